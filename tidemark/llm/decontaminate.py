"""Benchmark decontamination with an FM-index per shard of training text.

Benchmark items are cut into windows of 13 words (an item of fewer words is one window). Each task takes its documents in
shards of bounded size. A shard's words are numbered by the benchmark's vocabulary; stretches in which every two
neighbouring words also neighbour each other in some item are all that can hold an occurrence, and they are what the
shard's FM-index stores: suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix with rank
tables, and suffix positions sampled by text position. All windows are searched backwards at once; occurrences are
located by walking to sampled positions, and the words they cover are merged into removal spans.

Words are told apart by their bytes: a hash only finds a word's place in the vocabulary. The benchmark is handled in blocks
of bounded size, one broadcast each. A task searches its shard for one block after the other and merges what it finds, so
no row is shuffled however many blocks there are.

Defined results: null and empty texts have no words and are not contaminated; texts of any length are searched whole;
repeated rows are judged each by itself; an empty benchmark hits nothing; an item without words or id is ignored; items
with one id count once; columns of other names, whatever they are, are not looked at, and ``decontaminated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, bounded_batches, mix64, numbered, pieces, table, words_of

WINDOW = 13
SAMPLE = 16
BLOCK_BYTES = 16 << 20
LOWER = ascii_lower()
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


class Phrases:
    """The windows of some benchmark items, in the numbers of the items' own vocabulary."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        items = sorted(items)
        _, _, data, offsets = next(pieces(pa.array([t for _, t in items], pa.large_string()), 1 << 62), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        start, end, row, word, data = words_of(data, offsets, WORD, LOWER)
        self.names = sorted({k for k, _ in items})
        place = {k: i for i, k in enumerate(self.names)}
        number = numbered(data, start, end, word)
        self.symbols = int(number.max(initial=0))
        self.vocabulary, first = np.unique(word, return_index=True)
        self.number = number[first]
        # The bytes of each vocabulary word, and apart from them words that share a hash.
        self.data, self.start, self.end = data, start[first], end[first]
        self.shared: dict[bytes, int] = {}
        if self.symbols > len(self.vocabulary):
            self.shared = {data[i:j].tobytes(): n for i, j, n in zip(start.tolist(), end.tolist(), number.tolist(), strict=True)}
        same = row[1:] == row[:-1]
        self.pairs = np.unique(mix64((number[:-1] << 32 | number[1:])[same].astype(np.uint64)))
        windows: dict[tuple[int, ...], set[int]] = {}
        first = np.searchsorted(row, np.arange(len(items) + 1))
        for i, (name, _) in enumerate(items):
            own = number[first[i] : first[i + 1]].tolist()
            for j in range(max(1, len(own) - window + 1) if own else 0):
                windows.setdefault(tuple(own[j : j + window]), set()).add(place[name])
        self.length = np.array([len(w) for w in windows], np.int64)
        self.matrix = np.zeros((len(windows), window), np.int64)
        for i, w in enumerate(windows):
            self.matrix[i, : len(w)] = w
        self.item = np.array([k for v in windows.values() for k in sorted(v)], np.int64)
        self.first = np.cumsum([0, *(len(v) for v in windows.values())])
        self.shortest = int(self.length.min()) if len(windows) else 0

    def numbers(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number that a word of this hash may have, 0 if none, and its place in the vocabulary."""
        place = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == word, self.number[place], 0), place

    def is_same(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether spans have the bytes of vocabulary words."""
        size = end - start
        same = size == self.end[place] - self.start[place]
        many = np.where(same, size, 0)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        apart = data[np.repeat(start, many) + step] != self.data[np.repeat(self.start[place], many) + step]
        same[np.repeat(np.arange(len(size)), many)[apart]] = False
        return same


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by prefix doubling over ranks."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(both[order[1:]] != both[order[:-1]])
        rank, step = new, step * 2
        if not n or rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Counts and locates patterns in a text of small positive numbers; 0 separates stretches."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, 0)
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.n, self.levels = n, max(1, int(symbols).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 2))])
        #: Wavelet matrix: for each bit from the highest, zeros before each place, and how many zeros there are.
        self.zeros: list[np.ndarray] = []
        level = bwt
        for b in range(self.levels - 1, -1, -1):
            bit = (level >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.bwt = bwt
        # The first place of each stretch is sampled too, so that no walk crosses a separator.
        sampled = (order % SAMPLE == 0) | (bwt == 0)
        self.sampled, self.rank, self.position = sampled, np.cumsum(sampled) - 1, order[sampled]

    def occurrences(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, at = np.zeros_like(before), before
        for b, zeros in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            one = (symbol >> b) & 1 == 1
            low = np.where(one, zeros[-1] + low - zeros[low], zeros[low])
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return at - low

    def search(self, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 of the suffixes that begin with each pattern."""
        first, last = np.zeros(len(matrix), np.int64), np.full(len(matrix), self.n, np.int64)
        for back in range(1, int(length.max(initial=0)) + 1):
            live = np.flatnonzero((length >= back) & (first < last))
            symbol = matrix[live, length[live] - back]
            first[live] = self.smaller[symbol] + self.occurrences(symbol, first[live])
            last[live] = self.smaller[symbol] + self.occurrences(symbol, last[live])
        return first, np.maximum(first, last)

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to a sampled one."""
        out, steps, live, at = np.zeros(len(place), np.int64), 0, np.arange(len(place)), place.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.position[self.rank[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol = self.bwt[at]
            at = self.smaller[symbol] + self.occurrences(symbol, at)
            steps += 1
        return out


def stretches(number: np.ndarray, row: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 word of the runs of linked words that are long enough for the shortest window."""
    link = (number[:-1] > 0) & (number[1:] > 0) & (row[1:] == row[:-1])
    at = np.flatnonzero(link)
    if len(phrases.pairs) and len(at):
        pair = mix64((number[at] << 32 | number[at + 1]).astype(np.uint64))
        place = np.minimum(np.searchsorted(phrases.pairs, pair), len(phrases.pairs) - 1)
        link[at] = phrases.pairs[place] == pair
    begins = np.concatenate([[0], np.flatnonzero(~link) + 1])
    ends = np.concatenate([begins[1:], [len(number)]])
    long = (ends - begins >= phrases.shortest) & (number[begins] > 0)
    return begins[long], ends[long]


def hits(words: tuple[np.ndarray, ...], phrases: Phrases):
    """Start and length of each occurrence in a shard, counted in words, and its window; ``words`` as by ``words_of``."""
    start, end, row, word, data = words
    none = np.zeros(0, np.int64)
    if not len(word) or not len(phrases.length):
        return none, none, none
    number, place = phrases.numbers(word)
    if phrases.shared:
        maybe = np.flatnonzero(number)
        number[maybe] = [phrases.shared.get(data[start[i] : end[i]].tobytes(), 0) for i in maybe.tolist()]
    begins, ends = stretches(number, row, phrases)
    if not len(begins):
        return none, none, none
    # The words of these stretches must have the bytes of the words whose hashes they have.
    size = ends - begins
    own = np.repeat(begins - np.cumsum(size) + size, size) + np.arange(size.sum())
    other = own[~phrases.is_same(data, start[own], end[own], place[own])] if not phrases.shared else own[:0]
    if len(other):
        number[other] = 0
        begins, ends = stretches(number, row, phrases)
        if not len(begins):
            return none, none, none
    size = ends - begins + 1
    origin = np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text = number[np.minimum(origin, len(number) - 1)]
    text[np.cumsum(size) - 1] = 0
    index = FMIndex(text, phrases.symbols)
    first, last = index.search(phrases.matrix, phrases.length)
    found = np.flatnonzero(last > first)
    many = (last - first)[found]
    rank = np.repeat(first[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    window = np.repeat(found, many)
    return origin[index.locate(rank)], phrases.length[window], window


def covered(n: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n words lie in an occurrence."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def shard_results(data: np.ndarray, offsets: np.ndarray, parts: Iterable[Phrases]):
    """Per row: number of words, merged spans in words, merged spans in bytes, and names of the items found."""
    text = words_of(data, offsets, WORD, LOWER)
    start, end, row = text[:3]
    n = len(offsets) - 1
    words = np.bincount(row, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(words)])
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    cuts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    items: list[set[str]] = [set() for _ in range(n)]
    hit = np.zeros(len(row), bool)
    for phrases in parts:
        at, length, window = hits(text, phrases)
        if not len(at):
            continue
        hit |= covered(len(row), at, length)
        count = phrases.first[window + 1] - phrases.first[window]
        flat = np.repeat(phrases.first[window] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        keys = np.unique(np.repeat(row[at], count) * len(phrases.names) + phrases.item[flat])
        for k in keys.tolist():
            items[k // len(phrases.names)].add(phrases.names[k % len(phrases.names)])
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        while a < b:  # a stretch may run over into the next rows
            r = int(row[a])
            stop = min(b, int(first_word[r + 1]))
            spans[r].append((a - int(first_word[r]), stop - int(first_word[r])))
            cuts[r].append((int(start[a] - offsets[r]), int(end[stop - 1] - offsets[r])))
            a = stop
    return words, spans, cuts, [sorted(x) for x in items]


def blocks(items: DataFrame, text: str = "text", key: str = "item_id", most: int = BLOCK_BYTES) -> Callable[[], Iterator[Phrases]]:
    """The items in blocks of about ``most`` bytes, broadcast one by one, for tasks to go through.

    The driver and each task hold one block at a time (a task keeps its block where there is only one).
    """
    known = items.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    n = (known.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // most + 1
    ctx = items.sparkSession.sparkContext
    shared = [ctx.broadcast(Phrases([(r["k"], r["t"]) for r in known.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).toLocalIterator()])) for i in range(n)]

    def each() -> Iterator[Phrases]:
        for b in shared:
            yield b.value
            if len(shared) > 1:
                del b._value  # read again for the next shard

    return each


SPANS = "array<struct<s:long,e:long>>"


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", most: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, spans (in words), cuts (in bytes), items (sorted strings)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    parts = blocks(items, key=items.columns[0], text=items.columns[1], most=most)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(1), 8 << 20):
                words, spans, cuts, names = shard_results(data, offsets, parts())
                hit = [sum(e - s for s, e in x) for x in spans]
                as_spans = lambda x: pa.array([[{"s": s, "e": e} for s, e in y] for y in x], span)
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), as_spans(spans), as_spans(cuts), pa.array(names, pa.list_(pa.string()))],
                    names=[key, "n_words", "n_hit", "spans", "cuts", "items"],
                )

    return docs.select(key, text).mapInArrow(search, f"`{key}` {kind}, n_words long, n_hit long, spans {SPANS}, cuts {SPANS}, items array<string>")


def judged(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest of ``find_contamination``: a document is contaminated if a twentieth of its words are hit."""
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged; a row goes if a twentieth of its words are hit."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    parts = blocks(items, key=items.columns[0], text=items.columns[1], most=most)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in pieces(batch.column(at), 8 << 20):
                words, spans, _, _ = shard_results(data, offsets, parts())
                hit = np.array([sum(e - s for s, e in x) for x in spans])
                yield batch.slice(a, b - a).filter(pa.array(~((hit > 0) & (20 * hit >= words))))

    return docs.mapInArrow(keep, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return judged(find_contamination(docs.select("doc_id", "text"), items.select("item_id", "text")))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
    SELECT item, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, dw.n AS n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
