"""Secret scan: base patterns, and probabilistic automata inferred from labelled credentials.

A token is read as a word over classes of its runs: every character of a run of letters and digits counts as its run's
class (hex with digits in it, lower case, upper case, mixed, base64 and so on), dots, dashes and underscores stand for
themselves. Fitting builds a frequency prefix tree of the labelled credentials of each kind over these words and merges
states whose outgoing frequencies, the end's among them, do not differ by the Hoeffding bound, folding their subtrees
together. The result is a probabilistic deterministic automaton of the kind's format, which keeps the lengths and the
places of marks that the labels share. A further automaton is inferred from ordinary tokens.

Every candidate token of every text is scored. It is a secret if some kind's likelihood of it reaches that of nine in
ten of the kind's own labels, and if the log likelihood ratio to the ordinary automaton is above that of all
ordinary tokens of its band of lengths. Ordinary are tokens outside base matches that change less than three times
between letters and digits or stand in more than one document of the sample, and tokens made by rule.

Bounds of the fit, all parameters: about ``rows`` documents; of them at most ``labels`` distinct labels of each kind and,
apart from them, at most ``words`` distinct ordinary tokens; ``per_kind`` labels of each kind make an automaton; labels and
ordinary tokens of over 200 characters are not learned from. Scanning has no bounds.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows are scanned each by itself;
an empty table gives no rows; other columns, whatever their names, are not looked at, and ``without_secrets`` keeps them.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, bounded_sample, cut, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex", "format")
#: Tokens from the least length of a base value on; dots within them, not around them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{4,}[A-Za-z0-9+/_=-]")
#: Lengths from which ordinary tokens set a threshold of their own.
BANDS = (8, 12, 20)
END = "$"
#: Bounds of the fit's samples: distinct labels of each kind, and distinct ordinary tokens.
LABELS, WORDS = 2000, 20_000
#: Labels of a kind that make its automaton.
PER_KIND = 300


RUN = re.compile(r"[A-Za-z0-9+/=]+|[._-]")
HEX_RUN, HEX_UPPER = re.compile(r"[0-9a-f]+"), re.compile(r"[0-9A-F]+")
BASE64 = re.compile(r"(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])")


def run_class(run: str) -> str:
    """One of: l lower, u upper, t one capital first, d digits, x and X hex, n and N letters of one case and digits, m mixed cases, b base64, p other with + / =."""
    if run.isalnum():
        if run.isdigit():
            return "d"
        if run.isalpha():
            return "l" if run.islower() else "u" if run.isupper() else "t" if run[0].isupper() and run[1:].islower() else "m"
        if run.islower():
            return "x" if HEX_RUN.fullmatch(run) else "n"
        if run.isupper():
            return "X" if HEX_UPPER.fullmatch(run) else "N"
        return "m"
    return "b" if BASE64.match(run) else "p"


def symbols(token: str) -> str:
    """The token's word over the classes of its runs."""
    if token.isalnum():
        return run_class(token) * len(token)
    return "".join(r if r in "._-" else run_class(r) * len(r) for r in RUN.findall(token))


ALPHABET = "lutdxXnNmbp._-" + END


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base matches, leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


class Automaton:
    """A probabilistic deterministic automaton, inferred by state merging."""

    def __init__(self, words: Iterable[str], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for word, n in sorted(Counter(words).items()):
            state = 0
            for c in word:
                self.count[state][c] = self.count[state].get(c, 0) + n
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][c]
            self.count[state][END] = self.count[state].get(END, 0) + n
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self._finish()

    def _differs(self, a: int, b: int) -> bool:
        p, q = self.count[a], self.count[b]
        n, m = sum(p.values()), sum(q.values())
        if not n or not m:
            return False
        most = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return any(abs(p.get(c, 0) / n - q.get(c, 0) / m) > most for c in p.keys() | q.keys())

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            if self._differs(x, y):
                return False
            stack += [(self.next[x][c], self.next[y][c]) for c in self.next[x].keys() & self.next[y].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree under b to a."""
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            for c, n in self.count[y].items():
                self.count[x][c] = self.count[x].get(c, 0) + n
            for c, t in self.next[y].items():
                if c in self.next[x]:
                    stack.append((self.next[x][c], t))
                else:
                    self.next[x][c] = t

    def _merge(self) -> None:
        """Red states are kept; each blue state (a child of a red one) is merged into a compatible red one or becomes red."""
        red, known = [0], {0}
        while True:
            blue = min(((-sum(self.count[t].values()), t, r, c) for r in red for c, t in self.next[r].items() if t not in known), default=None)
            if blue is None:
                break
            _, state, parent, c = blue
            to = next((r for r in red if self._compatible(r, state)), None)
            if to is None:
                red.append(state)
                known.add(state)
            else:
                self.next[parent][c] = to
                self._fold(to, state)
        place = {r: i for i, r in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[r].items()} for r in red]
        self.count = [self.count[r] for r in red]

    def _finish(self) -> None:
        """Log probabilities with add-half smoothing over the classes; an unseen step stays where it is."""
        self.log = []
        for counts in self.count:
            total = sum(counts.values()) + 0.5 * len(ALPHABET)
            self.log.append({c: math.log((counts.get(c, 0) + 0.5) / total) for c in ALPHABET})

    def score(self, word: str) -> float:
        """Log likelihood, the end included."""
        state, total = 0, 0.0
        for c in word:
            total += self.log[state][c]
            state = self.next[state].get(c, state)
        return total + self.log[state][END]


class SecretModel:
    """Automata of the labelled kinds and of ordinary tokens, and what a candidate must reach."""

    def __init__(self, labelled: list[tuple[str, str]], ordinary: list[str], per_kind: int = PER_KIND, usual: list[str] | None = None):
        """``usual``: of the ordinary tokens, those that set the thresholds (all if None)."""
        kinds = sorted({k for k, _ in labelled})
        pick = lambda xs: sorted(set(xs), key=lambda x: hashlib.md5(x.encode()).digest())[:per_kind]
        chosen = {k: [symbols(x) for x in pick(v for kind, v in labelled if kind == k)] for k in kinds}
        self.formats = {k: Automaton(v) for k, v in chosen.items()}
        #: What nine in ten of the kind's labels reach.
        self.floor = {k: sorted(map(self.formats[k].score, v))[len(v) // 10] - 1e-9 for k, v in chosen.items()}
        made = made_ordinary()
        self.ordinary = Automaton(map(symbols, sorted({*ordinary, *made})))
        self.known: dict[str, float] = {}
        #: By band of lengths, above every usual token, with a margin.
        self.least = [1.0] * (len(BANDS) + 1)
        for x in sorted({*(ordinary if usual is None else usual), *made}):
            if (r := self.ratio(x)) > -math.inf:
                band = bisect(BANDS, len(x))
                self.least[band] = max(self.least[band], r + 0.5)
        self.known = {}

    def ratio(self, token: str) -> float:
        """Log likelihood ratio of the best kind whose floor is reached, to the ordinary automaton; else minus infinity."""
        word = symbols(token)
        if (r := self.known.get(word)) is None:
            r = max((x for k, a in self.formats.items() if (x := a.score(word)) >= self.floor[k]), default=-math.inf)
            r = r if r == -math.inf else r - self.ordinary.score(word)
            if len(word) <= 40:
                if len(self.known) >= 100_000:
                    self.known = {}
                self.known[word] = r
        return r

    def likely(self, token: str) -> bool:
        return self.ratio(token) >= self.least[bisect(BANDS, len(token))]

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """Base spans and, apart from them, the candidates whose format is likely; ordered by start and kind."""
        base = base_spans(text)
        # Stretches that base spans cover, in order; candidates ascend, so each is looked at once.
        taken: list[list[int]] = []
        for s, _, e in base:
            if taken and s <= taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], e)
            else:
                taken.append([s, e])
        more, at = [], 0
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            # A dotted token is a candidate, and so is each of its parts.
            parts = [(s, e)] if "." not in m[0] else [(s, e), *((s + x.start(), s + x.end()) for x in PART.finditer(m[0]))]
            near = at
            for i, j in parts:
                if i == s:
                    near = at
                while near < len(taken) and taken[near][1] <= i:
                    near += 1
                if near < len(taken) and taken[near][0] < j:
                    continue
                if self.likely(text[i:j]):
                    more.append((i, 3, j))
                    if j - i == e - s:
                        break
        return sorted(base + more)


PART = re.compile(r"[^.]{6,}")
SWITCH = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")


def made_credentials(per_kind: int = 150) -> list[tuple[str, str]]:
    """Labelled credentials of well-known shapes, made by rule, so that every kind has some whatever the corpus holds."""
    out = []
    sets = {
        "access": ("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16),
        "hex32": ("", "0123456789abcdef", 32),
        "hex40": ("", "0123456789abcdef", 40),
        "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 40),
    }
    for kind, (head, letters, n) in sets.items():
        for i in range(per_kind):
            data = b"".join(hashlib.sha256(f"{kind}:{i}:{j}".encode()).digest() for j in range(2))
            out.append((kind, head + "".join(letters[x % len(letters)] for x in data[:n])))
    return out


def made_ordinary(each: int = 40) -> list[str]:
    """Ordinary tokens made by rule: numbers, dates and times, versions and addresses, words joined by marks, runs of one letter."""
    out = []
    for i in range(each):
        x = list(hashlib.sha256(f"ordinary:{i}".encode()).digest())
        digits = "".join(str(v % 10) for v in x)
        words = ["".join("etaoinshrdlucmfwypvbgk"[v % 22] for v in x[j : j + 3 + x[j] % 9]) for j in (0, 6, 12, 18)]
        date = f"{1970 + x[0] % 70}-{1 + x[1] % 12:02}-{1 + x[2] % 28:02}"
        time = f"{x[3] % 24:02}-{x[4] % 60:02}-{x[5] % 60:02}"
        out += [digits[: 6 + i % 26], date, date.replace("-", "/"), f"{date}T{time}", f"{date}T{time}_{date[:4]}", f"{date}_{time}", ".".join(digits[3 * j : 3 * j + 1 + x[j] % 3] for j in range(4))]
        out += [mark.join(words[: 2 + i % 3]) for mark in "_-/."] + ["_".join(words).upper(), words[0].title() + words[1].title(), f"{words[0]}_{digits[: 1 + i % 4]}", "abxyzXD0"[i % 8] * (6 + i)]
    return sorted({x for x in out if len(x) >= 6})


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", rows: int = 20_000, labels: int = LABELS, words: int = WORDS) -> SecretModel:
    """Fits on base matches as labels, in a sample of about ``rows`` rows, and on credentials made by rule.

    Of the distinct labels in it at most ``labels`` of each kind are taken, and apart from them at most ``words`` ordinary tokens.
    """
    bounded_batches(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                base = base_spans(t)
                own = {(KINDS[k], ASSIGN.match(t, s)[2] if k == 0 else t[s:e]) for s, k, e in base}
                rest, at = [], 0
                for s, _, e in base:
                    rest.append(t[at:s])
                    at = max(at, e)
                own.update(("", w) for part in (*rest, t[at:]) for w in CANDIDATE.findall(part))
                found.update(own)
            rows = sorted(found)
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.string()), pa.array([w for _, w in rows], pa.string()), pa.array([found[x] for x in rows], pa.int64())], names=["kind", "word", "n"])

    sample = bounded_sample(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), rows, "k").select("t")
    got = sample.mapInArrow(gather, "kind string, word string, n long").where(F.length("word") <= 200).groupBy("kind", "word").agg(F.sum("n").alias("n"))
    few = lambda where, most: got.where(where).orderBy(F.xxhash64("word"), "word").limit(most)
    got = cut(docs.sparkSession, got)
    got = reduce(DataFrame.unionAll, [few(F.col("kind") == k, labels) for k in KINDS[:3]], few("kind = ''", words)).collect()
    labelled = [(r["kind"], r["word"]) for r in got if r["kind"]]
    secret = {w for _, w in labelled}
    ordinary = [r for r in got if not r["kind"] and r["word"] not in secret]
    usual = [r["word"] for r in ordinary if r["n"] > 1 or len(SWITCH.findall(r["word"])) < 3]
    return SecretModel(labelled + made_credentials(), [r["word"] for r in ordinary], usual=usual)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal covered stretch replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def scan_secrets(docs: DataFrame, model: SecretModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: the key, counts and digest of base spans, all spans, the text without them."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.scan(t or "") for t in batch.column(1).to_pylist()]
            counts = [np.bincount([k for _, k, _ in x], minlength=4) if x else (0, 0, 0, 0) for x in found]
            digest = [hashlib.sha256(listed([y for y in x if y[1] < 3]).encode()).hexdigest() for x in found]
            yield pa.record_batch(
                [batch.column(0), *(pa.array([int(c[i]) for c in counts], pa.int64()) for i in range(4)), pa.array(digest, pa.string()), pa.array([listed(x) for x in found], pa.string())],
                names=[key, "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")


def without_secrets(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with every span of the text replaced by a mark."""
    bounded_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t and redact(t, model.scan(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit(docs))
