"""Mixing sources to target weights, in DataFrame functions only.

The tree is domain, language, source. A budget of tokens goes down from the root by integer weights. A node can hold at most
``epochs`` times the tokens below it; what it cannot hold goes to its siblings in proportion to their weights as far as they
have room, and since a node's room is the sum of its leaves' room, only what a whole family cannot hold reaches the
family's own siblings. All sums are exact integers: shares are rounded down and the rest goes to the largest remainders.

A leaf takes its budget as a prefix of a stream of epochs. Each epoch is the leaf's documents in the order of
md5(seed:epoch:key); the document in which the budget ends is taken in part. Only the hash bucket in which the prefix ends
is sorted, so no leaf, however large, is sorted in one task.

Tokens are runs of characters other than ASCII white space. Defined results: null and empty texts have no tokens and are
not taken; null domains, languages and sources are the empty name; nodes without a weight or with one of 0 get nothing;
rows that repeat a key stand together in the order and are each taken by themselves; an empty table gives no rows; all
columns are kept, whatever their names: one that has the name of an added column gets ``_in`` behind its own.

A task's share is bounded: the prefix's last bucket is a 4096th of its leaf, and budgets go down the tree in windows of
one node's children, which are as many as the corpus has names for them, not documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, table

LEVELS = ("domain", "language", "source")
BROADCAST_LEAVES = 10_000
DIGITS = 3
NUMBER = "decimal(38,0)"


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Splits each parent's ``budget`` among its children by ``weight`` and up to ``room``; column ``share``.

    Children in the order in which they fill up: the first that would not fill up by the weights of those left, and all
    after it, share what is left by weight; all before it are full.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(1))
    order = by.orderBy("fills", name)
    before, left = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = children.where("weight > 0 and room > 0").withColumn("fills", F.col("room").cast("double") / F.col("weight"))
    d = d.withColumns({"full": F.coalesce(F.sum("room").over(before), F.lit(0)).cast(NUMBER), "weights": F.sum("weight").over(left).cast(NUMBER)})
    d = d.withColumn("rest", F.greatest(F.col("budget") - F.col("full"), F.lit(0)).cast(NUMBER))
    d = d.withColumn("open", F.col("rest") * F.col("weight") <= F.col("room").cast(NUMBER) * F.col("weights"))
    d = d.withColumns({"open": F.max(F.col("open").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1})
    first = F.min(F.when(F.col("open"), F.struct("fills", name, "rest", "weights"))).over(by)
    d = d.withColumn("first", first)
    product = (F.col("first.rest") * F.col("weight")).cast(NUMBER)
    d = d.withColumns({"low": F.when(F.col("open"), F.floor(product / F.col("first.weights")).cast("long")).otherwise(F.col("room"))})
    # The quotient of decimals may be rounded up; whole numbers decide.
    d = d.withColumn("low", F.when(F.col("open") & (F.col("low").cast(NUMBER) * F.col("first.weights") > product), F.col("low") - 1).otherwise(F.col("low")))
    d = d.withColumn("part", F.when(F.col("open"), product - F.col("low").cast(NUMBER) * F.col("first.weights")).otherwise(F.lit(0)).cast(NUMBER))
    spare = F.least(F.col("budget"), F.sum("room").over(by)) - F.sum("low").over(by)
    d = d.withColumns({"spare": spare, "place": F.row_number().over(by.orderBy(F.col("part").desc(), name))})
    return d.withColumn("share", F.col("low") + F.when((F.col("place") <= F.col("spare")) & (F.col("part") > 0), 1).otherwise(0))


def leaf_budgets(leaves: DataFrame, weights: dict[str, DataFrame], total: int, epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget); ``weights`` has a table (name, weight) for each level."""
    room = leaves.withColumn("room", F.col("tokens") * epochs)
    nodes = None
    for depth, level in enumerate(LEVELS):
        path = list(LEVELS[: depth + 1])
        own = room.groupBy(*path).agg(F.sum("room").alias("room")).join(weights[level].select(F.col("name").alias(level), "weight"), level)
        own = own.withColumn("budget", F.lit(total).cast("long")) if nodes is None else own.join(nodes, list(LEVELS[:depth]))
        nodes = shares(own, path[:-1], level).select(*path, F.col("share").alias("budget"))
    return leaves.join(nodes, list(LEVELS)).where("budget > 0")


def small(leaves: DataFrame) -> DataFrame:
    """The leaves, to be broadcast if they are few."""
    return F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves


def mix(docs: DataFrame, weights: dict[str, DataFrame], domain: Column, total: int | None = None, epochs: int = 4, seed: str = "mix", text: str = "text", key: str = "doc_id", language: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are taken, once for each epoch, with ``mix_domain``, ``mix_epoch`` and ``mix_tokens``.

    ``total``: tokens to take; all that there are if None.
    """
    spark = docs.sparkSession
    names = {"domain": domain, "language": F.col(language), "source": F.col(source)}
    path = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in names.items()]
    leaf = list(LEVELS)
    # The caller's row is one column from here on, so that no name of it meets a helper's.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    marked = docs.select(row, *path, tokens_of(F.col(text)).alias("tokens"), F.col(key).alias("key"), F.xxhash64(text).alias("said")).where("tokens > 0")
    leaves = cut(spark, marked.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")))
    if total is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, weights, total, epochs)
    budgets = cut(spark, budgets.select(*leaf, F.expr("budget div tokens").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("whole").cast("string"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"))
    placed = marked.join(small(budgets), leaf).withColumn("order", order).withColumn("bucket", F.substring("order", 1, DIGITS))

    sizes = placed.where("rest > 0").groupBy(*leaf, "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("bucket"))
    last = sizes.withColumn("upto", upto).where("upto >= rest and upto - n < rest").select(*leaf, F.col("bucket").alias("last"), (F.col("upto") - F.col("n")).alias("before"))
    ready = placed.join(small(cut(spark, last)), leaf, "left")
    row_order = Window.partitionBy(*leaf).orderBy("order", "key", "said").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = ready.where(F.col("bucket") == F.col("last")).withColumn("start", F.col("before") + F.sum("tokens").over(row_order) - F.col("tokens"))
    split = split.select("row", "domain", "whole", "tokens", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - F.col("start"))).alias("part"))
    part = F.when(F.col("bucket") < F.col("last"), F.col("tokens")).otherwise(F.lit(0).cast("long")).alias("part")
    clear = ready.where(F.col("last").isNull() | (F.col("bucket") != F.col("last"))).select("row", "domain", "whole", "tokens", part)
    every = clear.unionByName(split).where("whole > 0 or part > 0")
    taken = every.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    taken = taken.withColumn("take", F.when(F.col("epoch") < F.col("whole"), F.col("tokens")).otherwise(F.col("part"))).where("take > 0")
    own, added = [], ("mix_domain", "mix_epoch", "mix_tokens")
    used = {c.lower() for c in (*docs.columns, *added)}
    for c in docs.columns:
        name = c
        while name.lower() in added or (name != c and name.lower() in used):
            name += "_in"
        used.add(name.lower())
        own.append(F.col("row").getField(c).alias(name))
    return taken.select(*own, F.col("domain").alias(added[0]), F.col("epoch").alias(added[1]), F.col("take").alias(added[2]))


#: Query parameters: the domain of a source by a rule, and the weights of the tree's nodes.
DOMAINS = 4
LANGUAGE_WEIGHTS = {"en": 5, "de": 3, "fr": 3, "es": 2}


def domain_of(source: str = "source") -> Column:
    """Domains are dealt by the first hex digit of the source's MD5."""
    digit = F.conv(F.substring(F.md5(F.coalesce(F.col(source), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("d"), (digit % DOMAINS).cast("string"))


def rule_weights(docs: DataFrame) -> dict[str, DataFrame]:
    """Domain k weighs k + 1, languages as listed and others 1, sources 1 each."""
    name = lambda c: docs.select(F.coalesce(c, F.lit("")).alias("name")).distinct()
    listed = F.create_map(*(F.lit(x) for kv in LANGUAGE_WEIGHTS.items() for x in kv))
    return {
        "domain": docs.sparkSession.range(DOMAINS).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("name"), (F.col("id") + 1).alias("weight")),
        "language": name(F.col("lang")).withColumn("weight", F.coalesce(F.element_at(listed, F.col("name")), F.lit(1)).cast("long")),
        "source": name(F.col("source")).withColumn("weight", F.lit(1).cast("long")),
    }


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    taken = mix(docs, rule_weights(docs), domain_of(), total=None)
    return taken.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"))


def _sql_shares(name: str, children: str, parents: str) -> str:
    """``shares`` in SQL: children (parents, name, weight, room, budget) and the column share."""
    by = f"PARTITION BY {parents}" if parents else "PARTITION BY 1"
    order = f"{by} ORDER BY fills, {name}"
    return f"""
SELECT *, low + CASE WHEN part > 0 AND row_number() OVER ({by} ORDER BY part DESC, {name}) <= least(budget, sum(room) OVER ({by})) - sum(low) OVER ({by}) THEN 1 ELSE 0 END AS share FROM (
  SELECT *, CASE WHEN open THEN frest * weight // fweights ELSE room END AS low, CASE WHEN open THEN frest * weight % fweights ELSE 0 END AS part FROM (
    SELECT *, first_value(CASE WHEN open THEN rest END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS frest,
      first_value(CASE WHEN open THEN weights END IGNORE NULLS) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fweights FROM (
      SELECT *, max(CASE WHEN rest * weight <= room * weights THEN 1 ELSE 0 END) OVER ({order} ROWS UNBOUNDED PRECEDING) = 1 AS open FROM (
        SELECT *, greatest(budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
        FROM (SELECT *, CAST(room AS DOUBLE) / weight AS fills FROM ({children}) WHERE weight > 0 AND room > 0)))))"""


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, lang, source, 'd' || (strpos('0123456789abcdef', md5(coalesce(source, ''))[1]) - 1) % {DOMAINS} AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS src,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS tokens FROM documents
), t AS (SELECT * FROM d WHERE tokens > 0
), leaf AS (SELECT domain, language, src, sum(tokens) AS tokens, 4 * sum(tokens) AS room FROM t GROUP BY ALL
), one AS ({_sql_shares("domain", "SELECT domain, CAST(substr(domain, 2) AS HUGEINT) + 1 AS weight, sum(room) AS room, (SELECT sum(tokens) FROM leaf) AS budget FROM leaf GROUP BY domain", "")}
), two AS ({_sql_shares("language", "SELECT l.domain, l.language, CAST(CASE l.language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHTS.items()) + " ELSE 1 END AS HUGEINT) AS weight, sum(l.room) AS room, any_value(one.share) AS budget FROM leaf l JOIN one USING (domain) GROUP BY l.domain, l.language", "domain")}
), three AS ({_sql_shares("src", "SELECT l.domain, l.language, l.src, CAST(1 AS HUGEINT) AS weight, l.room, l.tokens AS held, two.share AS budget FROM leaf l JOIN two USING (domain, language)", "domain, language")}
), b AS (SELECT domain, language, src, share // held AS whole, share % held AS rest FROM three WHERE share > 0
), o AS (
  SELECT t.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, language, src ORDER BY md5('mix:' || whole || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM t JOIN b USING (domain, language, src)
), e AS (SELECT *, unnest(range(0, CAST(whole AS BIGINT) + 1)) AS epoch FROM o
), r AS (SELECT doc_id, domain, lang, source, epoch, CASE WHEN epoch < whole THEN tokens ELSE greatest(0, least(tokens, rest - start)) END AS tokens FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS BIGINT) AS epoch, CAST(tokens AS BIGINT) AS tokens FROM r WHERE tokens > 0
"""
