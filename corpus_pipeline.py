"""A pipeline over ``documents``: each stage's result is written as Parquet and read as the next one's documents.

1. language: documents without a recognisable language go; a missing ``lang`` is filled in.
2. near_copies: of each component of near copies the document with the least id stays.
3. benchmarks: documents of which a twentieth or more is benchmark windows go.
4. secrets: every secret is replaced by a mark; all documents stay.
5. mixing: documents are taken by the weights of the domain-language-source tree, with the columns mix_domain,
   mix_epoch and mix_tokens.

Defined results: null and empty texts have no language and go in the first stage; texts of any length are read whole; of
repeated rows one stays, rows without a key all stay; an empty table gives no rows; other columns are kept, whatever their
names (one that is named like an added column gets ``_in`` behind its name).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, jaccard, language, mixing, secrets
from tidemark.llm.common import shared_dir, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs, secrets.fit(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.rule_weights(docs), mixing.domain_of())


STAGES = [
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("benchmarks", drop_contaminated),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Automata and classifiers are not expressible in SQL. The tests compare the near-copy stage with brute force and check
#: planted cases in the other stages, whose operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what is between them is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
