"""Corpus preparation: quality, language, near duplicates, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``.  All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import langid, packing, quality, secrets, similar
from verdance.llm.common import cut, drop_written, own_tables, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if, with DEVIATIONS of confidence, its best language knows a smaller share of its n-grams than LEAST_SHARE.
LEAST_SHARE, DEVIATIONS = 0.05, 2.0

#: SQL cannot express these stages (learned models, decoded structures, tokenizers).
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the co-trained quality classifier accepts.

    A null text counts as empty and null metadata as a value of its own; each row
    is judged by itself, so repeated rows share their fate; a score of just the
    threshold is accepted; an empty table gives an empty one.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=COLUMNS).where("accepted").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents with letters of whose n-grams some learned language may know ``LEAST_SHARE``.

    The share is judged by the upper end of its Wilson interval, so one rule holds
    for all lengths.  Null texts and those without a letter go, as does everything
    if no language was learned; repeated rows share their fate; a share of just
    the limit is enough; an empty table gives an empty one.
    """
    found = langid.identify(docs, langid.train(docs), keep=COLUMNS)
    p, n, z = F.col("share"), F.greatest(F.col("grams"), F.lit(1)), DEVIATIONS
    upper = (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (upper >= LEAST_SHARE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of SimHash near-duplicates (similarity 0.8 of five-word shingles).

    It is the one of least id (null ids last), then of least text digest; of repeated rows one stays.
    """
    found = cut(similar.near_duplicates(docs.select("doc_id", "text")), "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    chosen = cut(found.groupBy("group").agg(F.min(order).alias("x")).select("x.doc_id", "x.node"), "pipeline-chosen")
    keyed = docs.select(*COLUMNS, similar.text_digest("text").alias("node"))
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d.node") == F.col("c.node"))
    kept = keyed.alias("d").join(chosen.alias("c"), same, "left_semi")
    # Only a row that stands for others can be there twice.
    again = found.groupBy("doc_id", "node").count().where("count > 1").select("doc_id", "node")
    if again.isEmpty():
        return kept.select(*COLUMNS)
    return kept.dropDuplicates(["doc_id", "node"]).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace each secret by its kind in brackets; every document stays.

    A null text stays null; of overlapping findings the first names the kind;
    repeated rows are treated alike; an empty table gives an empty one.
    """
    found = secrets.scan(docs, keep=COLUMNS, redacted=True)
    changed = F.size("spans") > 0
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source", F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    A null or empty text is one piece of the end id; repeated rows and null ids are
    packed like any other; equal costs take the earlier cut; an empty table gives no piece.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's own tables and its input go when its result is written."""
    docs = table(spark, sf_dir, "documents")
    with own_tables():
        for name, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            drop_written(spark, keep_last=True)
    return docs
