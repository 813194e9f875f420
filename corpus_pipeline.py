"""Corpus pipeline: quality, toxicity, near copies, source mix, byte-level BPE; each stage is one corpus operator.

Each stage takes ``(spark, docs, sf_dir)`` and works on what the stage before it kept; its result is written as Parquet
and read again as the next one's documents. All but the last return the columns of ``documents``. In every stage, columns of
any other name and type (dots and back quotes in names, names that the stages use themselves, maps) pass through as they are,
very long texts are read whole, and ties of scores fall to neither side of a threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import bpe, common, mixing, quality, simhash, toxicity


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts (score 0.5 or more).

    Null and empty texts get the score of no features; null ids and repeated rows are scored like others; without
    labels all documents stay (0.5); an empty table stays empty; extra columns pass through.
    """
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold (score under 0.7).

    Null and empty texts have no hits; null ids and repeated rows are scored like others; without labels all documents
    stay (0); an empty table stays empty; extra columns pass through.
    """
    return toxicity.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group: that of the smallest id, then of the smallest row hash; a null id comes last.

    Rows are told apart by id and hashes of all columns, so ids that are null or repeated lose no text; null and empty
    texts are one group (fingerprint zero); a row repeated as a whole stays once; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # two hashes of the text: rows of an id whose texts differ are told apart
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.xxhash64(F.lit(2), *common.hashable(docs, rest)).alias("h3")]
    key = ["doc_id", "h1", "h2", "h3"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), *key)).alias("best")
    kept = simhash.grouped(docs, more=hashes).groupBy("root").agg(best).select(*[F.col(f"best.{c}").alias(f"_{c}") for c in key])
    rows = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *hashes)
    rows = rows.join(kept, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left_semi")
    # a row repeated as a whole stays once: copies fold before they move
    return rows.groupBy(*key).agg(F.any_value("row").alias("row")).select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents once for each time that it takes them.

    A document taken in part is cut to its words, and ``n_chars`` follows its text. Null and empty texts hold no words,
    so no mix takes them; null ids and a null source are like others; an empty table stays empty.
    """
    out = mixing.mixed(docs)
    size = F.length("text").cast(out.schema["n_chars"].dataType) if "n_chars" in out.columns else None
    return out.select(*[size.alias(c) if c == "n_chars" else common.named(c) for c in out.columns])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents.

    Null and empty texts have no tokens; repeated rows get equal rows; an empty table stays empty.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Model fits, components and token merges have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.saved(docs, f"pipeline-{name}")
    return docs
