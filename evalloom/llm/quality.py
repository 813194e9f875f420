"""Quality classifier: a pairwise additive model (``gam``) over counts of the whole text.

Features are numpy sums over each text's bytes, words and lines. Labels are learned from rows of the training fold
only, from at most about ``TRAIN_ROWS`` ids (those of smallest hash) and ``PER_ID`` texts of each, so that neither
repeated ids nor repeated rows make the sample grow; the model is a few lookup tables.

Defined cases: null and empty texts have all-zero features and get the model's score for these; null labels are not
learned from; an id with several label rows counts once, with the greatest of its labels; rows of one id and text
count once; without any training row every score is 0.5; repeated rows get equal scores; an empty table gives an empty result. Only doc_id, text and the label are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.llm.gam import PairwiseGam

#: Bound of the sample of labelled rows that the model is fitted on.
TRAIN_ROWS = 40_000
#: Texts of one id in the sample, about.
PER_ID = 4
THRESHOLD = 0.5

_CLASSES = (b"|", b"!", b"?", b".", b",", b"\n", b"#$%&*@^~=+<>{}[]\\_", b"\"'()-:;/")


def _class_matrix() -> np.ndarray:
    m = np.zeros((256, len(_CLASSES) + 5))
    for j, c in enumerate(_CLASSES):
        m[list(c), j] = 1
    m[65:91, -5] = 1  # capitals
    m[97:123, -4] = 1
    m[48:58, -3] = 1
    m[128:, -2] = 1
    m[[9, 10, 11, 12, 13, 32], -1] = 1
    return m


_MATRIX = _class_matrix()


def features(texts: list[bytes]) -> np.ndarray:
    """One row of features for each text."""
    hist, rest = np.zeros((len(texts), 256)), np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        if not t:
            continue
        hist[i] = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        w, lines = t.split(), t.split(b"\n")
        n = len(w)
        capitals = sum(map(bytes.isupper, w))
        again = sum(a == b for a, b in zip(w, w[1:]))
        rest[i] = (len(t), n, len(set(w)), capitals, again, len(lines), len(set(lines)), max(map(len, w), default=0))
    c = hist @ _MATRIX
    k = len(_CLASSES)
    size, n, distinct, capitals, again, lines, unlike, longest = (rest[:, j] for j in range(8))
    one = lambda a: np.maximum(a, 1.0)
    letters = one(c[:, k] + c[:, k + 1])
    columns = [c[:, j] / one(n) for j in range(k)]
    columns += [c[:, k] / letters, c[:, k + 2] / one(size), c[:, k + 3] / one(size), c[:, k + 4] / one(size)]
    columns += [np.log1p(n), size / one(n), distinct / one(n), capitals / one(n), again / one(n), unlike / one(lines), n / one(lines), np.log1p(longest)]
    return np.stack(columns, 1)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = features(common.texts(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b.column(1)], ["x", "y"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int | None = TRAIN_ROWS) -> DataFrame:
    """``(text, y)`` of the training fold's labelled rows, one label an id; all rows if ``most`` is None.

    Else from about ``most`` ids by their hash, at most about ``PER_ID`` texts of each by theirs; texts stay whole.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("double").alias("y")).where("_id is not null and y is not null").where(common.remainder("_id", 3) != 1)
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    if most is None:
        # labels grow with the documents: no broadcast at any size; texts of the other fold don't move
        return rows.where(common.remainder("_id", 3) != 1).join(known.hint("shuffle_hash"), "_id").select("text", "y")
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64(F.lit(9), "_id"), F.lit(1 << 40)) < int(most / n * (1 << 40)))
    # at most about TRAIN_ROWS ids: a bounded side, as are the ids of many rows among them
    sampled = rows.join(F.broadcast(known), "_id")
    many = sampled.groupBy("_id").agg(F.approx_count_distinct(F.xxhash64("text")).alias("_n")).where(F.col("_n") > PER_ID)
    kept = F.pmod(F.xxhash64(F.lit(10), "text"), F.lit(1 << 40)) < F.lit(float(PER_ID << 40)) / F.col("_n")
    texts = sampled.join(F.broadcast(many), "_id", "left").where(F.col("_n").isNull() | kept)
    return texts.groupBy("_id", "text").agg(F.max("y").alias("y")).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> PairwiseGam | None:
    common.bounded_batches(docs.sparkSession)
    got = training_rows(docs, labels, label).mapInArrow(_featured, "x array<double>, y double").toArrow()
    if not got.num_rows:
        return None
    y = got["y"].to_numpy()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    # the order of rows depends on scheduling: sort it away
    order = np.lexsort((y, *x.T))
    return PairwiseGam().fit(x[order], y[order])


def _scorer(model: PairwiseGam | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(features(common.texts(b.column(b.num_columns - 1)))) if model else np.full(len(b), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64())], [*b.schema.names[:-1], "score"])

    return run


def scored(docs: DataFrame, model: PairwiseGam | None) -> DataFrame:
    """``(row struct of all columns, doc_id, score)``."""
    src = docs.select(common.whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    return src.mapInArrow(_scorer(model), src.drop("_text").schema.add("score", "double"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns."""
    rows = scored(docs, fit(docs, labels)).where(F.col("score") >= threshold)
    return rows.select("row.*")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = fit(docs, labels)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = src.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
