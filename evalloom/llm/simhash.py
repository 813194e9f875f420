"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then the Hamming distance.

A 64-bit fingerprint is cut into four pieces of 16 bits. Two fingerprints that differ in at most two bits agree in at
least two whole pieces, so they share one of the six (pair of pieces, 32 bits) block keys: nothing is missed. Distinct
fingerprints (copies of a text fold into one row first) meet in their blocks:

* blocks of up to ``DENSE`` fingerprints are joined with themselves and each pair's distance is verified;
* in larger ones (thousands of near copies) pairs would grow with the square. There each fingerprint takes the 33 keys
  that lie within one bit of it outside the agreed pieces. Two fingerprints are within two bits exactly if they share
  such a key (their midpoint), so linking each to the smallest holder of its key, verified again, gives the same
  components with 33 rows a fingerprint.

Components come from star rounds (``common.components``). Nulls and empty texts: fingerprint zero, linked like any
other. Repeated rows stay rows; they share a fingerprint. A null id never becomes a component id unless its group has
no other. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

SEED, SHINGLE, DISTANCE = 42, 3, 2
PIECES = 4
#: Largest block that is joined pair by pair.
DENSE = 32

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority of the bits of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    w = common.words(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else [b" ".join(w)]
    h = np.fromiter(map(partial(xxh64_intdigest, seed=SEED), shingles), np.uint64)
    columns = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, j], minlength=256) @ _BITS for j in range(8)])
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter(map(fingerprint, common.texts(b.column(1))), np.uint64, len(b))
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(fp.view(np.int64))], [b.schema.names[0], *b.schema.names[2:], "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: list[Column] | None = None) -> DataFrame:
    """``(doc_id, fp long)``, one row for each row, with the columns ``more`` between them."""
    common.bounded_batches(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(more or []))
    return src.mapInArrow(_fingerprints, src.drop("text").schema.add("fp", "long"))


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """Verified links ``(u, v)`` between the distinct values of ``fp``: all of them, or in large blocks a spanning part."""
    size = 64 // PIECES
    mask = (1 << size) - 1
    keys, outside = [], []
    for k, pieces in enumerate(combinations(range(PIECES), 2)):
        a, b = (F.shiftrightunsigned("fp", p * size).bitwiseAND(F.lit(mask).cast("long")) for p in pieces)
        keys.append(F.struct(F.lit(k).alias("combo"), F.shiftleft(a, size).bitwiseOR(b).alias("block")))
        outside.append([bit for bit in range(64) if bit // size not in pieces])
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.combo", "k.block")
    sizes = rows.groupBy("combo", "block").agg(F.count("*").alias("n")).where("n > 1")
    rows = common.saved(rows.join(sizes, ["combo", "block"]), "simhash-blocks")
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE
    small = rows.where(F.col("n") <= dense)
    pairs = small.select("combo", "block", F.col("fp").alias("u")).join(small.select("combo", "block", F.col("fp").alias("v")), ["combo", "block"]).where("u < v").where(near("u", "v")).select("u", "v")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in bits]) for bits in outside])
    stars = rows.where(F.col("n") > dense).select("fp", "combo", "block", F.explode(F.element_at(flips, F.col("combo") + 1)).alias("flip")).select("fp", "combo", "block", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    hubs = stars.groupBy("combo", "block", "mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("far")).where("hub < far").drop("far")
    star = stars.join(hubs, ["combo", "block", "mid"]).select(F.col("fp").alias("u"), F.col("hub").alias("v")).where("u <> v").where(near("u", "v"))
    return pairs.union(star).distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: list[Column] | None = None) -> DataFrame:
    """``(doc_id, *more, fp, root, component_id)`` of every row; ``root`` is the smallest fingerprint of its group and names it."""
    fps = common.saved(fingerprints(docs, doc_id, text, more), "simhash-fp")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = common.saved(distinct, "simhash-distinct")
    roots = common.components(links(distinct.select("fp")), "simhash-cc")
    named = distinct.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = common.saved(named, "simhash-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(named.join(lowest, "root").select("fp", "root", "component_id"), "fp").select(*fps.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; ``component_id`` is the smallest id that links reach."""
    return grouped(docs, doc_id, text).select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
