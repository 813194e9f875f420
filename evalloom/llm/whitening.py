"""Whitening of vectors by a tiled covariance.

1. Rows are cut into row blocks of at most ``ROW_BLOCK`` rows, and each of these into column blocks of ``TILE``
   dimensions, packed and saved once. Column blocks give the sums of every dimension.
2. A pair of column blocks is a tile key. Column blocks go to the tile keys they belong to and meet there by row block;
   each meeting centres its two blocks by the means and multiplies them. A task adds its products up by tile, the sums
   of the tasks are added entry by entry.
3. The tiles (the square of the dimension, not of the rows) are assembled and decomposed on the driver.
4. Rows are centred, projected and divided by the roots of the eigenvalues; the covariance of what came out is taken in
   the same tiled way and compared with the identity.

Whole numbers stay whole until they are centred: sums and deviations are exact at any size.

Defined cases: a vector that is null, empty or holds null, NaN or infinite entries drops out, and so does one whose
length isn't the commonest (the longest of the commonest), since it has no covariance with the others; repeated rows and
null ids are rows like any other; components whose eigenvalue is zero to rounding (constant or dependent dimensions, a
single row) have no scale, so their ``whitened`` is null and they stay out of the identity's check, null if none is
left; an empty table gives an empty result. Only the id and the vector are read. The driver holds a few matrices of the
dimension squared; row counts don't reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

TILE, ROW_BLOCK, COMPONENTS = 32, 4096, 32
#: Whole numbers beyond this size are refused: doubles wouldn't hold them.
MOST = 1 << 52


def _cut(tile: int, kind: type):
    """Column blocks of row blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            x = common.matrix(b.column(0), kind)
            for at in range(0, len(x), ROW_BLOCK):
                part = x[at : at + ROW_BLOCK]
                starts = range(0, part.shape[1], tile)
                data = [common.packed(np.ascontiguousarray(part[:, s : s + tile]).view(np.int64).ravel(), 8) for s in starts]
                n = len(data)
                yield pa.RecordBatch.from_arrays([pa.array([block] * n), pa.array(range(n), pa.int32()), pa.array([len(part)] * n, pa.int32()), pa.array(data, pa.binary())], ["row_block", "col_block", "n", "data"])
                block += 1

    return run


def _block(data: bytes, n: int, kind: type) -> np.ndarray:
    return common.unpacked(data, 8).view(kind).reshape(n, -1)


def _summed(tile: int, kind: type):
    """Sums of each dimension, and rows (dimension -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, float] = {}
        for b in batches:
            for c, n, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                for j, s in enumerate(_block(data, n, kind).sum(0).tolist()):
                    sums[c * tile + j] = sums.get(c * tile + j, 0) + s
                if c == 0:
                    sums[-1] = sums.get(-1, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(sums.values(), pa.int64() if kind is np.int64 else pa.float64())], ["dim", "s"])

    return run


class Centre:
    """Means, kept as a whole part and a fraction where sums are whole, so that centring doesn't cancel digits."""

    def __init__(self, n: int, sums: list):
        self.n, self.sums = n, sums
        whole = sums and isinstance(sums[0], int)
        self.base = np.array([s // n for s in sums], np.int64) if whole else np.array(sums, np.float64) / n
        self.left = [s - n * int(b) for s, b in zip(sums, self.base)] if whole else [0] * len(sums)
        self.fraction = np.array([m / n for m in self.left])

    def __call__(self, x: np.ndarray, at: int = 0) -> np.ndarray:
        own = slice(at, at + x.shape[1])
        return (x - self.base[own]).astype(np.float64) - self.fraction[own]

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S) squared, exactly."""
        far = x - self.base
        if (int(np.abs(far).max(initial=0)) + 1) ** 2 * self.n**2 * max(1, x.shape[1]) < 1 << 62:
            d = far * self.n - np.array(self.left, np.int64)
            return (d * d).sum(1).tolist()
        return [sum((self.n * v - m) ** 2 for v, m in zip(row, self.left)) for row in far.tolist()]


def _products(tile: int, kind: type, centre: Centre):
    """Products of the column blocks that met, summed by tile over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, sides in zip(*(batch.column(i).to_pylist() for i in range(3))):
                x = {s["col_block"]: centre(_block(s["data"], s["n"], kind), s["col_block"] * tile) for s in sides}
                p = x[a].T @ x[b]
                sums[a, b] = sums[a, b] + p if (a, b) in sums else p
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))], ["a", "b", "p"])

    return run


def tiled_covariance(vectors: DataFrame, column: str, tile: int = TILE) -> tuple[Centre, np.ndarray] | None:
    """Centre and covariance (divisor n) of the vectors of one length in ``column`` (array of longs or doubles); None if there is no row."""
    kind = np.int64 if dict(vectors.dtypes)[column] == "array<bigint>" else np.float64
    common.bounded_batches(vectors.sparkSession)
    blocks = common.saved(vectors.select(column).mapInArrow(_cut(tile, kind), "row_block long, col_block int, n int, data binary"), "whiten-blocks")
    sums = blocks.select("col_block", "n", "data").mapInArrow(_summed(tile, kind), f"dim int, s {'long' if kind is np.int64 else 'double'}").groupBy("dim").agg(F.sum("s").alias("s"))
    sums = {r["dim"]: r["s"] for r in sums.collect()}
    if not sums.get(-1):
        return None
    n, d = int(sums.pop(-1)), max(sums) + 1
    centre = Centre(n, [sums[i] for i in range(d)])
    wide = -(-d // tile)
    sent = blocks.select("row_block", F.struct("col_block", "n", "data").alias("side"), "col_block", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("other"))
    met = sent.groupBy(F.least("col_block", "other").alias("a"), F.greatest("col_block", "other").alias("b"), "row_block").agg(F.collect_list("side").alias("sides"))
    parts = met.select("a", "b", "sides").mapInArrow(_products(tile, kind, centre), "a int, b int, p array<double>")
    total = parts.select("a", "b", F.posexplode("p").alias("at", "v")).groupBy("a", "b", "at").agg(F.sum("v").alias("v"))
    got = total.toArrow()
    a, b, at, v = (got.column(i).to_numpy() for i in range(4))
    across = np.minimum(tile, d - b.astype(np.int64) * tile)  # columns of this tile
    i, j = a.astype(np.int64) * tile + at // across, b.astype(np.int64) * tile + at % across
    cov = np.zeros((d, d))
    cov[i, j] = cov[j, i] = v / n
    return centre, cov


def _projected(centre: Centre, axes: np.ndarray):
    """Deviation and whitened values of each row, added to its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = common.matrix(b.column(0), np.int64)
            far = pa.array(map(str, centre.deviations(x)), pa.string())
            w = centre(x) @ axes
            yield pa.RecordBatch.from_arrays([*b.columns[1:], far, pa.array(list(w), pa.list_(pa.float64()))], [*b.schema.names[1:], "deviation", "w"])

    return run


def whitened(rows: DataFrame, column: str = "x", keys: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """``(*keys, component, n, deviation, whitened, explained, identity_error)`` of vectors of whole numbers.

    ``rows`` has ``column`` (array of longs, none null); rows of another than the commonest length drop out.
    ``deviation`` is a decimal(38,0).
    """
    spark, size = rows.sparkSession, F.size(column)
    common_size = rows.groupBy(size.alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    fit = rows.where(size == F.lit(common_size[0]["d"] if common_size else -1)).select(column, *keys)
    found = tiled_covariance(fit, column, tile)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fit.drop(column).schema)
    if found is None:
        return spark.createDataFrame([], f"{kinds}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    centre, cov = found
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    live = int((values > len(cov) * np.finfo(np.float64).eps * max(values[0], 0.0)).sum())
    scaled = axes[:, :live] / np.sqrt(values[:live])
    saved = common.saved(fit.mapInArrow(_projected(centre, scaled), f"{kinds}, deviation string, w array<double>"), "whiten-rows")
    after = tiled_covariance(saved, "w", tile) if live else None
    error = float(np.abs(after[1] - np.eye(live)).max()) if after else None
    share = np.maximum(values, 0) / np.trace(cov) if live else np.zeros(len(values))
    shares = F.array(*[F.lit(float(v)) for v in share])
    each = saved.select(*keys, "deviation", "w", F.explode(F.sequence(F.lit(1), F.lit(len(values)))).alias("component"))
    return each.select(
        *keys,
        "component",
        F.lit(centre.n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        F.try_element_at("w", "component").alias("whitened"),
        F.element_at(shares, F.col("component")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def whole(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """Entries as whole numbers: floor(scale c) + offset. Entries too large for a double's whole numbers are an error."""
    return F.transform(vector, lambda c: F.when(F.abs(c * scale) < MOST, F.floor(c * scale).cast("long") + offset).otherwise(F.raise_error("an entry is too large to be a whole number").cast("long")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = common.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = src.where(common.finite(F.col("v"))).select("vec_id", whole(F.col("v")).alias("x"))
    return whitened(rows).withColumn("deviation", F.col("deviation").cast("long"))
