"""Helpers that the corpus operators share: shared-folder tables, splits, tokens, ranges and components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: ASCII white space: space and 0x09 to 0x0D. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bound of an Arrow batch handed to a Python worker; long texts make batches of fewer rows.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session bounds them as tightly."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jvm_dir.get() if jvm_dir.isDefined() else None
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evalloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evalloom/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")), F.lit(0)) % modulus


def words(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return text.lower().split()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (n + 1) and bytes of a string or binary Arrow array; a null is empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return off.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is empty."""
    if len(column) == 0:
        return []
    off, data = buffers(column)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Ints of ``width`` bytes, compressed: all lowest bytes first, then the next ones, since high bytes say little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    import zstandard

    lanes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(lanes.T).view(f"<i{width}").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Increasing unsigned ints of 64 bits, compressed."""
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64), 8)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, 8).view(np.uint64), dtype=np.uint64)


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """A table saved in the shared folder in buckets of ``key``: later groupings by it don't move its rows."""
    spark, name = df.sparkSession, f"evalloom_{tag}_{uuid.uuid4().hex}"
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    path = f"{shared_dir(spark)}/evalloom/{name}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


def finite(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN or infinite (never null)."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Vectors of one length, one a row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def named(column: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, named as they are."""
    return F.struct(*[named(c) for c in df.columns])


def _mapped(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_mapped(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _mapped(kind.elementType)


def hashable(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Columns in a form that can be hashed: what holds a map stands as JSON."""
    return [F.to_json(named(f.name), {"ignoreNullFields": "false"}) if _mapped(f.dataType) else named(f.name) for f in df.schema if columns is None or f.name in columns]


def total_bytes(df: DataFrame, text: str) -> int:
    return df.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def components(edges: DataFrame, tag: str = "cc", most: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large-star and small-star rounds.

    Returns ``(u, root)`` for each node that has an edge, ``root`` being the smallest node of its component (the
    root itself is not listed). Each round is written to the shared folder. Logarithmically many rounds suffice.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = saved(e, tag), None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = saved(e, tag)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return e.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")


def ranges(df: DataFrame, key: str, parts: int) -> list:
    """Increasing boundaries that cut the non-null values of ``key`` into about ``parts`` even ranges (a bounded list)."""
    if parts < 2:
        return []
    cut = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(cut or []))


def range_of(key: Column, bounds: list) -> Column:
    """The range that a value is in: the number of boundaries at or below it; 0 for a null."""
    if not bounds:
        return F.lit(0)
    n, lit = len(bounds), F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)])
    at = F.reduce(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.try_element_at(lit, at + step) <= key), at + step).otherwise(at))
    return F.coalesce(at, F.lit(0))
