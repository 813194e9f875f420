"""Training-order materialisation: token ids packed into sequences, permuted, and written as fixed-stride shards.

Documents are tokenised (uint16 or uint32 ids, an end id after each), laid end to end in the order of a keyed hash of id
and text, and cut into sequences of ``SEQUENCE`` ids; the last one is filled up with the end id. The order, and so every
record, depends on rows and key alone, not on how the input is split. Places follow from sums of the documents' lengths
within ranges of that hash and over the ranges; ids stay in buckets by their partition, places come to them, and ids
move once, to their shard. A keyed Feistel network over the
smallest even number of bits that covers the number of sequences, with cycle-walking for values outside it, gives every
sequence its global slot: a bijection that needs no sort, no shuffle buffer and no table, and that can be inverted.
Slots are dealt to range partitions by number; each partition, sorted by slot, packs its records into shards of
``RECORDS`` records of equal stride, so slot s is record s mod RECORDS of shard s div RECORDS: reads are sequential and
resume anywhere. A shard is one row with a binary payload, written by Spark's committer, which survives lost executors;
``export`` turns these rows into plain files.

Defined cases: a null or empty text contributes its end id alone; a null id counts like no id in the hash; repeated
rows are documents of their own; very long texts span sequences; an empty table has no sequences. Only doc_id and text
are read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import bpe, common, mixing

SEQUENCE, RECORDS, KEY = 1024, 2048, 0x5EED
FEISTEL_ROUNDS = 6
#: Payload bytes of a range partition.
PART_BYTES = 16 << 20


def _scramble(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def permuted(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n - 1 at ``x``, or its inverse."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.asarray(x).astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> bits, x & mask
        for r in range(FEISTEL_ROUNDS)[:: -1 if inverse else 1]:
            if inverse:
                a, b = b ^ (_scramble(a, key + r) & mask), a
            else:
                a, b = b, a ^ (_scramble(b, key + r) & mask)
        return a << bits | b

    x = once(x)
    out = np.flatnonzero(x >= n)
    while len(out):  # values outside walk on along their cycle
        x[out] = once(x[out])
        out = out[x[out] >= n]
    return x.astype(np.int64)


def _tokenised(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        table = bpe.ranks(path)
        encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        end = max(table.values()) + 1
        kind = np.uint16 if end < 2**16 else np.uint32
        nth = 0
        for b in batches:
            ids = [np.array([*encoder.encode_ordinary(t.decode("utf-8", "replace")), end], kind).tobytes() for t in common.texts(b.column(2))]
            n = [len(x) // kind().itemsize for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(nth, nth + len(b))), b.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["part", "nth", "h", "n", "ids"])
            nth += len(b)

    return run


def _pieces(length: int, width: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The documents of a partition, cut at the sequences that their places fall in."""

    def run(held: pa.Table, places: pa.Table) -> pa.Table:
        held, places = held.sort_by("nth"), places.sort_by("nth")
        seqs, starts, out = [], [], []
        for at, ids in zip(places["at"].to_pylist(), held["ids"].to_pylist()):
            i, n = 0, len(ids) // width
            while i < n:
                seq, start = divmod(at + i, length)
                j = min(n, i + length - start)
                seqs.append(seq)
                starts.append(start)
                out.append(ids[i * width : j * width])
                i = j
        return pa.table({"seq": pa.array(seqs, pa.int64()), "start": pa.array(starts, pa.int32()), "ids": pa.array(out, pa.binary())})

    return run


def sequences(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, key: int = KEY) -> tuple[DataFrame, int, int]:
    """Pieces ``(seq, start, ids)`` of all sequences, the number of ids, and the bytes of an id."""
    spark, path = docs.sparkSession, path or bpe.vocabulary_path()
    common.bounded_batches(spark)
    width = 2 if max(bpe.ranks(path).values()) + 1 < 2**16 else 4
    text = F.col("text").cast("string")
    h = F.xxhash64(F.lit(key), F.col("doc_id").cast("long"), F.xxhash64(text), F.octet_length(text))
    src = docs.select(F.spark_partition_id().alias("part"), h.alias("h"), text.alias("text"))
    held = src.mapInArrow(_tokenised(path), "part int, nth long, h long, n long, ids binary")
    held = common.bucketed(held, "part", max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "order")
    sizes = held.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.count("*").alias("rows")).first()
    bits = mixing.fold(sizes["rows"])
    range_ = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    # equal hashes are equal documents: their places may be swapped
    lengths = held.select(F.lit(0).alias("all"), range_.alias("range"), "h", "part", "nth", "n")
    places = mixing.prefix(lengths, "all", "range", [F.col("h"), F.col("part"), F.col("nth")], F.col("n"), "at").select(*[F.col(c).alias(c) for c in ("part", "nth", "at")])
    met = held.select("part", "nth", "ids").groupBy("part").cogroup(places.groupBy("part"))
    return met.applyInArrow(_pieces(length, width), "seq long, start int, ids binary"), sizes["ids"], width


def _packed(n: int, length: int, width: int, records: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs pieces, sorted by slot and start, into shard rows."""
    fill = end.to_bytes(width, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slot, done, part = None, None, [], []

        def record() -> None:
            whole = b"".join(part)
            done.append(whole + fill * (length - len(whole) // width))

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([shard * records], pa.int64()), pa.array([len(done)], pa.int32()), pa.array([length * width], pa.int32()), pa.array([b"".join(done)], pa.binary())], ["shard", "first_slot", "records", "stride", "payload"])

        for b in batches:
            for s, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if s != slot and slot is not None:
                    record()
                    part = []
                    if s // records != shard:
                        yield row()
                        done = []
                if s != slot:
                    slot, shard = s, s // records
                part.append(ids)
        if slot is not None:
            record()
            yield row()

    return run


SHARDS = "shard long, first_slot long, records int, stride int, payload binary"


def shards(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, records: int = RECORDS, key: int = KEY) -> tuple[DataFrame, int, int]:
    """Shard rows in training order (a written table), the number of sequences and of ids."""
    spark, path = docs.sparkSession, path or bpe.vocabulary_path()
    pieces, total, width = sequences(docs, path, length, key)
    n = -(-total // length)
    if not n:
        return spark.createDataFrame([], SHARDS), 0, 0

    @F.pandas_udf("long")
    def slot(seq):
        return type(seq)(permuted(seq.to_numpy(), n, key))

    count = -(-n // records)
    parts = max(1, min(count, max(n * length * width // PART_BYTES, spark.sparkContext.defaultParallelism)))
    each = -(-count // parts)
    dealt = pieces.withColumn("slot", slot("seq")).withColumn("part", F.expr(f"slot div {records * each}").cast("int"))
    lined = dealt.select("slot", "start", "ids", "part").repartitionById(-(-count // each), F.col("part")).sortWithinPartitions("slot", "start")
    end = max(bpe.ranks(path).values()) + 1
    return common.saved(lined.select("slot", "ids").mapInArrow(_packed(n, length, width, records, end), SHARDS), "order-shards"), n, total


def _indexed(n: int, total: int, length: int, key: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, first, records, stride, payload in zip(*(c.to_pylist() for c in b.columns)):
                slots = np.arange(first, first + records)
                seq = permuted(slots, n, key, inverse=True)
                digest = [hashlib.sha256(payload[i * stride : (i + 1) * stride]).hexdigest() for i in range(records)]
                ids = np.minimum(length, total - seq * length)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(seq), pa.array([shard] * records, pa.int64()), pa.array(np.arange(records) * stride, pa.int64()), pa.array(ids), pa.array(digest)], ["slot", "seq", "shard", "byte_offset", "n_tokens", "record_sha256"])

    return run


def index(docs: DataFrame, **options) -> DataFrame:
    """One row for each written record, read from the shards: its slot, sequence, place and digest."""
    written, n, total = shards(docs, **options)
    return written.mapInArrow(_indexed(n, total, options.get("length", SEQUENCE), options.get("key", KEY)), "slot long, seq long, shard long, byte_offset long, n_tokens long, record_sha256 string")


def export(written: DataFrame, folder: str) -> None:
    """Writes each shard row as a plain file of a folder that all executors share, by an atomic rename."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, f"shard-{shard:08d}.bin")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    f.write(payload)
                os.replace(f"{path}.{os.getpid()}", path)
            yield b.select([0])

    written.select("shard", "payload").mapInArrow(run, "shard long").count()


def read(folder: str, slot: int, count: int, length: int = SEQUENCE, records: int = RECORDS, kind=np.uint16) -> Iterator[np.ndarray]:
    """Records from a slot on, in order, from exported files."""
    stride = length * np.dtype(kind).itemsize
    for s in range(slot, slot + count):
        with open(os.path.join(folder, f"shard-{s // records:08d}.bin"), "rb") as f:
            f.seek(s % records * stride)
            yield np.frombuffer(f.read(stride), kind)


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(common.table(spark, sf_dir, "documents"))
