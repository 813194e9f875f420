"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms (words, A-Z lower-cased) whose document frequency lies in a band: at least ``RAREST`` and at
most ``COMMONEST`` of all documents, counted over all of them. A term needs ``RAREST * N`` documents, so the lexicon has
at most (mean distinct terms of a document) / ``RAREST`` entries at any corpus size; that is what makes it fit a
broadcast. Documents of very many or very long terms could still make it large, so the bytes of its terms are counted
before they are collected, and more than ``LEXICON_BYTES`` of them raise an error. Each of ``SUBSETS`` keyed random subsets keeps a fixed share of
the lexicon, from 1/8 to 1/4096. A document's distinct band terms in a subset, sorted, are hashed: one part of the
fingerprint per subset (24 bits, 6 hex digits; no term: zeros). Thin subsets survive edits, thick ones tell texts apart.

Likeness of two fingerprints: equal parts over parts that are set in either. If neither has a part, 1 for equal
fingerprints and 0 otherwise; a text without band terms hashes all its distinct terms into one appended part instead.

Defined cases: a null text is empty; an empty text's fingerprint is all zeros, and two of them are alike (1); null ids
come last in the order; rows with the same id follow each other by the hash of their text; a single row is its own
next document; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

RAREST, COMMONEST = 1 / 2000, 1 / 5
#: Share of the lexicon that each subset keeps: four subsets for each power of two.
RATES = tuple(2.0**-p for p in range(3, 13) for _ in range(4))
SUBSETS = len(RATES)
SEED = 77
#: Most bytes of the lexicon's terms, each counted with ``TERM_BYTES`` more.
LEXICON_BYTES, TERM_BYTES = 1 << 29, 64
#: Text bytes per range of the order, and most ranges.
RANGE_BYTES, MOST_RANGES = 4 << 20, 1 << 13


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial document frequencies of a batch; the empty term counts documents, and their bytes under ``size``."""
    for b in batches:
        df, size = Counter(), 0
        for t in common.texts(b.column(0)):
            df.update(set(common.words(t)))
            size += len(t)
        df[b""] = len(b)
        n = pa.array(list(df.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), n, pa.array([*[0] * (len(df) - 1), size], pa.int64())], ["term", "n", "size"])


def lexicon(docs: DataFrame, text: str = "text", rarest: float = RAREST, commonest: float = COMMONEST) -> tuple[list[bytes], int, int]:
    """Sorted terms of the band, the number of documents and of text bytes."""
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_document_counts, "term binary, n long, size long")
    df = common.saved(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "imatch-df")
    all_ = df.where(F.octet_length("term") == 0).first()
    if all_ is None:
        return [], 0, 0
    n = all_["n"]
    band = df.where((F.octet_length("term") > 0) & (F.col("n") >= max(1.0, rarest * n)) & (F.col("n") <= max(1.0, commonest * n)))
    held = band.agg(F.sum(F.octet_length("term") + TERM_BYTES).alias("b")).first()["b"] or 0
    if held > LEXICON_BYTES:
        raise RuntimeError(f"the lexicon takes {held} bytes, more than its bound of {LEXICON_BYTES}")
    terms = sorted(bytes(t) for t in band.select("term").toArrow()["term"].to_pylist())
    return terms, n, all_["size"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Fingerprinter:
    """Fingerprints against one lexicon; ``parts`` gives 24-bit values, 0 for an empty subset."""

    def __init__(self, terms: list[bytes]):
        from xxhash import xxh64_intdigest

        self.digest = xxh64_intdigest
        self.place = {t: i for i, t in enumerate(terms)}
        self.keys = np.fromiter((xxh64_intdigest(t, SEED) for t in terms), np.uint64, len(terms))
        self.kept = np.zeros((len(terms), SUBSETS), bool)
        for k, rate in enumerate(RATES):
            salt = np.uint64((SEED + 1 + k) * 0x9E3779B97F4A7C15 % 2**64)
            self.kept[:, k] = _mix(self.keys ^ salt) < np.uint64(int(rate * 2**64))

    def parts(self, text: bytes) -> np.ndarray:
        distinct = set(common.words(text))
        out = np.zeros(SUBSETS + 1, np.int64)
        get = self.place.get
        at = [i for i in map(get, distinct) if i is not None]
        if at:
            at = np.sort(np.array(at))
            kept, keys = self.kept[at], self.keys[at]
            for k in np.flatnonzero(kept.any(0)):
                out[k] = 1 + self.digest(keys[kept[:, k]].tobytes(), int(k)) % (2**24 - 1)
        if distinct and not out.any():
            out[SUBSETS] = 1 + self.digest(b" ".join(sorted(distinct)), SEED) % (2**24 - 1)
        return out


def shown(parts: np.ndarray) -> str:
    return "".join("%06x" % p for p in parts.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    either = (a != 0) | (b != 0)
    n = int(either.sum())
    return float(((a == b) & either).sum() / n) if n else 1.0


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """Code points of the text, and the text with its last third replaced by as many of the following text's first."""
    t = text.decode("utf-8", "surrogateescape")
    k = len(t) // 3
    if not k:
        return len(t), text
    # four bytes a code point at most: no need to decode all of a long following text
    head = following[: 4 * k].decode("utf-8", "surrogateescape")[:k]
    return len(t), (t[: len(t) - k] + head).encode("utf-8", "surrogateescape")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(terms_b) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, held = None, None  # held: the row that waits for its next one
        for b in batches:
            maker = maker or Fingerprinter(terms_b.value)
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text, bucket, tail in zip(b.column(0).to_pylist(), common.texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                parts = maker.parts(text)
                if held is not None and held[3] == bucket:
                    n, e = edited(held[1], text)
                    ep = maker.parts(e) if e != held[1] else held[2]
                    for to, v in zip(rows, (held[0], n, hashlib.sha256(e).hexdigest(), shown(held[2]), shown(ep), likeness(held[2], ep), likeness(held[2], parts))):
                        to.append(v)
                held = None if tail else (doc_id, text, parts, bucket)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], [x.split()[0] for x in SCHEMA.split(", ")])

    return run


def compared(docs: DataFrame) -> DataFrame:
    """Each row with its edited text's and its next row's likeness (see the module)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    terms, n, size = lexicon(docs)
    shared = spark.sparkContext.broadcast(terms)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = min(MOST_RANGES, max(size // RANGE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > 1000 else 1)
    bounds = common.ranges(ids, "doc_id", parts)
    rows = ids.select("doc_id", "text", F.xxhash64("text").alias("h"), common.range_of(F.col("doc_id"), bounds).alias("bucket"))
    # the first row of each range also closes the range before it; the very first closes the last
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    first = {r["bucket"]: r["k"] for r in rows.groupBy("bucket").agg(F.max(key).alias("k")).collect()}
    order = sorted(first)
    closes = dict(zip(order, [*order[1:], order[0]])) if order else {}
    firsts = F.array(*[F.struct(F.lit(first[b]["doc_id"] if b in first else None).cast("long").alias("doc_id"), F.lit(first[b]["h"] if b in first else None).cast("long").alias("h"), F.lit(closes.get(b, -1)).alias("to"), F.lit(b in first and first[b]["h"] is None).alias("none")) for b in range(len(bounds) + 1)])
    f = F.element_at(firsts, F.col("bucket") + 1)
    donor = F.col("doc_id").eqNullSafe(f["doc_id"]) & F.col("h").eqNullSafe(f["h"])
    self_ = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("tail"))
    also = F.struct(f["to"].alias("bucket"), F.lit(True).alias("tail"))
    dealt = rows.select("doc_id", "text", "h", F.explode(F.when(donor, F.array(self_, also)).otherwise(F.array(self_))).alias("d")).select("doc_id", "text", "d.bucket", "d.tail", "h")
    lined = dealt.repartition(max(1, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return lined.select("doc_id", "text", "bucket", "tail").mapInArrow(_compare(shared), SCHEMA)


def op10_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(common.table(spark, sf_dir, "documents"))
