"""Language identification by a bidirectional gated recurrent network over bytes (``bigru``).

Whole texts are cut into windows of ``WINDOW`` bytes; the network labels every position from both sides, and a
document's probability of a language is the mean over all its letter positions. The network is trained on windows from
at most about ``PER_LANGUAGE`` distinct training documents of each language and ``IN_ALL`` of all, ``WINDOWS`` from each,
spread over the whole text. It learns the ``LANGUAGES`` languages of most training documents (then by name), so stray
values of lang make neither the sample nor the network grow.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a null lang is not learned from; without
training rows every text is ``und``; repeated rows get equal answers; an empty table gives an empty result. Only
doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.llm.bigru import WINDOW, BiGru

#: Bounds of the training sample.
PER_LANGUAGE, IN_ALL, LANGUAGES, WINDOWS = 1500, 48_000, 256, 4
#: Windows that run side by side.
BESIDE = 2048


def has_letter(text: bytes) -> bool:
    low = text.lower()
    if low.upper() != low:
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace"))) if not text.isascii() else False


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text; the last window is filled with spaces."""
    a = np.full(-(-len(text) // WINDOW) * WINDOW, 32, np.uint8)
    a[: len(text)] = np.frombuffer(text, np.uint8)
    return a.reshape(-1, WINDOW)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, langs = [], []
        for t, lang in zip(common.texts(b.column(0)), b.column(1).to_pylist()):
            if has_letter(t):
                w = windows(t)
                for i in range(min(WINDOWS, len(w))):
                    out.append(w[i * len(w) // min(WINDOWS, len(w))].tobytes())
                    langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["w", "lang"])


def learn(docs: DataFrame) -> tuple[list[str], BiGru] | None:
    common.bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    src = src.where(F.col("lang").isNotNull() & (common.remainder("doc_id", 3) != 1))
    counts = src.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    most, each = 1 << 40, min(PER_LANGUAGE, IN_ALL // len(counts))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(most, int(each / r["n"] * most))) for r in counts], "lang string, share long")
    # the text counts too: rows of one id are thinned like others, and repeated rows are one
    thin = src.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(most)) < F.col("share"))
    got = thin.groupBy("lang", "doc_id", "text").agg(F.lit(1)).select("text", "lang").mapInArrow(_sampled, "w binary, lang string").toArrow()
    pairs = sorted(zip(got["lang"].to_pylist(), got["w"].to_pylist()))
    if not pairs:
        return None
    names = sorted({k for k, _ in pairs})
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(k) for k, _ in pairs])
    return names, BiGru(len(names)).fit(x, y)


def _predictor(model: tuple | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ts = common.texts(b.column(1))
            langs, scores = ["und"] * len(ts), np.zeros(len(ts))
            if model:
                names, net = model
                at = [i for i, t in enumerate(ts) if has_letter(t)]
                sums, seen = np.zeros((len(ts), len(names))), np.zeros(len(ts))
                held, owners, n = [], [], 0

                def flush() -> None:
                    x, who = np.concatenate(held), np.concatenate(owners)
                    for i in range(0, len(x), BESIDE):
                        s, k = net.pooled(np.ascontiguousarray(x[i : i + BESIDE].T))
                        np.add.at(sums, who[i : i + BESIDE], s)
                        np.add.at(seen, who[i : i + BESIDE], k)

                for i in at:
                    w = windows(ts[i])
                    held.append(w)
                    owners.append(np.full(len(w), i))
                    n += len(w)
                    if n >= 16 * BESIDE:
                        flush()
                        held, owners, n = [], [], 0
                if held:
                    flush()
                p = sums / np.maximum(seen, 1)[:, None]
                for i in at:
                    j = int(np.argmax(p[i]))
                    langs[i], scores[i] = names[j], min(1.0, float(p[i, j]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: tuple | None) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double")


def op9_language_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predicted(docs, learn(docs))
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
