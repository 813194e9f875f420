"""Language-model scoring with a probabilistic suffix tree over tokens.

A text is a sequence of tokens: its words (A-Z lower-cased) and one end. The tree predicts each token from the tokens
before it in the document, behind one start. ``score`` is a log10 probability of the same token sequence that the unigram
``base_score`` rates: of V known words and one unknown symbol.

* Root: training counts of the tokens; the unknown symbol gets the Good-Turing mass (tokens seen once over all).
* Contexts of 1 to ``DEPTH`` tokens, counted level by level over all training rows. The number of contexts grows with the
  corpus: a context needs two visits, a next token two occurrences in all, and each shorter part of a pair two as well.
* Divergence test: a context of v visits is retained if its predictions gain at least ``NATS`` over its suffix's on the
  training data, each occurrence of a next token x predicted without itself: the sum of n log(P(x | c) / P(x | suffix)).
* Smoothing: P(x | c) = (n - ``DISCOUNT`` + (v - M) P(x | suffix of c)) / v for the n times that x followed c (a token not
  counted there has 0 for n - ``DISCOUNT``), M being the sum of all n - ``DISCOUNT`` of the context. Each token is scored
  from its longest retained suffix.

Plan: documents are cut into blocks, one row each, saved in buckets by block, so that they never move again. Level by
level, blocks send their distinct (context, next token) pairs, by ranges of hashes, to where these are counted and
tested, and get the answers back the same way; a frequent pair comes once a block. A context with more than 1 / ``HOT`` of all tokens is counted
in parts; their sums, at most ``HOT`` rows a level, are the only thing that passes through the driver.

Tokens and pairs are told apart by 64-bit hashes (a pair within its context by 32 more bits): among 10**8 distinct
words a clash is expected with odds of 1 to 3,000, and it would add the two counts.

Defined cases: null and empty texts consist of the end alone; a null id counts as remainder 0 (held out); without
training rows N and V are 0 and both scores are 0; repeated rows get equal rows; an empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

DEPTH, NATS, DISCOUNT = 2, 2.0, 0.6
#: Text of a block, and text for each range of hashes (bytes).
BLOCK_BYTES, PART_BYTES = 8 << 20, 16 << 20
HOT, HOT_LEAST = 100_000, 10_000
#: Log probabilities travel in steps of this many nats.
STEP = 0.1

#: Hashes of the start, and of any next token that a level doesn't count.
_START, _OTHER = np.uint64(0x51A7), np.uint64(0x07E4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def longer(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hash of a context with one more token."""
    return (context ^ (context >> np.uint64(31))) * _MIX + token


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each one, and the number of each place's key (numpy's own sorts stably, slower)."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return keys[new], order[new], at


BLOCK = "block long, ids array<bigint>, train array<boolean>, sizes array<int>, codes binary, places binary, hashes binary, counts binary"


def _cut(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of about ``limit`` bytes: token codes by falling frequency, and the distinct tokens' hashes in order with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        first, nth = TaskContext.get().partitionId() << 32, 0
        ids, train, parts, size, known = [], [], [], 0, defaultdict(count().__next__)

        def block() -> pa.RecordBatch:
            at = np.concatenate(parts)
            seen = np.repeat(np.array(train, bool), [len(p) for p in parts])
            h = np.fromiter((xxh64_intdigest(w, 7) for w in known), np.uint64, len(known))
            order = np.argsort(h)
            often = np.argsort(-np.bincount(at, minlength=len(h)), kind="stable")
            place, code = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
            place[order], code[often] = np.arange(len(h)), np.arange(len(h))
            n = np.bincount(at[seen], minlength=len(h))[order]
            blobs = [common.packed(code[at]), common.packed(place[often]), common.packed_keys(h[order]), common.packed(n)]
            lists = [pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([[len(p) for p in parts]], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array([first + nth]), *lists, *(pa.array([x], pa.binary()) for x in blobs)], [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            for doc_id, text, t in zip(b.column(0).to_pylist(), common.texts(b.column(1)), b.column(2).to_pylist()):
                ws = common.words(text)
                ws.append(b"")
                parts.append(np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)))
                ids.append(doc_id)
                train.append(bool(t))
                size += len(text)
                if size >= limit:
                    yield block()
                    nth += 1
                    ids, train, parts, size, known = [], [], [], 0, defaultdict(count().__next__)
        if ids:
            yield block()

    return run


def _slices(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that increasing hashes fall in, and where each begins (with the end)."""
    there, starts = np.unique((keys >> np.uint64(32)).astype(np.int64) * parts >> 32, return_index=True)
    return there, np.append(starts, len(keys))


def _sent_tokens(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, keys, n in zip(*(c.to_pylist() for c in b.columns)):
                keys, n = common.unpacked_keys(keys), common.unpacked(n)
                there, at = _slices(keys, parts)
                blobs = [(common.packed_keys(keys[i:j]), common.packed(n[i:j])) for i, j in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([block] * len(there), pa.int64()), *(pa.array([x[k] for x in blobs], pa.binary()) for k in (0, 1))], ["part", "block", "keys", "n"])

    return run


ANSWER = "block long, part int, level int, m binary, n binary, key long, sum_m double, sum_g double, tokens long, kinds long, once long"


def _answer(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in ANSWER.split(", ")])


def _count_tokens(sent: pa.Table) -> pa.Table:
    """Training counts of the tokens of a range, for each block; and the range's totals."""
    keys, n = [common.unpacked_keys(x) for x in sent["keys"].to_pylist()], [common.unpacked(x) for x in sent["n"].to_pylist()]
    _, _, at = distinct(np.concatenate(keys))
    total = np.bincount(at, np.concatenate(n)).astype(np.int64)
    part, rows, i = sent["part"][0].as_py(), [], 0
    for block, k in zip(sent["block"].to_pylist(), keys):
        rows.append((block, part, 0, None, common.packed(total[at[i : i + len(k)]], 8), None, None, None, None, None, None))
        i += len(k)
    rows.append((None, part, 0, None, None, None, None, None, int(total.sum()), int((total > 0).sum()), int((total == 1).sum())))
    return _answer(rows)


class Model:
    """What all blocks know: token totals, and the sums of hot contexts by level (keys in order, M, G)."""

    def __init__(self, tokens: int, kinds: int, once: int):
        self.tokens, self.kinds = tokens, kinds
        self.unknown = (once + 0.5) / (tokens + 1.0)
        self.hot_visits = max(HOT_LEAST, tokens // HOT)
        self.hot: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.kinds + 1))) if self.tokens else np.zeros(len(c))

    def root(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (1 - self.unknown) * c / max(1, self.tokens), self.unknown) if self.tokens else np.ones(len(c))


class Pairs:
    """Distinct (context, next token) pairs of a level in a block, in the order in which they are sent."""

    def __init__(self, context: np.ndarray, key: np.ndarray, visits: np.ndarray, logp: np.ndarray, train: np.ndarray, model: Model):
        self.keys, first, self.at = distinct(key)
        self.n = np.bincount(self.at, train, len(self.keys)).astype(np.int64)
        # a hot context is counted in parts
        parts = np.maximum(1, -(-visits[first].astype(np.int64) // model.hot_visits))
        self.context, self.visits, self.logp, self.hot = context[first], visits[first], logp[first], parts > 1
        route = self.context + (self.keys % parts.astype(np.uint64)) * _MIX
        self.order = np.argsort(route)
        route = route[self.order]
        self.starts = np.flatnonzero(np.append(True, route[1:] != route[:-1])) if len(route) else np.zeros(0, np.int64)
        self.route, self.sizes = route[self.starts], np.diff(self.starts, append=len(route))

    def sent(self, parts: int) -> tuple[np.ndarray, list[tuple]]:
        """Ranges, and for each one: routes, hot contexts' keys, pairs of each route, visits, pairs, counts, log probabilities."""
        there, at = _slices(self.route, parts)
        o, blobs = self.order, []
        ends = np.append(self.starts, len(o))
        for i, j in zip(at, at[1:]):
            a, b = ends[i], ends[j]
            first = o[self.starts[i:j]]
            pairs = (self.keys[o[a:b]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            logp = np.clip(np.round(-self.logp[o[a:b]] / STEP), 0, 255).astype(np.uint8)
            hot = np.where(self.hot[first], self.context[first], np.uint64(0)).view(np.int64)
            blobs.append((common.packed_keys(self.route[i:j]), common.packed(hot, 8), common.packed(self.sizes[i:j]), common.packed(self.visits[first]), common.packed(pairs), common.packed(self.n[o[a:b]]), common.packed(logp.view(np.int8), 1)))
        return there, blobs

    def received(self, m: list[np.ndarray], n: list[np.ndarray], hot: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """M (0: the context isn't retained) and n of each position's pair."""
        total, sums = np.zeros(len(self.keys)), np.zeros(len(self.keys))
        if len(self.keys):
            total[self.order] = np.concatenate(n)
            sums[self.order] = np.repeat(np.concatenate(m), self.sizes)
        if hot is not None and len(hot[0]) and self.hot.any():
            mine = np.flatnonzero(self.hot)
            i = np.minimum(np.searchsorted(hot[0], self.context[mine]), len(hot[0]) - 1)
            sums[mine] = np.where((hot[0][i] == self.context[mine]) & (hot[2][i] >= NATS), hot[1][i], 0.0)
        return sums[self.at], total[self.at]


PAIRS = ["routes", "hot", "sizes", "visits", "pairs", "n", "logp"]


def _count_pairs(level: int) -> Callable[[pa.Table], pa.Table]:
    """Counts of the pairs of a range, and M of its contexts where they pass the divergence test."""

    def run(sent: pa.Table) -> pa.Table:
        blobs = {c: sent[c].to_pylist() for c in PAIRS}
        routes, sizes = [common.unpacked_keys(x) for x in blobs["routes"]], [common.unpacked(x) for x in blobs["sizes"]]
        every = lambda c, width=4: np.concatenate([common.unpacked(x, width) for x in blobs[c]])
        route, first, of = distinct(np.concatenate(routes))
        visits, hot = every("visits")[first].astype(float), every("hot", 8)[first].view(np.uint64)
        owner = np.repeat(of, np.concatenate(sizes))
        # one number for a pair within this range: its context's place, and the pair's 32 bits
        _, at0, at = distinct(owner.astype(np.uint64) << np.uint64(32) | every("pairs").view(np.uint32).astype(np.uint64))
        n = np.bincount(at, every("n")).astype(np.int64)
        logp = -STEP * every("logp", 1).view(np.uint8)[at0].astype(float)
        mine, seen = owner[at0], n > 0
        weight = np.bincount(mine, np.where(seen, n - DISCOUNT, 0), len(route))
        # a part of a hot context judges by its own share
        own = np.where(hot > 0, np.maximum(1, np.bincount(mine, n, len(route))), visits)
        left = ((own - weight) / own)[mine]
        without = np.maximum(n - 1 - DISCOUNT, 0) / own[mine] + left * np.exp(logp)
        gain = np.bincount(mine, n * (np.log(without) - logp), len(route))
        kept = np.where((gain >= NATS) & (hot == 0), weight, 0.0).astype("<f4")
        part, rows, i, j = sent["part"][0].as_py(), [], 0, 0
        for block, r, s in zip(sent["block"].to_pylist(), routes, sizes):
            k = int(s.sum())
            rows.append((block, part, level, common.packed(kept[of[j : j + len(r)]].view("<i4")), common.packed(n[at[i : i + k]], 8), None, None, None, None, None, None))
            i, j = i + k, j + len(r)
        for r in np.flatnonzero((hot > 0) & (weight > 0)):
            rows.append((None, part, level, None, None, int(hot[r].view(np.int64)), float(weight[r]), float(gain[r]), None, None, None))
        return _answer(rows)

    return run


class Text:
    """Positions of a block's tokens, each document behind a start, with what the levels so far say of them."""

    def __init__(self, block: dict, answers: dict[int, tuple[list, list]], model: Model):
        self.model = model
        hashes, places = common.unpacked_keys(block["hashes"]), common.unpacked(block["places"])
        c = np.concatenate(answers[0][1]) if len(hashes) else np.zeros(0, np.int64)
        token = places[common.unpacked(block["codes"])]
        sizes = np.array(block["sizes"], np.int64)
        self.sizes, self.count = sizes, c[token]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        # places of tokens among tokens and starts
        self.place = np.arange(len(token)) + self.doc + 1
        self.age = np.arange(len(token)) - (np.cumsum(sizes) - sizes)[self.doc] + 1
        self.train = np.array(block["train"], bool)[self.doc]
        whole = len(token) + len(sizes)
        self.hash = np.full(whole, _START)
        self.hash[self.place] = hashes[token]
        self.p = model.root(self.count)
        # of the longest gram ending at each place: its hash and training count
        self.gram, self.seen = self.hash.copy(), np.zeros(whole, np.int64)
        self.seen[self.place] = self.count
        starts = self.place[np.cumsum(sizes) - sizes] - 1
        # every training document has one start, and one end
        end = np.searchsorted(hashes, _end())
        self.seen[starts] = c[end] if len(hashes) else 0
        self.able = np.arange(len(token))

    def pairs(self, level: int) -> Pairs:
        """The pairs of a level; ``able`` are the positions whose context was seen twice.

        A next token whose pair with the context's suffix wasn't seen twice is another one, which counts nothing.
        """
        t = np.flatnonzero(self.age >= level)
        self.able = t[self.seen[self.place[t] - 1] >= 2]
        here = self.place[self.able]
        self.context, self.visits, counted = self.gram[here - 1], self.seen[here - 1], self.seen[here] >= 2
        self.key = longer(self.context, np.where(counted, self.hash[here], _OTHER))
        return Pairs(self.context, self.key, self.visits, np.log(self.p[self.able]), self.train[self.able] & counted, self.model)

    def learn(self, level: int, answer: tuple[list, list]) -> None:
        """Moves probabilities from the suffix to the retained contexts of a level."""
        pairs = self.pairs(level)
        m, n = pairs.received(answer[0], answer[1], self.model.hot.get(level))
        v, p = self.visits, self.p[self.able]
        self.p[self.able] = np.where(m > 0, (np.where(n > 0, n - DISCOUNT, 0) + (v - m) * p) / v, p)
        here = self.place[self.able]
        gram, seen = np.zeros(len(self.gram), np.uint64), np.zeros(len(self.seen), np.int64)
        gram[here], seen[here] = self.key, n
        self.gram, self.seen = gram, seen


def _end() -> np.uint64:
    from xxhash import xxh64_intdigest

    return np.uint64(xxh64_intdigest(b"", 7))


def _read(block: pa.Table, answers: pa.Table, model: Model, levels: int) -> Text:
    """A block's text after the given number of levels."""
    got: dict[int, tuple[list, list]] = {k: ([], []) for k in range(levels + 1)}
    for a in answers.sort_by([("level", "ascending"), ("part", "ascending")]).select(["level", "m", "n"]).to_pylist():
        if a["m"] is not None:
            got[a["level"]][0].append(common.unpacked(a["m"]).view("<f4"))
        got[a["level"]][1].append(common.unpacked(a["n"], 8))
    text = Text(block.to_pylist()[0], got, model)
    for k in range(1, levels + 1):
        text.learn(k, got[k])
    return text


def _sent_pairs(model: Model, level: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        there, blobs = _read(block, answers, model, level - 1).pairs(level).sent(parts)
        return pa.table([pa.array(there.astype(np.int32)), pa.array([block["block"][0].as_py()] * len(there), pa.int64()), *(pa.array([b[i] for b in blobs], pa.binary()) for i in range(len(PAIRS)))], names=["part", "block", *PAIRS])

    return run


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(model: Model, levels: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        text = _read(block, answers, model, levels)
        sums = lambda w: np.bincount(text.doc, w, len(text.sizes))
        known = sums((text.count > 0).astype(float)).astype(np.int64)
        return pa.table([pa.chunked_array([block["ids"].combine_chunks().flatten()]), pa.array(text.sizes), pa.array(known), pa.array(sums(model.base(text.count))), pa.array(sums(np.log10(text.p)))], names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def scored(docs: DataFrame, train, depth: int = DEPTH) -> tuple[DataFrame, int]:
    """``(doc_id, n_tokens, n_known, base_score, score)`` of every row, and the number of training tokens.

    ``train`` is a boolean column of ``docs``: the rows to learn from.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), train.alias("train"))
    size = common.total_bytes(src, "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES) if size > 1 << 20 else 1
    blocks = common.bucketed(src.mapInArrow(_cut(BLOCK_BYTES), BLOCK), "block", parts, "pst")
    sent = blocks.select("block", "hashes", "counts").mapInArrow(_sent_tokens(parts), "part int, block long, keys binary, n binary")
    answers = common.saved(sent.repartition(parts, "part").groupBy("part").applyInArrow(_count_tokens, ANSWER), "pst-answers")
    got = answers.where("tokens is not null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "kinds", "once")]).first()
    model = Model(got["tokens"], got["kinds"], got["once"])
    depth = depth if model.tokens else 0
    columns = ["block", "part", "level", "m", "n"]
    so_far = answers.where("block is not null").select(*columns)
    fields = ", ".join(f"{c} binary" for c in PAIRS)
    for level in range(1, depth + 1):
        met = blocks.drop("counts").groupBy("block").cogroup(so_far.groupBy("block"))
        sent = met.applyInArrow(_sent_pairs(model, level, parts), f"part int, block long, {fields}")
        answers = common.saved(sent.repartition(parts, "part").groupBy("part").applyInArrow(_count_pairs(level), ANSWER), "pst-answers")
        # at most HOT contexts have more than 1 / HOT of all visits
        hot = sorted((r["key"] % 2**64, r["m"], r["g"]) for r in answers.where("key is not null").groupBy("key").agg(F.sum("sum_m").alias("m"), F.sum("sum_g").alias("g")).collect())
        model.hot[level] = tuple(np.array(c, t) for c, t in zip(zip(*hot), (np.uint64, float, float))) if hot else (np.zeros(0, np.uint64),) * 3
        so_far = so_far.union(answers.where("block is not null").select(*columns))
    out = blocks.drop("counts").groupBy("block").cogroup(so_far.groupBy("block")).applyInArrow(_scored(model, depth), SCORED)
    return out, model.tokens


def op2_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out, n = scored(docs, common.remainder("doc_id", 10) != 0)
    return out.select("doc_id", (common.remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
