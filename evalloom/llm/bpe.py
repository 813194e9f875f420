"""Byte-level BPE: encoding by a fold of ranked merges with Spark's higher-order functions, decoding by concatenation.

* Pieces: the pattern cuts each text in the JVM (``\\s`` takes Unicode white space, as the tokenizer's own regex does).
* Merges: ``merge`` folds over the bytes of a piece. Its state is an array of parts, each with the rank of its merge
  with the next one; every step joins the leftmost pair of least rank, as the rank files define it. Ranks come from
  literal maps, hashed into small buckets, since a map look-up in Spark scans its keys. The maps are an inline table of
  one row that every range of pieces is joined with, a broadcast of the vocabulary's size: as literals within the fold
  they would be written out in each description of the plan that the driver keeps. Bytes travel as ISO-8859-1 strings,
  one character a byte.
* Distinct pieces: documents are cut into blocks, one row each, with their distinct pieces in the order of their hashes.
  Blocks send these, by ranges of hashes, to where each distinct piece of the corpus is folded once, and get the ids
  back the same way. Nothing passes through the driver or is broadcast, whatever the corpus holds; a frequent piece
  comes once a block. Blocks are read and cut twice instead of stored; a mark of their pieces tells if both readings
  agree, and the query fails if they don't (documents from a plan without a fixed order must be saved before).
* A piece of more than ``LONG_PIECE`` bytes would cost the fold its square; the same merges run there on a linked list
  with a heap, in the worker.
* Decoding takes every id's binary piece and concatenates them.

Defined cases: null and empty texts have no ids; their digests are those of the empty string; repeated rows get equal
rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BUCKETS, PAIR_BUCKETS = 1 << 13, 1 << 14
#: Text of a block, and text for each range of hashes (bytes).
BLOCK_BYTES, PART_BYTES = 8 << 20, 8 << 20
LONG_PIECE = 256
#: Bits of a rank and of a place in a state; NO_RANK: two parts don't merge.
WIDTH = 20
NO_RANK = (1 << WIDTH) - 1


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pattern() -> str:
    import public_tokenizers

    # Java's \s is ASCII without the flag
    return "(?U)" + public_tokenizers.PATTERN


def _rank_map(path: str) -> list[dict]:
    """The rank map: ranks by the hash of their piece."""
    from xxhash import xxh64_intdigest

    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for piece, r in ranks(path).items():
        p = piece.decode("latin-1")
        maps[xxh64_intdigest(p.encode(), 42) % BUCKETS][p] = r
    return maps


def _pair_map(path: str) -> list[dict]:
    """What two ranks merge into: keys ``left << WIDTH | right`` and their ranks by the hash of the key."""
    from xxhash import xxh64_intdigest

    table = ranks(path)
    buckets: list[dict] = [{"k": [], "v": []} for _ in range(PAIR_BUCKETS)]
    for piece, r in table.items():
        for i in range(1, len(piece)):
            a, b = table.get(piece[:i]), table.get(piece[i:])
            if a is not None and b is not None:
                key = a << WIDTH | b
                bucket = buckets[xxh64_intdigest(key.to_bytes(8, "little"), 42) % PAIR_BUCKETS]
                bucket["k"].append(key)
                bucket["v"].append(r)
    return buckets


def maps(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(t, p)``, inline: the rank map and the map of pairs."""
    whole = pa.array([[list(m.items()) for m in _rank_map(path)]], pa.list_(pa.map_(pa.string(), pa.int32())))
    pairs = pa.array([_pair_map(path)], pa.list_(pa.struct([("k", pa.list_(pa.int64())), ("v", pa.list_(pa.int32()))])))
    return spark.createDataFrame(pa.table([whole, pairs], names=["t", "p"]))


def _rank(table: Column, piece: Column) -> Column:
    at = (F.xxhash64(piece).bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")
    return F.try_element_at(F.element_at(table, at), piece)


def _merged(pairs: Column, left: Column, right: Column) -> Column:
    """The rank that two ranks merge into, in the place of a state's rank; ``NONE`` if they don't."""

    def found(key: Column) -> Column:
        at = (F.xxhash64(key).bitwiseAND(F.lit(PAIR_BUCKETS - 1)) + 1).cast("int")
        return _let(F.element_at(pairs, at), lambda b: F.get(b["v"], F.array_position(b["k"], key).cast("int") - 1))

    rank = _let(F.shiftleft(left, WIDTH).bitwiseOR(right), found)
    return F.shiftleft(F.coalesce(rank, F.lit(NO_RANK)).cast("long"), 2 * WIDTH)


def merge(table: Column, pairs: Column, piece: Column) -> Column:
    """Ids, an array of ints, of a non-empty piece given as an ISO-8859-1 string.

    The state is an array with one long for each part: the rank of its merge with the next part, its first byte's
    place, its own rank. Its least element is the leftmost pair of least rank.
    """
    n = F.length(piece)
    mask, low = F.lit((1 << WIDTH) - 1).cast("long"), F.lit((1 << 2 * WIDTH) - 1).cast("long")
    none = F.lit(NO_RANK << 2 * WIDTH).cast("long")
    part = lambda x: x.bitwiseAND(mask)
    codes = F.transform(F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0)), lambda c: F.element_at(F.element_at(table, (F.xxhash64(c).bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")), c).cast("long"))

    def begun(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.when(i + 1 < n, _merged(pairs, x, F.try_element_at(c, i + 2))).otherwise(none).bitwiseOR(F.shiftleft(i.cast("long"), WIDTH)).bitwiseOR(x))

    def join(state: Column, least: Column) -> Column:
        new = F.shiftright(least, 2 * WIDTH)

        def at(i: Column) -> Column:
            after = F.coalesce(_merged(pairs, new, part(F.try_element_at(state, i + 2))), none)
            tail = F.slice(state, i + 2, n)
            # the place stays, the rank changes
            fresh = after.bitwiseOR(least.bitwiseAND(low.bitwiseXOR(mask))).bitwiseOR(new)

            def behind(before: Column) -> Column:
                again = _merged(pairs, part(before), new).bitwiseOR(before.bitwiseAND(low))
                return F.concat(F.slice(state, F.lit(1), i - 2), F.array(again, fresh), tail)

            return F.when(i > 1, _let(F.element_at(state, F.greatest(i - 1, F.lit(1))), behind)).otherwise(F.concat(F.array(fresh), tail))

        # bound once: the place of the leftmost least rank
        return _let(F.array_position(state, least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _let(F.array_min(state), lambda least: F.when(least >= none, state).otherwise(join(state, least)))

    folded = F.reduce(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), _let(codes, begun), step, lambda s: F.transform(s, lambda x: part(x).cast("int")))
    return _let(_rank(table, piece), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(folded))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def encode_long(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece: a linked list, and a heap of (rank, place)."""
    n = len(piece)
    end, nxt, prv = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\x01" * n)

    def pair(i: int):
        j = nxt[i]
        return table.get(piece[i : end[j]]) if j < n else None

    heap = [(r, i, end[nxt[i]]) for i in range(n) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        alive[j], end[i], nxt[i] = 0, end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for k in (prv[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[nxt[k]]))
    out, i = [], 0
    while i < n:
        out.append(table[piece[i : end[i]]])
        i = nxt[i]
    return out


@cache
def _bytes_of(path: str) -> pa.Array:
    """The binary piece of each id."""
    table = ranks(path)
    pieces = [b""] * (max(table.values()) + 1)
    for p, r in table.items():
        pieces[r] = p
    return pa.array(pieces, pa.binary())


def taken(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays laid end to end, those at some places, end to end, and their ends (from 0)."""
    ends = np.concatenate([[0], np.cumsum(sizes[at])])
    first = (np.cumsum(sizes) - sizes)[at]
    return values[np.repeat(first - ends[:-1], sizes[at]) + np.arange(ends[-1])], ends


def hashes(pieces: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(t, 42) for t in common.texts(pieces)), np.uint64, len(pieces))


BLOCK = "block long, rows {rows}, ends array<bigint>, codes binary, places binary, pieces array<string>, mark long"


def _cut(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of about ``limit`` bytes of text: rows' other columns, ends of their pieces, the pieces' codes among the distinct ones.

    Distinct pieces are in the order of their hashes, so every range of hashes is a slice of them. Codes count them by
    falling frequency, which makes most codes small; ``places`` leads from codes to the order of the hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block(nth: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            pieces = pa.concat_arrays([b.column(b.num_columns - 1) for b in held])
            ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
            coded = pieces.flatten().dictionary_encode()
            h = hashes(coded.dictionary)
            order = np.argsort(h)
            place, code = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            at = coded.indices.to_numpy()
            often = np.argsort(-np.bincount(at, minlength=len(order)), kind="stable")
            code[often] = np.arange(len(order))
            distinct = coded.dictionary.take(pa.array(order))
            rows = pa.concat_arrays([pa.StructArray.from_arrays(b.columns[:-1], b.schema.names[:-1]) for b in held])
            one = pa.array([0, len(rows)], pa.int32())
            mark = int(np.bitwise_xor.reduce(h[order] * np.arange(1, 2 * len(h) + 1, 2, np.uint64))) if len(h) else 0
            columns = [pa.array([first + nth]), pa.ListArray.from_arrays(one, rows), pa.array([ends.tolist()], pa.list_(pa.int64()))]
            columns += [pa.array([common.packed(code[at])], pa.binary()), pa.array([common.packed(place[often])], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.array(np.array([mark], np.uint64).view(np.int64))]
            return pa.RecordBatch.from_arrays(columns, ["block", "rows", "ends", "codes", "places", "pieces", "mark"])

        nth = 0
        for b in batches:
            held.append(b)
            size += b.column(b.num_columns - 1).nbytes
            if size >= limit:
                yield block(nth, held)
                held, size, nth = [], 0, nth + 1
        if sum(map(len, held)):
            yield block(nth, held)

    return run


def _sent(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's distinct pieces, one row for each range of hashes that it has some in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for block, mark, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                pieces = pieces.values
                part = (hashes(pieces) >> np.uint64(32)).astype(np.int64) * parts >> 32
                there, starts = np.unique(part, return_index=True)
                stops = [*starts[1:].tolist(), len(pieces)]
                out = []
                for i, j in zip(starts.tolist(), stops):
                    off, data = common.buffers(pieces.slice(i, j - i))
                    out.append((common.packed(np.diff(off)), compress(data[off[0] : off[-1]].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([block] * len(out), pa.int64()), pa.array([mark] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*out))] if out else [pa.array([], t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())], ["part", "block", "mark", "sizes", "pieces"])

    return run


DISTINCT = "part int, pieces array<struct<piece:string,ids:array<int>>>, blocks array<struct<block:bigint,mark:bigint,codes:array<int>>>"


def _distinct(path: str) -> Callable[[pa.Table], pa.Table]:
    """Of one range of hashes: the distinct pieces of all blocks, and each block's places (from 1) among them.

    Pieces to fold are ISO-8859-1 strings; long ones come with their ids.
    """

    def run(sent: pa.Table) -> pa.Table:
        import zstandard

        expand, every = zstandard.ZstdDecompressor().decompress, []
        for sizes, data in zip(sent["sizes"].to_pylist(), sent["pieces"].to_pylist()):
            off = np.concatenate([[0], np.cumsum(common.unpacked(sizes))]).astype(np.int32)
            every.append(pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(expand(data))))
        coded = pa.concat_arrays(every).dictionary_encode()
        bytes_ = common.texts(coded.dictionary)
        ids = pa.array([encode_long(w, ranks(path)) if len(w) > LONG_PIECE else None for w in bytes_], pa.list_(pa.int32()))
        pieces = pa.StructArray.from_arrays([pa.array([w.decode("latin-1") if len(w) <= LONG_PIECE else None for w in bytes_], pa.string()), ids], ["piece", "ids"])
        off = np.concatenate([[0], np.cumsum(list(map(len, every)))])
        codes = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(coded.indices.to_numpy() + 1, pa.int32()))
        blocks = pa.StructArray.from_arrays([sent["block"].combine_chunks(), sent["mark"].combine_chunks(), codes], ["block", "mark", "codes"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.table([sent["part"].combine_chunks()[:1], one(pieces), one(blocks)], names=["part", "pieces", "blocks"])

    return run


#: Pieces whose ids are laid out at once when a block is put together.
STRETCH = 1 << 20


def _joined(path: str, digest: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows of a block: with their ids, or with the digests of their ids and of the bytes that these decode to."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        if answers.num_rows and pc.any(pc.not_equal(answers["mark"], blocks["mark"][0])).as_py():
            raise RuntimeError("the documents changed between two readings")
        flat = lambda c: answers[c].combine_chunks().flatten().to_numpy()
        sizes, ids = flat("sizes").astype(np.int64), flat("ids")
        rows = blocks["rows"].combine_chunks().flatten()
        ends = np.concatenate([[0], blocks["ends"].combine_chunks().flatten().to_numpy()])
        codes, places = common.unpacked(blocks["codes"][0].as_py()), common.unpacked(blocks["places"][0].as_py())
        columns, out, i = rows.flatten(), [], 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + STRETCH, "right")) - 1)
            got, stops = taken(ids, sizes, places[codes[ends[i] : ends[j]]])
            bounds = stops[ends[i : j + 1] - ends[i]]
            out.append(_digested(path, got, bounds) if digest else [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(got, pa.int32()))])
            i = j
        names = [f.name for f in rows.type] + (["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids"])
        return pa.table([*columns, *map(pa.chunked_array, zip(*out))], names=names)

    return run


def _digested(path: str, ids: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Number of ids, digest of the ids, and digest of the bytes that they decode to, between each two bounds."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    joined = common.texts(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), _decimals(path).take(pa.array(ids))), ","))
    of, data = common.buffers(_bytes_of(path).take(pa.array(ids)))
    cut = of[bounds].tolist()
    return [pa.array(np.diff(bounds)), pa.array(list(map(sha, joined)), pa.string()), pa.array([sha(data[i:j]) for i, j in zip(cut, cut[1:])], pa.string())]


@cache
def _decimals(path: str) -> pa.Array:
    return pa.array(map(str, range(len(_bytes_of(path)))), pa.string())


def _encoded(docs: DataFrame, path: str, digest: bool, names: str) -> DataFrame:
    """Rows of ``docs`` (all columns but text) with their ids or their digests, as ``names`` add to the schema."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.drop("text")
    src = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    cut = src.select(*rows.columns, F.regexp_extract_all("text", F.lit(pattern()), F.lit(0)).alias("_pieces"))
    size = common.total_bytes(src.select("text"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES) if size > 1 << 16 else 1
    limit = BLOCK_BYTES

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # in one worker: each step of its own would take another one's memory
        return _sent(parts)(b.select(["block", "mark", "pieces"]) for b in _cut(limit)(batches))

    held = cut.mapInArrow(_cut(limit), BLOCK.format(rows=f"array<{rows.schema.simpleString()}>"))
    sent = cut.mapInArrow(send, "part int, block long, mark long, sizes binary, pieces binary").repartition(parts, "part")
    found = sent.groupBy("part").applyInArrow(_distinct(path), DISTINCT)
    # one row of a fixed size; a key, since each range meets it once
    found = found.join(F.broadcast(maps(spark, path).withColumn("_k", F.size("t") * 0)), F.col("part") * 0 == F.col("_k"))
    folded = F.transform("pieces", lambda p: F.when(p["ids"].isNotNull(), p["ids"]).otherwise(merge(F.col("t"), F.col("p"), p["piece"])))

    def answer(ids: Column) -> Column:
        def each(b: Column) -> Column:
            mine = F.transform(b["codes"], lambda c: F.element_at(ids, c))
            return _let(mine, lambda m: F.struct(b["block"].alias("block"), b["mark"].alias("mark"), F.transform(m, F.size).alias("sizes"), F.flatten(m).alias("ids")))

        return F.transform("blocks", each)

    answers = found.select("part", F.explode(_let(folded, answer)).alias("a")).select("part", "a.*")
    whole = held.select("block", "mark", "rows", "ends", "codes", "places").groupBy("block").cogroup(answers.groupBy("block"))
    return whole.applyInArrow(_joined(path, digest), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, {names}")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``_ids``, an array of the text's token ids."""
    src = docs.select(common.whole_row(docs).alias("row"), F.col("text").cast("string").alias("text"))
    return _encoded(src, path or vocabulary_path(), False, "ids array<int>").select("row.*", F.col("ids").alias("_ids"))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The bytes of an array of ids: ISO-8859-1 pieces, one character a byte, looked up in a literal and concatenated."""
    pieces = [p.decode("latin-1") for p in _bytes_of(path or vocabulary_path()).to_pylist()]
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(_let(literal, lambda t: F.transform(ids, lambda i: F.element_at(t, i.cast("int") + 1))), ""), "ISO-8859-1")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row; the ids are decoded by taking their binary pieces."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _encoded(src, path or vocabulary_path(), True, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
