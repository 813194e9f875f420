"""Strict readers: JSON lines, JSON and YAML documents, id lists and run directories.

Spark's JSON reader keeps the last of duplicate keys, drops unknown fields, reads NaN and skips blank lines. Here each of
these is a violation, reported with file, row, record and field. A text is parsed once, on the executors, into typed
columns that are saved in the shared folder; violations, rules and queries read those. Files are read by Spark's text
reader, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from evalloom.operators.constraints import ConstraintError
from evalloom.sources.landing import landed


class DuplicateKey(ValueError):
    pass


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise DuplicateKey(f"duplicate key {k}")
        out[k] = v
    return out


def _no_constant(name: str) -> None:
    raise ValueError(f"non-finite number {name}")


def strict_loads(text: str) -> object:
    """One JSON document without duplicate keys, at any depth, and without NaN or infinities."""
    value = json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, float) and v in (float("inf"), float("-inf")):
            raise ValueError("non-finite number")
        stack.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return value


def mismatch(value: object, kind: T.DataType, path: str = "") -> str | None:
    """Why a JSON value doesn't have the type: no coercion, no unknown fields, no missing required ones."""
    at = path or "row"
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return f"{at}: not an object"
        names = {f.name: f for f in kind.fields}
        for k in value:
            if k not in names:
                return f"{path}.{k}: unknown field".lstrip(".")
        for k, f in names.items():
            if value.get(k) is None:
                if not f.nullable:
                    return f"{path}.{k}: missing".lstrip(".")
            elif problem := mismatch(value[k], f.dataType, f"{path}.{k}".lstrip(".")):
                return problem
        return None
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return f"{at}: not an array"
        return next((p for i, v in enumerate(value) if (p := (f"{at}[{i}]: null" if v is None and not kind.containsNull else mismatch(v, kind.elementType, f"{at}[{i}]")))), None)
    if isinstance(kind, T.MapType):
        if not isinstance(value, dict):
            return f"{at}: not an object"
        return next((p for k, v in value.items() if (p := mismatch(v, kind.valueType, f"{at}.{k}"))), None)
    if isinstance(kind, T.BooleanType):
        good = isinstance(value, bool)
    elif isinstance(kind, T.IntegralType):
        good = isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63
    elif isinstance(kind, T.FractionalType):
        good = isinstance(value, int | float) and not isinstance(value, bool)
    else:
        good = isinstance(value, str)
    return None if good else f"{at}: not {kind.simpleString()}"


def load_yaml(text: str) -> object:
    """A YAML document with unique string keys, as JSON values."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader: yaml.SafeLoader, node: yaml.MappingNode) -> dict:
        pairs = [(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value]
        if any(not isinstance(k, str) for k, _ in pairs):
            raise ConstraintError("a key is not a string")
        try:
            return _unique(pairs)
        except DuplicateKey as e:
            raise ConstraintError(str(e)) from e

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return strict_loads(json.dumps(yaml.load(text, Loader), allow_nan=True))


def _loose(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed everywhere: what must not be null is checked while parsing."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType))
    return T.MapType(kind.keyType, _loose(kind.valueType)) if isinstance(kind, T.MapType) else kind


def _parser(load: Callable[[str], object], kind: T.DataType, record_id: str | None):
    """Arrow batches of (text, file, block) to (file, block, at, value, problem); ``at`` counts the rows of a block."""
    shape = _loose(kind)
    arrow = to_arrow_type(shape)
    told = re.compile(rf'"?{re.escape(record_id)}"?\s*:\s*"?([^",\s]*)') if record_id else None

    def judged(text: str) -> tuple[object, str | None]:
        if not text.strip():
            return None, "blank line"
        try:
            value = load(text)
            problem = "no value" if value is None else mismatch(value, kind)
        except DuplicateKey as e:
            value, problem = None, str(e)
        except ValueError as e:
            value, problem = None, f"invalid: {e}"
        if problem and told and (m := told.search(text)):
            problem = f"record {m[1]}: {problem}"
        return (None if problem else value), problem

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for b in batches:
            values, problems, places = [], [], []
            for text, file, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                places.append(seen.get((file, block), 0))
                seen[file, block] = places[-1] + 1
                value, problem = judged(text)
                values.append(value)
                problems.append(problem)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(places, pa.int64()), pa.array(values, arrow), pa.array(problems, pa.string())], ["file", "block", "at", "value", "problem"])

    columns = [("file", T.StringType()), ("block", T.LongType()), ("at", T.LongType()), ("value", shape), ("problem", T.StringType())]
    return run, T.StructType([T.StructField(n, t) for n, t in columns])


def parsed_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType, record_id: str | None = None) -> DataFrame:
    """(file, block, at, value, problem) of every line, parsed once and saved."""
    rows = spark.read.option("lineSep", "\n").text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    return landed(rows.mapInArrow(*_parser(strict_loads, schema, record_id)), "lines")


def parsed_documents(spark: SparkSession, paths: str | list[str], kind: T.DataType, load: Callable[[str], object] = strict_loads, record_id: str | None = None) -> DataFrame:
    """(file, block, at, value, problem) of whole files, one document each, parsed by ``load`` on the executors."""
    rows = spark.read.text(paths, wholetext=True).select("value", "_metadata.file_path", F.lit(0).cast("long"))
    return landed(rows.mapInArrow(*_parser(load, kind, record_id)), "documents")


def violations(parsed: DataFrame) -> DataFrame:
    """(file, line, problem) of every bad row; lines count from 1 over the blocks that a file was split into."""
    bad = parsed.where("problem is not null").select("file", "block", "at", "problem")
    sizes = parsed.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = bad.select("file", "block").distinct().join(sizes.select("file", F.col("block").alias("_b"), "n"), "file").where("_b < block").groupBy("file", "block").agg(F.sum("n").alias("before"))
    return bad.join(before, ["file", "block"], "left").select("file", (F.coalesce("before", F.lit(0)) + F.col("at") + 1).alias("line"), "problem")


def require_parsed(parsed: DataFrame) -> DataFrame:
    """The typed values, with ``_file``; raises on the first bad row."""
    if parsed.where("problem is not null").take(1):
        bad = violations(parsed).orderBy("file", "line").first()
        raise ConstraintError(f"{bad['file']}: row {bad['line']}: {bad['problem']}")
    return parsed.select(F.col("file").alias("_file"), "value")


def read_json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType, key: list[str] | None = None, record_id: str | None = None) -> DataFrame:
    """Typed rows of strict JSON lines; an empty file has none. Raises on a bad line or a duplicate key."""
    rows = require_parsed(parsed_lines(spark, path, schema, record_id)).select("value.*")
    if key:
        for dup in rows.groupBy(*key).count().where("count > 1").take(1):
            raise ConstraintError(f"{path}: duplicate key {[dup[k] for k in key]}")
    return rows


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One strict JSON document (an object, or an array of objects) as rows, parsed on an executor."""

    def load(text: str) -> object:
        value = strict_loads(text)
        return value if isinstance(value, list) else [value]

    return require_parsed(parsed_documents(spark, path, T.ArrayType(schema, False), load)).select(F.explode("value").alias("value")).select("value.*")


def read_yaml(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One strict YAML document as a row, parsed on an executor."""
    return require_parsed(parsed_documents(spark, path, schema, load_yaml)).select("value.*")


def read_ids(spark: SparkSession, path: str, pattern: str = "^[^\\s]+$") -> DataFrame:
    """One unique id a line."""
    ids = spark.read.text(path).select(F.col("value").alias("id"))
    bad = ids.groupBy("id").count().where((F.col("count") > 1) | ~F.col("id").rlike(pattern)).take(1)
    if bad:
        raise ConstraintError(f"{path}: bad or repeated id {bad[0]['id']!r}")
    return ids


def entries(spark: SparkSession, path: str) -> list[tuple[str, bool]] | None:
    """(name, is a folder) of what lies in a folder of any file system, hidden names left out; None if there is no folder."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place) or not fs.getFileStatus(place).isDirectory():
        return None
    found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(place)]
    return sorted(x for x in found if x[0][0] not in "._")


def check_runs(spark: SparkSession, root: str, expected: list[tuple[str, int]], files: list[str]) -> list[str]:
    """Folders of the runs ``<root>/<path>/seed-<n>``: exactly those expected, each with exactly the files (a file may be a folder of parts)."""

    def check(path: str, want: set[str], what: str, folders: bool) -> None:
        found = entries(spark, path)
        if found is None:
            raise ConstraintError(f"{path}: {what}: the folder is missing")
        names = {n for n, _ in found}
        if names != want:
            raise ConstraintError(f"{path}: {what}: missing {sorted(want - names)}, unexpected {sorted(names - want)}")
        if folders and not all(d for _, d in found):
            raise ConstraintError(f"{path}: {what}: not a folder: {[n for n, d in found if not d]}")

    check(root, {p for p, _ in expected}, "run matrix", True)
    for p in dict.fromkeys(p for p, _ in expected):
        check(f"{root}/{p}", {f"seed-{n}" for q, n in expected if q == p}, "run matrix", True)
    runs = [f"{root}/{p}/seed-{n}" for p, n in expected]
    for r in runs:
        check(r, set(files), "files of a run", False)
    return runs


def placed(rows: DataFrame, file: str) -> DataFrame:
    """Adds (path, run_seed) from the folders in ``_file``; ``file`` is the name of a file, or of a folder of parts."""
    tail = rf"/([^/]+)/seed-(\d+)/{re.escape(file)}(/[^/]+)?$"
    return rows.withColumn("path", F.regexp_extract("_file", tail, 1)).withColumn("run_seed", F.regexp_extract("_file", tail, 2).cast("long"))


def read_runs(spark: SparkSession, root: str, expected: list[tuple[str, int]], schema: T.StructType, file: str = "records.jsonl") -> DataFrame:
    """All runs under ``root/<condition>/seed-<n>/``, with (path, run_seed) from the folders; exactly those expected, an empty run among them."""
    runs = check_runs(spark, root, expected, [file])
    return placed(require_parsed(parsed_lines(spark, [f"{r}/{file}" for r in runs], schema)), file).select("value.*", "path", "run_seed")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, of any length."""
    return spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
