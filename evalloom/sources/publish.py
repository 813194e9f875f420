"""Publication of runs: staged by executors, read back, renamed at once.

Everything is first written under a hidden stage beside the target, in the target's own file system. Executors write the
records of all runs in one job, as folders of parts; the small documents follow. Then the stage is read back, and counts
and digests must equal those of what was to be written. Only then are the folders renamed to their places, by Hadoop's
FileSystem. A job that dies before that leaves a hidden stage and no run; a target that exists is an error.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.operators import constraints
from evalloom.operators.constraints import ConstraintError
from evalloom.sources.landing import landed
from evalloom.sources.strict import entries

#: Hidden file of a published run: rows and digest of its records.
RECEIPT = "_published.json"


def compact_lines(df: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, line)``: each row as one compact JSON object with sorted keys; absent fields are left out."""
    return df.select(*by, F.to_json(F.struct(*sorted(c for c in df.columns if c not in by))).alias("line"))


def yaml_bytes(value: dict) -> bytes:
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True).encode()


class Store:
    """The file system of a path, by Hadoop."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def write(self, p: str, data: bytes) -> None:
        out = self.fs.create(self.path(p), False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def move(self, a: str, b: str) -> None:
        self.fs.mkdirs(self.path(b).getParent())
        if self.fs.exists(self.path(b)) or not self.fs.rename(self.path(a), self.path(b)):
            raise ConstraintError(f"{b} can't be published: it exists or the rename failed")


def check_identity(records: DataFrame, documents: dict[tuple[str, int], dict[str, dict]], runs: dict[tuple[str, int], str], shared: list[str]) -> None:
    """Records of a folder are of its condition and seed, and its documents agree on every shared field."""
    for (path, seed), condition in runs.items():
        docs = documents[path, seed]
        for name, d in docs.items():
            if isinstance(d, dict) and (d.get("condition"), d.get("seed")) != (condition, seed):
                raise ConstraintError(f"{path}/seed-{seed}/{name}: identity {(d.get('condition'), d.get('seed'))}, not {(condition, seed)}")
        for field in shared:
            if len({json.dumps(d.get(field)) for d in docs.values() if isinstance(d, dict)}) > 1:
                raise ConstraintError(f"{path}/seed-{seed}: documents disagree on {field}")
    known = F.create_map(*[F.lit(x) for (path, seed), c in runs.items() for x in (f"{path}/{seed}", c)])
    own = F.try_element_at(known, F.concat_ws("/", "path", F.col("run_seed").cast("string")))
    constraints.require(records.where(~(own.eqNullSafe(F.col("condition")) & F.col("seed").eqNullSafe(F.col("run_seed")))).select("path", "run_seed", "condition", "seed"), "records of one identity")


def publish_runs(records: DataFrame, documents: dict[tuple[str, int], dict[str, object]], runs: dict[tuple[str, int], str], root: str, shared: list[str] = (), order: list[str] = ()) -> list[str]:
    """Publishes runs under ``root/<path>/seed-<n>/`` and returns their folders.

    ``records`` has path and run_seed beside the records' own columns; ``documents`` has each run's other files by name, as
    values (names ending in .yaml are written as YAML, others as JSON); ``runs`` names each folder's condition.
    """
    spark = records.sparkSession
    if set(documents) != set(runs):
        raise ConstraintError("documents and runs are of different folders")
    check_identity(records, {k: v for k, v in documents.items()}, runs, list(shared))
    targets = {k: f"{root}/{k[0]}/seed-{k[1]}" for k in runs}
    store = Store(spark, root)
    for t in targets.values():
        if entries(spark, t) is not None:
            raise ConstraintError(f"{t} exists")
    stage = f"{root}/.stage-{uuid.uuid4().hex}"
    try:
        lines = landed(compact_lines(records, ["path", "run_seed"]), "publish")
        want = {(r["path"], r["run_seed"]): (r["n"], r["digest"]) for r in constraints.multiset_digest(lines, ["path", "run_seed"], "line").collect()}
        if set(want) - set(runs):
            raise ConstraintError(f"records of unknown runs: {sorted(set(want) - set(runs))}")
        spread = lines.repartitionByRange("path", "run_seed", "line").sortWithinPartitions("path", "run_seed", "line")
        spread.withColumnRenamed("line", "value").write.partitionBy("path", "run_seed").text(f"{stage}/records")
        back = spark.read.schema("value string, path string, run_seed long").option("basePath", f"{stage}/records").text(f"{stage}/records") if want else None
        got = {(r["path"], r["run_seed"]): (r["n"], r["digest"]) for r in constraints.multiset_digest(back, ["path", "run_seed"], "value").collect()} if want else {}
        if got != want:
            raise ConstraintError("what was read back differs from what was to be written")
        for (path, seed), docs in documents.items():
            run = f"{stage}/runs/{path}/seed-{seed}"
            part = f"{stage}/records/path={path}/run_seed={seed}"
            if (path, seed) in want:
                store.move(part, f"{run}/records.jsonl")
            else:
                store.write(f"{run}/records.jsonl", b"")
            for name, value in docs.items():
                store.write(f"{run}/{name}", yaml_bytes(value) if name.endswith(".yaml") else (json.dumps(value, sort_keys=True) + "\n").encode())
            n, digest = want.get((path, seed), (0, None))
            store.write(f"{run}/{RECEIPT}", json.dumps({"rows": n, "digest": digest}).encode())
        for k, t in targets.items():
            store.move(f"{stage}/runs/{k[0]}/seed-{k[1]}", t)
    finally:
        store.fs.delete(store.path(stage), True)  # made here, under a fresh name
    return list(targets.values())
