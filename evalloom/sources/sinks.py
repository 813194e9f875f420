"""Canonical bytes of final results, golden comparison, and atomic publication."""

from __future__ import annotations

import csv
import io
import json
import math
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.operators.constraints import ConstraintError


def json_bytes(results: dict) -> bytes:
    """Sorted keys, two spaces, UTF-8, no NaN, a newline at the end."""
    return (json.dumps(results, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()


def cell_text(value: object, digits: int | None = None) -> str:
    """A literal, blank for None, or fixed decimals without the sign of a rounded zero."""
    if value is None:
        return ""
    if digits is None or isinstance(value, str):
        return str(value)
    text = f"{value:.{digits}f}"
    return text[1:] if text.startswith("-") and not float(text) else text


def csv_bytes(columns: list[str], rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows(rows)
    return out.getvalue().encode()


def table_bytes(df: DataFrame, order: list[str], digits: dict[str, int]) -> bytes:
    """A small final table in a fixed row order as canonical CSV."""
    columns = [c for c in df.columns if c not in order or c in digits]
    return csv_bytes(columns, [[cell_text(r[c], digits.get(c)) for c in columns] for r in df.orderBy(*order).collect()])


def registry(cells: DataFrame) -> None:
    """Result ids and coordinates (file, row, column) are unique, values finite."""
    for key in (["result_id"], ["file", "row_key", "column"]):
        for r in cells.groupBy(*key).count().where("count > 1").take(1):
            raise ConstraintError(f"repeated {key}: {[r[k] for k in key]}")
    for r in cells.where(F.isnan("value") | (F.abs("value") == float("inf"))).take(1):
        raise ConstraintError(f"{r['result_id']} is not finite")


def differences(expected: object, actual: object, path: str = "", tolerance: float = 1e-7) -> list[str]:
    """Where two results differ: exact types, floats within an absolute tolerance."""
    if type(expected) is not type(actual):
        return [f"{path}: type {type(actual).__name__}, not {type(expected).__name__}"]
    if isinstance(expected, dict):
        out = [f"{path}.{k}: only on one side" for k in sorted(expected.keys() ^ actual.keys())]
        return out + [d for k in sorted(expected.keys() & actual.keys()) for d in differences(expected[k], actual[k], f"{path}.{k}", tolerance)]
    if isinstance(expected, list):
        if len(expected) != len(actual):
            return [f"{path}: length {len(actual)}, not {len(expected)}"]
        return [d for i, (a, b) in enumerate(zip(expected, actual)) for d in differences(a, b, f"{path}[{i}]", tolerance)]
    if isinstance(expected, float):
        return [] if math.isclose(expected, actual, rel_tol=0, abs_tol=tolerance) else [f"{path}: {actual}, not {expected}"]
    return [] if expected == actual else [f"{path}: {actual!r}, not {expected!r}"]


def publish(files: dict[str, bytes], target: str) -> None:
    """Writes a folder of driver-made files at once: staged beside it, synced, renamed; the target must not exist."""
    if os.path.lexists(target):
        raise ConstraintError(f"{target} exists")
    stage = tempfile.mkdtemp(prefix=".stage-", dir=os.path.dirname(os.path.abspath(target)))
    try:
        for name, data in files.items():
            with open(os.path.join(stage, name), "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One compact object a row, keys sorted; Spark's committer publishes it, and an existing path is an error."""
    text = df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    text.write.mode("errorifexists").text(path)
