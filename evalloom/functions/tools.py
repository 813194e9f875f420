"""External checkers on columns of source text: a process for each distinct input, with time limits and truthful statuses."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ToolMissing(RuntimeError):
    """A required program is not installed."""


def resolve(names: Sequence[str]) -> dict[str, str]:
    """Absolute paths of programs; raises for the first that is missing or not executable."""
    out = {}
    for n in names:
        found = shutil.which(n)
        if not found:
            raise ToolMissing(f"{n} is not on the path")
        out[n] = os.path.realpath(found)
    return out


def run_tool(command: Sequence[str], text: str, seconds: float, file: str | None = None) -> tuple[bool, bool, str]:
    """(ok, timed out, output) of one run; the text goes to standard input, or to a file of an own folder."""
    with tempfile.TemporaryDirectory() as folder:
        if file:
            with open(os.path.join(folder, file), "w") as f:
                f.write(text)
        env = {k: os.environ[k] for k in ("PATH", "HOME") if k in os.environ}
        try:
            done = subprocess.run(list(command), input=None if file else text, capture_output=True, text=True, timeout=seconds, cwd=folder, env=env)
        except subprocess.TimeoutExpired:
            return False, True, ""
        return done.returncode == 0, False, done.stdout + done.stderr


RESULT = [T.StructField("ok", T.BooleanType()), T.StructField("timed_out", T.BooleanType()), T.StructField("output", T.StringType())]


def checked(df: DataFrame, text: str, command: Sequence[str], seconds: float = 60, file: str | None = None) -> DataFrame:
    """Adds ok, timed_out and output of a program for each row; equal texts run once."""
    resolve(command[:1])
    kind = df.schema[text].dataType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [run_tool(command, t, seconds, file) for t in f[text]]
            yield pd.DataFrame({text: f[text], "ok": [g[0] for g in got], "timed_out": [g[1] for g in got], "output": [g[2] for g in got]})

    distinct = df.select(text).where(F.col(text).isNotNull()).distinct()
    results = distinct.mapInPandas(run, T.StructType([T.StructField(text, kind), *RESULT]))
    return df.join(results, text, "left")
