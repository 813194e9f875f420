"""Named results of many tables in one pass a table.

A leaf is an id with an aggregate over a frame. Leaves of one frame compile into one aggregation, so the frame is read
once however many there are, and the row that comes out is turned into a row a leaf. Ids are unique over all frames.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.constraints import ConstraintError

SCHEMA = "id string, number double, text string, flag boolean, kind string"


def uniform(values: Iterable[Column], name: str) -> Column:
    """The value that all have; different ones are an error."""
    every = F.array(*values)
    return F.when(F.array_min(every) == F.array_max(every), F.array_min(every)).otherwise(F.raise_error(F.lit(f"{name} must have one common value")).cast("double"))


def one_value(c: Column, name: str) -> Column:
    """The value that a column has in all rows it isn't null in; different ones are an error."""
    return F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).otherwise(F.raise_error(F.lit(f"{name} must have one common value")).cast("double"))


def share(a: Column, b: Column, times: float = 100.0) -> Column:
    return F.try_divide(a * F.lit(times), b)


class Leaves:
    """Leaves by frame, in the order in which they were declared."""

    def __init__(self) -> None:
        self.frames: dict[str, dict[str, Column]] = {}
        self.optional: set[str] = set()

    def ids(self) -> list[str]:
        return [i for f in self.frames.values() for i in f]

    def add(self, frame: str, leaves: dict[str, Column], optional: bool = False) -> None:
        """Declares leaves; an optional one that comes out null (of an empty class) is left out of the result."""
        known = set(self.ids())
        for i in leaves:
            if i in known:
                raise ConstraintError(f"result {i} is declared twice")
        self.frames.setdefault(frame, {}).update(leaves)
        self.optional |= set(leaves) if optional else set()

    def of(self, frame: str, df: DataFrame) -> DataFrame:
        """(id, number, text, flag, kind) of a frame's leaves: one aggregation."""
        leaves = self.frames[frame]
        wide = df.agg(*[c.alias(f"l{k}") for k, c in enumerate(leaves.values())])
        null = {t: F.lit(None).cast(t) for t in ("double", "string", "boolean")}

        def row(k: int, name: str, kind: T.DataType) -> Column:
            c = F.col(f"l{k}")
            number = c.cast("double") if isinstance(kind, T.NumericType) else null["double"]
            text = c if isinstance(kind, T.StringType) else null["string"]
            flag = c if isinstance(kind, T.BooleanType) else null["boolean"]
            what = "text" if isinstance(kind, T.StringType) else "flag" if isinstance(kind, T.BooleanType) else "whole" if isinstance(kind, T.IntegralType) else "number"
            return F.struct(F.lit(name).alias("id"), number.alias("number"), text.alias("text"), flag.alias("flag"), F.when(c.isNull(), "null").otherwise(what).alias("kind"))

        rows = wide.select(F.explode(F.array(*[row(k, i, f.dataType) for k, (i, f) in enumerate(zip(leaves, wide.schema))])).alias("r")).select("r.*")
        gone = [i for i in leaves if i in self.optional]
        return rows.where(~(F.col("kind").eqNullSafe("null") & F.col("id").isin(gone))) if gone else rows

    def table(self, frames: dict[str, DataFrame]) -> DataFrame:
        """The leaves of all frames."""
        if missing := self.frames.keys() - frames.keys():
            raise ConstraintError(f"no frame for {sorted(missing)}")
        return reduce(DataFrame.unionByName, [self.of(f, frames[f]) for f in self.frames])
