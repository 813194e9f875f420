"""Summary lines of source code: closed vocabulary, construct flags, provenance segments, and the parser's interface.

Lines come from a parser of the source language, which Spark doesn't have: ``summarised`` runs an external program that
prints them as JSON, and raises if it isn't installed. What follows from lines is done in columns; flags and text without
comments come from ``scanner``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.scanner import construct_flags, verbatim  # noqa: F401
from evalloom.functions.tools import checked

OUTPUT_LINES = "array<struct<tier:int,depth:int,text:string,segments:array<map<string,string>>>>"
OUTPUT_DDL = f"struct<id:string,ok:boolean,parse_strategy:string,lines:{OUTPUT_LINES},excluded_constructs:array<string>,parse_error:string>"


def summarised(df: DataFrame, code: str, command: Sequence[str]) -> DataFrame:
    """Adds ``summary``: a row that doesn't parse is data (ok = false), a program that fails is an error."""
    out = checked(df, code, command)
    told = F.when(F.col("ok"), F.from_json("output", OUTPUT_DDL)).when(F.col(code).isNotNull(), F.raise_error(F.concat(F.lit("summary program failed: "), F.col("output"))))
    return out.select(*df.columns, told.alias("summary"))


def unknown_words(segments: Column, allowed: list[str]) -> Column:
    """Words of authored segments (key "a") outside the closed vocabulary."""
    authored = F.filter(F.transform(segments, lambda s: F.try_element_at(s, F.lit("a"))), lambda t: t.isNotNull())
    tokens = F.flatten(F.transform(authored, lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    return F.array_except(tokens, F.array(*map(F.lit, allowed)))


def failure_is_empty(summary: Column) -> Column:
    """A successful summary names a strategy and no error; a failed one has no lines and says why."""
    good = summary["parse_strategy"].isNotNull() & summary["parse_error"].isNull()
    bad = (F.size(summary["lines"]) == 0) & summary["parse_error"].isNotNull()
    return F.when(summary["ok"], good).otherwise(bad)


def output_line(row_id: Column, summary: Column) -> Column:
    """The JSON line of a summary: empty arrays rather than nulls, every field present, segments with one key each."""
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    segments = "array<map<string,string>>"
    lines = F.transform(empty(summary["lines"], OUTPUT_LINES), lambda x: F.struct(x["tier"].alias("tier"), x["depth"].alias("depth"), x["text"].alias("text"), empty(x["segments"], segments).alias("segments")))
    several = F.exists(lines, lambda x: F.exists(x["segments"], lambda s: F.size(s) != 1))
    fields = F.struct(
        row_id.alias("id"),
        F.coalesce(summary["ok"], F.lit(False)).alias("ok"),
        F.coalesce(summary["parse_strategy"], F.lit("")).alias("parse_strategy"),
        lines.alias("lines"),
        empty(summary["excluded_constructs"], "array<string>").alias("excluded_constructs"),
        F.coalesce(summary["parse_error"], F.lit("")).alias("parse_error"),
    )
    return F.when(several, F.raise_error(F.lit("a segment has one key")).cast("string")).otherwise(F.to_json(fields))
