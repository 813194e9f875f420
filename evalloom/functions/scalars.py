"""Scalar column functions: label keys, fences, directives, versions, tool output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def normalise_label(x: Column, names: dict[str, str]) -> Column:
    """The canonical name of a label, by its key; null if unknown. ``names``: any spelling to canonical name."""
    strip = lambda s: "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    table = {strip(k): v for k, v in names.items()}
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), label_key(x))


def one_space(x: Column) -> Column:
    """Unicode white space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def fence(x: Column) -> Column:
    """A delimiter longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(x, F.lit("`+"), F.lit(0)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def fenced(x: Column, language: str) -> Column:
    body = F.when(F.endswith(x, F.lit("\n")), x).otherwise(F.concat(x, F.lit("\n")))
    return F.concat(fence(body), F.lit(f"{language}\n"), body, fence(body))


# Fence lines and comments, which aren't code.
NOT_CODE = [r"(?m)^\s*`{3,}(?:\w+)?\s*$", r"(?s)/\*.*?\*/", r"//[^\n]*"]


def has_code(x: Column) -> Column:
    """Whether text is left without fence lines and comments."""
    for p in NOT_CODE:
        x = F.regexp_replace(x, p, "")
    return x.rlike(r"(?U)\S")


def is_directive(x: Column, name: str) -> Column:
    """The directive's name, then the end, a space or a tab."""
    return x.rlike(f"^{name}([ \\t].*)?$")


def version_between(x: Column, low: tuple, high: tuple) -> Column:
    """Whether the first a.b.c in the text lies in [low, high)."""
    part = lambda i: F.regexp_extract(x, r"(\d+)\.(\d+)\.(\d+)", i).try_cast("int")
    v = F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    edge = lambda t: F.struct(*[F.lit(n).alias(k) for n, k in zip(t, "abc")])
    return F.coalesce(part(1).isNotNull() & (v >= edge(low)) & (v < edge(high)), F.lit(False))


def findings(x: Column, enabled: list[str]) -> Column:
    """(check, line, column) of each "file:line:column: check:" line whose check is enabled; a #tag enables all."""
    pattern = r"(?m)^.+?:(\d+):(\d+):\s+(\w+):"
    get = lambda i: F.regexp_extract_all(x, F.lit(pattern), F.lit(i))
    rows = F.transform(F.arrays_zip(get(3).alias("c"), get(1).alias("l"), get(2).alias("k")), lambda r: F.struct(r["c"].alias("check"), r["l"].cast("int").alias("line"), r["k"].cast("int").alias("column")))
    if any(e.startswith("#") for e in enabled):
        return rows
    return F.filter(rows, lambda r: r["check"].isin(enabled))


def build_status(ok: Column, output: Column, missing: list[str]) -> Column:
    """OK, or NA where the output names a missing dependency, or FAIL."""
    text = F.lower(output)
    absent = F.lit(False)
    for m in missing:
        absent = absent | F.contains(text, F.lit(m))
    return F.when(ok, "OK").when(absent, "NA").otherwise("FAIL")


def after_header(x: Column, header: str) -> Column:
    at = F.instr(x, header)
    return F.trim(F.when(at > 0, F.substr(x, at + len(header))).otherwise(x))


def entries_of(m: Column, prefix: str) -> Column:
    """Entries of a map whose key, up to the first colon, is the prefix."""
    return F.map_filter(m, lambda k, _: F.split_part(k, F.lit(":"), F.lit(1)) == prefix)
