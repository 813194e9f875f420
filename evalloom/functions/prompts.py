"""Prompts as columns: templates with named places, dispatched by task."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, places: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced by its column (null: empty). A name without a column is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    unknown = set(parts[1::2]) - places.keys()
    if unknown:
        raise ValueError(f"no value for {sorted(unknown)}")
    return F.concat(*[F.coalesce(places[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def by_task(task: Column, templates: dict[str, str], places: dict[str, Column]) -> Column:
    """The prompt of the row's task; a task without a template is an error."""
    out = F
    for name, template in templates.items():
        out = out.when(task == name, filled(template, places))
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown task: "), F.coalesce(task, F.lit("null")))).cast("string"))


def lengths(prompt: Column, response: Column, count) -> Column:
    """(prompt_len, total_len) in the units of ``count``, a function from a text column to its size."""
    p = count(prompt).cast("long")
    return F.struct(p.alias("prompt_len"), (p + count(response).cast("long")).alias("total_len"))
