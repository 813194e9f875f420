"""Chat framing, encoded examples and padded batches, as columns of token ids.

A tokenizer is injected as a function from a text column to its ids; everything around it stays on the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators.sequence import micro_batches

Encode = Callable[[Column], Column]
#: What a target is where it isn't learned.
IGNORED = -100


def _ids(*ids: int) -> Column:
    return F.array(*[F.lit(i).cast("long") for i in ids])


def framed(system: Column, user: Column, encode: Encode, specials: dict[str, int]) -> Column:
    """Ids of a chat up to the assistant's turn: begin, then header, text and end of the turn for system and user, then the open header.

    ``specials`` names begin, start_header, end_header and end_turn; specials in texts are text, as ``encode`` sees them.
    """

    def header(role: str) -> list[Column]:
        return [_ids(specials["start_header"]), encode(F.lit(role)), _ids(specials["end_header"]), encode(F.lit("\n\n"))]

    def turn(role: str, text: Column) -> list[Column]:
        return [*header(role), encode(text), _ids(specials["end_turn"])]

    return F.concat(_ids(specials["begin"]), *turn("system", system), *turn("user", user), *header("assistant"))


def example(prompt_ids: Column, target: Column, encode: Encode, end_turn: int) -> Column:
    """(input_ids, prompt_len): the prompt's ids, then the target's and the end of the turn."""
    ids = F.concat(prompt_ids, encode(target), _ids(end_turn))
    return F.struct(ids.alias("input_ids"), F.size(prompt_ids).cast("long").alias("prompt_len"))


def collated(batched: DataFrame, ids: str, prompt_len: str, pad: int, cap: int | None = None, batch: str = "batch") -> DataFrame:
    """Adds ``inputs`` and ``targets`` to rows with a batch number: cut and padded to the batch's width, shifted by one.

    A target is ignored where it is padding, or belongs to the prompt. Only widths are shuffled, one number a batch.
    """
    width = F.max(F.size(ids)) if cap is None else F.least(F.max(F.size(ids)), F.lit(cap))
    rows = batched.join(batched.groupBy(batch).agg(width.alias("_w")), batch)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.col("_w") - F.size(ids), F.lit(0)))
    rows = rows.withColumn("_p", F.concat(F.slice(ids, F.lit(1), F.col("_w")), fill))
    known = (F.col(prompt_len) - 1).cast("int")
    targets = F.transform(F.slice("_p", F.lit(2), F.greatest(F.col("_w") - 1, F.lit(0))), lambda t, i: F.when((i < known) | (t == pad), F.lit(IGNORED).cast("long")).otherwise(t))
    inputs = F.slice("_p", F.lit(1), F.greatest(F.col("_w") - 1, F.lit(0)))
    return rows.withColumn("inputs", inputs).withColumn("targets", targets).drop("_w", "_p")


def collated_stream(df: DataFrame, order: str, ties: list[str], ids: str, prompt_len: str, size: int, pad: int, cap: int | None = None) -> DataFrame:
    """Batches of ``size`` rows in order, collated."""
    return collated(micro_batches(df, order, ties, size), ids, prompt_len, pad, cap)
