"""Keyed permutations of positions as column arithmetic, and the training streams made with them.

A position finds its item by itself: a Feistel network over two halves of mixed radix maps 0..n-1 into a domain a little
larger than n, and positions that fall outside walk the same cycle on until they are inside. No row meets another, so a
stream of any length needs neither a shuffle nor a window. Rounds are digests (MD5), so SQL elsewhere can say the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, MOST_WALKS = 4, 32


def digest(*parts: Column) -> Column:
    """A whole number of 48 bits from the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def halves(n: int) -> tuple[int, int]:
    """Radices whose product is the least that covers n with halves of about its root."""
    low = max(1, math.isqrt(n - 1) + 1) if n > 1 else 1
    return -(-n // low), low


def _encrypted(x: Column, n: int, key: list[Column]) -> Column:
    """One pass of the network over the domain of ``halves(n)``."""
    a, b = halves(n)
    left, right = F.floor(x / F.lit(b)).cast("long"), x % b
    for r in range(0, ROUNDS, 2):
        left = (left + digest(*key, F.lit(r), right)) % a
        right = (right + digest(*key, F.lit(r + 1), left)) % b
    return left * b + right


def permuted(x: Column, n: int, *key: Column) -> Column:
    """The place, from 0 to n - 1, that x (0 to n - 1) has in the permutation that the key names.

    Cycle-walking needs at most as many steps as the domain has values beyond n, plus one. From 32 on (n of about a
    thousand and more) a walk ends sooner but for a chance below 3^-160; it would be an error, not a wrong place.
    """
    a, b = halves(n)
    walks = min(a * b - n, MOST_WALKS)
    out = _encrypted(x, n, list(key))
    if walks:
        # aggregate binds each step to a variable, so the expression stays one network long
        out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), out, lambda at, _: F.when(at < n, at).otherwise(_encrypted(at, n, list(key))))
        out = F.transform(F.array(out), lambda at: F.when(at < n, at).otherwise(F.raise_error("a walk didn't end").cast("long")))[0]
    return out


def drawn(ordinal: Column, n: int, *key: Column) -> Column:
    """The item of a pool of n at an ordinal of its draws without replacement, epoch after epoch; each epoch has its own order."""
    return permuted(ordinal % n, n, *key, F.floor(ordinal / F.lit(n)).cast("long"))


def mixture(positions: DataFrame, n_main: int, n_aux: int, ratio: float, seed: int, position: str = "position") -> DataFrame:
    """Adds ``pool``, ``ordinal``, ``epoch`` and ``index`` to a table of positions.

    Position i is auxiliary where floor((i + 1) r) exceeds floor(i r); each pool is drawn without replacement.
    """
    if n_main < 1:
        raise ValueError("the main pool is empty")
    r = F.lit(float(ratio) if n_aux > 0 else 0.0)
    i = F.col(position)
    before = F.floor(i * r).cast("long")
    aux = (F.floor((i + 1) * r) > before) & F.lit(n_aux > 0)
    rows = positions.withColumn("pool", F.when(aux, "aux").otherwise("main")).withColumn("ordinal", F.when(aux, before).otherwise(i - before))
    key = [F.lit(seed), F.col("pool")]
    index = F.when(F.col("pool") == "aux", drawn(F.col("ordinal"), max(1, n_aux), *key)).otherwise(drawn(F.col("ordinal"), n_main, *key))
    size = F.when(F.col("pool") == "aux", F.lit(max(1, n_aux))).otherwise(F.lit(n_main))
    return rows.withColumn("epoch", F.floor(F.col("ordinal") / size).cast("long")).withColumn("index", index)


def condition_stream(mixed: DataFrame, main: DataFrame, aux: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Items of a mixture: ``main(index, item)``, ``aux(index, item)``, with auxiliary items exchanged from some ordinal on.

    ``replaced(from_ordinal, index, item)`` says that, from that auxiliary ordinal to the next one listed for the same
    index, the item of an auxiliary index is another (a control pool, a corrected summary): an as-of match, by the last
    row at or before the ordinal. It becomes a range join by giving each row the ordinal at which it ends.
    """
    both = main.select(F.lit("main").alias("pool"), "index", "item").unionByName(aux.select(F.lit("aux").alias("pool"), "index", "item"))
    out = mixed.join(both, ["pool", "index"])
    if replaced is None:
        return out
    spans = replaced.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("from_ordinal", F.col("item").alias("other")))).alias("_spans"))
    spans = spans.withColumn("pool", F.lit("aux"))
    last = F.try_element_at(F.filter("_spans", lambda s: s["from_ordinal"] <= F.col("ordinal")), F.lit(-1))
    return out.join(spans, ["pool", "index"], "left").withColumn("item", F.coalesce(last["other"], F.col("item"))).drop("_spans")


def sql_permuted(rows: str) -> str:
    """The same in SQL for a query ``rows`` with columns x, n and key (parts joined by colons): adds y. Rounds are nested queries, walks a recursion."""

    def network(source: str, x: str) -> str:
        word = lambda r, half: f"('0x' || substr(md5(key || ':{r}:' || {half}), 1, 12))::BIGINT"
        out = f"SELECT *, {x} // b AS hl, {x} % b AS hr FROM ({source})"
        for r in range(0, ROUNDS, 2):
            out = f"SELECT * REPLACE ((hl + {word(r, 'hr')}) % a AS hl) FROM ({out})"
            out = f"SELECT * REPLACE ((hr + {word(r + 1, 'hl')}) % b AS hr) FROM ({out})"
        return f"SELECT * EXCLUDE (hl, hr), (hl * b + hr)::BIGINT AS y2 FROM ({out})"

    radices = f"SELECT *, (n + b - 1) // b AS a FROM (SELECT *, greatest(1, ceil(sqrt(n)))::BIGINT AS b FROM ({rows}))"
    first = f"SELECT * EXCLUDE (y2), y2 AS y FROM ({network(radices, 'x')})"
    again = f"SELECT * EXCLUDE (y, y2), y2 AS y FROM ({network('SELECT * FROM walk WHERE y >= n', 'y')})"
    return f"WITH RECURSIVE walk AS ({first} UNION ALL {again}) SELECT * FROM walk WHERE y < n"
