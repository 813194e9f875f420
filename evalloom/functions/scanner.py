"""A lexer of Go-like sources in columns: one alternation cuts a text into tokens, everything else works on the token array.

Strings, raw strings, runes and comments are tokens of their own, so nothing inside them is taken for code. Flags and
text without comments follow from the tokens, on the JVM; there is no syntax tree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.scalars import one_space

#: Token kinds, in the order in which they are tried; an unclosed string, rune or comment falls to single characters.
PARTS = [
    r"`[^`]*+`",
    r'"(?:[^"\\\n]++|\\.)*+"',
    r"'(?:[^'\\\n]++|\\.)*+'",
    r"(?s:/\*.*?\*/)",
    r"//[^\n]*+",
    r"[\p{L}_][\p{L}\p{Nd}_]*+",
    r"[0-9][0-9A-Za-z_.]*+",
    r"[ \t\r\f]++",
    r"(?s:.)",
]
TOKEN = "|".join(PARTS)
#: The same for RE2, which has no possessive quantifiers.
SQL_TOKEN = TOKEN.replace("++", "+").replace("*+", "*")


def tokens(code: Column) -> Column:
    """All tokens of a text in order; joined they are the text."""
    return F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))


def is_comment(t: Column) -> Column:
    return t.startswith("//") | (t.startswith("/*") & (F.length(t) > 3))


def verbatim(code: Column) -> Column:
    """Source text without comments, white space as single spaces (also within strings)."""
    return one_space(F.array_join(F.transform(tokens(code), lambda t: F.when(is_comment(t), F.lit(" ")).otherwise(t)), ""))


def _code(ts: Column) -> Column:
    """Tokens that mean something: no comments, no blanks, newlines kept."""
    return F.filter(ts, lambda t: ~is_comment(t) & ~t.rlike(r"^[ \t\r\f]+$"))


def _word(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^[\p{L}_]"), F.lit(False))


def construct_flags(code: Column) -> Column:
    """Sorted flags: build_tags, cgo, generics, go:embed, unsafe_ptr.

    Directives are line comments, build tags only before the first code token; ``"C"`` counts in an import alone, single or
    grouped; type parameters follow the name of a function, or of a type where a name and a constraint stand in brackets;
    ``unsafe.Pointer`` is three tokens, ``uintptr`` one.
    """
    return F.transform(F.array(tokens(code)), _flags)[0]


def _flags(ts: Column) -> Column:
    def bound(c: Column) -> Column:
        lead = F.transform(F.array(F.filter(c, lambda t: t != "\n")), lambda x: x)[0]
        at = lambda i: F.get(c, i)
        every = F.sequence(F.lit(0), F.greatest(F.size(c) - 1, F.lit(0)))
        unsafe = F.exists(every, lambda i: (at(i) == "unsafe") & (at(i + 1) == ".") & (at(i + 2) == "Pointer")) | F.array_contains(c, "uintptr")
        func = F.exists(every, lambda i: (at(i) == "func") & _word(at(i + 1)) & (at(i + 2) == "["))

        # a fold over code tokens: whether an import or a type declaration is open, and how deep in its brackets
        def step(s: Column, t: Column) -> Column:
            opens, closes = t.isin("(", "{", "["), t.isin(")", "}", "]")
            depth = F.when(s["kind"] == "", F.lit(0)).otherwise(s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0))
            ends = ((t == "\n") & (s["depth"] == 0) & ~s["fresh"]) | (closes & (depth <= 0) & (s["kind"] != ""))
            kind = F.when((s["kind"] == "") & t.isin("import", "type"), t).when(ends, F.lit("")).otherwise(s["kind"])
            group = F.when(s["fresh"] & (t == "("), F.lit(True)).when(kind == "", F.lit(False)).otherwise(s["group"])
            cgo = s["cgo"] | ((s["kind"] == "import") & (t == '"C"'))
            # name [ name constraint, where a declaration starts
            place = (
                F.when(t.isin("type", "(", "\n") & (kind == "type") & (depth == F.when(group, 1).otherwise(0)), F.lit(1))
                .when((s["place"] == 1) & _word(t), F.lit(2))
                .when((s["place"] == 2) & (t == "["), F.lit(3))
                .when((s["place"] == 3) & _word(t), F.lit(4))
                .otherwise(F.lit(0))
            )
            generic = s["generic"] | ((s["place"] == 4) & (_word(t) | t.isin(",", "~", "[")))
            fresh = (s["kind"] == "") & t.isin("import", "type")
            return F.struct(kind.alias("kind"), F.when(kind == "", F.lit(0)).otherwise(depth).alias("depth"), group.alias("group"), fresh.alias("fresh"), place.alias("place"), cgo.alias("cgo"), generic.alias("generic"))

        start = F.struct(F.lit("").alias("kind"), F.lit(0).alias("depth"), F.lit(False).alias("group"), F.lit(False).alias("fresh"), F.lit(0).alias("place"), F.lit(False).alias("cgo"), F.lit(False).alias("generic"))
        told = F.aggregate(c, start, step, lambda s: F.struct(s["cgo"], s["generic"]))
        first = F.coalesce(F.array_position(ts, F.get(lead, F.lit(0))), F.lit(0))
        before = F.when(first > 0, F.slice(ts, F.lit(1), (first - 1).cast("int"))).otherwise(ts)
        build = F.exists(before, lambda t: t.rlike(r"^//(go:build([ \t].*)?$|[ \t]*\+build([ \t].*)?$)"))
        embed = F.exists(ts, lambda t: t.rlike(r"^//go:embed([ \t].*)?$"))
        rules = {"build_tags": build, "cgo": told["cgo"], "generics": told["generic"] | func, "go:embed": embed, "unsafe_ptr": unsafe}
        return F.array_compact(F.array(*[F.when(F.coalesce(c_, F.lit(False)), F.lit(k)) for k, c_ in rules.items()]))

    return F.transform(F.array(_code(ts)), bound)[0]
