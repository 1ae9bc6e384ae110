"""Column expressions over SQL text (no parser, no per-row Python).

The text is first normalised (quoted literals emptied, subqueries hidden as
``(#SUB#)``), then each clause is cut out with a regular expression and its
units are counted.  Every function maps Column -> Column, so a feature row is
one projection over a table of queries: JVM-side, codegen'd, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AGG = r"(?i)\b(?:max|min|count|sum|avg)\s*\("
SUB = "#SUB#"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: A quoted literal or name: either quote, the quote doubled inside it.
QUOTED = r"""'(?:[^']|'')*+'|"(?:[^"]|"")*+\""""


def once(x: Column, fn) -> Column:
    """``fn(x)`` with ``x`` evaluated once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def strip_quoted(q) -> Column:
    """Empty every quoted literal ('...' or "...", doubled quotes inside)."""
    return once(_c(q), lambda y: F.when(y.contains("'") | y.contains('"'), F.regexp_replace(y, QUOTED, "''")).otherwise(y))


# The functions below walk the parentheses of a text with a depth counter, so
# any depth is right.  Texts are queries: short, whatever the number of rows.

def _walk(x: Column, pieces: str, start: Column, step) -> Column:
    """Fold ``step(state, piece)`` over the pieces of ``x`` that match
    ``pieces``; the state holds ``out``, the text so far."""
    return F.aggregate(F.regexp_extract_all(x, F.lit(pieces), F.lit(0)), start, step, lambda s: s["out"])


def hide_subqueries(q) -> Column:
    """Replace every outermost ``(SELECT ...)`` group by ``(#SUB#)``."""
    opened = "\u0003"  # stands for a parenthesis that opens a subquery
    marked = F.regexp_replace(_c(q), r"(?i)\(\s*+(?=select\b)", opened)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(-1).alias("hidden"))

    def step(s: Column, p: Column) -> Column:
        opens = p.isin("(", opened)
        depth = s["depth"] + F.when(opens, 1).when(p == ")", -1).otherwise(0)
        inside = s["hidden"] >= 0
        hides = ~inside & (p == opened)
        shows = inside & (p == ")") & (depth == s["hidden"])
        out = F.when(hides, F.concat(s["out"], F.lit(f"({SUB}"))).when(~inside | shows, F.concat(s["out"], p)).otherwise(s["out"])
        hidden = F.when(hides, s["depth"]).when(shows, -1).otherwise(s["hidden"])
        return F.struct(out.alias("out"), depth.alias("depth"), hidden.alias("hidden"))
    # Without a subquery the text stays as it is: no walk.
    return once(marked, lambda m: F.when(m.contains(opened), _walk(m, rf"[(){opened}]|[^(){opened}]+", start, step)).otherwise(m))


def outer_text(q) -> Column:
    return hide_subqueries(strip_quoted(q))


def set_op(outer) -> Column:
    """First top-level set operator ('union', 'intersect', 'except' or '')."""
    return F.lower(F.regexp_extract(_c(outer), r"(?i)\s(union|intersect|except)\s", 1))


def main_query(outer) -> Column:
    """The first operand of a set operation (or the whole query)."""
    return F.regexp_replace(_c(outer), r"(?is)\s(?:union|intersect|except)\s.*$", "")


_STOP = {
    "select": r"\s+from\s",
    "from": r"(?=\s+(?:where|group\s+by|having|order\s+by|limit)\s|$)",
    "where": r"(?=\s+(?:group\s+by|having|order\s+by|limit)\s|$)",
    "group": r"(?=\s+(?:having|order\s+by|limit)\s|$)",
    "having": r"(?=\s+(?:order\s+by|limit)\s|$)",
    "order": r"(?=\s+limit\s|$)",
}
_START = {
    "select": r"^\s*select\s+",
    "from": r"\sfrom\s+",
    "where": r"\swhere\s+",
    "group": r"\sgroup\s+by\s+",
    "having": r"\shaving\s+",
    "order": r"\sorder\s+by\s+",
}


def clause(main, name: str) -> Column:
    """Text of one clause of the main query ('' when absent)."""
    return F.regexp_extract(_c(main), f"(?is){_START[name]}(.*?){_STOP[name]}", 1)


def _level(s: Column, p: Column) -> Column:
    return s["depth"] + F.when(p == "(", 1).when(p == ")", -1).otherwise(0)


def flatten_parens(x) -> Column:
    """Empty every outermost pair of parentheses."""
    def step(s: Column, p: Column) -> Column:
        depth = _level(s, p)
        seen = (s["depth"] <= 0) | (depth <= 0)
        return F.struct(F.when(seen, F.concat(s["out"], p)).otherwise(s["out"]).alias("out"), depth.alias("depth"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    return once(_c(x), lambda y: F.when(y.contains("("), _walk(y, r"[()]|[^()]+", start, step)).otherwise(y))


def mark_commas(x, mark: str = "\u0001") -> Column:
    """Replace the commas outside all parentheses by ``mark``."""
    def step(s: Column, p: Column) -> Column:
        piece = F.when((p == ",") & (s["depth"] <= 0), F.lit(mark)).otherwise(p)
        return F.struct(F.concat(s["out"], piece).alias("out"), _level(s, p).alias("depth"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"))
    # A comma can be inside parentheses only where both occur.
    return once(_c(x), lambda y: F.when(y.contains(",") & y.contains("("), _walk(y, r"[(),]|[^(),]+", start, step)).otherwise(
        F.replace(y, F.lit(","), F.lit(mark))))


def n_items(part) -> Column:
    """Number of top-level comma separated items (0 for '')."""
    p = _c(part)
    return F.when(F.trim(p) == "", F.lit(0)).otherwise(F.size(F.split(flatten_parens(p), ",")))


def count(part, pattern: str) -> Column:
    return F.regexp_count(_c(part), F.lit(pattern))


def word(w: str) -> str:
    return rf"(?i)\b{w}\b"


def present(part) -> Column:
    return (F.trim(_c(part)) != "").cast("int")


def has_limit(main) -> Column:
    return _c(main).rlike(r"(?i)\slimit\s+(?:\d+|#VALUE#)").cast("int")


def split_items(part) -> Column:
    """Top-level items of a clause as an array of trimmed, lower-cased strings
    (commas inside parentheses do not split)."""
    p = _c(part)
    marked = mark_commas(p)
    return F.when(F.trim(p) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(marked, "\u0001"), lambda s: F.lower(F.trim(s))))


def split_conditions(part) -> Column:
    """WHERE/HAVING conditions split on top-level AND/OR (the AND of a
    BETWEEN stays inside its condition)."""
    p = F.regexp_replace(_c(part), r"(?i)\bbetween\s+(\S+)\s+and\s+", "between $1 \u0002 ")
    marked = F.regexp_replace(p, r"(?i)\s+(?:and|or)\s+", "\u0001")
    return F.when(F.trim(_c(part)) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(marked, "\u0001"),
                    lambda s: F.lower(F.trim(F.regexp_replace(s, "\u0002", "and")))))


def connectors(part) -> Column:
    """Distinct AND/OR connectors of a condition list (BETWEEN's AND excluded)."""
    p = F.regexp_replace(_c(part), r"(?i)\bbetween\s+(\S+)\s+and\s+", "between $1 ")
    return F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(p, F.lit(r"(?i)\s(and|or)\s"), 1), lambda s: F.lower(s))))


# Quoted strings, and numbers with the sign that follows an operator, a comma
# or an opening parenthesis.  What may begin one is looked for first, the costly
# tests of its surroundings follow.
LITERAL = (r"""(?=['"\d-])(?:""" + QUOTED + r"|-(?<=[=<>(,]-|[=<>(,]\s-)\d++(?:\.\d++)?+\b|(?=\d)\b\d++(?:\.\d++)?+\b)")


def literals(q) -> Column:
    """All literal values (quoted strings and numbers) in order."""
    return F.regexp_extract_all(_c(q), F.lit(f"({LITERAL})"), 1)


def replace_literals(q, slot: str = "#VALUE#") -> Column:
    return F.regexp_replace(_c(q), LITERAL, slot)


def balanced_parens(q) -> Column:
    s = strip_quoted(q)
    return F.length(F.regexp_replace(s, r"[^(]", "")) == F.length(F.regexp_replace(s, r"[^)]", ""))
