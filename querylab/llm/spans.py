"""Pattern spans of texts as column expressions (code points, end exclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def find(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches.

    The pieces between the matches give the positions; the pattern must not
    match an empty string.  Null texts give null."""
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern),
                      lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["p"])
        b = a + F.length(x["m"])
        return F.when(x["m"].isNull(), acc).otherwise(F.struct(b.alias("at"), F.concat(acc["out"], F.array(
            F.struct(a.alias("start"), b.alias("end"), x["m"].alias("value")))).alias("out")))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def kinds(found: dict[str, Column]) -> Column:
    """One array of (start, rank, end, kind, value), sorted by start, then by
    the order of the kinds."""
    def named(r: int, k: str, own: Column) -> Column:
        return F.transform(own, lambda s: F.struct(
            s["start"].alias("start"), F.lit(r).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind"),
            s["value"].alias("value")))
    return F.array_sort(F.concat(*[named(r, k, own) for r, (k, own) in enumerate(found.items())]))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (a["start"] < s["end"]) & (s["start"] < a["end"]))


def replaced(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` in place of each span; of overlapping spans the first stands."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(
            acc["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))
    return F.aggregate(spans, begin, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
