"""Secret scans by corpus-wide ownership frequency (operator 9), with DataFrame
functions only.

Base spans are assigned secrets, access key ids and long hexadecimal strings.
Other candidates are long tokens that mix letters and digits.  The hashes of
all candidates' values are counted over the corpus by distinct texts, owners
(``source``) and repositories (``source`` and ``lang``).  All copies of one text
are one witness: the text counts for the least of its owners and repositories,
so a mirrored document does not make examples of its own secrets.

A widely copied example spreads over owners and repositories as texts in general
do; an owner's credential recurs only where its owner writes.  With K the
effective number of owners (inverse sum of squared shares of the texts), m texts
placed independently would have E = K (1 - (1 - 1 / K)^m) owners.  A value is an
example if it has ``LEAST_OWNERS`` owners or more and ``SPREAD`` of E, and
``SPREAD`` of the same expectation for repositories; any other looks live.  A
live candidate outside the base spans becomes a span of kind ``live``; every
base span is marked live or example.

Values are grouped by (hash, owner, repository) before anything is shuffled, so
a value that stands in a third of all documents costs a row a task.

Cases: a null text counts as an empty one; a null owner or language is one of
its own; texts without candidates give empty lists; repeated rows each get a
row; an empty table gives none; columns other than doc_id, text, source and
lang are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylab.llm import spans
from querylab.llm.common import saved

LEAST_OWNERS = 3
SPREAD = 0.5
MIN_SYMBOLS = 8

_NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = _NAMES + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_VALUE = _NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# These two give only the runs that are long enough: shorter ones hold nothing either.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"


def _secret(s: Column) -> Column:
    """The secret itself: of an assignment, what is assigned."""
    return F.when(s["kind"] == "assign", F.regexp_extract(s["value"], _VALUE, 1)).otherwise(s["value"])


def base_spans(text: Column) -> Column:
    assigned = F.filter(spans.find(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], _VALUE, 1)) >= 8)
    return spans.kinds({"assign": assigned, "access": spans.find(text, ACCESS), "hex": spans.find(text, HEX)})


def other_candidates(text: Column, base: Column) -> Column:
    """Long tokens of letters and digits, of varied symbols, outside the base spans."""
    varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= MIN_SYMBOLS
    return F.filter(spans.find(text, TOKEN), lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(
        s["value"], F.lit("[A-Za-z]")) & varied(s["value"]) & ~spans.overlaps(s, base))


def ownership(values: DataFrame) -> DataFrame:
    """``values(hash, owner, repository)``, a row a text, to (hash, texts, owners, repositories)."""
    per = values.groupBy("hash", "owner", "repository").agg(F.count("*").alias("texts"))
    per_owner = per.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("texts").alias("texts"))
    return per_owner.groupBy("hash").agg(F.sum("texts").alias("texts"), F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def effective(texts: DataFrame, by: str) -> float:
    """Effective number of owners or repositories of ``texts``: one number."""
    n = texts.groupBy(by).agg(F.count("*").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
    return n[0] * n[0] / n[1] if n[0] else 1.0


def widely_copied(owned: DataFrame, n_owners: float, n_repositories: float) -> DataFrame:
    """Rows of ``ownership`` whose value spreads as independent texts would."""
    def expected(k: float) -> Column:
        return k * (1 - F.pow(F.lit(1 - 1 / k), F.col("texts")))
    return owned.filter((F.col("owners") >= LEAST_OWNERS) & (F.col("owners") >= SPREAD * expected(n_owners))
                        & (F.col("repositories") >= SPREAD * expected(n_repositories)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, base and spans (base and live spans, sorted;
    arrays of start, rank, end, kind, value), n_live and n_example (base spans
    that look live, and that are widely copied)."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), named("source").alias("owner"),
                       F.concat_ws("/", named("source"), named("lang")).alias("repository"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("other", other_candidates(F.col("text"), F.col("base")))
    hashed = lambda v: F.xxhash64(F.md5(v))
    rows = rows.select(
        "doc_id", "owner", "repository", F.md5("text").alias("text_key"), "base",
        F.transform("base", lambda s: hashed(_secret(s))).alias("base_hashes"),
        F.transform("other", lambda s: F.struct(
            s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("live").alias("kind"),
            s["value"].alias("value"))).alias("other"),
        F.transform("other", lambda s: hashed(s["value"])).alias("other_hashes"))
    held = saved(rows, "candidates")
    some = held.filter((F.size("base") > 0) | (F.size("other") > 0))
    texts = some.groupBy("text_key").agg(F.first(F.array_distinct(F.concat("base_hashes", "other_hashes"))).alias("hashes"),
                                         F.min(F.struct("owner", "repository")).alias("by"))
    texts = saved(texts.select("text_key", "hashes", "by.*"), "candidate-texts")
    owned = ownership(texts.select("owner", "repository", F.explode("hashes").alias("hash")))
    wide = saved(widely_copied(owned, effective(texts, "owner"), effective(texts, "repository")).select("hash"), "examples")
    # What each distinct text holds of widely copied values; a text's own values bound its list.
    copied = (texts.select("text_key", F.explode("hashes").alias("hash")).join(wide, "hash", "left_semi")
              .groupBy("text_key").agg(F.collect_set("hash").alias("copied")))
    none = F.array().cast("array<bigint>")
    judged = some.join(copied, "text_key", "left").withColumn("copied", F.coalesce("copied", none))
    judged = judged.unionByName(held.filter((F.size("base") == 0) & (F.size("other") == 0)).withColumn("copied", none))
    live = F.filter("other", lambda s, i: ~F.array_contains("copied", F.col("other_hashes")[i]))
    example = F.size(F.filter("base_hashes", lambda h: F.array_contains("copied", h))).cast("long")
    return judged.select("doc_id", "base", F.array_sort(F.concat("base", live)).alias("spans"),
                         (F.size("base") - example).alias("n_live"), example.alias("n_example"))
