"""Personal data by information-theoretic sanitisation (operator 6), with
DataFrame functions only.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers.  Their
values are the protected entities.  A term (a word of ``TERM`` letters or more)
within ``CONTEXT`` characters of an entity co-occurs with it.  Over all
documents, with N of them, df(e) holding the entity, df(t) the term and df(t, e)
the term near the entity,

    disclosure = PMI(t; e) / IC(e) = log(N df(t, e) / (df(t) df(e))) / log(N / df(e))

is the share of the entity's information that the term reveals.  Terms that
reveal at least ``THRESHOLD`` of it, seen with it in at least ``EVIDENCE``
different contexts, are spans of kind ``term`` wherever they stand near the entity.

With ``unseen`` above zero there is no count of contexts; instead a term is taken
to stand in that many more documents away from the entity (times its copies a
text), df(t) + unseen df(t, e) / texts(t, e), so a term seen once is judged by how
rare it is.

Copies of a text are one witness: contexts are taken from distinct texts.  Only
documents with base spans give contexts; document frequencies count only the
terms in question, over all documents.

Cases: a null text counts as an empty one; texts without spans give empty lists;
an entity in every document reveals nothing and has no terms; repeated rows
each get a row; an empty table gives none; columns other than ``doc_id`` and
``text`` are ignored by ``find_pii``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylab.llm import spans
from querylab.llm.common import saved

CONTEXT = 60
TERM = 4
THRESHOLD = 0.9
EVIDENCE = 2
UNSEEN = 0.5

# The first three patterns are written so that every match is found at the
# start of its run (or where the last match ended) and nothing is tried twice.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# A whole run of digits, single blanks or hyphens between, that has 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?+[0-9])"
# As far as the last digit of its run, 10 to 15 digits.
PHONE = r"\+[0-9](?:[ ().-]*+[0-9]){9,14}+(?![ ().-]*+[0-9])"


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(value, "[^0-9]", "")), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Sorted spans (start, rank, end, kind, value) of the base kinds."""
    none = F.array().cast(f"array<{spans.SPAN}>")
    digit = F.rlike(text, F.lit("[0-9]"))
    return spans.kinds({
        "email": F.when(F.contains(text, F.lit("@")), spans.find(text, EMAIL)).otherwise(none),
        "ip": F.when(digit, F.filter(spans.find(text, IP), lambda s: F.rlike(
            s["value"], F.lit(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")))).otherwise(none),
        "card": F.when(digit, F.filter(spans.find(text, CARD), lambda s: _luhn(s["value"]))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), spans.find(text, PHONE)).otherwise(none)})


def _entity(s: Column) -> Column:
    value = F.when(s["kind"].isin("card", "phone"), F.regexp_replace(s["value"], "[^0-9]", "")).otherwise(F.lower(s["value"]))
    return F.concat_ws(":", s["kind"], value)


def _term(shortest: int) -> str:
    return rf"(?<!\p{{L}})\p{{L}}{{{shortest},}}+"


def _context_terms(text: Column, s: Column, base: Column, shortest: int) -> Column:
    """Terms (start, end, term) within ``CONTEXT`` characters of a span and
    outside all base spans; a word at the context's outer edge may be cut and
    is left out (not at the text's start)."""
    def moved(part: Column, at: Column) -> Column:
        return F.transform(spans.find(part, _term(shortest)), lambda w: F.struct(
            (w["start"] + at).alias("start"), (w["end"] + at).alias("end"), F.lower(w["value"]).alias("term")))
    left = F.greatest(F.lit(0), s["start"] - CONTEXT)
    before = F.filter(moved(F.substring(text, left + 1, s["start"] - left), left), lambda w: (w["start"] > left) | (left == 0))
    after = F.filter(moved(F.substring(text, s["end"] + 1, F.lit(CONTEXT)), s["end"]), lambda w: w["end"] < s["end"] + CONTEXT)
    return F.filter(F.concat(before, after), lambda w: ~spans.overlaps(w, base))


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, evidence: int = EVIDENCE, shortest: int = TERM,
             unseen: float = 0.0) -> DataFrame:
    """One row a document: doc_id, text_key, base and spans (base and term
    spans, sorted), as arrays of (start, rank, end, kind, value)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    near = F.transform("base", lambda s: F.struct(
        _entity(s).alias("entity"), _context_terms(F.col("text"), s, F.col("base"), shortest).alias("terms")))
    held = saved(rows.select("doc_id", "base", F.when(F.size("base") > 0, F.md5("text")).alias("text_key"),
                             F.when(F.size("base") > 0, near).alias("near")), "base-spans")
    with_base = held.filter("text_key is not null")
    total = held.count()
    # Copies of a text count once as witnesses but in full as documents.
    per_text = with_base.groupBy("text_key").agg(F.count("*").alias("copies"), F.first("near").alias("near"))
    seen = saved(per_text.select("text_key", "copies", F.explode("near").alias("n")).select(
        "text_key", "copies", "n.entity", "n.terms"), "contexts")
    df_e = seen.select("text_key", "copies", "entity").distinct().groupBy("entity").agg(F.sum("copies").alias("df_e"))
    words = seen.select("text_key", "copies", "entity", F.explode("terms").alias("w"),
                        F.xxhash64(F.transform("terms", lambda w: w["term"])).alias("context")).select(
        "text_key", "copies", "entity", "context", "w.*")
    both = words.select("entity", "term", "text_key", "copies").distinct().groupBy("entity", "term").agg(
        F.sum("copies").alias("df_te"), F.count("*").alias("texts"))
    if not unseen:
        witnessed = words.select("entity", "term", "context").distinct().groupBy("entity", "term").count().filter(
            F.col("count") >= evidence)
        both = both.join(witnessed, ["entity", "term"])
    pairs = saved(both.join(df_e, "entity"), "pairs")
    asked = saved(pairs.select("term").distinct(), "terms")
    all_words = docs.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all("text", F.lit(_term(shortest)), F.lit(0)), lambda w: F.lower(w)))).alias("term"))
    if unseen:
        # Common words are asked for too: counted before the join, each is a row a task.
        df_t = all_words.groupBy("term").agg(F.count("*").alias("df_t")).join(asked, "term", "left_semi")
    else:
        df_t = all_words.join(asked, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_t"))
    held_t = F.col("df_t") + unseen * F.col("df_te") / F.col("texts") if unseen else F.col("df_t")
    information = F.log(F.lit(float(max(total, 1))) / F.col("df_e"))
    shared = F.log(F.lit(float(max(total, 1))) * F.col("df_te") / (held_t * F.col("df_e")))
    telling = pairs.join(df_t, "term").filter((information > 0) & (shared >= threshold * information)).select("entity", "term")
    found = (words.join(telling, ["entity", "term"], "left_semi").groupBy("text_key")
             .agg(F.collect_set(F.struct("start", F.lit(4).alias("rank"), "end", F.lit("term").alias("kind"),
                                         F.col("term").alias("value"))).alias("more")))
    spanned = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    plain = held.filter("text_key is null").select("doc_id", "text_key", "base", F.col("base").alias("spans"))
    return plain.unionByName(with_base.join(found, "text_key", "left").select(
        "doc_id", "text_key", "base", spanned.alias("spans")))


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, evidence: int = EVIDENCE) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in
    brackets: base values are removed and telling terms generalised."""
    found = (find_pii(docs, threshold, evidence).filter("text_key is not null")
             .groupBy(F.col("text_key").alias("key")).agg(F.first("spans").alias("spans")))
    # The given row travels packed, so its columns may have any names.
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.md5("text").alias("key")).join(found, "key", "left")
    out = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(spans.replaced(F.col("row.text"), F.col("spans")))
    return keyed.select(*[out.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
