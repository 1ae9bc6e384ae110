"""Chat formatting by quotation linking (operator 10).

A line that begins with ``>`` marks quotes, one level a mark.  Lines of one
level in a row are a quoted passage; the normalised lines of passages (lower
case, white space collapsed) are hashed and joined to the hashes of the own
(unquoted) lines of earlier messages of the same conversation.  A message's
parent is the earlier message with most of the lines that it quotes at the
first level; ties go to the latest.  A message without such a link answers the
message before it.  Conversations are ordered by turn, so every reply stands
after what it answers, and texts lose their quotes.

Places in a conversation are counted by blocks of turns, so a conversation that
holds most rows is not one task's: block totals become offsets, and a count
inside each block completes the place.  No conversation is gathered in a row.

Cases: a null text counts as an empty one; quoted lines that no earlier message
holds link nowhere; blank lines link nothing; a null ``conv_id`` is a
conversation of its own; a null ``turn`` comes first, and nothing links to it;
rows that repeat conversation and turn are ordered by role and text, are one
message as a parent and in what they quote; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylab.llm.common import saved

BLOCK = 1024
_MARKS = r"^[\x20\x09]*(?:>[\x20\x09]*)+"
_SPACE = r"[\x20\x09\x0B-\x0D]+"


def _parsed(text: Column) -> Column:
    """Lines as (level, body, norm); norm is empty for a blank line."""
    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        body = F.substring(x, F.length(marks) + 1, F.length(x))
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), body.alias("body"),
                        F.lower(F.trim(F.regexp_replace(body, _SPACE, " "))).alias("norm"))
    return F.transform(F.split(text, "\n"), line)


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, quoted or not: number of quoted passages."""
    levels = F.transform(lines, lambda x: x["level"])
    before = F.concat(F.array(F.lit(0)), F.slice(levels, 1, F.size(levels) - 1))
    return F.size(F.filter(F.zip_with(levels, before, lambda a, b: (a > 0) & (a != b)), lambda x: x))


def _units(lines: Column) -> Column:
    """Distinct (level, hash) of the lines with words and of the paragraphs:
    lines of one level in a row up to a blank one, joined by a space."""
    begin = F.struct(F.lit(-1).alias("level"), F.array().cast("array<string>").alias("part"),
                     F.array().cast("array<struct<level:int,hash:bigint>>").alias("out"))

    def closed(acc: Column) -> Column:
        whole = F.struct(acc["level"].alias("level"), F.xxhash64(F.array_join(acc["part"], " ")).alias("hash"))
        return F.when(F.size(acc["part"]) > 1, F.concat(acc["out"], F.array(whole))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        words = F.when(x["norm"] == "", F.array().cast("array<string>")).otherwise(F.array(x["norm"]))
        same = (acc["level"] == x["level"]) & (x["norm"] != "")
        return F.struct(x["level"].cast("int").alias("level"),
                        F.when(same, F.concat(acc["part"], words)).otherwise(words).alias("part"),
                        F.when(same, acc["out"]).otherwise(closed(acc)).alias("out"))
    single = F.transform(F.filter(lines, lambda x: x["norm"] != ""), lambda x: F.struct(
        x["level"].cast("int").alias("level"), F.xxhash64(x["norm"]).alias("hash")))
    return F.array_distinct(F.concat(single, F.aggregate(lines, begin, step, closed)))


def link_quotes(messages: DataFrame, deep: bool = False) -> DataFrame:
    """One row a message: conv_id, turn, role, place (0 first), parent_turn
    (null for a conversation's first turn), linked (by quotes, not by place),
    quote_level (deepest), n_quoted (quoted lines with words), n_matched (of
    those, lines of the parent), n_passages and text without quotes; with
    ``deep`` also links, and n_matched counts lines and paragraphs."""
    rows = messages.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").alias("role"),
        _parsed(F.coalesce("text", F.lit(""))).alias("lines"), F.xxhash64("role", "text").alias("of"))
    rows = rows.select("conv_id", "turn", "role", "of", "lines", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
                       F.col("conv_id").isNull().alias("c0"))
    units = _units(F.col("lines")) if deep else F.array_distinct(F.transform(
        F.filter("lines", lambda x: (x["level"] < 2) & (x["norm"] != "")),
        lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["norm"]).alias("hash"))))
    rows = rows.withColumn("units", units)
    own = F.transform(F.filter("units", lambda u: u["level"] == 0), lambda u: u["hash"])
    cited = F.filter("units", lambda u: u["level"] > 0)
    kept = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    held = saved(rows.select(
        "conv_id", "turn", "role", "of", "c", "c0", own.alias("own"), cited.alias("cited"),
        F.array_max(F.transform("lines", lambda x: x["level"])).cast("int").alias("quote_level"),
        F.size(F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))).cast("long").alias("n_quoted"),
        _passages(F.col("lines")).cast("long").alias("n_passages"),
        F.regexp_replace(kept, r"^[\s]+|[\s]+$", "").alias("text")), "messages")
    # Only conversations that quote bring their own lines into the join.
    quoting = held.filter(F.size("cited") > 0)
    quotes = quoting.select("c", "c0", F.col("turn").alias("at"), F.explode("cited").alias("u")).select("c", "c0", "at", "u.*").distinct()
    sources = (held.join(quoting.select("c", "c0").distinct(), ["c", "c0"], "left_semi").filter("turn is not null")
               .select("c", "c0", F.col("turn").alias("parent"), F.explode("own").alias("hash")).distinct())
    votes = (quotes.join(sources, ["c", "c0", "hash"]).filter("parent < at")
             .groupBy("c", "c0", "at", "level", "parent").agg(F.count("*").alias("n")))
    levels = votes.groupBy("c", "c0", "at", "level").agg(F.max(F.struct("n", "parent")).alias("best"))
    # A message's own levels bound its list; the shallowest comes first.
    links = levels.groupBy("c", "c0", F.col("at").alias("turn")).agg(F.array_sort(F.collect_list(F.struct(
        "level", F.col("best.parent").alias("parent_turn"), F.col("best.n").alias("n")))).alias("links"))
    links = links.withColumn("best", F.struct(F.col("links")[0]["n"].alias("n"), F.col("links")[0]["parent_turn"].alias("parent")))
    turns = held.select("c", "c0", "turn").groupBy("c", "c0", "turn").agg(F.count("*").alias("rows"))
    placed = _places(turns)
    before = placed.filter("turn is not null").select("c", "c0", (F.col("rank") + 1).alias("rank"), F.col("turn").alias("previous"))
    known = placed.join(before, ["c", "c0", "rank"], "left").join(links, ["c", "c0", "turn"], "left")
    known = known.withColumnsRenamed({"c": "kc", "c0": "kc0", "turn": "kturn"})
    same = Window.partitionBy("c", "c0", "turn").orderBy("role", "of")
    out = held.withColumn("nth", F.row_number().over(same) - 1).join(
        known, (F.col("c") == F.col("kc")) & (F.col("c0") == F.col("kc0")) & F.col("turn").eqNullSafe(F.col("kturn")))
    return out.select(
        "conv_id", "turn", "role", (F.col("first") + F.col("nth")).cast("long").alias("place"),
        F.coalesce("best.parent", "previous").alias("parent_turn"), F.col("best").isNotNull().alias("linked"), "quote_level",
        "n_quoted", F.coalesce("best.n", F.lit(0)).cast("long").alias("n_matched"), "n_passages", "text",
        *[F.coalesce("links", F.array().cast("array<struct<level:int,parent_turn:bigint,n:bigint>>")).alias("links")] * deep)


def _places(turns: DataFrame) -> DataFrame:
    """``turns(c, c0, turn, rows)``, distinct, with rank (of the turn in its
    conversation) and first (rows before it)."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long")
    dealt = turns.withColumn("block", block)
    sums = dealt.groupBy("c", "c0", "block").agg(F.count("*").alias("turns_in"), F.sum("rows").alias("rows_in"))
    ahead = Window.partitionBy("c", "c0").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("c", "c0", "block", F.coalesce(F.sum("turns_in").over(ahead), F.lit(0)).alias("turns_before"),
                          F.coalesce(F.sum("rows_in").over(ahead), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("c", "c0", "block").orderBy(F.col("turn").asc_nulls_first())
    counted = dealt.withColumns({
        "nth": F.row_number().over(inside) - 1,
        "sofar": F.coalesce(F.sum("rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return counted.join(offsets, ["c", "c0", "block"]).select(
        "c", "c0", "turn", (F.col("nth") + F.col("turns_before")).alias("rank"), (F.col("sofar") + F.col("rows_before")).alias("first"))


def formatted(linked: DataFrame, start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """``linked`` rows with their text as one chat segment."""
    return linked.withColumn("chat", F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), "text", F.lit(end + "\n")))


#: The same in DuckDB, with lines for hashes.
SQL = rf"""
WITH parsed AS (
    SELECT conv_id, turn, role, text, COALESCE(conv_id::VARCHAR, '') AS c, conv_id IS NULL AS c0,
           list_transform(string_split(COALESCE(text, ''), chr(10)), lambda x: {{
               'level': len(regexp_extract(x, '{_MARKS}')) - len(replace(regexp_extract(x, '{_MARKS}'), '>', '')),
               'body': substr(x, len(regexp_extract(x, '{_MARKS}')) + 1),
               'norm': lower(trim(regexp_replace(substr(x, len(regexp_extract(x, '{_MARKS}')) + 1), '{_SPACE}', ' ', 'g')))}}) AS lines
    FROM conversations),
held AS (
    SELECT *, list_filter(lines, lambda x: x.level = 0) AS own,
           list_filter(lines, lambda x: x.level > 0 AND x.norm <> '') AS quoted,
           ROW_NUMBER() OVER (PARTITION BY c, c0 ORDER BY turn NULLS FIRST, role, text) - 1 AS place
    FROM parsed),
quotes AS (
    SELECT DISTINCT c, c0, turn, q.norm FROM (SELECT c, c0, turn, UNNEST(quoted) AS q FROM held) WHERE q.level = 1),
sources AS (
    SELECT DISTINCT c, c0, turn AS parent, o.norm FROM (SELECT c, c0, turn, UNNEST(own) AS o FROM held)
    WHERE o.norm <> '' AND turn IS NOT NULL),
votes AS (
    SELECT q.c, q.c0, q.turn, s.parent, COUNT(*) AS n FROM quotes q JOIN sources s
    ON q.c = s.c AND q.c0 = s.c0 AND q.norm = s.norm AND s.parent < q.turn GROUP BY q.c, q.c0, q.turn, s.parent),
links AS (
    SELECT * FROM votes QUALIFY ROW_NUMBER() OVER (PARTITION BY c, c0, turn ORDER BY n DESC, parent DESC) = 1),
turns AS (
    SELECT c, c0, turn, LAG(turn) OVER (PARTITION BY c, c0 ORDER BY turn NULLS FIRST) AS previous
    FROM (SELECT DISTINCT c, c0, turn FROM held))
SELECT h.conv_id, h.turn, h.role, h.place, COALESCE(l.parent, t.previous) AS parent_turn, l.n IS NOT NULL AS linked,
       list_max(list_transform(h.lines, lambda x: x.level))::INTEGER AS quote_level, len(h.quoted)::BIGINT AS n_quoted,
       COALESCE(l.n, 0) AS n_matched,
       len(list_filter(range(1, len(h.lines) + 1), lambda i: h.lines[i].level > 0
           AND (i = 1 OR h.lines[i - 1].level <> h.lines[i].level)))::BIGINT AS n_passages,
       regexp_replace(array_to_string(list_transform(h.own, lambda x: x.body), chr(10)), '^\s+|\s+$', '', 'g') AS text
FROM held h JOIN turns t ON h.c = t.c AND h.c0 = t.c0 AND h.turn IS NOT DISTINCT FROM t.turn
LEFT JOIN links l ON h.c = l.c AND h.c0 = l.c0 AND h.turn = l.turn
"""
