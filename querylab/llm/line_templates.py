"""Line dedup by a log-template tree (operator 2), with DataFrame functions only.

A line walks a tree of fixed depth: first by its number of tokens, then by its
``DEPTH`` leading tokens, where a token with a digit is the variable ``<*>``.
In the leaf, a token further on is constant where at least ``MIN_TEXTS``
different texts have it at that position, and variable otherwise.  The line's
template is its leaf with the constants.  Lines whose template has at least
``CONSTANT`` of its tokens constant and recurs in ``MIN_TEXTS`` or more
different texts are dropped from all documents.  A line of ``LONG_WORDS`` words or
more, all of them constant (the same words, blanks apart), goes from
``LONG_TEXTS`` different texts on; short and generalised templates keep the
higher count.

Copies of a whole text are one witness, so a copied document does not make
templates of its own lines.  Only (leaf, text) hashes of all lines are shuffled;
token votes are taken in leaves that recur, which in prose are few.  All counts
combine before their shuffle, so a line in a third of all texts costs a row a task.

Cases: a null text stays null and has no lines; blank lines stay and have no
template; a line shorter than the depth is its own leaf; repeated rows each get
a row; an empty table gives none; other columns stay as they are (``dedup_lines``)
or are ignored (``line_counts``), whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querylab.llm.common import saved

DEPTH = 4
MIN_TEXTS = 5
CONSTANT = 0.6
LONG_WORDS = 50
LONG_TEXTS = 2
_BLANK = r"[\x20\x09\x0B-\x0D]+"


_WORD = r"[^\x20\x09\x0B-\x0D]"


def _masked(text: Column) -> Column:
    """The text with every token that has a digit masked; each token is looked at once."""
    digit_free = r"[^\x20\x09\x0B-\x0D0-9]"
    return F.regexp_replace(text, rf"(?<!{_WORD}){digit_free}*+[0-9]{_WORD}*+", "<*>")


def _tokens(line: Column) -> Column:
    """Tokens of a line, those with a digit masked."""
    return F.filter(F.split(_masked(line), _BLANK), lambda w: w != "")


def _plain(line: Column) -> Column:
    """No blanks but one space between words: most lines, seen without a pattern."""
    odd = [line.contains(b) for b in ("  ", "\t", "\x0b", "\x0c", "\r")] + [line.startswith(" "), line.endswith(" "), line == ""]
    return ~functools.reduce(Column.__or__, odd)


def _n_words(line: Column) -> Column:
    """Number of words; a plain line has one more than it has spaces."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(_plain(line), spaces + 1).otherwise(F.regexp_count(line, F.lit(f"{_WORD}++")))


def _leaf(line: Column, depth: int) -> Column:
    """Number of tokens and the leading ones, hashed, without cutting the whole line up."""
    head = F.regexp_extract(line, rf"^{_BLANK.replace('+', '*+')}((?:{_WORD}++{_BLANK.replace('+', '*+')}){{0,{depth}}}+)", 1)
    head = F.trim(F.regexp_replace(_masked(head), _BLANK, " "))
    return F.xxhash64(_n_words(line), head)


def _lines(docs: DataFrame, lines: Column) -> DataFrame:
    """(text_key, line), each line of a text once; the key is made before the
    lines are dealt out, so a text is hashed once and not once a line."""
    return docs.select(F.md5("text").alias("text_key"), F.array_distinct(lines).alias("lines")).select("text_key", F.explode("lines").alias("line"))


def _repeated(docs: DataFrame, long_words: int, long_texts: int) -> DataFrame:
    """Distinct (text_key, line): lines of ``long_words`` or more that stand in ``long_texts`` different texts."""
    line = F.col("line")
    words = F.when(_plain(line), line).otherwise(F.regexp_replace(F.regexp_replace(line, _BLANK, " "), "^ | $", ""))
    # So many words and the blanks between them have a least length, which is cheaper to see.
    some = F.filter(F.split("text", "\n"), lambda x: F.length(x) >= 2 * long_words - 1)
    lines = _lines(docs, some).filter(_n_words(line) >= long_words)
    held = saved(lines.select("text_key", F.xxhash64("line").alias("line"), F.md5(words).alias("words")).distinct(), "long-lines")
    wide = saved(held.select("words", "text_key").distinct().groupBy("words").count()
                 .filter(F.col("count") >= long_texts).select("words"), "long-words")
    return held.join(wide, "words", "left_semi").select("text_key", "line")


def recurring_lines(docs: DataFrame, depth: int = DEPTH, min_texts: int = MIN_TEXTS, constant: float = CONSTANT,
                    long_words: int = LONG_WORDS, long_texts: int = LONG_TEXTS) -> DataFrame:
    """(text_key, lines): for texts with any, the hashes of the lines whose template recurs."""
    lines = _lines(docs, F.split("text", "\n")).filter(F.rlike("line", F.lit(_WORD))).withColumn("leaf", _leaf(F.col("line"), depth))
    common = saved(lines.select("leaf", "text_key").distinct().groupBy("leaf").count()
                   .filter(F.col("count") >= min_texts).select("leaf"), "leaves")
    # Only lines in leaves that recur are cut into tokens.
    held = lines.join(common, "leaf", "left_semi").select(
        "text_key", F.xxhash64("line").alias("line"), "leaf", _tokens(F.col("line")).alias("tokens"))
    held = saved(held.dropDuplicates(["text_key", "line"]), "leaf-lines")
    after = held.select("text_key", "line", "leaf", F.size("tokens").alias("n"),
                        F.posexplode_outer(F.slice("tokens", depth + 1, F.size("tokens"))).alias("at", "token"))
    # What recurs is written, so the planner knows its size: a small table is broadcast, and no hot key is one task's.
    votes = saved(after.filter((F.col("token") != "<*>")).select("leaf", "at", "token", "text_key").distinct().groupBy(
        "leaf", "at", "token").count().filter(F.col("count") >= min_texts).select("leaf", "at", "token", F.lit(1).alias("kept")), "votes")
    leading = F.size(F.filter(F.slice("tokens", 1, depth), lambda t: t != "<*>")).alias("leading")
    parsed = (after.join(votes, ["leaf", "at", "token"], "left").groupBy("text_key", "line", "leaf", "n").agg(
        F.bit_xor(F.when(F.col("kept") == 1, F.xxhash64("at", "token"))).alias("constants"),
        F.count("kept").alias("kept")))
    parsed = (parsed.join(held.select("text_key", "line", leading), ["text_key", "line"])
              .filter(F.col("kept") + F.col("leading") >= constant * F.col("n"))
              .select("text_key", "line", F.xxhash64("leaf", "constants").alias("template")))
    parsed = saved(parsed, "parsed-lines")
    wide = saved(parsed.select("template", "text_key").distinct().groupBy("template").count()
                 .filter(F.col("count") >= min_texts).select("template"), "wide-templates")
    gone = parsed.join(wide, "template", "left_semi").select("text_key", "line").unionByName(_repeated(docs, long_words, long_texts))
    # A text's own lines bound its list.
    return (gone.groupBy("text_key")
            .agg(F.collect_set("line").alias("lines")))


def _without(docs: DataFrame, how: dict) -> DataFrame:
    """(row, gone, every, left): each row of ``docs`` packed, the hashes of its
    recurring lines, its lines, and those that stay."""
    found = saved(recurring_lines(docs, **how), "recurring").toDF("key", "gone")
    joined = docs.select(F.struct(*docs.columns).alias("row"), F.md5("text").alias("key")).join(found, "key", "left")
    joined = joined.withColumn("every", F.split("row.text", "\n"))
    return joined.withColumn("left", F.when(F.col("gone").isNull(), F.col("every")).otherwise(
        F.filter("every", lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(x)))))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without the lines of recurring templates (``n_chars``, if there, follows)."""
    text = F.array_join("left", "\n")
    n_chars = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text)) if "n_chars" in docs.columns else None
    new = {"text": text, "n_chars": n_chars}
    return _without(docs, how).select(*[
        new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def line_counts(docs: DataFrame, **how) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped and text without the dropped lines."""
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long")
    return _without(docs.select("doc_id", "text"), how).select(
        "row.doc_id", count("every").alias("n_lines"), (count("every") - count("left")).alias("n_dropped"),
        F.array_join("left", "\n").alias("text"))


#: The same in DuckDB, with texts for hashes.
SQL = rf"""
WITH lines AS (
    SELECT DISTINCT text, UNNEST(string_split(text, chr(10))) AS line FROM documents),
masked AS (
    SELECT text, line, list_transform(list_filter(string_split_regex(line, '{_BLANK}'), lambda x: x <> ''),
        lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t
    FROM lines),
leaves AS (
    SELECT text, line, t, len(t) AS n, t[1:{DEPTH}] AS lead FROM masked WHERE len(t) > 0),
held AS (
    SELECT * FROM leaves JOIN (SELECT n, lead FROM leaves GROUP BY n, lead HAVING COUNT(DISTINCT text) >= {MIN_TEXTS})
    USING (n, lead)),
after AS (
    SELECT text, line, n, lead, UNNEST(range({DEPTH} + 1, n + 1)) AS pos FROM held),
tokens AS (
    SELECT a.*, h.t[a.pos] AS token FROM after a JOIN held h USING (text, line)),
votes AS (
    SELECT n, lead, pos, token FROM tokens WHERE token <> '<*>' GROUP BY n, lead, pos, token
    HAVING COUNT(DISTINCT text) >= {MIN_TEXTS}),
constants AS (
    SELECT text, line, list((pos, token) ORDER BY pos) AS c, COUNT(*) AS kept
    FROM tokens JOIN votes USING (n, lead, pos, token) GROUP BY text, line),
parsed AS (
    SELECT h.text, h.line, h.n, h.lead, c.c AS constants FROM held h LEFT JOIN constants c USING (text, line)
    WHERE COALESCE(c.kept, 0) + len(list_filter(h.lead, lambda x: x <> '<*>')) >= {CONSTANT} * h.n),
wide AS (
    SELECT n, lead, constants FROM parsed GROUP BY n, lead, constants HAVING COUNT(DISTINCT text) >= {MIN_TEXTS}),
long AS (
    SELECT text, line, list_filter(string_split_regex(line, '{_BLANK}'), lambda x: x <> '') AS words FROM lines),
repeated AS (
    SELECT words FROM long WHERE len(words) >= {LONG_WORDS} GROUP BY words HAVING COUNT(DISTINCT text) >= {LONG_TEXTS}),
dropped AS (
    SELECT text, list(line) AS gone FROM (
        SELECT p.text, p.line FROM parsed p JOIN wide w
        ON p.n = w.n AND p.lead = w.lead AND p.constants IS NOT DISTINCT FROM w.constants
        UNION ALL SELECT text, line FROM long JOIN repeated USING (words)) GROUP BY text),
kept AS (
    SELECT d.doc_id, string_split(d.text, chr(10)) AS all_lines,
           list_filter(string_split(d.text, chr(10)), lambda x: NOT COALESCE(list_contains(g.gone, x), FALSE)) AS left_lines,
           d.text IS NULL AS none
    FROM documents d LEFT JOIN dropped g ON d.text = g.text)
SELECT doc_id, COALESCE(len(all_lines), 0)::BIGINT AS n_lines,
       (COALESCE(len(all_lines), 0) - COALESCE(len(left_lines), 0))::BIGINT AS n_dropped,
       CASE WHEN none THEN NULL ELSE array_to_string(left_lines, chr(10)) END AS text
FROM kept
"""
