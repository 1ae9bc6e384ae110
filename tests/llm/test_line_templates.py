import collections
import re

import duckdb

from querylab.llm import line_templates as lt
from querylab.llm.queries import op2_line_templates

BLANK = re.compile(r"[\x20\x09\x0B-\x0D]+")


def brute(rows):
    texts, held = {t for _, t in rows if t is not None}, {}
    for t in texts:
        for line in set(t.split("\n")):
            w = ["<*>" if re.search("[0-9]", x) else x for x in BLANK.split(line) if x]
            if w:
                held[t, line] = ((len(w), tuple(w[:lt.DEPTH])), w)
    leaf, vote, wide = (collections.defaultdict(set) for _ in range(3))
    for (t, _), (f, w) in held.items():
        leaf[f].add(t)
        for k, x in enumerate(w[lt.DEPTH:]):
            vote[f, k, x].add(t)
    template = {}
    for (t, line), (f, w) in held.items():
        const = tuple((k, x) for k, x in enumerate(w[lt.DEPTH:]) if x != "<*>" and len(vote[f, k, x]) >= lt.MIN_TEXTS)
        n = len(const) + sum(x != "<*>" for x in f[1])
        if len(leaf[f]) >= lt.MIN_TEXTS and n >= lt.CONSTANT * len(w):
            template[t, line] = (f, const)
            wide[f, const].add(t)
    long = collections.defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            w = tuple(x for x in BLANK.split(line) if x)
            if len(w) >= lt.LONG_WORDS:
                long[w].add(t)
    out = []
    for d, t in rows:
        all_lines = [] if t is None else t.split("\n")
        left = [x for x in all_lines if len(wide[template.get((t, x))]) < lt.MIN_TEXTS
                and len(long[tuple(w for w in BLANK.split(x) if w)]) < lt.LONG_TEXTS]
        out.append((d, len(all_lines), len(all_lines) - len(left), None if t is None else "\n".join(left)))
    return out


NAMES = ["Ada", "Grace", "Alan", "Edsger", "Barbara", "Donald"]
ROWS = [(k, f"This page was last edited on 3{k} May by {n} at the office\nown text number {n} {n}\n\nLicensed under v{k}.0")
        for k, n in enumerate(NAMES)]
ROWS += [(100 + k, f"This page was last some other words that differ {w} entirely yes") for k, w in enumerate("a b c d e f g".split())]
ROWS += [(200 + k, "copy of one whole text\nwith two lines") for k in range(9)] + [(300, None), (301, ""), (302, "\n \n"), (None, "Licensed under v9")]
ROWS += [(400 + k, "short\n" + "x " * (5_000 + k)) for k in range(6)]


def test_matches_brute_force(spark):
    df = spark.createDataFrame([(a, b, 7, "l") for a, b in ROWS], "doc_id long, text string, n_chars int, __key string")
    got = sorted((tuple(r) for r in lt.line_counts(df).collect()), key=str)
    assert got == sorted(brute(ROWS), key=str)
    assert dict((r[0], r[3]) for r in got)[0] == "own text number Ada Ada\n"
    out = lt.dedup_lines(df)
    assert out.columns == df.columns and {r.doc_id: (r.n_chars, r["__key"]) for r in out.collect()}[0] == (24, "l")
    assert lt.line_counts(df.limit(0)).count() == 0


def test_query_matches_sql_and_brute_force(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in op2_line_templates(spark, d).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    assert got == sorted(con.execute(lt.SQL).fetchall())
    assert got == sorted(brute(con.execute("select doc_id, text from documents").fetchall()))
    assert sum(r[2] for r in got) > 100


def test_long_lines_go_from_two_texts_on(spark):
    passage = " ".join(f"word{'abcdefgh'[k % 8]}{'xyz'[k % 3]}" for k in range(55))
    short, copied = " ".join(["below"] * 49), " ".join(["mirror"] * 60)
    rows = [(1, f"one\n{passage}"), (2, f"two\n  {passage.replace(' ', chr(9))}\nend"), (3, f"three\n{short}"), (4, f"four\n{short}"),
            (5, copied), (6, copied), (7, f"{passage} 7"), (8, f"{passage} 8"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_dropped, r.text) for r in lt.line_counts(df).collect()}
    assert got[1] == (1, "one") and got[2] == (1, "two\nend")
    # short lines, copies of one text and generalised templates keep the higher count
    assert all(got[k] == (0, t) for k, t in rows[2:])
    assert all(r.n_dropped == 0 for r in lt.line_counts(df, long_words=1000).collect())


def test_words_are_counted_alike_in_plain_and_odd_lines(spark):
    lines = ["", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a\x0bb c", "a\x0cb", "a\r", "\r", "\u00e9\u4e2d \U0001f600 z", "a\u00a0b c", "x " * 60]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: r.n for r in df.select("line", lt._n_words(df.line).alias("n")).collect()}
    assert got == {x: len([w for w in BLANK.split(x) if w]) for x in lines}


def test_long_lines_of_documents(spark):
    d = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall()
    texts = collections.defaultdict(set)
    for t in {t for _, t in rows if t}:
        for line in t.split("\n"):
            w = tuple(x for x in BLANK.split(line) if x)
            if len(w) >= lt.LONG_WORDS:
                texts[w].add(t)
    by_template = {r.doc_id: r.text for r in lt.line_counts(spark.read.parquet(f"{d}/documents.parquet"), long_words=10 ** 9).collect()}
    got = {r.doc_id: r.text for r in op2_line_templates(spark, d).collect()}
    long = lambda x: len(texts.get(tuple(w for w in BLANK.split(x) if w), ())) >= lt.LONG_TEXTS
    want = {k: None if t is None else "\n".join(x for x in t.split("\n") if not long(x)) for k, t in by_template.items()}
    assert got == want and got != by_template
