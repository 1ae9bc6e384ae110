"""Unit tests of operators on small hand-made inputs, checked against the
rules of the evaluator or against brute force."""

import hashlib

import itertools

import pytest
from pyspark.sql import functions as F

from querylab.operators import catalog as K
from querylab.operators import compare as C
from querylab.operators import relational as R
from querylab.operators import scoring as SC
from querylab.operators import textsim as TS
from querylab.operators import workload as WL


# ------------------------------------------------------------- hardness

HARDNESS_CASES = [
    ("SELECT count(*) FROM singer", "easy"),
    ("SELECT name FROM singer WHERE age > 20", "easy"),
    ("SELECT name, country FROM singer", "medium"),
    ("SELECT name FROM singer ORDER BY age DESC LIMIT 3", "medium"),
    ("SELECT T1.name FROM singer AS T1 JOIN concert AS T2 ON T1.id = T2.sid", "easy"),
    ("SELECT name FROM singer WHERE age > 20 OR country = 'x'", "medium"),
    ("SELECT name FROM singer WHERE age > (SELECT avg(age) FROM singer)", "hard"),
    ("SELECT name FROM singer WHERE age > 20 AND country = 'x' ORDER BY age LIMIT 1", "hard"),
    ("SELECT name FROM singer UNION SELECT name FROM actor", "hard"),
    ("SELECT name FROM singer WHERE id IN (SELECT sid FROM concert) ORDER BY age", "extra"),
    ("SELECT country, count(*) FROM singer GROUP BY country HAVING count(*) > 1 ORDER BY count(*) DESC LIMIT 1",
     "hard"),
    ("SELECT a, b FROM t WHERE x LIKE '%a%' OR y > 1 GROUP BY a, b ORDER BY a LIMIT 1", "extra"),
]


def test_hardness_rules(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(HARDNESS_CASES)], "id int, q string")
    got = {r.id: r.hardness for r in WL.with_hardness(df, "q").select("id", "hardness").collect()}
    assert got == {i: h for i, (_, h) in enumerate(HARDNESS_CASES)}


# (comp1, comp2, others) and the label, worked out by hand from the published rule.
HARDNESS_POINTS = {
    "easy": [(0, 0, 0), (1, 0, 0)],
    "medium": [(0, 0, 1), (1, 0, 2), (2, 0, 0), (2, 0, 1)],
    "hard": [(0, 0, 3), (2, 0, 3), (3, 0, 0), (3, 0, 2), (2, 0, 4), (0, 1, 0), (1, 1, 0)],
    "extra": [(3, 0, 3), (4, 0, 0), (4, 0, 2), (2, 1, 0), (1, 1, 1), (0, 2, 0), (2, 0, 2)],
}


def test_hardness_points(spark):
    rows = [(*p, label) for label, points in HARDNESS_POINTS.items() for p in points]
    df = spark.createDataFrame(rows, "c1 int, c2 int, o int, label string")
    got = df.withColumn("h", WL.hardness_expr(F.col("c1"), F.col("c2"), F.col("o"))).collect()
    assert [tuple(r) for r in got if r.h != r.label] == []


DEEP_CASES = [
    # subqueries and functions at any depth, both quotes
    ("SELECT a FROM t WHERE x = (SELECT max(round(abs(b), 2)) FROM u WHERE c IN (SELECT d FROM v WHERE e = (SELECT min(f(g(h))) FROM w))) AND y > 1",
     dict(n_where_conds=2, n_comparison_subquery=1, n_nested_where=1, n_in_subquery=0)),
    ("SELECT f(g(a, b), h(c, i(d, e))), z FROM t", dict(n_select=2)),
    ('SELECT a FROM t WHERE name = "x and y or (z" AND note = \'it\'\'s "and" so\'', dict(n_where_conds=2, n_or=0)),
    ("SELECT a FROM (SELECT b, c FROM u WHERE d = (SELECT 1)) s WHERE s.b BETWEEN 1 AND 2", dict(n_select=1, has_from_subquery=1, n_between=1, n_where_conds=1)),
]


def test_text_features_at_any_depth(spark):
    df = spark.createDataFrame([(q,) for q, _ in DEEP_CASES], "q string")
    for r, (q, want) in zip(WL.clause_features(df, "q").collect(), DEEP_CASES):
        assert {k: r[k] for k in want} == want, q


def test_literals_of_both_quotes_and_signs(spark):
    df = spark.createDataFrame([('SELECT a-3 FROM t WHERE b = -3 AND c IN (-1.5, 2) AND d = "it\'s" AND e = \'say ""x\'',)], "q string")
    from querylab.functions import sqltext as X
    assert df.select(X.literals("q").alias("v")).first().v == ["3", "-3", "-1.5", "2", '"it\'s"', "'say \"\"x'"]


def test_typed_comparisons(spark):
    df = spark.createDataFrame([
        (1, 'SELECT T1.n FROM people AS T1 JOIN pets T2 ON T1.id = T2.pid WHERE T1.n = "abc = 1" AND T2.age >= -3'),
        (2, "SELECT n FROM people WHERE n LIKE 'a%' AND age BETWEEN -1 AND 2.5"),
        (3, "SELECT n FROM a JOIN b ON a.x = b.y WHERE z < 4")], "id int, q string")
    got = sorted((tuple(r) for r in SC.typed_comparisons(df, "q", ["id"]).collect()), key=str)
    assert got == sorted([(1, "people", "n", "=", '"abc = 1"'), (1, "pets", "age", ">=", "-3"), (2, "people", "n", "like", "'a%'"),
                          (2, "people", "age", ">=", "-1"), (2, "people", "age", "<=", "2.5"), (3, None, "z", "<", "4")], key=str)


# ------------------------------------------------------------ NOT IN

def test_not_in_three_valued(spark):
    base = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    sub = spark.createDataFrame([(2,)], "k int")
    sub_null = spark.createDataFrame([(2,), (None,)], "k int")
    empty = spark.createDataFrame([], "k int")
    assert sorted(r.k for r in R.not_in_subquery(base, "k", sub, "k").collect()) == [1]
    assert R.not_in_subquery(base, "k", sub_null, "k").count() == 0
    assert R.not_in_subquery(base, "k", empty, "k").count() == 3


# ------------------------------------------------------- result equality

def _pair(spark, gold, pred, gschema, pschema, ordered=False):
    g = spark.createDataFrame(gold, gschema)
    p = spark.createDataFrame(pred, pschema)
    order = [] if ordered else None
    res = C.result_rows(g, C.GOLD, {"pair": "x"}, order=order).unionByName(
        C.result_rows(p, C.PRED, {"pair": "x"}, order=order))
    pairs = spark.createDataFrame([("x",)], "pair string")
    return C.compare_results(res, ["pair"], ordered, pairs).first()


def test_result_eq_arity_case(spark):
    """Rows of different arity are never equal, but may be partial answers."""
    s1 = [(71, 40, "oak", "elm"), (18, 18, "fir", "yew")]
    s2 = [(6, 71, 40, "oak", "elm"), (7, 18, 18, "fir", "yew")]
    v = _pair(spark, s1, s2, "a int, b int, c string, d string", "z int, a int, b int, c string, d string")
    assert not v.equal and v.partial


def test_result_eq_permutation_and_bag(spark):
    v = _pair(spark, [(1, "x"), (1, "x"), (2, "y")], [("x", 1), ("y", 2), ("x", 1)], "a int, b string",
              "b string, a int")
    assert v.equal and not v.direct_equal
    v = _pair(spark, [(1, "x"), (1, "x"), (2, "y")], [("x", 1), ("y", 2), ("y", 2)], "a int, b string",
              "b string, a int")
    assert not v.equal


def test_result_eq_numbers_and_nulls(spark):
    assert _pair(spark, [(1,)], [(1.0,)], "a int", "a double").equal
    assert not _pair(spark, [(1,)], [("1",)], "a int", "a string").equal
    assert not _pair(spark, [(None,)], [("",)], "a string", "a string").equal
    assert _pair(spark, [], [], "a int", "a int, b int").equal


def test_result_eq_is_exact_beyond_doubles(spark):
    from decimal import Decimal
    big = 9007199254740992
    assert not _pair(spark, [(big,)], [(big + 1,)], "a long", "a long").equal
    assert _pair(spark, [(big,)], [(float(big),)], "a long", "a double").equal
    assert _pair(spark, [(Decimal("12345678.90"), Decimal("100.00"))], [(12345678.9, 100.0)], "a decimal(12,2), b decimal(12,2)",
                 "a double, b double").equal
    assert _pair(spark, [(0.0, Decimal("0.00"))], [(-0.0, 0.0)], "a double, b decimal(5,2)", "a double, b double").equal
    assert _pair(spark, [(1.5e-9, float("nan"))], [(1.5e-9, float("nan"))], "a double, b double", "a double, b double").equal


def test_result_eq_with_many_tied_columns(spark):
    """Ten columns that are the same in every row are one choice, not ten factorial."""
    cols = [f"c{k}" for k in range(10)]
    gold = ", ".join(f"{c} string" for c in cols) + ", k int"
    pred = "k int, " + ", ".join(f"{c} string" for c in cols)
    rows = [((None,) * 10 + (i,), (i,) + (None,) * 10) for i in range(20)]
    assert _pair(spark, [a for a, _ in rows], [b for _, b in rows], gold, pred).equal
    # columns tied as bags but linked to their rows
    left = [(i % 3, (i + 1) % 3, (i + 2) % 3) for i in range(9)]
    assert _pair(spark, left, [(c, a, b) for a, b, c in left], "a int, b int, c int", "x int, y int, z int").equal
    assert not _pair(spark, left, [(c, b, a) for a, b, c in left[:-1]] + [(0, 0, 0)], "a int, b int, c int", "x int, y int, z int").equal


def test_split_writes_both_sinks_in_one_pass(spark):
    import uuid
    from querylab.session import scratch_path
    rows = [(k, "d", None if k % 3 else f"error {k}") for k in range(30)]
    df = spark.createDataFrame(rows, "id long, db string, error string")
    valid, bad, counts = WL.write_split(df, scratch_path(spark, f"split-test-{uuid.uuid4().hex}"))
    assert counts == {"valid": 20, "quarantined": 10}
    assert valid.columns == ["id", "db"] and bad.columns == df.columns
    assert sorted(r.id for r in valid.collect()) == [k for k in range(30) if k % 3]
    assert sorted(tuple(r) for r in bad.collect()) == [r for r in rows if r[2]]


def test_merged_queries_split_again(spark):
    """Blank lines inside a query, at its ends, empty and null queries."""
    texts = ["SELECT 1\n\nFROM t", "\n\n", "", None, "SELECT 'é\U0001d4b3'\n\n\nFROM u\n\n", "SELECT 2"]
    rows = [(f"d{k % 2}", k, texts[k % 6]) for k in range(300)]
    df = spark.createDataFrame(rows, "db string, id long, q string")
    merged = WL.merge_queries(df, ["db"], "id", "q")
    assert max(len(r.ids) for r in merged.collect()) <= 64
    got = [tuple(r) for r in WL.split_queries(merged, ["db"]).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_result_eq_by_refined_colours(spark):
    """Columns that colours cannot tell apart: any pairing works, or only some of them do."""
    names = lambda n: ", ".join(f"c{k} int" for k in range(n))
    # ten columns, each row a unit: every permutation of the columns is a symmetry
    unit = [tuple(int(i == k) for i in range(10)) for k in range(10)]
    assert _pair(spark, unit, [r[3:] + r[:3] for r in unit], names(10), names(10)).equal
    assert not _pair(spark, unit, unit[:9] + [unit[0]], names(10), names(10)).equal
    # two linked pairs of columns: (0, 2) and (1, 3) swap together only
    both = [(a, b, a + 2, b + 2) for a in (0, 1) for b in (0, 1)]
    for order in ((1, 0, 3, 2), (2, 0, 3, 1), (3, 2, 1, 0)):
        assert _pair(spark, both, [tuple(r[k] for k in order) for r in both], names(4), names(4)).equal
    # a ring of six against two rings of three: equal degrees, different tables
    ring = [(i, (i + 1) % 6) for i in range(6)]
    rings = [(i, (i + 1) % 3) for i in range(3)] + [(3 + i, 3 + (i + 1) % 3) for i in range(3)]
    table = lambda e: [tuple(int(v in x) for v in range(6)) for x in e]
    assert not _pair(spark, table(ring), table(rings), names(6), names(6)).equal
    moved = [(p, q) for p, q in [(4, 2), (2, 0), (0, 5), (5, 3), (3, 1), (1, 4)]]
    assert _pair(spark, table(ring), table(moved), names(6), names(6)).equal


def test_partial_answers_of_many_columns(spark):
    """40 predicted columns: subsets are not listed; few values shared, then all."""
    wide = ", ".join(f"c{k} int" for k in range(40))
    pred = [tuple(100 * k + i for k in range(40)) for i in range(5)]
    gold = [(r[3], r[17], r[39]) for r in pred]
    assert _pair(spark, gold, pred, "a int, b int, c int", wide).partial
    assert not _pair(spark, [(c, b, a) for a, b, c in gold], pred, "a int, b int, c int", wide).partial
    flags = [tuple(int(k in (i, 12, 30)) for k in range(40)) for i in range(4)]
    assert _pair(spark, [(1, 0, 1, 1)], flags, "a int, b int, c int, d int", wide).partial
    assert not _pair(spark, [(1, 1, 1, 1)], flags, "a int, b int, c int, d int", wide).partial


def test_result_eq_ordered(spark):
    assert _pair(spark, [(1,), (2,)], [(1,), (2,)], "a int", "a int", ordered=True).equal
    assert not _pair(spark, [(1,), (2,)], [(2,), (1,)], "a int", "a int", ordered=True).equal


def test_dense_positions(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("v", (F.col("id") * 7919) % 1000)
    pos = C.dense_positions(df, [F.col("v")]).orderBy("pos").collect()
    assert [r.pos for r in pos] == list(range(1000))
    assert [r.v for r in pos] == sorted(r.v for r in pos)


@pytest.mark.parametrize("partitions,coalesce", [(8, True), (200, True), (200, False)])
def test_positions_are_a_permutation(spark, partitions, coalesce):
    """Rows with payload, many and few partitions, merged and not: nothing is lost or numbered twice."""
    keys = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": str(coalesce).lower(),
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(0, 200_000).select(((F.col("id") * 7919) % 200_003).alias("v"), F.repeat(F.lit("x"), 40).alias("pay"))
        pos = C.dense_positions(df, [F.col("v")]).agg(
            F.count("*"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()
        assert tuple(pos) == (200_000, 200_000, 0, 199_999)
        run = C.running_sum(df.withColumn("one", F.lit(1)), [F.col("v")], "one", "before").select("before").agg(
            F.count("*"), F.count_distinct("before"), F.max("before")).first()
        assert tuple(run) == (200_000, 200_000, 199_999)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ------------------------------------------------------------ components

def test_connected_components_vs_brute_force(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 21), (21, 22), (22, 20), (30, 31)]
    comp = {r.node: r.component for r in K.connected_components(
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert comp == {n: find(n) for n in parent}


def test_chain_edges(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), ("b", 9)], "g string, k long")
    e = sorted(tuple(r) for r in K.chain_edges(df, ["g"], "k", "k").collect())
    assert e == [(1, 2), (2, 3), (2, 9)]


# -------------------------------------------------------------- textsim

def _lcs_dp(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[-1][-1]


def test_lcs_bit_parallel_vs_dp():
    import random
    rnd = random.Random(7)
    for _ in range(200):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 70))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 90))]
        assert TS._lcs(a, b) == _lcs_dp(a, b)


def test_rouge_l_on_fixture(spark, sf_dir):
    from querylab.tables import Tables
    t = Tables(spark, sf_dir)
    out = TS.rouge_l(TS.candidate_pairs(t.benchmark, "item_id", t.documents, "doc_id"), t.benchmark, "item_id",
                     t.documents, "doc_id")
    rows = out.join(t.benchmark.select("item_id", F.col("text").alias("rt")), "item_id").join(
        t.documents.select("doc_id", F.col("text").alias("ct")), "doc_id").collect()
    import regex
    tok = lambda s: [x for x in regex.split(r"[^\p{L}\p{N}]+", s.lower()) if x]
    assert rows
    for r in rows:
        assert r.lcs == _lcs_dp(tok(r.rt), tok(r.ct))


def test_gram_hashes_tokenise_a_text_once_and_agree_with_the_grams(spark):
    texts = ["a b c d e f g h i", "b c d e f g h i a b c", "a b", "", None, "x a b c d e f g h"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for n in (1, 3, 6, 8):
        out = TS.with_gram_hashes(df.select("id", TS.word_tokens(F.col("text")).alias("tok")), "tok", n, "h")
        assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
        of: dict = {}
        for r in out.select("id", "h", TS.ngrams(F.col("tok"), n).alias("g")).collect():
            assert (r.h is None) == (r.g is None) and len(r.h or []) == len(r.g or [])
            for h, g in zip(r.h or [], r.g or []):
                assert of.setdefault(g, h) == h
        assert len(set(of.values())) == len(of)


def test_candidate_pairs_of_odd_rows_against_brute_force(spark):
    refs = [(1, "one two three four five"), (2, "a b c"), (3, None), (None, "one two three"), (4, "q r"), (2, "a b c")]
    cands = [(10, "zero ONE two, three"), (11, "x a b c a b c"), (12, None), (None, "a b c"), (13, "a b"), (11, "c a b")]
    r, c = spark.createDataFrame(refs, "item int, text string"), spark.createDataFrame(cands, "doc int, text string")
    out = TS.candidate_pairs(r, "item", c, "doc", n=3)
    grams = lambda t: {tuple(w[i:i + 3]) for w in [(t or "").replace(",", "").lower().split()] for i in range(len(w) - 2)}
    want = sorted((i, d) for i, a in refs for d, b in cands if None not in (i, d) and grams(a) & grams(b))
    assert sorted(map(tuple, out.collect())) == want


# ------------------------------------------------------- text at scale

def test_comparisons_of_odd_texts_are_cut_as_the_plain_patterns_cut_them(spark):
    import regex
    plain = regex.compile(r"(?i)([\w.]+)\s*(>=|<=|!=|<>|=|>|<|\blike\b)\s*+('(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"|-?\d++(?:\.\d++)?+)|'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"")
    between = regex.compile(r"(?i)([\w.]+)\s+between\s+(-?\d++(?:\.\d++)?+)\s+and\s+(-?\d++(?:\.\d++)?+)|'(?:[^']|'')*+'|\"(?:[^\"]|\"\")*+\"")
    texts = ["a=1b=2", "SELECT * FROM t WHERE x.like 'q' AND a.like='b'", "t.a >= -1.5 or b like'x''y' and c<>\"z\"", "alike 'q' and xlike = 3",
             "c BETWEEN 1 AND 2 = 3 and d between -4 and 5.5", "'a = 1' = 'b' and e = 'c between 1 and 2'", "a = 'open and b = 2", "", None, ".a=.5 and 1.5=2"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    got = sorted((r.id, r.op, r.value, r.column) for r in SC.typed_comparisons(df, "q", ["id"]).collect())
    bare = lambda c: regex.sub(r"^\w+\.", "", c.lower())
    want = [(i, m[2].lower(), m[3], bare(m[1])) for i, q in enumerate(texts) for m in plain.finditer(q or "") if m[1]]
    want += [(i, op, m[g], bare(m[1])) for i, q in enumerate(texts) for m in between.finditer(q or "") if m[1] for op, g in ((">=", 2), ("<=", 3))]
    assert got == sorted(want)


def test_comparisons_are_searched_in_linear_time(spark):
    import time
    df = spark.createDataFrame([(i, "x" * 30000) for i in range(4)], "id int, q string")
    SC.typed_comparisons(df.limit(1), "q", ["id"]).count()
    start = time.time()
    assert SC.typed_comparisons(df, "q", ["id"]).count() == 0
    assert time.time() - start < 5


def test_units_of_odd_texts(spark):
    texts = ["SELECT f(a, b), g FROM t WHERE x IN (SELECT y FROM u WHERE (z = 1)) GROUP  BY a,\tb", "select a, b)(c, d from t",
             "SELECT a FROM t UNION SELECT b FROM u", "", None, "SELECT count(*) FROM t WHERE a = -1 AND b = 'x-1'"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, q string")
    got = {r.id: r.g for r in SC.with_units(df, "q", "g").select("id", "g").collect()}
    assert got[0].select == ["f(a, b)", "g"] and got[0].where == ["x in (#sub#)"] and got[0].group_cols == ["a", "b"]
    assert got[1].select == ["a", "b)(c", "d"] and got[2].set_op == "union" and got[2].set_tail == "select b from u"
    assert got[3].select == [] and got[4].select is None and got[5].where == ["a = #value#", "b = #value#"]


def test_renamed_columns_chain_in_order_and_keep_case_rules(spark):
    df = spark.createDataFrame([("SELECT A, b, ab FROM t WHERE a.b = B",), ("x",), (None,), ("",)], "q string")
    got = [r[0] for r in df.select(SC.fk_canonical(F.col("q"), {"a": "b", "b": "c", "ab": "ab"})).collect()]
    assert got == ["SELECT c, c, ab FROM t WHERE c.c = c", "x", None, ""]
    assert [r[0] for r in df.select(SC.fk_canonical(F.col("q"), {"AB": "z"})).collect()][0] == "SELECT A, b, z FROM t WHERE a.b = B"


def test_components_take_few_rounds_and_ignore_odd_edges(spark, monkeypatch):
    writes = []
    kept = K.saved
    monkeypatch.setattr(K, "saved", lambda df, name: writes.append(name) or kept(df, name))
    n = 3000
    edges = [(i, i + 1) for i in range(n)] + [(i, i + 1) for i in range(n)] + [(10000, 10000 + i) for i in range(1, 500)] + [
        (20002, 20001), (20001, 20002), (30000, 30000), (None, 5), (7, None)]
    got = dict(map(tuple, K.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    want = {i: 0 for i in range(n + 1)} | {10000 + i: 10000 for i in range(500)} | {20001: 20001, 20002: 20001}
    assert got == want and writes.count("contracted") <= 30
    assert K.connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).columns == ["node", "component"]


def test_a_pair_with_one_repeated_row_is_no_key(spark):
    rows = [(i // 4, i % 4, i) for i in range(800)]
    for more, want in (([], [("t", "a_id"), ("t", "b")]), ([(3, 3, 900)], [])):
        tables = {"t": spark.createDataFrame(rows + more, "a_id long, b int, c long").drop("c")}
        assert K.infer_primary_keys(tables, K.profile(tables)) == want


# ----------------------------------------------------------- value plugs

def test_plug_candidates_and_plugged(spark):
    df = spark.createDataFrame([(1, "SELECT a FROM t WHERE x = 3 AND y = 'k'", "SELECT a FROM t WHERE x = 1 AND y = -2"),
                                (2, "SELECT 1", "SELECT b FROM t")], "id int, g string, p string")
    rows = sorted(tuple(r) for r in SC.plug_candidates(df, "g", "p", ["id"]).collect())
    assert rows == [(1, 0, "1", "'k'"), (1, 0, "1", "3"), (1, 1, "-2", "'k'"), (1, 1, "-2", "3")]
    got = df.select(SC.plugged(F.col("p"), F.array(F.lit("'k'"), F.lit("3"))).alias("t")).collect()
    assert [r.t for r in got] == ["SELECT a FROM t WHERE x = 'k' AND y = 3", "SELECT b FROM t"]
    many = " AND ".join(f"x{k} = {k}" for k in range(60))
    one = spark.createDataFrame([(many, many)], "g string, p string")
    assert one.select(SC.plug_alternatives(F.col("g"), F.col("p"))[2].alias("n")).first().n is None


def test_weighted_draws_exact(spark):
    cats = spark.createDataFrame([(1, 5), (2, 0), (3, 10), (4, 1)], "c int, w long")
    draws = spark.range(0, 500).withColumnRenamed("id", "d")
    got = {r.c: r.n for r in WL.weighted_draws(cats, "c", "w", draws, "d").groupBy("c").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    lo = {1: 0, 3: 5, 4: 15}
    hi = {1: 5, 3: 15, 4: 16}
    want = {}
    for d in range(500):
        r = int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16) % 16
        for c in lo:
            if lo[c] <= r < hi[c]:
                want[c] = want.get(c, 0) + 1
    assert got == want


@pytest.mark.parametrize("text,expected", [
    ("SELECT a FROM t WHERE b > = 1", "SELECT a FROM t WHERE b >= 1"),
    ("SELECT DISTINCT a FROM t WHERE c = 'distinct value'", "SELECT a FROM t WHERE c = 'distinct value'"),
    ("SELECT a FROM t WHERE b = value", "SELECT a FROM t WHERE b = 1"),
])
def test_cleanup(spark, text, expected):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(SC.cleanup(F.col("q")).alias("c")).first().c == expected
