import collections
import re

import duckdb
import pandas as pd

from querylab.llm import chat
from querylab.llm.queries import op10_quotation_chains, op10_quotation_linking

MARKS = re.compile(r"^[ \t]*(?:>[ \t]*)+")


def parse(text):
    out = []
    for x in (text or "").split("\n"):
        m = MARKS.match(x)
        marks = m.group() if m else ""
        body = x[len(marks):]
        out.append((marks.count(">"), body, re.sub(r"[\x20\x09\x0B-\x0D]+", " ", body).strip(" ").lower()))
    return out


def brute(rows):
    convs, out = collections.defaultdict(list), []
    for r in rows:
        convs[r[0]].append(r)
    for c, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = sorted({r[1] for r in own}, key=lambda t: (t is not None, t or 0))
        lines = collections.defaultdict(set)
        for _, t, _, text in own:
            lines[t] |= {n for lv, _, n in parse(text) if lv == 0 and n}
        for place, (_, t, role, text) in enumerate(own):
            p = parse(text)
            # rows that repeat a turn cite together
            cited = {n for r in own if r[1] == t for lv, _, n in parse(r[3]) if lv == 1 and n}
            best = max(((len(cited & lines[x]), x) for x in turns if x is not None and t is not None and x < t and cited & lines[x]),
                       default=None)
            k = turns.index(t)
            out.append((c, t, role, place, best[1] if best else turns[k - 1] if k else None, best is not None,
                        max(x[0] for x in p), sum(x[0] > 0 and x[2] != "" for x in p), best[0] if best else 0,
                        sum(x[0] > 0 and (i == 0 or p[i - 1][0] != x[0]) for i, x in enumerate(p)),
                        "\n".join(x[1] for x in p if x[0] == 0).strip()))
    return out


ROWS = [(1, 0, "user", "Hello there\nHow do I sort a list?\n\nThanks"), (1, 1, "assistant", "> How do I  SORT a list?\nUse sorted().\nIt returns a copy."),
        (1, 2, "user", ">> How do I sort a list?\n> Use sorted().\nAnd in place?"), (1, 3, "user", "> Hello there\n>Thanks\n \nno reply yet"),
        (1, 5, "assistant", "> > Thanks\n> no such line\nfine"), (1, 9, "assistant", "> It returns a copy.\n> And in place?\n> Use sorted()."),
        (2, 0, "user", "> quote of nothing"), (2, 1, None, None), (2, 2, "user", ""), (3, 4, "user", "same\nline"), (3, 5, "a", "same"),
        (3, 7, "b", "> same\n> line\n>\n> "), (3, 7, "b", "> same\n> line\n>\n> "), (3, 7, "a", "x"), (3, None, "u", "no turn"), (3, 8, "c", "> no turn"),
        (None, 0, "user", "in the null one"), (None, 1, "user", "> in the null one\nyes"), (4, 5000, "u", "> far\n" + "y " * 50_000), (4, 100, "u", "far"),
        (4, 1, "u", "far " * 3), (5, 0, "u", "Émile\tÄ x"), (5, 1, "u", " > émile ä   X\nok")]
ROWS += [(7, k, "user", f"line {k}\n> line {k // 2}") for k in range(3000)]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[3]))


def test_matches_brute_force_and_sql(spark):
    df = spark.createDataFrame([(*r, 1, "c") for r in ROWS], "conv_id long, turn long, role string, text string, place int, c string")
    linked = chat.link_quotes(df.repartition(5))
    got = order(linked.collect())
    assert got == order(brute(ROWS))
    con = duckdb.connect()
    con.register("rows", pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    con.execute("create view conversations as select * from rows")
    assert got == order(con.execute(chat.SQL).fetchall())
    assert chat.formatted(linked).filter("conv_id = 1 and turn = 2").first().chat == "<|im_start|>user\nAnd in place?<|im_end|>\n"
    assert chat.link_quotes(df.limit(0)).count() == 0


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    got = order(op10_quotation_linking(spark, d).collect())
    assert got == order(con.execute(chat.SQL).fetchall()) == order(brute(rows))


def test_deep_and_rewrapped_quotes(spark):
    rows = [(1, 0, "How do I sort\na long list?\n\nThanks a lot"), (1, 1, "> How do I sort a long\n> list?\nUse sorted()"),
            (1, 2, "a turn between"), (1, 3, ">> thanks a LOT\nwelcome"), (1, 4, ">> How do I\n>> sort a long list?\n> Use sorted()\nyes"),
            (1, 5, ">> Use sorted()\n> no such line\n>>> nothing\n> >> > a turn between"), (1, 6, "> How do I sort\n> a long"), (2, 0, "> alone"), (2, 1, None)]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.parent_turn, r.linked, [tuple(x) for x in r.links]) for r in chat.link_quotes(df, deep=True).collect()}
    assert got == {(1, 0): (None, False, []), (1, 1): (0, True, [(1, 0, 1)]), (1, 2): (1, False, []), (1, 3): (0, True, [(2, 0, 1)]),
                   (1, 4): (1, True, [(1, 1, 1), (2, 0, 1)]), (1, 5): (1, True, [(2, 1, 1), (4, 2, 1)]), (1, 6): (0, True, [(1, 0, 1)]),
                   (2, 0): (None, False, []), (2, 1): (0, False, [])}


def test_chains_of_given_conversations(spark):
    d = "/root/testdata/sf0.01"
    chains = op10_quotation_chains(spark, d)
    assert order(chains.drop("links").collect()) == order(op10_quotation_linking(spark, d).collect())
