"""Scoring of predicted vs gold queries and evaluation roll-ups (E-9..E-23).

Clause units are arrays cut from the SQL text by Column expressions; a
component scores 1 only when gold and predicted units match completely (the
evaluator's 0/1 partial scores), with label/pred totals kept for the
roll-up denominators.  Roll-ups are grouping sets; per-session "all turns
right" is a bool_and aggregate; cumulative rates are windows over the
already-aggregated (level x iteration) table, never over raw rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querylab.functions import sqltext as X

COMPONENTS = ("select", "select_no_agg", "where", "where_no_op", "group_no_having", "group", "order",
              "and_or", "iuen", "keywords")
_AGG_WRAP = r"(?i)^(?:max|min|count|sum|avg)\s*\(\s*(.*?)\s*\)$"


# ------------------------------------------------------------- E-9 .. E-12

def outside_quotes(text: Column, fn) -> Column:
    """Apply ``fn`` to the parts of ``text`` outside single-quoted spans
    (split on quotes; even pieces are outside)."""
    parts = F.split(text, "'")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, fn(p)).otherwise(p)), "'")


def cleanup(text: Column) -> Column:
    """Evaluator clean-up before execution (E-9): join split comparison
    operators, drop DISTINCT, replace the placeholder word ``value`` by 1."""
    def fix(p: Column) -> Column:
        p = F.regexp_replace(p, r"([<>!])\s+=", "$1=")
        p = F.regexp_replace(p, r"(?i)\bdistinct\s+", "")
        return F.regexp_replace(p, r"(?i)\bvalue\b", "1")
    return outside_quotes(text, fix)


def value_slots(text: Column) -> tuple[Column, Column]:
    """(literal values in order, text with #VALUE# slots) (E-10)."""
    return X.literals(text), X.replace_literals(text)


def plug_alternatives(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """E-11: distinct gold values, number of predicted slots and the number
    of ways to fill the slots (|values| ^ slots; NULL beyond a bigint)."""
    vals = F.array_distinct(X.literals(gold))
    slots = F.size(X.literals(pred))
    n_alt = F.when(slots == 0, F.lit(1)).otherwise(F.pow(F.size(vals), slots)).try_cast("bigint")
    return vals, slots, n_alt


def plug_candidates(df: DataFrame, gold_col: str, pred_col: str, keys: Sequence[str]) -> DataFrame:
    """(keys, slot, predicted, value): for every literal slot of the predicted
    query what it holds and each distinct gold value that may be plugged in
    (E-11).  Rows grow with slots times values, not with their combinations;
    :func:`plugged` fills the slots for one choice of values."""
    slots = df.select(*keys, F.array_distinct(X.literals(F.col(gold_col))).alias("__vals"),
                      F.posexplode(X.literals(F.col(pred_col))).alias("slot", "predicted"))
    return slots.select(*keys, "slot", "predicted", F.explode("__vals").alias("value"))


def plugged(pred: Column, values: Column) -> Column:
    """The predicted text with its i-th literal replaced by ``values[i]``."""
    parts = F.split(X.replace_literals(pred, "\u0003"), "\u0003")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == F.size(parts) - 1, p).otherwise(
        F.concat(p, F.coalesce(F.try_element_at(values, i + 1), F.lit(""))))), "")


_NUMBER = r"-?\d++(?:\.\d++)?+"
# A run of name characters is tried from its start only, or from where the last match ended, and not given back
# bit by bit: the cost is linear in the text.  A comparison may still begin inside a run that ends in ".like".
_NAME_START = r"(?:(?<![\w.])|\G)"
# The last alternative passes over quoted text that is not itself a compared value.
COMPARISON = (rf"(?i){_NAME_START}([\w.]++|[\w.]*\.(?=like\b))\s*+(>=|<=|!=|<>|=|>|<|\blike\b)\s*+(" + X.QUOTED + "|" + _NUMBER + ")|" + X.QUOTED)
BETWEEN = rf"(?i){_NAME_START}([\w.]++)\s++between\s++({_NUMBER})\s++and\s++({_NUMBER})|" + X.QUOTED


def typed_comparisons(df: DataFrame, text_col: str, keys: Sequence[str]) -> DataFrame:
    """(keys, table, column, op, value) for every literal comparison, BETWEEN
    ends as ``>=`` / ``<=`` (E-12).  ``table`` is the column's qualifier, an
    alias resolved to its table; of a bare column it is the query's table when
    FROM names exactly one, else NULL."""
    t = F.col(text_col)

    def found(pattern: str) -> Column:
        """Whole matches; the groups are cut from these short texts."""
        return F.filter(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda x: ~F.substring(x, 1, 1).isin("'", '"'))
    none = F.array().cast("array<string>")
    named = r"(?i)\b(?:from|join|,)\s+(\w+)(?:\s+as)?\s+(?!(?:where|join|on|group|having|order|limit|union|intersect|except|left|right|full|inner|cross|natural)\b)(\w+)"
    as_lower = lambda pattern, g: F.transform(F.regexp_extract_all("__outer", F.lit(pattern), F.lit(g)), lambda x: F.lower(x))
    hits = df.select(*keys, t.alias("__text"), found(COMPARISON).alias("__cmp"),
                     F.when(F.lower(t).contains("between"), found(BETWEEN)).otherwise(none).alias("__btw"))
    hits = hits.filter("size(__cmp) + size(__btw) > 0").withColumn("__outer", X.strip_quoted("__text"))
    # Aliases are asked for by qualified columns only.
    dotted = lambda c: F.when(F.col("__text").contains("."), c).otherwise(none)
    kind = lambda c, k: F.transform(c, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("hit")))
    ex = hits.select(*keys, F.array_distinct(as_lower(r"(?i)\b(?:from|join)\s+(\w+)", 1)).alias("__tables"),
                     dotted(as_lower(named, 2)).alias("__aliases"), dotted(as_lower(named, 1)).alias("__named"),
                     F.explode(F.concat(kind("__cmp", 0), kind("__btw", 1), kind("__btw", 2))).alias("c"))
    of_kind, hit = F.col("c.kind"), F.col("c.hit")
    cut = lambda g, low, high: F.when(of_kind == 0, F.regexp_extract(hit, COMPARISON, g)).when(
        of_kind == 1, low).otherwise(high)
    between = lambda g: F.regexp_extract(hit, BETWEEN, g)
    ex = ex.select(*keys, "__tables", "__aliases", "__named", F.lower(cut(1, between(1), between(1))).alias("__full"),
                   F.lower(cut(2, F.lit(">="), F.lit("<="))).alias("op"), cut(3, between(2), between(3)).alias("value"))
    ex = ex.withColumn("__prefix", F.regexp_extract("__full", r"^(\w+)\.", 1))
    prefix = F.col("__prefix")
    of_alias = F.try_element_at(F.col("__named"), F.nullif(F.array_position("__aliases", prefix).cast("int"), F.lit(0)))
    only = F.when(F.size("__tables") == 1, F.col("__tables")[0])
    return ex.select(*keys, F.when(prefix == "", only).otherwise(F.coalesce(of_alias, prefix)).alias("table"),
                     F.regexp_replace("__full", r"^\w+\.", "").alias("column"), "op", "value")


# ----------------------------------------------------------- E-13 units

def fk_canonical(text: Column, mapping: dict[str, str]) -> Column:
    """Rename columns to the representative of their FK-equivalence class."""
    renames = [(c, rep) for c, rep in sorted(mapping.items()) if c != rep]

    def change(c: str, rep: str, low: Column | None = None):
        put = lambda y: F.regexp_replace(y, rf"(?i)\b{c}\b", rep)
        return put if low is None else lambda y: F.when(low.contains(c.lower()), put(y)).otherwise(y)

    def renamed(low: Column) -> Column:
        """A plain search in the lower-cased text spares the pattern where a name does not occur."""
        out = text
        for c, rep in renames:
            # A name that another renaming may bring in is always looked for.
            brought = not re.fullmatch(r"\w+", c) or any(c.lower() in r.lower() for k, r in renames if k != c)
            out = change(c, rep)(out) if brought else X.once(out, change(c, rep, low))
        return out
    return X.once(F.lower(text), renamed) if renames else text


def _norm(c: Column) -> Column:
    # Single blanks stay as they are: most texts need no copy.
    return F.lower(F.trim(F.regexp_replace(c, r"\s{2,}|[^\S ]", " ")))


_CLAUSES = ("select", "from", "where", "group", "having", "order")


def with_units(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Append ``out_col``: a struct of the clause units of ``text_col``
    (values replaced by slots).

    Built in three projections (normalised text -> clause strings -> units)
    so every regular expression runs once per row: Catalyst keeps the
    projections apart instead of inlining the expensive expressions into
    every field that reads them."""
    keep = df.columns
    n = f"__{out_col}"
    outer = X.outer_text(X.replace_literals(F.col(text_col)))
    s1 = df.withColumn(f"{n}_outer", outer).withColumn(f"{n}_op", X.set_op(F.col(f"{n}_outer")))
    single = F.col(f"{n}_op") == ""  # nothing to cut: no further pass over the text
    s1 = s1.withColumn(f"{n}_main", F.when(single, F.col(f"{n}_outer")).otherwise(X.main_query(F.col(f"{n}_outer"))))
    m, low = F.col(f"{n}_main"), F.col(f"{n}_low")
    s1 = s1.withColumn(f"{n}_low", F.lower(m))
    # A clause whose word the text lacks is not searched for.
    s2 = s1.select(*keep, *[F.when(~low.contains(c), "").otherwise(X.clause(m, c)).alias(f"{n}_{c}") for c in _CLAUSES if c != "select"],
                   F.regexp_replace(X.clause(m, "select"), r"(?i)^distinct\s+", "").alias(f"{n}_select"),
                   f"{n}_op", F.when(single, "").otherwise(
                       F.regexp_extract(F.col(f"{n}_outer"), r"(?is)\s(?:union|intersect|except)\s+(.*)$", 1)).alias(f"{n}_tail"),
                   F.when(~low.contains("limit"), 0).otherwise(X.has_limit(m)).alias(f"{n}_limit"))
    c = lambda k: F.col(f"{n}_{k}")
    s3 = s2.select(*keep, *[c(k) for k in ("from", "where", "group", "having", "order", "op", "tail", "limit")],
                   F.transform(X.split_items(c("select")), _norm).alias(f"{n}_sel"),
                   F.transform(X.split_conditions(c("where")), _norm).alias(f"{n}_conds"))
    whr, order, op = c("where"), c("order"), c("op")
    has = lambda w, found: F.lower(whr).contains(w) & found
    n_not = X.count(whr, X.word("not")) - X.count(whr, r"(?i)\bis\s+not\b")
    kw = F.array_compact(F.array(
        F.when(X.present(whr) == 1, F.lit("where")), F.when(X.present(c("group")) == 1, F.lit("group")),
        F.when(X.present(c("having")) == 1, F.lit("having")), F.when(X.present(order) == 1, F.lit("order")),
        F.when(X.present(order) == 1, F.when(order.rlike(r"(?i)\bdesc\b"), F.lit("desc")).otherwise(F.lit("asc"))),
        F.when(c("limit") == 1, F.lit("limit")), F.when(op != "", op),
        F.when(X.count(whr, X.word("or")) > 0, F.lit("or")), F.when(has("not", n_not > 0), F.lit("not")),
        F.when(has("(", X.count(whr, r"(?i)\bin\s*\(") > 0), F.lit("in")), F.when(has("like", X.count(whr, X.word("like")) > 0), F.lit("like"))))
    units = F.struct(
        F.array_sort(c("sel")).alias("select"),
        F.array_sort(F.transform(c("sel"), lambda x: F.regexp_replace(x, _AGG_WRAP, "$1"))).alias("select_no_agg"),
        F.array_sort(c("conds")).alias("where"),
        F.array_sort(F.transform(c("conds"), lambda x: F.regexp_extract(x, r"^(\S+)", 1))).alias("where_no_op"),
        F.array_sort(F.transform(X.split_items(c("group")), _norm)).alias("group_cols"),
        F.array_sort(F.transform(X.split_conditions(c("having")), _norm)).alias("having"),
        F.transform(X.split_items(order), _norm).alias("order_items"),
        c("limit").alias("has_limit"),
        X.connectors(whr).alias("and_or"),
        op.alias("set_op"), _norm(c("tail")).alias("set_tail"),
        F.array_sort(kw).alias("keywords"),
        F.array_sort(F.transform(F.regexp_extract_all(F.concat(F.lit("from "), c("from")),
                                                      F.lit(r"(?i)(?:from|join)\s+(\w+)"), 1), F.lower)).alias("tables"))
    return s3.select(*keep, units.alias(out_col))


def _score(label_total: Column, pred_total: Column, equal: Column) -> Column:
    return F.struct(label_total.cast("int").alias("label_total"), pred_total.cast("int").alias("pred_total"),
                    F.when((label_total == pred_total) & equal, 1).otherwise(0).alias("score"))


def _components(gold: str, pred: str) -> dict[str, Column]:
    """(label_total, pred_total, score) of every component of a row."""
    g, p = F.col(gold), F.col(pred)
    has_g, has_p = F.size(g["group_cols"]) > 0, F.size(p["group_cols"]) > 0
    has_og, has_op = F.size(g["order_items"]) > 0, F.size(p["order_items"]) > 0
    ao_eq = g["and_or"] == p["and_or"]
    iuen_g, iuen_p = (g["set_op"] != "").cast("int"), (p["set_op"] != "").cast("int")
    return {
        "select": _score(F.size(g["select"]), F.size(p["select"]), g["select"] == p["select"]),
        "select_no_agg": _score(F.size(g["select"]), F.size(p["select"]), g["select_no_agg"] == p["select_no_agg"]),
        "where": _score(F.size(g["where"]), F.size(p["where"]), g["where"] == p["where"]),
        "where_no_op": _score(F.size(g["where"]), F.size(p["where"]), g["where_no_op"] == p["where_no_op"]),
        "group_no_having": _score(F.size(g["group_cols"]), F.size(p["group_cols"]), g["group_cols"] == p["group_cols"]),
        "group": _score(has_g.cast("int"), has_p.cast("int"),
                        ~has_g | ((g["group_cols"] == p["group_cols"]) & (g["having"] == p["having"]))),
        "order": _score(has_og.cast("int"), has_op.cast("int"),
                        ~has_og | ((g["order_items"] == p["order_items"]) & (g["has_limit"] == p["has_limit"]))),
        "and_or": F.struct(F.when(ao_eq, 1).otherwise(F.size(g["and_or"])).alias("label_total"),
                           F.when(ao_eq, 1).otherwise(F.size(p["and_or"])).alias("pred_total"),
                           F.when(ao_eq, 1).otherwise(0).alias("score")),
        "iuen": _score(iuen_g, iuen_p, (g["set_op"] == p["set_op"]) & (g["set_tail"] == p["set_tail"])),
        "keywords": _score(F.size(g["keywords"]), F.size(p["keywords"]), g["keywords"] == p["keywords"]),
    }

def component_scores(df: DataFrame, keys: Sequence[str], gold: str = "g", pred: str = "p") -> DataFrame:
    """Long form (keys, component, label_total, pred_total, score) (E-13)."""
    arr = F.array(*[F.struct(F.lit(k).alias("component"), v.alias("s")) for k, v in _components(gold, pred).items()])
    return df.select(*keys, F.explode(arr).alias("x")).select(
        *keys, F.col("x.component").alias("component"), F.col("x.s.label_total").alias("label_total"),
        F.col("x.s.pred_total").alias("pred_total"), F.col("x.s.score").alias("score"))


def exact(gold: str = "g", pred: str = "p") -> Column:
    """E-14: 1 if every component scores 1 and the sorted tables agree; a
    condition on one row, so it costs no shuffle."""
    ok = F.col(f"{gold}.tables") == F.col(f"{pred}.tables")
    for c in _components(gold, pred).values():
        ok = ok & (c["score"] == 1)
    return ok.cast("int")


# ------------------------------------------------------------ E-15 rollups

def partial_rollup(scores: DataFrame, level_col: str) -> DataFrame:
    """Per level and overall ('all'): acc averaged over pred_total > 0, rec
    over label_total > 0, F1 from the averages (1 when both are 0)."""
    acc = F.avg(F.when(F.col("pred_total") > 0, F.col("score")))
    rec = F.avg(F.when(F.col("label_total") > 0, F.col("score")))
    both = scores.withColumn("level", F.explode(F.array(F.col(level_col), F.lit("all"))))
    out = both.groupBy("level", "component").agg(acc.alias("acc"), rec.alias("rec")).fillna(0.0, subset=["acc", "rec"])
    f1 = F.when((F.col("acc") == 0) & (F.col("rec") == 0), F.lit(1.0)).otherwise(
        2.0 * F.col("acc") * F.col("rec") / (F.col("acc") + F.col("rec")))
    return out.withColumn("f1", f1)


def exact_rollup(per_query: DataFrame, level_col: str, flags: Sequence[str]) -> DataFrame:
    """Count and mean of 0/1 flags per level plus 'all' (grouping sets)."""
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(F.col(f).cast("double")).alias(f) for f in flags]
    r = per_query.rollup(level_col).agg(*aggs)
    return r.withColumn("level", F.coalesce(F.col(level_col), F.lit("all"))).drop(level_col)


# ------------------------------------------------------------ E-16 turns

def turn_accuracy(turns: DataFrame, session_col: str, turn_col: str, flags: Sequence[str], max_turn: int = 4) -> DataFrame:
    """Accuracy per turn (1..max_turn, then '>max_turn') and joint accuracy
    (every turn of a session right; a bool_and per session)."""
    bucket = F.when(F.col(turn_col) <= max_turn, F.concat(F.lit("turn "), F.col(turn_col).cast("string"))
                    ).otherwise(F.lit(f"turn > {max_turn}"))
    per_turn = turns.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    sessions = turns.groupBy(session_col).agg(*[F.bool_and(F.col(f)).alias(f) for f in flags])
    joint = sessions.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in flags])
    return per_turn.unionByName(joint.withColumn("bucket", F.lit("joint_all")))


# -------------------------------------------------- E-17 .. E-20 iterations

def success_by_iteration(df: DataFrame, db_col: str, iter_col: str, flag_col: str, offset: int = 2) -> DataFrame:
    """Successful conversions per (db, iteration) and per iteration overall
    (db = 'all'); iterations are stored with an offset (E-17)."""
    both = df.select(F.explode(F.array(F.col(db_col), F.lit("all"))).alias(db_col),
                     (F.col(iter_col) - offset).alias("iteration"), flag_col)
    # Counted, not filtered first: a filter would be pushed into the flag's own projections and run them again.
    return both.groupBy(db_col, "iteration").agg(F.count_if(F.col(flag_col)).alias("n_success")).filter("n_success > 0")


def rate_by_level(df: DataFrame, level_col: str, flag_col: str) -> DataFrame:
    """Success rate per level plus the total row (E-18)."""
    r = df.rollup(level_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag_col)).alias("n_success"))
    return (r.withColumn("level", F.coalesce(F.col(level_col), F.lit("total"))).drop(level_col)
            .withColumn("rate", F.col("n_success") / F.col("n")))


def pct2(n: Column, total: Column) -> Column:
    """100 * n / total rounded half-up to 2 decimals with integer arithmetic."""
    return F.floor((n * 20000 + total) / (2 * total)) / 100.0


def summary_rows(df: DataFrame, flag_col: str) -> DataFrame:
    """Success and failure percentages, 2 decimals (E-19)."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag_col)).alias("ok"))
    return s.select(F.col("n"), F.col("ok").alias("n_success"), (F.col("n") - F.col("ok")).alias("n_failed"),
                    pct2(F.col("ok"), F.col("n")).alias("success_pct"),
                    pct2(F.col("n") - F.col("ok"), F.col("n")).alias("fail_pct"))


def cumulative_success(df: DataFrame, level_col: str, iter_col: str, flag_col: str) -> DataFrame:
    """Cumulative successes by iteration, overall ('all') and per level, and
    normalised by the level size (E-20).  The window runs over the small
    aggregated (level, iteration) table, not the raw rows."""
    both = df.select(F.explode(F.array(F.col(level_col), F.lit("all"))).alias(level_col), iter_col, flag_col)
    per = both.groupBy(level_col, iter_col).agg(F.count_if(F.col(flag_col)).alias("n_success"), F.count("*").alias("__n"))
    per = per.withColumn("level_size", F.sum("__n").over(Window.partitionBy(level_col))).drop("__n")
    w = Window.partitionBy(level_col).orderBy(iter_col).rowsBetween(Window.unboundedPreceding, 0)
    return (per.withColumn("cum_success", F.sum("n_success").over(w))
            .withColumn("cum_rate", F.col("cum_success") / F.col("level_size")))


# --------------------------------------------------- E-22 / E-23 failures

def common_failures(failures: DataFrame, keys: Sequence[str], model_col: str, n_models: int | Column) -> DataFrame:
    """Failures shared by every model (E-22): count_distinct(model) = n."""
    n = F.lit(n_models) if isinstance(n_models, int) else n_models
    return (failures.groupBy(*keys).agg(F.count_distinct(model_col).alias("n_models"))
            .filter(F.col("n_models") == n).drop("n_models"))


def unique_failures(failures: DataFrame, common: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Failures of each model outside the common set (E-23)."""
    return failures.join(common, list(keys), "left_anti")
