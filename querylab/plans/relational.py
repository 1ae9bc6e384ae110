"""Relational query surface
over the driver tables, each with its DuckDB oracle.

Conventions that keep Spark and the oracle bit-identical:
* sums/averages of money columns go through DECIMAL (querylab.functions.exact);
* every LIMIT follows a total order (ties broken by key);
* no rand(); integer outputs are BIGINT on both sides where types differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.functions.exact import dec, dsum, davg, dround, sql_dsum, sql_davg, sql_dround
from querylab.operators import relational as R
from querylab.plans.registry import query
from querylab.tables import Tables


def _ts(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _revenue():
    return dec("l_extendedprice") * (F.lit(1) - dec("l_discount"))


_SQL_REVENUE = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))"

# ------------------------------------------------------------------ flagship

FLAGSHIP_SQL = f"""
SELECT r_name, n_name,
       CAST(SUM({_SQL_REVENUE}) AS DOUBLE) AS revenue,
       COUNT(*) AS n_lines,
       COUNT(DISTINCT o_orderkey) AS n_orders
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity >= 5
GROUP BY r_name, n_name
HAVING COUNT(*) > 10
ORDER BY revenue DESC, n_name
LIMIT 10
"""


@query("R0_revenue_by_nation_top10", FLAGSHIP_SQL, ids=("S-1", "J-2", "F-1", "A-4", "A-6", "O-8"))
def flagship(t: Tables) -> DataFrame:
    """Revenue per (region, nation) over the five-table FK chain, HAVING and top 10."""
    li = t.lineitem.filter((F.col("l_shipdate") >= _ts("1996-01-01")) & (F.col("l_quantity") >= 5))
    j = (li.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
         .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    agg = (j.groupBy("r_name", "n_name")
           .agg(F.sum(_revenue()).cast("double").alias("revenue"),
                F.count(F.lit(1)).alias("n_lines"),
                F.count_distinct("o_orderkey").alias("n_orders"))
           .filter(F.col("n_lines") > 10))
    return R.top_k(agg, 10, F.col("revenue").desc(), F.col("n_name"))


# ------------------------------------------------------------------ scans (S)

@query("S1_typed_scan", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem WHERE l_quantity > 45
""", ids=("S-1",))
def s1(t: Tables) -> DataFrame:
    li = t.lineitem
    nums = R.attributes_by_type(li)[R.NUMBER]
    return li.filter(F.col("l_quantity") > 45).select(*nums)


@query("S2_aliased_scan", """
SELECT a.n_nationkey AS a_n_nationkey, a.n_name AS a_n_name
FROM nation AS a WHERE a.n_regionkey = 1
""", ids=("S-2",))
def s2(t: Tables) -> DataFrame:
    a = t.nation.alias("a")
    return a.filter(F.col("a.n_regionkey") == 1).select(
        F.col("a.n_nationkey").alias("a_n_nationkey"), F.col("a.n_name").alias("a_n_name"))


# ------------------------------------------------------------ projections (P)

@query("P1_select_star", "SELECT * FROM region", ids=("P-1",))
def p1(t: Tables) -> DataFrame:
    return t.region.select("*")


@query("P2_typed_columns", "SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate FROM orders",
       ids=("P-2",))
def p2(t: Tables) -> DataFrame:
    o = t.orders
    a = R.attributes_by_type(o)
    return o.select(a[R.NUMBER][0], a[R.NUMBER][2], a[R.TEXT][0], a[R.TIME][0])


@query("P3_column_alias", "SELECT c_custkey AS c_custkey_x, c_name AS c_name_x, c_acctbal AS c_acctbal_x FROM customer",
       ids=("P-3",))
def p3(t: Tables) -> DataFrame:
    return t.customer.select(*[F.col(c).alias(f"{c}_x") for c in ("c_custkey", "c_name", "c_acctbal")])


@query("P4_arithmetic", """
SELECT l_orderkey, l_linenumber,
       l_extendedprice + l_tax AS a_add,
       l_extendedprice - l_quantity AS a_sub,
       l_quantity * l_discount AS a_mul,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / l_discount END AS a_div,
       CAST(l_linenumber // 2 AS BIGINT) AS a_idiv
FROM lineitem
""", ids=("P-4",))
def p4(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        (c("l_extendedprice") + c("l_tax")).alias("a_add"),
        (c("l_extendedprice") - c("l_quantity")).alias("a_sub"),
        (c("l_quantity") * c("l_discount")).alias("a_mul"),
        F.try_divide(c("l_extendedprice"), c("l_discount")).alias("a_div"),
        F.expr("l_linenumber div 2").cast("bigint").alias("a_idiv"))


@query("P5_nested_arithmetic", """
SELECT l_orderkey, l_linenumber,
       ((l_extendedprice - l_quantity) * (1 + l_tax)) / 2 AS v1,
       (l_quantity + 10) * (l_discount - (l_tax + 1)) AS v2
FROM lineitem
""", ids=("P-5",))
def p5(t: Tables) -> DataFrame:
    c = F.col
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        (((c("l_extendedprice") - c("l_quantity")) * (F.lit(1) + c("l_tax"))) / 2).alias("v1"),
        ((c("l_quantity") + 10) * (c("l_discount") - (c("l_tax") + 1))).alias("v2"))


@query("P6_math_functions", f"""
SELECT c_custkey,
       ABS(c_acctbal) AS m_abs,
       {sql_dround('c_acctbal', 1)} AS m_round1,
       CAST(SIGN(c_acctbal) AS DOUBLE) AS m_sign,
       CAST(CEIL(c_acctbal) AS BIGINT) AS m_ceil,
       CAST(FLOOR(c_acctbal) AS BIGINT) AS m_floor,
       ROUND(SQRT(ABS(c_acctbal)), 6) AS m_sqrt,
       ROUND(LN(ABS(c_acctbal) + 1), 6) AS m_ln,
       ROUND(LOG10(ABS(c_acctbal) + 1), 6) AS m_log10,
       ROUND(POWER(c_acctbal / 1000, 2), 6) AS m_pow,
       ROUND(EXP(c_acctbal / 10000), 6) AS m_exp
FROM customer
""", ids=("P-6",))
def p6(t: Tables) -> DataFrame:
    c = F.col("c_acctbal")
    return t.customer.select(
        "c_custkey",
        F.abs(c).alias("m_abs"),
        dround(c, 1).alias("m_round1"),
        F.signum(c).alias("m_sign"),
        F.ceil(c).cast("bigint").alias("m_ceil"),
        F.floor(c).cast("bigint").alias("m_floor"),
        F.round(F.sqrt(F.abs(c)), 6).alias("m_sqrt"),
        F.round(F.log(F.abs(c) + 1), 6).alias("m_ln"),
        F.round(F.log10(F.abs(c) + 1), 6).alias("m_log10"),
        F.round(F.pow(c / 1000, 2), 6).alias("m_pow"),
        F.round(F.exp(c / 10000), 6).alias("m_exp"))


@query("P7_string_functions", """
SELECT p_partkey,
       UPPER(p_name) AS s_upper, LOWER(p_type) AS s_lower,
       CAST(LENGTH(p_name) AS BIGINT) AS s_len,
       SUBSTRING(p_name, 1, 3) AS s_sub,
       REPLACE(p_name, 'a', 'b') AS s_replace,
       CAST(INSTR(p_name, 'a') AS BIGINT) AS s_charindex,
       CONCAT(p_name, 'a') AS s_concat,
       TRIM(CONCAT('  ', p_brand, ' ')) AS s_trim,
       LEFT(p_name, 3) AS s_left, RIGHT(p_name, 3) AS s_right
FROM part
""", ids=("P-7",))
def p7(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.select(
        "p_partkey",
        F.upper(n).alias("s_upper"), F.lower("p_type").alias("s_lower"),
        F.length(n).cast("bigint").alias("s_len"),
        F.substring(n, 1, 3).alias("s_sub"),
        F.replace(n, F.lit("a"), F.lit("b")).alias("s_replace"),
        F.locate("a", n).cast("bigint").alias("s_charindex"),
        F.concat(n, F.lit("a")).alias("s_concat"),
        F.trim(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))).alias("s_trim"),
        F.left(n, F.lit(3)).alias("s_left"), F.right(n, F.lit(3)).alias("s_right"))


@query("P8_functions_in_clauses", """
SELECT UPPER(p_type) AS t_upper, COUNT(*) AS n, CAST(MAX(LENGTH(p_name)) AS BIGINT) AS max_len
FROM part
WHERE ABS(p_size - 25) < 10 AND LOWER(p_brand) LIKE 'brand#1%'
GROUP BY UPPER(p_type)
""", ids=("P-8",))
def p8(t: Tables) -> DataFrame:
    return (t.part.filter((F.abs(F.col("p_size") - 25) < 10) & F.lower("p_brand").like("brand#1%"))
            .groupBy(F.upper("p_type").alias("t_upper"))
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.length("p_name")).cast("bigint").alias("max_len")))


@query("P9_aggregate_exprs", f"""
SELECT MAX(o_totalprice) AS max_price, MIN(o_totalprice) AS min_price,
       {sql_davg('o_totalprice')} AS avg_price, {sql_dsum('o_totalprice')} AS sum_price,
       COUNT(o_totalprice) AS cnt_price
FROM orders
""", ids=("P-9",))
def p9(t: Tables) -> DataFrame:
    return t.orders.agg(F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"),
                        davg("o_totalprice").alias("avg_price"), dsum("o_totalprice").alias("sum_price"),
                        F.count("o_totalprice").alias("cnt_price"))


@query("P10_count_distinct", """
SELECT COUNT(DISTINCT o_custkey) AS n_cust, COUNT(DISTINCT o_orderstatus) AS n_status FROM orders
""", ids=("P-10",))
def p10(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_distinct("o_custkey").alias("n_cust"),
                        F.count_distinct("o_orderstatus").alias("n_status"))


@query("P11_select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ids=("P-11",))
def p11(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("P12_scalar_subquery_select", """
SELECT n.n_nationkey, n.n_name,
       (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS n_customers,
       (SELECT MAX(o_totalprice) FROM orders) AS max_price
FROM nation n
""", ids=("P-12",))
def p12(t: Tables) -> DataFrame:
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("cnt"))
    max_price = t.orders.agg(F.max("o_totalprice")).scalar()
    return (t.nation.join(per_nation, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .select("n_nationkey", "n_name", F.coalesce("cnt", F.lit(0)).alias("n_customers"),
                    max_price.alias("max_price")))


@query("P13_cast_text_to_number", """
SELECT p_partkey, TRY_CAST(SUBSTRING(p_brand, 7) AS BIGINT) AS brand_no,
       TRY_CAST(p_type AS BIGINT) AS type_no
FROM part
""", ids=("P-13",))
def p13(t: Tables) -> DataFrame:
    return t.part.select("p_partkey",
                         F.substring("p_brand", 7, 1 << 20).try_cast("bigint").alias("brand_no"),
                         F.col("p_type").try_cast("bigint").alias("type_no"))


@query("P14_case_when", """
SELECT o_orderkey,
       CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders
""", ids=("P-14",))
def p14(t: Tables) -> DataFrame:
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 300000, "high").when(p > 100000, "mid")
                           .otherwise("low").alias("band"))


@query("P15_text_chains", """
SELECT p_partkey,
       TRY_CAST(SUBSTRING(p_brand, INSTR(p_brand, '#') + 1) AS BIGINT) AS brand_after_hash,
       TRIM(CONCAT(' ', p_type, ' ')) AS type_trim,
       TRY_CAST(REPLACE(p_brand, 'Brand#', '') AS BIGINT) AS brand_replaced
FROM part
""", ids=("P-15",))
def p15(t: Tables) -> DataFrame:
    b = F.col("p_brand")
    return t.part.select(
        "p_partkey",
        F.expr("try_cast(substring(p_brand, instr(p_brand, '#') + 1) AS BIGINT)").alias("brand_after_hash"),
        F.trim(F.concat(F.lit(" "), F.col("p_type"), F.lit(" "))).alias("type_trim"),
        F.replace(b, F.lit("Brand#"), F.lit("")).try_cast("bigint").alias("brand_replaced"))


AS_OF = "2001-12-31"


@query("P16_pinned_current_year", f"""
SELECT o_orderkey, CAST(YEAR(DATE '{AS_OF}') - YEAR(o_orderdate) AS BIGINT) AS age_years
FROM orders WHERE YEAR(o_orderdate) >= YEAR(DATE '{AS_OF}') - 2
""", ids=("P-16",))
def p16(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """'Current year' is a parameter, never current_date(), so reruns agree."""
    y = F.year(F.lit(as_of).cast("date"))
    return (t.orders.filter(F.year("o_orderdate") >= y - 2)
            .select("o_orderkey", (y - F.year("o_orderdate")).cast("bigint").alias("age_years")))


# --------------------------------------------------------------- filters (F)

@query("F1_comparison_filter", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 48
""", ids=("F-1",))
def f1(t: Tables) -> DataFrame:
    return t.lineitem.filter(R.compare(F.col("l_quantity"), ">=", 48)).select("l_orderkey", "l_linenumber", "l_quantity")


_F1_OPS = [("=", "n_eq"), ("!=", "n_ne"), ("<>", "n_ltgt"), (">", "n_gt"), ("<", "n_lt"), (">=", "n_ge"), ("<=", "n_le")]


@query("F1_comparison_ops", "SELECT " + ", ".join(
    f"COUNT_IF(l_quantity {op} 25) AS {name}" for op, name in _F1_OPS) + " FROM lineitem", ids=("F-1",))
def f1_ops(t: Tables) -> DataFrame:
    """All comparison operators in one scan (conditional counts)."""
    return t.lineitem.agg(*[F.count_if(R.compare(F.col("l_quantity"), op, 25)).alias(n) for op, n in _F1_OPS])


@query("F2_between", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_quantity BETWEEN 1 AND 10 AND l_discount NOT BETWEEN 0.02 AND 0.08
""", ids=("F-2",))
def f2(t: Tables) -> DataFrame:
    return (t.lineitem.filter(F.col("l_quantity").between(1, 10) & ~F.col("l_discount").between(0.02, 0.08))
            .select("l_orderkey", "l_linenumber"))


@query("F3_in_list", """
SELECT p_partkey, p_size, p_type FROM part WHERE p_size IN (1, 5, 10, 20) AND p_type IN ('SMALL', 'LARGE')
""", ids=("F-3",))
def f3(t: Tables) -> DataFrame:
    return (t.part.filter(F.col("p_size").isin(1, 5, 10, 20) & F.col("p_type").isin("SMALL", "LARGE"))
            .select("p_partkey", "p_size", "p_type"))


@query("F4_not_in_list", """
SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')
""", ids=("F-4",))
def f4(t: Tables) -> DataFrame:
    return (t.part.filter(~F.col("p_size").isin(1, 2, 3) & ~F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"))
            .select("p_partkey"))


@query("F5_like", """
SELECT p_partkey, p_name FROM part
WHERE (p_name LIKE '%bolt' AND p_name NOT LIKE 'red%') OR p_name ILIKE 'BLUE G%'
""", ids=("F-5",))
def f5(t: Tables) -> DataFrame:
    n = F.col("p_name")
    return t.part.filter((n.like("%bolt") & ~n.like("red%")) | n.ilike("BLUE G%")).select("p_partkey", "p_name")


def _pattern_counts(df: DataFrame, textcol: str) -> DataFrame:
    c = F.col(textcol)
    wide = df.agg(*[F.count_if(R.named_pattern(c, k)).alias(k) for k in R.LIKE_CRITERIA])
    stack = ", ".join(f"'{k}', `{k}`" for k in R.LIKE_CRITERIA)
    return wide.selectExpr(f"stack({len(R.LIKE_CRITERIA)}, {stack}) AS (criteria, n)")


def _pattern_counts_sql(table: str, textcol: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{k}' AS criteria, COUNT_IF({R.named_pattern_sql(textcol, k)}) AS n FROM {table}"
        for k in R.LIKE_CRITERIA)


@query("F6_named_patterns_part", _pattern_counts_sql("part", "p_name"), ids=("F-6",))
def f6_part(t: Tables) -> DataFrame:
    return _pattern_counts(t.part, "p_name")


@query("F6_named_patterns_documents", _pattern_counts_sql("documents", "text"), ids=("F-6",))
def f6_docs(t: Tables) -> DataFrame:
    return _pattern_counts(t.documents, "text")


@query("F7_null_checks", """
SELECT c_mktsegment,
       COUNT_IF(o_orderkey IS NULL) AS n_without, COUNT_IF(o_orderkey IS NOT NULL) AS n_with
FROM customer LEFT JOIN orders ON c_custkey = o_custkey
GROUP BY c_mktsegment
""", ids=("F-7",))
def f7(t: Tables) -> DataFrame:
    j = t.customer.join(t.orders.select("o_orderkey", "o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.count_if(F.col("o_orderkey").isNull()).alias("n_without"),
                                         F.count_if(F.col("o_orderkey").isNotNull()).alias("n_with"))


@query("F8_and_or_with_subquery", """
SELECT o_orderkey FROM orders
WHERE (o_totalprice > 450000 AND o_orderstatus = 'F')
   OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)
""", ids=("F-8", "J-11"))
def f8(t: Tables) -> DataFrame:
    sub = t.customer.filter(F.col("c_acctbal") > 9900).select("c_custkey")
    o = t.orders
    # IN-subquery inside OR: Catalyst plans an ExistenceJoin (no row duplication).
    return o.filter(((F.col("o_totalprice") > 450000) & (F.col("o_orderstatus") == "F"))
                    | F.col("o_custkey").isin(sub)).select("o_orderkey")


@query("F9_boolean_groups", """
SELECT o_orderkey FROM orders
WHERE NOT ((o_orderstatus = 'O' OR o_orderpriority = '5-LOW')
           AND (o_totalprice < 200000 OR NOT (o_custkey > 700)))
  AND (o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_totalprice BETWEEN 100000 AND 150000)
""", ids=("F-9",))
def f9(t: Tables) -> DataFrame:
    c = F.col
    p = ~(((c("o_orderstatus") == "O") | (c("o_orderpriority") == "5-LOW"))
          & ((c("o_totalprice") < 200000) | ~(c("o_custkey") > 700)))
    q = c("o_orderpriority").isin("1-URGENT", "2-HIGH") | c("o_totalprice").between(100000, 150000)
    return t.orders.filter(p & q).select("o_orderkey")


@query("F10_column_vs_column", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE l_tax > l_discount AND l_quantity < l_linenumber * 5
""", ids=("F-10",))
def f10(t: Tables) -> DataFrame:
    c = F.col
    return (t.lineitem.filter((c("l_tax") > c("l_discount")) & (c("l_quantity") < c("l_linenumber") * 5))
            .select("l_orderkey", "l_linenumber"))


@query("F11_text_and_date_ranges", """
SELECT o_orderkey FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'
  AND o_orderpriority > '2' AND o_orderpriority <= '4-NOT SPECIFIED'
""", ids=("F-11",))
def f11(t: Tables) -> DataFrame:
    c = F.col
    return (t.orders.filter((c("o_orderdate") >= _ts("1997-01-01")) & (c("o_orderdate") < _ts("1997-04-01"))
                            & (c("o_orderpriority") > "2") & (c("o_orderpriority") <= "4-NOT SPECIFIED"))
            .select("o_orderkey"))


@query("F12_extra_correlated_conjunct", """
SELECT c_custkey FROM customer c
WHERE c_acctbal > 5000
  AND EXISTS (SELECT * FROM orders o WHERE o.o_totalprice > 450000 AND o.o_custkey = c.c_custkey)
""", ids=("F-12", "Q-4"))
def f12(t: Tables) -> DataFrame:
    child = t.orders.filter(F.col("o_totalprice") > 450000)
    base = t.customer.filter(F.col("c_acctbal") > 5000)
    return R.exists(base, child, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


# ------------------------------------------------------------------ joins (J)

@query("J1_fk_join", f"""
SELECT c_mktsegment, o_orderstatus, COUNT(*) AS n, {sql_dsum('o_totalprice')} AS total
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY c_mktsegment, o_orderstatus
""", ids=("J-1",))
def j1(t: Tables) -> DataFrame:
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_mktsegment", "o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n"), dsum("o_totalprice").alias("total")))


@query("J2_fk_chain_3", """
SELECT n_name, p_type, COUNT(*) AS n_lines
FROM lineitem JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
WHERE p_size > 40
GROUP BY n_name, p_type
""", ids=("J-2",))
def j2(t: Tables) -> DataFrame:
    return (t.lineitem.join(t.part.filter(F.col("p_size") > 40), F.col("l_partkey") == F.col("p_partkey"))
            .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name", "p_type").agg(F.count(F.lit(1)).alias("n_lines")))


@query("J3_multi_edge_join", f"""
SELECT n_name, COUNT(*) AS n_local_lines, CAST(SUM({_SQL_REVENUE}) AS DOUBLE) AS local_revenue
FROM customer
JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey
GROUP BY n_name
""", ids=("J-3",))
def j3(t: Tables) -> DataFrame:
    """All FK edges among the chosen tables are ANDed: the supplier join
    carries two equalities (one from the chain, one closing the cycle)."""
    j = (t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"))
         .join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
         .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_local_lines"),
                                   F.sum(_revenue()).cast("double").alias("local_revenue"))


@query("J4_self_join_on_key", """
SELECT a.c_custkey AS a_key, b.c_custkey AS b_key, b.c_acctbal - a.c_acctbal AS delta
FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1
WHERE a.c_nationkey = b.c_nationkey
""", ids=("J-4",))
def j4(t: Tables) -> DataFrame:
    a, b = t.customer.alias("a"), t.customer.alias("b")
    return (a.join(b, (F.col("b.c_custkey") == F.col("a.c_custkey") + 1)
                   & (F.col("a.c_nationkey") == F.col("b.c_nationkey")))
            .select(F.col("a.c_custkey").alias("a_key"), F.col("b.c_custkey").alias("b_key"),
                    (F.col("b.c_acctbal") - F.col("a.c_acctbal")).alias("delta")))


@query("J5_fk_plus_self_join", """
SELECT o1.o_orderkey AS first_key, o2.o_orderkey AS next_key, c.c_name
FROM orders o1
JOIN orders o2 ON o2.o_orderkey = o1.o_orderkey + 1
JOIN customer c ON o1.o_custkey = c.c_custkey
WHERE o2.o_custkey = o1.o_custkey OR o2.o_orderstatus = o1.o_orderstatus
""", ids=("J-5",))
def j5(t: Tables) -> DataFrame:
    o1, o2, c = t.orders.alias("o1"), t.orders.alias("o2"), t.customer.alias("c")
    return (o1.join(o2, F.col("o2.o_orderkey") == F.col("o1.o_orderkey") + 1)
            .join(c, F.col("o1.o_custkey") == F.col("c.c_custkey"))
            .filter((F.col("o2.o_custkey") == F.col("o1.o_custkey"))
                    | (F.col("o2.o_orderstatus") == F.col("o1.o_orderstatus")))
            .select(F.col("o1.o_orderkey").alias("first_key"), F.col("o2.o_orderkey").alias("next_key"),
                    F.col("c.c_name")))


@query("J6_non_fk_equi_join", """
SELECT n_name, COUNT(*) AS n_parts
FROM part JOIN nation ON p_size = n_nationkey
GROUP BY n_name
""", ids=("J-6",))
def j6(t: Tables) -> DataFrame:
    part = t.part.select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"))
    nation = t.nation.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    return (R.skew_join(part, nation, "p_size", "n_nationkey", ["p_partkey"])
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("n_parts")))


_J7_ORDERS = "orders"
_J7_CUST = "customer"


def _j7_sides(t: Tables):
    return t.customer.select("c_custkey", "c_mktsegment"), t.orders.select("o_orderkey", "o_custkey")


@query("J7_left_join", f"""
SELECT c_custkey, o_orderkey FROM {_J7_CUST} LEFT JOIN {_J7_ORDERS} ON c_custkey = o_custkey
""", ids=("J-7",))
def j7_left(t: Tables) -> DataFrame:
    c, o = _j7_sides(t)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("J7_right_join", f"""
SELECT c_custkey, o_orderkey FROM {_J7_CUST} RIGHT JOIN {_J7_ORDERS} ON c_custkey = o_custkey
""", ids=("J-7",))
def j7_right(t: Tables) -> DataFrame:
    c, o = _j7_sides(t)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("J7_full_outer_join", f"""
SELECT c_custkey, o_orderkey FROM {_J7_CUST} FULL OUTER JOIN {_J7_ORDERS} ON c_custkey = o_custkey
""", ids=("J-7",))
def j7_full(t: Tables) -> DataFrame:
    c, o = _j7_sides(t)
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("J8_band_join", """
SELECT n_name, COUNT(*) AS n_parts
FROM nation JOIN part ON p_size BETWEEN n_nationkey AND n_nationkey + 2
GROUP BY n_name
""", ids=("J-8",))
def j8(t: Tables) -> DataFrame:
    """Theta (band) join without a nested loop: each nation row expands its
    band into the integer keys it covers, then an equi join on that key."""
    bands = t.nation.select("n_name", F.explode(F.sequence(F.col("n_nationkey"), F.col("n_nationkey") + 2)).alias("band"))
    return (bands.join(t.part, F.col("p_size") == F.col("band"))
            .groupBy("n_name").agg(F.count(F.lit(1)).alias("n_parts")))


@query("J9_comma_join", """
SELECT c_mktsegment, COUNT(*) AS n FROM orders, customer
WHERE o_custkey = c_custkey AND o_orderstatus = 'P'
GROUP BY c_mktsegment
""", ids=("J-9",))
def j9(t: Tables) -> DataFrame:
    """Comma join + WHERE equality in SQL text: Catalyst turns it into an equi join."""
    spark = t.spark
    t.orders.createOrReplaceTempView("comma_orders")
    t.customer.createOrReplaceTempView("comma_customer")
    return spark.sql("""SELECT c_mktsegment, COUNT(*) AS n FROM comma_orders, comma_customer
                        WHERE o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_mktsegment""")


@query("J10_join_derived_top1", f"""
SELECT o.o_orderkey, o.o_totalprice
FROM orders o JOIN (
  SELECT o_custkey AS top_cust FROM orders GROUP BY o_custkey
  ORDER BY {sql_dsum('o_totalprice')} DESC, o_custkey LIMIT 1) t
ON o.o_custkey = t.top_cust
""", ids=("J-10",))
def j10(t: Tables) -> DataFrame:
    top = R.top_k(t.orders.groupBy("o_custkey").agg(dsum("o_totalprice").alias("spent")), 1,
                  F.col("spent").desc(), F.col("o_custkey")).select(F.col("o_custkey").alias("top_cust"))
    return t.orders.join(top, F.col("o_custkey") == F.col("top_cust")).select("o_orderkey", "o_totalprice")


@query("J11_semi_and_anti", """
SELECT 'semi' AS kind, COUNT(*) AS n FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL
SELECT 'anti' AS kind, COUNT(*) AS n FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""", ids=("J-11",))
def j11(t: Tables) -> DataFrame:
    _, o = _j7_sides(t)
    semi = R.in_subquery(t.customer, "c_custkey", o, "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    anti = R.not_exists(t.customer, o, F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return semi.select(F.lit("semi").alias("kind"), "n").unionByName(anti.select(F.lit("anti").alias("kind"), "n"))


# -------------------------------------------------------------- subqueries (Q)

@query("Q1_in_subquery", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)
""", ids=("Q-1",))
def q1(t: Tables) -> DataFrame:
    sub = t.orders.filter(F.col("o_totalprice") > 480000)
    return R.in_subquery(t.customer, "c_custkey", sub, "o_custkey").select("c_custkey", "c_name")


@query("Q1_in_subquery_limit", """
SELECT c_custkey FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)
""", ids=("Q-1",))
def q1_limit(t: Tables) -> DataFrame:
    sub = R.top_k(t.orders, 5, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return R.in_subquery(t.customer, "c_custkey", sub, "o_custkey").select("c_custkey")


@query("Q2_not_in_subquery", """
SELECT c_custkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01')
""", ids=("Q-2",))
def q2(t: Tables) -> DataFrame:
    sub = t.orders.filter(F.col("o_orderdate") >= _ts("1999-01-01"))
    return R.not_in_subquery(t.customer, "c_custkey", sub, "o_custkey").select("c_custkey")


@query("Q2_not_in_subquery_with_null", """
SELECT c_custkey FROM customer
WHERE c_custkey NOT IN (
  SELECT CASE WHEN o_orderkey % 1000 = 7 THEN NULL ELSE o_custkey END FROM orders
  WHERE o_orderdate >= TIMESTAMP '1999-01-01')
""", ids=("Q-2",))
def q2_null(t: Tables) -> DataFrame:
    """A NULL on the sub side makes every NOT IN unknown: no row survives."""
    sub = (t.orders.filter(F.col("o_orderdate") >= _ts("1999-01-01"))
           .select(F.when(F.col("o_orderkey") % 1000 == 7, F.lit(None)).otherwise(F.col("o_custkey")).alias("k")))
    return R.not_in_subquery(t.customer, "c_custkey", sub, "k").select("c_custkey")


@query("Q3_compare_to_aggregate", f"""
SELECT o_orderkey FROM orders
WHERE o_totalprice > (SELECT {sql_davg('o_totalprice')} * 1.8 FROM orders)
""", ids=("Q-3",))
def q3(t: Tables) -> DataFrame:
    avg = t.orders.agg(davg("o_totalprice") * 1.8).scalar()
    return t.orders.filter(F.col("o_totalprice") > avg).select("o_orderkey")


@query("Q3_compare_to_max", """
SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT MAX(s_acctbal) FROM supplier) - 100
""", ids=("Q-3",))
def q3_max(t: Tables) -> DataFrame:
    mx = t.supplier.agg(F.max("s_acctbal")).scalar()
    return t.customer.filter(F.col("c_acctbal") >= mx - 100).select("c_custkey")


@query("Q4_exists", """
SELECT c_custkey FROM customer c
WHERE EXISTS (SELECT * FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_custkey = c.c_custkey)
""", ids=("Q-4",))
def q4(t: Tables) -> DataFrame:
    child = t.orders.filter(F.col("o_orderstatus") == "P")
    return R.exists(t.customer, child, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("Q5_not_exists", """
SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT * FROM orders o WHERE o.o_orderstatus = 'P' AND o.o_custkey = c.c_custkey)
""", ids=("Q-5",))
def q5(t: Tables) -> DataFrame:
    child = t.orders.filter(F.col("o_orderstatus") == "P")
    return R.not_exists(t.customer, child, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("Q6_exists_derived_table", """
SELECT c_custkey FROM customer c
WHERE EXISTS (SELECT * FROM (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 13) d
              WHERE d.o_custkey = c.c_custkey)
""", ids=("Q-6",))
def q6(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 13)
    return R.exists(t.customer, d, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


@query("Q7_from_subquery", f"""
SELECT a.cust, a.total FROM (
  SELECT o_custkey AS cust, {sql_dsum('o_totalprice')} AS total FROM orders GROUP BY o_custkey) AS a
WHERE a.total > 3000000
""", ids=("Q-7",))
def q7(t: Tables) -> DataFrame:
    a = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(dsum("o_totalprice").alias("total")).alias("a")
    return a.filter(F.col("a.total") > 3000000).select("a.cust", "a.total")


@query("Q8_cte", f"""
WITH cte_1 AS (SELECT o_custkey, COUNT(*) AS n_orders, {sql_dsum('o_totalprice')} AS spent
               FROM orders GROUP BY o_custkey)
SELECT c_mktsegment, COUNT(*) AS n_customers, MAX(cte_1.n_orders) AS max_orders
FROM cte_1 JOIN customer ON cte_1.o_custkey = c_custkey
WHERE cte_1.spent > 2500000
GROUP BY c_mktsegment
""", ids=("Q-8",))
def q8(t: Tables) -> DataFrame:
    cte_1 = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), dsum("o_totalprice").alias("spent"))
    return (cte_1.filter(F.col("spent") > 2500000).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_customers"), F.max("n_orders").alias("max_orders")))


@query("Q9_having_subqueries", f"""
SELECT o_custkey, COUNT(*) AS n FROM orders
GROUP BY o_custkey
HAVING COUNT(*) > (SELECT COUNT(*) / COUNT(DISTINCT o_custkey) FROM orders) + 3
   AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""", ids=("Q-9",))
def q9(t: Tables) -> DataFrame:
    o = t.orders
    mean = o.agg(F.count(F.lit(1)) / F.count_distinct("o_custkey")).scalar()
    building = t.customer.filter(F.col("c_mktsegment") == "BUILDING")
    g = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > mean + 3)
    return R.in_subquery(g, "o_custkey", building, "c_custkey")


@query("Q10_two_level_nesting", f"""
SELECT c_custkey FROM customer
WHERE c_acctbal > (SELECT {sql_davg('c_acctbal')} FROM customer
                   WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000))
""", ids=("Q-10",))
def q10(t: Tables) -> DataFrame:
    inner = R.in_subquery(t.customer, "c_custkey", t.orders.filter(F.col("o_totalprice") > 450000), "o_custkey")
    thr = inner.agg(davg("c_acctbal")).scalar()
    return t.customer.filter(F.col("c_acctbal") > thr).select("c_custkey")


# ------------------------------------------------------------ aggregation (A)

@query("A1_global_aggregates", f"""
SELECT COUNT(*) AS n, {sql_dsum('l_quantity')} AS sum_qty, {sql_davg('l_extendedprice')} AS avg_price,
       MIN(l_shipdate) AS first_ship, MAX(l_shipdate) AS last_ship
FROM lineitem
""", ids=("A-1", "A-2"))
def a1(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), dsum("l_quantity").alias("sum_qty"),
                          davg("l_extendedprice").alias("avg_price"),
                          F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("A2_count_star", """
SELECT COUNT(*) AS n_all, COUNT_IF(l_returnflag = 'R') AS n_returned FROM lineitem
""", ids=("A-2",))
def a2(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count("*").alias("n_all"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))


@query("A3_multi_count_distinct", """
SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n_cust, COUNT(DISTINCT o_orderpriority) AS n_prio,
       COUNT(DISTINCT YEAR(o_orderdate)) AS n_years
FROM orders GROUP BY o_orderstatus
""", ids=("A-3",))
def a3(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(
        F.count_distinct("o_custkey").alias("n_cust"), F.count_distinct("o_orderpriority").alias("n_prio"),
        F.count_distinct(F.year("o_orderdate")).alias("n_years"))


@query("A4_group_by_one", f"""
SELECT o_orderpriority, COUNT(*) AS n, {sql_dsum('o_totalprice')} AS total FROM orders GROUP BY o_orderpriority
""", ids=("A-4",))
def a4(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), dsum("o_totalprice").alias("total"))


@query("A5_group_by_two", f"""
SELECT l_returnflag, l_linestatus, {sql_dsum('l_quantity')} AS sum_qty,
       {sql_dsum('l_extendedprice')} AS sum_base_price,
       CAST(SUM({_SQL_REVENUE}) AS DOUBLE) AS sum_disc_price,
       {sql_davg('l_quantity')} AS avg_qty, {sql_davg('l_discount')} AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-01'
GROUP BY l_returnflag, l_linestatus
""", ids=("A-5",))
def a5(t: Tables) -> DataFrame:
    return (t.lineitem.filter(F.col("l_shipdate") <= _ts("2001-09-01"))
            .groupBy("l_returnflag", "l_linestatus")
            .agg(dsum("l_quantity").alias("sum_qty"), dsum("l_extendedprice").alias("sum_base_price"),
                 F.sum(_revenue()).cast("double").alias("sum_disc_price"),
                 davg("l_quantity").alias("avg_qty"), davg("l_discount").alias("avg_disc"),
                 F.count(F.lit(1)).alias("count_order")))


@query("A6_having", f"""
SELECT o_custkey, {sql_davg('o_totalprice')} AS avg_price FROM orders
GROUP BY o_custkey HAVING {sql_davg('o_totalprice')} > 300000
""", ids=("A-6",))
def a6(t: Tables) -> DataFrame:
    return (t.orders.groupBy("o_custkey").agg(davg("o_totalprice").alias("avg_price"))
            .filter(F.col("avg_price") > 300000))


@query("A7_having_count_distinct", """
SELECT l_orderkey, COUNT(DISTINCT l_suppkey) AS n_supp FROM lineitem
GROUP BY l_orderkey HAVING COUNT(DISTINCT l_suppkey) >= 6
""", ids=("A-7",))
def a7(t: Tables) -> DataFrame:
    return (t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n_supp"))
            .filter(F.col("n_supp") >= 6))


@query("A8_having_and_or", """
SELECT o_custkey, COUNT(*) AS n, MAX(o_totalprice) AS mx FROM orders
GROUP BY o_custkey
HAVING (COUNT(*) > 16) OR (MAX(o_totalprice) < 350000 AND MIN(o_totalprice) > 5000)
""", ids=("A-8",))
def a8(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("mx"),
                                          F.min("o_totalprice").alias("mn"))
    return g.filter((F.col("n") > 16) | ((F.col("mx") < 350000) & (F.col("mn") > 5000))).select("o_custkey", "n", "mx")


@query("A9_loose_group_by", """
SELECT o_custkey, COUNT(*) AS n, MIN(o_orderdate) AS o_orderdate, MIN(o_orderstatus) AS o_orderstatus
FROM orders GROUP BY o_custkey
""", ids=("A-9",))
def a9(t: Tables) -> DataFrame:
    return R.loose_group_by(t.orders, ["o_custkey"], [F.count(F.lit(1)).alias("n")], ["o_orderdate", "o_orderstatus"])


@query("A9_bare_column_with_max", """
SELECT o_totalprice AS max_price, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1
""", ids=("A-9",))
def a9_max(t: Tables) -> DataFrame:
    """``SELECT MAX(p), k FROM t`` without GROUP BY: the bare column comes from
    the row holding the maximum (smallest key on ties), via max_by."""
    o = t.orders
    return o.agg(F.max("o_totalprice").alias("max_price"),
                 F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("o_orderkey"))


@query("A10_having_without_group_by", f"""
SELECT COUNT(*) AS n, {sql_dsum('o_totalprice')} AS total FROM orders HAVING COUNT(*) > 100
""", ids=("A-10",))
def a10(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n"), dsum("o_totalprice").alias("total")).filter(F.col("n") > 100)


@query("A11_reaggregate_derived", """
SELECT COUNT(*) AS n_customers, AVG(n) AS avg_orders, MAX(n) AS max_orders FROM
  (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) d
""", ids=("A-11",))
def a11(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("n_customers"), F.avg("n").alias("avg_orders"), F.max("n").alias("max_orders"))


# --------------------------------------------------------- sort and limit (O)

@query("O1_order_by_single", "SELECT n_name FROM nation ORDER BY n_name DESC", ids=("O-1",))
def o1(t: Tables) -> DataFrame:
    return t.nation.select("n_name").orderBy(F.col("n_name").desc())


@query("O2_order_by_mixed", """
SELECT c_custkey, c_mktsegment, c_acctbal FROM customer
ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey LIMIT 25
""", ids=("O-2",))
def o2(t: Tables) -> DataFrame:
    return R.top_k(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), 25,
                   F.col("c_mktsegment").asc(), F.col("c_acctbal").desc(), F.col("c_custkey"))


@query("O3_order_by_ordinal", "SELECT n_regionkey, n_name FROM nation ORDER BY 1, 2 LIMIT 7", ids=("O-3",))
def o3(t: Tables) -> DataFrame:
    df = t.nation.select("n_regionkey", "n_name")
    return df.orderBy(*[df.columns[i - 1] for i in (1, 2)]).limit(7)


@query("O4_order_by_aggregate_not_selected", """
SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10
""", ids=("O-4",))
def o4(t: Tables) -> DataFrame:
    g = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("__n"))
    return R.top_k(g, 10, F.col("__n").desc(), F.col("o_custkey")).select("o_custkey")


@query("O5_order_by_null", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", ids=("O-5",))
def o5(t: Tables) -> DataFrame:
    """ORDER BY NULL asks for no order: Catalyst drops the constant key, so no sort and no range shuffle remain."""
    t.customer.createOrReplaceTempView("null_order_customer")
    return t.spark.sql("SELECT c_mktsegment, COUNT(*) AS n FROM null_order_customer GROUP BY c_mktsegment ORDER BY NULL")


@query("O6_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10", ids=("O-6",))
def o6(t: Tables) -> DataFrame:
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, F.col("o_orderkey"))


@query("O7_limit_offset", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5
""", ids=("O-7",))
def o7(t: Tables) -> DataFrame:
    return R.page(t.customer.select("c_custkey", "c_acctbal"), 10, 5, F.col("c_acctbal").desc(), F.col("c_custkey"))


@query("O8_top_k", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10
""", ids=("O-8",))
def o8(t: Tables) -> DataFrame:
    return R.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), 10,
                   F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"))


# --------------------------------------------------------- set operations (U)

def _nk(t: Tables):
    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col(f"{p}_nationkey").alias("nationkey"),
                         F.floor(F.col(f"{p}_acctbal") / 500).cast("bigint").alias("band"))
    return side(t.customer, "c"), side(t.supplier, "s")


_U_L = "SELECT c_nationkey AS nationkey, CAST(FLOOR(c_acctbal / 500) AS BIGINT) AS band FROM customer"
_U_R = "SELECT s_nationkey AS nationkey, CAST(FLOOR(s_acctbal / 500) AS BIGINT) AS band FROM supplier"


@query("U1_union", f"{_U_L} UNION {_U_R}", ids=("U-1",))
def u1(t: Tables) -> DataFrame:
    return R.set_op(*_nk(t), "union")


@query("U2_union_all", f"{_U_L} UNION ALL {_U_R}", ids=("U-2",))
def u2(t: Tables) -> DataFrame:
    return R.set_op(*_nk(t), "union all")


@query("U3_intersect", f"{_U_L} INTERSECT {_U_R}", ids=("U-3",))
def u3(t: Tables) -> DataFrame:
    return R.set_op(*_nk(t), "intersect")


@query("U4_except", f"{_U_L} EXCEPT {_U_R}", ids=("U-4",))
def u4(t: Tables) -> DataFrame:
    return R.set_op(*_nk(t), "except")


@query("U5_minus", f"{_U_L} EXCEPT {_U_R}", ids=("U-5",))
def u5(t: Tables) -> DataFrame:
    """MINUS is accepted by Spark SQL as a synonym of EXCEPT."""
    left, right = _nk(t)
    right.createOrReplaceTempView("u_supplier_side")
    left.createOrReplaceTempView("u_customer_side")
    return t.spark.sql("SELECT * FROM u_customer_side MINUS SELECT * FROM u_supplier_side")


@query("U6_intersect_all", """
SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'
INTERSECT ALL
SELECT l_suppkey FROM lineitem WHERE l_linestatus = 'O'
""", ids=("U-6",))
def u6_int(t: Tables) -> DataFrame:
    li = t.lineitem
    return R.set_op(li.filter(F.col("l_returnflag") == "R").select("l_suppkey"),
                    li.filter(F.col("l_linestatus") == "O").select("l_suppkey"), "intersect all")


@query("U6_except_all", """
SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R'
EXCEPT ALL
SELECT l_suppkey FROM lineitem WHERE l_quantity > 40
""", ids=("U-6",))
def u6_exc(t: Tables) -> DataFrame:
    li = t.lineitem
    return R.set_op(li.filter(F.col("l_returnflag") == "R").select("l_suppkey"),
                    li.filter(F.col("l_quantity") > 40).select("l_suppkey"), "except all")
