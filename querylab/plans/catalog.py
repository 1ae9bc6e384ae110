"""Catalog and graph queries (K family).

The catalog row is built from the driver tables' own schemas plus their key
graph; the oracle reads the same schemas from DuckDB's information_schema.
Components are exercised on data-sized chains (each customer linked to the
next one of its nation and market segment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylab.operators import catalog as K
from querylab.operators.compare import dense_positions
from querylab.plans.registry import query
from querylab.session import saved
from querylab.sources import workload as W
from querylab.tables import TABLE_NAMES, Tables

DB = "driver"

# Columns of the driver tables, in order (for the oracle, which
# names them; the library reads the schemas).
COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag "
                "l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
# Fixed values, for the oracle: pairs of columns tried where no single column
# is a key, and references between key-like columns by their names.
_PAIRS = {"lineitem": ["l_partkey", "l_suppkey", "l_linenumber"], "conversations": ["turn"]}
REFERENCES = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("documents", "doc_id", "labels", "doc_id"),
    ("labels", "doc_id", "documents", "doc_id")]


_FOUND: dict = {}
_CLASSES: dict = {}


def _state(t: Tables) -> tuple:
    return t.spark.sparkContext.applicationId, t.sf_dir, W.file_state(t.spark, [t.path(n) for n in TABLE_NAMES])


def discovered(t: Tables) -> tuple[DataFrame, list, list]:
    """The tables' column profile, primary keys and references, found once an
    application and state of the tables' files."""
    tables, key = {n: t.table(n) for n in TABLE_NAMES}, _state(t)
    if key not in _FOUND:
        columns = saved(K.profile(tables), "profile")
        pks = K.infer_primary_keys(tables, columns)
        _FOUND[key] = columns, pks, K.infer_foreign_keys(tables, pks, columns)
    return _FOUND[key]


def catalog(t: Tables) -> DataFrame:
    """The catalog feed: one row from the tables' schemas and the keys that
    their data show."""
    _, pks, fks = discovered(t)
    return K.catalog_df(t.spark, [K.catalog_row(DB, {n: t.table(n).schema for n in TABLE_NAMES}, pks, fks)])


def counted(t: Tables, columns: DataFrame) -> DataFrame:
    """The column relation with the number of values of each column."""
    return columns.join(discovered(t)[0].select("table", "column", "n_values"), ["table", "column"])


def column_classes(t: Tables) -> dict[str, str]:
    """Column -> least name of the columns that references link it to: the
    components of the references' graph, a row a key column, found once a state
    of the tables."""
    key = _state(t)
    if key in _CLASSES:
        return _CLASSES[key]
    edges = K.foreign_keys(catalog(t)).select(F.col("column1").alias("a"), F.col("column2").alias("b")).filter("a <> b")
    names = edges.select(F.col("a").alias("c")).union(edges.select("b")).distinct()
    ids = saved(dense_positions(names, [F.col("c")], "id"), "key-columns")
    linked = (edges.join(ids.toDF("a", "src"), "a").join(ids.toDF("b", "dst"), "b").select("src", "dst"))
    found = K.connected_components(linked)
    rows = (found.join(ids.toDF("c", "node"), "node").join(ids.toDF("least", "component"), "component").select("c", "least").collect())
    _CLASSES[key] = {r.c: r.least for r in rows}
    return _CLASSES[key]


_NAMES = ", ".join(f"'{n}'" for n in TABLE_NAMES)
_COLS_SQL = f"""cols AS (
  SELECT DISTINCT table_name AS "table", column_name AS "column",
    CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT', 'REAL')
              OR data_type LIKE 'DECIMAL%' THEN 'number'
         WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'time'
         WHEN data_type IN ('VARCHAR', 'BOOLEAN', 'BLOB') THEN 'text' ELSE 'others' END AS type
  FROM information_schema.columns WHERE table_name IN ({_NAMES}))"""
_COUNTS_SQL = "counts AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", UNNEST([{', '.join(repr(c) for c in cs)}]) AS \"column\", "
    f"UNNEST([{', '.join(f'COUNT({c})' for c in cs)}]) AS n_values FROM {n}" for n, cs in COLUMNS.items()) + ")"


def _distinct_sql(table: str, cols: list[str], rank: int) -> str:
    null = " OR ".join(f"{c} IS NULL" for c in cols)
    return (f"SELECT '{table}' AS \"table\", {cols!r} AS cols, {rank} AS rank, COUNT(*) > 0 AND COUNT(*) = "
            f"(SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {table})) "
            f"AND NOT COALESCE(BOOL_OR({null}), FALSE) AS ok FROM {table}")


_PK_SQL = "found AS (" + " UNION ALL ".join(
    [_distinct_sql(n, [c], i) for n, cs in COLUMNS.items() for i, c in enumerate(cs) if K.is_key_like(c)]
    + [_distinct_sql(n, [next(c for c in COLUMNS[n] if K.is_key_like(c)), o], 100 + i)
       for n, others in _PAIRS.items() for i, o in enumerate(others)]) + """),
pks AS (SELECT "table", UNNEST(cols) AS "column" FROM found WHERE ok
        QUALIFY ROW_NUMBER() OVER (PARTITION BY "table" ORDER BY rank) = 1)"""
_FK_SQL = "fks AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS table1, '{c}' AS column1, '{b}' AS table2, '{k}' AS column2 "
    f"WHERE NOT EXISTS (SELECT 1 FROM {a} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {b}))"
    for a, c, b, k in REFERENCES) + ")"
_DEG_SQL = ("deg AS (SELECT t, COUNT(*) AS degree FROM (SELECT table1 AS t FROM fks UNION ALL "
            "SELECT table2 FROM fks) x GROUP BY t)")


@query("K1_column_relation", f"WITH {_COLS_SQL}, {_COUNTS_SQL} SELECT '{DB}' AS db_id, \"table\", \"column\", type, "
       "n_values FROM cols JOIN counts USING (\"table\", \"column\")", ids=("K-1", "S-5"))
def k1(t: Tables) -> DataFrame:
    return counted(t, K.columns_relation(catalog(t))).select("db_id", "table", "column", "type", "n_values")


@query("K2_primary_keys", f"WITH {_PK_SQL}, {_COLS_SQL} SELECT '{DB}' AS db_id, p.\"table\", p.\"column\" "
       "FROM pks p JOIN cols c ON p.\"table\" = c.\"table\" AND p.\"column\" = c.\"column\"", ids=("K-2",))
def k2(t: Tables) -> DataFrame:
    return K.primary_keys(catalog(t))


@query("K3_foreign_keys", f"WITH {_FK_SQL}, {_DEG_SQL} SELECT '{DB}' AS db_id, table1, column1, table2, column2, "
       "d1.degree AS degree1, d2.degree AS degree2 FROM fks JOIN deg d1 ON d1.t = table1 JOIN deg d2 ON d2.t = table2",
       ids=("K-3",))
def k3(t: Tables) -> DataFrame:
    return K.foreign_keys(catalog(t))


def customer_chain(t: Tables) -> DataFrame:
    return K.chain_edges(t.customer, ["c_nationkey", "c_mktsegment"], "c_custkey", "c_custkey")


_CHAIN_SQL = """grp AS (SELECT c_custkey, MIN(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS component,
                    COUNT(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS size FROM customer)"""


@query("K4_connected_components", f"WITH {_CHAIN_SQL} SELECT c_custkey AS node, component FROM grp WHERE size > 1",
       ids=("K-4",))
def k4(t: Tables) -> DataFrame:
    """Components of the customer chain graph (chains are the worst case for
    label propagation; contraction leaves about half of the nodes a round)."""
    return K.connected_components(customer_chain(t))


_REACH = f"""reach(a, b) AS (
  SELECT table1, table2 FROM fks UNION SELECT table2, table1 FROM fks UNION
  SELECT DISTINCT table1, table1 FROM fks UNION SELECT DISTINCT table2, table2 FROM fks
  UNION SELECT r.a, f.b FROM reach r JOIN (SELECT table1 AS a, table2 AS b FROM fks UNION
                                          SELECT table2, table1 FROM fks) f ON r.b = f.a)"""


@query("K5_max_joins", f"""WITH RECURSIVE {_FK_SQL}, {_REACH}, {_CHAIN_SQL},
comp AS (SELECT a, MIN(b) AS c FROM reach GROUP BY a)
SELECT 'customer_chain' AS graph, MAX(size) - 1 AS max_joins FROM grp WHERE size > 1
UNION ALL
SELECT 'foreign_keys', MAX(n) - 1 FROM (SELECT c, COUNT(*) AS n FROM comp GROUP BY c) s""", ids=("K-5",))
def k5(t: Tables) -> DataFrame:
    chain = K.max_joins(K.connected_components(customer_chain(t))).select(
        F.lit("customer_chain").alias("graph"), "max_joins")
    te = K.table_edges(K.foreign_keys(catalog(t))).select("src", "dst")
    # Table names are mapped to integer ids for the component rounds.
    ids = (te.select(F.col("src").alias("n")).union(te.select(F.col("dst").alias("n"))).distinct()
           .withColumn("id", F.xxhash64("n")))
    e = (te.join(ids.select(F.col("n").alias("src"), F.col("id").alias("s")), "src")
         .join(ids.select(F.col("n").alias("dst"), F.col("id").alias("d")), "dst")
         .select(F.col("s").alias("src"), F.col("d").alias("dst")))
    fk = K.max_joins(K.connected_components(e)).select(F.lit("foreign_keys").alias("graph"), "max_joins")
    return chain.unionByName(fk)


@query("K6_connected_table_subsets", f"""WITH {_FK_SQL},
e AS (SELECT DISTINCT LEAST(table1, table2) AS src, GREATEST(table1, table2) AS dst FROM fks),
tri AS (SELECT DISTINCT list_sort(list_distinct([e1.src, e1.dst, e2.src, e2.dst])) AS nodes
        FROM e e1 JOIN e e2 ON (e1.src = e2.src OR e1.src = e2.dst OR e1.dst = e2.src OR e1.dst = e2.dst)
        AND (e1.src, e1.dst) <> (e2.src, e2.dst))
SELECT array_to_string(nodes, ',') AS tables,
       (SELECT array_to_string(list_sort(list(src || '-' || dst)), ',') FROM e
        WHERE list_contains(nodes, src) AND list_contains(nodes, dst)) AS edges
FROM tri WHERE len(nodes) = 3""", ids=("K-6",))
def k6(t: Tables) -> DataFrame:
    te = K.table_edges(K.foreign_keys(catalog(t))).select("src", "dst")
    s = K.connected_subsets(te, 3)
    return s.select(F.array_join("nodes", ",").alias("tables"), F.array_join("edges", ",").alias("edges"))


@query("K7_column_owners", f"WITH {_COLS_SQL}, {_COUNTS_SQL} SELECT '{DB}' AS db_id, \"column\", "
       "string_agg(\"table\", ',' ORDER BY \"table\") AS tables, COUNT(*) AS n_tables, SUM(n_values)::BIGINT AS n_values "
       "FROM cols JOIN counts USING (\"table\", \"column\") GROUP BY \"column\"", ids=("K-7",))
def k7(t: Tables) -> DataFrame:
    """Owners of each column name, and how many values they hold together."""
    cols = counted(t, K.columns_relation(catalog(t)))
    held = cols.groupBy("db_id", "column").agg(F.sum("n_values").alias("n_values"))
    return K.column_owners(cols).join(held, ["db_id", "column"])


@query("K8_qualified_attributes", f"WITH {_COLS_SQL}, {_COUNTS_SQL} SELECT '{DB}' AS db_id, \"table\", \"column\", type AS bucket, "
       "CASE WHEN COUNT(*) OVER (PARTITION BY \"column\") > 1 THEN \"table\" || '.' || \"column\" ELSE \"column\" END "
       "AS attribute FROM cols JOIN counts USING (\"table\", \"column\") WHERE n_values > 0", ids=("K-8",))
def k8(t: Tables) -> DataFrame:
    """Qualified names of the columns that hold values."""
    return K.qualified_attributes(counted(t, K.columns_relation(catalog(t))).filter("n_values > 0"))


@query("K9_fk_neighbours", f"WITH {_FK_SQL} SELECT DISTINCT '{DB}' AS db_id, \"table\", neighbour FROM ("
       "SELECT table1 AS \"table\", table2 AS neighbour FROM fks UNION ALL SELECT table2, table1 FROM fks) x",
       ids=("K-9",))
def k9(t: Tables) -> DataFrame:
    return K.fk_neighbours(K.foreign_keys(catalog(t)))


@query("K10_groupable_columns", f"WITH {_COLS_SQL}, {_PK_SQL} SELECT '{DB}' AS db_id, c.\"table\", c.\"column\", "
       "c.type FROM cols c ANTI JOIN pks p ON c.\"table\" = p.\"table\" AND c.\"column\" = p.\"column\"",
       ids=("K-10",))
def k10(t: Tables) -> DataFrame:
    cat = catalog(t)
    cols = K.columns_relation(cat).select("db_id", "table", "column", "type")
    return K.groupable_columns(cols, K.primary_keys(cat))
