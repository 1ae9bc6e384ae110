"""Quoted CSV read by many tasks equals the reader that takes a file a task; the resume ledger."""

import uuid

import pytest

from querylab.sources import files as S

SCHEMA = "query_id BIGINT, query STRING, note STRING"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def corpus(spark, path):
    long = "\n".join(f'line {k} with "quotes", commas' for k in range(400))     # longer than several ranges
    texts = ['a "quoted" word', "two\nlines", "x,y", "", None, '"', '""\n"', "\n\n", " blanks ", "\u00e9\u4e2d\n\U0001f600", long, "plain"]
    data = [(k, texts[k % len(texts)], texts[(k * 5 + 1) % 10]) for k in range(360)]
    df = spark.createDataFrame(data, SCHEMA).coalesce(1)
    df.write.option("header", "true").option("quote", '"').option("escape", '"').csv(f"{path}/shop_correct_sqls")
    df.limit(0).coalesce(1).write.option("header", "true").csv(f"{path}/none_res")
    return data


def test_large_file_is_read_by_several_tasks(spark, tmp_path, small_ranges):
    path = str(tmp_path / "csv")
    data = corpus(spark, path)
    whole = (spark.read.schema(SCHEMA).options(**S._CSV_OPTS).option("recursiveFileLookup", "true").csv(path)
             .withColumn("db_id", S.db_from_path(S.F.col("_metadata.file_path"))))
    got = S.read_corpus(spark, path, SCHEMA)
    assert rows_of(got) == rows_of(whole) and got.count() == len(data)
    assert {r.db_id for r in got.collect()} == {"shop"}
    ranges = spark.read.option("recursiveFileLookup", "true").text(path).select("_metadata.file_block_start").distinct()
    assert ranges.count() > 20
    assert rows_of(S.read_corpus(spark, path, whole.drop("db_id").schema)) == rows_of(whole)


def test_line_ends_and_missing_last_break(spark, tmp_path, small_ranges):
    folder = tmp_path / "db_processed"
    folder.mkdir()
    body = "query_id,query,note\r\n" + "".join(f'{k},"first\nsecond ""{k}""",end\r\n' for k in range(300)) + '300,"last\none",x'
    (folder / "part-0.csv").write_text(body, newline="")
    (folder / "empty.csv").write_text("")
    got = {r.query_id: (r["query"], r.note) for r in S.read_corpus(spark, str(folder), SCHEMA).collect()}
    assert got == {**{k: (f'first\nsecond "{k}"', "end") for k in range(300)}, 300: ("last\none", "x")}


def test_ledger_is_not_shuffled(spark, tmp_path):
    name, keys = f"ledger_{uuid.uuid4().hex}", ["db", "id"]
    rows = spark.range(500).selectExpr("concat('db', id % 3) AS db", "IF(id = 499, NULL, id) AS id", "id AS n")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for cut in ("n < 100", "n BETWEEN 50 AND 200", "n = 499"):
            ledger = S.record_processed(rows.filter(cut), name, str(tmp_path / "ledger"), keys, 6)
        left = S.unprocessed(rows, ledger, keys)
        assert sorted(r.n for r in left.collect()) == list(range(201, 500))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.split("Final Plan")[-1].split("Initial Plan")[0].count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
