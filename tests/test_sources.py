import json

import pytest

from assayer.operators import templates
from assayer.plans import ask, prepare
from assayer.sources import bundle, readers, records
from assayer.sources import registry as registry_module
from assayer.sources.registry import TableRegistry, validate_query

CSV = """order_id,order_date,region,quantity,price,paid
1,2024-01-10,North,1,55000,True
2,2024-01-11,south,2,800,False
3,2024-01-12,EAST,,1500,True
4,2024-01-13,West,-2,,False
5,2024-01-14,north,1,58000,True
6,bad-date,"South, far",3,-900,True
6,bad-date,"South, far",3,-900,True
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types(spark, csv):
    df = readers.load_dataset(spark, csv)
    assert dict(df.dtypes) == {"order_id": "bigint", "order_date": "string", "region": "string", "quantity": "bigint",
                               "price": "bigint", "paid": "boolean"}
    assert df.where("quantity IS NULL").count() == 1 and df.count() == 7


def test_reader_guards(spark, tmp_path, csv):
    with pytest.raises(ValueError):
        readers.load_dataset(spark, csv.replace(".csv", ".txt"))
    with pytest.raises(FileNotFoundError):
        readers.load_dataset(spark, str(tmp_path / "none.csv"))
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        readers.load_dataset(spark, str(tmp_path / "empty.csv"))


@pytest.mark.parametrize("sql,ok", [
    ("SELECT * FROM t LIMIT 5;", True),
    ("with x as (select 1) select * from x", True),
    ("SELECT 'delete; drop' AS word, replace(a, 'x', 'y') FROM t -- update later", True),
    ("SELECT \"update\" FROM t /* insert */", True),
    ("", False), ("  ;  ", False), ("DELETE FROM t", False), ("DROP TABLE t", False),
    ("SELECT 1; SELECT 2", False), ("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", False),
    ("SELECT 1 FROM t WHERE call = 1", False), ("EXPLAIN SELECT 1", False), (None, False),
])
def test_query_guard(sql, ok):
    assert validate_query(sql)[0] is ok


def test_registry(spark, csv):
    registry = TableRegistry(spark)
    df = registry.register(readers.load_dataset(spark, csv), "guarded")
    assert registry.is_registered("GUARDED") and not registry.is_registered("other")
    assert registry.query("SELECT count(*) AS n FROM guarded;").first()["n"] == 7
    assert registry.describe("guarded").first()["column_name"] == "order_id"
    for call in (lambda: registry.query("DROP VIEW guarded"), lambda: registry.register(df, "1x"),
                 lambda: registry.register(df.limit(0), "empty"), lambda: registry.describe("other")):
        with pytest.raises(ValueError):
            call()
    context = {r["column"]: r for r in templates.schema_context(df).collect()}
    assert context["paid"]["samples"] == ["false", "true"]
    registry.close()
    assert not registry.is_registered("guarded")


def test_quoting():
    assert templates.quote("a`b") == "`a``b`" and templates.quote('a"b', '"') == '"a""b"'


def test_records(spark):
    df = spark.sql("SELECT 1 AS a, double('NaN') AS b, timestamp_ntz'2024-01-02 00:00:00' AS t, CAST(NULL AS STRING) AS s")
    assert json.loads(records.to_records(df).first()["record"]) == {"a": 1, "b": None, "t": "2024-01-02T00:00:00", "s": None}


def test_prepare_and_ask(spark, csv, tmp_path):
    path = str(tmp_path / "bundle")
    done = prepare.prepare_dataset(spark, csv, "orders", path)
    assert done.before.profile.types["order_id"] == "Identifier" and done.before.profile.types["paid"] == "Boolean"
    info = bundle.bundle_info(spark, path).first()
    assert (info["name"], info["original_rows"], info["rows"]) == ("orders", 7, 6)
    assert info["quality_improvement"] == round(info["score_after"] - info["score_before"], 2)
    assert 0 <= info["score_before"] <= info["score_after"] <= 100
    cleaned = bundle.read_section(spark, path, "cleaned")
    assert cleaned.columns == ["order_id", "order_date", "region", "quantity", "price", "paid"]
    assert cleaned.where("quantity < 0 OR price < 0 OR quantity IS NULL OR price IS NULL").count() == 0
    delta = {r["component"]: r["change"] for r in prepare.score_delta(done.before.quality, done.after.quality).collect()}
    assert len(delta) == 6 and delta["overall"] == info["quality_improvement"]
    kept = bundle.read_section(spark, path, "findings").where("type = 'quality'")
    bundle.replace_section(path, "findings", kept)
    assert bundle.read_section(spark, path, "findings").count() == 1
    with pytest.raises(ValueError):
        bundle.read_section(spark, path, "elsewhere")

    registry = TableRegistry(spark)
    registry.register(cleaned, "prepared")
    answer = ask.ask(registry, templates.average_by, "region", "price", table="prepared")
    assert answer.chart.chart_type == "bar" and answer.summary.first()["kind"] == "highest"
    boxed = ask.ask(registry, "SELECT count(*) AS n FROM prepared", table="prepared", chart="histogram",
                    types=done.after.profile)
    assert boxed.chart.chart_type == "histogram" and boxed.chart.data.count() >= 1


def test_bundle_versions_show_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bundle")
    numbers = lambda n: spark.range(n).toDF("n")
    first = bundle.write_bundle(path, {"cleaned": numbers(3), "findings": numbers(1)})
    held = bundle.open_bundle(spark, path)
    second = bundle.replace_section(path, "findings", bundle.read_section(spark, path, "findings").unionAll(numbers(4)))
    assert (first.number, second.number, bundle.versions(spark, path)) == (1, 2, [1, 2])
    assert bundle.read_section(spark, path, "findings").count() == 5 and held.section("findings").count() == 1
    assert bundle.read_section(spark, path, "cleaned").count() == 3

    broken = spark.range(2).selectExpr("CAST(raise_error('ends midway') AS STRING) AS x")
    with pytest.raises(Exception, match="ends midway"):
        bundle.write_bundle(path, {"cleaned": numbers(9), "info": broken})
    assert bundle.open_bundle(spark, path).number == 2 and bundle.read_section(spark, path, "cleaned").count() == 3

    with monkeypatch.context() as m:  # two writers start from the same version
        m.setattr(bundle, "open_bundle", lambda *_: held)
        with pytest.raises(bundle.ConcurrentWrite):
            bundle.replace_section(path, "findings", numbers(7))
    assert bundle.versions(spark, path) == [1, 2] and bundle.read_section(spark, path, "findings").count() == 5

    third = bundle.write_bundle(path, {"cleaned": numbers(6)})
    with pytest.raises(KeyError):
        third.section("findings")
    assert bundle.prune(spark, path) > 0 and bundle.versions(spark, path) == [3]
    assert bundle.read_section(spark, path, "cleaned").count() == 6
    assert bundle.write_bundle(path, {}) is None and bundle.open_bundle(spark, str(tmp_path / "none")).number == 0


@pytest.mark.parametrize("sql", [
    "SELECT * FROM t LIMIT 5", "SELECT region, count(*) FROM t GROUP BY region", "WITH x AS (SELECT 1 AS a) SELECT a FROM x WHERE a IN (SELECT 1)",
    "SELECT 'drop table t' AS s, replace(a, 'x', 'y') FROM t",
])
def test_plans_that_only_read(spark, sql):
    assert registry_module.plan_commands(spark, sql) == []


@pytest.mark.parametrize("sql", [
    "WITH x AS (SELECT 1 AS a) INSERT INTO t SELECT a FROM x", "INSERT INTO t VALUES (1)", "DROP TABLE t", "CREATE TABLE u AS SELECT 1 AS a",
    "SET spark.sql.ansi.enabled = false", "DELETE FROM t", "CACHE TABLE t", "FROM t INSERT INTO u SELECT a INSERT INTO v SELECT b",
])
def test_plans_that_do_more_than_read(spark, sql):
    assert registry_module.plan_commands(spark, sql)
