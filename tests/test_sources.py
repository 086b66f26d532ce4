import json
from pathlib import Path

import pytest
from pyspark.sql import Row, functions as F

from siftwatch import staging
from siftwatch.operators import skew
from siftwatch.sources import pulses, schemas, tables


def pulse(i, **over):
    base = {"id": str(i), "name": f"n{i}", "description": "d" * 100, "created": "2024", "tags": ["Malware"], "references": ["r"], "author": {"username": "u"}}
    return {**base, **over}


def test_pages_end_at_the_first_empty_one_and_stop_at_the_limit(spark, tmp_path):
    for page, results in {"1": [pulse(0), pulse(1)], "2": [pulse(2)], "3": [], "4": [pulse(9)]}.items():
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"results": results}, indent=1))
    pages = pulses.read_pulse_pages(spark, str(tmp_path))
    assert sorted(r.id for r in pulses.flatten_pulse_pages(pages, end_at_empty=True).collect()) == ["0", "1", "2"]
    assert sorted(r.id for r in pulses.flatten_pulse_pages(pages).collect()) == ["0", "1", "2", "9"]
    assert [r.id for r in pulses.flatten_pulse_pages(pages, 2).collect()] == ["0", "1"]


def test_pages_are_ordered_by_number(spark, tmp_path):
    for page in range(1, 12):
        (tmp_path / f"page-{page}.json").write_text(json.dumps({"results": [pulse(page)] if page != 11 else []}))
    pages = pulses.read_pulse_pages(spark, str(tmp_path))
    for end in (False, True):
        got = pulses.flatten_pulse_pages(pages, end_at_empty=end)
        assert [r.id for r in got.orderBy("page").collect()] == [str(i) for i in range(1, 11)]
    assert [r.id for r in pulses.flatten_pulse_pages(pages, 3).collect()] == ["1", "2", "3"]
    (tmp_path / "nameless.json").write_text(json.dumps({"results": [pulse(0)]}))
    with pytest.raises(Exception, match="no page number"):
        pulses.flatten_pulse_pages(pulses.read_pulse_pages(spark, str(tmp_path))).collect()


def test_csv_is_read_by_its_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,description\nT1,one,\"x, y\"\nT2,two,z\n")
    schema = "row_id bigint, name string, id string, description string"
    rows = tables.scan_threats(spark, str(tmp_path), "csv", schema).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(0, "one", "T1", "x, y"), (1, "two", "T2", "z")]
    with pytest.raises(ValueError, match="lacks tags"):
        tables.scan_threats(spark, str(tmp_path), "csv", schema + ", tags string")
    parquet = str(tmp_path / "p")
    spark.createDataFrame([("a", 1)], "name string, row_id bigint").write.parquet(parquet)
    with pytest.raises(ValueError, match="lacks id"):
        tables.scan_threats(spark, parquet, schema="row_id bigint, id string, name string")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.csv").write_text("row_id,name\nnot a number,x\n")
    with pytest.raises(Exception):
        tables.scan_threats(spark, str(tmp_path / "bad"), "csv", "row_id bigint, name string").collect()


def test_quality_filter_cases(spark, tmp_path):
    rows = [
        pulse("long", description="  " + "d" * 100 + "\n"),
        pulse("short", description="d" * 99 + "   "),
        pulse("adjacent", tags=["Supply", "Chain"]),
        pulse("irrelevant", tags=["news"]),
        pulse("nameless", name=" \t"),
        pulse("bare", author=None, references=None),
        {"id": "empty"},
    ]
    (tmp_path / "p1.json").write_text(json.dumps({"results": rows}))
    flat = pulses.normalise_pulses(pulses.flatten_pulse_pages(pulses.read_pulse_pages(spark, str(tmp_path))))
    kept = {r.id: r for r in pulses.quality_filter(flat).collect()}
    assert set(kept) == {"long", "adjacent", "bare"}
    assert kept["long"].description == "d" * 100 and kept["adjacent"].tags == "supply, chain"
    assert kept["bare"].author == "Unknown" and kept["bare"].references == ""
    summary = pulses.collection_summary(flat).first()
    assert (summary.raw, summary.kept) == (7, 3) and summary.filter_rate == pytest.approx(400 / 7)


def test_csv_keeps_quotes_line_breaks_and_blanks(spark, tmp_path):
    rows = [Row(row_id=1, name=' say "hi", ', description="two\nlines\r\nand, more"), Row(row_id=2, name=None, description="x")]
    schema = "row_id bigint, name string, description string"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "t")
    tables.write_threats(df, path, "csv")
    back = {r.row_id: r for r in tables.scan_threats(spark, path, "csv", schema).collect()}
    assert back[1].name == ' say "hi", ' and back[1].description.replace("\r", "") == "two\nlines\nand, more"
    assert back[2].name is None
    with pytest.raises(Exception):
        tables.scan_threats(spark, str(tmp_path / "missing"), "csv", schema).count()


def test_report_replaces_the_last_one(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.createDataFrame([(0, 1, 0.9, "a", "b")], schemas.DUPLICATE_REPORT)
    assert tables.write_duplicate_report(df, path) and spark.read.parquet(path).count() == 1
    assert not tables.write_duplicate_report(df.limit(0), path) and spark.read.parquet(path).count() == 0


def test_metrics_are_appended_and_placeholder_tags_read_as_null(spark, tmp_path):
    m = spark.createDataFrame([("r", "a", 1.0)], "run_id string, key string, value double")
    for _ in range(2):
        tables.append_metrics(m, str(tmp_path / "m"))
    tables.append_metrics(m.withColumn("run_id", F.lit("s")), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    stats = spark.createDataFrame(
        [(0, 0, 0.0, "N/A", "", 0.0)], "cluster_id int, size bigint, percentage double, top_tags string, sample_threats string, std_dev double"
    )
    tables.write_cluster_stats(stats, str(tmp_path / "s"))
    back = tables.scan_cluster_stats(spark, str(tmp_path / "s")).first()
    assert back.top_tags is None and back.sample_threats is None


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti", "left"])
def test_salted_join_equals_plain_join(spark, how):
    big = spark.range(500).select((F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 17)).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 12)], "k bigint, s string")
    plain = sorted(map(tuple, big.join(small, "k", how).collect()), key=str)
    assert sorted(map(tuple, skew.salted_join(big, small, "k", how, rows_per_salt=20, spread="v").collect()), key=str) == plain
    assert sorted(map(tuple, skew.lookup_join(big, small, "k", how, max_rows=5).collect()), key=str) == plain
    assert sorted(map(tuple, skew.lookup_join(big, small, "k", how).collect()), key=str) == plain


def test_renumber_across_buckets(spark):
    for ids in (spark.range(0, 100, 7), spark.range(20_000).select(F.xxhash64("id").alias("id")), spark.range(0)):
        df = ids.repartition(7).withColumnRenamed("id", "row_id")
        numbered = skew.renumber(df, "row_id")
        got = numbered.orderBy("row_id").collect()
        assert numbered.columns == ["row_id", "new_row_id"] and [r.new_row_id for r in got] == list(range(len(got)))


def test_a_scope_takes_its_staged_tables_with_it(spark):
    before = staging.stage(spark.range(3))
    with staging.stage_scope(spark) as folder:
        inside = staging.stage(spark.range(5))
        assert inside.count() == 5 and all(folder in f for f in inside.inputFiles())
    assert not Path(folder).exists() and before.count() == 3
    assert "scope-" not in staging.stage_path(spark)
