"""What sources publish, to rows; catalogues; filters on age and completeness."""

import datetime

from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.sources import catalogue as C
from tessera.sources import parsers as P


def test_rows_and_arrays_of_pages(spark):
    html = "<table><tr><th>Id</th><th>mm</th></tr><tr><td><b>7</b></td><td> 3,5 </td></tr></table><script>var d = [{\"id\": 7, \"mm\": 3.5}, {\"id\": 8, \"mm\": null}];</script>"
    pages = spark.createDataFrame([(1, html), (2, "no table")], "page_id long, html string")
    assert [r.cells for r in P.html_rows(pages, "page_id", "html").orderBy("pos").collect()] == [["Id", "mm"], ["7", "3,5"]]
    assert [(r.id, r.mm) for r in P.embedded_json(pages, "page_id", "html", "d", "id:long,mm:double").orderBy("id").collect()] == [(7, 3.5), (8, None)]
    ints = spark.createDataFrame([(35,), (32767,)], "v int")
    assert sorted((r.v for r in P.scaled_integers(ints, ["v"]).collect()), key=str) == [3.5, None]


def test_networks_that_fail_are_reported(spark):
    def broken(_):
        raise OSError("no answer")

    rain = lambda s: s.createDataFrame([(1, 2.0)], "id int, mm double")
    other = lambda s: s.createDataFrame([(2, "x")], "id int, name string")
    got, report = C.networks(spark, {"a": rain, "b": broken, "c": other, "d": rain}, restricted=["d"])
    assert sorted((r.id, r.network) for r in got.collect()) == [(1, "a"), (2, "c")]
    assert report["a"] == report["c"] == "ok" and report["b"].startswith("OSError") and report["d"] == "restricted"
    assert C.networks(spark, {"b": broken})[0] is None


def test_age_runs_regions_and_years(spark):
    t = datetime.datetime(2024, 1, 5, 12)
    rows = spark.createDataFrame([(1, t - datetime.timedelta(minutes=m)) for m in (10, 99, 150, 151)], "id int, at timestamp")
    assert C.fresh(rows, "at", F.lit(t), 150).count() == 3
    runs = spark.createDataFrame([("m", 6, True), ("m", 12, False), ("m", 0, True), ("n", 3, True)], "model string, run int, complete boolean")
    assert sorted((r.model, r.run) for r in C.latest_runs(runs).collect()) == [("m", 6), ("n", 3)]
    field = spark.createDataFrame([(1, m, v) for m, vs in ((0, (1.0, 5.0)), (1, (3.0, 2.0))) for v in vs], "k int, m int, v double")
    assert C.region_scalars(field, ["k"], "m", "v").first().v == 4.0
    days = spark.range(366 + 365 + 200).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.col("id").cast("double").alias("v"))
    days = days.where("not (year(d) = 2021 and month(d) = 11)")  # 335 days of 2021, with 92 in autumn; 200 of 2022
    assert {(r.year, r.top) for r in C.complete_years(days.withColumn("k", F.lit(1)), ["k"], "d", "v").collect()} == {(2020, 365.0)}


def test_a_store_is_read_by_folders_and_filters(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("m", r, v, 39.0 + i, -1.0 + i, t, 1.0) for r in (0, 6) for v in ("rain", "wind") for i in range(4) for t in range(3)]
    spark.createDataFrame(rows, "model string, run int, variable string, lat double, lon double, valid_time int, value double").write.partitionBy("model", "run", "variable").parquet(path)
    got = C.read_fields(spark, path, "m", [6], ["rain"], box=(39.5, 41.5, -0.5, 5.0), times=(1, 2))
    assert got.count() == 4
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(lat" in plan


def test_local_time(spark):
    rows = [(datetime.datetime(2024, 7, 1, 12), datetime.datetime(2024, 7, 1, 10)), (datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 1, 1, 11)), (datetime.datetime(2024, 3, 31, 1, 59), datetime.datetime(2024, 3, 31, 0, 59)), (datetime.datetime(2024, 3, 31, 3), datetime.datetime(2024, 3, 31, 1))]
    df = spark.createDataFrame(rows, "t timestamp, utc timestamp")
    assert all(r.x == r.utc for r in df.select(S.local_to_utc(F.col("t")).alias("x"), "utc").collect())
