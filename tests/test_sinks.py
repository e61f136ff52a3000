"""Sinks, upserts, registered functions, projections."""

from pyspark.sql import functions as F

from tessera.functions import geo, registry, scalar
from tessera.operators import grids as G
from tessera.operators import windows as W
from tessera.sources import sinks as K
from tessera.streaming import operators as S


def test_archive_keeps_every_third_hour_and_retention_the_newest(spark, tmp_path):
    path = str(tmp_path / "archive")
    for at in range(12):
        assert K.archive(spark.range(3).withColumn("v", F.lit(at)), path, at) == (at % 3 == 0)
    K.archive(spark.range(2).withColumn("v", F.lit(99)), path, 9)
    assert K.partitions(spark, path, "at") == [0, 3, 6, 9]
    assert K.retain(spark, path, "at", 2) == [0, 3] and K.partitions(spark, path, "at") == [6, 9]
    assert {r.v for r in spark.read.parquet(path).where("at = 9").collect()} == {99} and K.partitions(spark, str(tmp_path / "none"), "at") == []


def test_backfill_reads_all_again_after_a_long_gap(spark):
    missing = spark.createDataFrame([("a", t) for t in (95, 97, 98)] + [("b", 99), ("b", 40)], "source string, t long")
    got = {}
    for r in K.backfill(missing, F.lit(100).cast("long")).collect():
        got.setdefault(r.source, set()).add(r.t)
    assert got == {"a": set(range(87, 101)), "b": {99}}


def test_a_build_goes_on_where_it_was(spark, tmp_path):
    made, path = [], str(tmp_path / "blocks")

    def make(b):
        made.append(b)
        if b == "c" and made.count("c") == 1:
            raise RuntimeError("broken off")
        return spark.range(2)

    try:
        K.build_blocks(spark, ["a", "b", "c"], make, path)
    except RuntimeError:
        pass
    assert K.build_blocks(spark, ["a", "b", "c"], make, path) == ["c"] and made == ["a", "b", "c", "c"]
    assert spark.read.parquet(path).count() == 6


def test_publish_keeps_the_last_good_version(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    ok = {"rows": F.count("*") >= 3}
    assert K.publish(spark.range(3), path, ok, "v1") == {"rows": True} and K.publish(spark.range(1), path, ok, "v2") == {"rows": False}
    assert K.last_version(spark, path).count() == 3 and K.last_version(spark, path).first().version == "v1"


def test_packed_frames_come_back(spark):
    df = spark.createDataFrame([(1, p, c) for p, c in enumerate((0, 7, 255, 128))], "k int, pos int, c int")
    packed = K.packed_bytes(df, ["k"], "pos", "c")
    assert sorted((r.pos, r.code) for r in K.unpacked_bytes(packed, ["k"], "packed").collect()) == [(0, 0), (1, 7), (2, 255), (3, 128)]


def test_upserts_rewrite_only_the_partitions_they_touch(spark, tmp_path):
    path = str(tmp_path / "state")
    write = S.upsert(spark, path, ["k"], "at", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, at int, v string")
    write(rows(*[(k, 1, f"old{k}") for k in range(40)]), 0)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    for _ in range(2):  # a batch that comes again changes nothing
        write(rows((3, 5, "new"), (4, 0, "late")), 1)
    got = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert got == {**{k: f"old{k}" for k in range(40)}, 3: "new"}
    kept = [f for f in before if f.exists()]
    assert kept and all(f.stat().st_mtime_ns == before[f] for f in kept)


def test_registered_functions_are_those_of_the_library(spark):
    names = registry.register(spark, "t_")
    assert {"t_rain_rate", "t_offsets", "t_frames_of", "t_hours_of", "t_csgd_exceed"} <= set(names)
    x = spark.createDataFrame([(z, c, a) for z in (3.0, 20.0, 60.0, None) for c in (True, False) for a in (0.5, 184.0)], "z double, c boolean, a double")
    got = x.select(
        F.expr("t_rain_rate(z, c)").alias("r1"), scalar.rain_rate(F.col("z"), F.col("c")).alias("r2"), F.expr("t_areal_reduction(a)").alias("a1"), scalar.areal_reduction(F.col("a")).alias("a2"),
        F.expr("t_runoff_coefficient(a, 40, 60)").alias("c1"), scalar.runoff_coefficient(F.col("a"), 40, 60).alias("c2"), F.expr("t_runoff_depth(a, 40, 60)").alias("d1"), scalar.runoff_depth(F.col("a"), 40, 60).alias("d2"),
    ).collect()
    for r in got:
        assert all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-12) for p, q in ((r.r1, r.r2), (r.a1, r.a2), (r.c1, r.c2), (r.d1, r.d2)))
    assert "Python" not in x.select(F.expr("t_rain_rate(z, c)"))._jdf.queryExecution().toString()
    assert sorted(map(tuple, spark.sql("SELECT * FROM t_offsets(12.0, 5.5, 4.4)").collect())) == sorted(G.disc(12.0, 5.5, 4.4))
    assert sorted(map(tuple, spark.sql("SELECT * FROM t_frames_of(473449)").collect())) == sorted(map(tuple, W.frames(spark, 473449).collect()))
    assert [tuple(r) for r in spark.sql("SELECT * FROM t_hours_of(10, 3, 6.0)").collect()] == [(8, 2.0), (9, 2.0), (10, 2.0)]
    assert spark.sql("SELECT t_step_end(TIMESTAMP '1970-01-01 01:00:00', 3600) AS t").first().t == 1


def test_utm_series_comes_back(spark):
    """Against the forward projection, by the series in the meridian arc, of the points that come out."""
    import math

    pts = [(700_000.0 + 13_000 * k, 4_300_000.0 + 31_000 * k) for k in range(-8, 8)]
    df = spark.createDataFrame(pts, "e double, n double")
    lon, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"))
    a, f, k0 = 6378137.0, 1 / 298.257222101, 0.9996
    n = f / (2 - f)
    scale = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    for r in df.select("e", "n", lon.alias("lon"), lat.alias("lat")).collect():
        p, dl = math.radians(r.lat), math.radians(r.lon + 3)
        s = 2 * math.sqrt(n) / (1 + n)
        t = math.sinh(math.atanh(math.sin(p)) - s * math.atanh(s * math.sin(p)))
        xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
        east = 500_000 + k0 * scale * (eta + sum(x * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, x in enumerate(alpha, 1)))
        north = k0 * scale * (xi + sum(x * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, x in enumerate(alpha, 1)))
        assert abs(east - r.e) < 0.01 and abs(north - r.n) < 0.01
