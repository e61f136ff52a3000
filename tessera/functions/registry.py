"""The engine's functions for users of SQL: scalar ones as SQL functions, which the optimizer expands in place, table
functions as such, and the gamma law, which has no native form, as Arrow functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.special import csgd_exceed, csgd_quantile

#: name: (arguments, result, body)
SCALARS = {
    "rain_rate": ("dbz DOUBLE, convective BOOLEAN", "DOUBLE", "CASE WHEN dbz IS NULL THEN NULL WHEN dbz < 7 THEN 0D WHEN convective THEN pow(pow(10, least(dbz, 57) / 10) / 300, 1 / 1.4D) ELSE pow(pow(10, least(dbz, 57) / 10) / 200, 1 / 1.6D) END"),
    "areal_reduction": ("area DOUBLE", "DOUBLE", "least(greatest(1 - log10(greatest(area, 1)) / 15, 0.5D), 1D)"),
    "duration_threshold": ("t1 DOUBLE, t12 DOUBLE, hours DOUBLE", "DOUBLE", "t1 * pow(hours, ln(t12 / t1) / ln(12))"),
    "runoff_depth": ("wet DOUBLE, p0 DOUBLE, s DOUBLE", "DOUBLE", "CASE WHEN wet > p0 THEN pow(wet - p0, 2) / (wet - p0 + s) ELSE 0D END"),
    "runoff_coefficient": ("wet DOUBLE, p0 DOUBLE, s DOUBLE", "DOUBLE", "greatest(wet - p0, 0D) * (greatest(wet - p0, 0D) + 2 * s) / pow(greatest(wet - p0, 0D) + s, 2)"),
    "blend_weight": ("lead DOUBLE", "DOUBLE", "0.5D * (1 + cos(pi() * least(greatest((lead - 1) / 3, 0), 1)))"),
    "step_end": ("ts TIMESTAMP, seconds BIGINT", "BIGINT", "CAST(ceil(unix_micros(ts) / (seconds * 1000000)) AS BIGINT)"),
}

#: name: (arguments, result columns, query)
TABLES = {
    "offsets": (
        "radius_km DOUBLE, dy_km DOUBLE, dx_km DOUBLE", "dj INT, di INT",
        "SELECT dj, di FROM (SELECT explode(sequence(-CAST(floor(radius_km / dy_km) AS INT), CAST(floor(radius_km / dy_km) AS INT))) AS dj) "
        "LATERAL VIEW explode(sequence(-CAST(floor(radius_km / dx_km) AS INT), CAST(floor(radius_km / dx_km) AS INT))) o AS di WHERE pow(dj * dy_km, 2) + pow(di * dx_km, 2) <= pow(radius_km, 2) + 1e-9",
    ),
    "frames_of": (
        "start BIGINT", "horizon STRING, f INT, t0 BIGINT, t1 BIGINT",
        "SELECT horizon, f, first + f * size AS t0, first + (f + 1) * size AS t1 FROM (SELECT 'now' AS horizon, start AS first, 1 AS size, explode(sequence(0, 5)) AS f "
        "UNION ALL SELECT 'mid', (start + 6) DIV 3 * 3, 3, explode(sequence(0, 13)) UNION ALL SELECT 'long', start DIV 24 * 24 + 48, 24, explode(sequence(0, 5)))",
    ),
    "hours_of": ("ends BIGINT, hours INT, amount DOUBLE", "t BIGINT, amount_of_hour DOUBLE", "SELECT explode(sequence(ends - hours + 1, ends)) AS t, amount / hours AS amount_of_hour"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Declares all functions in the session, under names with the prefix; gives their names."""
    for name, (args, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS {result} RETURN {body}")
    for name, (args, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({args}) RETURNS TABLE ({result}) RETURN {body}")
    for name, f in (("csgd_exceed", csgd_exceed), ("csgd_quantile", csgd_quantile)):
        spark.udf.register(prefix + name, f)
    return [prefix + n for n in (*SCALARS, *TABLES, "csgd_exceed", "csgd_quantile")]

