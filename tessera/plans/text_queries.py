"""Queries that parse what sources publish: pages, JSON, numbers, times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.plans.catalogue import query, table
from tessera.sources import parsers as P


@query("""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<html[^>]*lang="([A-Za-z-]+)', 1) AS lang, len(regexp_extract_all(html, '(?i)<a [^>]*href="[^"]*"')) AS links,
regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""")
def page_attributes(spark: SparkSession, sf: str) -> DataFrame:
    return P.page_attributes(table(spark, sf, "pages"))


@query("""SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS item FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS l FROM pages)""")
def page_list_items(spark: SparkSession, sf: str) -> DataFrame:
    return P.html_items(table(spark, sf, "pages"), "page_id", "html", "li").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_property_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query("""WITH t AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN replace(CAST(p_size AS VARCHAR) || '.5', '.', ',') WHEN 1 THEN '1.' || lpad(CAST(p_size AS VARCHAR), 3, '0') || ',25' WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR) || ' mm' ELSE '-' END AS raw, p_size FROM part)
SELECT k, raw, CASE k % 4 WHEN 0 THEN p_size + CAST(0.5 AS DOUBLE) WHEN 1 THEN 1000 + p_size + CAST(0.25 AS DOUBLE) WHEN 2 THEN CAST(p_size AS DOUBLE) END AS value FROM t""")
def tolerant_numbers(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 4 == 0, F.concat(size, F.lit(",5"))).when(k % 4 == 1, F.concat(F.lit("1."), F.lpad(size, 3, "0"), F.lit(",25"))).when(k % 4 == 2, F.concat(F.lit(" "), size, F.lit(" mm"))).otherwise("-")
    return table(spark, sf, "part").select(k.alias("k"), raw.alias("raw")).withColumn("value", S.parse_number(F.col("raw")))


@query("""SELECT o_orderkey AS k, strftime(o_orderdate, '%d/%m/%Y 10:30') AS raw, CAST(epoch(o_orderdate) AS BIGINT) + 37800 AS seconds FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 06:00'), CAST(epoch(o_orderdate) AS BIGINT) + 21600 FROM orders WHERE o_orderkey % 2 = 1""")
def tolerant_times(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("d"))
    raw = F.when(F.col("k") % 2 == 0, F.concat(F.date_format("d", "dd/MM/yyyy"), F.lit(" 10:30"))).otherwise(F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 06:00")))
    return o.select("k", raw.alias("raw")).withColumn("seconds", F.unix_seconds(S.parse_time(F.col("raw"))))


@query("""SELECT p_partkey AS k, CAST(p_size AS INT) AS hours, p_retailprice AS value FROM part""")
def accumulation_parameters(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Precipitación acumulada en "), F.col("p_size").cast("string"), F.lit(" horas: "), F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(",")), F.lit(" mm"))
    x = S.accumulation_parameter(text)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), x["hours"].alias("hours"), x["value"].alias("value"))


@query("""SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàâäãéèêëíìîïóòôöõúùûüñç', 'aaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents""")
def folded_search_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.fold_text(F.col("text")).alias("key"))


@query("""SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS zone, CASE WHEN s_acctbal < 0 THEN 4 WHEN s_acctbal < 3000 THEN 3 ELSE 2 END AS level, s_acctbal AS mm FROM supplier""")
def warning_messages(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    severity = F.when(F.col("s_acctbal") < 0, "red").when(F.col("s_acctbal") < 3000, "orange").otherwise("yellow")
    xml = F.format_string(
        "<alert><identifier>%s</identifier><sent>2024-01-05T00:00:00</sent><info><event>rain</event><parameter><valueName>level</valueName><value>%s</value></parameter><parameter><valueName>mm</valueName><value>%s</value></parameter><area><geocode>%s</geocode></area></info></alert>",
        F.col("s_suppkey"), severity, F.col("s_acctbal").cast("string"), F.col("s_nationkey"),
    )
    out = P.warnings(s.select(xml.alias("xml")), "xml")
    return out.select(F.col("identifier").cast("long").alias("id"), F.col("zone").cast("long").alias("zone"), "level", F.col("parameters")["mm"].cast("double").alias("mm"))


@query("""SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END) AS BIGINT) AS with_digits FROM documents GROUP BY 1, 2""")
def document_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("text").rlike("[0-9]"), 1).otherwise(0)).alias("with_digits"))


@query("""SELECT label, CAST(i AS BIGINT) AS dim, round(avg(embedding[i + 1]), 5) AS mean, round(max(CAST(embedding[i + 1] AS DOUBLE)), 5) AS top FROM embeddings, range(64) x(i) GROUP BY 1, 2""")
def embedding_profile(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.max(F.col("x").cast("double")), 5).alias("top"))
