"""What networks publish, to rows: HTML, JSON and XML, by native functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_attributes(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", r'(?is)<html[^>]*lang="([A-Za-z-]+)', 1).alias("lang"),
        F.size(F.regexp_extract_all("html", F.lit(r'((?i)<a [^>]*href="[^"]*")'))).cast("long").alias("links"), F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1).alias("host"),
    )


def html_items(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """pos and item of each element of a tag that holds none of its kind."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "item"))


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Cells of table rows: row number and an array of the cells' texts."""
    rows = html_items(pages, key, html, "tr")
    cells = F.regexp_extract_all("item", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return rows.select(key, "pos", F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("cells"))


def embedded_json(pages: DataFrame, key: str, html: str, name: str, schema: str) -> DataFrame:
    """Rows of an array that a page's script assigns to a variable."""
    text = F.regexp_extract(html, rf"(?s)\b{name}\s*=\s*(\[.*?\])\s*;", 1)
    return pages.select(key, F.explode(F.from_json(text, f"array<struct<{schema}>>")).alias("x")).select(key, "x.*")


LEVELS = {"green": 1, "yellow": 2, "orange": 3, "red": 4}


def warnings(messages: DataFrame, xml: str) -> DataFrame:
    """Warnings in the Common Alerting Protocol, one row for each area: identifier, sent, event, level, parameters, zone.
    Messages that are no XML give no row."""
    schema = "identifier string, sent string, info array<struct<event:string,onset:string,expires:string,parameter:array<struct<valueName:string,value:string>>,area:array<struct<areaDesc:string,geocode:string>>>>"
    rows = messages.select(F.from_xml(xml, schema, {"mode": "PERMISSIVE"}).alias("a")).where("a.identifier is not null")
    info = rows.select("a.identifier", "a.sent", F.explode("a.info").alias("i")).select("identifier", "sent", "i.*")
    kinds = F.map_from_entries(F.transform(F.array_distinct("parameter"), lambda p: F.struct(p["valueName"], p["value"])))
    level = F.element_at(F.create_map(*[x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.col("parameters")["level"]))
    parsed = info.withColumn("parameters", kinds).withColumn("level", level).withColumn("area", F.explode("area"))
    return parsed.select("identifier", F.to_timestamp("sent").alias("sent"), "event", F.to_timestamp("onset").alias("onset"), F.to_timestamp("expires").alias("expires"), "level", "parameters", F.col("area.areaDesc").alias("zone_name"), F.col("area.geocode").alias("zone"))


def scaled_integers(df: DataFrame, columns: list[str], factor: float = 10.0, missing: int = 32767) -> DataFrame:
    """Packed integers to numbers; the greatest value means unknown."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(missing)) / factor for c in columns})
