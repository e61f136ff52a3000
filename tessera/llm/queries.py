"""One query for each operator of this package, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, chat, chunks, decontam, langid, licenses, negatives, packing, quality, resample, simhash, tiers, toxicity
from tessera.llm.common import table

#: A path that every machine has; the file is not part of this repository.
TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(n: int, held: int, id_col: str = "doc_id") -> Column:
    """Whether a row is not learned from. A row without an id has no label to learn: it is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n == held, F.lit(False))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _learned(spark: SparkSession, sf_dir: str, n: int, held: int) -> tuple[DataFrame, DataFrame]:
    """The documents and the labels that may be learned from."""
    return table(spark, sf_dir, "documents").where(~held_out(n, held)), table(spark, sf_dir, "labels").where(~held_out(n, held))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(*_learned(spark, sf_dir, 4, 2))
    scored = toxicity.score(table(spark, sf_dir, "documents"), model, keep={"held_out": held_out(4, 2)})
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return out.withColumn("spans", spans)


OP4_SQL = """
WITH plain AS (
  SELECT DISTINCT conv_id, turn, coalesce(nullif(role, ''), 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
turns AS (
  SELECT *, CAST(0 AS BIGINT) AS segment, replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' AS body FROM plain),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM plain WHERE role <> 'system'),
seen AS (
  SELECT r.*, s.perspective, r.role = s.perspective AS mine,
    '<|im_start|>' || CASE WHEN r.role = s.perspective THEN 'assistant' WHEN r.role = 'system' THEN 'system'
      ELSE 'user name=' || replace(r.role, '<|', '<' || chr(8203) || '|') END || chr(10) AS head
  FROM turns r JOIN speakers s ON r.conv_id = s.conv_id),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, segment ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS place FROM seen)
SELECT conv_id, perspective, segment, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(place AS VARCHAR) || '-' || CAST(place + length(body) AS VARCHAR), ',' ORDER BY place) FILTER (WHERE mine), '') AS spans,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) AS n_learned
FROM placed GROUP BY conv_id, perspective, segment
"""


def page_text(html: Column) -> Column:
    """All text of a page, without scripts, styles, comments, tags and character references."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#A-Za-z0-9]+;", " ")


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = langid.train(table(spark, sf_dir, "documents"))
    out = langid.identify(pages, model, "page_id", page_text(F.col("html")), markup_language(F.col("html")), langid.host_of(F.col("url")))
    return out.withColumnRenamed("id", "page_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(*_learned(spark, sf_dir, 3, 1))
    scored = quality.score(table(spark, sf_dir, "documents"), model, keep={"held_out": held_out(3, 1)})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.passages(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)


OP12_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ann, op2_toxicity, op3_decontamination, op4_chat, op5_language, op6_quality, op7_substrings, op8_packing, op9_licenses, op10_simhash, op11_tiers, op12_negatives, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL, "op12_negatives": OP12_SQL}
