"""From raw documents to packed sequences: five stages, each of which reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunks, decontam, langid, packing, simhash
from tessera.llm.common import durable, durable_folder, forget, fresh, select_ids, small_batches, table
from tessera.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the evidence settles. `lang` is what the document declares, `source` its host.

    A row whose id is null cannot be judged by id and stays. An id whose rows are judged differently stays, if one of them
    is accepted."""
    small_batches(spark)
    model = langid.train(docs)
    judged = langid.identify(docs.where("doc_id is not null"), model, "doc_id", F.col("text"), F.col("lang"), F.col("source"), address_suffix=False)
    rejected = judged.groupBy("id").agg(F.max("accepted").alias("any")).where(~F.col("any")).select(F.col("id").alias("doc_id"))
    return select_ids(docs, rejected, "doc_id", "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates one row: of the least id, and where several rows have it, of the least
    fingerprint, then of the text that sorts first (then of the other columns). So of rows with the same id and different texts each stays, unless it
    has a near duplicate. Rows with a null id belong to no group and stay. An empty table stays empty; other columns stay as they are."""
    small_batches(spark)
    rows = durable(simhash.members(docs).where("id is not null"))
    least = F.min(F.struct("id", "fp")).alias("s")
    kept = durable(rows.where(F.col("id") == F.col("component_id")).groupBy("root").agg(least).select(F.col("s.id").alias("doc_id"), F.col("s.fp").alias("fp")))
    ids = durable(rows.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n")))
    # rows of ids that stand for several rows are told apart by fingerprint and text; no other text is moved for it
    several = ids.where("n > 1").select("doc_id")
    gone = ids.join(kept, "doc_id", "left_anti").select("doc_id").unionByName(several).distinct()
    plain = select_ids(docs, gone, "doc_id", "left_anti").select(docs.columns)
    fp, row = fresh("fp__", docs.columns), fresh("row__", docs.columns)
    mixed = select_ids(docs, several, "doc_id", "left_semi").withColumn(fp, simhash.fingerprint_of(F.col("text").cast("string")))
    # the first row of each id and fingerprint: each task keeps one before rows are shuffled, however often an id is repeated
    first = F.min(F.struct("text", *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])).alias(row)
    mixed = mixed.groupBy("doc_id", fp).agg(first).join(kept.withColumnRenamed("fp", fp), ["doc_id", fp], "left_semi")
    return plain.unionByName(mixed.select(*[F.col(c) if c == "doc_id" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns]))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out, but for the first of each; documents of which no word is left go. n_chars follows the
    text. Rows with a null id or text stay as they are; of an id with several rows the passages of all are taken out of each. An
    empty table stays empty; other columns stay as they are."""
    small_batches(spark)
    out = chunks.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out documents that hold a passage of a benchmark item. Rows with a null id cannot be named and stay; of
    an id with several rows all go. An empty table stays empty; other columns stay as they are."""
    small_batches(spark)
    hit = decontam.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return select_ids(docs, hit, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents, those with a null id or text included, into sequences of at most 2,048 tokens. Rows
    with equal ids are documents of their own; an empty table gives no sequences."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("decontamination", decontamination), ("packing", pack)]

#: SQL cannot express the hashes, models and tokenizers of these stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next has written its own."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{durable_folder(spark)}/pipeline-{uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            forget(spark, before)
        before = f"{folder}/{name}"
    return docs
