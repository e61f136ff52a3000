"""Importance resampling towards a target corpus, by bucketed runs of words.

A document's words are runs of ASCII letters and digits and of all other characters beyond ASCII, with A-Z as a-z. Its
features are all runs of `shortest` to `longest` consecutive words, joined by a space, repeats counted; a feature's bucket
is its CRC-32 modulo `buckets`. One scan of each text keeps a ring of running CRC states, one for each of the last
`longest` words as a start, and extends each by a space and the next word, so no run is ever put together. The scan writes
a document's buckets; counts of both corpora, gains and weights follow from these, and no text is read twice.

A bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), with s and t its features in the corpus
and in the target, S and T all of them. A document's weight is the sum of its features' gains, its score that weight and
floor(1000 g), with Gumbel noise g from the SHA-256 of `seed:id`. Of the N documents of at least `least_words` words the
floor(N * share) with the highest scores are drawn and ranked, ties to the smaller id.

A null text has no words; weight 0 then. A null id draws its noise from an empty name and comes after all others in ties;
rows with equal or null ids are each a document of their own, and repeated rows are ranked in any order, which gives the
same rows. An empty table gives an empty result, an empty target the gains of a target without features. Other columns, whatever their names, play no part. Texts are scanned in pieces, so only a document's
buckets are held whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import durable

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Resampling:
    """percent: of the documents of at least least_words words, how many are drawn."""

    shortest: int = 1
    longest: int = 1
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 10
    seed: int = 2024


def pieces(text: bytes, limit: int = 1 << 18) -> Iterator[list[bytes]]:
    """The words of consecutive parts of a text; parts end between words."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > limit:
            gap = GAP.search(text, at + limit)
            end = gap.start() if gap else end
        yield WORDS.findall(text[at:end].lower())
        at = end


def run_hashes(text: bytes, shortest: int, longest: int) -> tuple[int, list[np.ndarray]]:
    """The number of words, and the CRC-32 of each run of shortest to longest words."""
    n, out, ring = 0, [], []
    for words in pieces(text):
        n += len(words)
        if longest == 1:  # each state is emitted before it is extended
            found = list(map(crc32, words))
        else:
            found = []
            for w in words:
                tail = b" " + w
                ring = [crc32(tail, state) for state in ring[1 - longest :]]
                ring.append(crc32(w))
                found += ring[: len(ring) - shortest + 1] if len(ring) >= shortest else []
        out.append(np.array(found, np.int64))
    return n, out


def bucketed(docs: DataFrame, id_col: str, text_col: str, how: Resampling) -> DataFrame:
    """doc_id, noise, words, and the buckets of all features as packed 16- or 32-bit numbers, of each row."""
    kind = "<u2" if how.buckets <= 1 << 16 else "<u4"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, found, noise = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                n, hashes = run_hashes(text.as_py() or b"", how.shortest, how.longest)
                words.append(n)
                found.append(b"".join((h % how.buckets).astype(kind).tobytes() for h in hashes))
                h = int(hashlib.sha256(f"{how.seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
                noise.append(math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(noise, pa.int64()), pa.array(words, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "noise", "words", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, noise long, words long, found binary")


def bucket_counts(found: DataFrame, how: Resampling) -> np.ndarray:
    """Features in each bucket. Each task counts its own rows; what comes to the driver is a number for each bucket."""
    kind = "<u2" if how.buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(how.buckets, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.bincount(np.frombuffer(v.as_py(), kind), minlength=how.buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    out = np.zeros(how.buckets, np.int64)
    for r in found.select("found").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    big_s, big_t, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (big_s + m)) / float((s + 1) * (big_t + m)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows with `rank` 1, 2, 3, ... in the order given, null beyond `most`. The rows are dealt by range and sorted; a row's
    rank is its place in its part and the sizes of the parts before it."""
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    laid = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumns({"part__": part, "place__": place})
    sizes = {r["part__"]: r["count"] for r in laid.groupBy("part__").count().collect()}  # a number for each part
    before, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        before.append(F.lit(total).cast("long"))
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*before), F.col("part__") + 1) if before else F.lit(0).cast("long")
    rank = start + F.col("place__") + 1
    return laid.withColumn("rank", F.when(rank <= most, rank)).drop("part__", "place__")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", how: Resampling = Resampling()) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for those not drawn."""
    spark = docs.sparkSession
    found = durable(bucketed(docs, id_col, text_col, how))
    aimed = bucketed(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), "id", "text", how)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(found, how), bucket_counts(aimed, how)))  # a number for each bucket
    kind = np.dtype("<u2" if how.buckets <= 1 << 16 else "<u4")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gain.value[np.frombuffer(v.as_py(), kind)].sum()) for v in b.column(3)]
            n = [len(v.as_py()) // kind.itemsize for v in b.column(3)]
            score = np.array(weight, np.int64) + b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(weight, pa.int64()), pa.array(score)], ["doc_id", "words", "n_features", "weight", "score"])

    rows = durable(found.mapInArrow(weigh, "doc_id long, words long, n_features long, weight long, score long"))
    enough = F.col("words") >= how.least_words
    most = rows.where(enough).count() * how.percent // 100
    # rows that tie in all else are dealt by their place, so that no part gets all of them
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie__")]
    drawn = ranked(rows.where(enough).withColumn("tie__", F.monotonically_increasing_id()), order, most)
    columns = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*columns, "rank").unionByName(rows.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
