"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

Every byte adds to a hash of the last 16 bytes; where its top bits are zero a chunk may end, so the cuts depend on the
content alone and come back after any insertion. A cut too close behind the previous candidate is passed over; a
stretch of more than `longest` bytes without a cut is cut where the hash is least in the later half of what is allowed,
which cuts runs of one repeated word in phase. Cuts move forward to where a character begins. Chunks with equal 128-bit
digests are copies: the one with the least (id, start) is the first and stays. Consecutive copies form a passage, which
counts if it has at least `min_words` words.

Texts are read once, and their chunks shuffled once, by digest. A digest that a third of all documents hold would make
one task of it; therefore a bounded sample of the documents (`sample` of them) tells which digests are frequent, and
chunks of these are dealt to as many groups as they need. The sample decides on the dealing alone: what is a copy and
which place is the first comes from all chunks.

Null and empty texts have no chunks. Rows with a null id take no part. Repeated rows with the same id are copies of
each other at the same place: all are the first, none is a repeat. An empty table gives no passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, as_bytes, durable, fresh, mix, slices

#: Bytes that the rolling hash sees: with 16 doublings the older ones have left a 16-bit value.
REACH = 16
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA0761D6478BD642F)) >> np.uint64(48)).astype(np.uint16)


@dataclass(frozen=True)
class Chunking:
    bits: int = 4
    shortest: int = 16
    longest: int = 128
    min_words: int = 16
    sample: int = 20_000
    hot: int = 1 << 14


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of GEAR of the last 16 bytes, each shifted left by its age."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(data: np.ndarray, chunking: Chunking, limit: int = 1 << 18) -> np.ndarray:
    """Ends of the chunks of one text, its end included."""
    h = np.empty(len(data), np.uint16)
    for _, s, e in slices(np.array([0, len(data)]), REACH - 1, limit):
        # a piece's first bytes lack what came before; the piece before has them
        skip = REACH - 1 if s[0] else 0
        h[s[0] + skip : e[0]] = gear(data[s[0] : e[0]])[skip:]
    at = np.flatnonzero(h >> np.uint16(16 - chunking.bits) == 0) + 1
    at = at[np.diff(at, prepend=0) >= chunking.shortest]
    at = np.append(at[at < len(data)], len(data))
    wide = np.flatnonzero(np.diff(at, prepend=0) > chunking.longest)
    more = []
    for k in wide.tolist():
        start, end = int(at[k - 1]) if k else 0, int(at[k])
        while end - start > chunking.longest:
            # the least hash of the later half; the first such, so that repeated text is cut in phase
            half = start + chunking.longest // 2
            start = half + int(np.argmin(h[half : start + chunking.longest])) + 1
            more.append(start)
    at = np.sort(np.append(at, more).astype(np.int64)) if more else at
    for _ in range(3):  # a character has at most three bytes behind its first
        at = at + (data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80) * (at < len(data))
    return np.unique(at)


@dataclass(frozen=True)
class Frequent:
    """Digests that hold more than their share of chunks, sorted, and over how many groups the chunks of each are dealt."""

    hi: np.ndarray
    lo: np.ndarray
    groups: np.ndarray

    def of(self, digests: np.ndarray) -> np.ndarray:
        """The place of each digest here, or -1."""
        if not len(self.hi):
            return np.full(len(digests), -1)
        at = np.minimum(np.searchsorted(self.hi, digests[:, 0]), len(self.hi) - 1)
        return np.where((self.hi[at] == digests[:, 0]) & (self.lo[at] == digests[:, 1]), at, -1)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, chunking: Chunking, frequent: Frequent | None = None) -> DataFrame:
    """id, start, stop (bytes), words begun, the digest hi, lo of each chunk, and its group (null unless it is frequent)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most `hot` digests

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known = xxhash.xxh3_128_digest, shared.value
        for b in batches:
            data, offsets = as_bytes(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            out, size = [], 0
            for i in range(len(ids)):
                text = data[offsets[i] : offsets[i + 1]]
                if not len(text):
                    continue
                end = cuts(text, chunking)
                start = np.append(0, end[:-1])
                word = WORD[text]
                word[1:] &= ~word[:-1]
                begun = np.append(0, np.cumsum(word, dtype=np.int32))
                raw = text.tobytes()
                digests = b"".join([digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
                out.append((np.full(len(end), ids[i]), start.astype(np.int32), end.astype(np.int32), (begun[end] - begun[start]).astype(np.int32), np.frombuffer(digests, np.int64).reshape(-1, 2)))
                size += len(end)
                if size > 50_000:
                    yield _batch(out, known)
                    out, size = [], 0
            if out:
                yield _batch(out, known)

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, start int, stop int, words int, hi long, lo long, group int")


def _batch(out: list, known: Frequent | None) -> pa.RecordBatch:
    ids, start, stop, words, digests = (np.concatenate(x) for x in zip(*out, strict=True))
    group, plain = np.zeros(len(ids), np.int32), np.ones(len(ids), bool)
    if known is not None and len(known.hi):
        at = known.of(digests)
        plain = at < 0
        spread = mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start.astype(np.uint64)) % known.groups[np.maximum(at, 0)].astype(np.uint64)
        group = spread.astype(np.int32)
    columns = [pa.array(np.ascontiguousarray(x)) for x in (ids, start, stop, words, digests[:, 0], digests[:, 1])]
    return pa.RecordBatch.from_arrays([*columns, pa.array(group, mask=plain)], ["id", "start", "stop", "words", "hi", "lo", "group"])


def frequent_digests(docs: DataFrame, id_col: str, text_col: str, chunking: Chunking) -> Frequent:
    """Digests with at least 1 / hot of a sample's chunks (and ten of them): at most `hot`, whatever the input."""
    n = docs.count()
    share = min(1.0, chunking.sample / max(n, 1))
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = durable(chunk_rows(some, id_col, text_col, chunking).groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n >= 10"))
    total = chunk_total(counted)
    found = counted.where(F.col("n") * chunking.hot >= total).orderBy("hi", "lo").toArrow()
    hi, lo, n_ = (found.column(c).to_numpy() for c in ("hi", "lo", "n"))
    return Frequent(hi, lo, -(-n_ * chunking.hot // max(total, 1)).astype(np.int64))


def chunk_total(counted: DataFrame) -> int:
    return counted.agg(F.sum("n")).first()[0] or 0


def marked_chunks(docs: DataFrame, id_col: str, text_col: str, chunking: Chunking) -> DataFrame:
    """id, start, stop, words, kept (whether it is the first place) of the chunks that occur more than once."""
    rows = chunk_rows(docs, id_col, text_col, chunking, frequent_digests(docs, id_col, text_col, chunking))
    place = F.struct("id", "start")
    same = Window.partitionBy("hi", "lo", "group")
    seen = rows.withColumns({"first": F.min(place).over(same), "last": F.max(place).over(same)})
    # frequent digests stay until their groups have met; of the others, what occurs once goes
    seen = durable(seen.where("group is not null or first <> last").select("id", "start", "stop", "words", "first", "last", *[F.when(F.col("group").isNotNull(), F.col(c)).alias(c) for c in ("hi", "lo")]))
    met = seen.where("hi is not null").groupBy("hi", "lo").agg(F.min("first").alias("least"), F.max("last").alias("most"))
    often = seen.where("hi is not null").join(F.broadcast(met), ["hi", "lo"]).where("least <> most").drop("first").withColumnRenamed("least", "first")
    both = seen.where("hi is null").select("id", "start", "stop", "words", "first").unionByName(often.select("id", "start", "stop", "words", "first"))
    return both.select("id", "start", "stop", "words", (place == F.col("first")).alias("kept"))


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking = Chunking(), repeats_only: bool = False) -> DataFrame:
    """Passages that consist of chunks which occur more than once: doc_id, start, stop (bytes), words, chunks, kept
    (whether it holds a chunk's first place).

    With repeats_only, the passages of chunks whose first place is elsewhere: what deduplication takes out.
    """
    marked = marked_chunks(docs, id_col, text_col, chunking)
    if repeats_only:
        marked = marked.where(~F.col("kept"))
    by_start = Window.partitionBy("id").orderBy("start", "stop")
    begins = (F.col("start") > F.coalesce(F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int")
    runs = marked.distinct().withColumn("run", F.sum(begins).over(by_start))
    out = runs.groupBy("id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("words"), F.count("*").alias("chunks"), F.max("kept").alias("kept"))
    return out.where(F.col("words") >= chunking.min_words).select(F.col("id").alias("doc_id"), "start", "stop", "words", "chunks", "kept")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunking: Chunking = Chunking()) -> DataFrame:
    """docs without their repeated passages; texts of which no word is left go. Other columns stay as they are, whatever
    their names."""
    names = docs.columns
    spans_col, cut_id = fresh("cut_spans", names), fresh("cut_id", names)
    spans = F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(spans_col)
    cut = passages(docs, id_col, text_col, chunking, repeats_only=True).groupBy(F.col("doc_id").alias(cut_id)).agg(spans)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index(text_col)
        for b in batches:
            texts, keep = [], []
            for text, spans in zip(b.column(k), b.column(len(names)), strict=True):
                text = text.as_py()
                if spans.is_valid:
                    raw, parts, at = text.encode(), [], 0
                    for s in spans.as_py():
                        parts.append(raw[at : s["start"]])
                        at = s["stop"]
                    text = b"".join([*parts, raw[at:]]).decode()
                    keep.append(any(c.isalnum() for c in text))
                else:
                    keep.append(True)
                texts.append(text)
            columns = [pa.array(texts, b.column(k).type) if n == k else b.column(n) for n in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    # rows without an id have no passages, and need not meet in one task
    named = docs.where(F.col(id_col).isNotNull()).join(cut, F.col(id_col).cast("long") == F.col(cut_id), "left").drop(cut_id)
    return named.mapInArrow(strip, docs.schema).unionByName(docs.where(F.col(id_col).isNull()))
