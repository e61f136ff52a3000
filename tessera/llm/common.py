"""Helpers shared by the corpus operators: shared storage, text blocks in numpy, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import forget  # noqa: F401  (the corpus modules take these from here)
from tessera.sources.storage import durable, durable_folder  # noqa: F401

#: Bytes of text that one numpy pass handles, so that its arrays stay in cache.
BLOCK = 1 << 18
U = np.uint64


def small_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Keeps the batches that Python functions get small for what the session runs from now on, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """y, text, h and id_ of at most per_class labelled ids of each class, those with the least hashes, and how many labels
    each class has in all. The ids are chosen from the labels alone; being at most 2 * per_class, they are broadcast, so
    that no text but the sample's is moved. Repeated labels count once; of an id's rows, the one with the least text is
    taken, so that there are no more rows than ids."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(label_col).cast("int").alias("y"), F.xxhash64(id_col).alias("h")).distinct()
    count = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == k).orderBy("h", "id_").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(ids, "id_").groupBy("id_", "y", "h").agg(F.min("text").alias("text")).select("y", "text", "h", "id_"), count


#: A key is hot if it holds at least 1 / HOT of all rows: whatever the input, there are at most HOT hot keys.
HOT = 4096
#: Facts that may be broadcast whole: some 6 MB.
MOST_FACTS = 1 << 16


def attach(rows: DataFrame, facts: DataFrame, key: str, total: int, size: str = "rows__") -> DataFrame:
    """rows left-joined with facts, which has one row for each value of `key`, and in `size` how many of the `total` rows
    have it. `size` is left out.

    Few facts are broadcast, after they are counted. More meet their rows by a shuffle in which no group holds more than
    about 1 / HOT of all rows: rows of hot keys (at most HOT, so these are broadcast) are dealt to several groups, and so
    are rows without a key."""
    if facts.count() <= MOST_FACTS:
        return rows.join(F.broadcast(facts.drop(size)), key, "left")
    groups = F.ceil(F.col(size) * HOT / total).cast("int")
    hot = F.broadcast(facts.where(F.col(size) * HOT >= total).select(key, groups.alias("groups__")))
    dealt = F.xxhash64(*[c for c in rows.columns if c != key], F.spark_partition_id())
    group = F.when(F.col(key).isNull(), F.pmod(dealt, F.lit(HOT))).otherwise(F.coalesce(F.pmod(dealt, "groups__"), F.lit(0))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col(size) * HOT >= total, groups).otherwise(1) - 1))
    left = rows.join(hot, key, "left").withColumn("group__", group).drop("groups__")
    return left.join(facts.withColumn("group__", every).drop(size), [key, "group__"], "left").drop("group__")


#: Ids that may be broadcast: 16 MB of longs.
MOST_IDS = 1 << 20


def select_ids(rows: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi- or anti-join of rows with a table of distinct ids. Few ids are broadcast, after their number is known, so that
    texts are not moved; more are joined by a shuffle."""
    ids = durable(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, id_col, how)


def fresh(name: str, taken: list[str]) -> str:
    """name, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * np.dtype(width).itemsize) if len(column) else np.zeros(1, width)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of consecutive rows with at most `limit` bytes; a longer row comes alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def slices(offsets: np.ndarray, overlap: int, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, starts, ends) of contiguous pieces of text. A row over the limit comes in pieces that overlap, so that
    each of its windows of overlap + 1 bytes lies in one piece."""
    for i, j in row_blocks(offsets, limit):
        if offsets[j] - offsets[i] <= limit + overlap:
            yield np.arange(i, j), offsets[i:j], offsets[i + 1 : j + 1]
        else:
            for s in range(int(offsets[i]), int(offsets[j]), limit):
                yield np.array([i]), np.array([s]), np.array([min(s + limit + overlap, int(offsets[j]))])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: ASCII letters and digits, and all bytes of other characters, belong to words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LONGEST_WORD = 1 << 12
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_CODE = mix(_LOWER.astype(np.uint64) + U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, base in ((up, _BASE), (down, pow(_BASE, -1, 1 << 64))):
        out[0] = 1
        k = 1
        while k < n:  # doubling: the second half is the first half times base ** k
            m = min(k, n - k)
            out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
            k += m
    return up, down


_UP, _DOWN = _powers(BLOCK + (1 << 12))


def _words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one block; a word never crosses a break."""
    global _UP, _DOWN
    if len(data) >= len(_UP):
        _UP, _DOWN = _powers(len(data) + (1 << 12))
    inside = WORD[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    starts[breaks] = inside[breaks]
    ends[breaks - 1] = inside[breaks - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    if len(s) and (e - s).max() > LONGEST_WORD:
        n = -(-(e - s) // LONGEST_WORD)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s, last = np.repeat(s, n) + nth * LONGEST_WORD, np.repeat(e, n)
        e = np.minimum(s + LONGEST_WORD, last)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODE[data] * _UP[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * _DOWN[s] + (e - s).astype(np.uint64)), s, e


def hashed_words(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of whole rows: (first row, row after the last, first word of each row and the end, hashes, starts, ends).

    Words are runs of letters and digits with A-Z as a-z, in pieces of LONGEST_WORD bytes at most; starts and ends are
    bytes of `data`.
    """
    for i, j in row_blocks(offsets, limit):
        lo, hi = int(offsets[i]), int(offsets[j])
        parts = []
        while lo < hi or not parts:
            end = hi
            if hi - lo > limit + LONGEST_WORD:  # one long row: cut it where a word ends, or would be cut anyway
                end = lo + limit
                gap = np.flatnonzero(~WORD[data[end : end + LONGEST_WORD]])
                if len(gap):
                    end += int(gap[0])
                else:
                    before = np.flatnonzero(~WORD[data[lo:end]])
                    word = lo + int(before[-1]) + 1 if len(before) else lo
                    end = word - (word - end) // LONGEST_WORD * LONGEST_WORD
            h, s, e = _words(data[lo:end], offsets[i : j + 1] - lo)
            parts.append((h, s + lo, e + lo))
            lo = end
        h, s, e = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]
        yield i, j, np.searchsorted(s, offsets[i : j + 1]), h, s, e


def gram_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hashes of all runs of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * U(0x9E3779B97F4A7C15) + words[k : k + n]
    return mix(out)
