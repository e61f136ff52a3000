"""Benchmark decontamination by spaced-seed hashing.

A fixed mask names the positions of a window of words that are hashed; the others may hold anything, so a seed survives
a changed word at an ignored place. Seeds of documents and of test items are joined, and around each hit the two texts
are laid on each other at its diagonal: the best stretch there, with a changed word costing what `1 / (1 - identity)`
equal ones earn, is an overlap if it has enough words and enough of them are equal. The three masks were chosen so that
one of them fits in any 10 words of which 8 are equal, wherever the changed words stand (and so in any longer stretch of
which that share is equal), so none of these is missed.

Words are runs of letters and digits in lower case (a run of over 4,096 bytes counts as several words). Null and empty
texts match nothing. Items of fewer than `min_words` words, and at least `least_words`, match where all of their words
stand in a document in their order, none changed; even shorter items, which any text may hold, match a document that
consists of nothing else. Rows with a null id take no part; repeated rows give the same overlaps once, an item id with
several texts the best overlap of them. Of overlaps with as many equal words the first in the document is reported, then
the first in the item. Texts are taken whole, whatever their length; without documents or items there are no overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import HOT, as_bytes, durable, hashed_words, mix

U = np.uint64


@dataclass(frozen=True)
class Seeds:
    """masks: 1 for a position that counts. reach: words on each side of a hit that are laid on each other. exact: so many
    seeds of items, at most, are sent to all tasks (8 bytes each); of more, a map of bits_per_seed bits each, 2 ** most_bits
    at most, and the join by seed alone tells which hits are real."""

    masks: tuple[str, ...] = ("111101", "1110011", "11010011")
    min_words: int = 10
    least_words: int = 5
    identity: float = 0.8
    reach: int = 80
    bits_per_seed: int = 64
    most_bits: int = 29
    exact: int = 1 << 20


def seed_keys(words: np.ndarray, mask: str, nth: int) -> np.ndarray:
    """One hash for each place at which the whole mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, nth + 1, np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            out *= U(0x9E3779B97F4A7C15)
            out += words[k : k + n]
    return mix(out)


def best_stretch(equal: np.ndarray, identity: float, min_words: int) -> tuple[int, int, int] | None:
    """(start, end, equal words) of the stretch of `min_words` words or more with the greatest sum, equal words counting
    1 - identity, others -identity, or None if all sums are negative: a stretch has that share of equal words if its
    sum is 0 or more. Sums are whole numbers, so that a share of just `identity` counts. The earliest one, if tied."""
    if len(equal) < min_words:
        return None
    share = Fraction(identity).limit_denominator(10_000)
    worth = np.concatenate([[0], np.cumsum(np.where(equal, share.denominator - share.numerator, -share.numerator))])
    gain = worth[min_words:] - np.minimum.accumulate(worth[: len(worth) - min_words])
    last = int(np.argmax(gain))
    if gain[last] < 0:
        return None
    start, end = int(np.argmin(worth[: last + 1])), last + min_words
    return start, end, int(equal[start:end].sum())


HITS = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32())]))
#: The nth mask's hashes differ from all others'; whole items of n words are hashed like a mask after these.
WHOLE = 1000


def whole_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    return seed_keys(words, "1" * n, WHOLE + n)


def alone_key(words: np.ndarray) -> int:
    """A hash of a text that consists of these words alone."""
    return int(whole_keys(words, len(words))[0] ^ U(0xA5A5A5A5A5A5A5A5))


def item_words(items: DataFrame, id_col: str, text_col: str, seeds: Seeds) -> DataFrame:
    """item_id, item (its word hashes as bytes), n (their number, if it is short) and its seeds (key, at)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(pc.utf8_lower(b.column(1)))
            ids, words, short, found = [], [], [], []
            for i, j, first, h, _, _ in hashed_words(data, offsets):
                for r in range(i, j):
                    own = h[first[r - i] : first[r - i + 1]]
                    if not len(own):
                        continue
                    if len(own) >= seeds.min_words:
                        keys = [seed_keys(own, m, k) for k, m in enumerate(seeds.masks)]
                    elif len(own) >= seeds.least_words:
                        keys = [whole_keys(own, len(own))]
                    else:
                        keys = [np.array([alone_key(own)], np.uint64)]
                    ids.append(b.column(0)[r].as_py())
                    words.append(own.tobytes())
                    short.append(len(own) if len(own) < seeds.min_words else None)
                    found.append([{"key": int(x), "at": n} for k in keys for n, x in enumerate(k.view(np.int64))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary()), pa.array(short, pa.int32()), pa.array(found, HITS)], ["item_id", "item", "n", "seeds"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(scan, "item_id long, item binary, n int, seeds array<struct<key:long,at:int>>")


@dataclass(frozen=True)
class Sieve:
    """Which keys items may have: all of them, sorted, or none, and a map of their first bits."""

    keys: np.ndarray | None
    bits: np.ndarray
    down: int

    def may(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys that pass."""
        slot = keys >> U(self.down)
        at = np.flatnonzero(self.bits[slot >> U(6)] >> (slot & U(63)) & U(1))
        if self.keys is None or not len(at):
            return at
        near = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        return at[self.keys[near] == keys[at]]


def sieve(keys: DataFrame, seeds: Seeds) -> tuple[Sieve, int]:
    """The sieve for a table of keys, and their number. At most `exact` keys or 2 ** most_bits bits come to the driver."""
    n = keys.count()
    width = min(seeds.most_bits, max(16, int(np.ceil(np.log2(max(1, n) * seeds.bits_per_seed)))))
    slot = F.shiftrightunsigned("key", 64 - width)
    map64 = keys.select(slot.alias("bit")).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << (width - 6), np.uint64)
    bits[map64.column("w").to_numpy()] = map64.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    known = np.sort(keys.select("key").toArrow().column("key").to_numpy().astype(np.int64).view(np.uint64)) if n <= seeds.exact else None
    return Sieve(known, bits, 64 - width), n


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", seeds: Seeds = Seeds()) -> DataFrame:
    """The best overlap of each document with each item: doc_id, item_id, doc_start, doc_end, item_start, words,
    equal_words (positions in words).

    Documents are read once: what is left of them are the places whose seeds pass a sieve of the items' seeds, with the
    words around them. These alone are joined by seed. Items' seeds are sent to them if they are few; else both sides are
    shuffled, and frequent seeds of documents dealt to several groups, as a phrase may stand in any share of them.
    """
    spark = docs.sparkSession
    items_w = durable(item_words(items, item_id, item_text, seeds).distinct())
    keys = items_w.select("item_id", "item", F.explode("seeds").alias("s")).select("item_id", "item", F.col("s.key").alias("key"), F.col("s.at").alias("at"))
    widths = sorted(r["n"] for r in items_w.where("n is not null").select("n").distinct().collect())  # fewer than min_words
    known, n_keys = sieve(keys.select("key").distinct(), seeds)
    small = max(n_keys, keys.count()) <= seeds.exact
    shared = spark.sparkContext.broadcast(known)
    reach = seeds.reach
    widths = [n for n in widths if n >= seeds.least_words], [n for n in widths if n < seeds.least_words]

    def hits_of(h: np.ndarray, first: np.ndarray, pass_: Sieve) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, row) of what passes in a block, by place."""
        at, key, span = [], [], []
        for x, n in [*((seed_keys(h, m, k), len(m)) for k, m in enumerate(seeds.masks)), *((whole_keys(h, n), n) for n in widths[0])]:
            hit = pass_.may(x)
            at.append(hit)
            key.append(x[hit])
            span.append(np.full(len(hit), n))
        for row in np.flatnonzero(np.isin(np.diff(first), widths[1])) if widths[1] else ():
            x = np.array([alone_key(h[first[row] : first[row + 1]])], np.uint64)
            if len(pass_.may(x)):
                at.append(first[row : row + 1])
                key.append(x)
                span.append(np.diff(first[row : row + 2]))
        at, key, span = np.concatenate(at), np.concatenate(key), np.concatenate(span)
        row = np.searchsorted(first, at, "right") - 1
        inside = at + span <= first[np.minimum(row + 1, len(first) - 1)]
        order = np.argsort(at[inside], kind="stable")
        return at[inside][order], key[inside][order], row[inside][order]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = as_bytes(pc.utf8_lower(b.column(1)))
            ids = b.column(0)
            out: list[tuple] = []
            for i, _, first, h, _, _ in hashed_words(data, offsets):
                at, key, row = hits_of(h, first, shared.value)
                # hits of one row whose surroundings touch share one region
                for own in np.split(np.arange(len(at)), np.flatnonzero((np.diff(row) > 0) | (np.diff(at) > 2 * reach)) + 1):
                    if len(own):
                        r = row[own[0]]
                        lo, hi = max(first[r], at[own[0]] - reach), min(first[r + 1], at[own[-1]] + reach + 1)
                        out.append((ids[i + int(r)].as_py(), int(lo - first[r]), h[lo:hi].tobytes(), [{"key": int(x), "at": int(a)} for x, a in zip(key[own].view(np.int64), at[own] - lo, strict=True)]))
            if out:
                d, lo, words, hits = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(lo, pa.int32()), pa.array(words, pa.binary()), pa.array(hits, HITS)], ["doc_id", "origin", "words", "hits"])

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    regions = durable(rows.mapInArrow(scan, "doc_id long, origin int, words binary, hits array<struct<key:long,at:int>>").withColumn("region", F.monotonically_increasing_id()))
    hits = regions.select("region", F.explode("hits").alias("h")).select("region", F.col("h.key").alias("key"), F.col("h.at").alias("doc_at"))
    if small:
        met = hits.join(F.broadcast(keys.select("key", "at", "item_id", F.xxhash64("item").alias("which"))), "key")
    else:
        # a seed that stands in more than 1 / HOT of all places is dealt to as many groups as that takes; such seeds are few
        each = durable(hits.groupBy("key").agg(F.count("*").alias("rows__")))
        total = each.agg(F.sum("rows__")).first()[0] or 1
        groups = F.ceil(F.col("rows__") * HOT / total).cast("int")
        hot = F.broadcast(each.where(F.col("rows__") * HOT >= total).select("key", groups.alias("deals")))  # HOT rows at most
        deals = F.coalesce("deals", F.lit(1))
        dealt = hits.join(hot, "key", "left").withColumn("deal", F.pmod(F.xxhash64("region", "doc_at"), deals).cast("int")).drop("deals")
        every = keys.select("key", "at", "item_id", F.xxhash64("item").alias("which")).join(hot, "key", "left")
        met = dealt.join(every.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals"), ["key", "deal"])
    diagonals = met.groupBy("region", "item_id", "which").agg(F.collect_set(F.col("doc_at") - F.col("at")).alias("diagonals"))
    texts = items_w.select("item_id", F.xxhash64("item").alias("which"), "item", "n")
    pairs = diagonals.join(regions.select("region", "doc_id", "origin", "words"), "region")
    pairs = pairs.join(F.broadcast(texts) if small else texts, ["item_id", "which"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                words, item = np.frombuffer(r["words"], np.uint64), np.frombuffer(r["item"], np.uint64)
                best = None
                for d in sorted(r["diagonals"]):
                    lo, hi = max(0, d), min(len(words), d + len(item))
                    same = words[lo:hi] == item[lo - d : hi - d]
                    if r["n"] is None:
                        found = best_stretch(same, seeds.identity, seeds.min_words)
                    else:  # a short item: all of it
                        found = (0, len(same), len(same)) if len(same) == len(item) and same.all() else None
                    if found and (best is None or found[-1] > best[-1]):
                        s, e, n = found
                        best = (r["doc_id"], r["item_id"], r["origin"] + lo + s, r["origin"] + lo + e, lo - d + s, e - s, n)
                if best:
                    out.append(best)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 2 else pa.int32()) for k, x in enumerate(zip(*out, strict=True))], ["doc_id", "item_id", "doc_start", "doc_end", "item_start", "words", "equal_words"])

    checked = pairs.select("doc_id", "item_id", "origin", "words", "item", "n", "diagonals").mapInArrow(verify, "doc_id long, item_id long, doc_start int, doc_end int, item_start int, words int, equal_words int")
    best = F.min_by(F.struct("doc_start", "doc_end", "item_start", "words", "equal_words"), F.struct(-F.col("equal_words"), "doc_start", "item_start"))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
