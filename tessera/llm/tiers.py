"""Packing for several context sizes: tiers of windows, whose gaps shorter documents fill, and steps of like size.

Windows have the sizes of `tiers`, powers of two. A document goes to the smallest tier that holds it; what a document has
beyond the longest is cut off in full windows first. Windows are filled from the longest tier down: each takes the longest
document left, then, again and again, the longest shorter one that still fits its gap; the last gap is closed by the first tokens of
the shortest document left, whose rest goes back to its tier. So every window is exactly full, and needs no padding.

Each task packs its documents in groups of bounded size. What is left of a task, less than a window, becomes an item of
the next round, with its tokens; rounds go on in a tree until one group is left, and only there the rest, less than one
window, is cut into powers of two.

Steps: full windows are dealt to steps of about `step` tokens, in the order of their tiers, so that all steps have the same
mix of sizes and differ by one window of each tier at most.

A null or empty text is a document of the end token alone. Rows with null or equal ids are documents of their own; ties of
length go by the order of the rows, and change nothing but which of them is cut. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import durable


@dataclass(frozen=True)
class Tiers:
    """tiers: window sizes, powers of two, in descending order. group: tokens that a task packs at once. items: rests that one
    task of a later round packs. step: tokens of a training step."""

    tiers: tuple[int, ...] = (2048, 1024, 512, 256)
    end_id: int = 1
    group: int = 1 << 21
    items: int = 2048
    step: int = 1 << 16


#: The usual split of byte-level BPE, for texts below U+0180, where all letters, numbers and spaces can be listed.
LETTER, NUMBER, SPACE = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BEYOND = re.compile(r"[^\x00-\u017f]|<\|")
#: Where the split falls before a single space, whatever stands around.
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit numbers, by a byte-level BPE file of `tokenizers`.

    Each distinct word is merged once by the tokenizer's model and kept, in a table of bounded size that lasts as long as
    the Python worker. Texts with characters beyond U+017F, or what may be a special token, go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known: dict[str, bytes] = {}
        # the usual printable stand-ins of byte-level BPE: a byte that is printable stands for itself
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = (x for x in range(256) if x not in shown)
        self.shown = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}

    def word(self, word: str) -> bytes:
        ids = b"".join(t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.shown)))
        if len(self.known) < self.most and len(word) <= 40:
            self.known[word] = ids
        return ids

    def __call__(self, text: str, limit: int = 1 << 20) -> bytes:
        if BEYOND.search(text):
            return b"".join(x.to_bytes(4, "little") for x in self.tokenizer.encode(text, add_special_tokens=False).ids)
        out, at = [], 0
        while at < len(text):  # long texts in parts
            gap = CUT.search(text, at + limit) if len(text) - at > limit else None
            end = gap.start() if gap else len(text)
            out.append(self.part(text[at:end]))
            at = end
        return b"".join(out)

    def part(self, text: str) -> bytes:
        words = SPLIT.findall(text)
        found = list(map(self.known.get, words))
        if None in found:
            found = [self.word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Items by size, and the longest or shortest of a range of sizes at once."""

    def __init__(self, most: int) -> None:
        self.lists: list[list] = [[] for _ in range(most + 1)]
        self.mask = 0  # bit s is set if an item of size s is there

    def put(self, item: tuple) -> None:
        size = len(item[1]) // 4
        self.lists[size].append(item)
        self.mask |= 1 << size

    def take(self, size: int) -> tuple:
        own = self.lists[size]
        item = own.pop()
        if not own:
            self.mask &= ~(1 << size)
        return item

    def longest(self, at_most: int) -> int:
        """The greatest size up to at_most, or 0."""
        return max(0, (self.mask & ((2 << at_most) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1


def windows(pool: Pool, tiers: tuple[int, ...]) -> Iterator[tuple[int, list]]:
    """(size, items) of full windows, while they can be filled; what is left stays in the pool. An item is (document,
    ids, first token, tokens of its document)."""
    left = sum(s * len(x) for s, x in enumerate(pool.lists) if x)
    while pool.mask:
        size = pool.longest(tiers[0])
        tier = min(t for t in tiers if t >= size)
        if left < tier:
            tier = max((t for t in tiers if t <= left), default=0)
            if not tier:
                return
        own, gap = [], tier
        while gap:
            fits = pool.longest(gap)
            if fits:
                item = pool.take(fits)
            else:  # all that is left is longer than the gap: cut the shortest
                doc, ids, start, n = pool.take(pool.shortest())
                pool.put((doc, ids[4 * gap :], start + gap, n))
                item = (doc, ids[: 4 * gap], start, n)
            own.append(item)
            gap -= len(item[1]) // 4
        left -= tier
        yield tier, own


#: A sequence's number: its round, the partition that made it, and its place there. All fit in the 53 bits of a double.
PARTITION, ROUND = 24, 46
ROWS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part long, nth long, ids binary"
NAMES = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)


class Packer:
    """Packs items as they come, in groups; the rest comes last, as rows with ids and without a sequence."""

    def __init__(self, turn: int, how: Tiers) -> None:
        self.how, self.part = how, (turn << ROUND) | (TaskContext.get().partitionId() << PARTITION)
        self.pool, self.tokens, self.made = Pool(how.tiers[0]), 0, 0
        self.nth = dict.fromkeys(how.tiers, 0)
        self.rows: list[tuple] = []

    def full(self, tier: int, items: list) -> None:
        offset = 0
        for doc, ids, start, n in items:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, self.part + self.made, offset, tier, self.part, self.nth.get(tier, 0), None))
            offset += len(ids) // 4
        self.made += 1
        self.nth[tier] = self.nth.get(tier, 0) + 1

    def add(self, doc: int | None, ids: bytes, start: int, n: int) -> Iterator[pa.RecordBatch]:
        top = self.how.tiers[0]
        while len(ids) >= 4 * top:
            self.full(top, [(doc, ids[: 4 * top], start, n)])
            ids, start = ids[4 * top :], start + top
        if ids:
            self.pool.put((doc, ids, start, n))
            self.tokens += len(ids) // 4
        if self.tokens >= self.how.group:
            yield from self.pack()
        yield from self.ready(4096)

    def pack(self) -> Iterator[pa.RecordBatch]:
        for tier, items in windows(self.pool, self.how.tiers):
            self.full(tier, items)
            self.tokens -= tier
            yield from self.ready(4096)

    def ready(self, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield as_batch(self.rows)
            self.rows = []

    def rest(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Packs what is there. What is still left goes out as items, or, at the last, in windows of ever smaller powers of two."""
        yield from self.pack()
        if last:
            small = [1 << k for k in reversed(range(self.how.tiers[-1].bit_length()))]
            for tier, items in windows(self.pool, (*self.how.tiers, *small[1:])):
                self.full(tier, items)
        else:
            for items in self.pool.lists:
                self.rows += [(doc, start, len(ids) // 4, None, n, None, None, None, None, None, ids) for doc, ids, start, n in items]
        yield from self.ready(1)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", how: Tiers = Tiers()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier and step of each piece of each document."""
    end = how.end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), Packer(0, how)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                yield from packer.add(doc.as_py(), ids, 0, len(ids) // 4)
        yield from packer.rest(last=False)

    def again(turn: int, last: bool):
        def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(turn, how)
            for b in batches:
                for row in b.to_pylist():
                    yield from packer.add(row["doc_id"], row["ids"], row["start"], row["doc_tokens"])
            yield from packer.rest(last)

        return more

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    now = durable(rows.mapInArrow(first, ROWS))
    done, turn = [now], 0
    while True:
        turn += 1
        left = now.where("sequence_id is null")
        n = left.count()
        if not n:
            break
        # each task leaves less than its smallest window, so there are fewer items in each round
        groups = -(-n // how.items)
        dealt = left.repartition(groups, F.xxhash64("doc_id", "start", "length", F.lit(turn)))
        now = durable(dealt.mapInArrow(again(turn, groups == 1), ROWS))
        done.append(now)
        if groups == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    pieces = out.where("sequence_id is not null")
    # a sequence's place among all of its tier: those of the parts before it, and its place in its own
    parts = pieces.groupBy("tier", "part").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("tier", "part", F.coalesce(before, F.lit(0)).alias("before"))
    steps = pieces.where("offset = 0").agg(F.coalesce(F.sum("tier"), F.lit(0)).alias("tokens")).first()["tokens"] // how.step or 1
    # in each tier the sequences go round the steps, from where the longer tier stopped
    totals = {r["tier"]: r["n"] for r in parts.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    shift, at = F.lit(0), 0
    for tier in sorted(totals, reverse=True):
        shift, at = F.when(F.col("tier") == tier, F.lit(at)).otherwise(shift), at + totals[tier]
    step = F.pmod(F.col("before") + F.col("nth") + shift, F.lit(steps)).alias("step")
    return pieces.join(starts, ["tier", "part"]).select(*NAMES[:7], "tier", step)
