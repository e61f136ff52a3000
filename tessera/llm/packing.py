"""Best-fit packing of tokenised documents into sequences of bounded length, in a tree of residual rounds.

Each partition packs its own pieces, largest first, each into the fullest sequence that has room. Sequences that are
nearly full are final. The others become items of the next round: groups of them, of bounded size, are packed again in
the same way, until one group is left or a round no longer saves anything worth while.

A null text counts as empty: a document of the end token alone. Rows with a null or repeated id are packed like all
others. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import durable


@dataclass(frozen=True)
class Packing:
    """nearly: sequences with at most this much room are final. group: items that one task packs at once."""

    capacity: int = 2048
    end_id: int = 0
    nearly: int = 2
    group: int = 40_000
    least_gain: float = 0.002


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: best fit in order of decreasing size."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    room, n = 0, 0  # room: bit r is set if a bin with r left is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = room >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                room &= ~(1 << left)
        else:
            b, left, n = n, capacity, n + 1
        bins[i], offsets[i] = b, capacity - left
        left -= size
        if left:
            open_bins[left].append(b)
            room |= 1 << left
    return bins, offsets, n


ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """Token ids of whole texts by a byte-level BPE file of `tokenizers` that drops white space.

    What stands between white space is encoded on its own, so each distinct piece is encoded once and kept, in tables of
    bounded size that last as long as the Python worker. Pieces of ASCII or Latin letters are lower-cased and split here
    and only merged by the tokenizer's model; all others go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.chunks: dict[bytes, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.most = most
        self.number = list(range(self.tokenizer.get_vocab_size()))  # one object for each id, however many words hold it
        # the usual printable stand-ins of byte-level BPE: a byte that is printable stands for itself
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = (x for x in range(256) if x not in set(shown))
        self.shown = {x: chr(x) for x in shown} | {x: chr(256 + k) for k, x in enumerate(hidden)}

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
            ids = tuple(self.number[t.id] for t in self.model.tokenize(seen))
            if len(self.words) < self.most // 2:
                self.words[word] = ids
        return ids

    def chunk(self, raw: bytes) -> tuple[int, ...]:
        text = raw.decode(errors="replace")
        if len(raw) > 200 or not text.isprintable() or "<|" in text:
            ids = tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)
        elif text.isascii():
            ids = tuple(x for w in ASCII_WORDS.findall(text.lower()) for x in self.word(w))
        elif max(text) < "\u0180" and "\u0130" not in text and unicodedata.is_normalized("NFC", text):
            ids = tuple(x for w in LATIN_WORDS.findall(text.lower()) for x in self.word(w))
        else:
            ids = tuple(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(self.chunks) < self.most and len(raw) <= 40:
            self.chunks[raw] = ids
        return ids

    def __call__(self, text: bytes) -> np.ndarray:
        parts = text.split()
        found = list(map(self.chunks.get, parts))
        if None in found:
            found = [self.chunk(p) if ids is None else ids for p, ids in zip(parts, found, strict=True)]
        return np.fromiter(chain.from_iterable(found), np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: A sequence's number: its turn, the partition that made it, and its place there. All fit in the 53 bits of a double.
PARTITION, TURN = 24, 46
BIN = "bin long, used int, pieces array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
PIECES = pa.list_(pa.struct([(f, pa.int32() if f == "piece" else pa.int64()) for f in FIELDS]))


def bins_batch(base: int, members: np.ndarray, bins: np.ndarray, used: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of BIN: `members` orders the pieces by their bin."""
    ends = np.append(0, np.cumsum(np.bincount(bins, minlength=len(used))))
    struct = pa.StructArray.from_arrays([pa.array(c[members].astype(np.int32 if f == "piece" else np.int64)) for c, f in zip(columns, FIELDS, strict=True)], list(FIELDS))
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), struct)
    return pa.RecordBatch.from_arrays([pa.array(base + np.arange(len(used), dtype=np.int64)), pa.array(used.astype(np.int32)), lists.cast(PIECES)], ["bin", "used", "pieces"])


def packed(base: int, sizes: np.ndarray, owner: np.ndarray, columns: list[np.ndarray], capacity: int) -> pa.RecordBatch:
    """Pack items, each of the pieces that name it as `owner`, and shift the pieces to their new places."""
    bins, offsets, n = best_fit(sizes, capacity)
    columns = [*columns[:-1], columns[-1] + offsets[owner]]
    own = bins[owner]
    order = np.lexsort((columns[-1], own))
    return bins_batch(base, order, own, np.bincount(bins, sizes, minlength=n), columns)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", packing: Packing = Packing()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each document."""
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        base = TaskContext.get().partitionId() << PARTITION
        rows: list[tuple] = []
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            for doc, text in zip(b.column(0).to_pylist(), texts, strict=True):
                ids = np.append(encode(text.as_py() or b""), np.uint32(packing.end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), packing.capacity)):
                    part = ids[at : at + packing.capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), 0))
            if len(rows) >= packing.group:
                out = first_batch(base, rows)
                base += len(out)
                rows = []
                yield out
        if rows:
            yield first_batch(base, rows)

    def first_batch(base: int, rows: list[tuple]) -> pa.RecordBatch:
        # a null id would not fit in numpy: ids stay in arrow, and numpy packs their places
        columns = [np.array(c, np.int64) for c in list(zip(*rows, strict=True))[1:]]
        out = packed(base, columns[2], np.arange(len(rows)), [np.arange(len(rows)), *columns], packing.capacity)
        return with_ids(out, pa.array([r[0] for r in rows], pa.int64()))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << PARTITION
        parts = list(batches)
        if not sum(len(b) for b in parts):
            return
        held = pa.Table.from_batches(parts).combine_chunks().sort_by("bin")
        lists = held["pieces"].combine_chunks()
        flat = lists.flatten()
        columns = [np.arange(len(flat)), *(flat.field(f).to_numpy(zero_copy_only=False) for f in FIELDS[1:])]
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        yield with_ids(packed(base, held["used"].to_numpy(), owner, columns, packing.capacity), flat.field("doc_id"))

    def with_ids(out: pa.RecordBatch, ids: pa.Array) -> pa.RecordBatch:
        lists = out.column(2)
        values = lists.values
        named = pa.StructArray.from_arrays([ids.take(values.field("doc_id")), *(values.field(f) for f in FIELDS[1:])], list(FIELDS))
        return pa.RecordBatch.from_arrays([out.column(0), out.column(1), pa.ListArray.from_arrays(lists.offsets, named).cast(PIECES)], out.schema.names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    now = durable(rows.mapInArrow(first, BIN))
    done: list[DataFrame] = []
    last = None
    for turn in range(64):
        loose = F.col("used") < packing.capacity - packing.nearly
        open_bins = now.where(loose)
        n = open_bins.count()
        done.append(now.where(~loose).withColumn("turn", F.lit(turn)))
        gained = last is None or n < last[0] * (1 - packing.least_gain)
        if n < 2 or (last and (last[1] == 1 or not gained)):
            done.append(open_bins.withColumn("turn", F.lit(turn)))
            break
        groups = -(-n // packing.group)
        last = (n, groups)
        # turn is part of the hash, so that bins which did not fit each other meet others
        dealt = open_bins.repartition(groups, F.xxhash64("bin", F.lit(turn)))
        now = durable(dealt.mapInArrow(again, BIN))
    else:
        done.append(now.withColumn("turn", F.lit(64)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    piece = F.explode("pieces").alias("p")
    return out.select((F.col("turn").cast("long") * (1 << TURN) + F.col("bin")).alias("sequence_id"), piece).select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
