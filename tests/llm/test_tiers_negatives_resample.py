"""Packing by tiers, hard negatives and importance resampling, each held against plain Python on small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import negatives, queries, resample, tiers

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
ODD = [(1, None), (2, ""), (None, "some words without an id"), (None, "some words without an id"), (3, LONG), (3, LONG), (5, "one"), (5, "two  words\n"), (6, " \t\n"), (7, "日本語 <|endoftext|> text"), (-8, "ÆØÅ ½ x² l'été  "), (9, "a" * 300)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "part", "tier", "ids", "found", "noise", "words", "score", "rank", "step")})


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_TOKENIZER))


def rows_of(name, sf=SF):
    return duckdb.sql(f"SELECT * FROM read_parquet('{sf}/{name}.parquet')").fetchall()


def check_pieces(got, docs, tokenizer, how):
    """All tokens are in one piece each, pieces are whole, sequences gapless; gives the tokens of padding."""
    want = collections.Counter()
    for doc, text in docs:
        want[(doc, tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, how.end_id]))] += 1
    seqs, pieces = collections.defaultdict(list), collections.defaultdict(collections.Counter)
    for r in got:
        seqs[r.sequence_id].append(r)
        pieces[r.doc_id][(r.start, r.length, r.ids_crc32, r.doc_tokens)] += 1
    expected = collections.defaultdict(collections.Counter)
    for (doc, ids), n in want.items():
        cuts = sorted({r.start for r in got if r.doc_id == doc and r.doc_tokens == len(ids)} | {len(ids)})
        if sum(k[0] == doc for k in want) == 1 and n == 1:  # one document of this id: its pieces follow from their starts
            for a, b in zip(cuts, cuts[1:]):
                expected[doc][(a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), len(ids))] += 1
            assert pieces[doc] == expected[doc]
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    padding = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.tier == own[0].tier and r.step == own[0].step
            at += r.length
        assert at <= how.tiers[0]
        padding += 0 if at & (at - 1) == 0 else how.tiers[0] - at
    return padding


def test_tiers_hold_every_token_without_padding(spark, tokenizer):
    got = queries.op11_tiers(spark, SF).collect()
    assert check_pieces(got, [(r[0], r[1]) for r in rows_of("documents")], tokenizer, tiers.Tiers()) == 0
    whole = collections.Counter(r.doc_id for r in got if r.doc_tokens <= 2048)
    assert np.mean([n == 1 for n in whole.values()]) > 0.8  # few documents are cut that need not be


def test_tiers_in_several_groups_and_rounds(spark, tokenizer):
    docs = [(r[0], r[1][:400]) for r in rows_of("documents")]
    how = tiers.Tiers(tiers=(128, 64, 32), group=1000, items=3, step=1024)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(16)
    got = tiers.pack(df, queries.tokenizer_path(queries.BYTE_TOKENIZER), how=how).collect()
    assert check_pieces(got, docs, tokenizer, how) == 0
    steps = collections.Counter()
    for r in got:
        steps[r.step] += r.length
    assert max(steps.values()) - min(steps.values()) <= sum(how.tiers)


def test_tiers_odd_rows(spark, odd, tokenizer):
    path = queries.tokenizer_path(queries.BYTE_TOKENIZER)
    assert check_pieces(tiers.pack(odd, path).collect(), ODD, tokenizer, tiers.Tiers()) == 0
    assert tiers.pack(odd.limit(0), path).collect() == []


def test_byte_encoder_equals_the_tokenizer(tokenizer):
    rng, enc = random.Random(5), tiers.Encoder(queries.tokenizer_path(queries.BYTE_TOKENIZER))
    signs = ["a", "Z", "é", "ß", "ſ", "ª", "²", "½", "7", "'s", "'re", "'", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "_", "-", "×", "€", "日", "́", "\x00", "<|", "the", " Straße", "\r\n", "Ŀ", "ƀ"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
        assert enc(text, limit=rng.choice([1, 3, 1 << 20])) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def plain_negatives(rows, how):
    """rows: id -> (label, whole vector, is an anchor)."""
    out = []
    for a, (label, v, asks) in rows.items():
        if not asks:
            continue
        score = {i: sum(x * y for x, y in zip(v, w[1])) for i, w in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][: how.positives]:
            took = [i for i in order if rows[i][0] != label and how.low * score[p] <= how.over * score[i] <= how.over * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(took[: how.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [negatives.Mining(), negatives.Mining(anchors=3, rows=17, chunk=5, together=2, low=30, negatives=3)])
def test_negatives_equal_all_pairs(spark, how):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, how=how).collect()
    rows = {i: (label, [math.floor(256 * x) for x in v], i % 20 == 0) for i, v, label in rows_of("embeddings")}
    assert sorted(map(tuple, got)) == plain_negatives(rows, how)


def test_negatives_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    got = queries.op12_negatives(spark, SF)
    want = con.execute(queries.OP12_SQL).fetchall()
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect())) == sorted(want) and want


def test_negatives_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.integers(-2, 3, 6)] for _ in range(60)]  # many ties
    rows = [(i, v[i % 40], i % 3) for i in range(60)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (102, [float("nan")] * 6, 1), (103, [float("inf")] * 6, 2), (104, v[0], None), (None, v[0], 1), (105, [1.0], 0), (106, [], 0), (107, [1e300] * 6, 0), (3, v[3], 0), (3, v[9], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit(1) for c in ("id", "a", "r", "c", "s", "h", "tile", "rank", "asks")})
    plain = {i: (label, [math.floor(256 * x) for x in vec], i % 10 == 0) for i, vec, label in rows}
    for how in (negatives.Mining(anchors=2, rows=7, chunk=4), negatives.Mining()):
        assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 10 == 0, how=how).collect())) == plain_negatives(plain, how)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(df, F.lit(None).cast("boolean")).collect() == []


def plain_resample(docs, target, how):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % how.buckets for n in range(how.shortest, how.longest + 1) for i in range(len(w) - n + 1)]

    found = [(d, *features(t)) for d, t in docs]
    s, t = collections.Counter(b for _, _, f in found for b in f), collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t, m = sum(s.values()), sum(t.values()), how.buckets
    out = []
    for d, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + m) / ((s[b] + 1) * (big_t + m)))) for b in f)
        h = int(hashlib.sha256(f"{how.seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    enough = sorted((r for r in out if r[4] >= how.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = [*range(1, len(enough) * how.percent // 100 + 1)]
    drawn = [(*r[:4], k) for r, k in zip(enough, rank + [None] * len(enough))]
    return sorted(drawn + [(*r[:4], None) for r in out if r[4] < how.least_words], key=repr)


@pytest.mark.parametrize("how", [resample.Resampling(), resample.Resampling(shortest=1, longest=2, buckets=70_000, percent=50), resample.Resampling(shortest=2, longest=4, buckets=500, least_words=0)])
def test_resampling_equals_plain_python(spark, how):
    docs, target = [(r[0], r[1]) for r in rows_of("documents")], [r[1] for r in rows_of("benchmark")]
    got = resample.resample(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/benchmark.parquet"), how=how)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(docs, target, how)
    if how == resample.Resampling():
        assert sorted(map(tuple, queries.op13_resample(spark, SF).collect()), key=repr) == plain_resample(docs, target, how)


def test_resampling_odd_rows(spark, odd):
    how = resample.Resampling(least_words=1, percent=70)
    target = spark.createDataFrame([("One two words",), (None,), ("",)], "text string")
    got = resample.resample(odd, target, how=how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_resample(ODD, ["One two words", None, ""], how)
    assert resample.resample(odd.limit(0), target).collect() == []
    assert len(resample.resample(odd, target.limit(0)).collect()) == len(ODD)


def test_ring_keeps_states_over_pieces():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["ab", "C", "é", " ", ", ", "9", "\n"]) for _ in range(rng.randrange(40))).encode()
        w = re.findall(rb"[0-9a-z\x80-\xff]+", text.lower())
        assert [x for p in resample.pieces(text, limit=rng.choice([1, 2, 7])) for x in p] == w
        n, h = resample.run_hashes(text, 2, 3)
        assert n == len(w) and sorted(np.concatenate([*h, []]).astype(int)) == sorted(zlib.crc32(b" ".join(w[i : i + k])) for k in (2, 3) for i in range(len(w) - k + 1))
