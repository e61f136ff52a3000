"""The corpus operators against plain Python on small tables, and what they do with odd rows."""

from __future__ import annotations

import collections
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import ann, chat, chunks, decontam, graph, langid, licenses, packing, quality, queries, simhash, toxicity
from tessera.llm.common import as_bytes, hashed_words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(120_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, null and repeated ids, copies, a very long text, and columns named like internal ones."""
    rows = [(1, None, "en", "s"), (2, "", "en", None), (None, "some words without an id", None, "s"), (3, LONG, "en", "s"), (4, LONG, "en", "s"), (5, "one", "fr", "s"), (5, "one", "fr", "s"), (6, "  \t\n", "de", "s")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("id", "fp", "h", "y", "start", "words", "cell", "id_", "text__", "label", "score")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def plain_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    ids, label = list(fps), {i: i for i in fps}
    for i in ids:
        for j in ids:
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    return label


def test_simhash_equals_all_pairs(docs, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    label = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", label[i]) for i in texts}


def test_simhash_links_across_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    fps = np.concatenate([base, *(base ^ np.uint64((1 << a) | (1 << b)) for a, b in ((3, 40), (9, 63), (40, 41)))])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").distinct()
    root = {r.node: r.root for r in graph.components(simhash.links(df, 3, tile=50)).collect()}
    want = plain_components({int(x): int(x) & (2**64 - 1) for x in np.unique(fps).view(np.int64)})
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert [g for g in groups(want) if len(g) > 1] == groups(root)


def test_simhash_odd_rows(odd, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == 8
    by = collections.defaultdict(set)
    for d, f, c in got:
        by[d].add((f, c))
    assert by[1] == by[2] == by[6] == {("0" * 16, 1)}
    assert {c for _, c in by[4]} == {3} and next(iter(by[3]))[0] == f"{plain_fingerprint(LONG):016x}"
    assert [c for _, c in by[None]] == [None] and len(by[5]) == 1
    assert simhash.near_duplicates(none).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 101)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    t = ["Abc def  abc-DEF éa", "", "def", "x" * 5000 + " def"]
    data, offsets = as_bytes(pa.array(t))
    found = []
    for limit in (8, 1 << 18):
        found.append([h[first[k] : first[k + 1]].tolist() for _, _, first, h, _, _ in hashed_words(data, offsets, limit) for k in range(len(first) - 1)])
    assert found[0] == found[1]
    a, b, c = found[0][0][:3]
    assert a == c and found[0][0][3] == b == found[0][2][0] and found[0][1] == []


def test_packing_is_whole_and_tight(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack(docs, queries.tokenizer_path(), packing=packing.Packing(group=50)).toPandas()
    total = 0
    for i, own in out.groupby("doc_id"):
        ids = np.array([*tok.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert list(own.sort_values("piece")[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert set(out.doc_id) == set(texts)
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        ends = (own.offset + own.length).tolist()
        assert own.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    assert out.sequence_id.nunique() <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("text", ["Hello World's  it's 12 a1b2", "naïve Ärger ÉTÉ ŒUVRE €5 «q»", "日本語 テキスト", "a\u00a0b\u2028c", "x\x0by\x1cz", "İstanbul ΣΑΣ", "e\u0301a <|endoftext|> b", "😀😀 !!!???", "x" * 500])
def test_encoder_equals_the_tokenizer(text):
    e = packing.encoder(queries.tokenizer_path())
    assert e(text.encode()).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(odd, none):
    out = packing.pack(odd, queries.tokenizer_path()).toPandas()
    assert out[out.doc_id.isin([1, 2, 6])].length.tolist() == [1, 1, 1] and (out.doc_id == 5).sum() == 2 and out.doc_id.isna().sum() == 1
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, n = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert n == 2 and bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def plain_chunks(texts, conf):
    out = {}
    for i, t in texts.items():
        raw, at = t.encode(), 0
        for e in chunks.cuts(np.frombuffer(raw, np.uint8), conf).tolist() if raw else []:
            out.setdefault(raw[at:e], []).append((i, at))
            at = e
        assert at == len(raw)
    return out


def test_chunks_equal_plain_python(docs, texts):
    conf = chunks.Chunking()
    repeated = {(p[0], p[1], p[1] + len(c)): p == min(ps) for c, ps in plain_chunks(texts, conf).items() if len(ps) > 1 for p in ps}
    cover = collections.defaultdict(set)
    for (i, s, e), _ in repeated.items():
        cover[i].update(range(s, e))
    rows = chunks.passages(docs, chunking=conf).collect()
    for r in rows:
        assert set(range(r.start, r.stop)) <= cover[r.doc_id] and r.words >= conf.min_words
        assert not {r.start - 1, r.stop} & cover[r.doc_id]
    none_short = chunks.passages(docs, chunking=chunks.Chunking(min_words=0)).collect()
    assert {(r.doc_id, k) for r in none_short for k in range(r.start, r.stop)} == {(i, k) for i, ks in cover.items() for k in ks}


def test_chunks_survive_insertions():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    conf = chunks.Chunking()
    a, b = (chunks.cuts(np.frombuffer(x, np.uint8), conf) for x in (body, b"inserted" + body))
    assert len(set(a + 8) & set(b)) > 0.97 * len(a)
    same = [chunks.cuts(np.frombuffer(body, np.uint8), conf, limit).tolist() for limit in (64, 1000, 1 << 18)]
    assert same[0] == same[1] == same[2]


def test_repeats_are_cut_once(spark):
    rng = np.random.default_rng(5)
    w = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    shared, a, b = w(80), w(60), w(60)
    df = spark.createDataFrame([(1, f"{a} {shared}", "x"), (2, f"{shared} {b}", "x"), (3, shared, "x"), (None, shared, "x"), (4, None, "x")], "doc_id long, text string, hi string")
    got = {r.doc_id: r.text for r in chunks.without_repeats(df).collect()}
    assert got[1] == f"{a} {shared}" and got[None] == shared and got[4] is None
    assert b in got[2] and len(got[2]) < len(b) + 120
    assert len(got.get(3, "")) < 120


def test_chunks_odd_rows(odd, none):
    rows = chunks.passages(odd).collect()
    assert {r.doc_id for r in rows} == {3, 4} and {r.kept for r in rows if r.doc_id == 4} <= {True, False}
    assert chunks.passages(none).count() == 0 and chunks.without_repeats(none).count() == 0


def test_decontamination(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    tok = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    index = collections.defaultdict(set)
    for i, t in items.items():
        w = tok(t)
        for k in range(len(w) - 9):
            index[tuple(w[k : k + 10])].add(i)
    want = {(d, i) for d, t in texts.items() for w in [tok(t)] for k in range(len(w) - 9) for i in index.get(tuple(w[k : k + 10]), ())}
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert want and got == want


def test_decontamination_stands_substitutions(spark, odd, none):
    w = [f"tok{i}" for i in range(40)]
    changed = [x if i % 7 else f"other{i}" for i, x in enumerate(w)]
    noise = [f"n{i}" for i in range(300)]
    d = spark.createDataFrame([(1, " ".join([*noise, *changed, *noise])), (2, " ".join(w[:8])), (3, " ".join(noise)), (None, " ".join(w))], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(w)), (8, "too short to tell"), (7, None)], "item_id long, text string")
    r = decontam.overlaps(d, b).collect()
    assert [(x.doc_id, x.item_id, x.doc_start, x.doc_end, x.equal_words) for x in r] == [(1, 9, 301, 335, 30)]
    assert decontam.overlaps(odd, b).count() == 0 and decontam.overlaps(none, b).count() == 0 and decontam.overlaps(d, b.limit(0)).count() == 0


def test_best_stretch_equals_all_stretches():
    rng = np.random.default_rng(3)
    for n in [*range(8, 41)] * 12:
        equal = rng.random(n) < rng.choice([0.6, 0.75, 0.8, 0.85, 0.9])
        fit = [(5 * int(equal[s:e].sum()) - 4 * (e - s), s, e) for s in range(n) for e in range(s + 10, n + 1) if 5 * int(equal[s:e].sum()) >= 4 * (e - s)]
        got = decontam.best_stretch(equal, 0.8, 10)
        assert (got is None) == (not fit)
        if got:
            s, e, same = got
            assert e - s >= 10 and same == equal[s:e].sum() and 5 * same - 4 * (e - s) == max(fit)[0]


def test_decontamination_at_the_bounds_of_its_rule(spark):
    """Four words of five are equal all along; and an item of 16 words, whose purest run is shorter than 10."""
    w, v, noise = [f"tok{i}" for i in range(40)], [f"item{i}" for i in range(16)], [f"n{i}" for i in range(30)]
    fifth = [x if i % 5 != 4 else f"other{i}" for i, x in enumerate(w)]
    short = [x if i not in (3, 12) else f"other{i}" for i, x in enumerate(v)]
    less = [x if i not in (3, 7, 11) else f"other{i}" for i, x in enumerate(v)]
    d = spark.createDataFrame([(k, " ".join([*noise, *x, *noise])) for k, x in enumerate([fifth, short, less])], "doc_id long, text string")
    b = spark.createDataFrame([(9, " ".join(w)), (8, " ".join(v))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.overlaps(d, b).collect()}
    assert {(0, 9), (1, 8)} <= got


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    cur = con.execute(queries.OP4_SQL)
    names = [d[0] for d in cur.description]
    got = queries.op4_chat(spark, SF).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_chat_masks(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 300, None, "x"), (None, 1, "ann", "lost"), (2, 0, "system", "alone")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.perspective, r.segment) for r in out} == {(1, p, 0) for p in ("ann", "bob", "unknown")}
    ann_ = next(r for r in out if r.perspective == "ann")
    assert ann_.text == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi <\u200b|im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nx<|im_end|>\n"
    last = next(r for r in out if r.perspective == "unknown")
    assert [last.text[s.start : s.stop] for s in last.spans] == ["x<|im_end|>"] and last.n_turns == 4
    parts = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), per_segment=256).collect()
    assert {(r.conv_id, r.perspective, r.segment) for r in parts} == {(1, p, s) for p in ("ann", "bob", "unknown") for s in (0, 1)}
    assert "".join(r.text for r in sorted(parts, key=lambda r: r.segment) if r.perspective == "ann") == ann_.text
    assert [ann_.text[s.start : s.stop] for s in ann_.spans] == ["hi <\u200b|im_end|><|im_end|>"]
    plan = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_language_fuses_evidence(spark, docs):
    model = langid.train(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs, model, "doc_id", F.col("text"), F.col("lang"), F.col("source"), address_suffix=False).collect()
    assert len(got) == len(truth) and np.mean([r.text_lang == truth[r.id] for r in got]) > 0.97 and np.mean([r.accepted for r in got]) > 0.97
    rows = [(k, "the and of", "de", "http://a.de/") for k in range(40)] + [(100, "", "de", "http://a.de/x"), (101, "", None, None)]
    de = docs.where("lang = 'de'").select("text").limit(40).collect()
    rows = [(k, de[k % len(de)].text, d, u) for k, (_, _, d, u) in enumerate(rows[:40])] + rows[40:]
    out = {r.id: r for r in langid.identify(spark.createDataFrame(rows, "k long, t string, d string, u string"), model, "k", F.col("t"), F.col("d"), langid.host_of(F.col("u"))).collect()}
    assert out[100].lang == "de" and out[100].probability > 0.9 and not out[100].accepted and out[3].accepted


def test_language_odd_rows(spark, odd, none, docs):
    model = langid.train(docs)
    assert langid.identify(odd, model, "doc_id", F.col("text"), F.col("lang"), F.col("source")).count() == 8
    assert langid.identify(none, model, "doc_id", F.col("text")).count() == 0
    empty = langid.train(none)
    assert [(r.lang, r.accepted) for r in langid.identify(odd, empty, "doc_id", F.col("text")).collect()] == [(None, True)] * 8


def test_classifiers_learn(spark, docs):
    words = {0: "calm river stone garden winter", 1: "vile rotten filth garden winter"}
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(rng.permutation((words[k % 3 == 0] + " plain text of many words " * 3).split())), int(k % 3 == 0)) for k in range(600)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows[:400]], "doc_id long, toxic int")
    held = {r.doc_id: r.score for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    assert np.mean([(held[k] >= 0.3) == bool(y) for k, _, y in rows[400:]]) > 0.98
    net = quality.train(d, lab.withColumnRenamed("toxic", "quality"), per_class=150)
    got = {r.doc_id: r.score for r in quality.score(d, net).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, _, y in rows[400:]]) > 0.95


def test_classifiers_odd_rows(spark, docs, odd, none):
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    tox, net = toxicity.train(docs, lab), quality.train(docs, lab, per_class=40)
    for out in (toxicity.score(odd, tox), quality.score(odd, net)):
        got = out.collect()
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, tox).count() == quality.score(none, net).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.train(docs, lab.limit(0))).collect()} == {0.5}
    assert {r.score for r in quality.score(odd, quality.train(docs, lab.where("quality = 1"))).collect()} == {1.0}


def test_quality_chunks_cover_the_text():
    shape = quality.Shape()
    for n in (0, 1, 255, 256, 257, 5000):
        row, start = quality.chunk_starts(np.array([n]), shape)
        seen = {k for s in start for k in range(s, min(s + shape.chunk, n))}
        assert len(row) >= 1 and seen == set(range(n))


def test_quality_gradient():
    shape = quality.Shape(width=3, filters=4, hidden=5, chunk=32, overlap=8)
    rng = np.random.default_rng(0)
    groups = [rng.integers(0, 256, 60, dtype=np.uint8) for _ in range(60)]
    y = np.arange(60) % 2
    for g, t in zip(groups, y, strict=True):
        if t:
            g[40:43] = (200, 201, 202)
    net = quality.fit([g.tobytes() for g in groups], y.astype(float), shape, epochs=30)
    p = net.scores(pa.array([g.tobytes() for g in groups], pa.binary()))
    assert np.mean((p > 0.5) == y) > 0.95


def test_licenses(spark, docs, texts, odd, none):
    want = {i for i, t in texts.items() if re.search("icensed under|the MIT License", t)}
    assert {r.doc_id for r in licenses.scan(docs).collect()} == want
    mit = licenses.TEMPLATES["MIT"][3].split()
    mit[20] = "gizmo"
    filler = " ".join(f"f{i}" for i in range(500))
    d = spark.createDataFrame([(1, f"{filler} {' '.join(mit)} {filler}"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, filler), (4, "the license of the general public")], "doc_id long, text string")
    got = {(r.doc_id, r.license) for r in licenses.scan(d).collect()}
    assert got == {(1, "MIT"), (2, "GPL-3.0")}
    assert licenses.scan(odd).count() == 0 and licenses.scan(none).count() == 0


def test_license_headers_that_differ_by_a_word(spark):
    rows = []
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "ISC"):
        for shift in range(8):
            noise = [f"f{i}" for i in range(30 + shift)]
            rows.append((len(rows), name, " ".join([*noise, licenses.TEMPLATES[name][-1], *noise])))
    d = spark.createDataFrame(rows, "doc_id long, name string, text string")
    assert {(r.doc_id, r.license) for r in licenses.scan(d).collect()} == {(i, n) for i, n, _ in rows}


def test_license_bands_keep_their_promise():
    rng = np.random.default_rng(0)
    hit = 0
    for _ in range(300):
        a = rng.integers(0, 2**63, 30, dtype=np.uint64)
        b = a.copy()
        b[:8] = rng.integers(0, 2**63, 8, dtype=np.uint64)  # Jaccard similarity 22 / 38 = 0.58
        x, y = (licenses.bands(next(iter(licenses.minima(v, (32,))))[1], 32) for v in (a, b))
        hit += bool((x == y).any())
    assert hit >= 0.97 * 300


def exact_neighbours(ids, x, q, k=5):
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    s = u @ u[q]
    order = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != ids[q]][:k]
    return ids[order].tolist(), s[order]


def test_neighbours_recall_and_order(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = ann.nearest(df, F.col("vec_id") % 50 == 0, search=ann.Search(block=64, node=16)).toPandas()
    hit = total = 0
    for q, own in out.groupby("query_id"):
        own = own.sort_values("rank")
        want, _ = exact_neighbours(ids, x, int(np.flatnonzero(ids == q)[0]))
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.is_monotonic_decreasing
        hit, total = hit + len(set(want) & set(own.vec_id)), total + 5
    assert total == 5 * len([i for i in ids if i % 50 == 0]) and hit / total >= 0.9


def test_neighbours_odd_rows(spark):
    v = [[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 0.0], None, [1.0, None, 0.0], [float("nan"), 1.0, 1.0], [1.0, 1.0], [float("inf"), 0.0, 0.0]]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v)] + [(None, [1.0, 1.0, 1.0], 1)], "vec_id long, embedding array<float>, id int")
    got = ann.nearest(df, F.col("vec_id") >= 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 1), (0, 2), (0, 3), (1, 0), (1, 2), (1, 3), (2, 0), (2, 1), (2, 3), (3, 0), (3, 1), (3, 2)]
    assert ann.nearest(df.limit(0), F.col("vec_id") >= 0).count() == 0
    assert ann.chi_square_cdf(ann.chi_square_quantile(0.9)) == pytest.approx(0.9)


def test_few_candidates_are_all_found(spark):
    """Nothing is tested away while fewer than k neighbours are known, however strict the test."""
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 0.0]), (2, [0.0, -1.0, 0.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") >= 0, search=ann.Search(confidence=0.001)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_copies_beyond_a_block_tie_by_id(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)] + [(i, rng.normal(size=4).tolist()) for i in range(400, 600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 100, search=ann.Search(block=32, node=8)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as P

    now, sizes = docs, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        now = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(now.count())
    assert sizes[0] >= 0.97 * docs.count() and sizes == sorted(sizes, reverse=True)
    packed = P.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]
    fps = {r.doc_id: plain_fingerprint(r.text) for r in P.near_duplicates(spark, docs, SF).collect()}
    assert len(set(plain_components(fps).values())) == len(fps)


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline as P

    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    # 5: a copy of a smaller id's text and one of its own; 6: two of its own, one twice; 7: a copy and a text of 6
    rows = [(2, a), (5, a), (5, b), (6, c), (6, e), (6, e), (7, e), (7, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(2, a), (5, b), (6, c), (6, e), (None, a)], key=str)


def test_pipeline_odd_rows(spark, none):
    import corpus_pipeline as P

    text = " ".join(f"plain{i} words" for i in range(40))
    rows = [(1, None, "en", "s", 0), (None, "no id at all", None, None, 12), (2, text, "en", "s", len(text)), (2, text, "en", "s", len(text)), (3, "", None, "s", 0), (4, LONG, "en", "s", len(LONG))]
    now = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("fp__", "cut_spans", "cut_id", "id", "nth__", "fp", "n")})
    by_stage = {}
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF)
        by_stage[name] = sorted(((r.doc_id, (r.text or "")[:12]) for r in now.collect()), key=str)
    # nothing without letters, one copy of 2 after the second stage; nothing else is lost
    start = [(2, "plain0 words"), (4, LONG[:12]), (None, "no id at all")]
    assert by_stage["language"] == [start[0], *start] and by_stage["near_duplicates"] == by_stage["substrings"] == by_stage["decontamination"] == start
    packed = P.STAGES[-1][1](spark, now, SF).collect()
    assert {r.doc_id for r in packed} == {2, 4, None}
    now = none
    for _, stage in P.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
