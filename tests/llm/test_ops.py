"""The registered queries as they are, hot keys without broadcasts, and brute force on small tables."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chunks, common, decontam, graph, langid, licenses, quality, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Nothing is broadcast for being small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    monkeypatch.setattr(common, "MOST_FACTS", 0)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows_of(name):
    return duckdb.sql(f"SELECT * FROM read_parquet('{SF}/{name}.parquet')").fetchall()


def held(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


@pytest.mark.parametrize(("name", "n", "k", "cut", "label"), [("op2_toxicity", 4, 2, 0.3, 2), ("op6_quality", 3, 1, 0.5, 1)])
def test_classifier_queries(spark, name, n, k, cut, label):
    got = queries.queries()[name](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows_of("documents"))
    assert all(r.held_out == held(r.doc_id, n, k) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in got)
    truth = {r[0]: r[label] for r in rows_of("labels")}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert np.mean(right) > (0.9 if label == 2 else 0.8)


def plain_fusion(rows, model, evidence=150.0, host_weight=20.0):
    """id -> (language, that of the text alone, probability). rows: id, text, declared, host."""
    n, seen = len(model.languages), {}
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
    for i, text, declared, host in rows:
        low, total = [fold(b) for b in (text or "").encode()], np.zeros(n + 1)
        for a, b, c in zip(low, low[1:], low[2:]):
            total += model.table[((a << 16 | b << 8 | c) * 0x9E3779B1 % (1 << 32)) >> (32 - langid.BITS)]
        letters = round(total[-1])
        own = np.zeros(n)
        if letters:
            own[int(np.argmax(total[:-1]))] = 1
        tag = re.match(r"\s*([A-Za-z]+)", declared or "")
        domain, suffix = re.search(r"([^.]+\.[^.]+)$", host or ""), re.search(r"\.([^.]+)$", host or "")
        seen[i] = (total[:-1] * (evidence / (letters + evidence)), own, tag and tag[1].lower(), host or None, domain and domain[1], suffix and suffix[1])
    votes = lambda at, name: sum((x[1] for x in seen.values() if x[at] == name), np.zeros(n))
    overall = sum((x[1] for x in seen.values()), np.zeros(n))
    share = (overall + 1) / (overall.sum() + n)
    out = {}
    for i, (log, own, tag, host, domain, suffix) in seen.items():
        up = np.maximum(votes(4, domain) - own, 0) if suffix else np.zeros(n)
        at = np.maximum((votes(3, host) if host else np.zeros(n)) - own, 0)
        prior = (at + host_weight * (up + host_weight * share) / (up.sum() + host_weight)) / (at.sum() + host_weight)
        says = np.ones(n)
        for place, name in ((2, tag), (5, suffix)):
            if name:
                v = votes(place, name) - own
                says = says * np.maximum((v + share) / (v.sum() + 1) / share, 1e-3)
        z = log + np.log(prior) + np.log(says)
        k = int(np.argmax(z))
        out[i] = (model.languages[k], model.languages[int(np.argmax(own))] if own.any() else None, 1 / np.exp(z - z[k]).sum())
    return out


def test_language_equals_the_fusion_by_hand(spark):
    """All evidence of each row, put together in plain Python from the model's table of trigrams."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hosted = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), F.concat(F.lit("h"), (F.col("doc_id") % 11).cast("string"), F.lit(".d"), (F.col("doc_id") % 4).cast("string"), F.when(F.col("doc_id") % 5 == 0, ".de").otherwise(".com")).alias("host"))
    model = langid.train(docs)
    got = {r.id: r for r in langid.identify(hosted, model, "doc_id", F.col("text"), F.col("lang"), F.col("host")).collect()}
    want = plain_fusion([tuple(r) for r in hosted.collect()], model)
    assert set(got) == set(want)
    for i, (lang, text_lang, p) in want.items():
        assert (got[i].lang, got[i].text_lang) == (lang, text_lang) and got[i].probability == pytest.approx(p, abs=1e-6)


def test_nobody_learns_from_held_out_rows(spark):
    docs, labels = queries._learned(spark, SF, 4, 2)
    assert not any(held(r.doc_id, 4, 2) for r in docs.select("doc_id").collect() + labels.select("doc_id").collect())
    lost = spark.createDataFrame([(None, "a")], "doc_id long, text string").select(queries.held_out(4, 2).alias("h")).first()
    assert lost.h is False


def test_toxicity_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc_id, text, *_ in rows_of("documents")[:12]:
        low, found = text.lower(), set()
        for at in range(len(low)):
            h = 0
            for n, c in enumerate(low[at : at + toxicity.LENGTHS[-1]], 1):
                h = (h * 0x01000193 + ord(c) + 1) % (1 << 32) if n > 1 else ord(c) + 1
                if n in toxicity.LENGTHS:
                    y = (h ^ h >> 15) * (0x2C1B3C6D + 2 * n) % (1 << 32)
                    found.add(int(model.chosen[(y ^ y >> 12) >> 32 - toxicity.BITS]))
        z = model.bias + sum(model.weights[f] for f in found if f >= 0)
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_quality_is_fitted_alike_on_stored_texts(spark):
    """Texts that the driver does not hold are read in pieces, and teach the same."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    few = {r.doc_id for r in labels.orderBy("doc_id").limit(24).collect()}
    some = docs.where(F.col("doc_id").isin(list(few)) & (F.length("text") < 2500))
    some = some.unionByName(some.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("")}))
    marks = labels.where(F.col("doc_id").isin(list(few))).unionByName(spark.createDataFrame([(-1, 0, 0)], labels.schema))
    shape = quality.Shape(filters=4, hidden=4)
    nets = [quality.train(some, marks, shape=shape, held=held, together=k) for held, k in ((1 << 26, 1 << 12), (0, 2), (3000, 3))]
    for net in nets[1:]:
        for name in ("table", "bias", "w1", "w2", "b2"):
            assert getattr(net, name) == pytest.approx(getattr(nets[0], name), abs=2e-4)


def test_a_vector_that_many_ids_share_is_found_by_its_least_ids(spark):
    rng = np.random.default_rng(12)
    hot, other = [1.0, 2.0, 3.0], rng.normal(size=(40, 3))
    rows = [(i, hot) for i in range(100, 400)] + [(400 + i, [float(x) for x in v]) for i, v in enumerate(other)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    got = {}
    for r in ann.nearest(df, F.col("vec_id").isin(100, 103, 399)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    first = lambda q: [i for i in range(100, 110) if i != q][:5]
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: first(q) for q in (100, 103, 399)}


def test_quality_scores_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_class=20)
    got = {r.doc_id: r.score for r in quality.score(docs, net).collect()}
    shape = net.shape
    for doc_id, text, *_ in sorted(rows_of("documents"), key=lambda r: len(r[1]))[:3]:
        raw, pooled, at = text.encode(), [], 0
        while True:
            best = np.full(shape.filters, -np.inf)
            for p in range(at, min(at + shape.chunk, max(len(raw), 1))):
                window = [raw[p + j] if p + j < len(raw) else quality.PAD for j in range(shape.width)]
                best = np.maximum(best, sum(net.table[j, b].astype(float) for j, b in enumerate(window)))
            pooled.append(np.maximum(best + net.bias, 0))
            if at + shape.chunk >= len(raw):
                break
            at += shape.chunk - shape.overlap
        z = float(net.logit(np.mean(pooled, axis=0)[None], np.max(pooled, axis=0)[None])[0])
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_language_of_pages(spark):
    """Pages hold articles of documents whose language is known."""
    docs = {" ".join(r[1].split()[:6]): r[2] for r in rows_of("documents") if len(r[1].split()) >= 6}
    truth = {}
    for page, _, html in rows_of("pages"):
        article = re.search(r"(?is)<article\b[^>]*>(.*)</article", html)
        start = " ".join(re.sub(r"<[^>]*>", " ", article.group(1)).split()[:6]) if article else ""
        if start in docs:
            truth[page] = docs[start]
    got = {r.page_id: r for r in queries.op5_language(spark, SF).collect()}
    assert len(got) == len(rows_of("pages")) and len(truth) > 10
    assert np.mean([got[p].lang == lang and got[p].accepted for p, lang in truth.items()]) > 0.97


def test_every_query_reads_its_whole_table(spark):
    n = len(rows_of("documents"))
    assert queries.op10_simhash(spark, SF).count() == n
    assert queries.op8_packing(spark, SF).select("doc_id").distinct().count() == n
    assert queries.op1_ann(spark, SF).count() == 5 * sum(r[0] % 50 == 0 for r in rows_of("embeddings"))
    assert set(queries.op3_decontamination(spark, SF).columns) >= {"doc_id", "item_id"} and set(queries.op7_substrings(spark, SF).columns) >= {"doc_id", "start", "stop"}
    assert queries.op9_licenses(spark, SF).where("containment < 0.8").count() == 0


def test_attach_is_a_left_join(spark, no_broadcast):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"), F.col("id").alias("n"))
    facts = rows.where("k is not null").groupBy("k").agg(F.max("n").alias("top"), F.count("*").alias("rows__")).where("k <> '4'")
    want = rows.join(facts.drop("rows__"), "k", "left").select("k", "n", "top")
    got = common.attach(rows, facts, "k", 9000).select("k", "n", "top")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_components_of_a_large_star(spark, no_broadcast):
    edges = spark.range(1, 5000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.createDataFrame([(9000, 9001), (9001, 9002)], "a long, b long"))
    got = graph.components(edges).groupBy("root").count().collect()
    assert sorted(map(tuple, got)) == [(0, 5000), (9000, 3)]


def test_language_of_a_hot_host(spark, no_broadcast):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    hosted = docs.withColumn("host", F.when(F.col("doc_id") % 3 == 0, "big.example.org").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("h"), F.col("doc_id"), F.lit(".de"))))
    out = langid.identify(hosted, model, "doc_id", F.col("text"), F.col("lang"), F.col("host")).collect()
    truth = {r[0]: r[2] for r in rows_of("documents")}
    assert len(out) == len(truth) and np.mean([r.lang == truth[r.id] for r in out]) > 0.97


def test_passages_of_frequent_digests_equal_those_without_dealing(spark, no_broadcast):
    rng = np.random.default_rng(8)
    w = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    shared = w(40)
    df = spark.createDataFrame([(i, f"{w(30)} {shared} {w(5)}" if i % 3 == 0 else w(40)) for i in range(300)], "doc_id long, text string")
    found = chunks.frequent_digests(df, "doc_id", "text", chunks.Chunking(hot=200))
    assert len(found.hi) and (found.groups >= 1).all()
    dealt = chunks.passages(df, chunking=chunks.Chunking(hot=200)).collect()
    plain = chunks.passages(df, chunking=chunks.Chunking(hot=1)).collect()
    assert sorted(dealt) == sorted(plain) and len(dealt) == 100 and any(r.kept for r in dealt)


def test_cuts_fall_between_characters(spark):
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("aé日😀 "), 4000))
    raw = text.encode()
    ends = chunks.cuts(np.frombuffer(raw, np.uint8), chunks.Chunking())
    assert ends[-1] == len(raw) and (np.diff(ends, prepend=0) > 0).all() and all(e == len(raw) or raw[e] & 0xC0 != 0x80 for e in ends)
    df = spark.createDataFrame([(1, text, "a", 3), (2, text + " and one thing more that is new", "b", 4)], "doc_id long, text string, cut_spans string, cut_id int")
    got = {r.doc_id: r for r in chunks.without_repeats(df).collect()}
    assert got[1].text == text and got[2].cut_spans == "b" and got[2].cut_id == 4 and set(got[2].text) <= set(text + "and one thing more that is new")


def neighbours(rows, asked, k=5):
    best = {}
    for q, u in rows:
        if q in asked:
            for i, v in rows:
                if i != q:
                    a, b = np.array(u) / np.abs(u).max(), np.array(v) / np.abs(v).max()
                    s = a @ b / math.sqrt((a @ a) * (b @ b))
                    best[q, i] = max(best.get((q, i), -2), s)
    out = {}
    for (q, i), s in best.items():
        out.setdefault(q, []).append((-round(s, 12), i))
    return {q: [i for _, i in sorted(x)[:k]] for q, x in out.items()}


def test_neighbours_with_repeated_rows_and_any_scale(spark):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [(7, rows[7][1])] * 5 + [(0, rows[0][1])] * 3  # repeated rows, queries among them
    rows += [(11, rng.normal(size=6).tolist()), (0, rng.normal(size=6).tolist())]  # other vectors of known ids
    rows += [(100 + i, (np.array(rows[i][1]) * s).tolist()) for i, s in ((1, 2.0**660), (2, 2.0**-660), (3, 2.0**1000))]
    rows += [(200 + i, rows[5][1]) for i in range(20)]  # more copies than can be neighbours
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (ann.Search(confidence=0.999999), ann.Search(confidence=0.999999, block=8, node=2, queries=3)):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 5 == 0, search=search).orderBy("query_id", "rank").collect():
            assert math.isfinite(r.score) and r.rank == len(got.get(r.query_id, ())) + 1
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == neighbours(rows, {i for i, _ in rows if i % 5 == 0})


def test_neighbours_recall_with_the_defaults(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = df.collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    got = ann.nearest(df, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set)
    hits = [len(own & set(ids[[i for i in np.argsort(-(u @ u[ids == q][0])) if ids[i] != q][:5]])) for q, own in got.items()]
    assert len(hits) == sum(ids % 50 == 0) and np.mean(hits) / 5 >= 0.9


def test_a_mask_fits_wherever_words_are_changed():
    masks = decontam.Seeds().masks
    assert all("0" in m for m in masks)
    for n in (*range(10, 18), 20):
        for changed in itertools.combinations(range(n), n // 5):
            assert any(all(m[k] == "0" or at + k not in changed for k in range(len(m))) for m in masks for at in range(n - len(m) + 1)), (n, changed)


def test_decontamination_equals_all_stretches(spark):
    """Random changes in short and long items, against every stretch of every diagonal."""
    rng = np.random.default_rng(4)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([*rng.integers(10, 60, 20), 5, 7, 9, 3, 1])]
    docs, want = [], set()
    for d in range(60):
        k = int(rng.integers(0, len(items)))
        own = [w if rng.random() > rng.choice([0, 0.1, 0.2, 0.25]) else f"x{d}{j}" for j, w in enumerate(items[k])]
        docs.append([*(f"n{d}a{j}" for j in range(rng.integers(0, 200))), *own, *(f"n{d}b{j}" for j in range(rng.integers(0, 200)))])
    docs += [items[-1], items[-2], [*items[-1], "more"]]
    for d, words in enumerate(docs):
        for k, item in enumerate(items):
            if len(item) < 5:
                hit = words == item
            elif len(item) < 10:
                hit = any(words[a : a + len(item)] == item for a in range(len(words)))
            else:
                hit = False
                for a in range(-len(item) + 10, len(words) - 9):
                    lo, hi = max(0, a), min(len(words), a + len(item))
                    same = np.array([words[p] == item[p - a] for p in range(lo, hi)])
                    if same.sum() >= 8:
                        total = np.concatenate([[0], np.cumsum(same)])
                        hit |= any(5 * (total[e] - total[s]) >= 4 * (e - s) for s in range(len(same)) for e in range(s + 10, len(same) + 1))
            if hit:
                want.add((d, k))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] * 2, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] * 2, "item_id long, text string")
    for seeds in (decontam.Seeds(), decontam.Seeds(exact=0)):  # with the items' seeds at hand, and by shuffling both sides
        got = [(r.doc_id, r.item_id) for r in decontam.overlaps(d, b, seeds=seeds).collect()]
        assert len(got) == len(set(got)) and set(got) == want


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""


def test_whole_license_texts_name_themselves(spark):
    """The two BSD texts, and those that this machine has."""
    third = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    whole = {"BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(third)}
    for file, name in {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}.items():
        path = Path("/usr/share/common-licenses") / file
        if path.exists():
            whole[name] = path.read_text()
    names = list(whole)
    df = spark.createDataFrame([(k, whole[n]) for k, n in enumerate(names)], "doc_id long, text string")
    got = {(names[r.doc_id], r.license) for r in licenses.scan(df).collect()}
    assert got == {(n, n) for n in names}


def test_licenses_equal_every_window(spark):
    """Against the exact containment of each template in every window of a document as long as it is."""
    names = ("MIT", "Apache-2.0", "MPL-2.0", "Zlib", "CC-BY-4.0", "BSD-3-Clause")
    rng = np.random.default_rng(9)
    rows, want = [], set()
    word = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    lib = {n: licenses.TEMPLATES[n] for n in names}
    for d in range(60):
        n = names[d % len(names)]
        own = word(lib[n][int(rng.integers(0, len(lib[n])))])
        own = [w if rng.random() > 0.015 * (d % 4) else f"q{d}" for w in own]
        text = [*(f"a{d}b{j}" for j in range(rng.integers(0, 60))), *own, *(f"c{d}d{j}" for j in range(rng.integers(0, 60)))]
        rows.append((d, " ".join(text)))
        for name, templates in lib.items():
            for t in templates:
                tw = word(t)
                for part in [tw] if len(tw) <= 32 else [tw[i : i + 32] for i in range(len(tw) - 31)]:
                    g = grams(part)
                    if any(len(g & grams(text[a : a + len(part) + 2])) >= 0.8 * len(g) for a in range(max(1, len(text) - len(part)))):
                        want.add((d, name))
                        break
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=lib).collect()}
    assert found <= want and len(found) >= 0.97 * len(want)


def test_licenses_do_not_depend_on_neighbours():
    text = licenses.TEMPLATES["MIT"][3].split()
    text[10] = text[40] = "gizmo"
    lib, seen = licenses.library(licenses.TEMPLATES), set()
    for shift in range(9):
        data, offsets = common.as_bytes(__import__("pyarrow").array([" ".join(f"f{i}" for i in range(shift)), " ".join(text)]))
        for _, _, first, w, _, _ in common.hashed_words(data, offsets):
            seen.add(tuple((s, e, share) for row, _, s, e, share in licenses.find(w, first, lib, 0.5) if row == 1))
    assert len(seen) == 1


def test_a_license_across_pieces_of_a_long_text(spark):
    filler = [f"f{i % 50_000}" for i in range((1 << 16) - 20)]
    d = spark.createDataFrame([(1, " ".join([*filler, licenses.TEMPLATES["MIT"][3], *filler[:2000]]))], "doc_id long, text string")
    got = licenses.scan(d).collect()
    assert [(r.license, r.containment) for r in got] == [("MIT", 1.0)] and abs(got[0].start - len(filler)) <= 8  # windows go by steps of 8


def test_conversation_of_a_third_of_all_turns(spark, no_broadcast):
    turns = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("s"), F.col("id") % 2).alias("role"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    from tessera.llm import chat

    rows = chat.perspectives(turns).collect()
    big = {r.perspective: r for r in rows if r.conv_id == 1}
    assert len(rows) == 2 + 1999 - (1 if 1 % 3 == 0 else 0) or len(big) == 2
    assert big["s0"].n_turns == 1001 and "".join(big["s0"].text[s.start : s.stop] for s in big["s0"].spans) == "".join(f"t{i}<|im_end|>" for i in range(0, 3000, 6))


def test_near_duplicates_of_one_huge_group(spark, no_broadcast):
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(words) if i % 3 else " ".join(words[:-1] + [f"z{i}"] * 40)) for i in range(900)], "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert {r.component_id for r in got if r.doc_id % 3} == {1} and len(got) == 900
