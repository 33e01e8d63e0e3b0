"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latticeworks.llm import bpe, components, decontaminate, jaccard, quality, secret_scan, suffix, token_counts, trigram_query
from latticeworks.llm.common import tokenizer_path

from .conftest import words


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# BPE


def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def encoded(tok, t):
    ids = tok.encode(t or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tok.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize(("long", "leaf", "far_leaf"), [(bpe.LONG, bpe.LEAF, bpe.FAR_LEAF), (300, 2, 40)])
def test_bpe_equals_the_library(docs, texts, long, leaf, far_leaf):
    tok = library(bpe.VOCABULARY)
    got = bpe.encode(docs, long=long, leaf=leaf, far_leaf=far_leaf).collect()
    assert ordered(got) == ordered((i, *encoded(tok, t)) for i, t in texts)


def test_bpe_tree_on_unsplit_text():
    tok, r = library(bpe.VOCABULARY), random.Random(2)
    for alphabet in ("ab", "theing", "é!a1'", "日本"):
        for _ in range(40):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(1, 300)))
            assert bpe.encode_text(t, leaf=4) == tok.encode(t, add_special_tokens=False).ids


def test_bpe_tree_on_table_texts():
    tok, rows = library(bpe.VOCABULARY), pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    c, trees = bpe.Codec(bpe.VOCABULARY), []
    symbols, c.tree = c.tree, lambda p: trees.append(len(p)) or symbols(p)
    for t, (ids, decoded) in zip(rows, c.texts(rows), strict=True):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded.decode() == tok.decode(want, skip_special_tokens=False)
    assert sum(n > bpe.LEAF for n in trees) > 10  # pieces that were halved


def test_a_worker_forgets(monkeypatch):
    tok, c, r = library(bpe.VOCABULARY), bpe.Codec(bpe.VOCABULARY), random.Random(14)
    monkeypatch.setattr(bpe, "REMEMBER", 2000)
    for _ in range(60):
        t = " ".join("".join(r.choice("abcé日") for _ in range(r.randint(1, 9))) for _ in range(12))
        assert np.frombuffer(next(c.texts([t]))[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids
        assert len(c.known) + len(c.older) < 40


def test_bpe_keeps_columns_and_round_trips(docs, nothing):
    t = bpe.with_tokens(docs)
    assert t.columns == [*docs.columns, "_tokens"] and t.count() == docs.count()
    assert bpe.encode(nothing).count() == 0 and bpe.with_tokens(nothing).count() == 0
    r = t.where("doc_id = 203").first()
    assert r["_tokens"]["decoded"] == "one</w>"
    i = bpe.with_ids(docs)
    assert i.columns == [*docs.columns, "_tokens"]
    same = t.select(F.col("_tokens.ids").alias("x"), F.sha2("_tokens.decoded", 256).alias("y")).collect()
    assert ordered(same) == ordered(i.select("_tokens.ids", "_tokens.decoded_sha256").collect())


# Token counts


def test_counts_equal_the_library(docs, texts, nothing):
    tok = library(token_counts.VOCABULARY)
    want = []
    for i, t in texts:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert ordered(token_counts.count(docs).collect()) == ordered(want)
    assert token_counts.count(nothing).count() == 0


def test_every_prefix_is_exact():
    tok, c, r = library(token_counts.VOCABULARY), token_counts.counter(token_counts.VOCABULARY), random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "'s", "'re", "'ll", "é", "1", "!", "\xa0", "日", " the", "ing"]
    for _ in range(200):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        table = c.table(t)
        assert table[-1] == c.total(t)
        for i in range(len(t) + 1):
            assert table[len(t[:i].encode())] == len(tok.encode(t[:i], add_special_tokens=False).ids), (t, t[:i])


def test_budgets_are_answered_from_the_table(spark):
    t = "hello world, this is a text of some words"
    df = spark.createDataFrame([(t,)], "text string").select(token_counts.prefix_table(F.col("text")).alias("p"))
    n = df.select(token_counts.fitting_bytes(F.col("p"), 4).alias("n")).first()["n"]
    tok = library(token_counts.VOCABULARY)
    assert len(tok.encode(t[:n]).ids) <= 4 and all(len(tok.encode(t[:m]).ids) > 4 for m in range(n + 1, len(t) + 1))


# Jaccard


def similar(texts):
    """n_shingles and component of each row, by comparing all pairs of sets."""
    sets = []
    for i, t in texts:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    kinds = sorted({s for _, s in sets if s}, key=repr)
    part = list(range(len(kinds)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            both = len(kinds[a] & kinds[b])
            if 100 * both >= 80 * (len(kinds[a]) + len(kinds[b]) - both):
                part[find(a)] = find(b)
    at = {s: k for k, s in enumerate(kinds)}
    ids = defaultdict(set)
    for i, s in sets:
        if s and i is not None:
            ids[find(at[s])].add(i)
    return [(i, len(s), min(ids[find(at[s])], default=None) if s else i) for i, s in sets]


#: As in production; every key combined in its slice; no star, so that all that is shared is torn and compared whole.
WAYS = [{}, {"local": 2}, {"rounds": 0}, {"rounds": 0, "local": 2, "block": 2500}]


@pytest.mark.parametrize("way", WAYS[1::2])
def test_components_equal_brute_force(docs, texts, way):
    got = jaccard.join(docs, **way).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(got) == ordered(similar(texts))


def chains(r):
    """Texts of shared boilerplate, short ones, chains of small changes and texts at the very limit, some without id."""
    rows, n = [], 0
    plate = [f"p{k}" for k in range(60)]
    for k in range(30):
        own = [f"o{k}_{j}" for j in range(r.choice([1, 2, 5, 10, 20, 40]))]
        rows.append((n + k, " ".join(plate + own if k % 2 else own + plate)))
    n += 30
    x = [f"c{j}" for j in range(50)]
    for k in range(25):
        x = list(x)
        x[r.randrange(50)] = f"d{k}"
        rows.append((n + k if k % 5 else None, " ".join(x)))
    n += 25
    for k in range(60):
        rows.append((n + k, " ".join(r.choice("abcd") for _ in range(r.randint(1, 12)))))
    n += 60
    for size in (20, 45, 90):  # 9 shared of 10 and the like: the share is 0.8 exactly, or just below
        words_ = [f"s{size}_{j}" for j in range(size + 4)]
        for cut in range(0, size // 4 + 3):
            rows.append((n, " ".join(words_[: len(words_) - cut])))
            n += 1
    return rows


@pytest.mark.parametrize("way", WAYS[::2])
def test_chains_and_boilerplate(spark, way):
    rows = chains(random.Random(21))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ids, pairs = linked_classes(rows)
    got = jaccard.join(d, **way).collect()
    assert ordered((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == ordered(similar(rows))
    want = {i: sum(s in p for p in pairs) for s, v in ids.items() for i in v if i is not None}
    assert len(pairs) > 60 and {x["doc_id"]: x["n_links"] for x in got if x["doc_id"] is not None} == want


def linked_classes(texts):
    """Distinct sets with an id, each with the ids of its rows, and all pairs of them that link."""
    ids = defaultdict(list)
    for i, t in texts:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        if w:
            ids[frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))].append(i)
    kinds = list(ids)
    pairs = [(a, b) for k, a in enumerate(kinds) for b in kinds[:k] if 100 * len(a & b) >= 80 * len(a | b)]
    return ids, pairs


@pytest.mark.parametrize("block", [2500])
def test_no_link_is_lost(spark, texts, block):
    r = random.Random(12)
    base = [f"w{r.randrange(1000)}" for _ in range(160)]
    near = []
    for k in range(40):
        x = list(base)
        for _ in range(r.randint(1, 2)):
            x[r.randrange(len(x))] = f"y{k}"
        near.append((1000 + k, " ".join(x)))
    rows = [*[x for x in texts if x[0] != 0], *near, (1100, near[0][1]), (None, near[1][1] + " z")]
    ids, pairs = linked_classes(rows)
    assert len(pairs) > 300
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    least = {s: min((i for i in v if i is not None), default=None) for s, v in ids.items()}
    got = jaccard.links(d, block=block).collect()
    assert sorted((sorted(x, key=repr) for x in got), key=repr) == sorted((sorted((least[a], least[b]), key=repr) for a, b in pairs), key=repr)
    want = ordered((i, least[s], sum(s in p for p in pairs)) for s, v in ids.items() for i in v)
    found = jaccard.join(d, block=block).where("n_shingles > 0").select("doc_id", "class_id", "n_links").collect()
    assert ordered(found) == want


def test_boilerplate_brings_few_together(spark, monkeypatch):
    plate = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(plate + [f"o{k}_{j}" for j in range(60)])) for k in range(60)]
    rows += [(100 + k, t + " z") for k, t in rows[::2]]
    largest, met = [], jaccard.met

    def watched(rows, cls, part, what, *block):
        if what == "span":
            largest.append(max(r["count"] for r in part.groupBy("root").count().collect()))
        return met(rows, cls, part, what, *block)

    monkeypatch.setattr(jaccard, "met", watched)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0).collect()
    assert ordered((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == ordered(similar(rows))
    assert largest == [2]


def test_deduplication_sends_no_text_to_many_blocks(spark, monkeypatch):
    plate = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join(plate + [f"o{k}_{j}" for j in range(60)])) for k in range(30)]
    rows += [(100 + k, t + " z") for k, t in rows]
    sizes, met = [], jaccard.met

    def watched(rows, cls, part, what, *block):
        sizes.extend(r["count"] for r in part.groupBy("root").count().collect())
        return met(rows, cls, part, what, *block)

    monkeypatch.setattr(jaccard, "met", watched)
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    kept = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(30)) and sizes == [2] * 30


def test_deduplication_moves_no_text(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 20)
    r = random.Random(3)
    rows = [(k, words(r, 60)) for k in range(40)]
    kept = jaccard.deduplicate(spark.createDataFrame(rows + [(100 + k, t) for k, t in rows[:10]], "doc_id long, text string"))
    assert "hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(kept.collect()) == sorted(rows)


def test_rows_that_share_an_id_are_told_apart(spark):
    r = random.Random(4)
    a, b, c, d = (words(r, 30) for _ in range(4))
    rows = [(1, a), (1, a.upper()), (1, b), (2, a), (2, c), (3, c), (None, d), (None, d.upper()), (None, d), (None, ""), (None, None), (1, " "), (4, ""), (4, "")]
    got = jaccard.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(1, a.upper()), (1, b), (2, c), (None, d.upper()), (None, ""), (None, None), (1, " "), (4, ""), (4, "")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_frequent_shingles_are_bounded(spark):
    rows = [(k, jaccard.class_of(jaccard.shingles(t)), k, t) for k, t in ((k, " ".join(["a b c d e f g h i"] * (k > 3) + [f"x{k % 9}"] * 7 + [f"y{k}"])) for k in range(60))]
    d = spark.createDataFrame(rows, "rk long, cls long, root long, text string")
    half, times = jaccard.frequent(d)
    assert (np.diff(half.astype(np.int64)) > 0).all() and times.max() == 56 and times.min() >= jaccard.OFTEN
    few, often = jaccard.frequent(d, 6)
    assert 0 < len(few) <= 6 and often.min() >= 32 and len(jaccard.frequent(d, 0)[0]) == 0
    known = dict(zip(half.tolist(), times.tolist(), strict=True))
    for _, _, _, t in rows[::7]:
        s = jaccard.shingles(t).tolist()
        want = sorted(s, key=lambda h: (known.get(h >> 32, 0), h))[: len(s) - -(-len(s) * 4 // 5) + 1]
        assert jaccard.rarest(np.array(s, np.uint64), half, times).tolist() == want


def test_keys_are_let_out_in_slices(monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 500)
    r = random.Random(41)
    t = [words(r, 80) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(200), pa.int64()), pa.array(range(200), pa.int64()), pa.array(t), pa.nulls(200, pa.int64()), pa.nulls(200, pa.list_(pa.int32()))], names=["id", "rk", "text", "cls", "bands"]
    )
    out = list(jaccard._keyed(8, 1, 8)(iter([batch])))
    keys = [sum(len(k) for k in b["k"].to_pylist()) // 8 for b in out if b["kind"][0].as_py() == jaccard.KEYS]
    assert max(keys) < 700 and sum(b.num_rows for b in out if b["kind"][0].as_py() == jaccard.CLASS) == 200
    assert sum(keys) == sum(len(jaccard.keys_of(jaccard.shingles(x), n, d)[0]) for x in t for n, d in jaccard.bands_of(len(jaccard.shingles(x))))


def test_shared_counts_what_two_sets_have_in_common():
    r = np.random.default_rng(4)
    x, y = ([np.unique(r.integers(0, 4000, r.integers(1, 900))).astype(np.uint64) for _ in range(n)] for n in (30, 70))
    x += [np.union1d(s, np.arange(5000, 5300, dtype=np.uint64)) for s in x[:20]]
    y += [np.union1d(s, np.arange(5000, 5300, dtype=np.uint64)) for s in y[:20]]
    assert jaccard.shared(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_one_of_each_group_stays(docs, texts):
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    want = [i for i, n, c in similar(texts) if n == 0]
    want += sorted({c for i, n, c in similar(texts) if n})
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=repr) == sorted(want, key=repr)


def test_jaccard_of_nothing(nothing):
    assert jaccard.join(nothing).count() == 0 and jaccard.deduplicate(nothing).count() == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(5)
    for _ in range(50):
        both, a, b = (np.unique(r.integers(0, 1 << 63, r.integers(0, n), dtype=np.int64)).astype(np.uint64) for n in (900, 200, 700))
        x, y = np.union1d(both, a), np.union1d(both, b)
        if len(x) and len(y):
            assert jaccard.distances([jaccard.sketch(x)], [jaccard.sketch(y)])[0] <= len(np.setxor1d(x, y))


def test_bands_hold_every_pair_that_can_link():
    for a in range(1, 400):
        for b in range(a, (a * 5) // 4 + 1):
            d = (a + b) // 9
            assert any(x[0] == y[0] and x[1] >= d for x in jaccard.bands(a) for y in jaccard.bands(b))


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_of_links(spark, few):
    r = random.Random(13)
    pairs = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = components.components(spark.createDataFrame(pairs, "a long, b long"), few).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in up)


# Quality


def test_quality_learns_and_holds_out(spark):
    r = random.Random(6)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        w = ["".join(r.choice("aeiourstnl") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 120))]
        rows.append((i, " ".join(w) if good else " ".join(x + "###" for x in w), int(good)))
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in rows], "doc_id long, quality int, toxic int")
    got = quality.classify(d, quality.fit(d, labels)).collect()
    held = [(x["score"], rows[x["doc_id"]][2]) for x in got if x["held_out"]]
    assert 40 < len(held) < 140 and sum((s >= 0.3) == bool(y) for s, y in held) / len(held) > 0.95


def test_quality_of_odd_rows(docs, spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, none)
    assert {r["score"] for r in quality.classify(docs, net).collect()} == {0.5}
    net = quality.new_net()
    got = quality.classify(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.keep(docs, net, 0.0).columns == docs.columns and quality.classify(nothing, net).count() == 0


def plainly(net, text):
    """The network's score of a text, filter by filter."""
    raw = [*text, *[256] * (-len(text) % quality.HALF)]
    raw += [256] * max(0, quality.CHUNK - len(raw))
    features = []
    for lo in range(0, len(raw) - quality.HALF, quality.HALF):
        chunk = raw[lo : lo + quality.CHUNK]
        top = [0.0] * quality.FILTERS
        for g in range(0, quality.CHUNK - quality.GROUP, quality.GROUP):
            a, b = (np.concatenate([net.embed[c] for c in chunk[g + k : g + k + quality.GROUP]]) for k in (0, quality.GROUP))
            for f in range(quality.FILTERS):
                top[f] = max(top[f], float(a @ net.conv_a[:, f] + b @ net.conv_b[:, f] + net.bias[f]))
        features.append([max(0.0, sum(top[f] * net.hidden[f, k] for f in range(quality.FILTERS)) + net.hidden_bias[k]) for k in range(quality.HIDDEN)])
    both = [max(c) for c in zip(*features, strict=True)] + [sum(c) / len(c) for c in zip(*features, strict=True)]
    return 1 / (1 + np.exp(-(float(np.dot(both, net.out)) + net.out_bias)))


def test_scores_equal_a_plain_forward_pass(spark):
    r = random.Random(16)
    net = quality.train([words(r, 40).encode() for _ in range(40)], [k % 2 for k in range(40)], epochs=1)
    rows = [(0, None), (1, ""), (2, "x"), (3, words(r, 30)), (4, words(r, 200)), (5, "é" * 128), (6, "y" * 256), (7, "日本" * 43), (8, words(r, 90) + "\n\n###")]
    got = quality.classify(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()
    want = {i: plainly(net, (t or "").encode()) for i, t in rows}
    assert all(abs(x["score"] - want[x["doc_id"]]) < 1e-4 for x in got) and len({round(x["score"], 4) for x in got}) > 5


def test_scoring_takes_few_texts_out_of_a_batch(monkeypatch):
    taken, sizes, score_texts = [], [], quality.score_texts
    monkeypatch.setattr(quality.F, "arrow_udf", lambda _: lambda f: taken.append(f) or (lambda c: c))
    monkeypatch.setattr(quality, "score_texts", lambda net, texts: sizes.append(len(texts)) or score_texts(net, texts))
    net = quality.new_net()
    quality.score(None, net)
    t = [None, "", "é"] + [f"text {k} " * (k % 7) for k in range(1200)]
    got = np.concatenate([x.to_numpy() for x in taken[0](iter([pa.array(t), pa.array([], pa.string())]))])
    assert max(sizes) <= quality.ROWS and np.allclose(got, score_texts(net, [(x or "").encode() for x in t]), atol=1e-5)


def test_training_in_blocks_is_the_same(monkeypatch):
    r = random.Random(17)
    texts, labels = [words(r, r.randint(5, 300)).encode() for _ in range(50)], [k % 2 for k in range(50)]
    whole = quality.train(texts, labels, epochs=1)
    monkeypatch.setattr(quality, "TRAIN_BLOCK", 7)
    parts = quality.train(texts, labels, epochs=1)
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(whole.parts(), parts.parts(), strict=True))


def test_the_sample_holds_whole_texts(spark):
    rows = [(i, f"{i} " + "a" * (10 * i)) for i in range(200)] + [(300, "z" * 200_000), (301, "two rows"), (301, "row")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i in range(200)] + [(300, 1), (301, 0), (7, 0), (None, 1), (8, 2), (400, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    import zlib

    usable = {i for i in [*range(200), 300, 301] if zlib.crc32(str(i).encode()) % 5 and i not in (7,)}
    whole = {t.encode() for i, t in rows if i in usable and t != "two rows"}
    every = quality.sampled(d, labels, 1000, 1 << 20)
    assert {t for t, _ in every} == whole
    few = quality.sampled(d, labels, 20, 1 << 20)
    assert len(few) == 20 and {t for t, _ in few} <= whole
    small = quality.sampled(d, labels, 1000, 20_000)
    assert 10 < len(small) and sum(len(t) for t, _ in small) <= 20_000 and {t for t, _ in small} <= whole
    assert quality.sampled(d, labels.where("false"), 10, 10) == []


def test_chunks_cover_whole_texts():
    for n in (0, 1, 127, 128, 129, 256, 257, 1000):
        codes, starts = quality.chunks_of([b"a" * n, b"b"])
        assert (codes[: starts[1]] == 97).any(axis=0).sum() >= min(n, 1) and starts[0] == 0
    long = bytes(range(256)) * 20
    whole = quality.score_texts(quality.new_net(), [long, b"x", long])
    assert whole[0] == whole[2]


# Suffix sort


@pytest.mark.parametrize("most", [suffix.MOST, 2])
def test_removed_bytes_equal_brute_force(docs, texts, most):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.report(docs, most=most).collect()]
    raw = [(t or "").encode() for _, t in texts]
    want = [(i, len(t), *x) for (i, _), t, x in zip(texts, raw, suffix.brute(raw), strict=True)]
    assert ordered(got) == ordered(want) and any(x[2] for x in want)


def test_suffix_order_is_lexicographic():
    r = random.Random(7)
    data = bytes(r.choice(b"ab") for _ in range(600))
    s = suffix.Suffixes(np.frombuffer(data, np.uint8))
    at = np.arange(500)
    order = s.sort(np.zeros(500, np.int64), at, np.minimum(60, 600 - at))
    assert [data[i : i + 60] for i in order] == sorted(data[i : i + 60] for i in range(500))


def test_a_scan_takes_as_many_steps_for_many_rows():
    def steps(n: int) -> int:
        called = []
        r = random.Random(6)
        passage = r.randbytes(500)
        rows = [r.randbytes(150) + passage + r.randbytes(150) for _ in range(n)]
        sys.setprofile(lambda _, event, __: called.append(event))
        try:
            got = suffix._scan(np.zeros(n, np.int64), rows, np.full(n, 400), np.zeros(n, bool))
        finally:
            sys.setprofile(None)
        assert got[0].min() == got[1].min() == 250
        return len(called)

    assert steps(400) < 2 * steps(20)


def test_a_merge_compares_each_pair_once(monkeypatch):
    data = np.random.default_rng(0).integers(0, 3, 512)
    compared, less = [], suffix.Suffixes.less

    def counted(self, a, *more):
        compared.append(len(a))
        return less(self, a, *more)

    monkeypatch.setattr(suffix.Suffixes, "less", counted)
    order = suffix.Suffixes(data).sort(np.zeros(512, np.int64), np.arange(512), 512 - np.arange(512))
    assert order.tolist() == sorted(range(512), key=lambda i: data[i:].tolist())
    assert sum(compared) <= 512 * sum(range(1, 10))  # run lengths 1 to 256 take 1 to 9 steps each


def test_suffix_dedup_keeps_columns(docs, nothing):
    assert suffix.deduplicate(docs).columns == docs.columns and suffix.report(nothing).count() == 0


@pytest.mark.parametrize("walk", [48, 1])
def test_reaches_equal_brute_force(walk):
    r = random.Random(8)
    for _ in range(15):
        rows, before, group, several = [], [], [], []
        for g in range(3):
            core = bytes(r.choice(b"ab") for _ in range(900))
            for _ in range(r.randint(2, 12)):
                x, y = r.choice([0, 400, r.randint(0, 400)]), r.choice([32, 400, r.randint(32, 400)])
                rows.append(bytes(r.choice(b"cd") for _ in range(400 - x)) + core[450 - x : 450 + y] + bytes(r.choice(b"ef") for _ in range(400 - y)))
                before.append(400)
                group.append(g)
                several.append(r.random() < 0.3)
        left, right = suffix.reaches(np.array(group), rows, np.array(before), np.array(several), walk)
        for i, t in enumerate(rows):
            fits = [k for k in range(401) if any((j != i or several[i]) and group[j] == group[i] and u[400 - k : 800 - k] == t[400 - k : 800 - k] for j, u in enumerate(rows))]
            assert (left[i], right[i]) == ((max(fits), 400 - min(fits)) if fits else (0, 0))


# Secrets


PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile("[0-9a-f]+"), 0, 32),
]


def secrets_of(t):
    found = [(m.start(), k, m.end(), name) for k, (name, rx, g, least) in enumerate(PATTERNS) for m in rx.finditer(t or "") if len(m[g]) >= least]
    spans = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
    return (*(sum(x[3] == n for x in found) for n, *_ in PATTERNS), spans, sha(spans.encode()))


def secret_texts():
    r = random.Random(9)
    parts = ["password", "PassWd: ", "token=", "secret = '", "api_key\"='", "ApiKey:", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "deadbeef" * 4, "x9/y+z_w=.-", " ", "\n", "é😀", "tok", ": ", "ſecret=", "abc"]
    out = ["".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400)]
    return [*out, None, "", "token=" + "a" * 100_000, "token=token: abcdefgh", "key " * 3000 + "secret=abcdefgh1"]


def test_secrets_equal_brute_force(spark):
    rows = list(enumerate(secret_texts()))
    got = secret_scan.scan(spark.createDataFrame([*rows, rows[0], (None, "token=abcdefgh")], "doc_id long, text string"))
    want = [(i, *secrets_of(t)) for i, t in [*rows, rows[0], (None, "token=abcdefgh")]]
    at = ["doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256"]
    assert ordered(got.select(at).collect()) == ordered(want)


def test_secrets_of_rows_without_id(spark):
    texts = [*secret_texts(), "a token=abcdefgh1 b AKIAABCDEFGHIJKL12 c"]
    d = spark.createDataFrame([(None, t) for t in texts] + [(1, "clean")], "doc_id long, text string")
    at = ["doc_id", "n_assign", "n_access", "n_hex", "spans", "base_sha256"]
    assert ordered(secret_scan.scan(d).select(at).collect()) == ordered([(1, *secrets_of("clean")), *((None, *secrets_of(t)) for t in texts)])
    masked = [r["text"] for r in secret_scan.redact(d).collect()]
    assert "a [assign] b [access] c" in masked and not any("AKIAABCDEFGHIJKL12" in (t or "") for t in masked)


def test_candidates_hold_every_match(spark):
    rows = list(enumerate(secret_texts()))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r["doc_id"]: set(r["_kinds"] or ()) for r in secret_scan.flagged(d, secret_scan.RULES, "text").select("doc_id", "_kinds").collect()}
    for i, t in rows:
        n = secrets_of(t)
        assert not n[0] or "assign" in kinds[i]
        assert not n[1] or "access" in kinds[i]


def test_spans_over_many_blocks(spark):
    t = "".join(f"token=abcdefgh{k} " for k in range(500)) + "token=ab " * 200 + "secret:abcdefgh9"
    got = secret_scan.scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).select("n_assign", "n_access", "n_hex", "spans", "base_sha256").first()
    assert tuple(got) == tuple(secrets_of(t)) and got["n_assign"] == 501


#: Expressions with the trigram sets that they force, as a set of words each of whose trigrams is meant; none: scan fully.
DERIVED = [
    (secret_scan.RULES[0].regex, {("password",), ("passwd",), ("secret",), ("token",), ("api_key",), ("apikey",)}),
    (secret_scan.RULES[1].regex, {("akia",)}),
    (secret_scan.RULES[2].regex, None),
    ("abc", {("abc",)}),
    ("ab", None),
    ("abc|d", None),
    ("a.c", None),
    (r"\d{3}-\d{4}", None),
    ("(abc|abd)ef", {("abcef",), ("abdef",)}),
    ("ab(cd)?ef", {("abcdef",), ("abef",)}),
    ("(ABC)+", {("abc",)}),
    ("(abc)*def", {("def",)}),
    ("x(abc){2,}y", {("xab", "abcabc", "bcy")}),
    ("(?:abc|[a-z]+)def", {("def",)}),
    ("[ab]cd", {("acd",), ("bcd",)}),
    ("a(?=bcd)b", None),
    ("^sk_(live|test)_[0-9a-zA-Z]{24}$", {("sk_live_",), ("sk_test_",)}),
    ("[^a]bcd", {("bcd",)}),
]


@pytest.mark.parametrize(("regex", "words"), DERIVED)
def test_queries_are_derived(regex, words):
    want = {frozenset(w[i : i + 3] for w in ws for i in range(len(w) - 2)) for ws in words or ()}
    assert set(trigram_query.derive(regex)) == want


def test_derived_queries_hold_for_random_matches():
    r = random.Random(15)
    parts = ["a", "b", "ab", "abc", "cab", "(ab|bc)", "(a|bca)", "[ab]", "[a-c]", ".", "c?", "(abc)?", "(ab)+", "(ca){2,3}", "b*", "(?i:AB)", "(b|(ca|ab)c)+"]
    for _ in range(300):
        rx = "".join(r.choice(parts) for _ in range(r.randint(1, 6)))
        sets = trigram_query.derive(rx)
        for _ in range(40):
            m = re.search(rx, "".join(r.choice("abcAB") for _ in range(r.randint(1, 16))))
            if m and sets:
                t = m[0].lower()
                assert any(all(g in t for g in s) for s in sets), (rx, m[0], sets)


def test_redaction(spark, docs, nothing):
    d = spark.createDataFrame([(1, "a token=abcdefgh1 b AKIAABCDEFGHIJKL12 c " + "0a" * 20 + " d token=ab"), (2, None), (3, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact(d).collect()}
    assert got == {1: "a [assign] b [access] c [hex] d token=ab", 2: None, 3: "clean"}
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.scan(nothing).count() == 0


# Decontamination


def hits_of(t, items, window=10):
    words = decontaminate.words_of(t)
    wins = defaultdict(set)
    for i, x in items:
        w = decontaminate.words_of(x)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            wins[tuple(w[k : k + n])].add(i)
    hit, ids = set(), set()
    for n in {len(x) for x in wins}:
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in wins:
                hit.update(range(k, k + n))
                ids |= wins[tuple(words[k : k + n])]
    names = sorted(str(x) for x in ids if x is not None)
    return len(words), len(hit), len(ids), sha(",".join(names).encode()), bool(hit)


def contaminated():
    r = random.Random(10)
    items = [(i, " ".join(r.choice("abc") for _ in range(r.choice([1, 3, 9, 10, 11, 14])))) for i in range(6)]
    items += [(7, "Some Longer ITEM-text, with é words: one two three four five six"), (8, None), (9, ""), (10, "..."), (7, "again again"), (None, "only null here")]
    texts = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for i in range(60)]
    texts += [(100, "x Some longer item text, WITH É words; one two"), (101, "some longer item text with é words one two three"), (102, None), (103, "again, again"), (104, "it has only null here"), (103, "again, again")]
    return items, texts


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontamination_equals_brute_force(spark, block_words):
    items, rows = contaminated()
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(d, b, block_words=block_words).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert ordered(got.collect()) == ordered((i, *hits_of(t, items)) for i, t in rows)


def test_cleaning(spark, docs, nothing):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    d = spark.createDataFrame([(1, "start One, two three four five six seven eight nine TEN. end"), (2, "clean"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, items).collect()) == [2, 3]
    assert {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(d, items).collect()} == {1: "start . end", 2: "clean", 3: None}
    assert decontaminate.clean(docs, items).columns == docs.columns
    empty = items.where("false")
    assert decontaminate.decontaminate(d, empty).where("contaminated").count() == 0 and decontaminate.clean(nothing, items).count() == 0
