"""Sharding, WARC files, search and the pipeline."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeworks.llm import shards, topk, warc

from .conftest import crowded


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# Store


def test_store_round_trip(spark, docs, nothing):
    s = shards.Store(spark, target=1 << 20)
    s.append_each(docs, shards.arrivals("doc_id", 3), 3)
    assert ordered(s.read().collect()) == ordered(docs.collect())
    before = s.manifest()
    s.append(docs)
    assert s.read().count() == 2 * docs.count() and s.read(before["version"]).count() == docs.count()
    small = len(s.manifest()["files"])
    s.compact(everything=True)
    assert len(s.manifest()["files"]) < small and s.read().count() == 2 * docs.count()
    assert s.vacuum() > 0 and s.versions() == [s.manifest()["version"]]
    assert ordered(s.read().distinct().collect()) == ordered(docs.distinct().collect())
    e = shards.Store(spark)
    with pytest.raises(ValueError):
        e.read()
    e.append(nothing)
    assert e.read().count() == 0 and e.read().columns == nothing.columns


def test_a_version_is_committed_once(spark, docs):
    s = shards.Store(spark)
    now = s.manifest()
    s.commit(now, [], docs.schema.json())
    with pytest.raises(shards.Conflict):
        s.commit(now, [], docs.schema.json())


def test_tiers_merge_files_of_like_size(spark):
    s = shards.Store(spark, target=100 << 20)
    f = [{"name": str(i), "bytes": 1000, "tier": s.tier(1000)} for i in range(4)] + [{"name": "big", "bytes": 30 << 20, "tier": s.tier(30 << 20)}]
    assert {x["name"] for x in s.full_tiers(f)} == {"0", "1", "2", "3"}
    assert s.full_tiers(f[:3]) == []


def test_reshard_returns_every_row(spark, docs, nothing):
    assert ordered(shards.reshard(docs).collect()) == ordered(docs.collect())
    assert shards.reshard(nothing, n=2).count() == 0


def test_a_vacuum_leaves_what_is_being_written(spark, docs):
    s, other = shards.Store(spark), None
    s.append(docs)
    other = shards.Store(spark, s.path)
    with other._pending("data/arriving"):
        docs.write.parquet(f"{s.path}/data/arriving")
        assert s.vacuum() == 0
        other._commit_last(lambda now: (now["files"] + other._files("data/arriving"), None))
    assert s.vacuum() == 0 and s.read().count() == 2 * docs.count()
    s._fs.create(s._path(f"{s.path}/pending/left"), False).close()  # of a writer that failed
    docs.write.parquet(f"{s.path}/data/left")
    assert s.vacuum() == 0 and s.vacuum(grace=-1) > 0 and s.read().count() == 2 * docs.count()


def test_two_writers_at_once(spark, docs):
    s = shards.Store(spark)
    seen = []
    commit = s.commit

    def late(before, files, schema):
        if not seen:  # another writer is first
            seen.append(shards.Store(spark, s.path).append(docs))
        return commit(before, files, schema)

    s.commit = late
    s.append(docs)
    assert s.manifest()["version"] == 2 and s.read().count() == 2 * docs.count()
    # a merge that comes second to a merge of the same files leaves things as they are
    seen.clear()

    def merged_before(before, files, schema):
        if not seen:
            seen.append(shards.Store(spark, s.path).compact(everything=True))
        return commit(before, files, schema)

    s.commit = merged_before
    s.compact(everything=True)
    assert s.manifest() == seen[0] and s.read().count() == 2 * docs.count()
    # one that comes second to an append keeps what was appended
    seen.clear()
    s.commit = commit
    s.append(docs)
    s.commit = late
    s.compact(everything=True)
    assert len(seen) == 1 and s.read().count() == 4 * docs.count()


# WARC


def pages(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two é</p>"), (3, None, "<p>one</p>"), (4, "http://a b/4", None), (5, "u", ""), (6, "u", "x" * 200_000), (7, "u", "<p>one</p>"), (7, "u", "<p>one</p>")]
    return crowded(spark.createDataFrame(rows, "page_id long, url string, html string")), rows


def wanted(rows, least=0):
    out, seen = [], set()
    for i, u, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        top = max(j for j, _, x in rows if (x or "").encode() == b)
        response = len(b) < least or i == top and (i, b) not in seen
        seen.add((i, b))
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else top))
    return out


@pytest.mark.parametrize("least", [0, 8])
def test_warc_round_trip(spark, least):
    df, rows = pages(spark)
    m = warc.write(df, revisit_from=least, roll=100, shard=50)
    back = warc.read(m, with_payload=True).collect()
    assert ordered((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back) == ordered(wanted(rows, least))
    by = {(i, hashlib.sha1((h or "").encode()).digest()) for i, _, h in rows}
    assert all((r["page_id"], hashlib.sha1(r["payload"]).digest()) in by for r in back if r["record_type"] == "response")
    assert m.count() > 2


def test_warc_files_are_the_same_each_time(spark):
    df, _ = pages(spark)
    a, b = (warc.write(x, roll=1000, shard=50).select("shard", "part", "records", "sha256").collect() for x in (df, df.repartition(7)))
    assert ordered(a) == ordered(b)


def test_a_second_write_adds_to_a_path(spark):
    df, rows = pages(spark)
    first = warc.write(df.where("page_id = 1"))
    path = first.first()["path"]
    both = warc.write(df.where("page_id > 1"), path)
    assert warc.versions(spark, path) == [1, 2]
    back = ordered((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read(both).collect())
    assert back == ordered([*wanted(rows[:1]), *wanted(rows[1:])])
    assert warc.read(warc.manifest(spark, path, 1)).count() == 1
    # a writer that is second to commit a number takes the next
    real, numbers = warc.versions, []
    try:
        warc.versions = lambda *a: numbers.append(real(*a)) or (real(*a) if len(numbers) > 1 else real(*a)[:-1])
        third = warc.write(df.where("page_id = 2"), path)
    finally:
        warc.versions = real
    assert warc.versions(spark, path) == [1, 2, 3] and warc.read(third).count() == len(rows) + 1


def test_warc_of_null_ids(spark):
    rows = [(None, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (None, None, "<p>two</p>"), (3, "u", "<p>two</p>"), (None, "u", None)]
    got = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string")), with_payload=True).collect()
    assert len(got) == 5 and sum(r["page_id"] is None for r in got) == 4
    assert [(r["record_type"], r["refers_to"]) for r in got if r["page_id"] == 3] == [("response", None)]
    assert ordered((r["record_type"], r["refers_to"]) for r in got if r["page_id"] is None) == ordered([("response", None)] * 3 + [("revisit", 3)])
    assert ordered(r["payload"] for r in got if r["record_type"] == "response") == ordered([b"<p>one</p>", b"<p>one</p>", b"<p>two</p>", b""])


def test_an_outlying_id_does_not_spoil_the_shards(spark):
    ids = [*range(2000), 1 << 60]
    for most in (100_000, 300):
        sizes = spark.createDataFrame([(i, 100) for i in ids] + [(None, 5)], "page_id long, length long")
        bounds = warc.shard_bounds(sizes, 10_000, most)
        held = np.diff(np.searchsorted(ids, [0, *bounds, 1 << 61]))
        assert 15 <= len(bounds) <= 25 and held.max() <= 200, (most, held)
    rows = [(i, "u", f"{i:0100d}") for i in ids]
    m = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=10_000)
    assert m.agg(F.max("records")).first()[0] <= 110 and m.count() >= 19 and warc.read(m).count() == len(ids)


def test_warc_of_nothing(spark):
    m = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert m.count() == 0 and warc.read(m).count() == 0


def test_gzip_members():
    import gzip

    parts = [b"a" * 10, b"", b"bc" * 5000]
    raw = b"".join(warc.member(p) for p in parts)
    assert gzip.decompress(raw) == b"".join(parts)
    assert list(warc.members(raw[i : i + 7] for i in range(0, len(raw), 7))) == parts


# Search


def vectors(spark):
    r = np.random.default_rng(11)
    rows = [(i, r.normal(0, 0.1, 8).tolist()) for i in range(330)]
    rows += [(400 + i, rows[7][1]) for i in range(40)] + [(100, rows[100][1]), (500, None), (600, [float("nan")] * 8), (700, [0.1] * 7 + [None]), (800, [0.5] * 3), (900, []), (901, []), (902, [float("inf")] * 8), (950, [-float("inf")] + [0.0] * 7), (None, rows[3][1]), (301, [1e9] * 8)]
    return crowded(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows


def nearest(rows, k, every):
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        score = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(score[:k])]
    return out


#: As in production; several blocks, shelves, packets and chunks.
SIZES = [{}, {"block": 4, "shelf": 3, "group": 2, "chunk": 5}]


@pytest.mark.parametrize(("k", "sizes"), [(10, SIZES[0]), (500, SIZES[1]), (10, SIZES[1])])
def test_search_equals_brute_force(spark, k, sizes):
    df, rows = vectors(spark)
    got = topk.search(df, k=k, every=50, **sizes).collect()
    assert ordered(got) == ordered(nearest(rows, k, 50))


def test_search_of_several_dimensions(spark):
    r = np.random.default_rng(12)
    rows = [(i, r.normal(0, 1, r.choice([2, 5, 16])).tolist()) for i in range(400)]
    rows += [(500 + i, rows[i][1]) for i in range(100)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4, every=5, block=8, shelf=2, group=16, chunk=3).collect()
    assert ordered(got) == ordered(nearest(rows, 4, 5))


def test_search_of_nothing(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# Pipeline


def test_pipeline_stages(spark, docs, nothing):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]
    for _, stage in p.STAGES[1:-1]:
        assert stage(spark, docs, sf).columns == docs.columns and stage(spark, nothing, sf).count() == 0
    out = p.run(spark, sf).persist()
    kept = spark.read.parquet(f"{sf}/documents.parquet")
    assert 0 < out.count() <= kept.count() and out.join(kept, "doc_id", "left_anti").count() == 0
    assert out.where(F.octet_length("ids") != 4 * F.col("n_tokens")).count() == 0




def test_pipeline_equals_plain_steps(spark):
    import corpus_pipeline as p
    from latticeworks.llm import bpe, quality
    from latticeworks.llm.common import table

    from .test_text_operators import PATTERNS, encoded, hits_of, library, similar

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    net = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = [x for x, s in zip(rows, quality.score_texts(net, [(t or "").encode() for _, t in rows]), strict=True) if s >= quality.THRESHOLD]
    rows = [x for x, (i, n, c) in zip(rows, similar(rows), strict=True) if n == 0 or c == i]
    rows = [(i, t) for i, t in rows if not hits_of(t, items)[1]]
    tok, want = library(bpe.VOCABULARY), {}
    for i, t in rows:
        for kind, rx, group, least in PATTERNS:
            t = rx.sub(lambda m, kind=kind, group=group, least=least: f"[{kind}]" if len(m[group]) >= least else m[0], t or "")
        n, ids, decoded = encoded(tok, t)
        want[i] = (n, ids, decoded)
    got = p.run(spark, sf).select("doc_id", "n_tokens", F.sha2("ids", 256), "decoded_sha256").collect()
    assert len(got) == len(want) > 50 and {r[0]: tuple(r)[1:] for r in got} == want
