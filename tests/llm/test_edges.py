"""Odd rows and tables: repeated and null ids, extreme values, clashing names, empty tables; plain versions where there is one."""

import bisect
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import langid, line_dedup, packing, queries, sharding, topk

DOC = "doc_id long, text string, lang string, source string, n_chars long"


# --- search


def brute(rows, asked, k=5):
    """By Python's integers: query_id -> [(vec_id, score)]."""
    vector = lambda v: [math.floor(256 * x) for x in v]
    live = [(i, vector(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q in asked:
        found = []
        for a in {tuple(v) for i, v in live if i == q}:
            found += sorted((-max(min(sum(x * y for x, y in zip(a, b, strict=True)), 2**63 - 1), -(2**63)), i) for i, b in live if i != q and len(b) == len(a))[:k]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: v for q, v in out.items() if v}


def found(spark, rows, asked):
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    got = defaultdict(list)
    for x in topk.top_k(e.where(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id"), e, 5).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["vec_id"], x["score"]))
    return dict(got)


def test_large_components_are_exact(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-(2**31), 2**31, 3) * r.choice([1, 2**10])]) for i in range(60)]
    rows += [(100, [2.0**40, 1.0, 0.0]), (101, [2.0**40, 1.0, 1.0]), (102, [1e300, 0.0, 0.0]), (103, [-1e300, 1.0, 1.0]), (104, [0.0, 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0]), (106, None), (None, [1.0, 1.0, 1.0])]
    asked = [0, 50, 100, 104]
    assert found(spark, rows, asked) == brute(rows, asked)


def test_repeated_ids_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    rows = [(i % 20, [float(i % 3), float(i % 5)]) for i in range(60)] + [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, -1.0])]
    assert found(spark, rows, [50, 0]) == brute(rows, [50, 0])


def test_blocks_out_of_reach_are_not_sent(spark, monkeypatch):
    """Short vectors lose to long ones before they are shuffled: the search sees none of their blocks."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.abs(r.normal(size=4)) * (1000 if i < 64 else 0.05)]) for i in range(2000)]
    sent = []
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    real = topk.written

    def watched(df, *a):
        out = real(df, *a)
        if df.columns[:3] == ["query_id", "v", "floor"]:
            sent.append(out.agg(F.count(F.lit(1)), F.max("bucket")).first())
        return out

    monkeypatch.setattr(topk, "written", watched)
    topk.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 5).count()
    short = -math.log(0.5 * 256) / -math.log(topk.SHRINK)  # the bucket of the longest of the short ones, or before it
    assert sent[0][0] >= 40 and all(n == 0 or bucket < short for n, bucket in sent)


# --- packing


def best_fit(counts, size=1024):
    rooms, n = [], 0
    for length in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
        i = bisect.bisect_left(rooms, length)
        room = rooms.pop(i) if i < len(rooms) else size
        n += room == size
        if room > length:
            bisect.insort(rooms, room - length)
    return n


@pytest.mark.parametrize("seed", range(10))
def test_never_above_best_fit(seed):
    r = np.random.default_rng(seed)
    lengths = r.lognormal(5.0 + seed / 5, 0.3 + seed / 10, 1500) if seed % 2 else r.integers(1, 1025, 1500)
    counts = Counter(int(x) for x in np.clip(lengths, 1, 1024))
    plan = packing.plan(dict(counts))
    assert sum(m for _, m in plan) <= best_fit(counts)
    got = Counter()
    for lengths, many in plan:
        assert sum(lengths) <= 1024
        for n in lengths:
            got[n] += many
    assert got == counts


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no such table")
def test_real_lengths(spark):
    out = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    counts = Counter(x["length"] for x in out.select("length").collect())
    assert out.select("sequence_id").distinct().count() <= best_fit(counts)


def test_packing_nothing(spark):
    d = spark.createDataFrame([], DOC)
    assert packing.pack_documents(d).count() == 0
    d = spark.createDataFrame([(None, None, None, None, None)] * 3, DOC)
    assert sorted((x["doc_id"], x["length"], x["offset"]) for x in packing.pack_documents(d).collect()) == [(None, 1, 0), (None, 1, 1), (None, 1, 2)]


# --- lines


def test_lines_of_odd_tables(spark):
    long = "this line has more than forty code points in it, surely"
    rows = [(i, f"{long}\nown {i}", "x", i) for i in range(6)] + [(5, f"{long}\nown 5", "x", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, n long")
    got = line_dedup.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "n", "n_lines", "n_dropped"]
    assert Counter((x["doc_id"], x["n_lines"], x["n_dropped"]) for x in got.collect()) == Counter({**{(i, 2, 1): 1 for i in range(5)}, (5, 2, 0): 2})
    assert line_dedup.dedup_lines(d.where("false")).count() == 0


# --- sharding


def rendezvous(key, weights):
    """Plain Python: of all shards the one with the best score."""
    text = ("\x00" if key is None else str(key)).encode()
    best = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            h = xxhash.xxh64_intdigest(text, 42)
            for part in (shard, 0):
                h = xxhash.xxh64_intdigest(part.to_bytes(4, "little"), h)
            best.append((math.log(((h >> 11) + 0.5) * 2.0**-53) / weight, shard))
    return max(best)[1]


def test_sharding_is_plain_rendezvous(spark):
    rows = [(i, f"t{i % 7}") for i in range(500)] + [(None, "n")] * 40 + [(None, f"n{i}") for i in range(300)] + [(7, "again")] * 30
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard(d, "doc_id", [1.0] * 24, [1.0] * 25, [F.length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("c")]).collect()
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, len(t)) for i, t in rows)
    for x in got:
        assert x["shard"] == rendezvous(x["doc_id"], [1.0] * 24) and x["grown_shard"] == rendezvous(x["doc_id"], [1.0] * 25)
    slots = defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_query_columns(spark, tmp_path):
    rows = [(1, "é€"), (2, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    got = {x["doc_id"]: (x["size"], x["text_crc32"], x["law"]) for x in queries.op6_sharding(spark, str(tmp_path)).collect()}
    assert got == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "key") for i, t in rows}


# --- languages


def test_no_letter_is_und(spark):
    r = np.random.default_rng(0)
    words = {"en": "the of and to in that".split(), "de": "der die und das nicht mit".split()}
    rows = [(i, " ".join(r.choice(words[lang], 20)), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 60)]
    odd = {900: "² ½ ① ٣", 901: "12_3", 902: "日本", 903: "² und", 904: "", 905: "́̂"}
    d = spark.createDataFrame([(*x, "old", 2.0) for x in [*rows, *((i, t, None, None, None) for i, t in odd.items())]], DOC + ", lang_pred string, score double")
    got = {x["doc_id"]: x for x in langid.identify(d).collect()}
    assert {i: got[i]["lang_pred"] == "und" for i in odd} == {900: True, 901: True, 902: False, 903: False, 904: True, 905: True}
    held = [x for i, x in got.items() if i < 120 and x["held_out"]]
    assert len(held) > 15 and all(x["lang_pred"] == rows[x["doc_id"]][2] for x in held)
    model = langid.train(d.where("lang is not null"))
    assert langid.predict(d, model).columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]


def test_sample_is_bounded_by_different_texts(spark):
    """Null ids, one id or one text on most rows don't fill the sample."""
    many = [(None, f"some words of text number {i}", "en", None, None) for i in range(600)] + [(7, f"einige worte als text {i}", "de", None, None) for i in range(600)] + [(i, "one text for all", "en", None, None) for i in range(600)]
    assert 5 < langid.train(spark.createDataFrame(many, DOC), rows_per_lang=20).rows < 60


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no such table")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(got) >= 20 and sum(x["lang"] == x["lang_pred"] for x in got) >= 0.95 * len(got)
