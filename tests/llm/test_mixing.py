"""Source mixing: targets, the splitting tree, and what is taken, against plain versions."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes, weights, share, limit):
    left, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / weight >= limit * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / weight
            break
        for i in over:
            out[i], left = limit * sizes[i], left - limit * sizes[i]
            free.discard(i)
    return out


@pytest.mark.parametrize("sizes", [[100, 100, 100], [5, 0, 1000, 1000, 3], [0, 0], [7], [1, 10_000, 1, 1, 1, 400], [10**12, 1, 5]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None]
    got = mixing.source_targets(spark.createDataFrame([(n, 1, x) for n, x in zip(names, sizes, strict=True)], "__source string, n long, __total long"), (3, 1, 2), 1.5, 2.0).collect()
    want = dict(zip(names, plain_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0), strict=True))
    assert {r["__source"]: r["target"] for r in got} == pytest.approx(want)


def test_split_quotas():
    q, leaves = [50, 3, 0, 129], [182 * (k + 1) // 16 - 182 * k // 16 for k in range(16)]
    m = mixing.split_quotas(q, leaves, 1)
    assert m.sum(axis=0).tolist() == q and m.sum(axis=1).tolist() == leaves and (m >= 0).all()
    # Of 1,000 trees the mean of a cell is its share.
    mean = sum(mixing.split_quotas([40, 24], [16, 48], s) for s in range(1000)) / 1000
    assert mean[0].tolist() == pytest.approx([10, 6], abs=0.2)


def words(r, n):
    return " ".join("w%d" % x for x in r.integers(0, 1000, n))


def check(d, rows, shards=16):
    got = mixing.mix(d, shards=shards).collect()
    assert len(got) == len(rows)
    taken, target, most, sizes, draws, blocks = Counter(), {}, Counter(), Counter(), defaultdict(set), defaultdict(set)
    for x in got:
        s = x["__source"]
        assert 0 <= x["copies"] <= 2 and len(x["places"]) == x["copies"]
        taken[s] += x["__size"] * x["copies"]
        sizes[s] += x["__size"]
        most[s] = max(most[s], x["__size"])
        target[s] = x["target"]
        for p in x["places"]:
            draws[p["shard"]].add((s, x["__block"], p["pass"]))
            blocks[s, x["__block"], p["pass"]].add(p["shard"])
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert target == pytest.approx(dict(zip(names, plain_targets([sizes[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True)))
    assert all(abs(taken[s] - target[s]) <= max(1, most[s]) for s in target)
    # A block's draw goes to one shard as a whole, and shards differ by one block at most but for blocks of which nothing fitted.
    assert all(len(at) == 1 for at in blocks.values())
    n = [len(draws[k]) for k in range(shards)]
    assert max(n) - min(n) <= 1 + len(names)
    return got


def test_mix(spark):
    r = np.random.default_rng(2)
    rows = [(i, words(r, int(n)), "en", f"s{i % 3}" if i % 7 else None, 1) for i, n in enumerate(r.integers(1, 60, 600))] + [(9999, None, None, None, None), (9998, "", "", "empty", 0)]
    d = spark.createDataFrame(rows, DOC).repartition(5)
    got = check(d, rows)
    again = mixing.mix(d.repartition(2)).collect()
    assert sorted((x["__doc"], x["copies"], str(x["places"])) for x in got) == sorted((x["__doc"], x["copies"], str(x["places"])) for x in again)
    assert mixing.mix(d.where("false")).count() == 0


@pytest.mark.parametrize("case", ["null ids", "one id", "equal rows", "one source"])
def test_hot_keys(spark, case):
    """No key makes documents be taken all or none."""
    r = np.random.default_rng(4)
    text = words(r, 10)
    rows = [({"null ids": None, "one id": 7}.get(case, i if case == "one source" else 5), text if case == "equal rows" else words(r, int(n)), "en", "s0" if case == "one source" or i % 2 else "s1", 1) for i, n in enumerate(r.integers(1, 40, 600))]
    d = spark.createDataFrame(rows, DOC).repartition(4)
    got = check(d, rows)
    again = mixing.mix(d.repartition(3)).collect()
    assert sorted((x["__size"], x["copies"], str(x["places"])) for x in got) == sorted((x["__size"], x["copies"], str(x["places"])) for x in again)


def test_mixed_documents(spark):
    r = np.random.default_rng(5)
    rows = [(None if i % 5 == 0 else i // 2, words(r, int(n)), "en", f"s{i % 3}", 1, i, "x") for i, n in enumerate(r.integers(1, 30, 200))]
    rows += [rows[1]] * 9
    d = spark.createDataFrame(rows, DOC + ", __n int, __size string")
    out, plan = mixing.mixed_documents(d), mixing.mix(d)
    assert out.columns == d.columns
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    n = Counter(x["__n"] for x in out.collect())
    assert all(c <= 2 for k, c in n.items() if k != 1) and n[1] <= 20
