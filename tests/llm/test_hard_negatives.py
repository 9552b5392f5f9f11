"""Hard negatives against a plain version; the bounds against exact products."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as hn
from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


def plain(anchors, rows, positives=5, negatives=3, low=50, high=95):
    """Both lists hold (id, label, whole components)."""
    out = []
    for a, label, q in {(i, k, tuple(v)) for i, k, v in anchors}:
        met = [(sum(x * y for x, y in zip(q, v, strict=True)), i, k) for i, k, v in rows if i != a and len(v) == len(q)]
        met = sorted((min(max(s, hn.LEAST), hn.MOST), i, k) for s, i, k in met)
        met.sort(key=lambda m: (-m[0], m[1]))
        for p, i, _ in [m for m in met if m[2] == label][:positives]:
            fits = [m for m in met if m[2] != label and low * p <= 100 * m[0] <= high * p][:negatives]
            out += [(a, i, rank, n, p, s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, anchors, rows, **options):
    frame = lambda name, of: spark.createDataFrame([(i, k, None if v is None else [None if c is None else float(c) for c in v]) for i, k, v in of], f"{name} long, label long, v array<double>")
    return sorted(map(tuple, hn.mine(frame("anchor_id", anchors), frame("vec_id", rows), **options).collect()))


def test_query_equals_plain_version(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        v = r["embedding"]
        if r["label"] is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [int(np.floor(256 * Fraction(c))) for c in v]))
    got = queries.op11_hard_negatives(spark, SF)
    assert sorted(map(tuple, got.collect())) == plain([r for r in rows if r[0] % 50 == 0], rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("seed", range(3))
def test_small_blocks_ties_and_repeated_rows(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_VALUES", 60)
    monkeypatch.setattr(hn, "SAMPLE_VALUES", 200)
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(3), [rng.randint(-3, 3) for _ in range(rng.choice((3, 4)))]) for _ in range(150)]
    rows += rows[:5]
    anchors = rows[:20]
    assert mined(spark, anchors, rows) == plain(anchors, rows)
    assert mined(spark, anchors, rows, positives=2, negatives=4, low=10, high=100) == plain(anchors, rows, 2, 4, 10, 100)


def test_huge_components_zero_and_missing_vectors(spark):
    rows = [(1, 0, [3, 4]), (2, 0, [6, 8]), (3, 1, [4, 4]), (4, 1, [2**40, 2**40]), (5, 0, [2**60, 1]), (6, 1, [2**60, -5]), (7, 2, [0, 0]), (8, 0, [int(1e300), int(1e300)]), (9, 1, [int(1e300), 1]), (10, 0, [5, 5]), (11, 2, [4, 3])]
    odd = [(None, 0, [1, 1]), (12, None, [1, 1]), (13, 0, None)]
    assert mined(spark, rows + odd, rows + odd) == plain(rows, rows)


def test_empty_tables_and_clashing_names(spark):
    rows = [(1, 0, [3, 4]), (2, 0, [6, 8]), (3, 1, [4, 4])]
    assert mined(spark, [], rows) == mined(spark, rows, []) == mined(spark, [], []) == []
    wide = spark.createDataFrame([(i, k, [float(c) for c in v], "x", 1, 2, 3) for i, k, v in rows], "vec_id long, label long, v array<double>, n string, block int, chunk int, anchor int")
    got = hn.mine(wide.withColumnRenamed("vec_id", "anchor_id"), wide)
    assert sorted(map(tuple, got.collect())) == plain(rows, rows)


@pytest.mark.parametrize("sampled", [0, 3, 400])
def test_bounds_hold_for_any_code_words(sampled):
    rng = np.random.default_rng(sampled)
    x = np.floor(rng.normal(size=(400, 7)) * rng.choice([1, 100, 1e6], size=(400, 1)))
    words = hn.fit_words(x[:sampled])
    codes, rest = hn.quantise(x, words)
    table = pa.table({"vec_id": np.arange(400), "label": np.zeros(400, np.int64), "v": x.tolist(), "codes": [c.tobytes() for c in codes], "rest": [r.tobytes() for r in rest]})
    block = hn.Block(table, words)
    for q in x[:50]:
        low, high = block.bounds(q)
        exact = x @ q
        assert (low <= exact).all() and (exact <= high).all()


def test_labels_move_where_the_id_is_divisible(spark):
    df = spark.createDataFrame([(7, 9), (8, 9), (0, 3), (None, 4), (14, None)], "vec_id long, label long")
    assert [r[0] for r in df.select(hn.relabelled(F.col("label"), F.col("vec_id"))).collect()] == [0, 9, 4, 4, None]
