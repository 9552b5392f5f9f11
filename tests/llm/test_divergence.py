"""Divergence of sources against a plain version in exact integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import divergence, queries

SF = "/root/testdata/sf0.001"
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, least=10, top=10):
    """docs: (lang, source, text)."""
    groups, holders = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        terms = TERM.findall((text or "").translate(A_Z))
        groups[lang or "", source or ""].update(terms)
        holders[lang or ""].update(set(terms))
    out = []
    for (lang, source), n in groups.items():
        kept = sorted(t for t, k in holders[lang].items() if k >= least)
        every = [c for (g, _), c in groups.items() if g == lang]
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))  # noqa: B023, E731
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        whole = sum(every, Counter())
        pairs = [(s, sum(apart(share(n, t), share(c, t)) for t in kept)) for (g, s), c in groups.items() if g == lang and s != source]
        terms = [(t, apart(share(n, t), share(whole, t))) for t in kept if n[t] and share(n, t) > share(whole, t)]
        for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows[:most], 1)]
    return sorted(out)


def audited(spark, docs, **options):
    frame = spark.createDataFrame([(k, t, lang, source) for k, (lang, source, t) in enumerate(docs)], "doc_id long, text string, lang string, source string")
    return sorted(map(tuple, divergence.audit(frame, **options).collect()))


def test_query_equals_plain_version(spark):
    docs = [(r["lang"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_source_divergence(spark, SF)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(docs)


@pytest.mark.parametrize("seed", range(2))
def test_tiles_chunks_and_both_kinds_of_terms(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "CHUNK", 40)
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["É", "é", "Straße", "İX", "漢字"]
    docs = [(rng.choice(["x", "y", None]), f"s{rng.randrange(8)}", " ".join(words[min(int(rng.expovariate(0.08)), 64)] for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    docs += [("x", "lone words", "zq" * 3), ("z", "one source", "a b c"), ("y", "nothing", None), ("y", None, "waa wba" * 4)]
    for least in (1, 3, 10):
        assert audited(spark, docs, least_docs=least) == plain(docs, least)


def test_odd_tables(spark):
    same = [("en", "a", "one two")] * 12 + [("en", "b", "One TWO three")] * 12 + [(None, None, None), ("", "", "")]
    assert audited(spark, same) == plain(same)
    assert audited(spark, []) == []
    nothing = [("en", "a", "1 2 3"), ("en", "b", None)]
    assert audited(spark, nothing) == plain(nothing) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    clashing = spark.createDataFrame([(lang, source, text, 1, "x", 2) for lang, source, text in same], "lang string, source string, text string, n int, term string, p int")
    assert sorted(map(tuple, divergence.audit(clashing).collect())) == plain(same)


def test_very_long_texts_are_split_at_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 50)
    text = "Word1 éa\x00b" * 400 + "x" * 300
    assert [t.decode() for part in divergence.terms_of(text) for t in part] == TERM.findall(text.translate(A_Z))


def test_counts_are_sent_on_when_many(monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 20)
    docs = [("en", f"s{k % 3}", " ".join(chr(97 + (k * j) % 26) * 2 for j in range(30))) for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs[lo : lo + 7], strict=True)], names=["lang", "source", "text"]) for lo in range(0, 60, 7)]
    sent = [b.to_pylist() for b in divergence._counted(iter(batches))]
    assert len(sent) > 3
    n, held = Counter(), Counter()
    for r in (r for rows in sent for r in rows if r["term"] is not None):
        n[r["source"], r["term"]] += r["n"]
        held[r["source"], r["term"]] += r["docs"]
    assert n == Counter((s, t) for _, s, text in docs for t in text.split())
    assert held == Counter((s, t) for _, s, text in docs for t in set(text.split()))


@pytest.mark.parametrize("same", [True, False])
def test_pairs_of_rare_terms_in_parts(monkeypatch, same):
    rng = np.random.default_rng(4)
    side = lambda: (np.sort(rng.integers(0, 30, 90)), rng.integers(0, 5, 90), rng.integers(1, 10**9, 90))
    left = side()
    right = left if same else side()
    base = (rng.integers(1, 10**6, 5), rng.integers(1, 10**6, 5))
    base = (base[0], base[0]) if same else base
    sums = []
    for most in (1, 7, 1 << 20):
        monkeypatch.setattr(divergence, "PAIRS", most)
        out = np.zeros((5, 5), dtype=np.int64)
        divergence.rare_pairs(left, right, same, base, out)
        sums.append(out)
    assert (sums[0] == sums[1]).all() and (sums[1] == sums[2]).all() and sums[0].any()
