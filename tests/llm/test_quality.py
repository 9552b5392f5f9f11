"""Quality rules: verdicts against a plain version, and the order of the cascade."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def verdict(text):
    """(base_failed, kept) in plain Python."""
    t = text or ""
    w = WORD.findall(t)
    n = Counter(zip(w, w[1:], w[2:]))
    covered = {i + o for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for o in range(3)}
    if len(w) < 50 or 100 * len(covered) > 50 * len(w):
        return True, False
    lines = [s for s in t.split("\n") if WORD.search(s)]
    chars = sum(map(len, w))
    bad = (
        sum(t.count(c) for c in "#*$%&|<>") * 10 > len(w), chars < 2 * len(w) or chars > 12 * len(w), (len(lines) - len(set(lines))) * 2 > len(lines), sum(c.isupper() for c in t) * 2 > chars,
        t.count("!") * 4 > len(w), sum(any(c.isalpha() for c in x) for x in w) * 10 < 6 * len(w), sum(s.strip(" \t\n\x0b\x0c\r")[0] in "-*•●" for s in lines) * 10 > 9 * len(lines),
        sum(s.rstrip(" \t\x0b\x0c\r").endswith(("...", "…")) for s in lines) * 10 > 5 * len(lines), max(Counter(w).values()) * 10 > 4 * len(w),
    )
    return False, not any(bad)


def texts():
    r = np.random.default_rng(3)
    word = lambda k: "".join(r.choice(list("abcdefghij"), k))
    prose = lambda n: " ".join(word(int(k)) for k in r.integers(2, 9, n))
    out = [prose(120), prose(49), prose(51), None, "", " \n ", prose(30_000), "# " * 40 + prose(60), "a b c d e " + " ".join("xyzuvw"[int(k)] for k in r.integers(0, 6, 300))]
    out += [" ".join(word(14) for _ in range(80)), "\n".join([prose(2)] * 30 + [prose(5) for _ in range(20)]), prose(90).upper(), prose(60) + "!" * 30, " ".join(str(k) for k in range(100)) + " " + prose(20)]
    out += ["\n".join(f"{b} {prose(6)}" for _ in range(15)) for b in "-*•●"] + ["\n".join(prose(8) + end for _ in range(12)) for end in ("...", "… ", ".")] + [" ".join(x for _ in range(60) for x in ("so", word(6)))]
    return out + [prose(int(n)) for n in r.integers(40, 200, 20)]


def test_verdicts(spark):
    rows = [(i if i % 4 else None, t, True) for i, t in enumerate(texts())]
    d = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, kept boolean").repartition(3)
    out = quality.filter_quality(d)
    assert out.columns.count("kept") == 1  # a column of that name is replaced
    got = Counter((x["doc_id"], x["text"], x["base_failed"], x["kept"]) for x in out.collect())
    assert got == Counter((i, t, *verdict(t)) for i, t, _ in [*rows, rows[0]])
    assert {verdict(t) for t in texts()} == {(True, False), (False, False), (False, True)}
    assert quality.filter_quality(d.where("false")).count() == 0


def test_costs_are_those_of_the_rules(spark):
    """A dear rule is found dear, and stands behind a cheap one that rejects as much."""
    sample = quality.base_stats(spark.createDataFrame([("word " * 2000,)] * 40, "text string"))
    work = F.aggregate(F.split("text", " "), F.lit(0), lambda a, w: a + F.length(F.reverse(w)))
    rules = [quality.Rule("dear", work > 5), quality.Rule("cheap", F.col("n_words") > 5), quality.Rule("never", F.col("n_words") < 0)]
    found = {e.name: e for e in quality.estimate(sample, rules)}
    assert found["dear"].seconds > 3 * found["cheap"].seconds and found["dear"].rejected == found["cheap"].rejected == 1.0 and found["never"].rejected == 0
    first = spark.range(1).select(F.lit(9).alias("n_words"), F.lit("a b").alias("text")).select(quality.cascade(rules[1:], list(found.values()))).first()[0]
    assert first == "cheap"


def test_sample_is_bounded(spark):
    d = spark.range(5000).select(F.concat(F.lit("t"), "id").alias("text")).union(spark.range(3).select(F.repeat(F.lit("x"), 200_000)))
    got = quality.sampled(d, "text", 100)
    assert got.count() == 100 and got.agg(F.max(F.length("text"))).first()[0] < 10
