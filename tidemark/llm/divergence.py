"""How far the sources of a language differ in their words: exact sums, dense for common terms and sparse for rare ones."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, written

SCALE = 1_000_000_000
TILE = 128  # sources of a language on each side of a tile
CHUNK = 1 << 17  # counts of terms, about, whose share of a language's sums one task adds for a tile
HEAVY = 3  # a term is heavy if at least one in so many of the language's groups has it
ENTRIES, SLICE = 400_000, 1 << 22  # terms held before they are sent on; bytes of a very long text that are split at once
PAIRS = 1 << 20  # pairs of counts of a rare term corrected at once
# Fixed rule: a term is a run of ASCII letters and characters beyond ASCII; only A to Z are lower-cased. In UTF-8 that is a rule on bytes.
_BYTES = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    raw = text.encode("utf-8", "replace").translate(_BYTES)
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + SLICE)
        hi = len(raw) if hi < 0 else hi
        yield raw[lo:hi].split()
        lo = hi


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition, with the term null for the group itself; one row of a key as long as memory allows."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (n, docs) in groups.items():
            for column, values in zip(out, ([lang] * (len(n) + 1), [source] * (len(n) + 1), [None, *n], [0, *n.values()], [0, *map(docs.__getitem__, n)]), strict=True):
                column += values
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held: set[bytes] = set()
            for terms in terms_of(text.as_py() or ""):
                n.update(terms)
                held.update(terms)
            docs.update(held)
        if sum(len(n) for n, _ in groups.values()) > ENTRIES:
            yield rows()
            groups.clear()
    if groups:
        yield rows()


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)), exact: both are at most 10^9 + 1."""
    return (p - q) * (p - q) // (p + q)


def rare_pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool, base: tuple[np.ndarray, np.ndarray], out: np.ndarray) -> None:
    """Adds to ``out`` what pairs of counts of the same rare term change, beyond what each count changes against an absent one.

    Sides are (term, place, p), sorted by term.
    """
    starts, ends = np.searchsorted(right[0], left[0], "left"), np.searchsorted(right[0], left[0], "right")
    met = ends - starts
    cut = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(met) // PAIRS)) + 1, [len(met)]))
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        i = np.repeat(np.arange(lo, hi), met[lo:hi])
        j = np.arange(len(i)) - np.repeat(np.cumsum(met[lo:hi]) - met[lo:hi], met[lo:hi]) + np.repeat(starts[lo:hi], met[lo:hi])
        if same:
            i, j = i[left[1][i] < right[1][j]], j[left[1][i] < right[1][j]]
        g, h, p, q = left[1][i], right[1][j], left[2][i], right[2][j]
        a, b = base[0][g], base[1][h]
        np.add.at(out, (g, h), divergence(p, q) - divergence(p, b) - divergence(a, q) + divergence(a, b))


def rare_singles(side: tuple[np.ndarray, ...], own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """[own, other]: what the rare terms of the side's groups change against groups that lack them. Equal p of a group count once."""
    out = np.zeros((len(own), len(other)), dtype=np.int64)
    if not len(side[0]):
        return out
    (place, p), n = np.unique(np.stack([side[1], side[2]]), axis=1, return_counts=True)
    for h, b in enumerate(other):
        np.add.at(out[:, h], place, n * (divergence(p, b) - divergence(own[place], b)))
    return out


def tile(groups: pa.Table, counts: pa.Table) -> pa.Table:
    """Of one chunk of terms and two blocks of a language's groups: (g, h, value) of every pair with g < h.

    The first chunk adds what all kept terms would make if none of the groups had them. Heavy terms that one of the blocks has fill dense tiles, which
    correct it; of rare terms single counts and pairs of counts do.
    """
    same = groups["i"][0].as_py() == groups["j"][0].as_py()
    first, kept = groups["chunk"][0].as_py() == 0, groups["kept"][0].as_py()
    sides, base = [], []
    for side in (0,) if same else (0, 1):
        own = groups.filter(pa.array(np.asarray(groups["side"]) == side)).sort_by("place")
        base.append((np.asarray(own["place"]), np.asarray(own["base"])))
        of = counts.filter(pa.array(np.asarray(counts["side"]) == side)) if counts.num_rows else counts
        order = np.argsort(np.asarray(of["tid"]), kind="stable")
        place = np.searchsorted(base[-1][0], np.asarray(of["place"]))
        sides.append(tuple(x[order] for x in (np.asarray(of["tid"]), place, np.asarray(of["p"]), np.asarray(of["heavy"]).astype(bool))))
    if same:
        sides, base = sides * 2, base * 2
    (at_i, b_i), (at_j, b_j) = base
    out = np.zeros((len(at_i), len(at_j)), dtype=np.int64)
    light = [tuple(x[~s[3]] for x in s[:3]) for s in sides]
    if first:
        out += kept * divergence(b_i[:, None], b_j[None, :])
    singles = rare_singles(light[0], b_i, b_j)
    out += singles + (singles.T if same else rare_singles(light[1], b_j, b_i).T)
    rare_pairs(light[0], light[1], same, (b_i, b_j), out)
    heavy = [tuple(x[s[3]] for x in s[:3]) for s in sides]
    tids = np.union1d(heavy[0][0], heavy[1][0])
    dense = []
    for (tid, place, p), b in zip(heavy, (b_i, b_j), strict=True):
        m = np.repeat(b[None, :], len(tids), axis=0)
        m[np.searchsorted(tids, tid), place] = p
        dense.append(m)
    for g in range(len(at_i)):
        out[g] += divergence(dense[0][:, g][:, None], dense[1]).sum(axis=0) - len(tids) * divergence(b_i[g], b_j)
    g, h = np.nonzero(at_i[:, None] < at_j[None, :])
    return pa.table([pa.array([groups["lang"][0].as_py()] * len(g), pa.string()), pa.array(at_i[g]), pa.array(at_j[h]), pa.array(out[g, h])], names=["lang", "g", "h", "value"])


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), in decimals, as n * 10^9 may pass 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", (wide(n) + F.lit(2)) * F.lit(SCALE), wide(total) + wide(kept) * F.lit(2))).cast("long")


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: per group (language and source) how far every other source of the language is from it (part
    ``pair``), and the ``top`` terms that it uses more than its language (part ``term``).

    Terms are those in at least ``least_docs`` documents of the language. p is 1 + floor(10^9 (count + 2) / (N + 2 V)), N the sum of
    the counts of a group, or of the language, over the V kept terms; p and q are floor((p - q)^2 / (p + q)) apart. A pair's value is the sum over all
    kept terms, present or not. Ranks run from 1 by value, the highest first, then by item in UTF-8.

    Null texts, languages and sources are ''. Every row is a document, whatever its id. A group without terms is a group like any other; a
    language without kept terms has values of 0; a language of one source has no pair. Very long texts count in whole. Other columns are ignored, whatever
    their names; an empty table gives no rows. The result has a row per ordered pair of sources of a language.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("holders")).where(F.col("docs") >= least_docs)
    kept = written(kept.select("lang", "term", "total", "holders", F.monotonically_increasing_id().alias("tid")))
    held = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "tid", "n", "total", "holders"))
    alone = counts.where("term is null").select("lang", "source")
    width = alone.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    heavy = F.col("holders") * HEAVY >= F.col("groups")
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"), F.sum("holders").alias("counts"))
    none = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "lang_total", "counts", "own_total")}
    groups = alone.join(held.groupBy("lang", "source").agg(F.sum("n").alias("own_total")), ["lang", "source"], "left").join(width, "lang").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", "groups", *none.values(), (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("place"))
    base = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("own_total"), F.when(F.col("kept") > 0, F.col("kept")))).otherwise(F.lit(1))
    groups = written(groups.select("*", base.cast("long").alias("base"), F.greatest(F.lit(1), F.ceil(F.col("counts") / CHUNK)).cast("int").alias("chunks"), F.ceil(F.col("groups") / TILE).cast("int").alias("blocks"), F.floor(F.col("place") / TILE).cast("int").alias("block")))
    p = _share(F.col("n"), F.col("own_total"), F.col("kept"))
    of_group = held.join(groups, ["lang", "source"]).select("lang", "source", "term", "tid", "total", "lang_total", "kept", "place", "block", "blocks", "chunks", heavy.alias("heavy"), p.alias("p"))
    of_group = written(of_group)

    # A group's counts go to each tile of its block with another block: in the first place with those after it, in the second with those before.
    spread = F.expr("transform(sequence(0, blocks - 1), b -> named_struct('i', least(block, b), 'j', greatest(block, b), 'side', if(block <= b, 0, 1)))")
    keys = ["lang", "chunk", "i", "j"]
    parts = of_group.withColumn("chunk", F.pmod(F.xxhash64("tid"), F.col("chunks")).cast("int")).withColumn("at", F.explode(spread)).select("lang", "chunk", "at.*", "tid", "place", "p", "heavy")
    sides = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("at", F.explode(spread)).select("lang", "chunk", "at.*", "place", "base", "kept")
    sums = sides.groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(tile, "lang string, g long, h long, value long")
    sums = written(sums.groupBy("lang", "g", "h").agg(F.sum("value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value"))
    names = groups.select("lang", "place", "source")
    pair = both.join(names.withColumnRenamed("place", "g"), ["lang", "g"]).join(names.withColumnsRenamed({"place": "h", "source": "item"}), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    q = _share(F.col("total"), F.col("lang_total"), F.col("kept"))
    term = of_group.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    drop(counts, kept, held)
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
