"""Similarity join on word shingles: MinHash LSH forest, then exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, drop, written
from .components import components

SHINGLE = 5  # words
TREES, DEPTH = 20, 6  # prefix tries of a signature, and values in a trie's longest prefix
# Joins of texts by their ids are merge joins at every size (hint "merge"): no table of texts is gathered on the driver.
BLOCK, BLOCK_VALUES = 256, 1 << 21  # texts of a large group, and shingles of theirs, that one task compares with as many others
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(1, 2**31, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1); a table that grows as texts need it."""
    table = _tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table, dtype=np.uint64)
        if len(table) <= 1 << 22:
            _tables[int(base)] = table
    return table[:n]


def windows(text: str | None) -> np.ndarray:
    """64-bit hashes of the five-word windows; a shorter text is one window, no word none."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    inside = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64)))
    word = _mix((prefix[ends] - prefix[starts]) * _powers(_INVERSE, len(raw))[starts] + (ends - starts).astype(np.uint64))
    n = max(1, len(word) - SHINGLE + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(SHINGLE, len(word))):
        h = _mix(h + word[k : k + n] * _STEP[k])
    return h


def shingles(text: str | None) -> np.ndarray:
    """The set of window hashes, sorted."""
    return np.unique(windows(text))


def sketch(of: np.ndarray) -> bytes:
    """The signature: one byte per minhash value, DEPTH of them for each of TREES tries."""
    low = (of >> np.uint64(32)).astype(np.uint32) ^ of.astype(np.uint32)
    values = np.full(TREES * DEPTH, 2**32 - 1, dtype=np.uint32)
    for lo in range(0, len(low), 2048):
        h = low[None, lo : lo + 2048] * _A[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(values, h.min(axis=1), out=values)
    values = _mix(values.astype(np.uint64) + np.arange(TREES * DEPTH, dtype=np.uint64) * _BASE) >> np.uint64(56)
    return values.astype(np.uint8).tobytes()


def recall(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """Share of pairs of this similarity that agree on a prefix of ``depth`` values in a tree at least."""
    return 1 - (1 - similarity**depth) ** trees


def bounds(threshold: float) -> tuple[int, int]:
    """(low, high) counts of equal sketch values. Below ``low`` a pair is not at the threshold (by over four standard
    deviations); a text that agrees with a pivot on ``high`` finds all its partners among those that agree with it on ``low``,
    as Jaccard distance is a metric."""
    n = TREES * DEPTH
    low = threshold - 4 * (threshold * (1 - threshold) / n) ** 0.5
    high = min(1.0, low + (1 - threshold) + 4 * (0.09 / n) ** 0.5)
    return int(np.floor(low * n)), int(np.ceil(high * n))


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), TREES * DEPTH)


def _meet(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Which pairs of sketches agree on a prefix of ``depth`` values in a tree at least."""
    out = np.zeros((len(a), len(b)), dtype=bool)
    if not depth or depth > DEPTH:
        return out | (not depth)
    weights = np.int64(256) ** np.arange(depth, dtype=np.int64)
    keys = [x.reshape(len(x), TREES, DEPTH)[:, :, :depth].astype(np.int64) @ weights for x in (a, b)]
    for t in range(TREES):
        out |= keys[0][:, t][:, None] == keys[1][:, t][None, :]
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal values of every pair of sketches."""
    out = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(a.shape[1]):
        out += a[:, k][:, None] == b[:, k][None, :]
    return out


def similarities(left: list[np.ndarray], right: list[np.ndarray], candidates: np.ndarray, threshold: float) -> np.ndarray:
    """Jaccard similarities of the shingle sets of candidate pairs, 0 for those under ``threshold``."""
    sizes_a, sizes_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    common = np.zeros(candidates.shape, dtype=np.float32)
    if candidates.sum() * 8 < candidates.size:
        for i, j in zip(*np.nonzero(candidates), strict=True):
            if min(sizes_a[i], sizes_b[j]) >= threshold * max(sizes_a[i], sizes_b[j]):
                common[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:
        rows_a, rows_b = np.repeat(np.arange(len(left)), sizes_a), np.repeat(np.arange(len(right)), sizes_b)
        all_a, all_b = np.concatenate(left), np.concatenate(right)
        shared = np.intersect1d(all_a, all_b)
        for lo in range(0, len(shared), 8192):
            part = shared[lo : lo + 8192]
            hold = []
            for rows, values, n in ((rows_a, all_a, len(left)), (rows_b, all_b, len(right))):
                at = np.minimum(np.searchsorted(part, values), len(part) - 1)
                hit = part[at] == values
                m = np.zeros((n, len(part)), dtype=np.float32)
                m[rows[hit], at[hit]] = 1
                hold.append(m)
            common += hold[0] @ hold[1].T
    union = sizes_a[:, None] + sizes_b[None, :] - common
    linked = candidates & (common >= threshold * union - 1e-6) & (union > 0)
    return np.where(linked, common / np.maximum(union, 1), 0.0)


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of links, those that join what was apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two blocks of a task, and whether they are one and the same."""
    left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
    return (left, right, False) if len(right) else (left, left, True)


def _alike(rows: pd.DataFrame, low: int) -> list[tuple[int, int]]:
    """Of one task of a mixed node: links between texts of different parts whose sketches agree on ``low`` values, as a forest."""
    left, right, _ = _sides(rows)
    a, b = left["part"].to_numpy(), right["part"].to_numpy()
    near = (a[:, None] != b[None, :]) & (_agree(_sketches(left["sketch"]), _sketches(right["sketch"])) >= low)
    return _forest([(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(near), strict=True)])


def _compare(rows: pd.DataFrame, threshold: float, depth: int) -> Iterator[tuple[int, int | None, int, int, float]]:
    """Of one task of a group: per text (it, none, documents linked, texts linked, the sum of their chances to be found), and
    per link that joins what was apart (text, text, 0, 0, 0).

    Candidates agree on ``depth`` values of a tree, but nowhere on more, as these were met before; one of the two is open."""
    left, right, same = _sides(rows)
    sk = [_sketches(x["sketch"]) for x in (left, right)]
    active = [x["active"].to_numpy(dtype=bool) for x in (left, right)]
    candidates = _meet(*sk, depth) & ~_meet(*sk, depth + 1) & (active[0][:, None] | active[1][None, :])
    if same:
        np.fill_diagonal(candidates, False)
    sets = [[np.asarray(v, dtype=np.int64) for v in x["shingles"]] for x in ((left,) if same else (left, right))]
    found = similarities(sets[0], sets[-1], candidates, threshold)
    links, chance = found > 0, np.where(found > 0, recall(found, depth), 0.0)
    ids, weights = [x["rep"].to_numpy() for x in (left, right)], [x["copies"].to_numpy() for x in (left, right)]
    for side in (0,) if same else (0, 1):
        axis = 1 - side
        documents = (links * (weights[1][None, :] if side == 0 else weights[0][:, None])).sum(axis=axis)
        for i, n, k, p in zip(ids[side], documents, links.sum(axis=axis), chance.sum(axis=axis), strict=True):
            if k:
                yield int(i), None, int(n), int(k), float(p)
    for a, b in _forest([(int(ids[0][i]), int(ids[1][j])) for i, j in zip(*np.nonzero(links), strict=True)]):
        yield a, b, 0, 0, 0.0


def _tasks(members: DataFrame, blocks: DataFrame, columns: list[str], per_task: int) -> DataFrame:
    """Deals ``members`` (grp, rep, ``columns``) to tasks: a group's ``blocks`` (grp, n, blocks) meet two by two, each text
    in its own block and with each other one. Small groups share a task of about ``per_task`` texts; a large group's tasks are dealt
    out one by one. Adds low, high, side and task."""
    n = blocks.agg(F.sum("n")).first()[0] or 0
    spread = F.expr("transform(sequence(0, blocks - 1), b -> named_struct('low', least(block, b), 'high', greatest(block, b), 'side', if(block <= b, 0, 1)))")
    placed = members.join(blocks.select("grp", "blocks").hint("merge"), "grp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("at", F.explode(spread)).select("grp", "rep", *columns, "blocks", "at.*")
    shared = F.pmod(F.xxhash64("grp"), F.lit(max(1, n // per_task)))
    return placed.withColumn("task", F.when(F.col("blocks") == 1, shared).otherwise(F.xxhash64("grp", "low", "high")))


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a == b).sum(axis=1).astype(np.int32))], names=["rep", "pivot", "agree"])


def _groups(texts: DataFrame, depth: int, threshold: float) -> DataFrame:
    """(rep, grp): texts that may be linked, from the tries' nodes at ``depth``.

    Each text of a node is held against the node's pivot, its smallest text, by their sketches; those that agree enough are
    connected. Where this leaves a node in several components, its texts that are not close to the pivot meet one another in
    blocks. So no chain of chance meetings makes a group, and no node is one task.
    """
    low, high = bounds(threshold)
    at = F.expr(f"transform(sequence(0, {TREES - 1}), t -> substring(sketch, t * {DEPTH} + 1, {depth}))")
    nodes = texts.select("rep", "active", F.posexplode(at).alias("tree", "node"))
    met = nodes.groupBy("tree", "node").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.bool_or("active").alias("open")).where("pivot < last and open")
    held = written(nodes.join(met.select("tree", "node", "pivot").hint("merge"), ["tree", "node"]).where("rep != pivot").select(F.xxhash64("tree", "node").alias("grp"), "rep", "pivot"))
    sketches = texts.select("rep", "sketch")
    pairs = held.select("rep", "pivot").distinct().join(sketches.hint("merge"), "rep").join(sketches.toDF("pivot", "pivot_sketch").hint("merge"), "pivot")
    near = written(pairs.select("rep", "pivot", "sketch", "pivot_sketch").mapInArrow(_likeness, "rep long, pivot long, agree int"))
    links = near.where(F.col("agree") >= low).select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
    found = components(links)
    joined = found.withColumnsRenamed({"id": "rep", "component": "part"})
    mixed = held.join(near.where(F.col("agree") < low).select("rep", "pivot").hint("merge"), ["rep", "pivot"], "left_semi").select("grp").distinct()
    open_ = held.join(near.where(F.col("agree") < high).select("rep", "pivot").hint("merge"), ["rep", "pivot"], "left_semi").join(mixed.hint("merge"), "grp", "left_semi").select("grp", "rep").distinct()
    open_ = written(open_.join(joined.hint("merge"), "rep", "left").select("grp", "rep", F.coalesce("part", "rep").alias("part")))
    sizes = open_.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("grp", "n", F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("blocks"))
    sizes = written(sizes)
    if not sizes.isEmpty():
        tasks = _tasks(open_.join(sketches.hint("merge"), "rep"), sizes, ["sketch", "part"], 4096)

        def alike(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([x for _, task in rows.groupby(["grp", "low", "high"]) for x in _alike(task, low)], columns=["u", "v"]).astype("int64")

        more = written(tasks.groupBy("task").applyInPandas(alike, "u long, v long"))
        if not more.isEmpty():
            before, found = found, components(joined.select(F.col("rep").alias("u"), F.col("part").alias("v")).unionByName(more))
            drop(before)
        drop(more)
    drop(held, near, open_, sizes)
    out = found.withColumnsRenamed({"id": "rep", "component": "grp"})
    out._scratch = found._scratch
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8, target: float = 0.999, doc_id: str = "doc_id", text: str = "text", wordless_apart: bool = True) -> DataFrame:
    """A row per document: doc_id, class_id, copy_id, n_links.

    Documents are linked if the sets of their five-word windows have a Jaccard similarity of ``threshold`` or more. ``class_id`` is
    the smallest doc_id reached over links, ``copy_id`` the smallest with the same text, ``n_links`` the number of other documents
    linked directly.

    Copies are compared once. Candidates agree on a prefix in a trie, first of DEPTH values, then of fewer, for the texts that
    have not reached ``target``: the mean chance of being found over a text's verified links and one supposed at the threshold. So
    texts with many close links keep long prefixes, lonely ones have theirs shortened until pairs at the threshold itself reach the
    target. Every candidate pair is verified exactly, in blocks of bounded size; no pair is ever a row, only counts per text
    and links that join.

    Words are compared as they stand; a text of fewer than five is one window. Very long texts count in whole. A text without a
    word (null, empty) links to nothing and is a class of its own, or, if ``wordless_apart`` is false, a copy of the other
    such texts. Rows with a null doc_id are left out; rows of equal doc_id count as one document (one of their texts). Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def digest(t: str, doc: int, worded: bool) -> bytes:
        return hashlib.md5(t.encode("utf-8", "replace") if worded else b"\0%d" % doc if wordless_apart else b"\0").digest()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, sketches = [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                s = windows(t)
                copies.append(digest(t, doc, len(s) > 0))
                sketches.append(sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "copy", "sketch"])

    signed = written(rows.mapInArrow(sign, "doc_id long, copy binary, sketch binary"))
    one = written(signed.groupBy("doc_id").agg(F.min("copy").alias("copy")))
    classes = written(one.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    first = signed.where("sketch is not null").join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["doc_id", "copy"]).dropDuplicates(["doc_id"])
    texts = written(first.select(F.col("doc_id").alias("rep"), "copy", "copies", "sketch", F.lit(True).alias("active")))
    drop(signed)
    verified: list[DataFrame] = []
    for depth in range(DEPTH, 0, -1):
        found = _verified(rows, texts, depth, threshold)
        if found is not None:
            verified.append(found)
        if recall(threshold, depth) >= target:
            break
        if verified:
            per = reduce(DataFrame.unionByName, verified).where("other is null").groupBy("rep").agg(F.sum("k").alias("k"), F.sum("chance").alias("chance"))
            settled = per.where((F.col("chance") + float(recall(threshold, depth))) / (F.col("k") + 1) >= target).select("rep", F.lit(False).alias("open"))
            last, texts = texts, written(texts.join(settled.hint("merge"), "rep", "left").withColumn("active", F.coalesce("open", F.lit(True))).drop("open"))
            drop(last)
    drop(texts)
    own = classes.select("copy", "rep", "copies")
    if not verified:
        per = own.select("copy", "rep", F.col("rep").alias("class_id"), (F.col("copies") - 1).alias("n_links"))
    else:
        found = reduce(DataFrame.unionByName, verified)
        linked = components(found.where("other is not null").select(F.col("rep").alias("u"), F.col("other").alias("v")))
        degree = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
        per = own.join(degree.hint("merge"), "rep", "left").join(linked.withColumnsRenamed({"id": "rep"}).hint("merge"), "rep", "left")
        per = per.select("copy", "rep", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return one.join(per.hint("merge"), "copy").select("doc_id", "class_id", F.col("rep").alias("copy_id"), "n_links")


def _verified(rows: DataFrame, texts: DataFrame, depth: int, threshold: float) -> DataFrame | None:
    """(rep, other, links, k, chance) of the candidates first met at ``depth``, as _compare gives them; none without a group."""
    groups = _groups(texts, depth, threshold)
    members = written(groups.join(texts.hint("merge"), "rep"))
    drop(groups)
    if members.isEmpty():
        return None

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for i, (t, copy) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), strict=True)):
                t = t.as_py() or ""
                if hashlib.md5(t.encode("utf-8", "replace")).digest() == copy:  # of rows with one doc_id the one that was signed
                    at.append(i)
                    values.append(shingles(t).view(np.int64))
            kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 3, 4, 5, 6)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values, pa.list_(pa.int64()))], names=["rep", "grp", "copies", "active", "sketch", "shingles"])

    # Only ids are broadcast, to keep other texts from being shuffled; the rest of a text's row meets it in a merge join.
    wanted = bounded(members.select("rep"), 200_000)
    with_text = rows.withColumnRenamed("doc_id", "rep").join(wanted, "rep", "left_semi").join(members.hint("merge"), "rep").select("rep", "text", "copy", "grp", "copies", "active", "sketch")
    made = written(with_text.mapInArrow(sets, "rep long, grp long, copies long, active boolean, sketch binary, shingles array<long>"))
    sizes = made.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("values"))
    sizes = written(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("values") / BLOCK_VALUES)).cast("int")))
    columns = ["copies", "active", "sketch", "shingles"]
    tasks = _tasks(made, sizes, columns, 512)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "grp", "low", "high", "side"])
        out = [x for _, part in rows.groupby(["grp", "low", "high"]) for x in _compare(part, threshold, depth)]
        table = pd.DataFrame(out, columns=["rep", "other", "links", "k", "chance"])
        return table.astype({"rep": "int64", "other": "Int64", "links": "int64", "k": "int64", "chance": "float64"})

    found = written(tasks.groupBy("task").applyInPandas(compare, "rep long, other long, links long, k long, chance double"))
    drop(members, made, sizes)
    return found
