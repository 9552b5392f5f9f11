"""Hard negatives by product quantisation: lookup-table scores with residual bounds choose candidates, exact products decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, written

PART, WORDS, ROUNDS = 2, 256, 8  # coordinates of a part, code words of a part, rounds of their fitting
SAMPLE_VALUES = 1 << 18  # components, at most about, that the code words of all dimensions are fitted on
BLOCK_VALUES = 1 << 19  # components of the rows, and of the anchors, that meet in one task
LEAST, MOST = -(2**63), 2**63 - 1  # scores beyond 64 bits are cut to these
TAME = 1e150  # lengths from which on bounds are not computed, and all rows are candidates
_FOUND = "anchor long, k int, vec_id long, score long"


def fit_words(sample: np.ndarray, words: int = WORDS, rounds: int = ROUNDS) -> np.ndarray:
    """Code words by k-means, [parts, words, PART], for vectors padded to whole parts. Without a sample the one word is zero."""
    parts = -(-sample.shape[1] // PART)
    if not len(sample) or not parts:
        return np.zeros((parts, 1, PART))
    x = np.pad(sample, ((0, 0), (0, parts * PART - sample.shape[1]))).reshape(len(sample), parts, PART)
    rng = np.random.default_rng(11)
    out = x[rng.permutation(len(x))[: min(words, len(x))]].transpose(1, 0, 2).copy()
    for p in range(parts):
        for _ in range(rounds):
            code = nearest(x[:, p], out[p])
            n = np.bincount(code, minlength=len(out[p]))
            for c in range(PART):
                total = np.bincount(code, weights=x[:, p, c], minlength=len(n))
                out[p, n > 0, c] = total[n > 0] / n[n > 0]
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(axis=1)[None, :] - 2 * (x @ words.T)).argmin(axis=1)


def quantise(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [rows, parts] and the lengths of what each part leaves, rounded up."""
    parts = len(words)
    x = np.pad(x, ((0, 0), (0, parts * PART - x.shape[1]))).reshape(len(x), parts, PART)
    codes, rest = np.zeros((len(x), parts), dtype=np.uint8), np.zeros((len(x), parts), dtype=np.float32)
    with np.errstate(all="ignore"):
        for p in range(parts):
            codes[:, p] = nearest(x[:, p], words[p])
            left = np.sqrt(((x[:, p] - words[p][codes[:, p]]) ** 2).sum(axis=1))
            rest[:, p] = np.nextafter(np.nan_to_num(left * (1 + 1e-9), nan=np.inf).astype(np.float32), np.float32(np.inf))
    return codes, rest


def _vectors(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(n, -1)


def _bytes(column: pa.ChunkedArray, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(n, -1)


class Block:
    """Rows of one task: exact vectors, and codes with what they leave."""

    def __init__(self, rows: pa.Table, words: np.ndarray):
        n = rows.num_rows
        self.ids, self.labels = rows["vec_id"].to_numpy(), np.asarray(rows["label"])
        self.x, self.words = _vectors(rows["v"], n), words
        self.codes = np.ascontiguousarray(_bytes(rows["codes"], n, np.uint8).T)
        self.rest = np.ascontiguousarray(_bytes(rows["rest"], n, np.float32).T).astype(np.float64)
        with np.errstate(over="ignore"):
            self.longest = float(np.sqrt((self.x**2).sum(axis=1)).max(initial=0))
        self.most = float(np.abs(self.x).max(initial=0))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Between which values the product of ``q`` with each row lies: the sum of looked-up products of parts, give or take the sum
        of the products of lengths that a part's remainder can add."""
        with np.errstate(over="ignore"):
            size = float(np.sqrt((q**2).sum()))
        if not (size < TAME and self.longest < TAME):
            return np.full(len(self.ids), -np.inf), np.full(len(self.ids), np.inf)
        parts = np.pad(q, (0, len(self.words) * PART - len(q))).reshape(len(self.words), PART)
        table = np.einsum("pwc,pc->pw", self.words, parts)
        score = np.zeros(len(self.ids))
        for p in range(len(table)):
            score += table[p].take(self.codes[p])
        off = np.sqrt((parts**2).sum(axis=1)) @ self.rest + 1e-9 * (size * self.longest + 1)
        return score - off, score + off

    def products(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer products with the rows ``at``."""
        with np.errstate(over="ignore"):
            whole = self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2**52
        if whole:
            return (self.x[at] @ q).astype(np.int64)
        own = [int(c) for c in q]
        return np.array([min(max(sum(int(a) * b for a, b in zip(row, own, strict=True)), LEAST), MOST) for row in self.x[at]], dtype=np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, ~scores))[:k]  # ~ turns the order round without overflow


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest value; -inf if there are fewer."""
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def positives_of(block: Block, anchor: int, q: np.ndarray, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the block's k best rows with the anchor's label, the anchor left out."""
    at = np.flatnonzero((block.labels == label) & (block.ids != anchor))
    low, high = block.bounds(q)
    at = at[high[at] >= _kth(low[at], k)]
    scores = block.products(q, at)
    best = _best(block.ids[at], scores, k)
    return block.ids[at][best], scores[best]


def negatives_of(block: Block, anchor: int, q: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of scores the ids and scores of the block's k best rows of other labels in it, the anchor's id left out.

    A row is a candidate if its bounds reach into the window and its upper bound reaches the k-th largest lower bound of rows
    that are in the window for certain; exact products then complete the window.
    """
    other = np.flatnonzero((block.labels != label) & (block.ids != anchor))
    low, high = block.bounds(q)
    low, high = low[other], high[other]
    masks = []
    for least, most in windows:
        near = (high >= least) & (low <= most)
        certain = low[near & (low >= least) & (high <= most)]
        masks.append(near & (high >= _kth(certain, k)))
    wanted = np.flatnonzero(np.logical_or.reduce(masks)) if masks else np.zeros(0, np.int64)
    scores = block.products(q, other[wanted])
    ids = block.ids[other[wanted]]
    out = []
    for mask, (least, most) in zip(masks, windows, strict=True):
        at = np.flatnonzero(mask[wanted] & (scores >= max(least, LEAST)) & (scores <= min(most, MOST)))
        best = at[_best(ids[at], scores[at], k)]
        out.append((ids[best], scores[best]))
    return out


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """The whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(anchors: DataFrame, rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` (anchor_id, label, v) and ``rows`` (vec_id, label, v) hold vectors of whole doubles. A score is the integer product with the
    anchor. An anchor's positives are its ``positives`` best other rows of the same label; for each of them the ``negatives`` best rows
    of another label whose score s has low * p <= 100 * s <= high * p, p the positive's score, are returned, ranked from 1. Ties go to the smaller
    vec_id; where there are fewer rows, all of them.

    Rows with a null id, label or vector take no part; an anchor meets rows of its own dimension with another id. Rows that share an id
    count each; equal anchor rows are one anchor, unequal ones with one id several. Products are exact whatever the size of components; a score beyond
    64 bits is cut to the end of its range. A zero vector takes part. Empty tables give no rows; other columns are ignored.

    Code words are fitted on a sample of SAMPLE_VALUES components; they move work only, as every row is indexed, the bounds hold for any
    words, and exact products decide. Rows in blocks meet anchors in chunks.
    """
    spark = rows.sparkSession
    whole = lambda df, name: df.where(F.col(name).isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).select(F.col(name).cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>").alias("v"))
    base = whole(rows, "vec_id")
    base = written(base.select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("n")))
    asked = whole(anchors, "anchor_id").distinct().select("*", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("anchor"))
    asked = written(asked)
    per = {r["dim"]: r["count"] for r in base.groupBy("dim").count().collect()}  # a row per dimension
    if not per:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chunks = {r["dim"]: -(-r["count"] * r["dim"] // BLOCK_VALUES) or 1 for r in asked.groupBy("dim").count().collect()}
    shares = [(dim, count, SAMPLE_VALUES // len(per) // max(1, dim), -(-count * dim // BLOCK_VALUES) or 1, chunks.get(dim, 0)) for dim, count in per.items()]
    plan = F.broadcast(spark.createDataFrame(shares, "dim int, rows long, share long, blocks int, chunks int"))
    dealt = base.join(plan, "dim")
    sample = dealt.where(F.pmod(F.xxhash64("n"), F.col("rows")) < F.col("share")).select("dim", "v").toArrow()
    words, dims = {}, np.asarray(sample["dim"])
    for dim in per:
        taken = sample.filter(pa.array(dims == dim))
        words[dim] = fit_words(_vectors(taken["v"], taken.num_rows) if taken.num_rows else np.zeros((0, dim)))
    shared = spark.sparkContext.broadcast(words)

    def index(batches):
        for batch in batches:
            d = np.asarray(batch.column(4))
            codes, rest = [b""] * len(d), [b""] * len(d)
            for dim in np.unique(d):
                at = np.flatnonzero(d == dim)
                x = _vectors(pa.chunked_array([batch.column(2).take(pa.array(at))]), len(at))
                for i, c, r in zip(at, *quantise(x, shared.value[int(dim)]), strict=True):
                    codes[i], rest[i] = c.tobytes(), r.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(rest, pa.binary())], names=[*batch.schema.names, "codes", "rest"])

    block = F.pmod(F.xxhash64("n"), F.col("blocks")).cast("int").alias("block")
    shape = "vec_id long, label long, v array<double>, n long, dim int, block int, chunks int, codes binary, rest binary"
    indexed = written(dealt.select("vec_id", "label", "v", "n", "dim", block, "chunks").mapInArrow(index, shape))
    drop(base)
    spread = indexed.where("chunks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "n")
    asked = asked.join(plan.select("dim", "blocks", "chunks"), "dim").withColumn("chunk", F.pmod(F.xxhash64("anchor"), F.col("chunks")).cast("int"))
    keys = ["dim", "chunk", "block"]

    def met(some: DataFrame, work) -> DataFrame:
        """What ``work`` yields of every anchor in every block, (k, ids, scores), as rows."""

        def one(a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[list] = [[], [], [], []]
            if a.num_rows and b.num_rows:
                of = Block(b, shared.value[a["dim"][0].as_py()])
                for row, q in zip(a.select(["anchor", "anchor_id", "label", *(["windows"] if "windows" in a.column_names else [])]).to_pylist(), _vectors(a["v"], a.num_rows), strict=True):
                    for k, ids, scores in work(of, row, q):
                        for column, values in zip(out, ([row["anchor"]] * len(ids), [k] * len(ids), ids, scores), strict=True):
                            column.extend(values)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["anchor", "k", "vec_id", "score"])

        every = some.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "chunks")
        return every.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(one, _FOUND)

    def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def own(of: Block, row: dict, q: np.ndarray):
        yield 0, *positives_of(of, row["anchor_id"], q, row["label"], positives)

    def others(of: Block, row: dict, q: np.ndarray):
        ks = [(w["k"], window(w["score"], low, high)) for w in row["windows"]]
        for (k, _), (ids, scores) in zip(ks, negatives_of(of, row["anchor_id"], q, row["label"], [w for _, w in ks], negatives), strict=True):
            yield k, ids, scores

    first = written(ranked(met(asked, own), ["anchor"], positives).select("anchor", F.col("rank").alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = first.where("positive_score >= 0").groupBy("anchor").agg(F.collect_list(F.struct("k", F.col("positive_score").alias("score"))).alias("windows"))  # no score has a window under a negative one
    second = ranked(met(asked.join(windows, "anchor"), others), ["anchor", "k"], negatives).select("anchor", "k", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = second.join(first, ["anchor", "k"]).join(asked.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def relabelled(label: Column, vec_id: Column, every: int = 7, labels: int = 10) -> Column:
    """The label moved on by one where the id is divisible by ``every``, so that some neighbours disagree; a null id moves nothing."""
    return F.when(vec_id % every == 0, (label + 1) % labels).otherwise(label)
