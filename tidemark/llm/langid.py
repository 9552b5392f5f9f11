"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS, BUCKETS = (1, 2, 3), 1 << 14
CHUNK = 1 << 20  # code points handled at once
LETTER = re.compile(r"[^\W\d_]")  # also numerals like a superscript two, which are no letters
MOST_LANGS, MOST_ROWS = 2000, 200_000  # languages, and sampled rows of all of them
HASHES = 1 << 62
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def lettered(text: str | None) -> bool:
    return text is not None and any(m[0].isalpha() for m in LETTER.finditer(text))


def _buckets(codes: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    h = codes[: len(codes) - order + 1] * _MULTIPLIERS[0]
    for k in range(1, order):
        h = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[1] + codes[k : len(codes) - order + 1 + k] * _MULTIPLIERS[2]
    h ^= h >> np.uint32(13)
    return (h * _MULTIPLIERS[0]) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of lower-case character n-grams: rows x BUCKETS) for slices of ``texts``, whole texts."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    row = 0
    while row < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(lengths[row : row + 256]), CHUNK, side="right")))
        part = texts.slice(row, n)
        lens = lengths[row : row + n]
        codes = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.cumsum(lens)
        out = np.zeros(n * BUCKETS, dtype=np.float32)
        for lo in range(0, len(codes), CHUNK):
            here = codes[lo : lo + CHUNK + max(ORDERS) - 1]
            docs = np.repeat(np.arange(n), np.diff(np.clip(np.concatenate(([0], ends)) - lo, 0, min(CHUNK, len(codes) - lo))))
            for order in ORDERS:
                if len(here) >= order:
                    b = _buckets(here, order)[:CHUNK].astype(np.int64)
                    at = docs[: len(b)] * BUCKETS + b
                    crossing = (ends[:-1, None] - np.arange(1, order)[None, :]).ravel() - lo  # n-grams over two texts
                    crossing = np.concatenate((crossing, (ends[-1:, None] - np.arange(1, order)[None, :]).ravel() - lo))
                    keep = np.ones(len(at), dtype=bool)
                    keep[crossing[(crossing >= 0) & (crossing < len(at))]] = False
                    out += np.bincount(at[keep], minlength=n * BUCKETS).astype(np.float32)
        yield row, out.reshape(n, BUCKETS)
        row += n


def _weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    rows: int = 0  # texts that the weights were learnt from

    def scores(self, c: np.ndarray) -> np.ndarray:
        z = (_weighted(c, self.idf) @ self.weights + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader (proximal, per coordinate) with elastic-net penalties on sparse rows."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            i, x = np.append(rows[r][0].astype(np.int64), BUCKETS), np.append(rows[r][1].astype(np.float64), 1.0)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[r]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search."""

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        top = s.max(axis=1)
        return float(np.mean(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top - s[np.arange(len(s)), labels]))

    if not len(logits):
        return 1.0
    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 4) == 2, F.lit(False))


def share(texts: int, rows: int) -> int:
    """Up to which hash of HASHES a language's texts are taken, so that about ``rows`` of its ``texts`` different ones are; 1 at least."""
    return min(HASHES, max(1, rows * HASHES // max(1, texts)))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 1000, calibration: float = 0.25) -> Model | None:
    """Learns from ``docs``: document frequencies from all of them, weights from a bounded sample.

    At most about ``rows_per_lang`` different labelled texts per language (fewer where MOST_ROWS among all languages is less), by a hash of
    the text, are used for the weights, so that no repeated id or text fills the sample; the share ``calibration`` of them sets the temperature. None without any labelled row.
    More than MOST_LANGS languages are an error, as the weights are held by every task.
    """
    learn = docs.where(F.col(lang).isNotNull()).select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    different = F.approx_count_distinct(F.when(F.length("text") > 0, F.xxhash64("text"))).alias("texts")
    per = {r["lang"]: r["texts"] for r in learn.groupBy("lang").agg(different).limit(MOST_LANGS + 1).collect()}
    if not per:
        return None
    if len(per) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = tuple(sorted(per))
    rows_per_lang = max(1, min(rows_per_lang, MOST_ROWS // len(langs)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for _, c in counts(batch.column(0)):
                total += (c > 0).sum(axis=0)
                n += len(c)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["bucket", "n"])

    sums = learn.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = next((r["n"] for r in sums if r["bucket"] < 0), 0)
    df = np.zeros(BUCKETS)
    for r in sums:
        if r["bucket"] >= 0:
            df[r["bucket"]] = r["n"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    shares = learn.sparkSession.createDataFrame([(name, share(count, rows_per_lang)) for name, count in per.items()], "lang string, share long")
    hashed = learn.where(F.length("text") > 0).withColumn("h", F.xxhash64("text")).join(F.broadcast(shares), "lang")
    sample = hashed.where(F.pmod("h", F.lit(HASHES)) < F.col("share")).groupBy("lang", "h").agg(F.min(F.struct("id", "text")).alias("one")).select("one.id", "one.text", "lang")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, c in counts(batch.column(1)):
                x = _weighted(c, idf)
                at = [np.flatnonzero(r) for r in x]
                ids, labels = batch.column(0).slice(row, len(c)), batch.column(2).slice(row, len(c))
                kinds = pa.list_(pa.int32()), pa.list_(pa.float32())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(at, kinds[0]), pa.array([r[i] for r, i in zip(x, at, strict=True)], kinds[1])], names=["id", "lang", "at", "x"])

    def fit(sample: pa.Table) -> pa.Table:
        """The model of the sample, which is of bounded size: weights from most of it, the temperature from the rest."""
        taken = sample.sort_by([("id", "ascending"), ("lang", "ascending")])
        labels = np.array([langs.index(v) for v in taken.column("lang").to_pylist()], dtype=np.int64)
        rows = [(a.values.to_numpy(), x.values.to_numpy()) for a, x in zip(taken.column("at"), taken.column("x"), strict=True)]  # views, no copies
        tune = np.random.default_rng(1).random(len(rows)) < calibration
        chosen = [i for i in range(len(rows)) if not tune[i]] or list(range(len(rows)))
        w, b = fit_ftrl([rows[i] for i in chosen], labels[chosen], len(langs))
        held = np.flatnonzero(tune)
        logits = np.array([rows[i][1].astype(np.float64) @ w[rows[i][0]] + b for i in held])
        return pa.table({"w": [w.astype("<f4").tobytes()], "b": [b.astype("<f4").tobytes()], "t": [float(temperature(logits, labels[held]))], "rows": [len(chosen)]})

    # The sample is fitted in one task, not on the driver, which gets the weights alone.
    fitted = sample.mapInArrow(features, "id string, lang string, at array<int>, x array<float>").withColumn("model", F.lit(0)).groupBy("model").applyInArrow(fit, "w binary, b binary, t double, rows long").collect()
    if not fitted:
        return Model(langs, idf, np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32), 1.0)
    w, b, t, n = fitted[0]
    return Model(langs, idf, np.frombuffer(w, "<f4").reshape(BUCKETS, len(langs)).copy(), np.frombuffer(b, "<f4").copy(), t, n)


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns ``names``, language and score; ``und`` and 0 where text is null or has no letter, or nothing was learnt.
    Columns of these names are replaced."""
    docs = docs.drop(*names)
    spark, columns = docs.sparkSession, docs.columns
    shared = spark.sparkContext.broadcast(model)
    place = columns.index(text)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(place)
            with_letter = np.array([lettered(t.as_py()) for t in texts], dtype=bool)
            best, score = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
            if m is not None:
                for row, c in counts(texts):
                    p = m.scores(c)
                    best[row : row + len(c)], score[row : row + len(c)] = p.argmax(axis=1), p.max(axis=1)
            known = with_letter & (m is not None)
            lang = [m.langs[k] if ok else "und" for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=[*columns, *names])

    kept = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(classify, f"{kept}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, text, held_out, lang_pred and score of every row; held-out rows are not learnt from.

    Every row is judged by its whole text alone. Null or empty texts and texts without a letter are
    ``und`` (numerals like a superscript two are no letters). Very long texts count in whole. Rows with a null lang are predicted but
    not learnt from; repeated rows count in the frequencies as often as they stand, for the weights once. A null id is not held out. Of
    languages with equal scores the first in order wins. Other columns are ignored. Without labelled rows all are ``und``; empty input gives no rows.
    """
    model = train(docs.where(~held_out(F.col(doc_id))), doc_id, text, lang, **options)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    return predict(rows, model)
