"""The corpus operators as queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, hard_negatives, html_text, jaccard, langid, line_dedup, mixing, packing, quality, secrets, sharding, topk

SHARDS = 24


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best integer products of every vector whose id is divisible by 50 with all others; see ``topk.top_k`` for odd rows."""
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "v")
    return topk.top_k(asked, rows, 5)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, cut and packed into sequences of 1,024 tokens; a null text is the one token of its end."""
    return packing.pack_documents(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters and more that five documents hold stay in the largest of them; a null text is one empty line."""
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdicts of every document; null and empty texts fail the base rule."""
    out = quality.filter_quality(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every text with its score, by a forest that learns from made-up findings; texts without one give no row."""
    found = secrets.scan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards by its key, with its place there and its shard of 25; null keys share one."""
    docs = _read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [(F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = sharding.shard(docs, "doc_id", [1.0] * SHARDS, [1.0] * (SHARDS + 1), columns)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those not held out; ``und`` where there is no letter."""
    return langid.identify(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, first copy and links of every document; rows without an id are left out."""
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; "" where there is none."""
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document, and the shard and place that the tree dealt each of its two copies at most."""
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    at = lambda k, field: F.try_element_at("places", F.lit(k))[field].alias(f"{field}_{k}")
    return out.select(F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("copies")).alias("taken"), "copies", at(1, "shard"), at(1, "place"), at(2, "shard"), at(2, "place"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three hardest negatives for each of the five best positives of every vector whose id is divisible by 50; see ``hard_negatives.mine``
    for odd rows."""
    rows = _read(spark, sf_dir, "embeddings")
    label = hard_negatives.relabelled(F.col("label").cast("long"), F.col("vec_id"))
    rows = rows.select("vec_id", label.alias("label"), topk.integers(F.col("embedding")).alias("v"))
    anchors = rows.where(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "anchor_id")
    return hard_negatives.mine(anchors, rows)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the bytes that they decode to, as digests; a null text has no ids."""
    ids = byte_bpe.encode(_read(spark, sf_dir, "documents"), columns=["doc_id"])
    out = byte_bpe.decode(ids, columns=["doc_id", "ids"])
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sources of a language, and the terms that each source uses most beyond its language."""
    return divergence.audit(_read(spark, sf_dir, "documents"))


def mix_source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's size and target, and whether its taken words are within its longest document of it."""
    out = mixing.mix(_read(spark, sf_dir, "documents")).groupBy(F.col("__source").alias("source"))
    out = out.agg(F.sum("__size").alias("size"), F.first("target").alias("target"), F.sum(F.col("__size") * F.col("copies")).alias("taken"), F.max("__size").alias("most"))
    return out.select("source", "size", F.round("target", 6).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= F.greatest("most", F.lit(1))).alias("near"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_topk_search, op2_best_fit_packing, op3_line_dedup, op4_quality_rules, op5_secret_scan, op6_sharding, op7_language_id, op8_ngram_jaccard_join, op9_html_extraction, op10_source_mixing, op11_hard_negatives, op12_byte_bpe, op13_source_divergence, mix_source_targets)
}

_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_line_dedup": r"""
        WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
        k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        c AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
        m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone FROM k LEFT JOIN c USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op4_quality_rules": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
        g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p),
        d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g),
        r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM d, (VALUES (0), (1), (2)) v(o) WHERE n >= 2 GROUP BY doc_id),
        l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
        s AS (SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, len(l.l) AS lines, coalesce(r.n, 0) AS n_repeat_words,
                     length(regexp_replace(w.t, '[^\p{Lu}]+', '', 'g')) AS capitals, length(regexp_replace(w.t, '[^!]+', '', 'g')) AS marks,
                     len(list_filter(w.w, lambda x: regexp_matches(x, '\p{L}'))) AS lettered,
                     len(list_filter(l.l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*\x{2022}\x{25cf}]'))) AS bullets, len(list_filter(l.l, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) AS ellipses,
                     coalesce(list_max(map_values(list_histogram(w.w))), 0) AS top
              FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < n_words * 2 OR word_chars > n_words * 12 OR n_dup_lines * 2 > lines OR capitals * 2 > word_chars
                    OR marks * 4 > n_words OR lettered * 10 < n_words * 6 OR bullets * 10 > lines * 9 OR ellipses * 10 > lines * 5 OR top * 10 > n_words * 4) AS kept
        FROM b""",
    "op11_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3""",
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        w AS (SELECT id, lang, source, unnest(t) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY 1),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
        o AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM c GROUP BY ALL),
        g AS (SELECT g.lang, g.source, coalesce(o.total, 0) AS total, coalesce(l.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN o USING (lang, source) LEFT JOIN l USING (lang)),
        p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2)) // (g.total + 2 * g.v) AS p,
                     1 + (1000000000 * (CAST(k.n AS HUGEINT) + 2)) // (l.total + 2 * l.v) AS q
              FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10""",
    "mix_source_targets": r"""
        WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents), s AS (SELECT source, sum(n) AS size FROM d GROUP BY 1),
        w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 1.5 * sum(size) OVER () AS goal FROM s),
        r AS (SELECT *, 2 * size / w AS stop, row_number() OVER (ORDER BY 2 * size / w, source) AS k FROM w),
        c AS (SELECT *, (goal - coalesce(sum(2 * size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM r),
        f AS (SELECT arg_min(rate, k) AS rate FROM c WHERE rate < stop)
        SELECT source, CAST(size AS BIGINT) AS size, round(CAST(CASE WHEN f.rate IS NULL OR f.rate * w >= 2 * size THEN 2 * size ELSE f.rate * w END AS DOUBLE), 6) AS target, true AS near FROM c, f""",
}
