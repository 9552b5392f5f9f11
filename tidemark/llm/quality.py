"""Quality rules as a short-circuit cascade, in SQL functions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, SPACE, WORD_BREAK


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for a document that the rule rejects; null counts as false."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-8)


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def base_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text.

    Null and empty texts have zeros. Three-word windows are told apart by the 64-bit hash of their
    words within one document, so chance agreement is below 1e-10 even for 20,000 words.
    """
    t = F.btrim(text_of(F.col(text)), F.lit(SPACE))
    parts = F.when(t == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(t, WORD_BREAK, -1))
    held = fresh_name(docs, "held")  # one column for what comes in between; its name is no column's
    d = docs.withColumn(held, parts)
    d = d.withColumn("n_words", F.size(held).cast("long"))
    whole = text_of(F.col(text))
    d = d.withColumn("word_chars", (F.length(whole) - F.regexp_count(whole, F.lit(r"[\x20\x09-\x0D]"))).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long"))
    # Windows as (hash, place), sorted: equal windows stand side by side.
    hashes = F.expr(f"if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64({held}[i], {held}[i + 1], {held}[i + 2])))")
    d = d.withColumn(held, hashes)
    d = d.withColumn(held, F.expr(f"if(size({held}) = size(array_distinct({held})), cast(array() as array<struct<h:bigint,i:int>>), array_sort(transform({held}, (h, i) -> named_struct('h', h, 'i', i))))"))
    again = F.expr(f"transform(filter({held}, (x, k) -> (k > 0 and {held}[k - 1].h = x.h) or (k + 1 < size({held}) and {held}[k + 1].h = x.h)), x -> x.i)")
    d = d.withColumn(held, F.array_sort(again))
    covered = F.expr(f"aggregate({held}, named_struct('n', 0L, 'last', -3), (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i), a -> a.n)")
    d = d.withColumn("n_repeat_words", covered)
    lines = F.filter(F.split(whole, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    d = d.withColumn(held, lines)
    return d.withColumn("n_dup_lines", (F.size(held) - F.size(F.array_distinct(held))).cast("long")).drop(held)


def base_failed() -> Column:
    """Too short, or over half of the words stand in repeated three-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)) != "")


def default_rules(text: str = "text") -> list[Rule]:
    """Rules on numbers that are at hand (symbols, length of words), on counts in the text (capitals, exclamation marks, words
    with a letter), on its lines (repeated, bullets, ellipses) and on its words (share of the most frequent one)."""
    t = text_of(F.col(text))
    n = F.col("n_words")
    share = lambda pattern, least: F.size(F.filter(_lines(t), lambda line: line.rlike(pattern))) * 10 > F.size(_lines(t)) * least
    sorted_words = F.array_sort(F.split(F.btrim(t, F.lit(SPACE)), WORD_BREAK, -1))
    run = lambda a, w: F.struct(w.alias("last"), F.when(w == a["last"], a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["most"], F.when(w == a["last"], a["now"] + 1).otherwise(1)).alias("most"))
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 12)),
        Rule("dup_lines", F.col("n_dup_lines") * 2 > F.size(_lines(t))),
        Rule("capitals", F.regexp_count(t, F.lit(r"\p{Lu}")) * 2 > F.col("word_chars")),
        Rule("exclamations", F.regexp_count(t, F.lit("!")) * 4 > n),
        Rule("letters", F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")) * 10 < n * 6),
        Rule("bullets", share(r"^[\x20\x09-\x0D]*[-*\u2022\u25cf]", 9)),
        Rule("ellipses", share(r"(?:\.\.\.|\u2026)[\x20\x09-\x0D]*$", 5)),
        Rule("top_word", F.aggregate(sorted_words, zero, run, lambda a: a["most"]) * 10 > n * 4),
    ]


def sampled(docs: DataFrame, text: str, rows: int, one_in: int = 7, most_chars: int = 100_000) -> DataFrame:
    """At most ``rows`` rows (text only), chosen by a hash and read from as few partitions as give them. Texts over ``most_chars``
    are left out, so the sample has a bounded size on the driver."""
    t = text_of(F.col(text))
    chosen = docs.select(t.alias(text)).where((F.pmod(F.xxhash64(text), F.lit(one_in)) == 0) & (F.length(text) <= most_chars)).take(rows)
    return docs.sparkSession.createDataFrame([(r[0],) for r in chosen], f"`{text}` string")


def estimate(sample: DataFrame, rules: Sequence[Rule], repeat: int = 8, times: int = 2) -> list[Estimate]:
    """Seconds a row and share of rejected rows of each rule, on ``sample``, which has the base statistics.

    A rule is evaluated ``repeat`` times a row in one task, after a run that warms it up; the least of ``times`` runs counts, less that
    of a rule that does nothing. The sample only sets the order of the rules, never a verdict.
    """
    sample = sample.coalesce(1).persist()
    try:
        n = sample.count()
        if not n:
            return [Estimate(r.name, 0.0, 0.0) for r in rules]
        many = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

        def run(fails: Column) -> tuple[float, int]:
            took = []
            for _ in range(times + 1):
                began = time.perf_counter()
                hit = many.agg(F.count(F.when(fails, 1)).alias("n")).first()["n"]
                took.append(time.perf_counter() - began)
            return min(took[1:]), hit // repeat

        # A null of the row's own, so that the optimiser keeps it.
        idle = run(F.col("n_words") < F.lit(-1))[0]
        found = [(rule.name, *run(rule.fails)) for rule in rules]
        return [Estimate(name, max(0.0, took - idle) / (n * repeat), hit / n) for name, took, hit in found]
    finally:
        sample.unpersist()


def cascade(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> Column:
    """Name of the first rule that rejects, the rules standing by rejection per cost; null if none does.

    ``coalesce`` stops at its first value, so later rules are not evaluated for a rejected row.
    """
    gain = {e.name: e.gain for e in estimates}
    ordered = sorted(rules, key=lambda r: (-gain.get(r.name, 0.0), r.name))
    return F.coalesce(*[F.when(r.fails, F.lit(r.name)) for r in ordered])


def filter_quality(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", rows: int = 256) -> DataFrame:
    """``docs`` with the base statistics, ``base_failed`` and ``kept``.

    A document is kept if the base rules hold and no rule of the cascade rejects it; where a base rule fails the cascade is not
    evaluated. Null and empty texts fail the base rule; very long texts count in whole; repeated rows and null ids are judged each;
    empty input gives no rows. Columns of the added names are replaced. Verdicts don't depend on the sample.
    """
    rules = default_rules(text) if rules is None else list(rules)
    order = cascade(rules, estimate(base_stats(sampled(docs, text, rows), text), rules)) if rules else F.lit(None).cast("string")
    stats = base_stats(docs, text).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(order.isNull()))
