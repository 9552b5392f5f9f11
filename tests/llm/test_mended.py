"""What once went wrong: clashing inner names, titles between menu and article, languages that no sample reached."""

from pyspark.sql import functions as F

from tidemark.llm import html_text, langid, line_dedup, quality


def test_line_dedup_with_columns_of_inner_names(spark):
    line = "a line that is long enough to be judged, and more"
    names = ["__lines", "__n", "__d", "row", "lines", "dropped", "text_hash", "whole", "hash", "holder", "__doc", "a.b"]
    rows = [(k, f"{line}\nown {k}", *[f"{n}{k}" for n in names]) for k in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    out = line_dedup.dedup_lines(docs.drop("a.b")).collect()
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out) == [(k, f"own {k}" if k < 5 else f"{line}\nown 5", 2, int(k < 5)) for k in range(6)]
    assert all(r[n] == f"{n}{r['doc_id']}" for r in out for n in names[:-1])


def test_quality_keeps_columns_of_inner_names(spark):
    names = ["__w", "__l", "__h", "__s", "__r", "held", "HELD_"]
    docs = spark.createDataFrame([(1, "word " * 60, *names), (2, None, *names)], ", ".join(["doc_id long", "text string", *[f"{n} string" for n in names]]))
    out = quality.filter_quality(docs).collect()
    assert [[r[n] for n in names] for r in out] == [names] * 2
    assert sorted((r["doc_id"], r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in out) == [(1, 60, 60, 0), (2, 0, 0, 0)]


def test_a_title_between_menu_and_article_stays():
    texts = {
        "The harbour at night": "The boats lie in the harbour at night, and the water is so still that you can see the lamps of the town in it, as if there were a second town below.",
        "Port nocą": "Łodzie stoją w porcie nocą, a woda jest tak spokojna, że widać w niej lampy miasta, jak gdyby pod nim było drugie miasto, które nie śpi.",
        "Гавань ночью": "Лодки стоят в гавани ночью, и вода так спокойна, что в ней видны огни города, как будто под ним есть второй город, который не спит.",
    }
    menu = "".join(f"<a href='/{k}'>Menu {k}</a>" for k in range(6))
    for title, text in texts.items():
        page = f"<html><body><nav>{menu}</nav><h1>{title}</h1><div><p>{text}</p><p>{text}</p><p>{text}</p></div><footer>Imprint</footer></body></html>"
        assert html_text.main_text(page).split("\n") == [title, text, text, text]


def test_every_language_is_sampled_whatever_its_size(spark):
    for texts in (0, 1, 10, 10**3, 10**6, 2 * 10**9, 10**13):
        got = langid.share(texts, 1000)
        assert 1 <= got <= langid.HASHES
        if texts > 1000:
            assert abs(got * texts / langid.HASHES - 1000) < 1
    # Many rows, two texts: both are learnt from.
    docs = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "abc abd abe").otherwise("xyz xyy xxz").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("x").alias("lang"))
    model = langid.train(docs, doc_id="id", rows_per_lang=100)
    got = langid.predict(docs.limit(50), model).groupBy("lang").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r["lang"], r["right"] == r["n"]) for r in got) == [("a", True), ("x", True)]
