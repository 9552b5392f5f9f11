"""Small fixtures with every awkward case, against plain versions of the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, html_text, jaccard, langid, line_dedup, packing, quality, queries, secrets, sharding, topk

LONG = "a line that is certainly longer than forty code points, number "
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n=120):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdefghij"), 5)) for _ in range(n))


def documents():
    rows = []
    for i in range(30):
        text = f"{LONG}{i % 3}\nown {i}\n  {LONG.upper()}{i % 3} \n\n" + prose(i % 9 if i % 2 else i)
        rows.append((i, text, ("en", "de")[i % 2], f"src{i % 4}" if i % 5 else None, len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "src1", 0), (102, " \n\t ", None, "src2", 4), (103, "0 1 2 !", "de", "src9", 7)]
    rows += [(104, prose(77, 40_000), "en", "src1", 1), rows[3], (None, "no id but some text that is here", "en", "src1", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1.0) for r in documents()], DOC + ", shard string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


# --- 1


def brute_topk(rows, k):
    live = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in live:
        if q % 50 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in live if i != q and len(b) == len(a))
            out[q] = [(i, -s) for s, i in near[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("case", ["unit", "lengths", "ties"])
def test_topk(spark, case):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 6))
    if case == "unit":
        v /= np.linalg.norm(v, axis=1)[:, None]
    elif case == "lengths":
        v *= np.exp(r.normal(size=(400, 1)) * 2)
    else:
        v = np.round(v)
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(400)]
    rows += [(400, None), (450, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (451, [float("nan")] * 6), (452, [float("inf")] * 6), (500, [0.0] * 6), (550, [1.0, 2.0]), (551, [3.0, -1.0]), (600, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.integers(F.col("embedding")).alias("v"))
    old = topk.BLOCK
    topk.BLOCK = 64
    try:
        got = defaultdict(list)
        for x in sorted(topk.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, 5).collect(), key=lambda x: (x["query_id"], x["rank"])):
            got[x["query_id"]].append((x["vec_id"], x["score"]))
    finally:
        topk.BLOCK = old
    assert dict(got) == brute_topk(rows, 5)


def test_topk_empty(spark):
    e = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_k(e.withColumnRenamed("vec_id", "query_id"), e, 5).count() == 0


# --- 2


def test_plan_keeps_all_pieces():
    for seed in range(6):
        r = np.random.default_rng(seed)
        counts = Counter(int(x) for x in np.minimum(1024, np.maximum(1, r.lognormal(5.5, 1.2, 3000).astype(int))))
        got = Counter()
        plan = packing.plan(counts)
        for lengths, many in plan:
            assert sum(lengths) <= 1024 and many > 0
            for n in lengths:
                got[n] += many
        assert got == counts
        assert sum(m for _, m in plan) <= 1.06 * -(-sum(n * c for n, c in counts.items()) // 1024) + 1


def test_packing_against_tokenizer(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, text, *_ in documents():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = list(range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024))
        for k, (lo, hi) in enumerate(zip([0, *cuts], cuts)):
            want[i, k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.1 * sum(r["length"] for r in got) / 1024 + 1


def test_encoder_is_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(None, None)
    for x in ["", "  ", "a  b", " \n\n x <|endoftext|> y", "x<|endoftext|>", "don't\t \tgo  now　 z  ", "\x1c \x1f a\x85b", "é" * 50 + "\n \n", "12 345,6 … 🙂🙂 日本語 テスト"]:
        assert e(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


# --- 3


def brute_lines(rows, least=5):
    keyed = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, lines in keyed:
        for s in lines:
            if len(key(s)) >= 40:
                held[key(s)].add(-(2**63) if i is None else i)
    out = []
    for i, lines in keyed:
        d = -(2**63) if i is None else i
        kept = [s for s in lines if not (len(held.get(key(s), ())) >= least and d != max(held[key(s)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == brute_lines(documents())


def test_line_runs_compact(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(bytes([k]), 100 - b) for k in range(b + 2)], "hash binary, doc_id long"))
    assert sum(len(x) for x in runs.levels) < 5
    assert {(r["hash"][0], r["n_docs"], r["holder"]) for r in runs.all().collect()} == {(k, 5 - max(0, k - 1), 100 - max(0, k - 1)) for k in range(6)}


# --- 4


def test_quality(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.filter_quality(docs).collect()}
    for i, text, *_ in documents():
        w = WORD.findall(text or "")
        n = Counter(zip(w, w[1:], w[2:]))
        covered = {i + o for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for o in range(3)}
        lines = [s for s in (text or "").split("\n") if WORD.search(s)]
        r = got[i, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert got[4, 120 + len(WORD.findall(LONG)) * 2 + 4]["kept"]


def test_cascade_order():
    found = [quality.Estimate("a", 1.0, 0.1), quality.Estimate("b", 0.1, 0.1), quality.Estimate("c", 1.0, 0.0)]
    assert sorted(found, key=lambda e: -e.gain)[0].name == "b"


# --- 5


def test_secret_scan(spark):
    key, sha = hashlib.sha1(b"k").hexdigest(), hashlib.sha256(b"k").hexdigest()
    rows = [(1, f'set token = "{key}" and go', None, "src0", 1), (2, f"sha256: {sha} is the digest", None, "src0", 1), (3, "internationalisationmanagementinformation", None, "src1", 1), (4, None, None, None, None), (5, "", None, "x", 0)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, DOC)).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["candidate"] == key and got[1]["is_secret"] and not got[2]["is_secret"] and not got[3]["is_secret"]


def test_secret_forms(spark):
    key, b64 = hashlib.sha1(b"k").hexdigest(), "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ8aTq4vRk"
    jwt = ("eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4ifQ", "SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c")
    sg = ("ngeVfQFYQlKU0ufo8x5d1A", "TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc1s5Y4aB")
    forms = {
        f"run token={key} now": [key],
        f"password={b64}==": [b64 + "=="],
        f"auth_token={key}": [key],
        f'AWS_SECRET_ACCESS_KEY = "{b64}"': [b64],
        f"AWS_SECRET_ACCESS_KEY={b64}\n": [b64],
        f"Authorization: Bearer {'.'.join(jwt)}": list(jwt),
        f"Authorization: Bearer SG.{'.'.join(sg)} x": list(sg),
        f"api_key=SG.{'.'.join(sg)}": [f"SG.{'.'.join(sg)}"],
        'DB_PASSWORD="xK9#qT2vLp"': ["xK9#qT2vLp"],
    }
    plain = [f"commit={key}", "password: required", "see www.internationalisation-management.information/station/table", "the secretary had a key: nothing", f"AWS_SECRET_ACCESS_KEY_OF_THE_SERVER is set, sha256: {key}{key[:24]}"]
    rows = [(i, t, None, "src0", 1) for i, t in enumerate([*forms, *plain])]
    found = secrets.scan(spark.createDataFrame(rows, DOC)).orderBy("doc_id", "n").collect()
    for i, (text, want) in enumerate(forms.items()):
        assert [r["candidate"] for r in found if r["doc_id"] == i and r["is_secret"]] == want, (text, [r for r in found if r["doc_id"] == i])
    assert not [r for r in found if r["doc_id"] >= len(forms) and r["is_secret"]]
    assert all("token=" in r["before"] for r in found if r["doc_id"] in (0, 2)) and any(r["before"].endswith("Bearer ") and r["n"] == 2 for r in found)


# --- 6


def test_sharding(spark, docs, none):
    got = sharding.shard(docs, "doc_id", [1.0] * 24, [1.0] * 25, [F.length("text").alias("size")]).collect()
    assert len(got) == len(documents())
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(none, "doc_id", [1.0] * 3).count() == 0
    many = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0, 0.0]).alias("s")).groupBy("s").count().collect()
    n = {r["s"]: r["count"] for r in many}
    assert set(n) == {0, 1, 2} and abs(n[1] - 10_000) < 400 and abs(n[0] - 5000) < 300


# --- 7


def test_language_id(spark, docs, none):
    words = {"en": "the of and to in that is was for".split(), "de": "der die und das nicht mit ist ein".split()}
    r = np.random.default_rng(0)
    rows = [(i, " ".join(r.choice(words[lang], 30)), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000, None, "en", "s", 1), (1001, "123 456", None, "s", 1), (1002, "der und die nicht", None, None, None)]
    got = langid.identify(spark.createDataFrame(rows, DOC)).collect()
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    assert all(by[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:300])
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1002]["lang_pred"] == "de"
    assert all(0 <= x["score"] <= 1 for x in got)
    assert langid.identify(none).count() == 0
    assert {x["lang_pred"] for x in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert len(langid.identify(docs).collect()) == len(documents())


def test_counts_are_those_of_each_text():
    import pyarrow as pa

    texts = pa.array(["abc", None, "", "Äbc" * 3, "x"])
    whole = np.concatenate([c for _, c in langid.counts(texts)])
    for i, t in enumerate(texts.to_pylist()):
        alone = np.concatenate([c for _, c in langid.counts(pa.array([t], pa.string()))])[0]
        assert (alone == whole[i]).all() and whole[i].sum() == sum(max(0, len(t or "") - k) for k in range(3))


# --- 8


def brute_links(rows, threshold=0.8):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        if i is not None and i not in sets:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
    return sets, links


def near_rows():
    r = np.random.default_rng(5)
    rows = []
    for g in range(6):
        base = prose(1000 + g, 150).split()
        for k in range(9):
            w = list(base)
            for at in r.integers(0, 150, k):
                w[at] = f"new{k}{at}"
            rows.append((g * 100 + k, " ".join(w), "en", "s", 1))
    return rows + [(900, rows[0][1], "en", "s", 1), (901, "two words", "en", "s", 1), (902, "two words", "en", "s", 1), (903, "", "en", "s", 1), (904, None, "en", "s", 1), (None, rows[0][1], "en", "s", 1)]


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates(spark, block):
    rows, old = near_rows(), jaccard.BLOCK
    jaccard.BLOCK = block
    try:
        got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    finally:
        jaccard.BLOCK = old
    sets, links = brute_links(rows)
    assert set(got) == set(sets)
    assert sum(got[i]["n_links"] for i in got if sets[i]) == sum(map(len, links.values()))
    assert all(got[i]["n_links"] == len(links[i]) for i in got if sets[i])
    todo, classes = set(sets), {}
    while todo:
        group, front = set(), [min(todo)]
        while front:
            x = front.pop()
            if x not in group:
                group.add(x)
                front += links[x]
        classes |= {x: min(group) for x in group}
        todo -= group
    assert all(got[i]["class_id"] == classes[i] for i in got if sets[i])
    assert all((got[i]["class_id"], got[i]["n_links"]) == (i, 0) for i in (903, 904))
    assert got[900]["copy_id"] == 0 and got[902]["copy_id"] == 901


def test_near_duplicates_of_all_and_none(docs, none):
    assert jaccard.near_duplicates(docs).count() == len({r[0] for r in documents() if r[0] is not None})
    assert jaccard.near_duplicates(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# --- 9


def test_html():
    good = "This is a sentence of the text that is long enough to count as good, with the words that the language has and that we look for in it, and it goes on for a while so that there is no doubt about it at all, is there. "
    page = f"""<html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body><nav><a href=x>Home</a></nav><header>Top of the site</header>
      <div class="cookie-notice">{good}</div><article><h1>A &amp; B</h1><p>{good} A&nbsp;b<br>c</p><p>Short.</p><aside>{good}</aside><p>{good}</p></article>
      <div id="comments"><p>{good}</p></div><form>{good}</form><footer>&copy; {good}</footer></body></html>"""
    text = html_text.main_text(page).split("\n")
    assert text == ["A & B", good + "A b c", "Short.", good.strip()]
    assert html_text.main_text("<") == "<"
    for odd in (None, "", "<p", "<!-- x", "<script>", "<div>" * 5000, "</p></div>", '<a href="' + "x" * 10_000):
        assert html_text.main_text(odd) == ""
    assert html_text.main_text("<p>one <b>two</b></p>") == "one two"


def test_html_text_decides():
    good = "This is a sentence of the text that is long enough to count as good, with the words that the language has and that we look for in it, and it goes on for a while so that there is no doubt about it at all, is there."
    card = "<article><h3><a href=x>Another story</a></h3><p>Read it.</p></article>"
    assert html_text.main_text(f"<body>{card}<div><h1>The title</h1><p>{good}</p><p>Short.</p><p>{good}</p></div>{card}<p>Imprint</p></body>").split("\n") == ["The title", good, "Short.", good]
    assert html_text.main_text(f"<div>Menu</div><div><h2>The title</h2><p>{good}</p></div>").split("\n")[-2:] == ["The title", good]  # no article at all
    linked = "<a href=y>The whole of this paragraph is a link to the page that it is about, as some papers have it.</a>"
    assert html_text.main_text(f"<article><h1><a href=x>The title</a></h1><p>{good}</p><p>{linked}</p><p>{good}</p></article>").split("\n") == ["The title", good, linked.split(">")[1].removesuffix("</a"), good]
    assert html_text.main_text(f'<div class="layout sidebar"><article><h1>The title</h1><p>{good}</p></article><div class="comments"><p>{good}</p></div></div>').split("\n") == ["The title", good]


def test_html_query(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x</p></article>"), (3, "u", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in queries.op9_html_extraction(spark, str(tmp_path)).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[None]["text"] == "x" and got[3]["n_chars"] == 20_000 * 5 - 1


# --- pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = np.random.default_rng(0)
    words = {"en": "the of and to in that is was for".split(), "de": "der die und das nicht mit ist ein".split()}
    rows = [(i, " ".join(w + str(r.integers(0, 30)) for w in r.choice(words[lang], 40)), lang, f"s{i % 3}", 1) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(500, rows[0][1], "en", "s1", 1), (501, None, "en", "s1", 1), (502, "", None, None, None)]
    spark.createDataFrame([(*x, "c") for x in rows], DOC + ", lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        assert at.columns == docs.columns, name
        if name == "language_id":
            assert {x["doc_id"] for x in at.collect()} == {i for i, *_ in rows} - {501, 502}
        if name == "ngram_jaccard_join":
            assert {x["doc_id"] for x in at.collect()} == set(range(120))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
