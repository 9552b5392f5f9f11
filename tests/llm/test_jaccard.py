"""The similarity join's forest: levels, mixed nodes, measured recall, texts without words."""

import numpy as np
import pytest

from tidemark.llm import jaccard

DOC = "doc_id long, text string"


def words(r, n):
    return ["".join(r.choice(list("abcdefghij"), 6)) for _ in range(n)]


def changed(r, base, at):
    w = list(base)
    for k in at:
        w[k] = "x" + "".join(r.choice(list("abcdefghij"), 5))
    return w


def corpus():
    """Templates (half of the windows shared, no links), pairs around the threshold, a group of close copies, lonely texts."""
    r = np.random.default_rng(11)
    rows = []
    template = words(r, 120)
    for k in range(60):
        rows.append((k, [*template, *words(r, 60)]))
    for k in range(60):
        base = words(r, 300)
        rows += [(1000 + 2 * k, base), (1001 + 2 * k, changed(r, base, r.choice(300, 3 + k % 6, replace=False)))]
    base = words(r, 400)
    rows += [(2000 + k, changed(r, base, r.choice(400, 1, replace=False))) for k in range(80)]
    rows += [(3000 + k, words(r, 50)) for k in range(40)]
    return [(i, " ".join(w)) for i, w in rows]


def brute(rows, threshold=0.8):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    ids, links = sorted(sets), {i: set() for i in sets}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a].add(b)
                links[b].add(a)
    return links


def test_levels_and_recall(spark, monkeypatch):
    rows, active = corpus(), []
    verified = jaccard._verified

    def watched(docs, texts, depth, threshold):
        active.append((depth, texts.where("active").count()))
        return verified(docs, texts, depth, threshold)

    monkeypatch.setattr(jaccard, "_verified", watched)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = {x["doc_id"]: x for x in jaccard.near_duplicates(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    want = brute(rows)
    total = sum(map(len, want.values()))
    assert all(got[i]["n_links"] <= len(want[i]) for i in want)
    assert sum(x["n_links"] for x in got.values()) >= 0.99 * total
    assert len({got[i]["class_id"] for i in range(2000, 2080)}) == 1
    assert all(got[i]["class_id"] == i and got[i]["n_links"] == 0 for i in [*range(60), *range(3000, 3040)])
    # The close group has its links at once and keeps its long prefixes; lonely texts go on with shorter ones.
    assert [d for d, _ in active] == [6, 5] and active[0][1] == len(rows) and active[1][1] <= len(rows) - 80


def test_mixed_nodes_do_not_chain(spark):
    """Texts that meet by their template alone come into no group."""
    rows = corpus()[:60]
    sketches = [jaccard.sketch(jaccard.shingles(t)) for _, t in rows]
    texts = spark.createDataFrame([(i, bytes(s), True) for (i, _), s in zip(rows, sketches, strict=True)], "rep long, sketch binary, active boolean")
    a = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(rows), -1)
    assert jaccard._meet(a, a, 3).sum() > len(rows)  # they do meet
    sizes = [x["count"] for x in jaccard._groups(texts, 3, 0.8).groupBy("grp").count().collect()]
    assert sum(sizes) <= 4  # of 1,770 pairs at a half one or two look like more in their sketches


@pytest.mark.parametrize("apart", [True, False])
def test_wordless(spark, apart):
    rows = [(1, ""), (2, None), (3, " \n\t"), (4, "one word"), (5, "one word"), (None, "one word")]
    got = {x["doc_id"]: (x["class_id"], x["copy_id"], x["n_links"]) for x in jaccard.near_duplicates(spark.createDataFrame(rows, DOC), wordless_apart=apart).collect()}
    assert {k: got[k] for k in (4, 5)} == {4: (4, 4, 1), 5: (4, 4, 1)} and set(got) == {1, 2, 3, 4, 5}
    assert {k: got[k][:2] for k in (1, 2, 3)} == ({1: (1, 1), 2: (2, 2), 3: (3, 3)} if apart else {1: (1, 1), 2: (1, 1), 3: (1, 1)})


def test_one_id_with_two_texts_and_clashing_names(spark):
    t = [" ".join(words(np.random.default_rng(k), 30)) for k in range(3)]
    rows = [(1, t[0], "a"), (1, t[1], "b"), (1, t[0], "c"), (2, t[0], "d"), (3, t[1], "e"), (4, t[2], "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = {x["doc_id"]: x["class_id"] for x in jaccard.near_duplicates(d).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4] == 4 and sorted((got[2], got[3])) in ([1, 2], [1, 3])
