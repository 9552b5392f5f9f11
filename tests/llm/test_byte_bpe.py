"""Byte BPE against the library that defines it."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def words():
    return byte_bpe.vocabulary()


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def check(words, library, texts):
    for text, ids in zip(texts, words.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:80]
        assert words.decode(ids) == text.encode()


def test_every_code_point_among_letters_digits_and_spaces(words, library):
    check(words, library, [f"a{chr(c)}b 1{chr(c)}{chr(c)}2 {chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000])
    check(words, library, [f"x{chr(c)} {chr(c)}y" for c in range(0x3100, 0x110000, 37) if not 0xD800 <= c < 0xE000])


def test_random_texts_of_awkward_parts(words, library):
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "'s", "'S", "1", "22", "é", "漢", "🙂", "\xa0", "\x1c", "́", "!", "--", "　", "ing", "aaaa", "<|endoftext|>"]
    check(words, library, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(5000)])


@pytest.mark.parametrize("letters", ["a", "ab", "aab", "abcdefghij", "etaoinshrdlu", "漢字仮名交", "=-"])
def test_long_pieces_merge_in_the_same_order(words, library, letters):
    rng = random.Random(letters)
    check(words, library, ["".join(rng.choice(letters) for _ in range(n)) for n in (96, 97, 127, 128, 129, 130, 500, 6000)])


def test_a_very_long_text_goes_in_slices(words, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "GROUP", 1000)
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 50)
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé1!") for _ in range(rng.randint(1, 12))) for _ in range(4000))
    check(words, library, [text, "", "short", text[:999], text[:1001]])


def test_pairs_finds_all_and_only_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (5000, 2)), axis=0)
    pairs = byte_bpe.Pairs(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    held = {tuple(k): i for i, k in enumerate(keys.tolist())}
    asked = rng.integers(0, 300, (40, 500, 2))
    got = pairs(asked[..., 0], asked[..., 1])
    assert got.tolist() == [[held.get(tuple(k), byte_bpe.NONE) for k in row] for row in asked.tolist()]


def test_an_id_that_is_no_token_is_an_error(words):
    with pytest.raises(KeyError):
        words.decode(np.array([10**6], "<u4").tobytes())


def test_query_equals_the_library_on_all_documents(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_rows_and_columns(spark, library):
    rows = [(1, None, "x", 1), (1, "", None, 2), (None, "same text", "y", 3), (7, "same text", "y", 3), (8, "w" * 300_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `data` int")
    out = byte_bpe.decode(byte_bpe.encode(docs)).select("doc_id", "text", "ids", F.col("data").cast("string").alias("data")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["data"], bytes(r["ids"])) for r in out) == sorted((d or 0, t or "", t or "", np.array(library.encode_ordinary(t or ""), "<u4").tobytes()) for d, t, _, _ in rows)
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    assert byte_bpe.decode(byte_bpe.encode(docs.select("text"), columns=[]), columns=[]).columns == ["data"]
