import random

import pytest

from plumbline.llm.token_counts import PrefixCounter, counter, longest_within, prefix_tables, token_counts, tokens_of_prefix

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
FILE = public.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(FILE)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def own():
    return PrefixCounter(open(FILE, "rb").read())


ODD = ["", " ", "a", "  a", "a  ", "\n\n a", "it's we'll I'd 'sx", "aaaaaaaaaaaaaaaaaa", "é ü　x", "<|endoftext|>", " <|endoftext|> x<|endoftext|><|endoftext|>", "<|endoftext", "日本語 😀😀", "1234567890 12.5%", "\t\r\n \x0b\x1c\x85", "a​b﻿", "don't  stop\n\n\n", "x" * 300]


def random_texts(n, seed=2):
    r = random.Random(seed)
    return ["".join(r.choices("aab  'sl\n.,éß1٣日<|>endoftext_  ", k=r.randint(0, 40))) for _ in range(n)]


def test_counts_are_the_library_s(own, library):
    for text in ODD + random_texts(3000):
        assert sum(own.parts(text)[1]) == library(text), text


def test_every_prefix(own, library):
    for text in ODD + random_texts(150, seed=8):
        if len(text) < 60:
            assert own.table(text) == [library(text[:k]) for k in range(len(text) + 1)], text


def test_prefixes_of_a_word(own, library):
    word = "internationalisations"
    assert own.prefixes(word.encode()) == [library(word[:k]) for k in range(len(word) + 1)]


def test_query_columns(docs, rows, library):
    got = token_counts(docs, FILE, limit=30).collect()
    want = sorted(((k, len((t or "").encode()), library(t or "")) for k, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert r.over_limit == (r.n_tokens > 30)
        text = texts[r.doc_id]
        assert library(text[: r.fit_chars]) <= 30
        assert r.fit_chars == len(text) or library(text[: r.fit_chars + 1]) > 30 or r.fit_chars == max(k for k in range(len(text) + 1) if library(text[:k]) <= 30)


def test_stored_tables_answer_budgets(spark, library):
    text = "Some words, of which each has its tokens; unbelievably so."
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    tables = prefix_tables(df, FILE)
    got = {r.doc_id: r for r in tables.select("doc_id", tokens_of_prefix(tables["counts"], 9).alias("nine"), tokens_of_prefix(tables["counts"], 10**6).alias("whole"), longest_within(tables["counts"], 5).alias("fit")).collect()}
    assert got[1].nine == library(text[:9]) and got[1].whole == library(text)
    assert got[1].fit == max(k for k in range(len(text) + 1) if library(text[:k]) <= 5)
    assert (got[2].nine, got[2].whole, got[2].fit) == (0, 0, 0)


def test_one_counter_for_each_vocabulary():
    raw = open(FILE, "rb").read()
    assert counter(raw) is counter(raw)


def test_empty(empty):
    assert token_counts(empty, FILE).collect() == []


def test_stored_prefixes_are_all_right(own, library):
    """What is stored of each chunk that a text has, looked up by every prefix."""
    r = random.Random(11)
    for text in ODD + random_texts(300, seed=12) + ["it's", " 's", "'ll'd", "we'veX", "a'", "x''s", " '", "\t'll"]:
        own.parts(text)
    seen = [c for c in own.chunks if len(c) < 40]
    for chunk in r.sample(seen, min(250, len(seen))) + ["'s", "'ll", "'", " 's", "\n've"]:
        assert [*own.chunk(chunk)] == [library(chunk[:k]) for k in range(len(chunk) + 1)], chunk


def test_budgets_are_looked_up(own, library):
    from itertools import accumulate

    for text in ODD + random_texts(200, seed=13):
        chunks, counts = own.parts(text)
        for budget in (0, 1, 3, 7):
            got = own.longest_within(text, chunks, list(accumulate(counts)), budget)
            assert got == max(k for k in range(len(text) + 1) if library(text[:k]) <= budget), (text, budget)


@pytest.mark.parametrize("text", ["a" * 400_000, " " * 400_000 + "x", "\n" * 400_000, "!?" * 200_000, "7" * 400_000, "<|endoftext|>" * 30_000, "é" * 200_000])
def test_long_texts(own, text):
    """Time in proportion to the length, also for what fits into a limit."""
    import time
    from itertools import accumulate

    began = time.perf_counter()
    chunks, counts = own.parts(text)
    assert 0 < own.longest_within(text, chunks, list(accumulate(counts)), 1024) < len(text)
    assert time.perf_counter() - began < 60


def test_other_settings_are_refused():
    import json

    for where, name, value in (("model", "ignore_merges", True), ("model", "dropout", 0.1), ("model", "byte_fallback", True), ("added", "lstrip", True), ("added", "single_word", True)):
        d = json.loads(open(FILE, "rb").read())
        (d["model"] if where == "model" else d["added_tokens"][0])[name] = value
        with pytest.raises(ValueError, match=name):
            PrefixCounter(json.dumps(d).encode())


def test_query(spark, docs, rows, library, tmp_path):
    from plumbline.llm.queries import op6_token_counts

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op6_token_counts(spark, f"file://{tmp_path}").collect()
    want = [(k, len((t or "").encode()), library(t or ""), library(t or "") > 1024) for k, t, *_ in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(want, key=str)
    assert any(r.over_limit for r in got)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "two words", 5, 6)], "doc_id bigint, text string, n_tokens int, fit_chars int")
    assert [tuple(r) for r in token_counts(df, FILE).collect()] == [(1, 9, 2, False, 9)]
