import re
from collections import Counter

import pytest

from plumbline.llm.quality import METRICS, RULES, Rule, passing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    repeat = {k + j for k, w in enumerate(windows) if w in often for j in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "n_lines": len(lines),
        "n_exclaims": text.count("!"),
        "n_upper": sum("A" <= c <= "Z" for c in text),
        "n_bullets": sum(x.lstrip(" ")[:2] in ("- ", "* ", "• ") for x in lines),
        "n_ellipsis": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines),
    }


TEXTS = [
    None, "", " \n\t", "a", "a b c d e a b c d e", "a b c d e f " * 9, "x\nx\nx\ny", "- one\n* two\n• three ...\n wait…\n", "#### $$ %% word <b> | & * word", "WHY! ALL! THESE! CAPITALS! HERE! ONE! TWO! SIX! TEN! NOW!",
    "the " * 40, "é ñ ü 日本 語 😀 word word word word word word", "a b c d e x a b c d e y a b c d e", "same same same same same same same same", "one\r\ntwo\x0bthree\x0cfour",
]


def test_metrics_against_brute_force(spark, docs, rows):
    some = [(k, t) for k, t in enumerate(TEXTS)] + [(1000 + (r[0] or 999), r[1]) for r in rows]
    got = quality(spark.createDataFrame(some, "doc_id bigint, text string")).collect()
    assert len(got) == len(some)
    want = Counter((k, tuple(sorted(brute(t).items()))) for k, t in some)
    assert Counter((r.doc_id, tuple(sorted((m, r[m]) for m in METRICS if m != "n_stop"))) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.failed)


def test_rules_are_a_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "## b c d e f g h i j")], "doc_id bigint, text string")
    one = quality(df, rules=[Rule("symbols", "n_symbols", "n_words", high=19)]).collect()
    assert {r.doc_id: (r.failed, r.kept) for r in one} == {1: ([], True), 2: (["symbols"], False)}
    none = quality(df, rules=[]).collect()
    assert all(r.kept for r in none)
    assert len({r.name for r in RULES}) == len(RULES)
    low = quality(df, rules=[Rule("stops", "n_stop", "n_words", low=1, least=20)]).collect()
    assert all(r.kept for r in low)  # too short for the rule


@pytest.mark.parametrize("name", ["kept", "row", "words", "at"])
def test_passing_keeps_all_columns(spark, name):
    text = "Some words of an ordinary text that the rules have nothing against at all."
    df = spark.createDataFrame([(1, text, 7), (2, "short", 8), (None, text, None)], f"doc_id bigint, text string, {name} int")
    got = passing(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, text, 7), (None, text, None)], key=str)


def test_empty(empty):
    assert quality(empty).collect() == passing(empty).collect() == []


def test_no_python_in_the_plan(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/docs")
    df = quality(spark.read.parquet(f"file://{tmp_path}/docs"))
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "Scan parquet" in plan and not re.search("Python|Pandas|Arrow|Exchange", plan)
