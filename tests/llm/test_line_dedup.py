import random
from collections import Counter

import pytest

from plumbline.llm import line_dedup
from plumbline.llm.line_dedup import dedup

BLANKS = " \t\n\x0b\x0c\r"


def n_words(line):
    for c in BLANKS:
        line = line.replace(c, " ")
    return len(line.split(" ")) - line.split(" ").count("")


def brute(rows, least):
    """Every run of consecutive lines with a word and ``least`` words that occurs earlier is deleted."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    own = {k: [(i, x) for i, x in enumerate((rows[k][1] or "").split("\n")) if n_words(x)] for k in order}
    seen, gone = {}, {k: set() for k in order}
    for k in order:
        for a in range(len(own[k])):
            total, content = 0, []
            for b in range(a, len(own[k])):
                content.append(own[k][b][1])
                total += n_words(own[k][b][1])
                if total >= least:
                    seen.setdefault(tuple(content), (k, a))
                    if seen[tuple(content)] != (k, a):
                        gone[k] |= set(range(own[k][a][0], own[k][b][0] + 1))
                    elif b - a > 40:
                        break
    return {k: "\n".join(x for i, x in enumerate(rows[k][1].split("\n")) if i not in gone[k]) if rows[k][1] is not None else None for k in order}, {k: len(gone[k]) for k in order}


@pytest.mark.parametrize("least", [1, 6, 20])
def test_against_brute_force(spark, docs, rows, least):
    rows = [r for k, r in enumerate(rows) if k != 150]  # the long text is tested below
    df = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = dedup(df, min_words=least).collect()
    texts, n = brute(rows, least)
    want = Counter((rows[k][0], texts[k], n[k]) for k in texts)
    assert Counter((r.doc_id, r.text, r.n_deleted) for r in got) == want
    assert sum(n.values()) > 0
    assert all(r.n_deleted == sum(x.last - x.line + 1 for x in r.runs or ()) for r in got)


def test_long_runs_of_short_lines(spark):
    r = random.Random(3)
    base = [r.choice("abc") for _ in range(120)]
    rows = [(k, "\n".join(base[a : a + n])) for k, (a, n) in enumerate([(0, 120), (10, 70), (50, 30), (3, 12), (90, 30)])]
    rows += [(9, "\n".join(base[20:60]) + "\nq\n" + "\n".join(base[70:90]))]
    got = {x.doc_id: x.text for x in dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=13).collect()}
    texts, _ = brute(rows, 13)
    assert got == {rows[k][0]: t for k, t in texts.items()}


def test_sources_of_runs(spark):
    line = "one two three four five six"
    rows = [(5, f"x\n{line}\n{line} 7"), (2, f"{line}\n{line} 7\nend"), (9, f"{line} 7")]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=6).collect()}
    assert [tuple(x) for x in got[5].runs] == [(1, 2, 2, 0)]
    assert [tuple(x) for x in got[9].runs] == [(0, 0, 2, 1)]
    assert got[2].runs is None and got[5].text == "x" and got[9].text == ""


def test_ranks_are_a_suffix_array(spark):
    """Ranks order suffixes by their first 2^k line ids, like a sort of them."""
    from plumbline.llm.common import Scratch

    r = random.Random(1)
    sequences = [[r.randint(0, 2) for _ in range(r.randint(1, 12))] for _ in range(30)]
    rows = [(k, k, list(range(len(s))), [], [(x, 7 * x) for x in s]) for k, s in enumerate(sequences)]
    lines = spark.createDataFrame(rows, "key bigint, doc_id bigint, nb array<int>, wanted array<struct<start:int,w:int>>, ids array<struct<a:bigint,b:bigint>>")
    got = {x.key: x for x in line_dedup._ranks(lines, Scratch(spark, "test"), 3).collect()}
    flat = [(tuple(s[i : i + 8]), k, i) for k, s in enumerate(sequences) for i in range(len(s))]
    for suffix, k, i in flat:
        assert got[k].r3[i] == sum(x < suffix for x, _, _ in flat)


def test_edges(spark, empty):
    assert dedup(empty).collect() == []
    df = spark.createDataFrame([(1, "x", 2, 3)], "doc_id bigint, text string, key int, `a b` int")
    assert dedup(df).columns == ["doc_id", "text", "key", "a b", "n_lines", "n_deleted", "runs"]
    assert dedup(df).collect()[0].n_lines == 1
    clash = dedup(spark.createDataFrame([(1, "x", 2, 3)], "doc_id bigint, text string, Runs int, _key int"))
    assert clash.columns == ["doc_id", "text", "Runs_input", "_key_input", "n_lines", "n_deleted", "runs"]
    assert tuple(clash.first())[:4] == (1, "x", 2, 3)
    with pytest.raises(ValueError, match="min_words"):
        dedup(df, min_words=0)


def test_words_of_lines(spark):
    r = random.Random(6)
    lines = ["", " ", "a", " a ", "a  b", "a\tb", "\r", "x\r", "a\x0bb c", "é ñ", *("".join(r.choices("ab  \t\r\x0c", k=9)) for _ in range(60))]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = df.select("line", line_dedup._n_words(df["line"]).alias("n")).collect()
    assert {x.line: x.n for x in got} == {x: n_words(x) for x in lines}


def brute_shortest(rows, least):
    """The lines from first to last of each shortest run from or to a line that occurs earlier."""
    own = {k: [(i, x) for i, x in enumerate((t or "").split("\n")) if n_words(x)] for k, (_, t) in enumerate(rows)}
    gone, runs = {k: set() for k in own}, []
    for k, lines in own.items():
        words = [n_words(x) for _, x in lines]
        found = {(a, min(b for b in range(a, len(lines)) if sum(words[a : b + 1]) >= least)) for a in range(len(lines)) if sum(words[a:]) >= least}
        found |= {(max(a for a in range(b + 1) if sum(words[a : b + 1]) >= least), b) for b in range(len(lines)) if sum(words[: b + 1]) >= least}
        runs += [(k, a, b, tuple(x for _, x in lines[a : b + 1])) for a, b in found]
    first = {}
    for k, a, _, content in sorted(runs):
        first.setdefault(content, (k, a))
    for k, a, b, content in runs:
        if first[content] != (k, a):
            gone[k] |= set(range(own[k][a][0], own[k][b][0] + 1))
    return {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone[k])) for k, (d, t) in enumerate(rows)}


@pytest.mark.parametrize("seed", range(4))
def test_many_shapes_of_runs(spark, seed):
    """Few kinds of lines, blanks between them, runs that touch, overlap and contain each other."""
    r = random.Random(seed)
    kinds = ["", " ", *(" ".join(r.choices("xyz", k=r.randint(1, 9))) for _ in range(5))]
    rows = [(k, "\n".join(r.choices(kinds, k=r.randint(0, 40)))) for k in range(12)]
    least = r.choice([3, 5, 9, 20])
    got = {x.doc_id: (x.text, x.n_deleted, [(y.line, y.last) for y in x.runs or ()]) for x in dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), min_words=least).collect()}
    assert {d: g[:2] for d, g in got.items()} == brute_shortest(rows, least)
    for _, total, runs in got.values():
        assert total == sum(b - a + 1 for a, b in runs) and all(y[0] > x[1] + 1 for x, y in zip(runs, runs[1:], strict=False))


def test_one_line_many_times(spark):
    """Copies that overlap the first one go as well: of a line many times over, the first is left."""
    got = dedup(spark.createDataFrame([(1, "\n".join(["a"] * 100))], "doc_id bigint, text string"), min_words=20).first()
    assert (got.text, got.n_deleted, [tuple(x) for x in got.runs]) == ("a", 99, [(1, 99, 1, 0)])


def test_long_documents(spark):
    """Two equal documents of 50,000 lines: work grows with the lines, not with their square."""
    import time

    lines = "\n".join(f"line {k} of this text" for k in range(50_000))
    began = time.perf_counter()
    got = {x.doc_id: x for x in dedup(spark.createDataFrame([(1, lines), (2, lines)], "doc_id bigint, text string")).collect()}
    assert got[1].text == lines and got[2].text == "" and got[2].n_deleted == 50_000
    assert time.perf_counter() - began < 120
