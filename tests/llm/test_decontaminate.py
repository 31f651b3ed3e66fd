import random
import re
from collections import Counter

import pytest

from plumbline.llm.decontaminate import Items, clean, find, matches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        if item is not None:
            for k in range(len(w) - m + 1 if w else 0):
                windows.setdefault(tuple(w[k : k + m]), set()).add(item)
    out = Counter()
    for row in rows:
        w, hit, found = words(row[1]), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    found |= own
        out[row[0], len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.fixture(scope="module")
def items(rows):
    r = random.Random(8)
    texts = [x[1] for x in rows if x[1] and len(words(x[1])) > 14]
    out = [(k, " ".join(words(t)[a : a + r.choice([3, 9, 10, 11, 30])]).upper()) for k, (t, a) in enumerate((r.choice(texts), r.randrange(10)) for _ in range(25))]
    return [*out, (3, "second text of item three"), (30, None), (31, ""), (32, "a"), (None, "z 9"), (33, "never found in any of these")]


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize("block_bytes", [1 << 20, 600])
def test_against_brute_force(spark, docs, rows, items, block_bytes):
    got = matches(docs, bench(spark, items), block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got) == brute(rows, items)
    texts = dict(items)
    for r in got:
        assert {m.item for m in r.matches} <= set(r["items"]) and bool(r["items"]) == bool(r.matches)
        for m in r.matches:
            own = words(texts[m.item] if m.item != 3 else "") or words(next(t for k, t in items if k == 3 and words(t)[m.item_start : m.item_start + m.words]))
            assert len(own[m.item_start : m.item_start + m.words]) == m.words


def longest_matches(text, items, n):
    """Runs of words of an item, n words or a whole shorter item, of which none lies within another of its kind."""
    w = words(text)
    found = set()
    for short in {min(n, len(words(t))) for _, t in items} - {0}:
        spans = set()
        for _, t in items:
            v = words(t)
            if min(n, len(v)) == short:
                for p in range(len(w)):
                    for q in range(len(v)):
                        m = 0
                        while p + m < len(w) and q + m < len(v) and w[p + m] == v[q + m]:
                            m += 1
                        if m >= short:
                            spans.add((p, m))
        found |= {(p, m) for p, m in spans if not any((a, b) != (p, m) and a <= p and p + m <= a + b for a, b in spans)}
    return found


@pytest.mark.parametrize("seed", range(30))
def test_matches_against_brute_force(seed):
    r = random.Random(seed)
    n, few = r.choice([2, 3, 4]), r.choice(["ab", "abc", "abcdef"])
    text = lambda k: " ".join(r.choices(few, k=k))
    items = [(k, text(r.randint(1, 12))) for k in range(r.randint(1, 6))]
    texts = [text(r.randint(0, 40)) + " zz " + text(20) for _ in range(5)]
    for t, (k, names, spans) in zip(texts, find(texts, Items(items, n)), strict=True):
        assert k == len(words(t)) and {x[1:3] for x in spans} == longest_matches(t, items, n)
        assert set(names) == {i for i, own in items if any(words(own)[a : a + min(n, len(words(own)))] == words(t)[b : b + min(n, len(words(own)))] for a in range(max(1, len(words(own)) - n + 1)) for b in range(k))}
        for item, start, m, at in spans:
            assert words(dict(items)[item])[at : at + m] == words(t)[start : start + m] and len(words(dict(items)[item])[at : at + m]) == m


@pytest.mark.parametrize("seed", range(5))
def test_pieces_of_texts_and_suffixes(seed, monkeypatch):
    """Cut into pieces of any size, texts have the same words and matches."""
    from plumbline.llm import decontaminate as own

    r = random.Random(seed)
    items = Items([(k, " ".join(r.choices("abc", k=r.randint(1, 9)))) for k in range(5)], 3)
    texts = [" ".join(r.choices(["a", "b", "c", "zz,", ""], k=r.randint(0, 200))) for _ in range(4)]
    want = list(find(texts, items))
    monkeypatch.setattr(own, "PIECE", r.randint(1, 30))
    monkeypatch.setattr(own, "SUFFIXES", r.randint(1, 30))
    assert list(find(texts, items)) == want and [n for n, *_ in want] == [len(words(t)) for t in texts]


def test_memory_of_equal_words():
    """Places and items aren't multiplied: 200,000 equal words, an item of 2,000 of them."""
    import tracemalloc

    items = Items([(1, "a " * 2000), (2, "a " * 1500)])
    tracemalloc.start()
    ((n, names, spans),) = find(["a " * 200_000], items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 200_000 and names == [1, 2] and len(spans) == 198_001 and set(s[2] for s in spans) == {2000}
    assert peak < 500e6


def test_longest_matches(spark):
    item = "a b c d e f g h i j k l m n"
    df = spark.createDataFrame([(1, f"x {item} y"), (2, "C, d; e f g h i j k l! z a b c d e f g h i j"), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: [tuple(m) for m in r.matches] for r in matches(df, bench(spark, [(7, item)])).collect()}
    assert got == {1: [(7, 1, 14, 0)], 2: [(7, 0, 10, 2), (7, 11, 10, 0)], 3: []}


def test_repeats_in_text_and_item(spark):
    df = spark.createDataFrame([(1, "a " * 40)], "doc_id bigint, text string")
    row = matches(df, bench(spark, [(1, "a " * 12), (2, "a a")])).first()
    assert (row.n_words, row.n_hit, {m.item for m in row.matches}) == (40, 40, {1, 2}) and row["items"] == [1, 2]


def test_clean(spark, docs, rows, items):
    bad = {k for (k, _, hit, _), _ in brute(rows, items).items() if hit}
    left = clean(docs, bench(spark, items))
    assert Counter(map(tuple, clean(docs, bench(spark, items), block_bytes=400).collect())) == Counter(map(tuple, left.collect()))
    assert left.columns == docs.columns
    assert Counter(map(tuple, rows)) - Counter(map(tuple, left.collect())) == Counter(tuple(r) for r in rows if r[0] in bad)


def test_empty(spark, docs, rows, empty):
    none = bench(spark, [])
    assert matches(empty, none).collect() == [] and clean(empty, none).collect() == []
    assert clean(docs, none).count() == len(rows)
    assert {r.n_hit for r in matches(docs, none).collect()} == {0}


def test_text_ids_and_clashing_names(spark):
    df = spark.createDataFrame([("d", "one two three four five six seven eight nine ten", 1, 2)], "doc_id string, text string, items int, matches int")
    for block_bytes in (1 << 20, 20):
        got = matches(df, spark.createDataFrame([("x", "Two three"), ("y", "five six"), ("z", "no")], "item_id string, text string"), block_bytes=block_bytes).first()
        assert (got.doc_id, got.n_hit, sorted(got["items"]), [tuple(m) for m in got.matches]) == ("d", 4, ["x", "y"], [("x", 1, 2, 0), ("y", 4, 2, 0)])


def test_one_block_at_a_time(spark, docs, items, monkeypatch):
    from plumbline.llm import decontaminate as own

    held, most = [], []
    enter, leave = own.Benchmark.broadcast, None

    class Sent:
        def __init__(self, inner):
            self.inner = inner
            held.append(self)
            most.append(len(held))

        def destroy(self):
            held.remove(self)
            self.inner.destroy()

        def __reduce__(self):
            return self.inner.__reduce__()

    monkeypatch.setattr(own.Benchmark, "broadcast", lambda self, k: Sent(enter(self, k)))
    assert leave is None and matches(docs, bench(spark, items), block_bytes=500).count() == docs.count()
    assert max(most) == 1 and len(most) > 2 and not held
