import random
import re
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm import minhash
from plumbline.llm.common import Scratch
from plumbline.llm.minhash import near_duplicates
from plumbline.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, percent):
    """(doc_id, shingles, component) of every row; rows without id are named by nobody."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return sorted(((d, len(s), least.get(find(k)) if s else d) for k, (d, s) in enumerate(zip([r[0] for r in rows], sets, strict=True))), key=str)


def families(seed, n_families, members):
    """Texts and edits of them, from slight to heavy, so that similarities lie on both sides of the threshold."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(4000)]
    out = []
    for _ in range(n_families):
        base = r.choices(words, k=r.choice([4, 9, 40, 150, 400]))
        for _ in range(members):
            own = list(base)
            for _ in range(int(len(own) * r.choice([0, 0.005, 0.01, 0.015, 0.02, 0.05]))):
                own[r.randrange(len(own))] = r.choice(words)
            out.append(" ".join(own[: len(own) - r.choice([0, 0, 1, 5])]))
    return out


@pytest.mark.parametrize(("percent", "seed"), [(85, 1), (80, 2), (60, 3)])
def test_against_brute_force(spark, percent, seed):
    texts = families(seed, 12, 14)
    rows = [(7 * k % 1009, t) for k, t in enumerate(texts)] + [(2000, None), (2001, " \n"), (2002, "a b"), (2003, "A  b"), (2003, "a b"), (None, texts[3]), (None, "by itself")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), percent=percent).collect()
    want = brute(rows, percent)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len({c for _, _, c in want}) < len(rows) - 20


def test_common_table(docs, rows):
    got = near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute([r[:2] for r in rows], 80)


def test_many_copies_and_empty(spark, empty):
    rows = [(k, "one two three four five six") for k in range(50, 350)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {50} and sum(r.kept for r in got) == 1
    assert near_duplicates(empty).collect() == []


def test_components_of_chains(spark):
    r = random.Random(0)
    links = [(k, k + 1) for k in range(40)] + [(100 + k, 100) for k in range(1, 30)] + [(x, x + 3) for x in range(200, 230)]
    names = list(range(400))
    r.shuffle(names)
    df = spark.createDataFrame([(names[a], names[b]) for a, b in links], "a bigint, b bigint")
    got = {x.node: x.comp for x in minhash.components(df, Scratch(spark, "test"), "c").collect()}
    groups = [range(41), range(100, 130), *(range(200 + k, 233, 3) for k in range(3))]
    for g in groups:
        own = {names[k] for k in g}
        assert {got.get(x, x) for x in own} == {min(own)}


def test_densified_bins_agree_as_sets_do():
    """The share of equal bins is the similarity, also for sets far smaller than the number of bins."""
    r = np.random.default_rng(0)
    for n, shared in ((20, 15), (300, 200), (5, 4)):
        same = []
        for _ in range(150):
            pool = np.unique(r.integers(0, 2**64, size=2 * n, dtype=np.uint64))
            r.shuffle(pool)
            a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
            s = minhash.signatures([a, b, np.empty(0, dtype=np.uint64)])
            same.append((s[0] == s[1]).mean())
        assert abs(np.mean(same) - shared / (2 * n - shared)) < 0.03


def test_word_hashes():
    hashes, at = word_hashes([b"ab  c", b"", b" c ab abc", b"x"])
    assert at.tolist() == [0, 2, 2, 5, 6]
    assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[3] and hashes[1] == hashes[2]
    assert [len(s) for s in shingle_sets(["a b c d e f", None, "a b", "a a a a a a a", "A B"])] == [2, 0, 1, 1, 1]
    two = list(shingle_sets(["a b", "A\tB ", "b a"]))
    assert two[0] == two[1] and two[0] != two[2]


def test_rows_of_bands():
    assert [minhash.rows_for(p) for p in (95, 85, 80, 60)] == [6, 6, 5, 2]


def bucket_of(spark, sets, comps):
    """A run whose nodes all share one bucket, with these sets and components."""
    run = object.__new__(minhash.NearDuplicates)
    run.percent, run.scratch = 85, Scratch(spark, "test")
    nodes = [(k, len(s)) for k, s in enumerate(sets)]
    run.nodes = run.scratch.cut(spark.createDataFrame([(k, n, [7]) for k, n in nodes], "node bigint, n bigint, keys array<bigint>"), "nodes")
    buckets = run.scratch.cut(spark.createDataFrame([(0, 7, k, n) for k, n in nodes], "band int, key bigint, node bigint, n bigint"), "buckets")
    own = run.scratch.cut(spark.createDataFrame([(k, sorted(s)) for k, s in enumerate(sets)], "node bigint, set array<bigint>"), "sets")
    return run, buckets, spark.createDataFrame(list(enumerate(comps)), "node bigint, comp bigint"), own


@pytest.mark.parametrize("common", [70, 86, 91])
def test_a_bucket_of_many_components(spark, common, monkeypatch):
    """5,000 nodes in 500 components without a link between them: candidates are no square of the nodes."""
    seen = []
    confirmed = minhash.NearDuplicates.confirmed
    monkeypatch.setattr(minhash.NearDuplicates, "confirmed", lambda self, pairs, sets, name: (seen.append(pairs.count()), confirmed(self, pairs, sets, name))[1])
    sets = [set(range(common)) | {1000 * (k // 10 + 1) + j for j in range(100 - common)} for k in range(5000)]
    run, buckets, comps, own = bucket_of(spark, sets, [k // 10 * 10 for k in range(5000)])
    got = run.rest(buckets, comps, own)
    assert sum(seen) < 20 * 5000
    assert {(r.node, r.comp) for r in got.collect()} == {(k, k // 10 * 10) for k in range(5000)}


def test_links_that_no_centre_has(spark):
    """A chain of sets in one bucket, of which each is linked with its neighbours alone; all its links are found."""
    sets = [set(range(4 * k, 4 * k + 100)) for k in range(60)] + [set(range(10_000 + k, 10_100 + k)) for k in range(0, 90, 30)]
    run, buckets, comps, own = bucket_of(spark, sets, range(len(sets)))
    got = {r.node: r.comp for r in run.rest(buckets, comps, own).collect()}
    assert {got.get(k, k) for k in range(60)} == {0} and [got.get(k, k) for k in (60, 61, 62)] == [60, 61, 62]


def test_clashing_names_and_long_texts(spark):
    """Columns named like those that the stages add; a text of 50,000 words, twice."""
    long = " ".join(map(str, range(50_000)))
    rows = [(1, long, 1, 2, 3), (2, long + " end", 4, 5, 6), (3, "a b c", 7, 8, 9), (3, "a b c", 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node int, keys int, n int")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, percent=85).collect()) == [(1, 49_996, 1, True), (2, 49_997, 1, False), (3, 1, 3, True), (3, 1, 3, True)]
    other = df.withColumnsRenamed({"node": "_row", "keys": "_who", "n": "kept"})
    got = minhash.representatives(other)
    assert got.columns == other.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_later_rounds_begin_with_what_is_left(spark, monkeypatch):
    """Of nodes that can't have a link, none is looked at in the second round."""
    seen = []
    viable = minhash.NearDuplicates.viable

    def watched(self, rows, sets, name):
        out = viable(self, rows, sets, name)
        seen.append(({r.node for r in rows.collect()}, {r.node for r in out.collect()}))
        return out

    monkeypatch.setattr(minhash.NearDuplicates, "viable", watched)
    chain = [set(range(4 * k, 4 * k + 100)) for k in range(60)]
    sets = chain + [set(range(10_000 + 200 * k, 10_100 + 200 * k)) for k in range(500)]
    run, buckets, comps, own = bucket_of(spark, sets, range(len(sets)))
    got = {r.node: r.comp for r in run.rest(buckets, comps, own).collect()}
    assert {got.get(k, k) for k in range(60)} == {0} and all(got.get(k, k) == k for k in range(60, 560))
    assert len(seen) == 2 and len(seen[0][0]) == 560 and seen[1][0] <= seen[0][1] <= set(range(60))


def first_of_each(rows, percent):
    """The rows that representatives() leaves, as a sorted list: of each component that of the least id, nulls last, then the first."""
    numbers = brute([(k, r[1]) for k, r in enumerate(rows)], percent)
    members = {}
    for k, _, c in numbers:
        members.setdefault(c, []).append(k)
    return sorted((rows[min(m, key=lambda k: (rows[k][0] is None, rows[k][0], k))] for m in members.values()), key=str)


@pytest.mark.parametrize("most", [None, 0])
def test_representatives_leave_texts_where_they_are(spark, rows, monkeypatch, most):
    """One row of each component, without a shuffle of the rows unless there are too many to drop; the tables of the search are gone."""
    if most is not None:
        monkeypatch.setattr(minhash, "BROADCAST_KEYS", most)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = list(Scratch.live)
    try:
        own = [r[:2] for r in rows] + [(5000 + k, t) for k, t in enumerate(families(4, 6, 40))]
        df = spark.createDataFrame([(*r, k) for k, r in enumerate(own)], "doc_id bigint, text string, _Gone int").coalesce(1)
        got = minhash.representatives(df, percent=80)
        assert got.columns == ["doc_id", "text", "_Gone"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == first_of_each(own, 80)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) == (most == 0)
        assert [s.root.rsplit("/", 1)[1].split("-")[0] for s in Scratch.live if s not in tables] == ["rows"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
