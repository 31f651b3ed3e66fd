"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, stars of candidates.

1. A text's set of word shingles gives a signature: its hashes fall into bins by their first bits, and each bin
   keeps its least. An empty bin takes the value of another, which a hash of (bin, attempt) common to all
   texts picks until it is a filled one. Texts with equal sets are one node from here on.
2. ``rows`` bins make a band; nodes that agree in a band share a bucket. In each bucket every node is a candidate
   with one centre, so a bucket of m nodes has m - 1 candidate pairs.
3. Candidates are confirmed on the full sets; confirmed links give components.
4. A link between two nodes neither of which was a centre would be missed. So buckets that still hold several
   components are looked at again. A node can have a link to another component only if enough of its shingles
   occur in other components, for the size of some node of another component in its bucket; the others are done. Of the rest,
   each bucket takes another centre, for ``STARS`` more rounds or until no link is found: m - 1 candidates again. Components
   only grow, so a node that was done stays so: a round begins with the rows that the one before has left.
   What is then left is listed: pairs of different components are
   candidates if the shingles that other components have too, counted by groups of hashes, are enough for a
   link: a pair's intersection is at most the sum of the smaller counts of each group. These bounds are
   exact, so no link within a bucket is lost. A pair that shares many buckets is a candidate in the first of them only.

A band has as many rows as leave two sets at the threshold without a common bucket with a probability of
1e-6 at most: at 0.85, 42 bands of 6 rows leave 2e-9. No list of the
members of a bucket or component is ever collected; links and components stay distributed. What a large side is
joined with is written first where it is an aggregate of that side: then both are plain exchanges, of which Spark can split a hot key.

Defined results: a null or blank text has an empty set, is linked with nothing and is its own component; a text with
fewer words than a shingle has one shingle, all of them; a null id counts in no minimum: its component is
the least id among the other texts, null if there is none; repeated rows are equal texts and share a component; other
columns are not read; an empty table gives an empty result; long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Scratch, map_texts, only_for, set_aside
from .shingles import BASE, mixed, numbers, set_hash, shingle_sets

BINS_LOG = 8
BANDS, MOST_ROWS = 42, 6
#: Attempts of densification before the next filled bin is taken.
ATTEMPTS = 64
#: Groups of hashes in which shingles are counted for bounds.
GROUPS = 32
#: Candidates whose ids may be broadcast to read their texts again; more are joined by a shuffle.
BROADCAST_NODES = 1 << 18
#: Further rounds of stars before what is left is listed.
STARS = 1


def rows_for(percent: int, bands: int = BANDS, miss: float = 1e-6) -> int:
    """The most rows of a band at which two sets of that similarity share a bucket but for the given probability."""
    return max((r for r in range(2, MOST_ROWS + 1) if (1 - (percent / 100) ** r) ** bands <= miss), default=1)


def signatures(sets: list[np.ndarray], bins_log: int = BINS_LOG) -> np.ndarray:
    """A row of 2^bins_log values for each set that isn't empty."""
    bins = 1 << bins_log
    out, filled = np.zeros((len(sets), bins), dtype=np.uint64), np.zeros((len(sets), bins), dtype=bool)
    hashes = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = row * bins + (hashes >> np.uint64(64 - bins_log)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, dtype=np.int64)
    out.ravel()[at[first]], filled.ravel()[at[first]] = hashes[first], True
    donors = (numbers(ATTEMPTS * bins, 2) >> np.uint64(64 - bins_log)).astype(np.int64).reshape(ATTEMPTS, bins)
    rows, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    for attempt in donors:
        if not len(rows):
            break
        donor = attempt[empty]
        ok = filled[rows, donor]
        out[rows[ok], empty[ok]] = out[rows[ok], donor[ok]]
        rows, empty = rows[~ok], empty[~ok]
    for r, b in zip(rows, empty, strict=True):
        own = np.flatnonzero(filled[r])
        out[r, b] = out[r, own[np.searchsorted(own, b) % len(own)]]
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """bands keys for each row of signatures."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    keys = np.broadcast_to(numbers(bands, 3), (len(signature), bands)).copy()
    for k in range(rows):
        keys = mixed(keys * BASE + parts[:, :, k])
    return keys


def _sketch(size: int, bands: int, rows: int) -> Callable:
    def make():
        def work(_, texts):
            sets = list(shingle_sets(texts, size))
            ids = [set_hash(s) for s in sets]
            keys = band_keys(signatures(sets), bands, rows).view(np.int64)
            return [len(s) for s in sets], [a for a, _ in ids], [b for _, b in ids], [k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)]

        return work

    return make


def _read_sets(size: int) -> Callable:
    def make():
        def work(_, texts, *own):
            sets = list(shingle_sets(texts, size))
            ids = [set_hash(s) for s in sets]
            return [*own, [x for x, _ in ids], [x for _, x in ids], [s.view(np.int64).tolist() for s in sets]]

        return work

    return make


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node and comp (the least node of its component) for all nodes with a link (a, b).

    Large and small stars in turn, until nothing changes: every node moves to the least neighbour."""
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-least")
        large = scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        small = scratch.cut(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
        joined = large.join(small, "u")
        edges = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        edges = scratch.cut(edges, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")  # the other tables are written over
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now


class NearDuplicates:
    """The stages of a run and its tables; use near_duplicates()."""

    def __init__(self, df: DataFrame, *, size: int, percent: int, bands: int, rows: int, id_col: str, text_col: str):
        self.df, self.size, self.percent, self.id_col, self.text_col = df, size, percent, id_col, text_col
        self.scratch = Scratch(df.sparkSession, "minhash")
        schema = "n bigint, c1 bigint, c2 bigint, keys array<bigint>"
        self.sketches = self.scratch.cut(map_texts(df, _sketch(size, bands, rows), schema, id_col=id_col, text_col=text_col), "sketches")
        nodes = self.sketches.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
        self.nodes = self.scratch.cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        self.sketches = self.scratch.cut(self.sketches.drop("keys"), "sizes")  # texts of one set have the same keys: the nodes hold them
        self.scratch.drop("sketches")

    def enough(self, inter: Column, n: Column, m: Column) -> Column:
        """Whether so large an intersection of sets of n and m makes a link."""
        return (100 + self.percent) * inter >= self.percent * (n + m)

    def buckets(self) -> DataFrame:
        """band, key, node, n and the bucket's centre and its n, for buckets of two nodes or more."""
        members = self.nodes.select("node", "n", F.posexplode("keys").alias("band", "key"))
        centre = F.min(F.struct(F.xxhash64("node", "band"), F.col("node").alias("node"), F.col("n").alias("n"))).alias("centre")
        shared = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m"), centre).where("m > 1").select("band", "key", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n"))
        return self.scratch.cut(members.join(self.scratch.cut(shared, "shared"), ["band", "key"]), "buckets")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node and set (array of hashes) of the wanted nodes, whose texts are read again."""
        own = self.scratch.cut(self.nodes.join(wanted, "node", "left_semi").select("node", "doc", F.col("c1").alias("d1"), F.col("c2").alias("d2")), "wanted")
        small = own.count() <= BROADCAST_NODES
        # Rows without an id are no document's first, unless a set has no other.
        rows = self.df.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).cast("string").alias("text"))
        found = rows.join(F.broadcast(own) if small else own, F.col("doc_id").eqNullSafe(F.col("doc")))
        read = map_texts(found, _read_sets(self.size), "node bigint, d1 bigint, d2 bigint, c1 bigint, c2 bigint, set array<bigint>", extra=("node", "d1", "d2"))
        return self.scratch.cut(read.where("c1 = d1 AND c2 = d2").select("node", "set").dropDuplicates(["node"]), "sets")

    def confirmed(self, pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) that are links."""
        left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("x")), sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
        inter = F.size(F.array_intersect("x", "y"))
        return self.scratch.cut(pairs.join(left, "a").join(right, "b").where(self.enough(inter, F.size("x"), F.size("y"))).select("a", "b"), name)

    def unresolved(self, buckets: DataFrame, comps: DataFrame) -> DataFrame:
        """Rows of buckets that hold several components, with comp."""
        rows = buckets.select("band", "key", "node", "n").join(comps, "node", "left").select("band", "key", "node", "n", F.coalesce("comp", "node").alias("comp"))
        several = rows.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key")
        return rows.join(self.scratch.cut(several, "several"), ["band", "key"], "left_semi")

    def viable(self, rows: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """band, key, node, n, comp, avail and counts (shingles that another component has, in all and by group) of the rows of buckets
        whose node may have a link to another component there; in buckets of several components."""
        live = self.scratch.cut(rows.select("node", "comp", "n").distinct(), f"{name}-all")
        group = F.pmod(F.col("h"), F.lit(GROUPS))
        counts = F.array(*(F.count(F.when(group == k, F.lit(1))).cast("int") for k in range(GROUPS))).alias("counts")
        for k in range(2):  # what is left out takes its shingles with it
            at = live.select("node", "comp", "n").join(sets, "node").select("node", "comp", "n", F.explode("set").alias("h"))
            shared = at.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
            found = at.select("node", "h").join(self.scratch.cut(shared, f"{name}-shared{k}"), "h").groupBy("node").agg(F.count(F.lit(1)).alias("avail"), counts)
            live = self.scratch.cut(live.select("node", "comp", "n").join(found, "node").where(self.enough(F.col("avail"), F.col("n"), F.col("avail"))), f"{name}-live{k}")
            self.scratch.drop(f"{name}-shared{k}")
        rows = self.scratch.cut(rows.select("band", "key", "node", "n", "comp").join(live.select("node", "avail"), "node"), f"{name}-rows")
        for k in range(2):
            # An intersection is at most avail: the smallest node of the bucket shows whether it may be enough.
            least = rows.groupBy("band", "key").agg(F.min("n").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band", "key", "least")
            fits = rows.join(self.scratch.cut(least, f"{name}-least{k}"), ["band", "key"]).where(self.enough(F.col("avail"), F.col("n"), F.col("least"))).drop("least")
            rows = self.scratch.cut(fits, f"{name}-fits{k}")
        return self.scratch.cut(rows.join(live.select("node", "counts"), "node"), name)

    def possible(self, x: Callable, y: Callable) -> Column:
        """Whether the bounds leave a link between two rows of viable(): of different components and sizes near enough."""
        total = F.aggregate(F.zip_with(x("counts"), y("counts"), lambda p, q: F.least(p, q)), F.lit(0), lambda s, v: s + v)
        return (x("comp") != y("comp")) & self.enough(F.least(x("avail"), y("avail")), x("n"), y("n")) & self.enough(total, x("n"), y("n"))

    def again(self, rows: DataFrame, k: int) -> DataFrame:
        """Candidate pairs of each bucket's rows with another centre, of those that are viable."""
        parts = ("node", "n", "comp", "avail", "counts")
        centre = F.min(F.struct(F.xxhash64("node", "band", F.lit(k)).alias("by"), *parts)).alias("centre")
        centres = self.scratch.cut(rows.groupBy("band", "key").agg(centre), f"centres{k}")
        pairs = rows.join(centres, ["band", "key"]).where(self.possible(F.col, lambda c: F.col(f"centre.{c}")))
        return pairs.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()

    def across(self, rows: DataFrame) -> DataFrame:
        """Candidate pairs of different components that share a bucket, all that the bounds leave."""
        rows = self.scratch.cut(rows.join(self.nodes.select("node", "keys"), "node"), "rows")
        a, b = rows.alias("a"), rows.alias("b")
        x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
        first = F.array_position(F.zip_with(x("keys"), y("keys"), lambda p, q: p == q), True)
        on = (x("band") == y("band")) & (x("key") == y("key")) & (x("comp") < y("comp")) & self.enough(F.least(x("avail"), y("avail")), x("n"), y("n")) & (first == x("band") + 1) & self.possible(x, y)
        return a.join(b, on).select(x("node").alias("a"), y("node").alias("b"))

    def merged(self, links: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """Components with further links: the components of components, which are few."""
        joined = components(self._between(links, comps), self.scratch, name).select(F.col("node").alias("comp"), F.col("comp").alias("least"))
        moved = comps.join(joined, "comp", "left").select("node", F.coalesce("least", "comp").alias("comp"))
        # A component's least node is not among its members in comps.
        return self.scratch.cut(moved.union(joined.select("comp", "least")), f"{name}-merged")

    def rest(self, buckets: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
        """Components with the links that the first stars have missed."""
        rows = buckets
        for k in range(STARS + 1):
            rows = self.viable(self.unresolved(rows, comps), sets, f"viable{k}")
            if rows.isEmpty():
                return comps
            links = self.confirmed(self.again(rows, k + 1) if k < STARS else self.across(rows), sets, f"more{k}")
            if links.isEmpty() and k < STARS:  # the same components, so the same rows: they are listed now
                links = self.confirmed(self.across(rows), sets, f"listed{k}")
                return comps if links.isEmpty() else self.merged(links, comps, f"all{k}")
            comps = self.merged(links, comps, f"all{k}")
        return comps

    def run(self) -> DataFrame:
        buckets = self.buckets()
        sets = self.sets(buckets.select("node").distinct())
        near = 100 * F.least("n", "centre_n") >= self.percent * F.greatest("n", "centre_n")
        stars = buckets.where((F.col("node") != F.col("centre")) & near).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        links = self.confirmed(stars, sets, "links")
        comps = components(links, self.scratch, "stars")
        comps = self.rest(buckets, comps, sets)
        of_node = self.nodes.join(comps, "node", "left").select("node", "c1", "c2", "doc", F.coalesce("comp", "node").alias("comp"))
        least = of_node.groupBy("comp").agg(F.min("doc").alias("component_id"))
        named = self.scratch.cut(of_node.join(least, "comp").select("c1", "c2", "component_id"), "named")
        out = self.sketches.select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2").join(named, ["c1", "c2"], "left")
        component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

    def _between(self, links: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between nodes as links between their components."""
        for side in ("a", "b"):
            own = comps.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
            links = links.join(own, side, "left").withColumn(side, F.coalesce(f"comp_{side}", side)).drop(f"comp_{side}")
        return links.where("a <> b")


def near_duplicates(df: DataFrame, *, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the component) and kept (doc_id = component_id).

    Texts are linked if 100 * intersection >= percent * union of their sets of shingles of ``size`` words."""
    return NearDuplicates(df, size=size, percent=percent, bands=bands, rows=rows or rows_for(percent, bands), id_col=id_col, text_col=text_col).run()


def representatives(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component, with all columns: that of the least id, nulls last; of rows with the same id, the first.

    Rows are told apart by a number, which is written first, so that it is the same in every pass; ids may repeat or be null.
    Which rows go is a bit for each row, 64 in a number, for numbers with a bit set: these are broadcast, so the texts stay where they are."""
    names = df.columns
    df = set_aside(df, ("_row", "_who", "_part", "_gone"))
    scratch = Scratch(df.sparkSession, "rows")
    numbered = scratch.cut(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    own = F.col(f"`{df.columns[names.index(id_col)]}`")
    who = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("_row").alias("row"))
    part, bit = F.shiftright("_row", 6).alias("_part"), F.col("_row").bitwiseAND(63).cast("int")
    with only_for():
        found = near_duplicates(numbered.select(who.alias("_who"), F.col(f"`{df.columns[names.index(text_col)]}`").alias("_text")), id_col="_who", text_col="_text", **options)
        bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_gone")
        gone = scratch.cut(found.where("NOT kept").select(F.col("doc_id.row").alias("_row")).groupBy(part).agg(bits), "gone")
    few = gone.count() <= BROADCAST_KEYS
    marked = numbered.withColumn("_part", part).join(F.broadcast(gone) if few else gone, "_part", "left")
    return marked.where(F.coalesce(F.getbit("_gone", bit), F.lit(0)) == 0).select(*(f"`{c}`" for c in df.columns)).toDF(*names)
