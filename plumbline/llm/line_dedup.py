"""Line dedup: repeated runs of lines, found by a suffix array over line ids, lose their later copies.

Each document is the sequence of the ids (128 bits of hash) of its lines that have a word. Ranks of
all suffixes of these sequences are made by distributed prefix doubling: the rank of a line is the
number of lines with smaller ids; then the pair (rank by the first 2^k lines, rank by the 2^k
after them) gives the rank by 2^(k+1) lines. Only suffixes that share their rank go into the next
doubling; the others stand already where they stand in the suffix array.

A run counts if it has ``min_words`` words or more. From each line the shortest such run that starts
there and the shortest that ends there are looked at: together they cover every line of every
longer run. Suffixes with the first w lines in common - an interval of the suffix array with longest
common prefixes of w or more - have the same ranks of their first and of their last 2^k of these lines,
2^k <= w < 2^(k+1), so intervals are read off the ranks without comparing lines again. In an
interval the copy in the smallest document (then line) stays; the lines of the others are deleted, also where
they overlap that copy: of a line that stands 100 times, one after another, the first is left.
Touching deleted lines make up the maximal runs. As every line in a sequence has a word, a run
looked at has min_words lines at most and the doubling ends at that depth; no longer common prefixes are measured.

Only built-in functions run, and time grows with a document's lines (times their logarithm). Sums run over blocks of ranks, so that a frequent line with many different
lines after it is no single task's work; groups are aggregated before they are shuffled.

Defined results: a null or empty text has no lines and stays as it is; lines without a word are deleted
only inside one of the shortest runs; a null doc_id counts as greater than all others; of repeated rows one is the
first; long texts are compared whole; an empty table gives an empty result; all columns of the input are carried, those named like
an added one with ``_input`` behind their name. A document's lines are held by one task, as its
text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, SPACE_CLASS, Scratch, let, set_aside

MIN_WORDS = 20
ADDED = ("n_lines", "n_deleted", "runs")


def _n_words(line: Column) -> Column:
    """Words of a line. Where single spaces stand between them, which is cheap to see, spaces are counted."""

    def count(inner: Column) -> Column:
        odd = F.contains(inner, F.lit("  "))
        for blank in SPACE.strip(" \n"):
            odd = odd | F.contains(inner, F.lit(blank))
        spaces = F.octet_length(inner) - F.octet_length(F.replace(inner, F.lit(" "), F.lit("")))
        return F.when(F.octet_length(inner) == 0, 0).when(odd, F.size(F.split(inner, SPACE_CLASS + "+"))).otherwise(spaces + 1)

    return let(F.btrim(line, F.lit(SPACE)), count)


def _before(groups: DataFrame, keys: list[str], order: list[str], number: str, shifts: tuple[int, ...]) -> DataFrame:
    """groups with before: the sum of n over those of the same keys that come earlier in the order.

    Sums within blocks, of blocks within larger blocks, and of the largest: blocks have number's high
    bits in common, so no window holds more than one block's members."""
    if not shifts:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return groups.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))
    block = f"block{shifts[0]}"
    groups = groups.withColumn(block, F.shiftright(number, shifts[0]))
    window = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.groupBy(*keys, block).agg(F.sum("n").alias("n"))
    ahead = _before(sums.withColumn(number, F.shiftleft(block, shifts[0])), keys, [block], number, shifts[1:]).select(*keys, block, F.col("before").alias("ahead"))
    inner = groups.withColumn("within", F.coalesce(F.sum("n").over(window), F.lit(0)))
    return inner.join(ahead, [*keys, block]).withColumn("before", F.col("within") + F.col("ahead")).drop(block, "within", "ahead")


#: Lengths of runs that are tried one by one before all lengths are; a line has some words as a rule.
SHORT = 4


def _wanted(words: Column, least: int) -> Column:
    """(start, w) of the shortest runs from each line and to each line that have the least number of words."""

    def shortest(some: Column) -> Column:
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("w"))
        grow = lambda a, x: F.when(a["sum"] >= least, a).otherwise(F.struct((a["sum"] + x).alias("sum"), (a["w"] + 1).alias("w")))
        return F.aggregate(some, zero, grow, lambda a: F.when(a["sum"] >= least, a["w"]))

    def length(x: Column, near, rest) -> Column:
        """The lines that ``least`` words take, beginning with x and going on with near(1), near(2), ...; rest: all of them."""
        found, total = F.when(x >= least, F.lit(1)), x
        for w in range(2, SHORT + 1):
            total = total + F.coalesce(near(w - 1), F.lit(0))
            found = found.when(total >= least, F.lit(w))
        # Beyond the text's end nothing is found; a sum of what there is may be too small, too.
        return found.otherwise(shortest(rest))

    def from_(x: Column, i: Column) -> Column:
        return code(i, length(x, lambda k: F.get(words, i + k), F.slice(words, i + 1, least)))

    def to(x: Column, i: Column) -> Column:
        first = F.greatest(i + 1 - least, F.lit(0))
        w = length(x, lambda k: F.when(i >= k, F.get(words, i - k)), F.reverse(F.slice(words, first + 1, i + 1 - first)))
        return code(i + 1 - w, w)

    # As numbers, since distinct structs are found by comparing each with each.
    code = lambda start, w: start.cast("long") * (least + 1) + w
    runs = F.array_distinct(F.filter(F.concat(F.transform(words, from_), F.transform(words, to)), lambda x: x.isNotNull()))
    return F.transform(runs, lambda x: F.struct(F.floor(x / (least + 1)).cast("int").alias("start"), (x % (least + 1)).cast("int").alias("w")))


def _ranks(lines: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """lines with r0, r1, ... (rank of the suffix at each line, by 2^k lines) and l0, l1, ... (others share it).

    Only documents with a line that occurs elsewhere are returned."""

    def renewed(found: DataFrame) -> DataFrame:
        return found.groupBy("key").agg(F.collect_list(F.struct("i", "rank", "live")).alias("new"))

    def arrays(k: int, entries: Column) -> dict[str, Column]:
        return {f"r{k}": F.transform(entries, lambda x: x["rank"]), f"l{k}": F.transform(entries, lambda x: x["live"])}

    at = lines.select("key", F.posexplode("ids").alias("i", "id")).select("key", "i", "id.a", "id.b")
    groups = at.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    places = _before(groups, [], ["a", "b"], "a", (40, 52)).select("a", "b", F.col("before").alias("rank"), (F.col("n") > 1).alias("live"))
    first = renewed(at.join(places, ["a", "b"])).where(F.exists("new", lambda x: x["live"])).withColumn("new", F.sort_array("new"))
    ranks = scratch.cut(lines.drop("ids").join(first.select("key", *(c.alias(n) for n, c in arrays(0, F.col("new")).items())), "key"), "ranks0")
    scratch.drop("lines")
    for k in range(levels):
        r, live, step = f"r{k}", f"l{k}", 1 << k
        pairs = F.transform(F.arrays_zip(F.col(r).alias("r"), F.col(live).alias("live")), lambda x, i: F.struct(i.alias("i"), x["r"].alias("r"), F.coalesce(F.get(F.col(r), i + step), F.lit(-1)).alias("s"), x["live"].alias("live")))
        shared = ranks.select("key", F.inline(F.filter(pairs, lambda x: x["live"]))).drop("live")
        groups = shared.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n"))
        places = _before(groups, ["r"], ["s"], "s", (12, 24)).select("r", "s", "n", "before")
        found = shared.join(places, ["r", "s"]).select("key", "i", (F.col("r") + F.col("before")).alias("rank"), ((F.col("n") > 1) & (F.col("s") >= 0)).alias("live"))
        # New are the ranks of exactly the lines that shared theirs: with those of the others they are the whole document's, in order.
        others = F.filter(F.transform(F.arrays_zip(F.col(r).alias("r"), F.col(live).alias("live")), lambda x, i: F.struct(i.alias("i"), x["r"].alias("rank"), x["live"].alias("live"))), lambda x: ~x["live"])
        whole = F.sort_array(F.concat("new", others))
        renew = ranks.join(renewed(found), "key", "left").withColumn("new", F.when(F.col("new").isNotNull(), whole))
        more = {n: F.when(F.col("new").isNull(), F.col(f"{n[0]}{k}")).otherwise(c) for n, c in arrays(k + 1, F.col("new")).items()}
        ranks = scratch.cut(renew.withColumns(more).drop("new"), f"ranks{k + 1}")
        scratch.drop(f"ranks{k}")
    return ranks


def _later(ranks: DataFrame, scratch: Scratch, levels: int) -> DataFrame:
    """key, runs: sorted (line, last, first_doc, first_line): touching and overlapping runs that an earlier run equals as one; the first one's source stays with it."""

    def named(x: Column) -> Column:
        cases: list[Column] = []
        for k in range(levels, -1, -1):
            here, end = x["w"] >= (1 << k), x["start"] + x["w"] - (1 << k)
            level = (F.get(F.col(f"r{k}"), x["start"]), F.get(F.col(f"r{k}"), end), F.get(F.col(f"l{k}"), x["start"]) & F.get(F.col(f"l{k}"), end))
            cases = [c.when(here, v) for c, v in zip(cases, level, strict=True)] if cases else [F.when(here, v) for v in level]
        p, q, live = cases
        return F.struct(
            x["w"].alias("w"), p.alias("p"), q.alias("q"), live.alias("live"), F.get(F.col("nb"), x["start"]).alias("line"), F.get(F.col("nb"), x["start"] + x["w"] - 1).alias("last")
        )

    runs = ranks.select("key", "doc_id", F.inline(F.filter(F.transform("wanted", named), lambda x: x["live"]))).drop("live")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), F.col("key").alias("key"), F.col("line").alias("line"))
    firsts = runs.groupBy("w", "p", "q").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # Written first, so that both sides of the join are plain exchanges, of which Spark can split a hot key.
    firsts = scratch.cut(firsts, "firsts")
    later = runs.join(firsts, ["w", "p", "q"]).where(place > F.col("first")).select("key", "line", "last", F.col("first.doc").alias("first_doc"), F.col("first.line").alias("first_line"))
    by_line = Window.partitionBy("key").orderBy("line", "last", "first_doc", "first_line")
    before = F.max("last").over(by_line.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("line") > before + 1), 1).otherwise(0)
    # A source follows from its run, so that of the least (line, last, ...) is the first one's.
    isles = later.withColumn("begins", begins).withColumn("isle", F.sum("begins").over(by_line.rowsBetween(Window.unboundedPreceding, 0)))
    source = F.min(F.struct("line", "last", "first_doc", "first_line"))
    merged = isles.groupBy("key", "isle").agg(F.max("last").alias("last"), source.alias("first"))
    run = F.struct("first.line", "last", "first.first_doc", "first.first_line")
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _rest(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, which are in order and apart."""
    after = lambda r, j: F.slice(lines, r["last"] + 2, F.coalesce(F.get(runs, j + 1)["line"], F.size(lines)) - r["last"] - 1)
    return F.flatten(F.concat(F.array(F.slice(lines, 1, F.get(runs, 0)["line"])), F.transform(runs, after)))


def dedup(df: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with texts without later copies, and n_lines, n_deleted (long) and runs: array of
    (line, last, first_doc, first_line), the deleted runs and where the run they begin with stays.
    Lines count from 0."""
    df = set_aside(df, (*ADDED, "_key"))
    if min_words < 1:
        raise ValueError("min_words is 1 at least")
    scratch, levels = Scratch(df.sparkSession, "line-dedup"), min_words.bit_length() - 1
    docs = scratch.cut(df.withColumn("_key", F.monotonically_increasing_id()), "docs")
    text = F.col(f"`{text_col}`").cast("string")
    numbered = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"), _n_words(x).alias("n")))
    lines = (
        docs.select(F.col("_key").alias("key"), F.col(f"`{id_col}`").alias("doc_id"), F.filter(numbered, lambda x: x["n"] > 0).alias("own"))
        .select("key", "doc_id", F.transform("own", lambda x: x["i"]).alias("nb"), F.transform("own", lambda x: x["n"]).alias("n"), F.transform("own", lambda x: F.struct(F.xxhash64(x["x"]).alias("a"), F.xxhash64(F.lit(1), x["x"], F.length(x["x"])).alias("b"))).alias("ids"))
        .select("key", "doc_id", "nb", "ids", _wanted(F.col("n"), min_words).alias("wanted"))
    )
    # The filter stands behind the cut: before it, it would be pushed down and the lines be split twice.
    ranks = _ranks(scratch.cut(lines, "lines").where(F.size("nb") > 0), scratch, levels)
    runs = _later(ranks, scratch, levels).withColumnRenamed("key", "_key")
    whole = docs.join(runs, "_key", "left")
    rest = F.array_join(let(F.split(text, "\n"), lambda x: _rest(x, F.col("runs"))), "\n")
    count = F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["line"] + 1)
    added = {
        "n_lines": F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("long"),
        "n_deleted": F.coalesce(count, F.lit(0)).cast("long"),
        text_col: F.when(F.col("runs").isNull(), text).otherwise(rest),
    }
    return whole.withColumns(added).select(*(f"`{c}`" for c in df.columns), *ADDED)
