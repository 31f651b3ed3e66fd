"""Quality rules: a threshold table compiled into one Spark projection.

Every metric and every rule is a built-in Spark expression; no user function runs. The metrics
of a text depend on that text alone, so the plan is one scan without a shuffle and no group of
rows can weigh on a task.

Defined results: a null or empty text has no words, all its counts are 0 and it fails the base
rule; a null doc_id is passed through; repeated rows give repeated rows; columns of the input
other than the id and the text are not looked at, whatever their names; an empty table gives an
empty result. Very long texts are processed whole: all metrics are linear or n log n in them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CLASS, let

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with in is it for on was are this as from at by or an a "
    "der die das und ist von zu den mit auf für im ein eine des dem nicht "
    "le la les de des et en un une du est que pour dans sur au par il "
    "el los las que y por con para una su se del es"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high`` in hundredths, for texts of ``least`` words or more."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None
    least: int = 0

    def passed(self) -> Column:
        scaled, base = F.lit(100) * F.col(self.numerator), F.col(self.denominator)
        tests = [scaled >= self.low * base] if self.low is not None else []
        tests += [scaled <= self.high * base] if self.high is not None else []
        ok = F.lit(True)
        for test in tests:
            ok = ok & test
        return (F.col("n_words") < self.least) | ok if self.least else ok


#: The threshold table. Ratios are hundredths, so that every comparison is one of whole numbers.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1600),
    Rule("symbol_to_word", "n_symbols", "n_words", high=10),
    Rule("exclamation_to_word", "n_exclaims", "n_words", high=40),
    Rule("upper_case", "n_upper", "word_chars", high=60),
    Rule("stop_words", "n_stop", "n_words", low=1, least=60),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40, least=30),
    Rule("bullet_lines", "n_bullets", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis", "n_lines", high=40),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop", "n_exclaims", "n_upper", "n_bullets", "n_ellipsis")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def _windows(hashes: str) -> Column:
    """A hash for each window of five consecutive words, from the hashes of the words."""
    at = lambda i: F.xxhash64(*(F.get(F.col(hashes), i + k) for k in range(5)))
    return F.when(F.size(hashes) >= 5, F.transform(F.sequence(F.lit(0), F.size(hashes) - 5), at)).otherwise(F.array().cast("array<bigint>"))


def _repeated(words: str, windows: str) -> Column:
    """Words in windows found twice or more.

    A text whose window hashes all differ has none. Otherwise the (hash, start) pairs are sorted,
    a window with an equal neighbour - the words themselves are compared - is repeated, and each
    repeated start covers five words, or fewer up to the next start."""

    def starts(s: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (F.slice(F.col(words), x["i"] + 1, 5) == F.slice(F.col(words), y["i"] + 1, 5)), F.lit(False))

        return F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"])

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(5), F.get(p, k + 1) - x)), F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    some = let(F.sort_array(let(pairs, starts)), covered)
    return F.when(F.size(F.array_distinct(F.col(windows))) == F.size(windows), F.lit(0)).otherwise(some).cast("long")


def metrics(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = tuple(STOP_WORDS), keep: Sequence[str] = ()) -> DataFrame:
    """id and the METRICS of each text, all long; columns to keep are in a struct ``row``."""
    row = [F.struct(*(F.col(f"`{c}`").alias(c) for c in keep)).alias("row")] if keep else []
    also = ["row"] * bool(keep)
    text = F.coalesce(F.col("text"), F.lit(""))
    blank = F.lit(SPACE)
    # What is left of a text without its ordinary characters is short; the counts below are taken from it.
    marks = F.regexp_replace(text, "[^#*$%&|<>!A-Z]+", "")
    only = lambda chars: F.length(F.regexp_replace(F.col("marks"), f"[^{chars}]+", "")).cast("long")
    among = lambda array, test: F.size(F.filter(array, test)).cast("long")
    stops = sorted({y for x in stop_words for y in (x, x.capitalize(), x.upper())})
    first, last = (lambda x: F.substring(F.ltrim(x), 1, 2)), (lambda x: F.rtrim(x))
    return (
        df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *row)
        .select(*also, "doc_id", words_of(F.col("text")).alias("words"), F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, blank)) > 0).alias("lines"), marks.alias("marks"))
        .select(*also, "doc_id", "words", "lines", "marks", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
        .select(*also, "doc_id", "words", "lines", "marks", _windows("hashes").alias("windows"))
        .select(
            *also,
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
            only("#*$%&|<>").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated("words", "windows").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
            among("words", lambda w: w.isin(stops)).alias("n_stop"),
            only("!").alias("n_exclaims"),
            only("A-Z").alias("n_upper"),
            among("lines", lambda x: first(x).isin("- ", "* ", "• ")).alias("n_bullets"),
            among("lines", lambda x: last(x).endswith("...") | last(x).endswith("…")).alias("n_ellipsis"),
        )
    )


def quality(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = tuple(STOP_WORDS), keep: Sequence[str] = ()) -> DataFrame:
    """id, METRICS, base_failed, failed (names of the rules that a text breaks) and kept.

    ``keep``: columns of the input that are returned too, in a struct ``row``."""
    base = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    broken = F.filter(F.array(*(F.when(~r.passed(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    return (
        metrics(df, id_col=id_col, text_col=text_col, stop_words=stop_words, keep=keep)
        .withColumns({"base_failed": base, "failed": broken})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
    )


def passing(df: DataFrame, **options) -> DataFrame:
    """The rows of the input that are kept, with all their columns.

    The number of the row keeps the filter behind the projection: pushed into it, the filter would copy the
    expressions of all metrics many times over."""
    found = quality(df, keep=df.columns, **options).withColumn("at", F.monotonically_increasing_id())
    return found.where(F.col("kept") & (F.col("at") >= 0)).select(*(F.col(f"row.`{c}`") for c in df.columns))
