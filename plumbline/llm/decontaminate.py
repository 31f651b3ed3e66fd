"""Benchmark decontamination: suffix arrays of the training texts, searched for every suffix of the test items.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. Documents are gathered into
shards that fit in memory; each shard's suffixes are sorted by their first ``window`` words, those
only that can match: suffixes with a word that no item has among them are left out. Every suffix of
every item, equal ones once, is looked up by binary search; the interval of the suffix array that it
matches has all its occurrences. So each place of a text gets the number of the window that occurs there, and the items of a
window are those of all its occurrences: places and items are never multiplied. From a matched place on, the longest
verbatim match in any item is found by binary search in a suffix array of the items.

An item shorter than the window is a window as a whole. One scan of the documents, no shuffle; each
document is searched on its own, so no group of copies weighs on a task. The items are taken in blocks of
``block_bytes`` of text at most; one block at a time is read, broadcast and let go. More blocks mean more
passes, whose results (of the documents with matches only) are written and put together by row.

Defined results: null and empty texts have no words and no matches; items without id, text or words match
nothing, and items of one id are taken together; ids of both sides keep their type; a null doc_id is passed through; repeated rows
give repeated rows; columns other than id and text, whatever their names, are not read by ``matches`` and are all kept by
``clean``; empty tables on either side give no matches. Long texts are searched whole. A match that several items
or places have is given with one of them, the same each time; ``items`` has them all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, ship

WINDOW = 10
#: Bytes of texts of a shard.
SHARD_BYTES = 4 << 20
#: Bytes of the items' texts that are broadcast at a time.
BLOCK_BYTES = 8 << 20
#: Upper case to lower case, and what is in no word to spaces.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: Bytes of a text whose words are held as objects at a time, and suffixes that are sorted at a time: a long text takes no more.
PIECE, SUFFIXES = 1 << 20, 1 << 19


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists that make up a piece of it."""
    data, at = (text or "").encode("utf-8", "replace").translate(LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def numbered(text: str | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The numbers of a text's words, 0 for those that the vocabulary doesn't have."""
    found = [np.fromiter(map(vocabulary.get, words, repeat(0)), dtype=np.uint32, count=len(words)) for words in words_of(text)]
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), then the same from starts[1] on, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class Windows:
    """The distinct windows of n words of items, the items of each, and a suffix array of the items' windows."""

    def __init__(self, n: int, width: int, parts: list[np.ndarray], own: np.ndarray):
        self.n, self.width = n, width
        many = np.array([len(p) - n + 1 for p in parts])
        begin = np.cumsum([0, *map(len, parts)])[:-1]
        flat = np.concatenate(parts)
        self.keys, at = np.unique(self.key(flat[spread(begin, many)[:, None] + np.arange(n)]), return_inverse=True)
        #: The windows' numbers from 1 on, in the order of the items, a 0 behind each item.
        first = np.cumsum(np.append(0, many + 1))[:-1]
        self.sequence = np.zeros(int(many.sum()) + len(parts), dtype=np.int64)
        self.sequence[spread(first, many)] = at + 1
        self.item, self.place = np.repeat(own, many + 1), spread(np.zeros(len(parts), dtype=np.int64), many + 1)
        pairs = np.unique(at.astype(np.int64) * (int(own.max()) + 1) + np.repeat(own, many))
        self.items = pairs % (int(own.max()) + 1)
        self.item_ends = np.searchsorted(pairs // (int(own.max()) + 1), np.arange(len(self.keys) + 1))
        self.longest = int(many.max())
        rank, step = self.sequence, 1
        while step < self.longest:
            after = np.append(rank[step:], np.zeros(min(step, len(rank)), dtype=np.int64))
            rank = np.unique(rank * (len(rank) + len(self.keys) + 2) + after, return_inverse=True)[1] + 1
            step *= 2
        self.order = np.argsort(rank, kind="stable")
        self.first = np.searchsorted(self.sequence[self.order], np.arange(len(self.keys) + 2))
        self.bytes = self.sequence.astype(">u4").tobytes()

    def key(self, rows: np.ndarray, fill: int = 0) -> np.ndarray:
        """Rows of word ids as byte strings that sort in the same order."""
        whole = np.full((len(rows), self.width), fill, dtype=">u4")
        whole[:, : rows.shape[1]] = rows
        return whole.view(f"S{4 * self.width}").ravel()

    def extended(self, run: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, windows, place in the sequence) of the longest matches of a run of window numbers; none lies within another."""
        packed, end = run.astype(">u4").tobytes(), 0
        for p in range(len(run)):
            most = min(self.longest, len(run) - p)
            lo, hi = int(self.first[run[p]]), int(self.first[run[p] + 1])
            target = packed[4 * p : 4 * (p + most)]
            k = bisect_left(self.order, target, lo, hi, key=lambda q: self.bytes[4 * q : 4 * (q + most)]) if most > 1 else lo
            best = (0, 0)
            for q in self.order[max(lo, k - 1) : min(hi, k + 1)].tolist():
                here = self.sequence[q : q + most]
                other = np.flatnonzero(here != run[p : p + len(here)])
                best = max(best, (int(other[0]) if len(other) else len(here), -q))
            if p + best[0] > end:
                end = p + best[0]
                yield p, best[0], -best[1]


class Items:
    """The windows of test items, ready to be looked up."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary, self.names, parts = {}, [], []
        known: dict = {}
        own = []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for words in words_of(text) for w in words]
            if ids:
                own.append(known.setdefault(item, len(known)))
                parts.append(np.array(ids, dtype=np.uint32))
        self.names, self.window = list(known), window
        lengths = np.array([min(window, len(p)) for p in parts], dtype=np.int64)
        self.tables = []
        for n in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == n)
            self.tables.append(Windows(n, window, [parts[k] for k in some], np.array(own, dtype=np.int64)[some]))

    def search(self, ids: np.ndarray) -> Iterator[tuple[Windows, np.ndarray, np.ndarray]]:
        """For windows of each length: the places in a shard's word ids (0: a word of no item) where one occurs, in order, and its number there."""
        if not self.tables or not len(ids):
            return
        gaps = np.flatnonzero(ids == 0)
        # How many words from each place on are words of items.
        reach = np.append(gaps, len(ids))[np.searchsorted(gaps, np.arange(len(ids)))] - np.arange(len(ids))
        starts = np.flatnonzero(reach >= self.tables[0].n)
        padded = np.append(ids, np.zeros(self.window, dtype=np.uint32))
        # The last of the suffixes that begin with a shorter window: what is behind it doesn't matter.
        ends = [t.keys if t.n == self.window else np.array([k.ljust(4 * t.n, b"\0").ljust(4 * self.window, b"\xff") for k in t.keys.tolist()], dtype=f"S{4 * self.window}") for t in self.tables]
        found: list[list] = [[] for _ in self.tables]
        for some in (starts[k : k + SUFFIXES] for k in range(0, len(starts), SUFFIXES)):
            rows = padded[some[:, None] + np.arange(self.window)]
            rows[np.arange(self.window) >= reach[some][:, None]] = 0
            keys = self.tables[0].key(rows)
            order = np.argsort(keys, kind="stable")
            suffixes, keys = some[order], keys[order]
            for table, end, own in zip(self.tables, ends, found, strict=True):
                low, high = np.searchsorted(keys, table.keys, "left"), np.searchsorted(keys, end, "right")
                own.append((suffixes[spread(low, high - low)], np.repeat(np.arange(1, len(low) + 1), high - low)))
        for table, own in zip(self.tables, found, strict=True):
            at, number = (np.concatenate([x[k] for x in own]) if own else np.empty(0, dtype=np.int64) for k in range(2))
            by_place = np.argsort(at, kind="stable")
            yield table, at[by_place], number[by_place]


def covered(spans: list[tuple[int, int]]) -> int:
    """Words in the union of (start, words)."""
    total = end = 0
    for start, n in sorted(spans):
        total += max(0, start + n - max(start, end))
        end = max(end, start + n)
    return total


def shards(texts: list[str | None], size: int = SHARD_BYTES):
    """Runs of texts of about that many characters in all; a longer text is a shard of its own."""
    first = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text or "") > size:
            yield texts[first:k]
            first, held = k, 0
        held += len(text or "")
    yield texts[first:]


def find(texts: list[str | None], items: Items):
    """For each text: the number of its words, the items that have a window in it, and its longest matches (item, start, words, item_start)."""
    for shard in shards(texts):
        lengths, parts = [], []
        for text in shard:
            parts.append(numbered(text, items.vocabulary))
            lengths.append(len(parts[-1]))
            parts.append(np.zeros(1, dtype=np.uint32))  # nothing matches across texts
        starts = np.cumsum([0, *(n + 1 for n in lengths)])
        found = [(table, at, number, np.searchsorted(at, starts)) for table, at, number in items.search(np.concatenate(parts))]
        for k, n in enumerate(lengths):
            names, spans = set(), []
            for table, at, number, ends in found:
                own, numbers = at[ends[k] : ends[k + 1]] - starts[k], number[ends[k] : ends[k + 1]]
                if not len(own):
                    continue
                seen = np.unique(numbers) - 1
                names |= set(table.items[spread(table.item_ends[seen], table.item_ends[seen + 1] - table.item_ends[seen])].tolist())
                breaks = np.flatnonzero(np.diff(own) != 1) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(own)], strict=True):
                    spans += [(items.names[table.item[q]], int(own[a]) + p, m + table.n - 1, int(table.place[q])) for p, m, q in table.extended(numbers[a:b])]
            yield n, [items.names[x] for x in sorted(names)], sorted(spans, key=lambda s: s[1:3])


FIELDS = ("item", "start", "words", "item_start")


class Benchmark:
    """The items of a table, read in blocks of a bounded size."""

    def __init__(self, df: DataFrame, window: int, block_bytes: int, item_col: str, text_col: str):
        self.spark, self.window = df.sparkSession, window
        self.kind = df.select(F.col(item_col).alias("item")).schema["item"].dataType.simpleString()
        self.rows = df.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
        size = self.rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.n_blocks = max(1, -(-size // block_bytes))

    def broadcast(self, k: int):
        own = self.rows if self.n_blocks == 1 else self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n_blocks)) == k)
        return self.spark.sparkContext.broadcast(Items([tuple(r) for r in own.collect()], self.window))

    @contextmanager
    def block(self, k: int) -> Iterator:
        """Block k as a broadcast that goes at the end."""
        sent = self.broadcast(k)
        yield sent
        sent.destroy()


def _searched(rows: DataFrame, items, kind: str, id_col: str) -> DataFrame:
    """id, n_words, n_hit, items and matches."""

    def make():
        def work(_, texts):
            n_words, n_hit, names, found = [], [], [], []
            for n, own, spans in find(texts, items.value):
                n_words.append(n)
                n_hit.append(covered([x[1:3] for x in spans]))
                names.append(own)
                found.append([dict(zip(FIELDS, x, strict=True)) for x in spans])
            return n_words, n_hit, names, found

        return work

    match = f"struct<item:{kind},start:bigint,words:bigint,item_start:bigint>"
    return map_texts(rows, make, f"n_words bigint, n_hit bigint, items array<{kind}>, matches array<{match}>", id_col=id_col)


def matches(df: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, items (distinct) and matches: array of (item, start, words, item_start), counted in words from 0.

    A match is a run of words of an item that lies within no longer one; items shorter than the window match as a whole, beside those of other lengths."""
    own = Benchmark(benchmark, window, block_bytes, item_col, item_text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if own.n_blocks == 1:
        return _searched(rows, own.broadcast(0), own.kind, "doc_id")
    scratch = Scratch(df.sparkSession, "decontaminate")
    numbered = scratch.cut(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = None
    for k in range(own.n_blocks):
        with own.block(k) as items:
            part = _searched(numbered, items, own.kind, "_row").withColumnRenamed("doc_id", "_row")
            # All rows once, for their words; then only those with matches.
            part = scratch.cut(part if not k else part.where("n_hit > 0"), f"block{k}")
        found = part if found is None else found.unionByName(part)
    spans = F.array_sort(F.flatten(F.collect_list("matches")), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["words"] - y["words"]).cast("int"))
    merged = found.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), spans.alias("matches"))
    # Words in the union of spans, in order of their starts.
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    stop = lambda x: x["start"] + x["words"]
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), stop(x) - F.greatest(x["start"], a["end"]))).alias("n"), F.greatest(a["end"], stop(x)).alias("end"))
    hit = F.aggregate("matches", zero, add, lambda a: a["n"])
    return numbered.select("_row", "doc_id").join(merged, "_row").select("doc_id", "n_words", hit.alias("n_hit"), "items", "matches")


def clean(df: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of the input that have no match, with all their columns."""
    ship(df.sparkSession)
    at, schema = df.columns.index(text_col), df.schema
    own = Benchmark(benchmark, window, block_bytes, item_col, item_text_col)

    def without(rows: DataFrame, items) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not names for _, names, _ in find(batch.column(at).to_pylist(), items.value)], type=pa.bool_()))

        return rows.mapInArrow(run, schema)

    if own.n_blocks == 1:
        return without(df, own.broadcast(0))
    scratch = Scratch(df.sparkSession, "clean")
    for k in range(own.n_blocks):
        with own.block(k) as items:
            df = scratch.cut(without(df, items), f"block{k}")
        if k:
            scratch.drop(f"block{k - 1}")
    return df
