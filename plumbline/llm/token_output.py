"""Token ids in training order: fixed-length sequences, permuted by a keyed Feistel network, in shards of fixed stride.

Each document's token ids and an end token follow on those of the document before it; the stream is
cut into sequences of ``length`` tokens, the last filled up with end tokens. Sequence i goes to the global slot that a
Feistel network over the next power of four gives it, walking on along the cycle while that lies beyond
the number of sequences: a permutation known from its key alone, that can be inverted, so any slot can be named without
a table. Shard s has the slots from s * per_shard on, in order; every record has the same bytes, so that slot x
starts at byte (x % per_shard) * stride of its shard, and reading can begin or go on anywhere.

Passes: tokenise (ids are written to the shared folder with their places in their partition's stream);
sum up the partitions; cut each batch's part of the stream at the borders of sequences, so that nearly all of them
leave their task whole; one shuffle by shard, every shard of the same size, whatever the documents are like;
join what batches cut apart. Records are written one by one: no task holds a shard.

Defined results: null and empty texts add nothing to the stream; a null id is kept among the ids of a sequence;
ids keep their type; repeated rows are in the stream as often; other columns, whatever their names, are not read; an empty
table gives no sequence; long texts, also long runs of white space, which the library can't split, go on over as many
sequences as they fill. Special tokens' strings in texts are ordinary text. Slots are distinct: there are no ties.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_A_TIME, BROADCAST_KEYS, Scratch, let, map_texts, running_base, ship
from .shingles import BASE, mixed
from .token_counts import WS

LENGTH, PER_SHARD, ROUNDS = 1024, 4096, 6
#: Runs of white space that are taken apart from a text: the library's matching goes back over them and overflows its stack.
BLANKS = re.compile(f"[{WS}]{{1000,}}")
#: Behind each record.
SEPARATOR = "\n"


class Feistel:
    """A keyed permutation of 0 .. n - 1 for arrays of numbers."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = mixed((np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(key & (1 << 62) - 1)) * BASE)

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in keys:
            left, right = right, left ^ (mixed(right ^ k) & self.mask)
        return (right << np.uint64(self.half)) | left  # swapped, so that the same rounds in reverse undo it

    def _walk(self, x, keys: np.ndarray) -> np.ndarray:
        out = self._once(np.asarray(x, dtype=np.uint64), keys)
        while (beyond := np.flatnonzero(out >= self.n)).size:
            out[beyond] = self._once(out[beyond], keys)
        return out.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        return self._walk(sequences, self.keys)

    def sequences(self, slots) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


class Ranks:
    """A vocabulary of ranks (base64 and number in each line) and a pattern in which, as is usual, white space before other
    characters is a word of its own but for its last character."""

    def __init__(self, raw: bytes, pattern: str):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
        self.plain, self.single = core._core_bpe.encode_to_tiktoken_buffer, core._core_bpe.encode_single_piece

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length. A long run of white space is one word, at once; before other characters its last one belongs to these."""
        parts, at = [], 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts.append(np.frombuffer(self.plain(text[at : run.start()], set()), dtype="<u4"))
            parts.append(np.array(self.single(text[run.start() : end].encode()), dtype="<u4"))
            at = end
        parts.append(np.frombuffer(self.plain(text[at:], set()), dtype="<u4"))
        return np.concatenate(parts) if at else parts[0]


_READY: dict[int, Ranks] = {}


def ranks(raw: bytes, pattern: str) -> Ranks:
    key = hash((raw, pattern))
    if key not in _READY:
        _READY[key] = Ranks(raw, pattern)
    return _READY[key]


def number_type(end: int) -> str:
    return "<u2" if end < 1 << 16 else "<u4"


class TokenOutput:
    """The sequences of a table of documents. ``end``: the id of the end token, the largest of all ids."""

    def __init__(self, df: DataFrame, tokenizer: str, pattern: str, *, end: int, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 42, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.length, self.per_shard, self.end, self.key = df.sparkSession, length, per_shard, end, key
        self.scratch = Scratch(self.spark, "tokens")
        raw = self.spark.sparkContext.broadcast(Path(tokenizer).read_bytes())
        kind = number_type(end)

        def make():
            from pyspark import TaskContext

            from plumbline.llm import token_output as own

            encode, part, place = own.ranks(raw.value, pattern).encode, TaskContext.get().partitionId(), 0

            def work(_, texts):
                nonlocal place
                parts, starts, counts, tokens = [part] * len(texts), [], [], []
                for text in texts:
                    ids = np.append(encode(text), end) if text else np.empty(0)
                    starts.append(place)
                    counts.append(len(ids))
                    tokens.append(ids.astype(kind).tobytes())
                    place += len(ids)
                return parts, starts, counts, tokens

            return work

        tokens = map_texts(df, make, "part bigint, start bigint, n bigint, tokens binary", id_col=id_col, text_col=text_col)
        # Long pages, as texts that repeat each other are then in one; this table is held beside the shuffle and the shards.
        self.tokens = self.scratch.cut(tokens, "tokens", parquet_compression_codec_zstd_level=6, parquet_page_size=16 << 20)
        sums = self.tokens.groupBy("part").agg(F.sum("n").alias("n"))
        self.n_tokens, self.n_parts = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        self.bases = running_base(sums, "part", "n")
        self.n_sequences = -(-self.n_tokens // length)
        self.n_shards = max(1, -(-self.n_sequences // per_shard))
        self.order = Feistel(self.n_sequences, key)

    def dictionary(self, rows: int = 1500, size: int = 16 << 10, most: int = 128 << 10) -> bytes:
        """What is frequent in some of the ids, for compressing records one by one. Records don't depend on it; ``rows`` and ``size`` (bytes of each) bound the sample."""
        import zstandard

        some = self.tokens.where("n >= 64").select(F.substring("tokens", 1, size).alias("tokens")).limit(rows).collect()
        record = self.length * np.dtype(number_type(self.end)).itemsize
        samples = [r.tokens[k : k + record] for r in some for k in range(0, len(r.tokens), record)]
        return zstandard.train_dictionary(most, samples).as_bytes() if len(samples) > 1000 and sum(map(len, samples)) > 8 * most else b""

    def sequences(self, tokens: bool = True) -> DataFrame:
        """slot, shard, sequence (long), doc_ids (array, in order), tokens (binary, length ids); partition s is shard s, in the order of slots.

        Without ``tokens``, that column is null and ids are neither read nor shuffled."""
        length, per_shard, order, kind, end = self.length, self.per_shard, self.order, number_type(self.end), self.end
        width = np.dtype(kind).itemsize
        ship(self.spark)
        bases = F.broadcast(self.bases) if self.n_parts <= BROADCAST_KEYS else self.bases
        rows = self.tokens.where("n > 0").join(bases, "part").select("doc_id", (F.col("base") + F.col("start")).alias("place"), "n", (F.col("tokens") if tokens else F.lit(None).cast("binary")).alias("tokens"))
        ids = f"doc_ids array<{self.tokens.schema['doc_id'].dataType.simpleString()}>"

        # Ids are most of what is shuffled; Spark's own compression of blocks leaves a third more of them.
        shared = self.dictionary() if tokens else b""

        def pieces(batches: Iterator) -> Iterator:
            import pyarrow as pa
            import zstandard

            packed = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared)).compress
            for whole in batches:
                place, n = (whole.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                # Documents that follow on one another are one stretch of the stream.
                breaks = np.flatnonzero(place[1:] != (place + n)[:-1]) + 1
                for a, b in zip([0, *breaks.tolist()], [*breaks.tolist(), len(n)], strict=True):
                    if a == b:
                        continue
                    batch, starts, ends = whole.slice(a, b - a), place[a:b], (place + n)[a:b]
                    sequence = np.arange(starts[0] // length, (ends[-1] - 1) // length + 1)
                    begin, stop = np.maximum(sequence * length, starts[0]), np.minimum((sequence + 1) * length, ends[-1])
                    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, stop, "left")
                    offsets = np.append(0, np.cumsum(last - first))
                    own = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first, last - first)
                    held = b"".join(batch.column(3).to_pylist()) if tokens else b""
                    cuts = zip(((begin - starts[0]) * width).tolist(), ((stop - starts[0]) * width).tolist(), strict=True)
                    slot = order.slots(sequence)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((slot // per_shard).astype(np.int32)), pa.array(slot), pa.array(sequence), pa.array(begin - sequence * length), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), batch.column(0).take(pa.array(own))), pa.array([packed(held[x:y]) for x, y in cuts] if tokens else [None] * len(slot), type=pa.binary())],
                        names=["shard", "slot", "sequence", "at", "doc_ids", "tokens"],
                    )

        cut = rows.mapInArrow(pieces, f"shard int, slot bigint, sequence bigint, at bigint, {ids}, tokens binary")
        dealt = cut.repartitionById(self.n_shards, F.col("shard")).sortWithinPartitions("slot", "at")

        def joined(batches: Iterator) -> Iterator:
            import pyarrow as pa
            import zstandard

            unpacked = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)).decompress
            size, fill = length * width, np.array([end], dtype=kind).tobytes()
            names, kinds = ["slot", "shard", "sequence", "doc_ids", "tokens"], None
            open_: list = []  # slot, shard, sequence, ids, parts of the record at hand

            def record(x: list) -> tuple:
                ids = b"".join(map(unpacked, x[4])) if tokens else None
                return x[0], x[1], x[2], x[3], ids + fill * ((size - len(ids)) // width) if tokens else None

            def out(done: list) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

            for whole in batches:
                kinds = [pa.int64(), pa.int32(), pa.int64(), whole.schema.field(4).type, pa.binary()]
                for batch in (whole.slice(k, AT_A_TIME) for k in range(0, whole.num_rows, AT_A_TIME)):
                    done = []
                    for shard, slot, sequence, _, docs, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if open_ and open_[0] != slot:
                            done.append(record(open_))
                            open_ = []
                        if open_:
                            open_[3] += docs
                            open_[4].append(part)
                        else:
                            open_ = [slot, shard, sequence, docs, [part]]
                    if done:
                        yield out(done)
            if open_:
                yield out([record(open_)])

        return dealt.mapInArrow(joined, f"slot bigint, shard int, sequence bigint, {ids}, tokens binary")

    @property
    def stride(self) -> int:
        return self.length * np.dtype(number_type(self.end)).itemsize + len(SEPARATOR)

    def write(self, path: str) -> None:
        """``path/shards/part-00000-...`` and so on: one file for each shard, by its number, a separator behind each record; ``path/layout``: what a reader needs.

        Spark's text writer puts the bytes out as they are, row by row, to any file system, and files appear when their task has ended well.
        The number in a file's name is that of the task's partition, and partition s is shard s."""
        self.sequences().select(F.col("tokens").cast("string")).write.mode("overwrite").option("lineSep", SEPARATOR).text(f"{path}/shards")
        layout = {"length": self.length, "stride": self.stride, "per_shard": self.per_shard, "n_sequences": self.n_sequences, "n_tokens": self.n_tokens, "kind": number_type(self.end), "key": self.key}
        self.spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")


class Reader:
    """Reads written slots from any slot on. Through Spark, a shard's file is held by the task that reads it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.__dict__.update(json.loads(spark.read.text(f"{path}/layout").first()[0]))

    def locate(self, slot: int) -> tuple[int, int]:
        """The shard of a slot and the byte at which its record starts."""
        return slot // self.per_shard, slot % self.per_shard * self.stride

    def files(self, shards: range | None = None) -> DataFrame:
        """shard and content of these files, or of all."""
        read = self.spark.read.format("binaryFile")
        if shards is not None:
            read = read.option("pathGlobFilter", f"part-{{{','.join(f'{s:05d}' for s in shards)}}}-*")
        return read.load(f"{self.path}/shards").select(F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long").alias("shard"), "content")

    def read(self, first: int, n: int) -> DataFrame:
        """slot and tokens of the slots from first on, n at most; only their shards' files are opened."""
        last = min(first + n, self.n_sequences)
        if last <= first:
            return self.spark.createDataFrame([], "slot bigint, tokens binary")
        files = self.files(range(first // self.per_shard, (last - 1) // self.per_shard + 1))
        slots = F.explode(F.sequence(F.greatest(F.lit(first), F.col("shard") * self.per_shard), F.least(F.lit(last), (F.col("shard") + 1) * self.per_shard) - 1))
        rows = files.select("content", "shard").select("content", slots.alias("slot"))
        return rows.select("slot", F.substring("content", F.pmod("slot", F.lit(self.per_shard)).cast("int") * self.stride + 1, F.lit(self.stride - len(SEPARATOR))).alias("tokens"))

    def records(self, value=lambda tokens: tokens, name: str = "tokens") -> DataFrame:
        """slot and ``value`` of the tokens of all records: each shard's file is read once and cut up, in Spark."""
        if not self.n_sequences:
            return self.read(0, 0).select("slot", value(F.col("tokens")).alias(name))
        stride, per_shard = self.stride, self.per_shard

        def cut(content: Column) -> Column:
            ends = F.sequence(F.lit(1), F.floor(F.octet_length(content) / stride).cast("int"))
            return F.transform(ends, lambda k: F.struct((F.col("shard") * per_shard + k - 1).alias("slot"), value(F.substring(content, (k - 1) * stride + 1, F.lit(stride - len(SEPARATOR)))).alias(name)))

        # Held by let, as each use of a row's column would copy the whole file.
        return self.files().where("length(content) > 0").select(F.inline(let(F.col("content"), cut)))
