"""SentencePiece encoding and decoding on the tokenizers library, built from the model's protobuf.

The model file is parsed here: pieces with their scores and types, the kind of model, the settings of the normaliser. From
these a tokenizer is rebuilt: the normaliser's character map, the marker of spaces, unigram scores or, for a BPE model,
the merges that its scores imply, and byte fallback. Between two characters that are side by side in no piece, no
piece ever lies; where the model has no letter before a marker or a stop in any piece, and no line end
in any, a text is cut there into chunks that are encoded on their own. New chunks of a batch go to the
library together, which encodes them on several threads, and tables keep what was found.

Parity is verified as it runs: the sentencepiece library encodes each chunk that a worker meets for the first time
too, as it is normalised here; a chunk that doesn't begin with a marker behind a line end, whose ids are cut off (where a model has no
byte for line ends, or other normalising, such chunks are not verified). Where the two differ (ties between equal scores), its ids are taken, and ``n_repaired`` counts
these chunks of a text. The normaliser and the cuts themselves are compared with the library in tests only. One scan, no shuffle.

Defined results: null and empty texts have no ids and decode to empty texts; a null id is passed through; repeated
rows give repeated rows; other columns, whatever their names, are not read; an empty table gives an empty result; long texts are encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from dataclasses import dataclass, field
from itertools import chain
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

MARK = "▁"
#: Types of pieces and kinds of models, as the format numbers them.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Marks before which a text may be cut.
STOPS = ",.;:!?"
#: Chunks that a worker keeps at most; beyond, it starts anew. Results don't depend on it.
KEEP = 600_000


def fields(raw: bytes):
    """(number, value) of a protobuf message: ints for varints, bytes for the rest."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            at += 1
            if raw[at - 1] < 128:
                return value, at
            shift += 7

    at = 0
    while at < len(raw):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                n, at = varint(at)
            if n is None:
                raise ValueError(f"a protobuf wire type {kind} is not known")
            value, at = raw[at : at + n], at + n
        yield tag >> 3, value


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, raw: bytes) -> PieceModel:
        m = cls()
        for number, value in fields(raw):
            if number == 1:
                own = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
                m.pieces.append(own[1].decode())
                m.scores.append(struct.unpack("<f", own[2])[0])
                m.types.append(own[3])
            elif number == 2:
                own = dict(fields(value))
                m.kind, m.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
                if own.get(24, 0):
                    raise ValueError("models with the marker as a suffix are not supported")
            elif number == 3:
                own = dict(fields(value))
                m.charsmap = own.get(2, b"")
                m.dummy_prefix, m.trim, m.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        if m.kind not in (UNIGRAM, BPE) or not m.escape or USER in m.types:
            raise ValueError("a unigram or BPE model with escaped spaces and without user-defined pieces is asked for")
        return m

    def chunks(self) -> re.Pattern | None:
        """What finds the chunks of a normalised text; None if there is no safe cut."""
        normal = [p for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL]
        pairs = {p[i : i + 2] for p in normal for i in range(len(p) - 1)}
        if any(x != MARK and y == MARK for x, y in pairs):
            return None
        stops = "".join(c for c in STOPS if all(y != c or x in STOPS + MARK for x, y in pairs))
        line = "\n" if self.byte_fallback and not any("\n" in p for p in normal) else ""
        rest = f"[^{MARK}{stops}{line}]"
        return re.compile("|".join([f"{MARK}*{rest}+", *[f"{MARK}*[{stops}]+{rest}*"] * bool(stops), f"{MARK}+", *[f"{line}+"] * bool(line)]))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, in the order of its score."""
        known = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        out = [(-self.scores[k], known[p[:i]], known[p[i:]], p[:i], p[i:]) for p, k in known.items() for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self):
        """The model of the tokenizers library, for normalised texts."""
        from tokenizers import Tokenizer
        from tokenizers.models import BPE as Bpe
        from tokenizers.models import Unigram

        unknown = self.types.index(UNKNOWN)
        if self.kind == UNIGRAM:
            return Tokenizer(Unigram(list(zip(self.pieces, self.scores, strict=True)), unknown, self.byte_fallback))
        vocabulary = {p: k for k, p in enumerate(self.pieces)}
        return Tokenizer(Bpe(vocabulary, self.merges(), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback))


class Codec:
    """Encodes and decodes texts; holds tables of the chunks met so far."""

    def __init__(self, raw: bytes, *, threads: int = 1, verify: bool = True):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), str(threads > 1).lower()
        self.model = m = PieceModel.parse(raw)
        self.cut = m.chunks()
        self.backend = m.tokenizer()
        if m.charsmap:
            from tokenizers.normalizers import Precompiled

            self.charsmap = Precompiled(m.charsmap)
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_proto=raw)
            lead = self.other.encode("\n")
            #: The ids of a line end at a text's start, if nothing that follows changes them.
            self.lead = lead if lead and m.types[lead[-1]] == BYTE and not (m.charsmap or m.trim) else None
        self.verify, self.chunks, self.repaired = verify, {}, set()
        self.bytes = [b"" if t in (CONTROL, UNUSED) else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]

    def normalise(self, text: str) -> str:
        """The text as its pieces spell it, with markers for spaces."""
        m = self.model
        if m.charsmap:
            text = self.charsmap.normalize_str(text)
        if m.trim:
            text = re.sub(" +", " ", text).strip(" ")
        return (MARK * m.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def _learn(self, new: list[str]) -> None:
        found = [x.ids for x in self.backend.encode_batch_fast(new, add_special_tokens=False)]
        if self.verify:
            skip = int(self.model.dummy_prefix)
            at, texts, ahead = [], [], []
            for k, c in enumerate(new):
                if c[:skip] == MARK * skip and len(c) > skip:
                    plain, lead = c[skip:], []
                elif self.lead is not None:
                    plain, lead = "\n" + c, self.lead
                else:
                    continue
                at.append(k)
                texts.append(plain.replace(MARK, " "))
                ahead.append(lead)
            for k, lead, ids in zip(at, ahead, self.other.encode(texts, num_threads=1) if texts else (), strict=True):
                if ids != lead + found[k]:
                    if ids[: len(lead)] != lead:
                        raise RuntimeError("a line end is no chunk of its own to the library")
                    found[k] = ids[len(lead) :]
                    self.repaired.add(new[k])
        self.chunks.update((c, array("i", ids).tobytes()) for c, ids in zip(new, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, int]]:
        """(ids, chunks repaired) of each text."""
        normal = [self.normalise(t or "") for t in texts]
        parts = [self.cut.findall(n) if self.cut else [n] * bool(n) for n in normal]
        if len(self.chunks) > KEEP:
            self.chunks.clear()
            self.repaired.clear()
        if new := list(set(chain.from_iterable(parts)).difference(self.chunks)):
            self._learn(new)
        get = self.chunks.__getitem__
        return [(np.frombuffer(b"".join(map(get, own)), dtype=np.int32), sum(c in self.repaired for c in own) if self.repaired else 0) for own in parts]

    def decode(self, ids) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def restored(self, text: str | None) -> str:
        """What decoding gives back of a text."""
        out = self.normalise(text or "").replace(MARK, " ")
        return out[1:] if self.model.dummy_prefix else out


_READY: dict[tuple, Codec] = {}


def codec(raw: bytes, threads: int, verify: bool) -> Codec:
    """One for each model and worker process."""
    key = hash(raw), threads, verify
    if key not in _READY:
        _READY[key] = Codec(raw, threads=threads, verify=verify)
    return _READY[key]


def _batches(texts: list, size: int = 1 << 20):
    first = held = 0
    for k, text in enumerate(texts):
        if k > first and held + len(text or ()) > size:
            yield texts[first:k]
            first, held = k, 0
        held += len(text or ())
    yield texts[first:]


def encode(df: DataFrame, model: str, *, threads: int = 2, verify: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, token_ids, n_tokens, n_repaired and round_trip: whether decoding the ids gives the normalised text."""
    raw = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def make():
        import pyarrow as pa

        from plumbline.llm import pieces as own  # the module's tables, not a copy in this closure

        c = own.codec(raw.value, threads, verify)

        def work(_, texts):
            ids, repaired, same = [], [], []
            for some in own._batches(texts):
                for text, (found, n) in zip(some, c.encode(some), strict=True):
                    ids.append(found)
                    repaired.append(n)
                    same.append(c.decode(found.tolist()) == c.restored(text))
            ends = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(ids), type=pa.int32()))
            return lists, [len(x) for x in ids], repaired, same

        return work

    return map_texts(df, make, "token_ids array<int>, n_tokens bigint, n_repaired bigint, round_trip boolean", id_col=id_col, text_col=text_col)


def decode(df: DataFrame, model: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id and text of rows of token ids; null ids give a null text."""
    raw = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def make():
        from plumbline.llm import pieces as own

        c = own.codec(raw.value, 1, False)
        return lambda _, __, ids: ([None if x is None else c.decode(x) for x in ids],)

    rows = df.select(F.col(id_col).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col(ids_col).alias("ids"))
    return map_texts(rows, make, "text string", extra=("ids",))
