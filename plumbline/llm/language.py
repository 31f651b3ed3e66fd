"""Language identification with string kernels: which n-grams of characters two texts have in common.

The kernel of two texts is the number of n-grams of 1 to ``longest`` characters that occur in both, however
often, over the geometric mean of how many each has (blended spectrum, presence). Letters count in lower case; everything
between letters is one space. Nyström: the kernel is spanned by landmarks, a part of the training texts. On their
coordinates one ridge regression for each language is solved, that language against the rest. As the
kernel is a product of presence vectors, landmarks and weights fold into one matrix, and a batch of
texts is scored by a product with it.

The model is fitted on the driver on a bounded sample: at most ``per_lang`` texts of each language, of the ``most_langs``
most frequent languages, at most ``sample_chars`` characters in all; which ones, a hash of the id decides.
Languages take texts in turn; a text that would go beyond the characters is skipped. Every text is then scored as a whole, in one scan without a shuffle.

Defined results: a null text and one without a letter are ``und`` with score 0, and so is every text if nothing could be
learned; null ids take no part in training and are passed through, as not held out; a null language is never
learned from; repeated rows give repeated rows; of several texts of one id and language the longest is learned from; other columns, whatever
their names, are not read; an empty table gives an empty result. Long texts are scored whole. Of languages with equal scores the first by name is
predicted. All letters of the training texts, of any script, are told apart; others count as one letter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

PER_LANG, MOST_LANGS, SAMPLE_CHARS = 300, 64, 40_000_000
LANDMARKS, RIDGE, LONGEST = 300, 0.1, 3
#: Numbers of n-grams up to which a table of all of them is made; beyond, those of the landmarks are searched by bisection.
DENSE = 1 << 21
#: Characters of texts worked on at a time.
SHARD_CHARS = 1 << 20
UNKNOWN = "und"


class Codes:
    """Characters as small numbers: 0 for what is no letter, 1 for letters that the training texts don't have."""

    def __init__(self, texts: list[str]):
        seen: Counter[str] = Counter()
        for text in texts:
            seen.update(text)
        common: Counter[str] = Counter()
        for c, n in seen.items():
            if c.isalpha():
                common[c.lower()[0]] += n
        self.letters = [c for c, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))]
        self.base = len(self.letters) + 2
        number = {c: k + 2 for k, c in enumerate(self.letters)}
        self.table = np.array([number.get(chr(k).lower()[0], 1) if chr(k).isalpha() else 0 for k in range(0x110000)], dtype=np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts, each between two spaces, runs of spaces as one; and each code's text."""
        points = np.frombuffer(" ".join([f"{t} " for t in texts]).encode("utf-32-le", "replace"), dtype=np.uint32)
        text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
        codes = np.append(np.int64(0), self.table[points])[: len(text)]
        # A text's first space stays beside the last one of the text before: two spaces are in no n-gram.
        keep = np.append(True, (codes[1:] != 0) | (codes[:-1] != 0) | (text[1:] != text[:-1]))
        return codes[keep], text[keep]

    def grams(self, codes: np.ndarray, longest: int):
        """For n = 1, 2, ...: the number of the n-gram that begins at each place."""
        whole = codes
        for n in range(1, longest + 1):
            yield whole
            if n < longest:
                whole = whole[:-1] * self.base + codes[n:]


class Model:
    """Fitted on (text, language); score() gives the weights of all languages for each text."""

    def __init__(self, texts: list[str], langs: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE, longest: int = LONGEST):
        self.langs, self.longest = sorted(set(langs)), longest
        if not self.langs:
            return
        self.codes = Codes(texts)
        # Landmarks: the first of each language in turn.
        order: dict[str, list[int]] = {}
        for k, lang in enumerate(langs):
            order.setdefault(lang, []).append(k)
        turns = sorted((place, lang, k) for lang, own in order.items() for place, k in enumerate(own))
        chosen = [k for *_, k in turns[:landmarks]]
        codes, _ = self.codes.of([texts[k] for k in chosen])
        self.tables, size = [], 0
        for n, grams in enumerate(self.codes.grams(codes, longest), 1):
            own = np.unique(grams)
            own = own[~self._spaces(own, n)]
            if self.codes.base**n <= DENSE:
                table = np.zeros(self.codes.base**n, dtype=np.int32)
                table[own] = np.arange(size + 1, size + 1 + len(own))
                self.tables.append((table, None, 0))
            else:
                self.tables.append((None, own, size + 1))
            size += len(own)
        self.size = size
        marks = self._unit(self.presence([texts[k] for k in chosen]))
        between = (marks @ marks.T).astype(np.float64)
        values, vectors = np.linalg.eigh(between)
        good = values > 1e-6 * values[-1]
        whiten = vectors[:, good] / np.sqrt(values[good])
        rows = np.concatenate([self._unit(self.presence(texts[k : k + 200])) @ marks.T for k in range(0, len(texts), 200)]) @ whiten
        rows = np.column_stack([rows, np.ones(len(rows))])
        target = np.array([[1.0 if x == y else -1.0 for y in self.langs] for x in langs])
        # Languages weigh the same, however many texts they have.
        weight = np.array([1 / langs.count(x) for x in langs]) * len(langs) / len(self.langs)
        left = (rows * weight[:, None]).T
        solved = np.linalg.solve(left @ rows + ridge * np.eye(rows.shape[1]), left @ target)
        self.weights, self.bias = (marks.T @ (whiten @ solved[:-1])).astype(np.float32), solved[-1]

    def _spaces(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Which n-grams have two spaces side by side."""
        digits = [grams // self.codes.base**k % self.codes.base for k in range(n)]
        out = np.zeros(len(grams), dtype=bool)
        for a, b in zip(digits, digits[1:], strict=False):
            out |= (a == 0) & (b == 0)
        return out

    @staticmethod
    def _columns(table: tuple, grams: np.ndarray) -> np.ndarray:
        """The columns of n-grams; 0 for those of no landmark."""
        dense, own, first = table
        if dense is not None:
            return dense[grams]
        at = np.minimum(np.searchsorted(own, grams), max(len(own) - 1, 0))
        return np.where(own[at] == grams, at + first, 0) if len(own) else np.zeros(len(grams), dtype=np.int64)

    def presence(self, texts: list[str]) -> np.ndarray:
        """A row for each text: 1 for each of the landmarks' n-grams that it has."""
        # Column 0 is for the n-grams of no landmark.
        out = np.zeros((len(texts), self.size + 1), dtype=np.float32)
        flat = out.ravel()
        codes, text = self.codes.of(texts)
        base = text * (self.size + 1)
        for n, (grams, table) in enumerate(zip(self.codes.grams(codes, self.longest), self.tables, strict=True)):
            flat[base[: len(base) - n] + self._columns(table, grams)] = 1
        return out[:, 1:]

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))

    def score(self, texts: list[str]) -> np.ndarray:
        out = []
        for some in _shards(texts):
            rows = self.presence(some)
            out.append((rows @ self.weights) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1)) + self.bias)
        return np.concatenate(out) if out else np.empty((0, len(self.langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [k for k, t in enumerate(texts) if self.langs and t and any(map(str.isalpha, t))]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            raw = np.clip((self.score([texts[k] for k in known]) + 1) / 2, 1e-6, 1)
            best = raw.argmax(axis=1)
            for k, b, p in zip(known, best, raw.max(axis=1) / raw.sum(axis=1), strict=True):
                langs[k], scores[k] = self.langs[b], float(p)
        return langs, scores


def _shards(texts: list[str], size: int = SHARD_CHARS, most: int = 128):
    first = held = 0
    for k, text in enumerate(texts):
        if k > first and (held + len(text) > size or k - first >= most):
            yield texts[first:k]
            first, held = k, 0
        held += len(text)
    if texts:
        yield texts[first:]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(df: DataFrame, *, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(text, language) of the bounded sample that the model is fitted on; no held-out row is in it."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return []
    scale = 1 << 30
    at = F.pmod(F.xxhash64("doc_id"), F.lit(scale))
    share = F.lit(None).cast("long")
    for r in counts:
        # So many that per_lang are found, but for a chance of 1e-9 or so.
        share = F.when(F.col("lang") == r.lang, math.ceil(min(1, (per_lang + 6 * math.sqrt(per_lang)) / r.n) * scale)).otherwise(share)
    found = sorted(rows.withColumn("at", at).where(F.col("at") < share).groupBy("lang", "at", "doc_id").agg(F.max(F.length("text")).alias("chars")).collect(), key=lambda r: (r["at"], r.doc_id, r.lang))
    kept, taken = [], Counter()
    for r in found:
        if taken[r.lang] < per_lang:
            taken[r.lang] += 1
            kept.append(r)
    fits = in_turn([(r.lang, r.chars) for r in kept], sample_chars) or [min(range(len(kept)), key=lambda k: kept[k].chars)] * bool(kept)
    ids = sorted({kept[k].doc_id for k in fits})
    longest = F.max_by("text", F.struct(F.length("text"), F.xxhash64("text"), F.col("text"))).alias("text")
    texts = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(longest).collect()
    return sorted(((r.text, r.lang) for r in texts), key=lambda x: (x[1], hash_of(x[0])))


def in_turn(found: list[tuple[str, int]], most: int) -> list[int]:
    """Places of the (language, characters) that are taken: the next of each language in turn, a text that doesn't fit is skipped."""
    place: Counter[str] = Counter()
    turns = []
    for k, (lang, _) in enumerate(found):
        turns.append((place[lang], lang, k))
        place[lang] += 1
    out, total = [], 0
    for *_, k in sorted(turns):
        if total + found[k][1] <= most:
            total += found[k][1]
            out.append(k)
    return sorted(out)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def predict(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(_, texts):
            langs, scores = shared.value.predict(texts)
            return langs, scores

        return work

    return map_texts(df, make, "lang_pred string, score double", id_col=id_col, text_col=text_col)


def identify(df: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score: fitted on the rows that aren't held out, applied to all."""
    sample = training_sample(df, **options)
    found = predict(df, Model([t for t, _ in sample], [x for _, x in sample]), **{k: options[k] for k in ("id_col", "text_col") if k in options})
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
