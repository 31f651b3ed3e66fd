"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two models of characters given the two before them, one of random strings and one of ordinary identifiers, are
trained from labelled samples. Along a run of key characters the log-likelihood ratios of its characters are
summed up; a stretch whose sum and mean are over thresholds is a span of kind ``markov``. The sum grows with the length, so that a
short stretch has to be far more like a random string than a long one. Spans of the patterns stay as they are; the parts of a
run beside them are scored on their own.

Least length, order and thresholds were chosen on held-out samples, which have no word in common with those of the training
(``labelled_samples(held_out=True)``); README has the figures. Digits alone are not found: ordinary numbers look the same.

Each text is scanned whole and on its own: one scan, no shuffle, no state between rows. A text of any length, also one without
any break, takes time in proportion to its length.

Defined results: null and empty texts have no spans; a null id is passed through; repeated rows
give repeated rows; other columns, whatever their names, are not read; an empty table gives an empty result. Of two stretches
that could be one, the first with the greatest sum is a span; spans that begin together are in the order of KINDS.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters that the models look at before the next; characters at least of a run and of a stretch in it.
ORDER, LEAST, CORE = 2, 12, 8
#: Sum and mean of the log-likelihood ratios of a span; the sum if it has the look of a word (letters of one case, the first aside), as most
#: stretches of a text have.
THRESHOLD, MEAN, WORD_THRESHOLD = 14.0, 0.5, 30.0
#: Keys of kind access and hex, and candidates of the models, lie in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
INDEX = {c: k for k, c in enumerate(ALPHABET)}
SIZE = len(ALPHABET) + 1  # the last is before the start of a string
#: Frequent words of the languages other than English, which the library's names don't have.
PARTS = (
    "und der die das nicht mit auf eine einen wird sich auch nach werden durch zwischen verwaltung einstellung gesellschaft verbindung entwicklung bezeichnung geschwindigkeit sicherheit moeglich schluessel zeichen "
    "les des pour dans avec sur que une est sont mais leur cette entre depuis toujours developpement gouvernement administration utilisateur utilisation fonctionnement notamment environnement heureux toutefois "
    "los las para con por una como pero sobre entre desde hasta cuando tambien siempre usuario configuracion informacion desarrollo administracion funcionamiento rapidamente conocimiento ciudades pasado"
).split()
#: Modules whose names are samples of ordinary identifiers.
MODULES = "argparse ast asyncio calendar codecs collections configparser csv datetime decimal difflib email errno ftplib http.client imaplib inspect io json locale logging mimetypes os pathlib pickle platform re shutil signal smtplib socket sqlite3 ssl stat statistics string subprocess tarfile tempfile threading token typing unittest urllib.parse urllib.request uuid xml.dom zipfile".split()


@cache
def ordinary_words() -> tuple[str, ...]:
    """Words in lower case: parts of the names in the standard library, of its help texts, and PARTS."""
    import importlib

    from pydoc_data.topics import topics

    names: set[str] = set()
    for module in map(importlib.import_module, MODULES):
        for name in dir(module):
            names.add(name)
            names.update(dir(getattr(module, name)) if isinstance(getattr(module, name, None), type) else ())
    words = {w.lower() for n in names for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n)} | set(re.findall(r"[a-z]+", " ".join(topics.values()).lower())) | set(PARTS)
    return tuple(sorted(w for w in words if len(w) > 1))


def held_out_word(word: str) -> bool:
    return zlib.crc32(word.encode()) % 4 == 0


def _random_string(r: random.Random) -> str:
    lower, upper, digits, base62 = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62], ALPHABET[:62]
    letters = r.choice((digits + "abcdef", digits + "ABCDEF", upper + "234567", lower + digits, upper + digits, lower, upper, ALPHABET[:52], base62, base62, base62 + "+/", base62 + "_-", digits))
    return "".join(r.choices(letters, k=r.randint(LEAST, 64)))


def _ordinary_name(r: random.Random, words: list[str]) -> str:
    parts = r.choices(words, k=r.randint(1, 7))
    for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
        number = r.choice((r.randint(0, 99), r.randint(1900, 2030), r.randint(100, 99999), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"v{r.randint(0, 9)}", r.randint(10**6, 10**12)))
        parts.insert(r.randrange(len(parts) + 1), str(number))
    shape = r.randrange(8)
    if shape < 4:
        return "_-/"[shape].join(parts) if shape < 3 else "".join(parts)
    if shape == 4:
        return "".join(p.capitalize() for p in parts)
    if shape == 5:
        return parts[0] + "".join(p.capitalize() for p in parts[1:])
    return ("_" if shape == 6 else "").join(parts).upper()


def labelled_samples(n: int = 20_000, seed: int = 17, held_out: bool = False) -> list[tuple[str, bool]]:
    """n random strings (True) and n ordinary identifiers (False), the same for the same seed; held-out ones share no word with the others."""
    r = random.Random(f"{seed} {held_out}")
    words = [w for w in ordinary_words() if held_out_word(w) == held_out]
    return [x for _ in range(n) for x in ((_random_string(r), True), (_ordinary_name(r, words), False))]


def _probabilities(samples: list[str], order: int) -> np.ndarray:
    """Log-probabilities of a character (last axis) by the two before it; each order is smoothed by the one below."""
    length = len(ALPHABET)
    ids = [[length, length, *(INDEX[c] for c in s if c in INDEX)] for s in samples]
    flat = np.array([x for s in ids for x in zip(s, s[1:], s[2:], strict=False)], dtype=np.int64).reshape(-1, 3)
    p = np.full((SIZE, SIZE, length), 1 / length)
    for k in range(order + 1):
        seen = flat.copy()
        seen[:, : 2 - k] = 0  # what this order doesn't look at
        counts = np.zeros((SIZE, SIZE, length))
        np.add.at(counts, tuple(seen.T), 1)
        view = counts if k == 2 else counts[:1] if k == 1 else counts[:1, :1]
        kinds = (view > 0).sum(axis=2, keepdims=True) + 1
        p = np.broadcast_to((view + kinds * p) / (view.sum(axis=2, keepdims=True) + kinds), p.shape)
    return np.log(p)


class MarkovModels:
    """Log-likelihood ratios of characters given the two before them, random against ordinary."""

    def __init__(self, samples: Iterable[tuple[str, bool]], *, threshold: float = THRESHOLD, mean: float = MEAN, word_threshold: float = WORD_THRESHOLD, order: int = ORDER):
        samples = list(samples)
        random_, plain = (_probabilities([t for t, label in samples if bool(label) is kind], order) for kind in (True, False))
        self.threshold, self.mean, self.word_threshold = threshold, mean, word_threshold
        #: For each two characters, by number, a list of ratios.
        self.ratio = (random_ - plain).reshape(SIZE * SIZE, -1).tolist()

    def spans(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, sum) of the stretches of a run that the models take for random, apart and in order.

        A sum that falls to nothing begins anew with the next character; one that falls by the threshold below its greatest ends there."""
        out, ratio, threshold = [], self.ratio, self.threshold
        at, n, ids = 0, len(text), [INDEX[c] for c in text]
        while at < n:
            context, total, start, peak, end = SIZE * SIZE - 1, 0.0, at, 0.0, at
            if at:
                context = (ids[at - 2] if at > 1 else SIZE - 1) * SIZE + ids[at - 1]
            k = at
            while k < n:
                c = ids[k]
                total += ratio[context][c]
                context = context % SIZE * SIZE + c
                k += 1
                if total > peak:
                    peak, end = total, k
                elif total <= 0 or total < peak - threshold:
                    break
            if peak > threshold:
                found = text[start:end]
                word = found.isalpha() and (found[1:].islower() or found.isupper())
                if end - start >= CORE and peak > max(self.mean * (end - start), self.word_threshold if word else 0):
                    out.append((start, end, peak))
                at = end
            else:
                at = k
        return out


def find(text: str, models: MarkovModels) -> list[tuple[int, int, int, float]]:
    """(start, number of the kind, end, score) of all spans of a text, in order."""
    spans = []
    lower = text.lower()
    if any(x in lower for x in NAMED) or not lower.isascii():
        spans += [(m.start(), 0, m.end(), math.inf) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = []
    for run in RUN.finditer(text):
        at, s = run.span()[0], run[0]
        if "AKIA" in s:
            spans += [(at + m.start(), 1, at + m.end(), math.inf) for m in ACCESS.finditer(s) if len(m[0]) >= 20]
        spans += [(at + m.start(), 2, at + m.end(), math.inf) for m in HEX.finditer(s)]
        runs.append((at, at + len(s)))
    base, k = sorted((a, b) for a, _, b, _ in spans), 0
    for at, stop in runs:
        # What base spans, in order, leave of the run.
        while k < len(base) and base[k][1] <= at:
            k += 1
        j = k
        while at < stop:
            while j < len(base) and base[j][1] <= at:
                j += 1
            end = min(stop, max(at, base[j][0])) if j < len(base) else stop
            if end - at >= LEAST:
                spans += [(at + a, 3, at + b, score) for a, b, score in models.spans(text[at:end])]
            at = max(end, min(stop, base[j][1])) if j < len(base) else stop
    return sorted(spans)


def scan(df: DataFrame, *, samples: Iterable[tuple[str, bool]] | None = None, max_samples: int = 100_000, threshold: float = THRESHOLD, mean: float = MEAN, word_threshold: float = WORD_THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans: array of (kind, start, end, score), code points, end exclusive, in order of start and kind.

    ``samples``: labelled strings for the models, of which max_samples at most are used;
    labelled_samples() by default."""
    from itertools import islice

    models = df.sparkSession.sparkContext.broadcast(MarkovModels(islice(samples if samples is not None else labelled_samples(), max_samples), threshold=threshold, mean=mean, word_threshold=word_threshold))

    def make():
        own = models.value

        def work(_, texts):
            return ([[{"kind": KINDS[k], "start": a, "end": b, "score": None if score == math.inf else score} for a, k, b, score in find(text or "", own)] for text in texts],)

        return work

    return map_texts(df, make, "spans array<struct<kind string, start bigint, end bigint, score double>>", id_col=id_col, text_col=text_col)
