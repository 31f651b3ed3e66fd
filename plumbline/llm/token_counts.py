"""Token counts: a byte-pair encoder's exact count at every prefix, by prefix dynamic programming.

Of each prefix of a pre-token exactly one last token is possible: the one whose neighbour - the
last token of what is left without it - stays apart from it when the two are encoded together. So
one pass over the prefixes finds, for each, its last token and with it the count of the prefix
before that token plus one. Counts of longer texts are sums over pre-tokens. What is stored answers
questions of truncation and budget without encoding again: the count of any prefix is looked up,
the longest prefix within a budget is searched for.

Texts are cut into chunks (white space and what follows up to the next) that are pre-tokenized on
their own, since no pre-token reaches from other characters into white space. Of each chunk the counts at all its prefixes are
stored and kept from one text to the next; a text's count is the sum of its chunks' last ones, and the longest prefix
within a limit is looked up in the chunk in which the limit is reached. One scan, no shuffle.

Defined results: null and empty texts have 0 tokens and 0 bytes; a null id is passed through;
repeated rows give repeated rows; other columns, whatever their names, are not read; an empty table gives an empty result; long texts, also without any
break, take time in proportion to their length; of prefixes with equally many tokens the longest is the one within a limit.
A special token's string in a text counts as one token, as is the library's default. A tokenizer with settings that are not counted here is refused.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from itertools import accumulate
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: White space as the pre-tokenizer's pattern has it.
WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WS}]*[^{WS}]+|[{WS}]+")
LEADING = re.compile(f"[{WS}]*")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each table that a worker keeps at most; beyond, it starts anew. Results don't depend on it.
KEEP = 500_000
#: Longer chunks' counts are made anew each time: few are found again.
LONG = 200


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for a byte-level BPE in the format of the tokenizers library."""

    def __init__(self, raw: bytes):
        import regex

        d = json.loads(raw)
        model, pre = d["model"], d["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or d["normalizer"] or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE without normalizer and prefix space is asked for")
        odd = [k for k in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [f"{k} of {x['content']}" for x in d["added_tokens"] for k in ("lstrip", "rstrip", "single_word") if x.get(k)]
        if odd:
            raise ValueError(f"settings that counts don't follow: {', '.join(odd)}")
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        special = [x["content"] for x in d["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        # Tokens by number: the single bytes, then what each merge makes, in the order of the merges.
        tokens = [bytes([k]) for k in range(256)]
        self.ids = {t: k for k, t in enumerate(tokens)}
        self.halves, self.joined = [(k, k) for k in range(256)], {}
        for m in model["merges"]:
            left, right = map(to_bytes, m if isinstance(m, list) else m.split(" "))
            pair = self.ids[left], self.ids[right]
            self.joined[pair] = self.ids[left + right] = len(self.halves)
            self.halves.append(pair)
            tokens.append(left + right)
        #: The lengths of tokens of three bytes or more, by their last three; the shorter ones always come into question.
        found: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > 2:
                found.setdefault(t[-3:], set()).add(len(t))
        self.lengths = {k: (*sorted(v, reverse=True), 2, 1) for k, v in found.items()}
        self.pre = regex.compile(PATTERN).findall
        self.apart: dict[int, bool] = {}
        #: The counts at all prefixes of a pre-token and of a chunk, by code points: bytes if they are small.
        self.pieces: dict[str, bytes | list[int]] = {}
        self.chunks: dict[str, bytes | list[int]] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether encoding token a's string followed by b's gives these two again.

        The merges of both are undone, latest first; if a pair that now meets at the border would have
        been merged before what was undone, encoding would have joined it."""
        joined, halves, most = self.joined, self.halves, 1 << 60
        while True:
            if joined.get((a, b), most) < most:
                return False
            right, left = halves[a][1], halves[b][0]
            if right == a and left == b:
                return True
            if left == b or (a > b and right != a):
                most, a = a, right
            else:
                most, b = b + 1, left

    def prefixes(self, word: bytes) -> list[int]:
        """The token counts of word[:0], word[:1], ... of a pre-token."""
        ids, lengths, apart, short = self.ids, self.lengths, self.apart, (2, 1)
        last, count = [-1], [0]
        for end in range(1, len(word) + 1):
            for n in lengths.get(word[end - 3 : end], short) if end > 2 else short[2 - end :]:
                if n <= end and (token := ids.get(word[end - n : end])) is not None:
                    if n < end:
                        key = last[end - n] << 20 | token
                        if (fits := apart.get(key)) is None:
                            if len(apart) > 2 * KEEP:
                                apart.clear()
                            fits = apart[key] = self.stays_apart(last[end - n], token)
                        if not fits:
                            continue
                    last.append(token)
                    count.append(count[end - n] + 1)
                    break
        return count

    def word(self, word: str) -> bytes | list[int]:
        """The counts of word[:0], word[:1], ... of a pre-token, by code points, stored."""
        if (table := self.pieces.get(word)) is None:
            raw = word.encode()
            table = self.prefixes(raw)
            if len(raw) > len(word):
                table = [c for c, b in zip(table, [*raw, 0], strict=True) if b & 0xC0 != 0x80]
            if len(word) < LONG:
                if len(self.pieces) > KEEP:
                    self.pieces.clear()
                table = self.pieces[word] = bytes(table) if table[-1] < 256 else table
        return table

    def piece(self, word: str) -> int:
        return self.word(word)[-1]

    def chunk(self, chunk: str) -> bytes | list[int]:
        """The counts of chunk[:0], chunk[:1], ...: by code points, stored."""
        if (table := self.chunks.get(chunk)) is None:
            table = self.chunk_prefixes(chunk)
            if len(chunk) < LONG:
                if len(self.chunks) > KEEP:
                    self.chunks.clear()
                table = self.chunks[chunk] = bytes(table) if isinstance(table, list) and table[-1] < 256 else table
        return table

    def count(self, chunk: str) -> int:
        return self.chunk(chunk)[-1]

    def chunk_prefixes(self, chunk: str) -> list[int]:
        words, blank = self.pre(chunk), LEADING.match(chunk).end()
        if len(words) == 1 and (not blank or chunk[0] == " " and blank == 1 or blank == len(chunk)) and (words[0][0] != "'" or len(chunk) > 3):
            return self.word(chunk)  # every part of it is one pre-token
        out = [*self.word(chunk[:blank])] if blank else [0]  # a text that ends in white space ends in one pre-token of it
        before = done = 0
        for word in words:
            counts = self.word(word)
            first = max(1, blank - done + 1)
            if word[0] != "'" or len(word) > 3:
                out += [before + x for x in counts[first:]]
            else:  # parts of a contraction may be two
                for k in range(first, len(word) + 1):
                    part = word[:k]
                    out.append(before + (counts[k] if self.pre(part) == [part] else sum(map(self.piece, self.pre(part)))))
            before, done = before + counts[-1], done + len(word)
        return out

    def segments(self, text: str):
        """(plain text, whether a special token follows)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], ""

    def parts(self, text: str) -> tuple[list[str], list[int]]:
        """The chunks and special tokens of a text, with their counts."""
        if not self.special or not self.special.search(text):
            chunks = CHUNK.findall(text)
            return chunks, list(map(self.count, chunks))
        chunks, counts = [], []
        for plain, special in self.segments(text):
            own = CHUNK.findall(plain)
            chunks += own + [special] * bool(special)
            counts += [*map(self.count, own), *[1] * bool(special)]
        return chunks, counts

    def table(self, text: str) -> list[int]:
        """The counts of text[:0], text[:1], ...: the last is that of the text."""
        out, base = [0], 0
        for plain, special in self.segments(text):
            chunks = CHUNK.findall(plain)
            for k, c in enumerate(chunks):
                out += [base + x for x in self.chunk(c)[1:]]
                if k + 1 < len(chunks) or not special:
                    base += self.count(c)
            if special:  # cut short, its string is plain text that goes on from the last chunk
                tail = chunks[-1] if chunks else ""
                cut = tail + special[:-1]
                for k in range(len(tail) + 1, len(cut) + 1):
                    out.append(base + sum(map(self.count, CHUNK.findall(cut[:k]))))
                base += (self.count(tail) if tail else 0) + 1
                out.append(base)
        return out

    def longest_within(self, text: str, chunks: list[str], sums: list[int], budget: int) -> int:
        """Code points of the longest prefix of at most budget tokens."""
        if not sums or sums[-1] <= budget:
            return len(text)
        k = bisect_right(sums, budget)  # the chunk in which the budget ends
        base, chars = (sums[k - 1] if k else 0), sum(map(len, chunks[:k]))
        if self.special and self.special.fullmatch(chunks[k]):
            table = self.table("".join(chunks[max(0, k - 1) : k + 1]))
            skip = len(chunks[k - 1]) if k else 0
            inner = [sums[k - 2] if k > 1 else 0 for _ in (0,)][0]
            return chars + max((j - skip for j in range(skip, len(table)) if inner + table[j] <= budget), default=0)
        inner = self.chunk(chunks[k])
        return chars + max(j for j, x in enumerate(inner) if base + x <= budget)


_READY: dict[int, PrefixCounter] = {}


def counter(raw: bytes) -> PrefixCounter:
    """One for each vocabulary and worker process, so that tables serve all of its tasks."""
    key = hash(raw)
    if key not in _READY:
        _READY[key] = PrefixCounter(raw)
    return _READY[key]


def token_counts(df: DataFrame, tokenizer: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit and fit_chars: the code points of the longest prefix within the limit."""
    raw = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def make():
        from plumbline.llm import token_counts as own  # the module's tables, not a copy in this closure

        c = own.counter(raw.value)

        def work(_, texts):
            n_bytes, n_tokens, fit = [], [], []
            for text in texts:
                chunks, counts = c.parts(text or "")
                total = sum(counts)
                n_bytes.append(len((text or "").encode()))
                n_tokens.append(total)
                fit.append(len(text or "") if total <= limit else c.longest_within(text, chunks, list(accumulate(counts)), limit))
            return n_bytes, n_tokens, [x > limit for x in n_tokens], fit

        return work

    return map_texts(df, make, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint", id_col=id_col, text_col=text_col)


def prefix_tables(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and counts: array of the token counts of all prefixes, by code points, from the empty one on."""
    raw = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def make():
        from plumbline.llm import token_counts as own

        c = own.counter(raw.value)
        return lambda _, texts: ([c.table(text or "") for text in texts],)

    return map_texts(df, make, "counts array<int>", id_col=id_col, text_col=text_col)


def tokens_of_prefix(counts: Column, n_chars: Column | int) -> Column:
    """The token count of the first n_chars code points, from a stored table."""
    return F.get(counts, F.least(F.lit(n_chars) if isinstance(n_chars, int) else n_chars, F.size(counts) - 1))


def longest_within(counts: Column, budget: int) -> Column:
    """The code points of the longest prefix of at most budget tokens, from a stored table."""
    return F.array_max(F.filter(F.transform(counts, lambda x, i: F.when(x <= budget, i)), lambda i: i.isNotNull()))
