import base64
import random
import zlib

import numpy as np
import pytest

from plumbline.llm.token_output import Feistel, Reader, TokenOutput

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
END = 50256


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def made(df, **options):
    return TokenOutput(df, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, end=END, **options)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_feistel_is_a_permutation(n):
    for key in (0, 7):
        f = Feistel(n, key)
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert f.sequences(slots).tolist() == list(range(n))
    if n > 64:
        assert Feistel(n, 0).slots(np.arange(n)).tolist() != Feistel(n, 7).slots(np.arange(n)).tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def test_stream_comes_back(docs, rows):
    t = made(docs, length=32, per_shard=50, key=3)
    got = t.sequences().collect()
    assert sorted(r.slot for r in got) == list(range(t.n_sequences))
    assert all(len(r.tokens) == 64 and r.shard == r.slot // 50 for r in got)
    stream = np.frombuffer(b"".join(bytes(r.tokens) for r in sorted(got, key=lambda r: r.sequence)), dtype="<u2").tolist()
    encode = encoder()
    texts = {k: t for k, t, *_ in rows}
    order = [x for r in sorted(got, key=lambda r: r.sequence) for x in r.doc_ids]
    docs_in_order = [x for k, x in enumerate(order) if k == 0 or x != order[k - 1]]
    # Row 3 is twice in the table, perhaps side by side.
    want = [x for d in docs_in_order for x in [*encode(texts[d]), END]]
    if len(want) != len(stream[: t.n_tokens]):
        want = [x for d in docs_in_order for x in [*encode(texts[d]), END] * (1 + (d == 3))]
    assert stream[: t.n_tokens] == want
    assert set(stream[t.n_tokens :]) <= {END}
    assert t.n_tokens == sum(len(encode(x)) + 1 for _, x, *_ in rows if x)


def test_written_and_read(spark, docs, tmp_path):
    t = made(docs, length=16, per_shard=64)
    want = {r.slot: bytes(r.tokens) for r in t.sequences().collect()}
    path = f"file://{tmp_path}/out"
    t.write(path)
    files = sorted((tmp_path / "out/shards").glob("part-*"))
    assert len(files) == t.n_shards > 2
    r = random.Random(1)
    reader = Reader(spark, path)
    for slot in r.sample(sorted(want), 20):
        shard, at = reader.locate(slot)
        assert files[shard].read_bytes()[at : at + t.stride] == want[slot] + b"\n"
    assert files[0].stat().st_size == 64 * t.stride
    for first, n in ((0, 3), (60, 10), (t.n_sequences - 2, 99), (t.n_sequences, 5), (5, 0)):
        got = {x.slot: bytes(x.tokens) for x in reader.read(first, n).collect()}
        assert got == {s: want[s] for s in range(first, min(first + n, t.n_sequences))}


def test_empty(spark, empty):
    assert made(empty).sequences().collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert made(none).sequences().collect() == []
    one = spark.createDataFrame([(None, "a", 1)], "doc_id bigint, text string, slot int")
    assert [(r.slot, r.doc_ids) for r in made(one).sequences().collect()] == [(0, [None])]


def test_query_writes_shards_and_reads_them(spark, docs, rows, tmp_path, monkeypatch):
    from plumbline.llm.queries import op2_token_output

    wrote, read = [], []
    write, records = TokenOutput.write, Reader.records
    monkeypatch.setattr(TokenOutput, "write", lambda self, path: (wrote.append(path), write(self, path))[1])
    monkeypatch.setattr(Reader, "records", lambda self, *of: (read.append(self.path), records(self, *of))[1])
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = op2_token_output(spark, f"file://{tmp_path}").collect()
    assert len(wrote) == 1 and read == wrote
    want = made(spark.read.parquet(f"file://{tmp_path}/documents.parquet")).sequences().collect()
    assert sorted((r.slot, r.shard, r.sequence, r.n_docs, r.tokens_crc32) for r in got) == sorted((r.slot, r.shard, r.sequence, len(r.doc_ids), zlib.crc32(bytes(r.tokens))) for r in want)
    assert sorted(x or 0 for r in got for x in r.doc_ids) == sorted(x or 0 for r in want for x in r.doc_ids)


def test_all_records_of_many_shards(spark, docs, tmp_path):
    t = made(docs, length=16, per_shard=64)
    t.write(f"file://{tmp_path}/out")
    want = t.sequences().collect()
    assert {r.slot: bytes(r.tokens) for r in Reader(spark, f"file://{tmp_path}/out").records().collect()} == {r.slot: bytes(r.tokens) for r in want}
    bare = t.sequences(tokens=False).collect()
    assert sorted((r.slot, r.shard, r.sequence, r.doc_ids, r.tokens) for r in bare) == sorted((r.slot, r.shard, r.sequence, r.doc_ids, None) for r in want)


def test_query_of_nothing(spark, empty, tmp_path):
    from plumbline.llm.queries import op2_token_output

    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert op2_token_output(spark, f"file://{tmp_path}").collect() == []


LONG = {
    "line feeds": "a" + "\n" * 10**6,
    "spaces": " " * 10**7 + "end",
    "letters": "ab" * 500_000,
    "digits": "7" * 10**6,
    "signs": "x " + "!" * 10**6,
    "mixed": "a \t" * 100 + "\u2003" * 200_000 + "\nb" + " " * 5000,
}


@pytest.mark.parametrize("name", LONG)
def test_long_runs(name):
    """No text is too much for the library; ids are those of its bytes, and of the library where it takes the text."""
    from plumbline.llm.token_output import ranks

    ranked = ranks(open(public.path("byte_bpe_50k.tiktoken"), "rb").read(), public.PATTERN)
    ids = ranked.encode(LONG[name])
    core = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    assert core.decode(ids.tolist()) == LONG[name]


def test_runs_are_cut_as_the_library_cuts_them():
    from plumbline.llm.token_output import ranks

    ranked, encode = ranks(open(public.path("byte_bpe_50k.tiktoken"), "rb").read(), public.PATTERN), encoder()
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choice((r.choice(" \n\t\x1c\xa0\u2003") * r.choice((1, 2, 999, 1000, 1001, 2500)), " " * 1000 + "\n", "word", "don't", "7", "?!", "\u00e9")) for _ in range(r.randint(1, 12)))
        assert ranked.encode(text).tolist() == encode(text)


def test_text_ids(spark):
    df = spark.createDataFrame([("x", "one two"), (None, "three"), ("y", None)], "doc_id string, text string")
    got = made(df, length=2).sequences().collect()
    assert sorted({x or "" for r in got for x in r.doc_ids}) == ["", "x"]
