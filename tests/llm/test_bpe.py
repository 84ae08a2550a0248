"""Merge replay against the tiktoken library, and an exact round trip."""

import hashlib
import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from verdant.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rnd = random.Random(7)
    odd = ["", " ", "\n\n", "a" * 5000, "x " * 3000, "  two  spaces\t\ttabs ", "\x1c\x1d \x1e a\x85b  c　d", "日本語 テスト '''s 's",
           "é" * 40, "12345678901234567890 ١٢٣", "🙂🙂🙂 a🙂", "<|endoftext|>", "don't we'll I'd THEY'RE"]
    alphabet = [*"abcdefghijtheringn  .,'\n", "é", "ñ", "世", "🙂", " "]
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 400))) for _ in range(200)]


def test_matches_library_and_round_trips(spark, reference):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (901, "same text"), (901, "same text"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    ids = bpe.encode(df.withColumn("ids_", df.doc_id), PATH, public_tokenizers.PATTERN)
    assert ids.columns == ["doc_id", "ids_", "ids"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in ids.collect())
    want = sorted((i if i is not None else -1, reference.encode_ordinary(t or "")) for i, t in rows)
    assert got == want
    out = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in
           bpe.digest(df, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in rows:
        e = reference.encode_ordinary(t or "")
        assert (i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(),
                hashlib.sha256((t or "").encode()).hexdigest()) in out


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digest(df, PATH, public_tokenizers.PATTERN).collect() == []


def test_encoder_keeps_pieces_between_stretches(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    enc = bpe.Encoder(bpe.MergeReplay(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)
    all_texts = texts()
    got = [x for k in range(0, len(all_texts), 9) for x in enc(all_texts[k:k + 9]).to_pylist()]
    assert got == [reference.encode_ordinary(t) for t in all_texts]


def test_ranks_that_open_earlier_ones():
    """A merge may make a pair of an earlier rank possible."""
    ranks = {bytes([i]): i for i in range(256)} | {b"bcb": 256, b"bc": 257, b"aa": 258, b"aab": 259, b"baab": 260, b"ab": 261}
    lib = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(4)
    words = ["bcbc", "bcbcb", "bbccbcbc"] + ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    ids, counts = bpe.MergeReplay(ranks).encode([w.encode() for w in words])
    at = 0
    for w, n in zip(words, counts.tolist()):
        assert ids[at:at + n].tolist() == lib.encode_ordinary(w), w
        at += n
    assert lib.encode_ordinary("bcbc") == [256, 99]
    with pytest.raises(ValueError):
        bpe.MergeReplay(ranks | {b"zz": 1 << 17})


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id bigint, text string, ids string, decoded string")
    out = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, ids_col="ids_")
    assert out.columns == ["doc_id", "ids", "decoded", "ids_", "decoded_"] and bytes(out.first().decoded_) == b"a b"


def test_one_python_pass_encodes_and_decodes(spark):
    df = spark.createDataFrame([(1, "one pass")], "doc_id bigint, text string")
    out = bpe.digest(df, PATH, public_tokenizers.PATTERN)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    enc = bpe.encode(df.withColumn("decoded", df.doc_id), PATH, public_tokenizers.PATTERN, decoded_col="decoded")
    assert enc.columns == ["doc_id", "decoded", "ids", "decoded_"] and bytes(enc.first()["decoded_"]) == b"one pass"


def most_memory(work):
    """What ``work`` gives, and the most bytes it held at a time."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_stretch(reference):
    replay = bpe.MergeReplay(bpe.read_ranks(PATH))
    rnd = random.Random(3)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(12)) for _ in range(20_000)]
    raw = [w.encode() for w in words]
    (ids, counts), most = most_memory(lambda: replay.encode(raw))
    assert most < 64 * sum(map(len, raw))                 # five arrays of positions and what a merge looks up; it was 95
    assert ids.tolist() == [i for w in words for i in reference.encode_ordinary(w)] and counts.sum() == len(ids)


def test_pieces_met_again_are_kept(reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 100)
    enc = bpe.Encoder(bpe.MergeReplay(bpe.read_ranks(PATH)), public_tokenizers.PATTERN)
    for k in range(8):
        texts = [f"often and always q{k * 60 + i}" for i in range(60)]
        assert enc(texts).to_pylist() == [reference.encode_ordinary(t) for t in texts]
        assert len(enc.begins) == len(enc.spaced) + len(enc.bare) == len(enc.uses) <= 100 + 63
        if k:
            assert enc.begins[enc.spaced["always"]] <= 10      # not encoded anew


def test_vocabulary():
    words = bpe.Vocabulary({b"a": 3, b"bc": 0, b"\xff": 7})
    lists = pa.array([[9], [3, 0, 7], None, [], [0]], pa.list_(pa.int32()))
    assert words(lists.slice(1)).to_pylist() == [b"abc\xff", b"", b"", b"bc"]
    assert words(lists.slice(2, 2)).to_pylist() == [b"", b""] and words(lists.slice(0, 0)).to_pylist() == []
    for bad in (9, 5, -1, None):
        with pytest.raises(KeyError):
            words(pa.array([[3, bad]], pa.list_(pa.int64())))
