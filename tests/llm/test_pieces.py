"""Encoding, spans and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from verdant.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.read_model(PATH))


def texts():
    rnd = random.Random(5)
    odd = ["", " ", "  ", "   ", "     a", "a  b   c    d     e      f", " x ", "\n", "\n\n a\t\tb\r\n", "a" * 3000, "ab" * 700, "x " * 2000,
           "▁", "▁▁ ▁x", "a▁b", "\x00", "a\x00b", "<s> </s> <unk> <0x41>", "日本語 テスト。これは長い文です", "🙂🙂 a🙂", "é ﬁ ①",
           "don't I'd", "١٢٣ 12345", "�﻿x", "   " * 50, "http://a.b/c?d=e&f", "ɐɐɐ\U0001F9FFɐ", "\x1c\x85\xa0　 z", "naïve façade " * 30]
    alphabet = [*"abcdefgheinrst   .,'\n-", "é", "ñ", "世", "界", "🙂", "▁", "ö", "\t", "ﷺ"]
    words = ["the", "and", "ing", "tion", " ", "  ", "re", "un", "\n", "er", "qu", "zz", "eau", "ß"]
    return (odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 300))) for _ in range(250)]
            + ["".join(rnd.choice(words) for _ in range(rnd.randrange(1, 200))) for _ in range(150)])


def test_ids_and_spans_equal_the_library(library, model):
    normalise, merge = pieces.Normaliser(model), pieces.Merger(model)
    assert merge.cut is not None
    for t in texts():
        want = library.encode(t, return_type="proto")
        ids, at = pieces.encode_texts(normalise, merge, [t])[0]
        assert ids.tolist() == [p.id for p in want.pieces], t
        if len(ids):
            assert list(zip(at[:-1].tolist(), at[1:].tolist())) == [(p.begin, p.end) for p in want.pieces], t


def test_whole_texts_merge_like_chunks(library, model):
    normalise, merge = pieces.Normaliser(model), pieces.Merger(model)
    merge.cut = None
    for t in texts():
        assert pieces.encode_texts(normalise, merge, [t])[0][0].tolist() == library.encode(t), t


def test_forgotten_chunks_are_merged_again(library, model, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_CHUNKS", 40)
    normalise, merge = pieces.Normaliser(model), pieces.Merger(model)
    for t in texts():
        assert pieces.encode_texts(normalise, merge, [t])[0][0].tolist() == library.encode(t)
    monkeypatch.setattr(pieces, "WIDTHS", (4, 5))
    merge = pieces.Merger(model)
    assert [i.tolist() for i, _ in pieces.encode_texts(normalise, merge, texts())] == [library.encode(t) for t in texts()]


def test_characters_without_a_piece_merge_all_the_same(model):
    """A piece may link characters that are none; alone they fall back to bytes."""
    small = pieces.Model(pieces.read_model(PATH))
    small.pieces, small.scores, small.kinds = ["<unk>", "ab", "abc", "c"], [0.0, -1.0, -2.0, -3.0], [2, 1, 1, 1]
    small.unknown, small.byte_fallback = 0, False
    merge = pieces.Merger(small)
    got = [e.tolist() for e in merge(["ababcxacab", "", "abd", "c"])]
    entry = lambda i, n: i | n << pieces._ID_BITS
    assert got == [[entry(1, 2), entry(2, 3), entry(0, 2), entry(3, 1), entry(1, 2)], [], [entry(1, 2), entry(0, 1)], [entry(3, 1)]]
    small.kinds = [2, 1, 5, 1]                                   # an unused piece falls apart again
    merge = pieces.Merger(small)
    assert [e.tolist() for e in merge(["ababc"])] == [[entry(1, 2), entry(1, 2), entry(3, 1)]]


def test_decoding_equals_the_library(library, model):
    decode = pieces.Decoder(model)
    for t in texts():
        ids = library.encode(t)
        assert decode(np.array(ids, np.int64)) == library.decode(ids), t
    rnd = random.Random(2)
    pool = [*range(0, 262), 28705, 264, 6312, *(rnd.randrange(262, 32000) for _ in range(60))]
    for _ in range(2000):
        ids = [rnd.choice(pool) for _ in range(rnd.randrange(1, 12))]
        assert decode(np.array(ids, np.int64)) == library.decode(ids), ids
    with pytest.raises(ValueError):
        decode(np.array([32000]))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("trim", [False, True])
def test_character_map_equals_the_library(model, rule, trim):
    """Longest-prefix normalisation and its alignment with the maps the library compiles."""
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=trim)
    spec = dict(pieces._fields(dict(pieces._fields(own.serialized_model_proto()))[3]))
    other = pieces.Model(pieces.read_model(PATH))
    other.char_map, other.trim = spec.get(2, b""), trim
    assert bool(other.char_map) == (rule != "identity")
    normalise = pieces.Normaliser(other)
    more = ["Ａｂｃ　ﬃ ㍿ ½", "Àẹ́ ö", "한글 한 ｶﾞ", "  ＡＢ   ﷺ  ", "­​ x‍", "ǅ İ ſ Straße"]
    for t in more + texts():
        flat, align = normalise(t)
        want, offsets = own.normalize(t, with_offsets=True)
        assert flat == want, t
        if want:                                # of texts trimmed away the library keeps no place
            raw = t.encode()
            assert [len(raw[:a].decode()) for a in align.tolist()][:len(offsets)] == offsets, t


def test_tables(spark, library):
    rows = list(enumerate(texts()[:120])) + [(900, None), (901, "twice  "), (901, "twice  "), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wide = pieces.encode(df.withColumn("ids", df.doc_id).withColumn("SPANS", df.text), PATH)
    assert wide.columns == ["doc_id", "ids", "SPANS", "ids_", "spans_"]
    for r in wide.collect():
        raw = (r.SPANS or "").encode()
        assert b"".join(raw[s.begin:s.end] for s in r.spans_) == raw and len(r.spans_) == len(r.ids_)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.covered_bytes) for r in pieces.digest(df, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in rows:
        ids = library.encode(t or "")
        assert (i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), len((t or "").encode())) in got, t
    assert pieces.digest(df, PATH).count() == len(rows) and pieces.digest(df.limit(0), PATH).count() == 0


def test_one_python_pass_encodes_and_decodes(spark):
    df = spark.createDataFrame([(1, "one  pass")], "doc_id bigint, text string")
    assert pieces.digest(df, PATH)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    enc = pieces.encode(df, PATH, ids_col="decoded", decoded_col="decoded")
    back = pieces.decode(enc, PATH, ids_col="decoded", out_col="again").first()
    assert enc.columns == ["doc_id", "decoded", "spans", "decoded_"] and back["decoded_"] == back["again"]
