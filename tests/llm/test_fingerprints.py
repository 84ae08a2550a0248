"""Fingerprints against true shingle similarity, and the edited texts against Python."""

import hashlib
import random

from verdant.llm import fingerprints as FP


def shingles(text, width=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for sep in "\t\n\x0b\x0c\r":
        w = w.replace(sep, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rnd = random.Random(3)
    voc = [f"w{i}" for i in range(900)] + ["é", "世界", "Word", "wOrd"]
    docs = [" ".join(rnd.choices(voc, k=rnd.choice([0, 1, 3, 4, 5, 30, 300, 2500]))) for _ in range(120)]
    docs += [docs[7]] * 5 + ["", "\n \t", "Ab cD", "aB Cd"]
    rnd.shuffle(docs)
    return docs


def test_edits_and_likeness(spark):
    docs = corpus()
    rows = [(10 * i - 50, t) for i, t in enumerate(docs)]
    rows[4] = (rows[4][0], None)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, bucket string").repartition(5)
    got = {r.doc_id: r for r in FP.compare_with_edits(df).collect()}
    assert len(got) == len(rows)
    err, by_text = [], {}
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        err += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert max(map(abs, err)) < 0.15 and abs(sum(err) / len(err)) < 0.02


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id bigint, text string")
    out = FP.compare_with_edits(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(False, 0), (True, 1), (True, 1), (True, 2)]
    assert FP.compare_with_edits(df.limit(0)).collect() == []
    one = FP.compare_with_edits(spark.createDataFrame([(5, "abcd")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_fingerprint_column_keeps_other_columns(spark):
    df = spark.createDataFrame([("t", 1)], "text string, fingerprint_ int")
    assert FP.fingerprints(df).columns == ["text", "fingerprint_", "fingerprint"]


def test_helper_with_a_clashing_column(spark):
    from verdant.llm import fingerprints
    df = spark.createDataFrame([(1, "a b c d e f", 7)], "doc_id bigint, text string, FINGERPRINT int")
    out = fingerprints.fingerprints(df)
    assert out.columns == ["doc_id", "text", "FINGERPRINT", "fingerprint_"] and out.first().FINGERPRINT == 7


def test_long_words_that_swap_blocks_differ():
    import pyarrow as pa
    from verdant.llm.common import word_hashes
    a, b = "a" * 65536, "b" * 65536
    words, counts = word_hashes(pa.array([a + b, b + a, a + b + a, a + b, "x " + a + b]))
    assert counts.tolist() == [1, 1, 1, 1, 2] and len({words[0], words[1], words[2]}) == 3 and words[0] == words[3] == words[5]
