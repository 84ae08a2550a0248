"""The pipeline's stages against brute force on the smallest tables."""

import hashlib

import public_tokenizers
import tiktoken

import __spark_entry__ as E
import corpus_pipeline as C
from verdant.llm import bpe, pii

from conftest import SF_SMALL
from test_decontaminate import brute as brute_overlaps
from test_jaccard_join import brute as brute_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    good = C.keep_good(spark, docs, SF_SMALL).cache()
    assert good.columns == COLUMNS
    kept = {r.doc_id for r in good.collect()}
    held = [(r.quality == 1 and r.toxic == 0, i in kept) for i, r in labels.items()]
    assert sum(a == b for a, b in held) / len(held) > 0.85      # 87 labels, 11 of them toxic: too few for a lexicon

    one = C.keep_one_of_each(spark, good, SF_SMALL).cache()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert one.columns == COLUMNS
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, _, c in brute_components(rows) if d == c)

    clean = C.drop_benchmark(spark, one, SF_SMALL).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    bad = {d for d, _ in brute_overlaps(rows, items)}
    assert bad and sorted(r.doc_id for r in clean.collect()) == sorted(d for d, _ in rows if d not in bad)

    masked = C.mask_personal_data(spark, clean, SF_SMALL).cache()
    assert masked.columns == COLUMNS
    for r in masked.collect():
        assert not pii.base_spans(r.text)[0] and r.n_chars == len(r.text)

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = sorted((r.doc_id, len(e := enc.encode_ordinary(r.text)), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest())
                  for r in masked.collect())
    assert sorted(tuple(r)[:3] for r in C.tokenise(spark, masked, SF_SMALL).collect()) == want


def test_registered(spark):
    names = E.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {x[:x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert [x for x, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
