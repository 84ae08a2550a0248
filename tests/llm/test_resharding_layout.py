"""The files after resharding are the whole new layout."""

import zlib
from pathlib import Path

from pyspark.sql import functions as F

from verdant.llm import resharding as R


def local(path):
    return Path(path.removeprefix("file:"))


def test_every_changed_shard_is_rewritten_whole(spark):
    docs = [(i, f"text {i % 90} é", i * 2) for i in range(3000)] + [(None, "n", 1), (3, None, 2), (7, "same", 3), (7, "same", 3)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, size int").repartition(3)
    new = R.lay_out(df, 12, 16)
    old = spark.read.parquet(new.before)
    assert {p.name for p in local(new.before).glob("old_shard=*")} == {f"old_shard={k}" for k in range(12)}
    assert old.where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(12))
                     != F.col("old_shard")).count() == 0
    assert new.untouched == []
    files = spark.read.parquet(new.after)
    key = lambda r: tuple((x is not None, x) for x in r)                      # noqa: E731
    assert sorted((tuple(r) for r in files.select("doc_id", "text", "size").collect()), key=key) == sorted(docs, key=key)
    want = {(r.shard, r.slot): (r.doc_id, r.text_crc32) for r in new.placed.collect()}
    sizes = []
    for k in range(16):                                                       # each folder alone is its shard
        rows = spark.read.parquet(f"{new.after}/shard={k}").collect()
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert all(want[k, r.slot] == (r.doc_id, zlib.crc32((r.text or "").encode())) for r in rows)
        sizes.append(len(rows))
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(docs)
    stayed = new.placed.where("shard = old_shard").count()
    assert stayed and files.where("arrived = 0").count() == stayed


def test_only_untouched_shards_keep_their_files(spark):
    by = {k: [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == k] for k in range(3)}
    ids = by[0][:10] + by[1][:14] + by[2][:6]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(2)
    new = R.lay_out(df, 3, 3)
    assert new.untouched == [0] and {p.name for p in local(new.after).glob("shard=*")} == {"shard=1", "shard=2"}
    assert sorted((r.doc_id, r.text) for r in new.rows.collect()) == sorted((i, f"t{i}") for i in ids)
    assert sorted((r.shard, r.slot) for r in new.rows.collect()) == [(k, s) for k in range(3) for s in range(10)]


def test_digest_reads_the_new_files(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(3000)], "doc_id bigint, text string")
    out = R.digest(df)
    assert out.inputFiles() and all("shards-new" in f for f in out.inputFiles()) and out.count() == 3000


def test_clashing_columns(spark):
    from verdant.llm import resharding
    df = spark.createDataFrame([(k, f"t{k}", k, k + 1, k + 2) for k in range(40)], "doc_id bigint, text string, shard int, Slot int, arrived int")
    new = resharding.lay_out(df, 3, 5)
    assert (new.shard, new.slot, new.arrived) == ("shard_", "slot_", "arrived_")
    rows = new.rows.collect()
    assert sorted(new.rows.columns) == sorted([*df.columns, "shard_", "slot_"]) and len(rows) == 40
    assert all(r.shard == r.doc_id and r.Slot == r.doc_id + 1 and r.arrived == r.doc_id + 2 for r in rows)
    placed, before, moved = resharding.reshard(df, 3, 5)
    assert "shard_=*/arrived_=1" in moved and spark.read.parquet(moved).count() == placed.where("old_shard <> shard").count()
