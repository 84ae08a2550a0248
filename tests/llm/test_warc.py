"""Exact round trip through archives and index."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from verdant.llm import warc


def test_surt():
    assert warc.surt("http://M.Example.com/en/1?x#y") == "com,example,m)/en/1?x#y"
    assert warc.surt("https://a.b") == "b,a)" and warc.surt(None) == "" and warc.surt("mail:x\ty") == "mail:x%09y"


def pages():
    rnd = random.Random(1)
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}", "x" * rnd.randrange(0, 2500) + "é") for i in range(300)]
    rows += [(1000 + i, f"http://h{i % 3}.example.org/", "same payload " * 100) for i in range(400)]
    rows += [(2000, None, "y" * 1000), (2001, "no scheme", "y" * 1000), (2002, "", "y" * 999), (2003, "http://a", None),
             (None, "http://a/", "y" * 1000), (5000, "http://dup/", "z" * 1200), (5000, "http://dup/", "z" * 1200)]
    return rows


def expected(rows):
    best = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        other = b in best and best[b] != i
        out.append((i if i is not None else -1, len(b), hashlib.sha1(b).hexdigest(),
                    "revisit" if other else "response", best[b] if other else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(5)
    got = sorted(((r.page_id if r.page_id is not None else -1, *r[1:]) for r in warc.digest(df).collect()), key=str)
    assert got == expected(rows)
    assert warc.digest(df.limit(0)).collect() == []


def test_lookup_reads_single_captures_and_archives_are_gzip_members(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archive, folder = warc.write(df)
    ask = spark.createDataFrame([(rows[3][1], 3), ("http://none/", 1), (rows[3][1], 4), ("http://dup/", 5000)],
                                "url string, page_id bigint")
    got = warc.lookup(spark, archive, folder, ask).collect()
    assert sorted(r.page_id for r in got) == [3, 5000, 5000]
    assert next(bytes(r.payload).decode() for r in got if r.page_id == 3) == rows[3][2]
    raw = spark.read.format("binaryFile").load(f"{folder}/archive").collect()
    n = 0
    for r in raw:
        data = bytes(r.content)
        while data:
            member = zlib.decompressobj(31)
            assert member.decompress(data).startswith(b"WARC/1.1\r\n")
            data, n = member.unused_data, n + 1
    assert n == len(rows)
