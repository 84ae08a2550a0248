"""Delimited files against the csv module, one file over many splits."""

import csv
import io
import random

import pytest

from verdant.operators import ingest as A
from verdant.sources import delimited as D


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    old = {n: spark.conf.get(n, None) for n in names}
    for n, v in zip(names, ("400", "1", "1")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _rows(text):
    return [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n"), newline=""))]


def _texts():
    rnd = random.Random(6)
    cell = lambda: rnd.choice(["", "a", "12", "x y", 'say "hi"', "two\nlines", "a,b", "é世", "  ", '"', "\n", "tail\n", ",", "long " * 30])
    out = []
    for k in range(6):
        buffer = io.StringIO(newline="")
        csv.writer(buffer, lineterminator=rnd.choice(["\n", "\r\n"])).writerows([[cell() for _ in range(rnd.randrange(1, 5))] for _ in range(120)])
        out.append(buffer.getvalue())
    out.append("".join(rnd.choice(['"', ",", "a", "\n", "b ", '""', "\r\n"]) for _ in range(3000)))       # any quotes anywhere
    out.append('head,er\n1,"never closed\nmore\n\nend')
    out.append('h\n\n\n  \n"x\n\n\ny"\n')
    return out


def test_line_states_follow_the_csv_module():
    rnd = random.Random(3)
    for _ in range(4000):
        line = "".join(rnd.choice('",ab') for _ in range(rnd.randrange(0, 12)))
        for inside in (False, True):
            more = next(csv.reader(io.StringIO(('"' if inside else "") + line + "\nZ,Z", newline="")))
            assert D.ends_inside(line, inside) == any("\nZ" in c for c in more), (line, inside)


def test_records_and_cells_over_many_splits(spark, tmp_path, small_splits):
    texts = _texts()
    for k, t in enumerate(texts):
        (tmp_path / f"f{k}.csv").write_bytes(t.encode())
    got = {}
    rows = D.read_delimited(spark, str(tmp_path)).collect()
    for r in rows:
        got.setdefault(r.file_id.rsplit("/", 1)[1], {})[r.row_no] = list(r.cells)
    lines = spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count()
    assert lines > 10                                             # splits really were small
    for k, t in enumerate(texts):
        want = [r or [""] for r in _rows(t)]
        found = got[f"f{k}.csv"]
        assert sorted(found) == list(range(1, len(want) + 1)), k
        cells = [found[i] or [""] for i in sorted(found)]
        for rows in (cells, want):                                # a quote never closed: less the file's last line end
            rows[-1][-1] = rows[-1][-1].rstrip("\n")
        assert cells == want, k


def test_pages_of_a_file(spark, tmp_path, small_splits):
    text = _texts()[0] + _texts()[1].replace("\r\n", "\n") + _texts()[2].replace("\r\n", "\n")
    (tmp_path / "one.csv").write_bytes(text.encode())
    (tmp_path / "head.csv").write_bytes(b"only,header\n\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    pages = {(r.file_id.rsplit("/", 1)[1], r.page_no): r.page_text for r in
             A.rows_to_pages(D.read_delimited(spark, str(tmp_path))).collect()}
    lines = [x for x in ("\t".join(r) for r in _rows(text)) if x.strip()]
    for p in range(0, len(lines) - 1, 100):
        part = lines[1 + p:101 + p]
        assert pages.pop(("one.csv", p // 100)) == f"[CSV, Rows {p + 2}-{p + 1 + len(part)}]\n{lines[0]}\n" + "\n".join(part)
    assert pages == {("head.csv", 0): "only\theader"}


def test_numbers_by_stretches(spark):
    rows = [(k % 3 if k % 5 else None, 7 * k) for k in range(200)]
    df = spark.createDataFrame(rows, "file int, row_no bigint").repartition(4)
    got = {(r.file, r.row_no): r._rn for r in A.numbered(df, ["file"], "row_no", span=50).collect()}
    for f in (0, 1, 2, None):
        mine = sorted(n for x, n in rows if x == f)
        assert [got[f, n] for n in mine] == list(range(1, len(mine) + 1))


def test_other_delimiters(spark, tmp_path):
    (tmp_path / "a.txt").write_text('x|"y|z"|\n1|2,3|"4\n5"\n')
    rows = sorted(tuple(r) for r in D.read_delimited(spark, str(tmp_path), "|").select("row_no", "cells").collect())
    assert rows == [(1, ["x", "y|z", ""]), (2, ["1", "2,3", "4\n5"])]


def test_parts_of_one_file(spark, tmp_path, small_splits):
    """F8: a file in parts reads as the file; a quoted cell may even reach over parts."""
    text = _texts()[0].replace("\r\n", "\n") + _texts()[1].replace("\r\n", "\n")
    lines = text.splitlines(keepends=True)
    for k in range(0, len(lines), 37):
        (tmp_path / f"part-{k:05d}.csv").write_text("".join(lines[k:k + 37]), newline="")
    rows = {r.row_no: list(r.cells) for r in D.read_delimited(spark, str(tmp_path), whole=True).collect()}
    assert [rows[k] or [""] for k in range(1, len(rows) + 1)] == [r or [""] for r in _rows(text)]
