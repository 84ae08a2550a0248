"""Operator 10 — WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of an archive file. Of pages with
equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the largest
id is a ``response``; the others are ``revisit`` records that name it.

Index: captures are sorted by reversed-host key (``com,example,www)/path``)
into shards of compressed blocks. Each shard file ends with the sparse
directory of its blocks (first key, offset, length); the list of shards holds
one first key a shard and is as long as the partitions. A lookup finds the
shard, then the block, both by binary search, and then range-reads the block
and the record.

Files are written under names of their own by each task attempt; only those of
attempts that succeeded are referred to, so a lost executor leaves no trace.

Defined cases: a null html is the empty payload; a null url has the key "";
a null id sorts first and is never preferred over an id; repeated rows are
separate records (all that carry the largest id are responses); control
characters in a url are percent-encoded; other columns are not archived.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from verdant.llm.common import arrow_map, partitions, prepare, scratch, stored

REVISIT_BYTES = 1000          # smaller payloads are always stored
ARCHIVE_BYTES = 128 << 20     # an archive file is closed beyond this size
BLOCK_LINES = 512             # captures of an index block
SALTS = 16                    # a hot payload's rows are dealt over this many keys
LOWEST = -(1 << 63)

CAPTURE = ("surt string, page_id bigint, file string, offset bigint, length bigint")
RECORD = ("page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, "
          "payload_digest string, refers_to bigint, refers_to_url string")
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def clean_url(url: str | None) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m.group()):02X}", url or "")


def surt(url: str | None) -> str:
    """Reversed-host key of a url; what is no ``scheme://host`` url stays as it is."""
    scheme, mark, rest = clean_url(url).partition("://")
    if not mark:
        return scheme
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[:cut.start()], rest[cut.start():]) if cut else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str,
            refers_to: int | None, refers_to_url: str | None) -> bytes:
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", clean_url(url)), ("WARC-Date", "1970-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Refers-To-Target-URI", clean_url(refers_to_url)),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Header fields and payload of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    fields["payload"] = body.partition(b"\r\n\r\n")[2]
    return fields


def _page_id(urn: str | None) -> int | None:
    digits = urn[len("<urn:page:"):-1] if urn else ""
    return int(digits) if digits else None


@dataclass
class Archive:
    """Where an archive's index lies: one (first surt, first id, file, directory
    offset, directory length) a shard, in key order."""
    shards: list[tuple[str, int, str, int, int]]


def revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``digest``, ``refers_to`` and
    ``refers_to_url``, both null for responses."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    hashed = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"),
                          F.octet_length(payload).alias("n"))
    kept = (hashed.where(F.col("n") >= REVISIT_BYTES).groupBy("digest")
            .agg(F.max("page_id").alias("keep"), F.count("*").alias("copies"),
                 F.max_by("url", "page_id").alias("keep_url"))
            .where("copies > 1 and keep is not null")
            .select("digest", "keep", "keep_url", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    other = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return (hashed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
            .join(kept, ["digest", "salt"], "left")
            .select("page_id", "url", "html", "digest", F.when(other, F.col("keep")).alias("refers_to"),
                    F.when(other, F.col("keep_url")).alias("refers_to_url")))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page into archive files under ``folder``; the captures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, at, rows = None, "", 0, []
        for b in batches:
            for r in b.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = member.compress(_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"],
                                               r["refers_to"], r["refers_to_url"])) + member.flush()
                out.write(data)
                rows.append((surt(r["url"]), r["page_id"], name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i != 1 else pa.array(c, pa.int64())
                                                  for i, c in enumerate(map(list, zip(*rows)))],
                                                 names=["surt", "page_id", "file", "offset", "length"])
                rows = []
        if out is not None:
            out.close()

    return arrow_map(revisits(pages), run, CAPTURE)


def write_index(captures: DataFrame, folder: str) -> Archive:
    """Sort captures into shards of compressed blocks under ``folder``."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, at, directory, lines, name = None, 0, [], [], f"{uuid.uuid4().hex}.idx"

        def block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(x[2] for x in lines).encode())
            out.write(data)
            directory.append((lines[0][0], lines[0][1], at, len(data)))
            at += len(data)
            lines.clear()

        for b in batches:
            for r in b.to_pylist():
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                key = LOWEST if r["page_id"] is None else r["page_id"]
                lines.append((r["surt"], key, f"{r['surt']}\t{key}\t{r['file']}\t{r['offset']}\t{r['length']}"))
                if len(lines) == BLOCK_LINES:
                    block()
        if out is None:
            return
        if lines:
            block()
        foot = zlib.compress(json.dumps(directory).encode())
        out.write(foot)
        out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([v]) for v in (directory[0][0], directory[0][1], name, at, len(foot))],
            names=["surt", "first", "file", "at", "size"])

    ordered = (captures.repartitionByRange(partitions(spark), F.col("surt"), F.col("page_id").asc_nulls_first())
               .sortWithinPartitions(F.col("surt"), F.col("page_id").asc_nulls_first()))
    shards = stored(arrow_map(ordered, run, "surt string, first bigint, file string, at bigint, size bigint"), "shards")
    return Archive(sorted(tuple(r) for r in shards.collect()))          # one row a partition


def write(pages: DataFrame) -> tuple[Archive, str]:
    """Archives and index of ``pages`` in a new shared folder."""
    prepare(pages.sparkSession)
    folder = scratch(pages.sparkSession, "warc")
    captures = stored(write_archives(pages, f"{folder}/archive"), "captures")
    return write_index(captures, f"{folder}/index"), folder


def lookup(spark: SparkSession, archive: Archive, folder: str, keys: DataFrame) -> DataFrame:
    """Records of the captures that ``keys`` (url, page_id) name. A key found
    several times gives all its captures, one asked for twice gives them once."""
    shards = archive.shards

    @pandas_udf("string")
    def key_of(url):
        return url.map(surt)

    @pandas_udf("int")
    def shard_of(key, page_id):
        import pandas as pd
        firsts = [(s[0], s[1]) for s in shards]
        return pd.Series([max(0, bisect.bisect_right(firsts, k) - 1) for k in zip(key, page_id)], dtype="int32")

    asked = keys.select(key_of(F.coalesce("url", F.lit(""))).alias("surt"),
                        F.coalesce("page_id", F.lit(LOWEST)).alias("page_id")).distinct()
    dealt = (asked.withColumn("shard", shard_of("surt", "page_id"))
             .repartition(partitions(spark), "shard").sortWithinPartitions("shard", "surt", "page_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        shard, directory, source, held = None, [], None, (None, [])
        archives: dict[str, pa.NativeFile] = {}

        def captures(i: int) -> list[tuple]:
            nonlocal held
            if held[0] != i:
                _, _, at, size = directory[i]
                lines = zlib.decompress(source.read_at(size, at)).decode().split("\n")
                split = [x.split("\t") for x in lines]
                held = (i, [((s, int(p)), f, int(o), int(n)) for s, p, f, o, n in split])
            return held[1]

        for b in batches:
            rows = []
            for key, page_id, k in zip(*(b.column(c).to_pylist() for c in ("surt", "page_id", "shard"))):
                if not shards:
                    continue
                if k != shard:
                    shard, held = k, (None, [])
                    _, _, file, at, size = shards[k]
                    source = fs.open_input_file(f"{root}/index/{file}")
                    directory = json.loads(zlib.decompress(source.read_at(size, at)))
                    firsts = [(d[0], d[1]) for d in directory]
                want = (key, page_id)
                i = max(0, bisect.bisect_left(firsts, want) - 1)      # the block before may end with the key
                while i < len(directory) and firsts[i] <= want:
                    block = captures(i)
                    j = bisect.bisect_left(block, want, key=lambda c: c[0])
                    for found, file, at, size in block[j:]:
                        if found != want:
                            break
                        if file not in archives:
                            if len(archives) >= 64:
                                archives.popitem()[1].close()
                            archives[file] = fs.open_input_file(f"{root}/archive/{file}")
                        rows.append(parse_record(zlib.decompress(archives[file].read_at(size, at), 31)))
                    i += 1
            if rows:
                yield _batch(rows)

    return arrow_map(dealt, run, RECORD)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    full = [r["WARC-Type"] == "response" for r in rows]
    return pa.RecordBatch.from_arrays([
        pa.array([_page_id(r["WARC-Record-ID"]) for r in rows], pa.int64()),
        pa.array([r["WARC-Target-URI"] for r in rows], pa.string()),
        pa.array([r["WARC-Type"] for r in rows], pa.string()),
        pa.array([r["payload"] if f else None for r, f in zip(rows, full)], pa.binary()),
        pa.array([len(r["payload"]) if f else int(r["X-Payload-Length"]) for r, f in zip(rows, full)], pa.int64()),
        pa.array([hashlib.sha1(r["payload"]).hexdigest() if f else r["WARC-Payload-Digest"][5:]
                  for r, f in zip(rows, full)], pa.string()),
        pa.array([_page_id(r.get("WARC-Refers-To")) for r in rows], pa.int64()),
        pa.array([r.get("WARC-Refers-To-Target-URI") for r in rows], pa.string())],
        names=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to", "refers_to_url"])


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    page, as read back from the archives through the index."""
    archive, folder = write(pages)
    found = lookup(pages.sparkSession, archive, folder, pages.select("url", "page_id"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
