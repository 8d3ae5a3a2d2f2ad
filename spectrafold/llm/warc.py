"""WARC archives of captures, and their index by external merge.

Each task writes its captures as gzipped WARC records into archives of ROLL bytes at least. Captures read back from the
archives are sorted by URL key, timestamp and page, RUN of them at a time, and each such run is a file of blocks in order. Runs
are merged by a loser tree that streams them from their files, a block of each in memory: first groups of FAN runs into
one, as long as there are more than FAN, then all that are left, range by range of the order, so that
all ranges in turn are the capture histories in global order. Only the blocks' first and last keys are shuffled.

Of captures with equal payloads the one of the largest page_id is a response, all others revisit it. Only
digests meet to find this out; payloads stay where they are read.

Files are named after task and attempt, and only those that the written manifest names are read.

Defined results: a null html is an empty payload; a null url has the empty key and no target URI; a null page_id is a
revisit where its payload has another page, else a response; rows that repeat the largest page_id are all responses; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, new_folder, open_shared, slices, with_small

ROLL = 64 << 20
#: Captures that one range of the merge, a run before it is merged, and a block hold, about.
RANGE, RUN, BLOCK = 200_000, 200_000, 256
#: Runs that are merged at once.
FAN = 256
#: The synthetic pages carry no time: a page is captured so many seconds after this one, by its id within SECONDS.
FIRST_SECOND, SECONDS = 1_704_067_200, 1_000_000_000

INDEX = "page_id long, url_key string, captured long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Host parts from the top level down, then path and query, in lower case; the whole text where it has no host."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def _urn(page_id: int | None) -> bytes:
    return f"<urn:page:{'none' if page_id is None else page_id}>".encode()


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the response's HTTP header and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + _urn(page_id)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127)))).encode())
    head += [b"WARC-Date: " + datetime.fromtimestamp(captured, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ").encode(), b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def read_records(source) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each gzip member of an open archive."""
    at, data, unpack, out, taken = 0, b"", zlib.decompressobj(31), [], 0
    while True:
        if not data and not (data := source.read(1 << 20)):
            if out or taken:
                raise ValueError("the archive ends within a record")
            return
        out.append(unpack.decompress(data))
        rest = unpack.unused_data
        taken += len(data) - len(rest)
        data = rest
        if unpack.eof:
            yield at, taken, b"".join(out)
            at, unpack, out, taken = at + taken, zlib.decompressobj(31), [], 0


def parsed(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers, HTTP header and payload."""
    head, _, rest = content.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    return headers, http, payload


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the manifest: path, records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    shared = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 and last is not null").select("sha1", "last")
    joined = with_small(rows, cut(shared, "payloads"), ["sha1"], 96, "left")
    joined = joined.select("page_id", "url", (F.lit(FIRST_SECOND) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(SECONDS))).alias("captured"), "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0
        manifest = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])
        for batch in slices(batches):
            for page_id, url, captured, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(path, "wb")
                member = record(page_id, url, captured, payload, sha1_base32(payload), refers_to)
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ROLL:
                    out.close()
                    out = None
                    yield manifest()
        if out is not None:
            out.close()
            yield manifest()

    return cut(joined.mapInArrow(run, "path string, records long"), "manifest")


KEY = "struct<url_key:string,captured:bigint,has_page:boolean,page:bigint,archive:string,offset:bigint>"
BLOCKS = f"run string, block int, n int, first {KEY}, last {KEY}"


def _read_archive(path: str) -> Iterator[tuple]:
    """The rows of INDEX of an archive's records; a response's payload is held against its digest."""
    with open_shared(path, "rb") as source:
        for offset, length, content in read_records(source):
            headers, http, payload = parsed(content)
            kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
            if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                raise ValueError(f"{path}, record at {offset}: payload and digest differ")
            page, refers = (re.search(r"page:(-?\d+)", headers.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
            captured = int(datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
            yield page and int(page[1]), url_key(headers.get("WARC-Target-URI")), captured, path, offset, length, size, digest, kind, refers and int(refers[1])


def _write_run(rows: Iterator[tuple], folder: str) -> Iterator[tuple]:
    """Writes rows, which are in order, as the blocks of a run; the rows of BLOCKS."""
    path, number = f"{folder}/run-{uuid.uuid4().hex}.arrow", 0
    with open_shared(path, "wb") as out, pa.ipc.new_file(out, _batch([], NAMES).schema) as file:
        while part := list(islice(rows, BLOCK)):
            file.write_batch(_batch(part, NAMES))
            yield path, number, len(part), order(part[0]), order(part[-1])
            number += 1


def _read_run(path: str, blocks: list[int]) -> Iterator[tuple]:
    with open_shared(path, "rb") as source, pa.ipc.open_file(source) as file:
        for number in blocks:
            yield from zip(*(c.to_pylist() for c in file.get_batch(number).columns))


def _block_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    key = pa.struct([("url_key", pa.string()), ("captured", pa.int64()), ("has_page", pa.bool_()), ("page", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
    kinds = [pa.string(), pa.int32(), pa.int32(), key, key]
    named = lambda k: dict(zip(key.names, k))
    while part := list(islice(rows, 10_000)):
        columns = [*zip(*((*r[:3], named(r[3]), named(r[4])) for r in part))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["run", "block", "n", "first", "last"])


def read_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Sorts the captures of the archives into runs; BLOCKS of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        captures = (row for batch in batches for path in batch.column(0).to_pylist() for row in _read_archive(path))

        def blocks() -> Iterator[tuple]:
            while part := list(islice(captures, RUN)):
                yield from _write_run(iter(sorted(part, key=order)), folder)

        yield from _block_batches(blocks())

    return cut(manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, BLOCKS), "runs")


NAMES = re.findall(r"(\w+) \w+", INDEX)


def order(row: tuple) -> tuple:
    """URL key, timestamp, page (null first), place in the archives."""
    return row[1], row[2], row[0] is not None, row[0] or 0, row[3], row[4]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("url_key", "archive", "payload_digest", "record_type") else pa.int64() for n in names]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def merge(runs: list[Iterator]) -> Iterator:
    """K-way merge by a loser tree: each inner node keeps the loser of its match, so a new head plays one path."""
    k = len(runs)
    if not k:
        return
    heads = [next(r, None) for r in runs]
    keys = [(h is None, order(h) if h is not None else ()) for h in heads]
    losers, winner_at = [0] * k, [0] * (2 * k)
    for i in range(k):
        winner_at[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winner_at[2 * node], winner_at[2 * node + 1]
        winner_at[node], losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
    best = winner_at[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        heads[best] = head = next(runs[best], None)
        keys[best] = (head is None, order(head) if head is not None else ())
        node = (k + best) // 2
        while node:
            if keys[losers[node]] < keys[best]:
                losers[node], best = best, losers[node]
            node //= 2


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[int]]]]:
    """Of each part (a number; rows are sorted by it, run and block) its runs and their blocks."""
    now, runs = None, {}
    for batch in batches:
        for part, run, block in zip(*(batch.column(c).to_pylist() for c in ("part", "run", "block"))):
            if part != now and runs:
                yield now, runs
                runs = {}
            now = part
            runs.setdefault(run, []).append(block)
    if runs:
        yield now, runs


def fewer_runs(blocks: DataFrame, runs: int, folder: str) -> DataFrame:
    """Merges groups of FAN runs, about, into one each."""
    groups = -(-runs // FAN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _parts(batches):
            yield from _block_batches(_write_run(merge([_read_run(path, numbers) for path, numbers in own.items()]), folder))

    dealt = blocks.select(F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("part"), "run", "block")
    return cut(dealt.repartitionById(groups, F.col("part")).sortWithinPartitions("part", "run", "block").mapInArrow(run, BLOCKS), "runs")


def histories(blocks: DataFrame, folder: str) -> DataFrame:
    """All captures in global order: ranges by URL key, timestamp and page, each merged from the blocks that reach into it."""
    captures, runs = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_distinct("run")).first()
    while runs > FAN:
        blocks = fewer_runs(blocks, runs, folder)
        runs = blocks.agg(F.count_distinct("run")).first()[0]
    ranges = max(1, -(-captures // RANGE))
    # One key for each RANGE captures is all that the driver sees.
    placed = blocks.select("first").repartitionByRange(ranges, "first").groupBy(F.spark_partition_id()).agg(F.min("first").alias("first"))
    bounds = sorted(tuple(r["first"]) for r in placed.collect())[1:] if ranges > 1 else []

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, run, block = [], [], []
            for path, number, first, last in zip(*(batch.column(c).to_pylist() for c in ("run", "block", "first", "last"))):
                for k in range(bisect_right(bounds, tuple(first.values())), bisect_right(bounds, tuple(last.values())) + 1):
                    part.append(k)
                    run.append(path)
                    block.append(number)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(run, pa.string()), pa.array(block, pa.int32())], ["part", "run", "block"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own in _parts(batches):
            inside = lambda rows, k=k: (r for r in rows if (k == 0 or order(r) >= bounds[k - 1]) and (k == len(bounds) or order(r) < bounds[k]))
            rows = merge([inside(_read_run(path, numbers)) for path, numbers in own.items()])
            while part := list(islice(rows, 10_000)):
                yield _batch(part, NAMES)

    dealt = blocks.mapInArrow(reach, "part int, run string, block int")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "run", "block").mapInArrow(merged, INDEX)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages as archives, reads them back, and returns the capture histories (INDEX's columns)."""
    return histories(read_runs(write_archives(pages, folder), folder), folder)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    found = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
