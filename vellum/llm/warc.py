"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id into shards whose bounds depend on the rows alone, headers and digests are made anew
from each record, files roll by compressed size, and each is written under a temporary name, then moved; the
manifest, moved into place last, lists what belongs. The same rows give the same bytes on every run.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, range_shards, saved, shard_of, work_path

SHARD, ROLL, LEAST_PAYLOAD = 64 << 20, 16 << 20, 100
DATE = "1970-01-01T00:00:00Z"
FILES = "shard int, name string, records long, bytes long, sha256 string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, position long"
CONTROLS = re.compile("[\x00-\x1f\x7f-\x9f\u2028\u2029]")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}/{digest}')}>"


def header_value(text: str) -> str:
    """text without what would end a header line: control characters and line separators as %XX of their bytes."""
    return CONTROLS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, its headers made from its content; a revisit holds no payload but names it and its length."""
    digest = hashlib.sha256(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page_id, digest)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {header_value(url)}"] if url is not None else []),
        *([f"X-Target-As-Given: {json.dumps(url)}"] if url is not None and CONTROLS.search(url) else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([] if refers_to is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]),
        *([] if page_id is None else [f"X-Page: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without time or name, so equal records are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def opening(name: str, date: str) -> bytes:
    """The warcinfo record that each file begins with."""
    block = b"software: vellum\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(stream, size: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(headers, block, position in the file) of each member of a gzip stream, digests and lengths verified."""
    data, at = stream.read(size), 0
    while data:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not data:
                raise ValueError("the file ends within a record")
            parts.append(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data if z.eof else stream.read(size)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"damaged record at {at}")
        yield headers, block, at
        at += used
        data = data or stream.read(size)


def write(pages: DataFrame, path: str, shard: int = SHARD, roll: int = ROLL, least: int = LEAST_PAYLOAD, date: str = DATE) -> list[dict]:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest's files in record order.

    Of records with equal payloads of at least `least` bytes, those of the smallest page_id are responses and the
    others revisit them (a null page_id is never the smallest). Null html: an empty payload; null url: no target header,
    though the standard asks for one; control characters of a url are written as %XX, all else as it is,
    and a url with such is also kept as JSON in a header of its own.
    Rows go to their shard once; what revisits what is found on digests alone and travels as small rows beside them.
    Repeated rows of one page_id sort by url and digest.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    narrow = saved(rows.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n")))
    shared = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).where("k > 1 and refers_to is not null").select("digest", "refers_to")
    revisits = narrow.where(F.col("n") >= least).join(shared, "digest").where("page_id is null or page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    bounds = range_shards(narrow, "page_id", F.col("n") + 600, shard)
    both = rows.select("page_id", "digest", "url", "html", F.lit(None).cast("long").alias("refers_to"), F.lit(1).alias("kind")).unionByName(revisits.select("page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "refers_to", F.lit(0).alias("kind")))
    dealt = both.withColumn("shard", shard_of(F.col("page_id"), bounds)).repartitionById(len(bounds), F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        now, seq, n, size, out, sha, refers = None, 0, 0, 0, None, None, (None, None, None)
        tag, made = uuid.uuid4().hex, []

        def done() -> None:
            nonlocal out
            if out is not None:
                out.close()
                name = f"shard-{now:06d}-{seq:04d}.warc.gz"
                fs.move(f"{root}/{name}.tmp-{tag}", f"{root}/{name}")
                made.append({"shard": now, "name": name, "records": n, "bytes": size, "sha256": sha.hexdigest()})
                out = None

        for b in batches:
            for s, page, digest, url, html, ref, kind in zip(*(b.column(i).to_pylist() if i != 4 else b.column(i) for i in range(7)), strict=True):
                if kind == 0:
                    refers = (page, digest, ref)
                    continue
                if s != now or (out is not None and size >= roll):
                    done()
                    seq = seq + 1 if s == now else 0
                    now = s
                if out is None:
                    name, first = f"shard-{now:06d}-{seq:04d}.warc.gz", member(opening(f"shard-{now:06d}-{seq:04d}.warc.gz", date))
                    out, n, size, sha = fs.open_output_stream(f"{root}/{name}.tmp-{tag}", compression=None), 0, len(first), hashlib.sha256(first)
                    out.write(first)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                raw = member(record(page, url, payload, refers[2] if refers[:2] == (page, digest) else None, date))
                out.write(raw)
                sha.update(raw)
                n, size = n + 1, size + len(raw)
        done()
        yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    files = sorted((r.asDict() for r in dealt.select("shard", "page_id", "digest", "url", "html", "refers_to", "kind").mapInArrow(run, FILES).collect()), key=lambda r: r["name"])
    tmp = f"{root}/manifest.tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        f.write(json.dumps({"date": date, "files": files}).encode())
    fs.move(tmp, f"{root}/manifest.json")
    return files


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives that the manifest lists: page_id, payload_bytes, payload_digest, record_type,
    refers_to, url, file, position. Digests are verified: of the block always, of the payload where the record holds it."""
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        names = [(x["name"],) for x in json.loads(f.read())["files"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for b in batches:
            for name in b.column(0).to_pylist():
                got = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block, at in records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest, n = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: payload differs at {at}")
                        page, ref, url = h.get("X-Page"), h.get("X-Refers-To-Page"), json.loads(h["X-Target-As-Given"]) if "X-Target-As-Given" in h else h.get("WARC-Target-URI")
                        got.append((page and int(page), n, digest, h["WARC-Type"], ref and int(ref), url, name, at))
                cols = list(zip(*got, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "file", "position"])

    if not names:
        return spark.createDataFrame([], RECORDS)
    return spark.createDataFrame(names, "name string").repartition(len(names)).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, shard: int = SHARD, roll: int = ROLL) -> DataFrame:
    """Writes pages into a new folder of the shared place and reads the archives back. Empty input: no rows."""
    path = work_path(pages.sparkSession, "warc")
    write(pages, path, shard, roll)
    return read(pages.sparkSession, path)
