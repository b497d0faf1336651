"""WARC: a deterministic sharded writer and a reader.

Pages are laid out by id and digest; exact running sums of payload bytes over that order cut it into
shards, so a record's shard depends on the table alone, whatever the ids look like. Each shard is sorted
by page id and written by one task, which starts a new file when the compressed size reaches the limit;
every record is its own gzip member. Headers and digests are made anew. Which records repeat a payload
is found on digests alone (aggregated before the shuffle); it reaches the writer as marker rows that
sort just before their record, so payloads are shuffled once.

Tasks write under temporary names that no other attempt uses and report their files. A second job moves
the reported files to their final names (a move that was already made counts as done, so its tasks may
be repeated), then the driver writes the manifest the same way; a reader takes files from the manifest
only. Files left by lost attempts go with the temporary folder. The driver holds a shard's first id and
a line of the manifest for each GB of payload.

Files are reached through pyarrow's file systems, by the folder's URI.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import join_groups, shared_dir, staged, text_batches
from quillon.session import table

SHARD_BYTES = 1 << 30
ROLL_BYTES = 1 << 30
MIN_SHARDS = 32
#: What a record weighs besides its payload.
HEAD_BYTES = 500
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "name string, temp string, shard int, records long, bytes long, sha256 string, first_id string, last_id string"


def base32_sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(page_id: int | None, digest: str, copy: int) -> str:
    """A record's id: the same page, payload and copy always get the same one."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{copy}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    named = [*headers, ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int) -> bytes:
    """One page's compressed record. A revisit keeps the HTTP header, whose length is the payload's."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_urn(page_id, digest, copy)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    headers += [("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_urn(refers_to, digest, 0))]
        if refers_to is not None:
            headers.append(("WARC-Refers-To-Page-ID", str(refers_to)))
    return _record(headers, http if revisit else http + payload)


def _writer(folder: str, roll_bytes: int, min_revisit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        attempt = uuid.uuid4().hex
        sink, at, done, number = None, {}, [], 0

        def close():
            sink.close()
            done.append(at | {"sha256": at["sha256"].hexdigest()})

        shard = before = mark = None
        copy = 0
        for batch in batches:
            for s, page_id, sha, kind, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (page_id, sha) != before:
                    before, mark, copy = (page_id, sha), None, 0
                if not kind:
                    mark = (first,)
                    continue
                revisit = len(payload) >= min_revisit and (mark is not None or copy > 0)
                data = page_record(page_id, url, payload, (mark[0] if mark else page_id) if revisit else None, revisit, copy + (mark is not None))
                copy += 1
                if s != shard or at["bytes"] >= roll_bytes:
                    if sink:
                        close()
                    number = number + 1 if s == shard else 0
                    shard, name = s, f"part-{s:06d}-{number:04d}.warc.gz"
                    at = {"name": name, "temp": f"_temporary/{attempt}-{name}", "shard": s, "records": 0, "bytes": 0, "sha256": hashlib.sha256(), "first_id": str(page_id)}
                    sink = fs.open_output_stream(f"{root}/{at['temp']}", compression=None)
                    info = _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_urn(None, name, 0)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    sink.write(info)
                    at["bytes"] += len(info)
                    at["sha256"].update(info)
                sink.write(data)
                at["sha256"].update(data)
                at |= {"records": at["records"] + 1, "bytes": at["bytes"] + len(data), "last_id": str(page_id)}
        if sink:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("temp", pa.string()), ("shard", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_id", pa.string()), ("last_id", pa.string())]))

    return run


def _mover(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for temp, name in zip(batch["temp"], batch["name"], strict=True):
                if fs.get_file_info(f"{root}/{temp}").type == pafs.FileType.NotFound:
                    if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.NotFound:
                        raise FileNotFoundError(f"{root}/{temp}")
                else:
                    fs.move(f"{root}/{temp}", f"{root}/{name}")
            yield batch[["name"]]

    return run


def shard_starts(narrow: DataFrame, shard_bytes: int) -> list[tuple[int | None, str]]:
    """The (page id, digest) at which each shard but the first starts, in order (null ids first): shards of about
    ``shard_bytes``, one more than are returned. narrow: (page_id, sha, n)."""
    order = [F.col("page_id").asc_nulls_first(), F.col("sha")]
    laid = narrow.groupBy("page_id", "sha").agg(F.sum(F.col("n") + HEAD_BYTES).alias("n"))
    laid = staged(laid.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "payload-order")
    sums = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    if not total:
        return []
    shards = max(MIN_SHARDS, -(-total // shard_bytes))
    running = F.sum("n").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(laid.sparkSession.createDataFrame(before, "part int, before long"))
    at = laid.join(offsets, "part").withColumn("at", F.col("before") + F.coalesce(running, F.lit(0)))
    shard = F.floor(F.col("at").cast("decimal(30,0)") * shards / total)
    firsts = at.groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("page_id").isNotNull().alias("own"), "page_id", "sha")).alias("first"))
    return [(r["first"]["page_id"], r["first"]["sha"]) for r in firsts.where("shard > 0").orderBy("shard").collect()]


def shard_of(spark: SparkSession, starts: list[tuple[int | None, str]]):
    """The shard of (page_id, sha), a binary search in the broadcast starts."""
    least = -(1 << 63)
    held = spark.sparkContext.broadcast((np.array([least if i is None else i for i, _ in starts], np.int64), [s for _, s in starts]))

    @F.pandas_udf("int")
    def run(page_id: pd.Series, sha: pd.Series) -> pd.Series:
        ids, digests = held.value
        of = page_id.to_numpy()
        low, high = np.searchsorted(ids, of, "left"), np.searchsorted(ids, of, "right")
        for k in np.flatnonzero(low < high):  # a shard starts within this id
            low[k] = bisect.bisect_right(digests, sha.iloc[k], low[k], high[k])
        return pd.Series(low.astype(np.int32))

    return run(F.coalesce("page_id", F.lit(least)), F.col("sha"))


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> list[dict]:
    """Writes every row as a record of WARC files in ``folder`` (a URI) and returns the manifest.

    A null payload is empty. Of records with equal payloads of ``min_revisit_bytes`` or more the one
    with the smallest page id (null ids last) is a response, the others revisit it; of repeated rows
    the first is. Rows of one id are ordered by digest, then url. Very long payloads are records like
    others. Other columns, whatever their names, are not read. An empty table leaves a manifest without
    files.
    """
    spark = pages.sparkSession
    text_batches(spark)
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    narrow = staged(rows.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")), "payloads")
    firsts = narrow.groupBy("sha").agg(F.min("page_id").alias("first"), F.max("n").alias("n"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    marks = join_groups(narrow, firsts, ["sha", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "sha", "first").distinct()
    starts = shard_starts(narrow, shard_bytes)
    tagged = rows.select("page_id", F.sha1("payload").alias("sha"), F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).unionByName(
        marks.select("page_id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "first")
    )
    ordered = (
        tagged.withColumn("shard", shard_of(spark, starts)).select("shard", "page_id", "sha", "kind", "url", "payload", "first")
        .repartitionById(len(starts) + 1, "shard").sortWithinPartitions("shard", "page_id", "sha", "kind", "url")
    )
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    files = sorted((r.asDict() for r in ordered.mapInArrow(_writer(folder, roll_bytes, min_revisit_bytes), _MANIFEST).collect()), key=lambda f: f["name"])
    if files:
        moves = spark.createDataFrame([(f["temp"], f["name"]) for f in files], "temp string, name string").repartition(min(len(files), 1000))
        moves.mapInPandas(_mover(folder), "name string").write.format("noop").mode("overwrite").save()
    for f in files:
        del f["temp"]
    with fs.open_output_stream(f"{root}/_temporary/manifest.json") as out:
        out.write(json.dumps({"files": files}, indent=1).encode())
    fs.move(f"{root}/_temporary/manifest.json", f"{root}/manifest.json")
    fs.delete_dir(f"{root}/_temporary")
    return files


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an uncompressed WARC stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or headers.get("warc-block-digest") != "sha1:" + base32_sha1(block):
            raise ValueError(f"a damaged record: {headers.get('warc-record-id')}")
        yield headers, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each page record of the files that the folder's manifest names: page_id, url,
    record_type, refers_to, payload_bytes, payload_digest, record_id and, with ``payloads``, the
    payload (null for revisits). Files are read as streams, one record at a time; digests are checked."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder)
        kept = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", *["payload"] * payloads]
        for batch in batches:
            for name in batch["name"]:
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for h, block in records(stream):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)^content-length:\s*(\d+)", http, re.MULTILINE)[1])
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        rows.append((number("warc-page-id"), h.get("warc-target-uri"), h["warc-type"], number("warc-refers-to-page-id"), size, h["warc-payload-digest"].removeprefix("sha1:"), h["warc-record-id"], *[payload if h["warc-type"] == "response" else None] * payloads))
                        held += len(block)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield _frame(rows, kept)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, kept)

    kind = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string" + ", payload binary" * payloads
    listed = spark.createDataFrame([(n,) for n in names], "name string")
    return listed.repartition(max(1, min(len(names), 100_000))).mapInPandas(run, kind)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: writes every row of ``pages`` to WARC files and reads them back."""
    folder = f"{shared_dir(spark)}/quillon/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder if "://" in folder else f"file://{folder}")
    return read_warc(spark, folder if "://" in folder else f"file://{folder}", payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP3_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d),
v AS (SELECT *, list_transform(range(8), lambda g: ('0x' || substr(h, 5 * g + 1, 5))::BIGINT) AS vs FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(vs, lambda x: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM v
"""
