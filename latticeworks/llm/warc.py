"""Deterministic sharded WARC writer and reader.

Pages are range-sorted by id into shards of about equal payload bytes, one task
each; the ids between them are quantiles of all ids or, beyond ``SAMPLE``, of
those with certain hashes, so equal input gives equal files. Within a shard
records are written in order as gzip members, and a file is rolled when its
compressed size reaches the target. Headers are made anew from the payload:
record id, length, block and payload digests. Of records with equal payloads
of at least ``revisit_from`` bytes, the one with the largest page id is the
response and the others revisit it, without a payload (which then isn't sent
to the shard's task either).

A task writes under a temporary name that holds its attempt, renames the file
when it is complete, and returns a manifest row. The manifest is written last
and names the files that count, so what a lost or repeated task leaves behind
is never read. Manifests are numbered, and a number is committed by a rename
that fails where it exists; a further write to a path commits the next one,
which names the files of all writes, each write's pages being deduplicated
among themselves. Files go to the session's shared folder through Arrow's file
systems.

Defined cases: null and empty html is an empty payload; a null url is written
as ``about:blank``; a page id may repeat: rows of the largest id that also
repeat the payload are one response and revisits of it; a null page id sorts
first and is written as ``-``, and is a response only if all equal payloads
have null ids, each of them then being one; extra columns are ignored; an
empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fs, cut, discard, fresh_path, join_small

#: Compressed size at which a file is rolled, and payload bytes of a shard.
ROLL, SHARD = 64 << 20, 32 << 20
#: Ids that quantiles are taken of, at most, and for each shard where there are many.
SAMPLE, PER_SHARD = 100_000, 32
#: Times that a manifest's commit is tried when other writers are first.
TRIES = 100
#: Repeated digests that may be broadcast (64 bytes each); beyond, the join shuffles.
BROADCAST_DIGESTS = 100_000
#: A fixed date keeps the files equal from run to run.
DATE = "2024-01-01T00:00:00Z"
WRITTEN = "shard long, part int, file string, records long, bytes long, sha256 string"
MANIFEST = f"{WRITTEN}, write int"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, length: int, sha: str, refers_to: int | None, refer_url: str | None = None) -> bytes:
    """One record; with ``refers_to`` a revisit, which has no block."""
    revisit = refers_to is not None
    block = b"" if revisit else payload

    def name(i: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{sha}')}>"

    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-ID: {'-' if page_id is None else page_id}",
        f"X-Payload-Length: {length}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        head.append("Content-Type: text/html; charset=utf-8")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without time or name, so that equal records are equal bytes."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def members(raw: Iterator[bytes]) -> Iterator[bytes]:
    """Uncompressed members of a stream of gzip bytes."""
    d = None
    out: list[bytes] = []
    for chunk in raw:
        while chunk:
            if d is None:
                d = zlib.decompressobj(31)
            out.append(d.decompress(chunk))
            chunk = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = None, []


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return fields, rest[: int(fields["Content-Length"])]


def with_roles(pages: DataFrame, revisit_from: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Rows (page_id, url, payload, length, sha, response_id); response_id where others have the payload.

    Payloads themselves don't travel: only digests are grouped, and only those that repeat are joined."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("length", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    same = F.when(F.col("length") >= revisit_from, F.sha2("payload", 256))
    digests = p.select("page_id", same.alias("_same")).where("_same IS NOT NULL")
    top = digests.groupBy("_same").agg(F.max("page_id").alias("response_id"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return join_small(p.withColumn("_same", same), cut(top, "repeated"), "_same", "left", BROADCAST_DIGESTS).drop("_same")


def shard_bounds(rows: DataFrame, target: int, most: int = SAMPLE) -> list[int]:
    """Least page id of every shard but the first: about ``target`` bytes of ``rows`` (page_id, length) lie between two."""
    n, size = rows.agg(F.count("page_id"), F.sum("length")).first()
    if not n or (size or 0) <= target:
        return []
    every = max(1, -(-n // max(most, PER_SHARD * (size // target + 1))))
    some = rows.where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0))
    ids = some.groupBy("page_id").agg(F.sum("length").alias("n")).orderBy("page_id").collect()  # about n / every
    out, size = [], 0
    for r in ids:
        if size >= target:
            out.append(r["page_id"])
            size = 0
        size += r["n"] * every
    return out


def commit(spark: SparkSession, path: str, written: DataFrame) -> DataFrame:
    """The next manifest: the files of the last one and those written."""
    jvm, hadoop = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    files = hadoop(path).getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(hadoop(path)).toUri(), conf)
    none = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files.mkdirs(hadoop(path))
    for _ in range(TRIES):
        last = versions(spark, path)[-1:]
        number = (last[0] if last else 0) + 1
        every = written.withColumn("write", F.lit(number))
        if last:
            every = manifest(spark, path, last[0]).drop("path").unionByName(every)
        temporary, final = f"{path}/_manifest.tmp-{uuid.uuid4().hex}", f"{path}/manifest-{number:010d}"
        every.coalesce(1).write.parquet(temporary)
        try:
            context.rename(files.makeQualified(hadoop(temporary)), files.makeQualified(hadoop(final)), none)
        except Exception:
            files.delete(hadoop(temporary), True)
            if files.exists(hadoop(final)):  # another writer was first
                continue
            raise
        return manifest(spark, path, number)
    raise OSError(f"{TRIES} manifests of {path} were committed by others first")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the manifests committed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n[9:]) for n in names if n.startswith("manifest-"))


def manifest(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest-{number:010d}").withColumn("path", F.lit(path))


def write(pages: DataFrame, path: str | None = None, revisit_from: int = 0, roll: int = ROLL, shard: int = SHARD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; the committed manifest, one row for each file of the path."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    rows = with_roles(pages, revisit_from, id_col, url_col, html_col)
    sizes = cut(pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.octet_length(html_col), F.lit(0)).cast("long").alias("length")), "sizes")
    bounds = shard_bounds(sizes, shard)
    discard(sizes)
    n = len(bounds) + 1
    which = F.lit(0)
    if bounds:
        which = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("page_id"))) if n <= 64 else _bisect(bounds)
    rows = rows.withColumn("shard", F.when(F.col("page_id").isNull(), F.lit(0)).otherwise(which).cast("long"))
    # a revisit's payload isn't written
    rows = rows.withColumn("payload", F.when(F.col("response_id").isNull() | (F.col("page_id") == F.col("response_id")), F.col("payload")))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_fs(path)
        fs.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        state: dict = {"shard": None, "part": 0, "out": None}
        done: list[tuple] = []

        def close() -> None:
            if state["out"] is not None:
                state["out"].close()
                file = f"shard-{state['shard']:06d}-{state['part']:04d}-{attempt}.warc.gz"
                fs.move(f"{root}/.{file}.tmp", f"{root}/{file}")
                done.append((state["shard"], state["part"], file, state["records"], state["bytes"], state["hash"].hexdigest()))
                state["out"] = None
                state["part"] += 1

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != state["shard"]:
                    close()
                    state |= {"shard": r["shard"], "part": 0}
                if state["out"] is None:
                    state |= {"records": 0, "bytes": 0, "hash": hashlib.sha256(), "out": fs.open_output_stream(f"{root}/.shard-{state['shard']:06d}-{state['part']:04d}-{attempt}.warc.gz.tmp")}
                sha = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                # rows of one id and payload stand together; the first of them can be the response
                first = (r["page_id"], r["sha"]) != state.get("last")
                state["last"] = (r["page_id"], r["sha"])
                refers = None if first and r["page_id"] == r["response_id"] else r["response_id"]
                data = member(record(r["page_id"], r["url"], r["payload"] or b"", r["length"], sha, refers))
                state["out"].write(data)
                state["hash"].update(data)
                state["records"] += 1
                state["bytes"] += len(data)
                if state["bytes"] >= roll:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["shard", "part", "file", "records", "bytes", "sha256"]).cast(
                pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
            )

    placed = rows.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions(F.col("shard"), F.col("page_id").asc_nulls_first(), "sha", "url")
    written = cut(placed.mapInArrow(store, WRITTEN), "written")
    done = commit(spark, path, written)
    discard(written)
    return done


def _bisect(bounds: list[int]):
    import numpy as np
    import pandas as pd

    held = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def which(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, ids.fillna(held[0] - 1).to_numpy(np.int64), side="right"))

    return which(F.col("page_id"))


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the manifest's files; each payload is checked against its digest."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, root = arrow_fs(f["path"])
                out: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/{f['file']}", compression=None) as stream:
                    for data in members(iter(lambda s=stream: s.read(1 << 20), b"")):
                        h, block = parse(data)
                        sha = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = h["WARC-Type"]
                        if kind == "response" and digest(block) != sha:
                            raise ValueError(f"{f['file']}: payload differs from its digest")
                        page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page")
                        row = (None if page == "-" else int(page), int(h["X-Payload-Length"]), sha, kind, None if refers is None else int(refers), h["WARC-Target-URI"])
                        out.append((*row, block) if with_payload else row)
                        size += len(block) if with_payload else 0
                        if len(out) >= 5000 or size > 8 << 20:
                            yield _records(out, with_payload)
                            out, size = [], 0
                if out:
                    yield _records(out, with_payload)

    schema = READ + (", payload binary" if with_payload else "")
    spread = manifest.select("path", "file").repartition(max(1, manifest.count()), "file")
    return spread.mapInArrow(load, schema)


def _records(out: list[tuple], with_payload: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
