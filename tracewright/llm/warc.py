"""Deterministic sharded WARC archives.

Records are range-sorted into shards whose bounds follow from the data alone, so any run over the same rows writes the
same files. Every record is a gzip member of its own with regenerated headers and digests; a shard rolls to a new file
when the present one reaches ``roll_bytes`` compressed. Tasks write under temporary names; the driver renames the files
of successful tasks (many at a time) and publishes them by a manifest, itself renamed into place. Each write is a
generation with file names and a manifest of its own, so appending leaves earlier records as they are, and overwriting
hides them. Readers open only what manifests list: a task that ran twice, or died, leaves nothing visible.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import attach, settled, shared_dir, table

MIN_REVISIT = 100
SHARD_BYTES = 32 << 20
ROLL_BYTES = 64 << 20
#: Shards that the default size aims at where SHARD_BYTES would give more; a size that is given always holds.
MOST_SHARDS = 50_000
GZIP_LEVEL = 4
DATE = "2020-01-01T00:00:00Z"
MANIFEST = re.compile(r"manifest-(\d{6})\.jsonl")
RECORD = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, shard int"
READ = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string"


def _split(df: DataFrame, key: str, weight: str, low: int, high: int, total: int, target: int) -> list[tuple[int, int, int]]:
    """(start, end, weight) of ranges of ``key`` within [low, high], in order. Ranges heavier than ``target`` are split
    further, till they hold one key only: each into at least 256 parts, so a few jobs do for any skew of the keys."""
    done: list[tuple[int, int, int]] = []
    todo = [(low, high, total)]
    while todo:
        bounds = sorted(todo)
        step = {a: max(-(-(b - a + 1) // max(256, 2 * w // target)), 1) for a, b, w in bounds}
        picked = []
        for group in (bounds[i : i + 400] for i in range(0, len(bounds), 400)):
            cell = F.lit(None).cast("bigint")
            for a, b, _ in reversed(group):
                cell = F.when(F.col(key).between(a, b), F.col(key) - F.pmod(F.col(key) - a, F.lit(step[a]))).otherwise(cell)
            picked += df.select(cell.alias("cell"), weight).filter("cell is not null").groupBy("cell").agg(F.sum(weight)).collect()
        firsts = [a for a, _, _ in bounds]
        todo = []
        for cell, held in picked:
            a, b, _ = bounds[bisect_right(firsts, cell) - 1]
            end = min(cell + step[a] - 1, b)
            (todo if held > target and end > cell else done).append((cell, end, held))
    return sorted(done)


def shard_bounds(df: DataFrame, key: str, weight: str, target: int) -> tuple[list[int], dict[int, int]]:
    """First keys of the second and later ranges, and the keys that alone weigh more than ``target``, with the number of
    shards that each needs. Neighbouring ranges are joined up to about ``target`` of weight. What comes to the driver is
    a few numbers a shard."""
    low, high, total = df.filter(F.col(key).isNotNull()).agg(F.min(key), F.max(key), F.sum(weight)).first()
    if low is None:
        return [], {}
    bounds, held, heavy = [], 0, {}
    for start, end, w in _split(df, key, weight, low, high, total, max(target // 4, 1)):
        if start == end and w > target:
            heavy[start] = -(-w // target)
        if held and held + w > target:
            bounds.append(start)
            held = 0
        held += w
    return bounds, heavy


class Shards:
    """Which shard a record belongs to. Ranges of page_id have one each, or as many as their heavy id needs, whose rows
    are dealt by their digest; rows without an id are dealt over all shards by digest and url."""

    def __init__(self, bounds: list[int], heavy: dict[int, int]):
        self.bounds, self.heavy = np.array(bounds, np.int64), heavy
        width = np.ones(len(bounds) + 1, np.int64)
        for key, n in heavy.items():
            at = int(np.searchsorted(self.bounds, key, "right"))
            width[at] = max(width[at], n)
        self.first = np.append(0, np.cumsum(width))
        self.n = int(self.first[-1])

    def of(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
        out = self.first[np.searchsorted(self.bounds, numbers, "right")]
        for key, n in self.heavy.items():
            own = known & (numbers == key)
            out[own] += hashes[own] % n
        out[~known] = hashes[~known] % self.n
        return out


def records(pages: DataFrame, shard_bytes: int | None = None) -> DataFrame:
    """WARC records of ``pages`` (page_id, url, html), partitioned and sorted by shard and page_id; columns as in RECORD.

    A null html is empty, a null url too. Of equal payloads of at least MIN_REVISIT bytes, the smallest page_id is the
    response and the others revisit it; smaller payloads, and rows without a page_id, are all responses. Of rows that
    repeat that smallest page_id, all are responses. Rows without a page_id, and those of an id that outweighs a shard,
    are dealt over shards by their digest (so only rows equal in all columns can't be parted).
    ``shard_bytes``: SHARD_BYTES if not given, or what MOST_SHARDS shards hold each, if that is more.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    base = pages.select(
        F.col("page_id").cast("long"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_digest"),
    )
    light = settled(base.select("page_id", "payload_bytes", "payload_digest"))
    large = light.filter((F.col("payload_bytes") >= MIN_REVISIT) & F.col("page_id").isNotNull())
    copies = large.groupBy("payload_digest").agg(F.count("*").alias("copies"), F.min("page_id").alias("first"))
    copies = settled(copies.filter("copies > 1"))
    copied = settled(attach(large.select("page_id", "payload_digest"), copies, "payload_digest", "copies"))
    revisits = copied.filter("page_id > first").select("page_id", "payload_digest", "first").distinct()
    if shard_bytes is None:
        shard_bytes = max(SHARD_BYTES, (light.agg(F.sum("payload_bytes")).first()[0] or 0) // MOST_SHARDS)
    shards = Shards(*shard_bounds(light, "page_id", "payload_bytes", shard_bytes))

    @F.arrow_udf("int")
    def shard_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(shards.of(ids, hashes.to_numpy(zero_copy_only=False)).astype(np.int32))

    # a note on each revisit travels with the records and is sorted to their front, so payloads are shuffled once
    nothing = F.lit(None)
    notes = revisits.select("page_id", nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), nothing.cast("long").alias("payload_bytes"), "payload_digest", F.col("first").alias("refers_to"))
    dealt = F.pmod(F.when(F.col("page_id").isNull(), F.xxhash64("payload_digest", "url")).otherwise(F.xxhash64("payload_digest")), F.lit(1 << 40))
    both = base.withColumn("refers_to", nothing.cast("long")).unionByName(notes).withColumn("shard", shard_of("page_id", dealt))
    order = ["shard", "page_id", "payload_digest", F.col("refers_to").asc_nulls_last(), "url"]
    return both.repartitionByRange(shards.n, "shard").sortWithinPartitions(*order).mapInArrow(_apply_notes, RECORD)


def _apply_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes the notes out of sorted records and turns the records that they name into revisits."""
    note, first = None, None
    for batch in batches:
        notes = batch.column("refers_to").is_valid().to_pylist()
        ids, digests = batch.column("page_id").to_pylist(), batch.column("payload_digest").to_pylist()
        refers: list[int | None] = []
        for k, is_note in enumerate(notes):
            if is_note:
                note, first = (ids[k], digests[k]), batch.column("refers_to")[k].as_py()
            refers.append(first if (ids[k], digests[k]) == note else None)
        refers_to = pa.array(refers, pa.int64())
        plain = refers_to.is_null()
        kinds = pc.if_else(plain, "response", "revisit")
        payload = pc.if_else(plain, batch.column("payload"), pa.scalar(None, batch.column("payload").type))
        out = [batch.column("page_id"), batch.column("url"), payload, batch.column("payload_bytes"), batch.column("payload_digest"), kinds, refers_to, batch.column("shard")]
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "shard"]
        yield pa.RecordBatch.from_arrays(out, names=names).filter(pc.invert(pa.array(notes, pa.bool_())))


def _record_id(generation: int, page_id: int | None, url: str, digest: str, copy: int = 0) -> str:
    """An id that no other record of the archive has: ``copy`` numbers the records of a generation with the same id and
    digest (and url, where there is no id). Copy 0 of an id is what revisits refer to."""
    name = f"{generation}:{url if page_id is None else page_id}:{page_id is None}:{digest}:{copy}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _clean(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def format_record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None, generation: int = 0, copy: int = 0) -> bytes:
    """One WARC/1.1 record, its headers and digests made anew. A revisit keeps the HTTP headers without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(generation, page_id, url, digest, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_record_id(generation, refers_to, '', digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """The reader's row of a record, without the file; digests are computed again where the payload is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't match")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't match")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return number("X-Page-Id"), fields["WARC-Target-URI"], payload if kind == "response" else None, size, digest, kind, number("X-Refers-To-Page-Id")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _gzip(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _manifests(files: fs.FileSystem, root: str) -> list[tuple[int, str]]:
    """Generations of an archive and their manifests, in order."""
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((int(m[1]), f.path) for f in found if (m := MANIFEST.fullmatch(f.base_name)))


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Takes rows of RECORD, sorted by shard and page_id. One writer at a time may add to an archive."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.roll, self.overwrite = options["path"], int(options.get("rollbytes", ROLL_BYTES)), overwrite
        self.job = uuid.uuid4().hex
        earlier = _manifests(*_filesystem(self.path))
        self.generation = earlier[-1][0] + 1 if earlier else 0

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _filesystem(self.path)
        temporary = f"{root}/_temporary/{self.job}"
        files.create_dir(temporary, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        done: list[dict] = []
        out, now = None, {}
        last, copy = None, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append(now | {"sha256": now["sha256"].hexdigest()})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None or row["shard"] != now["shard"] or now["bytes"] >= self.roll:
                    close()
                    part = now["part"] + 1 if out is not None and row["shard"] == now["shard"] else 0
                    name = f"{self.generation:06d}-shard-{row['shard']:06d}-{part:05d}.warc.gz"
                    now = {"shard": row["shard"], "part": part, "name": name, "temporary": f"{name}.{attempt}", "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    out = files.open_output_stream(f"{temporary}/{now['temporary']}", compression=None)
                same = (row["page_id"], row["payload_digest"], row["url"] if row["page_id"] is None else "")
                copy = copy + 1 if same == last else 0
                last = same
                record = format_record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"], self.generation, copy)
                member = _gzip(record)
                out.write(member)
                now["sha256"].update(member)
                now["bytes"] += len(member)
                now["records"] += 1
        close()
        return Written(done)

    def commit(self, messages: list) -> None:
        """Renames the files of this generation, then publishes them; until the manifest has its name, none is visible."""
        files, root = _filesystem(self.path)
        temporary = f"{root}/_temporary/{self.job}"
        files.create_dir(root, recursive=True)
        if any(g >= self.generation for g, _ in _manifests(files, root)):
            self._clear(files, root)
            raise ValueError(f"another job has written to {self.path} meanwhile")
        done = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["shard"], f["part"]))
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda f: files.move(f"{temporary}/{f.pop('temporary')}", f"{root}/{f['name']}"), done))
        with files.open_output_stream(f"{root}/_manifest.{self.job}", compression=None) as out:
            out.write(json.dumps({"generation": self.generation, "replaces": self.overwrite, "files": len(done)}).encode() + b"\n")
            for f in done:
                out.write(json.dumps(f).encode() + b"\n")
        files.move(f"{root}/_manifest.{self.job}", f"{root}/manifest-{self.generation:06d}.jsonl")
        self._clear(files, root)

    def abort(self, messages: list) -> None:
        files, root = _filesystem(self.path)
        self._clear(files, root)

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_temporary/{self.job}")


@dataclass
class Archive(InputPartition):
    name: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Archive]:
        """One for each file that manifests list, from the last one that replaces what was there before."""
        files, root = _filesystem(self.path)
        found = _manifests(files, root)
        if not found:
            raise FileNotFoundError(f"{self.path} has no manifest")
        names: list[str] = []
        for _, path in reversed(found):
            with files.open_input_stream(path, compression=None) as f:
                head, *listed = [json.loads(line) for line in f.read().splitlines()]
            names = [x["name"] for x in listed] + names
            if head["replaces"]:
                break
        return [Archive(n) for n in names] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        rows, size = [], 0
        for data in self._members(partition.name) if partition.name else ():
            rows.append((*parse_record(data), partition.name))
            size += len(data)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def _members(self, name: str) -> Iterator[bytes]:
        """The file's gzip members, one at a time."""
        files, root = _filesystem(self.path)
        with files.open_input_stream(f"{root}/{name}", compression=None) as f:
            held = b""
            while True:
                unpack, parts = zlib.decompressobj(31), []
                while not unpack.eof:
                    held = held or f.read(1 << 20)
                    if not held:
                        if parts:
                            raise ValueError(f"{name} ends within a record")
                        return
                    parts.append(unpack.decompress(held))
                    held = unpack.unused_data
                yield b"".join(parts)


class WarcSource(DataSource):
    """``format("warc")``: writes rows of RECORD, reads rows of READ."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def write_archives(pages: DataFrame, path: str, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES, mode: str = "append") -> None:
    """Archives of ``pages`` under ``path``, and their manifest: added to what is there, or instead of it (``mode``
    "overwrite"; the old files stay, unlisted). Revisits refer to records of the same write. An empty table gives a
    manifest without files."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    records(pages, shard_bytes).write.format("warc").mode(mode).option("path", path).option("rollBytes", roll_bytes).save()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).load()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> f THEN f END AS refers_to
FROM r
"""
