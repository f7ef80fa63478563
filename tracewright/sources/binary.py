"""Instrument files as a Spark data source, and writers for files of binary formats.

``register(spark)`` adds the source ``tracefiles``::

    spark.read.format("tracefiles").load(folder)                                       # one row a trace (formats.TRACE)
    spark.read.format("tracefiles").schema("path string, name string").load(folder)    # only these columns are made
    spark.read.format("tracefiles").option("rows", "samples").load(folder)             # one row a sample (SAMPLE)
    traces.write.format("tracefiles").option("format", "netcdf").mode("append").save(folder)

A partition takes whole files, small ones together. Filters on ``path`` leave out files before they are opened. Folders are reached through ``pyarrow.fs`` (local, S3, GCS, HDFS with libhdfs).
"""

from __future__ import annotations

import base64
import io
import os
import posixpath
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import formats

SAMPLE = "path string, trace_no int, name string, x double, y double, format string"
#: Files of at most so many bytes in all share a partition, each counted as FILE_BYTES more: small files take as long as they are many,
#: and packed text (XLSX) takes some seconds a MB.
TASK_BYTES = 4 << 20
FILE_BYTES = 4096
#: A folder that would come to more partitions than this gets larger ones.
MOST_TASKS = 20_000
ROWS_A_BATCH = 65_536


# Writers


def netcdf(x: np.ndarray, y: np.ndarray, name: str = "", y_unit: str = "", x_unit: str = "minutes") -> bytes:
    """A classic netCDF file (CDF-1) with a chromatogram: ordinates and the place of each."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    word = lambda s: struct.pack(">I", len(s.encode("latin-1", "replace"))) + pad(s.encode("latin-1", "replace"))
    attribute = lambda key, text: word(key) + struct.pack(">I", 2) + word(text)
    top = {k: v for k, v in (("retention_unit", x_unit), ("detector_name", name), ("detector_unit", y_unit)) if v}
    dims = struct.pack(">II", 10, 1) + word("point_number") + struct.pack(">I", len(y))
    head = b"CDF\x01" + struct.pack(">I", 0) + dims + struct.pack(">II", 12, len(top)) + b"".join(attribute(k, v) for k, v in top.items())
    arrays = {"ordinate_values": y, "raw_data_retention": x}

    def variables(at: int) -> bytes:
        out = struct.pack(">II", 11, len(arrays))
        for key, values in arrays.items():
            out += word(key) + struct.pack(">IIIIIII", 1, 0, 0, 0, 6, 8 * len(values), at)
            at += 8 * len(values)
        return out

    return head + variables(len(head) + len(variables(0))) + b"".join(np.asarray(v, ">f8").tobytes() for v in arrays.values())


def mzml(x: np.ndarray, y: np.ndarray, name: str = "", y_unit: str = "", x_unit: str = "minute") -> bytes:
    """An mzML file with one chromatogram, its arrays compressed."""

    def array(values: np.ndarray, kind: str, unit: str = "") -> str:
        text = base64.b64encode(zlib.compress(np.asarray(values, "<f8").tobytes())).decode()
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="MS:1000574"/><cvParam accession="{kind}"{unit}/><binary>{text}</binary></binaryDataArray>'

    unit = ' unitAccession="UO:0000031"' if x_unit == "minute" else ' unitAccession="UO:0000010"'
    body = f'<chromatogram id={quoteattr(name)}><cvParam accession="MS:1000235"/><binaryDataArrayList>{array(x, "MS:1000595", unit)}{array(y, "MS:1000515")}</binaryDataArrayList></chromatogram>'
    return f'<?xml version="1.0" encoding="utf-8"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><chromatogramList>{body}</chromatogramList></run></mzML>'.encode()


def xlsx(x: np.ndarray, y: np.ndarray, name: str = "Signal", y_unit: str = "mAU", x_unit: str = "min") -> bytes:
    """A workbook whose one sheet has a column of times and one of values."""
    text = lambda at, s: f'<c r="{at}" t="inlineStr"><is><t>{escape(s)}</t></is></c>'
    rows = [f'<row r="1">{text("A1", f"Time ({x_unit})")}{text("B1", f"{name} ({y_unit})")}</row>']
    rows += [f'<row r="{k}"><c r="A{k}"><v>{a!r}</v></c><c r="B{k}"><v>{b!r}</v></c></row>' for k, (a, b) in enumerate(zip(np.asarray(x, float).tolist(), np.asarray(y, float).tolist()), 2)]
    space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{main}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for part, content in parts.items():
            book.writestr(zipfile.ZipInfo(part), f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>{content}', zipfile.ZIP_DEFLATED)
    return out.getvalue()


def channel(x: np.ndarray, y: np.ndarray, name: str = "", y_unit: str = "", version: str = "179") -> bytes:
    """A channel file: 179 has doubles, 130 has runs of whole-number differences. Places go evenly from the first to the last of ``x``
    (minutes)."""
    head = bytearray(6144)
    head[0] = len(version)
    head[1 : 1 + len(version)] = version.encode()
    ends = (60000 * float(x[0]), 60000 * float(x[-1])) if len(x) else (0.0, 0.0)
    struct.pack_into(">ff", head, 282, *ends)
    struct.pack_into(">d", head, 4732, 1.0)
    if version == "179":
        return bytes(head) + np.asarray(y, "<f8").tobytes()
    if version != "130":
        raise ValueError(f"no writer for version {version}")
    body, last = b"", 0
    whole = np.rint(np.asarray(y, float)).astype(np.int64).tolist()
    for at in range(0, len(whole), 255):
        run = whole[at : at + 255]
        body += struct.pack(">BB", 0x10, len(run))
        for v in run:
            d = v - last
            body += struct.pack(">h", d) if -32768 < d < 32768 else struct.pack(">hi", -32768, v)
            last = v
    return bytes(head) + body


WRITERS: dict[str, tuple[Callable[..., bytes], str]] = {"netcdf": (netcdf, "cdf"), "mzml": (mzml, "mzML"), "xlsx": (xlsx, "xlsx"), "agilent-ch": (channel, "ch")}


# The data source


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


_MEETS: dict[type, Callable] = {
    EqualTo: lambda path, v: path == v, In: lambda path, v: path in v, StringStartsWith: lambda path, v: path.startswith(v),
    StringEndsWith: lambda path, v: path.endswith(v), StringContains: lambda path, v: v in path,
}


class TraceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.root, self.format, self.samples = options["path"], options.get("format"), options.get("rows") == "samples"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.schema = to_arrow_schema(schema)
        self.wanted: list[tuple[Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  Spark's name
        """Takes filters on the path; Spark applies all others."""
        for f in filters:
            if type(f) in _MEETS and f.attribute == ("path",):
                self.wanted.append((_MEETS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = _filesystem(self.root)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        found = sorted((i.path, i.size or 0) for i in listed if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path.removeprefix(root).split("/") if p))
        kept = [(path, size + FILE_BYTES) for path, size in found if all(meets(path, v) for meets, v in self.wanted)]
        room = max(self.task_bytes, sum(size for _, size in kept) // MOST_TASKS)
        out: list[Files] = []
        taken = 0
        for path, size in kept:
            if not out or taken + size > room:
                out.append(Files([]))
                taken = 0
            out[-1].paths.append(path)
            taken += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = _filesystem(self.root)
        for path in partition.paths:
            with files.open_input_stream(path, compression=None) as f:
                got = formats.parse_file(f.read(), path, self.format)
            shared = {"path": path, "format": got["format"], "warnings": got["warnings"], "error": got["error"]}
            for no, trace in enumerate(got["traces"] or [{}]):
                whole = {"peaks": [], "events": []} | trace | shared | {"trace_no": no} if trace else shared | {"trace_no": no}
                if not self.samples:
                    yield self._batch(1, lambda name: [list(v.items()) if isinstance(v := whole.get(name), dict) else v])
                    continue
                n = len(whole.get("x", []))
                for at in range(0, n, ROWS_A_BATCH):
                    rows = min(ROWS_A_BATCH, n - at)
                    yield self._batch(rows, lambda name: whole[name][at : at + rows] if name in ("x", "y") else [whole.get(name)] * rows)

    def _batch(self, n: int, values: Callable) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values(f.name), f.type) for f in self.schema], schema=self.schema)


@dataclass
class Wrote(WriterCommitMessage):
    files: int


class TraceWriter(DataSourceArrowWriter):
    """Writes a file for each row, named by its ``path`` in the folder. A file gets its name when it is complete, by its task; a task
    that runs again writes the same file."""

    def __init__(self, schema: StructType, options: dict):
        self.root, self.format = options["path"], options.get("format", "netcdf")
        if self.format not in WRITERS:
            raise ValueError(f"formats that can be written: {', '.join(WRITERS)}")
        if missing := {"path", "x", "y"} - set(schema.names):
            raise ValueError(f"rows lack {', '.join(sorted(missing))}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        files, root = _filesystem(self.root)
        encode, extension = WRITERS[self.format]
        count = 0
        for batch in batches:
            for row in batch.to_pylist():
                name = posixpath.normpath(row["path"])
                if name.startswith(("/", "..")):
                    raise ValueError(f"{row['path']} isn't within the folder")
                target = f"{root}/{name}" if name.endswith(f".{extension}") else f"{root}/{name}.{extension}"
                files.create_dir(posixpath.dirname(target), recursive=True)
                held = f"{posixpath.dirname(target)}/.{uuid.uuid4().hex}"
                said = {k: row[k] for k in ("name", "y_unit") if row.get(k) is not None}
                with files.open_output_stream(held, compression=None) as f:
                    f.write(encode(np.array(row["x"] or [], float), np.array(row["y"] or [], float), **said))
                files.move(held, target)
                count += 1
        return Wrote(count)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class TraceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tracefiles"

    def schema(self) -> str:
        return SAMPLE if self.options.get("rows") == "samples" else formats.TRACE

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TraceWriter:
        if overwrite:
            raise ValueError("files are added, not replaced: write in mode append")
        return TraceWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Adds the source to a session, and lets Spark hand filters to sources written in Python, as this one asks for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceFiles)
