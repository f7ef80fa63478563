"""Project documents (JSON with traces, peaks, a method and a calibration): versions, checks, and tables of their parts."""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lz
from ..operators.calibration import MODELS, WEIGHTINGS
from ..operators.integration import MODES

VERSION = 2
PARTS = "path string, version int, trace_id string, name string, x array<double>, y array<double>, peaks array<struct<peak_no:int,start:double,apex:double,end:double,mode:string,label:string>>, errors array<string>, warnings array<string>"


UNSAFE_KEYS = {"__proto__", "prototype", "constructor"}
DEPTH = 64


def _depth(v) -> int:
    """How deep a JSON value nests, without recursion."""
    deepest, todo = 0, [(v, 0)]
    while todo:
        v, depth = todo.pop()
        deepest = max(deepest, depth)
        if isinstance(v, (dict, list)) and depth <= DEPTH:
            todo += [(x, depth + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def migrate(project: dict) -> dict:
    """The document as of VERSION: before that, peaks had no mode and meant their own chord. Later versions stay. What isn't of
    the right kind stays as it is; ValueError for a document that nests deeper than DEPTH or is no object."""
    if not isinstance(project, dict):
        raise ValueError("the document is no object")
    if _depth(project) > DEPTH:
        raise ValueError("the document nests too deeply")
    out = json.loads(json.dumps(project))
    if (_finite(out.get("version")) or 1) >= VERSION:
        return out
    for trace in _list(out.get("traces")):
        for peak in _list(trace.get("peaks")) if isinstance(trace, dict) else []:
            if isinstance(peak, dict):
                peak.setdefault("clip", "valley")
    settings = out.setdefault("settings", {})
    if isinstance(settings, dict):
        settings.setdefault("clipDefault", "drop")
    out["version"] = VERSION
    return out


def stripped(v, depth: int = 0):
    """A JSON value without keys that only do harm in other programs; ValueError if it nests deeper than DEPTH."""
    if depth > DEPTH:
        raise ValueError("the document nests too deeply")
    if isinstance(v, dict):
        return {k: stripped(x, depth + 1) for k, x in v.items() if k not in UNSAFE_KEYS}
    return [stripped(x, depth + 1) for x in v] if isinstance(v, list) else v


def _finite(v) -> float | None:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return None
    try:
        v = float(v)
    except OverflowError:
        return None
    return v if math.isfinite(v) else None


def _list(v) -> list:
    return v if isinstance(v, list) else []


@dataclass(frozen=True)
class Lengths:
    """The longest texts that are taken over from untrusted documents: names, keys, notes and all others."""

    name: int = 200
    key: int = 64
    note: int = 20_000
    text: int = 1000


class _Walk:
    """Reads a document of unknown kinds. Every value comes out of the right kind; ``found`` has a pair (field, what was done)
    for each value that was dropped, replaced or shortened."""

    def __init__(self, lengths: Lengths):
        self.lengths, self.found = lengths, []

    def say(self, where: str, what: str) -> None:
        self.found.append((where, what))

    def text(self, v, where: str, most: int) -> str | None:
        if v is None:
            return None
        if isinstance(v, (dict, list)):
            return self.say(where, "no text")
        text = str(v)
        if len(text) > most:
            self.say(where, f"shortened from {len(text)} to {most} characters")
        return text[:most]

    def number(self, v, where: str, low: float = -math.inf, high: float = math.inf) -> float | None:
        n = _finite(v)
        if n is None:
            return self.say(where, "no finite number") if v is not None else None
        if not low <= n <= high:
            self.say(where, f"brought within {low:g} and {high:g}")
        return min(max(n, low), high)

    def choice(self, v, where: str, known, default=None):
        if isinstance(v, str) and v in known:
            return v
        if v is not None:
            self.say(where, "unknown value")
        return default

    def object(self, v, where: str, known: set[str] | None) -> dict:
        if not isinstance(v, dict):
            if v is not None:
                self.say(where, "no object")
            return {}
        for k in v:
            if known is not None and k not in known:
                self.say(f"{where}.{k[: self.lengths.key]}", "unsafe key" if k in UNSAFE_KEYS else "unknown key")
        return v

    def objects(self, v, where: str, known: set[str]) -> Iterator[tuple[str, dict]]:
        if v is not None and not isinstance(v, list):
            self.say(where, "no list")
        for k, item in enumerate(_list(v)):
            if isinstance(item, dict):
                yield f"{where}[{k}]", self.object(item, f"{where}[{k}]", known)
            else:
                self.say(f"{where}[{k}]", "no object")

    def numbers(self, v, where: str) -> list[float | None]:
        if not isinstance(v, list):
            self.say(where, "no list")
            return []
        out = [_finite(a) for a in v]
        if bad := sum(a is None and b is not None for a, b in zip(out, v)):
            self.say(where, f"{bad} values are no finite numbers")
        return out


LIMITS = {"window": (3, 1001), "order": (0, 10), "p": (1e-6, 0.5), "iterations": (1, 100), "lambda": (1, 1e12)}


def examined(project, lengths: Lengths = Lengths()) -> tuple[dict, list[tuple[str, str]]]:
    """A document of untrusted origin with values of the right kinds only, and what was done to get there: unknown keys and what
    can't be read are dropped, texts shortened to ``lengths``, numbers finite or null, x and y of one length, processing within its
    limits, modes and units of the calibration known ones. Any JSON value is taken; what is no document gives an empty one."""
    walk = _Walk(lengths)
    if not isinstance(project, dict):
        walk.say("", "no object")
        project = {}
    elif _depth(project) > DEPTH:
        walk.say("", "nests too deeply")
        project = {}
    raw = migrate(project)
    walk.object(raw, "", {"version", "traces", "settings", "notes", "calibration", "images"})
    if "version" in project and _finite(project["version"]) is None:
        walk.say("version", "no finite number")
    traces = []
    for k, (where, t) in enumerate(walk.objects(raw.get("traces"), "traces", {"id", "name", "x", "y", "xUnit", "yUnit", "meta", "peaks", "proc"})):
        x, y = (walk.numbers(t.get(c), f"{where}.{c}") for c in ("x", "y"))
        n = min(len(x), len(y))
        if len(x) != len(y):
            walk.say(where, f"x has {len(x)} values, y {len(y)}")
        meta = {}
        for key, value in walk.object(t.get("meta"), f"{where}.meta", None).items():
            if key in UNSAFE_KEYS:
                walk.say(f"{where}.meta.{key}", "unsafe key")
            elif (text := walk.text(value, f"{where}.meta.{key[: lengths.key]}", lengths.text)) is not None:
                meta[walk.text(key, f"{where}.meta", lengths.key)] = text
        peaks = []
        for at, p in walk.objects(t.get("peaks"), f"{where}.peaks", {"start", "apex", "end", "clip", "label", "manual"}):
            ends = [_finite(p.get(c)) for c in ("start", "apex", "end")]
            if None in ends or not ends[0] <= ends[1] <= ends[2]:
                walk.say(at, "bounds are missing or out of order")
                continue
            peaks.append({"start": ends[0], "apex": ends[1], "end": ends[2], "clip": walk.choice(p.get("clip"), f"{at}.clip", MODES), "label": walk.text(p.get("label"), f"{at}.label", lengths.name), "manual": p.get("manual") is True})
        proc = walk.object(t.get("proc"), f"{where}.proc", set(LIMITS))
        proc = {c: v for c, (a, b) in LIMITS.items() if (v := walk.number(proc.get(c), f"{where}.proc.{c}", a, b)) is not None}
        text = lambda key, most: walk.text(t.get(key), f"{where}.{key}", most)
        traces.append({
            "id": text("id", lengths.name) or str(k + 1), "name": text("name", lengths.name) or "", "x": x[:n], "y": y[:n], "xUnit": text("xUnit", lengths.key) or "min", "yUnit": text("yUnit", lengths.key),
            "meta": meta, "peaks": peaks, "proc": proc,
        })
    settings = walk.object(raw.get("settings"), "settings", {"clipDefault"})
    mode = walk.choice(settings.get("clipDefault"), "settings.clipDefault", MODES, "drop")
    out = {"version": VERSION, "traces": traces, "settings": {"clipDefault": mode}, "notes": walk.text(raw.get("notes"), "notes", lengths.note) or "", "calibration": _calibration(raw.get("calibration"), walk)}
    return out, walk.found


def sanitized(project: dict, lengths: Lengths = Lengths()) -> dict:
    """The document that ``examined`` gives; ValueError if it nests deeper than DEPTH."""
    if _depth(project) > DEPTH:
        raise ValueError("the document nests too deeply")
    return examined(project, lengths)[0]


def _calibration(cal, walk: _Walk) -> dict:
    cal = walk.object(cal, "calibration", {"unit", "analytes"})
    most, analytes = walk.lengths, []
    for k, (where, a) in enumerate(walk.objects(cal.get("analytes"), "calibration.analytes", {"id", "name", "peakMatch", "response", "model", "weighting", "levels"})):
        match = walk.object(a.get("peakMatch"), f"{where}.peakMatch", {"rt", "tol"})
        levels = []
        for at, v in walk.objects(a.get("levels"), f"{where}.levels", {"conc", "traceId", "response", "include"}):
            levels.append({"conc": walk.number(v.get("conc"), f"{at}.conc"), "traceId": walk.text(v.get("traceId"), f"{at}.traceId", most.name), "response": walk.number(v.get("response"), f"{at}.response"), "include": v.get("include", True) is not False})
        pick = lambda key, known: walk.choice(a.get(key), f"{where}.{key}", known, known[0])
        analytes.append({
            "id": walk.text(a.get("id"), f"{where}.id", most.name) or f"analyte{k + 1}", "name": walk.text(a.get("name"), f"{where}.name", most.name) or "",
            "peakMatch": {"rt": walk.number(match.get("rt"), f"{where}.peakMatch.rt"), "tol": walk.number(match.get("tol"), f"{where}.peakMatch.tol") or 0.1},
            "response": pick("response", ("area", "height")), "model": pick("model", MODELS), "weighting": pick("weighting", tuple(WEIGHTINGS)), "levels": levels,
        })
    return {"unit": walk.text(cal.get("unit"), "calibration.unit", most.key) or "", "analytes": analytes}


def calibration_of(project: dict) -> dict:
    """The calibration with defaults for what is missing, unknown or of another kind."""
    return _calibration(project.get("calibration") if isinstance(project, dict) else None, _Walk(Lengths()))


def examined_documents(files: DataFrame, lengths: Lengths = Lengths()) -> DataFrame:
    """path, document (JSON, as ``examined`` gives it) and findings (array of field, what) of each document (path, content). What is no
    JSON gives an empty document and says so."""
    kind = pa.list_(pa.struct([("field", pa.string()), ("what", pa.string())]))

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            documents, findings = [], []
            for content in batch.column(1).cast(pa.binary()).to_pylist():
                try:
                    document, found = examined(json.loads((content or b"").decode("utf-8-sig")), lengths)
                except (ValueError, RecursionError):
                    document, found = examined(None, lengths)[0], [("", "no JSON")]
                documents.append(json.dumps(document))
                findings.append([{"field": _plain(field), "what": what} for field, what in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(documents, pa.string()), pa.array(findings, kind)], names=["path", "document", "findings"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(examine, "path string, document string, findings array<struct<field:string,what:string>>")


def _plain(text: str | None) -> str | None:
    """A text that UTF-8 can hold: lone surrogates, which JSON can spell, become question marks."""
    return None if text is None else text.encode("utf-8", "replace").decode()


def problems(project: dict) -> tuple[list[str], list[str]]:
    """What makes a document unusable, and what only looks wrong."""
    errors, warnings = [], []
    if not isinstance(project, dict) or not isinstance(project.get("traces"), list):
        return ["no list of traces"], []
    version = project.get("version")
    if version is not None and _finite(version) is None:
        errors.append("the version is no number")
    elif (version or 1) > VERSION:
        warnings.append(f"version {version} is newer than {VERSION}")
    seen = set()
    for k, t in enumerate(project["traces"]):
        if not isinstance(t, dict):
            errors.append(f"trace {k + 1}: no object")
            continue
        where = f"trace {t.get('id') or k + 1}"
        x, y = t.get("x"), t.get("y")
        if not isinstance(x, list) or not isinstance(y, list):
            errors.append(f"{where}: x or y is missing")
            continue
        if len(x) != len(y):
            errors.append(f"{where}: x and y differ in length")
        odd = [v for v in (*x, *y) if v is not None and (isinstance(v, bool) or not isinstance(v, (int, float)))]
        if odd:
            errors.append(f"{where}: x or y has values that are no numbers")
        name = json.dumps(t.get("id"))
        if name in seen:
            errors.append(f"{where}: this id occurs twice")
        seen.add(name)
        if not odd and any(b is not None and a is not None and b < a for a, b in zip(x, x[1:])):
            warnings.append(f"{where}: x is not ascending")
        if t.get("peaks") is not None and not isinstance(t["peaks"], list):
            errors.append(f"{where}: no list of peaks")
        for p in _list(t.get("peaks")):
            ends = [_finite(p.get(f)) for f in ("start", "apex", "end")] if isinstance(p, dict) else [None]
            if None in ends or not ends[0] <= ends[1] <= ends[2]:
                errors.append(f"{where}: bounds of a peak are out of order")
            elif p.get("clip") is not None and p["clip"] not in MODES:
                warnings.append(f"{where}: unknown mode {p['clip']}")
    return errors, warnings


#: The rows of so many bytes of documents are handed out together.
BATCH_BYTES = 4 << 20


def project_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of read_projects() for batches of path and content."""
    names = ["path", "version", "trace_id", "name", "x", "y", "peaks", "errors", "warnings"]
    peak = pa.struct([("peak_no", pa.int32()), ("start", pa.float64()), ("apex", pa.float64()), ("end", pa.float64()), ("mode", pa.string()), ("label", pa.string())])
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(peak), pa.list_(pa.string()), pa.list_(pa.string())]

    said = lambda v: None if v is None else _plain(v if isinstance(v, str) else json.dumps(v))

    def rows(path: str, content: bytes) -> list[tuple]:
        try:
            raw = json.loads(content)
            errors, warnings = problems(raw)
            project = raw if errors else migrate(raw)
        except (ValueError, RecursionError) as e:
            errors, warnings = [f"not a project: {e}"], []
        if errors:
            return [(path, None, None, None, None, None, None, list(map(_plain, errors)), list(map(_plain, warnings)))]
        out = []
        for k, t in enumerate(project["traces"]):
            s = sorted(((a, b) for a, b in zip(map(_finite, t["x"]), map(_finite, t["y"])) if a is not None and b is not None), key=lambda v: v[0])
            peaks = [{"peak_no": i, "start": float(p["start"]), "apex": float(p["apex"]), "end": float(p["end"]), "mode": said(p.get("clip")), "label": said(p.get("label"))} for i, p in enumerate(_list(t.get("peaks")), 1)]
            out.append((path, int(project["version"]), said(t.get("id") or k + 1), said(t.get("name") or ""), [v[0] for v in s], [v[1] for v in s], peaks, [], list(map(_plain, warnings))))
        return out

    def made(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

    for batch in batches:
        got, size = [], 0
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            got += rows(path, content or b"")
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield from made(got)
                got, size = [], 0
        yield from made(got)


def read_projects(files: DataFrame) -> DataFrame:
    """A row for each trace of each document (path, content), columns as in PARTS; a document with errors has one row
    without a trace. Samples without a finite x and y are left out, and sorted by x."""
    return files.select(F.col("path").cast("string"), "content").mapInArrow(project_batches, PARTS)


LINK = re.compile(r"(?:.*#)?p=([A-Za-z0-9_+$-]+)=*\Z", re.DOTALL)
#: A shared document unpacks to this many bytes at most.
LINK_BYTES = 64 << 20


def pack_link(project: dict, codec: str = "zlib") -> str:
    """A project as a short text for a link: JSON without images, compressed, in url-safe characters. ``codec`` is "zlib", or "lz" for
    what browsers' share links use."""
    slim = {k: v for k, v in project.items() if k != "images"}
    if codec == "lz":
        return "p=" + lz.compress(json.dumps(slim, separators=(",", ":"), sort_keys=True, ensure_ascii=False))
    packed = zlib.compress(json.dumps(slim, separators=(",", ":"), sort_keys=True).encode(), 9)
    return "p=" + base64.urlsafe_b64encode(packed).decode().rstrip("=")


def unpack_link(text: str, most: int = LINK_BYTES) -> dict:
    """The project in a link or its part behind #, packed by either codec. Raises ValueError for anything else, or one that unpacks
    to more than ``most`` bytes (zlib) or half as many UTF-16 units (lz)."""
    m = LINK.match(text.strip())
    if not m:
        raise ValueError("not a link to a project")
    try:
        unpack = zlib.decompressobj()
        data = unpack.decompress(base64.b64decode(m[1] + "=" * (-len(m[1]) % 4), b"-_", validate=True), most)
    except (zlib.error, ValueError):
        data = lz.decompress(m[1], most // 2)
    else:
        if unpack.unconsumed_tail or not unpack.eof:
            raise ValueError("the project in this link is too large or cut off")
    try:
        return json.loads(data)
    except RecursionError as e:
        raise ValueError("the document nests too deeply") from e


def kind_of_text(text: Column) -> Column:
    """What a pasted text is: project (a JSON document with traces and a version), link, or data for the readers."""
    head = F.trim(text)
    project = head.startswith("{") & head.contains('"traces"') & head.rlike(r'"version"\s*:')
    return F.when(text.isNull() | (head == ""), None).when(project, "project").when(head.rlike(r"^(\S*#)?p=[A-Za-z0-9_+$-]+=*$"), "link").otherwise("data")


def import_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pasted texts (path, content) as (traces of projects and links, columns as in PARTS; traces of all others, columns as
    in formats.TRACE)."""
    from . import formats

    @F.arrow_udf("string")
    def opened(links: pa.Array) -> pa.Array:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(unpack_link(t))
            except ValueError as e:
                return json.dumps({"error": str(e)})

        return pa.array([one(t) for t in links.to_pylist()], pa.string())

    t = texts.select(F.col("path").cast("string"), F.col("content").cast("string").alias("content")).withColumn("_kind", kind_of_text(F.col("content")))
    whole = F.when(F.col("_kind") == "link", opened("content")).otherwise(F.col("content")).alias("content")
    return read_projects(t.filter("_kind in ('project', 'link')").select("path", whole)), formats.parse_files(t.filter("_kind = 'data'").select("path", "content"))
