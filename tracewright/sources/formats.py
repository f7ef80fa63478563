"""File formats as small plug-ins: each knows how likely a file is its own, and how to make traces of it."""

from __future__ import annotations

import base64
import io
import json
import math
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_image
from .delimited import TIME_UNITS, data_line, finish, metadata, role_of, traces_of, x_unit, y_unit

#: Peaks and events that a file brings along; places are in the unit of the trace's x.
PEAKS = "array<struct<start:double,apex:double,end:double,area:double,area_se:double,label:string>>"
EVENTS = "array<struct<curve:string,x:double,label:string>>"
TRACE = f"path string, trace_no int, name string, x array<double>, y array<double>, x_unit string, y_unit string, role string, meta map<string,string>, peaks {PEAKS}, events {EVENTS}, format string, warnings array<string>, error string"
GENERIC = {"csv", "txt", "tsv", "dat", "asc", "text"}
HEAD = 4096
LETTERS = re.compile(r"[A-Z]+")


@dataclass
class Plugin:
    id: str
    extensions: tuple[str, ...]
    order: int
    sniff: Callable[[bytes, str], float]
    parse: Callable[[bytes, dict], list[dict]]
    binary: bool = False
    #: For dialects of JSON: how likely a document is its own, and its traces.
    sniff_json: Callable[[object], float] | None = None
    parse_json: Callable[[object, dict], list[dict]] | None = None


PLUGINS: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    """Adds a format; one with the same id is replaced."""
    PLUGINS[plugin.id] = plugin


def unregister(name: str) -> None:
    PLUGINS.pop(name, None)


def listed() -> list[Plugin]:
    return sorted(PLUGINS.values(), key=lambda p: p.order)


def decode(data: bytes) -> str:
    """Text by its byte order mark, UTF-16 without one by its zero bytes, UTF-8 if it is, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(name, "replace")
    for first, name in ((1, "utf-16-le"), (0, "utf-16-be")):
        part = data[first::2]
        if part and part.count(0) > 0.3 * len(part):
            return data.decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def looks_text(data: bytes) -> bool:
    return 0 not in decode(data[:HEAD]).encode() if data else True


def extension(path: str) -> str:
    return (re.search(r"\.([A-Za-z0-9]+)\Z", path) or [None, ""])[1].lower()


def rank(data: bytes, path: str) -> list[tuple[float, Plugin]]:
    """Formats by how likely they are: what their sniffers say of the head, and a little for the extension."""
    head, text, ext = data[:HEAD], decode(data[:HEAD]), extension(path)
    out = []
    for p in listed():
        try:
            score = p.sniff(head, text)
        except Exception:  # noqa: BLE001  a sniffer that fails knows nothing
            score = 0.0
        if ext in p.extensions:
            score += 0.05 if ext in GENERIC else 0.3
        out.append((score, p))
    return sorted(out, key=lambda s: (-s[0], s[1].order))


def parse_file(data: bytes, path: str = "", format: str | None = None, **options) -> dict:
    """{format, traces, warnings, error} of a file. A text format that fails gives way to plain delimited text."""
    if not data:
        return {"format": None, "traces": [], "warnings": [], "error": "the file is empty"}
    ranked = rank(data, path)
    text = looks_text(data)
    if format:
        plugin = PLUGINS[format]
    else:
        score, plugin = ranked[0]
        if plugin.binary and score < (0.3 if not text else 0.5) or not plugin.binary and not text:
            return {"format": None, "traces": [], "warnings": [], "error": "unknown binary format: export it as text"}
        if score < 0.15:
            plugin = PLUGINS["delimited"]
    warnings: list[str] = []
    try:
        traces = plugin.parse(data, options | {"warnings": warnings, "path": path})
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, ElementTree.ParseError, zipfile.BadZipFile) as e:
        traces, error = [], f"{plugin.id}: {e}"
        if text and not plugin.binary and plugin.id != "delimited":
            again = parse_file(data, path, "delimited", **options)
            if again["traces"]:
                return again | {"warnings": [error, *again["warnings"]]}
        return {"format": plugin.id, "traces": [], "warnings": warnings, "error": error}
    warnings += ["fewer than 3 points"] * any(len(t["x"]) < 3 for t in traces)
    return {"format": plugin.id, "traces": traces, "warnings": warnings, "error": None if traces else "no trace found"}


def _trace(x, y, unit: str = "min", name: str = "", y_unit: str | None = None, role: str = "signal", meta: dict | None = None, peaks: list[dict] | None = None) -> dict:
    xs, ys, shown = finish([float(v) for v in x], [float(v) for v in y], unit)
    return {"name": name, "x": xs, "y": ys, "x_unit": shown, "y_unit": y_unit, "role": role, "meta": meta or {}, "peaks": imported_peaks(peaks or [], unit)}


def _number(v) -> float | None:
    """A finite number, or None."""
    try:
        v = float(v)
    except (TypeError, ValueError):
        return None
    return v if math.isfinite(v) else None


def imported_peaks(peaks: list[dict], unit: str = "min", flow: float | None = None) -> list[dict]:
    """Peaks as PEAKS, by apex: places in minutes where the unit or a flow allows it; without an apex a peak is left out, a
    missing bound is the apex, bounds are put in order, and areas that aren't finite are dropped."""
    factor = TIME_UNITS.get(unit) or (1 / flow if flow and flow > 0 and unit == "ml" else 1.0)
    out = []
    for p in peaks:
        apex = _number(p.get("apex"))
        if apex is None:
            continue
        ends = [v if (v := _number(p.get(k))) is not None else apex for k in ("start", "end")]
        label = p.get("label")
        out.append({"start": min(ends) * factor, "apex": apex * factor, "end": max(ends) * factor, "area": _number(p.get("area")), "area_se": _number(p.get("area_se")), "label": None if label is None else str(label)})
    return sorted(out, key=lambda p: p["apex"])


# Text


def _delimited(data: bytes, options: dict) -> list[dict]:
    found, warnings = traces_of(decode(data), flow=options.get("flow"))
    options["warnings"] += warnings
    return found


def _number_lines(text: str) -> int:
    return len(re.findall(r"(?m)^\s*[-+]?[\d.,]+(?:[eE][-+]?\d+)?[\t;, |]+[-+]?[\d.,]+", text))


def _json(data: bytes, options: dict) -> list[dict]:
    text = re.sub(r"(?<=[\[:,\s])-?(?:NaN|Infinity)(?=\s*[,\]}])", "null", decode(data))
    v = json.loads(text)
    dialects = [(score, p) for p in listed() if p.sniff_json and (score := p.sniff_json(v)) >= 0.5]
    if dialects:
        return max(dialects, key=lambda d: d[0])[1].parse_json(v, options)
    traces = _json_traces(v)
    if isinstance(v, dict) and isinstance(v.get("peakRows"), list):
        _merge_peak_rows(v, traces)
    return traces


def _own_peaks(v: dict) -> list[dict]:
    """Peaks that a JSON trace lists, under the names that are in use."""
    alias = {"start": ("start", "from", "left"), "apex": ("apex", "rt", "time", "position"), "end": ("end", "to", "right"), "area": ("area", "importedArea"), "area_se": ("area_se", "importedAreaSE"), "label": ("label", "name")}
    found = v.get("peaks")
    rows = [p for p in found if isinstance(p, dict)] if isinstance(found, list) else []
    return [{k: next((p[n] for n in names if p.get(n) is not None), None) for k, names in alias.items()} | {"id": p.get("id", p.get("peak_id"))} for p in rows]


def _merge_peak_rows(v: dict, traces: list[dict]) -> None:
    """Adds the rows of a peak table to the traces of the same document: by trace id or name; a peak that the trace has
    already (by its id) keeps its own values and takes what it lacks."""
    inner = next((v[k] for k in v if k.lower() == "traces"), [])
    for t, own in zip(traces, inner if isinstance(inner, list) and len(inner) == len(traces) else [{}] * len(traces)):
        rows = [r for r in v["peakRows"] if isinstance(r, dict) and (own.get("id") is not None and r.get("trace_id") == own.get("id") or r.get("trace_id") is None and r.get("trace_name") == t["name"])]
        have = {p["id"]: p for p in _own_peaks(own)}
        alone = [p for p in _own_peaks(own) if p["id"] is None]
        for r in _own_peaks({"peaks": rows}):
            known = have.get(r["id"]) if r["id"] is not None else None
            if known is None:
                (have.__setitem__(r["id"], r) if r["id"] is not None else alone.append(r))
            else:
                have[r["id"]] = r | {k: x for k, x in known.items() if x is not None}
        t["peaks"] = imported_peaks([*have.values(), *alone])


def _json_traces(v) -> list[dict]:
    """Shapes: [{x, y}], [[x, y]], {x: [], y: []}, {traces: [...]}, {data: [...]}."""
    nan = lambda a: math.nan if a is None else float(a)
    if isinstance(v, dict):
        low = {k.lower(): k for k in v}
        for key in ("traces", "data"):
            if key in low and isinstance(v[low[key]], list):
                inner = v[low[key]]
                return [t for e in inner for t in _json_traces(e)] if inner and isinstance(inner[0], dict) and any(isinstance(a, list) for a in inner[0].values()) else _json_traces(inner)
        xk = next((low[k] for k in ("x", "time", "t", "rt", "volume") if k in low), None)
        yk = next((low[k] for k in ("y", "signal", "intensity", "value", "absorbance") if k in low), None)
        if xk and yk and isinstance(v[xk], list):
            unit = v.get("xUnit") or v.get("x_unit") or x_unit(xk) or "min"
            return [_trace(map(nan, v[xk]), map(nan, v[yk]), unit.lower(), str(v.get("name") or ""), v.get("yUnit") or v.get("y_unit"), peaks=_own_peaks(v))]
    if isinstance(v, list) and v:
        if isinstance(v[0], dict):
            low = {k.lower(): k for k in v[0]}
            xk = next((low[k] for k in ("x", "time", "t", "rt", "volume") if k in low), None)
            yk = next((low[k] for k in ("y", "signal", "intensity", "value", "absorbance") if k in low), None)
            if xk and yk:
                return [_trace((nan(e.get(xk)) for e in v), (nan(e.get(yk)) for e in v))]
        elif isinstance(v[0], list) and len(v[0]) >= 2:
            return [_trace((nan(e[0]) for e in v), (nan(e[1]) for e in v))]
    raise ValueError("no trace in this JSON")


def _dataset_traces(v: dict, options: dict) -> list[dict]:
    """A dataset of absorbance matrices over time and wavelength: one trace a chromatogram, at the given wavelength (nm),
    all summed ("sum"), at 254 nm if there, else where the absorbance is greatest. Its peaks come along: of a resolved
    component the area is its integral times its spectrum at that wavelength times the step, of a plain peak that of the
    signal between its bounds."""
    out = []
    wavelength, compounds = options.get("wavelength"), v.get("compounds") or {}
    for name, c in v["chromatograms"].items():
        data, waves, time = np.array(c["data"], float), np.array(c["wavelength"], float), np.array(c["time"], float)
        if data.shape[0] != len(waves):
            data = data.T
        if wavelength == "sum":
            y, shown, k = data.sum(axis=0), "sum", None
        else:
            near = np.abs(waves - float(wavelength if wavelength is not None else 254))
            k = int(near.argmin()) if near.min() <= 0.5 else int(np.unravel_index(np.nanargmax(data), data.shape)[0])
            y, shown = data[k], f"{waves[k]:g} nm"
        step = float(np.median(np.diff(time))) if len(time) > 1 else 1.0
        peaks = []
        for p in c.get("peaks") or []:
            at = [min(max(int(p.get(f) or 0), 0), len(time) - 1) for f in ("left", "maximum", "right")]
            start, apex, end = (float(time[i]) for i in at)
            parts = p.get("components") or []
            for q in parts:
                spectrum = q.get("spectrum") or []
                weight = sum(spectrum) if k is None else spectrum[k] if k < len(spectrum) else None
                integral, place = _number(q.get("integral")), _number(q.get("elution_time"))
                label = q.get("compound_id")
                label = (compounds.get(str(label)) or {}).get("name", label) if isinstance(compounds, dict) else label
                place = float(time[min(max(int(place), 0), len(time) - 1)]) if place is not None else apex
                peaks.append({"start": start, "apex": place, "end": end, "area": None if integral is None or weight is None else integral * weight * step, "label": label})
            if not parts:
                inside = slice(at[0], at[2] + 1)
                peaks.append({"start": start, "apex": apex, "end": end, "area": float(np.trapezoid(y[inside], time[inside])), "label": p.get("name")})
        out.append(_trace(time, y, "min", f"{name} {shown}", "mAU", peaks=peaks))
    return out


def wavelengths(v: object) -> list[float]:
    """The wavelengths that such a dataset offers, ascending."""
    held = v.get("chromatograms") if isinstance(v, dict) else None
    return sorted({float(w) for c in held.values() for w in c.get("wavelength") or []}) if isinstance(held, dict) else []


def _stat(stats: dict, *words: str) -> object:
    """The value whose key has all ``words``; None without one."""
    return next((x for k, x in stats.items() if all(w in k.lower() for w in words)), None)


def _samples_traces(v: dict, options: dict) -> list[dict]:
    """Samples with raw columns: one trace each, of the first two columns that are a time and a signal. Processed peaks
    come along: the area is the mean of an ensemble (with its standard deviation) or, without one, of the best fit or the
    median; the bounds are the ends of the fitted places, or three widths about the centre."""
    out = []
    for name, s in v["Samples"].items():
        raw = s["Raw Data"]
        columns = {k: c for k, c in raw.items() if isinstance(c, list)}
        xk = next((k for k in columns if x_unit(k)), None)
        yk = next((k for k in columns if k != xk), None)
        if not xk or not yk:
            continue
        meta = {str(k): str(m) for k, m in (s.get("Metadata") or {}).items()}
        nan = [math.nan if a is None else a for a in columns[yk]]
        peaks = []
        for label, stats in (s.get("Processed Data") or {}).items():
            if not isinstance(stats, dict):
                continue
            flat = stats | (p if isinstance(p := _stat(stats, "param"), dict) else {})
            ensemble = [a for a in map(_number, e) if a is not None] if isinstance(e := _stat(flat, "ensemble"), list) else []
            area, se = (float(np.mean(ensemble)), float(np.std(ensemble, ddof=1)) if len(ensemble) > 1 else None) if ensemble else (None, None)
            for words in (("area", "mean"), ("area", "best"), ("area", "median"), ("area",)):
                area = _number(_stat(flat, *words)) if area is None else area
            se = _number(_stat(flat, "standard deviation")) if se is None else se
            apex = next((a for w in ("retention", "center", "centre", "rt") if (a := _number(_stat(flat, w))) is not None), None)
            fitted = [a for a in map(_number, e) if a is not None] if isinstance(e := flat.get("x", _stat(flat, "x-range")), list) else []
            width = _number(_stat(flat, "width") or _stat(flat, "sigma"))
            ends = (min(fitted), max(fitted)) if fitted else (apex - 3 * width, apex + 3 * width) if width and apex is not None else (None, None)
            peaks.append({"start": ends[0], "apex": apex, "end": ends[1], "area": area, "area_se": se, "label": label})
        out.append(_trace(columns[xk], nan, x_unit(xk), name, y_unit(yk), meta=meta, peaks=peaks))
    return out


#: Pseudo-digits of the compressed forms of JCAMP-DX.
SQZ = {c: s for c, s in zip("@ABCDEFGHI", range(10))} | {c: -s for c, s in zip("abcdefghi", range(1, 10))}
DIF = {c: s for c, s in zip("%JKLMNOPQR", range(10))} | {c: -s for c, s in zip("jklmnopqr", range(1, 10))}
DUP = {c: s for c, s in zip("STUVWXYZs", range(1, 10))}


def jcamp_line(line: str) -> tuple[list[float], bool]:
    """Ordinates of one line, whatever its form, and whether it ended in differences."""
    tokens = re.findall(r"[@A-Ia-i%J-Rj-rS-Zs][\d.]*|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]\d+)?|\?", line)
    out: list[float] = []
    last, differing = 0.0, False
    for token in tokens:
        c, rest = token[0], token[1:]
        if c in DUP:
            for _ in range(int(f"{DUP[c]}{rest}") - 1):
                out.append(out[-1] + last if differing else out[-1])
            continue
        if c in DIF:
            last, differing = float(f"{'-' if c.islower() else ''}{abs(DIF[c])}{rest}"), True
            out.append(out[-1] + last)
            continue
        differing = False
        out.append(math.nan if c == "?" else float(f"{'-' if c.islower() else ''}{abs(SQZ[c])}{rest}") if c in SQZ else float(token))
    return out, differing


def _jcamp(data: bytes, options: dict) -> list[dict]:
    out = []
    for block in re.split(r"(?m)^##END=.*$", decode(data)):
        fields = {re.sub(r"[\s_/-]", "", k).upper(): v.strip() for k, v in re.findall(r"(?ms)^##([^=]*)=(.*?)(?=^##|\Z)", block)}
        body = next((fields[k] for k in ("XYDATA", "XYPOINTS", "PEAKTABLE") if k in fields), None)
        if body is None:
            continue
        form, _, rest = body.partition("\n")
        number = lambda k, default=math.nan: float(fields[k].split()[0]) if k in fields else default
        fx, fy = number("XFACTOR", 1.0), number("YFACTOR", 1.0)
        unit = x_unit(fields.get("XUNITS", "")) or "min"
        if "++" in form:
            y: list[float] = []
            check = False
            for line in rest.splitlines():
                line = line.split("$$")[0].strip()
                m = re.match(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]\d+)?", line)
                if not m:
                    continue
                values, differing = jcamp_line(line[m.end() :])
                if check and values and y:
                    if abs(values[0] - y[-1]) > 1e-6 * max(abs(y[-1]), 1):
                        options["warnings"].append("a line does not begin where the one before ended")
                    values = values[1:]
                y += values
                check = differing
            first, n = number("FIRSTX"), len(y)
            step = (number("LASTX") - first) / (number("NPOINTS") - 1) if "LASTX" in fields and number("NPOINTS", 0) > 1 else number("DELTAX", 1.0)
            out.append(_trace((first + step * i for i in range(n)), (v * fy for v in y), unit, fields.get("TITLE", ""), fields.get("YUNITS")))
        else:
            v = [float(t) for t in re.findall(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", re.sub(r"\$\$.*", "", rest))]
            out.append(_trace((a * fx for a in v[::2]), (b * fy for b in v[1::2]), unit, fields.get("TITLE", ""), fields.get("YUNITS")))
    if not out:
        raise ValueError("no data block")
    return out


def _mzml(data: bytes, options: dict) -> list[dict]:
    """Chromatograms (TIC first; the first ``most`` if that option is given); without any, the ion current of the
    first-level spectra."""
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rpartition("}")[2]
    terms = lambda e: {p.get("accession"): p for p in e if local(p) == "cvParam"}

    def arrays(e) -> tuple[list[float], list[float], str]:
        xs, ys, unit = [], [], "min"
        for a in (a for a in e.iter() if local(a) == "binaryDataArray"):
            t = terms(a)
            if any(k and k.startswith("MS:10023") and int(k[3:]) in (1002312, 1002313, 1002314) for k in t):
                raise ValueError("Numpress arrays are not supported")
            raw = base64.b64decode(next((b.text or "" for b in a if local(b) == "binary"), ""))
            raw = zlib.decompress(raw) if "MS:1000574" in t else raw
            kind = next((d for k, d in (("MS:1000523", "<f8"), ("MS:1000521", "<f4"), ("MS:1000522", "<i8"), ("MS:1000519", "<i4")) if k in t), "<f4")
            values = np.frombuffer(raw, kind).astype(float).tolist()
            if "MS:1000595" in t:
                xs = values
                unit = {"UO:0000010": "sec", "UO:0000031": "min"}.get(t["MS:1000595"].get("unitAccession"), "sec" if max(values, default=0) > 200 else "min")
            elif "MS:1000515" in t:
                ys = values
        return xs, ys, unit

    found = []
    for c in (c for c in root.iter() if local(c) == "chromatogram"):
        xs, ys, unit = arrays(c)
        if xs and ys:
            found.append((("MS:1000235" not in terms(c)), _trace(xs, ys, unit, c.get("id", ""), "counts")))
    found.sort(key=lambda f: f[0])
    if found:
        if (most := options.get("most")) is not None and len(found) > most:
            options["warnings"].append(f"{len(found) - most} of {len(found)} chromatograms left out")
            found = found[:most]
        return [t for _, t in found]
    xs, ys = [], []
    for s in (s for s in root.iter() if local(s) == "spectrum"):
        t = terms(s)
        level, current = t.get("MS:1000511"), t.get("MS:1000285")
        start = next((p for p in s.iter() if local(p) == "cvParam" and p.get("accession") == "MS:1000016"), None)
        if current is not None and start is not None and (level is None or level.get("value") == "1"):
            xs.append(float(start.get("value")) * (1 / 60 if start.get("unitAccession") == "UO:0000010" else 1))
            ys.append(float(current.get("value")))
    return [_trace(xs, ys, "min", "TIC", "counts")] if xs else []


def _chromeleon(data: bytes, options: dict) -> list[dict]:
    """A header of keys, then the table, whose column of step widths is left out."""
    text = decode(data)
    unit = re.search(r"(?m)^Signal Unit\t(.*)$", text)
    head, found, body = text.partition("Chromatogram Data:")
    lines = [line.split("\t") for line in body.splitlines() if line.strip()]
    if not found or not lines:
        raise ValueError("no chromatogram section")
    keep = [k for k, name in enumerate(lines[0]) if not name.lower().startswith("step")]
    table, warnings = traces_of("\n".join("\t".join(c[k] for k in keep if k < len(c)) for c in lines))
    options["warnings"] += warnings
    meta = metadata(head.splitlines())
    return [t | {"meta": meta, "y_unit": t["y_unit"] or (unit and unit[1].strip())} for t in table]


def _shimadzu(data: bytes, options: dict) -> list[dict]:
    """Every intensity column of every section with a chromatogram; where there are several, names say which."""
    out = []
    for name, body in re.findall(r"(?ms)^\[([^\]]+)\]\s*$(.*?)(?=^\[|\Z)", decode(data).replace("\r\n", "\n")):
        if not name.lower().startswith("lc chromatogram") and "chromatogram(" not in name.lower():
            continue
        lines = body.splitlines()
        meta = metadata(lines[: next((k for k, line in enumerate(lines) if data_line(line)), len(lines))])
        scale = next((float(v) for k, v in meta.items() if "multiplier" in k.lower()), 1.0)
        found, warnings = traces_of(body)
        options["warnings"] += [f"[{name}] {w}" for w in warnings]
        named = (lambda t: name) if len(found) < 2 else (lambda t: f"{name} {t['name']}")
        out += [t | {"y": [v * scale for v in t["y"]], "name": named(t), "meta": meta, "y_unit": meta.get("Intensity Units")} for t in found]
    if not out:
        raise ValueError("no chromatogram section")
    return out


def _arw(data: bytes, options: dict) -> list[dict]:
    lines = decode(data).splitlines()
    meta: dict[str, str] = {}
    k = 0
    while k + 1 < len(lines) and '"' in lines[k]:
        cells = [c.strip().strip('"') for c in lines[k].split("\t")], [c.strip().strip('"') for c in lines[k + 1].split("\t")]
        meta |= dict(zip(*cells))
        k += 2
    found, _ = traces_of("\n".join(lines[k:]))
    channel = " ".join(meta.values())
    unit = "AU" if re.search(r"PDA|TUV|UV|\d{3}\s*nm", channel) else None
    return [t | {"meta": meta, "y_unit": unit, "name": meta.get("Channel", meta.get("SampleName", ""))} for t in found]


def _unicorn(data: bytes, options: dict) -> list[dict]:
    """Pairs of columns under a row of units; pairs whose values are texts are events, which every trace has."""
    lines = [re.split("[\t;]", line) for line in decode(data).splitlines()]
    at = next((k for k, cells in enumerate(lines) if len(cells) >= 2 and all(c.strip().strip('"').lower() in ("ml", "min", "cv", "sec") for c in cells[::2] if c.strip())), None)
    if at is None:
        raise ValueError("no row of units")
    units, names = [c.strip().strip('"') for c in lines[at]], [c.strip().strip('"') for c in lines[at - 1]]
    out, events = [], []
    for c in range(0, len(units) - 1, 2):
        pairs = [(row[c], row[c + 1]) for row in lines[at + 1 :] if len(row) > c + 1 and row[c].strip()]
        name = next((n for n in (names[c] if c < len(names) else "", names[c + 1] if c + 1 < len(names) else "") if n), f"curve {c // 2 + 1}")
        places = [_number(a.replace(",", ".")) for a, _ in pairs]
        values = [_number(b.replace(",", ".")) for _, b in pairs]
        if any(v is None for v in values):
            marks = [(x, label.strip().strip('"')) for x, (_, label) in zip(places, pairs) if x is not None]
            xs, order, _ = finish([x for x, _ in marks], [float(k) for k in range(len(marks))], units[c].lower(), options.get("flow"))
            events += [{"curve": name, "x": x, "label": marks[int(k)][1]} for x, k in zip(xs, order)]
            continue
        known = [(x, y) for x, y in zip(places, values) if x is not None]
        x, y, shown = finish([x for x, _ in known], [y for _, y in known], units[c].lower(), options.get("flow"))
        out.append({"name": name, "x": x, "y": y, "x_unit": shown, "y_unit": units[c + 1], "role": role_of(f"{name} {units[c + 1]}"), "meta": {}})
    return [t | {"events": events} for t in sorted(out, key=lambda t: t["role"] != "signal")]


# Binary


def _netcdf(data: bytes, options: dict) -> list[dict]:
    """Classic netCDF (CDF-1, CDF-2) with an AnDI chromatogram."""
    wide = data[3] == 2
    at = 4

    def take(fmt: str):
        nonlocal at
        (v,) = struct.unpack_from(">" + fmt, data, at)
        at += struct.calcsize(fmt)
        return v

    def text() -> str:
        nonlocal at
        n = take("I")
        s = data[at : at + n].decode("latin-1")
        at += -(-n // 4) * 4
        return s

    kinds = {1: "b", 2: "c", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 4, 6: 8}

    def values(kind: int, n: int, where: int):
        raw = data[where : where + n * sizes[kind]]
        return raw.decode("latin-1").rstrip("\0") if kind == 2 else np.frombuffer(raw, kinds[kind]).astype(float)

    def attributes() -> dict:
        nonlocal at
        take("I")
        out = {}
        for _ in range(take("I")):
            name, kind, n = text(), take("I"), take("I")
            out[name] = values(kind, n, at)
            at += -(-n * sizes[kind] // 4) * 4
        return out

    records = take("I")
    take("I")
    dims = [(text(), take("I")) for _ in range(take("I"))]
    top = attributes()
    take("I")
    found = {}
    for _ in range(take("I")):
        name = text()
        shape = [dims[take("I")][1] for _ in range(take("I"))]
        attributes()
        kind, _, begin = take("I"), take("I"), take("Q" if wide else "I")
        if shape and shape[0] == 0:
            shape[0] = 0 if records == 0xFFFFFFFF else records
        found[name] = values(kind, int(np.prod(shape)) if shape else 1, begin)
    if "ordinate_values" not in found:
        raise ValueError("no ordinate_values")
    y = np.where(found["ordinate_values"] > 1e30, np.nan, found["ordinate_values"])
    one = lambda k, d=0.0: float(found[k][0]) if k in found and len(found[k]) else d
    x = found["raw_data_retention"] if "raw_data_retention" in found and len(found["raw_data_retention"]) == len(y) else one("actual_delay_time") + one("actual_sampling_interval", 1.0) * np.arange(len(y))
    unit = x_unit(str(top.get("retention_unit", ""))) or "sec"
    return [_trace(x, y, unit, str(top.get("detector_name") or top.get("sample_name") or ""), str(top.get("detector_unit") or "") or None)]


def _agilent_ch(data: bytes, options: dict) -> list[dict]:
    """Channel files: 130 (and kin) are runs of 16-bit differences with 32-bit escapes, 179 doubles, 181 second
    differences with 48-bit escapes."""
    version = data[1 : 1 + data[0]].decode("latin-1")
    at = 6144
    wide = version in ("130", "131", "179", "181")
    start, end = (struct.unpack_from(">f", data, 282)[0], struct.unpack_from(">f", data, 286)[0]) if wide else struct.unpack_from(">ii", data, 282)
    y: list[float] = []
    if version == "179":
        y = np.frombuffer(data[at : at + (len(data) - at) // 8 * 8], "<f8").tolist()
    elif version == "181":
        a = d = 0
        while at + 2 <= len(data):
            (v,) = struct.unpack_from(">h", data, at)
            at += 2
            if v == -32768 and at + 6 <= len(data):
                high, low = struct.unpack_from(">hI", data, at)
                a, d = high << 32 | low, 0
                at += 6
            else:
                d += v
                a += d
            y.append(float(a))
    elif version in ("130", "131", "30", "31", "8"):
        at = at if wide else 1024
        a = 0
        while at + 2 <= len(data):
            head, n = data[at], data[at + 1]
            at += 2
            if head != 0x10:
                break
            for _ in range(n):
                (v,) = struct.unpack_from(">h", data, at)
                at += 2
                if v == -32768:
                    (a,) = struct.unpack_from(">i", data, at)
                    at += 4
                else:
                    a += v
                y.append(float(a))
    else:
        raise ValueError(f"unknown version {version}")
    scale = struct.unpack_from(">d", data, 4732)[0] if wide else 1.0
    scale = scale if math.isfinite(scale) and scale > 0 else 1.0
    n = len(y)
    return [_trace((start + (end - start) * i / max(n - 1, 1) for i in range(n)), (v * scale for v in y), "ms", "", "mAU")]


@lru_cache(1 << 14)
def _column(letters: str) -> int:
    """Number of a sheet's column, from 1."""
    k = 0
    for ch in letters:
        k = 26 * k + ord(ch) - 64
    return k


def _xlsx(data: bytes, options: dict) -> list[dict]:
    """The first sheet that has a table, as tab-separated text."""
    book = zipfile.ZipFile(io.BytesIO(data))
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
    for name in sorted(n for n in book.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n)):
        lines = []
        for row in ElementTree.fromstring(book.read(name)).iter(f"{space}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{space}c"):
                k, kind = _column(LETTERS.match(c.get("r", "A"))[0]), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{space}t")) if kind == "inlineStr" else c.findtext(f"{space}v") or ""
                cells[k] = shared[int(text)] if kind == "s" and text else text
            lines.append("\t".join(cells.get(k, "") for k in range(1, max(cells, default=0) + 1)))
        found, warnings = traces_of("\n".join(lines))
        if found:
            options["warnings"] += warnings
            return found
    raise ValueError("no sheet with a table")


def _unsupported(data: bytes, options: dict) -> list[dict]:
    raise ValueError("this vendor format can't be read: export it as text, mzML or netCDF")


for _p in (
    Plugin("delimited", ("csv", "txt", "tsv", "dat", "asc", "text"), 10, lambda h, t: 0.3 if _number_lines(t) >= 3 else 0.1 if looks_text(h) else 0.0, _delimited),
    Plugin("json", ("json",), 20, lambda h, t: 0.9 if re.match(r"\s*[\[{]\s*[\[{\"]", t) else 0.0, _json),
    Plugin("xlsx", ("xlsx", "xlsm"), 30, lambda h, t: 0.9 if h[:4] == b"PK\x03\x04" and (b"xl/" in h or b"[Content_Types]" in h) else 0.0, _xlsx, True),
    Plugin("jcamp", ("jdx", "dx", "jcm"), 40, lambda h, t: 0.95 if re.search(r"(?m)^##(?:TITLE|JCAMP-?DX)=", t, re.I) else 0.0, _jcamp),
    Plugin("netcdf", ("cdf", "nc"), 50, lambda h, t: 0.95 if h[:3] == b"CDF" and h[3:4] in (b"\x01", b"\x02") else 0.0, _netcdf, True),
    Plugin("mzml", ("mzml",), 60, lambda h, t: 0.95 if "<mzML" in t or "<indexedmzML" in t else 0.0, _mzml),
    Plugin("agilent-ch", ("ch",), 70, lambda h, t: 0.9 if h[:1] in (b"\x03", b"\x02") and h[1 : 1 + h[0]].isdigit() else 0.0, _agilent_ch, True),
    Plugin("unsupported", ("raw", "uv", "d"), 80, lambda h, t: 0.9 if h[:8] in (b"\x89HDF\r\n\x1a\n", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1") or h[:2] == b"\x01\xa1" else 0.0, _unsupported, True),
    Plugin("agilent-text", ("csv",), 90, lambda h, t: 0.6 if h[:2] == b"\xff\xfe" and _number_lines(t) >= 3 else 0.0, lambda d, o: [t | {"y_unit": t["y_unit"] or "mAU"} for t in _delimited(d, o)]),
    Plugin("chromeleon", ("txt",), 100, lambda h, t: 0.9 if "Chromatogram Data:" in t else 0.0, _chromeleon),
    Plugin("shimadzu", ("txt", "asc"), 110, lambda h, t: 0.9 if re.search(r"(?m)^\[(?:Header|LC Chromatogram)", t) else 0.0, _shimadzu),
    Plugin("waters-arw", ("arw",), 120, lambda h, t: 0.8 if re.match(r'"[^"\n]+"(?:\t"[^"\n]+")*\s*\n"', t) else 0.0, _arw),
    Plugin("unicorn", ("asc", "txt"), 130, lambda h, t: 0.85 if re.search(r"(?mi)^\"?(?:ml|min|cv)\"?[\t;][^\t;\n]+[\t;]\"?(?:ml|min|cv)\"?[\t;]", t) else 0.0, _unicorn),
    Plugin("chromatopy", ("json",), 150, lambda h, t: 0.0, lambda d, o: _json(d, o), False, lambda v: 0.9 * (isinstance(v, dict) and isinstance(v.get("Samples"), dict)), _samples_traces),
    Plugin("mocca2", ("json",), 160, lambda h, t: 0.0, lambda d, o: _json(d, o), False, lambda v: 0.9 * (isinstance(v, dict) and isinstance(v.get("chromatograms"), dict)), _dataset_traces),
    Plugin("biorad", ("csv",), 140, lambda h, t: 0.5 if re.search(r"(?m)^Volume \(ml\),", t) else 0.0, lambda d, o: sorted(_delimited(d, o), key=lambda t: t["role"] != "signal")),
):
    register(_p)


def parse_files(files: DataFrame, format: str | None = None, **options) -> DataFrame:
    """Traces of ``files`` (path, content as text or bytes), columns as in TRACE: a row for each trace, or one without a
    trace for a file that can't be read, whose error says why. Each file is read by itself, whole; no shuffle."""
    names = ["name", "x", "y", "x_unit", "y_unit", "role", "meta", "peaks", "events"]
    peak = pa.struct([*((k, pa.float64()) for k in ("start", "apex", "end", "area", "area_se")), ("label", pa.string())])
    event = pa.struct([("curve", pa.string()), ("x", pa.float64()), ("label", pa.string())])
    kinds = [pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(peak), pa.list_(event)]
    blank = {"peaks": [], "events": []}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                got = parse_file(data or b"", path or "", format, **options)
                rows = [blank | t for t in got["traces"]] or [dict.fromkeys(names)]
                n = len(rows)
                columns = [pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())]
                columns += [pa.array([list(r[c].items()) if c == "meta" and r[c] is not None else r[c] for r in rows], k) for c, k in zip(names, kinds)]
                columns += [pa.array([got["format"]] * n, pa.string()), pa.array([got["warnings"]] * n, pa.list_(pa.string())), pa.array([got["error"]] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "trace_no", *names, "format", "warnings", "error"])

    return files.select(F.col("path").cast("string"), "content").mapInArrow(read, TRACE)


def split_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, all others) by their paths: images go to ``images`` and the digitizer, all else to parse_files()."""
    image = F.coalesce(is_image(F.col("path").cast("string")), F.lit(False))
    return files.filter(image), files.filter(~image)


def read_files(spark, path: str, format: str | None = None, **options) -> DataFrame:
    """Traces of all files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return parse_files(split_files(files)[1], format, **options)


def at_wavelength(files: DataFrame, wavelength: float | str) -> DataFrame:
    """The traces of files with absorbance matrices at another wavelength (nm, or "sum"); trace_no stays the same, so
    settings and styles keyed by (path, trace_no) go on to apply."""
    return parse_files(files, "mocca2", wavelength=wavelength)


def offered_wavelengths(files: DataFrame) -> DataFrame:
    """path and the wavelengths (array of double, ascending) that each file offers; none where it has no matrix."""

    @F.arrow_udf("array<double>")
    def offered(content: pa.Array) -> pa.Array:
        def of(data: bytes | None) -> list[float]:
            try:
                return wavelengths(json.loads(decode(data or b"")))
            except ValueError:
                return []

        return pa.array([of(c) for c in content.cast(pa.binary()).to_pylist()], pa.list_(pa.float64()))

    return files.select(F.col("path").cast("string"), offered(F.col("content").cast("binary")).alias("wavelengths"))
