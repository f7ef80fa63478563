"""Delimited text: find the numeric table in a file, name its columns, and make traces of them."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\Z")
GROUPED = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?\Z")
#: Factors to minutes.
TIME_UNITS = {"min": 1.0, "minute": 1.0, "minutes": 1.0, "sec": 1 / 60, "s": 1 / 60, "second": 1 / 60, "seconds": 1 / 60, "ms": 1 / 60000, "msec": 1 / 60000, "h": 60.0, "hr": 60.0, "hour": 60.0, "hours": 60.0}
VOLUME_UNITS = {"ml": "mL", "cv": "CV"}
ROLES = [
    ("gradient", re.compile(r"%\s*b\b|\bconc\b|gradient|\bgp\b", re.I)), ("conductivity", re.compile(r"\bcond|ms/cm", re.I)), ("pH", re.compile(r"\bph\b", re.I)),
    ("pressure", re.compile(r"press|\bbar\b|\bpsi\b|mpa", re.I)), ("temperature", re.compile(r"temp", re.I)), ("flow", re.compile(r"\bflow\b", re.I)),
]


def parse_number(s: str, decimal_comma: bool = False) -> float:
    """The number in a cell, quoted perhaps, with thousands groups or a decimal comma; NaN if it is none."""
    s = s.strip().strip('"').strip()
    if decimal_comma:
        s = s.replace(".", "").replace(",", ".") if re.fullmatch(r"[+-]?\d{1,3}(?:\.\d{3})+(?:,\d+)?", s) else s.replace(",", ".")
    elif "," in s and GROUPED.match(s):
        s = s.replace(",", "")
    return float(s) if NUMBER.match(s) else math.nan


def uses_decimal_comma(cells: list[str]) -> bool:
    """A vote: 1,5 speaks for a decimal comma, 1.5 and 1,234.5 against; 1,234 only if nothing else does."""
    yes = sum(bool(re.fullmatch(r"[+-]?\d*,(?:\d{1,2}|\d{4,})(?:[eE][+-]?\d+)?", c)) for c in cells)
    no = sum(bool(re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", c) or re.fullmatch(r"[+-]?\d{1,3}(?:,\d{3})+\.\d+", c)) for c in cells)
    unsure = sum(bool(re.fullmatch(r"[+-]?\d{1,3},\d{3}", c)) for c in cells)
    return yes > no or not (yes or no) and unsure > 0


def split_line(line: str, delimiter: str) -> list[str]:
    if delimiter == " ":
        return line.split()
    if '"' not in line:
        return [c.strip() for c in line.split(delimiter)]
    out, cell, quoted = [], "", False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == delimiter and not quoted:
            out.append(cell.strip())
            cell = ""
        else:
            cell += ch
    return [*out, cell.strip()]


def _numeric(cells: list[float], least: int) -> int:
    """How many cells of a data line are numbers; 0 for other lines."""
    good = len(cells) - sum(map(math.isnan, cells))
    return good if good >= least and 3 * (len(cells) - good) <= good else 0


@dataclass
class Table:
    rows: list[list[float]]
    header: list[str] = field(default_factory=list)
    preamble: list[str] = field(default_factory=list)
    delimiter: str = ","


def _best_run(lines: list[list[float] | None], least: int) -> tuple[int, int, int]:
    """(numeric cells, first line, end) of the run of data lines with most numeric cells; None (a blank line) doesn't
    break a run."""
    best, start, score, last = (0, 0, 0), None, 0, 0
    for k, cells in enumerate([*lines, []]):
        if cells is None:
            continue
        if good := _numeric(cells, least):
            start = k if start is None else start
            score += good
            last = k + 1
        elif start is not None:
            best = max(best, (score, -start, last))
            start, score = None, 0
    return best[0], -best[1], best[2]


def data_line(line: str) -> bool:
    """Whether a line holds two numbers, whatever parts them."""
    return any(_numeric([parse_number(c) for c in split_line(line, d)], 2) for d in "\t;,| ")


def parse_table(text: str, delimiter: str | None = None, decimal_comma: bool | None = None, skip: int = 0, header: bool | None = None) -> Table:
    """The numeric table in ``text``: its delimiter (tab, semicolon, comma, bar or blanks) gives the longest run of
    numeric lines; earlier ones win ties. The header is the nearest line above it that isn't numeric. ``skip`` leaves out
    so many lines first; ``header`` True takes the next one as the header, whatever it holds, and False none."""
    lines = re.split(r"\r\n|\r|\n", text.lstrip("﻿"))[skip:]
    first = None
    if header:
        at = next((k for k, line in enumerate(lines) if line.strip()), 0)
        first, lines = lines[at : at + 1], lines[at + 1 :]
    best = None
    for d in [delimiter] if delimiter else ["\t", ";", ",", "|", " "]:
        if best and d != " " and d not in text:
            continue  # no line has two cells
        split = [split_line(line, d) if line.strip() else None for line in lines]
        comma = decimal_comma if decimal_comma is not None else d != "," and "," in text and uses_decimal_comma([c for cells in split for c in cells or () if "," in c or "." in c])
        known = zip(best[4], best[5]) if best and best[6] == comma else ((None, None) for _ in lines)  # lines that fall into the same cells are read once
        numbers = [None if cells is None else read if cells == same else [parse_number(c, comma) for c in cells] for cells, (same, read) in zip(split, known)]
        score, start, end = _best_run(numbers, 2)
        if best is None or score > best[0]:
            best = (score, start, end, d, split, numbers, comma)
    score, start, end, d, split, numbers, _ = best
    if score == 0:
        score, start, end = _best_run(numbers, 1)
        if end - start < 3:
            return Table([])
    rows = [cells for cells in numbers[start:end] if cells is not None]
    above = next((k for k in range(start - 1, -1, -1) if split[k]), None)
    if header is not None:
        return Table(rows, split_line(first[0], d) if first else [], lines[:start] if above is None else lines[: above + 1], d)
    header = []
    if above is not None and len(split[above]) > 1 and not lines[above].lstrip().startswith("#"):
        header = split[above]
        names = split[above - 1] if above else None
        if names and len(names) == len(header) and all(re.fullmatch(r"\(?[\w%/ .]{0,8}\)?", u) for u in header) and any(n.strip() for n in names):
            header = [f"{n} ({u.strip('()')})" for n, u in zip(names, header)]
            above -= 1
    return Table(rows, header, lines[: start if above is None else above], d)


def x_unit(name: str) -> str | None:
    """min-like or volume unit that a header names."""
    for word in re.findall(r"(?<![\w/])[A-Za-z]+(?![\w/])", name)[::-1]:
        w = word.lower()
        if w in TIME_UNITS or w in VOLUME_UNITS:
            return w
    return "min" if re.search(r"\btime\b|\brt\b|retention", name, re.I) else "ml" if re.search(r"volume", name, re.I) else None


def y_unit(name: str) -> str | None:
    m = re.search(r"[\[(]([^\])]+)[\])]", name) or re.search(r"\b(m?AU|mV|µV|uV|counts|nRIU|mS/cm|%B?|pA)\b", name)
    return m[1].strip() if m else None


def role_of(name: str) -> str:
    return next((role for role, pattern in ROLES if pattern.search(name)), "signal")


def wavelength_of(name: str) -> int | None:
    m = re.search(r"(\d{3,4})\s*nm|(?:uv|sig|ch)\D{0,3}(\d{3})(?:[,_ )]|\Z)", name, re.I)
    w = int(m[1] or m[2]) if m else 0
    return w if 150 <= w <= 1100 else None


def metadata(lines: list[str]) -> dict[str, str]:
    """Keys and values of a preamble; the first of a key counts."""
    out: dict[str, str] = {}
    for line in lines:
        m = re.match(r"\s*#?\s*\"?([^\t:=;,\"]{1,60})\"?\s*[\t:=;,]+\s*\"?(.*?)\"?\s*\Z", line)
        if m and m[2]:
            out.setdefault(m[1].strip(), m[2])
    return out


def is_monotone(v: list[float]) -> bool:
    v = [a for a in v if not math.isnan(a)]
    if len(v) < 3 or max(v) <= min(v):
        return False
    up = sum(b >= a for a, b in zip(v, v[1:])) / (len(v) - 1)
    down = sum(b <= a for a, b in zip(v, v[1:])) / (len(v) - 1)
    return max(up, down) >= 0.98


def finish(xs: list[float], ys: list[float], unit: str, flow: float | None = None) -> tuple[list[float], list[float], str]:
    """Places in minutes where the unit or a flow allows it, finite pairs only, sorted by place."""
    factor, out = TIME_UNITS.get(unit), "min"
    if factor is None:
        factor, out = (1 / flow, "min") if flow and flow > 0 and unit == "ml" else (1.0, VOLUME_UNITS.get(unit, unit))
    pairs = [(a * factor, b) for a, b in zip(xs, ys) if math.isfinite(a) and math.isfinite(b)]
    pairs.sort(key=lambda p: p[0])
    return [p[0] for p in pairs], [p[1] for p in pairs], out


def traces_of(text: str, flow: float | None = None, x_col: int | None = None, y_cols: list[int] | None = None, unit: str | None = None, step: float = 1.0, y_scale: float = 1.0, **options) -> tuple[list[dict], list[str]]:
    """Traces of a delimited text and warnings. Columns come in pairs where headers of places alternate; else all are
    signals over the first column that a header calls a time or volume, or that is monotone.

    A mapping by hand goes before: ``x_col`` (-1: none, places are ``step`` apart), ``y_cols``, the ``unit`` of x and
    ``y_scale``; other options are those of parse_table."""
    table = parse_table(text, **options)
    if not table.rows:
        return [], ["no numeric table found"]
    n = max(map(len, table.rows))
    columns = [[row[c] if c < len(row) else math.nan for row in table.rows] for c in range(n)]
    names = [table.header[c] if c < len(table.header) else "" for c in range(n)]
    units = [x_unit(name) if name else None for name in names]
    warnings: list[str] = []
    by_hand = x_col is not None or y_cols is not None
    if by_hand and max([x_col if x_col is not None else 0, *(y_cols or [])]) >= n:
        return [], ["the table has no such column"]
    if by_hand:
        x = x_col if x_col is not None else 0
        pairs = [(x if x >= 0 else None, c) for c in (y_cols if y_cols is not None else range(n)) if c != x]
    elif n == 1:
        pairs = [(None, 0)]
    elif n >= 4 and n % 2 == 0 and all(units[c] for c in range(0, n, 2)) and not any(units[c] for c in range(1, n, 2)):
        pairs = [(c, c + 1) for c in range(0, n, 2)]
    else:
        x = next((c for c in range(n) if units[c] in TIME_UNITS), next((c for c in range(n) if units[c]), next((c for c in (0, 1) if is_monotone(columns[c])), None)))
        if x is None or not table.header and n > 6:
            return [], ["no column of times or volumes found"]
        pairs = [(x, c) for c in range(n) if c != x and sum(not math.isnan(v) for v in columns[c]) > len(table.rows) / 2 and not (units[c] and units[x])]
    meta = metadata(table.preamble)
    out = []
    for x, y in pairs:
        named = unit or (units[x] if x is not None else None) or "min"
        if x is not None and not units[x] and not unit:
            warnings.append("no unit of x given: minutes assumed")
        xs = columns[x] if x is not None else [i * step for i in range(len(columns[y]))]
        xs, ys, x_name = finish(xs, [v * y_scale for v in columns[y]], named, flow)
        if xs:
            out.append({"name": re.sub(r"\s*[\[(][^\])]*[\])]\s*\Z", "", names[y]) or f"column {y + 1}", "x": xs, "y": ys, "x_unit": x_name, "y_unit": y_unit(names[y]), "role": role_of(names[y]), "meta": meta})
    return out, list(dict.fromkeys(warnings))
