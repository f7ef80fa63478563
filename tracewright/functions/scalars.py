"""Units, numbers in texts, file names, colours and guards for untrusted texts: built-in expressions, save for numeric
references."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.delimited import ROLES, TIME_UNITS


def minutes_factor(unit: Column) -> Column:
    """What turns places of this time unit into minutes; null for others."""
    out = F.lit(None).cast("double")
    for factor in sorted(set(TIME_UNITS.values())):
        out = F.when(F.lower(F.trim(unit)).isin(*[u for u, f in TIME_UNITS.items() if f == factor]), F.lit(factor)).otherwise(out)
    return out


def role_of(header: Column) -> Column:
    """signal, or what else a column's header names."""
    out = F.lit("signal")
    for role, pattern in reversed(ROLES):
        out = F.when(header.rlike("(?i)" + pattern.pattern), F.lit(role)).otherwise(out)
    return out


def wavelength_of(header: Column) -> Column:
    """nm, 150 to 1100, that a header names; else null."""
    w = F.regexp_extract(header, r"(\d{3,4})\s*nm", 1).try_cast("int")
    return F.when(w.between(150, 1100), w)


def parse_number(cell: Column) -> Column:
    """The number in a cell, quoted perhaps, with thousands groups; null if it is none."""
    s = F.trim(F.regexp_replace(F.trim(cell), '^"|"$', ""))
    s = F.when(s.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(s, F.lit(","), F.lit(""))).otherwise(s)
    return F.when(s.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))


def round_significant(v: Column, digits: int) -> Column:
    """Rounded half away from zero to so many significant digits; 0 stays."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(v))) - (digits - 1))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v) / step + 0.5) * step)


def escape_html(s: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(plain), F.lit(safe))
    return s


def hex_to_rgb(code: Column) -> Column:
    """struct(r, g, b) of #rgb or #rrggbb; null for anything else."""
    c = F.lower(F.regexp_replace(code, "^#", ""))
    c = F.when(F.length(c) == 3, F.regexp_replace(c, "(.)", "$1$1")).otherwise(c)
    part = lambda k: F.conv(F.substring(c, k, 2), 16, 10).cast("int")
    return F.when(c.rlike("^[0-9a-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(v.cast("long")), 2, "0")) for v in (r, g, b)])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[A-Za-z0-9]+$", "")


def is_image(path: Column) -> Column:
    return extension(path).isin("png", "jpg", "jpeg", "webp", "gif", "bmp", "pdf")


def binary_kind(content: Column) -> Column:
    """What a file's first bytes tell of it; null if nothing."""
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("89484446"), "hdf5").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0"), "ole2")
        .when(head.startswith("01A1"), "thermo-raw").when(head.startswith("434446"), "netcdf").when(head.startswith("89504E47"), "png")
    )


def unpadded_base64(s: Column) -> Column:
    """Bytes of a base64 text, url-safe letters and other characters tolerated."""
    s = F.regexp_replace(F.translate(s, "-_", "+/"), "[^A-Za-z0-9+/]", "")
    return F.unbase64(F.rpad(s, (F.ceil(F.length(s) / 4) * 4).cast("int"), "="))


def auto_lambda(n: Column) -> Column:
    """1e8 (n / 4000)^4 within [1e4, 1e11], three significant digits."""
    return round_significant(F.least(F.greatest(1e8 * F.pow(n / 4000, F.lit(4.0)), F.lit(1e4)), F.lit(1e11)), 3)


def peak_label(mode: Column, name: Column, rt: Column, area_pct: Column) -> Column:
    """The text at a peak: auto (the name, else rt), name, rt, name+rt, area or none."""
    at = F.format_string("%.2f", rt)
    return (
        F.when(mode == "none", "").when(mode == "rt", at).when(mode == "name", F.coalesce(name, F.lit("")))
        .when(mode == "name+rt", F.concat_ws(" ", name, at)).when(mode == "area", F.format_string("%.1f%%", area_pct)).otherwise(F.coalesce(name, at))
    )


def formatted(v: Column, digits: int = 4) -> Column:
    """A number for display with so many significant digits: plain within 1e-3 and 1e6, else with an exponent; a dash where
    there is none."""
    size = F.abs(v)
    rounded = round_significant(v, digits)
    places = F.greatest(F.lit(0), digits - 1 - F.floor(F.log10(F.greatest(F.abs(rounded), F.lit(1e-300))))).cast("int")
    trim = lambda s: F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")).otherwise(s)
    plain = trim(F.regexp_replace(F.format_number(F.round(rounded, 12), 12), ",", ""))
    exponent = F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits - 1}e", v), r"\.?0+e", "e"), r"e([+-])0*(\d)", "e$1$2")
    none = v.isNull() | F.isnan(v) | (size == float("inf"))
    return F.when(none, "—").when(v == 0, "0").when((size >= 1e6) | (size < 1e-3), exponent).when(places >= 0, plain)


#: The named references of XML.
XML_NAMES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decode_xml(s: Column) -> Column:
    """A text whose five named and numeric references are decoded; numbers that are no character give U+FFFD."""

    @F.arrow_udf("string")
    def numeric(texts: pa.Array) -> pa.Array:
        def one(m: re.Match) -> str:
            n = int(m[1], 16) if m[1] else int(m[2])
            return chr(n) if 0 < n < 0x110000 and not 0xD800 <= n < 0xE000 else "\ufffd"

        pattern = re.compile(r"&#(?:[xX]([0-9a-fA-F]{1,8})|(\d{1,10}));")
        return pa.array([None if t is None else pattern.sub(one, t) for t in texts.to_pylist()], pa.string())

    out = F.when(s.contains("&#"), numeric(s)).otherwise(s)
    for name, plain in XML_NAMES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(plain))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def safe_text(s: Column, most: int = 1000) -> Column:
    """An untrusted text without control characters (line ends and tabs stay), ``most`` characters at most."""
    return F.substring(F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), 1, most)


def safe_colour(s: Column, default: str = "#000000") -> Column:
    """#rgb or #rrggbb in small letters; ``default`` for anything else."""
    return F.when(s.rlike("^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"), F.lower(s)).otherwise(F.lit(default))


def safe_image(s: Column) -> Column:
    """A data URL of a bitmap in base64; null for anything else."""
    return F.when(s.rlike(r"^data:image/(png|jpeg|webp|gif|bmp);base64,[A-Za-z0-9+/]+={0,2}$"), s)


def file_safe(s: Column) -> Column:
    """A text as a file name: runs of all but letters, digits, dot, hyphen and underscore become one underscore."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(s), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("file"))
