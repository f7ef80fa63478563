"""Images of curves to traces: colour masks, columns of pixels, and the two-point calibration of the axes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K


@dataclass(frozen=True)
class Axes:
    """Two known places on each axis: (pixel, value) pairs; an axis may be logarithmic."""

    x1: tuple[float, float]
    x2: tuple[float, float]
    y1: tuple[float, float]
    y2: tuple[float, float]
    x_log: bool = False
    y_log: bool = False

    def line(self, which: str) -> tuple[float, float, bool]:
        (p1, v1), (p2, v2), log = (self.x1, self.x2, self.x_log) if which == "x" else (self.y1, self.y2, self.y_log)
        if log:
            v1, v2 = np.log10(v1), np.log10(v2)
        slope = (v2 - v1) / (p2 - p1)
        return v1 - slope * p1, slope, log


def to_data(axes: Axes, which: str, pixel: Column) -> Column:
    """The value at a pixel."""
    offset, slope, log = axes.line(which)
    v = F.lit(float(offset)) + pixel * float(slope)
    return F.pow(F.lit(10.0), v) if log else v


def to_pixel(axes: Axes, which: str, value: Column) -> Column:
    offset, slope, log = axes.line(which)
    v = F.log10(value) if log else value
    return (v - float(offset)) / float(slope)


def extent(axes: Axes, width: Column, height: Column) -> Column:
    """struct(x_min, x_max, y_min, y_max) of what an image of that size covers, in values of its axes."""
    xs = [to_data(axes, "x", F.lit(0.0)), to_data(axes, "x", width - 1.0)]
    ys = [to_data(axes, "y", F.lit(0.0)), to_data(axes, "y", height - 1.0)]
    return F.struct(F.least(*xs).alias("x_min"), F.greatest(*xs).alias("x_max"), F.least(*ys).alias("y_min"), F.greatest(*ys).alias("y_max"))


def half_pixel(axes: Axes, which: str, value: Column) -> Column:
    """Half of what one pixel is worth there."""
    _, slope, log = axes.line(which)
    return F.lit(abs(slope) / 2) * (value * float(np.log(10)) if log else F.lit(1.0))


#: A rectangle of pixels: left, top, width, height.
Rect = tuple[float, float, float, float]


def _inside(shape: tuple[int, int], rect: Rect) -> tuple[slice, slice]:
    """Rows and columns of a rectangle (negative sizes reach back), within the image."""
    x, y, w, h = rect
    (x0, x1), (y0, y1) = sorted((x, x + w)), sorted((y, y + h))
    cut = lambda v, most: int(min(max(round(v), 0), most))
    return slice(cut(y0, shape[0]), cut(y1, shape[0])), slice(cut(x0, shape[1]), cut(x1, shape[1]))


def within(m: np.ndarray, include: list[Rect] = (), exclude: list[Rect] = ()) -> np.ndarray:
    """A mask inside any of ``include`` (everywhere without one) and outside all of ``exclude``."""
    out = m.copy()
    if include:
        allowed = np.zeros_like(m)
        for rect in include:
            allowed[_inside(m.shape, rect)] = True
        out &= allowed
    for rect in exclude:
        out[_inside(m.shape, rect)] = False
    return out


def mask(raster: np.ndarray, rgb: tuple[int, int, int], tolerance: float, include: list[Rect] = (), exclude: list[Rect] = ()) -> np.ndarray:
    """Pixels (height, width, RGBA) near a colour; transparent ones aren't."""
    far = np.sqrt(((raster[..., :3].astype(float) - np.array(rgb)) ** 2).sum(axis=-1))
    return within((far <= tolerance) & (raster[..., 3] >= 16), include, exclude)


def dark_mask(raster: np.ndarray, most: float, chroma: float = 70) -> np.ndarray:
    c = raster[..., :3].astype(float)
    return (c @ np.array([0.299, 0.587, 0.114]) <= most) & (c.max(-1) - c.min(-1) <= chroma) & (raster[..., 3] >= 16)


def columns(m: np.ndarray, mode: str = "centroid") -> np.ndarray:
    """A row for each column of a mask: of its runs the one nearest to the column before (within 25 pixels), else the
    longest; its middle, top or bottom. NaN without a run."""
    edges = np.diff(np.pad(m.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    at, first = np.nonzero(edges == 1)  # runs, column by column
    stop = np.nonzero(edges == -1)[1]
    middle = (first + stop - 1) / 2
    value = {"centroid": middle, "top": first.astype(float), "bottom": stop - 1.0}[mode]
    out = np.full(m.shape[1], np.nan)
    starts = np.searchsorted(at, np.arange(m.shape[1] + 1))
    if (np.diff(starts) <= 1).all():
        out[at] = value
        return out
    last = None
    for c in range(m.shape[1]):
        a, b = starts[c], starts[c + 1]
        if a == b:
            continue
        near = np.abs(middle[a:b] - last) if last is not None else np.full(b - a, np.inf)
        k = a + int(near.argmin()) if near.min() < 25 else a + int((stop[a:b] - first[a:b]).argmax())
        out[c], last = value[k], middle[k]
    return out


def erase_lines(m: np.ndarray, least: int, thick: int = 4) -> np.ndarray:
    """Without horizontal or vertical runs of at least ``least`` pixels that are at most ``thick`` wide."""
    out = m.copy()
    for flip in (False, True):
        src, dst = (m.T, out.T) if flip else (m, out)
        long = np.zeros_like(src)
        for r in range(src.shape[0]):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], src[r].view(np.int8), [0]]))).reshape(-1, 2)
            for a, b in edges[edges[:, 1] - edges[:, 0] >= least]:
                long[r, a:b] = True
        for c in range(src.shape[1]):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], long[:, c].view(np.int8), [0]]))).reshape(-1, 2)
            for a, b in edges:
                crossed = (a > 0 and src[a - 1, c]) or (b < len(src) and src[b, c])
                if b - a <= thick and not crossed:
                    dst[a:b, c] = False
    return out


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 map that takes four points to four others."""
    a = []
    for (x, y), (u, v) in zip(src, dst):
        a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
    return np.append(np.linalg.solve(np.array(a, float), np.asarray(dst, float).ravel()), 1).reshape(3, 3)


def warp(raster: np.ndarray, back: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resampling: ``back`` takes target to source places; white outside."""
    u, v = np.meshgrid(np.arange(width), np.arange(height))
    p = back @ np.stack([u.ravel(), v.ravel(), np.ones(u.size)])
    x, y = p[0] / p[2], p[1] / p[2]
    h, w = raster.shape[:2]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    i, j = np.clip(np.floor(y).astype(int), 0, max(h - 2, 0)), np.clip(np.floor(x).astype(int), 0, max(w - 2, 0))
    fy, fx = (y - i)[:, None], (x - j)[:, None]
    r = raster.astype(float)
    out = (r[i, j] * (1 - fx) + r[i, np.minimum(j + 1, w - 1)] * fx) * (1 - fy) + (r[np.minimum(i + 1, h - 1), j] * (1 - fx) + r[np.minimum(i + 1, h - 1), np.minimum(j + 1, w - 1)] * fx) * fy
    out[~inside] = 255
    return np.rint(out).astype(np.uint8).reshape(height, width, -1)


def rotation(angle: float, width: int, height: int) -> np.ndarray:
    """Takes places of an image turned by ``angle`` degrees about its middle back to the original."""
    c, s, cx, cy = np.cos(np.radians(angle)), np.sin(np.radians(angle)), (width - 1) / 2, (height - 1) / 2
    return np.array([[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy], [0, 0, 1]])


def draw(y: np.ndarray, width: int, height: int, low: float, high: float, rgb: tuple[int, int, int], thick: int = 2) -> np.ndarray:
    """A white raster with the curve of ``y`` over its whole width."""
    out = np.full((height, width, 4), 255, np.uint8)
    v = np.interp(np.linspace(0, len(y) - 1, width), np.arange(len(y)), y)
    rows = np.rint((height - 1) * (high - v) / (high - low))
    before = np.append(rows[:1], rows[:-1])
    at = np.arange(height)[:, None]
    inside = (at >= np.minimum(rows, before) - thick // 2) & (at <= np.maximum(rows, before) + thick - thick // 2)
    out[inside, :3] = rgb
    return out


# Preparing images


def cropped(raster: np.ndarray, rect: Rect) -> np.ndarray:
    """The part of an image in a rectangle; at least one pixel."""
    rows, cols = _inside(raster.shape[:2], rect)
    part = raster[rows, cols]
    return part if part.size else raster[:1, :1]


def adjusted(raster: np.ndarray, brightness: float = 0.0, contrast: float = 1.0, grey: bool = False, threshold: float | None = None) -> np.ndarray:
    """Colours times ``contrast`` about the middle, plus ``brightness``; ``grey`` by luminance; with a ``threshold``, black
    below that luminance and white above. Opacity stays."""
    c = (raster[..., :3].astype(float) - 127.5) * contrast + 127.5 + brightness
    lum = c @ np.array([0.299, 0.587, 0.114])
    if threshold is not None:
        c = np.repeat(np.where(lum < threshold, 0.0, 255.0)[..., None], 3, axis=2)
    elif grey:
        c = np.repeat(lum[..., None], 3, axis=2)
    return np.dstack([np.clip(np.rint(c), 0, 255).astype(np.uint8), raster[..., 3]])


def perspective(raster: np.ndarray, corners: list[tuple[float, float]]) -> np.ndarray:
    """The quadrilateral of four corners (from the top left, clockwise) as a rectangle with its longest sides."""
    side = lambda a, b: float(np.hypot(corners[a][0] - corners[b][0], corners[a][1] - corners[b][1]))
    w, h = max(round(max(side(0, 1), side(3, 2))), 1), max(round(max(side(0, 3), side(1, 2))), 1)
    target = np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)
    return warp(raster, homography(target, np.array(corners, float)), w, h)


def apply_ops(raster: np.ndarray, ops: list[tuple]) -> np.ndarray:
    """Steps in order: ("crop", rect), ("quarter", turns clockwise), ("rotate", degrees), ("perspective", corners),
    ("adjust", {options of adjusted})."""
    for name, value in ops:
        if name == "crop":
            raster = cropped(raster, value)
        elif name == "quarter":
            raster = np.ascontiguousarray(np.rot90(raster, -int(value) % 4))
        elif name == "rotate":
            raster = warp(raster, rotation(value, raster.shape[1], raster.shape[0]), raster.shape[1], raster.shape[0])
        elif name == "perspective":
            raster = perspective(raster, value)
        elif name == "adjust":
            raster = adjusted(raster, **value)
        else:
            raise ValueError(f"unknown step {name}")
    return raster


def prepared(content: Column, width: Column, height: Column, ops: list[tuple]) -> Column:
    """struct(width, height, content) of an RGBA raster after the steps of apply_ops."""

    def run(data, w, h):
        out = apply_ops(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 4), ops)
        return out.shape[1], out.shape[0], out.tobytes()

    return K.struct({"width": "int", "height": "int", "content": "binary"}, run, content, width, height)


# Degrading images, to measure what that costs


def resized(raster: np.ndarray, share: float) -> np.ndarray:
    """Bilinear resampling to ``share`` of both edges."""
    h, w = raster.shape[:2]
    u, v = max(round(w * share), 1), max(round(h * share), 1)
    back = np.diag([(w - 1) / max(u - 1, 1), (h - 1) / max(v - 1, 1), 1.0])
    return warp(raster, back, u, v)


def blurred(raster: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, edges continued."""
    reach = max(int(np.ceil(3 * sigma)), 1)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    out = raster.astype(float)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(3)]
        out = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, np.pad(out, pad, "edge"))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def quantised(raster: np.ndarray, step: float) -> np.ndarray:
    """Colours whose 8 x 8 cosine coefficients are rounded to multiples that grow with the frequency, as lossy formats do."""
    h, w = raster.shape[:2]
    n = np.arange(8)
    d = np.sqrt(2 / 8) * np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / 16)
    d[0] /= np.sqrt(2)
    q = step * (1 + (n[:, None] + n[None, :]) / 2)
    a = np.pad(raster[..., :3].astype(float) - 128, ((0, -h % 8), (0, -w % 8), (0, 0)), "edge")
    b = a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8, 3)
    c = np.einsum("ui,xiyjc,vj->xuyvc", d, b, d)
    c = np.rint(c / q[None, :, None, :, None]) * q[None, :, None, :, None]
    out = np.einsum("ui,xuyvc,vj->xiyjc", d, c, d).reshape(a.shape)[:h, :w] + 128
    return np.dstack([np.clip(np.rint(out), 0, 255).astype(np.uint8), raster[..., 3]])


def scene(traces: list[np.ndarray], colours: list[tuple[int, int, int]], width: int = 900, height: int = 560, low: float = 0.0, high: float = 250.0, margin: int = 50) -> tuple[np.ndarray, Axes]:
    """A chart with a frame, a grey grid and curves over its plot, and its axes (x from 0 to 1 over each curve)."""
    out = np.full((height, width, 4), 255, np.uint8)
    left, right, top, bottom = margin, width - margin, margin, height - margin
    for k in range(1, 5):
        out[top + (bottom - top) * k // 5, left:right, :3] = 225
        out[top:bottom, left + (right - left) * k // 5, :3] = 225
    out[[top, bottom], left : right + 1, :3] = 0
    out[top : bottom + 1, [left, right], :3] = 0
    for y, rgb in zip(traces, colours):
        part = draw(y, right - left + 1, bottom - top + 1, low, high, rgb)
        on = (part[..., :3] != 255).any(axis=2)
        out[top : bottom + 1, left : right + 1][on] = part[on]
    return out, Axes((left, 0.0), (right, 1.0), (top, high), (bottom, low))


def curve(raster: np.ndarray, axes: tuple[float, float, float, float], rgb: tuple[int, int, int], tolerance: float = 60, points: int = 0, include: list[Rect] = (), exclude: list[Rect] = (), lines: int = 0) -> tuple[np.ndarray, np.ndarray, float] | None:
    """x, y and coverage of the curve of a colour in one raster, as digitized() gives them; ``axes`` is x0, dx, y0 and dy. None without it."""
    x0, dx, y0, dy = axes
    m = mask(raster, rgb, tolerance, include, exclude)
    rows = columns(erase_lines(m, lines) if lines else m)
    known = np.flatnonzero(~np.isnan(rows))
    if not len(known):
        return None
    share = len(known) / len(rows)
    for a, b in zip(known[:-1], known[1:]):
        if 1 < b - a <= max(0.03 * len(rows), 3) + 1:
            rows[a:b] = rows[a] + (rows[b] - rows[a]) * np.arange(b - a) / (b - a)
    at = np.flatnonzero(~np.isnan(rows))
    x, y = x0 + dx * at, y0 + dy * rows[at]
    if points:
        grid = np.linspace(x[0], x[-1], points)
        x, y = grid, np.interp(grid, x, y)
    return x, y, share


def digitized(content: Column, width: Column, height: Column, axes: Column, rgb: tuple[int, int, int], tolerance: float = 60, points: int = 0, include: list[Rect] = (), exclude: list[Rect] = (), lines: int = 0) -> Column:
    """struct(x, y, coverage) of the curve of a colour in an RGBA raster (rows from the top).

    ``axes`` is struct(x0, dx, y0, dy): value = x0 + dx * column and y0 + dy * row. Only pixels in ``include`` and outside
    ``exclude`` count; with ``lines``, straight runs of at least so many pixels are erased first. Gaps of at most 3 % of the
    columns are bridged; ``points`` > 0 resamples evenly.
    """

    def run(data, w, h, x0, dx, y0, dy):
        return curve(np.frombuffer(data, np.uint8).reshape(int(h), int(w), 4), (x0, dx, y0, dy), rgb, tolerance, points, include, exclude, lines)

    fields = {"x": "array<double>", "y": "array<double>", "coverage": "double"}
    return K.struct(fields, run, content, width, height, axes["x0"], axes["dx"], axes["y0"], axes["dy"])


def skew_angle(m: np.ndarray, most: float = 15.0) -> float:
    """Degrees by which a mask of straight rows is turned: rows are sharpest when it is undone (first by half degrees,
    then by twentieths)."""
    r, c = np.nonzero(m)
    if len(r) < 2:
        return 0.0
    c = c - m.shape[1] / 2

    def sharp(angle: float) -> float:
        rows = np.rint(r - np.tan(np.radians(angle)) * c).astype(int)
        return float((np.bincount(rows - rows.min()).astype(float) ** 2).sum())

    best = max(np.arange(-most, most + 0.25, 0.5), key=sharp)
    return float(max(np.arange(best - 0.5, best + 0.525, 0.05), key=sharp))


def blockiness(raster: np.ndarray) -> float:
    """How much greater the steps between 8 x 8 blocks are than those inside them; about 1 without compression."""
    lum = raster[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])
    d = np.abs(np.diff(lum, axis=1)).mean(axis=0)
    at = (np.arange(len(d)) % 8) == 7
    inner = d[~at].mean() if (~at).any() else 0.0
    return float(d[at].mean() / inner) if at.any() and inner > 0 else 1.0


def quality_warnings(width: Column, height: Column, coverage: Column, blocks: Column, x_pixels: Column | None = None, y_pixels: Column | None = None, gaps: Column | None = None) -> Column:
    """What may make a digitised curve inexact: a small image, strong compression, gaps, places for the calibration of an
    axis that lie within 100 pixels (``x_pixels``, ``y_pixels``: their distance), gaps that were bridged (``gaps``)."""
    near = lambda c, name: F.when(F.abs(c) < 100, f"calibration points of {name} are close")
    found = [F.when(width < 600, "narrow image"), F.when(width * height < 150_000, "few pixels"), F.when(coverage < 0.85, "gaps in the curve"), F.when(blocks > 1.5, "strong compression")]
    found += [near(c, name) for c, name in ((x_pixels, "x"), (y_pixels, "y")) if c is not None]
    if gaps is not None:
        found.append(F.when(gaps > 0, "gaps were bridged"))
    return F.array_compact(F.array(*found))


def uncertainty(axes: Axes, x: Column) -> Column:
    """struct(dx, dy) of half a pixel on both axes; on a logarithmic one, its median over the places ``x`` (an array)."""
    middle = F.array_sort(F.transform(x, lambda v: half_pixel(axes, "x", v)))
    return F.struct((F.get(middle, F.floor(F.size(middle) / 2).cast("int")) if axes.x_log else half_pixel(axes, "x", F.lit(1.0))).alias("dx"), half_pixel(axes, "y", F.lit(1.0)).alias("dy"))


def dominant_colours(raster: np.ndarray, most: int = 6, apart: float = 70.0) -> list[tuple[int, int, int, int]]:
    """(r, g, b, pixels) of the commonest saturated colours, by bins of hue and value; near ones are merged."""
    c = raster[..., :3].reshape(-1, 3).astype(int)
    chroma = c.max(1) - c.min(1)
    c = c[(chroma >= 40) & (raster[..., 3].ravel() >= 16)]
    if not len(c):
        return []
    high, span = c.max(1), c.max(1) - c.min(1)
    k = c.argmax(1)
    rows = np.arange(len(c))
    hue = (2 * k + (c[rows, (k + 1) % 3] - c[rows, (k + 2) % 3]) / span) % 6
    key = (hue * 4).astype(int) * 8 + high // 32
    out: list[list[float]] = []
    bins, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    means = np.stack([np.bincount(inverse, c[:, j]) / counts for j in range(3)], axis=1)
    for b in np.argsort(-counts, kind="stable"):
        near = next((o for o in out if np.linalg.norm(np.array(o[:3]) - means[b]) < apart), None)
        if near:
            near[3] += int(counts[b])
        else:
            out.append([*means[b], int(counts[b])])
    out.sort(key=lambda o: -o[3])
    return [(round(o[0]), round(o[1]), round(o[2]), int(o[3])) for o in out[:most]]
