"""PNG, JPEG, BMP and GIF files as pixels for the digitizer, by Spark's image source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The longest edge of an image that is passed on; larger ones are reduced by a whole factor.
EDGE = 3200


def rgba(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Pixels (height, width, RGBA) of the image source's grey, BGR or BGRA bytes."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    out = np.full((height, width, 4), 255, np.uint8)
    out[..., :3] = a[..., 2::-1] if channels >= 3 else a[..., :1]
    if channels == 4:
        out[..., 3] = a[..., 3]
    return out


def reduced(pixels: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """The image with no edge above ``edge``: means of blocks of k x k pixels, those at the right and bottom of what is
    left there."""
    h, w = pixels.shape[:2]
    k = -(-max(h, w) // edge)
    if k < 2:
        return pixels
    rows, columns = np.arange(0, h, k), np.arange(0, w, k)
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.float64), rows, 0), columns, 1)
    sizes = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(columns, w))[None, :]
    return (sums / sizes[..., None]).round().astype(np.uint8)


def read_images(spark: SparkSession, path: str, edge: int = EDGE) -> DataFrame:
    """path, width, height and content (RGBA bytes, row by row) of every image under ``path``. Files that are no images
    have nulls in place of pixels. No shuffle."""

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for v in rows.to_pylist():
            if v is None or v["height"] is None or v["height"] < 1:
                out.append(None)
                continue
            p = reduced(rgba(v["data"], v["width"], v["height"], v["nChannels"]), edge)
            out.append({"width": p.shape[1], "height": p.shape[0], "content": p.tobytes()})
        return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary())]))

    found = spark.read.format("image").option("recursiveFileLookup", "true").load(path)
    pixels = F.arrow_udf(run, "struct<width:int,height:int,content:binary>")(F.col("image"))
    return found.select(F.col("image.origin").alias("path"), pixels.alias("p")).select("path", "p.*")
