"""Measurements of decoded images: many 32 x 32 RGBA samples at once, in numpy. The input is a column of 4096 bytes a row."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = 32
# Low, ideal from, ideal to, high of each quality, and its weight.
OCCUPANCY, BOX, COMPLEXITY = (0.015, 0.08, 0.62, 0.96), (0.08, 0.32, 0.92, 1.001), (0.005, 0.025, 0.20, 0.48)
WEIGHTS = {"occupancy": 0.30, "box": 0.25, "contrast": 0.30, "complexity": 0.15}

MEASURES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("foreground_occupancy", T.DoubleType()),
        T.StructField("box_occupancy", T.DoubleType()),
        T.StructField("contrast", T.DoubleType()),
        T.StructField("contrast_light", T.DoubleType()),
        T.StructField("contrast_dark", T.DoubleType()),
        T.StructField("edge_density", T.DoubleType()),
        T.StructField("box_aspect", T.DoubleType()),
        T.StructField("horizontal_contact", T.BooleanType()),
        T.StructField("vertical_contact", T.BooleanType()),
        T.StructField("canvas_background", T.StringType()),
        T.StructField("hash", T.StringType()),
        T.StructField("raster", T.StringType()),
        T.StructField("red", T.IntegerType()),
        T.StructField("green", T.IntegerType()),
        T.StructField("blue", T.IntegerType()),
    ]
)


def triangular(x: np.ndarray, low: float, ideal: float, to: float, high: float) -> np.ndarray:
    """0 outside low and high, 1 between ideal and to, straight lines between."""
    return np.interp(x, [low, ideal, to, high], [0.0, 1.0, 1.0, 0.0], left=0.0, right=0.0)


def measure(images: np.ndarray) -> pd.DataFrame:
    """images: (n, 32, 32, 4) of uint8. One row for each image."""
    n = len(images)
    px = images.astype(np.float64)
    rgb, alpha = px[..., :3], px[..., 3]
    back = px[:, [0, 0, -1, -1], [0, -1, 0, -1]].mean(axis=1)
    see_through = (alpha < 250).sum(axis=(1, 2))
    clear = (back[:, 3] < 192) | (see_through > 64)
    away = np.abs(rgb - back[:, None, None, :3]).sum(axis=3) / 765
    mask = (alpha >= 48) & (clear[:, None, None] | (away >= 0.10))
    count = mask.sum(axis=(1, 2))
    some = np.maximum(count, 1)
    mean = lambda v: (v * mask).sum(axis=(1, 2)) / some
    on = lambda surface: np.abs(rgb - surface).sum(axis=3) * (alpha / 255) / 765
    contrast = mean(np.where(clear[:, None, None], alpha / 255, away))
    rows, cols = mask.any(axis=2), mask.any(axis=1)
    first = lambda m: m.argmax(axis=1)
    last = lambda m: EDGE - 1 - m[:, ::-1].argmax(axis=1)
    wide, high = last(cols) - first(cols) + 1, last(rows) - first(rows) + 1
    flips = (mask[:, :, 1:] != mask[:, :, :-1]).sum(axis=(1, 2)) + (mask[:, 1:] != mask[:, :-1]).sum(axis=(1, 2))
    occupancy, box, density = count / EDGE**2, wide * high / EDGE**2, flips / (2 * EDGE * (EDGE - 1))
    quality = {"occupancy": triangular(occupancy, *OCCUPANCY), "box": triangular(box, *BOX), "contrast": np.clip((contrast - 0.08) / 0.42, 0, 1), "complexity": triangular(density, *COMPLEXITY)}
    score = np.floor(1000 * sum(w * quality[k] for k, w in WEIGHTS.items()) + 0.5) / 10
    none = count == 0
    z = lambda v: np.where(none, 0.0, v)
    # on white, in 8 x 8 blocks
    flat = rgb * (alpha / 255)[..., None] + 255 * (1 - alpha / 255)[..., None]
    light = (flat @ np.array([0.2126, 0.7152, 0.0722])).reshape(n, 8, 4, 8, 4).mean(axis=(2, 4)).reshape(n, 64)
    bits = np.packbits(light < light.mean(axis=1, keepdims=True), axis=1)
    raster = np.floor(light / 17 + 0.5).astype(np.uint8)
    color = np.minimum(255, np.floor(flat.mean(axis=(1, 2)) / 8 + 0.5) * 8).astype(np.int32)
    return pd.DataFrame(
        {
            "score": z(score), "foreground_occupancy": z(occupancy), "box_occupancy": z(box), "contrast": z(contrast), "contrast_light": z(mean(on(255))), "contrast_dark": z(mean(on(0))), "edge_density": z(density),
            "box_aspect": np.where(none, np.nan, wide / np.maximum(high, 1)), "horizontal_contact": mask[:, :, 0].any(axis=1) & mask[:, :, -1].any(axis=1), "vertical_contact": mask[:, 0].any(axis=1) & mask[:, -1].any(axis=1),
            "canvas_background": np.where(see_through > 0, "transparent", "opaque"), "hash": [bytes(b).hex() for b in bits], "raster": [base64.b64encode(r.tobytes()).decode() for r in raster], "red": color[:, 0], "green": color[:, 1], "blue": color[:, 2],
        }
    )


@F.pandas_udf(MEASURES)
def measured(pixels: pd.Series) -> pd.DataFrame:
    """Measurements of 32 x 32 RGBA samples; nulls for rows of another length."""
    ok = pixels.map(lambda p: p is not None and len(p) == EDGE * EDGE * 4).to_numpy(bool)
    out = pd.DataFrame(index=pixels.index, columns=[f.name for f in MEASURES.fields], dtype=object)
    if ok.any():
        images = np.frombuffer(b"".join(bytes(p) for p in pixels[ok]), np.uint8).reshape(-1, EDGE, EDGE, 4)
        found = measure(images)
        found.index = pixels.index[ok]
        out.loc[ok] = found.astype(object)
    return out.where(out.notna(), None)


def content_box(image: np.ndarray) -> tuple[int, int] | None:
    """(width, height) of what is not background in an RGBA image: background is nearly transparent or like the first opaque corner."""
    px = image.astype(np.int64)
    corners = px[[0, 0, -1, -1], [0, -1, 0, -1]]
    solid = corners[corners[:, 3] >= 224]
    ground = px[..., 3] < 32
    if len(solid):
        ground |= np.abs(px[..., :3] - solid[0, :3]).sum(axis=2) <= 30
    rows, cols = np.flatnonzero(~ground.all(axis=1)), np.flatnonzero(~ground.all(axis=0))
    return (int(cols[-1] - cols[0] + 1), int(rows[-1] - rows[0] + 1)) if len(rows) else None


def raster_distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two rasters in base64 of 64 bytes."""
    digits = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(F.hex(F.unbase64(x)), 2 * i + 1, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(F.zip_with(digits(a), digits(b), lambda x, y: F.abs(x - y)), F.lit(0), lambda s, d: s + d) / F.lit(64.0)


def clipping_risk() -> Column:
    """Risk of 0 to 1 that artwork is cut off at its canvas, from contacts with opposing edges. Columns: width, height, box_aspect,
    horizontal_contact, vertical_contact, wordmark, source. 0.75 and more counts as cut."""
    canvas = F.coalesce(F.col("width") / F.col("height"), F.lit(1.0))
    aspect = F.col("box_aspect") * canvas
    square = canvas.between(0.72, 1.4)
    across, down = square & F.col("horizontal_contact"), square & F.col("vertical_contact")
    long = F.coalesce((across & (aspect >= 1.8)) | (down & (aspect > 0) & (aspect <= 1 / 1.8)), F.lit(False))
    crop = F.coalesce(F.col("wordmark") & ((across & (aspect >= 1.15)) | (down & (aspect <= 1 / 1.15))), F.lit(False))
    prone = F.coalesce(F.col("source").rlike("^(dom-img|dom-picture|browser-img|browser-picture)$|screenshot|favicon|^(html-icon|apple|mask-icon|ms-tile|manifest|besticon)$"), F.lit(False))
    low = F.coalesce(F.least("width", "height") < 96, F.lit(False))
    n = lambda cond, v: F.when(cond, v).otherwise(0.0)
    return F.least(F.lit(1.0), n(long, 0.55) + n(crop, 0.55) + F.when(crop & prone, 0.25).when(long & prone, 0.1).otherwise(0.0) + F.when(crop & low, 0.1).when(long & low, 0.05).otherwise(0.0))
