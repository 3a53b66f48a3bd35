"""The pixel pass: Arrow batches in, gray crops or crop moments out.

Crops of equal shape are stacked and measured together. All sums but the gradient's are
sums of integers, so they do not depend on the order of work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens import constants as C
from burstlens.schemas import MOMENTS

# Pixels measured at once; bounds the memory of a Python worker, not the input.
_CHUNK_PIXELS = 1 << 21


def gaussian_taps(sigma: float = C.NOISE_SIGMA, bits: int = 8) -> np.ndarray:
    """Integer Gaussian taps that sum to ``2**bits``.

    The window is the 8-bit rule ``round(6 * sigma + 1) | 1``; from the outside in, the
    rounding error of each tap is carried to the next, and the centre takes the rest.
    """
    size = int(round(sigma * 6 + 1)) | 1
    half = size // 2
    weights = [math.exp(-((i - half) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    total = sum(weights)
    taps = np.zeros(size, dtype=np.int64)
    carry = 0.0
    for i in range(half):
        exact = weights[i] / total * (1 << bits) + carry
        taps[i] = taps[size - 1 - i] = round(exact)
        carry = exact - taps[i]
    taps[half] = (1 << bits) - taps.sum()
    return taps


_TAPS = gaussian_taps()


def _mirror(n: int, pad: int) -> np.ndarray:
    """Positions ``-pad .. n+pad-1`` folded back into a side of ``n``; edges not repeated."""
    period = 2 * (n - 1)
    pos = np.arange(-pad, n + pad) % period
    return np.where(pos < n, pos, period - pos)


def _blur(stack: np.ndarray) -> np.ndarray:
    """Separable integer Gaussian, rounded half up once at the end."""
    pad = len(_TAPS) // 2
    out = stack.astype(np.int32)
    for axis in (2, 1):
        n = out.shape[axis]
        wide = out.take(_mirror(n, pad), axis=axis)
        acc = np.zeros_like(out)
        for i, tap in enumerate(_TAPS):
            if tap:
                acc += np.int32(tap) * wide.take(np.arange(i, i + n), axis=axis)
        out = acc
    return (out + (1 << 15)) >> 16


def stack_moments(stack: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of a stack of equally shaped gray crops, ``(crops, height, width)``."""
    count, h, w = stack.shape
    axes = (1, 2)
    v = stack.astype(np.int64)
    out = {
        "crop_width_px": np.full(count, w, dtype=np.int32),
        "crop_height_px": np.full(count, h, dtype=np.int32),
        "n_px": np.full(count, h * w, dtype=np.int64),
        "sum_v": v.sum(axes),
        "sum_v2": (v * v).sum(axes),
        "n_bright": (stack >= C.BRIGHT_LEVEL).sum(axes),
        "n_dark": (stack <= C.DARK_LEVEL).sum(axes),
    }
    if h < 2 or w < 2:
        zero = np.zeros(count, dtype=np.int64)
        out.update(sum_lap=zero, sum_lap2=zero, sum_resid=zero, sum_grad=zero.astype(float))
        return out
    p = stack.astype(np.int32).take(_mirror(h, 1), axis=1).take(_mirror(w, 1), axis=2)
    north, south = p[:, :-2, 1:-1], p[:, 2:, 1:-1]
    west, east = p[:, 1:-1, :-2], p[:, 1:-1, 2:]
    nw, ne, sw, se = p[:, :-2, :-2], p[:, :-2, 2:], p[:, 2:, :-2], p[:, 2:, 2:]
    lap = (north + south + west + east - 4 * p[:, 1:-1, 1:-1]).astype(np.int64)
    gx = (ne - nw) + 2 * (east - west) + (se - sw)
    gy = (sw - nw) + 2 * (south - north) + (se - ne)
    out["sum_lap"] = lap.sum(axes)
    out["sum_lap2"] = (lap * lap).sum(axes)
    out["sum_grad"] = np.sqrt((gx * gx + gy * gy).astype(np.float64)).sum(axes)
    out["sum_resid"] = np.abs(v - _blur(stack)).sum(axes)
    return out


def _ragged_moments(flat: np.ndarray, starts: np.ndarray, hs: np.ndarray, ws: np.ndarray):
    """Moments of crops laid end to end in ``flat``; unreadable shapes give zero rows."""
    total = len(starts)
    cols = {
        f.name: np.zeros(total, dtype=float if f.name == "sum_grad" else np.int64)
        for f in MOMENTS.fields
    }
    shapes, member = np.unique(np.stack([hs, ws], axis=1), axis=0, return_inverse=True)
    member = member.reshape(-1)
    for s, (h, w) in enumerate(shapes):
        if h < 1 or w < 1:
            continue
        rows = np.flatnonzero(member == s)
        n = int(h) * int(w)
        step = max(1, _CHUNK_PIXELS // n)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            stack = flat[starts[part][:, None] + np.arange(n)].reshape(len(part), h, w)
            for name, values in stack_moments(stack).items():
                cols[name][part] = values
    return pa.StructArray.from_arrays(
        [
            pa.array(cols[f.name], type=pa.int32())
            if f.dataType.typeName() == "integer"
            else pa.array(cols[f.name])
            for f in MOMENTS.fields
        ],
        names=[f.name for f in MOMENTS.fields],
    )


def _binary_layout(data: pa.Array):
    """Flat bytes, start and length of every value of a binary array (null as empty)."""
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32, count=len(data) + 1 + data.offset)
    offsets = offsets[data.offset :].astype(np.int64)
    body = data.buffers()[2]
    flat = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def _luma(pixels: np.ndarray, bgr: bool) -> np.ndarray:
    """8-bit luma of an ``(h, w, channels)`` block; one channel is gray already."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    first, green, third = (pixels[:, :, i].astype(np.int32) for i in range(3))
    red, blue = (third, first) if bgr else (first, third)
    half = 1 << (C.LUMA_SHIFT - 1)
    total = C.LUMA_RED * red + C.LUMA_GREEN * green + C.LUMA_BLUE * blue + half
    return (total >> C.LUMA_SHIFT).astype(np.uint8)


def _turn(gray: np.ndarray, orientation: int) -> np.ndarray:
    """A stored crop turned to how it is displayed."""
    if 5 <= orientation <= 8:
        gray = gray.T
    if orientation in (2, 3, 6, 7):
        gray = gray[:, ::-1]
    if orientation in (3, 4, 7, 8):
        gray = gray[::-1]
    return gray


def _gray_crops(scanlines: pa.Array, channels: pa.Array, orientation: pa.Array, bgr: bool):
    """Yield a displayed gray crop per row, None where there are no pixels."""
    n_channels = channels.to_pylist()
    turns = orientation.to_pylist()
    for i, lines in enumerate(scanlines):
        rows = lines.as_py()
        if not rows or not n_channels[i] or not rows[0]:
            yield None
            continue
        block = np.frombuffer(b"".join(rows), dtype=np.uint8)
        block = block.reshape(len(rows), -1, n_channels[i])
        yield _turn(_luma(block, bgr), turns[i] or 1)


@F.arrow_udf(MOMENTS)
def _moments_of_gray(gray: pa.Array, width: pa.Array) -> pa.Array:
    flat, starts, sizes = _binary_layout(gray)
    ws = np.nan_to_num(width.to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    hs = np.where(ws > 0, sizes // np.maximum(ws, 1), 0)
    return _ragged_moments(flat, starts, hs, ws)


_GRAY_CROP = "struct<gray: binary, crop_width_px: int, crop_height_px: int>"


def _gray_udf(bgr: bool):
    @F.arrow_udf(_GRAY_CROP)
    def gray_crop(scanlines: pa.Array, channels: pa.Array, orientation: pa.Array) -> pa.Array:
        body, widths, heights = [], [], []
        for gray in _gray_crops(scanlines, channels, orientation, bgr):
            # An empty window stands for one black pixel of width 0.
            body.append(b"\0" if gray is None else np.ascontiguousarray(gray).tobytes())
            widths.append(0 if gray is None else gray.shape[1])
            heights.append(0 if gray is None else gray.shape[0])
        return pa.StructArray.from_arrays(
            [pa.array(body, pa.binary()), pa.array(widths, pa.int32()), pa.array(heights, pa.int32())],
            names=["gray", "crop_width_px", "crop_height_px"],
        )

    return gray_crop


def _moments_udf(bgr: bool):
    @F.arrow_udf(MOMENTS)
    def moments(scanlines: pa.Array, channels: pa.Array, orientation: pa.Array) -> pa.Array:
        body, hs, ws, starts, at = [], [], [], [], 0
        for gray in _gray_crops(scanlines, channels, orientation, bgr):
            h, w = (0, 0) if gray is None else gray.shape
            if gray is not None:
                body.append(np.ascontiguousarray(gray).reshape(-1))
            hs.append(h)
            ws.append(w)
            starts.append(at)
            at += h * w
        flat = np.concatenate(body) if body else np.zeros(0, np.uint8)
        to_array = lambda values: np.array(values, dtype=np.int64)
        return _ragged_moments(flat, to_array(starts), to_array(hs), to_array(ws))

    return moments


def gray_moments(gray: Column, width: Column) -> Column:
    """Moments of a row-major gray crop (``binary``, one byte per pixel)."""
    return _moments_of_gray(gray, width)


def scanline_gray(scanlines: Column, channels: Column, orientation: Column, bgr: bool) -> Column:
    """Gray crop from the stored scanlines of a window."""
    return _gray_udf(bgr)(scanlines, channels, orientation)


def scanline_moments(scanlines: Column, channels: Column, orientation: Column, bgr: bool) -> Column:
    """Moments straight from scanlines: gray and measures in one Python hop."""
    return _moments_udf(bgr)(scanlines, channels, orientation)


def scanlines(data: Column, width: Column, channels: Column, window: Column) -> Column:
    """The bytes of a stored window, one binary per line, cut on the JVM side.

    Only these bytes ever reach Python; the image itself does not.
    """
    line = width.cast("int") * channels
    start = window["x1"] * channels + 1
    span = (window["x2"] - window["x1"]) * channels
    cut = F.transform(
        F.sequence(window["y1"], window["y2"] - 1),
        lambda y: F.substring(data, y * line + start, span),
    )
    empty = (window["x2"] <= window["x1"]) | (window["y2"] <= window["y1"])
    return F.when(~empty, cut)
