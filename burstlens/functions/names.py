"""Paths, tags and label text as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlens import constants as C


def normalize_name(raw: Column) -> Column:
    """Trimmed, lower case, blanks as underscores."""
    return F.replace(F.lower(strip(raw)), F.lit(" "), F.lit("_"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def posix_path(path: Column) -> Column:
    """Path text without doubled slashes, ``.`` steps and trailing slashes.

    Most paths are plain, which one search tells; only others are rewritten.
    """
    odd = path.rlike(r"//|/\.(?:/|$)|^\./|/$|^$")
    text = F.regexp_replace(path, r"/(\./)+|/{2,}", "/")
    text = F.regexp_replace(text, r"/{2,}", "/")
    text = F.regexp_replace(text, r"^\./|/\.$", "")
    text = F.regexp_replace(text, r"(?<=.)/$", "")
    return F.when(~odd, path).when(text == "", F.lit(".")).otherwise(text)


def base_name(path: Column) -> Column:
    return F.regexp_extract(posix_path(path), r"([^/]*)$", 1)


def stem(name: Column) -> Column:
    """File name without its last suffix; dot files keep their name."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def group_key(path: Column) -> Column:
    """Parent directory; ``.`` for bare names.

    The plain path is bound once, as the variable of a one-element array.
    """

    def parent(text: Column) -> Column:
        folder = F.regexp_extract(text, r"^(.*)/[^/]*$", 1)
        return (
            F.when(~text.contains("/"), F.lit("."))
            .when(folder == "", F.lit("/"))
            .otherwise(folder)
        )

    return F.get(F.transform(F.array(posix_path(path)), parent), F.lit(0))


def safe_name(path: Column) -> Column:
    """Flat file name: both slashes become ``__``."""
    return F.regexp_replace(posix_path(path), r"[/\\]", "__")


def label_name(path: Column) -> Column:
    return F.concat(stem(safe_name(path)), F.lit(".txt"))


def crop_path(base: str | None, path: Column, side: Column, tag: str = "stem") -> Column:
    """``<base>/<tag>_<side>_eye.jpg``; the tag is the file stem or 8 hex digits of md5."""
    if base is None:
        return F.lit(None).cast("string")
    if tag == "stem":
        label = stem(base_name(path))
    elif tag == "md5":
        label = F.substring(F.md5(path), 1, 8)
    else:
        raise ValueError(f"unknown tag rule: {tag}")
    return F.concat(F.lit(base.rstrip("/") + "/"), label, F.lit("_"), side, F.lit("_eye.jpg"))


@F.arrow_udf(T.StringType())
def _label_text(class_id: pa.Array, cells: pa.Array) -> pa.Array:
    """Label text of rows of 22 numbers; ``%.6f`` rounds the exact binary value.

    Spark's ``format_string`` rounds the shortest decimal text instead, so that 1/640
    would print as 0.001563, not 0.001562.
    """
    width = 4 + 3 * len(C.KEYPOINT_NAMES)
    form = " %.6f" * 4 + " %.6f %.6f %d" * len(C.KEYPOINT_NAMES)
    numbers = cells.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    whole = iter(zip(np.isfinite(numbers).all(axis=1).tolist(), numbers.tolist(), strict=True))
    texts = []
    for label, present in zip(class_id.to_pylist(), cells.is_valid().to_pylist(), strict=True):
        ok, row = next(whole) if present else (False, None)
        texts.append(f"{label}{form % tuple(row)}" if ok else None)
    return pa.array(texts, pa.string())


def label_line(
    box: Column, keypoints: Column, width: Column, height: Column, class_id: int = 0
) -> Column:
    """``class cx cy w h (kx ky v) x 6`` with six decimals.

    ``box`` is ``array<double>`` ``[x, y, w, h]`` and ``keypoints`` a flat
    ``array<double>``; incomplete trailing keypoints count as zeros.
    """
    w, h = width.cast("double"), height.cast("double")
    x, y, dx, dy = (F.get(box, F.lit(i)) for i in range(4))
    cells = [(x + dx / 2) / w, (y + dy / 2) / h, dx / w, dy / h]
    for i in range(len(C.KEYPOINT_NAMES)):
        complete = F.size(keypoints) > 3 * i + 2
        kx, ky, kv = (F.get(keypoints, F.lit(3 * i + j)) for j in range(3))
        cells += [F.when(complete, c).otherwise(F.lit(0.0)) for c in (kx / w, ky / h, kv)]
    return _label_text(F.lit(class_id), F.array(*cells))


def strip_keypoints(line: Column, n_tokens: int = 5) -> Column:
    """Box-only label: the first five tokens of a label line."""
    return F.array_join(F.slice(F.split(line, " "), 1, n_tokens), " ")


def usable_label(box: Column, width: Column, height: Column) -> Column:
    """A label needs a whole box and known image dims."""
    dims: Sequence[Column] = (width, height)
    known = F.lit(True)
    for dim in dims:
        known = known & F.coalesce(dim > 0, F.lit(False))
    return known & F.coalesce(F.size(box) == 4, F.lit(False))
