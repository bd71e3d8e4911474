"""Subtitle images in binary columns: palette bitmaps to grey PGM, PGM headers, crops by box and by word.

One image a row, as one film's cue; Arrow hands the bytes to numpy.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Opacity over which a pixel shows; brightness of a glyph's core and of its edge; what counts as
#: foreground in grey images; brightness under which a grey pixel is ink.
OPAQUE, CORE, EDGE, FOREGROUND, INK = 16, 160, 95, 220, 245
#: What a core, an edge and the ground are in two-level images.
BLACK, GREY, WHITE = 0, 64, 255
#: Room around a crop by box (x, y) and around a word.
BOX_ROOM, WORD_ROOM = (3, 2), (2, 2)
#: The least height of a band and width of a word; the blank columns between words are a sixth of the
#: band's height, within these bounds.
LEAST_BAND, LEAST_WORD, GAP = 4, 2, (2, 8)

CROPS = "array<struct<left:int,top:int,right:int,bottom:int,pgm:binary>>"
_SPACE = rb"[ \t\n\x0c\r]"
_HEADER = re.compile(rb"P5" + _SPACE + rb"*\+?([0-9]+)" + _SPACE + rb"+\+?([0-9]+)" + _SPACE + rb"+\+?([0-9]+)(" + _SPACE + rb"|\Z)")


def header_of(pgm: bytes) -> tuple[int, int, int] | None:
    """(width, height, where the pixels begin) of a binary PGM of 255 grey levels; None if it is none."""
    found = _HEADER.match(pgm)
    sizes = [int(x) for x in found.groups()[:3]] if found else [0, 0, 0]
    return (sizes[0], sizes[1], found.end()) if sizes[2] == 255 and max(sizes) < 2**63 else None


def pgm_of(grey: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (grey.shape[1], grey.shape[0]) + grey.astype(np.uint8).tobytes()


def _pixels(pgm: bytes | None) -> np.ndarray | None:
    head = header_of(pgm) if pgm is not None else None
    if head is None or not head[0] or not head[1] or len(pgm) - head[2] < head[0] * head[1]:
        return None
    return np.frombuffer(pgm, np.uint8, head[0] * head[1], head[2]).reshape(head[1], head[0])


def rasterised(indexes: np.ndarray, palette: bytes | None, grey: bool) -> tuple[np.ndarray, bool]:
    """An image of palette numbers as ink on white, and whether anything shows.

    Grey images keep the brightness of opaque pixels; two-level ones their cores and edges.  If that leaves
    no foreground, all that shows is black.  Without a palette every number but 0 is black.
    """
    if palette is None:
        shows = indexes > 0
        return np.where(shows, BLACK, WHITE), bool(shows.any())
    own = np.zeros((256, 4), np.int64)  # numbers beyond the palette are clear
    held = len(palette) // 4
    own[:held] = np.frombuffer(palette, np.uint8, 4 * held).reshape(held, 4)[:256]
    luma = (77 * own[:, 0] + 150 * own[:, 1] + 29 * own[:, 2]) >> 8
    shows = own[:, 3] > OPAQUE
    if grey:
        value = WHITE - (luma * own[:, 3] + 127) // 255
        strong = shows & (value < FOREGROUND)
    else:
        value = np.where(luma >= CORE, BLACK, np.where(luma >= EDGE, GREY, WHITE))
        strong = shows & (luma >= EDGE)
    value = np.where(shows, value, WHITE)
    if shows[indexes].any() and not strong[indexes].any():
        value = np.where(shows, BLACK, WHITE)
    return value[indexes], bool(shows[indexes].any())


def raster(width: Column, height: Column, stride: Column, pixels: Column, palette: Column, grey: Column, scale: int = 2) -> Column:
    """struct(pgm, visible) of a bitmap; null without a size or pixels, or where a row is longer than its stride.

    Grey images are made ``scale`` times as large.
    """

    @F.pandas_udf("pgm binary, visible boolean")
    def made(w: pd.Series, h: pd.Series, s: pd.Series, data: pd.Series, colours: pd.Series, grey_: pd.Series) -> pd.DataFrame:
        out = []
        for width, height, stride, raw, palette, g in zip(w, h, s, data, colours, grey_, strict=True):
            if raw is None or not width > 0 or not height > 0 or not stride >= width or len(raw) < stride * height:
                out.append((None, None))
                continue
            width, height, stride = int(width), int(height), int(stride)
            image, shows = rasterised(np.frombuffer(raw, np.uint8, stride * height).reshape(height, stride)[:, :width], palette, bool(g))
            out.append((pgm_of(image.repeat(scale, 0).repeat(scale, 1) if g else image), shows))
        return pd.DataFrame(out, columns=["pgm", "visible"])

    result = made(width.cast("long"), height.cast("long"), stride.cast("long"), pixels, palette, grey)
    return F.when(result["pgm"].isNotNull(), result)


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("width", "height", "offset")]))
def _header(pgm: pd.Series) -> pd.DataFrame:
    found = [(p is not None and header_of(p)) or (None, None, None) for p in pgm]
    return pd.DataFrame(found, columns=["width", "height", "offset"]).astype("Int64")


def pgm_header(pgm: Column) -> Column:
    """struct(width, height, offset); null for bytes that are no PGM of 255 levels."""
    result = _header(pgm)
    return F.when(result["offset"].isNotNull(), result)


@F.pandas_udf(BinaryType())
def _cropped(pgm: pd.Series, left: pd.Series, top: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.Series:
    out = []
    for raw, *box in zip(pgm, left, top, right, bottom, strict=True):
        grey = _pixels(raw)
        if grey is None or any(pd.isna(x) for x in box):
            out.append(None)
            continue
        x0, y0, x1, y1 = (max(int(x), 0) for x in box)
        height, width = grey.shape
        if x1 <= x0 or y1 <= y0 or x0 >= width or y0 >= height:
            out.append(None)
            continue
        out.append(pgm_of(grey[max(y0 - BOX_ROOM[1], 0) : y1 + BOX_ROOM[1], max(x0 - BOX_ROOM[0], 0) : x1 + BOX_ROOM[0]]))
    return pd.Series(out)


def cropped(pgm: Column, box: Column) -> Column:
    """The PGM of a box (left, top, right, bottom) with some room; null for an empty box or one outside."""
    return _cropped(pgm, *(box[c].cast("long") for c in ("left", "top", "right", "bottom")))


def runs(ink: np.ndarray, gap: int = 1) -> list[tuple[int, int]]:
    """Begins and ends of inked stretches, cut where ``gap`` blanks or more follow each other."""
    at = np.flatnonzero(ink)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > gap)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), (at[np.concatenate([cut, [len(at) - 1]])] + 1).tolist(), strict=True))


def words_of(grey: np.ndarray, gap: int | None = None) -> list[tuple[int, int, int, int]]:
    """Boxes (left, top, right, bottom) of the words of an image: bands of rows, then spans of columns.

    A band with fewer than two spans gives none, as it needs no cutting.
    """
    out, ink = [], grey < INK
    height, width = grey.shape
    for top, bottom in runs(ink.any(1)):
        if bottom - top < LEAST_BAND:
            continue
        least = gap or min(max((bottom - top) // 6, GAP[0]), GAP[1])
        spans = [s for s in runs(ink[top:bottom].any(0), least) if s[1] - s[0] >= LEAST_WORD]
        if len(spans) >= 2:
            out += [(max(a - WORD_ROOM[0], 0), max(top - WORD_ROOM[1], 0), min(b + WORD_ROOM[0], width), min(bottom + WORD_ROOM[1], height)) for a, b in spans]
    return out


def word_crops(pgm: Column, gap: int | None = None) -> Column:
    """The words of a PGM as an array of boxes with their own PGM, by band and from left to right."""

    @F.pandas_udf(CROPS)
    def made(images: pd.Series) -> pd.Series:
        out = []
        for raw in images:
            grey = _pixels(raw)
            boxes = [] if grey is None else words_of(grey, gap)
            out.append([{"left": x0, "top": y0, "right": x1, "bottom": y1, "pgm": pgm_of(grey[y0:y1, x0:x1])} for x0, y0, x1, y1 in boxes])
        return pd.Series(out)

    return made(pgm)
