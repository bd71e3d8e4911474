"""Rasters, PGM headers and crops, word cutting, text packets: against plain loops and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.functions import images
from cuewright.functions.text import plain_text_packet
from cuewright.sources.images import listed, pgm_files, read_files, write_images


def plain_raster(indexes, palette, grey):
    """Pixel by pixel."""
    shows, value = [], []
    for i in indexes.ravel().tolist():
        if palette is None:
            shows.append(i > 0)
            value.append(0 if i else 255)
            continue
        r, g, b, a = palette[4 * i : 4 * i + 4] if 4 * i + 3 < len(palette) else (0, 0, 0, 0)
        luma = (77 * r + 150 * g + 29 * b) >> 8
        shows.append(a > 16)
        value.append(255 if a <= 16 else 255 - (luma * a + 127) // 255 if grey else 0 if luma >= 160 else 64 if luma >= 95 else 255)
    strong = [s and (palette is None or (v < 220 if grey else v < 255)) for s, v in zip(shows, value, strict=True)]
    if any(shows) and not any(strong):
        value = [0 if s else 255 for s in shows]
    return np.array(value).reshape(indexes.shape), any(shows)


def test_rasters_equal_pixel_loops():
    rng = np.random.default_rng(4)
    for k in range(60):
        image = rng.integers(0, 256, rng.integers(1, 9, 2))
        palette = None if k % 4 == 0 else bytes((rng.integers(0, [60, 256, 256, 256][k % 4], 4 * [256, 100, 256][k % 3])).astype(np.uint8))
        got, shows = images.rasterised(image, palette, k % 2 == 0)
        want, seen = plain_raster(image, palette, k % 2 == 0)
        assert (got == want).all() and shows == seen


def test_raster_of_bad_bitmaps_is_null(spark):
    rows = [(2, 2, 3, bytearray(b"\x01\x00\x09\x00\x01\x09"), True), (0, 2, 3, bytearray(6), False), (2, 2, 1, bytearray(6), False), (2, 2, 3, bytearray(5), False), (2, None, 3, bytearray(6), False), (2, 2, 3, None, False)]
    made = spark.createDataFrame(rows, "w int, h int, s int, raw binary, ok boolean").withColumn("r", images.raster(F.col("w"), F.col("h"), F.col("s"), F.col("raw"), F.lit(None).cast("binary"), F.lit(False)))
    for r in made.collect():
        assert (r.r is not None) == r.ok
    assert bytes(made.first().r.pgm) == b"P5\n2 2\n255\n\x00\xff\xff\x00"
    grey = spark.range(1).select(images.raster(F.lit(1), F.lit(1), F.lit(1), F.lit(b"\x05"), F.lit(None).cast("binary"), F.lit(True), 3).alias("r")).first().r
    assert bytes(grey.pgm) == b"P5\n3 3\n255\n" + bytes(9) and grey.visible


@pytest.mark.parametrize(
    "pgm, want",
    [(b"P5\n3 2\n255\nabcdef", (3, 2, 11)), (b"P53 2 255 abcdef", (3, 2, 10)), (b"P5 \r\n+3\x0c2\t0255\nx", (3, 2, 15)), (b"P5 3 2 255", (3, 2, 10)), (b"P5 3 2 254 x", None), (b"P6 3 2 255 x", None), (b"P5 3 2", None), (b"P5 3 -2 255 x", None), (b"P5\x0b3 2 255 x", None), (b"", None), (b"P5 3 2 255x", None)],
)
def test_headers(pgm, want):
    assert images.header_of(pgm) == want


def test_crops_by_box(spark):
    grey = np.arange(12 * 9, dtype=np.uint8).reshape(9, 12)
    boxes = [(4, 3, 6, 5), (-5, -5, 1, 1), (11, 8, 99, 99), (5, 5, 5, 9), (12, 0, 14, 2), (None, 0, 3, 3)]
    made = spark.createDataFrame([(*b, bytearray(images.pgm_of(grey))) for b in boxes], "left int, top int, right int, bottom int, pgm binary")
    got = [r.c and bytes(r.c) for r in made.select(images.cropped(F.col("pgm"), F.struct("left", "top", "right", "bottom")).alias("c")).collect()]
    assert got == [images.pgm_of(grey[1:7, 1:9]), images.pgm_of(grey[0:3, 0:4]), images.pgm_of(grey[6:9, 8:12]), None, None, None]


def test_words_are_cut_at_gaps():
    ink = np.full((16, 40), 255, np.uint8)
    ink[2:7, 3:9] = ink[2:7, 10:14] = ink[2:7, 20:26] = 0  # the first two are one blank column apart
    ink[9:12, 5:30] = 0  # too low a band
    ink[12:16, 39] = 0
    assert images.words_of(ink) == [(1, 0, 16, 9), (18, 0, 28, 9)]
    assert images.words_of(ink, 1) == [(1, 0, 11, 9), (8, 0, 16, 9), (18, 0, 28, 9)]
    assert images.words_of(np.full((3, 3), 255, np.uint8)) == []


def test_image_files(spark, tmp_path):
    rows = [("1.pgm", bytearray(b"P5 1 1 255 x")), ("2.pgm", bytearray(b"nothing")), ("3.txt", bytearray(b"P5 1 1 255 x")), ("4.pgm", None)]
    assert write_images(spark.createDataFrame(rows, "name string, content binary"), str(tmp_path / "files")) == 3
    got = {r.name: (bytes(r.content), r.head and tuple(r.head)) for r in pgm_files(spark, str(tmp_path / "files")).collect()}
    assert got == {"1.pgm": (b"P5 1 1 255 x", (1, 1, 11)), "2.pgm": (b"nothing", None)}


def test_text_packets(spark):
    packet = lambda text, more=b"", n=None: bytearray((len(text) if n is None else n).to_bytes(2, "big") + text + more)
    pairs = [
        (packet(b"plain"), packet(b"plain")), (packet(b"<font a=1>x</font>{\\fs20}"), packet(b"x")), (packet(b"x", b"boxes"), packet(b"x")), (packet(b"x", n=9), packet(b"x", n=9)),
        (bytearray(b"\x00"), bytearray(b"\x00")), (bytearray(b""), bytearray(b"")), (packet(b""), packet(b"")), (packet(b"a\xffb"), packet("a�b".encode())), (packet(b"{\\an8\\fnArial}x"), packet(b"{\\an8}x")),
        (packet(b"\xff" * 30_000), packet(b"\xff" * 30_000)), (None, None),
    ]
    made = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(pairs)], "k int, p binary").select("k", plain_text_packet(F.col("p")).alias("p")).collect()
    assert {r.k: r.p for r in made} == {k: want for k, (_, want) in enumerate(pairs)}


def test_files_are_listed_and_read_in_folders_below(spark, tmp_path):
    rows = [(f"{k}.{'pgm' if k % 3 else 'txt'}", bytes([k % 256]) * (k % 5) * 40_000) for k in range(300)]
    want = {n: c for n, c in rows if c and n.endswith(".pgm")}
    for sharded in (False, True):
        folder = str(tmp_path / f"files-{sharded}")
        assert write_images(spark.createDataFrame(rows, "name string, content binary"), folder, sharded) == 300
        (tmp_path / f"files-{sharded}" / "_hidden.pgm").write_bytes(b"x")
        got = read_files(spark, folder, ".pgm").collect()
        assert len(got) == len(want) and {r.name: bytes(r.content) for r in got} == want
        assert all(r.path.startswith("file:/") and r.path.endswith("/" + r.name) for r in got)
        assert {r.name for r in listed(spark, folder, ".pgm").collect()} == set(want)
        plan = listed(spark, folder, ".pgm")._jdf.queryExecution().optimizedPlan().toString()
        assert "binaryFile" not in plan  # its file index is the driver's
