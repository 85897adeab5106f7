"""Pictures in, stacks and scores out: PNG codec, canvas fit, label field, command line."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.__main__ import main
from tesserae.functions import kernels
from tesserae.operators import stamps
from tesserae.plans import pictures
from tesserae.plans.recipe import recipe
from tesserae.sources import png


def raw_png(rows, colour, width, channels, filters, extra=b""):
    """A PNG whose rows are filtered by hand."""
    height, above, raw = len(rows), [0] * width * channels, b""
    for row, kind in zip(rows, filters):
        out = []
        for k, v in enumerate(row):
            left = row[k - channels] if k >= channels else 0
            corner = above[k - channels] if k >= channels else 0
            linear = left + above[k] - corner
            nearest = min((left, above[k], corner), key=lambda c: abs(c - linear))
            out.append((v - [0, left, above[k], (left + above[k]) // 2, nearest][kind]) % 256)
        raw += bytes([kind, *out])
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))
    return png.SIGNATURE + head + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_reads_every_filter():
    rng = np.random.default_rng(0)
    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        want = rng.integers(0, 256, (5, 7, channels))
        got = png.decode(raw_png(want.reshape(5, -1).tolist(), colour, 7, channels, [0, 1, 2, 3, 4]))
        grey = np.repeat(want[..., :1], 3, 2) if channels <= 2 else want[..., :3]
        assert (got[..., :3] == grey).all() and (got[..., 3] == (want[..., -1] if channels in (2, 4) else 255)).all()
    px = rng.integers(0, 256, (4, 3, 4)).astype(np.uint8)
    assert (png.decode(png.encode(px)) == px).all()
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_canvas_fit(spark):
    rows = [("a", y, x, 10.0 * y, 0.0, 0.0, 1.0) for y in range(4) for x in range(8)] + [("b", 0, 0, 7.0, 0.0, 0.0, 1.0)]
    px = spark.createDataFrame(rows, "image_id string, y int, x int, r double, g double, b double, alpha double")
    got = {(r.image_id, r.y, r.x): r.r for r in pictures.fit_canvas(px, 4).collect()}
    assert {k[1:] for k in got if k[0] == "a"} == {(y, x) for y in (1, 2) for x in range(4)} and got["a", 1, 0] == 5.0
    assert sum(k[0] == "b" for k in got) == 16
    cover = {(r.y, r.x) for r in pictures.fit_canvas(px.where("image_id = 'a'"), 4, "cover").collect()}
    assert cover == {(y, x) for y in range(4) for x in range(4)}


def test_fill_polygon_by_points():
    rng = np.random.default_rng(3)
    for _ in range(20):
        ring = rng.uniform(-2, 14, (rng.integers(3, 9), 2))
        inside = np.zeros((12, 12), bool)
        for y in range(12):
            for x in range(12):
                hits = 0
                for (ax, ay), (bx, by) in zip(ring, np.roll(ring, -1, 0)):
                    if (ay > y + 0.5) != (by > y + 0.5):
                        hits += ax + (y + 0.5 - ay) * (bx - ax) / (by - ay) < x + 0.5
                inside[y, x] = hits % 2
        assert (kernels.fill_polygon(ring, 12, 12) == inside).all()


def drawn_pictures():
    yy, xx = np.mgrid[:48, :48]
    disk = np.zeros((48, 48, 4), np.uint8)
    disk[(yy - 24) ** 2 + (xx - 24) ** 2 <= 300] = (200, 40, 30, 255)
    flag = np.zeros((40, 48, 4), np.uint8)
    flag[:, :24], flag[:, 24:] = (20, 60, 200, 255), (240, 220, 60, 255)
    flag[:4] = flag[-4:] = (255, 255, 255, 255)  # opaque: the subject comes from a flood of the corners
    return {"disk": disk, "flag": flag}


def test_command_line(spark, tmp_path, capsys):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for name, px in drawn_pictures().items():
        (source / f"{name}.png").write_bytes(png.encode(px))
    some = ["--canvas", "48", "--recall", "4", "--particles", "24", "--mode", "logo"]
    assert main(["approx", "--pictures", str(source), "--out", str(out), *some], spark) == 0
    body = (out / "disk.json").read_text()
    assert body.endswith("]\n") and json.loads(body)[0]["asset"] == "Circle" and png.decode((out / "flag.preview.png").read_bytes()).shape[2] == 4
    assert main(["validate", "--documents", str(out), *some], spark) == 0
    assert main(["render", "--documents", str(out), "--out", str(tmp_path / "drawn"), *some], spark) == 0
    assert (tmp_path / "drawn" / "disk.png").exists()
    capsys.readouterr()
    assert main(["score", "--documents", str(out), "--pictures", str(source), *some], spark) == 0
    assert "disk" in capsys.readouterr().out
    assert main(["prefit", "--out", str(tmp_path / "store"), *some], spark) == 0
    (out / "bad.json").write_text('[{"asset": "Line"}]')
    assert main(["validate", "--documents", str(out), *some], spark) == 1


def test_stacks_resemble_their_pictures(spark):
    files = spark.createDataFrame([(n, bytearray(png.encode(px))) for n, px in drawn_pictures().items()], "image_id string, content binary")
    run, library = recipe("logo", canvas=48, recall=4, particles=48, colours=3, max_faces=3), stamps.stamp_table(spark)
    faces, stack = pictures.picture_stacks(png.pixels_of(files), library, run)
    n = {r.image_id: r.n for r in faces.where("label >= 0").groupBy("image_id").agg(F.count_distinct("label").alias("n")).collect()}
    assert n["disk"] >= 1 and n["flag"] >= 2 and max(n.values()) <= 3
    got = {r.doc_id: r for r in pictures.score_stacks(stack, faces, library, run.canvas).collect()}
    assert all(r.cover > 0.8 and r.similarity > 0.5 and r.colour_error < 40 for r in got.values()) and got["disk"].iou > 0.9
    assert pictures.picture_stacks(png.pixels_of(files.where("false")), library, run)[1].count() == 0
