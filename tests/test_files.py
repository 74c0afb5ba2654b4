"""Files: images, palettes, manifests, frame sets, previews, commands, and streams."""

import json
import os
import struct
import zlib

import numpy as np
import pytest

from gridloom import api, formats
from gridloom.sources import framesets, gif, palettes, png
from gridloom.sources.manifests import frames_of, read_manifests, write_manifest

RED = (255, 0, 0, 255)


def image(width=6, height=5, seed=1):
    made = np.random.default_rng(seed).integers(0, 256, (height, width, 4)).astype(np.uint8)
    made[made[..., 3] < 128] = 0
    return made


def save(path, array):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as file:
        file.write(png.encode(array))


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def test_png_round_trip_and_other_kinds():
    made = image()
    assert (png.decode(png.encode(made)) == made).all()
    head = lambda depth, kind: chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, depth, kind, 0, 0, 0))
    build = lambda *c: png.SIGNATURE + b"".join(c) + chunk(b"IEND", b"")
    data = lambda raw: chunk(b"IDAT", zlib.compress(raw))
    grey_alpha = build(head(8, 4), data(b"\x00\x0a\xff\x14\x00\x01\x1e\xff\x0a\x00"))
    assert png.decode(grey_alpha).tolist() == [[[10, 10, 10, 255], [0, 0, 0, 0]], [[30, 30, 30, 255], [40, 40, 40, 255]]]
    paletted = build(head(1, 3), chunk(b"PLTE", bytes([1, 2, 3, 9, 8, 7])), chunk(b"tRNS", b"\x00"), data(b"\x00\x40\x02\x40"))
    assert png.decode(paletted)[0].tolist() == [[0, 0, 0, 0], [9, 8, 7, 255]]
    rgb16 = build(head(16, 2), data((b"\x00" + b"\x11\x22\x33\x44\x55\x66" * 2) * 2))
    assert png.decode(rgb16)[0, 0].tolist() == [0x11, 0x33, 0x55, 255]
    for bad in (b"", b"GIF89a", png.encode(made)[:40], png.encode(made).replace(b"IHDR", b"IHDX")):
        with pytest.raises(ValueError):
            png.decode(bad)


def test_pixels_and_back(spark, tmp_path):
    made = {f"i{k}": image(4 + k, 3, k) for k in range(3)}
    for name, array in made.items():
        save(str(tmp_path / "in" / f"{name}.png"), array)
    images = png.read_images(spark, str(tmp_path / "in"))
    back = png.images_of(png.pixels_of(images)).collect()
    assert {os.path.basename(r.image_id)[:2]: np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, 4).tolist() for r in back} == {k: v.tolist() for k, v in made.items()}


def test_palette_files(tmp_path, spark):
    listed = [(18, 24, 56), (242, 193, 78)]
    for kind in ("hex", "gpl"):
        path = str(tmp_path / f"p.{kind.upper()}")
        palettes.write_palette(spark, listed, path, kind)
        assert palettes.read_palette(spark, path) == listed
    assert palettes.parse_hex("# a comment\n#0a0b0c trailing\n\n") == [(10, 11, 12)]
    for bad in ("", "red\n", "#zzzzzz\n"):
        with pytest.raises(ValueError):
            palettes.parse_hex(bad)
    with pytest.raises(ValueError):
        palettes.parse_gpl("GIMP Palette\n300 0 0\n")


def test_manifest_shapes(spark, tmp_path):
    rect = {"x": 1, "y": 2, "w": 3, "h": 4}
    path = str(tmp_path / "m" / "manifest.json")
    write_manifest(spark, path, {"cell_w": 3, "cell_h": 4, "cols": 1, "rows": 1}, [{"index": 0, "path": "a.png", "rect": rect, "duration_ms": 0, "pivot": {"x": 0, "y": 0}}])
    text = json.load(open(path))
    assert text["version"] == 1 and text["frames"][0] == {"index": 0, "path": "a.png", **rect, "pivot": {"x": 0, "y": 0}, "duration_ms": 0}
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"frames": [{"index": 0, "path": "a.png", "rect": rect, "unknown": 1}]}))
    row = frames_of(read_manifests(spark, str(old))).first()
    assert row.rect.asDict() == rect and read_manifests(spark, str(old)).first().version == 1
    broken = tmp_path / "broken.json"
    broken.write_text(json.dumps({"frames": [{"index": 0, "path": "a.png", "x": 1}]}))
    with pytest.raises(Exception, match="no rect"):
        frames_of(read_manifests(spark, str(broken))).collect()


def unpacked(data, bits):
    """Codes of variable width back to indexes."""
    clear, stop = 1 << bits, (1 << bits) + 1
    held = int.from_bytes(data, "little")
    table, width, last, out = [], bits + 1, None, bytearray()
    while True:
        code, held = held & ((1 << width) - 1), held >> width
        if code == clear:
            table, width, last = [bytes([i]) for i in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == stop:
            return bytes(out)
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out += entry
        last = entry


def test_gif_codes_come_back():
    rng = np.random.default_rng(3)
    for bits, n in ((2, 10), (4, 3000), (8, 60_000)):
        data = rng.integers(0, 1 << bits, n).astype(np.uint8).tobytes()
        assert unpacked(gif.lzw(data, bits), bits) == data


def test_gif_file():
    data = gif.encode([image(4, 4), image(6, 2)], 13, True, 2)
    assert data[:6] == b"GIF89a" and struct.unpack("<HH", data[6:10]) == (12, 8) and b"NETSCAPE2.0" in data and data.endswith(b"\x3b")
    assert b"NETSCAPE2.0" not in gif.encode([image()], 13, False)
    with pytest.raises(ValueError):
        gif.encode([image()], 13, True, 9)


def test_frame_set_sources(spark, tmp_path):
    for name in ("attack", "idle"):
        for i in range(2):
            save(str(tmp_path / "rows" / name / f"frame_{i:03d}.png"), image(4, 4, i))
    rows = framesets.read_frames(spark, str(tmp_path / "rows"), rows=True).orderBy("index").collect()
    assert [(r.tag, r.row, r.col) for r in rows] == [("attack", 0, 0), ("attack", 0, 1), ("idle", 1, 0), ("idle", 1, 1)]
    names = framesets.read_frames(spark, str(tmp_path / "rows" / "idle")).orderBy("index").collect()
    assert [r.path for r in names] == ["frame_000.png", "frame_001.png"]
    os.makedirs(tmp_path / "none")
    with pytest.raises(ValueError):
        framesets.read_frames(spark, str(tmp_path / "none"))


def test_commands_in_a_row(spark, tmp_path):
    sheet = np.zeros((32, 128, 4), np.uint8)
    for i in range(4):
        sheet[2 + i % 2 : 30, 32 * i + 4 : 32 * i + 28] = (250, 10 * i, 0, 255)
    path = str(tmp_path / "walk.png")
    save(path, sheet)
    assert api.inspect_frame(spark, path)["bbox"] == {"x": 4, "y": 2, "w": 120, "h": 28}
    sliced = api.slice_grid(spark, path, 4, out=str(tmp_path / "slice"))
    assert [f["rect"]["x"] for f in sliced["frames"]] == [0, 32, 64, 96]
    aligned = api.align_frames(spark, str(tmp_path / "slice"), out=str(tmp_path / "align"))
    assert len(aligned["frames"]) == 4
    report = api.export(spark, str(tmp_path / "align"), "sheet", str(tmp_path / "out"))
    assert (report["cols"], report["rows"]) == (4, 1) and os.path.exists(report["png"])
    preview = api.export(spark, str(tmp_path / "align"), "gif", str(tmp_path / "out"), fps=8)
    assert (preview["frame_delay_cs"], preview["duration_ms"]) == (13, 520) and os.path.exists(preview["gif"])
    same = api.diff_frames(spark, path, path, str(tmp_path / "d.png"))
    assert same["diff_pixels"] == 0 and same["total_pixels"] == 4096
    dry = api.resize_image(spark, path, str(tmp_path / "never.png"), up=2, dry_run=True)
    assert dry["output_w"] == 256 and not os.path.exists(tmp_path / "never.png")
    assert not api.envelope(api.export, spark, str(tmp_path / "align"), "mp4")["ok"]
    assert not api.envelope(api.inspect_frame, spark, str(tmp_path / "missing.png"))["ok"]


def test_registries():
    assert [f["name"] for f in formats.listed()] == ["gif", "sheet"] and len(api.spec()) == 17
    with pytest.raises(ValueError):
        formats.register(formats.Format("gif", "", None))


def test_names_of_outputs():
    expected = {
        ".cache/slime3.png": "slime3", "out/snap/slime3/native.png": "slime3", "out/slime3/snap/native.png": "slime3", "out/knight/resize/frame_000.png": "knight", "out/paladin1/rows": "paladin1",
        "out/knight/slice": "knight", "out/slice/knight": "knight", "a/b.png": "b", "out/knight/slice.png": "slice", "out/knight/background/x.png": "x", "": "artifact", ".": "artifact",
        ".png": "artifact", "out/a/out/b/prep/c.png": "b", "dir.d/": "dir.d",
    }
    assert {p: api.subject_of(p) for p in expected} == expected


def test_default_outputs(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    save("out/slime3/snap/native.png", np.tile(image(4, 4), (2, 2, 1)))
    path, dry = "out/slime3/snap/native.png", {"dry_run": True}
    (tmp_path / "p.hex").write_text("#121838\n#4a7ad8\n")
    assert api.prep_alpha(spark, path, **dry)["out"] == "out/slime3/prep/clean.png"
    assert api.prep_background(spark, path, **dry)["out"] == "out/slime3/prep/background.png"
    assert api.snap_pixels(spark, path, "p.hex", **dry)["out"] == "out/slime3/snap/snapped.png"
    assert api.snap_scale(spark, path, **dry)["out"] == "out/slime3/snap/native.png"
    assert api.palette_extract(spark, path, **dry)["out"] == "out/slime3/palette/extracted-16.hex"
    assert api.palette_apply(spark, path, "p.hex", **dry)["out"] == "out/slime3/palette/applied.png"
    assert api.normalize_detail(spark, path, factor=1, **dry)["out"] == "out/slime3/normalize/detail.png"
    assert api.resize_image(spark, path, up=2, **dry)["out"] == "out/slime3/resize/image.png"
    assert api.diff_frames(spark, path, path, **dry)["out"] == "out/slime3_vs_slime3/diff/diff.png"
    assert api.slice_grid(spark, path, 2, 2)["out"] == "out/slime3/slice" and os.path.exists("out/slime3/slice/frame_003.png")
    report = api.prep_alpha(spark, path, **dry)
    assert "out: out/slime3/prep/clean.png" in api.as_text(report).splitlines() and "alpha:" in api.as_text(api.inspect_frame(spark, path))


def test_declared_grid(spark, tmp_path):
    sheet = np.zeros((8, 32, 4), np.uint8)
    for i in range(4):
        sheet[:7, 8 * i : 8 * i + 7] = RED
    save(path := str(tmp_path / "sheet.png"), sheet)
    save(flat := str(tmp_path / "flat.png"), np.full((8, 8, 4), 255, np.uint8))
    detected = api.inspect_sheet(spark, path)
    assert detected["grid"] == {"cols": 4, "rows": 1, "cell_w": 8, "cell_h": 8, "offset_x": 0, "offset_y": 0, "confidence": 1.0} and "grid_warning" not in detected
    assert "grid_warning" not in api.inspect_sheet(spark, path, "4X1") and "grid" not in api.inspect_sheet(spark, path, "None")
    declared = api.inspect_sheet(spark, path, "2x1")
    assert declared["grid"] == {"cols": 2, "rows": 1, "cell_w": 16, "cell_h": 8, "offset_x": 0, "offset_y": 0, "confidence": 1.0}
    assert declared["grid_warning"] == "declared grid 2x1 (cell 16x8) does not match detected 4x1 (cell 8x8, confidence 1.00)"
    assert api.inspect_sheet(spark, flat, "2x2")["grid_warning"] == "auto-detection found no grid structure to compare against"
    assert "grid" not in api.inspect_sheet(spark, flat)
    assert not api.envelope(api.inspect_sheet, spark, path, "3x1")["ok"]


def test_resize_frames_keeps_the_header(spark, tmp_path):
    frames = [{"index": i, "path": f"frame_{i:03d}.png", "rect": {"x": 3 + 16 * i, "y": 4, "w": 16, "h": 16}, "duration_ms": 80 + i} for i in range(2)]
    frames[0]["pivot"] = {"x": 5, "y": 11}
    for i, size in enumerate((16, 18)):
        save(str(tmp_path / "set" / f"frame_{i:03d}.png"), np.full((size, size, 4), 255, np.uint8))
    header = {"cell_w": 0, "cell_h": 1, "cols": 2, "rows": 1, "source": "s", "sheet": "x.png", "sheet_size": {"w": 32, "h": 16}}
    write_manifest(spark, str(tmp_path / "set" / "manifest.json"), header, frames)
    report = api.resize_frames(spark, str(tmp_path / "set"), str(tmp_path / "half"), down=2, method="Nearest")
    made = json.load(open(tmp_path / "half" / "manifest.json"))
    assert (report["cell_w"], report["cell_h"]) == (8, 8) == (made["cell_w"], made["cell_h"])
    assert report["warnings"] == ['frame "frame_001.png" has no pivot; leaving manifest pivot absent']
    assert made["sheet"] == "x.png" and made["sheet_size"] == {"w": 32, "h": 16} and made["source"] == "s"
    assert made["frames"][0]["pivot"] == {"x": 2, "y": 5} and made["frames"][0]["x"] == 3 and made["frames"][1]["duration_ms"] == 81 and "pivot" not in made["frames"][1]
    assert not api.envelope(api.resize_frames, spark, str(tmp_path / "set"), up=2, method="cubic")["ok"]


def test_stream_of_images(spark, tmp_path):
    from gridloom.streaming.images import reports, watch

    save(str(tmp_path / "in" / "a.png"), image())
    query = reports(watch(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("reports").outputMode("update").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert spark.table("reports").count() == 1
