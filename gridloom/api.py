"""The commands: each reads files, applies operators, writes results unless dry_run, and returns a report."""

from __future__ import annotations

import inspect as _inspect
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import __version__, formats
from gridloom.functions.colour import checked, hex_colour, parse_colour, parse_size
from gridloom.operators import align as _align
from gridloom.operators import cleanup, colours, compare, grid, scale, segment, stats
from gridloom.sources import files, framesets
from gridloom.sources.files import absolute
from gridloom.sources.manifests import read_manifests, write_manifest
from gridloom.sources.palettes import palette_table, read_palette, write_palette
from gridloom.sources.png import images_of, pixels_of, read_images, write_images

COMMANDS: dict[str, Callable] = {}
# The names of stages in output paths.
STAGES = ("align", "diff", "export", "generate", "normalize", "palette", "prep", "resize", "rows", "segment", "slice", "snap")


def command(name: str):
    def add(function: Callable) -> Callable:
        if name in COMMANDS:
            raise ValueError(f"there is a command {name}")
        COMMANDS[name] = function
        return function

    return add


def spec() -> list[dict]:
    """All commands with their arguments and defaults, by name."""
    found = []
    for name, function in sorted(COMMANDS.items()):
        arguments = [p for p in _inspect.signature(function).parameters.values() if p.name != "spark"]
        flags = [{"name": p.name, "default": None if p.default is p.empty else p.default, "required": p.default is p.empty} for p in arguments]
        found.append({"command": name, "summary": (function.__doc__ or "").strip().split("\n")[0], "flags": flags})
    return found


def version() -> str:
    return __version__


def envelope(call: Callable, *args, **options) -> dict:
    """{ok, data} of a call, or {ok, error}."""
    try:
        return {"ok": True, "data": call(*args, **options)}
    except Exception as error:  # noqa: BLE001
        return {"ok": False, "error": str(error)}


def subject_of(path: str) -> str:
    """The subject in out/<subject>/<stage> or out/<stage>/<subject>, from the right; else the file's name
    without its extension; else artifact."""
    clean = os.path.normpath(path) if path else "."
    parts = [p for p in clean.split(os.sep) if p]
    for at in (i for i in range(len(parts) - 3, -1, -1) if parts[i] == "out"):
        for name, other in ((parts[at + 1], parts[at + 2]), (parts[at + 2], parts[at + 1])):
            if other in STAGES:
                return name
    last = path.rpartition(os.sep)[2]
    extension = last[last.rfind(".") :] if "." in last else ""
    stem = os.path.basename(clean).removesuffix(extension) if extension else os.path.basename(clean)
    return stem if stem not in ("", ".") else "artifact"


def out_path(path: str, stage: str, name: str | None = None) -> str:
    return os.path.join("out", subject_of(path), stage, *([name] if name else []))


def _pixels(spark: SparkSession, path: str) -> DataFrame:
    images = read_images(spark, absolute(path)).cache()
    if images.isEmpty():
        raise ValueError(f"no image: {path}")
    return pixels_of(images)


def _save(px: DataFrame, out: str, dry_run: bool) -> None:
    """One image to one path."""
    if not dry_run:
        folder, name = os.path.split(absolute(out))
        write_images(images_of(px.withColumn("image_id", F.lit(os.path.splitext(name)[0]))), folder)


def _one(df: DataFrame, drop: tuple[str, ...] = ("image_id",)) -> dict:
    row = df.first()
    if row is None:
        raise ValueError("no result")
    return {k: v for k, v in row.asDict(recursive=True).items() if k not in drop}


def _nested(report: dict) -> dict:
    alpha = {k: report.pop(k) for k in ("transparent", "opaque", "fractional")}
    return report | {"alpha": alpha}


@command("inspect frame")
def inspect_frame(spark, path: str, alpha_threshold: int = 8) -> dict:
    """Size, colours, alpha, box and pivot hint of an image."""
    found = _nested(_one(stats.inspect_frame(_pixels(spark, path), alpha_threshold)))
    found["bbox"] = {c: found.pop(f"bbox_{c}") for c in "xywh"}
    found["pivot_hint"] = {"x": found.pop("pivot_x"), "y": found.pop("pivot_y"), "anchor": "feet"}
    return {"path": path} | found


@command("inspect sheet")
def inspect_sheet(spark, path: str, grid_size: str = "auto") -> dict:
    """Size, colours, alpha and grid of a sheet."""
    grid_size = grid_size.lower()
    declared = None if grid_size in ("auto", "none") else parse_size(grid_size)
    found = _nested(_one(grid.inspect_sheet(_pixels(spark, path), declared)))
    keys = ("cols", "rows", "cell_w", "cell_h", "offset_x", "offset_y", "confidence")
    layout = {k: found.pop(k) for k in keys}
    if layout["cols"] is not None and grid_size != "none":
        found["grid"] = layout
    return {"path": path} | {k: v for k, v in found.items() if v is not None}


def _changed(before: DataFrame, after: DataFrame, out: str, dry_run: bool, keys: tuple[str, ...]) -> dict:
    _save(after, out, dry_run)
    found = _one(cleanup.changes(before, after))
    return {"out": out} | {k: found[k] for k in keys} | {"dry_run": dry_run}


@command("prep alpha")
def prep_alpha(spark, path: str, out: str | None = None, threshold: int = 128, dry_run: bool = False) -> dict:
    """Alpha below the threshold becomes transparent."""
    checked("threshold", threshold, 1, 255)
    px = _pixels(spark, path)
    report = _changed(px, cleanup.threshold_alpha(px, threshold), out or out_path(path, "prep", "clean.png"), dry_run, ("fractional_pixels_zeroed", "changed_pixels"))
    return report | {"alpha_threshold": threshold}


@command("prep background")
def prep_background(spark, path: str, out: str | None = None, method: str = "auto", key: str | None = None, tolerance: int = 12, connectivity: int = 4, dry_run: bool = False) -> dict:
    """The background becomes transparent, by key colour or from the edges."""
    px, colour = _pixels(spark, path), parse_colour(key) if key else None
    after = cleanup.remove_background(px, method, colour, tolerance, connectivity)
    report = _changed(px, after, out or out_path(path, "prep", "background.png"), dry_run, ("removed_pixels", "changed_pixels"))
    used = method if method != "auto" else "key" if colour else "edge"
    report |= {"method": used, "tolerance": tolerance, "connectivity": connectivity}
    return report | ({"key_color": "#{:02X}{:02X}{:02X}".format(*colour)} if colour else {})


@command("snap pixels")
def snap_pixels(spark, path: str, palette: str, out: str | None = None, threshold: int = 128, dry_run: bool = False) -> dict:
    """Alpha threshold, then every visible pixel takes its nearest palette colour."""
    checked("threshold", threshold, 1, 255)
    px, listed = _pixels(spark, path), read_palette(spark, absolute(palette))
    after = colours.snap(cleanup.threshold_alpha(px, threshold), palette_table(spark, listed))
    report = _changed(px, after, out or out_path(path, "snap", "snapped.png"), dry_run, ("fractional_pixels_zeroed", "changed_pixels"))
    return report | {"palette_size": len(listed), "alpha_threshold": threshold}


def _sizes(px: DataFrame) -> tuple[int, int]:
    row = px.select("w", "h").first()
    return row.w, row.h


@command("snap scale")
def snap_scale(spark, path: str, out: str | None = None, factor: str | int = "auto", dry_run: bool = False) -> dict:
    """An upscaled image at its own size again."""
    px = _pixels(spark, path)
    w, h = _sizes(px)
    forced = None if factor == "auto" else int(factor)
    if forced is not None and (forced not in (1, 2, 3, 4, 8) or w % forced or h % forced):
        raise ValueError("factor must be 1, 2, 3, 4 or 8 and divide the image")
    found = grid.detect_scale(px).first()["factor"]
    used = forced or found
    out = out or out_path(path, "snap", "native.png")
    _save(scale.downscale(px, used), out, dry_run)
    return {"out": out, "detected_factor": found, "forced_factor": forced, "in_w": w, "in_h": h, "out_w": w // used, "out_h": h // used, "dry_run": dry_run}


@command("palette extract")
def palette_extract(spark, path: str, out: str | None = None, max_colors: int = 16, format: str = "hex", dry_run: bool = False) -> dict:  # noqa: A002
    """A palette of an image's visible colours."""
    checked("max colors", max_colors, 1)
    rows = colours.extract_palette(_pixels(spark, path), max_colors).orderBy("ord").select("r", "g", "b", hex_colour().alias("hex")).collect()
    if not rows:
        raise ValueError("the image has no visible colours")
    out = out or out_path(path, "palette", f"extracted-{max_colors}.{format.lower()}")
    if not dry_run:
        write_palette(spark, [(r.r, r.g, r.b) for r in rows], out if out == "-" else absolute(out), format)
    return {"colors": [r.hex for r in rows], "count": len(rows), "format": format, "out": out, "dry_run": dry_run}


@command("palette apply")
def palette_apply(spark, path: str, palette: str, out: str | None = None, dither: bool = False, dry_run: bool = False) -> dict:
    """Visible pixels in the palette's colours, dithered if asked."""
    px, listed = _pixels(spark, path), read_palette(spark, absolute(palette))
    after = colours.dither(px, listed) if dither else colours.snap(px, palette_table(spark, listed))
    out = out or out_path(path, "palette", "applied.png")
    _save(after, out, dry_run)
    count = lambda p: _one(stats.unique_rgb(p))["colors"]
    return {"out": out, "colors_in": count(px), "colors_out": count(after), "dither": dither, "dry_run": dry_run}


@command("normalize detail")
def normalize_detail(spark, path: str, out: str | None = None, target_height: int | None = None, factor: int | None = None, alpha_threshold: int = 8, dry_run: bool = False) -> dict:
    """An image at the whole factor that brings its subject nearest to a height."""
    px = _pixels(spark, path)
    after = scale.normalize_detail(px, target_height, factor, alpha_threshold)
    (w, h), (ow, oh) = _sizes(px), _sizes(after)
    height = lambda p: _one(stats.bbox(p, max(alpha_threshold - 1, 0)))["bbox_h"]
    out = out or out_path(path, "normalize", "detail.png")
    _save(after, out, dry_run)
    sizes = {"factor": w // ow, "input_w": w, "input_h": h, "output_w": ow, "output_h": oh, "input_bbox_h": height(px), "output_bbox_h": height(after)}
    return {"out": out} | sizes | {"alpha_threshold": alpha_threshold, "unchanged": w == ow, "dry_run": dry_run}


def _direction(up: int | None, down: int | None) -> dict:
    return {"direction": "up" if up is not None else "down", "factor": up if up is not None else down, "method": "nearest"}


@command("resize image")
def resize_image(spark, path: str, out: str | None = None, up: int | None = None, down: int | None = None, method: str = "nearest", dry_run: bool = False) -> dict:
    """An image larger or smaller by a whole factor."""
    px = _pixels(spark, path)
    after = scale.resize(px, up, down, method)
    (w, h), (ow, oh) = _sizes(px), _sizes(after)
    out = out or out_path(path, "resize", "image.png")
    _save(after, out, dry_run)
    return {"out": out} | _direction(up, down) | {"input_w": w, "input_h": h, "output_w": ow, "output_h": oh, "unchanged": (w, h) == (ow, oh), "dry_run": dry_run}


def _header(spark: SparkSession, folder: str) -> dict:
    path = os.path.join(absolute(folder), "manifest.json")
    if not files.exists(spark, path):
        return {"source": folder}
    found = read_manifests(spark, path).select("version", "source", "cell_w", "cell_h", "cols", "rows", "sheet", "sheet_size").first().asDict(recursive=True)
    return {k: v for k, v in found.items() if v is not None or not k.startswith("sheet")}


def _set(frames: DataFrame) -> DataFrame:
    return pixels_of(frames.select(F.lit(0).alias("set_id"), F.col("index").alias("frame"), "w", "h", "data"))


META = ("index", "path", "rect", "row", "col", "pivot", "duration_ms", "tag")


def _write_set(px: DataFrame, header: dict, frames: list[dict], out: str, dry_run: bool) -> None:
    """frame_NNN.png of pixels with frame, and the manifest."""
    if not dry_run:
        named = images_of(px, ["frame"]).withColumn("name", F.format_string("frame_%03d", "frame"))
        write_images(named, absolute(out), "name")
        write_manifest(px.sparkSession, os.path.join(absolute(out), "manifest.json"), header, frames)


def _metadata(frames: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in frames.orderBy("index").select(*META).collect()]
    return [r | {"path": f"frame_{r['index']:03d}.png"} for r in rows]


@command("resize frames")
def resize_frames(spark, folder: str, out: str | None = None, up: int | None = None, down: int | None = None, method: str = "nearest", dry_run: bool = False) -> dict:
    """A frame set larger or smaller by a whole factor, pivots and cells with it."""
    frames = framesets.read_frames(spark, absolute(folder)).cache()
    after = scale.resize(_set(frames).withColumn("image_id", F.col("frame")), up, down, method.lower()).drop("image_id")
    header, listed = _header(spark, folder), _metadata(frames)
    scaled = (lambda v: v * up) if up is not None else (lambda v: v // down)
    # a cell that is missing, or scaled to nothing, is as large as the first frame
    first = after.groupBy("frame").agg(F.first("w").alias("w"), F.first("h").alias("h")).orderBy("frame").first()
    cells = {k: scaled(header.get(k) or 0) or v for k, v in (("cell_w", first.w), ("cell_h", first.h))}
    paths = [r.path for r in frames.orderBy("index").select("path").collect()]
    warnings = [f'frame "{p}" has no pivot; leaving manifest pivot absent' for p, f in zip(paths, listed, strict=True) if f["pivot"] is None] if "version" in header else []
    moved = [f | ({"pivot": {c: scaled(v) for c, v in f["pivot"].items()}} if f["pivot"] else {}) for f in listed]
    defaults = {"cols": header.get("cols") or len(listed), "rows": header.get("rows") or 1, "source": header.get("source") or folder}
    out = out or out_path(folder, "resize")
    _write_set(after, header | cells | defaults, moved, out, dry_run)
    return {"out": out} | _direction(up, down) | {"frames": len(listed)} | cells | {"unchanged": (up or down) == 1, "warnings": warnings, "dry_run": dry_run}


def _sliced(px: DataFrame, frames: DataFrame, path: str, out: str, dry_run: bool) -> dict:
    w, h = _sizes(px)
    rows = frames.groupBy("frame").agg(F.first("w").alias("w"), F.first("h").alias("h"), F.min("src_x").alias("x"), F.min("src_y").alias("y")).orderBy("frame").collect()
    cell = frames.agg(F.max("w").alias("w"), F.max("h").alias("h")).first()
    listed = [{"index": r.frame, "path": f"frame_{r.frame:03d}.png", "rect": {"x": r.x, "y": r.y, "w": r.w, "h": r.h}} for r in rows]
    return {"out": out, "frames": listed, "cell_w": cell.w, "cell_h": cell.h, "w": w, "h": h}


@command("slice grid")
def slice_grid(spark, path: str, cols: int, rows: int = 1, out: str | None = None, trim: bool = False, dry_run: bool = False) -> dict:
    """A sheet's cells as frames, trimmed if asked."""
    px = _pixels(spark, path)
    frames = grid.slice_grid(px, cols, rows)
    frames = grid.trim_frames(frames) if trim else frames
    out = out or out_path(path, "slice")
    report = _sliced(px, frames, path, out, dry_run)
    report |= {"cell_w": report.pop("w") // cols, "cell_h": report.pop("h") // rows, "cols": cols, "rows": rows}
    header = {"source": path} | {k: report[k] for k in ("cell_w", "cell_h", "cols", "rows")}
    _write_set(frames, header, [f | {"row": f["index"] // cols, "col": f["index"] % cols} for f in report["frames"]], out, dry_run)
    return report | {"dry_run": dry_run}


@command("slice auto")
def slice_auto(spark, path: str, out: str | None = None, min_gap: int = 1, dry_run: bool = False) -> dict:
    """The cells of the grid that a sheet seems to have."""
    found = grid.guess_grid(_pixels(spark, path), min_gap).first()
    if found is None or found.confidence < grid.LEAST_CONFIDENCE:
        raise ValueError("no grid found")
    return slice_grid(spark, path, found.cols, found.rows, out, False, dry_run) | {"detected": {k: v for k, v in found.asDict().items() if k != "image_id"}}


@command("segment subjects")
def segment_subjects(
    spark, path: str, out: str | None = None, cell: str = "auto", anchor: str = "feet", fit: str = "error", threshold: int = 1, erode: int = 0, dilate: int = 0,
    min_area: str | int = "auto", expected: int = 0, sort: str = "ltr", dry_run: bool = False,
) -> dict:
    """An image's subjects, each in a cell of its own."""
    px = _pixels(spark, path)
    least = None if str(min_area).lower() in ("auto", "") else checked("min area", int(min_area), 0)
    mask = segment.dilate(segment.erode(cleanup.alpha_mask(px, checked("threshold", threshold, 0, 255)), erode), dilate)
    found = segment.component_boxes(segment.components(mask)).cache()
    kept = segment.ordered(segment.filter_components(found, least), sort).cache()
    n = kept.count()
    if not n:
        raise ValueError("no subjects")
    if expected and n != expected:
        raise ValueError(f"expected {expected} subjects, found {n}: {'raise' if n > expected else 'lower'} min_area or threshold (now {threshold})")
    frames = segment.to_cells(px, kept, None if cell.lower() == "auto" else parse_size(cell), anchor, fit).drop("image_id")
    rows = kept.orderBy("idx").collect()
    size = frames.select("w", "h").first()
    listed = [
        {"index": r.idx, "path": f"frame_{r.idx:03d}.png", "src_rect": {"x": r.min_x, "y": r.min_y, "w": r.max_x - r.min_x, "h": r.max_y - r.min_y}, "area": r.area} for r in rows
    ]
    places = [{"row": r.row_idx, "col": r.col_idx} if sort == "ltr" else {} for r in rows]
    header = {"source": path, "cell_w": size.w, "cell_h": size.h, "cols": max((p["col"] for p in places), default=0) + 1 if sort == "ltr" else n}
    header["rows"] = max(p["row"] for p in places) + 1 if sort == "ltr" else 1
    out = out or out_path(path, "segment")
    _write_set(frames, header, [{"index": f["index"], "path": f["path"], "rect": f["src_rect"]} | p for f, p in zip(listed, places, strict=True)], out, dry_run)
    w, h = _sizes(px)
    used = least if least is not None else max(64, -(-w * h // 1000))
    return {
        "out": out, "cell_w": size.w, "cell_h": size.h, "anchor": anchor, "fit": fit, "threshold": threshold, "erode": erode, "dilate": dilate, "min_area": used,
        "components_detected": found.count(), "components_kept": n, "frames": listed, "dry_run": dry_run,
    }


@command("align frames")
def align_frames(spark, folder: str, out: str | None = None, anchor: str = "feet", dry_run: bool = False) -> dict:
    """A frame set on one canvas, pivots in one place."""
    frames = framesets.read_frames(spark, absolute(folder)).cache()
    px = _set(frames)
    placed = _align.placements(_align.pivots(px, anchor)).orderBy("frame").collect()
    target = {"x": placed[0].target_x, "y": placed[0].target_y}
    listed = [f | {"pivot": target} for f in _metadata(frames)]
    header = _header(spark, folder)
    header |= {"cell_w": placed[0].canvas_w, "cell_h": placed[0].canvas_h, "cols": header.get("cols") or len(listed), "rows": header.get("rows") or 1, "source": header.get("source") or folder}
    out = out or out_path(folder, "align")
    _write_set(_align.align_frames(px, anchor).drop("set_id"), header, listed, out, dry_run)
    moved = [{"index": f["index"], "path": f["path"], "dx": p.dx, "dy": p.dy, "pivot": {"x": p.pivot_x, "y": p.pivot_y}} for f, p in zip(listed, placed, strict=True)]
    return {"out": out, "anchor": anchor, "target_pivot": target, "frames": moved, "dry_run": dry_run}


@command("diff frames")
def diff_frames(spark, a: str, b: str, out: str | None = None, tolerance: int = 0, dry_run: bool = False) -> dict:
    """Where two images differ, as numbers and as an overlay."""
    one, two = (_pixels(spark, p).withColumn("pair_id", F.lit(0)) for p in (a, b))
    found = _one(compare.frame_diff(one, two, tolerance=tolerance), ("pair_id",))
    out = out or os.path.join("out", f"{subject_of(a)}_vs_{subject_of(b)}", "diff", "diff.png")
    _save(compare.diff_overlay(one, two, tolerance=tolerance), out, dry_run)
    box = {c: found.pop(f"bbox_{c}") for c in "xywh"}
    return {k: v for k, v in found.items() if v is not None} | {"bbox": box, "tolerance": tolerance, "out": out, "dry_run": dry_run}


@command("export")
def export(spark, folder: str = "", format: str = "", out: str | None = None, list_formats: bool = False, **options) -> dict:  # noqa: A002
    """A frame set as an animated preview or a packed sheet."""
    if list_formats:
        return {"formats": formats.listed()}
    if not format:
        raise ValueError("give a format")
    chosen = formats.get(format)
    frames = framesets.read_frames(spark, absolute(folder), rows=format == "sheet").cache()
    return chosen.export(frames, out or out_path(folder, "export"), subject_of(folder), {"source": _header(spark, folder).get("source") or folder} | options)


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2)


def as_text(report: dict, indent: str = "") -> str:
    """A report as lines of names and values; lists of records are counted, and listed below."""
    lines = []
    for name, value in report.items():
        if isinstance(value, dict):
            lines += [f"{indent}{name}:", as_text(value, indent + "  ")]
        elif isinstance(value, list) and value and isinstance(value[0], dict):
            lines.append(f"{indent}{name}: {len(value)}")
            lines += [f"{indent}  " + " ".join(f"{k}={v}" for k, v in row.items()) for row in value]
        else:
            lines.append(f"{indent}{name}: {', '.join(map(str, value)) if isinstance(value, list) else value}")
    return "\n".join(lines)
