"""Small rasters with results worked out by hand."""

import numpy as np
import pytest

from gridloom.functions.colour import frame_delay, parse_colour, parse_size
from gridloom.operators import align, cleanup, colours, compare, grid, pack, scale, segment, stats


def raster(spark, width, height, rects, name="a"):
    """Rectangles (x0, y0, x1, y1, rgba) painted in order on a transparent canvas."""
    image = np.zeros((height, width, 4), int)
    for x0, y0, x1, y1, colour in rects:
        image[y0:y1, x0:x1] = colour
    rows = [(name, x, y, *map(int, image[y, x]), width, height) for y in range(height) for x in range(width)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, r int, g int, b int, a int, w int, h int")


RED, WHITE, BLACK = (255, 0, 0, 255), (255, 255, 255, 255), (0, 0, 0, 255)


def table(px):
    return {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in px.collect()}


def as_set(px, frame=0):
    from pyspark.sql import functions as F

    return px.withColumn("set_id", F.lit(0)).withColumn("frame", F.lit(frame)).drop("image_id")


def test_pivots(spark):
    tall = as_set(raster(spark, 32, 32, [(8, 2, 24, 30, RED)]))
    assert [tuple(align.pivots(tall, a).first()[4:]) for a in ("bbox", "feet")] == [(16, 16), (16, 29)]
    square = as_set(raster(spark, 32, 32, [(8, 8, 24, 24, RED)]))
    assert tuple(align.pivots(square, "centroid").first()[4:]) == (16, 16)
    empty = as_set(raster(spark, 8, 6, []))
    assert tuple(align.pivots(empty, "centroid").first()[4:]) == (4, 5)


def test_grid_of_four_blocks(spark):
    px = raster(spark, 128, 32, [(32 * i, 0, 32 * i + 31, 31, RED) for i in range(4)])
    assert tuple(grid.guess_grid(px).first()[1:]) == (4, 1, 32, 32, 0, 0, 1.0)
    assert grid.guess_grid(raster(spark, 16, 16, [(0, 0, 16, 16, RED)])).count() == 0


def test_short_gap_at_the_end_belongs_to_the_last_band(spark):
    px = raster(spark, 12, 1, [(0, 0, 3, 1, RED), (6, 0, 11, 1, RED)])
    rows = grid.bands(px, 3).where("axis = 'x'").orderBy("start").collect()
    assert [(r.start, r.stop) for r in rows] == [(0, 3), (6, 12)]


@pytest.mark.parametrize("cell,factor", [(4, 4), (2, 2)])
def test_scale_of_blocks(spark, cell, factor):
    n = 8 // cell
    rects = [(cell * i, cell * j, cell * (i + 1), cell * (j + 1), ((i * 7 + j * 31) % 256, i * 50, j * 50, 255)) for i in range(n) for j in range(n)]
    assert grid.detect_scale(raster(spark, 8, 8, rects)).first()["factor"] == factor


def test_scale_of_noise_and_of_one_colour(spark):
    noise = raster(spark, 16, 16, [(x, y, x + 1, y + 1, ((13 * x + y) % 256, (7 * x + 11 * y) % 256, (5 * x + 3 * y) % 256, 255)) for x in range(16) for y in range(16)])
    assert grid.detect_scale(noise).first()["factor"] == 1
    assert grid.detect_scale(raster(spark, 16, 16, [(0, 0, 16, 16, RED)])).first()["factor"] == 8


def test_diff_tolerance(spark):
    from pyspark.sql import functions as F

    one, two = (raster(spark, 2, 2, [(0, 0, 2, 2, (v, 100, 100, 255))]).withColumn("pair_id", F.lit(1)) for v in (100, 105))
    assert [compare.frame_diff(one, two, tolerance=t).first()["diff_pixels"] for t in (4, 5)] == [4, 0]


def test_haze_below_threshold_does_not_count(spark):
    px = raster(spark, 6, 6, [(2, 2, 4, 5, RED), (2, 1, 3, 2, (255, 0, 0, 7))])
    assert [stats.inspect_frame(px, t).first()["bbox_h"] for t in (8, 1)] == [3, 4]


def test_edge_flood_keeps_holes_and_follows_connectivity(spark):
    ring = raster(spark, 9, 9, [(0, 0, 9, 9, WHITE), (2, 2, 7, 7, BLACK), (3, 3, 6, 6, WHITE)])
    after = table(cleanup.edge_removal(ring, 0))
    assert after[0, 0] == (0, 0, 0, 0) and after[4, 4] == WHITE and after[2, 2] == BLACK
    # corners black but one: the white corner reaches the middle over the diagonal only
    diagonal = raster(spark, 3, 3, [(0, 0, 3, 3, BLACK), (0, 0, 1, 1, WHITE), (1, 1, 2, 2, WHITE)])
    assert table(cleanup.edge_removal(diagonal, 0, 4))[1, 1] == WHITE
    assert table(cleanup.edge_removal(diagonal, 0, 8))[1, 1] == (0, 0, 0, 0)


def test_key_removal_tolerance(spark):
    px = raster(spark, 2, 1, [(0, 0, 1, 1, (250, 5, 250, 255)), (1, 0, 2, 1, (200, 0, 0, 255))])
    assert table(cleanup.key_removal(px, (255, 0, 255), 8)) == {(0, 0): (0, 0, 0, 0), (1, 0): (200, 0, 0, 255)}


def test_components_and_reading_order(spark):
    boxes = [(1, 0, 0, 10, 10), (2, 20, 3, 30, 13), (3, 1, 40, 11, 50), (4, 22, 42, 32, 52)]
    rows = [("a", 64, 64, i, *b, 100) for i, *b in boxes]
    found = segment.ordered(spark.createDataFrame(rows, "image_id string, w int, h int, comp_id int, min_x int, min_y int, max_x int, max_y int, area bigint"), "ltr")
    assert [(r.comp_id, r.row_idx, r.col_idx) for r in found.orderBy("idx").collect()] == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)]


def test_segment_of_four_subjects(spark):
    px = raster(spark, 160, 96, [(x, y, x + 18, y + 20, RED) for x, y in ((10, 8), (74, 10), (12, 58), (72, 56))])
    subjects, frames = segment.segment_subjects(px, expected=4)
    assert [(r.row_idx, r.col_idx, r.min_x) for r in subjects.orderBy("idx").collect()] == [(0, 0, 10), (0, 1, 74), (1, 0, 12), (1, 1, 72)]
    assert frames.where("a > 0").count() == 4 * 360 and frames.count() == 4 * 24 * 24


def test_morphology(spark):
    mask = raster(spark, 7, 7, [(1, 1, 6, 6, RED)]).where("a > 0").select("image_id", "x", "y", "w", "h")
    assert segment.erode(mask, 2).select("x", "y").collect() == [(3, 3)]
    assert segment.dilate(mask, 1).count() == 49


def test_median_cut_is_deterministic_and_ignores_hidden(spark):
    ramp = raster(spark, 8, 1, [(x, 0, x + 1, 1, (20 * x, 255 - 20 * x, 10 * x, 255)) for x in range(8)])
    one, two = (colours.extract_palette(ramp, 4).orderBy("ord").collect() for _ in range(2))
    assert one == two and len(one) == 4
    hidden = raster(spark, 2, 1, [(1, 0, 2, 1, (10, 200, 10, 255))])
    assert [(r.r, r.g, r.b) for r in colours.extract_palette(hidden, 4).collect()] == [(10, 200, 10)]


def test_median_cut_stops_where_the_last_colour_outweighs_the_rest():
    bins = np.array([(0, 0, 0, 1), (10, 0, 0, 5)])
    assert colours.median_cut(bins, 2) == [(8, 0, 0, 6)]


def test_snap_takes_the_first_of_equals_and_keeps_alpha(spark):
    px = raster(spark, 2, 1, [(0, 0, 1, 1, (10, 10, 10, 99))])
    palette = spark.createDataFrame([(0, 20, 10, 10), (1, 0, 10, 10)], "ord int, r int, g int, b int")
    assert table(colours.snap(px, palette)) == {(0, 0): (20, 10, 10, 99), (1, 0): (0, 0, 0, 0)}
    assert table(colours.snap(px, palette.limit(0)))[0, 0] == (10, 10, 10, 99)


def test_dither_members_and_alpha(spark):
    px = raster(spark, 6, 6, [(0, 0, 6, 6, (128, 128, 128, 200)), (0, 0, 1, 1, (0, 0, 0, 0))])
    after = table(colours.dither(px, [(0, 0, 0), (255, 255, 255)]))
    assert {c[:3] for p, c in after.items() if p != (0, 0)} == {(0, 0, 0), (255, 255, 255)} and after[0, 0] == (0, 0, 0, 0)
    assert {c[3] for p, c in after.items() if p != (0, 0)} == {200}


def test_align_is_idempotent(spark):
    from pyspark.sql import functions as F

    frames = as_set(raster(spark, 32, 32, [(12, 14, 20, 30, RED)]), 0)
    for i, (dx, dy) in enumerate(((-1, 0), (0, 0), (1, -1)), 1):
        frames = frames.unionByName(as_set(raster(spark, 32, 32, [(12 + dx, 12 + dy, 20 + dx, 28 + dy, RED)]), i))
    once = align.align_frames(frames)
    placed = align.placements(align.pivots(once))
    assert placed.agg(F.max("dx"), F.min("dx"), F.max("dy"), F.min("dy")).first() == (0, 0, 0, 0)


def test_resize_round_trip_and_errors(spark):
    px = raster(spark, 4, 4, [(x, y, x + 1, y + 1, (x * 9, y * 9, 1, 255)) for x in range(4) for y in range(4)])
    assert table(scale.shrink(scale.upscale(px, 3), 3)) == table(px)
    with pytest.raises(ValueError):
        scale.resize(px)
    with pytest.raises(Exception, match="does not divide"):
        scale.shrink(px, 3).collect()


def test_normalize_factor(spark):
    px = scale.upscale(raster(spark, 48, 48, [(10, 0, 30, 48, RED)]), 2)
    assert tuple(scale.normalize_factors(px, 48).first()[1:]) == (2, 96, 48)


def test_pack_ways(spark):
    rows = [(0, i, 10, 10) for i in range(5)]
    frames = spark.createDataFrame(rows, "set_id int, frame int, w int, h int")
    found = pack.pack(frames, padding=1).orderBy("frame").collect()
    assert [(r.row, r.col) for r in found] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)] and (found[0].sheet_w, found[0].sheet_h) == (32, 21)


def test_scalars():
    assert [frame_delay(f) for f in (8, 100, 1000, 30)] == [13, 1, 1, 3]
    assert parse_colour(" #0aFF10 ") == (10, 255, 16) and parse_size("4x2") == (4, 2)
    for bad in ("#12345", "red"):
        with pytest.raises(ValueError):
            parse_colour(bad)
    with pytest.raises(ValueError):
        parse_size("0x2")


def test_crop(spark):
    px = raster(spark, 6, 5, [(2, 1, 4, 3, RED)])
    cut = grid.crop(px, 1, 1, 3, 2)
    assert cut.count() == 6 and cut.select("w", "h").distinct().collect() == [(3, 2)]
    assert {(r.x, r.y) for r in cut.where("a > 0").collect()} == {(1, 0), (2, 0), (1, 1), (2, 1)}
    with pytest.raises(ValueError):
        grid.crop(px, 0, 0, 0, 2)
    for place in ((4, 0, 3, 1), (-1, 0, 2, 2), (0, 4, 1, 2)):
        with pytest.raises(Exception, match="outside image bounds"):
            grid.crop(px, *place).collect()


def test_changes_in_one_row_and_by_join(spark):
    px = raster(spark, 4, 4, [(0, 0, 2, 4, RED), (2, 0, 3, 4, (9, 9, 9, 60))])
    operator = lambda p: cleanup.threshold_alpha(p, 128)
    one = cleanup.changes_of(px, operator).collect()
    assert one == cleanup.changes(px, operator(px)).collect() == [("a", 4, 4, 4)]


def test_snap_with_many_pixels_of_one_colour(spark):
    px = raster(spark, 4, 2, [(0, 0, 3, 1, (250, 5, 5, 200)), (3, 1, 4, 2, (0, 0, 9, 255))])
    palette = spark.createDataFrame([(0, 255, 0, 0), (1, 0, 0, 0)], "ord int, r int, g int, b int")
    found = table(colours.snap(px, palette))
    assert len(found) == 8 and found[0, 0] == (255, 0, 0, 200) and found[3, 1] == (0, 0, 0, 255) and found[0, 1] == (0, 0, 0, 0)
