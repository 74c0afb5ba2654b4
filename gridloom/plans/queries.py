"""Queries over the derived rasters, one or more for each operator, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.colour import delay_column, div, hex_colour
from gridloom.operators import align, cleanup, colours, compare, grid, pack, scale, segment, stats
from gridloom.plans.fixtures import PALETTE, PALETTE_SQL, PX_SQL, VARIED_SQL, frames, palette, pixels, varied
from gridloom.plans.sequential import DITHER, FLOOD, MEDIAN_CUT, ROWS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, more: str = ""):
    """Register a function of (px, spark) under its name; sql follows the expression px (and those in more)."""

    def add(function: Callable[[DataFrame, SparkSession], DataFrame]):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(pixels(spark, sf_dir), spark)
        if sql is not None:
            ORACLES[function.__name__] = "WITH RECURSIVE " + ", ".join(x for x in (PX_SQL, more) if x) + "\n" + sql
        return function

    return add


def pm(c: str) -> str:
    return f"(({c} * 257 * a) // 255 // 256)"


STATS = "count(*) FILTER (a = 0) AS transparent, count(*) FILTER (a = 255) AS opaque, count(*) FILTER (a BETWEEN 1 AND 254) AS fractional, coalesce(count(*) FILTER (a BETWEEN 1 AND 254)::DOUBLE / nullif(count(*) FILTER (a > 0), 0), 0.0) AS aa_score"


def box(seen: str, p: str = "bbox_") -> str:
    f = f"FILTER ({seen})"
    return (
        f"coalesce(min(x) {f}, 0) AS {p}x, coalesce(min(y) {f}, 0) AS {p}y, coalesce(max(x) {f} + 1 - min(x) {f}, 0) AS {p}w, coalesce(max(y) {f} + 1 - min(y) {f}, 0) AS {p}h"
    )


UNIQUE = f"SELECT image_id, least(4096, count(DISTINCT {pm('r')} * 16777216::BIGINT + {pm('g')} * 65536 + {pm('b')} * 256 + a)) AS unique_colors FROM px GROUP BY image_id"


@query(f"SELECT image_id, w, h, {STATS} FROM px GROUP BY image_id, w, h")
def image_stats(px, spark):
    return stats.image_stats(px)


@query(UNIQUE)
def unique_colors(px, spark):
    return stats.unique_colours(px)


@query("SELECT image_id, count(DISTINCT r * 65536 + g * 256 + b) FILTER (a <> 0) AS colors FROM px GROUP BY image_id")
def unique_rgb(px, spark):
    return stats.unique_rgb(px)


@query(f"SELECT image_id, {box('a > 8')} FROM vx GROUP BY image_id", VARIED_SQL)
def bbox(px, spark):
    return stats.bbox(varied(px))


@query("SELECT image_id, count(*) FILTER (a BETWEEN 1 AND 254) AS fractional FROM px GROUP BY image_id")
def count_fractional(px, spark):
    return stats.image_stats(px).select("image_id", "fractional")


@query(
    f"""SELECT s.*, CASE WHEN bbox_w > 0 THEN bbox_x + bbox_w // 2 ELSE 0 END AS pivot_x, CASE WHEN bbox_w > 0 THEN bbox_y + bbox_h - 1 ELSE 0 END AS pivot_y,
               unique_colors, 8 AS bbox_alpha_threshold
        FROM (SELECT image_id, w, h, {STATS}, {box("a >= 8")} FROM vx GROUP BY image_id, w, h) s JOIN ({UNIQUE.replace("px", "vx")}) u USING (image_id)""",
    VARIED_SQL,
)
def inspect_frame(px, spark):
    return stats.inspect_frame(varied(px))


CLEARED = "SELECT image_id, x, y, " + ", ".join(f"CASE WHEN {{cond}} THEN 0 ELSE {c} END AS {c}" for c in "rgba") + ", w, h FROM px"


@query(CLEARED.format(cond="a < 128"))
def threshold_alpha(px, spark):
    return cleanup.threshold_alpha(px, 100, 128)


@query("SELECT image_id, x, y, w, h FROM px WHERE a >= 128")
def alpha_mask(px, spark):
    return cleanup.alpha_mask(px, 128)


KEYED = "a <> 0 AND abs(r - 100) <= 60 AND abs(g - 100) <= 60 AND abs(b - 100) <= 60"


@query(CLEARED.format(cond=KEYED))
def key_removal(px, spark):
    return cleanup.remove_background(px, "auto", (100, 100, 100), 60)


@query(f"SELECT image_id, count(*) FILTER (({KEYED}) AND a < 255) AS fractional_pixels_zeroed, count(*) FILTER ({KEYED}) AS changed_pixels, count(*) FILTER ({KEYED}) AS removed_pixels FROM px GROUP BY image_id")
def background_changes(px, spark):
    return cleanup.changes_of(px, lambda p: cleanup.key_removal(p, (100, 100, 100), 60))


@query("SELECT image_id, count(*) FILTER (a BETWEEN 1 AND 127) AS fractional_pixels_zeroed, count(*) FILTER (a BETWEEN 1 AND 127) AS changed_pixels, count(*) FILTER (a BETWEEN 1 AND 127) AS removed_pixels FROM px GROUP BY image_id")
def changed_pixels(px, spark):
    return cleanup.changes_of(px, lambda p: cleanup.threshold_alpha(p, 128))


@query(
    """, corners AS (SELECT image_id, r, g, b, a FROM px WHERE x IN (0, 15) AND y IN (0, 15)),
    like_corner AS (SELECT DISTINCT p.image_id, p.x, p.y, p.r, p.g, p.b, p.a FROM px p JOIN corners c USING (image_id, r, g, b, a)),
    reach AS (SELECT image_id, x, y, r, g, b, a FROM like_corner WHERE x IN (0, 15) OR y IN (0, 15)
              UNION SELECT n.image_id, n.x, n.y, n.r, n.g, n.b, n.a FROM reach m JOIN like_corner n
              ON m.image_id = n.image_id AND m.r = n.r AND m.g = n.g AND m.b = n.b AND m.a = n.a AND abs(m.x - n.x) + abs(m.y - n.y) = 1)
    SELECT image_id, x, y, CASE WHEN q.x IS NULL THEN p.r ELSE 0 END AS r, CASE WHEN q.x IS NULL THEN p.g ELSE 0 END AS g, CASE WHEN q.x IS NULL THEN p.b ELSE 0 END AS b,
           CASE WHEN q.x IS NULL THEN p.a ELSE 0 END AS a, w, h FROM px p LEFT JOIN reach q USING (image_id, x, y)"""
)
def edge_removal_tol0(px, spark):
    return cleanup.edge_removal(px, 0)


@query(
    "SELECT p.image_id, x, y, " + ", ".join(f"CASE WHEN f.cell IS NULL THEN {c} ELSE 0 END AS {c}" for c in "rgba") + ", w, h FROM px p LEFT JOIN flood f ON f.image_id = p.image_id AND f.cell = y * 16 + x",
    FLOOD.format(tolerance=90, connectivity=8),
)
def edge_removal_tol(px, spark):
    return cleanup.edge_removal(px, 90, 8)


HIST = f"SELECT image_id, {pm('r')} AS r, {pm('g')} AS g, {pm('b')} AS b, count(*) AS weight FROM px WHERE a <> 0 GROUP BY ALL"


@query(HIST)
def color_histogram(px, spark):
    return colours.histogram(px)


@query(f"SELECT image_id, r, g, b, weight, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, r, g, b) - 1 AS ord FROM ({HIST})")
def palette_few(px, spark):
    return colours.extract_palette(px, 256)


@query("SELECT * FROM chosen", f"hist AS ({HIST}), " + MEDIAN_CUT.format(most=16))
def median_cut(px, spark):
    return colours.extract_palette(px, 16)


SNAPPED = """, near AS (SELECT image_id, x, y, first({'r': pr, 'g': pg, 'b': pb} ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), ord) AS n FROM px, pal WHERE a <> 0 GROUP BY ALL)
    SELECT image_id, x, y, coalesce(n.r, 0) AS r, coalesce(n.g, 0) AS g, coalesce(n.b, 0) AS b, a, w, h FROM px LEFT JOIN near USING (image_id, x, y)"""


@query(SNAPPED, PALETTE_SQL)
def palette_snap(px, spark):
    return colours.snap(px, palette(spark))


@query(
    f"""SELECT image_id, ord, printf('#%02x%02x%02x', r, g, b) AS hex, printf('%3d %3d %3d\t#%02x%02x%02x', r, g, b, r, g, b) AS gpl
        FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, r, g, b) - 1 AS ord FROM ({HIST})) WHERE ord < 256"""
)
def palette_text(px, spark):
    found = colours.extract_palette(px, 256)
    gpl = F.concat(F.format_string("%3d %3d %3d\t", "r", "g", "b"), hex_colour())
    return found.select("image_id", "ord", hex_colour().alias("hex"), gpl.alias("gpl"))


@query(
    "SELECT image_id, x, y, " + ", ".join(f"CASE WHEN a = 0 THEN 0 ELSE p{c} END AS {c}" for c in "rgb") + ", a, w, h FROM (SELECT *, y * 16 + x AS k FROM px) JOIN spread USING (image_id, k) JOIN pal ON ord = pick",
    PALETTE_SQL + ", " + DITHER,
)
def dither(px, spark):
    return colours.dither(px, list(PALETTE))


OCC = "occ AS (SELECT DISTINCT image_id, 'x' AS axis, x AS i, w AS length FROM vx WHERE a > 0 UNION SELECT DISTINCT image_id, 'y', y, h FROM vx WHERE a > 0)"
BANDS = """runs AS (SELECT *, sum(broke) OVER (PARTITION BY image_id, axis ORDER BY i)::INT AS band FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY image_id, axis ORDER BY i) - 1 >= {gap} THEN 1 ELSE 0 END AS broke FROM occ)),
spans AS (SELECT image_id, axis, length, band, min(i) AS start, max(i) + 1 AS stop FROM runs GROUP BY ALL),
bands AS (SELECT image_id, axis, length, band, start, CASE WHEN band = max(band) OVER (PARTITION BY image_id, axis) AND length - stop < {gap} THEN length ELSE stop END AS stop FROM spans)"""


@query("SELECT image_id, axis, i, length FROM occ", VARIED_SQL + ", " + OCC)
def occupied_lines(px, spark):
    return grid.occupied(varied(px))


@query("SELECT * FROM bands", VARIED_SQL + ", " + OCC + ", " + BANDS.format(gap=2))
def occupied_bands(px, spark):
    return grid.bands(varied(px), 2)


AXES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, axis ORDER BY start) - 1 AS k, count(*) OVER (PARTITION BY image_id, axis) AS n,
    first(start) OVER (PARTITION BY image_id, axis ORDER BY start) AS off, nth_value(start, 2) OVER (PARTITION BY image_id, axis ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first(start) OVER (PARTITION BY image_id, axis ORDER BY start) AS cell FROM bands),
axes AS (SELECT image_id, axis, cell, off, n, greatest(0.0, 1 - sum(CASE WHEN start - off - k * cell > 1 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN off + (k + 1) * cell - stop > 1 THEN 0.1::DOUBLE ELSE 0 END) / n) AS confidence
    FROM ranked WHERE n > 1 AND cell > 0 AND length % cell = 0 AND off < cell GROUP BY image_id, axis, cell, off, n HAVING bool_and(start >= off + k * cell AND stop <= off + (k + 1) * cell)
    UNION ALL SELECT image_id, axis, length, 0, n, 1.0 FROM ranked WHERE n = 1 AND start = 0 AND length - stop <= 1)"""
GUESS = """SELECT x.image_id, 16 // x.cell AS cols, 16 // y.cell AS rows, x.cell AS cell_w, y.cell AS cell_h, x.off AS offset_x, y.off AS offset_y, least(x.confidence, y.confidence) AS confidence
FROM axes x JOIN axes y ON x.image_id = y.image_id AND x.axis = 'x' AND y.axis = 'y' WHERE NOT (x.n = 1 AND y.n = 1)"""
GRID_CTE = OCC.replace("vx", "px") + ", " + BANDS.format(gap=1) + ", " + AXES


@query("SELECT * FROM (" + GUESS + ")", GRID_CTE)
def grid_guess(px, spark):
    return grid.guess_grid(px)


@query("SELECT * FROM (" + GUESS + ")", VARIED_SQL + ", " + OCC + ", " + BANDS.format(gap=1) + ", " + AXES)
def grid_guess_varied(px, spark):
    return grid.guess_grid(varied(px))


@query(
    f"""SELECT s.*, unique_colors, 4 AS cols, 2 AS rows, 4 AS cell_w, 8 AS cell_h, 0 AS offset_x, 0 AS offset_y, 1.0::DOUBLE AS confidence,
               CASE WHEN coalesce(confidence, 0) = 0 THEN 'auto-detection found no grid structure to compare against'
                    WHEN cols <> 4 OR rows <> 2 OR cell_w <> 4 OR cell_h <> 8
                    THEN printf('declared grid 4x2 (cell 4x8) does not match detected %dx%d (cell %dx%d, confidence %.2f)', cols, rows, cell_w, cell_h, confidence::DOUBLE) END AS grid_warning
        FROM (SELECT image_id, w, h, {STATS.replace("px", "vx")} FROM vx GROUP BY image_id, w, h) s JOIN ({UNIQUE.replace("px", "vx")}) u USING (image_id) LEFT JOIN ({GUESS}) g USING (image_id)""",
    VARIED_SQL + ", " + OCC + ", " + BANDS.format(gap=1) + ", " + AXES,
)
def inspect_sheet(px, spark):
    return grid.inspect_sheet(varied(px), (4, 2))


@query(
    f"""SELECT s.*, unique_colors, cols, rows, cell_w, cell_h, offset_x, offset_y, confidence, NULL::VARCHAR AS grid_warning
        FROM (SELECT image_id, w, h, {STATS} FROM vx GROUP BY image_id, w, h) s JOIN ({UNIQUE.replace("px", "vx")}) u USING (image_id) LEFT JOIN (SELECT * FROM ({GUESS}) WHERE confidence > 0) g USING (image_id)""",
    VARIED_SQL + ", " + OCC + ", " + BANDS.format(gap=1) + ", " + AXES,
)
def inspect_sheet_auto(px, spark):
    return grid.inspect_sheet(varied(px))


@query("SELECT image_id, x - 2 AS x, y - 3 AS y, r, g, b, a, 9 AS w, 7 AS h FROM px WHERE x BETWEEN 2 AND 10 AND y BETWEEN 3 AND 9")
def crop(px, spark):
    return grid.crop(px, 2, 3, 9, 7)


SLICED = "SELECT image_id, y // 8 * {cols} + x // {cw} AS frame, x % {cw} AS x, y % 8 AS y, r, g, b, a, {cw} AS w, 8 AS h, x // {cw} * {cw} AS src_x, y // 8 * 8 AS src_y FROM {px}"


@query("SELECT * FROM (" + SLICED.format(cols=4, cw=4, px="px") + ")")
def slice_grid(px, spark):
    return grid.slice_grid(px, 4, 2)


@query(f"SELECT * FROM ({SLICED.format(cols=2, cw=8, px='px')}) JOIN (SELECT image_id FROM ({GUESS}) WHERE confidence >= 0.5) USING (image_id)", GRID_CTE)
def slice_auto(px, spark):
    return grid.slice_auto(px)


@query(
    f"""SELECT image_id, frame, x - coalesce(bbox_x, 0) AS x, y - coalesce(bbox_y, 0) AS y, r, g, b, a, coalesce(bbox_w, w) AS w, coalesce(bbox_h, h) AS h,
               src_x + coalesce(bbox_x, 0) AS src_x, src_y + coalesce(bbox_y, 0) AS src_y
        FROM cut LEFT JOIN (SELECT image_id, frame, {box("a > 0")} FROM cut GROUP BY ALL HAVING max(a) > 0) USING (image_id, frame)
        WHERE bbox_w IS NULL OR (x >= bbox_x AND x < bbox_x + bbox_w AND y >= bbox_y AND y < bbox_y + bbox_h)""",
    VARIED_SQL + ", cut AS (" + SLICED.format(cols=4, cw=4, px="vx") + ")",
)
def slice_trim(px, spark):
    return grid.trim_frames(grid.slice_grid(varied(px), 4, 2))


UP = "up AS (SELECT image_id, f, x * f + dx AS x, y * f + dy AS y, r, g, b, a, w * f AS w, h * f AS h FROM (SELECT *, 1 + image_id % 4 AS f FROM px) q, range(4) s(dx), range(4) t(dy) WHERE dx < f AND dy < f)"


def _up(px: DataFrame) -> DataFrame:
    return scale.upscale(px.withColumn("f", 1 + F.col("image_id") % 4), "f")


@query(
    f""", wide AS (SELECT image_id, x, y, w, h, {pm("r")} * 16777216::BIGINT + {pm("g")} * 65536 + {pm("b")} * 256 + a AS c FROM up),
    offs AS (SELECT s.f, ox, oy FROM (VALUES (2), (3), (4), (8)) s(f), range(8) p(ox), range(8) q(oy) WHERE ox < f AND oy < f),
    blocks AS (SELECT image_id, f, ox, oy, min(c) = max(c) AS same FROM wide, offs WHERE x >= ox AND y >= oy AND (x - ox) // f < (w - ox) // f AND (y - oy) // f < (h - oy) // f GROUP BY image_id, f, ox, oy, (x - ox) // f, (y - oy) // f),
    ratios AS (SELECT image_id, f, avg(same::INT) AS ratio FROM blocks GROUP BY image_id, f, ox, oy)
    SELECT image_id, coalesce(max(f) FILTER (ratio >= 0.95), 1) AS factor FROM ratios GROUP BY image_id""",
    UP,
)
def detect_scale(px, spark):
    return grid.detect_scale(_up(px))


@query("SELECT image_id, f, x, y, r, g, b, a, w, h FROM up", UP)
def upscale(px, spark):
    return _up(px)


@query("SELECT image_id, x // 3 AS x, y // 3 AS y, r, g, b, a, 5 AS w, 5 AS h FROM px WHERE x % 3 = 0 AND y % 3 = 0 AND x // 3 < 5 AND y // 3 < 5")
def downscale(px, spark):
    return scale.downscale(px, 3)


@query("SELECT image_id, x // 4 AS x, y // 4 AS y, r, g, b, a, 4 AS w, 4 AS h FROM px WHERE x % 4 = 0 AND y % 4 = 0")
def resize_down(px, spark):
    return scale.resize(px, down=4)


HEIGHTS = "hs AS (SELECT image_id, f, max(y // f) - min(y // f) + 1 AS height FROM vx, (VALUES (1), (2), (4), (8), (16)) d(f) WHERE a >= 8 AND x % f = 0 AND y % f = 0 GROUP BY image_id, f)"


@query("SELECT image_id, first(f ORDER BY abs(height - 4), f) AS factor, max(height) FILTER (f = 1) AS input_bbox_h, first(height ORDER BY abs(height - 4), f) AS output_bbox_h FROM hs GROUP BY image_id", VARIED_SQL + ", " + HEIGHTS)
def normalize_factor(px, spark):
    return scale.normalize_factors(varied(px), 4)


MASK = "mask AS (SELECT image_id, x, y FROM px WHERE a >= 7)"
OFFSETS = "range(-{k}, {k} + 1) s(dx), range(-{k}, {k} + 1) t(dy)"


@query(f"SELECT image_id, x + dx AS x, y + dy AS y, 16 AS w, 16 AS h FROM mask, {OFFSETS.format(k=2)} GROUP BY ALL HAVING count(*) = 25", MASK)
def erode(px, spark):
    return segment.erode(cleanup.alpha_mask(px, 7), 2)


@query(f"SELECT DISTINCT image_id, x + dx AS x, y + dy AS y, 16 AS w, 16 AS h FROM mask, {OFFSETS.format(k=1)} WHERE x + dx BETWEEN 0 AND 15 AND y + dy BETWEEN 0 AND 15", MASK.replace("a >= 7", "a = 255"))
def dilate(px, spark):
    return segment.dilate(cleanup.alpha_mask(px, 255), 1)


REACH = """fg AS (SELECT image_id, x, y FROM px WHERE a >= 128),
reach AS (SELECT image_id, x, y, y * 16 + x AS l FROM fg UNION SELECT n.image_id, n.x, n.y, r.l FROM reach r JOIN fg n ON n.image_id = r.image_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1 WHERE r.l < n.y * 16 + n.x),
labelled AS (SELECT image_id, x, y, dense_rank() OVER (PARTITION BY image_id ORDER BY min(l))::INT AS comp_id FROM reach GROUP BY image_id, x, y)"""
BOXES = "boxes AS (SELECT image_id, 16 AS w, 16 AS h, comp_id, min(x) AS min_x, min(y) AS min_y, max(x) + 1 AS max_x, max(y) + 1 AS max_y, count(*) AS area FROM labelled GROUP BY image_id, comp_id)"


def _boxes(px: DataFrame) -> DataFrame:
    return segment.component_boxes(segment.components(cleanup.alpha_mask(px, 128)))


@query("SELECT image_id, x, y, 16 AS w, 16 AS h, comp_id FROM labelled", REACH)
def components(px, spark):
    return segment.components(cleanup.alpha_mask(px, 128))


@query("SELECT * FROM boxes", REACH + ", " + BOXES)
def component_boxes(px, spark):
    return _boxes(px)


@query("SELECT * FROM boxes WHERE area >= 4", REACH + ", " + BOXES)
def component_filter(px, spark):
    return segment.filter_components(_boxes(px), 4)


@query("SELECT DISTINCT image_id, greatest(64, ceil(w * h * 0.001))::INT AS min_area FROM px")
def auto_min_area(px, spark):
    return px.select("image_id", segment.auto_min_area().alias("min_area")).distinct()


@query("SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, min_x, min_y, comp_id) - 1 AS idx FROM boxes", REACH + ", " + BOXES)
def sort_area(px, spark):
    return segment.ordered(_boxes(px), "area")


@query("SELECT *, comp_id - 1 AS idx FROM boxes", REACH + ", " + BOXES)
def sort_none(px, spark):
    return segment.ordered(_boxes(px), "none")


@query("SELECT image_id, (ceil(max(max_x - min_x) / 8) * 8)::INT AS cell_w, (ceil(max(max_y - min_y) / 8) * 8)::INT AS cell_h FROM boxes GROUP BY image_id", REACH + ", " + BOXES)
def auto_cell(px, spark):
    return segment.auto_cell(_boxes(px))


@query("SELECT image_id, greatest(4, greatest(1, list_sort(list(max_y - min_y))[count(*) // 2 + 1]) // 2)::INT AS tolerance FROM boxes GROUP BY image_id", REACH + ", " + BOXES)
def row_tolerance(px, spark):
    return segment.row_tolerance(_boxes(px))


GROUPED = REACH + ", " + BOXES + ", comps AS (SELECT image_id AS gid, comp_id AS id, min_x, min_y, max_x, max_y FROM boxes WHERE area >= 3), " + ROWS
LTR = "(SELECT b.*, row_idx, col_idx, row_number() OVER (PARTITION BY image_id ORDER BY row_idx, col_idx) - 1 AS idx FROM boxes b JOIN grouped ON gid = image_id AND id = comp_id)"


@query("SELECT * FROM " + LTR, GROUPED)
def group_rows(px, spark):
    return segment.ordered(_boxes(px).where("area >= 3"), "ltr")


IN_CELLS = """, subjects AS ({subjects}),
    sized AS (SELECT *, ((8 - (max_x - min_x)) / 2)::DOUBLE AS hx FROM subjects)
    SELECT image_id, frame, cx AS x, cy AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a, 8 AS w, 8 AS h
    FROM sized, range(8) i(cx), range(8) j(cy) LEFT JOIN px ON px.image_id = sized.image_id AND px.x = cx - trunc(hx)::INT + min_x AND px.y = cy - (8 - (max_y - min_y)) + min_y AND px.x < max_x AND px.x >= min_x AND px.y < max_y AND px.y >= min_y""".replace("SELECT image_id, frame, cx", "SELECT sized.image_id, frame, cx")


@query(
    IN_CELLS.replace("{subjects}", "SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, min_x, min_y, comp_id) - 1 AS frame FROM boxes WHERE area >= 3"),
    REACH + ", " + BOXES,
)
def place_in_cell(px, spark):
    subjects = segment.ordered(_boxes(px).where("area >= 3"), "area")
    return segment.to_cells(px, subjects, (8, 8), "feet", "crop")


@query(IN_CELLS.replace("{subjects}", "SELECT *, idx AS frame FROM " + LTR), GROUPED)
def segment_subjects(px, spark):
    return segment.segment_subjects(px, 128, min_area=3, cell=(8, 8), fit="crop")[1]


# pairs: image i against the upscaled left half of image i + 1, so that sizes differ
PAIRS = """sa AS (SELECT image_id AS pair_id, x, y, r, g, b, a FROM px WHERE image_id + 1 IN (SELECT image_id FROM px)),
sb AS (SELECT image_id - 1 AS pair_id, x * 2 + dx AS x, y, r, g, b, a FROM px, range(2) s(dx) WHERE image_id > 0 AND y < 12),
canvas AS (SELECT pair_id, cx AS x, cy AS y FROM (SELECT DISTINCT pair_id FROM sa), range(32) i(cx), range(16) j(cy)),
cells AS (SELECT c.pair_id, c.x, c.y, abs(coalesce(sa.r, 0) - coalesce(sb.r, 0)) > 20 OR abs(coalesce(sa.g, 0) - coalesce(sb.g, 0)) > 20 OR abs(coalesce(sa.b, 0) - coalesce(sb.b, 0)) > 20 OR abs(coalesce(sa.a, 0) - coalesce(sb.a, 0)) > 20 AS d
          FROM canvas c LEFT JOIN sa USING (pair_id, x, y) LEFT JOIN sb USING (pair_id, x, y))"""


def _pairs(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = px.agg(F.max("image_id").alias("last"))
    one = px.withColumnRenamed("image_id", "pair_id").join(F.broadcast(last)).where("pair_id < last").drop("last")
    two = px.where("image_id > 0 and y < 12").withColumn("pair_id", F.col("image_id") - 1).withColumn("dx", F.explode(F.array(F.lit(0), F.lit(1))))
    return one, two.select("pair_id", (F.col("x") * 2 + F.col("dx")).alias("x"), "y", "r", "g", "b", "a", F.lit(32).alias("w"), F.lit(12).alias("h"))


@query(
    f"""SELECT pair_id, count(*) FILTER (d) AS diff_pixels, count(*) AS total_pixels, 100.0::DOUBLE * count(*) FILTER (d) / count(*) AS percent, {box("d")},
        {{'a': {{'w': 16, 'h': 16}}, 'b': {{'w': 32, 'h': 12}}}}::VARCHAR AS size_mismatch FROM cells GROUP BY pair_id""",
    PAIRS,
)
def frame_diff(px, spark):
    found = compare.frame_diff(*_pairs(px), tolerance=20)
    text = F.format_string("{'a': {'w': %d, 'h': %d}, 'b': {'w': %d, 'h': %d}}", "size_mismatch.a.w", "size_mismatch.a.h", "size_mismatch.b.w", "size_mismatch.b.h")
    return found.withColumn("size_mismatch", text)


@query("SELECT pair_id, x, y, CASE WHEN d THEN 255 ELSE 128 END AS r, CASE WHEN d THEN 0 ELSE 128 END AS g, CASE WHEN d THEN 0 ELSE 128 END AS b, CASE WHEN d THEN 255 ELSE 64 END AS a, 32 AS w, 16 AS h FROM cells", PAIRS)
def diff_overlay(px, spark):
    return compare.diff_overlay(*_pairs(px), tolerance=20)


FRAMES = VARIED_SQL + ", fr AS (SELECT image_id // 4 AS set_id, image_id % 4 AS frame, x, y, r, g, b, a, w, h FROM vx)"
FBOX = f"fb AS (SELECT set_id, frame, {box('a > 0')}, sum(a) AS sa, sum(x * a) AS sx, sum(y * a) AS sy FROM fr GROUP BY set_id, frame), fs AS (SELECT *, CASE WHEN bbox_w = 0 THEN 16 ELSE bbox_w END AS bw, CASE WHEN bbox_w = 0 THEN 16 ELSE bbox_h END AS bh FROM fb)"
FEET = "pv AS (SELECT set_id, frame, 16 AS w, 16 AS h, (bbox_x + bw // 2)::INT AS pivot_x, (bbox_y + bh - 1)::INT AS pivot_y FROM fs)"


@query("SELECT * FROM pv", f"{FRAMES}, {FBOX}, {FEET}")
def pivot_feet(px, spark):
    return align.pivots(frames(varied(px)), "feet")


@query("SELECT set_id, frame, 16 AS w, 16 AS h, (bbox_x + bw // 2)::INT AS pivot_x, (bbox_y + bh // 2)::INT AS pivot_y FROM fs", f"{FRAMES}, {FBOX}")
def pivot_bbox(px, spark):
    return align.pivots(frames(varied(px)), "bbox")


@query("SELECT set_id, frame, 16 AS w, 16 AS h, coalesce((sx + sa // 2) // nullif(sa, 0), bbox_x + bw // 2)::INT AS pivot_x, coalesce((sy + sa // 2) // nullif(sa, 0), bbox_y + bh - 1)::INT AS pivot_y FROM fs", f"{FRAMES}, {FBOX}")
def pivot_centroid(px, spark):
    return align.pivots(frames(varied(px)), "centroid")


ALIGNED = """tg AS (SELECT set_id, floor(median(pivot_x))::INT AS tx, floor(median(pivot_y))::INT AS ty FROM pv GROUP BY set_id),
mv AS (SELECT *, tx - pivot_x AS mx, ty - pivot_y AS my FROM pv JOIN tg USING (set_id)),
cv AS (SELECT set_id, least(0, min(mx)) AS x0, least(0, min(my)) AS y0, greatest(0, max(mx + w)) AS x1, greatest(0, max(my + h)) AS y1 FROM mv GROUP BY set_id),
pl AS (SELECT set_id, frame, mx - x0 AS dx, my - y0 AS dy, x1 - x0 AS canvas_w, y1 - y0 AS canvas_h, tx - x0 AS target_x, ty - y0 AS target_y, pivot_x, pivot_y FROM mv JOIN cv USING (set_id))"""
ALIGN_CTE = f"{FRAMES}, {FBOX}, {FEET}, {ALIGNED}"


@query("SELECT * FROM pl", ALIGN_CTE)
def align_placements(px, spark):
    return align.placements(align.pivots(frames(varied(px))))


@query(
    """SELECT pl.set_id, pl.frame, cx::INT AS x, cy::INT AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a, canvas_w AS w, canvas_h AS h
       FROM pl JOIN range(64) i(cx) ON cx < canvas_w JOIN range(64) j(cy) ON cy < canvas_h LEFT JOIN fr ON fr.set_id = pl.set_id AND fr.frame = pl.frame AND fr.x + dx = cx AND fr.y + dy = cy""",
    ALIGN_CTE,
)
def align_frames(px, spark):
    return align.align_frames(frames(varied(px)))


def _sheet_frames(px: DataFrame) -> DataFrame:
    """Frames of several sizes: set, frame, w, h."""
    one = frames(px).select("set_id", "frame").distinct()
    return one.select("set_id", "frame", (8 + F.col("frame") * 2).alias("w"), (10 + F.col("set_id") % 3).alias("h"))


SIZED = "sz AS (SELECT DISTINCT image_id // 4 AS set_id, image_id % 4 AS frame, 8 + image_id % 4 * 2 AS w, 10 + image_id // 4 % 3 AS h FROM px), mc AS (SELECT set_id, max(w) AS cell_w, max(h) AS cell_h, min(w) <> max(w) OR min(h) <> max(h) AS mixed_sizes, count(*) AS n FROM sz GROUP BY set_id)"


@query("SELECT set_id, cell_w, cell_h, mixed_sizes FROM mc", SIZED)
def max_cell(px, spark):
    return pack.max_cell(_sheet_frames(px))


LAYOUT = """lay AS (SELECT set_id, frame, (frame // cols)::INT AS row, (frame % cols)::INT AS col, cols, ((n - 1) // cols + 1)::INT AS rows, cell_w, cell_h, mixed_sizes FROM sz JOIN (SELECT *, {cols} AS cols FROM mc) USING (set_id))"""
PLACED = """SELECT set_id, frame, row, col, cols, rows, (col * (cell_w + {p}))::INT AS x, (row * (cell_h + {p}))::INT AS y, cell_w, cell_h, (cols * cell_w + (cols - 1) * {p})::INT AS sheet_w, (rows * cell_h + (rows - 1) * {p})::INT AS sheet_h, mixed_sizes FROM lay"""


@query("SELECT * FROM (" + PLACED.format(p=1) + ")", SIZED + ", " + LAYOUT.format(cols=3))
def pack_grid(px, spark):
    return pack.pack(_sheet_frames(px), cols=3, padding=1)


@query("SELECT * FROM (" + PLACED.format(p=2) + ")", SIZED + ", " + LAYOUT.format(cols="ceil(sqrt(n))::INT"))
def pack_square(px, spark):
    return pack.pack(_sheet_frames(px), padding=2)


@query(
    """SELECT set_id, frame, row, col, max(col) OVER (PARTITION BY set_id) + 1 AS cols, max(row) OVER (PARTITION BY set_id) + 1 AS rows, col * (cell_w + 1) AS x, row * (cell_h + 1) AS y, cell_w, cell_h,
       (max(col) OVER (PARTITION BY set_id) + 1) * cell_w + max(col) OVER (PARTITION BY set_id) AS sheet_w, (max(row) OVER (PARTITION BY set_id) + 1) * cell_h + max(row) OVER (PARTITION BY set_id) AS sheet_h, mixed_sizes
       FROM (SELECT *, frame % 2 AS row, frame // 2 + set_id % 2 AS col FROM sz JOIN mc USING (set_id))""",
    SIZED,
)
def pack_positioned(px, spark):
    placed = _sheet_frames(px).withColumns({"row": F.col("frame") % 2, "col": (div("frame", 2) + F.col("set_id") % 2).cast("int")})
    return pack.pack(placed, padding=1)


@query(
    """SELECT set_id, frame, row, col, cols, rows, (col * cell_w)::INT AS x, (row * cell_h)::INT AS y, cell_w, cell_h, (cols * cell_w)::INT AS sheet_w, (rows * cell_h)::INT AS sheet_h, mixed_sizes
       FROM (SELECT gid AS set_id, id AS frame, row_idx AS row, col_idx AS col, max(col_idx) OVER (PARTITION BY gid) + 1 AS cols, max(row_idx) OVER (PARTITION BY gid) + 1 AS rows FROM grouped) JOIN mc USING (set_id)""",
    SIZED + ", comps AS (SELECT set_id AS gid, frame AS id, frame % 2 * 20 AS min_x, frame // 2 * 24 + frame % 2 AS min_y, frame % 2 * 20 + w AS max_x, frame // 2 * 24 + frame % 2 + h AS max_y FROM sz), " + ROWS,
)
def pack_source_rows(px, spark):
    rect = F.struct((F.col("frame") % 2 * 20).alias("x"), (div("frame", 2) * 24 + F.col("frame") % 2).cast("int").alias("y"), "w", "h")
    return pack.pack(_sheet_frames(px).withColumn("rect", rect))


@query(
    """, s AS (SELECT image_id // 4 AS set_id, image_id % 4 AS frame, x, y, r, g, b, a FROM px), n AS (SELECT set_id, count(DISTINCT frame) AS n FROM s GROUP BY set_id),
    g AS (SELECT set_id, ceil(sqrt(n))::INT AS cols, ((n - 1) // ceil(sqrt(n))::INT + 1)::INT AS rows FROM n)
    SELECT g.set_id, cx::INT AS x, cy::INT AS y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a, (cols * 17 - 1)::INT AS w, (rows * 17 - 1)::INT AS h
    FROM g JOIN range(64) i(cx) ON cx < cols * 17 - 1 JOIN range(64) j(cy) ON cy < rows * 17 - 1 LEFT JOIN s ON s.set_id = g.set_id AND s.x + frame % cols * 17 = cx AND s.y + frame // cols * 17 = cy"""
)
def sheet_composite(px, spark):
    own = frames(px)
    return pack.composite(own, pack.pack(own.select("set_id", "frame", "w", "h").distinct(), padding=1))


@query(
    """SELECT set_id, frame, {'x': x, 'y': y, 'w': fw, 'h': fh}::VARCHAR AS rect, coalesce(orow, row) AS row, col, tag, cell_w, cell_h, cols, rows, sheet_w, sheet_h
       FROM (""" + PLACED.format(p=0) + """) JOIN (SELECT set_id, frame, w AS fw, h AS fh, CASE WHEN frame = 1 THEN 7 END AS orow, 'set' || set_id AS tag FROM sz) USING (set_id, frame)""",
    SIZED + ", " + LAYOUT.format(cols=2),
)
def sheet_manifest(px, spark):
    own = _sheet_frames(px).withColumns({"row": F.when(F.col("frame") == 1, 7), "tag": F.concat(F.lit("set"), F.col("set_id"))})
    found = pack.sheet_manifest(own, pack.pack(own, cols=2))
    return found.withColumn("rect", F.format_string("{'x': %d, 'y': %d, 'w': %d, 'h': %d}", "rect.x", "rect.y", "rect.w", "rect.h"))


@query("SELECT image_id, (1 + image_id % 250)::INT AS fps, greatest(1, round(100.0 / (1 + image_id % 250)))::INT AS delay_cs, (greatest(1, round(100.0 / (1 + image_id % 250))) * 4 * 10)::INT AS duration_ms FROM (SELECT DISTINCT image_id FROM px)")
def gif_delay(px, spark):
    shown = px.select("image_id", (1 + F.col("image_id") % 250).cast("int").alias("fps")).distinct()
    delayed = shown.withColumn("delay_cs", delay_column("fps"))
    return delayed.withColumn("duration_ms", (F.col("delay_cs") * 40).cast("int"))


@query(
    """SELECT set_id, frame, (tx - x0)::INT AS px, (ty - y0)::INT AS py, (x1 - x0)::INT AS cell_w, (y1 - y0)::INT AS cell_h FROM mv JOIN cv USING (set_id)""",
    ALIGN_CTE,
)
def align_manifest(px, spark):
    own = frames(varied(px))
    metadata = own.select("set_id", "frame").distinct()
    found = align.align_manifest(metadata, align.placements(align.pivots(own)))
    return found.select("set_id", "frame", F.col("pivot.x").alias("px"), F.col("pivot.y").alias("py"), "cell_w", "cell_h")


@query("SELECT image_id // 4 AS set_id, image_id % 4 AS frame, CASE WHEN image_id % 4 < 3 THEN (5 + image_id) // 2 END AS pivot_x, 8 AS cell_w, image_id % 4 = 3 AS pivot_missing FROM (SELECT DISTINCT image_id FROM px)")
def resize_manifest(px, spark):
    ids = px.select("image_id").distinct()
    own = ids.select(
        div("image_id", 4).cast("int").alias("set_id"), (F.col("image_id") % 4).alias("frame"),
        F.when(F.col("image_id") % 4 < 3, F.struct((F.col("image_id") + 5).alias("x"), F.lit(11).alias("y"))).alias("pivot"), F.lit(16).alias("cell_w"), F.lit(16).alias("cell_h"),
    )
    return scale.resize_frames(own, down=2).select("set_id", "frame", F.col("pivot.x").alias("pivot_x"), "cell_w", "pivot_missing")
