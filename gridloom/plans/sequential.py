"""SQL of the operators that depend on the order of visits: each step of a recursion makes one visit in all
images at once."""

from __future__ import annotations

#: From comps(gid, id, min_x, min_y, max_x, max_y): grouped(gid, id, row_idx, col_idx). A component joins the row whose
#: mean centre is nearest, within half the upper median height, and else begins a row.
ROWS = """lined AS (
    SELECT *, min_y + (max_y - min_y) // 2 AS cy, row_number() OVER (PARTITION BY gid ORDER BY min_y + (max_y - min_y) // 2, min_y, min_x, id) AS k FROM comps),
tols AS (SELECT gid, greatest(4, greatest(1, list_sort(list(max_y - min_y))[count(*) // 2 + 1]) // 2) AS tol FROM comps GROUP BY gid),
walk(gid, k, sums, ns, pick) AS (
    SELECT gid, k, [cy], [1], 1 FROM lined WHERE k = 1
    UNION ALL
    SELECT gid, k, CASE WHEN pick > len(sums) THEN list_append(sums, cy) ELSE [CASE WHEN i = pick THEN s + cy ELSE s END FOR s, i IN sums] END,
           CASE WHEN pick > len(ns) THEN list_append(ns, 1) ELSE [CASE WHEN i = pick THEN n + 1 ELSE n END FOR n, i IN ns] END, pick
    FROM (SELECT *, CASE WHEN list_min(off) <= tol THEN list_position(off, list_min(off)) ELSE len(off) + 1 END AS pick
          FROM (SELECT l.gid, l.k, l.cy, w.sums, w.ns, t.tol, [abs(l.cy - s // w.ns[i]) FOR s, i IN w.sums] AS off
                FROM walk w JOIN lined l ON l.gid = w.gid AND l.k = w.k + 1 JOIN tols t ON t.gid = w.gid))),
grouped AS (SELECT gid, id, (pick - 1)::INT AS row_idx, (row_number() OVER (PARTITION BY gid, pick ORDER BY min_x, min_y, k) - 1)::INT AS col_idx FROM lined JOIN walk USING (gid, k))"""

#: From hist(image_id, r, g, b, weight): chosen(image_id, ord, r, g, b, weight), at most {most} colours.
MEDIAN_CUT = """sides(image_id, turn, box, r, g, b, weight) AS (
    SELECT image_id, 0, 0, r, g, b, weight FROM hist
    UNION ALL
    SELECT image_id, turn + 1, CASE WHEN mine AND cut IS NOT NULL AND rn > cut THEN turn + 1 ELSE box END, r, g, b, weight
    FROM (SELECT *, min(CASE WHEN upto >= total // 2 AND rn < n THEN rn END) OVER (PARTITION BY image_id, box) AS cut
          FROM (SELECT *, row_number() OVER best AS rn, sum(weight) OVER best AS upto
                FROM (SELECT *, box = first(box) OVER (PARTITION BY image_id ORDER BY n < 2, -greatest(hr - lr, hg - lg, hb - lb), -total, lr, lg, lb, box) AND n > 1 AS mine,
                             CASE WHEN hr - lr >= greatest(hg - lg, hb - lb) THEN r WHEN hg - lg >= hb - lb THEN g ELSE b END AS along
                      FROM (SELECT *, min(r) OVER own AS lr, max(r) OVER own AS hr, min(g) OVER own AS lg, max(g) OVER own AS hg, min(b) OVER own AS lb, max(b) OVER own AS hb,
                                   sum(weight) OVER own AS total, count(*) OVER own AS n
                            FROM sides WHERE turn < {most} - 1 WINDOW own AS (PARTITION BY image_id, box)))
                WINDOW best AS (PARTITION BY image_id, box ORDER BY along, r, g, b, weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))),
sizes AS (SELECT image_id, count(*) AS n FROM hist GROUP BY image_id),
means AS (SELECT image_id, box, (sum(r * weight) + sum(weight) // 2) // sum(weight) AS r, (sum(g * weight) + sum(weight) // 2) // sum(weight) AS g,
                 (sum(b * weight) + sum(weight) // 2) // sum(weight) AS b, sum(weight) AS weight FROM sides WHERE turn = {most} - 1 GROUP BY image_id, box),
listed AS (SELECT image_id, r, g, b, first(weight ORDER BY box) AS weight FROM means JOIN sizes USING (image_id) WHERE n > {most} GROUP BY image_id, r, g, b
           UNION ALL SELECT image_id, r, g, b, weight FROM hist JOIN sizes USING (image_id) WHERE n <= {most}),
chosen AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY weight DESC, r, g, b) - 1)::INT AS ord, r::INT AS r, g::INT AS g, b::INT AS b, weight::BIGINT AS weight FROM listed)"""

#: From px and pal: spread(image_id, k, pick), the palette entry of each pixel in reading order. A row's errors stand in
#: lists of 18, one place to the left of each pixel's own; what the last pixel handed on is carried.
_READ = ", ".join(f"least(65535, greatest(0, p.{c} * 257 + trunc((d.now_{c}[p.x + 2] + d.on_{c}) / 16.0)::INT)) AS v{c}" for c in "rgb")
_ZEROS = "list_resize([]::INT[], 18, 0)"
_NEXT = ", ".join(
    f"CASE WHEN x = 15 THEN [CASE i - 1 WHEN x THEN v + 3 * e{c} WHEN x + 1 THEN v + 5 * e{c} WHEN x + 2 THEN v + e{c} ELSE v END FOR v, i IN aft_{c}] ELSE now_{c} END, "
    f"CASE WHEN x = 15 THEN {_ZEROS} ELSE [CASE i - 1 WHEN x THEN v + 3 * e{c} WHEN x + 1 THEN v + 5 * e{c} WHEN x + 2 THEN v + e{c} ELSE v END FOR v, i IN aft_{c}] END, "
    f"CASE WHEN x = 15 THEN 0 ELSE 7 * e{c} END"
    for c in "rgb"
)
DITHER = f"""spread(image_id, k, pick, now_r, aft_r, on_r, now_g, aft_g, on_g, now_b, aft_b, on_b) AS (
    SELECT DISTINCT image_id, -1, 0, {", ".join([f"{_ZEROS}, {_ZEROS}, 0"] * 3)} FROM px
    UNION ALL
    SELECT image_id, k, pick, {_NEXT}
    FROM (SELECT q.*, ord AS pick, vr - pr * 257 AS er, vg - pg * 257 AS eg, vb - pb * 257 AS eb
          FROM (SELECT w.*, list_position(offs, list_min(offs)) - 1 AS best
                FROM (SELECT d.* EXCLUDE (pick, k), d.k + 1 AS k, p.x, {_READ},
                             [((vr - c[1])::BIGINT * (vr - c[1])) // 4 + ((vg - c[2])::BIGINT * (vg - c[2])) // 4 + ((vb - c[3])::BIGINT * (vb - c[3])) // 4 FOR c IN (SELECT list([pr * 257, pg * 257, pb * 257] ORDER BY ord) FROM pal)] AS offs
                      FROM spread d JOIN px p ON p.image_id = d.image_id AND p.y * 16 + p.x = d.k + 1) w) q JOIN pal ON ord = best))"""

#: From px: flood(image_id, cells), the pixels that corner colours reach from the border, in the order of a queue. An entry
#: of the queue is a pixel's number times four plus the number of the corner whose colour it carries.
_STEPS = ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1))
_AHEAD = ", ".join(f"CASE WHEN x + {dx} BETWEEN 0 AND 15 AND y + {dy} BETWEEN 0 AND 15 THEN (y + {dy}) * 16 + x + {dx} END".replace("+ -", "- ") for dx, dy in _STEPS)
FLOOD = f"""corners AS (SELECT image_id, (y // 15) * 2 + x // 15 AS s, r, g, b, a FROM px WHERE x IN (0, 15) AND y IN (0, 15)),
fits AS (SELECT p.image_id, y * 16 + x AS cell, s, greatest(abs(p.r - c.r), abs(p.g - c.g), abs(p.b - c.b), abs(p.a - c.a)) <= {{tolerance}} AS fit FROM px p JOIN corners c USING (image_id)),
nears AS (SELECT image_id, list(fit ORDER BY cell, s) AS near FROM fits GROUP BY image_id),
border AS (SELECT i * 2 + j AS place, j * 240 + i AS cell FROM range(16) t(i), range(2) u(j) UNION ALL SELECT 32 + i * 2 + j, i * 16 + j * 15 FROM range(16) t(i), range(2) u(j)),
begun AS (SELECT image_id, list(cell * 4 + s ORDER BY place) AS queue FROM (SELECT image_id, cell, min(place) AS place, min(s) AS s FROM border JOIN fits USING (cell) WHERE fit GROUP BY image_id, cell) GROUP BY image_id),
flooded(image_id, head, queue) AS (
    SELECT image_id, 1, queue FROM begun
    UNION ALL
    SELECT image_id, head + 1, list_concat(queue, [c * 4 + s FOR c IN ahead IF c IS NOT NULL AND near[c * 4 + s + 1] AND NOT list_contains(cells, c)])
    FROM (SELECT f.image_id, f.head, f.queue, n.near, f.queue[f.head] % 4 AS s, (f.queue[f.head] // 4) % 16 AS x, f.queue[f.head] // 64 AS y, [q // 4 FOR q IN f.queue] AS cells, [{_AHEAD}][:{{connectivity}}] AS ahead
          FROM flooded f JOIN nears n USING (image_id) WHERE f.head <= len(f.queue))),
flood AS (SELECT image_id, unnest([q // 4 FOR q IN queue]) AS cell FROM (SELECT image_id, first(queue ORDER BY head DESC) AS queue FROM flooded GROUP BY image_id))"""
