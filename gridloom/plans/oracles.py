"""DuckDB SQL that computes the same results as the queries of the catalogue."""

from __future__ import annotations

PX = """px AS (SELECT vec_id AS raster_id, CAST(p // 8 AS INT) AS row, CAST(p % 8 AS INT) AS col, CAST(embedding[p + 1] AS DOUBLE) AS v, label AS zone
  FROM embeddings, range(0, 64) AS r(p))"""
MOSAIC = "mosaic AS (SELECT CAST(vec_id AS INT) AS row, CAST(p AS INT) AS col, CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(0, 64) AS r(p))"


def _box(name: str, shift: str = "0") -> str:
    return f"""{name} AS (SELECT box_id, image_id, xmin, ymin, xmin + w AS xmax, ymin + h AS ymax, score FROM (
  SELECT p_partkey AS box_id, CAST(p_partkey % 20 AS INT) AS image_id, CAST(37 * p_partkey % 206 + {shift} AS DOUBLE) AS xmin, CAST(91 * p_partkey % 206 AS DOUBLE) AS ymin,
    CAST(p_size AS DOUBLE) AS w, CAST(1 + p_partkey % 50 AS DOUBLE) AS h, p_retailprice / 1000 AS score FROM part))"""


BOX = _box("box")
SHIFTED = _box("shifted", "p_partkey % 5 - 2")
GEO = "geo AS (SELECT c_custkey AS id, (7919 * c_custkey % 360000) / 1000 - 180 AS lon, (104729 * c_custkey % 160000) / 1000 - 80 AS lat FROM customer)"
BANDS = "bands AS (SELECT vec_id, " + ", ".join(f"CAST(least(255, abs(floor(CAST(embedding[{i}] AS DOUBLE) * 1000))) AS INT) AS {c}" for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM embeddings)"
_A, _E = "6378137.0", "0.0818191908426215"


def _cea(lon0: str, sp: str) -> str:
    s0 = f"sin(radians({sp}))"
    k0 = f"(cos(radians({sp})) / sqrt(1 - {_E} * {_E} * {s0} * {s0}))"
    s = "sin(radians(lat))"
    q = f"((1 - {_E} * {_E}) * ({s} / (1 - {_E} * {_E} * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E})))"
    return f"WITH {GEO} SELECT id, round({_A} * {k0} * radians(lon - {lon0}), 3) AS x, round({_A} * {q} / (2 * {k0}), 3) AS y FROM geo"


GRID = """b AS (SELECT min(xmin) x0, min(ymin) y0, max(xmax) x1, max(ymax) y1 FROM box),
grid AS (SELECT CAST(t AS INT) AS tile_id, x0 + (t % 4) * ((x1 - x0) / 4) AS gx0, y1 - (t // 4 + 1) * ((y1 - y0) / 4) AS gy0, x0 + (t % 4 + 1) * ((x1 - x0) / 4) AS gx1, y1 - (t // 4) * ((y1 - y0) / 4) AS gy1 FROM b, range(0, 16) AS r(t))"""
PIECES = """pieces AS (SELECT tile_id, box_id, image_id, greatest(xmin, gx0) AS xmin, greatest(ymin, gy0) AS ymin, least(xmax, gx1) AS xmax, least(ymax, gy1) AS ymax, gx0, gy0, gx1, gy1
  FROM box, grid WHERE greatest(xmin, gx0) < least(xmax, gx1) AND greatest(ymin, gy0) < least(ymax, gy1))"""
ANN = """ann AS (SELECT row_number() OVER (ORDER BY tile_id, box_id) AS id, tile_id + 1 AS image_id, box_id AS feature_id, 1 AS category_id,
  (xmin - gx0) / abs(gx1 - gx0) * 256 AS xa, (1 - (ymin - gy0) / abs(gy1 - gy0)) * 256 AS ya, (xmax - gx0) / abs(gx1 - gx0) * 256 AS xb, (1 - (ymax - gy0) / abs(gy1 - gy0)) * 256 AS yb FROM pieces)"""


def _pixels(source: str, where: str = "true") -> str:
    return f"SELECT image_id, CAST(ymin AS INT) + r AS row, CAST(xmin AS INT) + c AS col FROM {source}, range(0, 60) AS a(r), range(0, 60) AS d(c) WHERE r < ymax - ymin AND c < xmax - xmin AND {where}"


RATIOS = """round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6) AS dice, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS precision_ref, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall_ref,
  round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS accuracy_ref, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision_textbook"""
MASK = f"""{PX}, on_px AS (SELECT raster_id, row, col FROM (SELECT *, max(v) OVER (PARTITION BY raster_id) AS m FROM px) WHERE v > 0.15 * m)"""
FILLED = f"""{MASK}, bg AS (SELECT raster_id, row, col FROM px ANTI JOIN on_px USING (raster_id, row, col)),
outside AS (SELECT raster_id, row, col FROM bg WHERE row IN (0, 7) OR col IN (0, 7)
  UNION SELECT b.raster_id, b.row, b.col FROM outside o JOIN bg b ON b.raster_id = o.raster_id AND abs(b.row - o.row) + abs(b.col - o.col) = 1),
filled AS (SELECT raster_id, row, col FROM px ANTI JOIN outside USING (raster_id, row, col))"""

CELLS = """cell AS (SELECT raster_id, r AS row, c AS col, CAST(sum(bit) AS INT) AS bits, count(*) AS n, avg(pr) AS my, avg(pc) AS mx FROM (
  SELECT raster_id, row - dr AS r, col - dc AS c, bit, row AS pr, col AS pc FROM filled, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) AS o(dr, dc, bit)) GROUP BY ALL HAVING count(*) >= 3),
link AS (SELECT a.raster_id, a.row AS r1, a.col AS c1, b.row AS r2, b.col AS c2 FROM cell a JOIN cell b ON a.raster_id = b.raster_id AND ((b.row = a.row AND b.col = a.col + 1 AND a.bits & 10 = 10) OR (b.row = a.row + 1 AND b.col = a.col AND a.bits & 12 = 12))),
twoway AS (SELECT * FROM link UNION ALL SELECT raster_id, r2, c2, r1, c1 FROM link),
reach AS (SELECT raster_id, row, col, row AS r, col AS c FROM cell UNION SELECT x.raster_id, x.row, x.col, l.r2, l.c2 FROM reach x JOIN twoway l ON l.raster_id = x.raster_id AND l.r1 = x.r AND l.c1 = x.c),
lab AS (SELECT raster_id, row, col, min(r * 8 + c) AS l FROM reach GROUP BY ALL),
nl AS (SELECT raster_id, r1 AS row, c1 AS col, count(*) AS k FROM link GROUP BY ALL),"""


#: Pixels whose centre lies inside the left half of a notched box (moved by dx, dy): a quadrilateral, its upper side falling to a quarter of the height.
SLANT = f"""{BOX}, q AS (SELECT box_id, image_id, xmin AS x0, (xmin + xmax) / 2 AS x1, ymin AS y0, ymax AS y1, ymin + (ymax - ymin) / 4 AS y2 FROM box),
s AS (SELECT 't' AS s, 0.0 AS dx, 0.0 AS dy, * FROM q UNION ALL SELECT 'shifted', box_id % 5 - 2, 0.25, * FROM q UNION ALL SELECT 'lowered', 0, 3, * FROM q),
m AS (SELECT s, image_id, r AS row, c AS col, count(*) AS n FROM (SELECT *, unnest(range(CAST(floor(y0 + dy) AS INT), CAST(ceil(y1 + dy) AS INT) + 1)) AS r FROM (SELECT *, unnest(range(CAST(floor(x0 + dx) AS INT), CAST(ceil(x1 + dx) AS INT) + 1)) AS c FROM s)) p
  WHERE c + 0.5 >= x0 + dx AND c + 0.5 < x1 + dx AND r + 0.5 >= y0 + dy AND r + 0.5 < y1 + dy AND (r + 0.5 <= y2 + dy OR c + 0.5 < x1 + dx + (r + 0.5 - y2 - dy) / (y1 - y2) * (x0 - x1)) GROUP BY ALL)"""
_RATIOS = "round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice, round(tp / nullif(tp + fn, 0), 6) AS precision_ref, round(tp / nullif(tp + fn, 0), 6) AS recall_ref, round(tp / nullif(tp + fn, 0), 6) AS accuracy_ref, round(tp / nullif(tp + fp, 0), 6) AS precision_textbook"
ZONES = f"""{MOSAIC}, z AS (SELECT p_partkey AS zone_id, 7 * p_partkey % 50 AS x, 31 * p_partkey % 480 AS y, 6 + p_partkey % 9 AS w FROM part),
zp AS (SELECT zone_id, row, col, v FROM z JOIN mosaic ON row >= y AND row < y + w AND col >= x AND col < x + w AND NOT (row >= y + 2 AND row < y + w - 2 AND col >= x + 2 AND col < x + w - 2))"""


def _rings(px: str, on: str, edge: str, result: str) -> str:
    """Borders of filled masks, edge by edge: px with a mask on_px, the places that lie on a raster's edge, what is told of the rings."""
    return f"""WITH RECURSIVE {px}, on_px AS ({on}), bg AS (SELECT raster_id, row, col FROM px ANTI JOIN on_px USING (raster_id, row, col)),
four AS (FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(dr, dc)),
outside AS (SELECT raster_id, row, col FROM bg WHERE {edge} UNION SELECT b.raster_id, b.row, b.col FROM (SELECT raster_id, row + dr AS row, col + dc AS col FROM outside, four) o JOIN bg b USING (raster_id, row, col)),
filled AS (SELECT raster_id, row, col FROM px ANTI JOIN outside USING (raster_id, row, col)),
cell AS (SELECT raster_id, row - dr AS row, col - dc AS col, CAST(sum(bit) AS INT) AS bits FROM filled, (VALUES (0, 0, 1), (0, 1, 2), (1, 0, 4), (1, 1, 8)) AS o(dr, dc, bit) GROUP BY ALL HAVING count(*) >= 3),
side AS (FROM (VALUES (5, 0, -1, 0, 0, 6), (12, 1, 0, 0, 1, 0), (10, 0, 1, 1, 1, 2), (3, -1, 0, 1, 0, 4)) AS o(need, dr, dc, ox, oy, d)),
slant AS (FROM (VALUES (14, 1, 0, 5), (13, 1, 1, 3), (11, 0, 0, 7), (7, 0, 1, 1)) AS o(bits, ox, oy, d)),
e AS (SELECT c.raster_id, c.col + ox AS x, c.row + oy AS y, d FROM cell c JOIN side s ON c.bits & need = need ANTI JOIN cell n ON n.raster_id = c.raster_id AND n.row = c.row + dr AND n.col = c.col + dc
  UNION ALL SELECT raster_id, col + ox, row + oy, d FROM cell JOIN slant USING (bits)),
f AS (SELECT *, x + [1, 1, 0, -1, -1, -1, 0, 1][d + 1] AS ex, y + [0, -1, -1, -1, 0, 1, 1, 1][d + 1] AS ey FROM e),
nxt AS (SELECT a.raster_id, a.x, a.y, a.d, a.ex, a.ey, min((a.d + 12 - b.d) % 8 * 10 + b.d) % 10 AS nd FROM f a JOIN e b ON a.raster_id = b.raster_id AND a.ex = b.x AND a.ey = b.y GROUP BY ALL),
walk AS (SELECT raster_id, ex AS sx, ey AS sy, nd AS sd, ex AS x, ey AS y, nd AS d, d AS was, 0 AS k FROM nxt WHERE d IN (1, 2, 3, 4) AND nd IN (0, 5, 6, 7)
  UNION ALL SELECT w.raster_id, sx, sy, sd, n.ex, n.ey, n.nd, n.d, k + 1 FROM walk w JOIN nxt n ON n.raster_id = w.raster_id AND n.x = w.x AND n.y = w.y AND n.d = w.d
  WHERE (n.ey > sy OR n.ey = sy AND n.ex >= sx) AND NOT (n.ex = sx AND n.ey = sy AND n.nd = sd)),
whole AS (SELECT raster_id, sx, sy, sd FROM walk w JOIN nxt n USING (raster_id, x, y, d) WHERE n.ex = sx AND n.ey = sy AND n.nd = sd),
r AS (SELECT raster_id, sx, sy, list(x ORDER BY k) FILTER (d <> was) AS xs, list(y ORDER BY k) FILTER (d <> was) AS ys, count(*) FILTER (d % 2 = 0) + sqrt(2.0) * count(*) FILTER (d % 2 = 1) AS per,
  sum(x * (y + [0, -1, -1, -1, 0, 1, 1, 1][d + 1]) - (x + [1, 1, 0, -1, -1, -1, 0, 1][d + 1]) * y) / -2.0 AS area FROM walk JOIN whole USING (raster_id, sx, sy, sd) GROUP BY raster_id, sx, sy, sd)
{result}"""


_POINTS = "'POLYGON ((' || array_to_string(list_transform(range(1, len(xs) + 1), lambda i: CAST(xs[i] AS VARCHAR) || '.0 ' || CAST(ys[i] AS VARCHAR) || '.0'), ', ') || ', ' || xs[1] || '.0 ' || ys[1] || '.0))'"
_MOSAIC_PX = MOSAIC + ", px AS (SELECT 0 AS raster_id, row, col, v FROM mosaic)"
_MOSAIC_ON = "SELECT raster_id, row, col FROM px WHERE v > 0.15 * (SELECT max(v) FROM px)"

#: The part of a notched box (box b) over [a, b] x [lo, hi]: its upper side is a V from ymax down to low at mid.
NOTCH = """n AS (SELECT *, (xmin + xmax) / 2 AS mid, ymin + (ymax - ymin) / 4 AS low, 1.5 * (ymax - ymin) / (xmax - xmin) AS slope FROM cut),
v AS (SELECT *, low + slope * abs(a - mid) AS fa, low + slope * abs(b - mid) AS fb FROM n WHERE a < b AND lo < hi),
pieces AS (SELECT *, least(b, mid) AS m1, greatest(a, mid) AS m2 FROM v WHERE greatest(fa, fb) > lo + 1e-9)"""


def _above(c: str) -> str:
    """The area of a piece above the line c: a squared height over twice the slope on both sides of the notch."""
    sq = lambda x: f"pow(greatest(0, low + slope * abs({x} - mid) - {c}), 2)"
    return f"((CASE WHEN a < m1 THEN {sq('a')} - {sq('m1')} ELSE 0 END + CASE WHEN m2 < b THEN {sq('b')} - {sq('m2')} ELSE 0 END) / (2 * slope))"


def _tiled_notches() -> str:
    return f"""WITH {BOX}, {GRID}, cut AS (SELECT tile_id, box_id, box.xmin, box.xmax, box.ymin, box.ymax, gx0, gy0, gx1, gy1, greatest(xmin, gx0) AS a, least(xmax, gx1) AS b, greatest(ymin, gy0) AS lo, gy1 AS hi FROM box, grid), {NOTCH},
shaped AS (SELECT tile_id, box_id, gx0, gy0, gx1, gy1, CASE WHEN low < lo - 1e-9 AND fa > lo + 1e-9 AND fb > lo + 1e-9 AND a < mid AND mid < b THEN 2 ELSE 1 END AS n_parts, {_above('lo')} - {_above('hi')} AS area,
  CASE WHEN fa > lo + 1e-9 THEN a ELSE mid + (lo - low) / slope END AS px0, CASE WHEN fb > lo + 1e-9 THEN b ELSE mid - (lo - low) / slope END AS px1, lo AS py0, least(hi, greatest(fa, fb)) AS py1 FROM pieces)"""


def _q(lat: str) -> str:
    """The authalic q of a latitude in degrees."""
    s = f"sin(radians({lat}))"
    return f"((1 - {_E} * {_E}) * ({s} / (1 - {_E} * {_E} * {s} * {s}) - ln((1 - {_E} * {s}) / (1 + {_E} * {s})) / (2 * {_E})))"


_K0 = f"(cos(radians(30.0)) / sqrt(1 - {_E} * {_E} * sin(radians(30.0)) * sin(radians(30.0))))"
PLACED = """placed AS (SELECT raster_id, epsg, x AS xmin, y AS ymin, x + z AS xmax, y + z AS ymax FROM (SELECT vec_id AS raster_id, [4326, 3857, 6933][vec_id % 3 + 1] AS epsg,
  CAST(CASE WHEN vec_id % 3 = 0 THEN (vec_id * 7919 % 3400) / 10 - 170 ELSE vec_id * 1000 - 200000 END AS DOUBLE) AS x, CAST(CASE WHEN vec_id % 3 = 0 THEN (vec_id * 104729 % 1200) / 10 - 60 ELSE vec_id * 700 - 100000 END AS DOUBLE) AS y,
  CAST(CASE WHEN vec_id % 3 = 0 THEN 0.0008 ELSE 80 END AS DOUBLE) AS z FROM embeddings))"""


def _local_y(y: str) -> str:
    """Metres north in the local equal-area projection of an ordinate of placed."""
    return f"(CASE epsg WHEN 4326 THEN {_A} * {_q(y)} / 2 WHEN 3857 THEN {_A} * {_q(f'(degrees(2 * atan(exp({y} / {_A}))) - 90)')} / 2 ELSE {y} * {_K0} END)"


SQL: dict[str, str] = {
    "filter_area": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice <= 1000",
    "raster_global_threshold": f"WITH {PX} SELECT raster_id, CAST(sum(CASE WHEN v > 0.15 * m THEN 1 ELSE 0 END) AS BIGINT) AS n_set FROM (SELECT *, max(v) OVER (PARTITION BY raster_id) AS m FROM px) GROUP BY raster_id",
    "raster_tile_threshold": f"""WITH {PX}, t AS (SELECT raster_id, greatest(v, 0) AS h, max(greatest(v, 0)) OVER (PARTITION BY raster_id, row // 256, col // 256) AS m FROM px)
SELECT raster_id, n_set, CAST(n_set AS DOUBLE) AS area_m2 FROM (SELECT raster_id, CAST(sum(CASE WHEN m > 0.05 AND h > 0.15 * m THEN 1 ELSE 0 END) AS BIGINT) AS n_set FROM t GROUP BY raster_id) WHERE n_set <= 100""",
    "raster_grayscale_cast": f"WITH {PX} SELECT raster_id, CAST(sum(b) AS BIGINT) AS total, max(b) AS top FROM (SELECT raster_id, CAST(trunc(greatest(v * 100, 0)) AS INT) AS b FROM px) GROUP BY raster_id",
    "raster_band_stats": f"WITH {PX} SELECT raster_id, count(v) AS n, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std FROM px GROUP BY raster_id",
    "raster_tile_index": f"""WITH {MOSAIC}, d AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM mosaic), t AS (SELECT *, CAST(ceil(h / 16) AS INT) AS tr, CAST(ceil(w / 16) AS INT) AS tc FROM d)
SELECT CAST(0 AS BIGINT) AS raster_id, CAST(c * tr + r AS INT) AS tile, CAST(r AS INT) AS tile_row, CAST(c AS INT) AS tile_col, CAST(r * 16 AS INT) AS row0, CAST(c * 16 AS INT) AS col0, CAST(least(r * 16 + 16, h) - r * 16 AS INT) AS tile_height, CAST(least(c * 16 + 16, w) - c * 16 AS INT) AS tile_width
FROM t, range(0, 100000) AS a(r), range(0, 4) AS e(c) WHERE r < tr AND c < tc""",
    "raster_within_budget": f"""WITH {MOSAIC}, d AS (SELECT CAST(0 AS BIGINT) AS raster_id, max(row) + 1 AS height, max(col) + 1 AS width FROM mosaic)
SELECT *, CAST((width // 16) * (height // 16) AS BIGINT) AS n_tiles, (width // 16) * (height // 16) <= 25 AS within_budget FROM d""",
    "raster_extent_crop": f"""WITH {MOSAIC}, d AS (SELECT max(row) + 1 AS h FROM mosaic)
SELECT row, col, v FROM mosaic, d WHERE col + 0.5 BETWEEN 10 AND 30 AND h - row - 0.5 BETWEEN 20 AND 120""",
    "minmax_normalize": f"WITH {PX} SELECT raster_id, row, col, round(CASE WHEN b > a THEN (v - a) / (b - a) * 255 ELSE 0 END, 6) AS v255 FROM (SELECT *, min(v) OVER (PARTITION BY raster_id) AS a, max(v) OVER (PARTITION BY raster_id) AS b FROM px)",
    "rgb_to_gray": f"WITH {BANDS} SELECT vec_id, CAST(floor(CAST(0.299 AS DOUBLE) * r + CAST(0.587 AS DOUBLE) * g + CAST(0.114 AS DOUBLE) * b + 0.5) AS INT) AS gray FROM bands",
    "band_normalize": f"WITH {BANDS} SELECT vec_id, round((r / 255 - 0.420) / 0.213, 6) AS r, round((g / 255 - 0.411) / 0.156, 6) AS g, round((b / 255 - 0.296) / 0.143, 6) AS b FROM bands",
    "bin_expectation": """WITH w AS (SELECT vec_id, i, greatest(CAST(embedding[i % 64 + 1] AS DOUBLE), 0) + 0.1 AS w FROM embeddings, range(0, 256) AS r(i))
SELECT vec_id, round(10 * sum(w * (0.001 + 9.999 * i / 255)) / sum(w), 6) AS height FROM w GROUP BY vec_id""",
    "raster_resample": f"WITH {PX} SELECT raster_id, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(avg(v), 6) AS v FROM px GROUP BY ALL",
    "mae": "SELECT round(avg(abs(CAST(embedding[1] AS DOUBLE) - CAST(embedding[2] AS DOUBLE))), 6) AS mae FROM embeddings",
    "zonal_max": f"WITH {PX} SELECT zone, max(v) AS v_max, round(avg(v), 6) AS v_mean, count(v) AS n FROM px GROUP BY zone",
    "pos_to_coords": f"WITH {BOX} SELECT box_id, round(100 + xmin / 256 * 512, 6) AS x, round(50 + (1 - ymin / 256) * 256, 6) AS y FROM box",
    "coords_to_pos": f"WITH {BOX} SELECT box_id, round(xmin / 512 * 256, 6) AS col, round((1 - ymin / 256) * 256, 6) AS row FROM box",
    "pixel_resolution": f"WITH {BOX} SELECT box_id, round((xmax - xmin) / 256, 3) AS resolution FROM box",
    "equiv_diameter": f"WITH {BOX} SELECT box_id, round(sqrt((xmax - xmin) * (ymax - ymin) * 4 / pi()), 6) AS a_diam_m FROM box",
    "box_measures": f"""WITH {BOX} SELECT row_number() OVER (ORDER BY image_id, box_id) - 1 AS id, box_id, 'Tree' AS class, 'Tree' AS label, (xmax - xmin) * (ymax - ymin) AS area_m2,
  round(sqrt((xmax - xmin) * (ymax - ymin) * 4 / pi()), 6) AS a_diam_m, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy FROM box""",
    "ring_shoelace": f"""WITH {BOX} SELECT box_id, (xmax - xmin) * (ymax - ymin) AS area_m2, 2 * (xmax - xmin + ymax - ymin) AS perim_m, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy,
  round(sqrt((xmax - xmin) * (ymax - ymin) * 4 / pi()), 6) AS a_diam_m FROM box""",
    "box_envelope_centroid": f"WITH {BOX} SELECT box_id, xmin, ymin, xmax, ymax, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy FROM box",
    "ring_clip": f"""WITH {BOX}, c AS (SELECT box_id, least(xmax, 160) - greatest(xmin, 40) AS w, least(ymax, 170) - greatest(ymin, 30) AS h FROM box)
SELECT box_id, w * h AS area_m2, 2 * (w + h) AS perim_m FROM c WHERE w > 0 AND h > 0""",
    "project_cea": _cea("0", "30.0"),
    "project_local_cea": _cea("12.5", "0.0"),
    "project_mercator_inverse": f"WITH {GEO} SELECT id, round({_A} * radians(lon), 3) AS x, round({_A} * ln(tan(radians(45 + lat / 2))), 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM geo",
    "total_bounds": f"WITH {GEO} SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM geo",
    "tile_grid": f"""WITH {GEO}, b AS (SELECT min(lon) x0, min(lat) y0, max(lon) x1, max(lat) y1 FROM geo)
SELECT CAST(t AS INT) AS tile_id, round(x0 + (t % 4) * ((x1 - x0) / 4), 6) AS xmin, round(y1 - (t // 4 + 1) * ((y1 - y0) / 4), 6) AS ymin, round(x0 + (t % 4 + 1) * ((x1 - x0) / 4), 6) AS xmax, round(y1 - (t // 4) * ((y1 - y0) / 4), 6) AS ymax FROM b, range(0, 16) AS r(t)""",
    "tile_overlay_box": f"WITH {BOX}, {GRID}, {PIECES} SELECT tile_id, box_id, image_id, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM pieces",
    "tile_clip_pixels": f"""WITH {MOSAIC}, d AS (SELECT max(vec_id) + 1 AS h FROM embeddings), t AS (SELECT v, CAST(floor((row + 0.5) * 4 / h) AS INT) AS r, CAST(floor((col + 0.5) * 4 / 64) AS INT) AS c, row, col, h FROM mosaic, d)
SELECT r * 4 + c AS tile_id, count(*) AS n, CAST(max(row - ceil(r * h / 4 - 0.5)) AS INT) AS last_row, CAST(max(col - ceil(c * 64 / 4 - 0.5)) AS INT) AS last_col, max(v) AS v_max FROM t GROUP BY r, c""",
    "rasterize_boxes": f"WITH {BOX} SELECT image_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM ({_pixels('box')}) GROUP BY image_id",
    "mask_union": f"WITH {BOX} SELECT image_id, count(*) AS n FROM (SELECT DISTINCT image_id, row, col FROM ({_pixels('box')})) GROUP BY image_id",
    "rasterize_rings": """WITH t AS (SELECT p_partkey AS k, p_partkey % 7 AS x1, p_partkey % 5 AS y1, p_partkey % 7 + 6 + p_partkey % 11 AS x2, p_partkey % 5 + 1 AS y2, p_partkey % 7 + 2 AS x3, p_partkey % 5 + 5 + p_partkey % 13 AS y3 FROM part),
c AS (SELECT *, r + 0.5 AS y FROM t, range(0, 25) AS a(r)),
e AS (SELECT k, r, c AS col, (CASE WHEN (y1 <= y) <> (y2 <= y) AND x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= c + 0.5 THEN 1 ELSE 0 END + CASE WHEN (y2 <= y) <> (y3 <= y) AND x2 + (y - y2) / (y3 - y2) * (x3 - x2) <= c + 0.5 THEN 1 ELSE 0 END
  + CASE WHEN (y3 <= y) <> (y1 <= y) AND x3 + (y - y3) / (y1 - y3) * (x1 - x3) <= c + 0.5 THEN 1 ELSE 0 END) % 2 AS inside FROM c, range(0, 30) AS b(c))
SELECT k AS box_id, count(*) AS n, CAST(sum(r) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM e WHERE inside = 1 GROUP BY k""",
    "coco_images": f"""WITH {BOX}, {GRID}, {PIECES} SELECT CAST(tile_id + 1 AS INT) AS id, 'tile_' || tile_id || '.tif' AS file_name, CAST(256 AS INT) AS width, CAST(256 AS INT) AS height,
  count(box_id) AS n_features, count(DISTINCT image_id) AS n_sources FROM grid LEFT JOIN pieces USING (tile_id) GROUP BY tile_id""",
    "coco_annotations": f"""WITH {BOX}, {GRID}, {PIECES}, {ANN} SELECT id, image_id, feature_id, category_id, round(xa, 6) AS left, round(yb, 6) AS top, round(abs(xb - xa), 6) AS width, round(abs(yb - ya), 6) AS height, CAST(10 AS INT) AS n_numbers,
  round(xa + yb + xb + yb + xb + ya + xa + ya + xa + yb, 6) AS ring_sum FROM ann""",
    "coco_json_roundtrip": f"WITH {BOX}, {GRID}, {PIECES}, {ANN} SELECT id, image_id, 'tile_' || (image_id - 1) || '.tif' AS file_name, category_id, round(xa, 6) AS left, round(yb, 6) AS top, round(abs(xb - xa), 6) AS width, round(abs(yb - ya), 6) AS height FROM ann",
    "match_by_file_name": "SELECT 'tile_' || d.doc_id || '.tif' AS file_name, d.doc_id AS target_id, min(l.doc_id) AS predicted_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id",
    "image_annotation_lookup": f"WITH {BOX} SELECT image_id, 'tile_' || image_id || '.tif' AS file_name, count(*) AS n, min(box_id) AS first_box FROM box GROUP BY image_id",
    "segmentation_scores": f"""WITH s AS (SELECT doc_id % 4 AS pred_set, CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN quality <> 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN quality = 1 AND toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM labels GROUP BY 1)
SELECT pred_set, tp, fp, fn, {RATIOS} FROM s""",
    "segmentation_scores_pixels": f"""WITH {BOX}, {SHIFTED}, t AS (SELECT DISTINCT * FROM ({_pixels('box')})),
p AS (SELECT DISTINCT 'shifted' AS pred_set, * FROM ({_pixels('shifted')}) UNION ALL SELECT DISTINCT 'lowered', image_id, row + 3 AS row, col FROM ({_pixels('box')})),
judged AS (SELECT DISTINCT pred_set, image_id FROM p), tt AS (SELECT pred_set, t.* FROM t JOIN judged USING (image_id)),
j AS (SELECT coalesce(tt.pred_set, p.pred_set) AS pred_set, tt.row IS NOT NULL AS t, p.row IS NOT NULL AS p FROM tt FULL JOIN p ON tt.pred_set = p.pred_set AND tt.image_id = p.image_id AND tt.row = p.row AND tt.col = p.col),
s AS (SELECT pred_set, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM j GROUP BY 1) SELECT pred_set, tp, fp, fn, {RATIOS} FROM s""",
    "box_iou": f"""WITH {BOX}, {SHIFTED}, i AS (SELECT box_id, greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS i,
  (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) AS s FROM box a JOIN shifted b USING (box_id)) SELECT box_id, round(coalesce(i / nullif(s - i, 0), 0), 6) AS iou FROM i""",
    "nms_boxes": f"""WITH RECURSIVE {BOX}, ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS k FROM box),
steps AS (SELECT image_id, 1 AS k, [box_id] AS kept FROM ranked WHERE k = 1
  UNION ALL SELECT s.image_id, s.k + 1, CASE WHEN EXISTS (SELECT 1 FROM box o WHERE list_contains(s.kept, o.box_id) AND
      (greatest(0, least(o.xmax, r.xmax) - greatest(o.xmin, r.xmin)) * greatest(0, least(o.ymax, r.ymax) - greatest(o.ymin, r.ymin))) > 0.2 * ((o.xmax - o.xmin) * (o.ymax - o.ymin) + (r.xmax - r.xmin) * (r.ymax - r.ymin) - greatest(0, least(o.xmax, r.xmax) - greatest(o.xmin, r.xmin)) * greatest(0, least(o.ymax, r.ymax) - greatest(o.ymin, r.ymin))))
    THEN s.kept ELSE list_append(s.kept, r.box_id) END FROM steps s JOIN ranked r ON r.image_id = s.image_id AND r.k = s.k + 1),
last AS (SELECT image_id, arg_max(kept, k) AS kept FROM steps GROUP BY image_id) SELECT b.image_id, b.box_id, b.score FROM box b JOIN last l ON l.image_id = b.image_id AND list_contains(l.kept, b.box_id)""",
    "probability_cut": f"WITH {PX} SELECT zone AS image_id, count(*) AS n FROM (SELECT DISTINCT zone, row, col FROM px WHERE abs(v) * 2 > 0.6) GROUP BY zone",
    "mask_components": f"""WITH RECURSIVE {MASK}, reach AS (SELECT raster_id, row, col, row AS r, col AS c FROM on_px
  UNION SELECT x.raster_id, x.row, x.col, o.row, o.col FROM reach x JOIN on_px o ON o.raster_id = x.raster_id AND abs(o.row - x.r) <= 1 AND abs(o.col - x.c) <= 1),
lab AS (SELECT raster_id, row, col, min(r * 8 + c) AS l FROM reach GROUP BY ALL) SELECT raster_id, CAST(l // 8 AS INT) AS lrow, CAST(l % 8 AS INT) AS lcol, count(*) AS n FROM lab GROUP BY raster_id, l""",
    "fill_holes": f"WITH RECURSIVE {FILLED} SELECT raster_id, count(*) AS n FROM filled GROUP BY raster_id",
    "polygonize_measures": f"""WITH RECURSIVE {FILLED},
{CELLS}
m AS (SELECT raster_id, l, count(*) AS n_cells, sum(CASE WHEN n = 4 THEN 1.0 ELSE 0.5 END) AS area, sum(CASE WHEN n = 4 THEN 4 ELSE 2 END - 2 * coalesce(k, 0)) + sqrt(2.0) * count(*) FILTER (n = 3) AS per,
  min(col) AS xmin, min(row) AS ymin, max(col) + 1 AS xmax, max(row) + 1 AS ymax, CAST(sum(CASE WHEN n = 4 THEN 1.0 ELSE 0.5 END * mx) AS DOUBLE) AS sx, CAST(sum(CASE WHEN n = 4 THEN 1.0 ELSE 0.5 END * my) AS DOUBLE) AS sy
  FROM cell JOIN lab USING (raster_id, row, col) LEFT JOIN nl USING (raster_id, row, col) GROUP BY raster_id, l)
SELECT row_number() OVER (ORDER BY raster_id, ymin, xmin, ymax, xmax, area, sx / area, sy / area) - 1 AS id, raster_id, n_cells, CAST(area AS DOUBLE) AS area_m2, round(per, 6) AS perim_m, round(sqrt(area * 4 / pi()), 6) AS a_diam_m, xmin, ymin, xmax, ymax, round(sx / area, 6) AS cx, round(sy / area, 6) AS cy FROM m""",
    "polygonize_rings": _rings(PX, "SELECT raster_id, row, col FROM (SELECT *, max(v) OVER (PARTITION BY raster_id) AS m FROM px) WHERE v > 0.15 * m", "row IN (0, 7) OR col IN (0, 7)", f"SELECT raster_id, CAST(len(xs) AS INT) AS n_points, CAST(area AS DOUBLE) AS area, round(per, 6) AS perimeter, {_POINTS} AS wkt FROM r"),
    "polygonize_rings_mosaic": _rings(_MOSAIC_PX, _MOSAIC_ON, "row IN (0, (SELECT max(row) FROM px)) OR col IN (0, 63)", f"SELECT CAST(len(xs) AS INT) AS n_points, CAST(area AS DOUBLE) AS area, round(per, 6) AS perimeter, {_POINTS} AS wkt FROM r"),
    "dissolve_boxes": f"""WITH RECURSIVE {BOX}, b AS (SELECT box_id AS i, image_id, xmin AS x0, ymin AS y0, xmin + 3 + box_id % 29 AS x1, ymin + 3 + box_id % 17 AS y1 FROM box),
touch AS (SELECT a.i, b.i AS j FROM b a JOIN b ON a.image_id = b.image_id AND a.i <> b.i AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND (least(a.x1, b.x1) > greatest(a.x0, b.x0) OR least(a.y1, b.y1) > greatest(a.y0, b.y0))),
reach AS (SELECT i, i AS j FROM b UNION SELECT r.i, t.j FROM reach r JOIN touch t ON t.i = r.j),
lab AS (SELECT i, min(j) AS part FROM reach GROUP BY i),
px AS (SELECT DISTINCT image_id, part, x, unnest(range(CAST(y0 AS INT), CAST(y1 AS INT))) AS y FROM (SELECT image_id, part, y0, y1, unnest(range(CAST(x0 AS INT), CAST(x1 AS INT))) AS x FROM b JOIN lab USING (i))),
beside AS (SELECT part, count(*) AS n FROM px a JOIN (SELECT part, x + dx AS x, y + dy AS y FROM px, (VALUES (0, 1), (1, 0)) AS o(dx, dy)) b USING (part, x, y) GROUP BY part)
SELECT image_id, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(any_value(n), 0) AS DOUBLE) AS perimeter, CAST(min(x) AS DOUBLE) AS xmin, CAST(min(y) AS DOUBLE) AS ymin, CAST(max(x) + 1 AS DOUBLE) AS xmax, CAST(max(y) + 1 AS DOUBLE) AS ymax FROM px LEFT JOIN beside USING (part) GROUP BY image_id, part""",
    "repair_rings": f"""WITH {BOX} SELECT box_id, CAST(CASE box_id % 4 WHEN 1 THEN 2 ELSE 1 END AS INT) AS n_parts, CAST(CASE box_id % 4 WHEN 1 THEN 0 ELSE 1 END AS INT) AS n_single, CAST(CASE box_id % 4 WHEN 1 THEN 6 ELSE 4 END AS INT) AS n_points,
round((xmax - xmin) * (ymax - ymin) / CASE box_id % 4 WHEN 1 THEN 2 ELSE 1 END, 6) AS area FROM box""",
    "mask_scores_rings": f"""WITH {SLANT}, k AS (SELECT DISTINCT s AS pred_set, image_id FROM m WHERE s <> 't'), u AS (SELECT pred_set, image_id, row, col, 1 AS t, 0 AS p FROM m JOIN k USING (image_id) WHERE s = 't'
  UNION ALL SELECT s, image_id, row, col, 0, 1 FROM m WHERE s <> 't' AND image_id IN (SELECT image_id FROM m WHERE s = 't')),
g AS (SELECT pred_set, max(t) AS t, max(p) AS p FROM u GROUP BY pred_set, image_id, row, col), n AS (SELECT pred_set, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0) AS fp, count(*) FILTER (p = 0) AS fn FROM g GROUP BY pred_set)
SELECT pred_set, tp, fp, fn, {_RATIOS} FROM n""",
    "mask_runs": f"""WITH {SLANT}, o AS (SELECT image_id, row, col, n, lag(col) OVER (PARTITION BY image_id, row ORDER BY col) AS l FROM m WHERE s = 't')
SELECT image_id, count(*) AS "any", count(*) FILTER (l IS NULL OR l <> col - 1) AS any_runs, count(*) FILTER (n > 1) AS two FROM o GROUP BY image_id""",
    "coco_rle_roundtrip": f"WITH {SLANT} SELECT image_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM m WHERE s = 't' GROUP BY image_id",
    "zonal_polygons": f"WITH {ZONES} SELECT zone_id, count(v) AS n, min(v) AS v_min, max(v) AS v_max, round(avg(v), 6) AS v_mean FROM z LEFT JOIN zp USING (zone_id) GROUP BY zone_id",
    "raster_crop_polygon": f"WITH {ZONES} SELECT DISTINCT row, col, v FROM zp WHERE zone_id % 10 = 1",
    "raster_window_read": f"WITH {MOSAIC} SELECT row, col, CAST(floor(v * 1000) AS INT) AS v FROM mosaic WHERE row BETWEEN 100 AND 399 AND col BETWEEN 5 AND 40",
    "png_folder_roundtrip": f"WITH {PX} SELECT 'image_' || raster_id || '.png' AS file, 8 AS height, 8 AS width, 3 AS count, " + ", ".join(f"CAST(sum(({e}) * (row * 8 + col)) AS BIGINT) AS {c}" for c, e in (("r", "abs(floor(v)) * 40 % 256"), ("g", "floor(abs(v) * 100) % 256"), ("b", "col * 30"))) + " FROM px GROUP BY raster_id",
    "polygon_layer": _rings(PX, "SELECT raster_id, row, col FROM (SELECT *, max(v) OVER (PARTITION BY raster_id) AS m FROM px) WHERE v > 0.15 * m", "row IN (0, 7) OR col IN (0, 7)", "SELECT raster_id, CAST(len(xs) AS INT) AS n_points, round(CAST(area AS DOUBLE) + 1e-9, 3) AS area, round(per + 1e-9, 3) AS perimeter FROM r"),
    "shapefile_roundtrip": f"""WITH {BOX}, p AS (SELECT box_id, xmin, (xmin + xmax) / 2 AS xm, xmax, ymin, ymax, ymin + (ymax - ymin) / 4 AS yn FROM box),
m AS (SELECT *, (xm - xmin) * ((yn - ymin) + (ymax - ymin)) / 2 AS area, (xm - xmin) + (yn - ymin) + (ymax - ymin) + sqrt((xm - xmin) * (xm - xmin) + (ymax - yn) * (ymax - yn)) AS per,
  (xm - xmin) * ((yn - ymin) + (ymax - ymin)) / 2 AS a, ymax - ymin AS h0, yn - ymin AS h1, xm - xmin AS w FROM p),
c AS (SELECT *, xmin + w * (h0 + 2 * h1) / (3 * (h0 + h1)) AS cx, ymin + (h0 * h0 + h0 * h1 + h1 * h1) / (3 * (h0 + h1)) AS cy FROM m)
SELECT layer, box_id, 'Tree' AS class, box_id % 2 = 1 AS odd, round(area + 1e-9, 6) AS area_m2, round(per + 1e-9, 6) AS perim_m, round(x0 + 1e-9, 6) AS xmin, round(y0 + 1e-9, 6) AS ymin, round(x1 + 1e-9, 6) AS xmax, round(y1 + 1e-9, 6) AS ymax, n AS n_points FROM (
SELECT *, 'layer' AS layer, xmin AS x0, ymin AS y0, xm AS x1, ymax AS y1, 4 AS n FROM c UNION ALL SELECT *, 'layer_bb', xmin, ymin, xm, ymax, 4 FROM c UNION ALL SELECT *, 'layer_centroids', cx, cy, cx, cy, 1 FROM c)""",
    "regex_percent": "SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS percent FROM events",
    "output_names": """WITH p AS (SELECT p_partkey, replace(p_brand, '#', '_') || '_' || p_partkey AS s FROM part)
SELECT p_partkey, s || '.shp' AS file, s AS stem, '/out/' || s || '_bb.shp' AS bb, CAST(p_partkey % 9000 AS INT) AS epsg, true AS is_vector FROM p""",
    "raster_tile_threshold_mosaic": f"""WITH {MOSAIC}, t AS (SELECT CAST(row // 16 AS INT) AS tile_row, CAST(col // 16 AS INT) AS tile_col, greatest(v, 0) AS h FROM mosaic), m AS (SELECT *, max(h) OVER (PARTITION BY tile_row, tile_col) AS m FROM t)
SELECT tile_row, tile_col, CAST(sum(CASE WHEN m > 0.05 AND h > 0.15 * m THEN 1 ELSE 0 END) AS BIGINT) AS n_set, max(h) AS tile_max FROM m GROUP BY ALL""",
    "raster_resample_up": f"""WITH {PX}, n AS (SELECT CAST(i AS INT) AS i, greatest(0, least(7, (i + 0.5) / 1.5 - 0.5)) AS p FROM range(0, 12) AS r(i))
SELECT raster_id, y.i AS row, x.i AS col, round(sum((1 - abs(y.p - row)) * (1 - abs(x.p - col)) * v), 6) AS v FROM px JOIN n y ON abs(y.p - row) < 1 JOIN n x ON abs(x.p - col) < 1 GROUP BY ALL""",
    "band_conversions": f"WITH {BANDS} SELECT vec_id, b AS r, r AS b, round(g / 255, 6) AS g_unit, CAST(b = 255 AS INT) AS r_full FROM bands",
    "raster_transpose": f"WITH {PX} SELECT raster_id, col AS row, row AS col, v FROM px",
    "ring_measures_slanted": f"""WITH {BOX}, p AS (SELECT box_id, xmin, ymin, xmax, ymax, unnest([xmin, (xmin + xmax) / 2, (xmin + xmax) / 2, xmin]) AS x, unnest([ymin, ymin, ymin + (ymax - ymin) / 4, ymax]) AS y,
  unnest([(xmin + xmax) / 2, (xmin + xmax) / 2, xmin, xmin]) AS u, unnest([ymin, ymin + (ymax - ymin) / 4, ymax, ymin]) AS w FROM box)
SELECT box_id, round(abs(sum(x * w - u * y)) / 2 + 1e-9, 6) AS area_m2, round(sum(sqrt((u - x) * (u - x) + (w - y) * (w - y))) + 1e-9, 6) AS perim_m, round(sum((x + u) * (x * w - u * y)) / (3 * sum(x * w - u * y)) + 1e-9, 6) AS cx,
  round(sum((y + w) * (x * w - u * y)) / (3 * sum(x * w - u * y)) + 1e-9, 6) AS cy, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM p GROUP BY box_id""",
    "ring_clip_slanted": f"""WITH {BOX}, cut AS (SELECT box_id, xmin, xmax, ymin, ymax, greatest(xmin, 40.0) AS a, least((xmin + xmax) / 2, 160.0) AS b, greatest(ymin, 30.0) AS lo, 170.0 AS hi FROM box), {NOTCH},
s AS (SELECT box_id, {_above('lo')} - {_above('hi')} AS area, CASE WHEN fb > lo THEN b ELSE mid - (lo - low) / slope END AS px1, least(hi, fa) AS py1 FROM pieces)
SELECT box_id, round(area + 1e-9, 6) AS area_m2, round(px1 + 1e-9, 6) AS xmax, round(py1 + 1e-9, 6) AS ymax FROM s WHERE area > 1e-9""",
    "project_cea_inverse": f"""WITH RECURSIVE c AS (SELECT c_custkey AS id, (c_custkey * 7919 % 34000) * 1000.0 - 17e6 AS x, 2 * {_K0} * ((c_custkey * 104729 % 14000) * 1000.0 - 7e6) / {_A} AS q FROM customer),
newton AS (SELECT id, x, q, degrees(asin(q / 2)) AS lat, 0 AS k FROM c
  UNION ALL SELECT id, x, q, lat + degrees(pow(1 - {_E} * {_E} * pow(sin(radians(lat)), 2), 2) / (2 * cos(radians(lat)) * (1 - {_E} * {_E})) * (q - {_q('lat')})), k + 1 FROM newton WHERE k < 8)
SELECT id, round(degrees(x / ({_A} * {_K0})), 6) AS lon, round(lat, 6) AS lat FROM newton WHERE k = 8""",
    "reproject_boxes": f"WITH {GEO} SELECT id AS raster_id, round({_A} * {_K0} * radians(lon), 3) AS xmin, round({_A} * {_q('lat')} / (2 * {_K0}), 3) AS ymin, round({_A} * {_K0} * radians(lon + 0.5), 3) AS xmax, round({_A} * {_q('(lat + 0.25)')} / (2 * {_K0}), 3) AS ymax FROM geo",
    "reproject_rings": f"""WITH {BOX} SELECT box_id, round({_A} * {_A} * radians(xmax - xmin) * ({_q('ymax / 4')} - {_q('ymin / 4')}) / 2 / 1e6, 3) AS area_km2, round({_A} * {_K0} * radians(xmin), 3) AS xmin, round({_A} * {_q('ymax / 4')} / (2 * {_K0}), 3) AS ymax FROM box""",
    "raster_crop_reprojected": f"""WITH {MOSAIC}, d AS (SELECT max(row) + 1 AS h FROM mosaic)
SELECT row, col, v FROM mosaic, d WHERE (col + 0.5) * 10 BETWEEN {_A} * radians(0.001) AND {_A} * radians(0.004) AND (h - row - 0.5) * 10 BETWEEN {_A} * ln(tan(radians(45 + 0.001))) AND {_A} * ln(tan(radians(45 + 0.015)))""",
    "tile_overlay_ring": f"{_tiled_notches()} SELECT tile_id, box_id, n_parts, round(area + 1e-9, 6) AS area, round(px0 + 1e-9, 6) AS xmin, round(py0 + 1e-9, 6) AS ymin, round(px1 + 1e-9, 6) AS xmax, round(py1 + 1e-9, 6) AS ymax FROM shaped",
    "coco_annotations_ring": f"""{_tiled_notches()} SELECT row_number() OVER (ORDER BY tile_id, box_id) AS id, tile_id + 1 AS image_id, box_id AS feature_id, round((px0 - gx0) / (gx1 - gx0) * 256 + 1e-9, 6) AS left, round((1 - (py1 - gy0) / (gy1 - gy0)) * 256 + 1e-9, 6) AS top,
  round((px1 - px0) / (gx1 - gx0) * 256 + 1e-9, 6) AS width, round((py1 - py0) / (gy1 - gy0) * 256 + 1e-9, 6) AS height, n_parts FROM shaped""",
    "coco_mask": f"""WITH {BOX}, {GRID}, {PIECES}, {ANN.replace('256', '32')}, m AS (SELECT DISTINCT image_id, r AS row, c AS col FROM ann, range(0, 32) AS a(r), range(0, 32) AS d(c) WHERE r + 0.5 >= yb AND r + 0.5 < ya AND c + 0.5 >= xa AND c + 0.5 < xb)
SELECT image_id, count(*) AS n, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM m GROUP BY image_id""",
    "coco_results": f"WITH {BOX}, {GRID}, {PIECES}, {ANN} SELECT ann.id, ann.image_id, feature_id, round(score, 6) AS score, round(xa, 6) AS xmin, round(yb, 6) AS ymin, round(xb, 6) AS xmax, round(ya, 6) AS ymax FROM ann JOIN box ON box_id = feature_id",
    "layers_roundtrip": f"WITH {BOX} SELECT unnest(['trees_vector', 'trees_vector_bb', 'trees_vector_centroids']) AS layer, count(*) AS n, sum((xmax - xmin) * (ymax - ymin)) AS area_m2 FROM box",
    "filtered_layer_roundtrip": f"WITH {BOX} SELECT box_id, (xmax - xmin) * (ymax - ymin) AS area_m2 FROM box WHERE (xmax - xmin) * (ymax - ymin) <= 400",
    "raster_roundtrip": f"WITH {MOSAIC} SELECT row, col, v, (SELECT max(row) + 1 FROM mosaic) AS height, CAST(3857 AS INT) AS epsg FROM mosaic WHERE row BETWEEN 20 AND 130 AND col BETWEEN 10 AND 40",
    "geotiff_roundtrip": f"""WITH {PX}, {PLACED} SELECT 'raster_' || raster_id || '.tif' AS file, CAST(8 AS INT) AS height, CAST(8 AS INT) AS width, CAST(1 AS INT) AS count, CAST(epsg AS INT) AS epsg, round(xmin, 5) AS xmin, round(ymin, 5) AS ymin, round(xmax, 5) AS xmax, round(ymax, 5) AS ymax,
  count(v) AS n, max(v) AS v_max, round(sum(v * (row * 8 + col)), 6) AS placed FROM px JOIN placed USING (raster_id) GROUP BY raster_id, placed.epsg, placed.xmin, placed.ymin, placed.xmax, placed.ymax""",
    "mask_folder_roundtrip": f"WITH {PX} SELECT 'mask_' || raster_id || '.tif' AS file, count(*) FILTER (v > 0) AS n_on FROM px GROUP BY raster_id",
    "export_dataset": f"""{_tiled_notches().replace(GRID, GRID.replace('SELECT min(xmin) x0, min(ymin) y0, max(xmax) x1, max(ymax) y1 FROM box', 'SELECT 0.0 x0, 0.0 y0, 256.0 x1, 256.0 y1'))}, {MOSAIC}, d AS (SELECT max(row) + 1 AS h FROM mosaic),
t AS (SELECT CAST(floor((row + 0.5) * 4 / h) * 4 + floor((col + 0.5) * 4 / 64) AS INT) AS tile_id, count(DISTINCT row) AS height, count(DISTINCT col) AS width, round(max(CAST(v AS FLOAT)::DOUBLE), 5) AS v_max FROM mosaic, d GROUP BY 1)
SELECT tile_id + 1 AS image_id, 'tile_' || tile_id || '.tif' AS file_name, width, height, CAST(height AS INT) AS file_height, gx0 AS xmin, gy1 AS ymax, count(*) AS n_annotations, v_max FROM shaped JOIN t USING (tile_id) GROUP BY tile_id, width, height, gx0, gy1, v_max""",
    "outputs_distinct": "SELECT DISTINCT '/out/' || p_brand AS path FROM part UNION SELECT '/out/' || lower(p_brand) FROM part",
    "raster_to_vector": f"""WITH RECURSIVE {FILLED},
{CELLS}
{PLACED}, sized AS (SELECT cell.*, {_A} * radians(CASE epsg WHEN 4326 THEN (xmax - xmin) / 8 WHEN 3857 THEN degrees((xmax - xmin) / 8 / {_A}) ELSE degrees((xmax - xmin) / 8 / {_A} / {_K0}) END) AS w,
  {_local_y('(ymin + (1 - row / 8) * (ymax - ymin))')} - {_local_y('(ymin + (1 - (row + 1) / 8) * (ymax - ymin))')} AS h, xmin, ymin, xmax, ymax FROM cell JOIN placed USING (raster_id)),
sides AS (SELECT raster_id, r1 AS row, c1 AS col, count(*) FILTER (c2 > c1) AS rights, count(*) FILTER (r2 > r1) AS downs FROM link GROUP BY ALL),
f AS (SELECT raster_id, l, count(*) AS n_cells, sum(CASE WHEN n = 4 THEN w * h ELSE w * h / 2 END) AS area, sum(CASE WHEN n = 4 THEN 2 * w + 2 * h ELSE w + h + sqrt(w * w + h * h) END - 2 * h * coalesce(rights, 0) - 2 * w * coalesce(downs, 0)) AS per,
  min(xmin + col / 8 * (xmax - xmin)) AS x0, min(ymin + (1 - (row + 1) / 8) * (ymax - ymin)) AS y0, max(xmin + (col + 1) / 8 * (xmax - xmin)) AS x1, max(ymin + (1 - row / 8) * (ymax - ymin)) AS y1
  FROM sized JOIN lab USING (raster_id, row, col) LEFT JOIN sides USING (raster_id, row, col) GROUP BY raster_id, l)
SELECT raster_id, n_cells, round(area, 3) AS area_m2, round(per, 3) AS perim_m, round(sqrt(area * 4 / pi()), 3) AS a_diam_m, round(x0, 5) AS xmin, round(y0, 5) AS ymin, round(x1, 5) AS xmax, round(y1, 5) AS ymax FROM f""",
}

SQL["detections_layer"] = SQL["nms_boxes"].replace("FROM part))", "FROM part) WHERE score > 0.905)").rpartition(" SELECT b.image_id")[0] + """ SELECT box_id, 'Tree' AS class, round((xmax - xmin) * 2 * (ymax - ymin) / 2, 6) AS area_m2, round(b.image_id * 1000 + xmin * 2, 6) AS xmin, round(628 - ymax / 2, 6) AS ymin,
  round(b.image_id * 1000 + xmax * 2, 6) AS xmax, round(628 - ymin / 2, 6) AS ymax, round(b.image_id * 1000 + xmin + xmax, 6) AS cx, round(628 - (ymin + ymax) / 4, 6) AS cy FROM box b JOIN last l ON l.image_id = b.image_id AND list_contains(l.kept, b.box_id)"""

_KEPT = "FROM box b JOIN last l ON l.image_id = b.image_id AND list_contains(l.kept, b.box_id)"
SQL["instance_polygons"] = SQL["nms_boxes"].rpartition(" SELECT b.image_id")[0] + f""", nth AS (SELECT box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY box_id) - 1 AS INT) AS instance FROM box)
SELECT image_id, instance, round(score, 6) AS score, 4 AS n_points, round(image_id * 1000 + 2 * xmin + 1e-9, 3) AS xmin, round(1102 - 2 * ymax + 1e-9, 3) AS ymin, round(image_id * 1000 + 2 * xmax - 2 + 1e-9, 3) AS xmax, round(1100 - 2 * ymin + 1e-9, 3) AS ymax
FROM (SELECT b.* {_KEPT}) k JOIN nth USING (box_id) WHERE xmax - xmin > 1 AND ymax - ymin > 1"""
SQL["detect_objects"] = SQL["nms_boxes"].replace("FROM part))", "FROM part) WHERE score > 0.905)").replace("> 0.2 *", "> 0.4 *").rpartition(" SELECT b.image_id")[0] + f""" SELECT box_id, 'Tree' AS class, round(4 * (xmax - xmin) * (ymax - ymin), 6) AS area_m2, round(b.image_id * 1000 + 2 * xmin, 6) AS xmin, round(1100 - 2 * ymax, 6) AS ymin,
  round(b.image_id * 1000 + 2 * xmax, 6) AS xmax, round(1100 - 2 * ymin, 6) AS ymax, round(b.image_id * 1000 + xmin + xmax, 6) AS cx, round(1100 - ymin - ymax, 6) AS cy {_KEPT}"""
SQL["binary_rasters"] = f"""WITH {MASK}, f AS (SELECT raster_id, 'mask_' || raster_id || '.tif' AS file_name, count(*) AS n FROM px GROUP BY raster_id), s AS (SELECT raster_id, count(*) AS k FROM on_px GROUP BY raster_id)
SELECT row_number() OVER (ORDER BY file_name) - 1 AS id, file_name, CAST(coalesce(k, 0) AS BIGINT) AS n_set, n FROM f LEFT JOIN s USING (raster_id)"""
