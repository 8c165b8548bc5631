"""Queries over tiles, regions across tiles, outlines, and page borders, and the SQL that checks them.

The images of `embeddings` are also laid out as one sheet, which grows with the table, for what works across tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrid.operators import contrast as C
from lumagrid.operators import images as I
from lumagrid.operators import lines as L
from lumagrid.operators import outlines as O
from lumagrid.operators import regions as RG
from lumagrid.operators import reports as Q
from lumagrid.operators import segments as G
from lumagrid.operators import tiles as T
from lumagrid.operators import vision as V
from lumagrid.operators import watermarks as M
from lumagrid.plans.images import BOX, ORACLES as IMAGES, _images, _sql
from lumagrid.sources import results as J
from lumagrid.sources.images import sheet, to_pixels

#: Images in a row of the sheet, and the side of its tiles.
ACROSS, SIDE = 32, 64


def _sheet(spark: SparkSession, sf_dir: str, before: int, after: int) -> DataFrame:
    return T.gather(*sheet(_images(spark, sf_dir), ACROSS), SIDE, before, after)


def tiled_box3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.to_pixels(I.box3(_sheet(spark, sf_dir, 1, 1))).drop("image_id")


def tiled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RG.region_runs(_sheet(spark, sf_dir, 0, 1)).selectExpr("y", "explode(sequence(x0, x1)) as x", "label")


def tiled_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RG.region_boxes(RG.region_runs(_sheet(spark, sf_dir, 0, 1))).drop("image_id")


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.outlines(_images(spark, sf_dir))


def vectorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.svg(_images(spark, sf_dir))


def hough_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.image_peaks(_images(spark, sf_dir), keep=3)


def _micro(column: str):
    return (F.floor(F.col(column) * 1e6 + 0.5) / 1e6).alias(column)


def corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_corners(_images(spark, sf_dir)).select("image_id", "corner", _micro("x"), _micro("y"))


def homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.homographies(L.page_corners(_images(spark, sf_dir))).select("image_id", F.posexplode("m").alias("k", "m")).select("image_id", "k", _micro("m"))


def rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_pixels(L.rectified(_images(spark, sf_dir)))


def enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_pixels(C.adapted(_images(spark, sf_dir)))


def graph_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without SQL: tests hold it against a plain version that takes link by link."""
    return G.graph_segments(_images(spark, sf_dir))


#: A mark that queries plant on all images: opacity in eighths and colour of place i.
OPACITY, COLOUR = "(i % 4) / 8.0D", "cast(30 * (i % 8) as double)"


def _planted(images: DataFrame) -> DataFrame:
    return I.kernel(images, f"transform(v, (p, i) -> cast(floor((1D - {OPACITY}) * p + {OPACITY} * {COLOUR} + 0.5D) as int))")


def watermark_matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _images(spark, sf_dir)
    return M.matte_of_pairs(_planted(clean), clean).select("i", _micro("opacity"), _micro("colour"))


def watermark_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.matte(_planted(_images(spark, sf_dir))).select("i", _micro("opacity"), _micro("colour"))


def watermark_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _images(spark, sf_dir)
    return to_pixels(M.unmarked(_planted(clean), M.matte_of_pairs(_planted(clean), clean)))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _images(spark, sf_dir)
    return Q.quality_report(d, {"box3": I.box3(d), "gamma_sqrt": I.gamma_sqrt(d), "unsharp": I.unsharp(d)}, 4)


def layout_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of every image, written as JSON, read back by schema and written again."""
    lines = V.text_blocks(V.detect_text(_images(spark, sf_dir)), 0)
    return J.as_json(J.from_json(J.as_json(J.layout(lines))))


def regions_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function from SQL, over the pixels of every image."""
    J.register_functions(spark)
    return spark.sql("select * from image_regions(table({pixels}) partition by (image_id), 128)", pixels=to_pixels(_images(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (tiled_box3, tiled_components, tiled_regions, outlines, vectorise, hough_peaks, corners, homography, rectify, enhance, graph_segment, watermark_matte, watermark_unpaired, watermark_removed, quality_report, layout_json, regions_by_function)}

_SHEET = f"sh AS MATERIALIZED (SELECT CAST((image_id // {ACROSS}) * 8 + y AS INTEGER) AS y, CAST((image_id % {ACROSS}) * 8 + x AS INTEGER) AS x, v FROM px)"
_FOUR = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) s(dy, dx)"
_WALK = f"""r AS (SELECT y, x, y * {8 * ACROSS} + x AS label FROM sh WHERE v > 128
  UNION SELECT q.y, q.x, r.label FROM r CROSS JOIN {_FOUR} JOIN sh q ON q.y = r.y + s.dy AND q.x = r.x + s.dx WHERE q.v > 128)"""
_LABELS = "lb AS (SELECT y, x, CAST(min(label) AS BIGINT) AS label FROM r GROUP BY y, x)"

_INK = "ink AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE v > 128)"
_SIDES = "(VALUES " + ", ".join(f"({k}, {dy}, {dx}, {b[0]}, {b[1]}, {o[0]}, {o[1]}, {right}, {left})" for k, (_, (dy, dx), _) in enumerate(O.SIDES) for b, o, right, left in [O._before(k)]) + ") s(k, dy, dx, ky, kx, oy, ox, r, l)"
_STEPS = f"""st AS MATERIALIZED (SELECT i.image_id, i.y, i.x, k, 4 * (8 * i.y + i.x) + k AS id,
  CASE WHEN b.y IS NULL THEN 4 * (8 * i.y + i.x) + r WHEN o.y IS NULL THEN 4 * (8 * (i.y + ky) + i.x + kx) + k ELSE 4 * (8 * (i.y + oy) + i.x + ox) + l END AS before
  FROM ink i CROSS JOIN {_SIDES} LEFT JOIN ink f ON f.image_id = i.image_id AND f.y = i.y + dy AND f.x = i.x + dx
  LEFT JOIN ink b ON b.image_id = i.image_id AND b.y = i.y + ky AND b.x = i.x + kx LEFT JOIN ink o ON o.image_id = i.image_id AND o.y = i.y + oy AND o.x = i.x + ox WHERE f.y IS NULL)"""
#: From each step on, as long as no lesser one comes; the least start that reaches a step is its ring.
_RINGS = """wk AS (SELECT image_id, id AS ring, id, 0 AS place FROM st UNION ALL SELECT wk.image_id, wk.ring, st.id, wk.place + 1 FROM wk JOIN st ON st.image_id = wk.image_id AND st.before = wk.id WHERE st.id > wk.ring),
pt AS (SELECT image_id, ring, place, CAST(x + CASE WHEN k IN (1, 2) THEN 1 ELSE 0 END AS INTEGER) AS x, CAST(y + CASE WHEN k IN (2, 3) THEN 1 ELSE 0 END AS INTEGER) AS y
  FROM (SELECT image_id, id, min(ring) AS ring, arg_min(place, ring) AS place FROM wk GROUP BY image_id, id) JOIN st USING (image_id, id) WHERE id % 4 <> before % 4)"""

_ANGLES = "(VALUES " + ", ".join(f"('{d}', {a}, {c}, {s})" for d, a, c, s in L.table()) + ") t(dir, theta, c, s)"
_FACES = "(VALUES " + ", ".join(f"('{d}', {dy}, {dx})" for d, (dy, dx) in L.FACING.items()) + ") f(dir, dy, dx)"
_RHO = "CAST(floor(CAST(px * c + py * s AS DOUBLE) / 2000.0::DOUBLE) AS INTEGER)"
_LINES = f"""sd AS MATERIALIZED (SELECT p.image_id, f.dir, 2 * p.x + f.dx AS px, 2 * p.y + f.dy AS py FROM px p CROSS JOIN {_FACES} LEFT JOIN px q ON q.image_id = p.image_id AND q.y = p.y + f.dy AND q.x = p.x + f.dx WHERE p.v > 128 AND coalesce(q.v, -1) <= 128),
ce AS MATERIALIZED (SELECT image_id, dir, theta, {_RHO} AS rho, count(*) AS votes FROM sd JOIN {_ANGLES} USING (dir) GROUP BY ALL),
pk AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id, dir ORDER BY votes DESC, theta, rho) AS INTEGER) AS rank FROM ce WHERE NOT EXISTS (
  SELECT 1 FROM ce o WHERE o.image_id = ce.image_id AND o.dir = ce.dir AND abs(o.theta - ce.theta) <= 10 AND abs(o.rho - ce.rho) <= 1 AND (o.votes > ce.votes OR o.votes = ce.votes AND (o.theta < ce.theta OR o.theta = ce.theta AND o.rho < ce.rho))))"""
_FIT = f"""ow AS (SELECT image_id, dir, CASE WHEN dir IN ('n', 's') THEN px ELSE py END AS u, CASE WHEN dir IN ('n', 's') THEN py ELSE px END AS t FROM sd JOIN pk USING (image_id, dir) JOIN {_ANGLES} USING (dir, theta) WHERE rank = 1 AND abs({_RHO} - rho) <= 1),
su AS (SELECT image_id, dir, count(*) AS n, sum(u) AS su, sum(t) AS st, sum(u * u) AS suu, sum(u * t) AS sut FROM ow GROUP BY ALL),
sl AS (SELECT *, CASE WHEN n * suu - su * su = 0 THEN 0.0::DOUBLE ELSE CAST(n * sut - su * st AS DOUBLE) / CAST(n * suu - su * su AS DOUBLE) END AS slope FROM su),
li AS (SELECT image_id, dir, slope, (CAST(st AS DOUBLE) - slope * CAST(su AS DOUBLE)) / n / 2.0::DOUBLE AS base FROM sl),
co AS (SELECT l.image_id, corner, x, l.slope * x + l.base AS y FROM (VALUES (0, 'n', 'w'), (1, 'n', 'e'), (2, 's', 'e'), (3, 's', 'w')) k(corner, a, b) JOIN li l ON l.dir = a JOIN li m ON m.dir = b AND m.image_id = l.image_id, LATERAL (SELECT CASE WHEN l.slope * m.slope <> 1 THEN (m.slope * l.base + m.base) / (1.0::DOUBLE - l.slope * m.slope) END AS x)
  WHERE (SELECT count(*) FROM li z WHERE z.image_id = l.image_id) = 4)"""
_MAP = """q4 AS (SELECT image_id, """ + ", ".join(f"max(CASE WHEN corner = {k} THEN {c} END) AS {c}{k}" for k in range(4) for c in "xy") + """ FROM co GROUP BY image_id),
qd AS (SELECT *, """ + ", ".join(f"{c}1 - {c}2 AS {c}a, {c}3 - {c}2 AS {c}b, {c}0 - {c}1 + {c}2 - {c}3 AS {c}c" for c in "xy") + """ FROM q4),
qe AS (SELECT *, xa * yb - xb * ya AS det FROM qd),
qg AS (SELECT *, (xc * yb - xb * yc) / det AS g, (xa * yc - xc * ya) / det AS k FROM qe WHERE det <> 0),
ma AS MATERIALIZED (SELECT image_id, [x1 - x0 + g * x1, x3 - x0 + k * x3, x0, y1 - y0 + g * y1, y3 - y0 + k * y3, y0, g, k, 1.0::DOUBLE] AS m FROM qg)"""
_TO = lambda k: f"(m[{k + 1}] * (x / 7.0::DOUBLE) + m[{k + 2}] * (y / 7.0::DOUBLE) + m[{k + 3}]) / (m[7] * (x / 7.0::DOUBLE) + m[8] * (y / 7.0::DOUBLE) + 1.0::DOUBLE)"
_WARP = f"""wa AS (SELECT image_id, px.y, px.x, v, m, greatest(0.0::DOUBLE, least(7.0::DOUBLE, {_TO(0)})) AS u, greatest(0.0::DOUBLE, least(7.0::DOUBLE, {_TO(3)})) AS t FROM px LEFT JOIN ma USING (image_id)),
wb AS (SELECT *, CAST(least(floor(u), 6) AS INTEGER) AS a, CAST(least(floor(t), 6) AS INTEGER) AS b FROM wa)"""


_TILED = """tp AS MATERIALIZED (SELECT image_id, CAST((y // 4) * 2 + x // 4 AS INTEGER) AS tile, v AS p, count(*) AS c FROM px GROUP BY ALL),
ce AS (SELECT *, least(c, 1) AS own, 16 - sum(least(c, 1)) OVER (PARTITION BY image_id, tile) AS spare FROM tp),
tt AS MATERIALIZED (SELECT image_id, tile, u, ((sum(CASE WHEN p <= u THEN own ELSE 0 END) * 256 + (u + 1) * any_value(spare)) * 255 * 4096) // (256 * 16) AS m FROM ce, unnest(range(256)) t(u) GROUP BY image_id, tile, u),
aq AS (SELECT image_id, y, x, v, least(1, greatest(0, 2 * y - 3) // 8) AS ty, least(1, greatest(0, 2 * x - 3) // 8) AS tx, greatest(0, 2 * y - 3) AS ry, greatest(0, 2 * x - 3) AS rx FROM px),
af AS (SELECT *, CASE WHEN ty >= 1 THEN 0 ELSE ry % 8 END AS fy, CASE WHEN tx >= 1 THEN 0 ELSE rx % 8 END AS fx FROM aq)"""
_OPACITY, _COLOUR = "((y * 8 + x) % 4) / 8.0::DOUBLE", "CAST(30 * x AS DOUBLE)"
_PLANTED = f"mk AS MATERIALIZED (SELECT image_id, y, x, y * 8 + x AS i, v AS p, CAST(floor((1.0::DOUBLE - {_OPACITY}) * v + {_OPACITY} * {_COLOUR} + 0.5::DOUBLE) AS INTEGER) AS v FROM px)"
_SUMS = "s1 AS (SELECT i, count(*) AS n, sum(v) AS sv, sum(p) AS sp, sum(p * p) AS spp, sum(p * v) AS spv, sum(v * v) AS svv FROM mk GROUP BY i)"
_PAIRED = "s2 AS (SELECT *, CASE WHEN n * spp - sp * sp <> 0 THEN CAST(n * spv - sp * sv AS DOUBLE) / CAST(n * spp - sp * sp AS DOUBLE) END AS slope FROM s1), s3 AS (SELECT *, (CAST(sv AS DOUBLE) - slope * CAST(sp AS DOUBLE)) / n AS base FROM s2)"
_UNPAIRED = """sm AS (SELECT *, n * svv - sv * sv AS spread, row_number() OVER (ORDER BY n * svv - sv * sv, i) AS k, row_number() OVER (ORDER BY sv, i) AS kv FROM s1),
s2 AS (SELECT *, (SELECT sv FROM sm WHERE kv = 32) AS mid, sqrt(CAST(spread AS DOUBLE) / CAST((SELECT spread FROM sm WHERE k = 32) AS DOUBLE)) AS slope FROM sm), s3 AS (SELECT *, (CAST(sv AS DOUBLE) - slope * CAST(mid AS DOUBLE)) / n AS base FROM s2)"""
_MATTE = f"""ma AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS i, opacity, CASE WHEN opacity = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(255.0::DOUBLE, base / opacity)) END AS colour FROM (
  SELECT i, base, CASE WHEN slope IS NULL OR 1.0::DOUBLE - slope < {M.LEAST}::DOUBLE THEN 0.0::DOUBLE WHEN 1.0::DOUBLE - slope > 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - slope END AS opacity FROM s3))"""


def _round(column: str) -> str:
    return f"floor({column} * 1e6 + 0.5) / 1e6 AS {column}"


ORACLES = {
    "tiled_box3": _sql("SELECT p.y, p.x, CAST(floor(sum(coalesce(q.v, 0)) / 9.0::DOUBLE) AS INTEGER) AS v FROM al p, d LEFT JOIN sh q ON q.y = greatest(0, least(p.h - 1, p.y + d.dy)) AND q.x = greatest(0, least(p.w - 1, p.x + d.dx)) GROUP BY p.y, p.x", _SHEET,
      "d AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))",
      f"hw AS (SELECT (max(image_id) // {ACROSS} + 1) * 8 AS h, {8 * ACROSS} AS w FROM px)",
      "al AS (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, h, w FROM hw, unnest(range(h)) a(y), unnest(range(w)) b(x))"),
    "tiled_components": _sql("SELECT y, x, label FROM lb", _SHEET, _WALK, _LABELS),
    "tiled_regions": _sql("SELECT label, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1, count(*) AS area FROM lb GROUP BY label", _SHEET, _WALK, _LABELS),
    "outlines": _sql("SELECT image_id, CAST(ring AS BIGINT) AS ring, CAST(place AS BIGINT) AS place, x, y FROM pt", _INK, _STEPS, _RINGS),
    "vectorise": _sql("""SELECT e.vec_id AS image_id, CAST(coalesce(n, 0) AS INTEGER) AS n_paths, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8"><path fill-rule="evenodd" d="' || coalesce(d, '') || '"/></svg>' AS svg FROM embeddings e LEFT JOIN dr ON dr.image_id = e.vec_id""", _INK, _STEPS, _RINGS,
      "pa AS (SELECT image_id, ring, 'M' || string_agg(x || ' ' || y, 'L' ORDER BY place) || 'Z' AS path FROM pt GROUP BY ALL)",
      "dr AS (SELECT image_id, count(*) AS n, string_agg(path, '' ORDER BY ring) AS d FROM pa GROUP BY image_id)"),
    "hough_peaks": _sql("SELECT image_id, dir, theta, rho, votes, rank FROM pk WHERE rank <= 3", _LINES),
    "corners": _sql(f"SELECT image_id, corner, {_round('x')}, {_round('y')} FROM co", _LINES, _FIT),
    "homography": _sql(f"SELECT image_id, k, {_round('m')} FROM (SELECT image_id, CAST(i - 1 AS INTEGER) AS k, m[i] AS m FROM ma, unnest(range(1, 10)) t(i))", _LINES, _FIT, _MAP),
    "rectify": _sql("""SELECT w.image_id, w.y, w.x, CASE WHEN w.m IS NULL THEN w.v ELSE CAST(floor((p.v * (1.0::DOUBLE - (u - a)) + q.v * (u - a)) * (1.0::DOUBLE - (t - b)) + (r.v * (1.0::DOUBLE - (u - a)) + s.v * (u - a)) * (t - b) + 0.5::DOUBLE) AS INTEGER) END AS v FROM wb w
      LEFT JOIN px p ON p.image_id = w.image_id AND p.y = b AND p.x = a LEFT JOIN px q ON q.image_id = w.image_id AND q.y = b AND q.x = a + 1 LEFT JOIN px r ON r.image_id = w.image_id AND r.y = b + 1 AND r.x = a LEFT JOIN px s ON s.image_id = w.image_id AND s.y = b + 1 AND s.x = a + 1""", _LINES, _FIT, _MAP, _WARP),
    "enhance": _sql("""SELECT image_id, y, x, CAST((2 * ((a.m * (8 - fx) + b.m * fx) * (8 - fy) + (c.m * (8 - fx) + d.m * fx) * fy) + 64 * 4096) // (2 * 64 * 4096) AS INTEGER) AS v FROM af
      JOIN tt a USING (image_id) JOIN tt b USING (image_id) JOIN tt c USING (image_id) JOIN tt d USING (image_id) WHERE a.u = v AND b.u = v AND c.u = v AND d.u = v
      AND a.tile = ty * 2 + tx AND b.tile = ty * 2 + least(1, tx + 1) AND c.tile = least(1, ty + 1) * 2 + tx AND d.tile = least(1, ty + 1) * 2 + least(1, tx + 1)""", _TILED),
    "watermark_matte": _sql(f"SELECT i, {_round('opacity')}, {_round('colour')} FROM ma", _PLANTED, _SUMS, _PAIRED, _MATTE),
    "watermark_unpaired": _sql(f"SELECT i, {_round('opacity')}, {_round('colour')} FROM ma", _PLANTED, _SUMS, _UNPAIRED, _MATTE),
    "watermark_removed": _sql(f"SELECT image_id, y, x, CASE WHEN opacity = 0 OR opacity > {M.MOST} THEN v ELSE CAST(greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor((v - opacity * colour) / (1.0::DOUBLE - opacity) + 0.5::DOUBLE))) AS INTEGER) END AS v FROM mk JOIN ma ON ma.i = mk.i", _PLANTED, _SUMS, _PAIRED, _MATTE),
    "quality_report": _sql("""SELECT CAST(CASE WHEN grouping(operator) = 1 THEN 2 WHEN grouping(image_id) = 1 THEN 1 ELSE 0 END AS INTEGER) AS level, operator, image_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(error) AS BIGINT) AS error,
      CASE WHEN sum(error) <> 0 THEN round(10.0::DOUBLE * log10(65025.0::DOUBLE * sum(n) / sum(error)), 4) END AS psnr, floor(CAST(sum(similarity) AS DOUBLE) / count(*) + 0.5::DOUBLE) / 1000000.0::DOUBLE AS ssim FROM wi GROUP BY ROLLUP (operator, image_id)""", BOX,
      "re AS (SELECT 'box3' AS operator, image_id, y, x, v AS b FROM bx UNION ALL SELECT 'gamma_sqrt', image_id, y, x, CAST(floor(sqrt(v * 255.0::DOUBLE)) AS INTEGER) FROM px UNION ALL SELECT 'unsharp', p.image_id, p.y, p.x, greatest(0, least(255, 2 * p.v - b.v)) FROM px p JOIN bx b USING (image_id, y, x))",
      "su AS (SELECT operator, image_id, y // 4 AS wy, x // 4 AS wx, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS sa, CAST(sum(b) AS BIGINT) AS sb, CAST(sum(v * v) AS BIGINT) AS saa, CAST(sum(b * b) AS BIGINT) AS sbb, CAST(sum(v * b) AS BIGINT) AS sab FROM px JOIN re USING (image_id, y, x) GROUP BY ALL)",
      f"wi AS (SELECT operator, image_id, n, saa + sbb - 2 * sab AS error, CAST(floor(((2.0::DOUBLE * sa * sb + {Q.C1}::DOUBLE * n * n) / (CAST(sa * sa + sb * sb AS DOUBLE) + {Q.C1}::DOUBLE * n * n)) * ((2.0::DOUBLE * (n * sab - sa * sb) + {Q.C2}::DOUBLE * n * n) / (CAST(n * saa - sa * sa + n * sbb - sb * sb AS DOUBLE) + {Q.C2}::DOUBLE * n * n)) * 1000000.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS similarity FROM su)"),
    "layout_json": f"""WITH bo AS ({IMAGES['detect_text']}),
b1 AS (SELECT *, max(y1) OVER (PARTITION BY image_id ORDER BY y0, x0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bo),
b2 AS (SELECT *, sum(CASE WHEN y0 - reach > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY y0, x0 ROWS UNBOUNDED PRECEDING) AS block FROM b1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY image_id, block ORDER BY y0, x0) AS line FROM b2),
b4 AS (SELECT image_id, block, '{{"block":' || block || ',"lines":[' || string_agg('{{"line":' || line || ',"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}}', ',' ORDER BY line) || ']}}' AS j FROM b3 GROUP BY image_id, block)
SELECT image_id, '{{"blocks":[' || string_agg(j, ',' ORDER BY block) || ']}}' AS json FROM b4 GROUP BY image_id""",
    "regions_by_function": IMAGES["regions"].replace("SELECT image_id, label,", "SELECT image_id, CAST(label AS BIGINT) AS label,", 1),
}
