"""Image queries over `embeddings`, whose vectors of 64 are read as 8 x 8 images, and text queries over `documents`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumagrid.operators import images as I
from lumagrid.operators import vision as V
from lumagrid.sources.images import spread, to_pixels, vectors_as_images


def _images(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return vectors_as_images(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), 8, extra)


def _pixels(operator):
    return lambda spark, sf_dir: to_pixels(operator(_images(spark, sf_dir)))


def _rows(operator):
    return lambda spark, sf_dir: operator(_images(spark, sf_dir))


def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir, "label")
    found = I.nearest_image(images.where("image_id % 20 = 0"), images)
    return found.join(images.select(F.col("image_id").alias("match_id"), "label"), "match_id").select("image_id", "match_id", "distance", "label")


def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.language_letters(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measure of text recognition on letters A-Z of consecutive documents: edits and characters of the first 30."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    truth = docs.select("doc_id", F.substring(F.regexp_replace("text", "[^A-Za-z]", ""), 1, 30).alias("truth"))
    pairs = truth.join(truth.select((F.col("doc_id") - 1).alias("doc_id"), F.col("truth").alias("read")), "doc_id")
    return I.character_errors(pairs, "doc_id")


PSF = np.ones((1, 3))

QUERIES = {
    "otsu": _rows(I.otsu),
    "pixels": _pixels(lambda d: d),
    "box3": _pixels(I.box3),
    "box3_sum": _pixels(I.box3_sum),
    "integral": _pixels(I.integral),
    "median3": _pixels(I.median3),
    "erode_dilate": _pixels(I.opened_rows),
    "laplacian_var": _rows(I.sharpness),
    "watermark_median": _pixels(I.without_watermark),
    "runs": _rows(I.runs),
    "edges": _rows(I.edges),
    "moments": _rows(I.moments),
    "hough": _rows(I.hough),
    "rot90": _pixels(I.rotate90),
    "downsample2": _pixels(I.downsample2),
    "hist_eq": _pixels(I.equalise),
    "unsharp": _pixels(I.unsharp),
    "gamma_sqrt": _pixels(I.gamma_sqrt),
    "stretch": _pixels(I.stretch),
    "kmeans_assign": _pixels(I.classes),
    "proj_rows": _rows(I.row_projection),
    "knn": knn,
    "remove_stains": _pixels(V.remove_stains),
    "segment": _pixels(V.segment),
    "levenshtein": levenshtein,
    "detect_text": _rows(V.detect_text),
    "components": _rows(V.components),
    "regions": _rows(V.regions),
    "text_language": text_language,
    # without an oracle: tested against hand-made images and by degrading and restoring
    "deblur_wiener": _pixels(lambda d: V.deblur(d, PSF)),
    "deblur_richardson_lucy": _pixels(lambda d: V.deblur(d, PSF, "richardson_lucy")),
    "fft_notch": _pixels(V.notch),
    "remove_screen_pattern": _pixels(V.remove_screen_pattern),
    "fill_in": _pixels(V.fill_in),
}

PX = """px AS MATERIALIZED (SELECT vec_id AS image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
  CAST(greatest(0, least(255, floor((CAST(embedding[i + 1] AS DOUBLE) + 0.5) * 256))) AS INTEGER) AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
#: The nine neighbours with repeated borders.
CLAMPED = "d AS (SELECT a.dy, b.dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx))"
_OUT = "SELECT image_id, y, x, v FROM"


def _sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([PX, *ctes]) + "\n" + body


BOX = f"""{CLAMPED}, bx AS MATERIALIZED (SELECT p.image_id, p.y, p.x, CAST(floor(sum(q.v) / 9.0) AS INTEGER) AS v FROM px p, d, px q
  WHERE q.image_id = p.image_id AND q.y = greatest(0, least(7, p.y + d.dy)) AND q.x = greatest(0, least(7, p.x + d.dx)) GROUP BY ALL)"""
SIDES = "(VALUES ('n', -1, 0), ('s', 1, 0), ('w', 0, -1), ('e', 0, 1)) s(dir, dy, dx)"

ORACLES = {
    "otsu": _sql("""SELECT image_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, v) AS k FROM (
      SELECT image_id, v, CASE WHEN w0 < n THEN CAST((s * w0 - n * s0) * (s * w0 - n * s0) AS DOUBLE) / CAST(w0 * (n - w0) AS DOUBLE) ELSE 0.0 END AS score FROM w)) WHERE k = 1""",
      "c AS (SELECT image_id, v, count(*) AS c FROM px GROUP BY ALL)",
      "w AS (SELECT image_id, v, sum(c) OVER up AS w0, sum(c * v) OVER up AS s0, sum(c) OVER al AS n, sum(c * v) OVER al AS s FROM c WINDOW up AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY image_id))"),
    "pixels": _sql("SELECT image_id, y, x, v FROM px"),
    "box3": _sql(f"{_OUT} bx", BOX),
    "box3_sum": _sql("SELECT p.image_id, p.y, p.x, CAST(sum(q.v) AS INTEGER) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL"),
    "integral": _sql("SELECT p.image_id, p.y, p.x, CAST(sum(q.v) AS BIGINT) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND q.y <= p.y AND q.x <= p.x GROUP BY ALL"),
    "median3": _sql("SELECT p.image_id, p.y, p.x, CAST(median(q.v) AS DOUBLE) AS v FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL"),
    "erode_dilate": _sql("SELECT image_id, y, x, max(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM e",
      "e AS (SELECT image_id, y, x, min(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM px)"),
    "laplacian_var": _sql("SELECT image_id, CAST(count(*) * sum(l * l) - sum(l) * sum(l) AS BIGINT) AS sharpness FROM l GROUP BY image_id",
      "l AS (SELECT p.image_id, 4 * p.v - sum(q.v) AS l FROM px p JOIN px q ON q.image_id = p.image_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 WHERE p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.image_id, p.y, p.x, p.v)"),
    "watermark_median": _sql("SELECT image_id, y, x, CAST(v - floor(m) AS INTEGER) AS v FROM px JOIN m USING (y, x)", "m AS (SELECT y, x, median(v) AS m FROM px GROUP BY ALL)"),
    "runs": _sql("SELECT image_id, y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS k FROM px WHERE v > 128) GROUP BY image_id, y, k"),
    "edges": _sql(f"SELECT p.image_id, p.y, p.x, s.dir FROM px p CROSS JOIN {SIDES} LEFT JOIN px q ON q.image_id = p.image_id AND q.y = p.y + s.dy AND q.x = p.x + s.dx WHERE p.v > 128 AND coalesce(q.v, -1) <= 128"),
    "moments": _sql("SELECT image_id, " + ", ".join(f"CAST(sum(v{' * x' * p}{' * y' * q}) AS BIGINT) AS m{p}{q}" for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))) + " FROM px GROUP BY image_id"),
    "hough": _sql("SELECT image_id, theta, CAST(floor((x * c + y * s) / 1000.0) AS INTEGER) AS rho, count(*) AS votes FROM px, (VALUES (0, 1000, 0), (15, 966, 259), (30, 866, 500), (45, 707, 707), (60, 500, 866), (75, 259, 966), (90, 0, 1000)) t(theta, c, s) WHERE v > 200 GROUP BY ALL"),
    "rot90": _sql("SELECT image_id, x AS y, 7 - y AS x, v FROM px"),
    "downsample2": _sql("SELECT image_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(floor(avg(v)) AS INTEGER) AS v FROM px GROUP BY image_id, y // 2, x // 2"),
    "hist_eq": _sql("SELECT image_id, y, x, CAST(floor(255.0::DOUBLE * (c - lo) / greatest(1, 64 - lo)) AS INTEGER) AS v FROM c JOIN (SELECT image_id, min(c) AS lo FROM c GROUP BY image_id) USING (image_id)",
      "c AS (SELECT p.image_id, p.y, p.x, count(*) AS c FROM px p JOIN px q ON q.image_id = p.image_id AND q.v <= p.v GROUP BY ALL)"),
    "unsharp": _sql("SELECT p.image_id, p.y, p.x, greatest(0, least(255, 2 * p.v - b.v)) AS v FROM px p JOIN bx b USING (image_id, y, x)", BOX),
    "gamma_sqrt": _sql("SELECT image_id, y, x, CAST(floor(sqrt(v * 255.0::DOUBLE)) AS INTEGER) AS v FROM px"),
    "stretch": _sql("SELECT image_id, y, x, CASE WHEN hi > lo THEN CAST(floor((v - lo) * 255.0::DOUBLE / (hi - lo)) AS INTEGER) END AS v FROM px JOIN (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id) USING (image_id)"),
    "kmeans_assign": _sql("SELECT image_id, y, x, CASE WHEN abs(v - 64) <= abs(v - 128) AND abs(v - 64) <= abs(v - 192) THEN 0 WHEN abs(v - 128) <= abs(v - 192) THEN 1 ELSE 2 END AS v FROM px"),
    "proj_rows": _sql("SELECT image_id, y, CAST(sum(CASE WHEN v > 128 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM px GROUP BY image_id, y"),
    "knn": _sql("""SELECT image_id, match_id, distance, e.label FROM (SELECT image_id, match_id, CAST(distance AS BIGINT) AS distance, row_number() OVER (PARTITION BY image_id ORDER BY distance, match_id) AS k FROM (
      SELECT p.image_id, q.image_id AS match_id, sum((p.v - q.v) * (p.v - q.v)) AS distance FROM px p JOIN px q ON p.y = q.y AND p.x = q.x AND p.image_id <> q.image_id WHERE p.image_id % 20 = 0 GROUP BY ALL)) JOIN embeddings e ON e.vec_id = match_id WHERE k = 1"""),
    "components": _sql("SELECT image_id, y, x, CAST(min(label) AS INTEGER) AS label FROM r GROUP BY image_id, y, x",
      f"""r AS (SELECT image_id, y, x, y * 8 + x AS label FROM px WHERE v > 128
      UNION SELECT q.image_id, q.y, q.x, r.label FROM r CROSS JOIN {SIDES} JOIN px q ON q.image_id = r.image_id AND q.y = r.y + s.dy AND q.x = r.x + s.dx WHERE q.v > 128)"""),
    "regions": _sql("SELECT image_id, label, CAST(min(x) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1, count(*) AS area FROM c GROUP BY image_id, label",
      f"""r AS (SELECT image_id, y, x, y * 8 + x AS label FROM px WHERE v > 128
      UNION SELECT q.image_id, q.y, q.x, r.label FROM r CROSS JOIN {SIDES} JOIN px q ON q.image_id = r.image_id AND q.y = r.y + s.dy AND q.x = r.x + s.dx WHERE q.v > 128)""",
      "c AS (SELECT image_id, y, x, CAST(min(label) AS INTEGER) AS label FROM r GROUP BY image_id, y, x)"),
    "detect_text": _sql("SELECT image_id, CAST(min(x0) AS INTEGER) AS x0, CAST(min(y) AS INTEGER) AS y0, CAST(max(x1) AS INTEGER) AS x1, CAST(max(y) AS INTEGER) AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY image_id ORDER BY y) AS band FROM r) GROUP BY image_id, band",
      "c AS (SELECT image_id, v, count(*) AS c FROM px GROUP BY ALL)",
      "s AS (SELECT image_id, v, sum(c) OVER up AS w0, sum(c * v) OVER up AS s0, sum(c) OVER al AS n, sum(c * v) OVER al AS s FROM c WINDOW up AS (PARTITION BY image_id ORDER BY v ROWS UNBOUNDED PRECEDING), al AS (PARTITION BY image_id))",
      "o AS (SELECT image_id, v AS t FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN w0 < n THEN CAST((s * w0 - n * s0) * (s * w0 - n * s0) AS DOUBLE) / CAST(w0 * (n - w0) AS DOUBLE) ELSE 0.0 END DESC, v) = 1)",
      "r AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM px JOIN o USING (image_id) WHERE px.v > o.t GROUP BY ALL)"),
    "levenshtein": """SELECT a.doc_id, CAST(levenshtein(a.t, b.t) AS BIGINT) AS edits, CAST(length(a.t) AS BIGINT) AS characters FROM l a JOIN l b ON b.doc_id = a.doc_id + 1""".join(
      ["WITH l AS (SELECT doc_id, substr(regexp_replace(text, '[^A-Za-z]', '', 'g'), 1, 30) AS t FROM documents WHERE text IS NOT NULL) ", ""]),
    "remove_stains": _sql("SELECT image_id, y, x, CAST(greatest(0, least(255, round_even(v * (hi / paper), 0))) AS INTEGER) AS v FROM px JOIN pp USING (image_id, y, x) JOIN (SELECT image_id, max(paper) AS hi FROM pp GROUP BY image_id) USING (image_id)",
      "d5 AS (SELECT a.dy, b.dx FROM (VALUES (-2), (-1), (0), (1), (2)) a(dy), (VALUES (-2), (-1), (0), (1), (2)) b(dx))",
      *(f"{name} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, {of} FROM {source} p, d5 d, {source} q WHERE q.image_id = p.image_id AND q.y = greatest(0, least(7, p.y + d.dy)) AND q.x = greatest(0, least(7, p.x + d.dx)) GROUP BY ALL)"
        for name, of, source in (("p1", "max(q.v) AS v", "px"), ("p2", "min(q.v) AS v", "p1"), ("pp", "greatest(sum(q.v) / 25.0::DOUBLE, 1.0::DOUBLE) AS paper", "p2")))),
    "segment": _sql("SELECT image_id, y, x, CAST(CASE WHEN abs(v - c0) <= abs(v - c1) AND abs(v - c0) <= abs(v - c2) THEN 0 WHEN abs(v - c1) <= abs(v - c2) THEN 1 ELSE 2 END AS INTEGER) AS v FROM px JOIN k12 USING (image_id)",
      "k0 AS (SELECT image_id, min(v) + (max(v) - min(v)) / 6.0::DOUBLE AS c0, min(v) + (max(v) - min(v)) / 2.0::DOUBLE AS c1, min(v) + 5 * (max(v) - min(v)) / 6.0::DOUBLE AS c2 FROM px GROUP BY image_id)",
      *(f"""k{k} AS MATERIALIZED (SELECT image_id, coalesce(sum(v) FILTER (n = 0) / count(*) FILTER (n = 0)::DOUBLE, any_value(c0)) AS c0, coalesce(sum(v) FILTER (n = 1) / count(*) FILTER (n = 1)::DOUBLE, any_value(c1)) AS c1, coalesce(sum(v) FILTER (n = 2) / count(*) FILTER (n = 2)::DOUBLE, any_value(c2)) AS c2 FROM (
      SELECT image_id, v, c0, c1, c2, CASE WHEN abs(v - c0) <= abs(v - c1) AND abs(v - c0) <= abs(v - c2) THEN 0 WHEN abs(v - c1) <= abs(v - c2) THEN 1 ELSE 2 END AS n FROM px JOIN k{k - 1} USING (image_id)) GROUP BY image_id)""" for k in range(1, 13))),
    "text_language": """SELECT doc_id, n_de, n_es, n_fr, CASE WHEN greatest(n_de, n_es, n_fr) = 0 THEN 'en' WHEN n_de = greatest(n_de, n_es, n_fr) THEN 'de' WHEN n_es = greatest(n_de, n_es, n_fr) THEN 'es' ELSE 'fr' END AS lang_tag FROM (
      SELECT doc_id, length(t) - length(translate(t, 'äöüß', '')) AS n_de, length(t) - length(translate(t, 'ñáíóú¿¡', '')) AS n_es, length(t) - length(translate(t, 'èêçàùâîôûëï', '')) AS n_fr FROM (SELECT doc_id, lower(text) AS t FROM documents))""",
}
