import numpy as np
import pytest
from pyspark.sql import functions as F

from lumagrid.operators import images as I
from lumagrid.operators import kernels as K
from lumagrid.operators import lines as L
from lumagrid.operators import outlines as O
from lumagrid.operators import regions as RG
from lumagrid.operators import reports as Q
from lumagrid.operators import segments as G
from lumagrid.operators import tiles as T
from lumagrid.operators import vision as V
from lumagrid.operators import watermarks as M
from lumagrid.operators.links import contracted, ranked
from lumagrid.sources import images as S
from lumagrid.sources import results as J
from tests.test_images import packed


def rasters(df):
    return {r.image_id: np.array(r.v).reshape(r.h, r.w).tolist() for r in df.collect()}


def test_tiles_give_back_and_work_as_whole(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.integers(0, 256, s) for s in ((37, 53), (16, 16), (1, 40), (5, 1))]
    d = packed(spark, *arrays)
    whole = {k: a.tolist() for k, a in enumerate(arrays)}
    tiles = T.cut(d, 16, 2, 3)
    assert rasters(T.stitched(tiles)) == whole and tiles.count() == 12 + 1 + 3 + 1
    assert rasters(T.stitched(T.gather(S.to_pixels(d), d.selectExpr("image_id", "h as image_h", "w as image_w"), 16, 2, 3))) == whole
    for operator, halo in ((I.box3, 1), (I.median3, 1), (I.opened_rows, 2)):
        assert rasters(T.stitched(T.each_tile(d, operator, 16, halo))) == rasters(operator(d))
    none = spark.createDataFrame([(1, None, None, None), (2, 0, 0, [])], "image_id long, h int, w int, v array<int>")
    assert T.cut(none).count() == 0 and T.cut(d.where("false")).count() == 0
    some = S.to_pixels(d).where("image_id = 1 and y != 3")
    filled = rasters(T.stitched(T.gather(some, d.selectExpr("image_id", "h as image_h", "w as image_w"), 8, missing=7)))
    assert filled[1][3] == [7] * 16 and filled[1][4] == whole[1][4]


def labels(runs):
    return {(r.image_id, r.y, x): r.label for r in runs.collect() for x in range(r.x0, r.x1 + 1)}


def test_regions_across_tiles(spark):
    rng = np.random.default_rng(2)
    spiral = np.zeros((31, 31), int)
    spiral[::2] = 255
    spiral[1::4, -1] = spiral[3::4, 0] = 255
    arrays = [rng.integers(0, 256, (40, 33)), spiral, np.zeros((9, 9), int), np.full((20, 20), 255)]
    d = packed(spark, *arrays)
    want = {(k, int(y), int(x)): int(K.components(a > 128)[y, x]) for k, a in enumerate(arrays) for y, x in zip(*np.nonzero(a > 128))}
    for size in (7, 64):
        assert labels(RG.labelled_regions(d, 128, size)) == want
    boxes = {(r.image_id, r.label): r.area for r in RG.region_boxes(RG.labelled_regions(d, 128, 7)).collect()}
    assert boxes[1, 0] == int((spiral > 0).sum()) and boxes[3, 0] == 400 and not any(k == 2 for k, _ in boxes)
    assert RG.labelled_regions(d.where("false")).count() == 0
    named = d.where("image_id = 1").withColumn("image_id", F.lit("a/b.png"))
    assert set(labels(RG.labelled_regions(named, 128, 7)).values()) == {0}


def test_a_large_image_is_labelled_in_many_tasks(spark):
    side, pitch = 4096, 64  # a comb: upright bars that one level bar joins, and dots in between
    rows = spark.range(side).select(F.col("id").cast("int").alias("y")).where(f"y % {pitch} = 0 or y % 4 = 2")
    bar = rows.where(f"y % {pitch} = 0").selectExpr("0L as image_id", "y", f"explode(sequence(0, {side - 1})) as x", "255 as v")
    dots = rows.where("y % 4 = 2").selectExpr("0L as image_id", "y", f"explode(sequence(1, {side - 1}, 2048)) as x", "255 as v")
    post = spark.range(side).selectExpr("0L as image_id", "cast(id as int) as y", "4000 as x", "255 as v")
    pixels = bar.unionByName(post).distinct().unionByName(dots)
    sizes = spark.createDataFrame([(0, side, side)], "image_id long, image_h int, image_w int")
    tiles = T.gather(pixels, sizes, 512, 0, 1)
    boxes = {r.label: (r.x0, r.y0, r.x1, r.y1, r.area) for r in RG.region_boxes(RG.region_runs(tiles)).collect()}
    assert boxes.pop(0) == (0, 0, side - 1, side - 1, side * (side // pitch) + side - side // pitch)
    assert len(boxes) == 2 * side // 4 and all(b[4] == 1 for b in boxes.values())


def test_contraction_and_ranks(spark):
    rng = np.random.default_rng(3)
    links = [(g, int(a), int(b)) for g in (1, 2) for a, b in rng.integers(0, 60, (40, 2))] + [(3, k, k + 1) for k in range(70)] + [(4, 5, 5)]
    root = {}
    for g, a, b in links:
        root.setdefault((g, a), a), root.setdefault((g, b), b)
    for _ in range(80):
        for g, a, b in links:
            root[g, a] = root[g, b] = min(root[g, a], root[g, b])
    got = {(r.group, r.id): r.root for r in contracted(spark.createDataFrame(links, "group long, a long, b long")).collect()}
    alone = {(g, a) for g, a, b in links if a == b} - {k for g, a, b in links if a != b for k in ((g, a), (g, b))}
    assert got == {k: v for k, v in root.items() if k not in alone}
    rings = [(g, int(o[k]), int(o[k - 1])) for g, n in ((1, 1), (2, 2), (3, 37), (4, 64)) for o in [rng.permutation(n) + 10] for k in range(n)]
    placed = {(r.group, r.id): (r.lead, r.hops) for r in ranked(spark.createDataFrame(rings, "group long, id long, to long")).collect()}
    to = {(g, a): b for g, a, b in rings}
    for (g, a), (lead, hops) in placed.items():
        assert lead == 10
        for _ in range(hops):
            a = to[g, a]
        assert a == lead
    assert len(placed) == len(rings) and ranked(spark.createDataFrame([], "group long, id long, to long")).count() == 0


def test_outlines_enclose_the_ink(spark):
    rng = np.random.default_rng(4)
    masks = [rng.random((9, 12)) > 0.5 for _ in range(3)] + [np.array([[1, 0], [0, 1]], bool), np.zeros((3, 3), bool), np.pad(np.zeros((1, 1), bool), 1, constant_values=True)]
    d = packed(spark, *[255 * m for m in masks])
    rings = {}
    for r in sorted(O.outlines(d).collect(), key=lambda r: (r.image_id, r.ring, r.place)):
        rings.setdefault((r.image_id, r.ring), []).append((r.x, r.y))
    for k, m in enumerate(masks):
        own = [p for (i, _), p in rings.items() if i == k]
        assert (K.fill(own, m.shape) == m).all()
        outer = [p for p in own if sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(p, p[1:] + p[:1])) > 0]
        assert len(outer) == len(set(K.components(m)[m].tolist()))  # one for each region; holes run the other way
    assert len([k for k in rings if k[0] == 3]) == 2 and len([k for k in rings if k[0] == 5]) == 2
    drawn = {r.image_id: r for r in V.vectorise(d).collect()}
    assert drawn[4].n_paths == 0 and drawn[5].svg.count("M") == 2
    assert sum(1 for _ in O.outlines(d, corners=False).where("image_id = 5").collect()) == 16


def test_outlines_within_the_task_equal_those_of_joins(spark):
    rng = np.random.default_rng(14)
    arrays = [rng.integers(0, 256, s) for s in ((8, 8), (8, 8), (5, 9), (1, 1), (20, 30))] + [np.full((4, 4), 255), np.zeros((3, 3), int)]
    d = packed(spark, *arrays).unionByName(spark.createDataFrame([(8, 2, 2, [200, None, 200, 1]), (9, None, None, None), (10, 0, 0, [])], "image_id long, h int, w int, v array<int>"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    for corners in (True, False):
        got = rows(O.outlines(d, corners=corners))
        assert got == rows(O.outlines(d, corners=corners, within=0)) == rows(O.outlines(d, corners=corners, within=50)) and len(got) > 100
    assert rows(O.svg(d)) == rows(O.svg(d, within=-1)) and O.svg(d).count() == 9
    named = d.where("image_id = 4").withColumn("image_id", F.lit("a/b.png"))
    assert [r[1:] for r in rows(O.outlines(named))] == [r[1:] for r in rows(O.outlines(d)) if r[0] == 4]
    for out in (O.outlines(d), O.svg(d)):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()  # nothing is shuffled


PAGE = np.array([[12.3, 8.1], [66.2, 13.9], [70.4, 50.2], [9.1, 47.7]])


def page(corners, shape=(60, 80)):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    inside = np.ones(shape, bool)
    for p, q in zip(corners, np.roll(corners, -1, 0)):
        inside &= (q[0] - p[0]) * (y - p[1]) - (q[1] - p[1]) * (x - p[0]) >= 0
    return inside


def test_corners_and_straightening(spark):
    inside = page(PAGE)
    picture = np.where(inside, 220, 20)
    d = packed(spark, picture, np.zeros((6, 6), int))
    got = {(r.image_id, r.corner): (r.x, r.y) for r in L.page_corners(d).collect()}
    assert len(got) == 4 and all(np.hypot(*(np.array(got[0, k]) - PAGE[k])) < 0.6 for k in range(4))
    m = np.array(L.homographies(L.page_corners(d)).first().m).reshape(3, 3)
    for k, (u, t) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1))):
        p = m @ [u, t, 1]
        assert p[:2] / p[2] == pytest.approx(got[0, k], abs=1e-9)
    straight = rasters(V.rectify(d))
    assert (np.array(straight[0])[3:-3, 3:-3] == 220).all() and straight[1] == np.zeros((6, 6), int).tolist()
    # a level line on the page comes out level
    y = np.mgrid[0:60, 0:80]
    q = np.linalg.inv(m) @ np.stack([y[1].ravel(), y[0].ravel(), np.ones(4800)])
    marked = np.where(inside & (np.abs((q[1] / q[2]).reshape(60, 80) - 0.5) < 0.05), 140, picture)
    out = np.array(rasters(V.rectify(packed(spark, marked), over=100))[0])
    assert (np.abs(out[28:32, 4:-4] - 140) < 20).mean() > 0.95 and (out[10:24, 4:-4] == 220).all()


def test_maps_whose_horizon_meets_a_pixel(spark):
    # the right column lies on the horizon: at u = 1 the divisor is 0, and places are infinitely far to the left or right, or undefined
    d = packed(spark, *[np.arange(9).reshape(3, 3)] * 3)
    maps = [(0, [2.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 1.0]), (1, [-2.0, 0.0, 1.0, 0.0, -1.0, 0.0, -1.0, 0.0, 1.0]), (2, [-1.0, 0.0, 1.0, 0.0, 1.0, 0.0, -1.0, 0.0, 1.0])]
    got = rasters(L.warped(d, spark.createDataFrame(maps, "image_id long, m array<double>")))
    assert [[row[2] for row in got[k]] for k in range(3)] == [[8, 8, 8], [6, 0, 0], [8, 8, 8]]


def test_peaks_are_local_maxima(spark):
    cells = [(1, "n", 90, 5, 9), (1, "n", 90, 6, 8), (1, "n", 100, 4, 9), (1, "n", 90, 20, 3), (1, "n", 60, 20, 3), (1, "s", 90, 5, 1)]
    d = spark.createDataFrame(cells, "image_id long, dir string, theta int, rho int, votes long")
    got = sorted((r.dir, r["rank"], r.theta, r.rho) for r in L.peaks(d, 9).collect())
    assert got == [("n", 1, 90, 5), ("n", 2, 60, 20), ("n", 3, 90, 20), ("s", 1, 90, 5)]


def test_lines_within_the_task_equal_those_of_tables(spark):
    rng = np.random.default_rng(13)
    arrays = [rng.integers(0, 256, s) for s in ((8, 8), (8, 8), (5, 9), (1, 1), (30, 40))] + [np.where(page(PAGE), 220, 20), np.zeros((3, 3), int)]
    d = packed(spark, *arrays).unionByName(spark.createDataFrame([(8, 2, 2, [200, None, 200, 1]), (9, None, None, None)], "image_id long, h int, w int, v array<int>"))
    rows = lambda x: sorted(map(tuple, x.select(sorted(x.columns)).collect()))
    for keep in (1, 3):
        got = L.image_peaks(d, keep)
        assert rows(got) == rows(L.image_peaks(d, keep, within=0)) == rows(L.image_peaks(d, keep, within=80)) and got.count() > 20
    assert rows(L.line_sums(d)) == rows(L.line_sums(d, within=0))
    plan = L.page_corners(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "votes" not in plan  # votes stay in their task: only the four lines of an image meet


def test_homography_from_many_points(spark):
    want = K.homography(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float), np.array([[0.1, 0.2], [0.9, 0.15], [0.95, 0.8], [0.05, 0.9]]))
    rng = np.random.default_rng(5)
    p = rng.random((40, 2))
    q = (want @ np.c_[p, np.ones(40)].T).T
    rows = [(1, *map(float, a), float(b[0] / b[2]), float(b[1] / b[2])) for a, b in zip(p, q)] + [(2, 0.0, 0.0, 0.0, 0.0)] * 5
    got = L.fit_homographies(spark.createDataFrame(rows, "image_id long, x double, y double, u double, t double")).collect()
    assert len(got) == 1 and got[0].image_id == 1 and np.abs(np.array(got[0].m) - want.ravel()).max() < 1e-8


def plain_segments(a, scale):
    """The same rounds, region by region."""
    h, w = a.shape
    links = [(abs(int(a[y, x]) - int(a[y + dy, x + dx])), (y * w + x) * 2 + dy, y * w + x, (y + dy) * w + x + dx) for y in range(h) for x in range(w) for dy, dx in ((0, 1), (1, 0)) if y + dy < h and x + dx < w]
    links = [(n, t * 2654435761 % 2**32, p, q) for n, t, p, q in links]
    own, size, inner = {k: k for k in range(h * w)}, dict.fromkeys(range(h * w), 1), dict.fromkeys(range(h * w), 0)
    while links:
        least = {}
        for n, t, p, q in links:
            for r in (own[p], own[q]):
                least[r] = min(least.get(r, (n, t, p, q)), (n, t, p, q))
        fits = lambda n, r: n <= inner[r] + scale / size[r]
        done = {r for r, e in least.items() if not fits(e[0], r)}
        joins = {e for e in least.values() if fits(e[0], own[e[2]]) and fits(e[0], own[e[3]])}
        grown = set()
        for n, _, p, q in joins:
            r, s = sorted((own[p], own[q]))
            for k, o in own.items():
                own[k] = r if o == s else o
            size[r], inner[r] = size[r] + size[s], max(inner[r], inner[s], n)
            grown.add(r)
        grown = {own[r] for r in grown}
        links = [e for e in links if own[e[2]] != own[e[3]] and not any(own[k] in done - grown for k in e[2:])]
    return np.array([own[k] for k in range(h * w)]).reshape(h, w)


def test_graph_segments_equal_plain_rounds(spark):
    rng = np.random.default_rng(6)
    halves = np.where(np.arange(16) < 8, 10, 200) + rng.integers(0, 4, (12, 16))
    ramp = np.add.outer(np.arange(9), 3 * np.arange(9))
    arrays = [halves, ramp, np.full((7, 7), 9), rng.integers(0, 256, (8, 8)), np.array([[5]])]
    d = packed(spark, *arrays)
    for scale in (20.0, 300.0):
        got = {(r.image_id, r.y, r.x): r.label for r in V.segment_regions(d, scale).collect()}
        for k, a in enumerate(arrays):
            want = plain_segments(a, scale)
            first = {}
            for y, x in np.ndindex(*a.shape):
                first.setdefault(want[y, x], y * a.shape[1] + x)
            assert all(got[k, y, x] == first[want[y, x]] for y, x in np.ndindex(*a.shape)), (k, scale)
    assert {got[0, y, x] for y in range(12) for x in range(8)} == {0} and {got[0, y, x] for y in range(12) for x in range(8, 16)} == {8}
    assert {got[2, y, x] for y in range(7) for x in range(7)} == {0}
    assert V.segment_regions(d.where("false")).count() == 0


def test_segments_within_the_task_equal_those_of_tables(spark):
    rng = np.random.default_rng(15)
    arrays = [rng.integers(0, 256, (8, 8)) for _ in range(3)] + [rng.integers(0, 40, (9, 14)), rng.integers(0, 3, (1, 9)) * 90]
    d = packed(spark, *arrays).unionByName(spark.createDataFrame([(5, 2, 2, [200, None, 200, 1]), (6, None, None, None), (7, 0, 0, [])], "image_id long, h int, w int, v array<int>"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    for scale in (20.0, 300.0):
        got = rows(G.graph_segments(d, scale))
        assert got == rows(G.graph_segments(d, scale, within=70)) and len(got) == sum(a.size for a in arrays) + 4
    assert "Exchange" not in G.graph_segments(d)._jdf.queryExecution().executedPlan().toString()  # no rounds over tables


def test_planted_watermark_is_found(spark):
    rng = np.random.default_rng(7)
    opacity, colour = np.zeros((6, 8)), np.full((6, 8), 230.0)
    opacity[2:4, 1:5] = [[0.25, 0.5, 0.75, 0.4], [0.3, 0.6, 0.2, 0.9]]
    clean = [rng.integers(0, 256, (6, 8)) for _ in range(300)]
    marked = [np.floor((1 - opacity) * a + opacity * colour + 0.5).astype(int) for a in clean]
    d, known = packed(spark, *marked), packed(spark, *clean[:40])
    paired = {r.i: r for r in M.matte_of_pairs(d, known).collect()}
    for i in range(48):
        o = opacity.ravel()[i]
        assert paired[i].opacity == pytest.approx(o, abs=0.01) and (o == 0) == (paired[i].opacity == 0)
        assert o == 0 or abs(paired[i].colour - 230) < 1
    back = rasters(V.remove_watermark(d, known))
    seen = opacity <= 0.75
    assert all(np.abs(np.array(back[k]) - a)[seen].max() <= 3 for k, a in enumerate(clean))
    blind = rasters(V.remove_watermark(d))
    error = lambda out: np.mean([np.abs(np.array(out[k]) - a)[seen & (opacity > 0)].mean() for k, a in enumerate(clean)])
    assert error(blind) < 0.4 * error({k: a for k, a in enumerate(marked)})
    assert V.remove_watermark(d.where("false")).count() == 0


def test_adapted_contrast(spark):
    low = (100 + 10 * np.sin(np.mgrid[0:32, 0:32][0] / 3.0)).astype(int)
    flat = np.full((6, 32), 90)
    out = rasters(V.enhance(packed(spark, low, flat, np.array([[3]])), 4))
    assert np.std(out[0]) > 1.5 * low.std() and all(len(set(r)) == 1 for r in out[0])
    assert len({v for r in out[1] for v in r}) == 1  # six rows make three tiles of two: there is no fourth to be drawn towards
    none = spark.createDataFrame([(1, 2, 1, [5, None]), (2, None, None, None)], "image_id long, h int, w int, v array<int>")
    got = {r.image_id: r.v for r in V.enhance(none).collect()}
    assert got[1][1] is None and got[2] is None


def test_quality_report(spark):
    rng = np.random.default_rng(8)
    clean = [rng.integers(0, 256, (8, 12)) for _ in range(2)]
    worse = [np.clip(a + rng.integers(-20, 20, a.shape), 0, 255) for a in clean]
    d = packed(spark, *clean)
    got = {(r.level, r.operator, r.image_id): r for r in Q.quality_report(d, {"same": d, "noise": packed(spark, *worse)}, 4).collect()}
    assert len(got) == 4 + 2 + 1 and got[0, "same", 0].psnr is None and got[1, "same", None].ssim == 1
    parts = []
    for k, (a, b) in enumerate(zip(clean, worse)):
        assert got[0, "noise", k].psnr == pytest.approx(K.psnr(a, b), abs=1e-3)
        own = [K.ssim(a[y : y + 4, x : x + 4], b[y : y + 4, x : x + 4]) for y in (0, 4) for x in (0, 4, 8)]
        assert got[0, "noise", k].ssim == pytest.approx(np.mean(own), abs=1e-5)
        parts += own
    assert got[1, "noise", None].ssim == pytest.approx(np.mean(parts), abs=1e-5) and got[2, None, None].n == 4 * 96
    assert Q.quality_report(d.where("false"), {"same": d}).count() <= 1


def test_layouts_as_json(spark):
    lines = spark.createDataFrame([(1, 0, 1, 0, 0, 9, 4, "a \"b\""), (1, 0, 2, 0, 6, 9, 9, None), (1, 1, 1, 0, 20, 9, 24, "ü"), (2, 0, 1, 0, 3, 4, 5, "")], "image_id long, block long, line int, x0 int, y0 int, x1 int, y1 int, text string")
    texts = J.as_json(J.layout(lines))
    back = J.lines_of(J.from_json(texts))
    assert sorted(map(tuple, back.select(lines.columns).collect()), key=str) == sorted(map(tuple, lines.collect()), key=str)
    assert J.as_json(J.from_json(texts)).collect() == texts.collect()
    broken = spark.createDataFrame([(1, "{"), (2, None)], "image_id long, json string")
    assert all(r.layout is None or r.layout.blocks is None for r in J.from_json(broken).collect())


def test_regions_as_a_table_function(spark):
    rng = np.random.default_rng(9)
    d = packed(spark, *[rng.integers(0, 256, (9, 7)) for _ in range(3)], np.zeros((2, 2), int))
    J.register_functions(spark)
    S.to_pixels(d).createOrReplaceTempView("pixels_of_images")
    got = spark.sql("select * from image_regions(table(pixels_of_images) partition by (image_id), 100)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, V.regions(d, 100).collect()))
