import numpy as np
import pyarrow as pa
import pytest

from lumagrid.operators import images as I
from lumagrid.operators import kernels as K
from lumagrid.operators import models
from lumagrid.operators import vision as V
from lumagrid.sources import images as S
from lumagrid.streaming.ingest import decode_pgm, pictures_to_parquet, stream_files, to_parquet

A = [[0, 10, 20], [30, 40, 50], [60, 70, 200]]


def packed(spark, *arrays):
    rows = [(k, len(a), len(a[0]), [int(x) for r in a for x in r]) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "image_id long, h int, w int, v array<int>")


def values(df):
    r = df.orderBy("image_id").collect()
    return [np.array(x.v).reshape(x.h, x.w).tolist() for x in r]


def test_filters_by_hand(spark):
    a = packed(spark, A)
    assert values(I.box3(a))[0] == [[13, 20, 26], [33, 53, 73], [53, 86, 120]]
    assert values(I.box3_sum(a))[0] == [[80, 150, 120], [210, 480, 390], [200, 450, 360]]
    assert values(I.integral(a))[0] == [[0, 10, 30], [30, 80, 150], [90, 210, 480]]
    assert values(I.median3(a))[0] == [[20.0, 25.0, 30.0], [35.0, 40.0, 45.0], [50.0, 55.0, 60.0]]
    assert values(I.opened_rows(a))[0] == [[0, 10, 10], [30, 40, 40], [60, 70, 70]]
    assert values(I.rotate90(a))[0] == [[60, 30, 0], [70, 40, 10], [200, 50, 20]]
    assert values(I.stretch(a))[0] == [[0, 12, 25], [38, 51, 63], [76, 89, 255]]
    assert values(I.classes(a))[0] == [[0, 0, 0], [0, 0, 0], [0, 0, 2]]
    assert I.sharpness(a).first().sharpness == 0
    m = I.moments(a).first()
    assert (m.m00, m.m10, m.m01) == (480, 660, 780)


def test_properties(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 256, (8, 8)) for _ in range(4)]
    d = packed(spark, *arrays)
    four = d
    for _ in range(4):
        four = I.rotate90(four)
    assert values(four) == [a.tolist() for a in arrays]
    assert [v[-1][-1] for v in values(I.integral(d))] == [int(a.sum()) for a in arrays]
    for low, a in zip(values(I.kernel(d, I.R.ERODED)), arrays):
        assert (np.array(low) <= a).all()
    for e, a in zip(values(I.equalise(d)), arrays):
        order = np.argsort(a.ravel(), kind="stable")
        assert (np.diff(np.array(e).ravel()[order]) >= 0).all()
    labels = [len(set(K.components(a > 128)[a > 128])) for a in arrays]
    turned = [len(set(K.components(np.rot90(a) > 128)[np.rot90(a) > 128])) for a in arrays]
    assert labels == turned
    got = {r.image_id: r.threshold for r in I.otsu(d).collect()}
    assert all(got[k] == V._otsu(a.astype(float)) for k, a in enumerate(arrays))
    back = S.to_packed(S.to_pixels(d))
    assert values(back) == [a.tolist() for a in arrays]


def test_empty_and_flat(spark):
    none = packed(spark, A).where("false")
    assert I.otsu(none).count() == 0 and V.components(none).count() == 0 and I.without_watermark(none).count() == 0
    flat = packed(spark, [[7, 7], [7, 7]])
    assert values(I.stretch(flat))[0] == [[None, None], [None, None]]
    assert I.otsu(flat).first().threshold == 7


def test_runs_edges_hough(spark):
    d = packed(spark, [[200, 200, 0], [0, 0, 0], [0, 201, 250]])
    assert sorted(map(tuple, I.runs(d).collect())) == [(0, 0, 0, 1), (0, 2, 1, 2)]
    assert I.edges(d).count() == 12
    assert sum(r.votes for r in I.hough(d).collect()) == 14
    assert [r.n for r in I.row_projection(d).orderBy("y").collect()] == [2, 0, 2]


def test_watermark_and_knn(spark):
    rng = np.random.default_rng(1)
    mark = rng.integers(0, 60, (4, 4))
    images = [np.full((4, 4), 0) + mark for _ in range(3)] + [rng.integers(0, 100, (4, 4)) + mark for _ in range(2)]
    assert values(I.without_watermark(packed(spark, *images)))[0] == np.zeros((4, 4), int).tolist()
    d = packed(spark, [[0, 0]], [[3, 4]], [[0, 1]], [[1, 0]])
    got = {r.image_id: (r.match_id, r.distance) for r in I.nearest_image(d, d).collect()}
    assert got[0] == (2, 1) and got[1] == (2, 18)


def test_degrade_and_restore():
    y, x = np.mgrid[0:32, 0:32]
    clean = (40 + 170 * ((y // 8 + x // 8) % 2)).astype(float)
    psf = np.ones((1, 5))
    blurred = K._blur(clean, psf)
    for restored in (K.wiener(blurred, psf, 1e-3), K.richardson_lucy(blurred, psf)):
        assert K.psnr(clean, restored) > K.psnr(clean, blurred) and K.ssim(clean, restored) > K.ssim(clean, blurred)
    smooth = 100 + 50 * np.sin(2 * np.pi * y / 32)
    screen = smooth + 30 * np.cos(2 * np.pi * 11 * x / 32)
    assert K.psnr(smooth, K.demoire(screen)) > K.psnr(smooth, screen) + 10
    assert K.psnr(smooth, K.notch(screen, 0, 11)) > 40
    mask = np.zeros((32, 32), bool)
    mask[10:14, 5:20] = True
    marked = np.where(mask, 255.0, smooth)
    assert K.psnr(smooth, K.inpaint(marked, mask)) > K.psnr(smooth, marked) + 10
    page = np.full((32, 32), 220.0)
    page[8:10, 6:26] = 30
    stained = page * (1 - 0.4 * np.exp(-((y - 20) ** 2 + (x - 16) ** 2) / 60))
    low = 100 + 10 * np.sin(y / 3.0)
    assert K.clahe(low).std() > low.std()


def test_stains_and_segments(spark):
    y, x = np.mgrid[0:16, 0:16]
    page = np.full((16, 16), 220)
    page[4:5, 3:13] = 30
    stained = (page * (1 - 0.4 * np.exp(-((y - 10) ** 2 + (x - 8) ** 2) / 60))).astype(int)
    clean = np.array(values(V.remove_stains(packed(spark, stained), 2))[0])
    assert K.psnr(page, clean) > K.psnr(page, stained)
    classes = np.array([[10, 12, 100], [101, 99, 240], [11, 241, 239]])
    assert values(V.segment(packed(spark, classes)))[0] == [[0, 0, 1], [1, 1, 2], [0, 2, 2]]
    assert values(V.segment(packed(spark, [[7, 7]])))[0] == [[0, 0]]


def test_expressions_equal_kernels(spark):
    rng = np.random.default_rng(9)
    arrays = [rng.integers(0, 256, (6, 8)) for _ in range(5)]
    d = packed(spark, *arrays)
    for fy, fx in ((0, 1), (2, 3), (3, 4), (0, 0)):
        assert all(np.abs(np.array(g) - K.notch(a.astype(float), fy, fx)).max() <= 1 for g, a in zip(values(V.notch(d, fy, fx)), arrays))
    got = {}
    for r in V.detect_text(d).collect():
        got.setdefault(r.image_id, set()).add((r.x0, r.y0, r.x1, r.y1))
    assert all(got[k] == set(K.text_lines(a > V._otsu(a.astype(float)))) for k, a in enumerate(arrays))
    large = packed(spark, rng.integers(0, 256, (400, 500)))
    assert I.otsu(large).first().threshold == V._otsu(np.array(large.first().v, float).reshape(400, 500))


def test_layout_of_lines(spark):
    lines = spark.createDataFrame([(1, 0, 20, 9, 24), (1, 0, 0, 9, 4), (1, 0, 6, 9, 9), (2, 0, 3, 4, 5)], "image_id long, x0 int, y0 int, x1 int, y1 int")
    got = sorted((r.image_id, r.y0, r.block, r.line) for r in V.text_blocks(lines).collect())
    assert got == [(1, 0, 0, 1), (1, 6, 0, 2), (1, 20, 1, 1), (2, 3, 0, 1)]


def test_colours_and_names(spark, tmp_path):
    rng = np.random.default_rng(6)
    picture = rng.integers(0, 256, (4, 6, 3))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(S.png(picture))
    read = S.read_images(spark, str(tmp_path / "in"))
    colours = S.channels(read)
    assert {r.c: np.array(r.v).reshape(4, 6).tolist() for r in colours.collect()} == {k: picture[:, :, k].tolist() for k in range(3)}
    assert {(r.c, r.threshold) for r in S.each_channel(colours, I.otsu).collect()} == {(k, V._otsu(picture[:, :, k].astype(float))) for k in range(3)}
    # read, change, write: names come from URIs
    S.write_png(S.merged(I.kernel(colours, "transform(v, p -> 255 - p)")), str(tmp_path / "out"))
    S.write_png(V.segment(S.grey(read)), str(tmp_path / "grey"))
    files = [p.name for p in (tmp_path / "out").iterdir()]
    assert len(files) == 1 and files[0].startswith("a-") and files[0].endswith(".png")
    again = S.read_images(spark, str(tmp_path / "out")).first()
    assert (np.frombuffer(again["data"], np.uint8).reshape(4, 6, 3) == 255 - picture).all()
    assert S.file_name("../x") != S.file_name("x") == "x" and "/" not in S.file_name("../../etc")


def test_rectify_and_outlines_of_arrays():
    rng = np.random.default_rng(5)
    page = np.zeros((40, 40))
    corners = np.array([[8, 5], [33, 8], [30, 35], [5, 30]], float)
    square = np.array([[0, 0], [19, 0], [19, 19], [0, 19]], float)
    y, x = np.mgrid[0:40, 0:40]
    p = K.homography(corners, square) @ np.stack([x.ravel(), y.ravel(), np.ones(1600)])
    u, v = (p[0] / p[2]).reshape(40, 40), (p[1] / p[2]).reshape(40, 40)
    inside = (u >= 0) & (u <= 19) & (v >= 0) & (v <= 19)
    page[inside] = 200 - 100 * (v[inside] > 10)
    out = K.rectify(page, inside, (20, 20))
    assert np.abs(out[2:8, 2:18] - 200).mean() < 5 and np.abs(out[13:18, 2:18] - 100).mean() < 5
    for _ in range(5):
        mask = rng.random((9, 7)) > 0.5
        assert (K.fill(K.outlines(mask), mask.shape) == mask).all()
    assert K.svg(np.ones((2, 2), bool)).count("M") == 1


FONT = {"i": ["0110", "0000", "0110", "0110"], "l": ["1000", "1000", "1000", "1111"], "o": ["1111", "1001", "1001", "1111"], "t": ["1111", "0110", "0110", "0110"]}


def test_recognise_rendered_text(spark):
    glyph = {c: np.array([[int(b) for b in r] for r in rows]) for c, rows in FONT.items()}
    line = np.zeros((8, 26), int)
    for k, c in enumerate("lotol"):
        line[2:6, 1 + 5 * k : 5 + 5 * k] = glyph[c] * 255
    def crop(g):
        cols = np.flatnonzero(g.any(0))
        return K.resized(g[:, cols[0] : cols[-1] + 1] > 0)
    templates = {c: crop(g) for c, g in glyph.items()}
    read = V.recognise_text(packed(spark, line), templates).first()
    assert read.text == "lotol" and (read.y0, read.y1) == (2, 5)
    pairs = spark.createDataFrame([("lotol", read.text), ("abc", "abd")], "truth string, read string")
    assert I.character_error_rate(pairs).first().edits == 1


def test_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 256, (5, 7)), np.zeros((1, 1), int)]
    S.write_png(packed(spark, *arrays), str(tmp_path / "png"))
    (tmp_path / "png" / "broken.png").write_bytes(b"no image")
    read = S.read_images(spark, str(tmp_path / "png"), "*.png")
    assert read.where("error is not null").count() == 1
    got = {r.image_id.rpartition("/")[2]: np.array(r.v).reshape(r.h, r.w).tolist() for r in S.grey(read).collect()}
    assert got == {f"{k}.png": a.tolist() for k, a in enumerate(arrays)}
    assert S.read_files(spark, str(tmp_path / "png")).select("length").count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    src = tmp_path / "in"
    src.mkdir()
    for k in range(3):
        a = rng.integers(0, 256, (4, 4)).astype(np.uint8)
        (src / f"{k}.pgm").write_bytes(b"P5 4 4 255\n" + a.tobytes())
    (src / "bad.pgm").write_bytes(b"P5 4 4 255\n1")
    apply = lambda f: I.box3(decode_pgm(f).where("error is null").drop("error"))
    q = to_parquet(stream_files(spark, str(src), per_trigger=1), str(tmp_path / "out"), str(tmp_path / "ckpt"), apply)
    q.awaitTermination()
    batch = apply(S.read_files(spark, str(src)))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))
    assert decode_pgm(S.read_files(spark, str(src))).where("error is not null").count() == 1


def test_grey_maps(spark):
    files = {"plain": b"P5 2 1 255\n\x05\x07", "note": b"P5 # made by hand\n2 1\n# depth\n15\n\x00\x0f", "deep": b"P5 2 1 65535\n\x00\x00\xff\xff", "short": b"P5 2 2 255\n\x01", "none": None}
    d = decode_pgm(spark.createDataFrame(list(files.items()), "path string, content binary"))
    got = {r.image_id: r.v for r in d.collect()}
    assert got == {"plain": [5, 7], "note": [0, 255], "deep": [0, 255], "short": None, "none": None}
    assert V.detect_text(d, 100).select("image_id").distinct().count() == 2  # rows without a raster are left out


def test_stream_of_pictures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.png").write_bytes(S.png(np.full((2, 3, 3), 40 * k)))
    q = pictures_to_parquet(stream_files(spark, str(tmp_path / "in"), "*.png", 2), str(tmp_path / "out"), str(tmp_path / "ckpt"), I.otsu)
    q.awaitTermination()
    assert sorted(r.threshold for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 40, 80]


def test_missing_model_says_so(spark):
    with pytest.raises(Exception, match="no model weights"):
        models.run_model(packed(spark, A), "/nowhere/model.onnx").collect()


def small_model(operation: bytes) -> bytes:
    """An ONNX file with one operation from x to y, both float images of four dimensions, written field by field."""

    def field(n, data):
        if isinstance(data, int):
            return bytes([n << 3, data])
        return bytes([n << 3 | 2, len(data)]) + data

    def tensor(name):
        shape = b"".join(field(1, field(2, d)) for d in (b"n", b"c", b"h", b"w"))
        return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))

    graph = field(1, field(1, b"x") + field(2, b"y") + field(4, operation)) + field(2, b"g") + field(11, tensor(b"x")) + field(12, tensor(b"y"))
    return field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13))


def test_a_supplied_model_runs(spark, tmp_path):
    (tmp_path / "neg.onnx").write_bytes(small_model(b"Neg"))
    got = {r.image_id: r.output for r in models.run_model(packed(spark, A, [[255]]), str(tmp_path / "neg.onnx")).collect()}
    assert got[0] == pytest.approx([-x / 255 for r in A for x in r], abs=1e-6) and got[1] == [-1.0]


def test_fill_in_takes_images_in_stacks(spark):
    rng = np.random.default_rng(11)
    stack = rng.integers(0, 256, (5, 6, 7)).astype(float)
    stack[3], stack[4] = 250, np.minimum(stack[4], 100)  # all marked, and nothing
    want = [K.inpaint(a, a > 200) for a in stack]
    assert (K.inpaint(stack, stack > 200) == want).all() and len(set(want[3].ravel().tolist())) == 1
    other = rng.integers(0, 256, (2, 3))
    got = values(V.fill_in(packed(spark, *stack, other), 200))
    assert got == [a.tolist() for a in want] + [K.inpaint(other.astype(float), other > 200).tolist()]
    seen = []
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "h": [1, 2, 1], "w": [2, 1, 2], "v": [[1, 2], [3, 4], [5, 6]]})
    for rows, a in K.stacks(batch):
        seen.append((rows.tolist(), a.tolist()))
    assert seen == [([0, 2], [[[1, 2]], [[5, 6]]]), ([1], [[[3], [4]]])] and len(list(K.stacks(batch, 2))) == 3


def test_richardson_lucy_takes_images_in_stacks(spark):
    stack, psf = np.random.default_rng(12).integers(0, 256, (5, 6, 7)).astype(float), np.ones((1, 3))
    stack[2] = 0
    want = [K.richardson_lucy(a, psf) for a in stack]
    assert (K.richardson_lucy(stack, psf) == want).all()
    assert values(V.deblur(packed(spark, *stack), psf, "richardson_lucy")) == [a.tolist() for a in want]
    assert values(V.deblur(packed(spark, *stack), psf)) == [K.wiener(a, psf).tolist() for a in stack]
