import functools
import struct
import zlib

import numpy as np
import pytest

from quillfold.operators import kernels as K
from quillfold.operators import vision
from quillfold.plans.queries import QUERIES
from quillfold.sources import pictures


def page(vertical):
    img = np.full((100, 100, 3), 255, np.uint8)
    for at in (20, 50):
        if vertical:
            img[:, at : at + 2] = 0
        else:
            img[at : at + 2] = 0
    return img


@pytest.mark.parametrize(
    ("vertical", "corners", "angle"),
    [(False, [(0, 0), (10, 0)], 0), (True, [(0, 0), (0, 10)], 270), (False, [(10, 0), (0, 0)], 0), (True, [(0, 10), (0, 0)], 90)],
)
def test_reading_angle(vertical, corners, angle):
    assert vision.reading_angle(page(vertical), lambda _: [("x", 1.0, corners)]) == angle


def test_hsv_round_trip():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (20, 30, 3), dtype=np.uint8)
    assert np.abs(K.from_hsv(K.to_hsv(img)).astype(int) - img).max() <= 12
    assert K.to_hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8))[0, :, 0].tolist() == [120, 60, 0]


def test_red_mark_is_strict():
    img = np.full((10, 10, 3), 255, np.uint8)
    img[0, 0] = (0, 0, 255)
    assert K.red_coverage(img) == 0.01
    assert not K.has_red_mark(img)
    img[0, 1] = (0, 0, 255)
    assert K.has_red_mark(img)


def test_stamp_boxes():
    img = np.full((200, 300, 3), 255, np.uint8)
    img[50:70, 40:120] = (200, 60, 20)  # wide and blue
    img[100:180, 200:210] = (200, 60, 20)  # tall
    boxes = K.stamp_boxes(img)
    assert len(boxes) == 1
    x, y, w, h = boxes[0]
    assert x <= 40 and y <= 50 and x + w >= 120 and y + h >= 70


@pytest.mark.parametrize("method", [*K.METHODS, "combined", "unknown"])
def test_enhance_keeps_the_shape(method):
    img = np.random.default_rng(2).integers(0, 256, (33, 47, 3), dtype=np.uint8)
    out = K.enhance(img, method)
    assert out.shape == img.shape and out.dtype == np.uint8


def test_shrink_and_pad():
    assert max(K.shrink(np.zeros((50, 400, 3), np.uint8), 100).shape) == 100
    assert K.pad_sides(np.zeros((10, 20, 3), np.uint8), True).shape == (10, 420, 3)
    assert K.pad_sides(np.zeros((20, 10, 3), np.uint8), True).shape == (20, 470, 3)


def _make():
    def read(img):
        return [("JOB 250371-01", 0.95, [(0, 0), (10, 0)])] if img.size and (img == 7).all(-1).any() else []

    def rasterise(name, content):
        if b"bad" in content:
            raise ValueError("unreadable")
        if b"none" in content:
            return None
        img = np.full((200, 400, 3), 255, np.uint8)
        if b"job" in content:
            img[100:106, 100:180] = 7
        return img

    def normalize(text):
        return text.split()[-1] if "JOB" in text else None

    return vision.Extractor(rasterise, lambda page: [((100, 95, 180, 110), 0.9)], read, normalize)


def test_extract_never_fails_a_row(spark):
    rows = [("d/1.pdf", b"job"), ("d/2.pdf", b"bad"), ("d/3.pdf", b"none"), ("d/4.pdf", b"blank")]
    got = {r.filename: r for r in vision.extract(spark.createDataFrame(rows, "path string, content binary"), _make).collect()}
    assert got["1.pdf"].job_number == "250371-01" and got["1.pdf"].method.startswith("box_")
    assert got["2.pdf"].error.startswith("critical_error")
    assert got["3.pdf"].error == "image_load_failed"
    assert got["4.pdf"].error == "all_methods_failed" and got["4.pdf"].status.startswith("Failure")


def _factory(answer):
    def make():
        return vision.Extractor(lambda name, content: np.full((200, 400, 3), 255, np.uint8), lambda page: [((100, 95, 180, 110), 0.9)], lambda img: [(answer, 0.9, [])], lambda text: text)

    return make


def test_each_call_has_its_own_extractor(spark):
    """Two factories from one function, and a partial, in workers that are used again."""
    files = spark.createDataFrame([("a", b"")], "path string, content binary").coalesce(1)
    jobs = [vision.extract(files, make).first().job_number for make in (_factory("1"), _factory("2"), functools.partial(_of, "3"))]
    assert jobs == ["1", "2", "3"]


def _of(answer):
    return _factory(answer)()


def _filtered(img, kind):
    """PNG rows under one filter, by plain loops."""
    h, w, c = img.shape
    rows, raw = img[..., ::-1].reshape(h, -1).astype(int), b""
    for y in range(h):
        line = []
        for x in range(w * c):
            left, up = (rows[y, x - c] if x >= c else 0), (rows[y - 1, x] if y else 0)
            corner = rows[y - 1, x - c] if y and x >= c else 0
            p = left + up - corner
            near = min((left, up, corner), key=lambda v: abs(p - v))
            line.append((rows[y, x] - [0, left, up, (left + up) // 2, near][kind]) % 256)
        raw += bytes([kind, *line])
    return raw


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    img = np.random.default_rng(kind).integers(0, 256, (7, 9, 3), dtype=np.uint8)
    whole = pictures.encode_png(img)
    at = whole.index(b"IDAT")
    size = int.from_bytes(whole[at - 4 : at], "big")
    body = zlib.compress(_filtered(img, kind))
    other = whole[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + b"\0" * 4 + whole[at + 8 + size :]
    assert (pictures.decode(other) == img).all() and (pictures.decode(whole) == img).all()


def test_other_pictures():
    img = np.random.default_rng(9).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    ppm = b"P6\n# a note\n6 5\n255\n" + img[..., ::-1].tobytes()
    assert (pictures.decode(ppm) == img).all()
    assert (pictures.decode(b"P5 6 5 255\n" + img[..., 0].tobytes())[..., 2] == img[..., 0]).all()
    rows = np.zeros((5, 20), np.uint8)
    rows[:, :18] = img[::-1].reshape(5, 18)
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 154, 0, 54, 40, 6, 5, 1, 24, 0, 100, 0, 0, 0, 0) + rows.tobytes()
    assert (pictures.decode(bmp) == img).all()
    assert (pictures.decode(pictures.encode_png(img[..., 0])) == img[..., :1]).all()
    for broken in (b"", b"BM", b"%PDF-1.4", pictures.encode_png(img)[:60], ppm[:40]):
        with pytest.raises(ValueError):
            pictures.decode(broken)
        assert vision.decoded("x", broken) is None


def test_specks_go():
    mask = np.zeros((12, 30), bool)
    mask[2:4, 2:12] = True
    mask[6, 3] = mask[7, 4] = True  # a speck, joined by its corner
    out = K.without_specks(mask, 10)
    assert out.sum() == 20 and not out[6:].any()


def test_faint_ink():
    img = np.full((60, 200, 3), 235, np.uint8)
    img[20:30, 40:120] = (235, 200, 190)  # pale blue
    got = K.faint_ink(img)
    assert got.shape == (150, 500) and got[62, 200] == 0 and got[5, 5] == 255
    assert K.faint_ink(np.full((60, 200, 3), 235, np.uint8)) is None
    assert K.faint_ink(img[:4]) is None
    lab = K.to_lab(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], np.uint8))[0].astype(int)
    assert np.abs(lab - [[255, 128, 128], [0, 128, 128], [82, 207, 20]]).max() <= 1


def test_a_failing_method_is_left_out(monkeypatch):
    def broken(img):
        raise ValueError("no")

    monkeypatch.setitem(K.METHODS, "clahe", broken)
    names = [m for m, _ in K.enhance_all(np.full((20, 30, 3), 200, np.uint8), ("hsv", "clahe", "morphological"))]
    assert names == ["hsv", "morphological"]


def test_enhancement_rows(spark):
    img = np.random.default_rng(3).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, pictures.encode_png(img)), (2, b"no picture")], "id int, content binary")
    spark.udtf.register("enhance_methods", vision.EnhanceMethods)
    df.createOrReplaceTempView("pictures_to_enhance")
    got = spark.sql("SELECT id, e.* FROM pictures_to_enhance, LATERAL enhance_methods(content) e").collect()
    assert sorted((r.id, r.method) for r in got) == sorted((1, m) for m in (*K.METHODS, "combined"))
    assert all((r.height, r.width) == (20, 30) and pictures.decode(bytes(r.image)).shape == (20, 30, 3) for r in got)


def test_pixels_without_colour_are_as_computed():
    img = np.random.default_rng(5).integers(0, 256, (40, 50, 3)).astype(np.uint8)
    img[:, ::3] = img[:, ::3, :1]
    img[::7] = 0
    hsv = K.to_hsv(img)
    assert (hsv == K._hsv(img)).all() and (K.from_hsv(hsv) == K._bgr(hsv)).all()


def test_pictures_of_batches_are_dealt_over_the_cores(spark):
    for name in ("enhanced_pictures", "extracted_pages"):
        assert QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
