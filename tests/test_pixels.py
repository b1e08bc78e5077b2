"""Pixel operators against plain loops on random images."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.functions.recipe import recipe
from linewatch.operators import pixels as px


def table(spark, images):
    data = [(1, f, x, y, int(im[y, x])) for f, im in enumerate(images) for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(data, "line_id long, frame_id long, x int, y int, v int").repartition("line_id", "frame_id")


def images_of(df, like):
    out = [np.zeros_like(im) for im in like]
    for r in df.collect():
        out[r["frame_id"]][r["y"], r["x"]] = r["v"]
    return out


@pytest.fixture(scope="module")
def scenes():
    rnd = np.random.default_rng(4)
    return [rnd.integers(0, 256, (h, w)) for h, w in ((9, 40), (33, 21), (5, 70))]


def brute(im, offsets, pick):
    h, w = im.shape
    out = np.zeros_like(im)
    for y in range(h):
        for x in range(w):
            out[y, x] = pick([im[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < h and 0 <= x + dx < w])
    return out


@pytest.mark.parametrize("k", [3, 15, 17, 29])
def test_rect_extremes(spark, scenes, k):
    r = k // 2
    near = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    got = images_of(px.dilate(table(spark, scenes), k, "rect"), scenes)
    assert all((g == brute(im, near, max)).all() for g, im in zip(got, scenes))
    got = images_of(px.erode(table(spark, scenes), k, "rect"), scenes)
    assert all((g == brute(im, near, min)).all() for g, im in zip(got, scenes))


def test_ellipse(spark, scenes):
    widths = px.ellipse_widths(5)
    assert widths == [0, 2, 2, 2, 0]
    near = [(dy - 2, dx) for dy, w in enumerate(widths) for dx in range(-w, w + 1)]
    got = images_of(px.dilate(table(spark, scenes), 5), scenes)
    assert all((g == brute(im, near, max)).all() for g, im in zip(got, scenes))


@pytest.mark.parametrize("block", [3, 7, 31])
def test_local_mean_repeats_the_border(spark, scenes, block):
    r = block // 2
    got = images_of(px.local_mean(table(spark, scenes), block).withColumn("v", F.col("mean")), scenes)
    for g, im in zip(got, scenes):
        p = np.pad(im, r, mode="edge")
        want = [[round(p[y:y + block, x:x + block].mean()) for x in range(im.shape[1])] for y in range(im.shape[0])]
        assert (g == np.array(want)).all()


def test_blur_mirrors_the_border(spark, scenes):
    k = np.array([1, 4, 6, 4, 1])
    got = images_of(px.blur5(table(spark, scenes)), scenes)
    for g, im in zip(got, scenes):
        p = np.pad(im, 2, mode="reflect")
        full = sum(k[i] * k[j] * p[i:i + im.shape[0], j:j + im.shape[1]] for i in range(5) for j in range(5))
        assert (g == (full + 128) // 256).all()


def components(on, diagonal):
    h, w = on.shape
    label = -np.ones((h, w), dtype=int)
    for y in range(h):
        for x in range(w):
            if on[y, x] and label[y, x] < 0:
                todo = [(y, x)]
                label[y, x] = y * w + x
                while todo:
                    cy, cx = todo.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            ny, nx = cy + dy, cx + dx
                            if (diagonal or dy == 0 or dx == 0) and 0 <= ny < h and 0 <= nx < w and on[ny, nx] and label[ny, nx] < 0:
                                label[ny, nx] = y * w + x
                                todo.append((ny, nx))
    return label


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(spark, diagonal):
    rnd = np.random.default_rng(8)
    ims = [(rnd.random((17, 23)) < d).astype(int) * 255 for d in (0.3, 0.5, 0.62)]
    spiral = np.zeros((9, 9), dtype=int)
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = spiral[2:, 0] = spiral[2, :7] = spiral[2:7, 6] = 255
    for im in (*ims, spiral):
        got = px.with_label(px.label_blobs(table(spark, [im]), diagonal), im.shape[1])
        want = components(im > 0, diagonal)
        assert {(r["y"], r["x"]): r["label"] for r in got.collect()} == {
            (y, x): want[y, x] for y in range(im.shape[0]) for x in range(im.shape[1]) if im[y, x]}


def test_fill_holes(spark):
    rnd = np.random.default_rng(2)
    ims = [(rnd.random((15, 15)) < d).astype(int) * 255 for d in (0.55, 0.7)]
    got = images_of(px.fill_holes(table(spark, ims), 1), ims)
    for g, im in zip(got, ims):
        label = components(im == 0, False)
        open_ = set(label[0]) | set(label[-1]) | set(label[:, 0]) | set(label[:, -1])
        want = [[255 if im[y, x] or label[y, x] not in open_ else 0 for x in range(15)] for y in range(15)]
        assert (g == np.array(want)).all()


def test_flat_frame_has_no_threshold(spark):
    flat = np.full((4, 4), 90)
    got = px.frame_stats(table(spark, [flat])).first()
    assert (got["threshold"], got["contrast"]) == (0, 0.0)


def test_background_of_another_shape_gives_nothing(spark):
    rnd = random.Random(1)
    small = np.array([[rnd.randint(0, 255) for _ in range(4)] for _ in range(4)])
    df = table(spark, [small, small[:, :3]])
    ref = px.capture_background(df.where("frame_id = 0")).withColumn("ref", F.lit(0))
    assert {r["frame_id"] for r in px.bg_difference(df, ref).collect()} == {0}


def test_strip_outside_the_image_is_free(spark):
    df = table(spark, [np.full((3, 3), 255)])
    assert px.strip_occupancy(df, 50, 1).first()[2:] == (0.0, False)
    assert px.strip_occupancy(df, 0, 1).first()[2:] == (1.0, True)


def shrunk(plane: np.ndarray, to_width: int) -> np.ndarray:
    """Area means out of whole shares, pixel by pixel."""
    h, w = plane.shape
    if w <= to_width:
        return plane
    nh = max(1, int(h * (to_width / w)))
    fine = np.kron(plane, np.ones((nh, to_width), int))  # nh x to_width parts a pixel
    sums = fine.reshape(nh, h, to_width, w).sum(axis=(1, 3))
    low, rest = np.divmod(sums, h * w)
    even = (2 * rest == h * w) & ((low % 2 == 1) | ((w, h) == (2 * to_width, 2 * nh)))
    return low + ((2 * rest > h * w) | even)


@pytest.mark.parametrize("to_width", [1, 3, 5, 6, 7, 12, 40])
def test_downscale(spark, to_width):
    rng = np.random.default_rng(to_width)
    planes = {0: rng.integers(0, 256, (9, 12)), 1: rng.integers(0, 256, (4, 10)), 2: rng.integers(0, 2, (6, 6)), 3: rng.integers(0, 256, (2, 24)), 4: rng.integers(0, 256, (1, 1))}
    rows = [(1, f, x, y, int(plane[y, x])) for f, plane in planes.items() for y in range(plane.shape[0]) for x in range(plane.shape[1])]
    out = px.downscale(spark.createDataFrame(rows, "line_id long, frame_id long, x int, y int, v int"), to_width).collect()
    got = {(r["frame_id"], r["y"], r["x"]): r["v"] for r in out}
    want = {(f, y, x): int(v) for f, plane in planes.items() for (y, x), v in np.ndenumerate(shrunk(plane, to_width))}
    assert got == want and len(out) == len(want)


def test_downscale_halves_go_up_for_two_by_two(spark):
    rows = [(1, 0, x, y, v) for (x, y), v in {(0, 0): 0, (1, 0): 1, (0, 1): 1, (1, 1): 0}.items()]
    assert px.downscale(spark.createDataFrame(rows, "line_id long, frame_id long, x int, y int, v int"), 1).first()["v"] == 1
    empty = spark.createDataFrame([], "line_id long, frame_id long, x int, y int, v int")
    assert px.downscale(empty, 3).count() == 0
    with pytest.raises(ValueError):
        px.downscale(empty, 0)


def test_measures_come_back_in_full_size(spark):
    """A bright 16 x 8 box in a frame of 40 x 24 keeps its place; frames that are narrow enough are not touched."""
    rows = [(1, 0, x, y, 220 if 12 <= x < 28 and 8 <= y < 16 else 20) for x in range(40) for y in range(24)]
    pixels = spark.createDataFrame(rows, "line_id long, frame_id long, x int, y int, v int")
    p = recipe(expected_width_px=16, expected_height_px=8, expected_area_px=128)
    plain = px.extract(pixels, p, open_k=3, dilate_k=0)
    same = px.extract(pixels, p, open_k=3, dilate_k=0, max_width=40)
    assert plain.collect() == same.select(plain.columns).collect()
    got = px.extract(pixels, p, open_k=3, dilate_k=0, max_width=20).first()
    full = plain.first()
    assert abs(got["cx"] - full["cx"]) <= 2 and abs(got["cy"] - full["cy"]) <= 2
    assert abs(got["width_px"] - 16) <= 2 and abs(got["height_px"] - 8) <= 2 and 0.7 <= got["area_px"] / full["area_px"] <= 1.4
    assert px.extract(pixels, p, open_k=3, dilate_k=0, max_width=20, max_area=60).count() == 0
