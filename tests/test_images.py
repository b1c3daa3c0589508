"""Image preparation on drawn pages."""

import numpy as np
from pyspark.sql import functions as F

from rubrica.functions import images


def page(angle=0.0):
    img = np.full((300, 400), 230, np.uint8)
    for y in range(40, 260, 30):
        img[y : y + 4, 50:350] = 20
    return images.rotated(img, -angle)


def test_levels_and_noise():
    rng = np.random.default_rng(0)
    noisy = page().copy()
    noisy[rng.random(noisy.shape) < 0.01] = 255
    flat = images.bilevel(images.smoothed(noisy))
    assert set(np.unique(flat)) == {0, 255} and flat[42, 200] == 0 and flat[20, 200] == 255
    assert (images.bilevel(np.full((4, 4), 7, np.uint8)) == 255).all() or (images.bilevel(np.full((4, 4), 7, np.uint8)) == 0).all()


def test_skew_is_found_and_removed():
    assert images.skew(images.bilevel(page())) == 0
    for angle in (4.0, -6.0):
        turned = images.bilevel(page(angle))
        found = images.skew(turned)
        assert abs(found - angle) <= 1
        assert abs(images.skew(images.rotated(turned, found))) <= 1


def test_closing_fills_gaps():
    img = np.zeros((6, 6), np.uint8)
    img[2, 1] = img[2, 3] = 255
    got = images.closed(img)  # both steps look up and left, so what stays stands one further down and right
    assert got[3, 2:5].tolist() == [255, 255, 255] and got.sum() == 3 * 255


def test_rows(spark):
    bgr = np.repeat(page()[..., None], 3, axis=2)
    kind = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>, n int"
    df = spark.createDataFrame([(("a", 300, 400, 3, 16, bytearray(bgr.tobytes())), 1), (("b", 3, 4, 3, 16, bytearray(b"x")), 2), (None, 3)], kind)
    got = {r.n: r.size for r in images.prepare(df).select("n", F.octet_length("prepared").alias("size")).collect()}
    assert got == {1: 300 * 400, 2: None, 3: None}
