"""Labels in tiles against labels of the whole image."""

import random

import numpy as np
import pytest

from calspark.operators import labels


def whole(image, share):
    return labels.numbered_parts(image > np.quantile(image, share))


def rows(spark, images):
    return spark.createDataFrame([(p, int(y), int(x), float(v)) for p, image in images.items() for (y, x), v in np.ndenumerate(image)], "plane int, y int, x int, v double").repartition(5)


@pytest.mark.parametrize("tile", [1, 7, 16, 100])
def test_tiles_of_any_size_give_the_labels_of_the_whole(spark, tile):
    r = np.random.default_rng(tile)
    images = {0: r.random((33, 41)), 1: np.kron(r.random((9, 8)), np.ones((4, 5))) + 0.01 * r.random((36, 40))}
    if tile == 1:
        images = {0: r.random((9, 11))}
    got = {p: np.zeros(image.shape, int) for p, image in images.items()}
    for x in labels.labelled(rows(spark, images), 0.55, tile).collect():
        got[x.plane][x.y, x.x] = x.label
    for p, image in images.items():
        assert (got[p] == whole(image, 0.55)).all()


def test_a_snake_through_all_tiles_is_one_part(spark):
    image = np.zeros((24, 24))
    for y in range(0, 24, 2):
        image[y] = 1
        image[min(y + 1, 23), 23 if y % 4 == 0 else 0] = 1
    image[23] = 0
    got = labels.labelled(rows(spark, {3: image + 0.0}), 0.4, 4).collect()
    assert {x.label for x in got} == {1} and len(got) == int(image.sum())


def test_stars_against_union_find(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (7, 8), (8, 7)]
    up = {}

    def top(n):
        up.setdefault(n, n)
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    want = {n: top(n) for n in list(up) if top(n) != n}
    assert {x.a: x.b for x in labels.stars(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()} == want


def test_nothing_above_the_level(spark):
    assert labels.labelled(rows(spark, {0: np.ones((5, 5))}), 0.5, 2).count() == 0
