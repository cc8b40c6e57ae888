import numpy as np

from quillgraph.functions import images as I


def test_augmentation_is_deterministic(spark):
    def codec():
        return (lambda b: np.frombuffer(b, np.uint8).reshape(12, 10, 3)), (lambda im, quality: im.tobytes())

    im = np.random.default_rng(0).integers(0, 256, (12, 10, 3), dtype=np.uint8)
    for family in I.CHOICES:
        seen = set()
        for seed in range(40):
            a, b = I.augment(im, seed, family), I.augment(im, seed, family)
            assert a[0] == b[0] and (a[1] == b[1]).all()
            assert (a[1].shape == im.shape and 85 <= a[2] <= 95) if family == "G" else a[2] == 92
            seen.add(a[0])
        assert seen == set(I.CHOICES[family]) - {"swap"}
    df = spark.createDataFrame([("a", 5, im.tobytes()), ("b", 6, b"bad")], "name string, seed long, content binary")
    rows = {r.name: r for r in I.augment_images(df, codec).collect()}
    assert bytes(rows["a"].content) == I.augment(im, 5)[1].tobytes() and len(rows["b"].content) == 224 * 224 * 3


def test_the_plain_recipe_crops_and_turns_without_scaling():
    import random

    im = np.random.default_rng(1).integers(1, 256, (40, 30, 3)).astype(float)
    cut = I.plain_crop(im, random.Random(3))
    assert cut.shape == (30, 22, 3) and any((im[r : r + 30, c : c + 22] == cut).all() for r in range(11) for c in range(9))
    assert I.plain_crop(im[:3], random.Random(3)).shape == (3, 30, 3)
    turned = I.plain_rotate(im, random.Random(3))
    assert turned.shape[0] >= 40 and turned.shape[1] >= 30 and (turned[0, 0] == 0).all()
    inks = np.zeros((1, 1, 4), np.uint8)
    inks[..., 0], inks[..., 3] = 255, 51
    assert I.to_rgb(inks, "CMYK")[0, 0].tolist() == [0, 204, 204] and I.to_rgb(np.zeros((2, 2), np.uint8)).shape == (2, 2, 3)


def test_pixels():
    assert I.shrink(np.zeros((512, 100, 3), np.uint8)).shape == (256, 50, 3)
    assert I.flatten_alpha(np.zeros((2, 2, 4), np.uint8)).max() == 255 and I.flatten_alpha(np.ones((2, 2), np.uint8)).shape == (2, 2, 3)
