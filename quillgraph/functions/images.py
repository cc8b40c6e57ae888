"""Deterministic image augmentation on pixel arrays; the codec (bytes to pixels and back) is injected."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Decode = Callable[[bytes], np.ndarray]
Encode = Callable[[np.ndarray, int], bytes]

# Choices by family, parameter ranges, chance of a blur.
CHOICES = {
    "G": ("swap", "crop", "rotate", "jitter", "crop+jitter", "rotate+jitter"),
    "M": ("crop", "rotate", "jitter", "crop+jitter", "rotate+jitter"),
}
PLAIN_CROP, PLAIN_QUALITY, LEAST_SIDE = 0.75, 92, 4  # family M: share of each side kept, stored quality, smallest side cropped
CROP, DEGREES, JITTER, SHARPEN, BLUR, QUALITY = (0.75, 0.95), 10.0, (0.85, 1.15), (0.90, 1.10), (0.4, 1.0), (85, 95)
BLUR_CHANCE = 0.3


def choose(seed: int, family: str = "G") -> tuple[str, random.Random]:
    """The augmentation of a seed and the generator that draws its parameters."""
    rng = random.Random(seed)
    return (rng.choice(CHOICES[family]) if family == "G" else CHOICES[family][rng.randrange(len(CHOICES[family]))]), rng


def resample(im: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear values at fractional positions, clamped to the edge."""
    h, w = im.shape[:2]
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[..., None], (c - c0)[..., None]
    return (im[r0, c0] * (1 - fc) + im[r0, c1] * fc) * (1 - fr) + (im[r1, c0] * (1 - fc) + im[r1, c1] * fc) * fr


def crop(im: np.ndarray, rng: random.Random) -> np.ndarray:
    """A random window, scaled back to the image's size."""
    h, w = im.shape[:2]
    share = rng.uniform(*CROP)
    nh, nw = max(2, int(h * share)), max(2, int(w * share))
    left, top = rng.randint(0, max(0, w - nw)), rng.randint(0, max(0, h - nh))
    rows, cols = np.meshgrid(top + np.linspace(0, nh - 1, h), left + np.linspace(0, nw - 1, w), indexing="ij")
    return resample(im, rows, cols)


def plain_crop(im: np.ndarray, rng: random.Random) -> np.ndarray:
    """A random window of a fixed share, not scaled back; small images are unchanged."""
    h, w = im.shape[:2]
    nh, nw = max(1, int(h * PLAIN_CROP)), max(1, int(w * PLAIN_CROP))
    if min(h, w) < LEAST_SIDE or nh >= h or nw >= w:
        return im
    left, top = rng.randint(0, w - nw), rng.randint(0, h - nh)
    return im[top : top + nh, left : left + nw]


def plain_rotate(im: np.ndarray, rng: random.Random) -> np.ndarray:
    """Turned by a few degrees; the frame grows to hold all of the image, on black."""
    h, w = im.shape[:2]
    a = np.deg2rad(rng.uniform(-DEGREES, DEGREES))
    nh, nw = (int(np.ceil(abs(x * np.cos(a)) + abs(y * np.sin(a)) - 1e-9)) for x, y in ((h, w), (w, h)))
    r, c = np.meshgrid(np.arange(nh) - (nh - 1) / 2, np.arange(nw) - (nw - 1) / 2, indexing="ij")
    rows, cols = r * np.cos(a) - c * np.sin(a) + (h - 1) / 2, r * np.sin(a) + c * np.cos(a) + (w - 1) / 2
    inside = (rows > -0.5) & (rows < h - 0.5) & (cols > -0.5) & (cols < w - 0.5)
    return resample(im, rows, cols) * inside[..., None]


def rotate(im: np.ndarray, rng: random.Random) -> np.ndarray:
    """Turned by a few degrees about the centre, size kept."""
    h, w = im.shape[:2]
    a = np.deg2rad(rng.uniform(-DEGREES, DEGREES))
    rows, cols = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return resample(im, rows * np.cos(a) - cols * np.sin(a) + (h - 1) / 2, rows * np.sin(a) + cols * np.cos(a) + (w - 1) / 2)


def jitter(im: np.ndarray, rng: random.Random, sharpen: bool = True) -> np.ndarray:
    """Brightness, contrast, colour and (by family) sharpness scaled about black, the mean, grey and the smoothed image."""
    bright, contrast, colour = (rng.uniform(*JITTER) for _ in range(3))
    out = im * bright
    out = out.mean() + (out - out.mean()) * contrast
    grey = out.mean(axis=2, keepdims=True)
    out = grey + (out - grey) * colour
    if sharpen:
        smooth = blur(out, 1.0)
        out = smooth + (out - smooth) * rng.uniform(*SHARPEN)
    return np.clip(out, 0, 255)


def blur(im: np.ndarray, radius: float) -> np.ndarray:
    n = max(1, int(np.ceil(3 * radius)))
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        padded = np.pad(im, [(n, n) if a == axis else (0, 0) for a in range(3)], mode="edge")
        im = sum(w * np.take(padded, range(i, i + im.shape[axis]), axis=axis) for i, w in enumerate(k))
    return im


def augment(im: np.ndarray, seed: int, family: str = "G", others: tuple[np.ndarray, ...] = ()) -> tuple[str, np.ndarray, int]:
    """(what was done, pixels, quality to store with); a swap without other images becomes a jitter."""
    done, rng = choose(seed, family)
    if done == "swap":
        if others:
            im = rng.choice(others)
        else:
            done = "jitter"
    out = im.astype(float)
    plain = family == "M"
    steps = {"crop": plain_crop if plain else crop, "rotate": plain_rotate if plain else rotate, "jitter": lambda x, r: jitter(x, r, sharpen=not plain), "swap": lambda x, _: x}
    for step in done.split("+"):
        out = steps[step](out, rng)
    if not plain and rng.random() < BLUR_CHANCE:
        out = blur(out, rng.uniform(*BLUR))
    return done, np.clip(np.round(out), 0, 255).astype(np.uint8), PLAIN_QUALITY if plain else rng.randint(*QUALITY)


def shrink(im: np.ndarray, longest: int = 256) -> np.ndarray:
    """Scaled down so that no side exceeds ``longest``; smaller images are unchanged."""
    h, w = im.shape[:2]
    scale = longest / max(h, w)
    if scale >= 1:
        return im
    nh, nw = max(1, round(h * scale)), max(1, round(w * scale))
    rows, cols = np.meshgrid(np.linspace(0, h - 1, nh), np.linspace(0, w - 1, nw), indexing="ij")
    return resample(im.astype(float), rows, cols).round().astype(np.uint8)


def flatten_alpha(im: np.ndarray, background: int = 255) -> np.ndarray:
    """Three channels: grey is repeated, transparency laid over the background."""
    if im.ndim == 2:
        return np.repeat(im[:, :, None], 3, axis=2)
    if im.shape[2] == 4:
        a = im[:, :, 3:] / 255
        return (im[:, :, :3] * a + background * (1 - a)).round().astype(np.uint8)
    return im


def to_rgb(im: np.ndarray, mode: str = "") -> np.ndarray:
    """Three channels of any decoded image; four channels are inks if ``mode`` is CMYK, else colour and transparency."""
    if mode == "CMYK":
        inks = im.astype(float) / 255
        return np.round(255 * (1 - inks[:, :, :3]) * (1 - inks[:, :, 3:])).astype(np.uint8)
    return flatten_alpha(im)


def placeholder(side: int = 224) -> np.ndarray:
    """The black image that stands for an unreadable one."""
    return np.zeros((side, side, 3), np.uint8)


def augment_images(df: DataFrame, codec: Callable[[], tuple[Decode, Encode]], family: str = "G") -> DataFrame:
    """``name``, ``choice`` and augmented ``content`` from ``name``, ``seed``, ``content``; unreadable images become the placeholder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode, encode = codec()

        def pixels(content: bytes) -> np.ndarray:
            try:
                return flatten_alpha(decode(content))
            except Exception:
                return placeholder()

        for frame in frames:
            rows = [augment(pixels(c), int(s), family) for s, c in zip(frame["seed"], frame["content"], strict=True)]
            yield pd.DataFrame({"name": frame["name"], "choice": [r[0] for r in rows], "content": [encode(r[1], r[2]) for r in rows]})

    return df.select("name", "seed", "content").mapInPandas(run, "name string, choice string, content binary")
