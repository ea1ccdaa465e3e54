"""Pixels in numpy: conversion, cutting out, resampling."""

from __future__ import annotations

import numpy as np


def float01(px: np.ndarray) -> np.ndarray:
    if np.issubdtype(px.dtype, np.floating):
        return px.astype(np.float32)
    return px.astype(np.float32) / np.float32(np.iinfo(px.dtype).max)


def from_float01(px: np.ndarray, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    if np.issubdtype(dtype, np.floating):
        return px.astype(dtype)
    top = np.iinfo(dtype).max
    return np.clip(np.rint(px * np.float32(top)), 0, top).astype(dtype)


def luma(rgb: np.ndarray) -> np.ndarray:
    """Gray of RGB by the weights 299, 587 and 114 in whole numbers, rounded."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def uint8_rgb(px: np.ndarray) -> np.ndarray:
    """Three channels of uint8; other types are stretched between the image's limits and cut to whole numbers."""
    if px.dtype != np.uint8:
        lo, hi = float(px.min()), float(px.max())
        px = ((px - lo) / (hi - lo) * 255).astype(np.uint8) if hi > lo else np.zeros(px.shape, np.uint8)
    px = px[..., None] if px.ndim == 2 else px
    return np.ascontiguousarray(np.repeat(px, 3, axis=2) if px.shape[2] == 1 else px)


def cut(px: np.ndarray, x0: int, y0: int, x1: int, y1: int, mode: str = "reflect") -> np.ndarray:
    """A window of an image, padded where it leaves it; edges are repeated where there is too little to reflect.

    A window wholly outside has nothing to pad from and is an error.
    """
    h, w = px.shape[:2]
    inner = px[max(y0, 0) : max(min(y1, h), 0), max(x0, 0) : max(min(x1, w), 0)]
    if not inner.size:
        raise ValueError(f"the window ({x0}, {y0}, {x1}, {y1}) is outside a frame of {w} x {h}")
    ends = [(max(0, -y0), max(0, y1 - h)), (max(0, -x0), max(0, x1 - w))] + [(0, 0)] * (px.ndim - 2)
    if not any(map(any, ends)):
        return inner
    if mode in ("reflect", "symmetric") and min(inner.shape[:2]) < 2:
        mode = "edge"
    return np.pad(inner, ends, mode=mode)


def _area_weights(n: int, out: int) -> np.ndarray:
    """(out, n): the share of each source pixel in each output pixel."""
    edges = np.arange(out + 1) * (n / out)
    lo = np.maximum(edges[:-1, None], np.arange(n)[None, :])
    hi = np.minimum(edges[1:, None], np.arange(1, n + 1)[None, :])
    return np.maximum(hi - lo, 0) / (n / out)


def shrink(px: np.ndarray, size: int) -> np.ndarray:
    """Area averaging to a square of `size`; whole-number types are rounded."""
    a, b = _area_weights(px.shape[0], size), _area_weights(px.shape[1], size)
    out = np.einsum("yh,hw...->yw...", a, px.astype(np.float64))
    out = np.einsum("xw,yw...->yx...", b, out)
    return out.astype(px.dtype) if np.issubdtype(px.dtype, np.floating) else np.clip(np.rint(out), 0, np.iinfo(px.dtype).max).astype(px.dtype)


def _reflect101(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * n - 2)
    return np.where(i >= n, 2 * n - 2 - i, i)


def warp(px: np.ndarray, forward: np.ndarray, shape: tuple[int, int], border: str = "reflect") -> np.ndarray:
    """Bilinear resampling by a 3x3 forward map (source to destination pixel); border reflects without the edge, or is 0."""
    h, w = px.shape[:2]
    back = np.linalg.inv(forward)
    ys, xs = np.mgrid[0 : shape[0], 0 : shape[1]].astype(np.float64)
    sx = back[0, 0] * xs + back[0, 1] * ys + back[0, 2]
    sy = back[1, 0] * xs + back[1, 1] * ys + back[1, 2]
    # a map that is the identity but for rounding leaves every pixel as it is
    sx, sy = (np.where(np.abs(v - np.rint(v)) < 1e-9, np.rint(v), v) for v in (sx, sy))
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    fx, fy = (sx - x0).astype(np.float32), (sy - y0).astype(np.float32)
    if px.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]

    def at(y, x):
        if border == "reflect":
            return px[_reflect101(y, h), _reflect101(x, w)]
        inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        v = px[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]
        return v * (inside[..., None] if px.ndim == 3 else inside)

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return (top * (1 - fy) + low * fy).astype(np.float32)


def like_channels(px: np.ndarray, other: np.ndarray) -> np.ndarray:
    """px with as many channels as another image: gray by their mean, or one repeated."""
    planes = np.atleast_3d(px)
    wanted = np.atleast_3d(other).shape[2]
    if other.ndim == 2 and planes.shape[2] > 1:
        planes = planes.mean(axis=2, keepdims=True, dtype=px.dtype)
    if planes.shape[2] not in (1, wanted):
        raise ValueError(f"{planes.shape[2]} channels can't stand for {wanted}")
    planes = np.repeat(planes, wanted // planes.shape[2], axis=2)
    return planes[..., 0] if other.ndim == 2 else planes


def synthetic_frame(height: int = 240, width: int = 320, seed: int = 0) -> np.ndarray:
    """A horizon with one bright vessel: sky from .35 down to .15, sea of .45 below 60 %, a blob of .9, noise of .01; cut to uint8. Fixed values."""
    px = np.repeat(np.linspace(0.35, 0.15, height)[:, None], width, axis=1)
    px[int(height * 0.6) :] = 0.45
    cy, cx = int(height * 0.55), width // 2
    px[cy - 8 : cy + 8, cx - 22 : cx + 22] = 0.9
    px = px + np.random.default_rng(seed).normal(0, 0.01, px.shape)
    return (np.clip(px, 0, 1) * 255).astype(np.uint8)
