"""Raster operators over numpy arrays; a page image is one row of a frame."""

from __future__ import annotations

import math

import numpy as np


def to_gray(pixels: np.ndarray) -> np.ndarray:
    """RGB or RGBA (rows, columns, channels) to 8-bit luminance, clear pixels as white."""
    light = pixels[..., :3] @ np.array([0.299, 0.587, 0.114])
    if pixels.shape[-1] == 4:
        solid = pixels[..., 3] / 255.0
        light = light * solid + 255 * (1 - solid)
    return light.astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The grey value that best divides the histogram; 128 where nothing divides it."""
    n = np.bincount(gray.ravel(), minlength=256).astype(float)
    below, levels = np.cumsum(n), np.arange(256)
    above = n.sum() - below
    part = np.cumsum(n * levels)
    ok = (below > 0) & (above > 0)
    spread = np.zeros(256)
    spread[ok] = below[ok] * above[ok] * (part[ok] / below[ok] - (part[-1] - part[ok]) / above[ok]) ** 2
    return int(spread.argmax()) if spread.max() > 0 else 128


def mostly_dark(gray: np.ndarray) -> bool:
    return bool(gray.mean() < 110)


def ink(gray: np.ndarray) -> np.ndarray:
    """1 where there is ink, also for light text on dark ground."""
    at = otsu(gray)
    return ((gray > at) if mostly_dark(gray) else (gray <= at)).astype(np.uint8)


def stretch(gray: np.ndarray) -> np.ndarray:
    """Contrast from the 1st to the 99th percentile."""
    low, high = np.percentile(gray, [1, 99])
    return np.clip((gray.astype(float) - low) * 255 / max(1.0, high - low), 0, 255).astype(np.uint8)


def adaptive(gray: np.ndarray, radius: int, share: float = 0.12) -> np.ndarray:
    """0 where a pixel is darker than its surroundings' mean by `share`, else 255; window sums from an integral image."""
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = gray.astype(float).cumsum(0).cumsum(1)
    y0, y1 = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    sums = total[np.ix_(y1, x1)] - total[np.ix_(y0, x1)] - total[np.ix_(y1, x0)] + total[np.ix_(y0, x0)]
    mean = sums / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return np.where(gray < mean * (1 - share), 0, 255).astype(np.uint8)


def connected_components(bits: np.ndarray) -> list[dict]:
    """x, y, w, h and area of each group of ink pixels that touch, corners too, by their first pixel.

    Runs of pixels are joined to the runs of the row above that they touch.
    """
    edge = np.diff(np.pad(bits > 0, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    parent = np.arange(len(rows))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    first = np.searchsorted(rows, np.arange(bits.shape[0] + 1))
    for y in range(1, bits.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= ends[j] and starts[j] <= ends[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    top = np.array([root(k) for k in range(len(rows))], int)
    kept, at = np.unique(top, return_inverse=True)
    n = len(kept)
    x, y = np.full(n, bits.shape[1]), np.full(n, bits.shape[0])
    x1, y1, area = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
    for ufunc, out, values in ((np.minimum, x, starts), (np.minimum, y, rows), (np.maximum, x1, ends), (np.maximum, y1, rows + 1), (np.add, area, ends - starts)):
        ufunc.at(out, at, values)
    return [{"x": int(a), "y": int(b), "w": int(c - a), "h": int(d - b), "area": int(e)} for a, b, c, d, e in zip(x, y, x1, y1, area)]


def clamped(x: float, y: float, w: float, h: float, width: float, height: float) -> dict:
    """A rectangle of whole pixels within a page, at least one wide and high."""
    x0, y0 = max(0, math.floor(x)), max(0, math.floor(y))
    return {"x": float(x0), "y": float(y0), "w": float(max(1, min(width, math.ceil(x + w)) - x0)), "h": float(max(1, min(height, math.ceil(y + h)) - y0))}


def crop(gray: np.ndarray, x: float, y: float, w: float, h: float, margin: int = 0) -> np.ndarray:
    """The part of a page in a rectangle, on white ground with a white margin."""
    r = clamped(x, y, w, h, gray.shape[1], gray.shape[0])
    x0, y0, wide, high = (int(r[k]) for k in ("x", "y", "w", "h"))
    out = np.full((high + 2 * margin, wide + 2 * margin), 255, np.uint8)
    part = gray[y0 : y0 + high, x0 : x0 + wide]
    out[margin : margin + part.shape[0], margin : margin + part.shape[1]] = part
    return out


def scaled(gray: np.ndarray, longest: int) -> np.ndarray:
    """Shrunk so that its longer side is `longest` at most; each pixel is the mean of those it stands for."""
    high, wide = gray.shape
    share = min(1.0, longest / max(high, wide))
    if share == 1.0:
        return gray
    ys, xs = (np.linspace(0, n, max(1, round(n * share)) + 1).round().astype(int) for n in (high, wide))
    total = np.add.reduceat(np.add.reduceat(gray.astype(np.float64), ys[:-1], axis=0), xs[:-1], axis=1)
    return (total / np.outer(np.diff(ys), np.diff(xs)) + 0.5).astype(np.uint8)


def turned(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned clockwise, on a page as large as needed, white where nothing is; quarter turns are exact."""
    if degrees % 90 == 0:
        return np.rot90(gray, -int(degrees // 90) % 4)
    a = np.deg2rad(degrees)
    c, s = abs(np.cos(a)), abs(np.sin(a))
    high, wide = gray.shape
    rows, columns = math.floor(wide * s + high * c), math.floor(wide * c + high * s)
    y, x = np.mgrid[0:rows, 0:columns]
    dx, dy = x + 0.5 - columns / 2, y + 0.5 - rows / 2
    fx = np.floor(dx * np.cos(a) + dy * np.sin(a) + wide / 2).astype(int)
    fy = np.floor(-dx * np.sin(a) + dy * np.cos(a) + high / 2).astype(int)
    inside = (fx >= 0) & (fx < wide) & (fy >= 0) & (fy < high)
    return np.where(inside, gray[fy.clip(0, high - 1), fx.clip(0, wide - 1)], 255).astype(np.uint8)


def text_band(gray: np.ndarray, rect: dict, level: float) -> tuple[float, float] | None:
    """Top and height of the band of text at `level` in a rectangle: rows of ink around the nearest inked one."""
    r = clamped(rect["x"], rect["y"], rect["w"], rect["h"], gray.shape[1], gray.shape[0])
    part = gray[int(r["y"]) : int(r["y"] + r["h"]), int(r["x"]) : int(r["x"] + r["w"])]
    share = min(1.0, 600 / part.shape[1])
    if share < 1:
        xs, ys = (((np.arange(max(1, round(n * share))) + 0.5) * n / max(1, round(n * share))).astype(int) for n in (part.shape[1], part.shape[0]))
        part = part[np.ix_(ys, xs)]
    at = otsu(part)
    profile = ((part > at) if mostly_dark(part) else (part < at)).mean(axis=1)
    inked = profile > max(0.015, profile.max() * 0.08)
    n = len(profile)
    centre = min(max(round((level - r["y"]) * share), 0), n - 1)
    near = [y for d in range(math.ceil(n * 0.25)) for y in (centre - d, centre + d) if 0 <= y < n and inked[y]]
    if not near:
        return None
    blank = np.flatnonzero(~inked)
    top = int(blank[blank < near[0]].max(initial=-1)) + 1
    bottom = int(blank[blank > near[0]].min(initial=n))
    high = (bottom - top) / share
    return (r["y"] + top / share, high) if high >= 4 else None


def text_like(bits: np.ndarray) -> np.ndarray:
    """Ink of components that may be characters; rules, edges of paper and filled areas go."""
    high, wide = bits.shape
    found = connected_components(bits)
    usual = sorted(c["h"] for c in found if 3 <= c["h"] < high / 8)
    tall = (usual[len(usual) // 2] if usual else 0) or 10
    out = np.zeros_like(bits)
    for c in found:
        if not max(3, tall * 0.4) <= c["h"] <= tall * 3 or c["w"] > min(c["h"] * 4, wide / 6):
            continue
        if c["area"] > c["w"] * c["h"] * 0.9 and c["w"] * c["h"] > 2 * tall * tall:
            continue
        box = np.s_[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]]
        out[box] |= bits[box]
    return out


def glyph_lines(components: list[dict], least: int = 10, most: int = 24, low: float = 6, high: float = 200) -> list[dict]:
    """Rows of characters among components: x, y, w, h, count, char_height, score and segments, best first.

    A row goes on to the next component to the right that is near, level and of about its mean height.
    """
    left = sorted((c for c in components if low <= c["h"] <= high and 1 <= c["w"] <= c["h"] * 1.6 and c["area"] >= 4), key=lambda c: c["x"])
    out = []
    while left:
        chain = [left[0]]
        for c in left[1:]:
            last, mean = chain[-1], sum(g["h"] for g in chain) / len(chain)
            gap = c["x"] - last["x"] - last["w"]
            if gap > mean * 6 or len(chain) > most * 2:
                break
            level = min(abs(c["y"] + c["h"] - last["y"] - last["h"]), abs(c["y"] + c["h"] / 2 - last["y"] - last["h"] / 2)) <= mean * 0.35
            if -mean * 0.3 <= gap <= mean * 3 and 0.6 <= c["h"] / mean <= 1.5 and level:
                chain.append(c)
        if len(chain) < least:
            left.pop(0)
            continue
        taken = {id(c) for c in chain}
        left = [c for c in left if id(c) not in taken]
        out.append(_line(chain, most))
    return sorted(out, key=lambda g: -g["score"])


def _line(chain: list[dict], most: int) -> dict:
    heights = np.sort([c["h"] for c in chain])
    middle = float(heights[len(chain) // 2])
    x, y = min(c["x"] for c in chain), min(c["y"] for c in chain)
    cuts = [0, *(i for i in range(1, len(chain)) if chain[i]["x"] - chain[i - 1]["x"] - chain[i - 1]["w"] > middle * 0.8), len(chain)]
    segments = [{"x": chain[a]["x"], "w": chain[b - 1]["x"] + chain[b - 1]["w"] - chain[a]["x"], "count": b - a} for a, b in zip(cuts, cuts[1:])]
    fit = 1.0 if 13 <= len(chain) <= 20 else 0.2 if len(chain) > most else 0.6
    uneven = float(np.abs(heights - middle).mean() / middle)
    size = {"w": max(c["x"] + c["w"] for c in chain) - x, "h": max(c["y"] + c["h"] for c in chain) - y}
    return {"x": x, "y": y, **size, "count": len(chain), "char_height": middle, "score": min(1.0, max(0.0, fit * (1 - 1.5 * uneven))), "segments": segments}


def ctc(steps: np.ndarray, letters: list[str], x: float, w: float, valid: int | None = None) -> tuple[str, float, list[tuple]]:
    """Text, confidence (0 to 100) and symbols (text, confidence, x, w) of a line's letter probabilities (steps, letters).

    The likeliest letter of each step counts, repeats once, the first letter (blank) not; only the first `valid` steps.
    """
    n = max(1, min(len(steps), valid or len(steps)))
    best, sure = steps[:n].argmax(axis=1), steps[:n].max(axis=1)
    new = np.flatnonzero((best != 0) & (best != np.concatenate(([0], best[:-1]))))
    symbols = [(letters[best[t]] if best[t] < len(letters) else "", float(sure[t]) * 100, x + t * w / n, w / n) for t in new]
    return "".join(s[0] for s in symbols), float(sure[new].mean() * 100) if len(new) else 0.0, symbols


def detected_boxes(chances: np.ndarray, width: float, height: float, ink_at: float = 0.3, sure: float = 0.6) -> list[dict]:
    """Boxes of text in a map of chances: components of a mean chance of `sure` or more, grown and brought to the page's size, with the angle and elongation of their pixels."""
    sx, sy = width / chances.shape[1], height / chances.shape[0]
    out = []
    for c in connected_components(chances > ink_at):
        box = chances[c["y"] : c["y"] + c["h"], c["x"] : c["x"] + c["w"]]
        ys, xs = np.nonzero(box > ink_at)
        if box[ys, xs].mean() < sure:
            continue
        (a, k), (_, b) = np.cov(np.stack((xs, ys)), bias=True)
        spread = math.hypot((a - b) / 2, k)
        grow = c["w"] * c["h"] * 1.5 / (2 * (c["w"] + c["h"]))
        x0, y0 = max(0.0, (c["x"] - grow) * sx), max(0.0, (c["y"] - grow) * sy)
        x1, y1 = min(width, (c["x"] + c["w"] + grow) * sx), min(height, (c["y"] + c["h"] + grow) * sy)
        out.append({"x": x0, "y": y0, "w": x1 - x0, "h": y1 - y0, "angle": math.degrees(math.atan2(2 * k, a - b) / 2), "elongation": math.sqrt(((a + b) / 2 + spread) / max(1e-6, (a + b) / 2 - spread))})
    return out


def profile_score(xs: np.ndarray, ys: np.ndarray, degrees: float, height: int) -> float:
    """How sharply rows stand out from one another when the points are turned by an angle."""
    a, bins = np.deg2rad(degrees), int(np.ceil(height * 1.5)) + 4
    at = (ys * np.cos(a) - xs * np.sin(a) + bins / 2).astype(int)
    n = np.bincount(at[(at >= 0) & (at < bins)], minlength=bins)
    return float((np.diff(n) ** 2).sum())


def straightening(gray: np.ndarray, reach: int = 20, least: float = 0.4, sure: float = 0.15) -> float:
    """By how many degrees a page is turned (0 where that is little or unsure); 2, 0.3 and 0.05 for what a first turn leaves."""
    small = scaled(gray, 1000 if reach > 2 else 1200)
    angle, confidence = skew((small <= otsu(small)).astype(np.uint8), reach)
    return angle if abs(angle) >= least and confidence >= sure else 0.0


def skew(bits: np.ndarray, reach: int = 20, most: int = 40_000) -> tuple[float, float]:
    """Angle of the text rows in degrees (clockwise positive) and a confidence from 0 to 1; only character-like ink counts."""
    ys, xs = np.nonzero(text_like(bits))
    step = max(1, -(-len(xs) // most))
    xs, ys = xs[::step] - bits.shape[1] / 2, ys[::step] - bits.shape[0] / 2
    if len(xs) < 200:
        return 0.0, 0.0
    score = lambda a: profile_score(xs, ys, a, bits.shape[0])
    coarse = {a: score(a) for a in range(-reach, reach + 1)}
    start = max(coarse, key=coarse.__getitem__)
    fine = max((start, *(start + 0.2 * k for k in range(-5, 6))), key=score)
    usual = sorted(coarse.values())[len(coarse) // 2] or 1.0
    return round(fine, 1), min(1.0, (score(fine) / usual - 1) / 2)
