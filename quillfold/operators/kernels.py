"""Image kernels in numpy. Images are height x width x 3 uint8 in B, G, R order; hue runs from 0 to 180."""

from __future__ import annotations

import numpy as np

# Hue, saturation and value bounds (inclusive) of inks: fixed values.
RED = (((0, 100, 100), (10, 255, 255)), ((170, 100, 100), (180, 255, 255)))
STAMP = (((85, 45, 20), (140, 255, 255)), ((35, 45, 30), (85, 255, 255)))
COLOURED = (
    ((0, 10, 30), (30, 255, 255)),
    ((150, 10, 30), (180, 255, 255)),
    ((35, 15, 30), (85, 255, 255)),
    ((80, 5, 30), (140, 255, 255)),
    ((135, 10, 30), (160, 255, 255)),
)
# Enhancement of blue stamps: fixed values.
HUES, SATURATION, VALUE, CLIP, TILES, GAMMA, KERNEL = (85, 130), 1.8, 1.3, 4.0, 8, 0.7, 3
VERTICAL = 1.5


def gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img
    return np.rint(img @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def to_hsv(img: np.ndarray) -> np.ndarray:
    """Pixels without colour, most of a scan, have neither hue nor saturation; only the others are computed."""
    b, g, r = (img[..., i] for i in range(3))
    top = np.maximum(np.maximum(b, g), r)
    coloured = top != np.minimum(np.minimum(b, g), r)
    out = np.zeros(img.shape, np.uint8)
    out[..., 2] = top
    out[coloured] = _hsv(img[coloured])
    return out


def _hsv(img: np.ndarray) -> np.ndarray:
    b, g, r = (img[..., i].astype(np.float64) for i in range(3))
    v = np.maximum(np.maximum(b, g), r)
    span = v - np.minimum(np.minimum(b, g), r)
    safe = np.where(span > 0, span, 1)
    h = np.select([v == r, v == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe) * 30
    h = np.where(span > 0, np.mod(h, 180), 0)
    s = np.where(v > 0, 255 * span / np.where(v > 0, v, 1), 0)
    return np.rint(np.stack([h, s, v], -1)).astype(np.uint8)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    coloured = hsv[..., 1] > 0
    out = np.repeat(hsv[..., 2:], 3, -1)
    out[coloured] = _bgr(hsv[coloured])
    return out


def _bgr(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv[..., 0] / 30.0, hsv[..., 1] / 255.0, hsv[..., 2].astype(np.float64)

    def channel(n: int) -> np.ndarray:
        k = np.mod(n + h, 6)
        return v * (1 - s * np.clip(np.minimum(k, 4 - k), 0, 1))

    return np.rint(np.stack([channel(1), channel(3), channel(5)], -1)).astype(np.uint8)


def in_ranges(hsv: np.ndarray, ranges) -> np.ndarray:
    out = np.zeros(hsv.shape[:2], bool)
    for low, high in ranges:
        inside = np.ones(hsv.shape[:2], bool)
        for i in range(3):
            inside &= (hsv[..., i] >= low[i]) & (hsv[..., i] <= high[i])
        out |= inside
    return out


def otsu(plane: np.ndarray) -> int:
    """The threshold that parts a plane's histogram with most variance between the parts."""
    p = np.bincount(plane.ravel(), minlength=256) / max(1, plane.size)
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    between = (mean[-1] * weight - mean) ** 2 / np.where((weight > 0) & (weight < 1), weight * (1 - weight), np.inf)
    return int(np.argmax(between))


def is_vertical(img: np.ndarray) -> bool:
    """Whether ink varies much more over columns than over rows."""
    g = gray(img)
    ink = (g <= otsu(g)).astype(np.float64)
    return bool(np.var(ink.sum(0)) > VERTICAL * np.var(ink.sum(1)))


def turn(img: np.ndarray, clockwise: int) -> np.ndarray:
    return np.ascontiguousarray(np.rot90(img, -(clockwise // 90)))


def red_coverage(img: np.ndarray) -> float:
    return float(in_ranges(to_hsv(img), RED).mean()) if img.size else 0.0


def has_red_mark(img: np.ndarray, threshold: float = 0.01) -> bool:
    return red_coverage(img) > threshold


def _part(x: np.ndarray, start: int, n: int, axis: int) -> np.ndarray:
    """n places of an axis, not copied."""
    return x[start : start + n] if axis == 0 else x[:, start : start + n]


def _slide(x: np.ndarray, size: int, axis: int, op) -> np.ndarray:
    before = size // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (before, size - 1 - before)
    edge = np.pad(x, pad, constant_values=0 if op is np.maximum else 255 if x.dtype != bool else True)
    n = x.shape[axis]
    out = _part(edge, 0, n, axis)
    for i in range(1, size):
        out = op(out, _part(edge, i, n, axis))
    return out


def dilate(x: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _slide(_slide(x, width, 1, np.maximum), height, 0, np.maximum)
    return x


def erode(x: np.ndarray, width: int, height: int, times: int = 1) -> np.ndarray:
    for _ in range(times):
        x = _slide(_slide(x, width, 1, np.minimum), height, 0, np.minimum)
    return x


def _runs(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(y, from, to, region) of each row's runs, regions being 8-connected; rows are joined bottom up."""
    up: list[int] = []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    found: list[tuple[int, int, int, int]] = []
    above: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            label = -1
            for c, d, other in above:
                if c <= b and a <= d:
                    root = top(other)
                    if label < 0:
                        label = root
                    elif root != label:
                        up[max(root, label)] = label = min(root, label)
            if label < 0:
                label = len(up)
                up.append(label)
            found.append((y, a, b, label))
            now.append((a, b, label))
        above = now
    return [(y, a, b, top(i)) for y, a, b, i in found]


def regions(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of the 8-connected regions."""
    merged: dict[int, list[int]] = {}
    for y, a, b, i in _runs(mask):
        m = merged.setdefault(i, [a, y, b, y + 1, 0])
        m[:] = [min(m[0], a), min(m[1], y), max(m[2], b), max(m[3], y + 1), m[4] + b - a]
    return [(a, b, c - a, d - b, n) for a, b, c, d, n in merged.values()]


def without_specks(mask: np.ndarray, least: int) -> np.ndarray:
    """The regions of at least so many pixels."""
    runs = _runs(mask)
    size: dict[int, int] = {}
    for _, a, b, i in runs:
        size[i] = size.get(i, 0) + b - a
    out = np.zeros_like(mask)
    for y, a, b, i in runs:
        out[y, a:b] = size[i] >= least
    return out


def stamp_boxes(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Wide regions of blue or green ink of over a thousandth of the page."""
    mask = dilate(in_ranges(to_hsv(img), STAMP), 15, 5, 2)
    least = 0.001 * mask.size
    return [(x, y, w, h) for x, y, w, h, _ in regions(mask) if w > h and w * h > least]


def crop(img: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    h, w = img.shape[:2]
    return img[max(0, top) : min(h, bottom), max(0, left) : min(w, right)]


def stamp_crop(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x, y, w, h = box
    return crop(img, x - 50, y - 20, x + w + 250, y + h + 20)


def pad_sides(img: np.ndarray, tight: bool) -> np.ndarray:
    """White space at both sides, for suffixes that a crop cuts off."""
    left, right = (100, 300) if tight else (20, 20)
    if tight and img.shape[0] > img.shape[1]:
        left, right = left + int(1.5 * img.shape[0]), right + int(1.5 * img.shape[0])
    return np.pad(img, ((0, 0), (left, right)) + ((0, 0),) * (img.ndim - 2), constant_values=255)


def shrink(img: np.ndarray, longest: int) -> np.ndarray:
    """Scaled down by area means until no side is longer."""
    scale = max(img.shape[:2]) / longest
    if scale <= 1:
        return img
    h, w = (max(1, int(n / scale)) for n in img.shape[:2])
    rows, cols = np.linspace(0, img.shape[0], h + 1).astype(int), np.linspace(0, img.shape[1], w + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(img.astype(np.float64), rows[:-1], 0), cols[:-1], 1)
    area = np.outer(np.diff(rows), np.diff(cols))
    return np.rint(sums / (area[..., None] if img.ndim == 3 else area)).astype(np.uint8)


def enlarge(plane: np.ndarray, factor: float) -> np.ndarray:
    """Scaled up with linear interpolation."""
    out = plane.astype(np.float64)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.clip((np.arange(int(n * factor)) + 0.5) / factor - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        part = (at - low).reshape([-1 if i == axis else 1 for i in range(out.ndim)])
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, n - 1), axis) * part
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def equalize(plane: np.ndarray, clip: float = 2.0, tiles: int = TILES) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation, tiles blended linearly."""
    h, w = plane.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(plane, ((0, th * tiles - h), (0, tw * tiles - w)), mode="edge")
    maps = np.empty((tiles, tiles, 256))
    limit = max(1, int(clip * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            extra = np.maximum(hist - limit, 0).sum()
            hist = np.minimum(hist, limit) + extra / 256
            maps[i, j] = np.cumsum(hist) * 255 / (th * tw)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    tile = lambda dy, dx: np.clip(y0 + dy, 0, tiles - 1)[:, None] * tiles + np.clip(x0 + dx, 0, tiles - 1)[None, :]
    at = lambda dy, dx: np.take(maps, tile(dy, dx) * 256 + plane)
    out = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _boost_stamp(img: np.ndarray) -> np.ndarray:
    hsv = to_hsv(img).astype(np.float64)
    blue = (hsv[..., 0] >= HUES[0]) & (hsv[..., 0] <= HUES[1])
    for channel, gain in ((1, SATURATION), (2, VALUE)):
        hsv[..., channel] = np.where(blue, np.minimum(255, hsv[..., channel] * gain), hsv[..., channel])
    return from_hsv(hsv.astype(np.uint8))


def _local_contrast(img: np.ndarray) -> np.ndarray:
    """Equalises lightness and keeps the colour."""
    light = gray(img).astype(np.float64)
    gain = equalize(light.astype(np.uint8), CLIP) - light
    return np.clip(img + gain[..., None], 0, 255).astype(np.uint8)


def _blue_plane(img: np.ndarray) -> np.ndarray:
    table = (255 * (np.arange(256) / 255.0) ** (1 / GAMMA)).astype(np.uint8)
    out = img.copy()
    out[..., 0] = equalize(table[img[..., 0]], CLIP)
    return out


def _strokes(img: np.ndarray) -> np.ndarray:
    """What is darker than its surroundings, thickened, on white."""
    g = gray(img).astype(np.float64)
    weight = np.exp(-0.5 * (np.arange(-5, 6) / 2.0) ** 2)
    weight /= weight.sum()
    mean = g
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (5, 5)
        edge = np.pad(mean, pad, mode="edge")
        mean = sum(c * _part(edge, i, g.shape[axis], axis) for i, c in enumerate(weight))
    dark = dilate(g <= mean - 2, KERNEL, KERNEL)
    return np.where(dark[..., None], img, np.uint8(255))


METHODS = {"hsv": _boost_stamp, "clahe": _local_contrast, "blue_channel": _blue_plane, "morphological": _strokes}


def enhance(img: np.ndarray, method: str = "combined") -> np.ndarray:
    """One enhancement, or all that strengthen a faded stamp in turn; unknown names mean all."""
    if not img.size:
        return img
    if method in METHODS:
        return METHODS[method](img)
    return _strokes(_local_contrast(_boost_stamp(img)))


def enhance_all(img: np.ndarray, methods: tuple[str, ...] = (*METHODS, "combined")) -> list[tuple[str, np.ndarray]]:
    """(method, picture) of each method; one that fails is left out."""
    out = []
    for m in methods:
        try:
            out.append((m, enhance(img, m)))
        except (ValueError, IndexError, ArithmeticError):
            continue
    return out


def for_reading(img: np.ndarray, colour_only: bool = False, thicken: bool = False) -> np.ndarray:
    """Black on white: coloured ink alone, or all, with low lines enlarged."""
    if not img.size:
        return img
    plane, found = img, False
    if colour_only and img.ndim == 3:
        mask = in_ranges(to_hsv(img), COLOURED)
        if found := bool(mask.any()):
            mask = dilate(mask, 2, 2) if thicken else mask
            plane = np.where(mask, 0, 255).astype(np.uint8)
    plane = equalize(gray(plane), 2.0)
    if plane.shape[0] < 65:
        plane = enlarge(plane, 2.5)
    out = np.where(plane > otsu(plane), 255, 0).astype(np.uint8)
    return erode(out, 2, 2) if thicken and (found or not colour_only) else out


def to_lab(img: np.ndarray) -> np.ndarray:
    """CIE L*a*b* of sRGB under D65, L in 0 to 255, a and b around 128."""
    c = img[..., ::-1] / 255.0
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # the matrix of sRGB and the white point: fixed values
    xyz = c @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    lab = np.stack([light * 2.55, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.rint(lab), 0, 255).astype(np.uint8)


def _ellipse(mask: np.ndarray, op) -> np.ndarray:
    """One step of dilation or erosion by an ellipse of 5 x 3: a row of five, and one above and below."""
    flat = _slide(mask, 5, 1, op)
    return op(flat, _slide(mask, 3, 0, op))


def faint_ink(img: np.ndarray) -> np.ndarray | None:
    """Faint blue ink, black on white and enlarged; null where there is next to none or too much."""
    if img.ndim != 3 or img.shape[0] < 5 or img.shape[1] < 10:
        return None
    lab = to_lab(img)
    blue = np.where((lab[..., 0] < 30) | (lab[..., 2] > 118), 128, lab[..., 2])
    plane = np.pad(255.0 - blue, 1, mode="reflect")
    near = np.exp(-0.5)  # weights of a 3 x 3 Gaussian of sigma 1
    for axis in (0, 1):
        n = plane.shape[axis]
        low, mid, high = (np.take(plane, range(i, n - 2 + i), axis) for i in range(3))
        plane = (near * (low + high) + mid) / (1 + 2 * near)
    ink = np.rint(plane) > 132
    for op in (np.maximum, np.maximum, np.minimum, np.minimum):
        ink = _ellipse(ink, op)
    ink = without_specks(ink, 10)
    if not 0.002 <= ink.mean() <= 0.5:
        return None
    return 255 - enlarge(np.where(ink, 255, 0).astype(np.uint8), 2.5)
