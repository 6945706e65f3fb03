"""Extraction of identifiers from page images: one cascade inside mapInPandas.

Detector, recogniser and rasteriser are interfaces: their models load once in a Python
worker. The cascade stays in one function, since Spark evaluates Python functions in every
branch of a CASE. A row never fails the job: its error is a column.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.config import FusionConfig, TrustConfig
from quillfold.operators import kernels as K
from quillfold.sources.pictures import decode, encode_png

LONGEST_PAGE, LONGEST_READ = 6000, 1200


class Rasteriser(Protocol):
    def __call__(self, name: str, content: bytes) -> np.ndarray | None: ...


def decoded(name: str, content: bytes) -> np.ndarray | None:
    """The rasteriser of plain pictures (PNG, PNM, BMP); none for other files."""
    try:
        return decode(content)
    except ValueError:
        return None


class Detector(Protocol):
    def __call__(self, page: np.ndarray) -> list[tuple[tuple[int, int, int, int], float]]: ...


class Recogniser(Protocol):
    def __call__(self, image: np.ndarray) -> list[tuple[str, float, list[tuple[float, float]]]]:
        """Lines of text: (text, confidence, corners from the top left, clockwise)."""


def box_ok(box: tuple[int, int, int, int], page: tuple[int, int]) -> bool:
    """Wide boxes that don't cover much of the page."""
    w, h = box[2] - box[0], box[3] - box[1]
    return w > 0 and h > 0 and w / h >= 1.2 and w * h <= 0.08 * page[0] * page[1]


def box_filter(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column) -> Column:
    """box_ok as an expression."""
    w, h = x2 - x1, y2 - y1
    return (w > 0) & (h > 0) & (w >= 1.2 * h) & (w * h <= 0.08 * page_w * page_h)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, page_w: Column, page_h: Column, wide: bool) -> Column:
    """The padded box, within the page: struct<x1, y1, x2, y2>."""
    least, share = ((50, 30), (0.80, 0.40)) if wide else ((10, 10), (0.05, 0.05))
    px = F.greatest(F.lit(least[0]), F.floor((x2 - x1) * share[0])).cast("long")
    py = F.greatest(F.lit(least[1]), F.floor((y2 - y1) * share[1])).cast("long")
    return F.struct(
        F.greatest(F.lit(0), x1 - px).cast("long").alias("x1"),
        F.greatest(F.lit(0), y1 - py).cast("long").alias("y1"),
        F.least(page_w, x2 + px).cast("long").alias("x2"),
        F.least(page_h, y2 + py).cast("long").alias("y2"),
    )


def reading_angle(page: np.ndarray, read: Recogniser) -> int:
    """Clockwise turn that makes a page's text level: 0, 90 or 270."""
    if not page.size or not K.is_vertical(page):
        return 0
    h, w = page.shape[:2]
    low = page[int(0.7 * h) :]
    for corner in (low[:, int(0.7 * w) :], low[:, : int(0.3 * w)]):
        lines = read(corner) if corner.size else []
        if lines:
            (ax, ay), (bx, by) = lines[0][2][:2]
            return 270 if math.atan2(by - ay, bx - ax) > 0 else 90
    return 0


@dataclass(frozen=True)
class Extractor:
    """The cascade over one page. normalize(text): the identifier in it, or none."""

    rasterise: Rasteriser
    detect: Detector
    read: Recogniser
    normalize: Callable[[str], str | None]
    trust: TrustConfig = field(default_factory=TrustConfig)
    fusion: FusionConfig = field(default_factory=FusionConfig)

    def _lines(self, image: np.ndarray) -> list[tuple[str, float, list]]:
        return self.read(K.shrink(image, LONGEST_READ))

    def _first(self, image: np.ndarray) -> tuple[str, float] | None:
        return next(((job, conf) for text, conf, _ in self._lines(image) if (job := self.normalize(text))), None)

    def _recover(self, image: np.ndarray, tight: bool) -> tuple[str, float, str] | None:
        """As it is, else its coloured ink alone."""
        wide = K.pad_sides(image, tight)
        for picture, name in ((lambda: wide, "raw"), (lambda: K.for_reading(wide, colour_only=True), "color_mask")):
            if found := self._first(picture()):
                return (*found, name)
        return None

    def _score(self, sure: float, conf: float, boosted: bool) -> float:
        f = self.fusion
        base = min(1.0, max(0.0, f.detector_weight * sure + f.reader_weight * conf))
        return min(1.0, base + f.color_boost) if boosted else base

    def _of_box(self, page: np.ndarray, box: tuple[int, int, int, int], sure: float) -> tuple[str, float, str, bool] | None:
        x1, y1, x2, y2 = box
        w, h = x2 - x1, y2 - y1
        best: tuple[str, float, str, bool] | None = None
        px, py = int(max(10, 0.05 * w)), int(max(10, 0.05 * h))
        tight = K.crop(page, x1 - px, y1 - py, x2 + px, y2 + py)
        px, py = int(max(50, 0.8 * w)), int(max(30, 0.4 * h))
        dragnet = K.crop(page, x1 - px, y1 - py, x2 + px, y2 + py)
        # (crop, enhanced, name): the second only if the first was weak
        for image, better, name in ((tight, True, "tight"), (tight, False, "tight"), (dragnet, True, "wide")):
            if not image.size or (name == "tight" and not better and best and best[1] >= self.trust.low_confidence):
                continue
            found = self._recover(K.enhance(image) if better else image, name == "tight")
            if not found:
                continue
            job, conf, how = found
            score = self._score(sure, conf, better and "color" in how)
            if best is None or score > best[1]:
                best = (job, score, f"box_{name}_{how}" + "_enhanced" * better, K.has_red_mark(image))
            if name == "tight" and better and score >= self.trust.threshold:
                break
        return best

    def page(self, page: np.ndarray) -> tuple[str | None, float, str, bool]:
        """(identifier, confidence, method, red mark)."""
        if page.shape[0] > page.shape[1]:
            page = K.turn(page, 90)
        page = K.turn(page, reading_angle(page, self.read))
        boxes = [(b, c) for b, c in self.detect(page) if box_ok(b, page.shape[:2])]
        for box, sure in sorted(boxes, key=lambda x: -x[1]):
            if found := self._of_box(page, box, sure):
                return found
        strong = K.enhance(page, "hsv")
        stamps = [(f[1], -i, f[0], image) for i, b in enumerate(K.stamp_boxes(strong)) if (f := self._first(image := K.stamp_crop(strong, b)))]
        if stamps:
            conf, _, job, image = max(stamps, key=lambda s: s[:2])
            return job, conf, "stamp_colour_enhanced", K.has_red_mark(image)
        corner = page[int(0.45 * page.shape[0]) :, int(0.45 * page.shape[1]) :]
        if corner.size and (found := self._recover(K.enhance(corner), False)):
            return found[0], found[1], f"corner_{found[2]}_enhanced", K.has_red_mark(corner)
        return None, 0.0, "failed", False


EXTRACTED = (
    "path string, filename string, job_number string, confidence double, method string, "
    "meta struct<has_red_correction:boolean,error:string>, processing_time_sec double, page int, error string, status string, raw_job_number string"
)


#: Extractors of this Python worker, by the call of extract() that they belong to.
_BUILT: dict[str, Extractor] = {}
KEPT = 4


def _built(key: str, make: Callable[[], Extractor]) -> Extractor:
    """The extractor of one call: models load once in a worker, which keeps those of the last few calls."""
    if key not in _BUILT:
        while len(_BUILT) >= KEPT:
            del _BUILT[next(iter(_BUILT))]
        _BUILT[key] = make()
    return _BUILT[key]


def extract(files: DataFrame, make: Callable[[], Extractor]) -> DataFrame:
    """Extraction results of files (path, content). make() builds the extractor in each worker, once."""
    call = uuid.uuid4().hex

    def one(path: str, content: bytes, e: Extractor) -> dict:
        began, error = time.perf_counter(), None
        job, conf, method, red = None, 0.0, "failed", False
        try:
            page = e.rasterise(path, content)
            if page is None or not page.size:
                error = "image_load_failed"
            else:
                job, conf, method, red = e.page(K.shrink(page, LONGEST_PAGE))
                error = None if job else "all_methods_failed"
        except Exception as x:  # noqa: BLE001  a bad page is a result, not a failed job
            error = f"critical_error: {x}"
        return {
            "path": path,
            "filename": path.rsplit("/", 1)[-1],
            "job_number": job,
            "confidence": conf,
            "method": method,
            "meta": {"has_red_correction": red, "error": error},
            "processing_time_sec": time.perf_counter() - began,
            "page": 1,
            "error": error,
            "status": "Success" if job else f"Failure: {error}",
            "raw_job_number": job or "failed",
        }

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(p, c, _built(call, make)) for p, c in zip(batch["path"], batch["content"], strict=True)])

    return files.select("path", "content").mapInPandas(run, EXTRACTED)


@F.udtf(returnType="method string, height int, width int, red double, image binary")
class EnhanceMethods:
    """A row for each enhancement of a picture (PNG, PNM or BMP); what can't be read has no rows."""

    def eval(self, content: bytes):
        try:
            page = decode(content)
        except ValueError:
            return
        for name, image in K.enhance_all(page):
            yield name, image.shape[0], image.shape[1], K.red_coverage(image), encode_png(image)


def red_pixels(h: Column, s: Column, v: Column) -> Column:
    """Whether a pixel is red ink, as an expression over rows of pixels."""
    return (h.between(0, 10) | h.between(170, 180)) & (s >= 100) & (v >= 100)


def best_candidate(confidence: Column, position: Column, *values: str) -> Column:
    """Aggregate: the values of the most confident candidate, the first of equals."""
    return F.max_by(F.struct(*values), F.struct(confidence, -position))
