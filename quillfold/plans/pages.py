"""Pictures of pages, made from the scan log, for the queries over image operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.operators import kernels as K
from quillfold.operators import vision
from quillfold.sources.pictures import decode, encode_png


def lined(log: DataFrame) -> DataFrame:
    """(scan_idx, content): two lines across the page where k is even, else down it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["k"]:
                img = np.full((40, 40, 3), 255, np.uint8)
                for at in (8 + int(k) % 5, 20):
                    if k % 2:
                        img[:, at : at + 2] = 0
                    else:
                        img[at : at + 2] = 0
                out.append(encode_png(img))
            yield pd.DataFrame({"scan_idx": f["scan_idx"], "k": f["k"], "content": out})

    return log.select("scan_idx", "k").mapInPandas(run, "scan_idx long, k long, content binary")


def turns(pictures: DataFrame) -> DataFrame:
    """(scan_idx, vertical, angle), by a reader that sees a line running down where k % 4 = 1, else up."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vertical, angle = [], []
            for k, content in zip(f["k"], f["content"], strict=True):
                img = decode(bytes(content))
                corners = [(0, 0), (0, 10)] if k % 4 == 1 else [(0, 10), (0, 0)]
                vertical.append(K.is_vertical(img))
                angle.append(vision.reading_angle(img, lambda _, c=corners: [("x", 1.0, c)]))
            yield pd.DataFrame({"scan_idx": f["scan_idx"], "vertical": vertical, "angle": angle})

    return pictures.mapInPandas(run, "scan_idx long, vertical boolean, angle long")


def marked(log: DataFrame) -> DataFrame:
    """(scan_idx, content): k pixels of red in a picture of 100 x 20."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["k"]:
                img = np.full((20, 100, 3), 255, np.uint8)
                img[7, : int(k)] = (0, 0, 200)
                out.append(encode_png(img))
            yield pd.DataFrame({"scan_idx": f["scan_idx"], "content": out})

    return log.select("scan_idx", "k").mapInPandas(run, "scan_idx long, content binary")


def red(pictures: DataFrame) -> DataFrame:
    """(scan_idx, coverage, red)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            img = [decode(bytes(c)) for c in f["content"]]
            yield pd.DataFrame({"scan_idx": f["scan_idx"], "coverage": [K.red_coverage(i) for i in img], "red": [K.has_red_mark(i) for i in img]})

    return pictures.mapInPandas(run, "scan_idx long, coverage double, red boolean")


def stamped(kinds: DataFrame) -> DataFrame:
    """(k, content): a blue mark, tall where k % 3 = 0, else wide by k."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["k"]:
                img = np.full((120, 240, 3), 255, np.uint8)
                if k % 3:
                    img[50:70, 40 : 60 + int(k)] = (200, 60, 20)
                else:
                    img[30:90, 40:46] = (200, 60, 20)
                out.append(encode_png(img))
            yield pd.DataFrame({"k": f["k"], "content": out})

    return kinds.mapInPandas(run, "k long, content binary")


def stamps(pictures: DataFrame) -> DataFrame:
    """(k, x, y, w, h, crop_w, crop_h) of each stamp, and the size of its crop."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, content in zip(f["k"], f["content"], strict=True):
                img = decode(bytes(content))
                rows += [(i, *box, *K.stamp_crop(img, box).shape[1::-1]) for box in K.stamp_boxes(img)]
            yield pd.DataFrame(rows, columns=["k", "x", "y", "w", "h", "crop_w", "crop_h"])

    return pictures.mapInPandas(run, "k long, x long, y long, w long, h long, crop_w long, crop_h long")


def pale(kinds: DataFrame) -> DataFrame:
    """(k, content): a pale blue mark where k is odd, else gray paper."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["k"]:
                img = np.full((30, 60, 3), 235, np.uint8)
                if k % 2:
                    img[10:16, 12:40] = (235, 200, 190)
                out.append(encode_png(img))
            yield pd.DataFrame({"k": f["k"], "content": out})

    return kinds.mapInPandas(run, "k long, content binary")


def prepared(pictures: DataFrame) -> DataFrame:
    """(k, faint, read_h, read_w, pad_w): faint ink found, and the sizes that a reader gets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            img = [decode(bytes(c)) for c in f["content"]]
            read = [K.for_reading(i) for i in img]
            yield pd.DataFrame(
                {
                    "k": f["k"],
                    "faint": [K.faint_ink(i) is not None for i in img],
                    "read_h": [r.shape[0] for r in read],
                    "read_w": [r.shape[1] for r in read],
                    "pad_w": [K.pad_sides(i, True).shape[1] for i in img],
                }
            )

    return pictures.mapInPandas(run, "k long, faint boolean, read_h long, read_w long, pad_w long")


def barred(batches: DataFrame) -> DataFrame:
    """(batch, path, content, readable): 1 + batch % 20 bars; every fifth file is no picture."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for b in f["batch"]:
                img = np.full((200, 400, 3), 255, np.uint8)
                for i in range(1 + int(b) % 20):
                    img[40:60, 40 + 12 * i : 45 + 12 * i] = 0
                out.append(encode_png(img) if b % 5 != 4 else b"%PDF-1.4")
            yield pd.DataFrame({"batch": f["batch"], "path": [f"drop/page_{b}.png" for b in f["batch"]], "content": out, "readable": f["batch"] % 5 != 4})

    return batches.mapInPandas(run, "batch long, path string, content binary, readable boolean")


def bar_reader() -> vision.Extractor:
    """An extractor whose reader counts the bars of a crop and whose detector finds where they are."""

    def dark(img: np.ndarray) -> np.ndarray:
        return K.gray(img) < 128

    def read(img: np.ndarray) -> list:
        ink = dark(img)
        if not ink.any():
            return []
        most = max(int((np.diff(np.r_[0, row.astype(np.int8)]) == 1).sum()) for row in ink)
        return [(f"250{most:03d}-01", 0.9, [(0.0, 0.0), (10.0, 0.0)])]

    def detect(page: np.ndarray) -> list:
        ys, xs = np.nonzero(dark(page))
        if not len(ys):
            return []
        x1, y1, x2, y2 = int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1
        return [((x1, y1, max(x2, x1 + 2 * (y2 - y1)), y2), 0.8)]

    return vision.Extractor(vision.decoded, detect, read, lambda text: text)
