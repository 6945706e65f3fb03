"""Fusion of detector and reader confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillfold.config import FusionConfig


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def fuse(detector: Column, reader: Column, config: FusionConfig = FusionConfig()) -> Column:
    d = F.coalesce(detector, F.lit(config.default_detector))
    return clamp(config.detector_weight * d + config.reader_weight * reader)


def combine(detector: Column, reader: Column, method: Column, config: FusionConfig = FusionConfig()) -> Column:
    """fuse() less the penalties that a method's name carries, capped for the weaker reader."""
    has = lambda *names: F.rlike(F.lower(F.coalesce(method, F.lit(""))), F.lit("|".join(names)))
    turned = F.when(has("90deg", "rot90"), 0.05).when(has("180deg", "rot180"), 0.02).otherwise(0.0)
    thick = F.when(has("dilated") & ~has("color"), 0.10).otherwise(0.0)
    score = fuse(detector, reader, config) - turned - thick
    return clamp(F.when(has("easyocr"), F.least(score, F.lit(0.85))).otherwise(score))


def fuse_legacy(detector: Column, reader: Column) -> Column:
    return clamp(0.6 * F.coalesce(detector, F.lit(0.70)) + 0.4 * reader)


def boost_color(score: Column, method: Column, config: FusionConfig = FusionConfig()) -> Column:
    return F.when(F.contains(method, F.lit("color")), F.least(F.lit(1.0), score + config.color_boost)).otherwise(score)
