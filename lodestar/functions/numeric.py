"""Column functions over spans, rates and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of two spans; 0 if a start is unknown or the hull is empty."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(s1.isNull() | s2.isNull() | (hull <= 0), F.lit(0.0)).otherwise(overlap(s1, e1, s2, e2) / hull)


def coverage(gs: Column, ge: Column, s: Column, e: Column) -> Column:
    return overlap(gs, ge, s, e) / F.greatest(F.lit(1), ge - gs)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def go_no_go(tool_recall: Column, human_recall: Column, tool_minutes: Column, human_minutes: Column, pending: Column, ratio: float = 0.9) -> Column:
    required = human_recall * ratio
    in_time = tool_minutes.isNull() | (tool_minutes <= human_minutes)
    verdict = F.when((tool_recall >= required) & in_time, "pass").when(tool_recall >= 0.75 * required, "marginal").otherwise("fail")
    return F.when(pending | human_recall.isNull(), "pending_human_baseline").otherwise(verdict)


def luminance(hex6: Column) -> Column:
    """Relative luminance of a six-digit sRGB colour."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(hex6, at, 2), 16, 10).cast("double") / 255.0
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5)


def contrast(a: Column, b: Column) -> Column:
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)
