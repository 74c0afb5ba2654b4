"""Column functions on colours and coordinates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """Integer quotient, truncated toward zero."""
    return F.call_function("div", F.lit(a) if isinstance(a, int) else F.col(a) if isinstance(a, str) else a, F.lit(b) if isinstance(b, int) else F.col(b) if isinstance(b, str) else b)


def premultiplied(channel, alpha="a") -> Column:
    """A straight channel scaled by its alpha, at 8 bits."""
    channel, alpha = (F.col(x) if isinstance(x, str) else x for x in (channel, alpha))
    return div(div(channel * 257 * alpha, 255), 256).cast("int")


def premultiplied_rgba() -> Column:
    return F.struct(premultiplied("r").alias("r"), premultiplied("g").alias("g"), premultiplied("b").alias("b"), F.col("a").alias("a"))


def hex_colour(r="r", g="g", b="b", upper: bool = False) -> Column:
    return F.format_string("#%02X%02X%02X" if upper else "#%02x%02x%02x", r, g, b)


def distance(r1, g1, b1, r2, g2, b2) -> Column:
    """Squared distance of two RGB colours."""
    return (r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2)


def within(values, others, tolerance: int) -> Column:
    """Every channel differs by the tolerance at most."""
    close = F.lit(True)
    for a, b in zip(values, others, strict=True):
        close = close & (F.abs(a - b) <= tolerance)
    return close


def frame_delay(fps: int) -> int:
    """Hundredths of a second that one frame stands: 100 / fps, halves up, 1 at least."""
    if fps <= 0:
        raise ValueError("fps must be positive")
    return max(1, (200 + fps) // (2 * fps))


def delay_column(fps) -> Column:
    """frame_delay of a column."""
    return F.greatest(F.lit(1), div(200 + F.col(fps), 2 * F.col(fps))).cast("int")


def round_up(value, step: int) -> Column:
    return (F.ceil(value / step) * step).cast("int")


def parse_colour(raw: str) -> tuple[int, int, int]:
    """#RRGGBB, the # being optional."""
    text = raw.strip().removeprefix("#")
    if not re.fullmatch("[0-9a-fA-F]{6}", text):
        raise ValueError(f"not a colour: {raw!r}")
    return tuple(int(text[i : i + 2], 16) for i in (0, 2, 4))


def parse_size(raw: str) -> tuple[int, int]:
    """COLSxROWS or WxH, both positive."""
    found = re.fullmatch(r"\s*([0-9]+)\s*[xX]\s*([0-9]+)\s*", raw)
    if not found or "0" in (found[1].lstrip("0") or "0", found[2].lstrip("0") or "0"):
        raise ValueError(f"not a size: {raw!r}")
    return int(found[1]), int(found[2])


def checked(name: str, value: int, low: int, high: int | None = None) -> int:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be {low} at least" if high is None else f"{name} must be between {low} and {high}")
    return value
