"""Image preparation on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chw_from_hwc(pixels: Column, height: int, width: int, channels: int) -> Column:
    """Reorder a flat height-width-channel array to channel-height-width."""
    plane = height * width
    source = F.sequence(F.lit(0), F.lit(plane * channels - 1))
    return F.transform(
        source,
        lambda i: F.get(
            pixels,
            ((i % F.lit(plane)) * F.lit(channels) + F.floor(i / F.lit(plane))).cast("int"),
        ),
    )


def normalise(pixels: Column, mean: float = 0.5, std: float = 0.5) -> Column:
    """Scale 0..255 to 0..1, then centre and scale by ``mean`` and ``std``."""
    return F.transform(
        pixels,
        lambda x: (x.cast("double") / F.lit(255.0) - F.lit(mean)) / F.lit(std),
    )
