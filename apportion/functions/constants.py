"""Driver-side tables as constant columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(value: list, kind: str) -> Column:
    """A list as a constant of type ``kind``.

    It goes to Spark as one literal, which the optimiser parses once, instead
    of as one expression per element.
    """
    return F.from_json(F.lit(json.dumps(value, default=str)), kind)
