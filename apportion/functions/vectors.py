"""Linear scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, term: total + term,
    )


def predict(features: Column, classes: Column) -> Column:
    """Best class of a sample as ``struct<logit, rank>``.

    ``classes`` is an array of ``struct<class_id, weights>``. ``rank`` is the
    negated class id, so that equal logits resolve to the lowest class.
    """
    return F.array_max(
        F.transform(
            classes,
            lambda c: F.struct(
                dot(features, c["weights"]).alias("logit"),
                (-c["class_id"]).alias("rank"),
            ),
        )
    )
