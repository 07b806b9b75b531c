"""Prediction output as JSON and CSV text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskloom.functions.numbers import fixed_text, number_text
from riskloom.operators.metrics import argmax


def argmax_label(raw: Column) -> Column:
    """``class-<i>`` of the first maximum of the raw scores."""
    return F.concat(F.lit("class-"), argmax(raw).cast("string"))


def _calibrated_or_raw(raw: Column, calibrated: Column) -> Column:
    return F.when(F.size(calibrated) == F.size(raw), calibrated).otherwise(raw)


def prediction_json(raw: Column, calibrated: Column, n_classes: int) -> Column:
    """One JSON record with every score as text; two classes show the positive one only."""
    cal = _calibrated_or_raw(raw, calibrated)
    if n_classes == 2:
        fields = [
            number_text(F.element_at(raw, 2)).alias("legacy-score"),
            number_text(F.element_at(cal, 2)).alias("calibrated-score"),
        ]
    else:
        fields = []
        for i in range(1, n_classes + 1):
            fields.append(number_text(F.element_at(raw, i)).alias(f"prob_{i:02d}"))
            fields.append(number_text(F.element_at(cal, i)).alias(f"calibrated_prob_{i:02d}"))
    return F.to_json(F.struct(*fields, argmax_label(raw).alias("custom-output-label")))


def prediction_csv(raw: Column, calibrated: Column, n_classes: int) -> Column:
    """Scores with four decimals and the label, comma separated."""
    cal = _calibrated_or_raw(raw, calibrated)

    def four(c: Column) -> Column:
        return fixed_text(c, 4)

    if n_classes == 2:
        label = F.when(F.element_at(raw, 2) > F.element_at(raw, 1), "class-1").otherwise("class-0")
        return F.concat_ws(",", four(F.element_at(raw, 2)), four(F.element_at(cal, 2)), label)
    parts = []
    for i in range(1, n_classes + 1):
        parts += [four(F.element_at(raw, i)), four(F.element_at(cal, i))]
    return F.concat_ws(",", *parts, argmax_label(raw))


def text_prediction_json(probs: Column, n_classes: int) -> Column:
    """The text model's record: first score, the others by number, the label."""
    first = number_text(F.element_at(probs, 1)).alias("legacy-score")
    rest = [number_text(F.element_at(probs, i)).alias(f"prob_{i:02d}") for i in range(2, n_classes + 1)]
    return F.to_json(F.struct(first, *rest, argmax_label(probs).alias("output-label")))


def text_prediction_csv(probs: Column, n_classes: int) -> Column:
    scores = [fixed_text(F.element_at(probs, i), 4) for i in range(1, n_classes + 1)]
    return F.concat_ws(",", *scores, argmax_label(probs))
