"""Loss functions as columns of the margin and the label.

Each entry gives the loss and its derivative by the margin, so a gradient is
``sum(derivative * x)``.  Labels are 0/1 for logistic and hinge.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hinloom.functions.vectors import log1p_exp, sigmoid


@dataclass(frozen=True)
class Loss:
    value: Callable[[Column, Column], Column]
    slope: Callable[[Column, Column], Column]


def _sign(label: Column) -> Column:
    return label * 2.0 - 1.0


SQUARED = Loss(
    value=lambda margin, label: (margin - label) * (margin - label) / 2.0,
    slope=lambda margin, label: margin - label,
)

LOGISTIC = Loss(
    value=lambda margin, label: F.when(label > 0, log1p_exp(-margin)).otherwise(
        log1p_exp(-margin) + margin
    ),
    slope=lambda margin, label: sigmoid(margin) - label,
)

HINGE = Loss(
    value=lambda margin, label: F.greatest(F.lit(0.0), 1.0 - _sign(label) * margin),
    slope=lambda margin, label: F.when(_sign(label) * margin < 1.0, -_sign(label)).otherwise(
        F.lit(0.0)
    ),
)

# Losses of the boosted trees: labels are -1/+1 for LOG_LOSS.
ABSOLUTE = Loss(
    value=lambda margin, label: F.abs(label - margin),
    slope=lambda margin, label: F.when(label - margin < 0, F.lit(1.0)).otherwise(F.lit(-1.0)),
)

SQUARED_ERROR = Loss(
    value=lambda margin, label: (label - margin) * (label - margin),
    slope=lambda margin, label: (label - margin) * -2.0,
)

LOG_LOSS = Loss(
    value=lambda margin, label: log1p_exp(label * margin * -2.0) * 2.0,
    slope=lambda margin, label: label * -4.0 / (F.lit(1.0) + F.exp(label * margin * 2.0)),
)

LOSSES = {
    "squared": SQUARED,
    "logistic": LOGISTIC,
    "hinge": HINGE,
    "absolute": ABSOLUTE,
    "squared_error": SQUARED_ERROR,
    "log_loss": LOG_LOSS,
}
