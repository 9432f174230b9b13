"""Walking-cost functions, slope units and multiplier clean-up.

A cost function is one formula written against a small set of maths names, so the same definition
builds a Catalyst expression (``COLUMN_MATH``) and works on numpy arrays inside a task
(``ARRAY_MATH``).
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMN_MATH = SimpleNamespace(
    exp=F.exp,
    abs=F.abs,
    # not greatest/least: those skip nulls, and a missing elevation must stay missing
    at_least=lambda c, bound: F.when(c < bound, F.lit(bound)).otherwise(c),
    at_most=lambda c, bound: F.when(c > bound, F.lit(bound)).otherwise(c),
)
ARRAY_MATH = SimpleNamespace(exp=np.exp, abs=np.abs, at_least=np.maximum, at_most=np.minimum)

# Fixed values of the walking-speed function: top speed in km/h, decay, offset of the best slope,
# lowest speed, largest exponent.
TOP_SPEED = 6.0
DECAY = 3.5
BEST_SLOPE = 0.05
MIN_SPEED = 1e-12
MAX_EXPONENT = 80.0


def tobler(dh, dz, cap: str = "speed", math=COLUMN_MATH):
    """Hours to walk ``dh`` metres while climbing ``dz`` metres.

    ``cap`` bounds hopeless slopes either by a least speed or by a largest exponent. The two agree
    until the exponent passes ln(6e12).
    """
    decay = math.abs(dz / dh + BEST_SLOPE) * DECAY
    if cap == "speed":
        return dh / 1000.0 / math.at_least(math.exp(-decay) * TOP_SPEED, MIN_SPEED)
    if cap == "exponent":
        return dh / (1000.0 * TOP_SPEED) * math.exp(math.at_most(decay, MAX_EXPONENT))
    raise ValueError(f"cap must be 'speed' or 'exponent', got {cap!r}")


COST_FUNCTIONS = {"tobler": tobler}


def cost_function(name: str):
    try:
        return COST_FUNCTIONS[name]
    except KeyError:
        raise ValueError(f"unknown cost function {name!r}; known: {sorted(COST_FUNCTIONS)}") from None


def slope_in_units(gradient: Column, units: str) -> Column:
    if units == "degrees":
        return F.degrees(F.atan(gradient))
    if units == "percent":
        return gradient * 100.0
    raise ValueError(f"slope units must be 'degrees' or 'percent', got {units!r}")


def clean_line_multiplier(cost: Column) -> Column:
    """Line costs that are missing, NaN or not positive mean no change."""
    return F.when(~F.isnan(cost) & (cost > 0), cost).otherwise(F.lit(1.0))


def clean_raster_multiplier(v: Column) -> Column:
    """Raster values that are missing, NaN or not positive mean no change."""
    return F.when(F.isnan(v) | v.isNull() | (v <= 0), F.lit(1.0)).otherwise(v)
