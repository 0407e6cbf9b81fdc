"""Column expressions shared by the jobs: money, rounding, guarded division, dates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as a decimal with four places, so a sum does not depend on the order in
# which partitions arrive and stays exact beyond the 15 digits of a double.
MONEY = "decimal(18,4)"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def money_sum(c) -> Column:
    return F.sum(_col(c).cast(MONEY))


def money(c) -> Column:
    """A decimal amount as a double rounded to cents."""
    return F.round(_col(c), 2).cast("double")


def round2(c) -> Column:
    """Round a double to two places, half away from zero, on its binary value.

    `round(x, 2)` in Spark rounds the printed decimal; scaling first gives what scaling and
    rounding the double itself gives, e.g. 1.0 and not 1.01 for the double nearest 1.005.
    """
    return F.round(_col(c).cast("double") * F.lit(100.0)) / F.lit(100.0)


def ratio(numerator, denominator) -> Column:
    """Double division that is NULL for a zero denominator."""
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))


def percentage(numerator, denominator) -> Column:
    return round2(ratio(F.lit(100.0) * _col(numerator).cast("double"), denominator))


def percent_true(flag) -> Column:
    """Share of TRUE among the known values of a flag, in per cent."""
    return round2(F.lit(100.0) * F.avg(_col(flag).cast("int")))


def percent_change(current, previous) -> Column:
    change = _col(current).cast("double") - _col(previous).cast("double")
    return round2(ratio(F.lit(100.0) * change, previous))


def days_between(start, end) -> Column:
    """Midnights crossed from start to end, signed."""
    return F.datediff(_col(end), _col(start)).cast("bigint")


def month_start(ts) -> Column:
    # By way of a date, so that the session time zone plays no part.
    return F.trunc(_col(ts).cast("date"), "month").cast("timestamp_ntz")


def late_flag(delivered, estimated) -> Column:
    """NULL while undelivered, else whether the delivery came after the estimate."""
    delivered, estimated = _col(delivered), _col(estimated)
    return F.when(delivered.isNotNull(), F.coalesce(delivered > estimated, F.lit(False)))


# The delay bands, earliest first, each with its last day.
DELAY_BANDS = [
    ("more_than_7_days_early", -8),
    ("1_to_7_days_early", -1),
    ("on_estimated_date", 0),
    ("1_to_3_days_late", 3),
    ("4_to_7_days_late", 7),
    ("more_than_7_days_late", None),
]


def delay_band_order(days) -> Column:
    """Position of the band a delay falls into, from 1; NULL for an unknown delay."""
    days = _col(days)
    bounds = [last for _, last in DELAY_BANDS if last is not None]
    return sum(((days > last).cast("int") for last in bounds), F.lit(1))


def delay_band_label(order) -> Column:
    label = F.lit(None).cast("string")
    for position, (name, _) in enumerate(DELAY_BANDS, 1):
        label = F.when(_col(order) == position, F.lit(name)).otherwise(label)
    return label
