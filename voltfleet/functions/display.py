"""Values as a person reads them: classes, labels, rounding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.functions.timekeys import day_label
from voltfleet.schema import CHARGE_PRESETS, RATINGS, UNKNOWN_LABEL, UNKNOWN_TIME_LEFT

# The decimals shown in the table, the summary and for the newest reading.
TABLE_ROUNDING = {"avg_watts_in": 1, "avg_watts_out": 1, "avg_temp": 1}
SUMMARY_ROUNDING = {
    "avg_watts_in": 2,
    "min_watts_in": 2,
    "max_watts_in": 2,
    "avg_watts_out": 2,
    "min_watts_out": 2,
    "max_watts_out": 2,
}
LATEST_ROUNDING = {"soc": 0, "watts_out": "watts", "watts_in": "watts", "temp": 1}


def classify_profile(df: DataFrame, out: str = "profile") -> DataFrame:
    """Name the charge profile in ``min``, ``max``, ``re``.

    A preset gets its name, a profile with a NULL member stays NULL, and every other
    one is ``custom``.
    """
    low, high, resume = F.col("min"), F.col("max"), F.col("re")
    named = F.when(low.isNull() | high.isNull() | resume.isNull(), F.lit(None).cast("string"))
    for name, (p_min, p_max, p_re) in CHARGE_PRESETS.items():
        named = named.when((low == p_min) & (high == p_max) & (resume == p_re), F.lit(name))
    return df.withColumn(out, named.otherwise(F.lit("custom")))


def time_left(minutes: Column, connected: Column | None = None) -> Column:
    """Signed minutes as ``HH:MM``; the hours may take more than two digits."""
    whole = F.floor(F.abs(minutes))
    unknown = minutes.isNull() | (minutes == -1)
    if connected is not None:
        unknown = unknown | ~F.coalesce(connected, F.lit(False))
    return F.when(unknown, F.lit(UNKNOWN_TIME_LEFT)).otherwise(
        F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)
    )


def format_time_left(
    df: DataFrame,
    minutes: str = "timeToEmptyFull",
    connected: str | None = None,
    out: str = "time_left",
) -> DataFrame:
    """Add the time to empty or full as text; unknown or disconnected is ``--:--``."""
    return df.withColumn(
        out, time_left(F.col(minutes), F.col(connected) if connected else None)
    )


def charge_direction(
    df: DataFrame,
    watts_in: str = "wattsIn",
    watts_out: str = "wattsOut",
    connected: str | None = None,
    out: str = "direction",
) -> DataFrame:
    """``charging``, ``discharging`` or ``neutral``; a NULL reading counts as 0."""
    w_in = F.coalesce(F.col(watts_in), F.lit(0.0))
    w_out = F.coalesce(F.col(watts_out), F.lit(0.0))
    label = (
        F.when(w_in > w_out, "charging").when(w_out > 0, "discharging").otherwise("neutral")
    )
    if connected:
        label = F.when(F.coalesce(F.col(connected), F.lit(False)), label).otherwise("neutral")
    return df.withColumn(out, label)


def chart_label(text: Column, ts: Column, period: str) -> Column:
    """The time label of a chart point: ``HH:mm``, ``dd/MM HH:mm`` or ``dd/MM``.

    A missing time is ``???``; text which is no time is shown, cut at 19 characters.
    """
    shown = ts.cast("string")
    clock = F.substring(shown, 12, 5)
    day = day_label(F.to_date(ts))
    day_month = F.concat(F.substring(day, 9, 2), F.lit("/"), F.substring(day, 6, 2))
    labels = {
        "hour": clock,
        "day": F.concat(day_month, F.lit(" "), clock),
        "month": day_month,
    }
    if period not in labels:
        raise ValueError(f"unknown period {period!r}")
    return (
        F.when(ts.isNotNull(), labels[period])
        .when(text.isNull(), F.lit(UNKNOWN_LABEL))
        .otherwise(F.substring(text, 1, 19))
    )


def chart_series(df: DataFrame, period: str) -> DataFrame:
    """Label and the three charted measures of each reading, NULL shown as 0."""
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "label": chart_label(F.col("date_heure"), F.col("ts"), period),
            "chart_watts_out": F.coalesce(F.col("wattsOut"), zero),
            "chart_temp": F.coalesce(F.col("temperature"), zero),
            "chart_watts_in": F.coalesce(F.col("wattsIn"), zero),
        }
    )


def null_to_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Show a NULL aggregate as 0."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(0.0)) for name in cols})


def round_exact(value: Column, decimals: int) -> Column:
    """Round the exact binary value, halves to even, as Python does: 0.15 gives 0.1.

    ``bround`` works on the shortest decimal form and gives 0.2 there.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", value, F.lit(pattern)).try_cast("double")


def display_round(df: DataFrame, spec: Mapping[str, int | str]) -> DataFrame:
    """Round columns for display.

    ``spec`` maps a column to a number of decimals, or to ``"watts"`` for whole numbers
    with halves up. :data:`TABLE_ROUNDING` and the two below it are those of a view.
    """
    return df.withColumns(
        {
            name: F.floor(F.col(name) + 0.5).cast("double")
            if how == "watts"
            else round_exact(F.col(name), how)
            for name, how in spec.items()
        }
    )


def rated_utilisation(df: DataFrame) -> DataFrame:
    """Each reading as a share of its rating.

    Power and temperature above the rating count as full. The state of charge is
    not held at 1.
    """
    shares = {}
    for name, rating in RATINGS.items():
        share = F.col(name) / rating
        if name != "socPercent":
            # LEAST would skip a NULL and call the reading full.
            share = F.when(F.col(name) > rating, F.lit(1.0)).otherwise(share)
        shares[f"{name}_share"] = share
    return df.withColumns(shares)
