"""All the parts of one dashboard view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from voltfleet.functions.display import chart_series
from voltfleet.operators.keylists import available_dates, available_months, available_weeks
from voltfleet.operators.latest import latest_reading, ordered_series
from voltfleet.operators.periods import Moment, check_period, week_span
from voltfleet.operators.rollups import label_order, rollup, summary
from voltfleet.plans.hourly import rollup_from_hourly, summary_from_hourly

# The heading of each view, trailing and chosen.
TITLES = {
    "hour": ("Par heure - Dernières 24h", "Par heure - {date}"),
    "day": ("Par jour - 7 derniers jours", "Par jour - Semaine {week}/{year}"),
    "month": ("Par mois - 6 derniers mois", "Par mois - Sélection personnalisée"),
}


def view_title(period: str, date: str | None = None) -> str:
    check_period(period)
    trailing, chosen = TITLES[period]
    if not date:
        return trailing
    if period == "day":
        week_span(date)
        year, week = date.split("-W")
        return chosen.format(week=week, year=year)
    return chosen.format(date=date)


def dashboard(
    df: DataFrame,
    period: str = "hour",
    date: str | None = None,
    as_of: Moment | None = None,
    keys: Sequence[str] = (),
    hourly: DataFrame | None = None,
    current: DataFrame | None = None,
    mode: str = "calendar",
) -> dict[str, str | DataFrame]:
    """The title of a view and its parts, each a lazy DataFrame.

    Given the hourly table, the table, the summary and the key lists are read from it;
    given ``current``, a table of newest readings such as a stream keeps, the latest
    reading is. Only the series then touches the readings. The parts share no cached
    frame: each scans only the partitions and columns it needs. ``mode`` tells where a
    trailing view starts; an exact start must be a full hour to be read from hours.
    """
    dated = df if hourly is None else hourly
    if hourly is None:
        table = rollup(df, period, date, as_of, keys, mode)
        totals = summary(df, period, date, as_of, keys, mode)
    else:
        table = rollup_from_hourly(hourly, period, date, as_of, keys, mode)
        totals = summary_from_hourly(hourly, period, date, as_of, keys, mode)
    series = chart_series(ordered_series(df, period, date, as_of, mode), period)
    return {
        "title": view_title(period, date),
        "table": label_order(table, keys=keys),
        "summary": totals,
        "series": series.select(*keys, "label", "chart_watts_out", "chart_temp", "chart_watts_in"),
        "latest": latest_reading(df if current is None else current, keys),
        "dates": available_dates(dated),
        "weeks": available_weeks(dated),
        "months": available_months(dated),
    }
