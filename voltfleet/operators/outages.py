"""Runs of failed polls.

Numbering the polls of a device in order of time would put all of them into one
task. Instead a device is cut into days, by one shuffle on device and date; runs are found
within each day, and only the two open ends of a day are joined up across days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltfleet.schema import OUTAGE_THRESHOLD


_BEFORE_ALL = -(2**31)  # the slice of runs which are carried in


DAY = 86_400  # seconds


def _slice(seconds: int) -> Column:
    """The number of a time's slice, in order of time; slices lie within days."""
    if seconds == DAY:
        return F.unix_date(F.to_date("ts"))
    if DAY % seconds:
        raise ValueError("a day must hold a whole number of slices")
    of_day = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return (F.unix_date(F.to_date("ts")) * (DAY // seconds) + F.floor(of_day / seconds)).cast("int")


def numbered(attempts: DataFrame, keys: Sequence[str], seconds: int = DAY) -> DataFrame:
    """The polls by slices of so many seconds, days by default, with the number of successes so far in the day
    (``stretch``) and in the whole day (``last_stretch``).

    Stretch k holds the k-th success of the slice and the failures after it; stretch 0
    holds the failures before the first success.
    """
    sliced = (
        attempts.where(F.col("ts").isNotNull())
        .select(*keys, "ts", "seq", "ok")
        .withColumn("slice", _slice(seconds))
    )
    in_slice = Window.partitionBy(*keys, "slice")
    success = F.col("ok").cast("long")
    return sliced.withColumn(
        "stretch", F.sum(success).over(in_slice.orderBy("ts", "seq"))
    ).withColumn("last_stretch", F.sum(success).over(in_slice))


def stretches(attempts: DataFrame, keys: Sequence[str], seconds: int = DAY) -> DataFrame:
    """The failures of each stretch: their number, and the first and last of them."""
    failed_at = F.when(~F.col("ok"), F.col("ts"))
    return numbered(attempts, keys, seconds).groupBy(*keys, "slice", "stretch", "last_stretch").agg(
        F.count(failed_at).alias("n"),
        F.min(failed_at).alias("start"),
        F.max(failed_at).alias("end"),
    )


def runs_after(
    attempts: DataFrame,
    open_runs: DataFrame | None = None,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
    seconds: int = DAY,
) -> DataFrame:
    """Runs in ``attempts`` which follow the runs in ``open_runs``.

    Gives every run of at least ``threshold`` failures and, marked ``is_open``, the
    run which each key is in at the end, however short; its length is 0 when the last
    poll was a success. ``open_runs`` has keys, ``start``, ``end`` and ``n``.
    """
    return runs_of_stretches(stretches(attempts, keys, seconds), open_runs, threshold, keys)


def runs_of_stretches(
    parts: DataFrame,
    open_runs: DataFrame | None = None,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
) -> DataFrame:
    """The runs of :func:`runs_after` from :func:`stretches`.

    Of the inner stretches of a day, those shorter than ``threshold`` may be left out.
    """
    # A stretch with a success on either side is complete and keeps a place of its
    # own. The first and last of each slice share the place NULL, where a stretch
    # which holds a success opens a new run and stretch 0 carries on the one before.
    inner = (F.col("stretch") > 0) & (F.col("stretch") < F.col("last_stretch"))
    placed = (
        parts.where(~inner | (F.col("n") >= threshold))
        .withColumn("place", F.when(inner, F.struct("slice", "stretch")))
        .drop("last_stretch")
    )
    if open_runs is not None:
        carried = open_runs.select(*keys, "start", "end", "n").withColumns(
            {"slice": F.lit(_BEFORE_ALL), "stretch": F.lit(0).cast("bigint")}
        )
        placed = placed.unionByName(carried, allowMissingColumns=True)
    in_place = Window.partitionBy(*keys, "place")
    opens = (F.col("stretch") > 0).cast("long")
    return (
        placed.withColumn("run", F.sum(opens).over(in_place.orderBy("slice", "stretch")))
        .withColumn("last_run", F.sum(opens).over(in_place))
        .groupBy(*keys, "place", "run", "last_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
        .withColumn("is_open", F.col("place").isNull() & (F.col("run") == F.col("last_run")))
        .where(F.col("is_open") | (F.col("n") >= threshold))
        .select(*keys, "start", "end", "n", "is_open")
    )


def failure_runs(
    attempts: DataFrame,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
    resets: DataFrame | None = None,
    seconds: int = DAY,
) -> DataFrame:
    """Runs of at least ``threshold`` failed polls in a row: keys, ``start``, ``end``, ``n``.

    ``alerts`` counts the failures from the threshold on, each of which raises one.
    Needs ``ts``, ``seq`` (breaks ties) and ``ok``. A poll without a time has no place
    in the order and is left out. ``resets`` (keys, ``ts``, ``seq``) are times at which
    the connection was set up anew, which ends a run as a success does.

    The polls of a key and slice of ``seconds`` are summed up by one task to the run which
    goes on from before, the one which goes on after, and those in between; slices are then
    joined up in order. Shorter slices spread the day of a device with very many polls.
    """
    if resets is not None:
        anew = resets.select(*keys, "ts", "seq", F.lit(True).alias("ok"))
        attempts = attempts.select(*keys, "ts", "seq", "ok").unionByName(anew)
    return (
        runs_after(attempts, None, threshold, keys, seconds)
        .where(F.col("n") >= threshold)
        .select(*keys, "start", "end", "n", (F.col("n") - (threshold - 1)).alias("alerts"))
    )


def carried(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per day the failures in a row just before it, from the stretches of all days.

    A day's last stretch goes on into the next days up to one with a success.
    """
    ends = parts.where(F.col("stretch") == F.col("last_stretch"))
    days = Window.partitionBy(*keys).orderBy("slice")
    broken = F.sum((F.col("last_stretch") > 0).cast("long")).over(days)
    in_row = Window.partitionBy(*keys, "broken").orderBy("slice")
    ends = ends.withColumn("broken", broken).withColumns(
        {"open_n": F.sum("n").over(in_row), "open_start": F.min("start").over(in_row),
         "open_end": F.max("end").over(in_row)}
    )
    return ends.select(
        *keys,
        "slice",
        F.coalesce(F.lag("open_n").over(days), F.lit(0)).alias("carried"),
        F.lag("open_start").over(days).alias("carried_start"),
        F.lag("open_end").over(days).alias("carried_end"),
    )


def outage_events(
    attempts: DataFrame,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
) -> DataFrame:
    """``alert`` and ``recovery`` events: keys, ``kind``, ``ts``, ``start``, ``end``, ``n``."""
    return polls_that_tell(attempts, threshold, keys).drop("seq")


def polls_that_tell(
    attempts: DataFrame,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
) -> DataFrame:
    """The events with the ``seq`` of their poll.

    Every failure from the threshold on is an alert, and the first success after one a
    recovery; both tell the start, end and length of the run up to then.
    """
    polls = numbered(attempts, keys).join(
        carried(stretches(attempts, keys), keys), [*keys, "slice"]
    )
    in_stretch = Window.partitionBy(*keys, "slice", "stretch").orderBy("ts", "seq")
    failed_at = F.when(~F.col("ok"), F.col("ts"))
    goes_on = (F.col("stretch") == 0) & (F.col("carried") > 0)
    first = F.min(failed_at).over(in_stretch)
    states = polls.withColumns(
        {
            "run_n": F.count(failed_at).over(in_stretch)
            + F.when(goes_on, F.col("carried")).otherwise(0),
            "run_start": F.when(goes_on, F.col("carried_start")).otherwise(first),
        }
    )
    in_day = Window.partitionBy(*keys, "slice").orderBy("ts", "seq")
    is_first = F.row_number().over(in_day) == 1

    def before(name: str, carried: str):
        return F.when(is_first, F.col(carried)).otherwise(F.lag(name).over(in_day))

    told = states.withColumns(
        {
            "was_n": before("run_n", "carried"),
            "was_start": before("run_start", "carried_start"),
            "was_end": before("ts", "carried_end"),
        }
    )
    alert = ~F.col("ok") & (F.col("run_n") >= threshold)
    recovery = F.col("ok") & (F.col("was_n") >= threshold)
    return told.where(alert | recovery).select(
        *keys,
        F.when(alert, "alert").otherwise("recovery").alias("kind"),
        "ts",
        "seq",
        F.when(alert, F.col("run_start")).otherwise(F.col("was_start")).alias("start"),
        F.when(alert, F.col("ts")).otherwise(F.col("was_end")).alias("end"),
        F.when(alert, F.col("run_n")).otherwise(F.col("was_n")).alias("n"),
    )


#: What :func:`day_states` keeps of a day besides its key.
STATE = (
    "kind string, stretch bigint, last_stretch bigint, ts timestamp_ntz, seq bigint, "
    "start timestamp_ntz, end timestamp_ntz, n bigint"
)


def day_states(
    attempts: DataFrame,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
) -> DataFrame:
    """What has to be kept of each day to tell its outages without its polls.

    Rows of kind ``stretch`` are those that :func:`runs_of_stretches` needs. ``alert`` and
    ``recovery`` are events which the day settles alone. ``head`` are the failures before the
    first success and ``first`` is that success: whether they tell depends on the
    failures carried into the day. One sort by day makes all of them.
    """
    in_day = Window.partitionBy(*keys, "slice").orderBy("ts", "seq")
    in_stretch = Window.partitionBy(*keys, "slice", "stretch").orderBy("ts", "seq")
    failed_at = F.when(~F.col("ok"), F.col("ts"))
    polls = numbered(attempts, keys).withColumns(
        {"run_n": F.count(failed_at).over(in_stretch), "run_start": F.min(failed_at).over(in_stretch)}
    )
    polls = polls.withColumns(
        {
            "was_n": F.coalesce(F.lag("run_n").over(in_day), F.lit(0)),
            "was_start": F.lag("run_start").over(in_day),
            "was_end": F.lag(failed_at).over(in_day),
            "run_end": F.max(failed_at).over(in_stretch),
            "is_last": ~F.col("stretch").eqNullSafe(F.lead("stretch").over(in_day)),
        }
    )
    ok, stretch, is_long = F.col("ok"), F.col("stretch"), F.col("run_n") >= threshold
    ends = (stretch == 0) | (stretch == F.col("last_stretch"))
    event = (
        F.when(~ok & (stretch == 0), "head")
        .when(~ok & is_long, "alert")
        .when(ok & (stretch == 1), "first")
        .when(ok & (F.col("was_n") >= threshold), "recovery")
    )

    def told(kind, prefix: str):
        columns = [F.col(f"{prefix}_{name}").alias(name) for name in ("start", "end", "n")]
        return F.struct(kind.alias("kind"), *columns)

    found = F.array(
        F.when(F.col("is_last") & (ends | is_long), told(F.lit("stretch"), "run")),
        F.when(event.isin("head", "alert"), told(event, "run")),
        F.when(event.isin("first", "recovery"), told(event, "was")),
    )
    each = polls.select(
        *keys, "slice", "stretch", "last_stretch", "ts", "seq",
        F.explode(F.array_compact(found)).alias("e"),
    )
    return each.select(
        *keys, "slice", "e.kind", "stretch", "last_stretch", "ts", "seq",
        "e.start", "e.end", "e.n",
    )


def events_of_states(
    states: DataFrame,
    parts: DataFrame,
    threshold: int = OUTAGE_THRESHOLD,
    keys: Sequence[str] = ("device_id",),
) -> DataFrame:
    """The events in ``states``, some days of :func:`day_states`.

    ``parts`` are the stretches of all days, which carry runs over to the next ones;
    ``threshold`` is not less than the one of the states.
    """
    open_ = states.where(F.col("kind").isin("head", "first")).join(
        carried(parts, keys), [*keys, "slice"], "left"
    )
    before = F.coalesce(F.col("carried"), F.lit(0))
    whole = open_.withColumns(
        {
            "n": F.col("n") + before,
            "start": F.when(before > 0, F.col("carried_start")).otherwise(F.col("start")),
            "end": F.coalesce("end", "carried_end"),
            "kind": F.when(F.col("kind") == "head", "alert").otherwise("recovery"),
        }
    )
    shown = [*keys, "kind", "ts", "start", "end", "n"]
    settled = states.where(F.col("kind").isin("alert", "recovery"))
    both = settled.select(*shown).unionByName(whole.select(*shown))
    return both.where(F.col("n") >= threshold)
