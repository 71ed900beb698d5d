"""The connection settings of each device, folded from a log of changes.

A change is (``device_id``, ``at``, ``seq``, ``mode``, ``ip``, ``success``). Every
device has the same two modes, so one aggregation per device holds the whole state.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.operators.outages import polls_that_tell
from voltfleet.schema import HOTSPOT, NETWORK, OUTAGE_THRESHOLD, SEED_ADDRESS


def _known_mode() -> Column:
    # Whatever is not the hotspot is the home network.
    return F.when(F.col("mode") == HOTSPOT, F.lit(HOTSPOT)).otherwise(F.lit(NETWORK))


def _newest(where: Column, *values: str) -> Column:
    return F.max(F.when(where, F.struct("at", "seq", *values)))


def _states(
    changes: DataFrame, seeds: Mapping[str, str], fixed: frozenset[str] | set[str]
) -> DataFrame:
    changed = changes.where(F.col("at").isNotNull()).withColumn("mode", _known_mode())
    has_address = F.trim("ip") != ""
    folds = [_newest(F.lit(True), "mode").alias("newest")]
    for mode in seeds:
        of_mode = F.col("mode") == mode
        folds.append(_newest(of_mode, "success").alias(f"{mode}_change"))
        folds.append(_newest(of_mode & has_address, "ip").alias(f"{mode}_address"))
    folded = changed.groupBy("device_id").agg(*folds)
    rows = []
    for mode, seed in seeds.items():
        address = F.lit(seed)
        if mode not in fixed:
            address = F.coalesce(F.trim(F.col(f"{mode}_address.ip")), address)
        rows.append(
            F.struct(
                F.lit(mode).alias("mode"),
                address.alias("ip"),
                (F.col("newest.mode") == mode).alias("is_active"),
                F.coalesce(F.col(f"{mode}_change.success"), F.lit(False)).alias(
                    "last_tested_success"
                ),
                F.col(f"{mode}_change.at").alias("last_updated"),
            )
        )
    return folded.select("device_id", F.inline(F.array(*rows)))


def fold_config(
    changes: DataFrame,
    seeds: Mapping[str, str] = SEED_ADDRESS,
    fixed: frozenset[str] = frozenset({HOTSPOT}),
) -> DataFrame:
    """Both modes of every device which has a change; exactly one mode is active.

    The newest change decides which mode is active, and the newest of each mode its
    test result and time. See :func:`fold_config_ip` for the address.
    """
    return _states(changes, seeds, fixed)


def fold_config_ip(
    changes: DataFrame,
    seeds: Mapping[str, str] = SEED_ADDRESS,
    fixed: frozenset[str] = frozenset({HOTSPOT}),
) -> DataFrame:
    """The address of both modes of every device.

    A mode takes the newest address which is not blank, or its seed when it never had
    one. Modes in ``fixed`` keep the seed whatever a change says; pass an empty set to
    let every mode change.
    """
    return _states(changes, seeds, fixed).select("device_id", "mode", "ip")


def active_config(
    changes: DataFrame,
    devices: DataFrame | None = None,
    seeds: Mapping[str, str] = SEED_ADDRESS,
    fixed: frozenset[str] = frozenset({HOTSPOT}),
) -> DataFrame:
    """The active mode and address of each device.

    ``devices`` adds the devices without a change, which are on the hotspot. Both
    sides of the join hold one row per device.
    """
    active = _states(changes, seeds, fixed).where("is_active").select("device_id", "mode", "ip")
    if devices is None:
        return active
    return (
        devices.select("device_id")
        .distinct()
        .join(active, "device_id", "left")
        .select(
            "device_id",
            F.coalesce("mode", F.lit(HOTSPOT)).alias("mode"),
            F.coalesce("ip", F.lit(seeds[HOTSPOT])).alias("ip"),
        )
    )


def config_from_polls(attempts: DataFrame, threshold: int = OUTAGE_THRESHOLD) -> DataFrame:
    """The changes of settings that polls make, ready for :func:`fold_config`.

    ``attempts`` has ``device_id``, ``ts``, ``seq``, ``ok`` and the ``mode`` the poll
    went by; the polls of each mode count for themselves. Every failure from the
    ``threshold`` on marks its mode as failing, and the first success after one as
    working. The address is NULL, which keeps the one before.
    """
    told = polls_that_tell(
        attempts.withColumn("mode", _known_mode()), threshold, ("device_id", "mode")
    )
    return told.select(
        "device_id",
        F.col("ts").alias("at"),
        "seq",
        "mode",
        F.lit(None).cast("string").alias("ip"),
        (F.col("kind") == "recovery").alias("success"),
    )
