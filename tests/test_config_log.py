import pytest
from pyspark.sql import functions as F

from voltfleet.operators import config_log
from voltfleet.schema import SEED_ADDRESS


@pytest.fixture(scope="module")
def changes(spark):
    rows = [
        (1, "2024-01-01 00:00:00", 1, "hotspot", "9.9.9.9", True),
        (1, "2024-01-02 00:00:00", 2, "reseau", "192.168.1.7", False),
        (1, "2024-01-03 00:00:00", 3, "reseau", "  ", True),
        (2, "2024-01-03 00:00:00", 5, "hotspot", "", True),
        (2, "2024-01-03 00:00:00", 4, "reseau", None, True),
        (3, "2024-01-03 00:00:00", 6, "network", "192.168.1.8", None),
        (4, None, 7, "reseau", "192.168.1.9", True),
    ]
    df = spark.createDataFrame(
        rows, "device_id long, at string, seq long, mode string, ip string, success boolean"
    )
    return df.withColumn("at", df["at"].cast("timestamp_ntz"))


def test_one_mode_is_active(changes):
    state = config_log.fold_config(changes).collect()
    got = {(r["device_id"], r["mode"]): r for r in state}
    assert len(got) == 6
    assert {k for k, r in got.items() if r["is_active"]} == {
        (1, "reseau"),
        (2, "hotspot"),
        (3, "reseau"),
    }
    assert got[1, "reseau"]["last_tested_success"] is True
    assert str(got[1, "hotspot"]["last_updated"]) == "2024-01-01 00:00:00"
    assert got[3, "hotspot"]["last_updated"] is None
    assert got[3, "hotspot"]["last_tested_success"] is False


def test_a_blank_address_keeps_the_old(changes):
    got = {(r[0], r[1]): r[2] for r in config_log.fold_config_ip(changes).collect()}
    assert got[1, "reseau"] == "192.168.1.7"
    assert got[2, "reseau"] == SEED_ADDRESS["reseau"]
    assert got[3, "reseau"] == "192.168.1.8"
    assert got[1, "hotspot"] == SEED_ADDRESS["hotspot"]
    free = config_log.fold_config_ip(changes, fixed=frozenset())
    assert {(r[0], r[1]): r[2] for r in free.collect()}[1, "hotspot"] == "9.9.9.9"


def test_fallback_for_devices_without_a_change(spark, changes):
    devices = spark.createDataFrame([(1,), (1,), (4,), (9,)], "device_id long")
    got = {r[0]: (r[1], r[2]) for r in config_log.active_config(changes, devices).collect()}
    assert got == {
        1: ("reseau", "192.168.1.7"),
        4: ("hotspot", "10.1.1.1"),
        9: ("hotspot", "10.1.1.1"),
    }
    assert config_log.active_config(changes).count() == 3


def test_polls_mark_a_mode_as_failing_and_working(polls):
    asked = polls(
        [(1, s, s == 5) for s in range(6)]
        + [(2, s, False) for s in range(4)]
        + [(3, 0, False), (3, 1, False), (3, 2, True)]
    ).withColumn("mode", F.when(F.col("device_id") == 2, "hotspot").otherwise("home"))
    changes = config_log.config_from_polls(asked)
    told = [(r["device_id"], r["seq"], r["success"]) for r in changes.collect()]
    assert sorted(told) == [(1, 2, False), (1, 3, False), (1, 4, False), (1, 5, True), (2, 8, False), (2, 9, False)]
    state = config_log.fold_config(changes).where("is_active").collect()
    assert {r["device_id"]: (r["mode"], r["ip"], r["last_tested_success"]) for r in state} == {
        1: ("reseau", SEED_ADDRESS["reseau"], True),
        2: ("hotspot", SEED_ADDRESS["hotspot"], False),
    }
