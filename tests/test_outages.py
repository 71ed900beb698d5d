import random
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import rows_of
from voltfleet.operators import outages
from voltfleet.operators.outages import failure_runs, runs_after


def brute_force(rows, threshold=3):
    """Runs by walking through each device's polls in order."""
    runs = []
    for device in {d for d, _, _ in rows}:
        current = []
        polls = sorted((s, i, ok) for i, (d, s, ok) in enumerate(rows) if d == device)
        for s, _, ok in [*polls, (None, None, True)]:
            if not ok:
                current.append(s)
                continue
            if len(current) >= threshold:
                runs.append((device, current[0], current[-1], len(current)))
            current = []
    return sorted(runs)


def found(df):
    epoch = datetime(2023, 11, 14, 22, 13, 20)
    return sorted(
        (
            r["device_id"],
            int((r["start"] - epoch).total_seconds()),
            int((r["end"] - epoch).total_seconds()),
            r["n"],
        )
        for r in df.collect()
    )


def test_named_case(polls):
    marks = "FFSFFFFS"
    rows = [(1, i, m == "S") for i, m in enumerate(marks)]
    (run,) = failure_runs(polls(rows)).collect()
    assert run["n"] == 4 and run["alerts"] == 2


def test_hot_device_is_cut_into_slices(polls):
    rng = random.Random(3)
    rows = [
        (1 if rng.random() < 0.9 else rng.randint(2, 5), s, rng.random() < 0.3)
        for s in range(4000)
    ]
    assert found(failure_runs(polls(rows))) == brute_force(rows)


def test_a_new_setup_ends_a_run(polls):
    rows = [(1, s, False) for s in range(6)]
    setup = polls([(1, 3, True)]).drop("ok")
    assert found(failure_runs(polls(rows), resets=setup)) == [(1, 0, 2, 3), (1, 3, 5, 3)]


def test_run_over_many_slices(spark, polls):
    # One device, no success at all: a single run through every slice.
    rows = [(1, s, False) for s in range(500)] + [(2, s, True) for s in range(500)]
    assert found(failure_runs(polls(rows))) == [(1, 0, 499, 500)]


def test_equal_times_go_by_seq(polls):
    rows = [(1, 5, False), (1, 5, True), (1, 5, False), (1, 5, False)]
    assert failure_runs(polls(rows)).count() == 0
    assert found(failure_runs(polls(rows), threshold=2)) == [(1, 5, 5, 2)]


POLL = st.tuples(st.integers(1, 3), st.integers(0, 40), st.booleans())


@settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(POLL, min_size=1, max_size=60))
def test_any_order(polls, rows):
    assert found(failure_runs(polls(rows))) == brute_force(rows)


def test_runs_carry_over(polls):
    rng = random.Random(11)
    rows = [(rng.randint(1, 4), s, rng.random() < 0.4) for s in range(600)]
    closed, carried = [], None
    for part in range(6):
        batch = polls(rows).where(f"seq >= {part * 100} AND seq < {part * 100 + 100}")
        runs = runs_after(batch, carried).cache()
        closed += found(runs.where("NOT is_open"))
        carried = runs.where("is_open AND n > 0")
    closed += found(carried.where("n >= 3"))
    assert sorted(closed) == brute_force(rows)


def test_polls_without_a_time_are_left_out(polls):
    rows = [(1, 0, False), (1, None, True), (1, 1, False), (1, 2, False)]
    assert found(failure_runs(polls(rows))) == [(1, 0, 2, 3)]


def test_empty(polls):
    assert rows_of(failure_runs(polls([(1, 0, True)]).where("seq < 0"))) == []


@pytest.mark.parametrize("seconds", [60, 3600, 43_200])
def test_shorter_slices_give_the_same_runs(polls, seconds):
    rng = random.Random(seconds)
    marks = [(rng.choice([1, 2]), rng.randrange(200_000), rng.random() < 0.4) for _ in range(400)]
    df = polls(marks)
    assert rows_of(outages.failure_runs(df, seconds=seconds)) == rows_of(outages.failure_runs(df))


def test_a_slice_must_divide_the_day(polls):
    with pytest.raises(ValueError):
        outages.failure_runs(polls([(1, 1, True)]), seconds=7000)


def test_the_day_of_one_device_is_spread(spark, polls):
    df = outages.numbered(polls([(1, s * 60, False) for s in range(1000)]), ["device_id"], 3600)
    assert df.select("slice").distinct().count() == 17
