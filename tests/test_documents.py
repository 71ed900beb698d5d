import json

from tests.conftest import rows_of
from voltfleet.functions.display import classify_profile
from voltfleet.schema import MEASURES
from voltfleet.sources import documents, tables


def raw(spark, payloads):
    rows = [(1, i, p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "device_id long, seq long, payload string")
    return df.selectExpr("*", "timestamp_ntz'2024-01-15 10:00:00' AS ts", "200 AS status_code")


def test_absent_is_zero_and_null_stays_null(spark):
    df = documents.read_state(
        raw(spark, ["{}", '{"wattsOut":null}', '{"wattsOut":12.5,"whOut":3}', "bad", None])
    )
    got = {r["seq"]: r for r in df.collect()}
    assert set(got) == {0, 1, 2}
    assert all(got[0][m] == 0.0 for m in MEASURES)
    assert got[1]["wattsOut"] is None and got[1]["wattsIn"] == 0.0
    assert got[2]["wattsOut"] == 12.5 and got[2]["whOut"] == 3.0


def test_odd_values(spark):
    payload = '{"wattsOut":"7.5","wattsIn":"much","whOut":true,"ampsIn":NaN,"ampsOut":[1]}'
    row = documents.read_state(raw(spark, [payload])).first()
    assert row["wattsOut"] == 7.5 and row["whOut"] == 1.0
    assert row["wattsIn"] is None and row["ampsIn"] is None and row["ampsOut"] is None


def test_only_objects_are_documents(spark):
    texts = ["{}", " {\n} ", "[]", '[{"a":1}]', "5", "null", '{"a":1', '{"a":1} tail', "", None]
    df = raw(spark, texts)
    assert documents.count_states(df).first().asDict() == {"n_readable": 2, "n_corrupt": 8}
    assert documents.corrupt_states(df).count() == 8
    ok = documents.poll_success(df, "logger").orderBy("seq").collect()
    assert [r["ok"] for r in ok] == [True, True] + [False] * 8


def test_ports(spark):
    df = documents.port_states(raw(spark, ["{}", '{"acPortStatus":1,"usbPortStatus":null}', "bad"]))
    got = rows_of(df.select("ac", "ac_on", "usb", "usb_on", "12v", "12v_on"))
    assert got == [(0, False, 0, False, 0, False), (1, True, None, False, 0, False)]


def test_charge_profile(spark):
    texts = [
        '{"chargeProfile":{"min":20,"max":85,"re":25}}',
        '{"chargeProfile":{"min":20,"max":null}}',
        '{"chargeProfile":null}',
        "{}",
    ]
    df = documents.charge_profile(raw(spark, texts)).orderBy("seq")
    got = [tuple(r) for r in df.select("min", "max", "re").collect()]
    assert got == [(20, 85, 25), (20, None, None), (None, None, None), (None, None, None)]


def test_profile_members_are_compared_as_numbers(spark):
    members = [("20.0", "85", "25"), ("20.5", "85", "25"), ("0", "1e2", "95.0")]
    texts = [f'{{"chargeProfile":{{"min":{a},"max":{b},"re":{c}}}}}' for a, b, c in members]
    df = classify_profile(documents.charge_profile(raw(spark, texts))).orderBy("seq")
    assert [r["profile"] for r in df.collect()] == ["eco", "custom", "standard"]


def test_a_second_document_makes_a_payload_corrupt(spark):
    texts = ['{"wattsOut":1} {"wattsOut":2}', '{"wattsOut":1},{"wattsOut":2}', '{"wattsOut":1}']
    df = raw(spark, texts)
    assert documents.count_states(df).first().asDict() == {"n_readable": 1, "n_corrupt": 2}
    assert [r["ok"] for r in documents.poll_success(df, "logger").orderBy("seq").collect()] == [
        False, False, True
    ]


def test_the_last_of_a_field_given_twice_counts(spark):
    row = documents.read_state(raw(spark, ['{"wattsOut":1,"whOut":5,"wattsOut":2}'])).first()
    assert row["wattsOut"] == 2.0 and row["whOut"] == 5.0 and row["wattsIn"] == 0.0


def test_brackets_that_close_the_list_do_not_hide_a_second_document(spark):
    texts = [
        '{"wattsOut":1}],[{"wattsOut":2}', '{"a":NaN}],[{"wattsOut":2}', '{"a":1,"a":2}],[{}',
        '{"a":"end of the document"}', '{"a":"]"}', '{"a":[{"b":"}],[{"}]}',
    ]
    df = raw(spark, texts)
    assert [r["seq"] for r in documents.read_state(df).orderBy("seq").collect()] == [4, 5]
    assert [r["seq"] for r in documents.corrupt_states(df).orderBy("seq").collect()] == [0, 1, 2, 3]


def test_a_payload_is_parsed_once(spark):
    plan = documents.read_state(raw(spark, ["{}"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_poll_rules(spark):
    df = spark.createDataFrame(
        [(200, "bad"), (503, "{}"), (200, "{}"), (None, None)], "status_code int, payload string"
    )
    dashboard = [r["ok"] for r in documents.poll_success(df, "dashboard").collect()]
    logger = [r["ok"] for r in documents.poll_success(df, "logger").collect()]
    assert dashboard == [True, False, True, False]
    assert logger == [False, True, True, False]


def test_export_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a long, b double")
    assert json.loads(tables.export_json(df).first()["json"]) == {"a": 1, "b": None}


def test_append_and_read(spark, readings, tmp_path):
    path = str(tmp_path / "t")
    rows = [{"t": "2024-01-15T10:00:00", "wattsOut": 5}, {"t": None}, {"t": "2024-01-16T00:00:00"}]
    tables.append_readings(readings(rows), path)
    # Columns go by name, whatever their order.
    more = readings([{"t": "2024-01-16T01:00:00", "seq": 9}])
    tables.append_readings(more.select(*reversed(more.columns)), path)
    back = tables.read_logs(spark, path)
    assert back.count() == 4
    assert back.where("log_date IS NULL").count() == 1
    assert back.where("seq = 9").first()["date_heure"] == "2024-01-16T01:00:00"


def test_rejected_times(readings):
    df = readings([{"t": "2024-01-15T10:00:00+02:00"}, {"t": "2024-01-15T10:00:00"}, {"t": None}])
    assert [r["seq"] for r in tables.rejected_times(df).collect()] == [0]


def test_write_json(spark, tmp_path):
    path = str(tmp_path / "j")
    tables.write_json(spark.range(3), path)
    assert sorted(json.loads(r[0])["id"] for r in spark.read.text(path).collect()) == [0, 1, 2]
