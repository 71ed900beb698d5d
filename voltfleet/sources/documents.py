"""Device-state documents: JSON text in, typed columns out.

A payload is parsed once, as a variant, which keeps absent fields apart from explicit nulls.
It is parsed as the first element of a list with a mark behind it: a payload that holds
more than one document pushes the mark away from its place. The few which the variant
parser refuses but which count as documents, such as ones with NaN or with a field given
twice, are read in a second, slower way.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.schema import CHARGE_PROFILE, MEASURES, PORTS

_FIELDS = "_fields"
_MARK = "end of the document"

_NAMES = (*MEASURES, *PORTS, "chargeProfile")
_KNOWN = ", ".join(f"{name} string" for name in _NAMES)


def _variant(payload: Column) -> Column:
    """The payload and the mark as a variant; NULL where that is no JSON."""
    marked = F.concat(F.lit("["), payload, F.lit(f',"{_MARK}"]'))
    return F.try_parse_json(F.when(~F.contains(payload, F.lit(_MARK)), marked))


def _is_one(variant: Column, payload: Column) -> Column:
    """Whether the mark stands right behind one value, which begins as an object."""
    mark = F.try_variant_get(variant, "$[1]", "string")
    is_object = F.ltrim(payload, F.lit(" \t\n\r")).startswith("{")
    return F.coalesce((mark == _MARK) & is_object, F.lit(False))


def _read_slowly(payload: Column) -> Column:
    """Texts and names of the known fields by the lenient parser; NULL for no document."""
    is_object = payload.rlike(r"(?s)^\s*\{.*\}\s*$")
    marked = F.concat(F.lit("["), payload, F.lit(f',{{"{_MARK}":1}}]'))
    both = F.from_json(marked, "array<map<string,string>>")
    first, last = (F.map_keys(F.get(both, F.lit(k))) for k in (0, 1))
    one = is_object & (F.size(both) == 2) & F.array_contains(last, _MARK)
    found = F.struct(F.from_json(payload, _KNOWN).alias("texts"), first.alias("names"))
    return F.when(one & ~F.contains(payload, F.lit(_MARK)), found)


def state_keys(payload: Column) -> Column:
    """True where the payload is one JSON object, else NULL."""
    variant = _variant(payload)
    slow = F.when(variant.isNull(), _read_slowly(payload).isNotNull())
    return F.when(F.coalesce(slow, _is_one(variant, payload)), True)


def parsed_states(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """The rows with a readable payload, and its fields: their texts and names.

    Exploding one variant keeps it as a column: a plain projection would be folded into
    what reads it, and each field would parse the payload again.
    """
    payload, variant = F.col(json_col), F.col("_v")
    once = raw.select("*", F.explode(F.array(_variant(payload))).alias("_v"))
    slow = F.explode(F.array(F.when(variant.isNull(), _read_slowly(payload))))
    kept = once.where(variant.isNull() | _is_one(variant, payload)).select("*", slow.alias("_slow"))
    quick = F.try_variant_get(variant, "$[0]", f"struct<{_KNOWN}>")
    fields = F.struct(
        F.coalesce(quick, "_slow.texts").alias("texts"),
        variant.alias("document"),
        F.col("_slow.names").alias("names"),
    )
    readable = variant.isNotNull() | F.col("_slow").isNotNull()
    return kept.where(readable).select(*raw.columns, fields.alias(_FIELDS))


def _number(text: Column) -> Column:
    # try_cast, since a plain cast of a bad number fails the job in ANSI mode.
    truth = F.when(text == "true", 1.0).when(text == "false", 0.0)
    return F.nanvl(F.coalesce(text.try_cast("double"), truth), F.lit(None))


def fields_or_zero(df: DataFrame, names: Iterable[str], fields: str = _FIELDS) -> DataFrame:
    """Add numeric fields: 0 when absent, NULL when null or not a number.

    The texts are taken in a projection of their own.
    """
    texts = df.withColumns({n: F.col(f"{fields}.texts.{n}") for n in names})

    def absent(name: str) -> Column:
        given = F.try_variant_get(f"{fields}.document", f"$[0].{name}", "variant").isNotNull()
        return ~F.coalesce(F.array_contains(F.col(f"{fields}.names"), name), given)

    return texts.withColumns(
        {
            n: F.when(F.col(n).isNotNull(), _number(F.col(n))).when(absent(n), 0.0)
            for n in names
        }
    )


def default_missing(df: DataFrame, fields: str = _FIELDS) -> DataFrame:
    """Turn the fields of a readable document into the nine measures."""
    return fields_or_zero(df, MEASURES, fields)


def corrupt_states(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """The rows which :func:`read_state` leaves out, for a quarantine table."""
    return raw.where(state_keys(F.col(json_col)).isNull())


def count_states(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """How many payloads are readable and how many are corrupt."""
    readable = state_keys(F.col(json_col)).isNotNull()
    return raw.select(readable.alias("readable")).agg(
        F.count_if("readable").alias("n_readable"),
        F.count_if(~F.col("readable")).alias("n_corrupt"),
    )


def read_state(raw: DataFrame, json_col: str = "payload", ts_col: str = "ts") -> DataFrame:
    """Device-state documents as readings.

    Works on a batch and on a stream. Corrupt payloads are left out before absent
    fields become 0, or each of them would read as a row of zeros.
    """
    ts = F.col(ts_col).cast("timestamp_ntz")
    seq = F.col("seq") if "seq" in raw.columns else F.lit(None).cast("bigint")
    return default_missing(parsed_states(raw, json_col)).select(
        "device_id",
        seq.alias("seq"),
        F.translate(ts.cast("string"), " ", "T").alias("date_heure"),
        ts.alias("ts"),
        *MEASURES,
        F.to_date(ts).alias("log_date"),
    )


def port_states(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """Status (0 when absent) and on/off flag of the three ports."""
    ports = fields_or_zero(parsed_states(raw, json_col), PORTS)
    columns = []
    for field, port in PORTS.items():
        status = F.col(field).cast("int")
        columns.append(status.alias(port))
        columns.append(F.coalesce(status != 0, F.lit(False)).alias(f"{port}_on"))
    return ports.select(*raw.columns, *columns)


def charge_profile(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """The members of the nested charge profile; a missing one is NULL."""
    text = F.col(f"{_FIELDS}.texts.chargeProfile")
    return (
        parsed_states(raw, json_col)
        .withColumn("_profile", F.from_json(text, CHARGE_PROFILE))
        .select(*raw.columns, "_profile.min", "_profile.max", "_profile.re")
    )


def poll_success(attempts: DataFrame, rule: str = "dashboard", out: str = "ok") -> DataFrame:
    """Flag each poll attempt.

    ``dashboard``: the device answered with status 200. ``logger``: whatever the
    status, the answer was a JSON document.
    """
    if rule == "dashboard":
        flag = F.col("status_code") == 200
    elif rule == "logger":
        flag = state_keys(F.col("payload")).isNotNull()
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return attempts.withColumn(out, F.coalesce(flag, F.lit(False)))
