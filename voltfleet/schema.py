"""Schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# The measures of a device-state document, in the order in which
# they are stored.
MEASURES = (
    "whOut",
    "whStored",
    "socPercent",
    "wattsOut",
    "ampsOut",
    "wattsIn",
    "ampsIn",
    "temperature",
    "timeToEmptyFull",
)

# Port fields of a device-state document and the name of the port.
PORTS = {"acPortStatus": "ac", "usbPortStatus": "usb", "v12PortStatus": "12v"}

# The presets (min, max, re) of the charge profile.
CHARGE_PRESETS = {"eco": (20, 85, 25), "standard": (0, 100, 95)}

# Ratings against which a reading is shown as a share.
RATINGS = {
    "socPercent": 100.0,
    "wattsOut": 2000.0,
    "wattsIn": 1500.0,
    "temperature": 60.0,
}

# The two connection modes and the address each one starts with.
HOTSPOT = "hotspot"
NETWORK = "reseau"
SEED_ADDRESS = {HOTSPOT: "10.1.1.1", NETWORK: "192.168.1.100"}

# Failed polls in a row which make an outage; length of the month list.
OUTAGE_THRESHOLD = 3
MONTH_LIST_SIZE = 6

# Fixed value: what is shown for an unknown time or an unknown time left.
UNKNOWN_LABEL = "???"
UNKNOWN_TIME_LEFT = "--:--"

# Compared as numbers: 20.0 is the preset's 20, and 20.5 is no preset.
CHARGE_PROFILE = "min DOUBLE, max DOUBLE, re DOUBLE"

# One row per successful poll. `seq` is the insert order and breaks ties between
# equal times; `log_date` is the partition column.
READINGS = T.StructType(
    [
        T.StructField("device_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("date_heure", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
        T.StructField("log_date", T.DateType()),
    ]
)
