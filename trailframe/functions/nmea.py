"""NMEA sentences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import timeparse as P
from trailframe.functions.binding import let, with_computed

_SENTENCE = r"(?i)^\s*\$?(\w{2}(\w{3}),([^*]*))(?:\*([A-F0-9]{2}))?\s*$"
_DEGREES = r"^(\d+)(\d\d\.\d+)$"
_CLOCK = r"^(\d{2})(\d{2})(\d{2})(\.\d+)?$"
_DAY = r"^(\d{2})(\d{2})(\d{2})$"

# A dash-cam line: [camera milliseconds]$SENTENCE, sometimes with another stamp behind.
LOG_LINE = r"^\s*\[(\d+)\]\s*(\$\w{5}.*)\s*(\[\d+\])?\s*$"

# Position of each field in the sentences that carry a position.
FIELDS = {
    "GGA": {"clock": 0, "lat": 1, "ns": 2, "lon": 3, "ew": 4, "quality": 5, "alt": 8},
    "RMC": {"clock": 0, "status": 1, "lat": 2, "ns": 3, "lon": 4, "ew": 5, "day": 8},
    "GLL": {"lat": 0, "ns": 1, "lon": 2, "ew": 3, "clock": 4, "status": 5},
}


def checksum(body: Column) -> Column:
    """Exclusive or of all characters."""
    return F.aggregate(F.split(body, ""), F.lit(0), lambda acc, c: acc.bitwiseXOR(F.ascii(c))).cast("bigint")


def _degrees(text: Column, side: Column, plus: str, minus: str) -> Column:
    dot = F.instr(text, ".")
    whole = F.substring(text, F.lit(1), dot - 3).try_cast("double")
    minutes = F.substring(text, dot - 2, F.lit(99)).try_cast("double")
    value = F.when(text.isin("", "0"), 0.0).when(text.rlike(_DEGREES), whole + minutes / 60)
    return value * F.when(side == plus, 1).when(side == minus, -1).otherwise(0)


def _clock_us(text: Column) -> Column:
    part = lambda i: F.substring(text, i, 2).try_cast("bigint")
    fraction = F.coalesce(F.substring(text, 7, 99).try_cast("double"), F.lit(0.0))
    h, m, s = part(1), part(3), part(5)
    whole = (h * 3600 + m * 60 + s) * 1_000_000 + (fraction * 1_000_000).cast("bigint")
    return F.when(text.rlike(_CLOCK) & (h <= 23) & (m <= 59) & (s <= 59), whole)


def _day(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _DAY, i)
    year = part(3).try_cast("int") + F.when(part(3).try_cast("int") < 69, 2000).otherwise(1900)
    return P._days(year.cast("string"), part(2), part(1))


def with_sentence(df: DataFrame, line: str, name: str = "s") -> DataFrame:
    """Add ``struct<type, valid, lat, lon, alt, quality, clock_us, day>`` of a sentence.

    The struct is null for a malformed sentence or a wrong checksum; its ``type``
    is null where the sentence carries no position.
    """
    # One match gives all groups; a text that doesn't match stays one part.
    groups = F.split(F.regexp_replace(F.col(line), _SENTENCE, "$1\x1f$2\x1f$3\x1f$4"), "\x1f")
    matched = with_computed(df, _groups=groups)
    part = lambda i: F.when(F.size("_groups") == 4, F.get("_groups", F.lit(i))).otherwise("")
    cut = with_computed(
        matched, _kind=F.upper(part(1)), _data=F.split(part(2), ","), _given=F.upper(part(3)), _body=part(0)
    ).drop("_groups")
    kind, data = F.col("_kind"), F.col("_data")
    expected = F.lpad(F.hex(checksum(F.col("_body"))), 2, "0")
    intact = (F.col("_body") != "") & ((F.col("_given") == "") | (expected == F.col("_given")))

    def field(name: str) -> Column:
        out = None
        for type_, places in FIELDS.items():
            if name in places:
                value = F.get(data, F.lit(places[name]))
                out = F.when(kind == type_, value) if out is None else out.when(kind == type_, value)
        return out

    names = ("clock", "lat", "ns", "lon", "ew", "status", "day", "quality", "alt")
    split = with_computed(cut, _intact=intact, **{f"_{n}": field(n) for n in names})
    quality = F.col("_quality").try_cast("int")
    valid = F.when(kind == "GGA", quality.between(1, 5)).otherwise(F.col("_status") == "A")
    parsed = F.struct(
        F.when(kind.isin(list(FIELDS)), kind).alias("type"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
        _degrees(F.col("_lat"), F.col("_ns"), "N", "S").alias("lat"),
        _degrees(F.col("_lon"), F.col("_ew"), "E", "W").alias("lon"),
        F.col("_alt").try_cast("double").alias("alt"),
        quality.alias("quality"),
        _clock_us(F.col("_clock")).alias("clock_us"),
        _day(F.col("_day")).alias("day"),
    )
    out = with_computed(split, **{name: F.when(F.col("_intact"), parsed)})
    return out.drop("_kind", "_data", "_given", "_body", "_intact", *[f"_{n}" for n in names])


def split_log_line(line: Column) -> Column:
    """``struct<epoch_s, sentence>`` of a dash-cam line, null when it is not one."""
    groups = F.split(F.regexp_replace(line, LOG_LINE, "$1\x1f$2"), "\x1f")

    def parsed(parts: Column) -> Column:
        stamp = F.get(parts, F.lit(0)).try_cast("bigint")
        found = F.struct(
            F.round(stamp / F.lit(1000.0), 3).alias("epoch_s"), F.get(parts, F.lit(1)).alias("sentence")
        )
        return F.when(F.size(parts) == 2, found)

    return let(groups, parsed)
