"""Datetime and coordinate texts as Column expressions.

A parsed datetime is ``struct<local_us, offset_s>``: wall-clock microseconds
since 1970 and the zone offset in seconds, null where the text names none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions.binding import let

DATETIME = "struct<local_us:bigint,offset_s:double>"
DAY_S = 86400

_ISO = (
    r"^(\d{4})-(\d{2})-(\d{2})"
    r"(?:[\s\S](\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
)
_DATE = r"^(\d{4})([:-])(\d{1,2})\2(\d{1,2})$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _whole(text: Column) -> Column:
    return F.when(text.rlike(_INTEGER), F.trim(text).try_cast("bigint"))


def _number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def _days(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a civil date; null when there is no such date."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.datediff(text.try_cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")


def _made(local_us: Column, offset_s: Column) -> Column:
    made = F.struct(local_us.cast("bigint").alias("local_us"), offset_s.cast("double").alias("offset_s"))
    return let(made.cast(DATETIME), lambda d: F.when(d["local_us"].isNotNull(), d))


def _micros(seconds: Column) -> Column:
    return F.round(seconds * 1_000_000).cast("bigint")


def duration(text: Column) -> Column:
    """Seconds in ``h[:m[:s]]``; null when it is no such text."""

    def read(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        hours = _whole(part(0)) * 3600.0
        minutes = F.when(F.size(parts) > 1, _whole(part(1)) * 60).otherwise(0)
        seconds = F.when(F.size(parts) > 2, _number(part(2))).otherwise(0.0)
        return F.round(hours + minutes + seconds, 6)

    return let(F.split(F.trim(text), ":"), read)


def ratio(value: Column) -> Column:
    """``struct<num,den>`` as a double; null for a zero denominator."""
    return F.try_divide(value["num"].cast("double"), value["den"].cast("double"))


def ratio_duration(values: Column) -> Column:
    """Seconds in three rationals (hours, minutes, seconds), fractions kept."""
    h, m, s = (ratio(F.get(values, F.lit(i))) for i in range(3))
    return h * 3600 + m * 60 + s


def dms_to_decimal(values: Column) -> Column:
    """Degrees from three rationals (degrees, minutes, seconds)."""
    d, m, s = (ratio(F.get(values, F.lit(i))) for i in range(3))
    return d + m / 60 + s / 3600


def parse_ratios(text: Column) -> Column:
    """``"41/1, 30/1"`` to an array of ``struct<num,den>``; bare numbers get denominator 1."""

    def one(item: Column) -> Column:
        halves = F.split(F.trim(item), "/")
        return F.struct(
            F.get(halves, F.lit(0)).try_cast("bigint").alias("num"),
            F.coalesce(F.get(halves, F.lit(1)), F.lit("1")).try_cast("bigint").alias("den"),
        )

    return F.transform(F.split(text, ","), one)


def parse_iso(text: Column) -> Column:
    """ISO 8601 date or datetime with an optional zone."""
    return let(text, _parse_iso)


def _parse_iso(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, _ISO, i)
    # Digits or nothing, as the pattern has it: nothing counts as zero.
    digits_of = lambda c: F.concat(F.lit("0"), c).try_cast("bigint")
    number = lambda i: digits_of(part(i))

    def read(p: Column) -> Column:
        micros = F.rpad(F.substring(part(7), 1, 6), 6, "0").try_cast("bigint")
        seconds = _days(part(1), part(2), part(3)) * DAY_S + p["h"] * 3600 + p["m"] * 60 + p["s"]
        digits = F.regexp_replace(p["zone"], "[^0-9]", "")
        two = lambda i: digits_of(F.substring(digits, i, 2))
        size = two(1) * 3600 + two(3) * 60 + two(5)
        sign = F.when(p["zone"].startswith("-"), -1).otherwise(1)
        offset = F.when(p["zone"] == "Z", 0).when(p["zone"] != "", sign * size)
        fits = (p["h"] <= 23) & (p["m"] <= 59) & (p["s"] <= 59)
        return F.when(fits, _made(seconds * 1_000_000 + F.coalesce(micros, F.lit(0)), offset))

    names = {"h": number(4), "m": number(5), "s": number(6), "zone": part(8)}
    return F.when(text.rlike(_ISO), let(F.struct(*[c.alias(n) for n, c in names.items()]), read))


def parse_date(text: Column) -> Column:
    """Days since 1970 of ``Y:m:d`` or ``Y-m-d``."""

    def read(clean: Column) -> Column:
        part = lambda i: F.regexp_extract(clean, _DATE, i)
        return F.when(clean.rlike(_DATE), _days(part(1), part(3), part(4)))

    return let(F.trim(text), read)


def with_default_zone(parsed: Column, offset_s: float | None) -> Column:
    if offset_s is None:
        return parsed
    zone = F.lit(float(offset_s))
    return let(parsed, lambda d: _made(d["local_us"], F.coalesce(d["offset_s"], zone)))


def parse_gps_parts(date: Column, time: Column, default_offset_s: float | None = 0.0) -> Column:
    """Date stamp and time stamp, the time with an optional ``Z`` or offset.

    The time is added to the date, so 24:00:00 is the next day's midnight.
    """

    def split(clock: Column) -> Column:
        plus, minus = F.instr(clock, "+"), F.instr(clock, "-")
        sign_at = F.when(plus > 0, plus).otherwise(minus)
        is_utc = clock.endswith("Z")
        cut = F.when(is_utc, F.length(clock)).when(sign_at > 0, sign_at).otherwise(F.length(clock) + 1)
        body = clock.substr(F.lit(1), cut - 1)
        zone = F.when(is_utc, "Z").when(sign_at > 0, clock.substr(sign_at, F.length(clock)))
        return F.struct(body.alias("body"), zone.alias("zone"))

    def read(parts: Column) -> Column:
        zone = parts["zone"]
        shift = duration(zone.substr(F.lit(2), F.length(zone)))
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        offset = F.when(zone == "Z", F.lit(0.0)).when(zone.isNotNull(), sign * shift)
        local = parse_date(date) * (DAY_S * 1_000_000) + _micros(duration(parts["body"]))
        made = _made(local, offset)
        valid = lambda d: d["offset_s"].isNull() | (F.abs(d["offset_s"]) < DAY_S)
        return let(made, lambda d: F.when(valid(d), d))

    return with_default_zone(let(let(F.trim(time), split), read), default_offset_s)


def parse_gps_datetime(text: Column, default_offset_s: float | None = 0.0) -> Column:
    """ISO, or date and time apart by whitespace (anything after is ignored)."""

    def read(clean: Column) -> Column:
        words = F.split(clean, r"\s+")
        apart = parse_gps_parts(F.get(words, F.lit(0)), F.get(words, F.lit(1)), default_offset_s)
        return F.coalesce(with_default_zone(parse_iso(clean), default_offset_s), apart)

    return let(F.trim(text), read)


def first_datetime(text: Column, parsers) -> Column:
    """First of several parsers that understands the text."""
    return let(text, lambda t: F.coalesce(*[parse(t) for parse in parsers]))


def normalize_offset(seconds: Column) -> Column:
    """Fold a zone offset into (-24 h, 24 h), keeping its sign."""
    whole_day = F.lit(float(DAY_S))
    return let(
        seconds,
        lambda s: F.when(s >= DAY_S, F.pmod(s, whole_day))
        .when(s <= -DAY_S, -F.pmod(-s, whole_day))
        .otherwise(s),
    )


def parse_camera_datetime(text: Column, subsec: Column | None = None, offset: Column | None = None) -> Column:
    """Camera datetime with separate sub-second digits and zone offset.

    Only the leading digits of the sub-second text count, as a fraction.
    """
    micros = zone = F.lit(None)
    if subsec is not None:
        digits = F.regexp_extract(F.trim(subsec), r"^(\d+)", 1)
        micros = let(digits, lambda d: F.when(d != "", F.rpad(F.substring(d, 1, 6), 6, "0").try_cast("bigint")))
    if offset is not None:
        zone = let(F.trim(offset), _signed_duration)

    def read(d: Column) -> Column:
        second = d["local_us"] - F.pmod(d["local_us"], F.lit(1_000_000))
        return _made(F.coalesce(second + micros, d["local_us"]), F.coalesce(normalize_offset(zone), d["offset_s"]))

    return let(parse_gps_datetime(text, default_offset_s=None), read)


def _signed_duration(text: Column) -> Column:
    size = duration(F.regexp_replace(text, r"^[+-]", ""))
    return size * F.when(text.startswith("-"), -1).otherwise(1)


def as_unix_time(parsed: Column) -> Column:
    """Unix seconds; a text without a zone is read as UTC.

    A zone-less time in the year 1, which some systems cannot place, keeps its
    date and clock but in 1970.
    """
    year_two = -62_104_060_800_000_000

    def read(d: Column) -> Column:
        us = d["local_us"] - _micros(F.coalesce(d["offset_s"], F.lit(0.0)))
        in_1970 = d["local_us"] + 62_135_596_800_000_000
        early = d["offset_s"].isNull() & (d["local_us"] < year_two)
        return F.when(early, in_1970 / F.lit(1e6)).otherwise(us / F.lit(1e6))

    return let(parsed, read)


# Sign of a coordinate per hemisphere.
HEMISPHERE = {"N": 1, "S": -1, "E": 1, "W": -1}
_ADOBE = r"^(\d+),(\d{1,3}\.?\d*)([NSWE])"


def _sign(ref: Column) -> Column:
    out = F.when(ref.isNull(), 1)
    for name, sign in HEMISPHERE.items():
        out = out.when(ref == name, sign)
    return out


def parse_coordinate(text: Column, ref: Column) -> Column:
    """Plain number with its hemisphere, else ``degrees,minutes[NSEW]``."""

    def read(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, _ADOBE, i)
        minutes = part(1).try_cast("double") + part(2).try_cast("double") / 60
        adobe = F.when(t.rlike(_ADOBE), minutes * _sign(part(3)))
        return F.coalesce(_number(t) * _sign(ref), adobe)

    return let(text, read)


def since_1904(seconds: Column) -> Column:
    """Unix seconds of a count of seconds since 1904-01-01."""
    return seconds - 2_082_844_800
