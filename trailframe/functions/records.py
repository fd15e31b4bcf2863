"""Record-level Column helpers: error structs, capture times, packed points, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR_TYPE = "struct<type:string,message:string,vars:map<string,string>>"

# Error names carried in ``error.type``.
GEOTAGGING = "GeoTaggingError"
VIDEO_GPS_NOT_FOUND = "VideoGPSNotFoundError"
TOOL_NOT_FOUND = "ExiftoolNotFoundError"
TOOL_XML_NOT_FOUND = "ExifToolXMLNotFoundError"
INVALID_VIDEO = "InvalidVideoError"
GPX_EMPTY = "GPXEmptyError"
GPS_NOISE = "GPSNoiseError"
STATIONARY_VIDEO = "StationaryVideoError"
OUTSIDE_TRACK = "OutsideGPXTrackError"
DUPLICATION = "DuplicationError"
FILE_TOO_LARGE = "FileTooLargeError"
TOO_FAST = "CaptureSpeedTooFastError"
NULL_ISLAND = "NullIslandError"
ZIGZAG = "ZigZagError"
VALIDATION = "MetadataValidationError"

# Errors that let the next position source try.
RETRYABLE = [GEOTAGGING, VIDEO_GPS_NOT_FOUND, TOOL_NOT_FOUND, TOOL_XML_NOT_FOUND]

# Decimal places kept in written records.
COORDINATE_DIGITS = 7
ALTITUDE_DIGITS = 3
ANGLE_DIGITS = 3


def error(type_: str, message: Column | str, **variables: Column) -> Column:
    """Error struct ``<type, message, vars>``; variables are kept as text."""
    text = F.lit(message) if isinstance(message, str) else message
    if variables:
        entries = [part for k, v in variables.items() for part in (F.lit(k), v.cast("string"))]
        extra = F.create_map(*entries)
    else:
        extra = F.lit(None).cast("map<string,string>")
    return F.struct(
        F.lit(type_).alias("type"), text.alias("message"), extra.alias("vars")
    ).cast(ERROR_TYPE)


def no_error() -> Column:
    return F.lit(None).cast(ERROR_TYPE)


def is_retryable(err: Column) -> Column:
    return F.coalesce(err["type"].isin(RETRYABLE), F.lit(False))


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("bigint"))


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def format_capture_time(seconds: Column) -> Column:
    """``YYYY_MM_DD_HH_MM_SS_mmm`` in UTC, milliseconds cut, in any session zone."""
    us = F.round(seconds * 1_000_000).cast("bigint")
    whole = F.floor(us / 1_000_000)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(whole / 86400).cast("int"))
    left = F.pmod(whole, F.lit(86400))
    millis = F.floor(F.pmod(us, F.lit(1_000_000)) / 1000)
    return F.concat_ws(
        "_",
        F.date_format(day, "yyyy_MM_dd"),
        _digits(F.floor(left / 3600), 2),
        _digits(F.floor(F.pmod(left, F.lit(3600)) / 60), 2),
        _digits(F.pmod(left, F.lit(60)), 2),
        _digits(millis, 3),
    )


def parse_capture_time(text: Column) -> Column:
    """Unix seconds of a capture-time text; null when it is not one."""
    pattern = r"^(\d{4})_(\d{1,2})_(\d{1,2})_(\d{1,2})_(\d{1,2})_(\d{1,2})_(\d{1,6})$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    number = lambda i: part(i).try_cast("int")
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date")
    h, m, s = number(4), number(5), number(6)
    fraction = F.rpad(part(7), 6, "0").try_cast("bigint")
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint")
    total = ((days * 24 + h) * 60 + m) * 60 + s
    valid = (h <= 23) & (m <= 59) & (s <= 61)
    return F.when(valid, (total * 1_000_000 + fraction) / F.lit(1e6))


def pack_point(
    time: Column, lon: Column, lat: Column, alt: Column, angle: Column, epoch: Column
) -> Column:
    """``[ms, lon, lat, alt, angle, epoch]`` as written to the metadata table."""
    return F.array(
        (time * 1000).cast("bigint").cast("double"),
        F.round(lon, COORDINATE_DIGITS),
        F.round(lat, COORDINATE_DIGITS),
        F.round(alt, ALTITUDE_DIGITS),
        F.round(angle, ANGLE_DIGITS),
        epoch,
    )


def unpack_point(entry: Column) -> Column:
    """Inverse of ``pack_point``; a sixth value makes it a full GPS record."""
    epoch = F.get(entry, F.lit(5))
    alt = F.get(entry, F.lit(3))
    return F.struct(
        (F.get(entry, F.lit(0)) / 1000).alias("time"),
        F.get(entry, F.lit(1)).alias("lon"),
        F.get(entry, F.lit(2)).alias("lat"),
        alt.alias("alt"),
        F.get(entry, F.lit(4)).alias("angle"),
        epoch.alias("gps_epoch"),
        F.when(epoch.isNotNull(), F.when(alt.isNotNull(), 3).otherwise(2)).alias("fix"),
        F.when(epoch.isNotNull(), "gps").otherwise("point").alias("point_kind"),
    )


def normalize_point(
    epoch: Column, fix: Column, alt: Column
) -> Column:
    """Kind of telemetry record a point is stored as, with its fix type."""
    full = F.coalesce(epoch > 0, F.lit(False))
    default_fix = F.when(alt.isNotNull(), 3).otherwise(2)
    return F.struct(
        F.when(full, "gps").otherwise("mini_gps").alias("point_kind"),
        F.when(full, epoch).alias("time_gps_epoch"),
        F.when(full, F.coalesce(fix, default_fix)).alias("gps_fix_type"),
    )


def content_key(md5sum: Column, filetype: Column, prefix: str, suffixes: dict[str, str]) -> Column:
    """Content-addressed session key ``prefix + md5 + suffix-of-type``."""
    pairs = F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])
    return F.concat(F.lit(prefix), md5sum, F.coalesce(pairs[filetype], F.lit("")))


# Suffix of a session key per file type.
KEY_SUFFIXES = {
    "zip": ".zip",
    "camm": ".mp4",
    "blackvue": ".mp4",
    "image": ".jpg",
    "video": ".mp4",
    "gopro": ".mp4",
}


def is_hex_digest(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-fA-F]{4,}$"), F.lit(False))
