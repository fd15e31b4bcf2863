"""Scaling and calibration of raw telemetry values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailframe.functions import timeparse as P

EPOCH_2000_S = 946_684_800
_STAMP = r"^(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})\.(\d{1,6})$"


def scale_values(values: Column, scales: Column) -> Column:
    """Value over scale, element by element; null when any scale is zero."""
    scaled = F.zip_with(values, scales, lambda v, s: F.try_divide(v.cast("double"), s.cast("double")))
    return F.when(~F.exists(scales, lambda s: s == 0), scaled)


def compact_stamp_to_epoch(text: Column) -> Column:
    """Unix seconds of ``yymmddHHMMSS.sss``; null when it is not one."""
    part = lambda i: F.regexp_extract(text, _STAMP, i)
    number = lambda i: part(i).try_cast("bigint")
    year = (number(1) + F.when(number(1) < 69, 2000).otherwise(1900)).cast("string")
    day = P._days(year, part(2), part(3))
    seconds = ((day * 24 + number(4)) * 60 + number(5)) * 60 + number(6)
    micros = F.rpad(part(7), 6, "0").try_cast("bigint")
    valid = text.rlike(_STAMP) & (number(4) <= 23) & (number(5) <= 59) & (number(6) <= 61)
    return F.when(valid, (seconds * 1_000_000 + micros) / F.lit(1e6))


def five_value_point(values: Column, scales: Column) -> Column:
    """``lat, lon, alt, ground_speed`` of a five-value GPS reading."""
    scaled = scale_values(values, scales)
    at = lambda i: F.get(scaled, F.lit(i))
    point = F.struct(at(0).alias("lat"), at(1).alias("lon"), at(2).alias("alt"), at(3).alias("ground_speed"))
    return F.when(scaled.isNotNull(), point)


def nine_value_point(values: Column, scales: Column) -> Column:
    """Nine-value GPS reading: adds epoch (days and seconds since 2000), precision and fix."""
    scaled = scale_values(values, scales)
    at = lambda i: F.get(scaled, F.lit(i))
    point = F.struct(
        at(0).alias("lat"),
        at(1).alias("lon"),
        at(2).alias("alt"),
        at(3).alias("ground_speed"),
        (EPOCH_2000_S + at(5) * 86400 + at(6)).alias("epoch_time"),
        (at(7) * 100).alias("precision"),
        at(8).cast("int").alias("fix"),
    )
    return F.when(scaled.isNotNull(), point)


def calibration_matrix(matrix: Column, axes_out: Column, axes_in: Column) -> Column:
    """The matrix unless it is a mere axis swap, else one built from axis letters.

    A letter pair of equal case keeps an axis, of opposite case flips it. Null
    when neither source gives a matrix.
    """
    real = F.exists(matrix, lambda v: ~v.isin(0.0, 1.0, -1.0))
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    rows = F.transform(
        letters(axes_out),
        lambda out: F.transform(
            letters(axes_in),
            lambda in_: F.when(out == in_, 1.0).when(F.lower(out) == F.lower(in_), -1.0).otherwise(0.0),
        ),
    )
    return F.when(F.coalesce(real, F.lit(False)), matrix).otherwise(F.flatten(rows))


def calibrate(values: Column, scales: Column, matrix: Column) -> Column:
    """Rotate a reading by a square matrix (row by row), then divide by the scales.

    Zero scales count as one, and a single scale serves every axis.
    """
    size = F.size(values)
    indices = F.sequence(F.lit(0), size - 1)

    def row(y: Column) -> Column:
        terms = F.zip_with(
            F.slice(matrix, y * size + 1, size), values, lambda m, v: m.cast("double") * v.cast("double")
        )
        return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)

    rotated = F.when(matrix.isNull(), F.transform(values, lambda v: v.cast("double"))).otherwise(
        F.transform(indices, row)
    )
    known = F.coalesce(scales, F.array(F.lit(1.0)))
    safe = F.transform(known, lambda s: F.when(s == 0, 1.0).otherwise(s.cast("double")))
    return F.transform(
        rotated,
        lambda v, i: v / F.when(F.size(safe) == 1, F.get(safe, F.lit(0))).otherwise(F.get(safe, i)),
    )


def kmh_to_ms(speed: Column) -> Column:
    return speed / 3.6


def metres_to_dop100(error: Column) -> Column:
    return error * 100


def edit_to_seconds(media_time: Column, duration: Column, media_scale: Column, movie_scale: Column) -> Column:
    """Ticks to seconds; -1 marks an empty edit and stays."""
    return F.struct(
        F.when(media_time == -1, -1.0).otherwise(media_time / media_scale).alias("media_time"),
        (duration / movie_scale).alias("duration"),
    )
