"""Media to clean sequences: the processing flow from end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.functions import paths
from trailframe.operators import accounting as B
from trailframe.operators import matching as X
from trailframe.operators import sequences as S


def located_captures(sources: list[DataFrame]) -> DataFrame:
    """Best position source per file, with the folder and base name it groups by."""
    found = X.cascade(sources, key="filename")
    return found.withColumns(
        {"folder": paths.parent(F.col("filename")), "basename": paths.basename(F.col("filename"))}
    )


def process_images(
    captures: DataFrame,
    limits: S.Limits = S.Limits(),
    reset_headings: bool = False,
    skip_zigzag: bool = False,
    make: str | None = None,
    model: str | None = None,
    offset_time: float = 0.0,
    offset_angle: float = 0.0,
    listing: DataFrame | None = None,
) -> DataFrame:
    """Sequence the located captures, finish and validate their records.

    Error rows pass through. Offsets and overrides touch good rows only.
    """
    errors = X.error_rows(captures)
    done = S.process_captures(X.good_rows(captures).drop("error"), limits, reset_headings, skip_zigzag)
    good = X.good_rows(done)
    finished = B.apply_offsets(B.override_device(good, make, model), offset_time, offset_angle)
    checked = B.validate(finished)
    if listing is not None:
        checked = B.require_files(checked, listing)
    rejected = X.error_rows(done)
    out = checked.unionByName(rejected, allowMissingColumns=True).unionByName(errors, allowMissingColumns=True)
    return out.withColumn("filetype", F.lit("image"))


def process_media(
    captures: DataFrame, videos: DataFrame, points: DataFrame, limits: S.Limits = S.Limits(), **options
) -> DataFrame:
    """Images and videos together: ``filename, filetype, filesize, sequence_id, error``."""
    images = process_images(captures, limits, **options)
    checked = S.check_videos(videos, points, "filename", ["time", "ord"], limits)
    columns = ["filename", "filetype", "filesize", "error"]
    return images.select(*columns, "sequence_id").unionByName(
        checked.select(*columns), allowMissingColumns=True
    )


def conservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in against good and error rows out, as one row."""
    tagged = before.select(F.lit(1).alias("_in"), F.lit(0).alias("_good"), F.lit(0).alias("_bad")).unionByName(
        after.select(
            F.lit(0).alias("_in"),
            F.col("error").isNull().cast("int").alias("_good"),
            F.col("error").isNotNull().cast("int").alias("_bad"),
        )
    )
    return tagged.agg(
        F.sum("_in").alias("rows_in"), F.sum("_good").alias("rows_good"), F.sum("_bad").alias("rows_bad")
    )


