"""Validation, summaries, and the bookkeeping around uploads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import records as R
from trailframe.operators import ordered as O
from trailframe.operators.fold import stream_sorted
from trailframe.operators.ordered import Ordered
from trailframe.runtime import freeze

# Rows of one sequence gathered into a single value (text of a few hundred kilobytes).
MAX_GATHERED = 20_000
CACHE_TTL_S = 3600 * 24 * 2

CAPTURE_TIME = r"[0-9]{4}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]{2}_[0-9]+"
SEQUENCE_ID = r"[a-zA-Z0-9_-]+"


# -- finishing records --------------------------------------------------------------


def override_device(df: DataFrame, make: str | None = None, model: str | None = None) -> DataFrame:
    """Given make and model replace the read ones; the base name is added."""
    out = df.withColumn("basename", F.regexp_extract("filename", r"([^/]*)$", 1))
    if make is not None:
        out = out.withColumn("make", F.lit(make))
    if model is not None:
        out = out.withColumn("model", F.lit(model))
    return out


def apply_offsets(df: DataFrame, time: float = 0.0, angle: float = 0.0) -> DataFrame:
    """Shift times and headings; a missing heading becomes 0 before the shift."""
    turned = F.pmod(F.coalesce(F.col("angle"), F.lit(0.0)) + angle, F.lit(360.0))
    return df.withColumns({"time": F.col("time") + time, "angle": turned})


def validate(df: DataFrame) -> DataFrame:
    """First broken rule per record as its error; earlier errors stay."""
    taken = R.format_capture_time(F.col("time"))
    rules = [
        (F.col("lat").isNull(), "'MAPLatitude' is a required property"),
        (F.col("lon").isNull(), "'MAPLongitude' is a required property"),
        (F.col("time").isNull(), "'MAPCaptureTime' is a required property"),
        (F.col("lat") < -90, "MAPLatitude is less than the minimum of -90"),
        (F.col("lat") > 90, "MAPLatitude is greater than the maximum of 90"),
        (F.col("lon") < -180, "MAPLongitude is less than the minimum of -180"),
        (F.col("lon") > 180, "MAPLongitude is greater than the maximum of 180"),
        (~taken.rlike(CAPTURE_TIME), "MAPCaptureTime does not match its pattern"),
        (~F.col("sequence_id").cast("string").rlike(SEQUENCE_ID), "MAPSequenceUUID does not match its pattern"),
    ]
    broken = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in rules])
    failed = F.when(broken.isNotNull(), R.error(R.VALIDATION, broken))
    return df.withColumn("error", F.coalesce(F.col("error"), failed))


VIDEO_TYPES = ("video", "camm", "gopro", "blackvue")


def validate_videos(df: DataFrame) -> DataFrame:
    """First broken rule per video as its error; earlier errors stay.

    ``track`` holds packed points: time, longitude and latitude must be there,
    then altitude, heading and epoch, where any may be null.
    """
    short = F.exists("track", lambda p: F.coalesce(F.size(p) < 5, F.lit(True)) | (F.size(p) > 6))
    bare = F.exists("track", lambda p: F.exists(F.slice(p, 1, 3), lambda v: v.isNull() | F.isnan(v)))
    off = F.exists(
        "track", lambda p: (F.abs(F.get(p, F.lit(1))) > 180) | (F.abs(F.get(p, F.lit(2))) > 90)
    )
    rules = [
        (F.col("filename").isNull(), "'filename' is a required property"),
        (~F.col("filetype").isin(*VIDEO_TYPES) | F.col("filetype").isNull(), "filetype is not one of the video types"),
        (F.col("track").isNull(), "'MAPGPSTrack' is a required property"),
        (short, "MAPGPSTrack has a point without five or six values"),
        (bare, "MAPGPSTrack has a point without time or place"),
        (off, "MAPGPSTrack has a point off the globe"),
    ]
    broken = F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in rules])
    failed = F.when(broken.isNotNull(), R.error(R.VALIDATION, broken))
    return df.withColumn("error", F.coalesce(F.col("error"), failed))


def require_files(df: DataFrame, listing: DataFrame) -> DataFrame:
    """Records without an existing file become error rows."""
    here = listing.select(F.col("path").alias("filename"), F.lit(True).alias("_here")).distinct()
    joined = df.join(here, "filename", "left")
    missing = R.error(R.VALIDATION, F.concat(F.lit("No such file "), F.col("filename")))
    lost = F.when(F.col("_here").isNull(), missing)
    return joined.withColumn("error", F.coalesce(F.col("error"), lost)).drop("_here")


def fill_sequence_id(df: DataFrame, run_id: str) -> DataFrame:
    """All records without a sequence share one id, fixed for the run."""
    return df.withColumn("sequence_id", F.coalesce(F.col("sequence_id").cast("string"), F.lit(run_id)))


def raise_on_errors(df: DataFrame, skipped: tuple[str, ...] = (R.DUPLICATION,), skip_all: bool = False) -> None:
    """Fail the job when there are errors beyond the skipped types."""
    critical = critical_errors(df, skipped, skip_all).count()
    if critical:
        raise RuntimeError(f"Failed to process {critical} files")


def critical_errors(df: DataFrame, skipped: tuple[str, ...] = (R.DUPLICATION,), skip_all: bool = False) -> DataFrame:
    if skip_all:
        return df.limit(0)
    return df.filter(F.col("error").isNotNull() & ~F.col("error.type").isin(list(skipped)))


# -- summaries -----------------------------------------------------------------------


def process_summary(df: DataFrame) -> DataFrame:
    """Counts and bytes per file type (``error_type`` null, ``level`` 1) and error type."""
    typed = df.select(
        "filetype", F.coalesce("error.type", F.lit("ok")).alias("error_type"),
        F.coalesce("filesize", F.lit(0)).cast("bigint").alias("_bytes"), F.col("error").isNull().alias("_good"),
    )
    rolled = typed.rollup("filetype", "error_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_good").cast("bigint")).alias("n_good"),
        F.sum("_bytes").alias("bytes"),
        F.grouping_id().cast("bigint").alias("level"),
    )
    return rolled.filter("level < 3")


def _mb(bytes_: Column) -> Column:
    return bytes_ / F.lit(1024.0 * 1024.0)


def upload_summary(stats: DataFrame) -> DataFrame:
    """Totals over all uploads: images, sequences, megabytes, speed, time."""
    sent = F.col("entity_size") - F.coalesce("upload_first_offset", F.lit(0))
    total = stats.agg(
        F.coalesce(F.sum(F.coalesce("sequence_image_count", F.lit(0))), F.lit(0)).alias("images"),
        F.count(F.lit(1)).alias("sequences"),
        F.coalesce(_mb(F.sum("entity_size")), F.lit(0.0)).alias("_size"),
        F.coalesce(_mb(F.sum(sent)), F.lit(0.0)).alias("_sent"),
        F.coalesce(F.sum("upload_total_time"), F.lit(0.0)).alias("_time"),
    )
    speed = F.coalesce(F.try_divide(F.col("_sent"), F.col("_time")), F.lit(0.0))
    return total.select(
        "images",
        "sequences",
        F.round("_size", 4).alias("size"),
        F.round("_sent", 4).alias("uploaded_size"),
        F.round(speed, 4).alias("speed"),
        F.round("_time", 4).alias("time"),
    )


def upload_counts(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """Uploads per file type and failures per error type."""
    done = stats.groupBy(F.coalesce("file_type", F.lit("unknown")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    failed = errors.groupBy(F.col("error_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return done.withColumn("what", F.lit("uploaded")).unionByName(failed.withColumn("what", F.lit("failed")))


def upload_timing(events: DataFrame, key: str, max_rows: int | None = None) -> DataFrame:
    """Active time and first offset of each upload from its events.

    The clock runs from a start or an offset fetch to the next retry or end;
    later openings restart it, and after a retry it waits for the next opening.
    """
    opens = F.col("event").isin("upload_start", "upload_fetch_offset")
    closes = F.col("event").isin("upload_retrying", "upload_end")
    turn = F.when(opens | (F.col("event") == "upload_retrying"), F.struct(opens.alias("open"), F.col("at").alias("at")))
    rows = Ordered.of(events, [key], ["at", "ord"], max_rows).scan(_last=O.last_known(turn, current=False))
    active = F.when(closes & F.col("_last.open"), F.col("at") - F.col("_last.at"))
    started = F.max(F.col("event") == "upload_start")
    fetched = F.min(F.when(F.col("event") == "upload_fetch_offset", F.col("offset")))
    return rows.df.groupBy(key).agg(
        F.coalesce(F.sum(active), F.lit(0.0)).alias("upload_total_time"),
        F.when(started, F.least(F.coalesce(fetched, F.lit(0)), F.lit(0))).otherwise(fetched).alias("upload_first_offset"),
    )


# -- sequences to upload ----------------------------------------------------------------


def latest_per_file(images: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last record of each file within its sequence."""
    rest = [c for c in images.columns if c not in keys and c != "filename"]
    last = F.max_by(F.struct(*rest), order)
    return images.groupBy(*keys, "filename").agg(last.alias("_r")).select(*keys, "filename", "_r.*")


def payloads(images: DataFrame, key: str) -> DataFrame:
    """Image count and bytes of each sequence."""
    return images.groupBy(key).agg(
        F.count(F.lit(1)).alias("sequence_image_count"),
        F.sum(F.coalesce("filesize", F.lit(0))).cast("bigint").alias("entity_size"),
    )


def _digest(key: str, digests: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            for k, text in zip(batch[key], batch[digests]):
                if state is None or k != current:
                    if state is not None:
                        yield pd.DataFrame({key: [current], "sequence_md5sum": [state.hexdigest()]})
                    current, state = k, hashlib.md5()
                if text is not None:
                    state.update(text.encode())
        if state is not None:
            yield pd.DataFrame({key: [current], "sequence_md5sum": [state.hexdigest()]})

    return run


def fingerprints(images: DataFrame, key: str, order: list[str], max_rows: int | None = None) -> DataFrame:
    """MD5 over the members' digests in order; members without a digest add nothing.

    Sequences of usual length are joined and hashed in one expression. Each
    longer one streams through a running digest, which holds no more than its
    state: a digest can only be taken in order. Both ways give equal results.
    """
    limit = max_rows or MAX_GATHERED
    slim = images.select(key, *order, "md5sum")
    sizes = slim.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = freeze(sizes.filter(F.col("_n") > limit).select(key))
    if long_keys.isEmpty():
        return _gathered_digests(slim, key, order)
    usual = O.join_keys(slim, long_keys, [key], "left_anti")
    long = O.join_keys(slim, long_keys, [key], "left_semi")
    key_type = images.schema[key].dataType.simpleString()
    streamed = stream_sorted(long, [key], order, _digest(key, "md5sum"), f"`{key}` {key_type}, sequence_md5sum string")
    return _gathered_digests(usual, key, order).unionByName(streamed)


def _gathered_digests(slim: DataFrame, key: str, order: list[str]) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(*order, "md5sum")))
    text = F.array_join(F.transform(ordered, lambda r: r["md5sum"]), "")
    return slim.groupBy(key).agg(F.md5(text.cast("binary")).alias("sequence_md5sum"))


def manifest_rows(images: DataFrame, key: str, order: list[str], max_rows: int | None = None) -> DataFrame:
    """Handles of each sequence, numbered in order, for any length."""
    rows = Ordered.of(images, [key], order, max_rows).scan(position=O.index())
    return rows.rows().select(key, (F.col("position") - 1).alias("position"), "handle")


def manifests(images: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One JSON manifest per sequence, whatever its length.

    A manifest is one text by definition, so its handles meet in one value;
    ``manifest_rows`` lists them without gathering.
    """
    handles = F.transform(F.sort_array(F.collect_list(F.struct(*order, "handle"))), lambda r: r["handle"])
    body = F.struct(
        handles.alias("image_handles"), F.lit("images").alias("upload_type"), F.lit("1").alias("version")
    )
    return images.groupBy(key).agg(F.count(F.lit(1)).alias("n_images"), F.to_json(body).alias("manifest"))


def not_uploaded(sequences: DataFrame, history: DataFrame, reupload: bool = False) -> DataFrame:
    """Sequences to upload; ``already`` tells which are in the history."""
    seen = history.select("sequence_md5sum", F.lit(True).alias("_seen")).distinct()
    flagged = sequences.join(seen, "sequence_md5sum", "left")
    flagged = flagged.withColumn("already", F.coalesce("_seen", F.lit(False))).drop("_seen")
    return flagged if reupload else flagged.filter(~F.col("already"))


# -- cache and history ---------------------------------------------------------------------


def is_expired(expires_at: Column, now: float | Column) -> Column:
    """Expired at its very second; an entry without expiry never is."""
    return F.coalesce(expires_at <= now, F.lit(False))


def cache_get(wanted: DataFrame, cache: DataFrame, now: float | Column) -> DataFrame:
    """Adds the cached ``value`` where the key is present and alive."""
    alive = cache.filter(~is_expired(F.col("expires_at"), now if isinstance(now, Column) else F.lit(now)))
    return wanted.join(alive.select("key", "value"), "key", "left")


def cache_set(cache: DataFrame, entries: DataFrame, now: float, ttl: float = CACHE_TTL_S) -> DataFrame:
    """Cache with new entries in; the last write of a key wins."""
    fresh = entries.select("key", "value", F.lit(now + ttl).alias("expires_at"), (F.col("ord") + 1).alias("_w"))
    merged = cache.select("key", "value", "expires_at", F.lit(0).cast("bigint").alias("_w")).unionByName(fresh)
    last = F.max_by(F.struct("value", "expires_at"), "_w")
    return merged.groupBy("key").agg(last.alias("_e")).select("key", "_e.*")


def cache_clear_expired(cache: DataFrame, now: float) -> DataFrame:
    return cache.filter(~is_expired(F.col("expires_at"), F.lit(now)))


def history_records(
    stats: DataFrame, images: DataFrame, params: dict[str, str], order: list[str], nofinish: bool = False
) -> DataFrame:
    """Rows to append to the history, one per record of each finished upload.

    ``position`` numbers a sequence's records in order (a finished upload
    without records has one row). Nothing is written for unfinished runs.
    """
    done = stats.filter(F.col("finished"))
    if nofinish:
        done = done.limit(0)
    ranked = Ordered.of(images, ["sequence_id"], order).scan(position=O.index()).rows()
    record = F.to_json(F.struct("filename", "lat", "lon", "time"))
    descs = ranked.select("sequence_id", "position", record.alias("desc"))
    run = F.to_json(F.create_map(*[F.lit(x) for kv in sorted(params.items()) for x in kv]))
    summary = F.to_json(F.struct("file_type", "entity_size", "upload_total_time"))
    out = done.select("sequence_md5sum", "sequence_id", run.alias("params"), summary.alias("summary"))
    return out.join(descs, "sequence_id", "left").drop("sequence_id")
