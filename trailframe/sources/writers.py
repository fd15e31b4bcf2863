"""Writing records, GPX, and the history and cache tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trailframe.functions import records as R
from trailframe.runtime import open_store

GPX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="trailframe">'
GPX_TAIL = "</gpx>"


def image_record(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """JSON text of a capture or error row, keys sorted, absent values and those in ``without`` left out.

    ``accuracy`` (metres), ``orientation`` and ``map_filename`` are written where
    the table has them.
    """
    heading = F.round("angle", R.ANGLE_DIGITS)
    compass = F.struct(heading.alias("MagneticHeading"), heading.alias("TrueHeading"))
    good = F.col("error").isNull()
    when_good = lambda c: F.when(good, c)
    columns = {
        "MAPAltitude": when_good(F.round("alt", R.ALTITUDE_DIGITS)),
        "MAPCameraUUID": when_good(F.col("camera_uuid")),
        "MAPCaptureTime": when_good(R.format_capture_time(F.col("time"))),
        "MAPCompassHeading": when_good(F.when(F.col("angle").isNotNull(), compass)),
        "MAPDeviceMake": when_good(F.col("make")),
        "MAPDeviceModel": when_good(F.col("model")),
        "MAPLatitude": when_good(F.round("lat", R.COORDINATE_DIGITS)),
        "MAPLongitude": when_good(F.round("lon", R.COORDINATE_DIGITS)),
        "MAPSequenceUUID": when_good(F.col("sequence_id").cast("string")),
        "error": F.col("error"),
        "filename": F.col("filename"),
        "filesize": when_good(F.col("filesize")),
        "filetype": F.lit("image"),
        "md5sum": when_good(F.col("md5sum")),
    }
    optional = {"MAPFilename": "map_filename", "MAPGPSAccuracyMeters": "accuracy", "MAPOrientation": "orientation"}
    columns.update({n: when_good(F.col(c)) for n, c in optional.items() if c in df.columns})
    return F.to_json(F.struct(*[columns[n].alias(n) for n in sorted(columns) if n not in without]))


def video_record(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """JSON text of a video or error row, keys sorted, absent values and those in ``without`` left out.

    ``points`` holds the track: ``array<struct<time,lon,lat,alt,angle,epoch>>``.
    """
    good = F.col("error").isNull()
    when_good = lambda c: F.when(good, c)
    packed = F.transform(
        "points", lambda p: R.pack_point(p["time"], p["lon"], p["lat"], p["alt"], p["angle"], p["epoch"])
    )
    columns = {
        "MAPCameraUUID": when_good(F.col("camera_uuid")),
        "MAPDeviceMake": when_good(F.col("make")),
        "MAPDeviceModel": when_good(F.col("model")),
        "MAPGPSTrack": when_good(packed),
        "error": F.col("error"),
        "filename": F.col("filename"),
        "filesize": when_good(F.col("filesize")),
        "filetype": F.col("filetype"),
        "md5sum": when_good(F.col("md5sum")),
    }
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items() if n not in without]))


def write_video_records(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.select(video_record(df).alias("value")).write.text(path)


def write_image_records(df: DataFrame, path: str) -> None:
    """One JSON record per line."""
    df.select(image_record(df).alias("value")).write.text(path)


# -- files by name ---------------------------------------------------------------------------


@dataclass
class Folder(WriterCommitMessage):
    name: str | None


class NamedTextWriter(DataSourceArrowWriter):
    """Rows ``name, value``, sorted by name: the lines of each file, one file open at a time."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A task's folder has a hidden name; only the driver's commit shows it, so a lost task leaves nothing behind to read."""
        store, where = open_store(self.path)
        folder, name, out = None, None, None
        for batch in batches:
            names, values = (batch.column(c).to_pylist() for c in ("name", "value"))
            held = np.array(names, object)
            starts = [0, *(np.flatnonzero(held[1:] != held[:-1]) + 1).tolist()] if len(names) else []
            for start, end in zip(starts, [*starts[1:], len(names)]):
                if names[start] != name:
                    if out is not None:
                        out.close()
                    name = names[start]
                    if not name or "/" in name or name[0] in "._":
                        raise ValueError(f"not the name of a visible file: {name!r}")
                    if folder is None:
                        folder = uuid.uuid4().hex
                        store.create_dir(f"{where}/.{folder}", recursive=True)
                    out = store.open_output_stream(f"{where}/.{folder}/{name}", compression=None)
                out.write("".join(f"{v or ''}\n" for v in values[start:end]).encode())
        if out is not None:
            out.close()
        return Folder(folder)

    def _folders(self, messages: list) -> list[str]:
        return [m.name for m in messages if m is not None and m.name is not None]

    def commit(self, messages: list) -> None:
        store, where = open_store(self.path)
        store.create_dir(where, recursive=True)
        for folder in self._folders(messages):
            store.move(f"{where}/.{folder}", f"{where}/{folder}")

    def abort(self, messages: list) -> None:
        store, where = open_store(self.path)
        for folder in self._folders(messages):
            store.delete_dir(f"{where}/.{folder}")


class NamedTextSource(DataSource):
    """``df.write.format("named_text")``."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return NamedTextWriter(self.options)


def write_named_files(lines: DataFrame, path: str, name: Column, order: list[str]) -> None:
    """Write ``value`` as text files named by row, lines by ``order``.

    A task puts all its files in one folder, shown by one renaming: the costs of
    a commit and of a listing are by task, and a file's own is its bytes. Files
    are streamed, never held. Names may not hold a slash or start with a dot or
    an underscore, which Spark hides.
    """
    lines.sparkSession.dataSource.register(NamedTextSource)
    named = lines.withColumn("name", name)
    arranged = named.repartition("name").sortWithinPartitions("name", *order)
    arranged.select("name", "value").write.format("named_text").mode("append").save(path)


def _escaped(text: Column) -> Column:
    for char, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def _iso(seconds: Column) -> Column:
    stamp = R.format_capture_time(seconds)
    return F.regexp_replace(stamp, r"^(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)_(\d+)$", "$1-$2-$3T$4:$5:$6.$7Z")


def _point_line(time: Column, lat: Column, lon: Column, alt: Column, name: Column, gps_epoch: Column) -> Column:
    when = F.coalesce(F.when(gps_epoch > 0, gps_epoch), time)
    return F.concat(
        F.lit('<trkpt lat="'), lat.cast("string"), F.lit('" lon="'), lon.cast("string"), F.lit('">'),
        F.coalesce(F.concat(F.lit("<ele>"), alt.cast("string"), F.lit("</ele>")), F.lit("")),
        F.lit("<time>"), _iso(when), F.lit("</time>"),
        F.coalesce(F.concat(F.lit("<name>"), _escaped(name), F.lit("</name>")), F.lit("")),
        F.lit("</trkpt>"),
    )


def gpx_lines(points: DataFrame, track: str, order: list[str], section: Column, description: Column | None = None) -> DataFrame:
    """A GPX document as text lines keyed by (section, track, place).

    ``points``: track name, time, lat, lon, alt, name, gps_epoch; the epoch, where
    there is one, is the written time. Rows with ``lat`` null only make a track
    with a description (used for errors). Each track gets a first and last line
    of its own, so no track is ever gathered.
    """
    line = _point_line(*[F.col(c) for c in ("time", "lat", "lon", "alt", "name", "gps_epoch")])
    keyed = points.withColumn("_section", section)
    place = F.struct(*[F.col(o).cast("double").alias(f"o{i}") for i, o in enumerate(order)])
    none = F.lit(None).cast(keyed.select(place.alias("p")).schema["p"].dataType)
    body = keyed.filter("lat IS NOT NULL").select(
        "_section", F.col(track).alias("_track"), F.lit(1).alias("_part"), place.alias("_place"), line.alias("value")
    )
    text = description if description is not None else F.lit(None).cast("string")
    per = keyed.groupBy("_section", F.col(track).alias("_track")).agg(F.max(text).alias("_desc"))
    desc = F.coalesce(F.concat(F.lit("<desc>"), _escaped(F.col("_desc")), F.lit("</desc>")), F.lit(""))
    opening = F.concat(F.lit("<trk><name>"), _escaped(F.col("_track")), F.lit("</name>"), desc, F.lit("<trkseg>"))
    first = per.select("_section", "_track", F.lit(0).alias("_part"), none.alias("_place"), opening.alias("value"))
    last = per.select("_section", "_track", F.lit(2).alias("_part"), none.alias("_place"), F.lit("</trkseg></trk>").alias("value"))
    return first.unionByName(body).unionByName(last)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Put the document's first and last line around a partition's lines."""
    opened = False
    for batch in batches:
        if len(batch) and not opened:
            opened = True
            yield pd.DataFrame({"value": [GPX_HEAD]})
        yield batch[["value"]]
    if opened:
        yield pd.DataFrame({"value": [GPX_TAIL]})


def write_gpx(lines: DataFrame, path: str) -> None:
    """Every part is a whole GPX document holding whole tracks in order."""
    arranged = lines.repartition("_section", "_track").sortWithinPartitions("_section", "_track", "_part", "_place")
    arranged.mapInPandas(_documents, "value string").write.text(path)


# Properties that a track's name and points say already.
SAID_BY_IMAGES = ("filename", "MAPLongitude", "MAPLatitude", "MAPCaptureTime", "MAPAltitude")
SAID_BY_VIDEOS = ("filename", "MAPGPSTrack")


def metadata_gpx_lines(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Lines of one GPX document that describes a run: ``section, track, part, place, value``.

    Section 1 has a track without points for every row with an error, 2 one for
    every image sequence, 3 one for every video, by name. A track's description
    is its record as JSON without what name and points say; a sequence's is that
    of its last image. ``images`` has the columns of ``image_record`` and
    ``basename``, ``videos`` those of ``video_record``. A track is as many rows
    as it has points: none is gathered.
    """
    none = F.lit(None).cast("struct<time:double,name:string>")

    def line(section: int, track: Column, part: int, place: Column, value: Column) -> list[Column]:
        return [F.lit(section).alias("section"), track.alias("track"), F.lit(part).alias("part"), place.alias("place"), value.alias("value")]

    def opening(name: Column, description: Column) -> Column:
        return F.concat(F.lit("<trk><name>"), _escaped(name), F.lit("</name><desc>"), _escaped(description), F.lit("</desc>"))

    def failed(rows: DataFrame, record: Column) -> DataFrame:
        whole = F.concat(opening(F.col("filename"), record), F.lit("</trk>"))
        return rows.filter("error IS NOT NULL").select(*line(1, F.col("filename"), 0, none, whole))

    def ends(section: int, tracks: DataFrame) -> list[DataFrame]:
        first = tracks.select(*line(section, F.col("track"), 0, none, F.concat(opening(F.col("track"), F.col("description")), F.lit("<trkseg>"))))
        return [first, tracks.select(*line(section, F.col("track"), 2, none, F.lit("</trkseg></trk>")))]

    placed = images.filter("error IS NULL")
    at = F.struct(F.col("time"), F.col("basename").alias("name"))
    sequence = F.col("sequence_id").cast("string")
    about = placed.groupBy(sequence.alias("track")).agg(F.max_by(image_record(placed, SAID_BY_IMAGES), at).alias("description"))
    shots = placed.select(*line(2, sequence, 1, at, _point_line(*[F.col(c) for c in ("time", "lat", "lon", "alt", "basename")], F.lit(None).cast("double"))))
    clips = videos.filter("error IS NULL")
    filed = clips.select(F.col("filename").alias("track"), video_record(clips, SAID_BY_VIDEOS).alias("description"))
    points = clips.select("filename", F.posexplode("points").alias("i", "p"))
    place = F.struct(F.col("i").cast("double").alias("time"), F.lit(None).cast("string").alias("name"))
    on_way = points.select(*line(3, F.col("filename"), 1, place, _point_line(*[F.col(f"p.{c}") for c in ("time", "lat", "lon", "alt")], F.lit(None).cast("string"), F.col("p.epoch"))))
    out = failed(images, image_record(images, ("filename",)))
    for more in (failed(videos, video_record(videos, SAID_BY_VIDEOS)), *ends(2, about), shots, *ends(3, filed), on_way):
        out = out.unionByName(more)
    return out


def write_gpx_in_parts(lines: DataFrame, path: str) -> None:
    """One document as files whose names are in the lines' order: put end to end they are the document.

    Lines are dealt by ranges, so a track of any size is spread over tasks; the
    head and the tail of the document are lines before and after all others.
    """
    none = F.lit(None)
    edges = lines.sparkSession.createDataFrame([(0, GPX_HEAD), (9, GPX_TAIL)], "section int, value string")
    edges = edges.select("section", none.cast("string").alias("track"), F.lit(0).alias("part"), none.cast(lines.schema["place"].dataType).alias("place"), "value")
    order = ["section", "track", "part", "place", "value"]
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.unionByName(edges).repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(path)


# -- tables kept between runs ----------------------------------------------------------------


def append_history(records: DataFrame, path: str, per_file: int = 1_000_000, group_bytes: int = 8 << 20) -> None:
    """Append to the history, filed by the first two digits of the fingerprint.

    A prefix is written by as many tasks as its share of ``spark.sql.shuffle.partitions``
    allows, in files of at most ``per_file`` rows. Files are sorted by fingerprint
    and hold a Bloom filter of it per row group, so that a look-up of a few
    (``find_history``) reads few row groups.
    """
    valid = records.filter(R.is_hex_digest(F.col("sequence_md5sum")))
    filed = valid.withColumn("prefix", F.substring("sequence_md5sum", 1, 2))
    writers = -(-int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 256)
    dealt = filed.repartition("prefix", F.pmod(F.xxhash64("sequence_md5sum"), F.lit(writers)))
    writer = dealt.sortWithinPartitions("prefix", "sequence_md5sum").write.mode("append").option("maxRecordsPerFile", per_file)
    # Bits for the rows that a row group may hold, by the size of a fingerprint.
    blooms = {"parquet.bloom.filter.enabled#sequence_md5sum": "true", "parquet.bloom.filter.expected.ndv#sequence_md5sum": max(1, group_bytes // 32)}
    writer.options(**{"parquet.block.size": group_bytes, **blooms}).partitionBy("prefix").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history; prefixes are text, whatever their digits look like."""
    found = spark.read.option("basePath", path).parquet(path).drop("prefix").schema
    return spark.read.schema(found.add("prefix", "string")).option("basePath", path).parquet(path)


def find_history(spark: SparkSession, path: str, digests: list[str]) -> DataFrame:
    """History rows of a few stated fingerprints.

    They reach the scan as equality, ten at a time, which row groups' statistics
    and Bloom filters answer; for a table of fingerprints see ``lookup_history``.
    """
    history = read_history(spark, path)
    out = history.filter("false")
    for at in range(0, len(digests), 10):
        own = digests[at : at + 10]
        out = out.unionByName(history.filter(F.col("prefix").isin([d[:2] for d in own]) & F.col("sequence_md5sum").isin(own)))
    return out


def lookup_history(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """History rows of the wanted fingerprints; only their partitions are read."""
    keyed = wanted.withColumn("prefix", F.substring("sequence_md5sum", 1, 2))
    return read_history(spark, path).join(keyed.select("prefix", "sequence_md5sum"), ["prefix", "sequence_md5sum"], "left_semi")
