"""Reading media listings, logs, XML and record files into tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailframe.functions import paths
from trailframe.functions import records as R
from trailframe.functions import timeparse as P
from trailframe.operators import accounting
from trailframe.operators import ordered as O
from trailframe.operators.ordered import Ordered
from trailframe.runtime import materialize, open_store


def list_files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of every visible file; contents are not read.

    Files and folders starting with a dot are hidden; Spark also hides names
    starting with an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    found = reader.load(roots).select("path", "length", F.col("modificationTime").alias("modified"))
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


def find_media(spark: SparkSession, roots: list[str], kind: str, recursive: bool = True) -> DataFrame:
    """Files of one kind (image, video, zip, xml), each resolved path once."""
    files = list_files(spark, roots, recursive).filter(paths.media_kind(F.col("path")) == kind)
    return files.dropDuplicates(["path"])


def hash_files(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """MD5 of each file's bytes.

    Files up to ``WHOLE_FILE`` bytes are hashed as one value. Longer ones are
    read block by block in the task of their row, which holds one block at a
    time: no size is too large, and bytes are never a Spark value.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(roots)
    small = files.filter(F.col("length") <= WHOLE_FILE).select("path", "length", F.md5("content").alias("md5sum"))
    large = files.filter(F.col("length") > WHOLE_FILE).select("path", "length")
    hashed = small.unionByName(large.mapInPandas(_stream_digests, "path string, length bigint, md5sum string"))
    return hashed.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))


# Bytes of a file that may be one value; Spark's own limit is 2 GB.
WHOLE_FILE = 64 << 20


def _stream_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        digests = []
        for path in batch["path"]:
            store, where = open_store(path)
            state = hashlib.md5()
            with store.open_input_stream(where, compression=None) as f:
                while block := f.read(8 << 20):
                    state.update(block)
            digests.append(state.hexdigest())
        yield batch[["path", "length"]].assign(md5sum=digests)


def read_lines(spark: SparkSession, roots: list[str] | str) -> DataFrame:
    """``file, ord, line`` of text files.

    ``ord`` rises through each file: the start of the split the line is in,
    then its place in the split.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(roots)
    return text.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place")
        ).alias("ord"),
        F.col("value").alias("line"),
    )


# -- records ------------------------------------------------------------------------------

RECORD_SCHEMA = """
    filename string, filetype string, md5sum string, filesize bigint,
    MAPLatitude double, MAPLongitude double, MAPAltitude double, MAPCaptureTime string,
    MAPCompassHeading struct<TrueHeading:double,MagneticHeading:double>,
    MAPDeviceMake string, MAPDeviceModel string, MAPGPSAccuracyMeters double, MAPCameraUUID string,
    MAPOrientation int, MAPFilename string, MAPSequenceUUID string,
    MAPGPSTrack array<array<double>>,
    error struct<type:string,message:string,vars:string>
"""


def read_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Metadata records without the error rows (JSON lines, or arrays with ``multi_line``)."""
    rows = spark.read.schema(RECORD_SCHEMA).option("multiLine", multi_line).json(path)
    return rows.filter("error IS NULL").drop("error")


def image_records(records: DataFrame) -> DataFrame:
    """Records of images as captures; invalid ones become error rows."""
    images = records.filter("filetype = 'image'").select(
        "filename", "md5sum", "filesize", "filetype",
        F.col("MAPLatitude").alias("lat"),
        F.col("MAPLongitude").alias("lon"),
        F.col("MAPAltitude").alias("alt"),
        R.parse_capture_time(F.col("MAPCaptureTime")).alias("time"),
        F.col("MAPCompassHeading.TrueHeading").alias("angle"),
        F.col("MAPDeviceMake").alias("make"),
        F.col("MAPDeviceModel").alias("model"),
        F.col("MAPCameraUUID").alias("camera_uuid"),
        F.col("MAPGPSAccuracyMeters").alias("accuracy"),
        F.col("MAPOrientation").alias("orientation"),
        F.col("MAPFilename").alias("map_filename"),
        F.col("MAPSequenceUUID").alias("sequence_id"),
        R.no_error().alias("error"),
    )
    return accounting.validate(images)


def video_records(records: DataFrame) -> DataFrame:
    """Records of videos; those that break a rule become error rows."""
    videos = records.filter("filetype <> 'image'").select(
        "filename", "md5sum", "filesize", "filetype",
        F.col("MAPDeviceMake").alias("make"), F.col("MAPDeviceModel").alias("model"),
        F.col("MAPCameraUUID").alias("camera_uuid"), F.col("MAPGPSTrack").alias("track"), R.no_error().alias("error"),
    )
    return accounting.validate_videos(videos)


def video_points(records: DataFrame) -> DataFrame:
    """Points of the video records, one row each."""
    videos = records.filter("filetype <> 'image'")
    exploded = videos.select("filename", "filetype", F.posexplode("MAPGPSTrack").alias("ord", "_p"))
    return exploded.select("filename", "filetype", "ord", R.unpack_point(F.col("_p")).alias("p")).select(
        "filename", "filetype", "ord", "p.*"
    )


# -- XML -----------------------------------------------------------------------------------

GPX_SCHEMA = """
    name string, `desc` string,
    trkseg array<struct<trkpt:array<struct<_lat:double,_lon:double,ele:double,time:string,name:string>>>>
"""


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Points of GPX files; those without a time are left out.

    ``track_no`` numbers the tracks of each file in the file's order, named or
    not, and ``segment_id`` the segments of each track. A point with an
    elevation has a three-dimensional fix.
    """
    tracks = (
        spark.read.format("xml").option("rowTag", "trk").option("recursiveFileLookup", "true")
        .schema(GPX_SCHEMA).load(path)
    )
    located = tracks.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place")
        ).alias("_at"),
        "name", "trkseg",
    )
    by_file = Window.partitionBy("file").orderBy("_at")
    numbered = located.withColumn("track_no", F.row_number().over(by_file) - 1)
    segments = numbered.select("file", "track_no", "name", F.posexplode("trkseg").alias("segment_id", "_s"))
    points = segments.select(
        "file", "track_no", "name", "segment_id", F.posexplode("_s.trkpt").alias("ord", "_p")
    )
    time = P.as_unix_time(P.parse_iso(F.col("_p.time")))
    out = points.select(
        "file", "track_no", "name", "segment_id", "ord", time.alias("time"),
        F.col("_p._lat").alias("lat"), F.col("_p._lon").alias("lon"), F.col("_p.ele").alias("alt"),
        time.alias("time_gps_epoch"),
        F.when(F.col("_p.ele").isNotNull(), 3).otherwise(2).alias("gps_fix_type"),
    )
    return out.filter("time IS NOT NULL")


_POINT_END = "</trkpt>"
# What opens a track, a segment and a point; a name or place is looked for behind the last of them.
_TRACK, _SEGMENT, _POINT = (rf"<{tag}(?:\s[^>]*)?>" for tag in ("trk", "trkseg", "trkpt"))
_MARKS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def read_gpx_points(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """What ``read_gpx`` gives, by files that are split inside their tracks.

    The files are cut behind every point, so a track of any size is read by many
    tasks, a point at a time. A point's chunk also holds what was opened before
    it; tracks, segments and points are numbered by running sums over the file's
    chunks, and a track's name goes on to the chunks behind it. Comments may not
    hold the end of a point; tags may not have a prefix.
    """
    reader = spark.read.option("lineSep", _POINT_END).option("recursiveFileLookup", "true")
    text = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    chunks = reader.text(path).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_place"), text.alias("value"),
    )
    behind = lambda mark: F.regexp_replace("value", rf"(?s)^.*{mark}", "")
    count = lambda c, mark: F.regexp_count(c, F.lit(mark)).cast("bigint")
    own, point = behind(_TRACK), behind(_POINT)
    header = F.regexp_extract(F.regexp_replace(own, rf"(?s){_SEGMENT}.*$", ""), r"(?s)<name>([^<]*)</name>", 1)
    attributes = F.regexp_extract("value", r"(?s)^.*<trkpt(\s[^>]*)>", 1)
    attribute = lambda name: F.regexp_extract(attributes, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1).try_cast("double")
    element = lambda name: F.regexp_extract(point, rf"(?s)<{name}>\s*([^<]*?)\s*</{name}>", 1)
    read = chunks.filter(F.col("value").rlike(_TRACK) | F.col("value").rlike(_SEGMENT) | F.col("value").rlike(_POINT)).select(
        "file", "_split", "_place",
        count("value", _TRACK).alias("_tracks"), count(own, _SEGMENT).alias("_segments"), count(behind(_SEGMENT), _POINT).alias("_points"),
        F.col("value").rlike(_SEGMENT).alias("_opens"), header.alias("_name"),
        attribute("lat").alias("lat"), attribute("lon").alias("lon"), element("ele").try_cast("double").alias("alt"),
        P.as_unix_time(P.parse_iso(F.nullif(element("time"), F.lit("")))).alias("time"),
    )
    # Written once: places are those of one scan.
    ordered = Ordered.of(materialize(read, "gpx-chunks"), ["file"], ["_split", "_place"], max_rows)
    starts = F.col("_tracks") > 0
    sums = ordered.scan(_t=O.running_sum(F.col("_tracks")), _s=O.running_sum(F.col("_segments")), _p=O.running_sum(F.col("_points")))
    # Numbers begin anew where a track or segment opens: take off what was counted before.
    carried = sums.scan(
        _s0=O.last_known(F.when(starts, F.col("_s") - F.col("_segments"))),
        _p0=O.last_known(F.when(F.col("_opens"), F.col("_p") - F.col("_points"))),
        name=O.last_known(F.when(starts, F.col("_name"))),
    ).rows()
    name = F.col("name")
    for mark, char in _MARKS.items():
        name = F.replace(name, F.lit(mark), F.lit(char))
    number = lambda c: (c - 1).cast("int")
    return carried.filter("time IS NOT NULL").select(
        "file", number(F.col("_t")).alias("track_no"), F.nullif(name, F.lit("")).alias("name"),
        number(F.col("_s") - F.coalesce("_s0", F.lit(0))).alias("segment_id"), number(F.col("_p") - F.coalesce("_p0", F.lit(0))).alias("ord"),
        "time", "lat", "lon", "alt", F.col("time").alias("time_gps_epoch"), F.when(F.col("alt").isNotNull(), 3).otherwise(2).alias("gps_fix_type"),
    )


_DESCRIPTION_END = "</rdf:Description>"


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Elements of tool XML files: ``source, path, ord, tag, text`` per described file.

    The files are split at the end of each description, so one file may be read
    by many tasks; a description is read by an XML parser. Of several
    descriptions of one path the last counts; elements without text of their
    own have none.
    """
    reader = spark.read.option("lineSep", _DESCRIPTION_END).option("recursiveFileLookup", "true")
    chunks = reader.text(path).filter(F.col("value").contains("<rdf:Description"))
    placed = chunks.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("source"),
        F.struct(
            F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")
        ).alias("place"),
        "value",
    )
    items = "array<struct<tag:string,text:string>>"
    found = placed.mapInArrow(
        _parse_descriptions, f"source string, place struct<split:bigint,row:bigint>, about string, items {items}"
    )
    resolved = found.filter("about <> ''").withColumn("path", paths.resolve(F.col("about")))
    last = resolved.groupBy("path").agg(F.max_by(F.struct("source", "items"), F.struct("source", "place")).alias("_r"))
    elements = last.select("path", "_r.source", F.posexplode("_r.items").alias("ord", "_e"))
    return elements.select("source", "path", "ord", F.col("_e.tag").alias("tag"), F.col("_e.text").alias("text"))


def _parse_descriptions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    items = pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))
    for batch in batches:
        parsed = [_description(text) for text in batch.column("value").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("source"), batch.column("place"), pa.array([p[0] for p in parsed], pa.string()), pa.array([p[1] for p in parsed], items)],
            ["source", "place", "about", "items"],
        )


def _description(chunk: str) -> tuple[str | None, list[dict]]:
    """What a chunk's description is about, and its elements with their own text.

    The chunk may open elements that it doesn't close, or close a comment that
    it didn't open; a chunk without a description gives None.
    """
    about: list[str | None] = [None]
    found: list[dict] = []
    open_tags: list[str] = []
    inside = [0]

    def start(name: str, attributes: dict) -> None:
        open_tags.append(name)
        if name == "rdf:Description" and not inside[0]:
            about[0], inside[0] = attributes.get("rdf:about"), len(open_tags)
            found.clear()
        elif inside[0] and len(open_tags) == inside[0] + 1:
            found.append({"tag": name, "text": ""})
        elif inside[0] and found:
            found[-1]["text"] = None  # it holds elements

    def end(name: str) -> None:
        open_tags.pop()

    def text(data: str) -> None:
        if inside[0] and len(open_tags) == inside[0] + 1 and found[-1]["text"] is not None:
            found[-1]["text"] += data

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    body = chunk.partition("-->")[2] if "-->" in chunk.partition("<!--")[0] else chunk
    try:
        parser.Parse(body.lstrip() + _DESCRIPTION_END, False)
    except expat.ExpatError:
        return None, []
    return about[0], [{"tag": e["tag"], "text": e["text"] or None} for e in found]
