"""Reading capture properties out of tag tables.

``tags`` is a ``MAP<string, array<string>>`` from tag name to its texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import records as R
from trailframe.functions import timeparse as P
from trailframe.functions.binding import let, with_computed

TAG_MAP = "map<string,array<string>>"


@dataclass(frozen=True)
class Vocabulary:
    """Tag names per property, in order of preference."""

    make: list[str]
    model: list[str]
    width: list[str]
    height: list[str]
    orientation: list[str]
    direction: list[str]
    altitude: list[str]
    altitude_ref: list[str]
    lon_lat: list[tuple[str, str]]
    gps_times: list[tuple[list[str], list[str]]]
    camera_times: list[tuple[list[str], list[str], list[str]]]
    body_serial: list[str]
    lens_serial: list[str]
    rational: bool = False
    compact_coordinates: bool = False


# Tag names written by an external tag tool.
TOOL_TAGS = Vocabulary(
    make=["IFD0:Make", "IFD1:Make", "ExifIFD:Make", "ExifIFD:LensMake", "XMP-exif:Make", "XMP-exifEX:LensMake"],
    model=[
        "IFD0:Model", "IFD1:Model", "ExifIFD:Model", "GoPro:Model", "ExifIFD:LensModel",
        "XMP-exif:Model", "XMP-exifEX:LensModel",
    ],
    width=[
        "File:ImageWidth", "ExifIFD:ExifImageWidth", "IFD0:ExifImageWidth", "IFD1:ExifImageWidth",
        "XMP-exif:ExifImageWidth",
    ],
    height=[
        "File:ImageHeight", "ExifIFD:ExifImageHeight", "IFD0:ExifImageHeight", "IFD1:ExifImageHeight",
        "XMP-exif:ExifImageHeight",
    ],
    orientation=[
        "ExifIFD:Orientation", "IFD0:Orientation", "IFD1:Orientation", "XMP-exif:Orientation", "XMP-tiff:Orientation",
    ],
    direction=["GPS:GPSImgDirection", "GPS:GPSTrack"],
    altitude=["GPS:GPSAltitude"],
    altitude_ref=["GPS:GPSAltitudeRef"],
    lon_lat=[
        ("GPS:GPSLongitude", "GPS:GPSLatitude"),
        ("Composite:GPSLongitude", "Composite:GPSLatitude"),
        ("XMP-exif:GPSLongitude", "XMP-exif:GPSLatitude"),
    ],
    gps_times=[
        (["GPS:GPSDateStamp"], ["GPS:GPSTimeStamp"]),
        (["XMP-exif:GPSDateStamp"], ["XMP-exif:GPSDateTime", "XMP-exif:GPSTimeStamp"]),
    ],
    camera_times=[
        (["ExifIFD:DateTimeOriginal"], ["ExifIFD:SubSecTimeOriginal"], ["ExifIFD:OffsetTimeOriginal"]),
        (["ExifIFD:CreateDate"], ["ExifIFD:SubSecTimeDigitized"], ["ExifIFD:OffsetTimeDigitized"]),
        (["ExifIFD:ModifyDate", "IFD0:ModifyDate", "IFD1:ModifyDate"], ["ExifIFD:SubSecTime"], ["ExifIFD:OffsetTime"]),
        (["XMP-exif:DateTimeOriginal"], ["XMP-exif:SubsecTimeOriginal"], ["XMP-exif:OffsetTimeOriginal"]),
        (
            ["XMP-exif:DateTimeDigitized", "XMP-xmp:CreateDate"],
            ["XMP-exif:SubsecTimeDigitized"],
            ["XMP-exif:OffsetTimeDigitized"],
        ),
        (["XMP-exif:ModifyDate"], ["XMP-exif:SubsecTime"], ["XMP-exif:OffsetTime"]),
    ],
    body_serial=[
        "ExifIFD:BodySerialNumber", "ExifIFD:SerialNumber", "IFD0:CameraSerialNumber", "IFD0:SerialNumber",
        "Canon:SerialNumber", "Canon:InternalSerialNumber", "DJI:SerialNumber", "XMP-drone-dji:CameraSerialNumber",
        "XMP-drone-dji:DroneSerialNumber", "FLIR:CameraSerialNumber", "FujiFilm:InternalSerialNumber",
        "GoPro:CameraSerialNumber", "Kodak:SerialNumber", "Leica:SerialNumber", "Leica:InternalSerialNumber",
        "Nikon:SerialNumber", "Olympus:SerialNumber", "Olympus:InternalSerialNumber", "Panasonic:InternalSerialNumber",
        "Pentax:SerialNumber", "Pentax:InternalSerialNumber", "Ricoh:SerialNumber", "Ricoh:InternalSerialNumber",
        "Ricoh:BodySerialNumber", "Sigma:SerialNumber", "Sony:InternalSerialNumber", "XMP-exif:SerialNumber",
        "XMP-exif:BodySerialNumber", "XMP-exifEX:SerialNumber", "XMP-exif:CameraSerialNumber",
        "XMP-exifEX:BodySerialNumber", "XMP-aux:SerialNumber",
    ],
    lens_serial=[
        "ExifIFD:LensSerialNumber", "FLIR:LensSerialNumber", "Olympus:LensSerialNumber", "Panasonic:LensSerialNumber",
        "Ricoh:LensSerialNumber", "XMP-exifEX:LensSerialNumber", "XMP-aux:LensSerialNumber",
    ],
)

# Tag names embedded in an image; numbers are rationals.
EMBEDDED_TAGS = Vocabulary(
    make=["Image Make", "EXIF Make", "EXIF LensMake"],
    model=["Image Model", "EXIF Model", "EXIF LensModel"],
    width=["Image ImageWidth", "EXIF ExifImageWidth"],
    height=["Image ImageLength", "EXIF ExifImageLength"],
    orientation=["Image Orientation"],
    direction=["GPS GPSImgDirection", "GPS GPSTrack"],
    altitude=["GPS GPSAltitude"],
    altitude_ref=["GPS GPSAltitudeRef"],
    lon_lat=[("GPS GPSLongitude", "GPS GPSLatitude")],
    gps_times=[(["GPS GPSDate"], ["GPS GPSTimeStamp"])],
    camera_times=[
        (["EXIF DateTimeOriginal"], ["EXIF SubSecTimeOriginal"], ["EXIF OffsetTimeOriginal"]),
        (["EXIF DateTimeDigitized"], ["EXIF SubSecTimeDigitized"], ["EXIF OffsetTimeDigitized"]),
        (["Image DateTime"], ["EXIF SubSecTime"], ["EXIF OffsetTime"]),
    ],
    body_serial=[
        "EXIF BodySerialNumber", "EXIF SerialNumber", "EXIF CameraSerialNumber", "Image BodySerialNumber",
        "MakerNote SerialNumber", "MakerNote InternalSerialNumber",
    ],
    lens_serial=["EXIF LensSerialNumber", "Image LensSerialNumber"],
    rational=True,
)

# Tag names of the secondary packet an image may carry.
PACKET_TAGS = Vocabulary(
    make=["tiff:Make", "exifEX:LensMake"],
    model=["tiff:Model", "exifEX:LensModel"],
    width=["exif:PixelXDimension", "GPano:FullPanoWidthPixels", "GPano:CroppedAreaImageWidthPixels"],
    height=["exif:PixelYDimension", "GPano:FullPanoHeightPixels", "GPano:CroppedAreaImageHeightPixels"],
    orientation=["tiff:Orientation"],
    direction=["exif:GPSImgDirection", "exif:GPSTrack"],
    altitude=["exif:GPSAltitude"],
    altitude_ref=[],
    lon_lat=[("exif:GPSLongitude", "exif:GPSLatitude")],
    gps_times=[(["exif:GPSDateStamp"], ["exif:GPSTimeStamp"])],
    camera_times=[
        (["exif:DateTimeOriginal"], ["exif:SubsecTimeOriginal"], ["exif:OffsetTimeOriginal"]),
        (["exif:DateTimeDigitized"], ["exif:SubsecTimeDigitized"], ["exif:OffsetTimeDigitized"]),
    ],
    body_serial=[
        "exif:SerialNumber", "exif:BodySerialNumber", "exif:CameraSerialNumber", "exifEX:SerialNumber",
        "exifEX:BodySerialNumber", "aux:SerialNumber",
    ],
    lens_serial=["exif:LensSerialNumber", "exifEX:LensSerialNumber", "aux:LensSerialNumber"],
    compact_coordinates=True,
)

# Make and model tags of videos, vendor by vendor, with the vendor's default make.
VIDEO_VENDORS = [("GoPro:Make", "GoPro:Model", "GoPro"), ("Insta360:Make", "Insta360:Model", "Insta360")]
VIDEO_MAKES = ["IFD0:Make", "UserData:Make", "Keys:Make"]
VIDEO_MODELS = ["IFD0:Model", "UserData:Model", "Keys:Model"]
VIDEO_BODY_SERIALS = [
    "GoPro:SerialNumber", "GoPro:CameraSerialNumber", "Ricoh:SerialNumber", "XMP-GSpherical:PiDeviceSN",
    "Insta360:SerialNumber", "DJI:SerialNumber", "XMP-drone-dji:CameraSerialNumber",
    "XMP-drone-dji:DroneSerialNumber", "ExifIFD:BodySerialNumber", "ExifIFD:SerialNumber", "IFD0:SerialNumber",
    "UserData:SerialNumber", "XMP-aux:SerialNumber", "UserData:SerialNumberHash",
]
VIDEO_LENS_SERIALS = ["UserData:LensSerialNumber", "ExifIFD:LensSerialNumber", "XMP-aux:LensSerialNumber"]


def collect_tags(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Element rows ``(tag, ord, text)`` to one tag map per key, texts in order.

    Elements with no text are skipped. A key's elements are gathered in one row,
    which is what a record's map is, so they are shuffled once, by key; there
    each tag's texts are a run of the elements in order.
    """
    found = F.collect_list(F.struct("tag", "ord", "text"))
    per_key = elements.filter("text IS NOT NULL").groupBy(*keys).agg(found.alias("found"))
    return per_key.select(*keys, let(F.sort_array("found"), _tag_map).alias("tags"))


def _tag_map(found: Column) -> Column:
    """Map of sorted ``(tag, ord, text)`` elements; linear in their number."""
    starts = F.transform(found, lambda e, i: F.when((i == 0) | ~e["tag"].eqNullSafe(F.get(found, i - 1)["tag"]), i))

    def entries(starts: Column) -> Column:
        def entry(start: Column, j: Column) -> Column:
            own = F.slice(found, start + 1, F.coalesce(F.get(starts, j + 1), F.size(found)) - start)
            return F.struct(F.get(found, start)["tag"], own["text"])

        return F.map_from_entries(F.transform(starts, entry))

    return let(F.array_compact(starts), entries)


def first_text(tags: Column, name: str) -> Column:
    return F.get(F.try_element_at(tags, F.lit(name)), F.lit(0))


def first_field(tags: Column, names: list[str], type_: str = "string", rational: bool = False) -> Column:
    """First listed tag whose text reads as ``type_`` (string, bigint or double)."""

    def read(name: str) -> Column:
        text = first_text(tags, name)
        if type_ == "string":
            return text
        if type_ == "double" and rational:
            parts = P.parse_ratios(text)
            return F.when(F.size(parts) == 1, P.ratio(F.get(parts, F.lit(0))))
        return F.trim(text).try_cast(type_)

    if not names:
        return F.lit(None).cast(type_)
    return F.coalesce(*[read(n) for n in names])


def altitude(tags: Column, v: Vocabulary) -> Column:
    """Altitude, negative below sea level (reference 1)."""
    value = first_field(tags, v.altitude, "double", v.rational)
    ref = first_field(tags, v.altitude_ref, "bigint")
    return F.when(ref == 1, -value).otherwise(value)


def lon_lat(tags: Column, v: Vocabulary) -> Column:
    """``struct<lon,lat>`` from the first pair of tags that holds both."""

    def side(tag: str, minus: list[str]) -> Column:
        ref = first_text(tags, f"{tag}Ref")
        if v.compact_coordinates:
            return P.parse_coordinate(first_text(tags, tag), ref)
        if v.rational:
            value = let(P.parse_ratios(first_text(tags, tag)), P.dms_to_decimal)
        else:
            value = first_text(tags, tag).try_cast("double")
        return value * F.when(F.upper(ref).isin(minus), -1).otherwise(1)

    def pair(lon_tag: str, lat_tag: str) -> Column:
        west, south = (["W"], ["S"]) if v.rational else (["W", "WEST"], ["S", "SOUTH"])
        place = F.struct(side(lon_tag, west).alias("lon"), side(lat_tag, south).alias("lat"))
        return let(place, lambda p: F.when(p["lon"].isNotNull() & p["lat"].isNotNull(), p))

    return F.coalesce(*[pair(a, b) for a, b in v.lon_lat])


def capture_time(tags: Column, v: Vocabulary) -> Column:
    """Unix seconds: GPS times (unless on 1970-01-01), then camera times."""

    def gps(dates: list[str], times: list[str]) -> Column:
        date, time = first_field(tags, dates), first_field(tags, times)
        if v.rational:
            seconds = let(P.parse_ratios(time), P.ratio_duration)
            local = P.parse_date(date) * (P.DAY_S * 1_000_000) + F.round(seconds * 1_000_000).cast("bigint")
            parsed = P._made(local, F.lit(0.0))
        else:
            joined = P.parse_gps_parts(date, time)
            # A full timestamp may stand in the time field alone.
            parsed = F.coalesce(P.with_default_zone(P.parse_iso(F.trim(time)), 0.0), joined) if v.compact_coordinates else joined
        first_day = lambda d: F.floor(d["local_us"] / (P.DAY_S * 1_000_000)) == 0
        return let(parsed, lambda d: F.when(~first_day(d), P.as_unix_time(d)))

    def camera(dates: list[str], subsecs: list[str], offsets: list[str]) -> Column:
        subsec = F.regexp_replace(first_field(tags, subsecs), " ", "0")
        return P.as_unix_time(
            P.parse_camera_datetime(first_field(tags, dates), subsec, first_field(tags, offsets))
        )

    return F.coalesce(*[gps(*g) for g in v.gps_times], *[camera(*c) for c in v.camera_times])


def orientation(tags: Column, v: Vocabulary) -> Column:
    value = first_field(tags, v.orientation, "bigint")
    return F.when(value.between(1, 8), value).otherwise(F.lit(1).cast("bigint"))


def clean_serial(text: Column) -> Column:
    """Letters and digits only; null when nothing is left."""
    cleaned = F.regexp_replace(text, r"[^\p{L}\p{N}]", "")
    return F.when(cleaned != "", cleaned)


def join_serials(body: Column, lens: Column) -> Column:
    joined = F.concat_ws("_", clean_serial(body), clean_serial(lens))
    return F.when(joined != "", joined)


def camera_id(tags: Column, v: Vocabulary) -> Column:
    return join_serials(first_field(tags, v.body_serial), first_field(tags, v.lens_serial))


def properties(tags: Column, v: Vocabulary) -> dict[str, Column]:
    """Every property of a capture read from one tag map."""
    place = lon_lat(tags, v)
    return {
        "lon": place["lon"],
        "lat": place["lat"],
        "time": capture_time(tags, v),
        "alt": altitude(tags, v),
        "angle": first_field(tags, v.direction, "double", v.rational),
        "width": first_field(tags, v.width, "bigint"),
        "height": first_field(tags, v.height, "bigint"),
        "orientation": orientation(tags, v),
        "make": F.trim(first_field(tags, v.make)),
        "model": F.trim(first_field(tags, v.model)),
        "camera_uuid": camera_id(tags, v),
    }


def merged_properties(primary: Column, secondary: Column) -> dict[str, Column]:
    """Embedded tags first, the secondary packet only where they have nothing.

    Heading and orientation come from the embedded tags alone.
    """
    first, second = properties(primary, EMBEDDED_TAGS), properties(secondary, PACKET_TAGS)
    own = ("angle", "orientation")
    out = {n: c if n in own else F.coalesce(c, second[n]) for n, c in first.items()}
    # Longitude and latitude are taken from the same place.
    placed = first["lon"].isNotNull()
    for n in ("lon", "lat"):
        out[n] = F.when(placed, first[n]).otherwise(second[n])
    return out


def assemble_captures(df: DataFrame, props: dict[str, Column], position_later: bool = False) -> DataFrame:
    """Capture rows from properties; a missing position or time is an error row.

    With ``position_later`` (a GPS log will supply it) a missing position is (0, 0).
    """
    out = with_computed(df, **props)
    no_place = F.col("lon").isNull() | F.col("lat").isNull()
    place_error = R.error(R.GEOTAGGING, "no position in the tags")
    time_error = R.error(R.GEOTAGGING, "no capture time in the tags")
    checks = F.when(F.lit(not position_later) & no_place, place_error).when(F.col("time").isNull(), time_error)
    out = out.withColumn("error", checks)
    if position_later:
        zeroed = {c: F.when(no_place, 0.0).otherwise(F.col(c)) for c in ("lon", "lat")}
        out = out.withColumns(zeroed)
    return out


def video_make_model(tags: Column) -> Column:
    """``struct<make,model>``: a vendor counts when it has a model."""
    chosen = None
    for make_tag, model_tag, default in VIDEO_VENDORS:
        make, model = first_text(tags, make_tag), first_text(tags, model_tag)
        pair = F.struct(
            F.trim(F.coalesce(make, F.lit(default))).alias("make"), F.trim(model).alias("model")
        )
        chosen = F.when(model.isNotNull(), pair) if chosen is None else chosen.when(model.isNotNull(), pair)
    generic = F.struct(
        F.trim(first_field(tags, VIDEO_MAKES)).alias("make"), F.trim(first_field(tags, VIDEO_MODELS)).alias("model")
    )
    return chosen.otherwise(generic)


def video_camera_id(tags: Column) -> Column:
    return join_serials(first_field(tags, VIDEO_BODY_SERIALS), first_field(tags, VIDEO_LENS_SERIALS))


def model_from_copyright(text: Column) -> Column:
    """Camera model in a copyright text: JSON ``model``, else the second ``;`` field."""
    clean = F.trim(F.regexp_replace(F.trim(text), r"^\x00+|\x00+$", ""))
    is_json = F.try_parse_json(clean).isNotNull()
    parts = F.split(clean, ";")
    listed = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    named = F.trim(F.coalesce(F.get_json_object(clean, "$.model"), F.lit("")))
    return F.when(is_json, named).otherwise(listed)
