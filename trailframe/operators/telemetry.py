"""Turning logged telemetry rows into tracks, and choosing among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailframe.functions import nmea
from trailframe.functions import records as R
from trailframe.functions import timeparse as P
from trailframe.functions.binding import with_computed
from trailframe.operators import ordered as O
from trailframe.operators import tracks as K
from trailframe.operators.ordered import Ordered
from trailframe.runtime import materialize

# Which sentence type supplies a file's points.
SENTENCE_RANK = {"RMC": 0, "GGA": 1, "GLL": 2}


def preferred(rows: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Keep, per key, the rows of its best (lowest) rank; null ranks never count."""
    ranked = rows.withColumn("_rank", rank)
    best = ranked.groupBy(*keys).agg(F.min("_rank").alias("_best"))
    joined = O.join_keys(ranked.filter("_rank IS NOT NULL"), best, keys, "inner")
    return joined.filter("_rank = _best").drop("_rank", "_best")


def sentence_rank(type_: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in SENTENCE_RANK.items() for x in kv])
    return F.try_element_at(pairs, type_)


def read_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Dash-cam lines to ``epoch_s`` and parsed sentence ``s``; other lines are skipped."""
    stamped = with_computed(lines, _l=nmea.split_log_line(F.col(line))).filter("_l IS NOT NULL")
    rest = [c for c in lines.columns if c != line]
    parsed = nmea.with_sentence(stamped.select(*rest, "_l.*"), "sentence")
    return parsed.filter("s IS NOT NULL").drop("sentence")


def _clock_offset() -> Column:
    """Ranked offset of one sentence: ``struct<rank, ord, offset>``, null if unusable."""
    dated = (F.col("s.type") == "RMC") & F.col("s.day").isNotNull() & F.col("s.clock_us").isNotNull()
    undated = F.col("s.type").isin("GGA", "GLL")
    gps = (F.col("s.day") * 86_400_000_000 + F.col("s.clock_us")) / F.lit(1e6)
    camera_day = F.floor(F.col("epoch_s") / 86400)
    camera_clock = F.floor(F.col("epoch_s") - camera_day * 86400)
    clock = F.floor(F.col("s.clock_us") / 1_000_000)
    turn = F.when(camera_clock - clock > 43200, 1).when(clock - camera_clock > 43200, -1).otherwise(0)
    same_day = ((camera_day + turn) * 86_400_000_000 + F.col("s.clock_us")) / F.lit(1e6)
    offset = F.round(F.when(F.col("s.type") == "RMC", gps).otherwise(same_day) - F.col("epoch_s"), 3)
    rank = F.when(F.col("s.valid") & dated, 0).when(F.col("s.valid") & undated, 1)
    return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("ord"), offset.alias("offset")))


def clock_offsets(log: DataFrame, key: str) -> DataFrame:
    """Seconds to add to the camera clock of each file.

    The first valid dated sentence decides; else the first valid undated one,
    trusting the camera's day unless the clocks are over 12 hours apart; else 0.
    """
    found = log.groupBy(key).agg(F.min(_clock_offset()).alias("_o"))
    return found.select(key, F.coalesce("_o.offset", F.lit(0.0)).alias("clock_offset"))


def log_points(
    log: DataFrame, key: str, sized_by: list[DataFrame] | None = None, max_rows: int | None = None
) -> DataFrame:
    """GPS points of each file on the corrected clock, from its preferred sentence type.

    Offset and preferred type are group-wide minima over one pass of the log.
    ``sized_by`` may name the unparsed lines, which are cheaper to count.
    """
    usable = F.col("s.valid") & F.col("s.type").isNotNull()
    rank = F.when(usable, sentence_rank(F.col("s.type")))
    rows = Ordered.of(log.withColumn("_rank", rank), [key], ["epoch_s", "ord"], max_rows, sized_by)
    judged = rows.scan(_o=O.group_min(_clock_offset()), _best=O.group_min(F.col("_rank")))
    best = judged.rows().filter("_rank = _best")
    epoch = F.round(F.col("epoch_s") + F.coalesce("_o.offset", F.lit(0.0)), 3)
    is_gga = F.col("s.type") == "GGA"
    return best.select(
        key,
        "ord",
        epoch.alias("time"),
        F.col("s.lat").alias("lat"),
        F.col("s.lon").alias("lon"),
        F.when(is_gga, F.col("s.alt")).alias("alt"),
        F.lit(None).cast("double").alias("angle"),
        epoch.alias("epoch_time"),
        F.when(is_gga & (F.col("s.quality") >= 1), 3).alias("fix"),
    )


def nmea_track(lines: DataFrame, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """Positions of plain NMEA logs; the day comes from the latest dated sentence.

    Lines before the first dated sentence take its day. Logs without one turn
    into error rows (``time`` null).
    """
    parsed = nmea.with_sentence(lines, "line")
    useful = parsed.filter("s IS NOT NULL AND (line LIKE '%GPRMC%' OR line LIKE '%$GPGGA%')")
    day = F.when(F.col("line").contains("GPRMC"), F.col("s.day"))
    rows = Ordered.of(useful, keys, ["ord"], max_rows)
    dated = rows.scan(_day=O.last_known(day), _later=O.next_known(day))
    at = (F.coalesce("_day", "_later") * 86_400_000_000 + F.col("s.clock_us")) / F.lit(1e6)
    points = dated.rows().filter(F.col("line").contains("$GPGGA"))
    missing = R.error(R.GEOTAGGING, "No date found in the NMEA log")
    return points.select(
        *keys,
        "ord",
        at.alias("time"),
        F.col("s.lat").alias("lat"),
        F.col("s.lon").alias("lon"),
        F.col("s.alt").alias("alt"),
        F.when(at.isNull(), missing).alias("error"),
    )


# -- element streams -------------------------------------------------------------------


def group_samples(
    elements: DataFrame, key: str, time_tag: str, duration_tag: str, max_rows: int | None = None, known: int | None = None
) -> DataFrame:
    """Cut an element stream at its sample markers.

    Each element gets its ``sample`` number, time and duration; markers and
    elements of samples without a readable time or duration go.
    """
    is_time, is_duration = F.col("tag") == time_tag, F.col("tag") == duration_tag
    rows = Ordered.of(elements, [key], ["ord"], max_rows, known=known)
    number = lambda flag: F.when(flag, F.struct(F.col("text").try_cast("double").alias("v")))
    marked = rows.scan(
        sample=O.running_sum(F.when(is_time, 1).otherwise(0)),
        _time=O.last_known(number(is_time)),
        # A sample is closed by the next marker, with the last duration read by then.
        _duration=O.last_known(number(is_duration)),
    )
    last = marked.df.groupBy(key, "sample").agg(F.max_by("_duration", "ord").alias("_d"))
    joined = marked.rows().filter(~is_time & ~is_duration).join(last, [key, "sample"])
    kept = joined.filter("_time.v IS NOT NULL AND _d.v IS NOT NULL")
    return kept.select(
        key, "sample", F.col("_time.v").alias("sample_time"), F.col("_d.v").alias("duration"), "ord", "tag", "text"
    )


def align_lists(
    elements: DataFrame,
    keys: list[str],
    lon: str,
    lat: str,
    optional: dict[str, str] | None = None,
    time: str | None = None,
    epoch: str | None = None,
    max_rows: int | None = None,
    known: int | None = None,
) -> DataFrame:
    """Parallel tag lists in an element stream to point rows (``ord`` is the place).

    The n-th text of each tag belongs to the n-th point. Coordinates must have
    equal counts, as must times; a single epoch serves every point, another
    count than the coordinates' drops the epochs; short optional lists end in
    nulls. Texts meet by (key, place), so no list is ever gathered.
    """
    tags = {"lon": lon, "lat": lat, **(optional or {})}
    if time:
        tags["time"] = time
    if epoch:
        tags["epoch"] = epoch
    # Two columns may read one tag.
    names = {tag: f"_t{i}" for i, tag in enumerate(dict.fromkeys(tags.values()))}
    column = {name: names[tag] for name, tag in tags.items()}
    useful = elements.filter(F.col("tag").isin(list(names)) & F.col("text").isNotNull())
    counted = useful.groupBy(*keys).agg(
        *[F.count(F.when(F.col("tag") == tag, 1)).alias(f"{c}_n") for tag, c in names.items()],
        *[F.min_by("text", F.when(F.col("tag") == tag, F.col("ord"))).alias(f"{c}_0") for tag, c in names.items()],
    )
    size = lambda name: F.col(f"{column[name]}_n")
    fits = size("lon") == size("lat")
    if time:
        fits = fits & (size("time") == size("lat"))
    numbered = Ordered.of(useful, [*keys, "tag"], ["ord"], max_rows, known=known).scan(_place=O.index()).rows()
    wide = numbered.groupBy(*keys, "_place").agg(
        *[F.max(F.when(F.col("tag") == tag, F.col("text"))).alias(c) for tag, c in names.items()]
    )
    joined = O.join_keys(wide, counted.filter(fits), keys, "inner")
    rows = joined.filter(F.col("_place") <= size("lat"))
    number = lambda name: F.trim(F.col(column[name])).try_cast("double")
    stamp = lambda text: P.as_unix_time(P.parse_gps_datetime(text))
    read = {"time": stamp(F.col(column["time"])) if time else F.lit(0.0), "lon": number("lon"), "lat": number("lat")}
    if epoch:
        own = F.when(size("epoch") == size("lat"), F.col(column["epoch"]))
        text = F.when(size("epoch") == 1, F.col(f"{column['epoch']}_0")).otherwise(own)
        read["epoch_time"] = stamp(text)
    for name in optional or {}:
        read[name] = number(name)
    out = with_computed(rows, **read)
    if not epoch:
        out = out.withColumn("epoch_time", F.col("time") if time else F.lit(None).cast("double"))
    out = out.select(*keys, (F.col("_place") - 1).alias("ord"), "time", "lon", "lat", "epoch_time", *(optional or {}))
    return out.filter("time IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")


# -- choices ------------------------------------------------------------------------------


def preferred_device(names: DataFrame, key: str) -> DataFrame:
    """Device name with "hero", else with "gopro", else the first in order."""
    lowered = F.lower("name")
    rank = F.when(lowered.contains("hero"), 0).when(lowered.contains("gopro"), 1).otherwise(2)
    best = F.min(F.struct(rank.alias("rank"), F.col("name")))
    return names.groupBy(key).agg(F.trim(best["name"]).alias("name"))


def first_device(points: DataFrame, key: str) -> DataFrame:
    """Points of the first device, each sample from its first stream with points.

    Among the streams of a sample the earliest non-empty one counts, and in it
    the nine-value readings before the five-value ones.
    """
    device = points.groupBy(key).agg(F.min_by("device", F.struct("sample", "device_no")).alias("_first"))
    own = points.join(device, key).filter("device = _first").drop("_first")
    rank = F.struct("stream", F.when(F.col("values") == 9, 0).otherwise(1).alias("short"))
    return preferred(own, [key, "sample"], rank)


def largest_stream(streams: DataFrame, key: str) -> DataFrame:
    """Video stream with most pixels per file, the first on ties."""
    area = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0))
    fields = F.struct(*[c for c in streams.columns if c != key])
    best = F.max_by(fields, F.struct(area.alias("area"), -F.col("stream_no")))
    return streams.filter("codec_type = 'video'").groupBy(key).agg(best.alias("_s")).select(key, "_s.*")


def recording_start(streams: DataFrame, key: str) -> DataFrame:
    """Creation minus duration; video streams by size, then the others as listed."""
    start = F.col("creation_time") - F.col("duration")
    is_video = F.col("codec_type") == "video"
    area = F.coalesce(F.col("width"), F.lit(0)) * F.coalesce(F.col("height"), F.lit(0))
    rank = F.struct(
        F.when(is_video, 0).otherwise(1).alias("a"),
        F.when(is_video, -area).otherwise(0).alias("b"),
        F.col("stream_no"),
    )
    known = F.when(start.isNotNull(), rank)
    return streams.groupBy(key).agg(F.min_by(start, known).alias("start_time"))


def first_source_with_data(points: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """Points of the best-ranked source that has any."""
    return preferred(points, keys, rank)


def group_frames(frames: DataFrame, keys: list[str], streams: list[str]) -> DataFrame:
    """One row per frame index with one path column per selected stream."""
    return frames.groupBy(*keys, "frame_idx").pivot("stream", streams).agg(F.max("path"))


# -- tracks in tool XML ---------------------------------------------------------------------

# Namespaces that list a whole track, best first; numbered tracks (``Track1``, ...) follow.
TRACK_NAMESPACES = ["QuickTime", "Insta360"]


def _has_tags(elements: DataFrame, key: str, tags: list[str]) -> DataFrame:
    """Keys whose elements include every one of the tags."""
    found = elements.filter(F.col("tag").isin(tags) & F.col("text").isNotNull())
    counted = found.groupBy(key).agg(F.countDistinct("tag").alias("_n"))
    return counted.filter(F.col("_n") == len(tags)).select(key)


def listed_track(elements: DataFrame, key: str, namespace: str, max_rows: int | None = None, known: int | None = None) -> DataFrame:
    """Track given as whole lists: de-duplicated, sorted, and starting at 0."""
    tag = lambda name: f"{namespace}:{name}"
    needed = [tag("GPSDateTime"), tag("GPSLongitude"), tag("GPSLatitude")]
    own = elements.join(_has_tags(elements, key, needed), key, "left_semi")
    points = align_lists(
        own, [key], tag("GPSLongitude"), tag("GPSLatitude"),
        {"alt": tag("GPSAltitude"), "angle": tag("GPSTrack")}, time=tag("GPSDateTime"), epoch=tag("GPSDateTime"),
        max_rows=max_rows, known=known,
    )
    once = K.drop_repeated_points(Ordered.of(points, [key], ["ord"], max_rows, known=known)).rows()
    again = K.drop_repeated_points(Ordered.of(once, [key], ["time", "ord"], max_rows, known=known)).rows()
    again = materialize(again, "listed-points")
    rebased = K.rebase_times(again, [key])
    nothing = {"fix": "int", "precision": "double", "ground_speed": "double"}
    return rebased.withColumns({n: F.lit(None).cast(t) for n, t in nothing.items()})


def sampled_track(elements: DataFrame, key: str, namespace: str, max_rows: int | None = None, known: int | None = None) -> DataFrame:
    """Track given sample by sample: points are spread over their sample's duration.

    Fix and precision (metres to hundredths) hold for the whole sample.
    """
    tag = lambda name: f"{namespace}:{name}"
    needed = [tag(n) for n in ("SampleTime", "SampleDuration", "GPSLongitude", "GPSLatitude")]
    own = elements.join(_has_tags(elements, key, needed), key, "left_semi")
    samples = materialize(group_samples(own, key, tag("SampleTime"), tag("SampleDuration"), max_rows, known), "samples")
    keys = [key, "sample"]
    points = align_lists(
        samples, keys, tag("GPSLongitude"), tag("GPSLatitude"),
        {"alt": tag("GPSAltitude"), "angle": tag("GPSTrack"), "ground_speed": tag("GPSSpeed")},
        epoch=tag("GPSDateTime"), max_rows=max_rows, known=known,
    )
    fresh = K.drop_repeated_points(Ordered.of(points, keys, ["ord"], max_rows, known=known)).rows()
    first = lambda name: F.min_by("text", F.when(F.col("tag") == tag(name), F.col("ord")))
    about = samples.groupBy(*keys).agg(
        F.first("sample_time").alias("sample_time"),
        F.first("duration").alias("duration"),
        first("GPSMeasureMode").try_cast("int").alias("_fix"),
        (F.trim(first("GPSHPositioningError")).try_cast("double") * 100).alias("precision"),
    )
    joined = O.join_keys(fresh, about, keys)
    spread = K.spread_in_sample(Ordered.of(joined, keys, ["ord"], max_rows, known=known), "sample_time", "duration")
    fix = F.when(F.col("_fix").isin(0, 2, 3), F.col("_fix"))
    return spread.rows().withColumn("fix", fix).drop("_fix", "sample_time", "duration", "sample")


def tool_video_tracks(elements: DataFrame, key: str, max_rows: int | None = None) -> DataFrame:
    """GPS track per video from its tool XML elements: the first source with points.

    The source is read off the tag's namespace, so all listed tracks go one way
    together and all numbered tracks, however many, another.
    """
    columns = ["ord", "time", "lon", "lat", "alt", "angle", "epoch_time", "fix", "precision", "ground_speed"]
    # Every step below works on parts of these groups, so one count bounds them all.
    known = O.largest_group(elements, [key])
    namespace, name = (F.regexp_extract("tag", r"^([^:]*):(.*)$", i) for i in (1, 2))
    number = F.regexp_extract(namespace, r"^Track([1-9][0-9]{0,8})$", 1).try_cast("int")
    listed_no = F.array_position(F.array(*[F.lit(n) for n in TRACK_NAMESPACES]), namespace).cast("int") - 1
    source = F.when(listed_no >= 0, listed_no).otherwise(number + len(TRACK_NAMESPACES) - 1)
    sourced = elements.select(
        F.struct(F.col(key).alias("key"), source.alias("source_no")).alias("_source"),
        (listed_no >= 0).alias("_listed"), "ord", F.concat(F.lit("own:"), name).alias("tag"), "text",
    ).filter("_source.source_no IS NOT NULL")
    # Tables that several steps read are written once: their cost would double with each step.
    sourced = materialize(sourced, "sourced-elements")
    listed = listed_track(sourced.filter("_listed").drop("_listed"), "_source", "own", max_rows, known)
    sampled = sampled_track(sourced.filter("NOT _listed").drop("_listed"), "_source", "own", max_rows, known)
    merged = listed.select("_source", *columns).unionByName(sampled.select("_source", *columns))
    flat = merged.select(F.col("_source.key").alias(key), *columns, F.col("_source.source_no").alias("source_no"))
    return first_source_with_data(materialize(flat, "tool-points"), [key], F.col("source_no"))
