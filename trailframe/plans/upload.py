"""What an upload would send: sequences, cached handles, manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.functions import records as R
from trailframe.operators import accounting as B
from trailframe.operators import matching as X

ORDER = ["time", "basename"]


@dataclass(frozen=True)
class UploadPlan:
    sequences: DataFrame
    images: DataFrame


def plan_upload(
    records: DataFrame,
    listing: DataFrame,
    history: DataFrame,
    cache: DataFrame,
    now: float,
    run_id: str = "run",
    key_prefix: str = "",
    reupload: bool = False,
) -> UploadPlan:
    """Sequences still to upload and their images with any cached handle.

    Records without a sequence share the run's; files must exist; each file
    counts once per sequence; a sequence is known by its fingerprint.
    """
    filled = B.fill_sequence_id(X.good_rows(records), run_id)
    present = X.existing_records(filled, listing)
    images = B.latest_per_file(present, ["sequence_id"], "ord")
    prints = B.fingerprints(images, "sequence_id", ORDER)
    sized = prints.join(B.payloads(images, "sequence_id"), "sequence_id")
    todo = B.not_uploaded(sized, history, reupload)
    session_key = R.content_key(F.col("md5sum"), F.lit("image"), key_prefix, R.KEY_SUFFIXES)
    wanted = images.join(todo.select("sequence_id"), "sequence_id", "left_semi").withColumn("key", session_key)
    return UploadPlan(todo, B.cache_get(wanted, cache, now))
