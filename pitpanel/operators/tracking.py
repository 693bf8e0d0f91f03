"""Traits of moving subjects: frames turned to one direction, then speeds, path depths and separations per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def oriented(
    frames: DataFrame, left: Column, length: float, width: float, *, x: str = "x", y: str = "y", angles: Sequence[str] = (),
) -> DataFrame:
    """frames with those where `left` holds turned by half a turn about the field's centre, angles with them.

    A null `left` leaves a row as it is; null coordinates stay null.
    """
    turn = F.coalesce(left, F.lit(False))
    new = {x: F.when(turn, length - F.col(x)).otherwise(F.col(x)), y: F.when(turn, width - F.col(y)).otherwise(F.col(y))}
    new |= {a: F.when(turn, (F.col(a) + 180) % 360).otherwise(F.col(a)) for a in angles}
    return frames.withColumns(new)


def traits(
    frames: DataFrame, play: Sequence[str], subject: str, frame: str, period: str, *,
    role: str, movers: Sequence[str], target: str, marker: str,
    x: str = "x", y: str = "y", speed: str = "speed", accel: str = "accel",
) -> DataFrame:
    """A row for each subject of oriented frames (a row for each play, frame and subject).

    frames, periods seen and the last; plays as mover, as target, as marker; mean and 0.9 quantile of speed and
    0.9 quantile of acceleration as mover; 0.9 quantile of speed as marker; mean and 0.9 quantile of the path depth
    (x of a play's last frame less that of its first, as mover); mean distance of a target from the nearest marker
    in the last frame of a play. A target counts as a mover if its role is among `movers`. Sums and quantiles do not
    depend on order. A subject without rows of a kind has null there and counts of 0. Null subjects are left out;
    an empty table gives no rows. A play's last frame is over all of its rows; only rows of one play meet.
    """
    key = F.struct(*play)
    frames = frames.where(F.col(subject).isNotNull())
    moving, marking = F.col(role).isin(*movers), F.col(role) == marker
    base = frames.groupBy(subject).agg(
        F.count("*").alias("frames"),
        F.count_distinct(period).alias("periods"),
        F.max(period).alias("last_period"),
        F.count_distinct(F.when(moving, key)).alias("mover_plays"),
        F.count_distinct(F.when(marking, key)).alias("marker_plays"),
        F.avg(F.when(moving, F.col(speed))).alias("speed_mean"),
        F.percentile(F.when(moving, F.col(speed)), F.lit(0.9)).alias("speed_p90"),
        F.count(F.when(moving, F.col(speed))).alias("speed_n"),
        F.percentile(F.when(moving, F.col(accel)), F.lit(0.9)).alias("accel_p90"),
        F.percentile(F.when(marking, F.col(speed)), F.lit(0.9)).alias("marker_speed_p90"),
        F.count(F.when(marking, F.col(speed))).alias("marker_speed_n"),
    )
    path = frames.where(moving).groupBy(*play, subject).agg((F.max_by(x, frame) - F.min_by(x, frame)).alias("depth"))
    path = path.groupBy(subject).agg(F.avg("depth").alias("depth_mean"), F.percentile("depth", F.lit(0.9)).alias("depth_p90"))

    # only targets and markers of a play's last frame go on
    ends = frames.groupBy(*play).agg(F.max(frame).alias("_last"))
    seen = frames.where(F.col(role).isin(target, marker)).select(*play, subject, frame, role, x, y).join(ends, list(play))
    seen = seen.where(F.col(frame) == F.col("_last"))
    others = seen.where(marking).select(*play, F.col(x).alias("_x"), F.col(y).alias("_y"))
    pairs = seen.where(F.col(role) == target).join(others, list(play))
    apart = pairs.groupBy(*play, subject).agg(F.min(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias("_d"))
    apart = apart.groupBy(subject).agg(F.avg("_d").alias("separation_mean"), F.count("*").alias("target_plays"))
    out = base.join(path, subject, "left").join(apart, subject, "left")
    return out.withColumn("target_plays", F.coalesce("target_plays", F.lit(0)))
