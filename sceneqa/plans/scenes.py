"""Frames to analysed scenes: ego motion, objects in range and view, contacts, in flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.functions import geometry as G

FRAMES = """sample_idx bigint, scene_token string, timestamp bigint, translation array<double>, rotation array<double>,
 navigation int, planning int, objects array<struct<name string, box array<double>, velocity array<double>>>"""
#: Driving commands by number (fixed values).
COMMANDS = {
    0: "turn left",
    1: "turn right",
    2: "go straight",
    3: "follow lane",
    4: "change lane to left",
    5: "change lane to right",
    6: "U-Turn",
}
VEHICLES = ["car", "truck", "bus", "trailer", "motorcycle", "bicycle", "construction_vehicle"]
#: Half length, half width, and the centre's lead over the reference point of the own vehicle, in metres.
EGO = (2.35, 0.95, 1.65)


def ego_states(frames: DataFrame) -> DataFrame:
    """sample_idx, velocity to the next frame (0 at a scene's end), acceleration (0 at both ends), speed, km/h, band, yaw, command
    (its name with a capital).
    """
    w = Window.partitionBy("scene_token").orderBy("sample_idx")
    dt = (F.lead("timestamp").over(w) - F.col("timestamp")) / 1e6
    before = (F.col("timestamp") - F.lag("timestamp").over(w)) / 1e6
    ahead = [F.when(dt > 0, (F.get(F.lead("translation").over(w), i) - F.get("translation", i)) / dt) for i in range(2)]
    behind = [F.when(before > 0, (F.get("translation", i) - F.get(F.lag("translation").over(w), i)) / before) for i in range(2)]
    v = [F.coalesce(x, F.lit(0.0)) for x in ahead]
    a = [F.coalesce((x - y) / ((dt + before) / 2), F.lit(0.0)) for x, y in zip(ahead, behind, strict=True)]
    names = F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])
    speed = F.sqrt(v[0] * v[0] + v[1] * v[1])
    name = F.try_element_at(names, F.coalesce("navigation", "planning"))
    command = F.coalesce(F.concat(F.upper(F.left(name, F.lit(1))), F.substring(name, 2, 100)), F.lit("Unknown"))
    out = frames.select("sample_idx", "scene_token", G.quat_yaw(F.col("rotation")).alias("yaw"), v[0].alias("vx"), v[1].alias("vy"), a[0].alias("ax"), a[1].alias("ay"), speed.alias("speed"), command.alias("command"))
    return out.withColumn("kmh", F.col("speed") * 3.6).withColumn("motion", G.motion_band(F.col("speed")))


def objects(frames: DataFrame, reach: float = 50.0, rear: float | None = None) -> DataFrame:
    """Objects within reach of each frame, with dense numbers, distance, place and sector; rear: reach of others than vehicles behind."""
    o = frames.select("sample_idx", F.posexplode("objects").alias("pos", "o"))
    x, y = F.get("o.box", 0), F.get("o.box", 1)
    speed = [F.when(F.isnan(F.get("o.velocity", i)), 0.0).otherwise(F.get("o.velocity", i)) for i in range(2)]
    d = F.sqrt(x * x + y * y)
    keep = d <= reach
    if rear is not None:
        keep &= (x >= 0) | F.col("o.name").isin(VEHICLES) | (d <= rear)
    near = o.where(keep).select("sample_idx", "pos", F.col("o.name").alias("name"), F.col("o.box").alias("box"), x.alias("x"), y.alias("y"), speed[0].alias("vx"), speed[1].alias("vy"), d.alias("distance"))
    number = F.row_number().over(Window.partitionBy("sample_idx").orderBy("pos"))
    return near.withColumn("number", number).withColumn("place", G.relative_label(F.col("x"), F.col("y"))).withColumn("sector", G.sector(F.col("x"), F.col("y")))


def contacts(objects_: DataFrame, ego: DataFrame) -> DataFrame:
    """Time to contact, risk and closing speed of each object. Objects stand in the frame of the own vehicle, into which its velocity and
    acceleration are turned; boxes keep their headings.
    """
    own = [F.col(f"own.{c}") for c in ("yaw", "vx", "vy", "ax", "ay")]
    both = objects_.join(ego.select("sample_idx", F.struct("yaw", "vx", "vy", "ax", "ay").alias("own")), "sample_idx")
    c, s = F.cos(own[0]), F.sin(own[0])
    turned = [[c * x + s * y, c * y - s * x] for x, y in (own[1:3], own[3:5])]
    half_l, half_w, lead = EGO
    place = [F.col("x") - lead, F.col("y")]
    v, a = [F.col("vx") - turned[0][0], F.col("vy") - turned[0][1]], [-x for x in turned[1]]
    zero = F.lit(0.0)
    ttc = G.ttc_obb([zero, zero, zero, F.lit(half_l), F.lit(half_w)], [*place, F.get("box", 6), F.get("box", 3) / 2, F.get("box", 4) / 2], v, a)
    closing = F.coalesce(G.closing_speed(*place, *v), zero)
    out = both.withColumn("closing", closing).withColumn("ttc", ttc)
    return out.withColumn("risk", G.risk_band(F.col("ttc"))).drop("own")


def scene_summary(objects_: DataFrame) -> DataFrame:
    """sample_idx, total, class_counts, nearest per sector."""
    counts = objects_.groupBy("sample_idx", "name").agg(F.count("*").alias("n")).groupBy("sample_idx").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("class_counts"))
    best = objects_.groupBy("sample_idx", "sector").agg(F.min(F.struct("distance", "number")).alias("b")).groupBy("sample_idx").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", F.col("b.number").alias("number"))))).alias("closest"))
    return counts.join(best, "sample_idx")


def road_heading(poses: DataFrame, least_speed: float = 5.0, most_turn: float = 0.5) -> DataFrame:
    """The mean heading (degrees) over straight and fast steps of each clip."""
    w = Window.partitionBy("clip").orderBy("ts_us")
    dt = (F.lead("ts_us").over(w) - F.col("ts_us")) / 1e6
    dx, dy = (F.lead(c).over(w) - F.col(c) for c in ("x", "y"))
    steps = poses.withColumn("_v", F.try_divide(F.sqrt(dx * dx + dy * dy), dt)).withColumn("_h", F.atan2(dy, dx))
    turn = F.degrees(G.wrap_angle(F.col("_h") - F.lag("_h").over(w)))
    straight = steps.withColumn("_t", F.abs(turn)).where((F.col("_v") >= least_speed) & (F.col("_t") <= most_turn))
    return straight.groupBy("clip").agg(F.degrees(F.atan2(F.avg(F.sin("_h")), F.avg(F.cos("_h")))).alias("heading"), F.count("*").alias("steps"))
