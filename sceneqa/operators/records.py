"""Lookups with rules, picks, draws and flattening of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.functions.geometry import rigid_inverse
from sceneqa.operators.sampling import uniform
from sceneqa.operators.windows import last_write

#: The cameras of a sample, which it must have (fixed values).
CAMERAS = ["CAM_FRONT_LEFT", "CAM_FRONT", "CAM_FRONT_RIGHT", "CAM_BACK_LEFT", "CAM_BACK", "CAM_BACK_RIGHT"]


def point_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    """The row of a key; fails on reading if there is none."""
    found = df.where(F.col(key) == value)
    n = found.agg(F.count("*").alias("_n"))
    checked = n.select(F.when(F.col("_n") > 0, F.lit(value)).otherwise(F.raise_error(F.lit(f"no row with {key} = {value}")).cast("bigint")).alias("_k"))
    return checked.join(found, F.col("_k") == F.col(key), "left").drop("_k")


def camera_records(samples: DataFrame, cameras: str = "cameras") -> DataFrame:
    """Each camera with the transform from the vehicle to it (ego2sensor_rotation, a matrix, and ego2sensor_translation) beside its
    own rotation (a quaternion) and translation. Reading a sample that lacks one of the six fails.
    """

    def whole(name: str) -> Column:
        cam = F.try_element_at(cameras, F.lit(name))
        cam = F.when(cam.isNull(), F.raise_error(F.concat(F.lit(f"camera {name} not found in sample "), F.col("sample_idx").cast("string"))).cast(samples.schema[cameras].dataType.valueType)).otherwise(cam)
        rotation, translation = rigid_inverse(cam["rotation"], cam["translation"])
        return cam.withField("ego2sensor_rotation", rotation).withField("ego2sensor_translation", translation)

    return samples.withColumn(cameras, F.create_map(*[x for name in CAMERAS for x in (F.lit(name), whole(name))]))


def scene_filter(df: DataFrame, token: str, column: str = "scene_token") -> DataFrame:
    if not token:
        raise ValueError("empty scene token")
    return df.where(F.col(column).startswith(token))


def resolve_category(samples: DataFrame, lookup: DataFrame) -> DataFrame:
    """The sample's own category, else that of its question in the lookup (question, category, ord: the last wins)."""
    last = last_write(lookup.select("question", "category", "ord"), ["question"], [F.col("ord")]).select("question", F.col("category").alias("_looked_up"))
    return samples.join(last, "question", "left").withColumn("category", F.coalesce("category", "_looked_up")).drop("_looked_up")


def status_join(signals: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """Signals with the last status of their key; outcome says missing, unparsed or labelled, and defaults fill in."""
    picked = last_write(status, keys, [F.col("ord")]).drop("ord")
    both = signals.join(picked.withColumn("_found", F.lit(True)), keys, "left")
    outcome = F.when(F.col("_found").isNull(), "missing").when(~F.coalesce("parse_ok", F.lit(False)), "unparsed").otherwise("labelled")
    out = both.withColumn("outcome", outcome)
    return out.withColumn("colour", F.when(F.col("outcome") == "labelled", F.col("colour")).otherwise("unknown")).withColumn("confidence", F.when(F.col("outcome") == "labelled", F.col("confidence")).otherwise(-1.0)).drop("_found", "parse_ok")


def enrich(rows: DataFrame, bank: DataFrame) -> DataFrame:
    """Template fields by category and template_idx (from 1); rows out of range stay without."""
    return rows.join(bank, ["category", "template_idx"], "left")


def pin(rows: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the index of their template's text, and the rows that have none."""
    return rows.join(meta, ["category", "template"]), rows.join(meta, ["category", "template"], "left_anti")


def by_basename(rows: DataFrame, path: str, index: DataFrame, index_path: str) -> DataFrame:
    """Joins on the last part of a path; of equal ones in the index the last sample wins."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    names = index.groupBy(base(index_path).alias("_base")).agg(F.max("sample_idx").alias("sample_idx"))
    return rows.withColumn("_base", base(path)).join(names, "_base", "left").drop("_base")


def first_per_category(df: DataFrame, category: str, order: str, n: int, condition: Column) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.where(condition).withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


def level_histogram(df: DataFrame, key: str, level: str, levels: list[str]) -> DataFrame:
    """key, level, n for all levels, those that don't occur with 0."""
    dim = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(levels)], f"{level} string, ord int")
    counts = df.groupBy(key, level).agg(F.count("*").alias("n"))
    return df.select(key).distinct().crossJoin(F.broadcast(dim)).join(counts, [key, level], "left").na.fill(0, ["n"])


def three_stage_draw(buckets: DataFrame, weights: dict[int, float], draws: int, seed: int) -> DataFrame:
    """draw, view, category, row: a view by weight, a category of it uniformly, a row of that uniformly. buckets: view, category, n."""
    upto, total, bounds = 0.0, sum(weights.values()), []
    for view, w in sorted(weights.items()):
        upto += w
        bounds.append((view, upto / total))
    place = F.lit(bounds[-1][0])  # whatever rounding leaves over
    for view, high in reversed(bounds[:-1]):
        place = F.when(uniform(seed, F.col("id"), "view") < high, view).otherwise(place)
    w = Window.partitionBy("view")
    dim = buckets.withColumn("_k", F.row_number().over(w.orderBy("category")) - 1).withColumn("_m", F.count("*").over(w))
    placed = buckets.sparkSession.range(draws).select(F.col("id").alias("draw"), place.cast("bigint").alias("view"))
    sized = placed.join(F.broadcast(dim.select("view", "_m").distinct()), "view").withColumn("_k", F.floor(uniform(seed, F.col("draw"), "category") * F.col("_m")).cast("int"))
    return sized.join(F.broadcast(dim.drop("_m")), ["view", "_k"]).select("draw", "view", "category", F.floor(uniform(seed, F.col("draw"), "row") * F.col("n")).cast("bigint").alias("row"))


def composite_pool(df: DataFrame, key: str, p_replay: float, floor: float | None, seed: int) -> DataFrame:
    """pool of each draw: replay with p; else the grounded floor with its own probability; else current. key: names a draw."""
    rest = F.when(uniform(seed, F.col(key), "floor") < floor, "global").otherwise("current") if floor else F.lit("current")
    return df.withColumn("pool", F.when(uniform(seed, F.col(key), "replay") < p_replay, "prior").otherwise(rest))


def expected_pools(p_replay: float, floor: float | None) -> dict[str, float]:
    t = floor or 0.0
    return {"prior": p_replay, "global": (1 - p_replay) * t, "current": (1 - p_replay) * (1 - t)}


def coco_rows(detections: DataFrame) -> DataFrame:
    """Arrays per image (boxes, scores, labels) to one row each, boxes as x, y, width, height."""
    d = detections.select("image_id", F.explode(F.arrays_zip("boxes", "scores", "labels")).alias("d"))
    b = [F.get("d.boxes", i) for i in range(4)]
    return d.select("image_id", F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]).alias("bbox"), F.col("d.scores").alias("score"), F.col("d.labels").alias("category_id"))


def run_rows(reports: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Named values of run summaries in JSON text (path by name); missing ones are null."""
    v = F.try_parse_json("summary")
    return reports.select("experiment", "seed", *[F.try_variant_get(v, path, "double").alias(name) for name, path in fields.items()])


def curriculum_order(df: DataFrame, category: str, known: list[str]) -> DataFrame:
    """Known categories in their order, others by name after them."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), F.col(category))
    return df.orderBy(F.when(at > 0, at).asc_nulls_last(), category)


def nested_labels(labels: DataFrame) -> DataFrame:
    """token, idx, label rows to one map per scene: {token: {idx: label}}."""
    inner = labels.groupBy("scene", "token").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("idx", "label")))).alias("m"))
    return inner.groupBy("scene").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", F.to_json("m").alias("m"))))).alias("sample_labels"))
