"""What is known of a scene, as the text that precedes the questions of a category: one Column a category, in a registry.

A scene is a row with objects (array of OBJECT, in the order of their numbers), ego (EGO), location, description, and, for the
categories that add an earlier risk analysis, risk (RISK, or null). The lines of text are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT = "struct<category:string,distance:double,x:double,y:double,vx:double,vy:double,speed:double,motion:string,views:array<int>,place:string,ttc:double,risk:string,closing:double>"
EGO = "struct<motion:string,speed:double,kmh:double,command:string>"
RISK = "struct<overall_risk:string,description:string>"
#: The names of views 1 to 6 and the levels of risk (fixed values).
VIEWS = ["Front-left", "Front", "Front-right", "Rear-left", "Rear", "Rear-right"]
LEVELS = ["CRITICAL", "HIGH", "MODERATE", "LOW", "NONE"]

Numbered = Callable[[Column, Column], Column]


def _lines(*parts: Column | str) -> Column:
    """Lines of text, and arrays of lines, one below the other; null ones are left out."""
    arrays = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.flatten(F.array(*arrays)), "\n")


def _line(pattern: str, *values: Column) -> Column:
    return F.array(F.format_string(pattern, *values))


def _views(o: Column) -> Column:
    names = F.array(*[F.lit(v) for v in VIEWS])
    return F.array_join(F.transform(o["views"], lambda v: F.format_string("Image %d (%s)", v, F.element_at(names, v))), ", ")


def _each(line: Numbered, none: str | None = None, keep: Callable[[Column], Column] | None = None) -> Column:
    """A line for each object (of those to keep) with its number; `none` where there is none."""
    numbered = F.transform("objects", lambda o, i: F.struct((i + 1).alias("n"), o.alias("o")))
    kept = F.filter(numbered, lambda x: keep(x["o"])) if keep else numbered
    lines = F.transform(kept, lambda x: line(x["o"], x["n"]))
    return F.when(F.size(kept) == 0, F.array(F.lit(none))).otherwise(lines) if none else lines


def _at(o: Column, i: Column) -> Column:
    return F.format_string("  OBJ %d: %s at distance=%.1fm (%s) visible in %s", i, o["category"], o["distance"], o["place"], _views(o))


def _ttc(o: Column) -> Column:
    return F.when(o["ttc"].isNull(), "∞").otherwise(F.format_string("%.2fs", o["ttc"]))


def _velocity(o: Column) -> Column:
    return F.format_string("[vx=%.2f, vy=%.2f] m/s", o["vx"], o["vy"])


def _ego(name: str) -> Column:
    return F.col(f"ego.{name}")


def _total() -> Column:
    return F.size("objects")


def _counts() -> Column:
    kinds = F.array_sort(F.array_distinct(F.transform("objects", lambda o: o["category"])))
    lines = F.transform(kinds, lambda k: F.format_string("  - %s: %d", k, F.size(F.filter("objects", lambda o: o["category"] == k))))
    return F.when(_total() == 0, F.array(F.lit("  - No objects detected"))).otherwise(lines)


def _by_view() -> Column:
    def line(v: int) -> Column:
        seen = F.filter("objects", lambda o: F.array_contains(o["views"], v))
        kinds = F.array_join(F.array_sort(F.array_distinct(F.transform(seen, lambda o: o["category"]))), ", ")
        head = f"  - Image {v} ({VIEWS[v - 1]}): "
        return F.when(F.size(seen) == 0, head + "No objects").otherwise(F.format_string(head + "%d objects (%s)", F.size(seen), kinds))

    return F.array(*[line(v) for v in range(1, 7)])


def _closest() -> Column:
    def line(name: str) -> Column:
        there = F.transform("objects", lambda o, i: F.struct(o["distance"].alias("d"), (i + 1).alias("n"), o["category"].alias("c"), F.contains(o["place"], F.lit(name)).alias("ok")))
        first = F.array_min(F.filter(there, lambda x: x["ok"]))
        return F.when(first.isNull(), f"  - {name.capitalize()}: Clear").otherwise(F.format_string(f"  - {name.capitalize()}: OBJ %d (%s) at %.1fm", first["n"], first["c"], first["d"]))

    return F.array(*[line(d) for d in ("ahead", "behind", "left", "right")])


def _levels() -> Column:
    def line(level: str) -> Column:
        n = F.size(F.filter("objects", lambda o: o["risk"] == level))
        return F.when(n > 0, F.format_string(f"  - {level}: %d objects", n))

    return F.array_compact(F.array(*[line(x) for x in LEVELS]))


def observation() -> Column:
    return _lines(
        "=== PRIOR KNOWLEDGE: OBSERVATION ===", "You have access to the following information about objects in the scene:", "",
        "** Object Counts by Class **", _counts(), "", "** Objects in Scene **", _each(_at, "  - No objects detected"), "",
        "** Objects by Camera View **", _by_view(), "", _line("** Total Objects in Scene: %d **", _total()),
    )


def identification() -> Column:
    return _lines(
        "=== PRIOR KNOWLEDGE: IDENTIFICATION ===", "You have access to the following object information for identification:", "",
        "** Objects and Their Categories **", _each(_at, "  - No objects detected for identification"), "",
        "Note: Visual inspection may reveal additional attributes (color, special markings, etc.)",
    )


def attributes() -> Column:
    def line(o: Column, i: Column) -> Column:
        return F.format_string("  OBJ %d: %s (%s), %s, velocity=%s, speed=%.2f m/s, visible in %s", i, o["category"], o["place"], F.upper(o["motion"]), _velocity(o), o["speed"], _views(o))

    return _lines(
        "=== PRIOR KNOWLEDGE: ATTRIBUTES AND STATES ===", "You have access to the following state information:", "",
        "** Object Motion States **", _each(line, "  - No objects detected"), "",
        "** Ego Vehicle State **", _line("  - Motion: %s", F.upper(_ego("motion"))), _line("  - Speed: %.2f m/s (%.1f km/h)", _ego("speed"), _ego("kmh")), _line("  - Command: %s", _ego("command")), "",
        "Note: Visual attributes (lights, signals, pedestrian actions) require image inspection.",
    )


def spatial() -> Column:
    def line(o: Column, i: Column) -> Column:
        x = F.format_string("x=%.1fm %s", o["x"], F.when(o["x"] > 0, "ahead").otherwise("behind"))
        y = F.format_string("y=%.1fm %s", o["y"], F.when(o["y"] > 0, "left").otherwise("right"))
        return F.format_string("  OBJ %d: %s, distance=%.1fm, position=[%s, %s], visible in %s", i, o["category"], o["distance"], x, y, _views(o))

    return _lines(
        "=== PRIOR KNOWLEDGE: SPATIAL RELATIONSHIPS ===", "You have access to 3D position data for spatial reasoning:", "",
        "** Object Positions (Ego-centric) **", _each(line, "  - No objects detected"), "",
        "** Closest Objects by Direction **", _closest(), "",
        "Note: Occlusion relationships require visual analysis of camera images.",
    )


def signs() -> Column:
    def line(o: Column, i: Column) -> Column:
        return F.format_string("  OBJ %d: %s at distance=%.1fm, visible in %s", i, o["category"], o["distance"], _views(o))

    found = _each(line, keep=lambda o: F.lower(o["category"]).rlike("traffic|cone"))
    return _lines(
        "=== PRIOR KNOWLEDGE: TRAFFIC SIGNS AND SIGNALS ===", "Limited structured data available for traffic signs/signals.", "",
        F.when(F.size(found) == 0, F.array(F.lit("** No traffic-related objects in 3D annotations **"))).otherwise(F.concat(F.array(F.lit("** Detected Traffic-Related Objects **")), found)), "",
        "Note: Traffic signs, signals, and text require visual extraction from camera images.",
        "The VLM should analyze images to identify traffic lights, signs, and road markings.",
    )


def _place() -> list[Column]:
    return [_line("  - Location: %s", F.coalesce("location", F.lit("None"))), _line("  - Description: %s", F.coalesce("description", F.lit("None")))]


def markings() -> Column:
    return _lines(
        "=== PRIOR KNOWLEDGE: ROAD MARKINGS AND LANE CONFIGURATION ===", "Road marking information requires visual extraction from images.", "",
        "** Scene Context **", *_place(), "",
        "** Available for Visual Analysis **", "  - Lane line types (solid, dashed, double)", "  - Lane line colors (white, yellow)",
        "  - Road surface markings (arrows, text, crosswalks)", "  - Lane count and configuration", "",
        "Note: The VLM should analyze camera images (especially Front view) for lane information.",
    )


def risk() -> Column:
    def lines(o: Column, i: Column) -> Column:
        head = F.format_string("  OBJ %d: %s [%s]", i, o["category"], _views(o))
        return F.concat(head, F.lit("\n"), F.format_string("    distance=%.1fm, velocity=%s, TTC=%s, Risk=%s, closing_speed=%.2fm/s", o["distance"], _velocity(o), _ttc(o), o["risk"], o["closing"]))

    level = F.when(F.col("risk.overall_risk").isNotNull(), F.format_string("  - Overall Risk Level: %s", "risk.overall_risk"))
    earlier = F.array_compact(F.array(F.lit("** Previous VQA Risk Analysis Summary **"), level, F.format_string("  - Scene: %s", F.coalesce("risk.description", F.lit("N/A")))))
    return _lines(
        "=== PRIOR KNOWLEDGE: DYNAMIC AGENTS AND RISK ASSESSMENT ===", "Pre-computed TTC and risk metrics are available:", "",
        "** Risk Summary by Object **", _each(lines, "  - No objects detected for risk assessment"), "",
        "** Risk Level Distribution **", _levels(), "", F.when(F.col("risk").isNotNull(), earlier).otherwise(F.array().cast("array<string>")),
    )


def planning() -> Column:
    def line(o: Column, i: Column) -> Column:
        return F.format_string("  OBJ %d: %s at distance=%.1fm (%s), TTC=%s, visible in %s", i, o["category"], o["distance"], o["place"], _ttc(o), _views(o))

    return _lines(
        "=== PRIOR KNOWLEDGE: RIGHT OF WAY AND PLANNING ===", "Ego vehicle intent and scene context for planning:", "",
        "** Ego Vehicle Status **", _line("  - Driving Command: %s", _ego("command")), _line("  - Current Speed: %.2f m/s (%.1f km/h)", _ego("speed"), _ego("kmh")), _line("  - Motion State: %s", _ego("motion")), "",
        "** Nearby Objects (within 15m) **", _each(line, "  - No objects within 15m", lambda o: o["distance"] < 15), "",
        "Note: Right-of-way rules and lane restrictions require visual analysis of signs/signals.",
    )


def environment() -> Column:
    return _lines(
        "=== PRIOR KNOWLEDGE: ENVIRONMENTAL CONDITIONS ===", "Environmental information from scene metadata and visual analysis:", "",
        "** Scene Metadata **", *_place(), "",
        "** Requires Visual Analysis **", "  - Weather conditions (sunny, cloudy, rainy, foggy)", "  - Time of day (day, night, dusk, dawn)",
        "  - Road surface condition (dry, wet, icy)", "  - Visibility quality (clear, moderate, poor)", "  - Sensor/camera quality (clean, obscured)", "",
        "Note: The VLM should analyze all 6 camera views to determine environmental conditions.",
    )


def causal() -> Column:
    def line(o: Column, i: Column) -> Column:
        way = F.when(o["closing"] > 0.5, "toward").otherwise("away/parallel")
        return F.format_string("  OBJ %d: %s at distance=%.1fm, speed=%.2fm/s, heading %s, visible in %s", i, o["category"], o["distance"], o["speed"], way, _views(o))

    speed = _ego("speed")
    stop = F.when(speed > 0.5, F.format_string("  - Estimated stopping distance (comfortable): %.1fm", speed * speed / 7.0)).otherwise("  - Ego is nearly stationary, minimal stopping distance needed")
    return _lines(
        "=== PRIOR KNOWLEDGE: CAUSAL AND HYPOTHETICAL REASONING ===", "Aggregated scene information for causal/hypothetical analysis:", "",
        "** Situation Summary **", _place()[0], _line("  - Scene: %s", F.coalesce("description", F.lit("None"))),
        _line("  - Ego State: %s (%.1f km/h), command=%s", _ego("motion"), _ego("kmh"), _ego("command")), _line("  - Total Objects: %d", _total()), "",
        "** Dynamic Objects (Moving) **", _each(line, "  - No moving objects detected", lambda o: o["motion"] == "moving"), "",
        "** Physics-Based Information **", F.array(stop), "",
        "Note: Causal and hypothetical reasoning requires understanding scene dynamics from images.",
    )


PRIORS: dict[str, Callable[[], Column]] = {
    "Observation": observation,
    "Identification": identification,
    "Attributes_and_States": attributes,
    "Spatial_Relationships_and_Occlusion": spatial,
    "Traffic_Signs_and_Signals": signs,
    "Road_Markings_and_Lane_Configuration": markings,
    "Dynamic_Agents_and_Risk_Assessment": risk,
    "Right_of_Way_and_Planning": planning,
    "Environmental_and_Sensor_Conditions": environment,
    "Causal_and_Hypothetical_Reasoning": causal,
}


def prior_texts(scenes: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """sample_idx, category, prior: the text of each category for each scene, in one pass."""
    texts = F.array(*[F.struct(F.lit(c).alias("category"), PRIORS[c]().alias("prior")) for c in categories or PRIORS])
    return scenes.select("sample_idx", F.inline(texts))
