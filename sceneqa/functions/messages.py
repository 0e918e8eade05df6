"""Messages, answers and references as Column expressions: assembly, parsing, grounding, options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sceneqa.functions.text import infer_choice, parse_refs, strip
from sceneqa.functions.text_udf import math_value

GROUNDING = "struct<reasoning:string,grounding:array<struct<image_idx:int,camera:string,ref:string>>,answer:string>"
LABELLED_BOX = r"([A-Za-z][\w \-]*?)\s*\(Image (\d+)(?:\s*\([^)]*\))?\s*bbox\[(-?\d+),\s*(-?\d+),\s*(-?\d+),\s*(-?\d+)\]\)"
BARE_BOX = r"bbox\[(-?\d+),\s*(-?\d+),\s*(-?\d+),\s*(-?\d+)\]"


def has_grounding(value: Column) -> Column:
    """Whether a reply is JSON with a grounding that isn't empty; anything else is false."""
    return F.coalesce(F.size(F.from_json(value, GROUNDING)["grounding"]) > 0, F.lit(False))


def valid_grounding(entries: Column) -> Column:
    """Entries (image, label, box) with a view of 1..6 and a box with area, the first of equal ones."""
    ok = F.filter(entries, lambda e: e["image"].between(1, 6) & (F.get(e["box"], 2) > F.get(e["box"], 0)) & (F.get(e["box"], 3) > F.get(e["box"], 1)))
    return F.array_distinct(ok)


def canonical_grounding(entries: Column) -> Column:
    """By view, then falling area, then left edge; equal ones stay in order."""

    def key(e: Column, i: Column) -> Column:
        b = [F.get(e["box"], k) for k in range(4)]
        return F.struct(e["image"].alias("a"), (-(b[2] - b[0]) * (b[3] - b[1])).alias("b"), b[0].alias("c"), i.alias("d"), e.alias("e"))

    return F.transform(F.array_sort(F.transform(entries, key)), lambda k: k["e"])


def reply_json(reasoning: Column, grounding: Column, answer: Column) -> Column:
    """The unified reply; a missing grounding is an empty array."""
    return F.to_json(F.struct(reasoning.alias("reasoning"), F.coalesce(grounding, F.array().cast("array<string>")).alias("grounding"), answer.alias("answer")))


def true_grounding(value: Column) -> Column:
    """The groundings of a reply whose box is valid."""
    return F.filter(parse_refs(value), lambda e: e["ok"])


def parse_boxes(text: Column) -> Column:
    """Boxes of a text: those with a label and view, then bare ones outside of these (label and view null)."""
    labelled = F.transform(
        F.regexp_extract_all(text, F.lit(LABELLED_BOX), F.lit(0)),
        lambda r: F.struct(F.trim(F.regexp_extract(r, LABELLED_BOX, 1)).alias("label"), F.regexp_extract(r, LABELLED_BOX, 2).cast("int").alias("image"), F.array(*[F.regexp_extract(r, LABELLED_BOX, i).cast("int") for i in range(3, 7)]).alias("box")),
    )
    bare = F.transform(
        F.regexp_extract_all(F.regexp_replace(text, LABELLED_BOX, ""), F.lit(BARE_BOX), F.lit(0)),
        lambda r: F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("image"), F.array(*[F.regexp_extract(r, BARE_BOX, i).cast("int") for i in range(1, 5)]).alias("box")),
    )
    return F.concat(labelled, bare)


def description(label: Column, image: Column, camera: Column, box: Column, rear: Column, width: int = 1600) -> Column:
    """`label (Image n (Camera) bbox[..])`, a rear view mirrored; the label alone without a box."""
    b = [F.get(box, i) for i in range(4)]
    x1, x2 = F.when(rear, width - b[2]).otherwise(b[0]), F.when(rear, width - b[0]).otherwise(b[2])
    return F.when(box.isNull(), label).otherwise(F.format_string("%s (Image %d (%s) bbox[%d,%d,%d,%d])", label, image, camera, x1, b[1], x2, b[3]))


def mcq_rewrite(options: Column, answer: Column) -> tuple[Column, Column]:
    """An open question as a choice: without options, A is the answer and B stands for all others."""
    open_ = options.isNull() | F.try_element_at(options, F.lit("A")).isNull()
    new = F.create_map(F.lit("A"), answer, F.lit("B"), F.lit("Other Answers"))
    return F.when(open_, new).otherwise(options), F.when(open_, "A").otherwise(answer)


def math_equal(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Equal as text whatever the case, or as numbers within a tolerance; plain numbers natively, expressions by math_value()."""
    p, q = (F.lower(strip(x)) for x in (a, b))
    plain = (p == q) | (F.abs(p.try_cast("double") - q.try_cast("double")) < tolerance)
    unsure = ~F.coalesce(plain, F.lit(False)) & p.isNotNull() & q.isNotNull() & (p.try_cast("double").isNull() | q.try_cast("double").isNull())
    x, y = (math_value(F.when(unsure, strip(v))) for v in (a, b))
    return F.coalesce(plain | (F.abs(x - y) < tolerance), F.abs(x - y) < tolerance, F.lit(False))


def post_check(response: Column, answer: Column, choices: Column) -> Column:
    """Whether a response is right: with choices the one that it names, without any the response itself, against the answer."""
    named = infer_choice(response, choices)
    return F.when(F.size(choices) > 0, F.coalesce(math_equal(named, answer), F.lit(False))).otherwise(math_equal(response, answer))


def swap_words(text: Column, a: str, b: str) -> Column:
    """Two phrases change places."""
    return F.replace(F.replace(F.replace(text, F.lit(a), F.lit("\u0000")), F.lit(b), F.lit(a)), F.lit("\u0000"), F.lit(b))


def sections(text: Column) -> Column:
    """`1. Header` lines and what follows each, as structs (header, body)."""
    parts = F.filter(F.split(text, r"(?m)(?=^\d+\.\s+\S)"), lambda p: p.rlike(r"^\d+\.\s"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"^\d+\.\s+([^\n]*)", 1)).alias("header"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))


def tagged_blocks(text: Column) -> Column:
    """`[TAG]` blocks as structs (tag, body), rule lines left out."""
    parts = F.filter(F.split(F.regexp_replace(text, r"(?m)^[-=]{3,}\s*$", ""), r"(?m)(?=^\[[A-Z_ ]+\])"), lambda p: p.rlike(r"^\[[A-Z_ ]+\]"))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\[([A-Z_ ]+)\]", 1).alias("tag"), strip(F.regexp_replace(p, r"^\[[A-Z_ ]+\]", "")).alias("body")))


def user_prompt(state: Column, question: Column, options: Column) -> Column:
    """State, task and, if there are any, options, as one prompt."""
    tail = F.when(options.isNotNull() & (options != ""), F.concat(F.lit("\n\nOptions:\n"), options)).otherwise("")
    return F.concat(state, F.lit("\n\nTASK:\n"), question, tail)


def chat(system: Column, user: Column, answer: Column, reasoning: Column) -> Column:
    """The three turns of a training sample; a reply is `answer. reasoning`."""
    reply = F.concat_ws(" ", F.concat(F.regexp_replace(F.trim(answer), r"\.+$", ""), F.lit(".")), F.nullif(F.trim(reasoning), F.lit("")))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    return F.array(turn("system", system), turn("human", user), turn("gpt", reply))


def interleave(text: Column, images: Column) -> Column:
    """Parts of a text between `<image>` marks, each mark with its image in order; fails if their numbers differ."""
    parts = F.split(text, "<image>")
    checked = F.when(F.size(parts) - 1 == F.size(images), parts).otherwise(F.raise_error(F.lit("marks and images differ")).cast("array<string>"))
    pairs = F.transform(checked, lambda p, i: F.array(F.struct(F.lit("text").alias("type"), p.alias("value")), F.struct(F.lit("image").alias("type"), F.get(images, i).alias("value"))))
    return F.filter(F.flatten(pairs), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def prompt_completion(conversations: Column) -> Column:
    """prompt (all turns but the reply) and completion of a sample; null where a turn is missing."""
    ok = (F.size(conversations) >= 3) & ~F.exists(conversations, lambda t: t["value"].isNull())
    return F.when(ok, F.struct(F.slice(conversations, 1, 2).alias("prompt"), F.slice(conversations, 3, 1).alias("completion")))


def normalized_result(parsed: Column) -> Column:
    """A VARIANT result: itself if it has pairs or a template, else the first such among its qa_results."""
    good = lambda v: F.try_variant_get(v, "$.pairs", "variant").isNotNull() | F.try_variant_get(v, "$.template_idx", "int").isNotNull()
    inner = F.try_variant_get(parsed, "$.qa_results", "array<variant>")
    return F.when(good(parsed), parsed).otherwise(F.get(F.filter(inner, good), 0))


def frame_range(start: Column, end: Column, fps: Column, total: Column) -> Column:
    """First and last frame of a span of seconds: up from the start, down from the end, inside the video; null if empty."""
    lo = F.greatest(F.lit(0), F.ceil(F.coalesce(start, F.lit(0.0)) * fps).cast("int"))
    hi = F.least(total - 1, F.coalesce(F.floor(end * fps).cast("int"), total - 1))
    return F.when(lo <= hi, F.array(lo, hi))


def frame_indices(n: Column, total: Column) -> Column:
    """n frame numbers spread evenly from the first to the last, rounded half to even."""
    last = F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(total - 1, F.rint(i * (total - 1) / last).cast("int")))


def object_line(number: Column, name: Column, x: Column, y: Column, distance: Column, ttc: Column) -> Column:
    return F.concat(F.format_string("OBJ %d: %s at (%.1f, %.1f), %.1f m", number, name, x, y, distance), F.when(ttc.isNotNull(), F.format_string(", contact in %.1f s", ttc)).otherwise(""))


def camera_views(views: Column) -> Column:
    """`Image 2 (Front) bbox[..], Image 1 (Front-left)` of an array of structs (image, camera, box), in the order of image numbers;
    a view without a box is named only. Null without views.
    """
    one = lambda v: F.concat(F.format_string("Image %d (%s)", v["image"], v["camera"]), F.when(v["box"].isNotNull(), F.format_string(" bbox[%d,%d,%d,%d]", *[F.get(v["box"], i).cast("int") for i in range(4)])).otherwise(""))
    named = F.array_join(F.transform(F.array_sort(F.transform(views, lambda v: F.struct(v["image"].alias("image"), one(v).alias("text")))), lambda v: v["text"]), ", ")
    return F.when(F.size(views) > 0, named)


def object_listing(objects: Column, most: float) -> Column:
    """The listing of a sample's objects, structs (name, distance, vx, vy, ttc, risk, views): those that a camera sees within `most`
    metres, numbered as they come, each with its cameras and boxes.
    """
    seen = F.filter(objects, lambda o: (o["distance"] <= most) & (F.size(o["views"]) > 0))
    line = lambda o, i: F.concat(
        F.format_string("OBJ %d: %s [%s]", i + 1, o["name"], camera_views(o["views"])),
        F.format_string("\n%s at distance=%.1fm from the ego, moving with velocity [vx=%.2f, vy=%.2f] visible in %s", o["name"], o["distance"], o["vx"], o["vy"], camera_views(o["views"])),
        F.when(o["risk"].isNotNull(), F.format_string("\n>> TTC = %s, Risk = %s", F.when(o["ttc"].isNotNull(), F.format_string("%.2fs", o["ttc"])).otherwise("\u221e"), o["risk"])).otherwise(""),
    )
    head = F.format_string("%d objects within %.1fm", F.size(seen), F.lit(float(most)))
    return F.when(F.size(seen) > 0, F.concat_ws("\n", head, F.array_join(F.transform(seen, line), "\n"))).otherwise(F.format_string("No objects are visible within %.1fm.", F.lit(float(most))))
