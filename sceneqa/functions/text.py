"""Text as Column expressions: cleansing, answers, references, JSON, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Object references in the order of their removal (fixed values).
REFERENCES = [
    r"(?i)\bOBJ\s+\d+\s*\([^)]*\)",
    r"(?i)\(\s*OBJ\s+\d+(?:\s*,\s*(?:OBJ\s+)?\d+)*\s*\)",
    r"(?i)\bOBJs?\s+\d+(?:\s*,\s*(?:OBJ\s+)?\d+)*",
]
#: Words of sentences that speak about the prompt's own data (fixed values).
META_KEYWORDS = [
    "spatial data", "OBJ IDs", "OBJ ids", "OBJ ID", "OBJ id", "object lists", "object list", "does not list", "pre-computed",
    "precomputed", "prior knowledge", "3D detection", "3D object detection", "provided object data", "object detection data",
]
#: Where a sentence can begin: a search that starts there alone takes a long sentence once, not once for each of its places.
BEGIN = r"(?:(?<![^.!?\n])|\G)"
#: A keyword's first letter is looked at before all keywords are tried at a place.
_FIRST = "".join(sorted({k[0].lower() for k in META_KEYWORDS}))
META = rf"(?i){BEGIN}[^.!?\n]*(?=[{_FIRST}])\b(?:" + "|".join(META_KEYWORDS) + r")\b[^.!?\n]*[.!?]?\s*"
#: Phrases and what stands for them, in order (fixed values).
PHRASES = [
    (r"(?i)no objects? with (?:a 3D position or )?OBJ IDs?", "no object"),
    (r"(?i)no objects? with an? OBJ IDs?", "no object"),
    (r"(?i)(?:the\s+)?OBJ IDs?(?:\s+and\s+(?:their\s+)?descriptions?)?", ""),
    (r"(?i)spatial database", "scene"),
    (r"(?i)spatial dataset", "scene"),
    (r"(?i)spatial data", "scene"),
    (r"(?i)object lists?", "scene"),
]
CONTROL = r"[\x00-\x08\x0B-\x0C\x0E-\x1F]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def tidy(text: Column) -> Column:
    """Empty brackets, doubled commas and runs of blanks go, whether or not anything was removed before."""
    for pattern, new in ((r"\(\s*\)", ""), (r",\s*,", ","), (r"\s{2,}", " ")):
        text = F.regexp_replace(text, pattern, new)
    return strip(text)


def _counted(text: Column, edits: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The text after the edits, and how many there were, each counted on what the one before has left."""
    n = F.lit(0)
    for pattern, new in edits:
        n, text = n + F.regexp_count(text, F.lit(pattern)), F.regexp_replace(text, pattern, new)
    return text, n


def cleanse_references(text: Column) -> Column:
    return tidy(_counted(text, [(p, "") for p in REFERENCES])[0])


def count_references(text: Column) -> Column:
    return _counted(text, [(p, "") for p in REFERENCES])[1]


def drop_meta(text: Column) -> Column:
    """Without the sentences that hold a keyword; a text that has none stays as it is."""
    return F.when(text.rlike(META), strip(F.regexp_replace(F.regexp_replace(text, META, ""), r"\s{2,}", " "))).otherwise(text)


def replace_phrases(text: Column, phrases: list[tuple[str, str]] = PHRASES) -> Column:
    return _counted(text, phrases)[0]


def cleansed(df: DataFrame, text: str) -> DataFrame:
    """The frame with the text after all three rounds, and r1, r2, r3: how much each round found."""
    out = df.withColumns({"r1": count_references(F.col(text)), text: cleanse_references(F.col(text))})
    out = out.withColumns({"r2": F.regexp_count(text, F.lit(META)), text: drop_meta(F.col(text))})
    return out.withColumns({"r3": _counted(F.col(text), PHRASES)[1], text: replace_phrases(F.col(text))})


def strip_control(text: Column) -> Column:
    """Control characters go; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, CONTROL, "")


#: Repairs of broken tokens for display, in their order (patterns and values, fixed values).
REPAIRS = [
    (r"\uFFFD~[^\s]{1,20}", ""),
    (r"::\n:\n", ":\n"),
    (r"::", ":"),
    (r"\bENUU+\b", "ENU"),
    (r"\bENU\s*U\b", "ENU"),
    (r"(?i)E\s*X+\s*X*\s*E\s*C\s*T\s*E\s*D", "EXPECTED"),
    (r"(?i)SUPPLEMENT\s*T+\s*ARY", "SUPPLEMENTARY"),
    (r"(?i)\bfeaturee\b", "feature"),
    (r"(?i)\bobjectt\s*s\b", "objects"),
    (r"\]\]\s*\n\s*m\b", "] m"),
    (r"\]\]\s*m\b", "] m"),
]


def clean_display(text: Column) -> Column:
    """Line ends unified, broken tokens repaired, three and more line feeds made two, trailing blanks cut line by line, ends stripped.

    The repairs that would follow the first one's removals (of corrupted comparison signs) find nothing any more, so they are not here.
    """
    text = F.regexp_replace(text, r"\r\n?", "\n")
    for pattern, new in REPAIRS:
        text = F.regexp_replace(text, pattern, new)
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"[\x0B\x0C\x1C-\x1E\x85\u2028\u2029]", "\n")
    return strip(F.regexp_replace(text, r"[^\S\n]+(?=\n|$)", ""))


def split_answer(text: Column, bullet_limit: int = 400, sentence_limit: int = 200) -> Column:
    """struct(answer, reasoning, how): the part before the first ` - `, else the first sentence, else all of it."""
    at = F.locate(" - ", text)
    head = F.substring(text, F.lit(1), at - 1)
    sentence = F.regexp_extract(text, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    bullet = (at > 1) & (F.length(head) <= bullet_limit)
    first = (F.length(sentence) > 0) & (F.length(sentence) <= sentence_limit)
    return F.struct(
        F.trim(F.when(bullet, head).when(first, sentence).otherwise(text)).alias("answer"),
        F.trim(F.when(bullet, F.substring(text, at + 3, F.length(text))).when(first, F.substring(text, F.length(sentence) + 1, F.length(text))).otherwise(F.lit(""))).alias("reasoning"),
        F.when(bullet, "bullet").when(first, "sentence").otherwise("whole").alias("how"),
    )


def normalize_answer(answer: Column) -> Column:
    """Trimmed, without trailing dots; a list of single letters upper-cased, sorted and joined; else lower-cased."""
    text = F.regexp_replace(F.trim(answer), r"\.+$", "")
    parts = F.filter(F.split(text, r"[,;\s]+|\band\b"), lambda p: p != "")
    letters = F.forall(parts, lambda p: p.rlike("^[A-Za-z]$")) & (F.size(parts) > 0)
    return F.when(letters, F.array_join(F.array_sort(F.transform(parts, F.upper)), ",")).otherwise(F.lower(text))


#: Parts of a reply that mean no answer: a failed call, and refusals (fixed values).
FAILED = "Failed to obtain answer via API"
REFUSALS = [
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
]


def infer_option(answer: Column, options: list[str] | Column) -> Column:
    """The one option letter that stands alone in an answer; Z for a refusal, or a Z where no option stands; null if the call
    failed, and if none or several stand. options: letters, or an array column of them.

    A stand-alone A in an answer of more than three tokens may be the article, which voids the result.
    """
    refused = F.lit(False)
    for r in REFUSALS:
        refused = refused | F.contains(answer, F.lit(r))
    letters = options if isinstance(options, Column) else F.array(*[F.lit(o) for o in options])
    tokens = F.filter(F.split(F.regexp_replace(answer, r"[.()\[\],:;!*#{}]", " "), r"\s+"), lambda t: t != "")
    found = F.array_intersect(tokens, letters)
    article = F.array_contains(tokens, "A") & (F.size(tokens) > 3)
    one = F.when((F.size(found) == 1) & ~article, F.get(found, 0)).when((F.size(found) == 0) & F.array_contains(tokens, "Z"), "Z")
    return F.when(F.contains(answer, F.lit(FAILED)), None).when(refused, "Z").otherwise(one)


def infer_by_text(answer: Column, options: dict[str, Column]) -> Column:
    """The one option whose text the answer contains."""
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(answer), F.lower(t)), F.lit(k)) for k, t in options.items()]))
    return F.when(F.size(found) == 1, F.get(found, 0))


def infer_choice(answer: Column, choices: Column) -> Column:
    """The letter of a choice that an answer names: by the letter, else by the one text among an array of choices that it contains."""
    letters = F.transform(choices, lambda c, i: F.chr(i + 65))
    held = F.filter(F.arrays_zip(letters.alias("l"), choices.alias("t")), lambda c: F.contains(F.lower(answer), F.lower(c["t"])))
    return F.coalesce(infer_option(answer, letters), F.when(F.size(held) == 1, F.get(held, 0)["l"]))


def contract_reason(answer_type: Column, answer: Column, options: Column) -> Column:
    """Why an answer breaks the rule of its type; null if it doesn't. options: a map, or null."""
    text = F.trim(answer)
    words = "zero|one|two|three|four|five|six|seven|eight|nine|ten"
    rules = (
        F.when(answer_type == "mcq", F.when(options.isNull() | (F.size(options) == 0), "no options").when(~text.rlike("^[A-E]$"), "not a letter"))
        .when(answer_type == "y_or_n", F.when(~F.lower(text).rlike(r"^(yes|no)\b"), "not yes or no"))
        .when(answer_type == "num_count", F.when(~F.lower(text).rlike(rf"^(\d+|{words})$"), "not a count"))
        .when(answer_type == "distance", F.when(~text.rlike(r"\d"), "no digit"))
        .when(answer_type == "open_ended", F.when(F.length(text) < 2, "too short"))
        .otherwise(F.lit("unknown type"))
    )
    stray = (answer_type != "mcq") & options.isNotNull() & (F.size(options) > 0)
    return F.when(answer.isNull() | (text == ""), "empty").when(stray, "stray options").otherwise(rules)


#: The grounding tokens of replies (fixed values).
REF_START, REF_END, BOX_START, BOX_END = "<|object_ref_start|>", "<|object_ref_end|>", "<|box_start|>", "<|box_end|>"
LABEL = r"<\|object_ref_start\|>(.*?)<\|object_ref_end\|>"
BOX = r"<\|box_start\|>\((\d+),(\d+)\),\((\d+),(\d+)\)<\|box_end\|>"
_BOX = r"<\|box_start\|>\((\d+,\d+\),\(\d+,\d+)\)<\|box_end\|>"  # its numbers in one group
GROUNDING = "struct<grounding:array<struct<image_idx:int,camera:string,ref:string>>>"


def render_ref(label: Column, box: list[Column]) -> Column:
    """A label and its box between the grounding tokens."""
    told = [F.coalesce(c, F.lit("null")) for c in (label.cast("string"), *[b.cast("bigint").cast("string") for b in box])]
    marks = [F.lit(m) for m in (REF_START, f"{REF_END}{BOX_START}(", ",", "),(", ",", f"){BOX_END}")]
    return F.concat(marks[0], *[part for pair in zip(told, marks[1:], strict=True) for part in pair])


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once, wherever fn names it: inside lambdas Spark computes an expression at each place anew."""
    return F.get(F.transform(F.array(value), fn), 0)


def _entry(image: Column, label: Column, box: Column) -> Column:
    """struct(image, label, box, ok): the four numbers found; a box is ok with an area and numbers up to 1000, else it is null."""
    fits = lambda b: (F.get(b, 0) < F.get(b, 2)) & (F.get(b, 1) < F.get(b, 3)) & F.forall(b, lambda v: v.between(0, 1000))
    told = lambda b: F.struct(b.alias("box"), fits(b).alias("ok"))
    entry = lambda t: F.struct(image.cast("int").alias("image"), F.coalesce(strip(label), F.lit("")).alias("label"), F.when(t["ok"], t["box"]).alias("box"), t["ok"].alias("ok"))
    return _let(_let(box, told), entry)


def _numbers(text: Column) -> Column:
    """The four numbers of the first box of a text that has one."""
    return F.transform(F.split(F.regexp_extract(text, _BOX, 1), r"\D+"), lambda v: v.try_cast("bigint"))


def parse_refs(value: Column) -> Column:
    """The groundings of a reply as structs (image, label, box, ok).

    Of a JSON reply: its grounding entries with a view of 1..6 and a box. Of any other text: its boxes in order, each with
    the last view named before it and the last label since the box before; a box without such a view is left out.
    """
    known = lambda entries: F.filter(entries, lambda g: g["image_idx"].between(1, 6) & g["ref"].rlike(BOX))
    whole = lambda entries: F.transform(known(entries), lambda g: _entry(g["image_idx"], F.regexp_extract(g["ref"], LABEL, 1), _numbers(g["ref"])))
    parts = rf'(?s)"image_idx"\s*:\s*(\d+)|{LABEL}|{BOX}'
    none = F.struct(F.lit(None).cast("int").alias("image"), F.lit(None).cast("string").alias("label"), F.array().cast("array<struct<image:int,label:string,box:array<bigint>,ok:boolean>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        view, name = F.regexp_extract(part, parts, 1), F.regexp_extract(part, parts, 2)
        is_view, is_name = part.startswith('"image_idx"'), part.startswith(REF_START)
        fits = ~is_view & ~is_name & state["image"].between(1, 6)
        out = F.when(fits, F.concat(state["out"], F.array(_entry(state["image"], state["label"], _numbers(part))))).otherwise(state["out"])
        label_ = F.when(is_name, name).when(fits, F.lit(None)).otherwise(state["label"])
        return F.struct(F.when(is_view, view.try_cast("int")).otherwise(state["image"]).alias("image"), label_.alias("label"), out.alias("out"))

    def read(text: Column) -> Column:
        scanned = F.aggregate(F.regexp_extract_all(text, F.lit(parts), F.lit(0)), none, step)["out"]
        # a text that can't have the field, its name escaped or not, isn't parsed: failures cost most
        named = F.contains(text, F.lit("grounding")) | F.contains(text, F.lit("\\u"))
        return _let(F.when(named, F.from_json(text, GROUNDING)["grounding"]), lambda entries: F.when(entries.isNotNull(), whole(entries)).otherwise(scanned))

    return _let(value, read)


def mask_near(text: Column, word: str, replacement: str) -> Column:
    """Sentences that hold a word give way to a replacement."""
    return F.regexp_replace(text, rf"(?i){BEGIN}[^.!?\n]*\b{word}\b[^.!?\n]*[.!?]?", replacement)


def task_question(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"(?s)TASK:\s*\n(.*?)(?:\n\nOptions:|$)", 1)


def after_thinking(response: Column) -> Column:
    """What follows the last closing think tag."""
    return F.trim(F.substring_index(response, "</think>", -1))


def tolerant_json(response: Column) -> Column:
    """The first rung of a ladder that parses: all of it, a fenced block, the widest object, the widest array."""
    body = after_thinking(response)
    rungs = [body, F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.regexp_extract(body, r"(?s)(\[.*\])", 1)]
    return F.coalesce(*[F.try_parse_json(F.nullif(r, F.lit(""))) for r in rungs])


def extract_answer(value: Column) -> Column:
    """The answer field of a JSON text, else what follows `"answer":`."""
    return F.coalesce(F.get_json_object(value, "$.answer"), F.nullif(F.regexp_extract(value, r'"answer"\s*:\s*"([^"]*)"', 1), F.lit("")))


def replace_first(text: Column, old: Column | str, new: Column | str) -> Column:
    """The first occurrence of a literal alone."""
    old, new = (F.lit(x) if isinstance(x, str) else x for x in (old, new))
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def render_options(options: Column) -> Column:
    """`A. text` lines in the order of letters."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(options)), lambda k: F.concat(k, F.lit(". "), F.element_at(options, k))), "\n")


def provenance(sample: Column, template: Column, pair: Column, positive: Column) -> Column:
    return F.format_string("s%04d_t%03d_p%s_%s", sample, template, pair.cast("string"), F.when(positive, "pos").otherwise("con"))


def md5_token(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def normalize_path(path: Column, root: str, prefix: str = "data/") -> Column:
    path = F.regexp_replace(F.regexp_replace(path, r"^\./", ""), f"^{prefix}", "")
    return F.concat_ws("/", F.lit(root), path)


def risk_summary(text: Column) -> Column:
    """The first level named in the line after the last `Overall Risk Level`."""
    tail = F.substring_index(text, "Overall Risk Level", -1)
    line = F.regexp_extract(tail, r"^[^\n]*", 0)
    hit = F.regexp_extract(line, r"(Low|Moderate|High)", 1)
    return F.when(F.contains(text, F.lit("Overall Risk Level")), F.nullif(hit, F.lit("")))
