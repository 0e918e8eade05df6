"""Question-answer rows: contracts of whole results, reasoning bands, traps, disagreements, priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.functions.text import contract_reason, strip
from sceneqa.operators import ordered

#: Bounds of the number of reasoning steps by category, for other categories, and of an absent premise (fixed values).
BANDS = {
    "Observation": (2, 4),
    "Identification": (2, 4),
    "Environmental_and_Sensor_Conditions": (2, 4),
    "Traffic_Signs_and_Signals": (3, 5),
    "Road_Markings_and_Lane_Configuration": (3, 5),
    "Attributes_and_States": (3, 5),
    "Spatial_Relationships_and_Occlusion": (4, 6),
    "Dynamic_Agents_and_Risk_Assessment": (4, 6),
    "Right_of_Way_and_Planning": (5, 8),
    "Causal_and_Hypothetical_Reasoning": (5, 8),
}
ANY_BAND, ABSENT_STEPS = (2, 8), 2
#: Flags that ask for another try, and those that are only kept (fixed values).
RETRY = ["malformed_think", "band_violation", "absent_band_violation", "missing_contrast_status"]
AUDIT = ["status_mismatch", "contract_violation", "answer_null_downgraded"]
#: Signs in a reasoning trace that a contrast was seen not to change the answer (patterns, fixed values).
TRAPS = [
    r"same answer",
    r"same as the positive",
    r"answer (?:would|will|does)(?: not|n't) (?:change|differ|flip)",
    r"(?:can(?:'t|not)|unable to|not possible to|hard to|difficult to)[^.\n]{0,30}(?:create|come up with|make|find|construct|produce)[^.\n]{0,40}contrastive",
    r"no valid contrastive",
    r"contrastive[^.\n]{0,40}(?:would|will) (?:also )?(?:be|have) the same",
    r"both (?:answers?|questions?|would be|are '?(?:yes|no)'?)",
    r"have to go with",
    r"forced to (?:say|answer|pick|choose)",
    r"the positive answer will be '?no'? for all",
]
#: The vocabularies of signals (fixed values).
SIGNAL_TYPES = ["vehicle", "pedestrian", "other", "not_a_signal"]
SHAPES = ["circle", "arrow_left", "arrow_right", "arrow_straight", "pedestrian", "other", "unknown"]
COLOURS = ["red", "yellow", "green", "off", "unknown"]


def result_contract(blocks: DataFrame, key: str) -> DataFrame:
    """One row per result: accepted, and the reasons of its blocks that fail; a result without blocks is rejected.

    blocks: key, answer_type, answer, options, has_block. Null blocks are allowed and have no reason.
    """
    reason = F.when(F.col("has_block"), contract_reason(F.col("answer_type"), F.col("answer"), F.col("options")))
    g = blocks.withColumn("_reason", reason).groupBy(key)
    out = g.agg(F.count_if("has_block").alias("n"), F.array_sort(F.collect_set("_reason")).alias("reasons"))
    return out.withColumn("accepted", (F.col("n") > 0) & (F.size("reasons") == 0))


def think_flags(think: Column, category: Column, absent_swap: Column) -> Column:
    """Sorted flags of a reasoning array: missing, null or blank steps; a number of steps outside the category's band, of which
    two are always allowed; more than two where the premise is known to be absent.
    """
    least, most = F.lit(ANY_BAND[0]), F.lit(ANY_BAND[1])
    for name, (lo, hi) in BANDS.items():
        least, most = F.when(category == name, lo).otherwise(least), F.when(category == name, hi).otherwise(most)
    malformed = think.isNull() | (F.size(think) == 0) | F.exists(think, lambda t: t.isNull() | (strip(t) == ""))
    size = F.size(think)
    band = (size != ABSENT_STEPS) & ((size < least) | (size > most))
    absent = F.coalesce(absent_swap, F.lit(False)) & (size > ABSENT_STEPS)
    named = [("absent_band_violation", ~malformed & absent), ("band_violation", ~malformed & band), ("malformed_think", malformed)]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in named]))


def contrast_status(status: Column, answered: Column, positive: Column, contrast: Column) -> Column:
    """struct(status, flags) of a pair whose contrastive side is there; status: what it says of itself; answered: whether it has
    an answer; positive, contrast: comparable answers, null where they can't be compared.

    Without an answer the side counts as skipped. A side with an answer has to say `achieved` or `same_answer`, which is held
    against the answers.
    """
    known = F.when(answered & status.isin("achieved", "same_answer"), status)
    equal = positive == contrast
    wrong = F.coalesce((known == "achieved") & equal | (known == "same_answer") & ~equal, F.lit(False))
    flags = [F.when(~answered, F.lit("answer_null_downgraded")), F.when(answered & known.isNull(), F.lit("missing_contrast_status")), F.when(wrong, F.lit("status_mismatch"))]
    return F.struct(F.when(answered, known).otherwise("skipped").alias("status"), F.array_compact(F.array(*flags)).alias("flags"))


def needs_retry(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(*[F.lit(r) for r in RETRY]))


def trap_markers(response: Column) -> Column:
    """The trap patterns that hit the text before the last closing think tag, in their order."""
    parts = F.split(response, "</think>")
    before = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "</think>")
    return F.array_compact(F.array(*[F.when(before.rlike(f"(?i){p}"), F.lit(p)) for p in TRAPS]))


def has_skip(result: Column) -> Column:
    """Whether a VARIANT result has a contrastive that is null by choice (a key with null, not a missing key), or a reason."""
    value = F.try_variant_get(result, "$.contrastive", "variant")
    return F.coalesce(F.is_variant_null(value), F.lit(False)) | F.try_variant_get(result, "$.contrastive_skip_reason", "string").isNotNull()


def trap_pair(positive: Column, contrast: Column, has_contrast: Column) -> Column:
    """The class of a pair of a flagged template, by its normalised answers."""
    same = positive.eqNullSafe(contrast)
    return F.when(~has_contrast, "skipped").when(same, "honest_same").otherwise("contrast_achieved")


def trap_class(honest: Column, contrast: Column) -> Column:
    """The class of a template by the number of its pairs of either class."""
    both = F.when((honest > 0) & (contrast > 0), "mixed")
    return both.when(honest > 0, "honest_same").when(contrast > 0, "contrast_achieved").otherwise("no_comparable_pairs")


def answer_key(answer: Column) -> Column:
    return F.lower(F.trim(answer))


def nested_key(answer: Column) -> Column:
    """The key by which answers of any shape (a VARIANT) compare, never null.

    Objects compare whatever the order of their keys, at every depth: a VARIANT holds them sorted. Arrays keep their order, and a null
    inside differs from a missing key. Strings compare as answer_key(), numbers by value (1 and 1.0 are equal), a number and its digits
    as a string are equal, truth values are `True` and `False`, and a missing answer is as a null one, `None`; both differ from any
    string, which is in small letters.
    """
    kind = F.schema_of_variant(answer)
    text = F.try_variant_get(answer, "$", "string")
    word = F.when(kind == "STRING", answer_key(strip(text))).when(kind == "BOOLEAN", F.initcap(text)).when(kind == "VOID", "None")
    return F.coalesce(word, F.when(kind != "VOID", F.to_json(answer)), F.lit("None"))


def comparable(answer: Column, answer_type: Column, options: Column) -> Column:
    """A letter's option text for multiple choice (null if it names none), null for open ends, else the trimmed answer."""
    return F.when(answer_type == "open_ended", F.lit(None)).when(answer_type == "mcq", F.lower(F.try_element_at(options, F.upper(F.trim(answer))))).otherwise(answer_key(answer))


def disagreements(rows: DataFrame) -> DataFrame:
    """Counts by source, by category, and by source, prior and answer, with the number of samples of each."""
    filled = rows.select("sample_idx", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("source", "unknown"), ("category", "unknown"), ("prior_says", "?"), ("vlm_says", "?"))])
    sets = filled.groupingSets([("source",), ("category",), ("source", "prior_says", "vlm_says")], "source", "category", "prior_says", "vlm_says")
    return sets.agg(F.count("*").alias("n"), F.count_distinct("sample_idx").alias("samples"))


def signal_label(kind: Column, observable: Column, colour: Column, shape: Column, confidence: Column) -> Column:
    """A classified signal in the vocabulary: unknown kinds are `other`, unknown colours and shapes `unknown`, as they are where
    the light isn't visible; confidence in 0..1; null without a kind or visibility.
    """
    k, c, s = (F.lower(strip(x)) for x in (kind, colour, shape))
    known = F.when(k.isin(SIGNAL_TYPES), k).when(k != "", "other")
    shown = F.when(observable & c.isin(COLOURS), c).otherwise("unknown")
    lit = F.when(observable & s.isin(SHAPES), s).otherwise("unknown")
    conf = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    label = F.struct(known.alias("kind"), observable.alias("observable"), shown.alias("colour"), lit.alias("shape"), conf.alias("confidence"))
    return F.when(known.isNotNull() & observable.isNotNull(), label)


def drop_reason(score: Column, floor: float, kind: Column, rear: Column) -> Column:
    """Why a signal row goes, in order: score, not a signal, rear camera; null if it stays."""
    return F.when(score < floor, "score").when(kind == "not_a_signal", "not_a_signal").when(rear, "rear")


def preceding_tag(df: DataFrame, by: str | None, order: str, tag: str, out: str) -> DataFrame:
    """The last tag at or before each row of a group, or without `by` of the whole table."""
    if by is None:
        return ordered.locate(df, [order], F.col(tag), out)
    return df.withColumn(out, F.last(tag, True).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def crop_manifest(signals: DataFrame) -> DataFrame:
    """One row per signal: its file name is its address (split, sample, camera, signal)."""
    name = F.format_string("%s/%06d_c%d_s%03d.jpg", "split", "sample_idx", "cam_idx", "sig_idx")
    return signals.withColumn("file", name)
