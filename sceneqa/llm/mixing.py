"""Mixing sources to target weights: hash-random keys, a range sort within each source, prefix sums of sizes, an exact cut.

Each document has a random key, the hash of a seed and its id, which is the same in every run. Keys are uniform, so their
leading bits are the ranges of the sort: about the root of the number of documents for each source, as many as a range
holds documents. Sums over the ranges give what stands before each (one scan of ranges for a source), a scan
within a range the place of each document. A source's budget is taken as whole epochs and a cut of the last one, at the
word; so what a source gives differs from its target by half a word at most.

Targets: sources in order of their code points, null last, have the weights in turn and share `total` by them; a source
gives `most` times its size at most, and what is above is shared anew by weight until nothing is. That is a level L with
sum(min(most * size, L * weight)) = total, found from prefix sums over the sources in order of most * size / weight, so neither
the number of sources nor that of documents has to fit one task.

Rows with equal doc_id, source and text are counted before they travel and told apart by their number only. A null text has
size 0, a null doc_id the key of the empty string, a null source is a source of its own. A source without words has the target 0. An
empty table gives no rows. Further columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneqa.llm.common import Workspace
from sceneqa.operators.ordered import Ranges

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in turn, and how often a source is repeated at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Bits of a key: 15 hexadecimal digits of an MD5, which SQL of any engine can give.
KEY_BITS = 60


def _key(seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, unnamed, source (empty where unnamed), size, key, digest of each row; the only reading of texts."""
    none = F.col("source").isNull()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", none.alias("unnamed"), F.coalesce("source", F.lit("")).alias("source"), size.alias("size"), _key(seed).alias("key"), F.xxhash64("text").alias("digest"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float | None = None, most: float = MOST) -> DataFrame:
    """unnamed, source, source_size, weight, target of rows (unnamed, source, source_size), one a source."""
    if min(weights) <= 0:
        raise ValueError("weights must be above 0")
    ranked = Ranges(sizes, ["unnamed", "source"]).scan(sums={"rank": F.lit(1).cast("bigint")}).drop("_range")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * float(most)
    weighed = ranked.select("unnamed", "source", "source_size", turn.alias("weight"), cap.alias("cap"), (cap / turn).alias("ratio"))
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    asked = float(total if total is not None else whole.size or 0)
    upto = Ranges(weighed, ["ratio", "unnamed", "source"]).scan(sums={"caps": "cap", "weights": "weight"}).drop("_range")
    held = F.col("caps") + F.col("ratio") * ((whole.weight or 0.0) - F.col("weights")) <= asked
    full = upto.where(held).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    free = (whole.weight or 0.0) - (full.weight or 0.0)
    level = (asked - (full.cap or 0.0)) / free if free > 0 else math.inf
    return weighed.select("unnamed", "source", "source_size", "weight", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, ws: Workspace, weights: tuple[float, ...] = WEIGHTS, total: float | None = None, most: float = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, source, digest, size, source_size, target, place (words before it in its source's order), epochs (whole uses), taken.

    `taken` counts the words of all uses: epochs * size, and for documents before the cut, or at it, size or the part before it.
    """
    rows = ws.table(sized(docs, seed), "sized")
    bits = min(KEY_BITS, math.ceil(math.log2(max(rows.count(), 1)) / 2))
    rows = rows.withColumn("range", F.shiftright("key", KEY_BITS - bits))
    ranges = rows.groupBy("unnamed", "source", "range").agg(F.sum("size").alias("n"))
    plan = targets(rows.groupBy("unnamed", "source").agg(F.sum("size").alias("source_size")), weights, total, most)
    plan = plan.withColumn("budget", F.least(F.floor(F.col("target") + 0.5), F.floor(F.col("source_size") * float(most))))
    some = F.col("source_size") > 0
    plan = plan.withColumn("epochs", F.when(some, F.expr("budget div source_size")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    plan = ws.table(plan.drop("weight", "budget"), "plan")
    over = Window.partitionBy("unnamed", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.join(plan, ["unnamed", "source"]).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).drop("n")
    same = rows.groupBy("unnamed", "source", "range", "key", "doc_id", "size", "digest").agg(F.count("*").alias("copies"))
    inner = Window.partitionBy("unnamed", "source", "range").orderBy("key", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inner), F.lit(0))).join(before, ["unnamed", "source", "range"])
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    place = F.col("before") + F.col("inside") + F.col("copy") * F.col("size")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("place")))
    each = each.withColumn("place", place).withColumn("taken", F.col("epochs") * F.col("size") + cut)
    return each.select("doc_id", F.when(~F.col("unnamed"), F.col("source")).alias("source"), "digest", "size", "source_size", "target", "place", "epochs", "taken")


def expand(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """doc_id, source, epoch, text: the texts of the mix, a row for each use; a document at the cut gives its first words, joined by a space."""
    use = mixed.where("taken > 0").select("doc_id", "source", "digest", "size", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))).alias("epoch"))
    left = F.col("taken") - (F.col("epoch") - 1) * F.col("size")
    once = docs.select("doc_id", "source", F.xxhash64("text").alias("digest"), "text").dropDuplicates(["doc_id", "source", "digest"])
    names = ("doc_id", "source", "digest")
    both = use.join(once.select(*[F.col(c).alias(f"_{c}") for c in names], "text"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, left.cast("int")), " ")
    return both.select("doc_id", "source", "epoch", F.when(left < F.col("size"), part).otherwise(F.col("text")).alias("text"))
