"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words, runs of punctuation, and pairs of neighbours, in BUCKETS bins) are
counted: one of the target, the labelled good texts, and one of the raw text, all documents. The weight of a document is
the log ratio of its probability under both. Documents are sampled in proportion to it by Gumbel top-k: the k largest
sums of weight and Gumbel noise, where the noise depends on doc_id and text. Their exact border is found by counting,
never by sorting in one place. Beside the sample, a document is rejected if its weight per n-gram falls below the
border that separates labelled good from bad texts best.

keep() resamples a corpus with truncated weights: a text at the border or over it has the log weight 0, one below it has as
much less as its n-grams together lack. Gumbel top-k takes as many documents as lie at the border or over it, so all
of these stand the same chance, and a text below enters in place of one only if it lacks a few nats at most.

Counts of raw text cover every document. The labelled rows are a bounded sample: the LABELLED ids with the smallest
hash; that is the only limit. A pair of equal words counts as one n-gram of its own, whatever the word, so that
texts that repeat themselves differ from others.

Null and empty texts hold no n-gram: weight 0, and they are rejected if bad labelled texts exist. Repeated rows are
scored each and get equal noise. Ties at the border of the sample fall in the order of doc_id, and rows that share that too
in the order in which they are read, so score() samples as many as asked; keep() takes all repeats of the row at its border.
Without labels of both kinds nothing is rejected. An empty table gives no rows. Further columns are ignored by score() and kept
by keep().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneqa.llm.common import WORDS_AND_MARKS, Workspace, byte_view, groups, hash_spans, mix, per_value, spans, text_array

BUCKETS = 10_000
#: Labelled documents that are read at most.
LABELLED = 20_000
#: Parts of the documents that resampling takes.
SHARE = 0.5
SMOOTH = 1.0


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bins of the n-grams of some texts at a time, the text of each, and the number of texts."""
    raw, offsets = byte_view(texts)
    for i, j in groups(offsets):
        data, bounds = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = spans(data, bounds, WORDS_AND_MARKS)
        first = per_value(starts, bounds)
        doc = np.repeat(np.arange(j - i), np.diff(first))
        h = hash_spans(data, starts, ends)
        same_doc = doc[1:] == doc[:-1]
        pair = mix(h[:-1] * np.uint64(3) + h[1:], 5)
        pair[h[:-1] == h[1:]] = np.uint64(BUCKETS - 1)
        bins = np.concatenate([h % np.uint64(BUCKETS - 1), np.where(pair == BUCKETS - 1, pair, pair % np.uint64(BUCKETS - 1))[same_doc]]).astype(np.int64)
        yield bins, np.concatenate([doc, doc[1:][same_doc]]), j - i


@dataclass
class Model:
    """log ratio of each bin, and the border below which the weight per n-gram is that of a bad text (None: no border)."""

    ratio: np.ndarray
    border: float | None = None

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The log importance of each text, and its number of n-grams."""
        total, many = [np.zeros(0)], [np.zeros(0, np.int64)]
        for bins, doc, n in features(texts):
            total.append(np.bincount(doc, self.ratio[bins], n))
            many.append(np.bincount(doc, minlength=n))
        return np.concatenate(total), np.concatenate(many)


def labelled(labels: DataFrame, ws: Workspace, most: int) -> DataFrame:
    """doc_id, quality of the labelled sample: `most` rows at most, which bounds what is broadcast."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return ws.table(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")


def fit(docs: DataFrame, labels: DataFrame, ws: Workspace, most: int = LABELLED) -> Model:
    sample = F.broadcast(labelled(labels, ws, most))
    tagged = docs.select("doc_id", "text").join(sample, "doc_id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            good = np.array([q == 1 for q in batch.column(2).to_pylist()], bool)
            at = 0
            for bins, doc, n in features(text_array(batch)):
                sums[0] += np.bincount(bins, minlength=BUCKETS)
                sums[1] += np.bincount(bins[good[at : at + n][doc]], minlength=BUCKETS)
                at += n
        keep = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(sums[0][keep]), pa.array(sums[1][keep])], names=["bin", "raw", "target"])

    counted = tagged.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(count, "bin bigint, raw bigint, target bigint")
    sums = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows
        sums[:, r.bin] = r.raw, r.target
    p = np.log((sums + SMOOTH) / (sums.sum(1, keepdims=True) + SMOOTH * BUCKETS))
    model = Model(p[1] - p[0] if sums[1].any() else np.zeros(BUCKETS))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, n = model.weigh(text_array(batch))
            yield pa.RecordBatch.from_arrays([pa.array(w / np.maximum(n, 1)), batch.column(2)], names=["mean", "quality"])

    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(weigh, "mean double, quality int").groupBy("quality", F.round("mean", 4).alias("mean")).count().collect()
    model.border = border([(r["mean"], r["quality"], r["count"]) for r in rows])
    return model


def border(rows: list[tuple[float, int, int]]) -> float | None:
    """The value below which bad texts lie, with the fewest errors, an error on a good text counting twice."""
    good, bad = sum(n for _, q, n in rows if q == 1), sum(n for _, q, n in rows if q != 1)
    if not good or not bad:
        return None
    rows = sorted(rows)
    cost = best = bad
    at, k = rows[0][0] - 1e-9, 0
    while k < len(rows):
        value = rows[k][0]
        while k < len(rows) and rows[k][0] == value:
            cost += 2 * rows[k][2] if rows[k][1] == 1 else -rows[k][2]
            k += 1
        if cost < best:
            best, at = cost, (value + rows[k][0]) / 2 if k < len(rows) else value + 1e-9
    return at


NONE = -(2**63)
KEYS = "doc_id bigint, row bigint, log_weight double, n_grams bigint, mean_weight double, accepted boolean, key double"


def _keys(docs: DataFrame, model: Model, seed: int, truncated: bool) -> DataFrame:
    """KEYS: row numbers those of a written table; key: weight (truncated: at the border) and noise."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for batch in batches:
            w, n, mean, ok, key = _sampled(batch, model, seed, truncated)
            cols = [batch.column(0), pa.array(at + np.arange(len(w))), pa.array(w), pa.array(n), pa.array(mean), pa.array(ok), pa.array(key)]
            at += len(w)
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in KEYS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(weigh, KEYS)


def _sampled(batch: pa.RecordBatch, model: Model, seed: int, truncated: bool) -> tuple[np.ndarray, ...]:
    """Log weight, n-grams, weight per n-gram, whether it is accepted, and the key of each row of doc_id and text."""
    texts, names = text_array(batch), batch.column(batch.schema.get_field_index("doc_id"))
    w, n = model.weigh(texts)
    mean = w / np.maximum(n, 1)
    ok = np.ones(len(w), bool) if model.border is None else (n > 0) & (mean >= model.border)
    data, bounds = byte_view(texts)
    ids = np.array([NONE if d is None else d for d in names.to_pylist()], np.int64).view(np.uint64)
    noise = mix(mix(ids, seed + 1) ^ hash_spans(data, bounds[:-1], bounds[1:]), seed + 2)
    u = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    weight = w
    if truncated:
        lack = np.zeros(len(w)) if model.border is None else np.where(n > 0, w - model.border * n, -np.inf)
        weight = np.where(ok, 0.0, np.minimum(lack, 0.0))
    return w, n, mean, ok, weight - np.log(-np.log(u))


def score(docs: DataFrame, model: Model, share: float = SHARE, seed: int = 0, ws: Workspace | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, mean_weight, accepted, sampled."""
    rows = (ws or Workspace(docs.sparkSession, "quality")).table(_keys(docs, model, seed, False), "weights")
    key, doc, row = top_border(rows, share)
    name = F.coalesce("doc_id", F.lit(NONE))
    tied = (name < doc) | (name == doc) & (F.col("row") <= row)
    return rows.withColumn("sampled", (F.col("key") > key) | (F.col("key") == key) & tied).drop("key", "row")


def top_border(rows: DataFrame, share: float | None = None, want: int | None = None) -> tuple[float, int, int]:
    """The key, doc_id and row of the last of the largest keys, a share or a number of them; counts of 4,096 ranges narrow it down."""
    stats = rows.agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    want = int(round(stats.n * share)) if want is None else want
    if not want:
        return float("inf"), NONE, 0
    if want >= stats.n:
        return float("-inf"), 2**63 - 1, 2**63 - 1
    finite = rows.where(F.col("key") > float("-inf"))
    lo, hi, above = finite.agg(F.min("key")).first()[0], stats.hi, 0  # above: rows with a key over hi
    if lo is None:
        lo = hi
    for _ in range(12):
        if not hi > lo:
            break
        step = (hi - lo) / 4096
        bin_ = F.least(F.lit(4095), F.greatest(F.lit(0), F.floor((F.col("key") - F.lit(lo)) / F.lit(step))))
        held = {r.b: (r.n, r.lo, r.hi) for r in rows.where(F.col("key").between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()}
        for b in sorted(held, reverse=True):
            n, lo, hi = held[b]
            if above + n >= want:
                break
            above += n
        else:  # only rows of no weight at all are left
            lo = hi = float("-inf")
    tied = rows.where(F.col("key") == hi).select(F.coalesce("doc_id", F.lit(NONE)).alias("d"), "row")
    doc, left = _nth(tied, "d", want - above)
    return hi, doc, _nth(tied.where(F.col("d") == doc), "row", left)[0]


def _nth(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The n-th smallest value of a column, and its place among the rows that have it; by counting."""
    stats = rows.agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = stats.low, stats.high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if rows.where(F.col(column) <= mid).count() >= n else (mid + 1, high)
    return low, n - rows.where(F.col(column) < low).count()


def keep(docs: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """The rows that Gumbel top-k takes with truncated weights: as many as are not rejected (and repeats of the last one)."""
    if model.border is None:
        return docs
    rows = Workspace(docs.sparkSession, "quality-keep").table(_keys(docs, model, seed, True), "keys")
    key, doc, _ = top_border(rows, want=rows.where("accepted").count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _sampled(batch, model, seed, True)[-1]
            ids = np.array([NONE if d is None else d for d in batch.column(batch.schema.get_field_index("doc_id")).to_pylist()], np.int64)
            yield batch.filter(pa.array((own > key) | (own == key) & (ids <= doc)))

    return docs.mapInArrow(run, docs.schema)
