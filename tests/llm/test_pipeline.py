"""corpus_pipeline.run() against plain Python of all five stages."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from sceneqa.llm import pii, quality

from .conftest import prose
from .test_neardup import brute, copies

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder):
    """Good and poor texts, exact and near copies, passages of the benchmark, personal data, and the odd cases."""
    item = prose(900, 40)
    poor = [(5000 + i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(60)]
    good = [(i, prose(i, 90)) for i in range(1, 60)]
    leaked = [(300 + i, f"{prose(300 + i, 60)} {item} {prose(400 + i, 30)}") for i in range(3)] + [(310, item.upper()), (311, " ".join(item.split()[:9]) + " " + prose(311, 50))]
    private = [(320 + i, f"{prose(320 + i, 50)} write to jo{i}@mail.example.com or +49 30 123456{i}, since 2001-02-0{i + 1}. {prose(330 + i, 20)}") for i in range(4)]
    texts = [*good, *poor, *leaked, *private, *copies(30, 120, 2, 21), (2, prose(2, 90)), (401, prose(5, 90)), (402, None), (403, ""), (None, prose(777, 60))]
    rows = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in poor[:40]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, item), (2, "..."), (3, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, labels, [t for _, t in items if t]


def accepted(texts, labels):
    """Log ratios of counted bins; the border with the fewest errors, those on good texts counting twice."""
    m = quality.BUCKETS - 1

    def bins(text):
        h = [int(quality.hash_spans(d := np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(d)]))[0]) for w in re.findall(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]+", text or "")]
        pair = lambda a, b: m if a == b else int(quality.mix(np.array([(a * 3 + b) % 2**64], np.uint64), 5)[0]) % m
        return [x % m for x in h] + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]

    mark = {i: q for i, q, _ in labels}
    raw, target = collections.Counter(), collections.Counter()
    held = [bins(t) for _, t in texts]
    for (i, _), b in zip(texts, held, strict=True):
        raw.update(b)
        target.update(b if mark.get(i) == 1 else [])
    p = lambda c, b: np.log((c[b] + 1) / (c.total() + quality.BUCKETS))
    mean = [sum(p(target, x) - p(raw, x) for x in b) / max(1, len(b)) for b in held]
    known = [(v, mark[i]) for v, (i, _) in zip(mean, texts, strict=True) if i in mark]
    cuts = sorted({v for v, _ in known})
    border = min([cuts[0] - 1, *((a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False)), cuts[-1] + 1], key=lambda c: sum(2 * (q == 1 and v < c) + (q == 0 and v >= c) for v, q in known))
    return [row for row, v, b in zip(texts, mean, held, strict=True) if b and v >= border]


def without(text, items, window=10):
    """The text without the words that windows of items cover, if these runs have 10 words or are over half; None if no word is left."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    word = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    windows = set()
    for t in items:
        w = word.findall(low(t))
        windows |= {tuple(w[k : k + window]) for k in range(len(w) - window + 1)}
    found = list(word.finditer(low(text)))
    w, hit = [m[0] for m in found], set()
    for k in range(len(w) - window + 1):
        if tuple(w[k : k + window]) in windows:
            hit |= set(range(k, k + window))
    if hit and len(hit) == len(w):
        return None
    out, k = text, len(w) - 1
    while k >= 0:
        if k in hit:
            end = found[k].end()
            while k - 1 in hit:
                k -= 1
            out = out[: found[k].start()] + out[end:]
        k -= 1
    return out


def test_pipeline(spark, tmp_path, tokenizers_dir):
    from tokenizers import Tokenizer

    folder = f"file://{tmp_path}"
    texts, labels, items = tables(spark, folder)
    left = accepted(texts, labels)
    assert {i for i, _ in left} == {i for i, _ in texts} - {402, 403} - set(range(5000, 5060))
    left = [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in brute(left)]
    clean = [(i, without(t, items)) for i, t in left]
    clean = [(i, pii.replace(t, pii.DEMO_KEY)) for i, t in clean if t is not None]
    tok = Tokenizer.from_file(tokenizers_dir.path("byte_bpe_50k.json"))
    want = sorted(((i, tuple(tok.encode(t, add_special_tokens=False).ids + [0])) for i, t in clean), key=str)
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, folder).collect():
        pieces[p.doc_id, p.sequence_id * 1024 + p.offset - p.start].append((p.start, np.frombuffer(p.ids, "<u2").tolist()))
    got = sorted(((i, tuple(x for _, part in sorted(parts) for x in part)) for (i, _), parts in pieces.items()), key=str)
    assert got == want
    assert any("@mail.example.com" in t for _, t in clean) and not any(f"jo{i}@" in t for i in range(4) for _, t in clean)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, folder).columns == none.columns and stage(spark, none, folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, none, folder).count() == 0


@pytest.mark.parametrize("text, want", [("a b", "a b"), ("...", "...")])
def test_texts_without_passages_stay(text, want):
    assert without(text, [prose(1, 40)]) == want
