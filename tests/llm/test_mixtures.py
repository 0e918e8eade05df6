"""Mixing, periodic runs and the filter audit against brute force."""

import collections
import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest

from sceneqa.llm import interaction, mixing, periodic, queries
from sceneqa.llm.common import Workspace

from .conftest import DOCS, prose
from .test_operators import blank_words

# op11


def plain_targets(sizes, weights, total, most):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), total
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


SOURCES = [("b", 40), ("B", 7), ("é", 90), (None, 30), ("", 2), ("a", 0)]


def sources_table(spark, rng):
    rows, ids = [], iter(range(10_000))
    for source, n in SOURCES:
        rows += [(next(ids), prose(rng.randrange(1 << 30), rng.randrange(1, 60)), source, "clash") for _ in range(n)]
    rows += [(next(ids), None, "a", "clash"), (next(ids), "", "a", "clash"), (None, prose(1, 30), "b", "x"), (5, rows[5][1], "b", "x"), (5, rows[5][1], "b", "x")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, source string, size string").repartition(5)


@pytest.mark.parametrize("weights, share, most", [((5, 2, 1), 1.0, 3), ((1,), 0.2, 3), ((1, 100), 2.9, 3), ((5, 2, 1), 7.0, 3), ((2, 1), 1.0, 1)])
def test_mix_reaches_its_targets(spark, weights, share, most):
    rows, docs = sources_table(spark, random.Random(3))
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(blank_words(text))
    total = share * sum(sizes.values())
    want = plain_targets(sizes, weights, total, most)
    got = mixing.mix(docs, Workspace(spark, "t"), weights, total, most).collect()
    assert sorted(((r.doc_id, r.size, r.source) for r in got), key=str) == sorted(((d, len(blank_words(t)), s) for d, t, s, _ in rows), key=str)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.epochs * r.size <= r.taken <= min((r.epochs + 1) * r.size, math.ceil(most * r.size))
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-9
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.source].append((r.place, r.size, r.taken - r.epochs * r.size))
    for places in by_source.values():  # places follow one another; once the cut is met nothing is taken
        at, cut = 0, False
        for place, size, extra in sorted(places, key=lambda p: (p[0], p[1])):
            assert place == at and not (cut and extra)
            at, cut = at + size, cut or extra < size


def test_mix_is_the_same_in_every_run(spark):
    _, docs = sources_table(spark, random.Random(3))
    a, b = (sorted(mixing.mix(d, Workspace(spark, "t")).collect(), key=str) for d in (docs, docs.repartition(2, "text")))
    assert a == b


def test_mix_expands_to_texts(spark):
    rows, docs = sources_table(spark, random.Random(4))
    mixed = mixing.mix(docs, Workspace(spark, "t"))
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.doc_id, r.source] += r.taken
    texts = {(d, s): t for d, t, s, _ in rows}
    out = collections.Counter()
    for r in mixing.expand(docs, mixed).collect():
        whole = blank_words(texts[r.doc_id, r.source])
        assert blank_words(r.text) == whole[: len(blank_words(r.text))]
        out[r.doc_id, r.source] += len(blank_words(r.text))
    assert out == +taken


def test_mix_of_odd_rows(docs, empty, spark):
    assert len(mixing.mix(docs, Workspace(spark, "t")).collect()) == len(DOCS)
    assert mixing.mix(empty, Workspace(spark, "t")).collect() == []
    assert [(r.target, r.taken) for r in mixing.mix(docs.where("doc_id = 4"), Workspace(spark, "t")).collect()] == [(0.0, 0)]
    with pytest.raises(ValueError):
        mixing.mix(docs, Workspace(spark, "t"), weights=(1, 0)).collect()


# op12


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // periodic.TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(periodic.LEAST, periodic.TIMES * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def odd_words(rng):
    out, letters = [], rng.choice([2, 3, 30])
    while len(out) < rng.randrange(10, 400):
        piece = [rng.randrange(letters) for _ in range(rng.randrange(1, 30))]
        out += (piece * rng.randrange(1, 9))[: rng.randrange(1, 90)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(5)
    docs = [odd_words(rng) for _ in range(150)] + [[], [1], [1] * 23, [1] * 24, [1, 2] * 12, [0] * 2_000, list(range(50)) * 3]
    got = periodic.find_runs(np.array([w for d in docs for w in d]), np.array([len(d) for d in docs]))
    assert got == [plain_runs(d) for d in docs]


def test_lag_counts_equal_brute_force():
    rng = random.Random(6)
    docs = [odd_words(rng) for _ in range(40)] + [[7] * 500 + list(range(90))]
    counts, first = periodic.lag_counts(np.array([w for d in docs for w in d]), np.array([len(d) for d in docs]))
    for d, words in enumerate(docs):
        for q in range(1, len(words) // 3 + 1):
            assert counts[first[d] + q] == sum(a == b for a, b in zip(words, words[q:], strict=False))


def test_best_run_is_exact():
    assert periodic.best_run([(0, 3 * 10**9 + 1, 10**9), (5, 30, 10), (7, 3 * 10**9 + 2, 10**9)]) == (7, 3 * 10**9 + 2, 10**9)
    assert periodic.best_run([(0, 24, 8), (4, 24, 8)]) == (0, 24, 8) and periodic.best_run([]) is None


def planted(doc_id, words):
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_periodic_query(spark, tmp_path):
    rows = [(i, t) for i, t in DOCS] + [(100 + i, prose(i, 30 + i)) for i in range(60)] + [(200, "x y " * 40), (201, "Wort\tWort\n" * 12)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, collapsed string, n_words int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        words = planted(i, blank_words(text)) if i is not None else blank_words(text)
        runs = plain_runs(words)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for x, w in enumerate(words) if x not in gone))))
    assert sorted(map(tuple, queries.op12_periodic(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want) and periodic.find(docs.limit(0)).collect() == []
    assert periodic.find(docs.where("text is null")).first().collapsed is None


# op13


def plain_audit(docs, labels):
    first, marks = {}, collections.defaultdict(lambda: [False, False])
    for i, _, text in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, quality, toxic in labels:
        if i is not None:
            marks[i] = [marks[i][0] or quality == 1, marks[i][1] or toxic == 1]
    rows = []
    for i, lang, text in docs:
        text = text or ""
        words = blank_words(text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and text in first and first[text] < i,
        }
        rows.append((lang or "", {f for f in fails if fails[f]}, *(marks[i] if i is not None else (False, False))))
    out, shapley = [], collections.Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                alive = [r for r in own if not r[1] & set(order[: step - 1])]
                hit = [r for r in alive if f in r[1]]
                shapley[part, f] += len(hit)
                redundant = sum(f in r[1] for r in own) - len(hit)
                out.append((part, "".join(order), step, len(alive) - len(hit), len(hit), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in hit), sum(r[3] for r in hit), f))
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


@pytest.mark.parametrize("heavy", [interaction.HEAVY, 3])
def test_audit_equals_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(interaction, "HEAVY", heavy)
    rng = random.Random(7)
    texts = [None, "", "SHOUT " * 30, "a$ b", prose(1, 130), prose(2, 150) + " #", "x " * 120, "ÄÖÜ " * 110]
    docs = [(rng.choice([None, *range(60)]), rng.choice([None, "", "en", "de"]), rng.choice([*texts, prose(i, 90 + i)])) for i in range(120)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(70)]
    frame = spark.createDataFrame([(*d, 9, "x") for d in docs], "doc_id bigint, lang string, text string, part int, digest string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    ws = Workspace(spark, "t")
    got = interaction.audit(interaction.flagged(frame, marks, ws), "ABCDE", ("good", "toxic"), ws)
    names = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.select(*names).collect())) == plain_audit(docs, labels)


def test_audit_makes_each_state_once(spark):
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0) for i in range(210)], "part string, X boolean, Y boolean, Z boolean, lost boolean")
    ws = Workspace(spark, "t")
    edges = interaction.edges(rows, "XYZ", ("lost",), ws).collect()
    assert len(edges) == 3 * 2**2 and {r.state for r in edges} == {"", "X", "Y", "Z", "XY", "XZ", "YZ"}
    got = interaction.audit(rows, "XYZ", ("lost",), ws)
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.lost_lost) for r in got.collect()}["ZXY", 3] == (56, 28, 4)
    assert got.count() == 18


def test_audit_of_empty_tables(spark, empty):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    ws = Workspace(spark, "t")
    assert interaction.audit(interaction.flagged(empty, marks, ws), "ABCDE", ("good", "toxic"), ws).collect() == []
    with pytest.raises(ValueError):
        interaction.audit(empty, "ABCDEFG", (), ws)
