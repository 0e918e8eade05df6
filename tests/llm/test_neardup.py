"""The pipeline's near-dedup against all pairs in plain Python."""

import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from sceneqa.llm import neardup

from .conftest import DOCS, prose


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(table):
    """The rows that stay, of (doc_id, text)."""
    sets, up = [shingles(t) for _, t in table], list(range(len(table)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(table)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for k, row in enumerate(table):
        groups.setdefault(root(k), []).append(row)
    return groups.values()


def copies(n, words, changes, first):
    """Texts that each differ from one text in so many places."""
    out = []
    for k in range(n):
        w = prose(first, words).split()
        for c in range(changes):
            w[(37 * k + 53 * c + 11) % words] = f"v{k}x{c}"
        out.append((1000 * first + k, " ".join(w)))
    return out


def test_near_copies_go(spark):
    table = [*DOCS, *copies(120, 200, 1, 21), *copies(40, 200, 3, 22), *copies(20, 120, 2, 23), *copies(30, 90, 6, 24), *((700 + i, prose(700 + i, 50)) for i in range(40))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in table], "doc_id bigint, text string, lang string").repartition(5)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute(table)
    assert len(got) == len(groups)
    for rows in groups:
        low = min((i for i, _ in rows if i is not None), default=None)
        assert [i for i, t in got if (i, t) in rows] == [low]


def test_texts_under_one_id_and_without_id(spark):
    table = [(1, prose(1, 40)), (1, prose(2, 40)), (None, prose(3, 40)), (None, prose(3, 40)), (None, prose(2, 40)), (5, prose(2, 40))]
    for parts in (1, 3):
        got = neardup.dedup(spark.createDataFrame(table, "doc_id bigint, text string").repartition(parts)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, prose(1, 40)), (1, prose(2, 40)), (None, prose(3, 40))], key=str)


@pytest.mark.parametrize("stars", [0, 2])
def test_texts_that_share_a_passage(spark, monkeypatch, stars):
    """Two thirds of each text are one passage; some of them are near copies of each other besides. STARS 0: prefixes do all the work."""
    monkeypatch.setattr(neardup, "STARS", stars)
    passage = prose(500, 120)
    table = [(i, f"{prose(900 + i, 60)} {passage}") for i in range(60)]
    table += [(100 + k * 10 + i, t) for k in range(5) for i, (_, t) in enumerate(copies(4, 180, 2, 930 + k))]
    table += [(300 + i, f"{passage} {t.replace('1', '7', 2)}") for i, (_, t) in enumerate(table[:20])]
    docs = spark.createDataFrame(table, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id for r in neardup.dedup(docs).collect()}
    assert got == {min(i for i, _ in rows) for rows in brute(table)} and 60 < len(got) < len(table)


def test_columns_of_any_name(spark):
    table = [(1, prose(1, 40), 1, {"k": 1}), (2, prose(1, 40), 2, {"k": 1}), (3, prose(3, 40), 3, None)]
    docs = spark.createDataFrame(table, "doc_id int, text string, row int, row_ map<string,int>")
    got = neardup.dedup(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]
    clash = docs.withColumnRenamed("row", "__row").withColumnRenamed("row_", "key")
    assert sorted(r.doc_id for r in neardup.dedup(clash).collect()) == [1, 3]


def test_nothing_to_dedup(empty):
    assert neardup.dedup(empty).count() == 0


def test_golay_keys_bring_candidates(spark):
    """Fingerprints of sets against plain Python, and every pair within two bits is reached."""
    texts = [t for _, t in copies(40, 200, 1, 31)] + [prose(800 + i, 60) for i in range(30)] + ["", "a b", "A  b"]
    flat, at = next(neardup.shingle_sets(pa.array(texts)))
    fps = neardup.fingerprints(flat, at).view(np.uint64).tolist()
    mixed = [neardup.mix(flat[a:b], 17).tolist() for a, b in zip(at[:-1], at[1:])]
    assert fps == [sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hs) > len(hs)) for hs in mixed] and len(set(fps)) > 30
    sigs = neardup.signatures(flat, at).tolist()
    nodes = spark.createDataFrame([(s, f - (f >> 63 << 64)) for s, f in dict(zip(sigs, fps)).items()], "sig bigint, fp bigint")
    up = {s: s for s in sigs}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for u, v in map(tuple, neardup._golay(nodes, neardup.Workspace(spark, "golay-test")).collect()):
        assert u < v
        up[max(root(u), root(v))] = min(root(u), root(v))
    close = [(a, b) for i, a in enumerate(sigs) for j, b in enumerate(sigs[:i]) if a != b and (fps[i] ^ fps[j]).bit_count() <= 2]
    assert close and all(root(a) == root(b) for a, b in close)
