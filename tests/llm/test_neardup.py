"""Near-dedup of the pipeline against all pairs of rows."""

from __future__ import annotations

import random

import corpus_pipeline
from flowquarry.llm import neardup, simhash

SCHEMA = "doc_id long, text string, n_chars int"


def shingles(text):
    ws = (text or "").lower().split()
    w = min(5, len(ws))
    return {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} if ws else set()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    sets = [shingles(t) for _, t, _ in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                top[y] = x
    return sorted((rows[i] for i in range(len(rows)) if root(i) == i), key=str)


def near(spark, rows):
    return sorted(map(tuple, corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()), key=str)


def corpus(seed, ids):
    """Texts with copies that have up to a tenth of their words changed, a common passage in many, and a large group."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(rng.choice((1, 3, 6, 40, 120, 300)))] for _ in range(40)]
    large = [word() for _ in range(150)]
    out = []
    for i in range(240):
        words = list(large) if i % 4 == 0 else list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 2, 3, len(words) // 30))):
            words[rng.randrange(len(words))] = word()
        if i % 5 == 0:
            words = passage + words
        out.append((ids(i, rng), " ".join(words), i))
    return out


def test_near_copies_of_five_words_go(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(200)]
    near_copy = list(base)
    for at in (20, 90, 160):
        near_copy[at] = "changed"
    far = base[:120] + [f"x{i}" for i in range(80)]
    rows = [(1, " ".join(base), 0), (2, " ".join(near_copy), 0), (3, " ".join(far), 0)]
    assert [r[0] for r in near(spark, rows)] == [1, 3]


def test_against_all_pairs(spark):
    rows = corpus(1, lambda i, _: i)
    got = near(spark, rows)
    assert got == brute(rows)
    assert 20 < len(got) < 200


def test_rows_are_no_doc_ids(spark):
    rows = [(None, "one clean text without an id", 1), (None, "another unrelated text without an id", 2), (None, None, 3), (1, "", 4), (7, "b first of seven is long enough", 5), (7, "a second of seven is quite different", 6), (8, "b first of seven is long enough", 7), (7, "b first of seven is long enough", 8)]
    got = near(spark, rows)
    assert len(got) == 5 and sorted({r[1] for r in got}) == sorted({r[1] for r in rows if r[1] is not None})
    rows = corpus(2, lambda i, rng: rng.choice((None, None, 3, i)))
    got = near(spark, rows)
    assert [r[:2] for r in got] == [r[:2] for r in brute(rows)]


def test_fingerprints_find_copies_before_the_join(spark, monkeypatch):
    rows = corpus(3, lambda i, _: i)
    seen, inner = [], neardup.links
    monkeypatch.setattr(neardup, "links", lambda *args, start, **more: seen.append({tuple(r) for r in start.collect()}) or inner(*args, start=start, **more))
    assert near(spark, rows) == brute(rows)
    texts = {i: t for i, t, _ in rows}
    got = {tuple(r) for r in neardup.fingerprint_links(spark.createDataFrame([r[:2] for r in rows], "set long, text string")).collect()}
    assert len(seen[0]) > 5 and len(got) > 5
    groups = {}
    for i, t in texts.items():
        groups.setdefault(simhash.simhash64(t, 5), []).append(i)
    first = {i: g[0] for g in groups.values() for i in g}
    want = {(i, f) for i, f in first.items() if i != f and len(shingles(texts[i]) & shingles(texts[f])) >= 0.8 * len(shingles(texts[i]) | shingles(texts[f]))}
    assert want <= got
    assert all(len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b])) for a, b in got)
