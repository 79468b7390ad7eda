"""The n-gram Jaccard join against all pairs of rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from flowquarry.llm import jaccardjoin
from flowquarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingles(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = min(3, len(ws))
    return frozenset(tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)) if ws else frozenset()


def brute(rows, share=90):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= share * max(len(a), len(b)) and 100 * len(a & b) >= share * len(a | b):
                top[root(i)] = root(j)
    ids: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, len(sets[i]), ids.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=300):
    """Chains of edited texts that drift apart, short texts, a passage in many texts, a large group, repeats and nulls."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    large = [word() for _ in range(200)]
    chain = [word() for _ in range(150)]
    bases = [[word() for _ in range(rng.choice((1, 2, 3, 4, 9, 12, 30, 80, 200)))] for _ in range(30)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = list(large)
            for _ in range(rng.choice((0, 1, 2, 4))):
                words[rng.randrange(len(words))] = word()
        elif kind == 1:
            chain[rng.randrange(len(chain))] = word()
            words = list(chain)
        elif kind == 2:
            words = passage + [word() for _ in range(rng.choice((3, 10, 40)))]
        else:
            words = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 2, len(words) // 40))):
                words[rng.randrange(len(words))] = word()
        if kind == 3 and i % 4 == 1:
            words = words + words[: len(words) // 30]
        rows.append((rng.choice((None, 5)) if i % 17 == 0 else i, rng.choice((" ", "\n", " \t")).join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "É é"), (904, "é é"), (905, "one"), (906, "One"), (None, None), (907, "x " * 30_000), (908, "X " * 20_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "share"), [(1, 90), (2, 90), (3, 80)])
def test_against_all_pairs(spark, seed, share):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, row_ int, n int, k1 string, set int").repartition(4)
    got = jaccardjoin.components(docs, share=share)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows, share)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({r[2] for r in want}) < 0.8 * len(want)


def test_empty_table(spark):
    assert jaccardjoin.components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = spark.createDataFrame([("a", "only one text is here"), ("b", None)], "doc_id string, text string")
    assert sorted(map(tuple, jaccardjoin.components(one).collect())) == [("a", 3, "a"), ("b", 0, "b")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_ngram_jaccard"](spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_groups_lie_within_balls(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(4)) if shingles(t)]
    texts = spark.createDataFrame(rows, "set long, text string")
    full = jaccardjoin.whole_sets(texts, 3)
    groups, _ = jaccardjoin.partition(full, full.select("set", F.lit(0.0).alias("rare")), 90)
    sets = {i: shingles(t) for i, t in rows}
    found = groups.collect()
    assert sorted(r["set"] for r in found) == sorted(sets)
    assert all(r["set"] == r["g"] or 100 * len(sets[r["set"]] & sets[r["g"]]) >= 90 * len(sets[r["set"]] | sets[r["g"]]) for r in found)
    # The large group of near copies comes into few groups.
    assert len({r["g"] for r in found}) < 0.75 * len(sets)
    assert full.select(F.max(F.size("hs"))).first()[0] == max(map(len, sets.values()))


def test_components_meet_by_few_rows(spark, monkeypatch):
    """Texts that share much, but too little, are not opened; similar ones in either form are."""
    met, real = [], jaccardjoin._met
    monkeypatch.setattr(jaccardjoin, "_met", lambda now, share: met.append(real(now, share).count()) or real(now, share))
    common = [f"c{k}" for k in range(100)]
    unlike = [(d, " ".join([*common[: 7 * d], f"x{d // 2}", *common[7 * d :], f"y{d // 2}", *(f"u{d // 2}_{k}" for k in range(12))])) for d in range(12)]
    got = {r["doc_id"]: r["component_id"] for r in jaccardjoin.components(spark.createDataFrame(unlike, "doc_id long, text string")).collect()}
    wanted = {}
    shingles = {d: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for d, t in unlike}
    for d in shingles:
        wanted[d] = min(wanted.get(o, o) for o in shingles if o <= d and 10 * len(shingles[o] & shingles[d]) >= 9 * len(shingles[o] | shingles[d]))
    assert got == wanted
    assert sum(met) <= 12
