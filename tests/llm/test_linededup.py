"""Line dedup against all pairs of lines."""

from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from flowquarry.llm import linededup

SCHEMA = "doc_id long, text string, removed_lines_x int"


def brute(rows):
    lines = sorted(((d is not None, d or 0, i), frozenset(x.lower().split())) for d, t, _ in rows for i, x in enumerate((t or "").split("\n")) if x.split())
    gone = set()
    for at, words in lines:
        for before, other in lines:
            if before < at and len(words & other) >= 0.8 * len(words | other) - 1e-9:
                gone.add(at)
                break
    out = []
    for d, t, _ in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d is not None, d or 0, i) not in gone)
        out.append((d, kept))
    return sorted(out, key=str)


def run(spark, rows):
    found = linededup.without_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    return sorted(((r["doc_id"], r["text"]) for r in found.select("doc_id", "text").collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(400)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 2, 4, 5, 9, 10, 30)))) for _ in range(60)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines).split()
            for _ in range(rng.choice((0, 0, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line))
        rows.append((d, "\n".join(text), 0))
    return rows


def test_all_pairs(spark):
    rows = corpus(1)
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(len(t) for _, t in got) < sum(len(t) for _, t, _ in rows)


def test_nulls_ties_and_clashing_names(spark):
    rows = [(3, None, 1), (1, "", 1), (2, "  \n\t", 1), (None, "a b c d e", 1), (4, "A b c d e\n\nx", 1), (5, "e d c b a a\nx y", 1), (6, "word " * 5000 + "end", 1), (7, "END " + "word " * 9, 1)]
    assert run(spark, rows) == brute(rows)
    assert linededup.without_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("set", F.lit(1)).withColumn("line", F.lit("x")).withColumn("n", F.lit(2))
    assert linededup.without_repeated_lines(wide).columns == [*wide.columns, "removed_lines_"]
    assert linededup.without_repeated_lines(wide.withColumn("removed_lines_", F.lit(0))).columns == [*wide.columns, "removed_lines_", "removed_lines__"]


def test_different_texts_under_one_id(spark):
    rows = [(1, "a b c d e f", 0), (1, "k l m n o p", 0), (2, "k l m n o p q", 0), (3, "a b c d e f g", 0), (4, "r s t", 0)]
    assert run(spark, rows) == brute(rows)


def brute_rows(rows):
    """As ``brute``, but a line belongs to its row."""
    signed = lambda t: (xxhash.xxh64_intdigest(t, 42) + (1 << 63)) % (1 << 64) if t is not None else 42 + (1 << 63)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])))
    return sorted(((rows[n][0], t) for n, t in brute([(n, t, 0) for n, (_, t, _) in enumerate(rows)])), key=str)


def test_rows_that_share_an_id(spark):
    rows = [(None, "a b c d e\nfirst clean line", 0), (None, "a b c d e\nsecond other words here", 0), (5, "unique words stay here\nf g h i j", 0), (5, "f g h i j\nkept too for sure", 0), (6, "x y z", 0), (6, "x y z", 0)]
    got = run(spark, rows)
    assert got == brute_rows(rows)
    assert (None, "second other words here") in got and (5, "f g h i j\nkept too for sure") in got and (6, "") in got
    rng = random.Random(9)
    rows = [(rng.choice((None, 3, d)), t, n) for d, t, n in corpus(2)]
    assert run(spark, rows) == brute_rows(rows)


def test_unlike_lines_that_share_a_word_are_not_compared(spark, monkeypatch):
    """Each long line has one word of another one; only lines with more words in common are compared."""
    seen, decided = [], linededup._decided
    monkeypatch.setattr(linededup, "_decided", lambda pairs, *rest: seen.append(pairs.count()) or decided(pairs, *rest))
    common = [f"c{k}" for k in range(9)]
    lines = [" ".join([f"pair{d // 2}", *common, *(f"u{d}_{k}" for k in range(16))]) for d in range(40)]
    rows = [(d, line, 0) for d, line in enumerate(lines)] + [(50, lines[3] + " more", 0), (51, "a b c d", 0), (52, "a b c d e", 0), (53, "a b c", 0), (54, "a b", 0)]
    assert run(spark, rows) == brute(rows)
    assert sum(seen) <= 2


def test_more_corpora(spark):
    for seed in (3, 4):
        assert run(spark, corpus(seed)) == brute(corpus(seed))


def test_near_copies_of_frequent_words_meet_by_few_rows(spark, monkeypatch):
    """Lines of one length that differ in a few frequent words make a row for a run of common words, not one for each."""
    rows_made, joined = [], linededup.candidate_pairs
    monkeypatch.setattr(linededup, "RARE", 2)
    monkeypatch.setattr(linededup, "star_pairs", lambda frequent, *rest: frequent.limit(0).select(F.col("set").alias("late"), F.col("set").alias("early"), F.lit(0).alias("diff")))
    monkeypatch.setattr(linededup, "candidate_pairs", lambda index, keys, *rest: rows_made.append(joined(index, keys, *rest).count()) or joined(index, keys, *rest))
    words = [f"w{k}" for k in range(66)]
    lines = [" ".join(words[:d] + words[d + 6 :]) for d in range(0, 48, 4)]
    rows = [(d, line, 0) for d, line in enumerate(lines)]
    assert run(spark, rows) == brute(rows)
    assert sum(rows_made) <= 3 * len(lines) * (len(lines) - 1) // 2
