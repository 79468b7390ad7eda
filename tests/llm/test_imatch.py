"""I-Match around the border of its two kinds, and the whole band."""

from __future__ import annotations

import numpy as np

from flowquarry.llm import imatch


def test_likeness_around_the_border():
    words = [f"lex{i}" for i in range(40)]
    make = imatch.Fingerprinter(np.sort(imatch._hashes(words)))
    rest = " ".join(f"rare{i}" for i in range(30))
    seven, eight = (f"{rest} {' '.join(words[:n])}" for n in (7, 8))
    assert make(seven)[0] == "a" and make(eight)[0] == "b"
    assert imatch.likeness(make(seven), make(eight)) > 0.5 and imatch.likeness(make(eight), make(seven)) > 0.5
    other = " ".join([*(f"else{i}" for i in range(30)), *words[20:28]])
    assert imatch.likeness(make(seven), make(other)) < 0.2
    assert imatch.likeness(make("only rare ones"), make(" ".join(words))) == 0.0


def test_the_lexicon_holds_the_whole_band(spark):
    assert not hasattr(imatch, "LEXICON_LIMIT")
    docs = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(3000) if (i + j) % 10 == 0)) for i in range(20)], "doc_id long, text string")
    assert imatch.lexicon(docs).tolist() == sorted(imatch._hashes([f"t{j}" for j in range(3000)]).tolist())
