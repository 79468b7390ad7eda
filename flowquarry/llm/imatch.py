"""I-Match document fingerprints over randomised lexicons.

The lexicon has the terms whose share of documents lies between ``RAREST`` and ``MOST_COMMON``, which is
a band of inverse document frequencies.  With m distinct terms a document on average it has at most
m / RAREST terms however large the corpus is; it is sent as 8-byte hashes, none left out.  A document keeps its terms of the lexicon, distinct
and sorted.  Each of ``SUBSETS`` randomised lexicons holds a pseudo-random part of all terms, and the
fingerprint has one hash of the kept terms in each of them.  The parts come in nested levels, level k
with 2**-k of the terms; a fingerprint uses the two levels at which one to four of its terms fall into
a part on average, so short and long texts both keep hashes that survive an edit.  Likeness of two
fingerprints is the largest share of agreeing hashes at a level of both.  A second part, of the other kind,
follows the first where a text may meet one of the other kind: likeness then compares the kind that both have.

Defined cases: null text is empty; texts with fewer than ``FEW`` lexicon terms use all their terms first, and texts
without terms have the fingerprint ``-``, alike (1) only to themselves; rows of equal doc_id follow one
another in the order of their texts, null doc_id first; the last row's next is the first row, and the
only row's next is itself; long texts are fingerprinted whole; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import ordered_shards, slices

RAREST = 1e-3
MOST_COMMON = 0.2
SUBSETS = 32
FEW = 8
#: Texts with fewer lexicon terms than this carry hashes over all their terms as well.
BORDER = 4 * FEW
HELD = 150_000
TERM = re.compile(r"[^\W_]+")


def terms(text: str) -> set[str]:
    return set(TERM.findall(text.lower()))


def lexicon(docs: DataFrame, rarest: float = RAREST, most_common: float = MOST_COMMON) -> np.ndarray:
    """Hashes, ascending, of all terms inside the band of document frequencies, counted over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for whole in batches:
            for b in slices(whole, 0, 2_000_000):
                for t in b.column(0):
                    seen.update(terms(t.as_py() or ""))
                if len(seen) > HELD:
                    yield _counts(seen)
                    seen = Counter()
        yield _counts(seen)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column(0).to_pylist()).view(np.int64))], names=["h"])

    total = docs.count()
    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    low, high = max(2, total * rarest), max(2, total * most_common)
    band = counted.filter((F.col("df") >= low) & (F.col("df") <= high)).select("term").mapInArrow(hashed, "h long")
    return np.sort(band.toArrow().column(0).to_numpy().view(np.uint64))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "df"])


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


class Fingerprinter:
    """Fingerprints under one lexicon."""

    def __init__(self, words: np.ndarray, subsets: int = SUBSETS):
        self.lexicon = words
        rng = np.random.default_rng(20)
        self.salts = rng.integers(1, 1 << 63, size=(subsets, 1), dtype=np.uint64)
        self.subsets = subsets

    def of_terms(self, found: set[str]) -> str:
        if not found:
            return "-"
        every = _hashes(sorted(found))
        at = np.searchsorted(self.lexicon, every)
        kept = every[at < len(self.lexicon)]
        kept = kept[self.lexicon[at[at < len(self.lexicon)]] == kept]
        if len(kept) >= FEW:
            return self._part("b", kept) + (f"|{self._part('a', every)}" if len(kept) < BORDER else "")
        return self._part("a", every) + (f"|{self._part('b', kept)}" if len(kept) else "")

    def _part(self, kind: str, h: np.ndarray) -> str:
        x = h[None, :] ^ self.salts
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        draw = x ^ (x >> np.uint64(32))
        level = max(0, int(np.log2(len(h))) - 1)
        out = []
        for k in (level, level + 1):
            inside = draw < np.uint64(((1 << 64) >> k) - 1)
            part = []
            for row in inside:
                some = h[row]
                part.append(f"{xxhash.xxh32_intdigest(some.tobytes()) & 0xFFFF:04x}" if len(some) else "....")
            out.append("".join(part))
        return f"{kind}{level:02d}:{out[0]}:{out[1]}"

    def __call__(self, text: str) -> str:
        return self.of_terms(terms(text))


def likeness(a: str, b: str) -> float:
    """Share of agreeing subset hashes at a level that both fingerprints have, 0 to 1."""
    if a == b:
        return 1.0
    if a == "-" or b == "-":
        return 0.0
    kinds = [{x[0]: x for x in y.split("|")} for y in (a, b)]
    shared = a[0] if a[0] == b[0] else min(kinds[0].keys() & kinds[1].keys(), default=None)
    if shared is None:
        return 0.0
    a, b = (k[shared] for k in kinds)
    levels = [{int(x[1:3]) + i: p for i, p in enumerate(x.split(":")[1:])} for x in (a, b)]
    best = 0.0
    for k in levels[0].keys() & levels[1].keys():
        x, y = levels[0][k], levels[1][k]
        pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, min(len(x), len(y)), 4)]
        used = [(p, q) for p, q in pairs if p != "...." or q != "...."]
        best = max(best, sum(p == q for p, q in used) / len(used)) if used else best
    return best


def edited(text: str, following: str) -> str:
    """The text with its last quarter of code points replaced by as many, or all, of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprint_documents(docs: DataFrame, rarest: float = RAREST, most_common: float = MOST_COMMON) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, rarest, most_common))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(sent.value)
        id_type, names = None, schema.names
        prior = None  # shard, doc_id, text, fingerprint of the row before
        for whole in batches:
            id_type = whole.schema.field("doc_id").type
            for b in slices(whole, 3, 4_000_000):
                out: list[tuple] = []
                for shard, ahead, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    text = text or ""
                    mark = make(text)
                    if prior is not None and prior[0] == shard:
                        _, pdoc, ptext, pmark = prior
                        new = edited(ptext, text)
                        nmark = make(new)
                        out.append((pdoc, len(ptext), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), pmark, nmark, likeness(pmark, nmark), likeness(pmark, mark)))
                    prior = None if ahead else (shard, doc, text, mark)
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names=names)

    rows, n = ordered_shards(docs.select("doc_id", F.col("text").cast("string")), "doc_id")
    dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "lookahead", "doc_id", "text")
    return dealt.select("shard", "lookahead", "doc_id", "text").mapInArrow(run, schema)
