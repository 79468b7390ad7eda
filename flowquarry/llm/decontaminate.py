"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

A benchmark item is found in a document if the document holds at least ``threshold`` of the item's
distinct word shingles.  Items are partitioned by size (powers of two of their shingle counts).  Each
item keeps a bottom-k MinHash sketch: its k smallest shingle hashes, k = floor((1 - threshold) * u) + 1
for the upper size u of its partition, or all its shingles if it has fewer.  A document that misses all
k of them misses more than 1 - threshold of the item, so the search loses nothing; long documents keep
all their hashes on the probing side, as a document-side minimum would hide a short item.  A document probes
only hashes up to the largest sketch value of the partitions whose items can fit into it, and of those only
items that fit.  Every candidate is then verified by the exact shingle strings.

Words are the maximal runs of letters and digits of the lower-cased text.  Defined cases: null or wordless
documents match nothing; null or wordless items match nothing; an item of fewer than ``width`` words
is one shingle of all its words; repeated items (same item_id and text) count once, and different texts
under one item_id, null included, are items of their own; every document row is searched by itself,
whatever its doc_id; the result has one row for each document row and item text that it holds;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import in_place, materialise, maybe_in

WIDTH = 5
THRESHOLD = 0.8
#: Item shingles of more rows than this are joined by a shuffle instead of a broadcast; sketches have no more rows.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(ws: Column, width: int) -> Column:
    """Array of the ``width``-word shingles of a word array with at least ``width`` words."""
    return F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.array_join(F.slice(ws, i + 1, width), " "))


def _hash(ws: Column, i: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(ws, i + k) for k in range(width)])


def _hashes(ws: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: _hash(ws, i, width))


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_, w, shingle, hash): the distinct shingles of every item.  ``items``: (item_, text), item_ distinct."""
    ws = items.select("item_", words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    sized = ws.withColumn("w", F.least(F.size("ws"), F.lit(width)))
    parts = []
    for k in range(1, width + 1):
        of_k = sized.filter(F.col("w") == k)
        hashed = of_k.select("item_", "ws", F.explode(F.sequence(F.lit(0), F.size("ws") - k)).alias("i"))
        parts.append(hashed.select("item_", F.lit(k).alias("w"), F.array_join(F.slice("ws", F.col("i") + 1, k), " ").alias("shingle"), _hash(F.transform("ws", lambda x: F.xxhash64(x)), F.col("i"), k).alias("hash")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_, w, hash, need, part): bottom-k hashes of each item; need: fewest shingles of a document that can hold it."""
    per = shingles.groupBy("item_").agg(F.sort_array(F.collect_set(F.struct("hash", "w"))).alias("hs"))
    per = per.withColumn("n", F.size("hs")).withColumn("part", F.ceil(F.log2("n")).cast("int"))
    k = F.least(F.col("n"), (F.floor(F.lit(1 - threshold + 1e-9) * F.call_function("shiftleft", F.lit(1), F.col("part"))) + 1).cast("int"))
    return per.select("item_", "part", F.ceil(F.col("n") * threshold - 1e-9).alias("need"), F.inline(F.slice("hs", 1, k)))


def _probe(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_, size, w, hash): shingle hashes of each document for the shingle widths that items have."""
    ws = docs.select("doc_", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("ws"))
    parts = []
    for k in widths:
        fit = ws.filter(F.size("ws") >= k)
        hashes = _hashes(F.col("ws"), k)
        parts.append(fit.select("doc_", (F.size("ws") - k + 1).alias("size"), F.lit(k).alias("w"), F.explode(hashes).alias("hash")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_, item_, n_shingles, n_shared, containment) by row and item numbers.  ``docs``: (doc_, text), ``items``: (item_, text)."""
    shingles = materialise(item_shingles(items, width))
    sketch = materialise(sketches(shingles, threshold))
    widths = [r["w"] for r in sketch.select("w").distinct().orderBy("w").collect()]  # at most ``width`` rows
    counts = shingles.groupBy("item_").agg(F.count_distinct("shingle").alias("n_shingles"))
    small = shingles.count() <= BROADCAST_ROWS
    if not widths:
        widths = [width]
    side = F.broadcast(sketch) if small else sketch
    probe = _probe(docs, widths)
    # Two numbers a size partition, of which there are 32 at most.
    bounds = sketch.groupBy("part").agg(F.min("need").alias("need"), F.max("hash").alias("top")).collect()
    if bounds:
        probe = probe.filter(F.col("hash") <= F.greatest(*[F.when(F.col("size") >= r["need"], r["top"]).otherwise(-(1 << 63)) for r in bounds], F.lit(-(1 << 63))))
    hits = probe.alias("d").join(side.alias("s"), (F.col("d.w") == F.col("s.w")) & (F.col("d.hash") == F.col("s.hash")) & (F.col("d.size") >= F.col("s.need")))
    candidates = materialise(hits.select(F.col("d.doc_"), F.col("s.item_"), F.col("s.w")).distinct())

    # Exact check: only documents with candidates, only shingles of their candidate items.
    of_doc = candidates.groupBy("doc_").agg(F.collect_set("w").alias("ws_"))
    # Texts that are surely no candidates stay out of the join.
    texts = docs.select("doc_", "text").filter(maybe_in(candidates, ["doc_"], candidates.count())).join(of_doc, "doc_")
    ws = texts.select("doc_", words(F.col("text")).alias("ws"), F.explode("ws_").alias("w")).filter(F.size("ws") >= F.col("w"))
    grams = F.transform(F.sequence(F.lit(0), F.size("ws") - F.col("w")), lambda i: F.array_join(F.slice("ws", i + 1, F.col("w")), " "))
    there = ws.select("doc_", "w", F.explode(F.array_distinct(grams)).alias("shingle"))
    known = shingles.select("item_", "w", "shingle").distinct()
    known = F.broadcast(known) if small else known
    shared = there.join(known, ["w", "shingle"]).groupBy("doc_", "item_").agg(F.count_distinct("shingle").alias("n_shared"))
    total = F.broadcast(counts) if small else counts
    out = shared.join(total, "item_")
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold - 1e-9).select("doc_", "item_", "n_shingles", "n_shared", "containment")


def _numbered(docs: DataFrame, column: str, *names: str) -> DataFrame:
    """``docs`` with the number ``column`` for every row, as a written table."""
    return materialise(docs.select(*[F.col(f"`{n}`") for n in names]).withColumn(column, F.monotonically_increasing_id()))


def _named(docs: DataFrame, **columns: Column) -> DataFrame:
    """``columns`` and ``doc_``, the name of every row of ``docs``."""
    return in_place(docs, **columns).withColumn("doc_", F.struct("file_", "at_")).drop("file_", "at_")


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item that a document contains."""
    rows = _named(docs, doc_id=F.col("doc_id"), text=F.col("text"))
    known = _numbered(items.select("item_id", "text").distinct(), "item_", "item_id", "text")
    hits = materialise(_hits(rows.select("doc_", "text"), known.select("item_", "text"), width, threshold))
    ids = rows.select("doc_", "doc_id").filter(maybe_in(hits, ["doc_"], hits.count()))
    out = hits.join(ids, "doc_").join(known.select("item_", "item_id"), "item_")
    return out.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that contain a benchmark item."""
    rows = _named(docs, row_=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    known = _numbered(items.select("text").distinct(), "item_", "text")
    bad = materialise(_hits(rows.select("doc_", F.col("row_.text").alias("text")), known, **options).select("doc_").distinct())
    suspect = maybe_in(bad, ["doc_"], bad.count())
    kept = rows.filter(~suspect).unionByName(rows.filter(suspect).join(bad, "doc_", "left_anti").select(*rows.columns))
    return kept.select(*[F.col("row_").getField(c).alias(c) for c in docs.columns])
