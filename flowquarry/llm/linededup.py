"""Line dedup by an exact set-similarity join over the words of lines, DataFrame functions only.

A line is removed if an earlier line of the corpus has a word set with Jaccard similarity of at least
``threshold``, and is cut from its own row alone.  Lines stand in the order of doc_id (null first), hash of the
row's text, row, line number.  A row is named by its file and its place in it; a frame that is no table of
files is written once first.  The join goes in these steps:

1. count words over the whole corpus in counters whose number follows the number of distinct words (at most
   ``2**MOST_BITS``), kept as 4-bit rarity classes that span the corpus's largest count;
2. per line, order its distinct words by rarity and keep its prefix, the shortest start that a similar
   line must meet; words whose counter is one occur nowhere else and are left out of the index;
3. lines of equal word sets become one set with its earliest place;
4. sets that share a word of more than ``RARE`` occurrences are compared with the likeliest first set of their buckets; those
   found similar to it are done, so that a large group of similar lines is not joined pairwise;
5. join the prefixes on words under the length filter, the positional filter of the first word that two sets have
   in common and a parity filter: the number of bits in which two parities of word hashes (64 bits, 128 for long
   lines) differ never exceeds the number of words that are in one set only; frequent words are joined within
   length groups, without pairs whose later set is done, and not where the word before is one that both have;
6. verify on the whole word sets: for every set its likeliest earlier partner first and the others only where that
   one is not similar; then remove the later lines.

Any fixed order of words gives the same result; rarity only decides the cost.  Words are the parts of the
lower-cased line between white space (blank, tab, line feed and the three beside it); they are compared by
64-bit hashes.  Defined cases: null text stays null; lines without words always stay; lines of one document are
compared as all others; rows that repeat a doc_id, null included, and equal rows are rows of their own; very
long lines are compared whole; an empty table gives an empty result; all columns of the input are kept, whatever
their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import discard, free_name, in_place, materialise, maybe_in, one_array, shuffle_partitions

THRESHOLD = 0.8
#: Bounds of the number of counters: a task carries half a byte for each.
LEAST_BITS, MOST_BITS = 20, 26
#: Words of more occurrences than this are joined by buckets first and then within length groups.
RARE = 1024
#: Times that the sets of a frequent word are dealt to buckets.
STARS = 3
#: Sets a bucket.
BUCKET = 256
#: Bits of parity in which a set and the first of its bucket may differ to be compared; unlike long lines differ in about 32.
STAR_BITS = 24
#: Words from which a line has 128 bits of parity: in 64 bits unlike long lines differ too little.
SPLIT = 32
PLACE = ["file_", "at_", "line_no"]
BLANKS = "\t\x0b\f\r"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_, file_, at_): every row of ``docs`` whole, and its name, which is the same at every reading."""
    return in_place(docs, doc_=F.struct(*[F.col(f"`{c}`") for c in docs.columns]))


def _words(text: Column) -> Column:
    """Words, and empty strings between blanks that follow one another; a plain separator is the fast way to split."""
    return F.split(F.lower(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), BLANKS, text)), " ")


def _hashes(text: Column) -> Column:
    """Distinct hashes of the words of a line."""
    return F.array_remove(F.array_distinct(F.transform(_words(text), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _shift(h: Column) -> Column:
    """Place of a word's 4 bits in its number of 16 counters."""
    return F.shiftrightunsigned(h, 58).cast("int").bitwiseAND(F.lit(60))


def rarity_classes(texts: DataFrame) -> tuple[Column, int, int]:
    """4-bit classes of all word counters, an array of 16 to a number; its length, and the least class of words beyond ``RARE``.

    Class 0 counts at most one word; the others span the logarithm of the largest count evenly.
    """
    words = texts.select(F.explode(_words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''")
    mask = F.lit((1 << (MOST_BITS - 4)) - 1).cast("long")
    h = F.xxhash64("w")
    counts = materialise(words.select(h.bitwiseAND(mask).alias("slot"), _shift(h).alias("shift")).groupBy("slot", "shift").count())
    used, most = counts.agg(F.count(F.lit(1)), F.max("count")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, used.bit_length()))
    slots = 1 << (bits - 4)
    scale = 14 / max(1.0, (most or 1).bit_length())
    folded = counts.groupBy(F.col("slot").bitwiseAND(F.lit(slots - 1).cast("long")).alias("slot"), "shift").agg(F.sum("count").alias("n"))
    level = F.when(F.col("n") <= 1, 0).otherwise(F.least(F.lit(15), 1 + F.floor(F.log2("n") * scale))).cast("long")
    out = one_array(folded.select(F.col("slot").cast("int").alias("slot"), F.call_function("shiftleft", level, F.col("shift")).alias("v")), slots)
    discard(counts)
    return out, slots, 1 + int((RARE.bit_length() - 1) * scale)


def _needed(n: Column, threshold: float) -> Column:
    """Fewest words that a line of n words shares with a similar line."""
    return F.ceil(n * threshold - 1e-9).cast("int")


def _lines(rows: DataFrame) -> DataFrame:
    """A row for every line that has a word."""
    text = F.col("doc_.text").cast("string")
    cut = rows.select(F.col("doc_.doc_id").alias("doc_id"), F.xxhash64(text).alias("hash_"), "file_", "at_", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return cut.filter(F.col("line").rlike(r"[^ \t\x0b\f\r]"))


def line_sets(rows: DataFrame, classes: Column, slots: int, least: int, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, hash_, file_, at_, line_no, k1, k2, n, parity, parity2, skip, rare, often): the word set of each line, named by two hashes, and its prefix.

    ``skip``: words at the start that occur nowhere else, which are left out.  ``rare``: 31 bits of the words below class ``least``, which all come before ``often``, the others.
    """
    mask = F.lit(slots - 1).cast("long")

    def ranked(h: Column) -> Column:
        level = F.call_function("shiftrightunsigned", F.get(F.col("classes"), h.bitwiseAND(mask).cast("int")), _shift(h)).bitwiseAND(F.lit(15).cast("long"))
        return F.shiftleft(level, 59).bitwiseOR(F.shiftrightunsigned(h, 5))

    lines = _lines(rows).withColumn("classes", classes)
    ws = F.sort_array(F.transform(_hashes(F.col("line")), ranked))
    ordered = lines.select("doc_id", "hash_", *PLACE, ws.alias("ws"))
    one = F.lit(1).cast("long")
    bit = lambda w, x: F.call_function("shiftleft", x, w.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    parity = F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(bit(w, one)))
    half = F.aggregate("ws", F.lit(0).cast("long"), lambda acc, w: acc.bitwiseXOR(bit(w, F.shiftright(w, 6).bitwiseAND(one))))
    n = F.size("ws")
    parity2 = F.when(n >= SPLIT, half).otherwise(F.lit(0).cast("long"))
    # A line too short for a similar line of another word set has no prefix.
    alone = (F.floor(n / threshold + 1e-9) == n) & (_needed(n, threshold) == n)
    start = F.slice("ws", 1, F.when(alone, 0).otherwise(n - _needed(n, threshold) + 1))
    named = ordered.select("doc_id", "hash_", *PLACE, F.xxhash64("ws").alias("k1"), F.hash("ws").alias("k2"), n.alias("n"), parity.alias("parity"), parity2.alias("parity2"), start.alias("start"))
    low, high = F.lit(1 << 59), F.lit(min(least << 59, (1 << 63) - 1))
    rare = F.transform(F.filter("start", lambda w: (w >= low) & (w < high)), lambda w: w.bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int"))
    split = named.withColumn("rare", rare).withColumn("often", F.filter("start", lambda w: w >= high))
    skip = F.size("start") - F.size("rare") - F.size("often")
    return split.select("doc_id", "hash_", *PLACE, "k1", "k2", "n", F.col("parity").bitwiseXOR(F.col("parity2")).alias("parity"), "parity2", skip.alias("skip"), "rare", "often")


def _index(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w, set, n, at, parity, parity2): a row for each prefix word, for the rare words and, with ``prev``, the one before among them, for the frequent ones."""
    own = ["set", "n", "parity", "parity2"]
    rare = sets.select(*own, "skip", F.posexplode("rare").alias("i", "w")).select("w", *own, (F.col("skip") + F.col("i")).alias("at"))
    often = sets.select(*own, (F.col("skip") + F.size("rare")).alias("skip"), "often", F.posexplode("often").alias("i", "w"))
    return rare, often.select("w", *own, (F.col("skip") + F.col("i")).alias("at"), F.when(F.col("i") > 0, F.get("often", F.col("i") - 1)).alias("prev"))


def _group(n: Column, threshold: float) -> Column:
    """Length group: a partner's length is within a factor of 1/threshold, so its group is the same or the next."""
    return F.floor(F.log(1 / threshold, n) + 1e-9).cast("int")


def _differ(x: str, y: str) -> Column:
    """Bits in which the parities of two sets differ; the two halves of a short line's are one."""
    p, q = (F.col(f"{x}{k}").bitwiseXOR(F.col(f"{y}{k}")) for k in ("parity", "parity2"))
    return F.when(F.least(f"{x}n", f"{y}n") >= SPLIT, F.bit_count(p) + F.bit_count(q)).otherwise(F.bit_count(p.bitwiseXOR(q)))


def _within(na: Column, nb: Column, diff: Column, threshold: float) -> tuple[Column, Column]:
    """Words that similar sets of na and nb words share at least, and whether lengths and parities allow it."""
    share = F.ceil((na + nb) * (threshold / (1 + threshold)) - 1e-9)
    return share, (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-9) & (diff <= na + nb - 2 * share)


def star_pairs(frequent: DataFrame, threshold: float = THRESHOLD, stars: int = STARS) -> DataFrame:
    """(late, early, diff): sets that share a frequent prefix word, each with the likeliest of the earliest sets of its buckets.

    The sets of a word are dealt to buckets of about ``BUCKET`` sets, ``stars`` times anew, so the rows are linear.
    """
    sizes = frequent.groupBy("w").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("buckets"))
    index = frequent.join(sizes, "w").withColumn("turn", F.explode(F.array(*map(F.lit, range(stars))))).withColumn("g", _group(F.col("n"), threshold))
    index = index.withColumn("bucket", F.pmod(F.xxhash64("set", "turn"), F.col("buckets")))
    keys = ["w", "g", "turn", "bucket"]
    heads = index.groupBy(*keys).agg(F.min(F.struct("set", "n", "parity", "parity2")).alias("head"))
    x = index.join(heads, keys).filter(F.col("set") > F.col("head.set"))
    diff = _differ("", "head.")
    _, fits = _within(F.col("n"), F.col("head.n"), diff, threshold)
    best = x.filter(fits & (diff <= STAR_BITS)).groupBy(F.col("set").alias("late")).agg(F.min(F.struct(diff.alias("diff"), F.col("head.set").alias("early"))).alias("best"))
    return best.select("late", "best.early", "best.diff")


def candidate_pairs(index: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(late, early, diff): all sets that may be similar by the first word that both have; joined on ``keys`` beside the word.

    No word before it is in the other set.  Where the words before are equal, they have had the pair already.  ``diff``: bits in which the parities differ.
    """
    a, b = index.alias("a"), index.alias("b")
    if "g" in keys:
        a = index.withColumn("g", F.explode(F.array("g", F.col("g") + 1))).alias("a")
    na, nb = F.col("a.n"), F.col("b.n")
    diff, later = _differ("a.", "b."), F.col("a.set") > F.col("b.set")
    share, fits = _within(na, nb, diff, threshold)
    keep = ((na < nb) | ((na == nb) & (F.col("a.set") < F.col("b.set")))) & fits
    keep &= (na - F.col("a.at") >= share) & (nb - F.col("b.at") >= share)
    if "prev" in index.columns:
        keep &= ~F.coalesce(F.col("a.prev") == F.col("b.prev"), F.lit(False))
    if "done" in index.columns:
        keep &= (later & ~F.col("a.done")) | (~later & ~F.col("b.done"))
    for k in ("w", *keys):
        keep &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, keep).select(F.greatest("a.set", "b.set").alias("late"), F.least("a.set", "b.set").alias("early"), diff.alias("diff"))


def _verified(pairs: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(set): ``late`` of the pairs (late, early) whose word sets are similar.  ``found``: (set, hs)."""
    a, b = (found.select(F.col("set").alias(k), F.col("hs").alias(f"hs_{k}")) for k in ("late", "early"))
    share, _ = _within(F.size("hs_late"), F.size("hs_early"), F.lit(0), threshold)
    similar = pairs.join(a, "late").join(b, "early").filter(F.size(F.array_intersect("hs_late", "hs_early")) >= share)
    return materialise(similar.select(F.col("late").alias("set")).distinct())


def _decided(pairs: DataFrame, firsts: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(set): the later sets of all pairs (late, early, diff) that are similar; the words come from the texts."""
    pairs = materialise(pairs)
    wanted = materialise(firsts.join(pairs.select(F.explode(F.array("late", "early")).alias("set")).distinct(), "set").select("set", *[F.col(f"first.{c}").alias(c) for c in PLACE]))
    # Lines that are surely not wanted stay out of the join.
    lines = _lines(rows).filter(maybe_in(wanted, PLACE, wanted.count())).select(*PLACE, _hashes(F.col("line")).alias("hs"))
    found = materialise(lines.join(wanted, PLACE).select("set", "hs"))

    likeliest = materialise(pairs.groupBy("late").agg(F.min(F.struct("diff", "early")).alias("best")).select("late", F.col("best.early").alias("early")))
    gone = _verified(likeliest, found, threshold)
    rest = pairs.select("late", "early").join(gone.select(F.col("set").alias("late")), "late", "left_anti").join(likeliest, ["late", "early"], "left_anti").distinct()
    out = gone.unionByName(_verified(rest, found, threshold))
    for used in (pairs, wanted, found, likeliest):
        discard(used)
    return out


def removed_lines(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(file_, at_, line_no) of every line that an earlier line resembles.  ``rows``: (doc_, file_, at_)."""
    classes, slots, least = rarity_classes(rows.select(F.col("doc_.text").cast("string").alias("text")))
    table = materialise(line_sets(rows, classes, slots, least, threshold))
    first = F.min(F.struct("doc_id", "hash_", *PLACE)).alias("first")
    firsts = table.groupBy("k1", "k2", "n").agg(first, F.count(F.lit(1)).alias("lines"), *[F.first(c).alias(c) for c in ("parity", "parity2", "skip", "rare", "often")])
    # Sets are numbered in the order of their places.
    ordered = firsts.repartitionByRange(shuffle_partitions(rows.sparkSession), "first").sortWithinPartitions("first")
    firsts = materialise(ordered.withColumn("set", F.monotonically_increasing_id()))

    whole, table = table, materialise(table.select("doc_id", "hash_", *PLACE, "k1", "k2", "n"))
    discard(whole)

    index, frequent = _index(firsts)
    frequent = materialise(frequent)
    done = _decided(star_pairs(frequent, threshold), firsts, rows, threshold)
    marked = frequent.join(done.withColumn("done", F.lit(True)), "set", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    pairs = candidate_pairs(index.repartition("w"), [], threshold).unionByName(candidate_pairs(marked.withColumn("g", _group(F.col("n"), threshold)), ["g"], threshold))
    gone = done.unionByName(_decided(pairs.groupBy("late", "early").agg(F.min("diff").alias("diff")), firsts, rows, threshold)).distinct()

    # All lines of such a set go, and of the other sets all but the first.
    loses = firsts.select("k1", "k2", "n", "set", "first", "lines").join(gone.withColumn("all_", F.lit(True)), "set", "left").filter("all_ or lines > 1")
    out = table.join(loses.select("k1", "k2", "n", "first", "all_"), ["k1", "k2", "n"])
    out = materialise(out.filter(F.coalesce("all_", F.lit(False)) | (F.struct("doc_id", "hash_", *PLACE) > F.col("first"))).select(*PLACE))
    for used in (table, firsts, frequent):
        discard(used)
    return out


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, count: str | None = "removed_lines_") -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; the number cut in column ``count`` (with more ``_`` where taken), if named."""
    rows = _rows(docs)
    gone = removed_lines(rows, threshold).groupBy("file_", "at_").agg(F.collect_list("line_no").alias("gone_"))
    out = rows.join(gone, ["file_", "at_"], "left")
    text = F.col("doc_.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone_", i)), "\n")
    text = F.when(F.col("gone_").isNull(), text).otherwise(kept)
    columns = [text.alias(c) if c == "text" else F.col("doc_").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.coalesce(F.size("gone_"), F.lit(0)).alias(free_name(count, docs.columns))] if count else []))
