"""N-gram Jaccard join with a token-group matrix: components of documents whose shingle sets are similar.

Two documents link if the Jaccard similarity of their sets of ``WIDTH``-word shingles is at least ``share`` percent.

1. Documents of equal sets become one set.  The head of a set is its first tokens in the order of their hashes, so
   many that two similar sets share ``spare`` tokens of their heads; a set of which fewer head tokens occur in
   other sets is similar to none and goes no further.
2. The sets left get all their tokens, made anew from the texts, in ascending order of the number of sets that
   have them.  Their prefix is a head in that order; a passage that many unlike documents share stands behind it.
3. Similar sets are partitioned into groups: sets of equal least hash and like size are compared with the one of
   them that has the fewest rare tokens, in ``ROUNDS`` rounds, and join its group if they are similar to it.  Each group
   lies within a ball about its leader; every other set is a group of its own.  No pair of members is compared.
4. The token-group matrix holds the union of the prefixes of each group.  Groups are first linked to one leader
   each, and the unions taken over the components that come of it.  Components meet by the first token that two of their sets
   have in common, of which a pair makes few rows.  Two groups of them are opened only if their unions share enough tokens
   for a similar pair of the sizes, and with the rare tokens, that they have.
5. Leaders of opened groups are compared first.  One minus the similarity is a metric, so groups whose leaders are
   farther apart than their balls allow are closed.  Then members that the matrix still allows meet the
   leader of the other group, at last members within reach of the other ball meet members.  After each step
   groups that are of one component already are closed, so that large groups of near copies cost no pairs.

Every comparison is exact on whole sets; grouping, order and bounds only decide the cost.  Tokens are compared by
64-bit hashes.  Words are the parts between white space of the text with A-Z in lower case.
Defined cases: a text of fewer than ``WIDTH`` words is one shingle of all its words; null or wordless text has no
shingle and is its own component; repeated rows and rows of one doc_id are rows of their own with equal or own
sets; a null doc_id takes part, but a component is named by its smallest non-null doc_id, null if there is none; very
long texts are taken whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import batches_of, discard, materialise, slices
from flowquarry.llm.components import connected_components

WIDTH = 3
#: Percent of the union that similar sets share.
SHARE = 90
#: Tokens that heads have beyond the least, in percent of a set: so many tokens must two heads share, and one more.
SPARE = 10
ROUNDS = 3
#: Times that every group is compared with one leader before groups meet by tokens.
STARS = 3
#: Most tokens of a group whose pairs are compared as arrays, a row a pair.
PLAIN = 1024
#: Words that a worker remembers with their hashes.
MEMORY = 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 11)
        return out


def token_set(text: str | None, words: dict[bytes, int], width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.int64)
    if len(found) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 12)], dtype=np.uint64).view(np.int64)
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(ids) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):  # wraps at 64 bits
        h = (h ^ (h >> np.uint64(31))) * _MIX[0] + ids[i : i + n] * _MIX[1]
    h = (h ^ (h >> np.uint64(29))) * _MIX[2]
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def _need(n, share: int):
    """Fewest tokens that a set of n tokens shares with a similar one."""
    return -(-share * n // 100)


def _spare(n):
    return 1 + n * SPARE // 100


def head_length(n: int, share: int) -> int:
    return min(n, n - _need(n, share) + _spare(n))


def _need_column(n: Column, share: int) -> Column:
    return F.floor((n * share + 99) / 100).cast("int")


def _spare_column(n: Column) -> Column:
    return (F.lit(1) + F.floor(n * SPARE / 100)).cast("int")


def _rows(docs: DataFrame) -> DataFrame:
    """(row_, doc_id, text): a row is named by its file and its place in it; a frame that is no table of files is written once."""
    text = F.col("text").cast("string").alias("text")
    if docs.inputFiles() and "_metadata" not in docs.columns:
        try:
            return docs.select(F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row_"), "doc_id", text)
        except AnalysisException:
            pass  # rows of a join or an aggregate have no place in a file
    return materialise(docs.select(F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("row_"), "doc_id", text))


def _listed(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))


def heads(rows: DataFrame, width: int, share: int) -> DataFrame:
    """(row_, doc_id, n, k1, k2, head) of every row: the size of its set, its name of two hashes, its head in the order of hashes."""
    schema = T.StructType([rows.schema["row_"], rows.schema["doc_id"], *T._parse_datatype_string("n int, k1 long, k2 long, head array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for b in slices(whole, 2, 4_000_000):
                sets = [token_set(t.as_py(), words, width) for t in b.column(2)]
                names = np.array([(xxhash.xxh64_intdigest(s.tobytes(), 1), xxhash.xxh64_intdigest(s.tobytes(), 2)) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                starts = _listed([s[: head_length(len(s), share)] for s in sets])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(names[:, 0]), pa.array(names[:, 1]), starts], names=schema.names)

    with batches_of(rows.sparkSession, 500):
        return materialise(rows.mapInArrow(run, schema))


def whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """(set, n, hs, m0, m1, ...) of ``texts`` (set, text): all tokens, and the least of them under ``ROUNDS`` hash functions."""
    names = ["set", "n", "hs", *[f"m{i}" for i in range(ROUNDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for whole in batches:
            for b in slices(whole, 1, 4_000_000):
                sets = [token_set(t.as_py(), words, width) for t in b.column(1)]
                least = [pa.array([int(((s.view(np.uint64) ^ _MIX[i]) * _MIX[i + 1]).min().view(np.int64)) for s in sets], pa.int64()) for i in range(ROUNDS)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), _listed(sets), *least], names=names)

    with batches_of(texts.sparkSession, 500):
        return materialise(texts.select("set", "text").mapInArrow(run, "set long, n int, hs array<long>, " + ", ".join(f"m{i} long" for i in range(ROUNDS))))


def compared(pairs: DataFrame, full: DataFrame, share: int) -> DataFrame:
    """``pairs`` (a, b, ...) with ``far``, one minus the exact similarity of their sets, and ``linked``, as a written table."""
    x, y = (full.select(F.col("set").alias(k), F.col("n").alias(f"n_{k}"), F.col("hs").alias(f"hs_{k}")) for k in "ab")
    both = F.size(F.array_intersect("hs_a", "hs_b"))
    met = pairs.join(x, "a").join(y, "b").withColumn("both_", both).withColumn("union_", F.col("n_a") + F.col("n_b") - F.col("both_"))
    return materialise(met.select(*pairs.columns, (1 - F.col("both_") / F.col("union_")).alias("far"), (F.col("both_") * 100 >= F.col("union_") * share).alias("linked")))


def prefixes(full: DataFrame, share: int) -> DataFrame:
    """(set, n, rare, w, left, prev) of the prefix tokens, in the order of their numbers of sets, that other sets have; sets without enough of them are left out.

    ``rare``: share of the set's tokens that no other set has.  ``left``: tokens of the set from this one on.  ``prev``: the token before, null for the first.
    """
    tokens = full.select("set", "n", F.explode("hs").alias("w"))
    counts = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    listed = tokens.join(counts, "w").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("c", "w"))).alias("cw"))
    n = F.col("n")
    # Tokens that no other set has come first in the order.
    rare = n - F.size("cw")
    length = F.greatest(F.lit(0), n - _need_column(n, share) + _spare_column(n) - F.col("rare"))
    cut = listed.withColumn("rare", rare).withColumn("cw", F.slice("cw", 1, length)).filter(F.size("cw") >= _spare_column(_need_column(n, share)))
    placed = cut.select("set", "n", "rare", F.col("cw.w").alias("ws"), F.posexplode("cw.w").alias("i", "w"))
    left, prev = n - F.col("rare") - F.col("i"), F.when(F.col("i") > 0, F.get("ws", F.col("i") - 1))
    return materialise(placed.select("set", "n", (F.col("rare") / n).alias("rare"), "w", left.alias("left"), prev.alias("prev")))


def partition(full: DataFrame, rare: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """(set, g, off) of all sets of ``rare`` (set, rare), g being the leader of the set's group and off how far it is, and the links (a, b) of members to leaders.

    The leader of a bucket is the set with the smallest share of rare tokens, of near copies the one least edited.
    """
    sizes = full.join(rare, "set").select("set", "rare", F.floor(F.log(F.col("n")) / F.log(F.lit(1.2))).alias("band"), *[f"m{i}" for i in range(ROUNDS)])
    free, links = sizes, None
    for i in range(ROUNDS):
        firsts = free.groupBy(f"m{i}", "band").agg(F.min(F.struct("rare", "set")).alias("first_"), F.count(F.lit(1)).alias("size_")).filter("size_ > 1")
        pairs = free.join(firsts.select(f"m{i}", "band", F.col("first_.set").alias("b")), [f"m{i}", "band"]).filter("set <> b").select(F.col("set").alias("a"), "b")
        new = compared(pairs, full, share).filter("linked").select("a", "b", "far")
        links = new if links is None else links.unionByName(new)
        if i + 1 < ROUNDS:
            taken = new.select(F.explode(F.array("a", "b")).alias("set")).distinct()
            free = materialise(free.join(taken, "set", "left_anti"))
    links = materialise(links)
    members = links.select(F.col("a").alias("set"), F.col("b").alias("g"), F.col("far").alias("off"))
    groups = sizes.select("set").join(members, "set", "left").select("set", F.coalesce("g", "set").alias("g"), F.coalesce("off", F.lit(0.0)).alias("off"))
    return materialise(groups), links.select("a", "b")


def _component(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``comp``, the component of the set ``key`` by the links so far."""
    comps = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return rows.join(comps.select(F.col("node").alias(key), F.col("component").alias("comp")), key, "left").withColumn("comp", F.coalesce("comp", key))


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """``pairs`` whose sets a and b are not of one component of the links yet."""
    both = _component(_component(pairs, links, "a").withColumnRenamed("comp", "comp_a"), links, "b")
    return materialise(both.filter("comp_a <> comp").select(*pairs.columns))


def _not_too_rare(x: Column, y: Column, share: int) -> Column:
    """Whether sets with these shares of rare tokens may be similar: rare tokens of one are missing from the intersection, those of the other add to the union."""
    one = lambda p, q: (1 - p) * 100 + 1e-6 >= share * (1 + q * share / 100)
    return one(x, y) & one(y, x)


def _may(x: str, y: str, share: int) -> Column:
    """Whether the sizes of two groups, and the least shares of rare tokens in their sets, allow a similar pair."""
    fits = (F.col(f"{x}.low") * share <= F.col(f"{y}.high") * 100) & (F.col(f"{y}.low") * share <= F.col(f"{x}.high") * 100)
    return fits & _not_too_rare(F.col(f"{x}.rare"), F.col(f"{y}.rare"), share)


def _met(now: DataFrame, share: int) -> DataFrame:
    """(comp_x, comp_y): components that may have similar sets, by the first prefix token that two of their sets have in common.  ``now``: a matrix with ``comp``.

    What is left of a set from that token on holds the whole intersection.  Where two single sets have the token before in common as well, that one has had the pair.
    """
    extent = now.groupBy("comp").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("rare").alias("rare"), ((F.max("g") == F.min("g")) & (F.max("ball") == 0)).alias("single"))
    whole = now.filter("first").groupBy("comp", "w").agg(F.max("left").alias("left"), F.max("prev").alias("prev")).join(extent, "comp").withColumn("prev", F.when(F.col("single"), F.col("prev")))
    x, y = whole.alias("x"), whole.alias("y")
    both = F.floor(((F.col("x.low") + F.col("y.low")) * share + 99 + share) / (100 + share))
    first = (F.least("x.left", "y.left") >= both) & ~F.coalesce(F.col("x.prev") == F.col("y.prev"), F.lit(False))
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.comp") < F.col("y.comp")) & _may("x", "y", share) & first)
    return met.select(F.col("x.comp").alias("comp_x"), F.col("y.comp").alias("comp_y")).distinct()


def opened_groups(matrix: DataFrame, links: DataFrame, full: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups (a, b, ball_a, rare_a, ball_b, rare_b), of two components, whose unions of tokens allow a similar pair; and the links with those found on the way.

    ``matrix``: (g, w, left, first, prev, low, high, ball, rare).  First every group is compared with one leader, the one that is the first
    group of most of its tokens, ``STARS`` times by another order, and components that come together are taken
    as one row of the matrix.
    """
    for turn in range(STARS):
        order = F.struct("rare", "g") if not turn else F.struct(F.xxhash64("g", F.lit(turn)).alias("o"), "g")
        now = materialise(_component(matrix, links, "g"))
        heads_ = now.groupBy("w").agg(F.min(F.struct(order.alias("o"), "g", "low", "high", "rare", "comp")).alias("h"), F.max("comp").alias("most"), F.min("comp").alias("least")).filter("least < most")
        y = heads_.select("w", F.col("h.g").alias("g"), F.col("h.low").alias("low"), F.col("h.high").alias("high"), F.col("h.rare").alias("rare"), F.col("h.comp").alias("comp")).alias("y")
        met = now.alias("x").join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.comp") != F.col("y.comp")) & _may("x", "y", share))
        counted = met.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("x.low", "y.low")).alias("low"))
        best = counted.filter(F.col("shared") >= _spare_column(F.col("low"))).groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
        links = materialise(links.unionByName(compared(best, full, share).filter("linked").select("a", "b")))
        discard(now)
    now = materialise(_component(matrix, links, "g"))
    apart = _met(now, share)
    sizes = now.groupBy("comp").agg(F.count(F.lit(1)).alias("tokens"), (F.max("g") != F.min("g")).alias("several"))
    for k in "xy":
        apart = apart.join(sizes.select(F.col("comp").alias(f"comp_{k}"), F.col("tokens").alias(f"tokens_{k}"), (F.col("several") | (F.col("tokens") > PLAIN)).alias(f"wide_{k}")), f"comp_{k}")
    apart = materialise(apart)

    # Components of one group each: one row a pair.
    plain = sizes.filter(~F.col("several") & (F.col("tokens") <= PLAIN)).select("comp")
    lists = now.join(plain, "comp").groupBy("comp", "g", "low", "high", "ball", "rare").agg(F.collect_list("w").alias("ws"))
    alone = apart.filter("not wide_x and not wide_y").select("comp_x", "comp_y")
    for k in "xy":
        alone = alone.join(lists.select(F.col("comp").alias(f"comp_{k}"), F.struct("g", "low", "high", "ball", "rare", "ws").alias(k)), f"comp_{k}")
    alone = alone.filter(_may("x", "y", share)).filter(F.size(F.array_intersect("x.ws", "y.ws")) >= _spare_column(F.least("x.low", "y.low")))
    alone = alone.select(*[F.col(f"{x}.{c}").alias(n) for x, k in (("x", "a"), ("y", "b")) for c, n in (("g", k), ("ball", f"ball_{k}"), ("rare", f"rare_{k}"))])

    # Of the others, the one with fewer tokens is sent to the other one.
    small = F.col("tokens_x") <= F.col("tokens_y")
    sent = apart.filter("wide_x or wide_y").select(F.when(small, F.col("comp_x")).otherwise(F.col("comp_y")).alias("comp"), F.when(small, F.col("comp_y")).otherwise(F.col("comp_x")).alias("comp_y"))
    x, y = now.join(sent, "comp").alias("x"), now.withColumnRenamed("comp", "comp_y").alias("y")
    met = x.join(y, (F.col("x.w") == F.col("y.w")) & (F.col("x.comp_y") == F.col("y.comp_y")) & _may("x", "y", share))
    out = met.groupBy(F.col("x.g").alias("a"), F.col("y.g").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("x.low", "y.low")).alias("low"), *[F.max(f"{s}.{c}").alias(f"{c}_{k}") for s, k in (("x", "a"), ("y", "b")) for c in ("ball", "rare")])
    return materialise(out.filter(F.col("shared") >= _spare_column(F.col("low"))).drop("shared", "low").unionByName(alone)), links


def links_of(full: DataFrame, share: int = SHARE) -> DataFrame:
    """(a, b) similar sets of ``full`` whose components are those of all similar pairs."""
    tokens = prefixes(full, share)
    groups, links = partition(full, tokens.select("set", "rare").distinct(), share)
    reach = 1 - share / 100

    member = materialise(tokens.join(groups, "set"))
    extent = member.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), (F.max("set") != F.min("set")).cast("int").alias("ball"), F.min("rare").alias("rare"))
    cells = member.groupBy("g", "w").agg(F.max("left").alias("left"), F.max(F.col("left") >= _need_column(F.col("n"), share)).alias("first"), F.max("prev").alias("prev"))
    matrix = materialise(cells.join(extent, "g"))
    opened, links = opened_groups(matrix, links, full, share)

    # Leaders.
    seen = compared(opened, full, share)
    links = materialise(links.unionByName(seen.filter("linked").select("a", "b")))
    left = seen.filter(~F.col("linked") & (F.col("ball_a") + F.col("ball_b") > 0) & (F.col("far") <= reach * (1 + F.col("ball_a") + F.col("ball_b")) + 1e-9))
    left = _apart(left.drop("linked"), links)

    # Members and the leaders of other groups.  How far a member is from its own leader bounds how far it is from the other one.
    sides = [left.select(F.col(x).alias("g"), F.col(y).alias("other"), F.col(f"ball_{x}").alias("own_ball"), F.col(f"ball_{y}").alias("ball"), F.col(f"rare_{y}").alias("other_rare"), "far") for x, y in ("ab", "ba")]
    sides = sides[0].unionByName(sides[1]).filter("own_ball = 1")
    asked = member.filter("set <> g").select("set", "g", "n", "rare", "off").distinct().join(sides, "g")
    asked = asked.filter((F.col("far") - F.col("off") <= reach * (1 + F.col("ball")) + 1e-9) & _not_too_rare(F.col("rare"), F.col("other_rare"), share))
    asked = materialise(asked.select("set", "g", "other", "ball", "n"))
    asked = asked.join(member.select("set", "w"), "set").join(matrix.select(F.col("g").alias("other"), "w"), ["other", "w"])
    asked = asked.groupBy("set", "g", "other", "ball", "n").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= _spare_column(_need_column(F.col("n"), share)))
    seen = compared(asked.select(F.col("set").alias("a"), F.col("other").alias("b"), "g", "ball"), full, share)
    links = materialise(links.unionByName(seen.filter("linked").select("a", "b")))
    near = seen.filter(~F.col("linked") & (F.col("ball") == 1) & (F.col("far") <= reach * 2 + 1e-9)).select("a", "b", "g")
    near = _apart(near, links)

    # Members and members of the other group.
    words = member.select(F.col("set").alias("a"), "w", "n")
    reached = near.join(words, "a")
    p, q = reached.alias("p"), reached.alias("q")
    fits = (F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * share) & (F.col("p.g") < F.col("q.g"))
    pairs = p.join(q, (F.col("p.w") == F.col("q.w")) & (F.col("p.g") == F.col("q.b")) & (F.col("p.b") == F.col("q.g")) & fits)
    pairs = pairs.groupBy(F.col("p.a").alias("a"), F.col("q.a").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("p.n", "q.n")).alias("n"))
    seen = compared(pairs.filter(F.col("shared") >= _spare_column(F.col("n"))).select("a", "b"), full, share)
    out = materialise(links.unionByName(seen.filter("linked").select("a", "b")))
    for table in (tokens, groups, member, matrix):
        discard(table)
    return out


def components(docs: DataFrame, width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    rows = _rows(docs)
    table = heads(rows, width, share)
    sets = table.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("row_").alias("row_"), F.min("doc_id").alias("least"))
    sets = materialise(sets.withColumn("set", F.monotonically_increasing_id()))

    tokens = table.join(sets.select("row_", "set"), "row_").select("set", "n", F.explode("head").alias("w"))
    tokens = materialise(tokens)
    headed, table = table, materialise(table.drop("head"))
    discard(headed)
    shared = tokens.groupBy("w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w")
    alive = tokens.join(shared, "w", "left_semi").groupBy("set", "n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= _spare_column(_need_column(F.col("n"), share)))
    alive = materialise(sets.join(alive.select("set"), "set", "left_semi").select("set", "row_"))
    discard(tokens)
    full = whole_sets(rows.join(alive, "row_").select("set", "text"), width)
    links = links_of(full, share)

    named = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    labelled = sets.join(named.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    labelled = materialise(labelled.join(names, "component").select("k1", "k2", "n", "component_id"))
    found = table.select("doc_id", "n", "k1", "k2").join(labelled, ["k1", "k2", "n"], "left")
    out = materialise(found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))
    for t in (table, full, labelled):
        discard(t)
    return out
