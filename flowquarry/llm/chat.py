"""Chat formatting in budgeted windows, DataFrame functions only.

A conversation's turns are formatted as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line feed becomes ``\\n`` too), so control
strings occur in the template alone and reading back is exact.

The budget counts bytes of the formatted turn in UTF-8, which no byte-level tokenizer exceeds in tokens; another
``measure`` of a turn may be given as a column function.

Prefix sums of the turns' sizes choose the windows: a window starts behind the last one and takes the turns up to the
largest prefix sum within its room.  The room is the budget less the system turn and the turns that the window
repeats; a window whose first turn alone is larger than its room holds that turn only (column ``over_budget``).  Every
window begins with the conversation's leading system turn, then repeats as many of the last turns of the window before as
fit into ``history``, then has its own turns.  The loss mask covers the text of its own assistant turns, never repeated
ones, so each target occurs once.

Long conversations are not gathered in one task: turns are dealt by range of (conv_id, turn), prefix sums are taken
inside each range and offset by the sums of the ranges before it.  Windows are cut inside stretches of ``STRETCH`` rooms
of the prefix sums, which bound what a task holds of a conversation at once; only the last window of a stretch may
stay short.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; null turns come
first; rows of equal conv_id and turn are ordered by role, then text, and repeated rows are kept; very
long turns are kept whole; a system turn that is not the first is a turn like others; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import materialise, shuffle_partitions

START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 4096, 768
#: Rooms of a stretch, within which windows are cut.
STRETCH = 16
#: Windows of a stretch are numbered below this.
MOST = 1 << 20


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def size(turn: Column) -> Column:
    """Size of a formatted turn against the budget: its bytes in UTF-8."""
    return F.octet_length(turn).cast("long")


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, measure: Callable[[Column], Column] = size) -> DataFrame:
    """(conv_id, window, size, over_budget, formatted, spans): one row a window.

    ``spans`` has for each formatted turn: start and end offsets of its code points in ``formatted``,
    ``own`` (not repeated), ``loss_start`` and ``loss_end`` (equal where nothing is under the mask).
    """
    spark = turns.sparkSession
    base = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    dealt = base.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    # The number grows with the order of the rows; its high bits number the range.
    dealt = materialise(dealt.withColumn("pos", F.monotonically_increasing_id()))
    dealt = dealt.select("conv_id", "pos", F.shiftright("pos", 33).alias("range"), "role", escape_role(F.col("role")).alias("erole"), escape(F.col("text")).alias("etext"))
    dealt = dealt.withColumn("tok", measure(_turn(F.col("erole"), F.col("etext"))).cast("long"))

    in_range = Window.partitionBy("conv_id", "range").orderBy("pos")
    sums = dealt.groupBy("conv_id", "range").agg(F.sum("tok").alias("r_tok"), F.count(F.lit(1)).alias("r_n"), F.min_by(F.struct("pos", "role", "erole", "etext", "tok"), "pos").alias("head"))
    over = Window.partitionBy("conv_id").orderBy("range")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "range", F.coalesce(F.sum("r_tok").over(before), F.lit(0)).alias("off_tok"), F.coalesce(F.sum("r_n").over(before), F.lit(0)).alias("off_n"), F.first("head").over(over).alias("head"))
    sums = sums.withColumn("head", F.when(F.col("head.role") == "system", F.col("head")))
    sums = sums.select(F.col("conv_id").alias("c_"), F.col("range").alias("r_"), "off_tok", "off_n", "head")

    run = dealt.withColumn("upto", F.sum("tok").over(in_range)).withColumn("ord", F.row_number().over(in_range))
    run = run.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("range") == F.col("r_")))
    sys_tok = F.coalesce(F.col("head.tok"), F.lit(0))
    room = F.greatest(F.lit(1), F.lit(budget) - sys_tok)
    run = run.withColumn("ord", F.col("ord") + F.col("off_n")).withColumn("upto", F.col("upto") + F.col("off_tok") - sys_tok).withColumn("room", room)
    first = F.coalesce(F.col("pos") == F.col("head.pos"), F.lit(False))
    run = run.withColumn("is_head", first).withColumn("stretch", F.when(first, F.lit(0)).otherwise(F.floor((F.col("upto") - 1) / (STRETCH * F.col("room")))).cast("long"))

    item = F.struct("ord", "role", "tok", "upto", _turn(F.col("erole"), F.col("etext")).alias("out"), F.length("etext").alias("len"), "is_head")
    grouped = run.groupBy("conv_id", "stretch").agg(F.sort_array(F.collect_list(item)).alias("turns"), F.first("head").alias("head"), F.first("room").alias("room"))
    grouped = grouped.select("conv_id", "stretch", "head", "room", F.exists("turns", lambda t: t["is_head"]).alias("opens"), F.filter("turns", lambda t: ~t["is_head"]).alias("turns"))

    # One step a turn: the windows' last turns so far, the sizes in the open window, and what it repeats.
    zero = F.lit(0).cast("long")

    def tail(sizes: Column) -> Column:
        """Sum of the longest end of ``sizes`` within the history."""
        fits = F.aggregate(F.reverse(sizes), F.struct(zero.alias("sum"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & (a["sum"] + x <= history), a["sum"] + x).otherwise(a["sum"]).alias("sum"), (a["on"] & (a["sum"] + x <= history)).alias("on")))
        return fits["sum"]

    def step(acc: Column, tok: Column) -> Column:
        used = F.aggregate(acc["open"], zero, lambda a, x: a + x)
        goes_on = (F.size(acc["open"]) == 0) | (used + tok <= F.col("room") - acc["past"])
        return F.when(goes_on, F.struct(F.concat(acc["at"], F.array(acc["window"])).alias("at"), acc["window"].alias("window"), F.concat(acc["open"], F.array(tok)).alias("open"), acc["past"].alias("past"))).otherwise(
            F.struct(F.concat(acc["at"], F.array(acc["window"] + 1)).alias("at"), (acc["window"] + 1).alias("window"), F.array(tok).alias("open"), tail(acc["open"]).alias("past"))
        )

    # A later stretch does not know what its first window repeats, so it keeps room for all of the history.
    before_first = F.when(F.col("stretch") == 0, zero).otherwise(F.lit(history).cast("long"))
    none = F.array().cast("array<long>")
    start = F.struct(none.alias("at"), zero.alias("window"), none.alias("open"), before_first.alias("past"))
    grouped = grouped.withColumn("at", F.aggregate(F.transform("turns", lambda t: t["tok"]), start, step)["at"])
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0)))), lambda w: F.struct(w.alias("w"), F.filter("turns", lambda t, i: F.get("at", i) == w).alias("turns")))
    grouped = grouped.select("conv_id", "stretch", "head", "opens", F.explode(cut).alias("c"))
    grouped = grouped.select("conv_id", (F.col("stretch") * MOST + F.col("c.w")).alias("window"), F.col("c.turns").alias("turns"), (F.col("opens") & (F.col("c.w") == 0)).alias("opens"), "head")
    grouped = materialise(grouped.withColumn("from", F.try_element_at(F.col("turns"), F.lit(1))["ord"]).withColumn("to", F.try_element_at(F.col("turns"), F.lit(-1))["ord"]))

    last = F.try_element_at("turns", F.lit(-1))["upto"]
    tail = grouped.filter(F.size("turns") > 0).select(F.col("conv_id").alias("c_"), (F.col("to") + 1).alias("next_"), F.filter("turns", lambda t: last - t["upto"] + t["tok"] <= history).alias("past"))
    both = grouped.join(tail, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("from") == F.col("next_")), "left")

    def shown(t: Column, own: Column, lead: Column) -> Column:
        return F.struct(t["out"].alias("out"), t["tok"].alias("tok"), own.alias("own"), (own & (t["role"] == "assistant")).alias("loss"), t["len"].alias("len"), lead.alias("head"))

    yes, no = F.lit(True), F.lit(False)
    lead = F.when(F.col("head").isNotNull(), F.array(F.struct(_turn(F.col("head.erole"), F.col("head.etext")).alias("out"), F.col("head.tok").alias("tok"), F.col("opens").alias("own"), no.alias("loss"), F.length("head.etext").alias("len"), yes.alias("head"))))
    none = F.filter(F.transform("turns", lambda t: shown(t, no, no)), lambda t: F.lit(False))
    parts = F.concat(F.coalesce(lead, none), F.coalesce(F.transform("past", lambda t: shown(t, no, no)), none), F.transform("turns", lambda t: shown(t, yes, no)))
    out = both.select("conv_id", "window", parts.alias("parts"))
    # Offsets: lengths of the parts before each; a window holds few parts, as the budget bounds it.
    ends = F.aggregate("parts", F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + F.length(p["out"]))))
    out = out.withColumn("ends", ends)

    def span(p: Column, i: Column) -> Column:
        start, end = F.get("ends", i), F.get("ends", i + 1)
        stop = end - len(END)
        return F.struct(start.alias("start"), end.alias("end"), p["own"].alias("own"), F.when(p["loss"], stop - p["len"]).otherwise(stop).alias("loss_start"), stop.alias("loss_end"))

    total = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + p["tok"])
    return out.select("conv_id", "window", total.alias("size"), (total > budget).alias("over_budget"), F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("formatted"), F.transform("parts", span).alias("spans"))


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, at, own, role, text, loss): turns read back from windows.

    The template's control strings alone cut the turns, roles and texts; the mask tells which are repeated, and ``loss``
    is the unescaped text under it.
    """
    parts = F.split("formatted", r"<\|im_start\|>")
    cut = formatted.select("conv_id", "window", "formatted", "spans", F.posexplode(F.slice(parts, 2, F.size(parts))).alias("at", "part")).withColumn("s", F.get("spans", F.col("at")))
    turn = F.split_part(F.col("part"), F.lit("<|im_end|>"), F.lit(1))
    role, text = F.substring_index(turn, "\n", 1), F.substring(turn, F.locate("\n", turn) + 1, F.length(turn))
    under = F.substring("formatted", F.col("s.loss_start") + 1, F.col("s.loss_end") - F.col("s.loss_start"))
    return cut.select("conv_id", "window", "at", F.col("s.own").alias("own"), unescape_role(role).alias("role"), unescape(text).alias("text"), unescape(under).alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from the windows.

    The digests are of a whole conversation's text, which the last step has to join; it gets one piece
    for every 64 windows.
    """
    own = read_turns(formatted).filter("own")
    order = F.struct("at", "role", "text", "loss")
    per = own.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(order)).alias("ts"))
    per = per.select("conv_id", "window", F.size("ts").alias("n"), F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("all"), F.array_join(F.transform("ts", lambda t: t["loss"]), "").alias("loss"))

    def joined(df: DataFrame, keys: list[Column], by: str) -> DataFrame:
        got = df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct(by, "all", "loss"))).alias("ps"))
        return got.withColumn("all", F.array_join("ps.all", "")).withColumn("loss", F.array_join("ps.loss", "")).drop("ps")

    stretch = joined(per.withColumn("stretch", F.shiftright("window", 6)), ["conv_id", "stretch"], "window")
    whole = joined(stretch, ["conv_id"], "stretch")
    chars = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("formatted_chars")).withColumnRenamed("conv_id", "c_")
    out = whole.join(chars, F.col("conv_id").eqNullSafe(F.col("c_")))
    return out.select("conv_id", F.col("n").alias("n_turns"), F.sha2(F.col("all"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    return digests(materialise(windows(turns, budget, history)))
