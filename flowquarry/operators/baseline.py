"""Behavioral baselines: what each internal host does from capture to capture, and where a new capture departs from it.

A snapshot is two tables: volumes of a host in a capture, and its traits (peers, ports, fingerprints, hours, categories,
periodic channels) in long form.  A profile is three: moments with the recent samples of each metric, the same by phase of
a cycle, and counted traits.  Profiles of disjoint captures merge by one full outer join a table, so that a corpus
of captures can be profiled in parts; everything but the moving average is the same for any split.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import is_external, let
from flowquarry.operators.behavior import channels
from flowquarry.operators.detect import COLUMNS
from flowquarry.operators.forecast import ALPHA, BETA, FLOOR, GAMMA
from flowquarry.operators.series import EWMA, clamped_points, merged_moments, phase

METRICS = ["bytes_out", "bytes_in", "flows"]
# Captures before a host is judged, width of the static and the forecast band in deviations, least and most
# contacts and variation of a periodic channel, least active hours.
WARM_UP, STATIC_K, FORECAST_Z, CHANNEL_CONTACTS, CHANNEL_CV, ACTIVE_HOURS = 5, 4.0, 3.0, 4, 0.35, 3
# Recent samples that are kept, least of them for a trend, length and slot of the cycle, least samples of a phase and least phases.
RECENT, TREND_POINTS, PERIOD, SLOT, PHASE_SAMPLES, PHASES = 24, 4, 7, 86_400, 2, 3
# Traits of a host that a profile keeps, and its hosts.
CAPS = {"peer": 128, "port": 64, "ja3": 16, "beacon": 16}
MOST_HOSTS = 100_000
# Points of each departure.
POINTS = {"peer": 15, "port": 10, "static": 10, "forecast": 15, "ja3": 10, "category": 10, "hour": 10, "beacon": 15}


@dataclass
class Snapshot:
    """``volumes``: (capture, unix, host, bytes_out, bytes_in, flows); ``traits``: (capture, unix, host, dim, value, total, interval_ns, cv)."""

    volumes: DataFrame
    traits: DataFrame

    def filter(self, condition: str) -> Snapshot:
        return Snapshot(self.volumes.filter(condition), self.traits.filter(condition))


@dataclass
class Profile:
    """``stats`` by (host, metric), ``phases`` by (host, metric, phase), ``traits`` by (host, dim, value)."""

    stats: DataFrame
    phases: DataFrame
    traits: DataFrame

    def map(self, f) -> Profile:
        return Profile(*[f(getattr(self, x.name)) for x in fields(self)])


def snapshot(contacts: DataFrame, capture: list[str] = ["capture", "unix"]) -> Snapshot:  # noqa: B006
    """Snapshots of all captures of ``contacts``, which has the columns ``capture`` and ``unix``, its second.

    Hosts are those that reach an external server from inside.  Their peers, ports and periodic channels are those of
    such channels; fingerprints, hours and categories are those of all their contacts.
    """
    egress = channels(contacts.filter(~is_external(F.col("client")) & is_external(F.col("server"))), capture)
    key = [*capture, F.col("client").alias("host")]
    volumes = egress.groupBy(*key).agg(F.sum("bytes_out").alias("bytes_out"), F.sum("bytes_in").alias("bytes_in"), F.sum("contacts").alias("flows"))
    periodic = (F.col("contacts") >= CHANNEL_CONTACTS) & (F.col("mean_gap") > 0) & (F.col("cv") <= CHANNEL_CV)
    none = [F.lit(None).cast("long").alias("interval_ns"), F.lit(None).cast("double").alias("cv")]

    def trait(dim: str, value: Column, *more: Column) -> Column:
        return F.struct(F.lit(dim).alias("dim"), value.cast("string").alias("value"), *(more or none))

    channel = F.concat_ws(":", "server", F.col("port").cast("string"))
    beacon = F.when(periodic, trait("beacon", channel, F.col("mean_gap").cast("long").alias("interval_ns"), F.col("cv").alias("cv")))
    reached = egress.select(*key, F.inline(F.array_compact(F.array(trait("peer", F.col("server")), trait("port", F.col("port")), beacon))))
    reached = reached.groupBy(*capture, "host", "dim", "value").agg(F.lit(1).cast("long").alias("total"), F.max("interval_ns").alias("interval_ns"), F.max("cv").alias("cv"))

    hour = F.expr("pmod(first_ns div 3600000000000, 24)")
    own = F.array_compact(F.array(F.when(F.col("ja3").isNotNull(), trait("ja3", F.col("ja3"))), trait("hour", hour), trait("category", F.col("category"))))
    shown = contacts.select(*key, F.inline(own)).groupBy(*capture, "host", "dim", "value")
    shown = shown.agg(F.count(F.lit(1)).alias("total"), F.max("interval_ns").alias("interval_ns"), F.max("cv").alias("cv"))
    shown = shown.withColumn("total", F.when(F.col("dim") == "ja3", F.lit(1).cast("long")).otherwise(F.col("total"))).join(volumes.select(*capture, "host"), [*capture, "host"], "left_semi")
    return Snapshot(volumes, reached.unionByName(shown))


def _moments(by: list[str]) -> list[Column]:
    """Moments of ``value`` within groups whose rows are numbered backwards as ``back``, of ``size`` rows."""
    x, back = F.col("value"), F.col("back")
    weight = F.pow(F.lit(1 - EWMA), back - 1) * F.when(back == F.col("size"), 1.0).otherwise(EWMA)
    recent = F.sort_array(F.collect_list(F.when(back <= RECENT, F.struct("unix", "capture", "value"))))
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(weight * x).alias("ewma"),
        F.min_by("value", F.struct("unix", "capture")).alias("first_value"), F.min("unix").alias("first_unix"), F.max("unix").alias("last_unix"), recent.alias("recent"),
    ]


def _numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by)
    return rows.withColumn("back", F.row_number().over(w.orderBy(F.desc("unix"), F.desc("capture")))).withColumn("size", F.count(F.lit(1)).over(w))


def build(snap: Snapshot) -> Profile:
    """Profile of all captures of ``snap``, as if they were observed one after another in the order of their times."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])
    long = snap.volumes.select("capture", "unix", "host", F.inline(each)).withColumn("phase", phase(F.col("unix"), SLOT, PERIOD).cast("int"))
    stats, phases = (_numbered(long, by).groupBy(*by).agg(*_moments(by)) for by in (["host", "metric"], ["host", "metric", "phase"]))
    last = F.struct("unix", "capture")
    traits = snap.traits.groupBy("host", "dim", "value").agg(
        F.count(F.lit(1)).alias("captures"), F.sum("total").alias("total"), F.min("unix").alias("first_unix"), F.max("unix").alias("last_unix"), F.max_by("interval_ns", last).alias("interval_ns"), F.max_by("cv", last).alias("cv"),
    )
    return Profile(stats, phases.drop("recent"), traits)


def _joined(a: DataFrame, b: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Full outer join; ``values`` over the aliases a and b hold where both have the key."""
    both = F.col("a.here_") & F.col("b.here_")
    here = F.lit(True).alias("here_")
    joined = a.select("*", here).alias("a").join(b.select("*", here).alias("b"), keys, "full_outer")
    out = [F.when(both, values[c]).otherwise(F.coalesce(f"a.{c}", f"b.{c}")).alias(c) for c in a.columns if c not in keys]
    return joined.select(*keys, *out)


def merge(a: Profile, b: Profile, later: bool = False) -> Profile:
    """Profile of the captures of both.  ``later``: those of ``b`` come after those of ``a``, so the moving average goes on; else it is the mean of both."""
    c = lambda x: (F.col(f"a.{x}"), F.col(f"b.{x}"))
    low, high = (lambda x: F.least(*c(x))), (lambda x: F.greatest(*c(x)))
    _, mean, m2 = merged_moments(tuple(F.col(f"a.{x}") for x in ("n", "mean", "m2")), tuple(F.col(f"b.{x}") for x in ("n", "mean", "m2")))
    going_on = F.pow(F.lit(1 - EWMA), F.col("b.n")) * (F.col("a.ewma") - F.col("b.first_value")) + F.col("b.ewma")
    moments = {
        "n": F.col("a.n") + F.col("b.n"), "mean": mean, "m2": m2, "least": low("least"), "most": high("most"), "ewma": going_on if later else (F.col("a.ewma") + F.col("b.ewma")) / 2,
        "first_value": F.when(F.col("a.first_unix") <= F.col("b.first_unix"), F.col("a.first_value")).otherwise(F.col("b.first_value")), "first_unix": low("first_unix"), "last_unix": high("last_unix"),
    }
    every = F.sort_array(F.concat("a.recent", "b.recent"))
    recent = {"recent": F.slice(every, F.greatest(F.lit(1), F.size(every) - RECENT + 1), RECENT)}
    newer = lambda x: F.when(F.col("a.last_unix") > F.col("b.last_unix"), F.col(f"a.{x}")).otherwise(F.col(f"b.{x}"))
    counts = {"captures": F.col("a.captures") + F.col("b.captures"), "total": F.col("a.total") + F.col("b.total"), "first_unix": low("first_unix"), "last_unix": high("last_unix"), "interval_ns": newer("interval_ns"), "cv": newer("cv")}
    return Profile(
        _joined(a.stats, b.stats, ["host", "metric"], moments | recent), _joined(a.phases, b.phases, ["host", "metric", "phase"], moments), _joined(a.traits, b.traits, ["host", "dim", "value"], counts),
    )


def capped(p: Profile, caps: dict[str, int] = CAPS, most_hosts: int = MOST_HOSTS) -> Profile:
    """The profile with its hosts and traits of most captures; hours and categories are few by nature."""
    hosts = p.stats.filter("metric = 'bytes_out'").orderBy(F.desc("n"), F.desc("mean"), "host").limit(most_hosts).select("host")
    place = F.row_number().over(Window.partitionBy("host", "dim").orderBy(F.desc("captures"), F.desc("total"), F.when(F.col("dim") == "port", F.col("value").try_cast("int")), "value"))
    most = F.coalesce(*[F.when(F.col("dim") == d, k) for d, k in caps.items()], F.lit(24))
    traits = p.traits.withColumn("place_", place).filter(F.col("place_") <= most).drop("place_")
    return Profile(p.stats, p.phases, traits).map(lambda t: t.join(hosts, "host", "left_semi"))


def holt_next(values: Column) -> Column:
    """Struct (forecast, sigma) one step beyond an array of at most ``RECENT`` doubles; null for fewer than three."""
    n = F.size(values)
    least = F.greatest(F.lit(1.0), FLOOR * F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n)

    def step(acc: Column, x: Column) -> Column:
        f = acc["level"] + acc["trend"]
        level = ALPHA * x + (1 - ALPHA) * f
        return F.struct(level.alias("level"), (BETA * (level - acc["level"]) + (1 - BETA) * acc["trend"]).alias("trend"), (GAMMA * (x - f) * (x - f) + (1 - GAMMA) * acc["var"]).alias("var"))

    start = F.struct(values[0].alias("level"), (values[1] - values[0]).alias("trend"), F.lit(0.0).alias("var"))
    folded = F.aggregate(F.slice(values, 2, RECENT), start, step)
    found = let(folded, lambda s: F.struct(F.greatest(F.lit(0.0), s["level"] + s["trend"]).alias("forecast"), F.greatest(F.sqrt(s["var"]), least).alias("sigma")))
    return F.when(n >= 3, found)


def expected(profile: Profile, asked: DataFrame) -> DataFrame:
    """``asked`` (host, metric, unix, ...) with (model, forecast, sigma, mean, deviation, n) of what the profile expects at that time.

    ``model`` is seasonal where enough phases are known, the phase of the time among them; else trend; else static.
    Seasonal effects are the means of phases against the mean of them all, and are taken off before the trend is fitted.
    """
    known = F.map_from_entries(F.collect_list(F.when(F.col("n") >= PHASE_SAMPLES, F.struct("phase", F.struct("mean", F.sqrt(F.col("m2") / F.col("n")).alias("deviation"), "n")))))
    rhythm = profile.phases.groupBy("host", "metric").agg(known.alias("rhythm"))
    rows = asked.join(profile.stats.select("host", "metric", "n", "mean", "m2", "recent"), ["host", "metric"]).join(rhythm, ["host", "metric"], "left")
    rows = rows.withColumn("deviation", F.sqrt(F.col("m2") / F.col("n"))).withColumn("phase_", phase(F.col("unix"), SLOT, PERIOD).cast("int"))
    rows = rows.withColumn("all_", F.aggregate(F.map_values("rhythm"), F.lit(0.0), lambda a, x: a + x["mean"]) / F.greatest(F.lit(1), F.size("rhythm")))
    effect = lambda p: F.coalesce(F.try_element_at("rhythm", p)["mean"] - F.col("all_"), F.lit(0.0))
    flat = F.transform("recent", lambda r: r["value"] - effect(phase(r["unix"], SLOT, PERIOD).cast("int")))
    rows = rows.withColumn("own_", F.try_element_at("rhythm", F.col("phase_"))).withColumn("effect_", effect(F.col("phase_")))
    rows = rows.withColumn("seasonal_", (F.size("rhythm") >= PHASES) & F.col("own_").isNotNull())
    rows = rows.withColumn("next_", F.when(F.col("seasonal_"), holt_next(flat)).when(F.size("recent") >= TREND_POINTS, holt_next(F.transform("recent", lambda r: r["value"]))))
    # Too few samples for a trend: the phase's own distribution.
    plain = F.greatest(F.lit(1.0), F.col("own_.deviation"), 0.15 * F.greatest(F.lit(1.0), F.col("own_.mean")))
    forecast = F.when(F.col("seasonal_") & F.col("next_").isNotNull(), F.greatest(F.lit(0.0), F.col("next_.forecast") + F.col("effect_"))).when(F.col("seasonal_"), F.col("own_.mean")).otherwise(F.col("next_.forecast"))
    sigma = F.coalesce("next_.sigma", F.when(F.col("seasonal_"), plain))
    model = F.when(F.col("seasonal_"), "seasonal").when(F.col("next_").isNotNull(), "trend").otherwise("static")
    return rows.select(*asked.columns, model.alias("model"), forecast.alias("forecast"), sigma.alias("sigma"), "mean", "deviation", "n")


def judged_volumes(profile: Profile, snap: Snapshot) -> DataFrame:
    """(capture, host, metric, model, observed, forecast, sigma, direction) of hosts past their warm-up; direction is above or below the band, else null."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("observed")) for m in METRICS])
    rows = expected(profile, snap.volumes.select("capture", "unix", "host", F.inline(each))).filter(F.col("n") >= WARM_UP)
    x, f, s = F.col("observed"), F.col("forecast"), F.col("sigma")
    up = F.when(F.col("model") == "static", (F.col("deviation") > 0) & (x > F.col("mean") + STATIC_K * F.col("deviation"))).otherwise(x > f + FORECAST_Z * s)
    down = (F.col("model") != "static") & (x < F.greatest(F.lit(0.0), f - FORECAST_Z * s)) & (f > s)
    out = rows.withColumn("direction", F.when(up, "above").when(down, "below"))
    static = F.col("model") == "static"
    return out.select("capture", "host", "metric", "model", "observed", F.when(static, F.col("mean")).otherwise(f).alias("forecast"), F.when(static, F.col("deviation")).otherwise(s).alias("sigma"), "direction")


def new_traits(profile: Profile, snap: Snapshot) -> DataFrame:
    """(capture, host, dim, value, interval_ns, cv): traits that the profile of a host past its warm-up lacks.

    Hours count only where the profile has a window of activity: at least ``ACTIVE_HOURS`` hours, but not all.
    """
    judged = profile.stats.filter((F.col("metric") == "flows") & (F.col("n") >= WARM_UP)).select("host")
    hours = profile.traits.filter("dim = 'hour'").groupBy("host").agg(F.count(F.lit(1)).alias("hours_"))
    fresh = snap.traits.join(judged, "host", "left_semi").join(profile.traits.select("host", "dim", "value"), ["host", "dim", "value"], "left_anti").join(hours, "host", "left")
    window = (F.col("hours_") >= ACTIVE_HOURS) & (F.col("hours_") < 24)
    return fresh.filter((F.col("dim") != "hour") | F.coalesce(window, F.lit(False))).select("capture", "host", "dim", "value", "interval_ns", "cv")


def deviations(profile: Profile, snap: Snapshot) -> DataFrame:
    """Findings of the kind ``baseline_deviation`` beside ``capture``, one for each host and capture of ``snap`` that departs from the profile.

    A host that the profile does not know, or has met in fewer than ``WARM_UP`` captures, gives none.
    """
    fresh, volumes = new_traits(profile, snap), judged_volumes(profile, snap).filter("direction is not null")
    number = F.col("value").try_cast("int")
    server, port = F.regexp_extract("value", r"^(.*):(\d+)$", 1), F.regexp_extract("value", r"^(.*):(\d+)$", 2).try_cast("int")
    order = F.when(F.col("dim").isin("port", "hour"), F.lpad("value", 6, "0")).otherwise(F.col("value"))
    shown = {"peer": 6, "port": 6, "ja3": 3, "category": 13, "hour": 6, "beacon": 1}
    most = F.coalesce(*[F.when(F.col("dim") == d, k) for d, k in shown.items()])
    text = F.when(F.col("dim") == "hour", F.concat(F.lpad("value", 2, "0"), F.lit(":00"))).otherwise(F.col("value"))
    place = F.row_number().over(Window.partitionBy("capture", "host", "dim").orderBy(order))
    listed = fresh.withColumns({"place_": place, "order_": order, "text_": text}).groupBy("capture", "host", "dim").agg(
        F.count(F.lit(1)).alias("many"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place_") <= most, F.struct("order_", "text_")))), lambda x: x["text_"]).alias("names"),
        F.min(F.when(F.col("dim") == "peer", F.col("value"))).alias("peer"), F.min(F.when(F.col("dim") == "port", number)).alias("port"),
        F.min(F.when(F.col("dim") == "beacon", F.struct(server.alias("server"), port.alias("port")))).alias("channel"),
    )
    names = {"peer": "new external peers", "port": "new destination ports", "ja3": "new TLS client fingerprints", "category": "first use of categories", "hour": "active at unusual hours", "beacon": "new periodic channels"}
    head = F.coalesce(*[F.when(F.col("dim") == d, n) for d, n in names.items()])
    points = lambda c: F.coalesce(*[F.when(c == d, n) for d, n in POINTS.items()])
    rank = F.array_position(F.array(*map(F.lit, ["peer", "port", *METRICS, "ja3", "category", "hour", "beacon"])), F.col("dim"))
    line = F.concat(F.lit("baseline: "), head, F.lit(" "), F.array_join("names", ", "), F.when(F.col("many") > F.size("names"), F.concat(F.lit(" and "), (F.col("many") - F.size("names")).cast("string"), F.lit(" more"))).otherwise(""))
    traits = listed.select("capture", "host", F.struct(rank.alias("rank"), line.alias("line"), points(F.col("dim")).alias("points")).alias("d"), "peer", "port", "channel")
    whole = lambda c: F.format_string("%.0f", c)
    told = F.concat(F.lit("baseline: "), F.col("dim"), F.lit(" "), whole("observed"), F.lit(" "), "direction", F.lit(" the "), "model", F.lit(" expectation of "), whole("forecast"), F.lit(" (deviation "), whole("sigma"), F.lit(")"))
    volumes = volumes.withColumnRenamed("metric", "dim").select("capture", "host", F.struct(rank.alias("rank"), told.alias("line"), F.when(F.col("model") == "static", POINTS["static"]).otherwise(POINTS["forecast"]).alias("points")).alias("d"))
    g = traits.unionByName(volumes, allowMissingColumns=True).groupBy("capture", "host").agg(F.array_sort(F.collect_list("d")).alias("dims"), F.min("peer").alias("peer"), F.min("port").alias("port"), F.min("channel").alias("channel"))
    score = clamped_points(F.transform("dims", lambda d: d["points"].cast("int")))
    none = F.array().cast("array<string>")
    title = F.concat("host", F.lit(" departs from its baseline in "), F.size("dims").cast("string"), F.lit(" ways"))
    return g.withColumn("score", score).select(
        "capture", F.lit("baseline_deviation").alias("kind"), F.when(F.col("score") >= 35, "medium").when(F.col("score") >= 15, "low").otherwise("info").alias("severity"), "score", title.alias("title"), F.col("host").alias("src_ip"),
        F.coalesce("peer", "channel.server").alias("dst_ip"), F.coalesce("port", "channel.port").alias("dst_port"), none.alias("attack"), F.transform("dims", lambda d: d["line"]).alias("evidence"),
        F.lit(None).cast("long").alias("first_ns"), F.lit(None).cast("long").alias("last_ns"), none.alias("victims"),
    ).select("capture", *COLUMNS)
