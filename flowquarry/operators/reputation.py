"""Verdicts of reputation providers from their answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.net import rank, severity_at, severity_of


def by_confidence(confidence: Column, reports: Column) -> Column:
    """Verdict of a provider that gives a percentage of confidence and a number of reports."""
    return F.when(confidence >= 75, "malicious").when(confidence >= 25, "unknown").when(reports == 0, "clean").otherwise("unknown")


def by_label(status: Column, label: Column, common_service: Column) -> Column:
    """Verdict of a provider that labels addresses and answers 404 for those it does not know."""
    return F.when(status == 404, "notfound").when(label == "malicious", "malicious").when((label == "benign") | common_service, "clean").otherwise("unknown")


def by_engines(malicious: Column, engines: Column) -> tuple[Column, Column]:
    """Verdict and rounded percentage of the engines that object."""
    share = F.when(engines > 0, F.round(100.0 * malicious / engines)).otherwise(0.0).cast("int")
    return F.when(malicious > 0, "malicious").otherwise("clean"), share


# Points of a malicious verdict, their cap, and the floors of one and of several providers.
UPLIFT, UPLIFT_CAP, ONE_FLOOR, SEVERAL_FLOOR = 25, 25, 60, 90


def cached(indicators: DataFrame, cache: DataFrame, now: Column, hours: dict[str, int], budget: int) -> DataFrame:
    """(indicator, source, verdict, state): verdicts still fresh in the cache; of the others ``budget`` a source are to be asked for, smallest first.

    ``cache``: (indicator, source, verdict, asked timestamp); ``hours``: how long a source's verdict is fresh.
    """
    kept = F.create_map(*[F.lit(x) for kv in hours.items() for x in kv])
    wanted = indicators.select("indicator").distinct().withColumn("source", F.explode(F.array(*map(F.lit, hours))))
    fresh = cache.filter((now - F.col("asked")) < F.make_dt_interval(hours=kept[F.col("source")]))
    j = wanted.join(fresh.groupBy("indicator", "source").agg(F.max_by("verdict", "asked").alias("verdict")), ["indicator", "source"], "left")
    ask = j.filter("verdict is null").withColumn("i", F.row_number().over(Window.partitionBy("source").orderBy("indicator"))).filter(F.col("i") <= budget)
    return j.filter("verdict is not null").withColumn("state", F.lit("cached")).unionByName(ask.drop("i").withColumn("state", F.lit("ask")))


def applied(cards: DataFrame, verdicts: DataFrame, finding_hosts: DataFrame) -> DataFrame:
    """Cards with verdicts folded in.  ``cards``: (ip, external, ioc, score, severity); ``verdicts``: (ip, source, status); ``finding_hosts``: (ip).

    Malicious verdicts on external addresses add points and force high, or critical from two on; a benign one lowers the
    severity by one unless the address is listed or has a finding.
    """
    v = verdicts.groupBy("ip").agg(F.count_if(F.col("status") == "malicious").alias("bad_"), F.bool_or(F.col("status") == "benign").alias("good_"), F.count(F.lit(1)).alias("verdicts_"))
    j = cards.join(v, "ip", "left").join(finding_hosts.select("ip").distinct().withColumn("found_", F.lit(True)), "ip", "left")
    bad, ext = F.coalesce("bad_", F.lit(0)), F.col("external")
    raised = F.least(F.lit(100), F.col("score") + F.least(UPLIFT * bad, F.lit(UPLIFT_CAP)))
    score = F.when(ext & (bad >= 2), F.greatest(raised, F.lit(SEVERAL_FLOOR))).when(ext & (bad == 1), F.greatest(raised, F.lit(ONE_FLOOR))).otherwise(F.col("score"))
    calm = ext & (bad == 0) & F.coalesce("good_", F.lit(False)) & ~F.col("ioc") & F.col("found_").isNull()
    severity = F.when(ext & (bad > 0), severity_of(score)).when(calm, severity_at(F.greatest(F.lit(0), rank(F.col("severity")) - 1))).otherwise(F.col("severity"))
    return j.select("ip", score.cast("int").alias("score"), severity.alias("severity"), F.when(ext, F.coalesce("verdicts_", F.lit(0))).otherwise(0).cast("long").alias("verdicts"))


def by_domain(hosts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(host, verdicts): the verdicts of each name as ``source=status``."""
    g = verdicts.groupBy(F.lower("host").alias("key_")).agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "source", "status"))), ",").alias("verdicts"))
    return hosts.select("host").distinct().join(g, F.lower("host") == F.col("key_"), "left").select("host", "verdicts")
