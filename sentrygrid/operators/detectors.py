"""Fifteen detectors.  ``metrics`` functions score every candidate with a ``hit`` flag; ``findings`` turns hits into findings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import entropy_bits, mean_percentile, poisson_cdf, robust_z
from sentrygrid.operators import anomaly, histograms
from sentrygrid.operators.cohorts import cohorts, peer_stats
from sentrygrid.operators.features import alert_features, analyst_counts, asset_features, ch, entity_cases, entity_features, entity_month_features, entity_volumes, numbered, rate, zero_runs
from sentrygrid.schema import FINDING, THRESHOLDS, Bundle
from sentrygrid.sources.scratch import written

EXECUTION, NEGATIVE, NOVEL = "EXECUTION_GAP", "NEGATIVE_SPACE", "NOVEL"
VERSION = "1.0.0"
SAMPLE = 10


class Context:
    """A bundle with the frames that detectors share, each planned once."""

    def __init__(self, bundle: Bundle, keep: str | None = None):
        """``keep``: a new folder where shared frames are written when they are first used; without it each use plans them anew."""
        self.bundle, self._keep, self._made = bundle, keep, {}

    def _get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            df = make()
            if self._keep:
                df.write.parquet(f"{self._keep}/{name}")
                df = df.sparkSession.read.schema(df.schema).parquet(f"{self._keep}/{name}")
            self._made[name] = df
        return self._made[name]

    @property
    def alerts(self) -> DataFrame:
        return self._get("alerts", lambda: alert_features(self.bundle))

    @property
    def given(self) -> DataFrame:
        """The alerts as they are: from the written features, which have each alert once, where those are kept."""
        return self.alerts if self._keep else self.bundle.alerts

    @property
    def cases(self) -> DataFrame:
        return self._get("cases", lambda: entity_cases(self.bundle, self.given))

    @property
    def volumes(self) -> DataFrame:
        return self._get("volumes", lambda: entity_volumes(self.bundle.entities, self.given, self.bundle.assets))

    @property
    def assets(self) -> DataFrame:
        return self._get("assets", lambda: asset_features(self.bundle))

    @property
    def entities(self) -> DataFrame:
        return self._get("entities", lambda: entity_features(self.bundle, self.alerts))

    @property
    def months(self) -> DataFrame:
        return self._get("months", lambda: entity_month_features(self.alerts))

    @property
    def cohorts(self) -> DataFrame:
        return self._get("cohorts", lambda: cohorts(self.bundle.entities))


# ---------------------------------------------------------------- metrics
def eg01(c: Context) -> DataFrame:
    """Closures of critical and high alerts far faster than the peers' (the entity itself left out where enough remain).

    Durations are counted once a cohort; an entity's own counts are taken off where ranks are looked up."""
    t = THRESHOLDS
    own = c.alerts.where(ch() & F.col("closure_duration_sec").isNotNull()).select("alert_id", "entity_id", "severity", F.col("closure_duration_sec").cast("double").alias("dur"))
    co = c.cohorts
    pooled = written(c.bundle.alerts.sparkSession, own.groupBy("entity_id", "severity", F.col("dur").alias("value")).agg(F.count("*").alias("m")), "durations")
    whole = pooled.join(co.select("entity_id", F.explode("groups").alias("key")), "entity_id").groupBy("key", "severity", "value").agg(F.sum("m").alias("m"))
    mine = pooled.join(co.select("entity_id", F.col("cohort_key").alias("key")), "entity_id")
    placed, stats = histograms.peers(whole, mine, ["key", "severity"], "entity_id", {"p5": 0.05, "median": 0.5}, t.eg01_min_alerts)
    ranks = placed.select("entity_id", "severity", F.col("value").alias("dur"), "below", "upto")
    scored = own.join(ranks.hint("merge"), ["entity_id", "severity", "dur"]).join(stats.drop("key", "mean"), ["entity_id", "severity"])
    scored = scored.withColumn("z", robust_z(F.col("dur"), F.col("median"), F.col("mad"), F.col("std"))).withColumn("percentile", mean_percentile(F.col("below"), F.col("upto"), F.col("n")))
    hit = (F.col("dur") > 0) & ((F.col("dur") <= F.col("p5")) | (F.col("z") <= t.eg01_z) | (F.col("percentile") <= t.eg01_percentile))
    return scored.select("entity_id", "alert_id", "severity", "dur", "p5", "median", "z", "percentile", hit.alias("hit")).join(co.select("entity_id", "cohort_level"), "entity_id")


def eg02(c: Context) -> DataFrame:
    rates = c.alerts.where(ch()).groupBy("entity_id").agg(rate(F.col("is_escalated")).alias("value"), F.count("*").alias("n")).where(F.col("n") >= THRESHOLDS.eg02_min_alerts)
    return peer_stats(rates, c.cohorts).withColumn("hit", F.col("z") <= THRESHOLDS.eg02_z)


def eg03(c: Context) -> DataFrame:
    gap = c.alerts.where(F.col("has_case") & (F.col("workflow_event_count") == 0) & (F.col("closure_duration_sec") >= THRESHOLDS.eg03_gap_sec))
    head = F.coalesce(F.substring("asset_id", 1, 4), F.lit(""))  # keeps the order of ids
    ranked = numbered(gap.select("entity_id", "alert_id", "case_id", "closure_duration_sec", "asset_id", "category", "created_ts"), "entity_id", [head], ["asset_id", "category", "created_ts", "alert_id"], "ordinal")
    return ranked.select("entity_id", "alert_id", "case_id", "closure_duration_sec", "ordinal").withColumn("hit", F.col("ordinal") <= THRESHOLDS.eg03_cap)


def note_similarity(top: DataFrame) -> DataFrame:
    """Entities' most used notes to the largest cosine between two of them: character 3- to 5-grams within padded words,
    smooth inverse document frequencies, unit length; 1 for a single note."""
    words = F.filter(F.split(F.lower("note"), r"\s+"), lambda w: w != "")

    def of_length(n: int) -> Column:
        padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
        whole = n == 3
        return F.flatten(
            F.transform(
                padded,
                lambda w: F.when(F.char_length(w) > n, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n))))
                .when((F.char_length(w) == n) | ((F.char_length(w) < n) & F.lit(whole)), F.array(w))
                .otherwise(F.array().cast("array<string>")),
            )
        )

    grams = top.select("entity_id", "note", F.explode(F.concat(*[of_length(n) for n in (3, 4, 5)])).alias("gram")).groupBy("entity_id", "note", "gram").agg(F.count("*").alias("tf"))
    df = grams.groupBy("entity_id", "gram").agg(F.count("*").alias("df"))
    n = top.groupBy("entity_id").agg(F.count("*").alias("n"))
    weighed = grams.join(df, ["entity_id", "gram"]).join(n, "entity_id").withColumn("w", F.col("tf") * (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = weighed.groupBy("entity_id", "note").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighed.join(norm, ["entity_id", "note"]).select("entity_id", "note", "gram", (F.col("w") / F.col("norm")).alias("w"))
    other = unit.select("entity_id", F.col("note").alias("note2"), "gram", F.col("w").alias("w2"))  # at most five notes an entity
    pairs = unit.join(other, ["entity_id", "gram"]).where("note < note2").groupBy("entity_id", "note", "note2").agg(F.sum(F.col("w") * F.col("w2")).alias("sim"))
    best = pairs.groupBy("entity_id").agg(F.max("sim").alias("sim"))
    return n.join(best, "entity_id", "left").select("entity_id", F.when(F.col("n") == 1, 1.0).otherwise(F.coalesce("sim", F.lit(0.0))).alias("similarity"))


def eg04(c: Context, min_notes: int = THRESHOLDS.eg04_min_notes) -> DataFrame:
    t = THRESHOLDS
    ec = c.cases
    notes = ec.where(F.length(F.trim("notes_text")) > 10).select("entity_id", F.trim("notes_text").alias("note"))
    counts = notes.groupBy("entity_id", "note").agg(F.count("*").alias("n"))
    total = counts.groupBy("entity_id").agg(F.sum("n").alias("notes"))
    cases = ec.groupBy("entity_id").agg(F.count("*").alias("cases"))
    rank = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "note"))
    top = counts.withColumn("rank", rank).where((F.col("rank") <= 5) & (F.col("n") >= min_notes))
    dominant = top.groupBy("entity_id").agg(F.max("n").alias("dominant"))
    out = dominant.join(total, "entity_id").join(cases, "entity_id").join(note_similarity(top.select("entity_id", "note")), "entity_id").join(entropy_bits(ec, ["entity_id"], "closure_code", "entropy"), "entity_id")
    out = out.where((F.col("cases") >= 5) & (F.col("notes") >= t.eg04_min_notes)).withColumn("share", F.col("dominant") / F.col("notes"))
    return out.select("entity_id", "cases", "notes", "share", "similarity", "entropy", ((F.col("share") >= t.eg04_share) & (F.col("similarity") >= t.eg04_similarity) & (F.col("entropy") <= t.eg04_entropy)).alias("hit"))


def eg05(c: Context) -> DataFrame:
    groups = c.alerts.where("is_repeat_7d").groupBy("entity_id", "asset_id", "category").agg(F.count("*").alias("repeats"))
    return groups.withColumn("hit", F.col("repeats") >= THRESHOLDS.eg05_repeats)


def eg06(c: Context) -> DataFrame:
    rates = c.alerts.groupBy("entity_id").agg(rate(F.col("is_sla_window")).alias("value"))
    return peer_stats(rates, c.cohorts).withColumn("hit", (F.col("z") >= THRESHOLDS.eg06_z) & (F.col("value") >= THRESHOLDS.eg06_rate))


def eg07(c: Context) -> DataFrame:
    t = THRESHOLDS
    counts = analyst_counts(c.alerts)
    total = c.alerts.where(ch()).groupBy("entity_id").agg(F.count("*").alias("rows"))
    top = counts.groupBy("entity_id").agg(F.count("*").alias("analysts"), F.min(F.struct((-F.col("n")).alias("n"), "analyst_id")).alias("t"))
    shares = top.join(total, "entity_id").where((F.col("rows") >= t.eg07_min_alerts) & (F.col("analysts") >= t.eg07_min_analysts)).select("entity_id", F.col("t.analyst_id").alias("analyst_id"), (-F.col("t.n") / F.col("rows")).alias("value"))
    return peer_stats(shares, c.cohorts).join(shares.select("entity_id", "analyst_id"), "entity_id").withColumn("hit", (F.col("value") >= t.eg07_share) & (F.col("z") >= t.eg07_z))


def eg08(c: Context) -> DataFrame:
    """CUSUM of the monthly false-positive rate against the first month: s = max(0, s + x) is P - min(0, running min of P)."""
    t = THRESHOLDS
    months = c.months.select("entity_id", "year_month", F.col("fp_rate").alias("rate"), F.col("monthly_volume").alias("n"))
    order = Window.partitionBy("entity_id").orderBy("year_month")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    step = (F.col("rate") - F.first("rate").over(running)) * 10 - t.eg08_drift
    walk = months.withColumn("step", step).withColumn("first", F.row_number().over(order) == 1).withColumn("p", F.sum(F.when(F.col("first"), 0.0).otherwise(F.col("step"))).over(running))
    walk = walk.withColumn("s", F.col("p") - F.least(F.lit(0.0), F.min("p").over(running)))
    out = walk.groupBy("entity_id").agg(F.max("s").alias("cusum"), F.count("*").alias("months"), F.sum("n").alias("alerts"), F.min_by("rate", "year_month").alias("first_rate"), F.max_by("rate", "year_month").alias("last_rate"))
    return out.where((F.col("alerts") >= t.eg08_min_alerts) & (F.col("months") >= t.eg08_min_months)).withColumn("hit", F.col("cusum") >= t.eg08_cusum)


def ns01(c: Context) -> DataFrame:
    silent = c.bundle.assets.where("criticality = 'critical' and monitoring_expected").join(c.given.select("asset_id").distinct().hint("merge"), "asset_id", "left_anti")
    return silent.select("entity_id", "asset_id", F.lit(True).alias("hit"))


def ns02(c: Context) -> DataFrame:
    """Categories that an entity should have had, given its volume and its cohort's mix, by the Poisson lower tail."""
    t = THRESHOLDS
    counts = c.given.where("entity_id is not null and category is not null").groupBy("entity_id", "category").agg(F.count("*").alias("n"))
    co = c.cohorts
    groups = co.select("entity_id", F.explode("groups").alias("key"))
    mix = counts.join(groups, "entity_id").groupBy("key", "category").agg(F.sum("n").alias("c_cat"))
    volume = mix.groupBy("key").agg(F.sum("c_cat").alias("c_tot"))
    own = counts.groupBy("entity_id").agg(F.sum("n").alias("e_tot"))
    expected = own.join(co.select("entity_id", "cohort_level", F.col("cohort_key").alias("key")), "entity_id").join(volume, "key").join(mix, "key")  # each entity with its cohort's categories
    out = expected.join(counts, ["entity_id", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.where((F.col("e_tot") >= t.ns02_min_alerts) & (F.col("c_tot") >= t.ns02_min_cohort_alerts)).withColumn("share", F.col("c_cat") / F.col("c_tot")).where(F.col("share") >= t.ns02_share)
    out = out.withColumn("mu", F.col("share") * F.col("e_tot")).withColumn("p", poisson_cdf(F.col("n"), F.col("mu")))
    return out.select("entity_id", "category", "n", "mu", "p", ((F.col("p") <= t.ns02_p) | ((F.col("n") == 0) & (F.col("mu") >= t.ns02_mu))).alias("hit"))


def ns03(c: Context) -> DataFrame:
    orphans = c.alerts.where(ch() & ~F.col("has_case")).groupBy("entity_id").agg(F.count("*").alias("orphans"))
    return orphans.withColumn("hit", F.col("orphans") > 0)


def ns04(c: Context) -> DataFrame:
    values = c.volumes.select("entity_id", F.col("alerts_per_asset").alias("value"))
    out = peer_stats(values, c.cohorts).withColumn("ratio", F.when(F.col("median") > 0, F.try_divide("value", "median")).otherwise(1.0))
    return out.withColumn("hit", ((F.col("ratio") <= THRESHOLDS.ns04_ratio) | (F.col("z") <= THRESHOLDS.ns04_z)) & (F.col("median") > 0))


def ns05(c: Context) -> DataFrame:
    span = c.given.groupBy("entity_id").agg((F.datediff(F.max("created_ts"), F.min("created_ts")) + 1).alias("span"))
    runs = zero_runs(c.given).join(span, "entity_id").where(F.col("span") >= THRESHOLDS.ns05_span)
    return runs.withColumn("hit", F.col("days") >= THRESHOLDS.ns05_days)


def ns06(c: Context) -> DataFrame:
    values = c.volumes.select("entity_id", F.col("crit_coverage_ratio").alias("value"))
    return peer_stats(values, c.cohorts).withColumn("hit", (F.col("z") <= THRESHOLDS.ns06_z) & (F.col("value") <= THRESHOLDS.ns06_coverage))


def nov01(c: Context) -> DataFrame:
    return anomaly.novelty(c.months)


METRICS: dict[str, Callable[[Context], DataFrame]] = {
    "EG-01": eg01, "EG-02": eg02, "EG-03": eg03, "EG-04": eg04, "EG-05": eg05, "EG-06": eg06, "EG-07": eg07, "EG-08": eg08,
    "NS-01": ns01, "NS-02": ns02, "NS-03": ns03, "NS-04": ns04, "NS-05": ns05, "NS-06": ns06, "NOV-01": nov01,
}


#: Detectors that a user has added: their findings from a context.
ADDED: dict[str, Callable[[Context], DataFrame]] = {}


def register(detector: str, found: Callable[[Context], DataFrame]) -> None:
    """Add a detector under a name of its own; ``found`` returns findings in the columns of ``FINDING`` (``finding`` helps).  Every later run has it."""
    if detector in METRICS or detector in ADDED:
        raise ValueError(f"detector {detector} exists")
    ADDED[detector] = found


def unregister(detector: str) -> None:
    ADDED.pop(detector, None)


# ---------------------------------------------------------------- findings
def finding_id(detector: str, entity: Column, seed: Column) -> Column:
    return F.concat(F.lit(f"FND-{detector}-"), F.substring(F.sha2(F.concat_ws(":", F.lit(detector), entity, seed), 256), 1, 12))


def finding(hits: DataFrame, detector: str, kind: str, scope: Column, seed: Column, weight: Column, deviation: Column, percentile: Column, confidence: Column, reason: Column, refs: Column, params: list[str]) -> DataFrame:
    number = lambda x: x.cast("double")
    return hits.select(
        finding_id(detector, F.col("entity_id"), seed).alias("finding_id"), F.lit(detector).alias("detector_id"), F.lit(VERSION).alias("detector_version"), F.lit(kind).alias("category"), "entity_id", scope.alias("scope"),
        number(weight).alias("severity_weight"), number(deviation).alias("deviation"), number(percentile).alias("peer_percentile"), number(confidence).alias("confidence"), reason.alias("reason_text"),
        refs.alias("evidence_refs"), F.to_json(F.struct(*params)).alias("parameters"), F.lit(1.0).alias("feedback_factor"),
    )


def _samples(rows: DataFrame, key: list[str], ref: Column, order: list[str], n: int) -> DataFrame:
    """The first n references of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", ref.alias("ref")))), lambda s: s["ref"]).alias("refs"))


def _tiered(primary: float, fallback: float) -> Column:
    return F.when(F.col("cohort_level") == "primary", primary).otherwise(fallback)


ALERT_ORDER = ["asset_id", "category", "created_ts", "alert_id"]


def findings(detector: str, c: Context) -> DataFrame:
    """The hits of one detector as findings."""
    if detector in ADDED:
        return ADDED[detector](c).select(*FINDING.fieldNames())
    lit, col, cat = F.lit, F.col, F.concat
    alert_ref, no_refs = cat(lit("alerts:"), col("alert_id")), F.array().cast("array<string>")
    entity = cat(lit("entity:"), col("entity_id"))
    refs = lambda: F.coalesce("refs", no_refs)
    hits = METRICS[detector](c).where("hit")
    if detector == "EG-01":
        return finding(hits, detector, EXECUTION, cat(lit("alert:"), col("alert_id")), col("alert_id"), F.when(col("severity") == "critical", 5.0).otherwise(3.0), F.bround("z", 3), F.bround("percentile", 4), _tiered(0.95, 0.85), F.format_string("%s alert closed in %.0f s; peers' 5th percentile is %.0f s", "severity", F.round("dur", 0), F.round("p5", 0)), F.array(alert_ref), ["dur", "p5", "median", "cohort_level"])
    if detector == "EG-02":
        hits = hits.join(_samples(c.alerts.where(ch() & ~col("is_escalated")), ["entity_id"], alert_ref, ALERT_ORDER, SAMPLE), "entity_id", "left")
        return finding(hits, detector, EXECUTION, entity, lit("esc"), lit(4.0), F.bround("z", 3), F.bround("percentile", 4), _tiered(0.90, 0.80), F.format_string("%.1f%% of critical and high alerts escalated; peers' median is %.1f%%", F.round(col("value") * 100, 1), F.round(col("median") * 100, 1)), refs(), ["value", "median", "peers", "cohort_level"])
    if detector == "EG-03":
        return finding(hits, detector, EXECUTION, cat(lit("alert:"), col("alert_id")), col("alert_id"), lit(2.5), lit(-2.5), lit(0.05), lit(0.92), F.format_string("case %s was open %.0f s without a workflow event", "case_id", F.round("closure_duration_sec", 0)), F.array(alert_ref, cat(lit("cases:"), col("case_id"))), ["closure_duration_sec"])
    if detector == "EG-04":
        hits = hits.join(_samples(c.cases, ["entity_id"], cat(lit("cases:"), col("case_id")), ["case_id"], 5), "entity_id", "left")
        return finding(hits, detector, EXECUTION, entity, lit("notes"), lit(3.5), F.bround(col("similarity") - THRESHOLDS.eg04_similarity, 3), lit(0.95), lit(0.88), F.format_string("one note covers %.0f%% of notes, similarity %.2f", F.round(col("share") * 100, 0), F.round("similarity", 2)), refs(), ["share", "similarity", "entropy"])
    if detector == "EG-05":
        key = ["entity_id", "asset_id", "category"]
        hits = hits.join(_samples(c.alerts.where("is_repeat_7d"), key, alert_ref, ["created_ts", "alert_id"], 5).hint("merge"), key, "left")
        return finding(hits, detector, EXECUTION, cat(lit("asset:"), col("asset_id")), F.concat_ws(":", "asset_id", "category"), lit(3.0), col("repeats"), lit(0.90), lit(0.85), F.format_string("%d repeats of %s within a week of the one before", "repeats", "category"), refs(), ["category", "repeats"])
    if detector == "EG-06":
        hits = hits.join(_samples(c.alerts.where("is_sla_window"), ["entity_id"], alert_ref, ALERT_ORDER, SAMPLE), "entity_id", "left")
        return finding(hits, detector, EXECUTION, entity, lit("sla"), lit(3.2), F.bround("z", 3), F.bround("percentile", 4), lit(0.88), F.format_string("%.1f%% of closures fall just before the hour", F.round(col("value") * 100, 1)), refs(), ["value", "median", "cohort_level"])
    if detector == "EG-07":
        named = c.alerts.where(ch() & col("case_id").isNotNull() & col("analyst_id").isNotNull())
        hits = hits.join(_samples(named, ["entity_id", "analyst_id"], cat(lit("cases:"), col("case_id")), ALERT_ORDER, 5), ["entity_id", "analyst_id"], "left")
        return finding(hits, detector, EXECUTION, cat(lit("analyst:"), col("analyst_id")), col("analyst_id"), lit(2.8), F.bround("z", 3), F.bround("percentile", 4), lit(0.86), F.format_string("one analyst closed %.0f%% of critical and high alerts", F.round(col("value") * 100, 0)), refs(), ["analyst_id", "value", "median"])
    if detector == "EG-08":
        return finding(hits, detector, EXECUTION, entity, lit("drift"), lit(3.2), F.bround("cusum", 3), lit(0.92), lit(0.88), F.format_string("false-positive rate drifted from %.2f to %.2f", F.round("first_rate", 2), F.round("last_rate", 2)), no_refs, ["cusum", "first_rate", "last_rate", "months"])
    if detector == "NS-01":
        return finding(hits, detector, NEGATIVE, cat(lit("asset:"), col("asset_id")), col("asset_id"), lit(4.5), lit(-3.0), lit(0.02), lit(0.95), F.format_string("monitored critical asset %s sent no alert", "asset_id"), F.array(cat(lit("assets:"), col("asset_id"))), ["asset_id"])
    if detector == "NS-02":
        return finding(hits, detector, NEGATIVE, cat(lit("category:"), col("category")), col("category"), lit(4.0), F.bround(col("n") - col("mu"), 2), F.bround("p", 4), lit(0.92), F.format_string("%d alerts of %s where %.1f were expected", "n", "category", F.round("mu", 1)), no_refs, ["category", "n", "mu", "p"])
    if detector == "NS-03":
        hits = hits.join(_samples(c.alerts.where(ch() & ~col("has_case")), ["entity_id"], alert_ref, ALERT_ORDER, SAMPLE), "entity_id", "left")
        return finding(hits, detector, NEGATIVE, entity, lit("orphans"), lit(3.8), -col("orphans"), lit(0.05), lit(0.90), F.format_string("%d critical or high alerts have no case", "orphans"), refs(), ["orphans"])
    if detector == "NS-04":
        return finding(hits, detector, NEGATIVE, entity, lit("volume"), lit(4.2), F.bround(col("ratio") - 1, 3), F.bround("percentile", 4), lit(0.88), F.format_string("%.2f alerts an asset; peers' median is %.2f", F.round("value", 2), F.round("median", 2)), no_refs, ["value", "median", "ratio", "z"])
    if detector == "NS-05":
        period = cat(lit("period:"), col("start").cast("string"), lit("_to_"), col("end").cast("string"))
        return finding(hits, detector, NEGATIVE, period, col("start").cast("string"), lit(4.0), -col("days"), lit(0.01), lit(0.94), F.format_string("no alert for %d days", "days"), no_refs, ["days"])
    if detector == "NS-06":
        return finding(hits, detector, NEGATIVE, entity, lit("coverage"), lit(4.0), F.bround("z", 3), F.bround("percentile", 4), lit(0.90), F.format_string("critical coverage %.0f%%; peers' median is %.0f%%", F.round(col("value") * 100, 0), F.round(col("median") * 100, 0)), no_refs, ["value", "median"])
    return finding(hits, detector, NOVEL, cat(lit("period:"), col("year_month")), col("year_month"), lit(3.5), F.bround("forest_score", 3), lit(0.98), lit(0.82), F.format_string("unusual month: %s", F.array_join("drivers", ", ")), no_refs, ["year_month", "forest_score", "lof", "drivers"])


def data_gap(bundle: Bundle, detector: str) -> DataFrame:
    """One finding an entity for a table that is missing altogether: workflow events (EG-03) or assets (NS-01)."""
    kind, table, weight, deviation, confidence = {"EG-03": (EXECUTION, "workflow_events", 2.5, -3.0, 0.70), "NS-01": (NEGATIVE, "assets", 4.0, -3.0, 0.75)}[detector]
    lit = F.lit
    return finding(bundle.entities.select("entity_id"), detector, kind, lit(f"table:{table}"), lit(f"no-{table}"), lit(weight), lit(deviation), lit(0.05), lit(confidence), lit(f"table {table} is empty"), F.array().cast("array<string>"), ["entity_id"])


def each_detector(bundle: Bundle, detectors: list[str] | None = None, keep: str | None = None) -> Iterator[DataFrame]:
    """The findings of one detector after the other.  Empty tables are probed once, so that data gaps are told from silence.  ``keep``: as in ``Context``.

    Written one by one (``scratch.write_parts``) they are small queries; as one query the driver holds the stages and plans of all detectors at once."""
    c = Context(bundle, keep)
    gaps = {"EG-03": bundle.workflow_events.isEmpty(), "NS-01": bundle.assets.isEmpty()}
    for d in detectors or [*METRICS, *ADDED]:
        yield (data_gap(bundle, d) if gaps.get(d) else findings(d, c)).select(*FINDING.fieldNames())


def run_detectors(bundle: Bundle, detectors: list[str] | None = None, keep: str | None = None) -> DataFrame:
    """All findings in one query, for small tables; see ``each_detector``."""
    return reduce(DataFrame.unionByName, each_detector(bundle, detectors, keep))
