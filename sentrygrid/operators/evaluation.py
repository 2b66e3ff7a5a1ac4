"""How well queues and examiners' orders find known faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrygrid.functions.stats import spearman
from sentrygrid.operators.features import alert_features, numbered
from sentrygrid.operators.scoring import scored
from sentrygrid.schema import Bundle
from sentrygrid.sources.scratch import written

#: Detector sets of the ablation.
SUITES = {
    "rules": ("EG-03", "EG-05", "NS-01", "NS-03", "NS-05"),
    "statistics": ("EG-01", "EG-02", "EG-04", "EG-06", "EG-07", "EG-08", "NS-02", "NS-04", "NS-06"),
    "learned": ("NOV-01",),
}
BUDGETS = (0.05, 0.10, 0.20)
FAST_MIN, FALSE_POSITIVE_MIN = 10.0, 30.0
POINTS = {"fast": 4.0, "unescalated": 3.0, "orphan": 3.0, "false_positive": 2.0}
STEP = 20


def singular(ref: Column) -> Column:
    out = ref
    for many, one in (("alerts:", "alert:"), ("cases:", "case:"), ("assets:", "asset:")):
        out = F.replace(out, F.lit(many), F.lit(one))
    return out


#: Lengths of the pieces by which texts are looked up: a part is found by its end of the greatest of them that it has.
PIECES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def _pieces(text: Column, n: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))


def contained(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """``texts`` (entity_id, text, ...) that contain one of the non-empty ``parts`` (entity_id, part, ...) of their entity: rows of both.

    Texts are cut into pieces of the lengths that parts' ends have; these are the keys of an equi-join with the ends.  Both sides grow with the tables and their files are compressed, so neither is broadcast whatever its file's size."""
    ends = parts.where(F.length("part") > 0).withColumn("__end", F.right("part", F.greatest(*[F.when(F.length("part") >= n, n) for n in PIECES])))
    lengths = ends.agg(F.collect_set(F.length("__end")).alias("__sizes"))  # one row, at most as many numbers as PIECES
    cut = F.array_distinct(F.flatten(F.transform(F.filter("__sizes", lambda n: n <= F.length("text")), lambda n: _pieces(F.col("text"), n))))
    meets = texts.join(F.broadcast(lengths)).withColumn("__end", F.explode(cut)).drop("__sizes")
    return meets.hint("merge").join(ends, ["entity_id", "__end"]).where(F.contains("text", F.col("part"))).drop("__end")


def matched(items: DataFrame, truth: DataFrame) -> DataFrame:
    """Items (entity_id, item_id, detector_id, scope, evidence_refs) that a fault of the same entity explains: the scopes
    contain each other, a reference contains the fault's scope, or the detector is the expected one of a broad fault."""
    fault = written(truth.sparkSession, truth.select("entity_id", F.lower("scope").alias("f"), "detector_expected").distinct(), "faults")  # read six times
    row = F.sha2(F.to_json(F.struct("entity_id", "item_id", "detector_id", "scope", "evidence_refs")), 256)
    keyed = items.withColumn("__row", row)
    scope = F.lower("scope")
    own = keyed.where(F.length("scope") > 0).select("entity_id", "__row", scope.alias("text"))
    refs = keyed.select("entity_id", "__row", F.explode("evidence_refs").alias("ref")).where("ref is not null").select("entity_id", "__row", singular(F.lower("ref")).alias("text"))
    scopes = fault.select("entity_id", F.col("f").alias("part")).distinct()
    broad = fault.where(F.contains("f", F.lit("entity:")) | F.contains("f", F.lit("category:")) | F.contains("f", F.lit("period:"))).select("entity_id", F.col("detector_expected").alias("detector_id")).distinct()
    hits = contained(own.unionByName(refs), scopes).select("__row")
    hits = hits.unionByName(contained(scopes.select("entity_id", F.col("part").alias("text")), own.withColumnRenamed("text", "part")).select("__row"))
    hits = hits.unionByName(keyed.join(broad, ["entity_id", "detector_id"], "left_semi").select("__row"))
    hits = hits.unionByName(refs.join(fault.where("f = ''"), "entity_id", "left_semi").select("__row"))
    found = written(truth.sparkSession, hits.distinct(), "matched")  # a query of its own, so that what follows is not planned with it
    return keyed.join(found.hint("merge"), "__row", "left_semi").drop("__row")


def budget_of(n: Column, share: float) -> Column:
    return F.greatest(F.lit(5), F.bround(n * share, 0).cast("int"))


def _at_shares(marked: DataFrame, position: str, shares: tuple[float, ...]) -> DataFrame:
    """A row for each share, counted in one pass: items within the entity's budget, and how many of them have a ``hit``."""
    inside = [F.col(position) <= budget_of(F.col("alerts"), s) for s in shares]
    counts = [c for i, x in enumerate(inside) for c in (F.count_if(x).alias(f"n{i}"), F.count_if(x & F.col("hit").isNotNull()).alias(f"h{i}"))]
    rows = [F.struct(F.lit(s).alias("share"), F.col(f"n{i}").alias("items"), F.col(f"h{i}").alias("true_positives")) for i, s in enumerate(shares)]
    return marked.agg(*counts).select(F.inline(F.array(*rows)))


def precision_at(ranked: DataFrame, hits: DataFrame, sizes: DataFrame, shares: tuple[float, ...] = BUDGETS) -> DataFrame:
    """Pooled precision and recall of each entity's first k items; ``ranked``: (entity_id, item_id, rank), ``sizes``: (entity_id, alerts, faults)."""
    marked = ranked.join(hits.select("item_id").distinct().withColumn("hit", F.lit(1)).hint("merge"), "item_id", "left").join(sizes, "entity_id")
    total = sizes.agg(F.sum("faults").alias("faults"))
    return _at_shares(marked, "rank", shares).join(F.broadcast(total)).select("share", "items", "true_positives", F.bround(F.try_divide("true_positives", "items"), 6).alias("precision"), F.bround(F.try_divide("true_positives", "faults"), 6).alias("recall"))


def random_baseline(alerts: DataFrame, hits: DataFrame) -> DataFrame:
    """What random picks find on average: hits over alerts, the mean of the hypergeometric distribution, without trials."""
    flagged = hits.select("alert_id").distinct().withColumn("hit", F.lit(1))
    return alerts.select("entity_id", "alert_id").join(flagged.hint("merge"), "alert_id", "left").groupBy("entity_id").agg(F.count("*").alias("alerts"), F.count("hit").alias("hits")).withColumn("expected_precision", F.col("hits") / F.col("alerts"))


def _day(c: str) -> Column:
    """The day of a time as a number; a missing time comes first, as in ascending order."""
    return F.coalesce(F.unix_date(F.to_date(c)), F.lit(-(1 << 31)))


def uniform_sample(alerts: DataFrame, step: int = STEP) -> DataFrame:
    """Every ``step``-th alert of each entity in time order."""
    return numbered(alerts.where("entity_id is not null"), "entity_id", [_day("created_ts")], ["created_ts", "alert_id"], "__p").where((F.col("__p") - 1) % step == 0).drop("__p")


def lift(measured: Column, baseline: Column) -> Column:
    return F.coalesce(F.try_divide(measured, baseline), F.lit(1.0))


def stratified_order(alerts: DataFrame) -> DataFrame:
    """Positions in the order critical first, then time, then id."""
    rank = F.coalesce(*[F.when(F.lower(F.trim("severity")) == s, i) for i, s in enumerate(("critical", "high", "medium", "low"))], F.lit(9))
    rows = alerts.where("entity_id is not null")
    return numbered(rows, "entity_id", [rank, _day("created_ts")], ["created_ts", "alert_id"], "position").select("entity_id", "alert_id", "position")


def checklist(bundle: Bundle) -> DataFrame:
    """An examiner's absolute-threshold score of every alert, and its place in the entity's order."""
    af = alert_features(bundle)
    sev = F.lower(F.trim("severity"))
    severe = sev.isin("critical", "high")
    minutes = (F.unix_micros("closed_ts") - F.unix_micros("ack_ts")) / 60e6
    base = F.coalesce(F.when(sev == "critical", 3.0).when(sev == "high", 2.0).when(sev == "medium", 1.0), F.lit(0.0))
    rules = {"fast": severe & (minutes < FAST_MIN), "unescalated": severe & F.col("has_case") & ~F.col("is_escalated"), "orphan": ~F.col("has_case"), "false_positive": severe & (F.lower(F.trim("disposition")) == "false_positive") & (minutes < FALSE_POSITIVE_MIN)}
    score = base
    for name, rule in rules.items():
        score = score + F.when(rule, POINTS[name]).otherwise(0.0)
    out = written(bundle.alerts.sparkSession, af.where("entity_id is not null").select("entity_id", "alert_id", score.alias("score")), "checked")  # read for the counts and for the places
    head = F.coalesce(F.substring("alert_id", 1, 4), F.lit(""))  # keeps the order of ids
    return numbered(out, "entity_id", [-F.col("score"), head], ["alert_id"], "position")


def alert_hits(bundle: Bundle, truth: DataFrame) -> DataFrame:
    """Alerts that a fault of their entity names, by their own scope or by that of a case opened for them."""
    own = bundle.alerts.select("entity_id", "alert_id", F.concat(F.lit("alert:"), "alert_id").alias("scope"))
    cases = bundle.alerts.select("entity_id", "alert_id").join(bundle.cases.select("alert_id", "case_id").hint("merge"), "alert_id").select("entity_id", "alert_id", F.concat(F.lit("case:"), "case_id").alias("scope"))
    faults = truth.select("entity_id", F.lower("scope").alias("low")).distinct()
    both = own.unionByName(cases).withColumn("low", F.lower("scope"))
    return both.join(faults.hint("merge"), ["entity_id", "low"], "left_semi").select("entity_id", "alert_id").distinct()


def manual_precision(order: DataFrame, hits: DataFrame, shares: tuple[float, ...] = BUDGETS) -> DataFrame:
    """Precision of an examiner who works through each entity's alerts in an order (entity_id, alert_id, position)."""
    sizes = order.groupBy("entity_id").agg(F.count("*").alias("alerts"))
    marked = order.join(hits.select("entity_id", "alert_id").withColumn("hit", F.lit(1)).hint("merge"), ["entity_id", "alert_id"], "left").join(sizes, "entity_id")
    return _at_shares(marked, "position", shares).withColumn("precision", F.bround(F.try_divide("true_positives", "items"), 6))


def report_of_run(spark: SparkSession, output: str, truth: DataFrame) -> str:
    """A report from what a run wrote, ranking findings by score, without running detectors again."""
    read = lambda n: spark.read.parquet(f"{output}/{n}")
    order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "finding_id")
    ranked = scored(read("findings.parquet")).withColumn("rank", F.row_number().over(order))
    items = ranked.select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs")
    sizes = read("store/alerts.parquet").groupBy("entity_id").agg(F.count("*").alias("alerts")).join(truth.groupBy("entity_id").agg(F.count("*").alias("faults")), "entity_id")
    rows = precision_at(ranked.select("entity_id", F.col("finding_id").alias("item_id"), "rank"), matched(items, truth), sizes).collect()  # one row a budget
    agreement = rank_agreement(read("scores.parquet"), truth).first()
    return report([r.asDict() for r in rows]) + f"\nSpearman correlation of risk index and fault intensity: {agreement['rho']}\n"


def ablation(findings: DataFrame) -> DataFrame:
    """Findings with the suites that they belong to, ``full`` among them: detectors run once, suites are filters."""
    named = [F.when(F.col("detector_id").isin(*d), F.lit(s)) for s, d in SUITES.items()]
    return findings.withColumn("suite", F.explode(F.array_compact(F.array(*named, F.lit("full")))))


def ablation_precision(findings: DataFrame, truth: DataFrame, sizes: DataFrame, share: float = 0.10) -> DataFrame:
    """Each suite alone: its findings, and precision and recall of every entity's first ones by score within the budget; ``sizes`` as in ``precision_at``."""
    hits = matched(findings.select("entity_id", F.col("finding_id").alias("item_id"), "detector_id", "scope", "evidence_refs"), truth)
    marked = scored(findings).join(hits.select(F.col("item_id").alias("finding_id")).distinct().withColumn("hit", F.lit(1)).hint("merge"), "finding_id", "left")
    order = Window.partitionBy("suite", "entity_id").orderBy(F.desc("score"), "finding_id")
    ranked = ablation(marked).withColumn("rank", F.row_number().over(order)).join(sizes, "entity_id")
    inside = F.col("rank") <= budget_of(F.col("alerts"), share)
    total = sizes.agg(F.sum("faults").alias("faults"))
    out = ranked.groupBy("suite").agg(F.count("*").alias("findings"), F.count_if(inside).alias("items"), F.count_if(inside & F.col("hit").isNotNull()).alias("true_positives"))
    return out.join(F.broadcast(total)).select("suite", "findings", "items", "true_positives", F.bround(F.try_divide("true_positives", "items"), 6).alias("precision"), F.bround(F.try_divide("true_positives", "faults"), 6).alias("recall"))


def lifts(measured: DataFrame, baselines: DataFrame) -> DataFrame:
    """How many times better than each baseline (share, baseline, precision) the ranking (share, precision) is; 1 where a baseline finds nothing."""
    base = baselines.select("share", "baseline", F.col("precision").alias("baseline_precision"))
    return measured.select("share", "precision").join(base, "share").withColumn("lift", lift(F.col("precision"), F.col("baseline_precision")))


def fault_intensity(truth: DataFrame) -> DataFrame:
    return truth.groupBy("entity_id").agg(F.sum(F.when(F.col("intensity") == "strong", 2.0).otherwise(1.0)).alias("intensity"))


def rank_agreement(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Spearman's correlation of risk index and fault intensity over all entities."""
    both = scores.select("entity_id", "risk_index").join(fault_intensity(truth), "entity_id", "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))
    return spearman(both, "risk_index", "intensity")


def most_faulty(truth: DataFrame) -> DataFrame:
    return truth.groupBy("entity_id").agg(F.count("*").alias("faults")).orderBy(F.desc("faults"), "entity_id").limit(1)


def report(metrics: list[dict], title: str = "Validation") -> str:
    """Metric rows as a Markdown table."""
    names = list(metrics[0]) if metrics else []
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(str(m[n]) for n in names) + " |" for m in metrics]) + "\n"
