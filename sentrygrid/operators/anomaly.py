"""Novel months: robust scaling, exact local outlier factors, and an isolation forest that grows from hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrygrid.schema import THRESHOLDS
from sentrygrid.sources import scratch

FEATURES = ("monthly_volume", "crit_volume", "crit_median_close_sec", "ch_esc_rate", "unworked_ratio", "sla_window_ratio", "fp_rate", "unique_assets_alerted")
TREES, SUBSAMPLE = 100, 256
#: Digits of the features that the forest and the leading features see, so that engines agree on ties.
DIGITS = 9
#: Points that are compared pairwise at once.
BLOCK = 2000


def scaled(months: DataFrame) -> DataFrame:
    """Every feature less its median over its interquartile range (1 where that is 0), over all rows.
    Months are written first: statistics, forest and factors read them many times, and each would make them from all alerts."""
    months = kept(months)
    stats = months.agg(*[F.percentile(F.col(f).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{f}") for f in FEATURES])
    spread = lambda q: F.when(q[2] - q[0] == 0, 1.0).otherwise(q[2] - q[0])
    out = months.join(F.broadcast(stats))  # one row
    return out.select("entity_id", "year_month", *[((F.col(f) - F.col(f"q_{f}")[1]) / spread(F.col(f"q_{f}"))).alias(f) for f in FEATURES])


def kept(df: DataFrame) -> DataFrame:
    """Computed once: written to the session's shared folder and read back, so that plans stay short."""
    return scratch.written(df.sparkSession, df, "novelty")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        out += (x[:, i, None] - y[None, :, i]) ** 2
    return np.sqrt(out)


def _sub_blocks(key: str, sizes: dict[int, int], block: int) -> Column:
    """The part of its cell that a point belongs to, each of about ``block`` points."""
    parts = F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, math.ceil(n / block))])
    return F.pmod(F.xxhash64(key), F.coalesce(parts[F.col("cell")], F.lit(1))).cast("int")


def _first_names(rows: DataFrame, k: int) -> DataFrame:
    """Distinct points with the first k + 1 of their names: no later one can be a neighbour."""
    salt = F.pmod(F.xxhash64("a"), F.lit(64))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("x", salt).orderBy("a"))).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("a"))).where(F.col("r") <= k + 1)
    return first.groupBy("x").agg(F.array_sort(F.collect_list("a")).alias("names")).select(F.col("names")[0].alias("p"), "x", "names")


def nearest(rows: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The k nearest other rows of every row (a, x): a, b, d, ties broken by b; exact at any size.

    Points go to the cell of their nearest pivot.  The k-th distance within a part of the cell bounds the true one, and
    a point visits every cell that the triangle inequality does not put beyond its bound."""
    points = kept(_first_names(rows, k))
    pivots = points.orderBy(F.xxhash64("p"), "p").limit(math.ceil(points.count() / block)).select("x").toPandas()["x"]
    centre = np.array(pivots.tolist(), float)

    def place(parts):
        for pdf in parts:
            d = _distances(np.array(pdf["x"].tolist(), float), centre) if len(pdf) else np.zeros((0, 1))
            yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), away=d.min(axis=1))

    placed = kept(points.mapInPandas(place, "p string, x array<double>, names array<string>, cell int, away double"))
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()
    held, radius = np.zeros(len(centre), int), np.full(len(centre), -np.inf)
    held[cells["cell"]], radius[cells["cell"]] = cells["n"], cells["radius"]

    def bound(pdf):
        x = np.array(pdf["x"].tolist(), float)
        most = np.full(len(x), np.inf)
        for at in range(0, len(x), 256) if len(x) > k else ():
            most[at : at + 256] = np.partition(_distances(x[at : at + 256], x), k, axis=1)[:, k]  # its own distance of 0 is one of them
        return pd.DataFrame({"p": pdf["p"], "x": pdf["x"], "most": most})

    def visit(parts):
        for pdf in parts:
            d = _distances(np.array(pdf["x"].tolist(), float), centre)
            full = np.where(held > k, d + radius, np.inf).min(axis=1)  # a cell of more than k points lies within this
            most = np.minimum(pdf["most"].to_numpy(float), full) * (1 + 1e-9) + 1e-12
            i, c = np.nonzero((d - radius <= most[:, None]) & (held > 0))
            yield pd.DataFrame({"p": pdf["p"].to_numpy()[i], "x": pdf["x"].to_numpy()[i], "cell": c.astype(np.int32)})

    parted = placed.withColumn("part", _sub_blocks("p", dict(enumerate(held.tolist())), block))
    bounded = parted.groupBy("cell", "part").applyInPandas(bound, "p string, x array<double>, most double")
    visitors = kept(bounded.mapInPandas(visit, "p string, x array<double>, cell int"))
    guests = {r["cell"]: r["count"] for r in visitors.groupBy("cell").count().collect()}
    every = lambda sizes: F.sequence(F.lit(0), F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, math.ceil(n / block) - 1)])[F.col("cell")])
    asked = visitors.withColumn("chunk", _sub_blocks("p", guests, block)).select("cell", F.explode(every({c: n for c, n in enumerate(held.tolist()) if n})).alias("part"), "chunk", "p", "x", F.lit(None).cast("array<string>").alias("names"))
    asking = parted.where(F.col("cell").isin(list(guests))).select("cell", "part", F.explode(every(guests)).alias("chunk"), "p", "x", "names")

    def compare(pdf):
        own = pdf["names"].notna()
        there, here = pdf[own], pdf[~own]
        out = []
        if len(there) and len(here):
            y, x = np.array(there["x"].tolist(), float), np.array(here["x"].tolist(), float)
            names, ids = there["names"].tolist(), here["p"].tolist()
            for at in range(0, len(x), 256):
                d = _distances(x[at : at + 256], y)
                last = np.partition(d, min(k, len(y) - 1), axis=1)[:, min(k, len(y) - 1)]
                for i, row in enumerate(d):
                    near = sorted((row[j], b) for j in np.flatnonzero(row <= last[i]) for b in names[j])
                    out += [(ids[at + i], b, g) for g, b in near[: k + 1]]
        return pd.DataFrame(out, columns=["p", "b", "d"])

    found = asked.unionByName(asking).groupBy("cell", "part", "chunk").applyInPandas(compare, "p string, b string, d double")
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("d", "b"))).where(F.col("r") <= k + 1)
    lists = first.groupBy("p").agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("near")).join(points.select("p", "x"), "p")
    others = F.slice(F.filter("near", lambda s: s["b"] != F.col("a")), 1, k)
    return rows.join(lists, "x").select("a", F.explode(others).alias("s")).select("a", "s.b", "s.d")


def lof(points: DataFrame, k: int = THRESHOLDS.nov01_neighbors, block: int = BLOCK) -> DataFrame:
    """Local outlier factor of every row (Breunig et al. 2000) with exactly k neighbours among all rows, ties broken by row key."""
    rows = kept(points.select(F.concat_ws("/", "entity_id", "year_month").alias("a"), F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("x")))
    k = min(k, rows.count() - 1)
    if k < 2:
        return points.select("entity_id", "year_month", F.lit(None).cast("double").alias("lof"))
    near = kept(nearest(rows, k, block))
    reach = near.groupBy("a").agg(F.max("d").alias("kd"))
    density = near.join(reach.select(F.col("a").alias("b"), "kd"), "b").groupBy("a").agg((1.0 / (F.avg(F.greatest("d", "kd")) + 1e-10)).alias("lrd"))
    ratio = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lrd_b")), "b").groupBy("a").agg(F.avg("lrd_b").alias("around"))
    out = density.join(ratio, "a").select("a", (F.col("around") / F.col("lrd")).alias("lof"))
    return out.select(F.substring_index("a", "/", 1).alias("entity_id"), F.substring_index("a", "/", -1).alias("year_month"), "lof")


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _draw(kind: str, *keys: Column) -> Column:
    """A whole number below 2 ** 32 for keys."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(kind), *keys)), 1, 8), 16, 10).cast("long")


def grow_forest(points: DataFrame, rows: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """Isolation trees (Liu et al. 2008) as rows (tree, node, feature, cut, size, depth), the root 1 and the children of n 2n and 2n + 1;
    leaves have no feature.

    A tree takes the rows whose hash with it is low enough, about ``subsample``.  Trees grow a level at a time: a window over each node counts
    its rows and bounds their features; the feature, among those that vary, and the cut are drawn from a hash of tree and node.  A
    tree's rows stay in one partition, so no level shuffles."""
    limit = math.ceil(math.log2(max(min(subsample, rows), 2)))
    enough = (subsample << 32) // rows if rows > subsample else 1 << 32
    x = F.array(*[F.round(F.col(f).cast("double"), DIGITS) for f in FEATURES])
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _draw("row", t.cast("string"), F.col("a")) < enough)
    grown = points.select(F.concat_ws("/", "entity_id", "year_month").alias("a"), x.alias("x")).select("x", F.explode(mine).alias("tree")).repartition("tree")
    step = "struct<node:long,feature:int,cut:double,size:long,depth:int>"
    grown = grown.select("tree", "x", F.lit(1).cast("long").alias("node"), F.lit(False).alias("done"), F.array().cast(f"array<{step}>").alias("steps"))
    node = Window.partitionBy("tree", "node")
    name = [F.col("tree").cast("string"), F.col("node").cast("string")]
    for depth in range(limit + 1):
        bounds = [F.array(*[f(F.col("x")[i]).over(node) for i in range(len(FEATURES))]) for f in (F.min, F.max)]
        level = grown.withColumns({"size": F.count("*").over(node), "lo": bounds[0], "hi": bounds[1]})
        level = level.withColumn("open", F.filter(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), lambda i: F.get("hi", i) > F.get("lo", i)))
        inner = ~F.col("done") & (F.col("size") > 1) & (F.size("open") > 0) & F.lit(depth < limit)
        level = level.withColumn("feature", F.when(inner, F.get("open", (_draw("feature", *name) % F.size("open")).cast("int"))))
        low, high = F.get("lo", F.col("feature")), F.get("hi", F.col("feature"))
        level = level.withColumn("cut", low + _draw("cut", *name) / float(1 << 32) * (high - low))
        here = F.array(F.struct("node", "feature", "cut", "size", F.lit(depth).alias("depth")).cast(step))
        child = F.col("node") * 2 + F.when(F.get("x", F.col("feature")) <= F.col("cut"), 0).otherwise(1)
        grown = level.select("tree", "x", F.when(F.col("feature").isNull(), F.col("node")).otherwise(child).alias("node"), F.col("feature").isNull().alias("done"), F.when(F.col("done"), F.col("steps")).otherwise(F.concat("steps", here)).alias("steps"))
    return grown.select("tree", F.explode("steps").alias("s")).select("tree", "s.*").distinct()


def _tables(splits: list) -> list[list[tuple]]:
    """Trees as lists of (feature, cut, left, right), or (-1, depth + expected rest, 0, 0)."""
    trees: dict[int, dict[int, tuple]] = {}
    for r in splits:
        trees.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["cut"], r["size"], r["depth"])
    out = []
    for nodes in trees.values():
        at = {n: i for i, n in enumerate(sorted(nodes))}
        out.append([(-1, depth + _path(size), 0, 0) if f is None else (f, cut, at[2 * n], at[2 * n + 1]) for n, (f, cut, size, depth) in sorted(nodes.items())])
    return out


def forest_scores(x: np.ndarray, forest: list[list[tuple]], size: int) -> np.ndarray:
    """Minus the anomaly score 2^(-mean depth / expected depth): lower is more unusual."""
    depth = np.zeros(len(x))
    for nodes in forest:
        at = np.zeros(len(x), np.int64)
        table = np.array(nodes)
        while True:
            feature = table[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                break
            go = np.where(x[np.arange(len(x)), np.maximum(feature, 0)] <= table[at, 1], table[at, 2], table[at, 3]).astype(np.int64)
            at = np.where(inner, go, at)
        depth += table[at, 1]
    return -(2.0 ** (-depth / len(forest) / max(_path(size), 1e-9)))


def isolation_forest(points: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """forest_score of every row.  The forest, at most ``trees`` times twice ``subsample`` nodes, goes to the tasks; rows are scored where they lie."""
    rows = points.count()
    names = list(FEATURES)
    forest = _tables(grow_forest(points, rows, trees, subsample).collect()) if rows > 1 else []
    if not forest:
        return points.select("entity_id", "year_month", F.lit(-0.5).alias("forest_score"))
    size = min(subsample, rows)

    def score(parts):
        for pdf in parts:
            yield pd.DataFrame({"entity_id": pdf["entity_id"], "year_month": pdf["year_month"], "forest_score": forest_scores(pdf[names].to_numpy(float), forest, size)})

    rounded = [F.round(F.col(f).cast("double"), DIGITS).alias(f) for f in names]
    return points.select("entity_id", "year_month", *rounded).mapInPandas(score, "entity_id string, year_month string, forest_score double")


def novelty(months: DataFrame) -> DataFrame:
    """Months that the forest or the outlier factor puts beyond the contamination share, with their two leading features."""
    t = THRESHOLDS
    points = scaled(months)
    if points.count() < t.nov01_min_rows:
        empty = points.limit(0)
        return empty.select("entity_id", "year_month", F.lit(0.0).alias("forest_score"), F.lit(0.0).alias("lof"), F.array(F.lit("")).alias("drivers"), F.lit(False).alias("hit"))
    joined = kept(points.join(isolation_forest(points), ["entity_id", "year_month"]).join(lof(points), ["entity_id", "year_month"], "left"))
    cut = joined.agg(F.percentile("forest_score", t.nov01_contamination).alias("low"), F.percentile("lof", 1 - t.nov01_contamination).alias("high"))

    def strength(f: str) -> Column:
        return F.struct((-F.abs(F.round(f, DIGITS))).alias("s"), F.lit(f).alias("f"))

    drivers = F.transform(F.slice(F.array_sort(F.array(*[strength(f) for f in FEATURES])), 1, 2), lambda s: s["f"])
    hit = (F.col("forest_score") < F.col("low")) | F.coalesce(F.col("lof") > F.col("high"), F.lit(False))
    return joined.join(F.broadcast(cut)).select("entity_id", "year_month", "forest_score", "lof", drivers.alias("drivers"), hit.alias("hit"))
