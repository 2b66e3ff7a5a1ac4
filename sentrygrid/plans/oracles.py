"""The registry's results as DuckDB SQL, written from the operators' definitions, over the same tables."""

from __future__ import annotations

import re

from sentrygrid.schema import AREA_WEIGHTS, DETECTOR_AREAS

CTES: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


cte("entities", """
SELECT 'N' || n_nationkey AS entity_id, CASE WHEN n_nationkey >= 23 THEN 'OTHER' ELSE r_name END AS sector,
  CASE WHEN n_nationkey < 15 THEN 'Tier-1' ELSE 'Tier-2' END AS size_band,
  CASE WHEN n_nationkey % 7 <> 6 THEN (40 + n_nationkey * 7 % 45)::DOUBLE END AS claimed_mttc_min,
  CASE WHEN n_nationkey % 7 <> 6 THEN (60 + n_nationkey * 13 % 41)::DOUBLE END AS claimed_coverage_pct,
  CASE WHEN n_nationkey % 7 <> 6 THEN (25 + n_nationkey * 11 % 30)::DOUBLE END AS claimed_fp_rate_pct,
  CASE WHEN n_nationkey % 7 <> 6 THEN (20 + n_nationkey * 17 % 45)::DOUBLE END AS claimed_escalation_pct
FROM nation JOIN region ON n_regionkey = r_regionkey""")
cte("assets", """
SELECT 'C' || c_custkey AS asset_id, 'N' || c_nationkey AS entity_id,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'critical' WHEN 'MACHINERY' THEN 'high' WHEN 'HOUSEHOLD' THEN 'medium' ELSE 'low' END AS criticality,
  c_acctbal >= 0 AS monitoring_expected FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, ['critical', 'high', 'medium', 'low'][(s_suppkey % 4 + 1)::INT], s_acctbal >= 0 FROM supplier""")
cte("alerts", """
SELECT *, ack_us + (60 + floor(o_totalprice)::BIGINT % 7140) * 1000000 AS closed_us FROM (
  SELECT o_orderkey AS k, o_totalprice, 'O' || o_orderkey AS alert_id, 'N' || c_nationkey AS entity_id, 'C' || o_custkey AS asset_id, 'CAT' || (o_orderkey * 31 % 6) AS category,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
    epoch_us(o_orderdate) + o_orderkey * 7919 % 86400 * 1000000 AS created_us,
    epoch_us(o_orderdate) + o_orderkey * 7919 % 86400 * 1000000 + (60 + o_orderkey * 104729 % 840) * 1000000 AS ack_us,
    CASE o_orderstatus WHEN 'F' THEN 'false_positive' WHEN 'O' THEN 'true_positive' ELSE 'unresolved' END AS disposition
  FROM orders JOIN customer ON o_custkey = c_custkey)""")
cte("cases", """
SELECT 'K' || l_orderkey AS case_id, 'O' || l_orderkey AS alert_id, 'A' || (s % 8) AS analyst_id, flag AS closure_code, p_name AS notes_text
FROM (SELECT l_orderkey, min(l_suppkey) AS s, min(l_returnflag) AS flag, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey) LEFT JOIN part ON p = p_partkey""")
cte("wf", "SELECT 'K' || l_orderkey AS case_id, l_returnflag AS step FROM lineitem WHERE l_linestatus = 'F'")
cte("esc", "SELECT 'K' || l_orderkey AS case_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
cte("af", """
SELECT a.*, greatest(0, (closed_us - ack_us) / 1e6) AS dur, greatest(0, (closed_us - ack_us) / 1e6) / 60 BETWEEN 55 AND 60 AS in_sla,
  severity IN ('critical', 'high') AS ch, c.case_id, c.case_id IS NOT NULL AS has_case, analyst_id, closure_code, notes_text, coalesce(w.n, 0) AS wf_n, e.case_id IS NOT NULL AS escalated,
  (created_us - lag(created_us) OVER rep) / 86400e6 AS days_since_prev,
  coalesce((created_us - lag(created_us) OVER rep) / 86400e6, 999) <= 7 AS repeat7,
  make_timestamp(created_us) AS created_ts
FROM alerts a LEFT JOIN cases c USING (alert_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM wf GROUP BY 1) w ON w.case_id = c.case_id
  LEFT JOIN (SELECT DISTINCT case_id FROM esc) e ON e.case_id = c.case_id
WINDOW rep AS (PARTITION BY a.entity_id, asset_id, category ORDER BY created_us, a.alert_id)""")
cte("asf", """
SELECT s.*, coalesce(t, 0) AS total_alerts, coalesce(cr, 0) AS critical_alerts, coalesce(hi, 0) AS high_alerts, coalesce(t, 0) = 0 AS is_silent
FROM assets s LEFT JOIN (SELECT asset_id, count(*) AS t, count(*) FILTER (severity = 'critical') AS cr, count(*) FILTER (severity = 'high') AS hi FROM alerts GROUP BY 1) USING (asset_id)""")
cte("ec", "SELECT c.*, entity_id FROM cases c JOIN alerts USING (alert_id)")
cte("gaps", """
SELECT entity_id, day + 1 AS start, nxt AS "end", nxt - day - 1 AS days FROM (
  SELECT entity_id, day, lead(day) OVER (PARTITION BY entity_id ORDER BY day) AS nxt FROM (SELECT DISTINCT entity_id, make_timestamp(created_us)::DATE AS day FROM alerts))
WHERE nxt - day - 1 > 0""")
cte("ac", "SELECT entity_id, analyst_id, count(*) AS n FROM af WHERE ch AND analyst_id IS NOT NULL GROUP BY ALL")
cte("gini_t", """
SELECT entity_id, 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*)::DOUBLE AS gini
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n) AS i FROM ac) GROUP BY 1""")
cte("entropy_t", """
SELECT entity_id, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS bits
FROM (SELECT entity_id, closure_code, count(*) AS c FROM ec WHERE closure_code IS NOT NULL GROUP BY ALL) GROUP BY 1""")
cte("notes_t", """
SELECT entity_id, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS bits
FROM (SELECT entity_id, left(notes_text, 40) AS l, count(*) AS c FROM ec WHERE notes_text IS NOT NULL GROUP BY ALL) GROUP BY 1""")
cte("months", """
SELECT entity_id, strftime(created_ts, '%Y-%m') AS year_month, count(*) AS monthly_volume, count(*) FILTER (severity = 'critical') AS crit_volume,
  coalesce(median(dur) FILTER (severity = 'critical'), 0) AS crit_median_close_sec, coalesce(avg(escalated::INT) FILTER (ch), 0) AS ch_esc_rate, avg((wf_n = 0)::INT) AS unworked_ratio,
  avg(in_sla::INT) AS sla_window_ratio, avg((disposition = 'false_positive')::INT) AS fp_rate, count(DISTINCT asset_id) AS unique_assets_alerted
FROM af GROUP BY ALL""")
cte("co", """
SELECT entity_id, sector, size_band, CASE WHEN nb >= 3 THEN 'primary' WHEN ns >= 3 THEN 'sector_fallback' ELSE 'global_fallback' END AS cohort_level,
  CASE WHEN nb >= 3 THEN nb WHEN ns >= 3 THEN ns ELSE nt END AS cohort_size,
  CASE WHEN nb >= 3 THEN 'band|' || sector || '|' || size_band WHEN ns >= 3 THEN 'sector|' || sector ELSE 'all' END AS cohort_key
FROM (SELECT *, count(*) OVER (PARTITION BY sector, size_band) AS nb, count(*) OVER (PARTITION BY sector) AS ns, count(*) OVER () AS nt FROM entities)""")
cte("pairs", """
SELECT e.entity_id, e.cohort_level, p.entity_id AS peer FROM co e JOIN co p
ON CASE e.cohort_level WHEN 'primary' THEN e.sector = p.sector AND e.size_band = p.size_band WHEN 'sector_fallback' THEN e.sector = p.sector ELSE true END""")


def peers(values: str, extra: str = "") -> str:
    """Peer statistics of a values query (entity_id, value) by explicit pairs, in CTEs named v, ps and peer."""
    return f"""
v AS ({values}),
few AS (SELECT p.entity_id, count(v.value) AS n FROM pairs p JOIN v ON v.entity_id = p.peer WHERE v.value IS NOT NULL GROUP BY 1),
pv AS (SELECT o.entity_id, o.value AS own, c.cohort_level, q.value AS x FROM v o JOIN co c USING (entity_id) JOIN few USING (entity_id)
  JOIN v q ON (few.n < 3 OR EXISTS (SELECT 1 FROM pairs p WHERE p.entity_id = o.entity_id AND p.peer = q.entity_id)) WHERE o.value IS NOT NULL AND q.value IS NOT NULL),
p1 AS (SELECT entity_id, any_value(own) AS value, any_value(cohort_level) AS cohort_level, count(*) AS peers, median(x) AS median, stddev_pop(x) AS sd,
  count(*) FILTER (x < own) AS lo, count(*) FILTER (x <= own) AS hi FROM pv GROUP BY 1),
p2 AS (SELECT entity_id, median(abs(x - median)) AS mad FROM pv JOIN p1 USING (entity_id) GROUP BY 1),
peer AS (SELECT *, CASE WHEN 1.4826 * mad >= 1e-6 THEN greatest(least((value - median) / (1.4826 * mad), 10), -10) WHEN sd >= 1e-6 THEN greatest(least((value - median) / sd, 10), -10)
  WHEN abs(value - median) < 1e-6 THEN 0 ELSE sign(value - median) * 3 END AS z, (lo + hi) / (2.0 * peers) AS percentile FROM p1 JOIN p2 USING (entity_id)){extra}"""


PEER = "entity_id, round(value, 6) AS value, cohort_level, peers, round(median, 6) AS median, round(mad, 6) AS mad, round(z, 6) AS z, round(percentile, 6) AS percentile"

_VOLUME = "SELECT entity_id, count(*)::DOUBLE AS value FROM alerts GROUP BY 1"
_ALERTS_PER_ASSET = "SELECT e.entity_id, coalesce(n, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS value FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS m FROM assets GROUP BY 1) USING (entity_id)"
_COVERAGE = "SELECT entity_id, CASE WHEN c > 0 THEN least((c - s) / c::DOUBLE, m / c::DOUBLE) ELSE 1 END AS value FROM (SELECT entity_id, count(*) FILTER (criticality = 'critical') AS c, count(*) FILTER (criticality = 'critical' AND monitoring_expected) AS m, count(*) FILTER (criticality = 'critical' AND monitoring_expected AND is_silent) AS s FROM asf GROUP BY 1)"
_SHARES = "SELECT entity_id, max(n) / any_value(rows)::DOUBLE AS value, arg_min(analyst_id, (-n, analyst_id)) AS analyst_id FROM ac JOIN (SELECT entity_id, count(*) AS rows FROM af WHERE ch GROUP BY 1) USING (entity_id) GROUP BY 1 HAVING any_value(rows) >= 10 AND count(*) >= 3"
_EG01 = """
own AS (SELECT alert_id, entity_id, severity, dur FROM af WHERE ch),
rows AS (SELECT p.entity_id AS target, o.entity_id = p.entity_id AS mine, o.severity, o.dur FROM pairs p JOIN own o ON o.entity_id = p.peer),
sizes AS (SELECT target, severity, count(*) FILTER (mine) AS n_own, count(*) AS n_all FROM rows GROUP BY ALL),
ref AS (SELECT r.* FROM rows r JOIN sizes s USING (target, severity) WHERE n_own >= 5 AND n_all >= 5 AND (NOT mine OR n_all - n_own < 5)),
s1 AS (SELECT target, severity, quantile_cont(dur, 5e-2) AS p5, median(dur) AS median, stddev_pop(dur) AS sd, count(*) AS n, list_sort(list(dur)) AS all_dur FROM ref GROUP BY ALL),
s2 AS (SELECT target, severity, median(abs(dur - median)) AS mad FROM ref JOIN s1 USING (target, severity) GROUP BY ALL),
ranks AS (SELECT target, severity, d.dur, count(*) FILTER (ref.dur < d.dur) AS lo, count(*) FILTER (ref.dur <= d.dur) AS hi
  FROM (SELECT DISTINCT entity_id AS target, severity, dur FROM own) d JOIN ref USING (target, severity) GROUP BY ALL),
done AS (SELECT o.entity_id, alert_id, o.severity, o.dur, p5, median, CASE WHEN 1.4826 * mad >= 1e-6 THEN greatest(least((o.dur - median) / (1.4826 * mad), 10), -10) WHEN sd >= 1e-6 THEN greatest(least((o.dur - median) / sd, 10), -10)
  WHEN abs(o.dur - median) < 1e-6 THEN 0 ELSE sign(o.dur - median) * 3 END AS z, (lo + hi) / (2.0 * n) AS percentile
  FROM own o JOIN s1 ON s1.target = o.entity_id AND s1.severity = o.severity JOIN s2 ON s2.target = s1.target AND s2.severity = s1.severity JOIN ranks k ON k.target = o.entity_id AND k.severity = o.severity AND k.dur = o.dur)"""
_NOTES = """
cnt AS (SELECT entity_id, trim(notes_text) AS note, count(*) AS n FROM ec WHERE length(trim(notes_text)) > 10 GROUP BY ALL),
tot AS (SELECT entity_id, sum(n)::BIGINT AS notes FROM cnt GROUP BY 1),
cas AS (SELECT entity_id, count(*) AS cases FROM ec GROUP BY 1),
top AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, note) <= 5 AND n >= 5),
words AS (SELECT entity_id, note, ' ' || w || ' ' AS w FROM (SELECT entity_id, note, unnest(regexp_split_to_array(lower(note), '\\s+')) AS w FROM top) WHERE w <> ''),
grams AS (SELECT entity_id, note, substr(w, i, g) AS gram, count(*) AS tf FROM words, (SELECT unnest([3, 4, 5]) AS g) gs, LATERAL (SELECT unnest(range(1, greatest(length(w) - g + 2, 2))) AS i) WHERE length(w) >= g OR g = 3 GROUP BY ALL),
dfs AS (SELECT entity_id, gram, count(*) AS df FROM grams GROUP BY ALL),
nn AS (SELECT entity_id, count(*) AS n FROM top GROUP BY 1),
wt AS (SELECT g.entity_id, note, gram, tf * (ln((1.0 + n) / (1 + df)) + 1) AS w FROM grams g JOIN dfs USING (entity_id, gram) JOIN nn USING (entity_id)),
unitw AS (SELECT entity_id, note, gram, w / sqrt(sum(w * w) OVER (PARTITION BY entity_id, note)) AS w FROM wt),
sims AS (SELECT entity_id, max(sim) AS sim FROM (SELECT x.entity_id, x.note, y.note, sum(x.w * y.w) AS sim FROM unitw x JOIN unitw y ON x.entity_id = y.entity_id AND x.gram = y.gram AND x.note < y.note GROUP BY ALL) GROUP BY 1),
done AS (SELECT t.entity_id, cases, notes, dominant / notes::DOUBLE AS share, CASE WHEN nn.n = 1 THEN 1 ELSE coalesce(sim, 0) END AS similarity, bits AS entropy
  FROM (SELECT entity_id, max(n) AS dominant FROM top GROUP BY 1) t JOIN tot USING (entity_id) JOIN cas USING (entity_id) JOIN nn USING (entity_id) LEFT JOIN sims USING (entity_id) JOIN entropy_t USING (entity_id) WHERE cases >= 5 AND notes >= 5)"""

def _named(**params: str) -> str:
    """Parameters as text: names in order, numbers with six digits; values ending in a star are text."""
    one = lambda k, v: f"'{k}=' || {v[:-1]}" if v.endswith("*") else f"'{k}=' || printf('%.6f', round(({v})::DOUBLE, 6))"
    return "array_to_string([" + ", ".join(one(k, v) for k, v in sorted(params.items())) + "], ',')"


_RATIO = "CASE WHEN median > 0 THEN value / median ELSE 1 END"
REASONS = {
    "EG-01": ("printf('%s alert closed in %.0f s; peers'' 5th percentile is %.0f s', severity, round(dur, 0), round(p5, 0))", _named(dur="dur", p5="p5", median="median", cohort_level="cohort_level*")),
    "EG-02": ("printf('%.1f%% of critical and high alerts escalated; peers'' median is %.1f%%', round(value * 100, 1), round(median * 100, 1))", _named(value="value", median="median", peers="peers", cohort_level="cohort_level*")),
    "EG-03": ("printf('case %s was open %.0f s without a workflow event', case_id, round(dur, 0))", _named(closure_duration_sec="dur")),
    "EG-04": ("printf('one note covers %.0f%% of notes, similarity %.2f', round(share * 100, 0), round(similarity::DOUBLE, 2))", _named(share="share", similarity="similarity", entropy="entropy")),
    "EG-05": ("printf('%d repeats of %s within a week of the one before', repeats, category)", _named(category="category*", repeats="repeats")),
    "EG-06": ("printf('%.1f%% of closures fall just before the hour', round(value * 100, 1))", _named(value="value", median="median", cohort_level="cohort_level*")),
    "EG-07": ("printf('one analyst closed %.0f%% of critical and high alerts', round(value * 100, 0))", _named(analyst_id="analyst_id*", value="value", median="median")),
    "EG-08": ("printf('false-positive rate drifted from %.2f to %.2f', round(first_rate, 2), round(last_rate, 2))", _named(cusum="cusum", first_rate="first_rate", last_rate="last_rate", months="months")),
    "NS-01": ("printf('monitored critical asset %s sent no alert', asset_id)", _named(asset_id="asset_id*")),
    "NS-02": ("printf('%d alerts of %s where %.1f were expected', n, category, round(mu, 1))", _named(category="category*", n="n", mu="mu", p="p")),
    "NS-03": ("printf('%d critical or high alerts have no case', count(*))", "'orphans=' || printf('%.6f', count(*)::DOUBLE)"),
    "NS-04": ("printf('%.2f alerts an asset; peers'' median is %.2f', round(value, 2), round(median, 2))", _named(value="value", median="median", ratio=_RATIO, z="z")),
    "NS-05": ("printf('no alert for %d days', days)", _named(days="days")),
    "NS-06": ("printf('critical coverage %.0f%%; peers'' median is %.0f%%', round(value * 100, 0), round(median * 100, 0))", _named(value="value", median="median")),
}
_HEAD = "SELECT {reason} AS reason_text, {params} AS params, 'FND-{d}-' || left(sha256('{d}:' || entity_id || ':' || {seed}), 12) AS finding_id, '{d}' AS detector_id, '{kind}' AS category, entity_id, {scope} AS scope, {sev} AS sev, {dev} AS dev, {pct} AS pct, {conf} AS conf, {refs} AS refs FROM {rows}"
_ENTITY, _TIERED = "'entity:' || entity_id", "CASE WHEN cohort_level = 'primary' THEN {} ELSE {} END"


def found(d: str, kind: str, seed: str, scope: str, sev: float | str, dev: str, pct: float | str, conf: float | str, rows: str, refs: str = "[]::VARCHAR[]", lead: str = "") -> None:
    """The findings of a detector as a CTE; ``lead``: CTEs of its own."""
    sql = _HEAD.format(d=d, kind=kind, seed=seed, scope=scope, sev=sev, dev=dev, pct=pct, conf=conf, refs=refs, rows=rows, reason=REASONS[d][0], params=REASONS[d][1])
    cte("f_" + d.replace("-", "").lower(), f"WITH {lead.strip()}\n{sql}" if lead else sql)


def samples(key: str, ref: str, where: str, order: str, n: int, rows: str = "af") -> str:
    """The first references of each key."""
    return f"(SELECT {key}, list({ref} ORDER BY r) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {rows} WHERE {where}) WHERE r <= {n} GROUP BY ALL)"


_ORDER = "asset_id, category, created_us, alert_id"
_RATE = "SELECT entity_id, avg(escalated::INT) AS value FROM af WHERE ch GROUP BY 1 HAVING count(*) >= 5"
_Z, _P = "round_even(z, 3)", "round_even(percentile, 4)"
_SOME = "coalesce(refs, []::VARCHAR[])"
_MISSED = """
SELECT *, least(1, list_sum(list_transform(range(0, n + 1), lambda i: exp(-mu + i * ln(mu) - lgamma(i + 1))))) AS p FROM (
  SELECT o.entity_id, m.category, coalesce(x.n, 0) AS n, m.n / t.n::DOUBLE * o.n AS mu FROM (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) o
  JOIN (SELECT p.entity_id, category, count(*) AS n FROM pairs p JOIN alerts a ON a.entity_id = p.peer GROUP BY ALL) m USING (entity_id)
  JOIN (SELECT p.entity_id, count(*) AS n FROM pairs p JOIN alerts a ON a.entity_id = p.peer GROUP BY ALL) t USING (entity_id)
  LEFT JOIN (SELECT entity_id, category, count(*) AS n FROM alerts GROUP BY ALL) x ON x.entity_id = o.entity_id AND x.category = m.category
  WHERE o.n >= 30 AND t.n >= 100 AND m.n / t.n::DOUBLE >= 5e-2)"""
found("EG-01", "EXECUTION_GAP", "alert_id", "'alert:' || alert_id", "CASE severity WHEN 'critical' THEN 5.0 ELSE 3.0 END", _Z, _P, _TIERED.format(0.95, 0.85), "done JOIN co USING (entity_id) WHERE dur > 0 AND (dur <= p5 OR z <= -2.5 OR percentile <= 5e-2)", "['alerts:' || alert_id]", _EG01)
found("EG-02", "EXECUTION_GAP", "'esc'", _ENTITY, 4.0, _Z, _P, _TIERED.format("0.90", "0.80"), f"peer LEFT JOIN {samples('entity_id', "'alerts:' || alert_id", 'ch AND NOT escalated', _ORDER, 10)} s USING (entity_id) WHERE z <= -2", _SOME, peers(_RATE))
found("EG-04", "EXECUTION_GAP", "'notes'", _ENTITY, 3.5, "round_even(similarity - 0.9, 3)", "0.95", "0.88", f"done LEFT JOIN {samples('entity_id', "'cases:' || case_id", 'true', 'case_id', 5, 'ec')} s USING (entity_id) WHERE share >= 0.35 AND similarity >= 0.9 AND entropy <= 1", _SOME, _NOTES)
found("EG-05", "EXECUTION_GAP", "asset_id || ':' || category", "'asset:' || asset_id", 3.0, "repeats::DOUBLE", "0.9", "0.85", f"(SELECT entity_id, asset_id, category, count(*) AS repeats FROM af WHERE repeat7 GROUP BY ALL HAVING count(*) >= 3) JOIN {samples('entity_id, asset_id, category', "'alerts:' || alert_id", 'repeat7', 'created_us, alert_id', 5)} s USING (entity_id, asset_id, category)", "refs")
found("EG-06", "EXECUTION_GAP", "'sla'", _ENTITY, 3.2, _Z, _P, "0.88", f"peer LEFT JOIN {samples('entity_id', "'alerts:' || alert_id", 'in_sla', _ORDER, 10)} s USING (entity_id) WHERE z >= 2.5 AND value >= 0.15", _SOME, peers("SELECT entity_id, avg(in_sla::INT) AS value FROM af GROUP BY 1"))
found("EG-07", "EXECUTION_GAP", "analyst_id", "'analyst:' || analyst_id", 2.8, _Z, _P, "0.86", f"peer JOIN (SELECT entity_id, analyst_id FROM v) w USING (entity_id) LEFT JOIN {samples('entity_id, analyst_id', "'cases:' || case_id", 'ch AND case_id IS NOT NULL AND analyst_id IS NOT NULL', _ORDER, 5)} s USING (entity_id, analyst_id) WHERE value >= 0.5 AND z >= 1.8", _SOME, peers(_SHARES))
found("NS-01", "NEGATIVE_SPACE", "asset_id", "'asset:' || asset_id", 4.5, "-3.0", "0.02", "0.95", "asf WHERE criticality = 'critical' AND monitoring_expected AND is_silent", "['assets:' || asset_id]")
found("NS-02", "NEGATIVE_SPACE", "category", "'category:' || category", 4.0, "round_even(n - mu, 2)", "round_even(p, 4)", "0.92", f"({_MISSED}) WHERE p <= 0.01 OR (n = 0 AND mu >= 8)")
found("NS-04", "NEGATIVE_SPACE", "'volume'", _ENTITY, 4.2, "round_even(CASE WHEN median > 0 THEN value / median ELSE 1 END - 1, 3)", _P, "0.88", "peer WHERE (CASE WHEN median > 0 THEN value / median ELSE 1 END <= 0.45 OR z <= -1.5) AND median > 0", lead=peers(_ALERTS_PER_ASSET))
found("NS-05", "NEGATIVE_SPACE", "strftime(start, '%Y-%m-%d')", "'period:' || strftime(start, '%Y-%m-%d') || '_to_' || strftime(\"end\", '%Y-%m-%d')", 4.0, "-days::DOUBLE", "0.01", "0.94", "gaps JOIN (SELECT entity_id, max(make_timestamp(created_us)::DATE) - min(make_timestamp(created_us)::DATE) + 1 AS span FROM alerts GROUP BY 1) USING (entity_id) WHERE span >= 14 AND days >= 3")
found("NS-06", "NEGATIVE_SPACE", "'coverage'", _ENTITY, 4.0, _Z, _P, "0.9", "peer WHERE z <= -1.8 AND value <= 0.7", lead=peers(_COVERAGE))
cte("f_eg03", f"""
SELECT {REASONS['EG-03'][0]} AS reason_text, {REASONS['EG-03'][1]} AS params, 'FND-EG-03-' || left(sha256('EG-03:' || entity_id || ':' || alert_id), 12) AS finding_id, 'EG-03' AS detector_id, 'EXECUTION_GAP' AS category, entity_id, 'alert:' || alert_id AS scope,
  2.5 AS sev, -2.5 AS dev, 5e-2 AS pct, 0.92 AS conf, ['alerts:' || alert_id, 'cases:' || case_id] AS refs
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY asset_id, category, created_us, alert_id) AS r FROM af WHERE has_case AND wf_n = 0 AND dur >= 60) WHERE r <= 15""")
cte("walk", """
SELECT entity_id, year_month, fp_rate, monthly_volume, sum(CASE WHEN r = 1 THEN 0 ELSE (fp_rate - first) * 10 - 0.5 END) OVER (PARTITION BY entity_id ORDER BY year_month) AS p
FROM (SELECT *, first_value(fp_rate) OVER w AS first, row_number() OVER w AS r FROM months WINDOW w AS (PARTITION BY entity_id ORDER BY year_month))""")
cte("drift", """
SELECT entity_id, max(s) AS cusum, count(*) AS months, sum(monthly_volume)::BIGINT AS alerts, arg_min(fp_rate, year_month) AS first_rate, arg_max(fp_rate, year_month) AS last_rate
FROM (SELECT *, p - least(0, min(p) OVER (PARTITION BY entity_id ORDER BY year_month)) AS s FROM walk) GROUP BY 1""")
cte("f_eg08", f"""
SELECT {REASONS['EG-08'][0]} AS reason_text, {REASONS['EG-08'][1]} AS params, 'FND-EG-08-' || left(sha256('EG-08:' || entity_id || ':drift'), 12) AS finding_id, 'EG-08' AS detector_id, 'EXECUTION_GAP' AS category, entity_id, 'entity:' || entity_id AS scope,
  3.2 AS sev, round_even(cusum, 3) AS dev, 0.92 AS pct, 0.88 AS conf, []::VARCHAR[] AS refs FROM drift WHERE alerts >= 50 AND months >= 3 AND cusum >= 4""")
cte("f_ns03", f"""
SELECT {REASONS['NS-03'][0]} AS reason_text, {REASONS['NS-03'][1]} AS params, 'FND-NS-03-' || left(sha256('NS-03:' || entity_id || ':orphans'), 12) AS finding_id, 'NS-03' AS detector_id, 'NEGATIVE_SPACE' AS category, entity_id, 'entity:' || entity_id AS scope,
  3.8 AS sev, -count(*)::DOUBLE AS dev, 5e-2 AS pct, 0.9 AS conf, list('alerts:' || alert_id ORDER BY r) FILTER (r <= 10) AS refs
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY asset_id, category, created_us, alert_id) AS r FROM af WHERE ch AND NOT has_case) GROUP BY entity_id""")
FOUND = tuple(f"f_{d.replace('-', '').lower()}" for d in DETECTOR_AREAS if d != "NOV-01")
cte("findings", "SELECT *, sev * least(abs(dev), 5) * conf AS score FROM (" + " UNION ALL ".join(f"SELECT finding_id, detector_id, category, entity_id, scope, sev::DOUBLE AS sev, dev::DOUBLE AS dev, pct::DOUBLE AS pct, conf::DOUBLE AS conf, refs FROM {n}" for n in FOUND) + ")")
cte("area_map", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', '{a}')" for d, xs in DETECTOR_AREAS.items() for a in xs) + ") t(detector_id, area)")
cte("weights", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {w}::DOUBLE)" for a, w in AREA_WEIGHTS.items()) + ") t(area, weight)")
cte("areas", """
SELECT entity_id, area, weight, round_even(100 * (1 - exp(-coalesce(s, 0) / 45)), 2) AS score, coalesce(n, 0) AS findings, coalesce(tops, '') AS top_detectors
FROM entities CROSS JOIN weights LEFT JOIN (
  SELECT entity_id, area, sum(score) AS s, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(detector_id))), 1, 3), ',') AS tops
  FROM findings JOIN area_map USING (detector_id) GROUP BY ALL) USING (entity_id, area)""")
cte("risk", """
SELECT entity_id, r AS risk_index, CASE WHEN r >= 75 THEN 'critical' WHEN r >= 55 THEN 'high' WHEN r >= 35 THEN 'elevated' WHEN r >= 20 THEN 'moderate' ELSE 'low' END AS risk_tier
FROM (SELECT entity_id, round_even(greatest(least(sum(weight * score), 100), 0), 2) AS r FROM areas GROUP BY 1)""")
cte("det_order", "SELECT * FROM (VALUES " + ", ".join(f"('{d}', {i})" for i, d in enumerate(DETECTOR_AREAS)) + ") t(detector_id, det)")
cte("picked", """
SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN rn <= 12 THEN 0 ELSE 1 END, CASE WHEN rn <= 12 THEN rn ELSE -score END, CASE WHEN rn <= 12 THEN det ELSE 0 END, det, finding_id) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, det ORDER BY score DESC, finding_id) AS rn FROM findings JOIN det_order USING (detector_id)) QUALIFY rank <= 34""")
cte("control", """
SELECT entity_id, alert_id, taken, row_number() OVER (PARTITION BY entity_id ORDER BY md5('42:' || entity_id || ':' || alert_id), alert_id) AS pick, greatest(6, 40 - taken) AS need
FROM (SELECT a.entity_id, a.alert_id, r.alert_id IS NOT NULL AS flagged, count(*) FILTER (r.alert_id IS NULL) OVER (PARTITION BY a.entity_id) AS free, coalesce(t.n, 0) AS taken
  FROM alerts a LEFT JOIN (SELECT DISTINCT entity_id, split_part(x, ':', -1) AS alert_id FROM (SELECT entity_id, unnest(refs) AS x FROM picked)) r USING (entity_id, alert_id)
  LEFT JOIN (SELECT entity_id, count(*) AS n FROM picked GROUP BY 1) t ON t.entity_id = a.entity_id)
WHERE NOT flagged OR free < greatest(6, 40 - taken) QUALIFY pick <= need""")
cte("evidence", """
SELECT e.entity_id, mttc_min, coverage_pct, fp_rate_pct, escalation_pct FROM entities e
LEFT JOIN (SELECT entity_id, median(dur / 60) FILTER (ch) AS mttc_min, 100 * avg((disposition = 'false_positive')::INT) AS fp_rate_pct, 100 * avg(escalated::INT) FILTER (ch) AS escalation_pct FROM af GROUP BY 1) USING (entity_id)
LEFT JOIN (SELECT entity_id, 100 * avg((NOT is_silent)::INT) AS coverage_pct FROM asf WHERE criticality = 'critical' AND monitoring_expected GROUP BY 1) USING (entity_id)""")
cte("claimed", """
SELECT entity_id, metric, claimed, observed, CASE WHEN metric IN ('coverage_pct', 'escalation_pct') THEN 1 ELSE -1 END * (claimed - observed) / greatest(abs(observed), 1e-9) AS exag FROM (
  SELECT e.entity_id, unnest(['mttc_min', 'coverage_pct', 'fp_rate_pct', 'escalation_pct']) AS metric, unnest([claimed_mttc_min, claimed_coverage_pct, claimed_fp_rate_pct, claimed_escalation_pct]) AS claimed,
    unnest([mttc_min, coverage_pct, fp_rate_pct, escalation_pct]) AS observed FROM entities e JOIN evidence USING (entity_id)) WHERE claimed IS NOT NULL AND observed IS NOT NULL""")
cte("compared", """
SELECT entity_id, metric, round_even(claimed, 2) AS claimed, round_even(observed, 2) AS observed, round_even(exag, 4) AS exaggeration,
  round_even(least(greatest(CASE WHEN exag > 0 THEN 1 - (exag - 5e-2) / 0.45 ELSE 1 - 0.5 * (-exag - 5e-2) / 0.45 END, 0), 1), 4) AS credibility FROM claimed""")
cte("indexed", """
SELECT entity_id, round_even(100 * avg(credibility), 1) AS idx, count(*) FILTER (exaggeration > 5e-2) AS exaggerated, count(*) FILTER (credibility >= 0.999) AS substantiated, count(*) AS claims FROM compared GROUP BY 1""")
cte("verdicts", "SELECT *, CASE WHEN idx >= 85 THEN 'substantiated' WHEN idx >= 60 THEN 'partially substantiated' ELSE 'not substantiated' END AS verdict FROM indexed")
cte("ledger", """
SELECT o_orderkey AS feedback_id, 'FND-' || (o_orderkey % 200) AS finding_id, 'N' || (o_orderkey % 25) AS entity_id, ['EG-03', 'EG-08', 'NS-03'][(o_orderkey % 3 + 1)::INT] AS detector_id,
  CASE WHEN o_orderkey % 7 < 4 THEN 'dismiss' ELSE 'confirm' END AS decision FROM orders""")
cte("fw", """
SELECT entity_id, detector_id, list_reduce(list_prepend(1.0::DOUBLE, list(CASE decision WHEN 'dismiss' THEN 0.0 ELSE 2.0 END::DOUBLE ORDER BY feedback_id)),
  lambda f, d: CASE WHEN d = 0 THEN round_even(greatest(0.3, f * 0.6), 6) ELSE round_even(least(1.0, f / 0.6), 6) END) AS factor, count(*) AS version
FROM ledger GROUP BY ALL""")
cte("chain", """
WITH RECURSIVE c AS (
  SELECT 0::BIGINT AS entry_id, '' AS timestamp, '' AS event_type, '' AS run_id, '' AS data_hash, '' AS prev_hash, repeat('0', 64) AS entry_hash
  UNION ALL SELECT n_nationkey + 1, '2026-01-01', 'run', n_name, md5(n_name), p, CASE WHEN n_nationkey = 24 THEN 'altered' ELSE sha256(concat_ws('|', n_nationkey + 1, '2026-01-01', 'run', n_name, md5(n_name), p)) END
  FROM (SELECT n.n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n.n_nationkey = 8 THEN 'broken' ELSE c.entry_hash END AS p FROM c JOIN nation n ON n.n_nationkey = c.entry_id))
SELECT * FROM c WHERE entry_id > 0""")
cte("truth", """
SELECT entity_id, 'EG-03' AS det, 'alert:' || alert_id AS scope, CASE WHEN k % 80 = 0 THEN 2.0 ELSE 1.0 END AS w FROM alerts WHERE k % 40 = 0
UNION ALL SELECT entity_id, 'NS-03', 'entity:' || entity_id, 2.0 FROM entities WHERE sector = 'ASIA'""")
cte("matched", """
SELECT finding_id, detector_id FROM findings f WHERE EXISTS (SELECT 1 FROM truth t WHERE t.entity_id = f.entity_id AND (
  contains(lower(f.scope), lower(t.scope)) OR contains(lower(t.scope), lower(f.scope))
  OR len(list_filter(f.refs, lambda r: contains(replace(replace(lower(r), 'alerts:', 'alert:'), 'cases:', 'case:'), lower(t.scope)))) > 0
  OR (f.detector_id = t.det AND regexp_matches(t.scope, 'entity:|category:|period:'))))""")
cte("hits", "SELECT DISTINCT entity_id, alert_id FROM alerts LEFT JOIN cases USING (alert_id) WHERE k % 40 = 0 OR (case_id IS NOT NULL AND k % 90 = 7)")
cte("by_hand", """
SELECT 'stratified' AS baseline, entity_id, alert_id, row_number() OVER (PARTITION BY entity_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_us, alert_id) AS position FROM alerts
UNION ALL SELECT 'checklist', entity_id, alert_id, row_number() OVER (PARTITION BY entity_id ORDER BY
  CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN ch AND dur < 600 THEN 4 ELSE 0 END + CASE WHEN ch AND has_case AND NOT escalated THEN 3 ELSE 0 END + CASE WHEN NOT has_case THEN 3 ELSE 0 END
  + CASE WHEN ch AND disposition = 'false_positive' AND dur < 1800 THEN 2 ELSE 0 END DESC, alert_id) FROM af""")
cte("dirty", """
SELECT k AS row_pos, CASE WHEN k % 101 = 0 THEN NULL WHEN k % 103 = 0 THEN ' ' WHEN k % 50 = 1 THEN 'O' || (k % 500) ELSE alert_id END AS alert_id,
  CASE WHEN k % 89 = 0 THEN 'N999' ELSE entity_id END AS entity_id, CASE WHEN k % 97 = 0 THEN 'urgent' ELSE severity END AS severity,
  CASE WHEN k % 107 = 0 THEN NULL ELSE created_us END AS c_us, CASE WHEN k % 109 = 0 THEN created_us - 86400000000 ELSE ack_us END AS a_us, CASE WHEN k % 113 = 0 THEN created_us ELSE closed_us END AS z_us FROM alerts""")
cte("judged", """
SELECT *, CASE WHEN alert_id IS NULL OR trim(alert_id) = '' THEN 'Missing primary key alert_id'
  WHEN row_number() OVER (PARTITION BY alert_id, CASE WHEN alert_id IS NULL OR trim(alert_id) = '' THEN row_pos END ORDER BY row_pos) > 1 THEN 'Duplicate primary key alert_id'
  WHEN c_us IS NULL THEN 'Unparseable timestamp in column ''created_ts''' WHEN c_us > a_us THEN 'Timestamp ordering violation: created_ts > ack_ts' WHEN a_us > z_us THEN 'Timestamp ordering violation: ack_ts > closed_ts'
  WHEN severity = 'urgent' THEN 'Invalid severity tier' END AS quarantine_reason FROM dirty""")
cte("ri_a", "SELECT * FROM alerts WHERE entity_id NOT IN ('N3', 'N7')")
cte("ri_c", "SELECT c.* FROM cases c WHERE EXISTS (SELECT 1 FROM ri_a a WHERE a.alert_id = c.alert_id)")
cte("orphaned", """
SELECT 'alerts' AS table_name, alert_id AS record_id, 'Referential integrity: entity_id not in entities' AS quarantine_reason FROM alerts WHERE entity_id IN ('N3', 'N7')
UNION ALL SELECT 'cases', case_id, 'Referential integrity: alert_id not in alerts' FROM cases c WHERE NOT EXISTS (SELECT 1 FROM ri_a a WHERE a.alert_id = c.alert_id)""")
cte("sliced", "SELECT *, (('0x' || substr(md5('42:' || k), 1, 8))::BIGINT % 100)::INT AS s FROM alerts")
cte("spoilt", """
SELECT k + CASE WHEN s = 5 THEN 1099511627776 ELSE 0 END AS row_pos, s, CASE WHEN s = 5 THEN coalesce(f.a, alert_id) ELSE alert_id END AS alert_id, CASE WHEN s = 4 THEN 'GHOST' ELSE entity_id END AS entity_id,
  created_us, CASE WHEN s = 2 THEN NULL WHEN s = 3 THEN created_us - 2700000000 ELSE ack_us END AS a_us, closed_us, CASE WHEN s = 0 THEN 'p1-urgent' WHEN s = 1 THEN '' ELSE severity END AS severity
FROM sliced LEFT JOIN (SELECT entity_id, min_by(alert_id, k) AS a FROM sliced WHERE s > 5 GROUP BY 1) f USING (entity_id)""")
cte("spoilt_judged", """
SELECT s, ['bad_severity', 'missing_severity', 'bad_timestamp', 'reversed_timestamp', 'ghost_entity', 'duplicate_pk'][s + 1] AS corruption, CASE WHEN row_number() OVER (PARTITION BY alert_id ORDER BY row_pos) > 1 THEN 'duplicate_pk' WHEN a_us IS NULL THEN 'bad_timestamp' WHEN created_us > a_us THEN 'reversed_timestamp' WHEN a_us > closed_us THEN 'late'
  WHEN severity NOT IN ('critical', 'high', 'medium', 'low') THEN 'severity' WHEN entity_id NOT IN (SELECT entity_id FROM entities) THEN 'ghost_entity' END AS reason FROM spoilt""")
cte("steadier", """
SELECT entity_id, round_even(greatest(least(sum(weight * round_even(100 * (1 - exp(-coalesce(s, 0) / 45)), 2)), 100), 0), 2) AS r FROM entities CROSS JOIN weights
LEFT JOIN (SELECT entity_id, area, sum(score) AS s FROM findings JOIN area_map USING (detector_id) WHERE detector_id <> 'EG-08' GROUP BY ALL) USING (entity_id, area) GROUP BY 1""")
cte("tidied", """
SELECT 'EG-03' AS detector_id, count(*) FILTER (wf_n = 0 AND before) AS before, count(*) FILTER (wf_n + 1 = 0 AND before) AS after FROM (
  SELECT *, wf_n = 0 AND dur >= 60 AND row_number() OVER (PARTITION BY has_case AND wf_n = 0 AND dur >= 60 ORDER BY asset_id, category, created_us, alert_id) <= 15 AS before FROM af WHERE entity_id = 'N5' AND has_case)
UNION ALL SELECT 'NS-01', count(*), count(*) FROM asf WHERE entity_id = 'N5' AND criticality = 'critical' AND monitoring_expected AND is_silent
UNION ALL SELECT 'NS-03', least(count(*), 1), least(count(*), 1) FROM af WHERE entity_id = 'N5' AND ch AND NOT has_case""")
cte("at_share", """
SELECT share, round_even(count(m.finding_id) / count(*)::DOUBLE, 6) AS precision
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, finding_id) AS rank FROM findings) f JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id)
JOIN (SELECT DISTINCT entity_id FROM truth) USING (entity_id) CROSS JOIN (SELECT unnest([5e-2, 0.1, 0.2]::DOUBLE[]) AS share) LEFT JOIN matched m USING (finding_id) WHERE rank <= greatest(5, round_even(n * share, 0)) GROUP BY share""")
cte("manual_at", """
SELECT baseline, share, round_even(count(h.alert_id) / count(*)::DOUBLE, 6) AS precision
FROM by_hand b JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id) CROSS JOIN (SELECT unnest([5e-2, 0.1, 0.2]::DOUBLE[]) AS share) LEFT JOIN hits h USING (entity_id, alert_id)
WHERE position <= greatest(5, round_even(n * share, 0)) GROUP BY ALL""")
cte("suites", """
SELECT unnest(['full', CASE WHEN detector_id IN ('EG-03', 'EG-05', 'NS-01', 'NS-03', 'NS-05') THEN 'rules' ELSE 'statistics' END]) AS suite, * FROM findings""")
cte("nov", "SELECT * FROM months")

FEATURES = ("monthly_volume", "crit_volume", "crit_median_close_sec", "ch_esc_rate", "unworked_ratio", "sla_window_ratio", "fp_rate", "unique_assets_alerted")


def _scaled(f: str) -> str:
    q = lambda p: f"(SELECT quantile_cont({f}::DOUBLE, {p}) FROM nov)"
    return f"({f} - {q(0.5)}) / CASE WHEN {q(0.75)} - {q(0.25)} = 0 THEN 1 ELSE {q(0.75)} - {q(0.25)} END"


cte("pts", "SELECT entity_id, year_month, " + ", ".join(f"{_scaled(f)} AS {f}" for f in FEATURES) + " FROM nov")
cte("lp", "SELECT entity_id || '/' || year_month AS a, * FROM pts")
cte("near", "SELECT * FROM (SELECT x.a, y.a AS b, sqrt(" + " + ".join(f"(x.{f} - y.{f}) * (x.{f} - y.{f})" for f in FEATURES) + ") AS d FROM lp x JOIN lp y ON x.a <> y.a) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5")
cte("kd", "SELECT a AS b, max(d) AS kd FROM near GROUP BY 1")
cte("lrd", "SELECT a, 1.0 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd USING (b) GROUP BY 1")


# The isolation forest a level at a time, as the operator grows it.
_TREES, _SUBSAMPLE, _LEVELS = 100, 256, 8
_MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
cte("fx", "SELECT a, [" + ", ".join(f"round({f}, 9)" for f in FEATURES) + "] AS x, count(*) OVER () AS rows FROM lp")
cte("fm0", f"SELECT tree, 1::BIGINT AS node, a, x FROM fx, (SELECT unnest(range({_TREES})) AS tree) WHERE {_MD5.format("'row:' || tree || ':' || a")} < CASE WHEN rows > {_SUBSAMPLE} THEN ({_SUBSAMPLE} * 4294967296) // rows ELSE 4294967296 END")
for _i in range(_LEVELS + 1):
    _bounds = ", ".join("[" + ", ".join(f"{f}(x[{j}]) OVER w" for j in range(1, len(FEATURES) + 1)) + f"] AS {n}" for f, n in (("min", "lo"), ("max", "hi")))
    cte(f"fo{_i}", f"SELECT *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: hi[i] > lo[i]) AS open FROM (SELECT *, count(*) OVER w AS size, {_bounds} FROM fm{_i} WINDOW w AS (PARTITION BY tree, node))")
    cte(f"ff{_i}", f"SELECT *, CASE WHEN size > 1 AND len(open) > 0 AND {_i} < least({_LEVELS}, ceil(log2(greatest((SELECT count(*) FROM lp), 2)))) THEN open[{_MD5.format("'feature:' || tree || ':' || node")} % len(open) + 1] END AS f FROM fo{_i}")
    cte(f"fc{_i}", f"SELECT *, lo[f] + {_MD5.format("'cut:' || tree || ':' || node")} / 4294967296.0::DOUBLE * (hi[f] - lo[f]) AS cut FROM ff{_i}")
    cte(f"fm{_i + 1}", f"SELECT tree, node * 2 + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END AS node, a, x FROM fc{_i} WHERE f IS NOT NULL")
cte("fsplits", " UNION ALL ".join(f"SELECT DISTINCT tree, node, f, cut, size, {i} AS depth FROM fc{i}" for i in range(_LEVELS + 1)))
cte("fw0", f"SELECT a, x, tree, 1::BIGINT AS node FROM fx, (SELECT unnest(range({_TREES})) AS tree)")
for _i in range(_LEVELS):
    cte(f"fw{_i + 1}", f"SELECT a, x, tree, CASE WHEN f IS NULL THEN node ELSE node * 2 + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END END AS node FROM fw{_i} JOIN fsplits USING (tree, node)")
_rest = "CASE WHEN {0} <= 1 THEN 0 WHEN {0} = 2 THEN 1 ELSE 2 * (ln({0} - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * ({0} - 1) / {0} END"
cte("fscore", f"SELECT a, -pow(2.0::DOUBLE, -(sum(depth + {_rest.format('size')}) / {_TREES}) / (SELECT {_rest.format('n')} FROM (SELECT least(count(*), {_SUBSAMPLE}) AS n FROM lp))) AS forest_score FROM fw{_LEVELS} JOIN fsplits USING (tree, node) GROUP BY a")
cte("flof", "SELECT a, around / lrd AS lof FROM lrd JOIN (SELECT n.a, avg(l.lrd) AS around FROM near n JOIN lrd l ON l.a = n.b GROUP BY 1) USING (a)")
cte("novel", """
SELECT *, forest_score < quantile_cont(forest_score, 0.08) OVER () OR coalesce(lof > quantile_cont(lof, 0.92) OVER (), false) AS hit FROM (
  SELECT lp.entity_id, lp.year_month, forest_score, lof, list_transform(list_slice(list_sort([""" + ", ".join(f"{{'s': -abs(round({f}, 9)), 'f': '{f}'}}" for f in FEATURES) + """]), 1, 2), lambda d: d.f) AS drivers
  FROM lp JOIN fscore USING (a) LEFT JOIN flof USING (a))""")
cte("f_nov01", """
SELECT 'unusual month: ' || array_to_string(drivers, ', ') AS reason_text, '' AS params, 'FND-NOV-01-' || left(sha256('NOV-01:' || entity_id || ':' || year_month), 12) AS finding_id, 'NOV-01' AS detector_id, 'NOVEL' AS category, entity_id, 'period:' || year_month AS scope,
  3.5 AS sev, round_even(forest_score, 3) AS dev, 0.98 AS pct, 0.82 AS conf, []::VARCHAR[] AS refs FROM novel WHERE hit AND (SELECT count(*) FROM lp) >= 8""")

def needs(sql: str, own: str = "", ctes: dict[str, str] = CTES) -> str:
    """``sql`` with the CTEs that it names, in order of definition."""
    used, todo = set(), [sql + own]
    while todo:
        text = todo.pop()
        for name in ctes:
            if name not in used and re.search(rf"(?<![\w.']){name}(?![\w'(])", text):
                used.add(name)
                todo.append(ctes[name])
    parts = [f"{n} AS ({ctes[n]})" for n in ctes if n in used] + ([own.strip()] if own else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


PLAIN: dict[str, str] = {
    "scan_store_counts": "SELECT 'alerts' AS table_name, count(*) AS rows FROM alerts UNION ALL SELECT 'cases', count(*) FROM cases UNION ALL SELECT 'workflow_events', count(*) FROM wf UNION ALL SELECT 'escalations', count(*) FROM esc UNION ALL SELECT 'assets', count(*) FROM assets UNION ALL SELECT 'entities', count(*) FROM entities",
    "sql_sev_disp": "SELECT severity, disposition, count(*) AS n FROM alerts GROUP BY ALL",
    "sql_crit_mttc": "SELECT entity_id, round(median((closed_us - ack_us) / 6e7), 6) AS minutes FROM alerts WHERE severity = 'critical' GROUP BY 1",
    "sql_top_assets": "SELECT asset_id, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, asset_id LIMIT 10",
    "sql_grouping_sets": "SELECT entity_id, severity, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((entity_id, severity), (severity), ())",
    "infer_entities": "SELECT entity_id, 'financial' AS sector, 'Tier-1' AS size_band, 'in-house' AS soc_model FROM (SELECT entity_id FROM alerts UNION SELECT entity_id FROM assets)",
    "legacy_adapt": "SELECT alert_id, entity_id, severity, category, strftime(make_timestamp(created_us), '%Y-%m-%d %H:%M:%S') AS created_ts, 'CASE-' || alert_id AS case_id, CASE WHEN disposition = 'true_positive' THEN 'resolved' ELSE 'standard' END AS closure_code, category AS notes_text, CASE WHEN severity = 'critical' THEN 'escalated' END AS outcome FROM alerts",
    "quarantine_reason": "SELECT row_pos, alert_id, quarantine_reason FROM judged",
    "quarantine_counts": "SELECT quarantine_reason, count(*) AS n FROM judged GROUP BY 1",
    "dedup_pk": "SELECT alert_id, entity_id, severity FROM judged WHERE quarantine_reason IS NULL",
    "ri_alerts": "SELECT 'alerts' AS table_name, 'Referential integrity: entity_id not in entities' AS quarantine_reason, count(*) AS n FROM alerts WHERE entity_id IN ('N3', 'N7')",
    "ri_cases": "SELECT 'cases' AS table_name, 'Referential integrity: alert_id not in alerts' AS quarantine_reason, count(*) AS n FROM cases c WHERE NOT EXISTS (SELECT 1 FROM ri_a a WHERE a.alert_id = c.alert_id)",
    "ri_workflow": "SELECT 'workflow_events' AS table_name, 'Referential integrity: case_id not in cases' AS quarantine_reason, count(*) AS n FROM wf w WHERE NOT EXISTS (SELECT 1 FROM ri_c c WHERE c.case_id = w.case_id)",
    "ri_escalations": "SELECT 'escalations' AS table_name, 'Referential integrity: case_id not in cases' AS quarantine_reason, count(*) AS n FROM esc w WHERE NOT EXISTS (SELECT 1 FROM ri_c c WHERE c.case_id = w.case_id)",
    "alert_durations": "SELECT alert_id, (ack_us - created_us) / 1e6 AS ack_latency_sec, (closed_us - ack_us) / 1e6 AS closure_duration_sec, round((closed_us - ack_us) / 6e7, 6) AS closure_duration_min, (closed_us - created_us) / 1e6 AS total_lifecycle_sec, minute(make_timestamp(closed_us)) AS closed_minute, hour(make_timestamp(closed_us)) AS closed_hour, isodow(make_timestamp(closed_us)) - 1 AS closed_dayofweek FROM alerts",
    "sla_window": "SELECT entity_id, count(*) FILTER (in_sla) AS in_window, count(*) AS n FROM af GROUP BY 1",
    "repeat_7d": "SELECT alert_id, round(days_since_prev, 6) AS days_since_prev, repeat7 AS is_repeat_7d FROM af",
    "repeat_running": "SELECT alert_id, sum(repeat7::INT) OVER (PARTITION BY entity_id, asset_id, category ORDER BY created_us, alert_id)::BIGINT AS repeat_streak_7d FROM af",
    "case_link": "SELECT alert_id, case_id, has_case, analyst_id, closure_code, notes_text FROM af",
    "workflow_count": "SELECT alert_id, wf_n AS workflow_event_count FROM af",
    "escalated_flag": "SELECT entity_id, severity, count(*) FILTER (escalated) AS escalated, count(*) AS n FROM af GROUP BY ALL",
    "asset_features": "SELECT asset_id, entity_id, total_alerts, critical_alerts, high_alerts, is_silent, is_silent AND criticality = 'critical' AS is_critical_silent FROM asf",
    "entity_features": """
SELECT e.entity_id, sector, size_band, total_alerts, total_assets, round(total_alerts / greatest(total_assets, 1)::DOUBLE, 6) AS alerts_per_asset, """ + _r("crit_median_close_sec", "crit_p5_close_sec", "high_median_close_sec", "crit_esc_rate", "high_esc_rate", "crithigh_esc_rate", "unworked_ratio") + """,
  round(g.gini, 6) AS analyst_gini, round(top1 / chn::DOUBLE, 6) AS top1_analyst_share, round(sla, 6) AS sla_bunching_ratio, round(t.bits, 6) AS closure_code_entropy, round(n.bits, 6) AS notes_entropy, 0.0::DOUBLE AS template_ratio,
  silent_crit_assets, round(active / total_assets::DOUBLE, 6) AS coverage_ratio, round(CASE WHEN crit > 0 THEN least((crit - silent_crit_assets) / crit::DOUBLE, mon / crit::DOUBLE) ELSE 1 END, 6) AS crit_coverage_ratio, coalesce(gap, 0) AS max_consecutive_zero_days
FROM entities e
JOIN (SELECT entity_id, count(*) AS total_alerts, median(dur) FILTER (severity = 'critical') AS crit_median_close_sec, quantile_cont(dur, 5e-2) FILTER (severity = 'critical') AS crit_p5_close_sec, median(dur) FILTER (severity = 'high') AS high_median_close_sec,
  avg(escalated::INT) FILTER (severity = 'critical') AS crit_esc_rate, avg(escalated::INT) FILTER (severity = 'high') AS high_esc_rate, avg(escalated::INT) FILTER (ch) AS crithigh_esc_rate, avg((wf_n = 0)::INT) AS unworked_ratio, avg(in_sla::INT) AS sla, count(*) FILTER (ch) AS chn FROM af GROUP BY 1) a USING (entity_id)
JOIN (SELECT entity_id, count(*) AS total_assets, count(*) FILTER (criticality = 'critical') AS crit, count(*) FILTER (criticality = 'critical' AND monitoring_expected) AS mon, count(*) FILTER (criticality = 'critical' AND monitoring_expected AND is_silent) AS silent_crit_assets, count(*) FILTER (NOT is_silent) AS active FROM asf GROUP BY 1) s USING (entity_id)
LEFT JOIN gini_t g USING (entity_id) LEFT JOIN (SELECT entity_id, max(n) AS top1 FROM ac GROUP BY 1) USING (entity_id) LEFT JOIN entropy_t t USING (entity_id) LEFT JOIN notes_t n USING (entity_id) LEFT JOIN (SELECT entity_id, max(days) AS gap FROM gaps GROUP BY 1) USING (entity_id)""",
    "entity_month": "SELECT entity_id, year_month, monthly_volume, crit_volume, unique_assets_alerted, " + _r("crit_median_close_sec", "ch_esc_rate", "unworked_ratio", "sla_window_ratio", "fp_rate") + " FROM months",
    "daily_gaps": "SELECT entity_id, strftime(start, '%Y-%m-%d') AS start, strftime(\"end\", '%Y-%m-%d') AS \"end\", days FROM gaps",
    "closure_entropy": "SELECT entity_id, round(bits, 6) AS bits FROM entropy_t",
    "analyst_gini": "SELECT entity_id, round(gini, 6) AS gini FROM gini_t",
    "template_ratio": "SELECT entity_id, round(avg(contains(notes_text, 'ch')::INT), 6) AS ratio FROM ec GROUP BY 1",
    "category_pivot": "SELECT entity_id, " + ", ".join(f"count(*) FILTER (category = 'CAT{i}') AS CAT{i}" for i in range(6)) + " FROM alerts GROUP BY 1",
    "system_of_tiers": "SELECT criticality, monitoring_expected, count(*) AS n FROM assets GROUP BY ALL",
    "cohort_levels": "SELECT entity_id, cohort_level, cohort_key, cohort_size FROM co",
    "poisson_tail": "SELECT entity_id, severity, n, round(list_sum(list_transform(range(0, n + 1), lambda i: exp(-1.1 * n + i * ln(1.1 * n) - lgamma(i + 1)))), 6) AS p FROM (SELECT entity_id, severity, count(*) AS n FROM alerts GROUP BY ALL)",
    "spearman_rank": "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT entity_id, count(*) AS x, count(*) FILTER (severity = 'critical') AS y FROM alerts GROUP BY 1))",
    "eg03": "SELECT entity_id, alert_id, case_id, dur AS closure_duration_sec, r AS ordinal, r <= 15 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY asset_id, category, created_us, alert_id) AS r FROM af WHERE has_case AND wf_n = 0 AND dur >= 60)",
    "eg05": "SELECT entity_id, asset_id, category, count(*) AS repeats, count(*) >= 3 AS hit FROM af WHERE repeat7 GROUP BY ALL",
    "eg08": "SELECT entity_id, months, alerts, " + _r("cusum", "first_rate", "last_rate") + ", cusum >= 4 AS hit FROM drift WHERE alerts >= 50 AND months >= 3",
    "ns01": "SELECT entity_id, asset_id, true AS hit FROM asf WHERE criticality = 'critical' AND monitoring_expected AND is_silent",
    "ns02": """
SELECT entity_id, category, n, round(mu, 6) AS mu, round(p, 6) AS p, p <= 0.01 OR (n = 0 AND mu >= 8) AS hit FROM (
  SELECT *, least(1, list_sum(list_transform(range(0, n + 1), lambda i: exp(-mu + i * ln(mu) - lgamma(i + 1))))) AS p FROM (
    SELECT o.entity_id, m.category, coalesce(x.n, 0) AS n, m.n / t.n::DOUBLE * o.n AS mu FROM (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) o
    JOIN (SELECT p.entity_id, category, count(*) AS n FROM pairs p JOIN alerts a ON a.entity_id = p.peer GROUP BY ALL) m USING (entity_id)
    JOIN (SELECT p.entity_id, count(*) AS n FROM pairs p JOIN alerts a ON a.entity_id = p.peer GROUP BY ALL) t USING (entity_id)
    LEFT JOIN (SELECT entity_id, category, count(*) AS n FROM alerts GROUP BY ALL) x ON x.entity_id = o.entity_id AND x.category = m.category
    WHERE o.n >= 30 AND t.n >= 100 AND m.n / t.n::DOUBLE >= 5e-2))""",
    "ns03": "SELECT entity_id, count(*) AS orphans, true AS hit FROM af WHERE ch AND NOT has_case GROUP BY 1",
    "ns05": "SELECT entity_id, strftime(start, '%Y-%m-%d') AS start, days, days >= 3 AS hit FROM gaps JOIN (SELECT entity_id, max(make_timestamp(created_us)::DATE) - min(make_timestamp(created_us)::DATE) + 1 AS span FROM alerts GROUP BY 1) USING (entity_id) WHERE span >= 14",
    "nov01_scaled": "SELECT entity_id, year_month, " + _r(*FEATURES) + " FROM pts",
    "nov01_iforest": "SELECT split_part(a, '/', 1) AS entity_id, split_part(a, '/', 2) AS year_month, round(forest_score, 6) AS forest_score FROM fscore",
    "nov01_months": "SELECT entity_id, year_month, round(forest_score, 6) AS forest_score, round(log10(lof), 5) AS log_lof, array_to_string(list_sort(drivers), ',') AS drivers, hit FROM novel",
    "all_findings": "SELECT detector_id, count(*) AS findings FROM (SELECT detector_id FROM findings UNION ALL SELECT detector_id FROM f_nov01) GROUP BY 1",
    "nov01_lof": "SELECT split_part(a, '/', 1) AS entity_id, split_part(a, '/', 2) AS year_month, round(log10(around / lrd), 5) AS log_lof FROM lrd JOIN (SELECT n.a, avg(l.lrd) AS around FROM near n JOIN lrd l ON l.a = n.b GROUP BY 1) USING (a)",
    "finding_ids": "SELECT finding_id, detector_id, entity_id, scope FROM findings",
    "finding_score": "SELECT finding_id, round(score, 6) AS score FROM findings",
    "area_scores": "SELECT entity_id, area, score, findings, top_detectors FROM areas",
    "risk_index": "SELECT entity_id, risk_index FROM risk",
    "risk_tier": "SELECT risk_tier, count(*) AS entities FROM risk GROUP BY 1",
    "qoq_trend": """
SELECT entity_id, e AS early_index, l AS late_index, CASE WHEN l - e > 15 THEN 'deteriorating' WHEN l - e < -15 THEN 'improving' ELSE 'stable' END AS trend FROM (
  SELECT entity_id, round_even(100 * (1 - exp(-coalesce(sum(score) FILTER (early), 0) / 45)), 2) AS e, round_even(100 * (1 - exp(-coalesce(sum(score) FILTER (late), 0) / 45)), 2) AS l
  FROM (SELECT DISTINCT entity_id FROM alerts) LEFT JOIN (
    SELECT r.entity_id, finding_id, max(score) AS score, bool_or(created_us <= mid) AS early, bool_or(created_us > mid) AS late FROM (SELECT entity_id, finding_id, score, split_part(unnest(refs), ':', -1) AS alert_id FROM findings) r
    JOIN alerts a USING (entity_id, alert_id) JOIN (SELECT entity_id, min(created_us) + (max(created_us) - min(created_us)) // 2 AS mid FROM alerts GROUP BY 1) m ON m.entity_id = r.entity_id GROUP BY ALL) USING (entity_id) GROUP BY 1)""",
    "top_concern": "SELECT entity_id, area, score FROM areas QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, area) = 1",
    "queue_risk": "SELECT entity_id, rank, finding_id FROM picked",
    "queue_control": "SELECT entity_id, alert_id, pick FROM control",
    "queue_full": "SELECT entity_id, rank, 'QI-' || entity_id || '-' || lpad(rank::VARCHAR, 3, '0') AS item_id, bucket, scope, split_part(scope, ':', 1) AS target_type FROM (SELECT entity_id, rank, 'risk' AS bucket, scope FROM picked UNION ALL SELECT entity_id, taken + pick, 'control', 'alert:' || alert_id FROM control)",
    "claim_evidence": "SELECT entity_id, " + _r("mttc_min", "coverage_pct", "fp_rate_pct", "escalation_pct") + " FROM evidence",
    "claim_compare": "SELECT entity_id, metric, round(claimed, 3) AS claimed, round(observed, 3) AS observed, round(exaggeration, 3) AS exaggeration, round(credibility, 3) AS credibility FROM compared",
    "claim_index": "SELECT entity_id, idx AS credibility_index, exaggerated, substantiated, claims, verdict FROM verdicts",
    "claim_summary": "SELECT count(*) AS entities, round_even(avg(idx), 1) AS mean_index, sum(exaggerated)::BIGINT AS exaggerated_claims, count(*) FILTER (verdict = 'substantiated') AS substantiated_entities, count(*) FILTER (verdict = 'partially substantiated') AS partially_substantiated_entities, count(*) FILTER (verdict = 'not substantiated') AS not_substantiated_entities FROM verdicts",
    "feedback_weights": "SELECT entity_id, detector_id, round(factor, 4) AS factor, version FROM fw",
    "feedback_apply": "SELECT entity_id, detector_id, count(*) FILTER (coalesce(factor, 1) <> 1) AS weighed, count(*) AS n FROM findings LEFT JOIN fw USING (entity_id, detector_id) GROUP BY ALL",
    "feedback_latest": "SELECT finding_id, feedback_id, decision FROM ledger QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY feedback_id DESC) = 1",
    "feedback_history": "SELECT feedback_id, detector_id, decision FROM ledger WHERE entity_id = 'N3' ORDER BY feedback_id DESC LIMIT 50",
    "expert_agreement": """
SELECT f.entity_id, count(*) AS findings, count(decision) AS reviewed, count(*) FILTER (decision = 'confirm') AS confirmed, round_even(count(*) FILTER (decision = 'confirm') / nullif(count(decision), 0)::DOUBLE, 4) AS confirm_rate, round_even(count(decision) / count(*)::DOUBLE, 4) AS coverage,
  round_even(avg(conf) FILTER (decision = 'confirm'), 4) AS confidence_confirmed, round_even(avg(conf) FILTER (decision = 'dismiss'), 4) AS confidence_dismissed
FROM (SELECT 'FND-' || o_orderkey AS finding_id, 'N' || (o_orderkey % 25) AS entity_id, o_orderkey % 5 / 8::DOUBLE AS conf FROM orders) f
LEFT JOIN (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY feedback_id DESC) = 1) l USING (finding_id) GROUP BY 1""",
    "chain_verify": """
SELECT entry_id, prev_hash = coalesce(lag(entry_hash) OVER (ORDER BY entry_id), repeat('0', 64)) AS link_ok, entry_hash = sha256(concat_ws('|', entry_id, timestamp, event_type, run_id, data_hash, prev_hash)) AS hash_ok FROM chain""",
    "match_findings": "SELECT finding_id AS item_id, detector_id FROM matched",
    "precision_at_k": """
SELECT share, count(*) AS items, count(m.finding_id) AS true_positives, round(count(m.finding_id) / count(*)::DOUBLE, 6) AS precision, round(count(m.finding_id) / max(total)::DOUBLE, 6) AS recall
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, finding_id) AS rank FROM findings) f JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id)
JOIN (SELECT DISTINCT entity_id FROM truth) USING (entity_id) CROSS JOIN (SELECT unnest([5e-2, 0.1, 0.2]::DOUBLE[]) AS share) CROSS JOIN (SELECT count(*) AS total FROM truth) LEFT JOIN matched m USING (finding_id)
WHERE rank <= greatest(5, round_even(n * share, 0)) GROUP BY share""",
    "case_hits": "SELECT entity_id, alert_id FROM hits",
    "manual_baselines": """
SELECT baseline, share, count(*) AS items, count(h.alert_id) AS true_positives, round_even(count(h.alert_id) / count(*)::DOUBLE, 6) AS precision
FROM by_hand b JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id) CROSS JOIN (SELECT unnest([5e-2, 0.1, 0.2]::DOUBLE[]) AS share) LEFT JOIN hits h USING (entity_id, alert_id)
WHERE position <= greatest(5, round_even(n * share, 0)) GROUP BY ALL""",
    "uniform_baseline": "SELECT entity_id, alert_id FROM alerts QUALIFY (row_number() OVER (PARTITION BY entity_id ORDER BY created_us, alert_id) - 1) % 20 = 0",
    "random_baseline": "SELECT entity_id, count(*) AS alerts, count(*) FILTER (k % 40 = 0) AS hits, round(count(*) FILTER (k % 40 = 0) / count(*)::DOUBLE, 6) AS expected_precision FROM alerts GROUP BY 1",
    "stratified_order": "SELECT entity_id, alert_id, row_number() OVER (PARTITION BY entity_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, created_us, alert_id) AS position FROM alerts",
    "checklist_score": """
SELECT entity_id, alert_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, alert_id) AS position FROM (SELECT entity_id, alert_id,
  (CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN ch AND dur < 600 THEN 4 ELSE 0 END + CASE WHEN ch AND has_case AND NOT escalated THEN 3 ELSE 0 END + CASE WHEN NOT has_case THEN 3 ELSE 0 END
  + CASE WHEN ch AND disposition = 'false_positive' AND dur < 1800 THEN 2 ELSE 0 END)::DOUBLE AS score FROM af)""",
    "ablation": "SELECT 'full' AS suite, count(*) AS findings FROM findings UNION ALL SELECT CASE WHEN detector_id IN ('EG-03', 'EG-05', 'NS-01', 'NS-03', 'NS-05') THEN 'rules' ELSE 'statistics' END, count(*) FROM findings GROUP BY 1",
    "fault_intensity": "SELECT entity_id, sum(w)::DOUBLE AS intensity FROM truth GROUP BY 1",
    "most_faulty": "SELECT entity_id, count(*) AS faults FROM truth GROUP BY 1 ORDER BY faults DESC, entity_id LIMIT 1",
    "sparse_cohorts": "SELECT entity_id, CASE WHEN nb >= 3 THEN 'primary' WHEN ns >= 3 THEN 'sector_fallback' ELSE 'global_fallback' END AS cohort_level, CASE WHEN nb >= 3 THEN nb WHEN ns >= 3 THEN ns ELSE nt END AS cohort_size FROM (SELECT *, count(*) OVER (PARTITION BY sector, size_band) AS nb, count(*) OVER (PARTITION BY sector) AS ns, count(*) OVER () AS nt FROM (SELECT * FROM entities QUALIFY (row_number() OVER (PARTITION BY sector ORDER BY entity_id) - 1) % 3 = 0))",
    "entity_list": "SELECT * FROM risk ORDER BY risk_index DESC, entity_id LIMIT 10",
    "findings_filtered": "SELECT finding_id, scope FROM findings WHERE entity_id = 'N4' AND detector_id = 'EG-03'",
    "area_averages": "SELECT area, round(round_even(avg(score), 2), 1) AS mean_score FROM areas GROUP BY 1",
    "coverage_heatmap": "SELECT criticality, CASE WHEN NOT monitoring_expected THEN 'Unmonitored' WHEN is_silent THEN 'Silent' ELSE 'Normal' END AS status, count(*) AS assets FROM asf GROUP BY ALL",
    "priority_findings": "SELECT entity_id, finding_id, detector_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, finding_id) AS rn FROM findings) WHERE rn <= 3 ORDER BY rn, score DESC, finding_id LIMIT 25",
    "concept_share": "SELECT category, count(*) AS findings, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS share FROM findings GROUP BY 1",
    "top_findings": "SELECT finding_id, entity_id, detector_id, scope FROM findings ORDER BY score DESC, finding_id LIMIT 25",
    "top_detectors": "SELECT detector_id, count(*) AS findings FROM findings GROUP BY 1 ORDER BY findings DESC, detector_id LIMIT 15",
    "capability_profile": "SELECT entity_id, area, round(score, 2) AS score, round(m, 2) AS median_score, round(score - m, 2) AS gap FROM areas JOIN (SELECT area, median(score) AS m FROM areas GROUP BY 1) USING (area)",
    "sql_quarantine_sample": "SELECT * FROM orphaned ORDER BY table_name, record_id LIMIT 50",
    "store_roundtrip": "SELECT 'alerts' AS table_name, count(*) AS rows FROM alerts UNION ALL SELECT 'cases', count(*) FROM cases UNION ALL SELECT 'workflow_events', count(*) FROM wf UNION ALL SELECT 'escalations', count(*) FROM esc UNION ALL SELECT 'assets', count(*) FROM assets UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'quarantine', 0 UNION ALL SELECT 'severity ' || severity, count(*) FROM alerts GROUP BY severity",
    "csv_source": "SELECT coalesce(quarantine_reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "json_source": "SELECT coalesce(quarantine_reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "spearman_p": """
SELECT round(rho, 6) AS rho, n, round(1 - 2 * list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * i / 4000, 2) / (n - 2), -(n - 1) / 2.0))) * t / 12000 * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()), 6) AS p
FROM (SELECT *, abs(rho) * sqrt((n - 2) / (1 - rho * rho)) AS t FROM (SELECT corr(rx, ry) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
  FROM (SELECT entity_id, count(*) AS x, avg((severity = 'critical')::INT) AS y FROM alerts GROUP BY 1))))""",
    "queue_decisions": """
SELECT entity_id, rank, bucket, scope, CASE WHEN t < '4' THEN 'dismiss' WHEN t < '8' THEN CASE WHEN finding_id[-2] < '8' THEN 'confirm' ELSE 'dismiss' END END AS decision, CASE WHEN t < '4' THEN 2 WHEN t < '8' THEN 1 END::BIGINT AS decided_by
FROM (SELECT entity_id, rank, 'risk' AS bucket, scope, finding_id, finding_id[-1] AS t FROM picked UNION ALL SELECT entity_id, taken + pick, 'control', 'alert:' || alert_id, NULL, NULL FROM control)""",
    "lift_over_manual": "SELECT a.share, a.precision, baseline, m.precision AS baseline_precision, round(coalesce(a.precision / nullif(m.precision, 0), 1), 4) AS lift FROM at_share a JOIN manual_at m ON a.share = m.share",
    "ablation_precision": """
SELECT suite, count(*) AS findings, count(*) FILTER (inside) AS items, count(*) FILTER (inside AND hit) AS true_positives, round_even(count(*) FILTER (inside AND hit) / nullif(count(*) FILTER (inside), 0)::DOUBLE, 6) AS precision, round_even(count(*) FILTER (inside AND hit) / max(total)::DOUBLE, 6) AS recall
FROM (SELECT suite, m.finding_id IS NOT NULL AS hit, row_number() OVER (PARTITION BY suite, entity_id ORDER BY score DESC, s.finding_id) <= greatest(5, round_even(n * 0.1::DOUBLE, 0)) AS inside
  FROM suites s JOIN (SELECT entity_id, count(*) AS n FROM alerts GROUP BY 1) USING (entity_id) JOIN (SELECT DISTINCT entity_id FROM truth) USING (entity_id) LEFT JOIN matched m ON m.finding_id = s.finding_id) CROSS JOIN (SELECT count(*) AS total FROM truth) GROUP BY suite""",
    "messy_catch_rate": "SELECT corruption, count(*) AS injected, count(*) FILTER (reason = CASE WHEN s < 2 THEN 'severity' ELSE corruption END) AS caught, round(count(*) FILTER (reason = CASE WHEN s < 2 THEN 'severity' ELSE corruption END) / count(*)::DOUBLE, 6) AS rate FROM spoilt_judged WHERE s < 6 GROUP BY 1",
    "rank_stability": "SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT risk_index AS x, r AS y FROM risk JOIN steadier USING (entity_id)))",
    "lane_survival": "SELECT *, round(after / before::DOUBLE, 6) AS survival FROM tidied WHERE before > 0",
    "indicators": "SELECT count(*) AS findings, count(*) FILTER (pct >= 0.9) AS extreme, count(*) FILTER (sev >= 5) AS severe, (SELECT count(*) FROM risk WHERE risk_tier IN ('high', 'critical')) AS risky_entities FROM findings",
}

RELATIVE: dict[str, tuple[str, str]] = {
    "peer_robust_z": (_VOLUME, "SELECT entity_id, value, round(median, 6) AS median, round(mad, 6) AS mad, round(z, 6) AS z FROM peer"),
    "peer_pct_rank": (_VOLUME, "SELECT entity_id, cohort_level, peers, round(percentile, 6) AS percentile FROM peer"),
    "volume_ratio": (_ALERTS_PER_ASSET, "SELECT entity_id, round(value, 6) AS value, round(median, 6) AS median, round(CASE WHEN median > 0 THEN value / median ELSE 1 END, 6) AS ratio FROM peer"),
    "eg02": ("SELECT entity_id, avg(escalated::INT) AS value FROM af WHERE ch GROUP BY 1 HAVING count(*) >= 5", f"SELECT {PEER}, z <= -2 AS hit FROM peer"),
    "eg06": ("SELECT entity_id, avg(in_sla::INT) AS value FROM af GROUP BY 1", f"SELECT {PEER}, z >= 2.5 AND value >= 0.15 AS hit FROM peer"),
    "eg07": (_SHARES, f"SELECT {PEER}, (SELECT analyst_id FROM v WHERE v.entity_id = peer.entity_id) AS analyst_id, value >= 0.5 AND z >= 1.8 AS hit FROM peer"),
    "ns04": (_ALERTS_PER_ASSET, f"SELECT {PEER}, (CASE WHEN median > 0 THEN value / median ELSE 1 END <= 0.45 OR z <= -1.5) AND median > 0 AS hit FROM peer"),
    "ns06": (_COVERAGE, f"SELECT {PEER}, z <= -1.8 AND value <= 0.7 AS hit FROM peer"),
    "peer_percentile": ("SELECT entity_id, risk_index AS value FROM risk", "SELECT entity_id, round(round_even(percentile, 4), 6) AS peer_percentile, (SELECT count(*) FROM findings f WHERE f.entity_id = peer.entity_id) AS finding_count FROM peer"),
}

ORACLE_SQL: dict[str, str] = {n: needs(sql) for n, sql in PLAIN.items()}
ORACLE_SQL |= {n: needs(sql, peers(values)) for n, (values, sql) in RELATIVE.items()}
ORACLE_SQL |= {f"findings_{n[2:]}": needs(f"SELECT finding_id, entity_id, scope, category, sev::DOUBLE AS severity_weight, round(dev, 3) AS deviation, round(pct, 4) AS peer_percentile, conf::DOUBLE AS confidence, array_to_string(list_sort(refs), ',') AS refs FROM {n}") for n in FOUND}
ORACLE_SQL["trend_distribution"] = needs(f"SELECT trend, count(*) AS entities FROM ({PLAIN['qoq_trend']}) GROUP BY 1")
ORACLE_SQL["findings_by_detector"] = needs("SELECT detector_id, count(*) AS findings FROM findings GROUP BY 1")
ORACLE_SQL["eg01"] = needs("SELECT entity_id, alert_id, severity, dur, " + _r("p5", "median", "z", "percentile") + ", dur > 0 AND (dur <= p5 OR z <= -2.5 OR percentile <= 5e-2) AS hit FROM done", _EG01)
ORACLE_SQL["eg04"] = needs("SELECT entity_id, cases, notes, " + _r("share", "similarity", "entropy") + ", share >= 0.35 AND similarity >= 0.9 AND entropy <= 1 AS hit FROM done", _NOTES)
