"""Secrets by strict patterns and by linking the parts of credentials, in DataFrame functions only (operator 8).

Strict matches (assign, access, hex) are always reported.  Besides, weak parts are located: names of accesses
(``user = ...``), weak secrets (``pwd: ...``, or an assignment whose value is too short to count) and endpoints (URLs,
``host = ...``).  A weak access or secret is reported only if a complementary part lies within ``SCOPE`` code points
of it in the same text, counted from the end of the one to the start of the other: an access needs a secret, a secret
needs an access or an endpoint.  The link is an interval join on (text, bin of the place), where every part lies in all
bins from its start to its end and each weak part also looks ``SCOPE`` to either side; it is a semi join, so a part is
found once however many parts surround it.  ``LEAST`` characters make a part of each role.

Defined results: null text is the empty text and has no spans; a weak part that overlaps a strict span is not reported
again; repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.  Texts
are searched whole: the work grows with the length of a text and the number of its matches, neither of which is limited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrygrid.llm.common import id_text, materialize, row_key
from sentrygrid.llm.spans import apart, labelled, located, matches, nothing

# The strict patterns (letters of the first in either case), in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
}
ASSIGN_LENGTH = 12
#: Characters that the value of a weak part needs.
LEAST = {"access": 4, "secret": 6, "endpoint": 3}
_SET = r"[\"']?\x20*+[:=]\x20*+[\"']?"
#: Weak parts by role.
WEAK = {
    "access": rf"(?i)(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|access_?key|key_?id|user_?name|user|login|account){_SET}[A-Za-z0-9._@+-]{{{LEAST['access']},}}+",
    "secret": rf"(?i)(?<![A-Za-z0-9])(?:pass|pwd|passphrase|private_?key|credentials?|auth|signature){_SET}[^\s\"',;]{{{LEAST['secret']},}}+",
    "endpoint": rf"(?i)(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]++|(?<![A-Za-z0-9])(?:host|hostname|endpoint|server){_SET}[A-Za-z0-9.-]{{{LEAST['endpoint']},}}+",
}
#: Code points between complementary parts, at most.
SCOPE = 256


def _hints(text: Column) -> dict[str, Column]:
    """Cheap tests that spare most texts a pattern."""
    named = text.rlike("[:=]")
    return {"assign": named, "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{16}"), "weak": named}


def analyse(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """A written table of strict spans and parts by row; texts stay behind."""
    rows = id_text(docs, text).select(row_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", "text")
    t, hints = F.col("text"), _hints(F.col("text"))
    for k in KINDS:
        rows = rows.withColumn(f"m_{k}", F.when(hints[k], matches(t, PATTERNS[k])).otherwise(nothing("string")))
    rows = rows.withColumn("g_assign", F.when(F.size("m_assign") > 0, matches(t, PATTERNS["assign"], 2)).otherwise(nothing("string")))
    for role in WEAK:
        rows = rows.withColumn(f"w_{role}", F.when(hints["weak"], matches(t, WEAK[role])).otherwise(nothing("string")))
    for k in KINDS:
        rows = rows.withColumn(f"s_{k}", located(t, PATTERNS[k], F.col(f"m_{k}")))
    for role in WEAK:
        rows = rows.withColumn(f"p_{role}", located(t, WEAK[role], F.col(f"w_{role}")))
    sized = F.zip_with("s_assign", "g_assign", lambda s, g: F.struct(s["start"], s["end"], F.char_length(g).alias("n")))
    rows = rows.withColumn("sized", sized)
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["end"]))
    rows = rows.select("key", "doc_id", bare(F.filter("sized", lambda s: s["n"] >= ASSIGN_LENGTH)).alias("assign"), bare(F.col("s_access")).alias("access"), bare(F.col("s_hex")).alias("hex"), bare(F.filter("sized", lambda s: s["n"] < ASSIGN_LENGTH)).alias("short"), *[bare(F.col(f"p_{r}")).alias(f"p_{r}") for r in WEAK])
    return materialize(spark, rows, "secrets")


def link_weak(table: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, weak): the weak parts that a complementary part accompanies."""
    part = lambda spans, role, weak: F.transform(spans, lambda s: F.struct(F.lit(role).alias("role"), F.lit(weak).alias("weak"), s["start"].alias("start"), s["end"].alias("end")))
    own = F.concat(part(F.col("short"), "secret", True), part(F.col("p_access"), "access", True), part(F.col("p_secret"), "secret", True))
    rows = table.where((F.size("short") > 0) | (F.size("p_access") > 0) | (F.size("p_secret") > 0)).withColumn("strict", F.concat("assign", "access", "hex")).withColumn("own", own)
    exploded = rows.select("key", F.explode(apart(F.col("own"), F.col("strict"))).alias("p")).select("key", "p.*")
    others = rows.select("key", F.explode(F.concat(part(F.col("assign"), "secret", False), part(F.col("access"), "access", False), part(F.col("p_endpoint"), "endpoint", False), "own")).alias("p")).select("key", "p.*")
    bins = lambda first, last: F.sequence(F.floor(first / scope), F.floor(last / scope))
    weak = exploded.select("key", "role", "start", "end", F.explode(bins(F.col("start") - scope, F.col("end") + scope)).alias("bin"))
    right = others.select(F.col("key").alias("k2"), F.col("role").alias("role2"), F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode(bins(F.col("start"), F.col("end"))).alias("bin2"))
    near = F.greatest("start", "start2") - F.least("end", "end2") <= scope
    separate = (F.col("end") <= F.col("start2")) | (F.col("end2") <= F.col("start"))
    fits = ((F.col("role") == "access") & (F.col("role2") == "secret")) | ((F.col("role") == "secret") & F.col("role2").isin("access", "endpoint"))
    hits = weak.join(right, (F.col("key") == F.col("k2")) & (F.col("bin") == F.col("bin2")) & near & separate & fits, "left_semi")
    return hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "role"))).alias("weak"))


def find_secrets(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the strict spans by kind, and the linked weak parts (start, end, role)."""
    table = analyse(spark, docs, text)
    joined = table.join(link_weak(table), "key", "left")
    return joined.select("doc_id", *KINDS, F.coalesce("weak", nothing("struct<start:int,end:int,role:string>")).alias("weak"))


def digest_spans(spans: DataFrame) -> DataFrame:
    """Counts, the hash of the strict spans and all spans as text, ordered by start, then kind."""
    order = lambda k, i: F.transform(F.zip_with(F.col(k), labelled(F.col(k), k), lambda s, name: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), name.alias("name"))), lambda x: x)
    base = F.concat(*[order(k, i) for i, k in enumerate(KINDS)])
    weak = F.transform("weak", lambda s: F.struct(s["start"].alias("start"), F.when(s["role"] == "access", len(KINDS)).otherwise(len(KINDS) + 1).alias("rank"), s["end"].alias("end"), F.concat(F.lit("weak_"), s["role"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("name")))
    names = lambda x: F.array_join(F.transform(F.sort_array(x), lambda s: s["name"]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(names(base), 256).alias("base_sha256"), names(F.concat(base, weak)).alias("spans"))
