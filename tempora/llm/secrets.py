"""Secret scans over an incremental ledger of content-addressed blobs, with built-in functions only.

A version is a path (any key columns) with a text at some time. Texts are addressed by
their SHA-256; the ledger has one row for each pair of a blob and a rule's version that was
ever scanned, with the spans found. A scan takes the distinct blobs of the given versions,
drops the pairs that the ledger has, scans the rest once, appends it, and joins all findings
back to every path. A rule's version is a digest of its definition, so a changed rule is
scanned again and the others aren't.

Defined results: a null text is the empty blob; repeated rows and equal texts share a scan
and each get the findings; an empty table gives no row; other columns of the versions are
carried along unread, but those that are named like a column of the result give way to it. A
ledger that holds a pair twice, as after an append that was repeated, counts it once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import fresh, quoted, shared_dir, table, written


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of pattern that don't overlap, of which those stay whose group has `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.kind, self.pattern, self.group, self.least)).encode()).hexdigest()[:16]


def either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


#: Fixed values. The lengths of hex and access runs are in their patterns: such runs can't be
#: entered in the middle by another match, so this drops what a test afterwards would.
RULES = (
    Rule("assign", "(" + either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)

SPAN = "struct<start: int, no: int, end: int>"
#: Blobs with findings that may go to every task, and the spans that they may have in all.
BROADCAST_BLOBS, BROADCAST_SPANS = 50_000, 200_000
LEDGER = f"blob string, rule string, rule_version string, spans array<{SPAN}>"


def scanned_spans(text: str, rule: Rule, no: int) -> Column:
    """Spans (start, no, end) of a rule's matches, in code points: the pieces between matches tell their places."""
    pattern = F.lit(rule.pattern)
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(held: Column, match: Column) -> Column:
        begin = held["at"] + match["gap"]
        end = begin + match["size"]
        one = F.array(F.struct(begin.alias("start"), F.lit(no).alias("no"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(match["value"] >= rule.least, F.concat(held["found"], one)).otherwise(held["found"]).alias("found"))

    matches = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("size"), value.alias("value"))
    return F.when(F.rlike(F.col(text), pattern), F.aggregate(matches, start, step, lambda held: held["found"])).otherwise(none)


def addressed(versions: DataFrame, into: str = "blob") -> DataFrame:
    return versions.withColumn(into, F.sha2(F.coalesce("text", F.lit("")), 256))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """Distinct blobs with their text and, for each rule, whether this pair was never scanned."""
    blobs = addressed(versions.select("text")).groupBy("blob").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    if ledger is None:
        return blobs.select("blob", "text", *[F.lit(True).alias(f"new_{k}") for k in range(len(rules))])
    known = ledger.groupBy("blob").agg(*[F.max(F.col("rule_version") == r.version).alias(f"has_{k}") for k, r in enumerate(rules)])
    new = [(~F.coalesce(F.col(f"has_{k}"), F.lit(False))).alias(f"new_{k}") for k in range(len(rules))]
    some = " or ".join(f"new_{k}" for k in range(len(rules)))
    return blobs.join(known, "blob", "left").select("blob", "text", *new).where(some)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: the unseen pairs of blob and rule version, with their spans."""
    blobs = unseen(versions, ledger, rules)
    per = [F.when(F.col(f"new_{k}"), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"), scanned_spans("text", r, k).alias("spans"))) for k, r in enumerate(rules)]
    rows = blobs.select("blob", F.explode(F.array(*per)).alias("s")).where("s is not null")
    return rows.select("blob", "s.rule", "s.rule_version", "s.spans")


def update(spark: SparkSession, versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scans what the ledger at `path` has not, appends it there, and returns the whole ledger."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(path)
        ledger.limit(1).count()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None
    scan(versions, ledger, rules).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every version's columns but its text, with its blob and the `spans` of all rules by start, then rule."""
    spark = versions.sparkSession
    current = ledger.where(F.col("rule_version").isin([r.version for r in rules]) & (F.size("spans") > 0))
    once = current.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))
    by_blob = written(spark, once.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).toDF("of", "found"), "by_blob")
    # the few blobs with findings go to every task; many are joined by two plain exchanges, of which the planner can split a hot blob
    rows, spans = by_blob.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
    by_blob = F.broadcast(by_blob) if rows <= BROADCAST_BLOBS and spans <= BROADCAST_SPANS else by_blob
    kept = [c for c in versions.columns if c.lower() not in ("text", "blob", "spans")]
    of, found = fresh(kept, "of"), fresh(kept, "found")
    keys = addressed(versions.select("text", *quoted(kept))).drop("text").join(by_blob.toDF(of, found), F.col("blob") == F.col(of), "left")
    return keys.select(*quoted(kept), "blob", F.coalesce(F.col(found), F.array().cast(f"array<{SPAN}>")).alias("spans"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a ledger of its own in the shared folder, in which no pair is known before: every blob is scanned."""
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(versions, update(spark, versions, f"{shared_dir(spark)}/ledger"))
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    written = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kinds, s["no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = [F.expr(f"cast(size(filter(spans, s -> s.no = {k})) as bigint)").alias(f"n_{r.kind}") for k, r in enumerate(RULES)]
    return found.select("doc_id", *n, F.sha2(written, 256).alias("base_sha256"), written.alias("spans"))


def _sql() -> str:
    parts = []
    for no, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT r, {no} AS no, '{r.kind}' AS kind, (list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0))::BIGINT AS s, (list_sum(g[1:i]) + list_sum(m[1:i]))::BIGINT AS e, v[i] AS v
FROM (SELECT r, list_transform(string_split_regex(t, '{p}'), lambda x: length(x)) AS g, list_transform(regexp_extract_all(t, '{p}'), lambda x: length(x)) AS m,
list_transform(regexp_extract_all(t, '{p}', {r.group}), lambda x: length(x)) AS v, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i FROM d) WHERE v[i] >= {r.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES)
    cols = ", ".join(f"coalesce(a.n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM f GROUP BY r)
SELECT d.doc_id, {cols}, sha256(coalesce(a.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans FROM d LEFT JOIN a ON d.r = a.r
"""


OP2_SQL = _sql()
