"""Issue rows: severities, filters, overrides, groups, rankings and the decision at the end of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities, most severe first.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: The number of an issue's severity as text, from 0.
LEVELS = ("info", "warning", "error", "critical")


def rank(severity: Column) -> Column:
    """0 for the most severe; unknown and null severities come last. Case does not count."""
    known = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.lower(severity))
    return F.when(known > 0, known - 1).otherwise(F.lit(len(SEVERITIES))).cast("int")


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Issues delivered twice count once."""
    return issues.dropDuplicates(["issue_id"])


def at_least(issues: DataFrame, level: int) -> DataFrame:
    """Issues of a severity number or above; files that keep none disappear with them."""
    return issues.filter(F.col("severity") >= level)


def rules_at_or_above(rules: DataFrame, severity: str) -> DataFrame:
    return rules.filter(rank(F.col("severity")) <= SEVERITIES.index(severity))


def rules_for(rules: DataFrame, framework: str) -> DataFrame:
    """Rules that name the framework; rules that name none hold nowhere."""
    return rules.filter(F.array_contains("frameworks", framework))


def configured(rules: DataFrame, by_rule: DataFrame, by_category: DataFrame) -> DataFrame:
    """Rules with their settings: the rule's own entry wins over its category's; disabled rules are left out.

    Both settings tables have enabled and severity beside their key (rule_id, category); a null leaves the value as it is.
    """
    r = by_rule.select("rule_id", F.col("enabled").alias("_e1"), F.col("severity").alias("_s1"), F.lit(True).alias("_own"))
    c = by_category.select("category", F.col("enabled").alias("_e2"), F.col("severity").alias("_s2"))
    out = rules.join(r, "rule_id", "left").join(c, "category", "left")
    own = F.col("_own").isNotNull()
    enabled = F.when(own, F.coalesce("_e1", F.lit(True))).otherwise(F.coalesce("_e2", F.lit(True)))
    severity = F.when(own, F.coalesce("_s1", "severity")).otherwise(F.coalesce("_s2", "severity"))
    return out.withColumn("severity", severity).filter(enabled).select(*rules.columns)


def suppressions(files: DataFrame, marker: str) -> DataFrame:
    """(file_id, line_no, rule_id) that comments ``// <marker>-line a, b`` and ``// <marker>-next-line a, b`` switch off."""
    line = files.select("file_id", F.posexplode(F.split("source_code", "\n")).alias("_no", "_line")).filter(F.col("_line").contains(marker))
    found = line.select("file_id", (F.col("_no") + 1).alias("_no"), F.regexp_extract("_line", rf"//\s*{marker}(-next)?-line\s+([\w\-,/\s]+)", 1).alias("_next"), F.regexp_extract("_line", rf"//\s*{marker}(-next)?-line\s+([\w\-,/\s]+)", 2).alias("_rules"))
    found = found.filter("_rules <> ''").select("file_id", (F.col("_no") + F.when(F.col("_next") == "-next", 1).otherwise(0)).alias("line_no"), F.explode(F.split("_rules", ",")).alias("rule_id"))
    return found.select("file_id", "line_no", F.trim("rule_id").alias("rule_id")).distinct()


def unsuppressed(issues: DataFrame, off: DataFrame) -> DataFrame:
    """Issues whose line has neither their rule nor ``all`` switched off; issues without place or rule stay."""
    line = F.col("loc.start_line")
    hit = (issues["file_id"] == off["file_id"]) & (line == off["line_no"]) & ((issues["rule_id"] == off["rule_id"]) | (off["rule_id"] == "all"))
    return issues.join(off, hit, "left_anti")


def counts(issues: DataFrame, *keys: str) -> DataFrame:
    """Total, per severity, and fixable issues; over everything if no keys are given, zeros over no rows."""
    per = [F.count_if(F.col("severity") == n).alias(name) for n, name in enumerate(LEVELS)]
    return issues.groupBy(*keys).agg(F.count("*").alias("total"), *per, F.count_if(F.col("fixable")).alias("fixable"))


def grouped_rules(rules: DataFrame, column: str, buckets: tuple[str, ...]) -> DataFrame:
    """Rules per bucket, empty buckets too: bucket, rules, ids in order."""
    names = rules.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    per = rules.groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("rules"), F.array_join(F.array_sort(F.collect_list("rule_id")), ",").alias("ids"))
    return names.join(per, "bucket", "left").select("bucket", F.coalesce("rules", F.lit(0)).alias("rules"), F.coalesce("ids", F.lit("")).alias("ids"))


def merged_sightings(infos: DataFrame, *keys: str) -> DataFrame:
    """Per key: sightings, occurrences, first and last time (swapped ones the right way round), first known place."""
    first, last = F.least("first_detected", "last_detected"), F.greatest("first_detected", "last_detected")
    return infos.groupBy(*keys).agg(
        F.count("*").alias("sightings"),
        F.sum(F.coalesce("occurrence_count", F.lit(1))).alias("occurrences"),
        F.min(first).alias("first_seen"),
        F.max(last).alias("last_seen"),
        F.min_by("loc.file_path", F.when(F.col("loc.file_path").isNotNull(), F.col("info_id"))).alias("file_path"),
    )


def mode(table: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, n): the most frequent value of a key; of equally frequent ones the one that came first. Nulls don't count."""
    n = table.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = n.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_b"))
    return best.select(key, F.col(f"_b.{value}").alias(value), F.col("_b.n").alias("n"))


def ranked(issues: DataFrame, limit: int) -> DataFrame:
    """The printed table: files by their worst severity, then id; issues by severity, then id; at most ``limit`` in all.

    Only the limit's rows are ever sorted whole: a top-k over the issues with their file's worst severity.
    """
    worst = issues.groupBy("file_id").agg(F.max("severity").alias("worst"))
    return issues.join(worst, "file_id").orderBy(F.desc("worst"), "file_id", F.desc("severity"), "issue_id").limit(limit)


def top_files(issues: DataFrame, limit: int) -> DataFrame:
    """Files by their number of issues, then by id."""
    return issues.filter("file_id is not null").groupBy("file_id").agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "file_id").limit(limit)


def exit_code(issues: DataFrame, fail_on: int = 3, warn_on: int = 2) -> DataFrame:
    """One row: 2 if an issue reaches ``fail_on``, 1 if one reaches ``warn_on``, else 0."""
    worst = F.coalesce(F.max("severity"), F.lit(-1))
    return issues.agg(F.when(worst >= fail_on, 2).when(worst >= warn_on, 1).otherwise(0).alias("exit_code"))


def best_fix(issues: DataFrame, templates: DataFrame) -> DataFrame:
    """Issues with the first template that supports their rule; templates has template_id, priority, supported (rule ids)."""
    each = templates.select("template_id", "priority", F.explode("supported").alias("rule_id"))
    first = each.groupBy("rule_id").agg(F.min_by("template_id", F.struct("priority", "template_id")).alias("template_id"))
    return issues.join(first, "rule_id")


def suggestion_by_prefix(rules: DataFrame, templates: DataFrame) -> DataFrame:
    """The template whose prefix of the rule's id is longest, by an equi-join on the id's folders instead of a nested loop."""
    parts = F.split("rule_id", "/")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    per = rules.select("rule_id", prefix.alias("prefix")).join(templates, "prefix")
    return per.groupBy("rule_id").agg(F.max_by("suggestion", F.length("prefix")).alias("suggestion"))


def scheduled(rules: DataFrame) -> DataFrame:
    """Rules in the order in which they run: severity, then id; place counts from 1 within the severity, which is the partition."""
    place = F.row_number().over(Window.partitionBy("severity").orderBy("rule_id"))
    return rules.select("rule_id", "severity", rank(F.col("severity")).alias("priority"), place.alias("place"))
