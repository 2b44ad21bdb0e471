"""Queries of the core operators, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions.lineage import cut
from granary.operators import assets, caches, changes, graphs, issues, measures, nodes, rules
from granary.operators.spikes import implausible_readings, series_health

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return issues.distinct_issues(_read(spark, d, "issues"))


_RANK = "case lower(severity) when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 when 'info' then 4 else 5 end"
_D = "(select distinct * from issues)"

def _cents(spark: SparkSession, d: str) -> DataFrame:
    """Events with the value in whole cents, whose sums are exact in any order."""
    return _read(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


# metrics


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: metric_id of every reading that jumps, freezes or takes an impossible value."""
    return implausible_readings(_read(spark, d, "metrics")).select("metric_id").distinct()


@query()
def p5_health(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: readings and flagged ones per metric."""
    m = _read(spark, d, "metrics")
    return series_health(implausible_readings(m), m)


@query("select source, metric_name, arg_max(metric_value, (ts, metric_id)) metric_value, count(*) readings from (select distinct * from metrics) where metric_value is not null group by 1, 2")
def agg23_gauge_latest(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: last value of every series."""
    return measures.latest(measures.distinct_readings(_read(spark, d, "metrics")))


@query(
    """select source, metric_name, round(sum(rise), 4) rise, count(*) filter (where metric_value < p) restarts from (
      select source, metric_name, metric_value, p, case when p is null then 0 when metric_value < p then metric_value else metric_value - p end rise from (
        select *, lag(metric_value) over (partition by source, metric_name order by ts, metric_id) p from (select distinct * from metrics) where metric_value is not null and metric_type = 'counter')) group by 1, 2"""
)
def agg23_counter_increase(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23, WIN-6: rise of counters over restarts."""
    m = measures.distinct_readings(_read(spark, d, "metrics")).filter("metric_type = 'counter'")
    return measures.increases(m).withColumn("rise", F.round("rise", 4))


@query("select metric_name, cast(floor(metric_value / 10) as bigint) bucket, count(*) readings from (select distinct * from metrics) where metric_value is not null group by 1, 2")
def agg23_histogram(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: readings per bucket."""
    return measures.histogram(measures.distinct_readings(_read(spark, d, "metrics")), 10.0)


@query("select metric_id, metric_name, metric_value, case when metric_value >= 90 then 'critical' else 'warning' end as level from (select distinct * from metrics) where metric_name = 'cpu_percent' and metric_value >= 70")
def sta6_cpu_alerts(spark: SparkSession, d: str) -> DataFrame:
    """STA-6: processor alerts at 70 and 90 percent."""
    m = measures.distinct_readings(_read(spark, d, "metrics")).filter("metric_name = 'cpu_percent'")
    return measures.alerts(m, "metric_value", 70, 90).select("metric_id", "metric_name", "metric_value", "level")


@query("select metric_id, metric_value, case when metric_value >= 1000 then 'critical' else 'warning' end as level from (select distinct * from metrics) where metric_name = 'heap_used_mb' and metric_value >= 500")
def sta6_heap_alerts(spark: SparkSession, d: str) -> DataFrame:
    """STA-6: memory alerts at 500 and 1000 MB."""
    m = measures.distinct_readings(_read(spark, d, "metrics")).filter("metric_name = 'heap_used_mb'")
    return measures.alerts(m, "metric_value", 500, 1000).select("metric_id", "metric_value", "level")


@query("select source, metric_name, metric_id from (select *, row_number() over (partition by source, metric_name order by ts desc, metric_id desc) rn from (select distinct * from metrics)) where rn <= 100")
def win3_last_100(spark: SparkSession, d: str) -> DataFrame:
    """WIN-3: the last 100 readings of each series."""
    m = measures.distinct_readings(_read(spark, d, "metrics"))
    return measures.last_n(m, ["source", "metric_name"], [F.desc("ts"), F.desc("metric_id")], 100).select("source", "metric_name", "metric_id")


@query(
    "select event_id, avg(cents) over w mean, max(cents) over w most, count(cents) over w n from (select *, cast(round(value * 100) as bigint) cents from events) window w as (partition by user_id order by ts, event_id rows between 99 preceding and current row)"
)
def win4_rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    """WIN-4: mean of the last 100 events of a user."""
    return measures.rolling(_cents(spark, d), ["user_id"], ["ts", "event_id"], "cents", 100).select("event_id", "mean", "most", "n")


@query("select event_id, cast(sum(cents) over w as bigint) total, avg(cents) over w mean, max(cents) over w most from (select *, cast(round(value * 100) as bigint) cents from events) window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def win5_running(spark: SparkSession, d: str) -> DataFrame:
    """WIN-5, WIN-6: running sum, mean and greatest per user."""
    return measures.running(_cents(spark, d), ["user_id"], ["ts", "event_id"], "cents").select("event_id", "total", "mean", "most")


@query(
    "select event_id, round(value - p, 6) change, case when p <> 0 then round((value - p) / p * 100, 4) end change_pct from (select *, lag(value) over (partition by user_id order by ts, event_id) p from events)"
)
def win2_change(spark: SparkSession, d: str) -> DataFrame:
    """WIN-2, WIN-7, WIN-8, JOI-9: change against the value before."""
    return measures.changes_to_previous(_read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("change", 6).alias("change"), F.round("change_pct", 4).alias("change_pct"))


@query("select user_id, arg_min(event_type, (ts, event_id)) first_type, min(event_id) first_event, count(*) sightings from events group by 1")
def win9_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """WIN-9: first sighting of each key."""
    return _read(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("event_id").alias("first_event"), F.count("*").alias("sightings"))


_RENDER = "select user_id component, ts, event_id, case event_type when 'view' then 'update' when 'signup' then 'mount' else 'other' end phase, cast(round(value * 100) as bigint) took from events"


def _renders(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "view", "update").when(F.col("event_type") == "signup", "mount").otherwise("other")
    return _cents(spark, d).select(F.col("user_id").alias("component"), "ts", "event_id", phase.alias("phase"), F.col("cents").alias("took"))


@query(
    f"""select component, count(*) renders, avg(took) mean, max(took) most, arg_max(took, (ts, event_id)) "last", count(*) filter (where rn > 1 and phase = 'update' and took < 1600) needless
    from (select *, row_number() over (partition by component order by ts, event_id) rn from ({_RENDER}) where took is not null and took <> 0) group by 1"""
)
def agg7_render_stats(spark: SparkSession, d: str) -> DataFrame:
    """AGG-7: renders per component, those of exactly 16 ms and first ones never needless."""
    return measures.render_stats(_renders(spark, d), 1600)


@query("select count(*) total, count(distinct user_id) components, count(*) filter (where event_type = 'error') errors, count(*) filter (where event_type = 'view') views, count(*) filter (where value > 16) slow from events")
def agg8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-8, AGG-12: counters over all events; one row over none too."""
    return _read(spark, d, "events").agg(F.count("*").alias("total"), F.countDistinct("user_id").alias("components"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("value") > 16).alias("slow"))


@query("select user_id, event_type, count(*) calls from events group by 1, 2")
def agg11_usage(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11, AGG-20, AGG-27: calls per component and kind."""
    return _read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("calls"))


@query(
    """select event_id, user_id, length from (select *, count(*) over (partition by user_id, run) length from (
      select *, sum(fresh) over (partition by user_id order by ts, event_id) run from (
        select *, case when p is null or epoch_us(ts) - epoch_us(p) > 600000000 then 1 else 0 end fresh, case when f is null or epoch_us(f) - epoch_us(ts) > 600000000 then 1 else 0 end fin from (
          select *, lag(ts) over w p, lead(ts) over w f from events window w as (partition by user_id order by ts, event_id))))) where fin = 1"""
)
def sta4_debounced(spark: SparkSession, d: str) -> DataFrame:
    """STA-4: the last event of every burst."""
    return measures.bursts(_read(spark, d, "events"), ["user_id"], 600.0).select("event_id", "user_id", "length")


@query("select user_id, count(*) events, arg_max(event_id, (ts, event_id)) last_event from events group by 1 having max(ts) >= (select max(ts) from events) - interval 24 hour")
def sta2_fresh_state(spark: SparkSession, d: str) -> DataFrame:
    """STA-1, STA-2: state per key that is not older than 24 hours at the end of the data."""
    e = _read(spark, d, "events")
    state = e.groupBy("user_id").agg(F.count("*").alias("events"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"), F.max("ts").alias("last_ts"))
    end = e.agg(F.max("ts")).first()[0]
    return measures.fresh(state, "last_ts", F.lit(end), 24).select("user_id", "events", "last_event")


# issues


@query(f"select file_id, count(*) kept, max(severity) worst from {_D} where severity >= 2 group by 1")
def fil1_min_severity(spark: SparkSession, d: str) -> DataFrame:
    """FIL-1, AGG-5, AGG-17: issues of severity 2 and above per file; files without any are gone."""
    return issues.at_least(_issues(spark, d), 2).groupBy("file_id").agg(F.count("*").alias("kept"), F.max("severity").alias("worst"))


@query(f"select rule_id, severity from scan_rules where {_RANK} <= 1")
def fil2_rules_at_or_above(spark: SparkSession, d: str) -> DataFrame:
    """FIL-2: rules of severity high and above."""
    return issues.rules_at_or_above(_read(spark, d, "scan_rules"), "high").select("rule_id", "severity")


@query("select rule_id from scan_rules where list_contains(frameworks, 'react')")
def fil3_rules_by_framework(spark: SparkSession, d: str) -> DataFrame:
    """FIL-3: rules for one framework."""
    return issues.rules_for(_read(spark, d, "scan_rules"), "react").select("rule_id")


@query("select rule_id, category, severity from scan_rules where category = 'security' and severity = 'high'")
def fil4_rules_by_category(spark: SparkSession, d: str) -> DataFrame:
    """FIL-4: rules of a category and an exact severity."""
    return _read(spark, d, "scan_rules").filter("category = 'security' and severity = 'high'").select("rule_id", "category", "severity")


@query(
    """with o as (select rule_id, row_number() over (order by rule_id) n from scan_rules),
    r as (select rule_id, case when n % 5 = 0 then false end enabled, case when n % 3 = 0 then 'critical' end severity from o where n % 3 = 0 or n % 5 = 0),
    c(category, enabled, severity) as (values ('performance', false, null), ('memory', null, 'low'))
    select s.rule_id, s.category, case when r.rule_id is not null then coalesce(r.severity, s.severity) else coalesce(c.severity, s.severity) end severity
    from scan_rules s left join r using (rule_id) left join c on s.category = c.category
    where case when r.rule_id is not null then coalesce(r.enabled, true) else coalesce(c.enabled, true) end"""
)
def fil5_configured_rules(spark: SparkSession, d: str) -> DataFrame:
    """FIL-5, JOI-10: settings per rule before settings per category."""
    from pyspark.sql import Window

    s = _read(spark, d, "scan_rules")
    n = F.row_number().over(Window.orderBy("rule_id"))  # rules are a table of fixed size
    by_rule = s.select("rule_id", n.alias("n")).filter("n % 3 = 0 or n % 5 = 0").select("rule_id", F.when(F.col("n") % 5 == 0, F.lit(False)).alias("enabled"), F.when(F.col("n") % 3 == 0, F.lit("critical")).alias("severity"))
    by_category = spark.createDataFrame([("performance", False, None), ("memory", None, "low")], "category string, enabled boolean, severity string")
    return issues.configured(s, by_rule, by_category).select("rule_id", "category", "severity")


@query("select file_id, file_path from source_files where not (file_path like '%node_modules%' or file_path like '%/dist/%' or regexp_matches(file_path, '^.*\\.test\\..*$'))")
def fil7_excluded_paths(spark: SparkSession, d: str) -> DataFrame:
    """FIL-7, SRC-1: files no pattern excludes."""
    return _read(spark, d, "source_files").filter(~T.excluded(F.col("file_path"), ["node_modules", "/dist/", "*.test.*"])).select("file_id", "file_path")


@query("select file_id from source_files where regexp_matches(file_path, '\\.(js|jsx|ts|tsx|vue|svelte)$')")
def src2_files_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """SRC-1, SRC-2: files of the known extensions."""
    return _read(spark, d, "source_files").filter(T.extension(F.col("file_path")).isin(".js", ".jsx", ".ts", ".tsx", ".vue", ".svelte")).select("file_id")


@query("select file_id from source_files where contains(source_code, 'http://') and not contains(source_code, 'http://localhost')")
def fil10_insecure_requests(spark: SparkSession, d: str) -> DataFrame:
    """FIL-9, FIL-10: files with plain addresses other than the local one."""
    return _read(spark, d, "source_files").filter(F.col("source_code").contains("http://") & ~F.col("source_code").contains("http://localhost")).select("file_id")


@query(
    """select file_id from source_files where regexp_matches(source_code, '(?i)<script\\b[^>]*>(.*?)</script>') or regexp_matches(source_code, '(?i)javascript\\s*:')
    or regexp_matches(source_code, '(?i)on\\w+\\s*=\\s*["'']?[^"'']*["'']?') or regexp_matches(source_code, '(?i)eval\\s*\\(') or regexp_matches(source_code, '(?i)expression\\s*\\(')"""
)
def fil11_xss_content(spark: SparkSession, d: str) -> DataFrame:
    """FIL-11: markup that runs code."""
    f = _read(spark, d, "source_files")
    return f.filter(rules.matches(*rules.XSS_PATTERNS)(F.col("source_code"))).select("file_id")


@query(
    """select file_id from source_files where regexp_matches(source_code, '(?i)password|passwd|token|api[-_]?key|secret|credential') or regexp_matches(source_code, '\\d{13,16}')
    or regexp_matches(source_code, '\\b[\\w.%+-]+@[\\w.-]+\\.[a-zA-Z]{2,}\\b')"""
)
def fil12_sensitive_content(spark: SparkSession, d: str) -> DataFrame:
    """FIL-12: words and numbers of secrets and persons."""
    f = _read(spark, d, "source_files")
    return f.filter(rules.matches(*rules.SENSITIVE_PATTERNS)(F.col("source_code"))).select("file_id")


@query("select info_id from issue_infos where not (component like '%View%' or component like '%List%')")
def fil13_ignored_components(spark: SparkSession, d: str) -> DataFrame:
    """FIL-13, FIL-17: components that no pattern ignores; null components are neither."""
    c = F.col("component")
    return _read(spark, d, "issue_infos").filter(~(c.contains("View") | c.contains("List"))).select("info_id")


@query(f"select issue_id, file_id from {_D} where fixable")
def fil18_fixable(spark: SparkSession, d: str) -> DataFrame:
    """FIL-18: fixable issues, flat."""
    return _issues(spark, d).filter("fixable").select("issue_id", "file_id")


@query(
    """select file_id, api, severity from source_files, (values ('eval', 'critical'), ('document.write', 'high'), ('innerHTML', 'high'), ('localStorage.setItem', 'medium'), ('sessionStorage.setItem', 'medium'),
    ('fetch', 'medium'), ('XMLHttpRequest.open', 'medium'), ('setTimeout', 'medium'), ('setInterval', 'medium'), ('Function', 'critical')) t(api, severity) where contains(source_code, api)"""
)
def fil19_dangerous_apis(spark: SparkSession, d: str) -> DataFrame:
    """FIL-19: dangerous APIs that a file names, by one array of conditions and one explode."""
    hits = F.array_compact(F.array(*[F.when(F.col("source_code").contains(a), F.struct(F.lit(a).alias("api"), F.lit(s).alias("severity"))) for a, s in rules.DANGEROUS_APIS]))
    return _read(spark, d, "source_files").filter("source_code is not null").select("file_id", F.explode(hits).alias("h")).select("file_id", "h.*")


@query(f"select count(*) total, count(*) filter (where severity = 0) info, count(*) filter (where severity = 1) warning, count(*) filter (where severity = 2) error, count(*) filter (where severity = 3) critical, count(*) filter (where fixable) fixable from {_D}")
def agg1_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG-1: total and per severity."""
    return issues.counts(_issues(spark, d))


@query(f"select issue_type, count(*) total, count(*) filter (where severity = 0) info, count(*) filter (where severity = 1) warning, count(*) filter (where severity = 2) error, count(*) filter (where severity = 3) critical, count(*) filter (where fixable) fixable from {_D} group by 1")
def agg2_report_by_type(spark: SparkSession, d: str) -> DataFrame:
    """AGG-2, AGG-15, SNK-2: the report's summary by type."""
    return issues.counts(_issues(spark, d), "issue_type")


@query(
    """select b.bucket, coalesce(rules, 0) rules, coalesce(ids, '') ids from (values ('security'), ('performance'), ('memory'), ('react'), ('none')) b(bucket)
    left join (select category bucket, count(*) rules, string_agg(rule_id, ',' order by rule_id) ids from scan_rules group by 1) using (bucket)"""
)
def agg4_rules_by_category(spark: SparkSession, d: str) -> DataFrame:
    """AGG-4: rules per category, empty ones too."""
    return issues.grouped_rules(_read(spark, d, "scan_rules"), "category", ("security", "performance", "memory", "react", "none"))


@query(
    """select lower(component) component, issue_type, count(*) sightings, cast(sum(coalesce(occurrence_count, 1)) as bigint) occurrences, epoch_us(min(least(first_detected, last_detected))) first_us,
    epoch_us(max(greatest(first_detected, last_detected))) last_us, arg_min(loc.file_path, info_id) filter (where loc.file_path is not null) file_path from issue_infos where component is not null group by 1, 2"""
)
def agg6_sightings(spark: SparkSession, d: str) -> DataFrame:
    """AGG-6, STA-1: occurrences, first and last time per component and type."""
    i = _read(spark, d, "issue_infos").filter("component is not null").withColumn("component", F.lower("component"))
    m = issues.merged_sightings(i, "component", "issue_type")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return m.select("component", "issue_type", "sightings", "occurrences", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "file_path")


@query(
    """select file_id, rule_id, n from (select file_id, rule_id, count(*) n, min(issue_id) f, row_number() over (partition by file_id order by count(*) desc, min(issue_id)) rn
    from (select distinct * from issues) where file_id is not null and rule_id is not null group by 1, 2) where rn = 1"""
)
def agg16_mode_rule(spark: SparkSession, d: str) -> DataFrame:
    """AGG-16: the commonest rule of each file, of equals the first."""
    return issues.mode(_issues(spark, d).filter("file_id is not null"), "file_id", "rule_id", "issue_id")


@query(f"select file_id, string_agg(issue_type, ',' order by issue_type) types from (select distinct file_id, issue_type from {_D} where issue_type is not null and file_id is not null) group by 1")
def agg18_distinct_concat(spark: SparkSession, d: str) -> DataFrame:
    """AGG-18, SET-4: distinct types of a file as one text."""
    return _issues(spark, d).filter("issue_type is not null and file_id is not null").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("issue_type")), ",").alias("types"))


@query(f"select issue_id, file_id, severity, worst from (select i.*, max(severity) over (partition by file_id) worst from {_D} i where file_id is not null) order by worst desc, file_id, severity desc, issue_id limit 100")
def lim1_ranked_table(spark: SparkSession, d: str) -> DataFrame:
    """SRT-1, LIM-1, SNK-4: the printed table of 100 issues."""
    return issues.ranked(_issues(spark, d).filter("file_id is not null"), 100).select("issue_id", "file_id", "severity", "worst")


@query(f"select file_id, count(*) issues from {_D} where file_id is not null group by 1 order by 2 desc, 1 limit 10")
def top2_files(spark: SparkSession, d: str) -> DataFrame:
    """TOP-2: files with most issues."""
    return issues.top_files(_issues(spark, d), 10)


@query(f"select cast(case when coalesce(max(severity), -1) >= 3 then 2 when coalesce(max(severity), -1) >= 2 then 1 else 0 end as integer) exit_code from {_D}")
def snk10_exit_code(spark: SparkSession, d: str) -> DataFrame:
    """SNK-10: how a run ends."""
    return issues.exit_code(_issues(spark, d))


@query(f"select 'issues' origin, issue_id id, issue_type kind from {_D} union all select 'infos', info_id, issue_type from issue_infos")
def set1_union_all(spark: SparkSession, d: str) -> DataFrame:
    """SET-1: results one after the other."""
    a = _issues(spark, d).select(F.lit("issues").alias("origin"), F.col("issue_id").alias("id"), F.col("issue_type").alias("kind"))
    return a.union(_read(spark, d, "issue_infos").select(F.lit("infos"), "info_id", "issue_type"))


@query(f"select distinct rule_id from scan_rules where rule_id not in (select rule_id from {_D} where rule_id is not null)")
def set3_unused_rules(spark: SparkSession, d: str) -> DataFrame:
    """SET-3, JOI-11: rules without an issue."""
    return _read(spark, d, "scan_rules").select("rule_id").distinct().join(_issues(spark, d).select("rule_id"), "rule_id", "left_anti")


@query(f"select issue_id, s.rule_id, s.category, s.severity rule_severity from {_D} i join scan_rules s using (rule_id)")
def joi_issue_rules(spark: SparkSession, d: str) -> DataFrame:
    """JOI-10, PRJ-6: issues with their rule."""
    return _issues(spark, d).join(_read(spark, d, "scan_rules").select("rule_id", "category", F.col("severity").alias("rule_severity")), "rule_id").select("issue_id", "rule_id", "category", "rule_severity")


_TEMPLATES = [("security", "escape the value"), ("security/xss", "use textContent"), ("memory", "clean up on unmount"), ("performance", "load it later")]


@query(
    """select rule_id, suggestion from (select rule_id, suggestion, row_number() over (partition by rule_id order by length(prefix) desc) rn from scan_rules,
    (values ('security', 'escape the value'), ('security/xss', 'use textContent'), ('memory', 'clean up on unmount'), ('performance', 'load it later')) t(prefix, suggestion) where rule_id = prefix or starts_with(rule_id, prefix || '/')) where rn = 1"""
)
def joi3_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """JOI-3, JOI-4, CLS-3, GRA-8: the suggestion whose prefix of the rule is longest."""
    return issues.suggestion_by_prefix(_read(spark, d, "scan_rules"), spark.createDataFrame(_TEMPLATES, "prefix string, suggestion string"))


@query(
    f"""select issue_id, template_id from (select issue_id, template_id, row_number() over (partition by issue_id order by priority, template_id) rn from {_D} i join
    (select category || '-fix' template_id, case category when 'security' then 1 else 2 end priority, rule_id from scan_rules) using (rule_id)) where rn = 1"""
)
def joi2_fix_templates(spark: SparkSession, d: str) -> DataFrame:
    """JOI-2: the first fix template that supports an issue's rule."""
    t = _read(spark, d, "scan_rules").groupBy(F.concat("category", F.lit("-fix")).alias("template_id"), F.when(F.col("category") == "security", 1).otherwise(2).alias("priority")).agg(F.collect_list("rule_id").alias("supported"))
    return issues.best_fix(_issues(spark, d), t).select("issue_id", "template_id")


@query(f"select rule_id, severity, cast({_RANK} as integer) priority, cast(row_number() over (partition by severity order by rule_id) as integer) place from scan_rules")
def win1_rule_order(spark: SparkSession, d: str) -> DataFrame:
    """WIN-1, SRT-5, TOP-7: the order in which rules run."""
    return issues.scheduled(_read(spark, d, "scan_rules"))


# texts

_LINE = "cast(length(substr(source_code, 1, {a} - 1)) - length(replace(substr(source_code, 1, {a} - 1), chr(10), '')) + 1 as integer)"
_COL = "cast({a} - length(substr(source_code, 1, {a} - 1)) + length(split_part(substr(source_code, 1, {a} - 1), chr(10), -1)) as integer)"


def _place(word: str) -> str:
    at = f"strpos(source_code, '{word}')"
    line, col = _LINE.format(a=at), _COL.format(a=at)
    return f"case when {at} > 0 then {line} else 1 end line_no, case when {at} > 0 then {col} else 1 end column_no"


@query(
    f"""select file_id, 'security/no-unsafe-innerHTML' rule_id, 3 severity, {_place('innerHTML')} from source_files where contains(source_code, 'innerHTML') or contains(source_code, 'dangerouslySetInnerHTML')
    union all select file_id, 'security/no-eval', 3, {_place('eval(')} from source_files where contains(source_code, 'eval(') or contains(source_code, 'new Function(')
    union all select file_id, 'memory/no-forgotten-listeners', 2, {_place('addEventListener')} from source_files where contains(source_code, 'addEventListener') and not contains(source_code, 'removeEventListener')"""
)
def rul1_static_rules(spark: SparkSession, d: str) -> DataFrame:
    """RUL-1 to RUL-3, PRJ-1, PRJ-2, UDF-1: static rules with line and column of their word."""
    return rules.findings(_read(spark, d, "source_files"), rules.STATIC_RULES).drop("snippet")


@query(
    """select file_id, 'editor/xss' rule_id from source_files where contains(source_code, 'innerHTML') or contains(source_code, 'dangerouslySetInnerHTML') or contains(source_code, 'document.write')
    union all select file_id, 'editor/listener-leak' from source_files where contains(source_code, 'addEventListener') and not contains(source_code, 'removeEventListener')"""
)
def rul4_editor_rules(spark: SparkSession, d: str) -> DataFrame:
    """RUL-4: the editor's rules."""
    return rules.findings(_read(spark, d, "source_files"), rules.EDITOR_RULES).select("file_id", "rule_id")


@query("select file_id, 'XSS-001' rule_id from source_files where contains(source_code, 'innerHTML') union all select file_id, 'EVAL-001' from source_files where contains(source_code, 'eval(')")
def rul5_build_rules(spark: SparkSession, d: str) -> DataFrame:
    """RUL-5: the build's rules."""
    return rules.findings(_read(spark, d, "source_files"), rules.BUILD_RULES).select("file_id", "rule_id")


@query()
def rul6_text_rules(spark: SparkSession, d: str) -> DataFrame:
    """RUL-6 to RUL-12, RUL-16, RUL-20, RUL-23, DSL: rules built from conditions."""
    return rules.findings(_read(spark, d, "source_files"), rules.NODE_TEXT_RULES)


@query("select file_id, trim(regexp_replace(substr(source_code, greatest(strpos(source_code, 'innerHTML') - 20, 1), strpos(source_code, 'innerHTML') + 29 - greatest(strpos(source_code, 'innerHTML') - 20, 1)), '^\\s+|\\s+$', '', 'g')) snippet from source_files where contains(source_code, 'innerHTML')")
def prj3_snippets(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-3: the text around a word."""
    t = F.col("source_code")
    return _read(spark, d, "source_files").filter(t.contains("innerHTML")).select("file_id", T.snippet(t, T.position(t, "innerHTML"), F.lit(9)).alias("snippet"))


@query("select file_id, cast(list_sum(list_transform(string_split(source_code, chr(10))[1:2], lambda x: length(x) + 1)) + 1 as integer) third_line from source_files where source_code is not null and len(string_split(source_code, chr(10))) >= 3")
def prj5_offset_of_line(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-4, PRJ-5: the offset at which the third line begins."""
    t = F.col("source_code")
    return _read(spark, d, "source_files").filter(F.size(F.split(t, "\n")) >= 3).select("file_id", T.offset_at(t, F.lit(3), F.lit(1)).alias("third_line"))


@query("select info_id, regexp_extract(stack, 'at\\s+(?:[^()\\n]+\\s+\\()?([^()\\n]+):(\\d+):(\\d+)\\)?', 1) file_path, try_cast(regexp_extract(stack, 'at\\s+(?:[^()\\n]+\\s+\\()?([^()\\n]+):(\\d+):(\\d+)\\)?', 2) as integer) line_no from issue_infos where stack is not null")
def prj7_stack_places(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-7: file and line of a stack's first frame."""
    p = r"at\s+(?:[^()\n]+\s+\()?([^()\n]+):(\d+):(\d+)\)?"
    return _read(spark, d, "issue_infos").filter("stack is not null").select("info_id", F.regexp_extract("stack", p, 1).alias("file_path"), F.regexp_extract("stack", p, 2).try_cast("int").alias("line_no"))


_IMPORTS = """(select file_id, no, regexp_extract(line, '[''"]([^''"]+)[''"];?\\s*$', 1) source from (select file_id, unnest(string_split(replace(source_code, chr(13) || chr(10), chr(10)), chr(10))) line, generate_subscripts(string_split(source_code, chr(10)), 1) - 1 no from source_files where source_code is not null) where starts_with(line, 'import ') and regexp_extract(line, '[''"]([^''"]+)[''"];?\\s*$', 1) <> '')"""


@query(f"select file_id, source, count(*) times, cast(min(no) as integer) first_line from {_IMPORTS} group by 1, 2 having count(*) > 1")
def rul22_duplicate_imports(spark: SparkSession, d: str) -> DataFrame:
    """RUL-22: sources imported more than once."""
    return rules.duplicate_imports(rules.imports(_read(spark, d, "source_files")))


@query(f"select file_id, cast(no as integer) no, i.source, library, kb from {_IMPORTS} i, (values ('react', 40), ('@kestrel', 70), ('@nimbus', 120)) l(library, kb) where i.source = library or starts_with(i.source, library || '/')")
def rul20_library_imports(spark: SparkSession, d: str) -> DataFrame:
    """RUL-20, RUL-21, JOI-4: imports of large libraries, by folders of the source."""
    libraries = spark.createDataFrame([("react", 40), ("@kestrel", 70), ("@nimbus", 120)], "library string, kb int")
    return rules.imports_of(rules.imports(_read(spark, d, "source_files")), libraries).select("file_id", "no", "source", "library", "kb")


@query()
def rul24_unused_imports(spark: SparkSession, d: str) -> DataFrame:
    """RUL-24, RUL-26: names that are declared and never referenced."""
    return rules.unused_imports(_read(spark, d, "source_files"))


@query()
def fil6_suppressions(spark: SparkSession, d: str) -> DataFrame:
    """FIL-6: issues that no comment switches off."""
    off = issues.suppressions(_read(spark, d, "source_files"), "eslint-disable")
    return issues.unsuppressed(_issues(spark, d), off).select("issue_id")


@query("select doc_id, case when length(text) <= 80 then text else substr(text, 1, 80) || '...' end short from documents where text is not null")
def fn_truncate(spark: SparkSession, d: str) -> DataFrame:
    """FN Truncate."""
    return _read(spark, d, "documents").filter("text is not null").select("doc_id", T.truncate(F.col("text"), 80).alias("short"))


@query("select issue_id, replace(replace(replace(replace(replace(code, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;') escaped from (select distinct * from issues) where code is not null")
def fn_html_escape(spark: SparkSession, d: str) -> DataFrame:
    """FN HTML escape."""
    return _issues(spark, d).filter("code is not null").select("issue_id", T.html_escape(F.col("code")).alias("escaped"))


@query("select file_id, md5(source_code) md5, md5(file_path || ':' || source_code) keyed, sha256(source_code) sha256 from source_files where source_code is not null")
def fn_hashes(spark: SparkSession, d: str) -> DataFrame:
    """FN Hash: digests of content, and of path and content."""
    c = F.col("source_code")
    return _read(spark, d, "source_files").filter("source_code is not null").select("file_id", F.md5(c).alias("md5"), F.md5(F.concat("file_path", F.lit(":"), c)).alias("keyed"), F.sha2(c, 256).alias("sha256"))


@query(
    """select file_id, lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) ext, regexp_extract(file_path, '([^/]*)$', 1) base, case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end dir,
    case when starts_with(file_path, 'src/') then substr(file_path, 5) else file_path end below from source_files"""
)
def fn_paths(spark: SparkSession, d: str) -> DataFrame:
    """FN Path: extension, base, folder, relative path."""
    p = F.col("file_path")
    return _read(spark, d, "source_files").select("file_id", T.extension(p).alias("ext"), T.basename(p).alias("base"), T.dirname(p).alias("dir"), T.relative(p, F.lit("src")).alias("below"))


@query(
    """select file_id, case when size_bytes is null or size_bytes <= 0 then '0 Bytes' when size_bytes < 1024 then size_bytes || ' Bytes'
    else rtrim(rtrim(printf('%.2f', round(size_bytes / 1024.0, 2)), '0'), '.') || ' KB' end size from source_files where size_bytes < 1048576"""
)
def fn_format_bytes(spark: SparkSession, d: str) -> DataFrame:
    """FN Byte formatting."""
    return _read(spark, d, "source_files").filter("size_bytes < 1048576").select("file_id", T.format_bytes(F.col("size_bytes")).alias("size"))


@query()
def fn_text_hash(spark: SparkSession, d: str) -> DataFrame:
    """FN Hash: the 31-multiplier hash of issue keys."""
    return _read(spark, d, "issue_infos").select("info_id", T.text_hash(F.col("issue_key")).alias("hash"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k, date_part('year', ts) * 10000 + date_part('month', ts) * 100 + date_part('day', ts) as day_no from events")
def fn_json_and_dates(spark: SparkSession, d: str) -> DataFrame:
    """FN JSON, FN Date/time: a field of a JSON text, a date as a number."""
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("bigint").alias("day_no"))


@query("select metric_id, coalesce(tags['unit'], 'none') unit, coalesce(tags['env'], 'prod') env, cast(len(map_keys(tags)) as integer) n from (select distinct on (metric_id) * from metrics)")
def fn_maps(spark: SparkSession, d: str) -> DataFrame:
    """FN Map, PRJ-10: defaults merged with the tags of a reading."""
    m = _read(spark, d, "metrics").dropDuplicates(["metric_id"])
    defaults = F.create_map(F.lit("unit"), F.lit("none"), F.lit("env"), F.lit("prod"))
    both = T.merged(defaults, F.coalesce("tags", F.create_map().cast("map<string,string>")))
    return m.select("metric_id", both["unit"].alias("unit"), both["env"].alias("env"), F.size(F.map_keys("tags")).alias("n"))


@query("select file_id, md5(replace(source_code, 'innerHTML', 'textContent')) after from source_files where contains(source_code, 'innerHTML')")
def fn_text_fix(spark: SparkSession, d: str) -> DataFrame:
    """FN Text fixers, UDF-4: a fix that rewrites a text; a second run changes nothing."""
    c = F.col("source_code")
    return _read(spark, d, "source_files").filter(c.contains("innerHTML")).select("file_id", F.md5(F.replace(c, F.lit("innerHTML"), F.lit("textContent"))).alias("after"))


@query("select issue_id, 'Rule ' || coalesce(rule_id, '{rule}') || ' at {place}' as text from (select distinct * from issues)")
def fn_templates(spark: SparkSession, d: str) -> DataFrame:
    """FN String: templates with names; unknown names stay."""
    values = F.map_filter(F.create_map(F.lit("rule"), F.col("rule_id")), lambda k, v: v.isNotNull())
    return _issues(spark, d).select("issue_id", T.fill_template(F.lit("Rule {rule} at {place}"), values).alias("text"))


# changes

_FIRST = "(select repo || '/' || file_path path, arg_min(coalesce(epoch_us(mtime_ts), 0), file_id) mtime, arg_min(coalesce(size_bytes, -1), file_id) size from source_files where file_id % 3 <> 0 group by 1)"
_LAST = "(select repo || '/' || file_path path, arg_max(coalesce(epoch_us(mtime_ts), 0), file_id) mtime, arg_max(coalesce(size_bytes, -1), file_id) size from source_files group by 1)"


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The newest state of every path, and an older state of most."""
    f = _read(spark, d, "source_files").select(F.concat("repo", F.lit("/"), "file_path").alias("path"), "file_id", F.coalesce(F.unix_micros(F.col("mtime_ts").cast("timestamp")), F.lit(0)).alias("m"), F.coalesce("size_bytes", F.lit(-1)).alias("s"))
    now = f.groupBy("path").agg(F.max_by("m", "file_id").alias("mtime"), F.max_by("s", "file_id").alias("size"))
    before = f.filter("file_id % 3 <> 0").groupBy("path").agg(F.min_by("m", "file_id").alias("mtime"), F.min_by("s", "file_id").alias("size"))
    return now, before


@query(
    f"""select n.path, case when contains(n.path, '.env') then 'forced' when b.path is null then 'new' when n.mtime > b.mtime then 'newer' when n.size <> b.size then 'size' end reason
    from {_LAST} n left join {_FIRST} b using (path) where contains(n.path, '.env') or b.path is null or n.mtime > b.mtime or n.size <> b.size"""
)
def dif1_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """DIF-1, FIL-8, SRC-7: files to scan again."""
    now, before = _scans(spark, d)
    return changes.changed_files(now, before, force=[".env"])


@query(f"select b.path, b.size from {_FIRST} b join {_LAST} n using (path) where not (contains(n.path, '.env') or n.mtime > b.mtime or n.size <> b.size)")
def joi7_restored(spark: SparkSession, d: str) -> DataFrame:
    """JOI-7: earlier results that still hold."""
    now, before = _scans(spark, d)
    return changes.restored(before, now, changes.changed_files(now, before, force=[".env"])).select("path", "size")


@query("select distinct a.repo || '/' || a.file_path path, a.content_hash digest from source_files a where a.content_hash is not null and not exists (select 1 from source_files b where b.file_id % 2 = 0 and b.repo = a.repo and b.file_path = a.file_path and b.content_hash = a.content_hash)")
def dif3_content_gate(spark: SparkSession, d: str) -> DataFrame:
    """DIF-3: contents that no earlier scan has seen."""
    f = _read(spark, d, "source_files").filter("content_hash is not null").select(F.concat("repo", F.lit("/"), "file_path").alias("path"), F.col("content_hash").alias("digest"), "file_id")
    return changes.content_gate(f.select("path", "digest").distinct(), f.filter("file_id % 2 = 0"))


_REG = """(select case when n % 7 = 0 then rule_id || '/old' else rule_id end rule_id, case when n % 4 = 0 then 'x' else sha256(concat_ws(chr(31), rule_id, rule_name, description, category, severity)) end digest, case when n % 4 = 0 and n % 3 = 0 then 'broken' else '1.' || n || '.0' end version, n
   from (select *, row_number() over (order by rule_id) n from scan_rules) where n % 5 <> 0)"""


@query(
    f"""select coalesce(s.rule_id, g.rule_id) rule_id, case when s.rule_id is null then 'removed' when g.rule_id is null then 'new' when d = digest then 'unchanged' else 'updated' end as "update", version previous,
    case when s.rule_id is null then null when g.rule_id is null then '1.0.0' when d = digest then version when version = 'broken' then '1.0.0' else '1.' || (n + 1) || '.0' end as "current"
    from (select rule_id, sha256(concat_ws(chr(31), rule_id, rule_name, description, category, severity)) d from scan_rules) s full join {_REG} g on s.rule_id = g.rule_id"""
)
def dif2_rule_versions(spark: SparkSession, d: str) -> DataFrame:
    """DIF-2, JOI-8, FN Version: new, updated, unchanged and removed rules with their next version."""
    from pyspark.sql import Window

    s = _read(spark, d, "scan_rules").withColumn("digest", changes.rule_digest("rule_id", "rule_name", "description", "category", "severity"))
    n = s.withColumn("n", F.row_number().over(Window.orderBy("rule_id"))).filter("n % 5 <> 0")  # rules are a table of fixed size
    registry = n.select(
        F.when(F.col("n") % 7 == 0, F.concat("rule_id", F.lit("/old"))).otherwise(F.col("rule_id")).alias("rule_id"),
        F.when(F.col("n") % 4 == 0, "x").otherwise(F.col("digest")).alias("digest"),
        F.when((F.col("n") % 4 == 0) & (F.col("n") % 3 == 0), "broken").otherwise(F.concat(F.lit("1."), "n", F.lit(".0"))).alias("version"),
    )
    return changes.version_updates(s, registry)


_UPDATES = _SQL["dif2_rule_versions"]


@query(f'select "update", count(*) rules from ({_UPDATES}) group by 1')
def agg29_change_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG-29: rules per kind of update."""
    return dif2_rule_versions(spark, d).groupBy("update").agg(F.count("*").alias("rules"))


# snapshots: the files of a scan are the objects, their issues hold them

_KIND = "case when file_path like '%.tsx' or file_path like '%.jsx' then 'component_instance' when file_path like '%.json' then 'map' when file_path like '%.vue' then 'dom_node' when file_path like '%.ts' then 'closure' else 'other' end"
_OBJ = "(select repo || '/' || file_path object_id, cast({pick}(coalesce(size_bytes, 0) * 20, file_id) as bigint) size, cast(count(*) % 3 as bigint) retained, any_value(" + _KIND + ") \"type\" from source_files where {where} group by 1)"
_BASE, _TARGET = _OBJ.format(pick="arg_min", where="file_id % 4 <> 0"), _OBJ.format(pick="arg_max", where="file_id % 5 <> 0")
_DIFF = f"""(select object_id, change, size_before, size_after, retained, "type", case when change = 'changed' then size_after - size_before end size_delta from (select coalesce(b.object_id, t.object_id) object_id,
   case when b.object_id is null then 'added' when t.object_id is null then 'removed' when b.size <> t.size or b.retained <> t.retained then 'changed' end change, b.size size_before, t.size size_after, coalesce(t.retained, b.retained) retained, coalesce(t."type", b."type") "type"
   from {_BASE} b full join {_TARGET} t on b.object_id = t.object_id) where change is not null)"""


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = F.col("file_path")
    kind = F.when(p.endswith(".tsx") | p.endswith(".jsx"), "component_instance").when(p.endswith(".json"), "map").when(p.endswith(".vue"), "dom_node").when(p.endswith(".ts"), "closure").otherwise("other")
    f = _read(spark, d, "source_files").select(F.concat("repo", F.lit("/"), p).alias("object_id"), "file_id", (F.coalesce("size_bytes", F.lit(0)) * 20).alias("s"), kind.alias("k"))

    def objects(where: str, pick) -> DataFrame:
        return f.filter(where).groupBy("object_id").agg(pick("s", "file_id").alias("size"), (F.count("*") % 3).alias("retained"), F.any_value("k").alias("type"))

    return objects("file_id % 4 <> 0", F.min_by), objects("file_id % 5 <> 0", F.max_by)


@query(f"select * from {_DIFF}")
def joi1_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """JOI-1: objects added, removed and changed between two snapshots."""
    return changes.snapshot_diff(*_snapshots(spark, d)).drop("change_rate")


@query(f"""select object_id, change, size_after from {_DIFF} where (change = 'added' and retained > 0 and (size_after > 10000 or "type" = 'component_instance')) or (change = 'changed' and size_delta > 5000 and abs(size_delta) / greatest(size_before, 1) > 0.5)""")
def set2_leak_candidates(spark: SparkSession, d: str) -> DataFrame:
    """SET-2, FIL-16: objects that look like leaks, each once."""
    return changes.leak_candidates(changes.snapshot_diff(*_snapshots(spark, d))).select("object_id", "change", "size_after")


@query(
    f"""select object_id, case "type" when 'dom_node' then 'detached_dom' when 'component_instance' then 'zombie_component' when 'closure' then 'closure_cycle' when 'map' then case when s > 100000 then 'large_cache' else 'other' end
    else case when contains(object_id, 'Context') or contains(object_id, 'Provider') then 'context_reference' when contains(object_id, 'Store') or contains(object_id, 'Redux') then 'redux_store' else 'other' end end pattern,
    case "type" when 'dom_node' then case when s > 10000 then 'high' else 'medium' end when 'component_instance' then case when s > 50000 then 'critical' else 'high' end when 'closure' then case when s > 20000 then 'high' else 'medium' end
    when 'map' then case when s > 100000 then 'medium' when s > 50000 then 'high' else 'low' end
    else case when contains(object_id, 'Context') or contains(object_id, 'Provider') or contains(object_id, 'Store') or contains(object_id, 'Redux') then 'medium' when s > 50000 then 'high' else 'low' end end severity from (select object_id, "type", size s from {_TARGET})"""
)
def cls1_leak_patterns(spark: SparkSession, d: str) -> DataFrame:
    """CLS-1: pattern and severity of every object."""
    _, t = _snapshots(spark, d)
    p = changes.leak_pattern(F.col("type"), F.col("size"), F.col("object_id"), F.lit(False))
    return t.select("object_id", p.alias("p")).select("object_id", "p.pattern", "p.severity")


@query(f"""select "type", count(*) objects, cast(sum(size) as bigint) bytes, max(size) largest from {_TARGET} group by 1""")
def agg9_objects_by_type(spark: SparkSession, d: str) -> DataFrame:
    """AGG-9, AGG-20, SRT-2: objects and bytes per type."""
    return _snapshots(spark, d)[1].groupBy("type").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


# reference graph: region -> nation -> customer -> order, and region -> nation -> supplier

_EDGES = """(select 'R' || n_regionkey source_id, 'N' || n_nationkey target_id from nation union all select 'N' || c_nationkey, 'C' || c_custkey from customer union all select 'C' || o_custkey, 'O' || o_orderkey from orders union all select 'N' || s_nationkey, 'S' || s_suppkey from supplier)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))

    def edge(table: str, a: str, ac: str, b: str, bc: str) -> DataFrame:
        return _read(spark, d, table).select(key(a, ac).alias("source_id"), key(b, bc).alias("target_id"))

    edges = edge("nation", "R", "n_regionkey", "N", "n_nationkey").union(edge("customer", "N", "c_nationkey", "C", "c_custkey")).union(edge("orders", "C", "o_custkey", "O", "o_orderkey")).union(edge("supplier", "N", "s_nationkey", "S", "s_suppkey"))
    return edges, _read(spark, d, "region").select(key("R", "r_regionkey").alias("object_id"))


@query(
    f"""with recursive e as {_EDGES}, w(object_id, pos, path) as (select 'O' || o_orderkey, 'O' || o_orderkey, 'O' || o_orderkey from orders union all
    select w.object_id, e.source_id, e.source_id || ' -> ' || w.path from w join e on e.target_id = w.pos) select object_id, path from w where pos like 'R%'"""
)
def gra1_retention_paths(spark: SparkSession, d: str) -> DataFrame:
    """GRA-1, GRA-2, GRA-5, JOI-5: paths of every order up to its region."""
    edges, roots = _graph(spark, d)
    starts = edges.filter(F.col("target_id").startswith("O")).select(F.col("target_id").alias("object_id"))
    return graphs.retention_paths(starts, edges, roots, max_steps=6).select("object_id", graphs.path_text(F.col("path")).alias("path"))


@query(f"with e as {_EDGES} select distinct source_id object_id from e where source_id not in (select target_id from e)")
def prj9_roots(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-9, GRA-7: vertices that are nobody's child."""
    edges, _ = _graph(spark, d)
    return graphs.tree_roots(edges.select(F.col("source_id").alias("object_id")).distinct(), edges)


@query("with e as (select distinct l_suppkey % 50 s, l_partkey % 50 t from lineitem where l_linenumber = 1) select distinct a.s object_id from e a join e b on a.s = b.t and a.t = b.s")
def gra6_cycles(spark: SparkSession, d: str) -> DataFrame:
    """GRA-6: vertices on cycles of one or two steps."""
    e = _read(spark, d, "lineitem").filter("l_linenumber = 1").select((F.col("l_suppkey") % 50).alias("source_id"), (F.col("l_partkey") % 50).alias("target_id")).distinct()
    return graphs.two_step_cycles(e)


@query(f"""select repo, case when dom > 0 and dom >= n / 3.0 then 'dom_chain' when clo > 0 and clo >= n / 3.0 then 'closure_chain' when com > 0 then 'component_chain' else 'mixed_chain' end kind
  from (select repo, count(*) n, count(*) filter (where k = 'dom_node') dom, count(*) filter (where k = 'closure') clo, count(*) filter (where k = 'component_instance') com from (select repo, {_KIND} k from source_files) group by 1)""")
def agg22_chain_kinds(spark: SparkSession, d: str) -> DataFrame:
    """AGG-22, GRA-4: the kind of a group of objects by the kinds in it, from counts and not from lists."""
    p = F.col("file_path")
    kind = F.when(p.endswith(".tsx") | p.endswith(".jsx"), "component_instance").when(p.endswith(".json"), "map").when(p.endswith(".vue"), "dom_node").when(p.endswith(".ts"), "closure").otherwise("other")
    n = _read(spark, d, "source_files").select("repo", kind.alias("k")).groupBy("repo").agg(F.count("*").alias("n"), *[F.count_if(F.col("k") == k).alias(k) for k in ("dom_node", "closure", "component_instance")])
    third = F.col("n") / 3
    return n.select("repo", F.when((F.col("dom_node") > 0) & (F.col("dom_node") >= third), "dom_chain").when((F.col("closure") > 0) & (F.col("closure") >= third), "closure_chain").when(F.col("component_instance") > 0, "component_chain").otherwise("mixed_chain").alias("kind"))


# build assets and cache entries

_ASSETS = "(select repo || '/' || file_path path, arg_max(coalesce(size_bytes, 0), file_id) size from source_files where regexp_matches(file_path, '\\.(js|css)$') group by 1)"


def _assets(spark: SparkSession, d: str) -> DataFrame:
    f = _read(spark, d, "source_files").filter(assets.is_asset(F.col("file_path")))
    return f.groupBy(F.concat("repo", F.lit("/"), "file_path").alias("path")).agg(F.max_by(F.coalesce("size_bytes", F.lit(0)), "file_id").alias("size"))


@query(f"select count(*) assets, cast(sum(size) as bigint) bytes, max(size) largest, count(*) filter (where size > 2048) \"over\" from {_ASSETS}")
def agg13_bundle_totals(spark: SparkSession, d: str) -> DataFrame:
    """AGG-13, SRC-13, FIL-14: totals over assets."""
    return assets.totals(_assets(spark, d), 2048)


@query(f"select path, size from {_ASSETS} where size > 2048")
def fil15_oversize(spark: SparkSession, d: str) -> DataFrame:
    """FIL-15: assets above the limit."""
    return assets.oversize(_assets(spark, d), 2048)


@query(f"select path, size from {_ASSETS} order by size desc, path limit 5")
def top1_largest(spark: SparkSession, d: str) -> DataFrame:
    """TOP-1, TOP-3: the largest assets."""
    return assets.largest(_assets(spark, d))


@query("select coalesce(nullif(regexp_extract(file_path, 'node_modules/((?:@[^/]+/)?[^/]+)', 1), ''), '(own)') package, cast(sum(coalesce(size_bytes, 0)) as bigint) bytes, count(*) modules from source_files group by 1")
def agg14_size_by_package(spark: SparkSession, d: str) -> DataFrame:
    """AGG-14, PRJ-8: bytes per package."""
    return assets.sizes_by_package(_read(spark, d, "source_files").select(F.col("file_path").alias("path"), F.coalesce("size_bytes", F.lit(0)).alias("size")))


_ENTRIES = "(select user_id::varchar as key, count(*) hits, cast(round(sum(value) * 1000) as bigint) size, epoch_us(min(ts)) / 1e6 created, epoch_us(max(ts)) / 1e6 last_access from events group by 1)"
_NOW = "(select epoch_us(max(ts)) / 1e6 + 3600 from events)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    s = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    return _read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("hits"), F.round(F.sum("value") * 1000).cast("bigint").alias("size"), s(F.min("ts")).alias("created"), s(F.max("ts")).alias("last_access"))


def _end(spark: SparkSession, d: str) -> float:
    return _read(spark, d, "events").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] / 1e6 + 3600


@query(f"select key, round(least(hits / 10.0, 1) * 0.4 + greatest(0, 1 - ({_NOW} - last_access) / 86400) * 0.3 + greatest(0, 1 - size / 1048576.0) * 0.2 + greatest(0, 1 - ({_NOW} - created) / 604800) * 0.1, 6) score from {_ENTRIES}")
def cac5_priority(spark: SparkSession, d: str) -> DataFrame:
    """CAC-5: priority of cache entries."""
    now = F.lit(_end(spark, d))
    return _entries(spark, d).select("key", F.round(caches.priority(F.col("hits"), now - F.col("last_access"), F.col("size"), now - F.col("created")), 6).alias("score"))


@query(f"select key from {_ENTRIES} where {_NOW} - last_access > least(3600 * (1 + log10(hits + 1)), 3600 * 24)")
def cac6_pattern_prune(spark: SparkSession, d: str) -> DataFrame:
    """CAC-6, CAC-1, CAC-2: entries whose time to live, longer with more hits, is over."""
    return caches.expired(_entries(spark, d), F.lit(_end(spark, d)), caches.dynamic_ttl(3600.0, F.col("hits"))).select("key")


@query(f"select key from (select key, (select cast(sum(size) as double) from {_ENTRIES}) total, coalesce(sum(size) over (order by last_access, key rows between unbounded preceding and 1 preceding), 0) freed from {_ENTRIES}) where total >= 1000000 and freed < total - 0.8 * 1000000")
def cac6_capacity_prune(spark: SparkSession, d: str) -> DataFrame:
    """CAC-3, CAC-6: least recently used entries until there is room again."""
    return caches.over_capacity(_entries(spark, d), 1_000_000).select("key")


@query(f"select key, last_access from {_ENTRIES} order by last_access desc, key limit 20")
def top5_recent_keys(spark: SparkSession, d: str) -> DataFrame:
    """TOP-4, TOP-5: the newest entries."""
    return caches.keep_first(_entries(spark, d), 20).select("key", "last_access")


@query(f"select count(*) entries, cast(sum(hits) as bigint) hits, cast(sum(size) as bigint) bytes, count(*) filter (where hits > 50) hot from {_ENTRIES}")
def agg24_cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-24, AGG-28: figures of a cache."""
    return _entries(spark, d).agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.sum("size").alias("bytes"), F.count_if(F.col("hits") > 50).alias("hot"))


@query()
def cac7_routing(spark: SparkSession, d: str) -> DataFrame:
    """CAC-7: the node of every key on a consistent ring."""
    places = caches.ring([("a", 1), ("b", 2), ("c", 1)], 8)
    return _entries(spark, d).select("key", caches.routed(T.text_hash(F.col("key")), places).alias("node"))


@query("select severity, count(*) judged, count(*) filter (where category = 'security') \"right\", round(count(*) filter (where category = 'security') / count(*), 6) accuracy, round(1 - count(*) filter (where category = 'security') / count(*), 6) false_rate from (select lower(severity) severity, category from issue_infos) group by 1")
def agg21_feedback(spark: SparkSession, d: str) -> DataFrame:
    """AGG-21: accuracy of judgements."""
    i = _read(spark, d, "issue_infos").withColumn("severity", F.lower("severity"))
    return measures.feedback_accuracy(i, ["severity"], F.col("category") == "security")


# nodes of scripts


@query()
def src5_nodes(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5 to SRC-7: nodes per file and kind; a file that can't be parsed is one row of kind error."""
    return nodes.nodes(_read(spark, d, "source_files")).groupBy("file_id", "kind").agg(F.count("*").alias("nodes"))


@query()
def rul13_node_rules(spark: SparkSession, d: str) -> DataFrame:
    """RUL-8, RUL-9, RUL-11, RUL-13 to RUL-19, RUL-23, RUL-25 to RUL-27, RUL-29, JOI-12, UDF-2: rules on nodes, parsed once."""
    return nodes.match_rules(cut(nodes.nodes(_read(spark, d, "source_files"))))


# more rules, features and reports

_SENSITIVE = (("api_key", r"(?i)api[_-]?key|apikey"), ("password", r"(?i)password|passwd|pwd"), ("token", r"(?i)token|jwt|auth[_-]token"), ("credential", r"(?i)credential|cred"), ("secret", r"(?i)secret|private"))


@query(
    """select issue_id, case when regexp_matches(code, '(?i)api[_-]?key|apikey') then 'api_key' when regexp_matches(code, '(?i)password|passwd|pwd') then 'password' when regexp_matches(code, '(?i)token|jwt|auth[_-]token') then 'token'
    when regexp_matches(code, '(?i)credential|cred') then 'credential' else 'secret' end kind from (select distinct * from issues) where regexp_matches(code, '(?i)api[_-]?key|apikey|password|passwd|pwd|token|jwt|credential|cred|secret|private')"""
)
def rul10_sensitive_code(spark: SparkSession, d: str) -> DataFrame:
    """RUL-10: the first kind of secret that a piece of code speaks of."""
    kind = F.coalesce(*[F.when(F.col("code").rlike(p), F.lit(k)) for k, p in _SENSITIVE])
    return _issues(spark, d).select("issue_id", kind.alias("kind")).filter("kind is not null")


@query("select info_id, 'medium' \"level\" from issue_infos where regexp_matches(description, '(?i)^\\[SECURITY\\]')")
def rul31_console_lines(spark: SparkSession, d: str) -> DataFrame:
    """RUL-31, SRC-12: lines that a console marks as security, with their level."""
    from granary.sources.files import console_level

    return _read(spark, d, "issue_infos").select("info_id", console_level(F.col("description")).alias("level")).filter("level is not null")


@query("select info_id, component from issue_infos where component is not null and not regexp_matches(component, '^[A-Z][A-Za-z0-9]*$')")
def rul28_component_names(spark: SparkSession, d: str) -> DataFrame:
    """RUL-28: names that are not in the form of components."""
    return _read(spark, d, "issue_infos").filter(~F.col("component").rlike("^[A-Z][A-Za-z0-9]*$")).select("info_id", "component")


@query("select user_id, count(*) calls, count(distinct event_type) hooks from events where event_type in ('click', 'view') group by 1 having count(*) > 20 and count(distinct event_type) > 1")
def rul30_hook_checks(spark: SparkSession, d: str) -> DataFrame:
    """RUL-30, AGG-11: components that call too many hooks."""
    e = _read(spark, d, "events").filter(F.col("event_type").isin("click", "view"))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("hooks")).filter("calls > 20 and hooks > 1")


@query("select rule_id, array_to_string(list_sort(list_filter(frameworks, lambda x: x not in ('react', 'vue'))), ',') missing from scan_rules where len(list_filter(frameworks, lambda x: x not in ('react', 'vue'))) > 0")
def rul24_missing_entries(spark: SparkSession, d: str) -> DataFrame:
    """RUL-24, SET-3: what is used and not declared, as a difference of arrays."""
    missing = F.array_sort(F.array_except("frameworks", F.array(F.lit("react"), F.lit("vue"))))
    return _read(spark, d, "scan_rules").select("rule_id", F.array_join(missing, ",").alias("missing")).filter("missing <> ''")


@query("select file_id, cast(1 + len(regexp_extract_all(source_code, '\\b(?:if|for|while|case|catch)\\b|&&|\\|\\|')) as integer) complexity, cast(2 * length(source_code) as integer) estimate from source_files where source_code is not null")
def agg26_complexity(spark: SparkSession, d: str) -> DataFrame:
    """AGG-25, AGG-26: branches of a script, its size in memory."""
    c = F.col("source_code")
    return _read(spark, d, "source_files").filter("source_code is not null").select("file_id", (F.size(F.regexp_extract_all(c, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\|"), F.lit(0))) + 1).alias("complexity"), (F.length(c) * 2).alias("estimate"))


@query(f"""select object_id, case when "type" = 'dom_node' and retained = 2 then 'detached_dom' when "type" = 'component_instance' and retained = 2 then 'zombie_component' when "type" = 'closure' and retained = 2 then 'closure_cycle' else '' end features,
  case when "type" in ('dom_node', 'component_instance', 'closure') and retained = 2 then 0.125 else 0 end confidence from {_TARGET}""")
def cls2_leak_features(spark: SparkSession, d: str) -> DataFrame:
    """CLS-2, AGG-19, UDF-5: features of objects and how sure they make."""
    _, t = _snapshots(spark, d)
    yes = F.when(F.col("retained") == 2, "true").otherwise("false")
    known = F.create_map(F.lit("detached"), yes, F.lit("unmounted"), yes, F.lit("cyclic"), yes)
    f = changes.leak_features(F.col("type"), known)
    return t.select("object_id", F.array_join(f, ",").alias("features"), changes.confidence(f).alias("confidence"))


@query("select info_id, issue_type pattern, case issue_type when 'leak' then 'take references away' when 'timer' then 'clear the timer' else description end \"text\" from issue_infos")
def cls4_enriched(spark: SparkSession, d: str) -> DataFrame:
    """CLS-3, CLS-4: guidance where there is some, the own text elsewhere."""
    notes = spark.createDataFrame([("leak", "take references away"), ("timer", "clear the timer")], "pattern string, text string")
    i = _read(spark, d, "issue_infos").select("info_id", F.col("issue_type").alias("pattern"), F.col("description").alias("text"))
    return changes.enriched(i, notes)


@query(
    """select user_id, avg(cents) mean, max(cents) most, count(*) n from (select user_id, cast(round(value * 100) as bigint) cents, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events) where rn <= 100 group by 1"""
)
def agg10_lifecycle_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-10, WIN-3: figures over the last 100 events of each component."""
    last = measures.last_n(_cents(spark, d), ["user_id"], [F.desc("ts"), F.desc("event_id")], 100)
    return last.groupBy("user_id").agg(F.avg("cents").alias("mean"), F.max("cents").alias("most"), F.count("*").alias("n"))


@query(
    """with recursive e as %s, w(object_id, pos, path) as (select 'S' || s_suppkey, 'S' || s_suppkey, ['S' || s_suppkey] from supplier union all select w.object_id, e.source_id, list_prepend(e.source_id, w.path) from w join e on e.target_id = w.pos)
    select object_id, path[1] || ',' || path[len(path)] ends, array_to_string(path, ' -> ') path from w where pos like 'R%%'"""
    % _EDGES
)
def gra3_simplified_paths(spark: SparkSession, d: str) -> DataFrame:
    """GRA-3, GRA-4: short paths and their key vertices (both ends, where no vertex is of a key kind)."""
    edges, roots = _graph(spark, d)
    starts = edges.filter(F.col("target_id").startswith("S")).select(F.col("target_id").alias("object_id"))
    p = graphs.retention_paths(starts, edges, roots, max_steps=4).withColumn("kinds", F.transform("path", lambda x: F.lit("other")))
    ends = graphs.key_vertices(F.col("path"), F.col("kinds"), ("timer",))
    return p.select("object_id", F.array_join(ends, ",").alias("ends"), graphs.path_text(graphs.simplified(F.col("path"), F.col("kinds"))).alias("path"))


@query(f"select e.event_id, r.rule_id from (select event_id, event_type, user_id %% 40 k from events where event_type = 'error') e join (select rule_id, row_number() over (order by rule_id) - 1 n from scan_rules) r on e.k = r.n".replace("%%", "%"))
def joi6_calls_and_findings(spark: SparkSession, d: str) -> DataFrame:
    """JOI-6: calls joined with what is found of their hook."""
    from pyspark.sql import Window

    r = _read(spark, d, "scan_rules").select("rule_id", (F.row_number().over(Window.orderBy("rule_id")) - 1).alias("n"))  # rules are a table of fixed size
    e = _read(spark, d, "events").filter("event_type = 'error'").select("event_id", (F.col("user_id") % 40).alias("n"))
    return e.join(r, "n").select("event_id", "rule_id")


@query(
    f"""select issue_type, total, case when critical > 0 then 'fix critical issues first' when error > 10 then 'plan a clean-up' else 'keep watching' end advice from
    (select issue_type, count(*) total, count(*) filter (where severity = 3) critical, count(*) filter (where severity = 2) error from {_D} group by 1)"""
)
def snk12_recommendations(spark: SparkSession, d: str) -> DataFrame:
    """SNK-9, SNK-12, AGG-3: advice by counts."""
    c = issues.counts(_issues(spark, d), "issue_type")
    return c.select("issue_type", "total", F.when(F.col("critical") > 0, "fix critical issues first").when(F.col("error") > 10, "plan a clean-up").otherwise("keep watching").alias("advice"))


@query()
def snk1_json_report(spark: SparkSession, d: str) -> DataFrame:
    """SNK-1, SNK-7, AGG-15: the issues of each file as one JSON text, in the order of severity."""
    i = _issues(spark, d).filter("file_id is not null").select("file_id", "issue_id", "rule_id", "severity", "message")
    return i.groupBy("file_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("order"), "issue_id", "rule_id", "message")))).alias("json"))


@query("select metric_id, source, metric_name from (select distinct * from metrics) where metric_value is not null and ts >= (select max(ts) from metrics) - interval 1 hour")
def sta3_last_hour(spark: SparkSession, d: str) -> DataFrame:
    """STA-2, STA-3, TOP-4: readings of the last hour of the data."""
    m = measures.distinct_readings(_read(spark, d, "metrics"))
    end = m.agg(F.max("ts")).first()[0]
    return measures.fresh(m.filter("metric_value is not null"), "ts", F.lit(end), 1).select("metric_id", "source", "metric_name")


@query("select metric_name, round(avg(metric_value), 3) mean, min(metric_value) least, max(metric_value) most, count(*) n from (select distinct * from metrics) where metric_type = 'timer' and metric_value is not null group by 1")
def agg23_timers(spark: SparkSession, d: str) -> DataFrame:
    """AGG-23: figures of timers."""
    m = measures.distinct_readings(_read(spark, d, "metrics")).filter("metric_type = 'timer' and metric_value is not null")
    return m.groupBy("metric_name").agg(F.round(F.avg("metric_value"), 3).alias("mean"), F.min("metric_value").alias("least"), F.max("metric_value").alias("most"), F.count("*").alias("n"))
