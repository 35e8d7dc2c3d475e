"""Registered queries over the order tables as history, each with the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.config import Bugfix, Config, Coupling
from faultline.functions import scalars
from faultline.operators import calibration, commits, coupling, files, filters, graph, scoring
from faultline.plans import reports
from faultline.sources import bridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CONFIG = Config(bugfix=Bugfix(bridge.PATTERNS))
WINDOW = 7


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *also: str) -> DataFrame:
    """Doubles to six decimals, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _history(path: str = "concat(p.p_type, '/', p.p_brand, '/', p.p_name)", name: str = "h") -> str:
    return f"""{name} AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) AS sha, {path} AS path, o.o_orderdate AS "when", lower(concat('Cust', o.o_custkey, '@X.com')) AS author,
         o.o_orderpriority AS message, CASE l.l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'deleted' ELSE 'modified' END AS kind,
         CAST(l.l_quantity AS BIGINT) AS added, CAST(round(l.l_discount * 100) AS BIGINT) AS deleted,
         regexp_matches(o.o_orderpriority, '(?i)\\burgent\\b') OR regexp_matches(o.o_orderpriority, '(?i)\\bhigh\\b') AS fix
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
)"""


SUPPLIER = "concat('supp/', l.l_suppkey)"


def _files(source: str = "h", name: str = "files", days: int = WINDOW) -> str:
    return f"""live AS (SELECT * FROM {source} WHERE kind <> 'deleted'),
who AS (SELECT path, author, count(*) AS n FROM live GROUP BY path, author),
own AS (SELECT path, count(*) AS contributor_count, max(n) / CAST(sum(n) AS DOUBLE) AS ownership_ratio FROM who GROUP BY path),
near AS (SELECT path, count(*) OVER (PARTITION BY path ORDER BY "when" RANGE BETWEEN INTERVAL {days} DAYS PRECEDING AND CURRENT ROW) AS n FROM live),
bursts AS (SELECT path, max(n) / CAST(count(*) AS DOUBLE) AS burst_score FROM near GROUP BY path),
sums AS (SELECT path, count(*) AS commit_count, CAST(sum(added) AS BIGINT) AS added_lines, CAST(sum(deleted) AS BIGINT) AS deleted_lines, max("when") AS last_modified,
                CAST(sum(CASE WHEN fix THEN 1 ELSE 0 END) AS BIGINT) AS bugfix_count FROM live GROUP BY path),
{name} AS (SELECT s.*, o.contributor_count, o.ownership_ratio, b.burst_score FROM sums s JOIN own o ON s.path = o.path JOIN bursts b ON s.path = b.path)"""


def _norm(v: str, low: str, high: str) -> str:
    return f"""(CASE WHEN abs({high} - {low}) < 1e-10 THEN CASE WHEN {v} > 0 THEN 1e0 ELSE 0e0 END
   ELSE greatest(0e0, least(1e0, (ln(1e0 + {v}) - ln(1e0 + {low})) / (ln(1e0 + {high}) - ln(1e0 + {low})))) END)"""


def _scored(size: str = "0", weight: float = 0.0) -> str:
    """Scores of ``files``, by part."""
    return f"""ctx AS (SELECT min(commit_count) AS c0, max(commit_count) AS c1, min(added_lines + deleted_lines) AS h0, max(added_lines + deleted_lines) AS h1,
               min(bugfix_count) AS b0, max(bugfix_count) AS b1, min({size}) AS s0, max({size}) AS s1 FROM files),
parts AS (SELECT f.*, 0.2e0 * {_norm("commit_count", "c0", "c1")} AS p_commit, 0.2e0 * {_norm("(added_lines + deleted_lines)", "h0", "h1")} AS p_churn,
  0.15e0 * exp(-ln(2e0) / 30e0 * greatest(0e0, (epoch(TIMESTAMP '{bridge.UNTIL}') - epoch(last_modified)) / 86400e0)) AS p_recency,
  0.1e0 * burst_score AS p_burst, 0.1e0 * (1e0 - ownership_ratio) AS p_ownership, 0.15e0 * {_norm("bugfix_count", "b0", "b1")} AS p_bugfix,
  {weight}e0 * {_norm(size, "s0", "s1")} AS p_complexity FROM files f CROSS JOIN ctx),
scored AS (SELECT *, greatest(0e0, least(1e0, p_commit + p_churn + p_recency + p_burst + p_ownership + p_bugfix + p_complexity)) AS risk_score FROM parts)"""


BASE = f"WITH {_history()}, {_files()}"
FILE_COLUMNS = "path, commit_count, added_lines, deleted_lines, last_modified, contributor_count, round(ownership_ratio, 6) AS ownership_ratio, round(burst_score, 6) AS burst_score, bugfix_count"


def _until(df: DataFrame) -> DataFrame:
    return df.drop("last_modified_iso")


@query(f"WITH {_history()} SELECT sha, path, \"when\" AS at, author, message, kind, added, deleted FROM h")
def changes_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bridge.history(spark, sf_dir)
    return h.select("sha", "path", F.col("when").alias("at"), F.lower("author_email").alias("author"), "message", "kind", F.col("lines_added").alias("added"), F.col("lines_deleted").alias("deleted"))


def _timed(spark: SparkSession, sf_dir: str, path: str = "part") -> DataFrame:
    """Without the ISO form of times, which no query shows."""
    return bridge.history(spark, sf_dir, path).drop("when_iso")


def _hotspots(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return reports.hotspots(_timed(spark, sf_dir), CONFIG, bridge.UNTIL, **more)


@query(f"{BASE}, {_scored()} SELECT path, commit_count, contributor_count, bugfix_count, round(burst_score, 6) AS burst_score, round(risk_score, 6) AS risk_score FROM scored ORDER BY scored.risk_score DESC, path")
def file_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _hotspots(spark, sf_dir).select("path", "commit_count", "contributor_count", "bugfix_count", "burst_score", "risk_score")
    return rounded(scoring.ranked(items, "risk_score", "path"))


@query(f"{BASE}, {_scored()} SELECT path, round(risk_score, 6) AS risk_score, round(p_commit, 6) AS p_commit, round(p_churn, 6) AS p_churn, round(p_recency, 6) AS p_recency, round(p_burst, 6) AS p_burst, round(p_ownership, 6) AS p_ownership, round(p_bugfix, 6) AS p_bugfix, round(p_complexity, 6) AS p_complexity FROM scored")
def hotspots_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _hotspots(spark, sf_dir, explain=True)
    return rounded(items.select("path", "risk_score", *[F.col(f"breakdown.{p}").alias(f"p_{p}") for p in scoring.FILE_PARTS]))


@query(f"""WITH {_history()}, {_files(name="plain")}, sizes AS (SELECT concat(p_type, '/', p_brand, '/', p_name) AS path, max(p_size) AS line_count FROM part GROUP BY 1),
files AS (SELECT f.*, CAST(coalesce(s.line_count, 0) AS BIGINT) AS file_size FROM plain f LEFT JOIN sizes s ON f.path = s.path), {_scored("file_size", 0.1)}
SELECT path, file_size, round(risk_score, 6) AS risk_score FROM scored""")
def hotspots_with_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = bridge.read(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path")).agg(F.max("p_size").alias("line_count"))
    return rounded(_hotspots(spark, sf_dir, sizes=sizes).select("path", "file_size", "risk_score"))


@query(f"{BASE}, {_scored()}, best AS (SELECT * FROM scored ORDER BY scored.risk_score DESC, path LIMIT 50) SELECT count(*) AS total_files, count(*) FILTER (WHERE risk_score >= 0.7) AS high_risk_count, count(*) FILTER (WHERE risk_score >= 0.4 AND risk_score < 0.7) AS medium_risk_count, round(max(risk_score), 6) AS max_risk_score FROM best")
def ci_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the report's 50 first files, as the report counts them."""
    return rounded(scoring.ci_summary(scoring.ranked(_hotspots(spark, sf_dir), "risk_score", "path", top=50)))


@query(f"{BASE}, {_scored()} SELECT round(max(risk_score), 6) AS max_score, max(risk_score) >= 0.5 AS exceeded FROM scored")
def ci_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scoring.gate(_hotspots(spark, sf_dir), 0.5))


@query(f"""{BASE}, {_scored()}, diff AS (SELECT concat(p_type, '/', p_brand, '/', p_name) AS path FROM part WHERE p_size <= 5 UNION SELECT concat(p_type, '/', p_brand, '/', p_name) FROM part WHERE p_size = 50)
SELECT path, round(risk_score, 6) AS risk_score FROM scored WHERE path IN (SELECT path FROM diff)""")
def diff_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("/", "p_type", "p_brand", "p_name")
    part = bridge.read(spark, sf_dir, "part").filter("p_size <= 5 OR p_size = 50")
    diff = part.select(F.when(F.col("p_size") <= 5, name).alias("path"), F.when(F.col("p_size") == 50, name).alias("old_path"))
    return rounded(_hotspots(spark, sf_dir, diff=diff).select("path", "risk_score"))




@query(f"SELECT p_partkey, p_size, round({_norm('p_size', '1', '40')}, 6) AS wide, round({_norm('p_size', '5', '5')}, 6) AS flat FROM part")
def norm_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_size")
    return rounded(bridge.read(spark, sf_dir, "part").select("p_partkey", "p_size", scalars.norm_log(v, 1, 40).alias("wide"), scalars.norm_log(v, 5, 5).alias("flat")))


@query("SELECT s_suppkey, round(greatest(0e0, least(1e0, (s_acctbal + 500e0) / 5500e0)), 6) AS place, CASE WHEN s_acctbal > 0 THEN 1e0 ELSE 0e0 END AS flat FROM supplier")
def norm_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("s_acctbal")
    return rounded(bridge.read(spark, sf_dir, "supplier").select("s_suppkey", scalars.norm_minmax(v, -500, 5000).alias("place"), scalars.norm_minmax(v, 3, 3).alias("flat")))


@query("SELECT o_orderkey, round(exp(-ln(2e0) / 30e0 * greatest(0e0, (epoch(TIMESTAMP '2001-01-01') - epoch(o_orderdate)) / 86400e0)), 6) AS decay FROM orders")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = scalars.days_between(F.lit("2001-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return rounded(bridge.read(spark, sf_dir, "orders").select("o_orderkey", scalars.recency_decay(days, 30).alias("decay")))


@query("SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_discount >= 0.07e0 THEN 'high' WHEN l_discount >= 0.04e0 THEN 'medium' ELSE 'low' END AS level FROM lineitem")
def risk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", scalars.risk_level(F.col("l_discount"), 0.07, 0.04).alias("level"))


_PATHS = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN concat(p_type, chr(92), p_brand, chr(92), p_name) WHEN 2 THEN concat('/', p_type, '/', p_name) ELSE concat(p_type, '/', p_name) END AS path FROM part"


@query(f"""SELECT p_partkey, path, regexp_extract(s, '^(.+)/[^/]*$', 1) AS directory,
CASE WHEN regexp_extract(s, '^(.+)/[^/]*$', 1) = '' THEN '' WHEN s LIKE '/%' THEN regexp_extract(s, '^(.+)/[^/]*$', 1) ELSE split_part(s, '/', 1) END AS subsystem
FROM (SELECT *, replace(path, chr(92), '/') AS s FROM ({_PATHS}))""")
def path_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    back = F.concat("p_type", F.lit("\\"), "p_brand", F.lit("\\"), "p_name")
    path = F.when(k == 0, F.col("p_name")).when(k == 1, back).when(k == 2, F.concat(F.lit("/"), "p_type", F.lit("/"), "p_name")).otherwise(F.concat("p_type", F.lit("/"), "p_name"))
    rows = bridge.read(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    return rows.select("p_partkey", "path", scalars.directory(F.col("path")).alias("directory"), scalars.subsystem(F.col("path")).alias("subsystem"))


@query("""SELECT event_id, CASE WHEN length(m) > 100 THEN concat(substr(m, 1, 97), '...') ELSE m END AS message
FROM (SELECT event_id, split_part(concat(repeat(event_type, CAST(event_id % 30 AS INTEGER) + 1), chr(10), props), chr(10), 1) AS m FROM events)""")
def message_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    text = F.concat(F.expr("repeat(event_type, CAST(event_id % 30 AS INT) + 1)"), F.lit("\n"), "props")
    return e.select("event_id", scalars.first_line(text).alias("message"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS line_count FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bridge.read(spark, sf_dir, "documents").select("doc_id", scalars.line_count(F.col("text")).alias("line_count"))


@query(f"{BASE} SELECT {FILE_COLUMNS} FROM files")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_until(files.metrics(_timed(spark, sf_dir), bridge.PATTERNS)).drop("file_size"))


@query(f"WITH {_history()}, {_files()} SELECT path, contributor_count, round(ownership_ratio, 6) AS ownership_ratio FROM own")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = files.by_author(bridge.history(spark, sf_dir))
    return rounded(people.groupBy("path").agg(F.count("*").alias("contributor_count"), (F.max("n") / F.sum("n")).alias("ownership_ratio")))


@query(f"WITH {_history(SUPPLIER)}, {_files(days=30)} SELECT path, round(burst_score, 6) AS burst_score FROM bursts")
def burst_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(files.burst(bridge.history(spark, sf_dir, "supplier"), 30))


@query("""WITH e AS (SELECT concat('k/', json_extract_string(props, '$.k')) AS path, ts FROM events),
n AS (SELECT path, count(*) OVER (PARTITION BY path ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM e)
SELECT path, round(max(n) / CAST(count(*) AS DOUBLE), 6) AS burst_score FROM n GROUP BY path""")
def burst_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(files.burst(bridge.event_history(spark, sf_dir), 1))


@query(f"{BASE} SELECT path, bugfix_count FROM files WHERE bugfix_count > 0")
def bugfix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = files.by_author(bridge.history(spark, sf_dir), bridge.PATTERNS)
    return people.groupBy("path").agg(F.sum("fixes").alias("bugfix_count")).filter("bugfix_count > 0")


@query(f"WITH {_history()} SELECT count(DISTINCT sha) AS total_bugfixes FROM h WHERE fix")
def bugfix_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.bugfix_totals(bridge.history(spark, sf_dir), bridge.PATTERNS)


@query(f"""{BASE} SELECT min(commit_count) AS commit_min, max(commit_count) AS commit_max, min(added_lines + deleted_lines) AS churn_min, max(added_lines + deleted_lines) AS churn_max,
min(bugfix_count) AS bugfix_min, max(bugfix_count) AS bugfix_max, CAST(0 AS BIGINT) AS size_min, CAST(0 AS BIGINT) AS size_max FROM files""")
def file_norm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.file_context(files.metrics(_timed(spark, sf_dir), bridge.PATTERNS))


@query(f"WITH {_history()} SELECT path, count(*) AS n FROM h WHERE \"when\" >= TIMESTAMP '1997-01-01' AND \"when\" <= TIMESTAMP '1997-12-31' GROUP BY path")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.time_range(bridge.history(spark, sf_dir), "1997-01-01", "1997-12-31").groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {_history()} SELECT path, count(*) AS n FROM h WHERE (path LIKE 'PROMO%' OR path LIKE 'STANDARD%' OR path LIKE '%/Brand#1_/%') AND path NOT LIKE '%/Brand#12/%' GROUP BY path")
def glob_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.globs(bridge.history(spark, sf_dir), ["{PROMO,STANDARD}*/**", "**/Brand#1?/**"], ["**/Brand#12/**"])
    return kept.groupBy("path").agg(F.count("*").alias("n"))


_COMMITS = f"""{_history()}, rows AS (SELECT sha, added, deleted, CAST(added + deleted AS DOUBLE) AS c,
  nullif(lower(regexp_extract(path, '^(.+)/[^/]*$', 1)), '') AS folder, nullif(lower(split_part(path, '/', 1)), '') AS part FROM h),
agg AS (SELECT sha, count(*) AS file_count, count(DISTINCT folder) AS directory_count, greatest(count(DISTINCT part), 1) AS subsystem_count,
  CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(deleted) AS BIGINT) AS lines_deleted, sum(CASE WHEN c > 0 THEN c * log2(c) ELSE 0e0 END) AS w, sum(c) AS t FROM rows GROUP BY sha),
commits AS (SELECT sha, file_count, directory_count, subsystem_count, lines_added, lines_deleted,
  CASE WHEN file_count <= 1 THEN 0e0 WHEN t <= 0 THEN 1e0 ELSE greatest(0e0, least(1e0, (log2(t) - w / t) / log2(CAST(file_count AS DOUBLE)))) END AS change_entropy FROM agg)"""
_RISK = f"""{_COMMITS}, ctx AS (SELECT min(file_count) AS f0, max(file_count) AS f1, min(directory_count) AS d0, max(directory_count) AS d1, min(subsystem_count) AS s0, max(subsystem_count) AS s1,
  min(lines_added + lines_deleted) AS c0, max(lines_added + lines_deleted) AS c1 FROM commits),
scored AS (SELECT sha, greatest(0e0, least(1e0, 0.35e0 * (({_norm("file_count", "f0", "f1")} + {_norm("directory_count", "d0", "d1")} + {_norm("subsystem_count", "s0", "s1")}) / 3e0)
  + 0.35e0 * {_norm("(lines_added + lines_deleted)", "c0", "c1")} + 0.3e0 * change_entropy)) AS score FROM commits CROSS JOIN ctx),
risk AS (SELECT sha, round(score, 6) AS risk_score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS risk_level FROM scored)"""


@query(f"WITH {_COMMITS} SELECT sha, file_count, directory_count, subsystem_count, lines_added, lines_deleted, round(change_entropy, 6) AS change_entropy FROM commits")
def commit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = commits.metrics(bridge.history(spark, sf_dir))
    return rounded(m.select("sha", "file_count", "directory_count", "subsystem_count", "lines_added", "lines_deleted", "change_entropy"))


@query("""WITH e AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS c, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS t, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS sha, round(CASE WHEN max(n) = 1 THEN 0e0 WHEN max(t) = 0 THEN 1e0
  ELSE greatest(0e0, least(1e0, -sum(CASE WHEN c > 0 THEN CAST(c AS DOUBLE) / t * log2(CAST(c AS DOUBLE) / t) ELSE 0e0 END) / log2(CAST(max(n) AS DOUBLE)))) END, 6) AS change_entropy FROM e GROUP BY l_orderkey""")
def commit_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sha"), F.lit("a/b").alias("path"), F.col("l_quantity").cast("long").alias("lines_added"), F.lit(0).cast("long").alias("lines_deleted"))
    return rounded(commits.metrics(rows).select("sha", "change_entropy"))


def _commit_risk(spark: SparkSession, sf_dir: str, level: str | None) -> DataFrame:
    return rounded(reports.risky_commits(bridge.history(spark, sf_dir), CONFIG, level).select("sha", "risk_score", "risk_level"))


@query(f"WITH {_RISK} SELECT * FROM risk")
def commit_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit_risk(spark, sf_dir, None)


@query(f"WITH {_RISK} SELECT * FROM risk WHERE risk_level = 'high'")
def commit_risk_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit_risk(spark, sf_dir, "high")


@query(f"WITH {_RISK} SELECT * FROM risk WHERE risk_level IN ('high', 'medium')")
def commit_risk_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _commit_risk(spark, sf_dir, "medium")


@query(f"""WITH {_COMMITS} SELECT min(file_count) AS files_min, max(file_count) AS files_max, min(directory_count) AS folders_min, max(directory_count) AS folders_max, min(subsystem_count) AS parts_min,
max(subsystem_count) AS parts_max, min(lines_added + lines_deleted) AS churn_min, max(lines_added + lines_deleted) AS churn_max FROM commits""")
def commit_norm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.commit_context(commits.metrics(bridge.history(spark, sf_dir)))


def _coupled(path: str) -> str:
    return f"""{_history(path)}, d AS (SELECT DISTINCT sha, lower(path) AS f FROM h WHERE kind <> 'deleted'),
fit AS (SELECT sha FROM d GROUP BY sha HAVING count(*) BETWEEN 2 AND 50), e AS (SELECT d.* FROM d JOIN fit ON d.sha = fit.sha),
n AS (SELECT f, count(*) AS n FROM e GROUP BY f), t AS (SELECT count(*) AS total FROM fit),
p AS (SELECT a.f AS file_a, b.f AS file_b, count(*) AS co FROM e a JOIN e b ON a.sha = b.sha AND a.f < b.f GROUP BY 1, 2),
pairs AS (SELECT file_a, file_b, co AS co_commit_count, na.n AS file_a_commit_count, nb.n AS file_b_commit_count, CAST(co AS DOUBLE) / (na.n + nb.n - co) AS jaccard,
  CAST(co AS DOUBLE) / na.n AS confidence, (CAST(co AS DOUBLE) / total) / ((CAST(na.n AS DOUBLE) / total) * (CAST(nb.n AS DOUBLE) / total)) AS lift
  FROM p JOIN n na ON na.f = file_a JOIN n nb ON nb.f = file_b CROSS JOIN t)"""


_PAIR = "file_a, file_b, co_commit_count, file_a_commit_count, file_b_commit_count, round(jaccard, 6) AS jaccard, round(confidence, 6) AS confidence, round(lift, 6) AS lift"


@query(f"WITH {_coupled('p.p_brand')} SELECT {_PAIR} FROM pairs WHERE co_commit_count >= 3 AND jaccard >= 0.05")
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coupling.analyze(bridge.history(spark, sf_dir, "brand", by_commit=True), Coupling(min_jaccard_threshold=0.05))[0])


@query(f"WITH {_coupled('p.p_brand')} SELECT (SELECT total FROM t) AS total_commits, (SELECT count(*) FROM n) AS total_files, (SELECT count(*) FROM p) AS total_pairs")
def coupling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.analyze(bridge.history(spark, sf_dir, "brand", by_commit=True), Coupling())[1]


@query(f"WITH {_coupled(SUPPLIER)} SELECT {_PAIR} FROM pairs WHERE co_commit_count >= 3 AND jaccard >= 0.02 ORDER BY pairs.jaccard DESC, file_a, file_b LIMIT 50")
def coupling_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = coupling.analyze(bridge.history(spark, sf_dir, "supplier", by_commit=True), Coupling(min_jaccard_threshold=0.02))
    return rounded(coupling.top(pairs, 50))


_CANONICAL = "concat('supp/', k + CASE WHEN k + 3 - k % 4 <= (SELECT max(s_suppkey) + CASE WHEN max(s_suppkey) % 4 <> 3 THEN 1 ELSE 0 END FROM supplier) THEN 3 - k % 4 ELSE (SELECT max(s_suppkey) + CASE WHEN max(s_suppkey) % 4 <> 3 THEN 1 ELSE 0 END FROM supplier) - k END)"


@query(f"SELECT concat('supp/', k) AS path, {_CANONICAL} AS canonical FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 3 UNION SELECT s_suppkey + 1 FROM supplier WHERE s_suppkey % 4 <> 3)")
def rename_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.aliases(bridge.rename_edges(spark, sf_dir))
    edges = bridge.rename_edges(spark, sf_dir)
    every = edges.select("path").union(edges.select("old_path")).distinct()
    return every.join(found, "path", "left").select("path", F.coalesce("canonical", "path").alias("canonical"))


_RENAMED = _CANONICAL.replace("k +", "l.l_suppkey +").replace("k %", "l.l_suppkey %").replace("- k END", "- l.l_suppkey END")


@query(f"WITH {_history(_RENAMED)}, {_files()} SELECT {FILE_COLUMNS} FROM files")
def rename_file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.aliases(bridge.rename_edges(spark, sf_dir))
    return rounded(_until(files.metrics(_timed(spark, sf_dir, "supplier"), bridge.PATTERNS, aliases=found)).drop("file_size"))


_FEATURES = f"""{BASE}, {_scored()}, features AS (SELECT path, p_commit / 0.2e0 AS f1, p_churn / 0.2e0 AS f2, p_recency / 0.15e0 AS f3, burst_score AS f4, 1e0 - ownership_ratio AS f5, p_bugfix / 0.15e0 AS f6, bugfix_count > 0 AS is_bugfix FROM scored)"""


@query(f"{_FEATURES} SELECT path, round(f1, 6) AS f_commit, round(f2, 6) AS f_churn, round(f3, 6) AS f_recency, round(f4, 6) AS f_burst, round(f5, 6) AS f_ownership, round(f6, 6) AS f_bugfix, 0e0 AS f_complexity, is_bugfix FROM features")
def calibration_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.features(files.metrics(_timed(spark, sf_dir), bridge.PATTERNS), 30, bridge.UNTIL)
    return rounded(rows.select("path", *[F.col("features")[i].alias(f"f_{p}") for i, p in enumerate(scoring.FILE_PARTS)], "is_bugfix"))


@query(f"""{_FEATURES}, r AS (SELECT is_bugfix, row_number() OVER (ORDER BY round(0.3e0 * f1 + 0.3e0 * f2 + 0.2e0 * f4 + 0.2e0 * f5, 9) DESC, path) AS place, count(*) OVER () AS n FROM features)
SELECT round(count(*) FILTER (WHERE is_bugfix AND place <= ceil(n * 20 / 100e0)) / CAST(count(*) FILTER (WHERE is_bugfix) AS DOUBLE), 6) AS rate FROM r""")
def detection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calibration.features(files.metrics(_timed(spark, sf_dir), bridge.PATTERNS), 30, bridge.UNTIL)
    return rounded(calibration.detection_rate(rows, [0.3, 0.3, 0, 0.2, 0.2, 0, 0]))


@query()
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequential search, which SQL doesn't express."""
    r = reports.calibrated(_timed(spark, sf_dir), CONFIG, bridge.UNTIL)
    row = (r.total_files, r.bugfix_files, float(r.current_rate), float(r.recommended_rate), *[float(x) for x in astuple(r.recommended_weights)])
    return spark.createDataFrame([row], "total_files long, bugfix_files long, current_rate double, recommended_rate double, " + ", ".join(f"w_{p} double" for p in scoring.FILE_PARTS))
