"""Registered queries of trends, interfaces, unused symbols, fixes, caches, baselines, spans and clones, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import api, baseline, catalogue, comments, fixes, fixgraph, graph, reports, rules, scalars, similarity, trends, unused
from ..session import table
from ..sources import documents
from ..streaming import cache
from .catalog import _EDITS, _LINES, _edits, _lines, query

_DAYS = "D AS (SELECT event_type, ts::DATE AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)"


def _days(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_DAYS}, P AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, count(*) OVER (PARTITION BY event_type) AS c FROM D),
A AS (SELECT event_type, count(*) AS n, avg(v) FILTER (i <= c // 2) AS first, avg(v) FILTER (i > c // 2) AS second, var_samp(v) AS variance FROM P GROUP BY event_type),
C AS (SELECT *, coalesce(CASE WHEN first = 0 THEN CASE WHEN second = 0 THEN 0.0 ELSE 100.0 END ELSE (second - first) / first * 100 END, 0.0)::DOUBLE AS change FROM A)
SELECT *, CASE WHEN change > 10 THEN 'degrading' WHEN change < -10 THEN 'improving' ELSE 'stable' END AS direction FROM C""")
def trend_half_means(spark, sf):
    return trends.halves(_days(spark, sf), ["event_type"], ["day"], "v")


@query("""WITH M AS (SELECT o_custkey AS rule, o_orderdate AS day, o_totalprice AS ms FROM orders), P AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY day, ms) AS i, count(*) OVER (PARTITION BY rule) AS c FROM M),
A AS (SELECT rule, avg(ms) FILTER (i <= c // 2) AS first, avg(ms) FILTER (i > c // 2) AS second FROM P GROUP BY rule) SELECT rule, (second - first) / first * 100 AS change FROM A WHERE first > 0 AND (second - first) / first * 100 > 20""")
def regressions_by_rule(spark, sf):
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("rule"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("ms"))
    return trends.regressions(trends.halves(m, ["rule"], ["day", "ms"], "ms"), 20.0).select("rule", "change")


@query(f"""WITH {_DAYS}, P AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS i FROM D),
A AS (SELECT event_type, floor(avg(n) FILTER (i <= 3)) - floor(avg(n) FILTER (i BETWEEN 4 AND 6)) AS di, avg(v) FILTER (i BETWEEN 4 AND 6) - avg(v) FILTER (i <= 3) AS dq FROM P GROUP BY event_type)
SELECT event_type, CASE WHEN coalesce(di, 0) > 5 THEN 'degrading' WHEN coalesce(di, 0) < -5 THEN 'improving' ELSE 'stable' END AS issues, CASE WHEN coalesce(dq, 0) > 2 THEN 'degrading' WHEN coalesce(dq, 0) < -2 THEN 'improving' ELSE 'stable' END AS quality,
CASE WHEN coalesce(di, 0) > 5 THEN 'degrading' WHEN coalesce(di, 0) < -5 THEN 'improving' ELSE 'stable' END AS debt FROM A""")
def snapshot_directions(spark, sf):
    return trends.snapshot_trends(_days(spark, sf), ["event_type"], "day", "n", "v", "n")


@query("""WITH B AS (SELECT l_partkey AS rule, sum(l_extendedprice) AS before FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01' GROUP BY 1), A AS (SELECT l_partkey AS rule, sum(l_extendedprice) AS after FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' GROUP BY 1)
SELECT rule, before, after, CASE WHEN before = 0 THEN CASE WHEN after = 0 THEN 0.0 ELSE 100.0 END ELSE (after - before) / before * 100 END AS change, CASE WHEN B.rule IS NULL THEN 'new' WHEN A.rule IS NULL THEN 'removed' ELSE 'common' END AS state FROM B FULL JOIN A USING (rule)""")
def compare_sessions(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rule"), "l_extendedprice", (F.col("l_shipdate") < F.lit("1995-06-01").cast("timestamp")).alias("old"))
    of = lambda c: li.where(c).groupBy("rule").agg(F.sum("l_extendedprice").alias("v"))
    return trends.compare_sessions(of("old"), of("NOT old"), ["rule"], "v")


@query("SELECT event_type, user_id, count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, 2 - bit_count(grouping_id(event_type, user_id))::INTEGER AS level FROM events GROUP BY ROLLUP (event_type, user_id)")
def profile_rollup(spark, sf):
    return trends.profiles(table(spark, sf, "events"), ["event_type", "user_id"], "value").withColumn("level", F.col("level").cast("int"))


@query("SELECT l_suppkey AS file, l_returnflag AS rule, sum(l_quantity) AS ms FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL")
def merged_profiles(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("rule"), F.col("l_quantity").alias("ms"), "l_linestatus")
    return trends.merged_profiles([li, li.where("l_linestatus = 'F'")], ["file", "rule"], "ms")


@query("SELECT l_returnflag AS rule, count(*) AS runs, sum(l_linenumber)::BIGINT AS findings, sum(l_quantity) AS ms, max(l_quantity) AS longest FROM lineitem GROUP BY 1")
def rule_executions(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("rule"), "l_linenumber", "l_quantity")
    return trends.executions(li, "rule", "l_linenumber", "l_quantity").select("rule", "runs", "findings", "ms", "longest")


@query("SELECT count(*) AS runs, sum(value) AS total, avg(value) AS mean, max(value) AS peak, count(*) / sum(value) * 1000 AS throughput FROM events")
def metrics_summary(spark, sf):
    return trends.metrics_summary(table(spark, sf, "events"), "value")


@query("SELECT user_id AS rule, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1 ORDER BY avg(value), user_id LIMIT 10")
def fastest_rules(spark, sf):
    stats = table(spark, sf, "events").groupBy(F.col("user_id").alias("rule")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return trends.slowest(stats, 10, "mean", fastest=True)


@query("WITH S AS (SELECT p_brand AS name, sum(p_retailprice) AS ms FROM part GROUP BY 1) SELECT name, ms, ms / (SELECT sum(ms) FROM S) * 100 AS pct FROM S WHERE ms / (SELECT sum(ms) FROM S) * 100 >= 1")
def hot_spots(spark, sf):
    return trends.hot_spots(table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.sum("p_retailprice").alias("ms")))


@query("WITH T AS (SELECT event_type, sum(value) AS total FROM events GROUP BY 1) SELECT event_type, total, CASE WHEN max(total) OVER () = min(total) OVER () THEN 0.0 ELSE (total - min(total) OVER ()) / (max(total) OVER () - min(total) OVER ()) END AS scaled, round(total / sum(total) OVER () * 100, 1) AS pct FROM T")
def category_heat(spark, sf):
    return trends.category_heat(table(spark, sf, "events"), "event_type", "value")


@query("""WITH F AS (SELECT l_suppkey, sum(l_quantity) AS t FROM lineitem GROUP BY 1 ORDER BY t DESC, l_suppkey LIMIT 20), R AS (SELECT l_returnflag, sum(l_quantity) AS t FROM lineitem GROUP BY 1 ORDER BY t DESC, l_returnflag LIMIT 2)
SELECT F.l_suppkey, R.l_returnflag, coalesce((SELECT sum(l_quantity) FROM lineitem x WHERE x.l_suppkey = F.l_suppkey AND x.l_returnflag = R.l_returnflag), 0) AS total FROM F, R""")
def file_rule_heat(spark, sf):
    return trends.file_rule_heat(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag", "l_quantity", 20, 2)


_SYMBOLS = "SELECT p_name || '.' || (p_partkey % 400) AS symbol, min(p_type || p_size) AS signature FROM part"


def _symbols(spark, sf, old):
    p = table(spark, sf, "part").where("p_size <= 40" if old else "p_size >= 10")
    return p.groupBy(F.concat(F.col("p_name"), F.lit("."), (F.col("p_partkey") % 400).cast("string")).alias("symbol")).agg(F.min(F.concat("p_type", F.col("p_size").cast("string"))).alias("signature"))


_API = f"""WITH B AS ({_SYMBOLS} WHERE p_size <= 40 GROUP BY 1), A AS ({_SYMBOLS} WHERE p_size >= 10 GROUP BY 1),
C AS (SELECT symbol, CASE WHEN A.symbol IS NULL THEN 'removed' WHEN B.symbol IS NULL THEN 'added' WHEN A.signature <> B.signature THEN 'changed' END AS change, B.signature AS before, A.signature AS after FROM B FULL JOIN A USING (symbol))"""


@query(_API + " SELECT symbol, change, before, after, CASE WHEN change = 'added' THEN 1 ELSE 2 END AS bump FROM C WHERE change IS NOT NULL")
def api_changes(spark, sf):
    return api.compare_symbols(_symbols(spark, sf, True), _symbols(spark, sf, False))


@query(_API + " SELECT count(*) FILTER (change IN ('removed', 'changed')) AS breaking, count(*) FILTER (change = 'added') AS additions, 0::BIGINT AS other, CASE WHEN count(*) FILTER (change IN ('removed', 'changed')) > 0 THEN 'major' WHEN count(change) > 0 THEN 'minor' ELSE 'patch' END AS bump FROM C")
def api_bump(spark, sf):
    return api.summarize_changes(api.compare_symbols(_symbols(spark, sf, True), _symbols(spark, sf, False)))


@query("""WITH V AS (SELECT p_partkey, (p_size % 4) || '.' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '.' || (p_size % 5) ELSE '' END AS a, 'v' || (p_partkey % 4) || '.' || (p_size % 3) AS b FROM part),
N AS (SELECT p_partkey, list_transform(string_split(a, '.'), lambda x: x::INT) AS x, list_transform(string_split(b[2:], '.'), lambda x: x::INT) AS y FROM V), M AS (SELECT p_partkey, [x[1], x[2], coalesce(x[3], 0)] AS x, [y[1], y[2], 0] AS y FROM N)
SELECT p_partkey, CASE WHEN x < y THEN -1 WHEN x > y THEN 1 ELSE 0 END AS cmp FROM M""")
def version_order(spark, sf):
    a = F.expr("concat(p_size % 4, '.', p_partkey % 3, CASE WHEN p_partkey % 2 = 0 THEN concat('.', p_size % 5) ELSE '' END)")
    b = F.expr("concat('v', p_partkey % 4, '.', p_size % 3)")
    return table(spark, sf, "part").select("p_partkey", api.compare_versions(a, b).alias("cmp"))


_GRAPH = """S AS (SELECT 'M' || (c_nationkey) || '.' || CASE WHEN c_custkey % 11 = 0 THEN '$f' WHEN c_custkey % 7 = 0 THEN 'T' ELSE 'f' END || c_custkey AS name, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 > 0 THEN 'type' ELSE 'function' END AS kind, c_mktsegment AS file, c_custkey AS line, c_custkey % 5 = 0 AS th, c_custkey FROM customer),
E AS (SELECT a.name AS src, b.name AS dst FROM S a JOIN S b ON b.c_custkey = a.c_custkey * 2 OR b.c_custkey = a.c_custkey * 3)"""


def _symbol_graph(spark, sf):
    name = F.expr("concat('M', c_nationkey, '.', CASE WHEN c_custkey % 11 = 0 THEN '$f' WHEN c_custkey % 7 = 0 THEN 'T' ELSE 'f' END, c_custkey)")
    s = table(spark, sf, "customer").select(name.alias("name"), F.expr("CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 > 0 THEN 'type' ELSE 'function' END").alias("kind"), F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("line"), F.lit(1).alias("col"), F.expr("c_custkey % 5 = 0").alias("th"))
    a = s.select(F.col("name").alias("src"), F.explode(F.array(F.col("line") * 2, F.col("line") * 3)).alias("line"))
    return s, a.join(s.select("line", F.col("name").alias("dst")), "line").select("src", "dst")


_REACHED = "R(name) AS (SELECT name FROM S WHERE regexp_matches(name, '^M[0-5]\\.f') OR regexp_matches(name, '\\.\\$[fc]') UNION SELECT dst FROM R JOIN E ON src = name)"


@query(f"WITH RECURSIVE {_GRAPH}, {_REACHED}, U AS (SELECT * FROM S WHERE NOT th AND name NOT IN (SELECT name FROM R)) SELECT name, 'function' AS finding, file, line, 1 AS col, 0.9::DOUBLE AS confidence FROM U WHERE kind = 'function' UNION ALL SELECT name, 'type', file, line, 1, 0.85 FROM U WHERE kind = 'type' UNION ALL SELECT name, 'field', file, line, 1, 0.7 FROM U WHERE kind = 'function'")
def unused_symbols(spark, sf):
    s, e = _symbol_graph(spark, sf)
    return unused.detect(s, e, [r"^M[0-5]\.f"]).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH RECURSIVE {_GRAPH}, {_REACHED}, U AS (SELECT * FROM S WHERE NOT th AND name NOT IN (SELECT name FROM R)), X AS (SELECT 'function' AS finding, 0.9 AS confidence FROM U WHERE kind = 'function' UNION ALL SELECT 'type', 0.85 FROM U WHERE kind = 'type' UNION ALL SELECT 'field', 0.7 FROM U WHERE kind = 'function') SELECT count(*) AS total, count(*) FILTER (confidence >= 0.8) AS sure, count(*) FILTER (confidence >= 0.8 AND finding = 'function') AS fixable FROM X")
def unused_stats(spark, sf):
    s, e = _symbol_graph(spark, sf)
    return unused.stats(unused.detect(s, e, [r"^M[0-5]\.f"]))


_FIX = "FX AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY fix, lo, hi) AS id, repeat('x', (hi - lo) - CASE WHEN fix % 2 = 0 THEN 0 ELSE 1 END) AS text FROM X)"


def _fixes(spark, sf):
    from pyspark.sql import Window

    e = _edits(spark, sf).withColumn("id", F.row_number().over(Window.partitionBy("file").orderBy("fix", "lo", "hi")))
    text = F.expr("repeat('x', (hi - lo) - CASE WHEN fix % 2 = 0 THEN 0 ELSE 1 END)")
    return e.withColumn("text", text).withColumn("edits", F.lit(1)).withColumn("rule", F.concat(F.lit("r"), F.col("fix").cast("string"))).drop("fix").withColumnRenamed("id", "fix")


@query(f"WITH {_EDITS}, {_FIX}, E AS (SELECT file, lo AS pl, 1 AS o, id, NULL AS ends FROM FX UNION ALL SELECT file, hi, 0, NULL, id FROM FX WHERE length(text) <> hi - lo), W AS (SELECT file, id, last_value(ends IGNORE NULLS) OVER (PARTITION BY file ORDER BY pl, o, ends NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dst FROM E) SELECT file, id AS src, dst FROM W WHERE id IS NOT NULL AND dst IS NOT NULL AND dst <> id")
def positional_dependencies(spark, sf):
    return fixgraph.positional(_fixes(spark, sf))


@query(f"WITH {_EDITS}, {_FIX} SELECT DISTINCT a.file, a.id AS src, b.id AS dst FROM FX a JOIN FX b ON a.file = b.file AND a.fix = 3 AND b.fix IN (1, 2)")
def rule_dependencies(spark, sf):
    return fixgraph.by_rules(_fixes(spark, sf), spark.createDataFrame([("r3", "r1"), ("r3", "r2")], "rule string, needs string"))


@query(f"WITH {_EDITS}, G AS (SELECT file, fix, max(preferred::INT) AS p, sum(hi - lo) AS w FROM X GROUP BY ALL), C AS (SELECT DISTINCT a.file, a.fix AS x1, b.fix AS x2 FROM X a JOIN X b ON a.file = b.file AND a.fix < b.fix AND a.lo < b.hi AND b.lo < a.hi), K AS (SELECT C.file, CASE WHEN g2.w < g1.w THEN x1 ELSE x2 END AS fix FROM C JOIN G g1 ON g1.file = C.file AND g1.fix = x1 JOIN G g2 ON g2.file = C.file AND g2.fix = x2) SELECT count(*) FILTER (k.fix IS NULL) AS kept, count(*) FILTER (k.fix IS NOT NULL) AS dropped FROM X LEFT JOIN (SELECT DISTINCT * FROM K) k ON k.file = X.file AND k.fix = X.fix")
def conflict_prefer_smaller(spark, sf):
    e = _edits(spark, sf).withColumn("edits", F.lit(1))
    out = fixgraph.resolve(e, fixes.overlaps(e), "prefer_smaller")
    return out.agg(F.sum(F.col("apply").cast("long")).alias("kept"), F.sum((~F.col("apply")).cast("long")).alias("dropped"))


@query("SELECT kind, severity, file, count(*) AS n FROM (SELECT l_returnflag AS kind, l_linenumber AS severity, l_suppkey AS file FROM lineitem) GROUP BY GROUPING SETS ((kind), (severity), (file))")
def conflict_summary(spark, sf):
    return fixgraph.conflict_summary(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("severity"), F.col("l_suppkey").alias("file")))


@query("SELECT count(*) AS files, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'error') AS error, sum(a)::BIGINT AS applied, sum(b)::BIGINT AS skipped, sum(c)::BIGINT AS failed, max(i) AS iterations FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'unchanged' ELSE 'error' END AS status, o_orderkey % 7 AS a, o_orderkey % 3 AS b, o_orderkey % 2 AS c, o_orderkey % 11 AS i FROM orders)")
def batch_fix_stats(spark, sf):
    o = table(spark, sf, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'unchanged' ELSE 'error' END AS status", "o_orderkey % 7 AS applied", "o_orderkey % 3 AS skipped", "o_orderkey % 2 AS failed", "o_orderkey % 11 AS iterations")
    return fixgraph.batch_stats(o)


_CACHE = "C AS (SELECT 'f' || o_orderkey AS path, o_orderstatus AS sha256, o_orderdate AS stored, o_custkey AS result FROM orders WHERE o_orderkey % 3 <> 0)"


@query(f"WITH {_CACHE}, K AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS sha256 FROM orders) SELECT path, CASE WHEN stored IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '1996-01-01') - epoch(stored::TIMESTAMP) > 31536000 THEN 'stale' ELSE 'hit' END AS state, result FROM K LEFT JOIN C USING (path, sha256)")
def cache_lookup(spark, sf):
    return cache.lookup(*_cache(spark, sf), "1996-01-01 00:00:00", 31536000)


def _cache(spark, sf):
    o, path = table(spark, sf, "orders"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path")
    held = o.where("o_orderkey % 3 <> 0").select(path, F.col("o_orderstatus").alias("sha256"), F.col("o_orderdate").alias("stored"), F.col("o_custkey").alias("result"))
    return o.select(path, F.expr("CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END").alias("sha256")), held


@query(f"WITH {_CACHE}, K AS (SELECT 'f' || o_orderkey AS path, CASE WHEN o_custkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS sha256 FROM orders), L AS (SELECT path, CASE WHEN stored IS NULL THEN 'miss' WHEN epoch(TIMESTAMP '1996-01-01') - epoch(stored::TIMESTAMP) > 31536000 THEN 'stale' ELSE 'hit' END AS state FROM K LEFT JOIN C USING (path, sha256)) SELECT count(*) AS requests, count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'miss') AS misses, count(DISTINCT path) AS paths, count(*) FILTER (state = 'hit') / count(*) AS hit_rate FROM L")
def cache_counters(spark, sf):
    return cache.counters(cache.lookup(*_cache(spark, sf), "1996-01-01 00:00:00", 31536000))


@query("SELECT path FROM (SELECT 'f' || o_orderkey AS path, o_orderdate AS used, o_custkey AS size, row_number() OVER (ORDER BY epoch(o_orderdate::TIMESTAMP)::BIGINT DESC, 'f' || o_orderkey) AS n FROM orders) QUALIFY n <= 1000 AND sum(size) OVER (ORDER BY n) <= 300000")
def cache_eviction(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderdate").alias("used"), F.col("o_custkey").alias("size"))
    return cache.evict(o, 1000, 300000).select("path")


@query(f"WITH {_CACHE} SELECT count(*) AS n FROM C WHERE epoch(TIMESTAMP '1996-01-01') - epoch(stored::TIMESTAMP) <= 31536000")
def cache_compaction(spark, sf):
    return cache.compact(_cache(spark, sf)[1], "1996-01-01 00:00:00", 31536000).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT substr(sha256(coalesce(l_suppkey::VARCHAR, '') || '|' || coalesce(l_returnflag, '') || '|' || coalesce(l_linestatus, '')), 1, 16) AS fingerprint, count(*) AS n FROM lineitem GROUP BY 1")
def baseline_fingerprints(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("message"))
    return baseline.fingerprint(d).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))


_FOUND = "SELECT l_suppkey::VARCHAR AS file, l_returnflag AS rule, l_shipdate::DATE::VARCHAR AS message, l_linenumber + (l_partkey % 50) * 10 AS line, l_linestatus FROM lineitem"


def _found(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_returnflag").alias("rule"), F.to_date("l_shipdate").cast("string").alias("message"), F.expr("int(l_linenumber + (l_partkey % 50) * 10)").alias("line"), "l_linestatus")


@query(f"WITH X AS ({_FOUND}), B AS (SELECT * FROM X WHERE l_linestatus = 'F'), N AS (SELECT * FROM X WHERE l_linestatus = 'O') SELECT rule, count(*) FILTER (known) AS known, count(*) FILTER (NOT known) AS fresh FROM (SELECT rule, EXISTS (SELECT 1 FROM B WHERE B.file = N.file AND B.rule = N.rule AND (B.message = N.message OR abs(B.line - N.line) <= 3)) AS known FROM N) GROUP BY rule")
def baseline_known(spark, sf):
    d = _found(spark, sf)
    c = baseline.categorize(d.where("l_linestatus = 'O'"), d.where("l_linestatus = 'F'"))
    return c.groupBy("rule").agg(F.sum(F.col("known").cast("long")).alias("known"), F.sum((~F.col("known")).cast("long")).alias("fresh"))


@query("SELECT substr(sha256(l_returnflag || l_linestatus || l_linenumber || l_partkey), 1, 16) AS hash, count(*) AS n FROM lineitem GROUP BY 1")
def exact_hashes(spark, sf):
    h = scalars.exact_hash(F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber"), F.col("l_partkey"))
    return table(spark, sf, "lineitem").groupBy(h.alias("hash")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, max(CASE WHEN ms < 1 THEN printf('%.2fµs', ms * 1000.0) WHEN ms < 1000 THEN printf('%.2fms', ms) WHEN ms < 60000 THEN printf('%.2fs', ms / 1000.0) ELSE printf('%.2fm', ms / 60000.0) END) AS longest FROM (SELECT user_id, floor(value * 97) AS ms FROM events) GROUP BY 1")
def formatted_durations(spark, sf):
    ms = F.col("value") * 97
    down = F.when(F.rint(ms) > ms, F.rint(ms) - 1).otherwise(F.rint(ms))  # floor() of Spark gives a long, without NaN and infinities
    e = table(spark, sf, "events").select("user_id", down.alias("ms"))
    return e.groupBy("user_id").agg(F.max(scalars.format_duration(F.col("ms"))).alias("longest"))


@query("SELECT s_suppkey, CASE WHEN length(s_name) <= 8 THEN repeat('*', length(s_name)) ELSE s_name[:4] || repeat('*', length(s_name) - 4) END AS masked FROM supplier")
def masked_secrets(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", scalars.mask_secret(F.col("s_name")).alias("masked"))


@query(f"WITH {_LINES} SELECT count(*) AS n, sum(CASE WHEN contains(x, '--') THEN 1 ELSE 0 END)::BIGINT AS dashes, sum((length(x) - length(replace(x, 'the', ''))) // 3)::BIGINT AS hits FROM (SELECT regexp_replace(text, '\"(?:[^\"\\\\]|\\\\.)*\"', '\"\"', 'g') AS x FROM L)")
def stripped_strings(spark, sf):
    x = comments.strip_strings(F.col("text"))
    d = _lines(spark, sf).select(x.alias("x"))
    hits = F.floor((F.length("x") - F.length(F.replace("x", F.lit("the"), F.lit("")))) / 3)
    return d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").contains("--").cast("long")).alias("dashes"), F.sum(hits).alias("hits"))


_MANY = [rules.Rule(f"w{i}", w, severity=i % 4, category="many") for i, w in enumerate("the of and to in is that with for on as at by from an be this are was not or but all one they have had which you their".split())]
_MANY += [rules.Rule(f"digit-{i}", str(i), severity=3, category="digits") for i in range(100, 200)]


@query(f"WITH {_LINES}, R AS (" + " UNION ALL ".join(f"SELECT '{r.id}' AS rule, '{r.pattern}' AS w, {r.severity} AS severity" for r in _MANY) + "), T AS (SELECT DISTINCT file_id, line_no, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM L) SELECT rule, severity, count(*) AS n, count(DISTINCT file_id) AS files FROM T JOIN R USING (w) GROUP BY ALL")
def rule_table_hits(spark, sf):
    """More rules than one expression holds: the table of rules with its scan for literals, the configurable rules among them."""
    d = _lines(spark, sf)
    hits = rules.match(d, _MANY + catalogue.configurable())
    return hits.where(F.col("category").isin("many", "digits")).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


@query("""WITH A AS (SELECT l_orderkey AS k, least(l_linenumber, 4)::INT AS l1, (l_partkey % 9 + 1)::INT AS c1, (least(l_linenumber, 4) + l_suppkey % 3)::INT AS l2, (l_suppkey % 9 + 1)::INT AS c2 FROM lineitem),
P AS (SELECT a.k, [a.l1, a.c1] AS alo, [a.l2, a.c2] AS ahi, [b.l1, b.c1] AS blo, [b.l2, b.c2] AS bhi FROM A a JOIN A b ON a.k = b.k) SELECT count(*) AS pairs, count(*) FILTER (alo < bhi AND blo < ahi) AS overlapping, sum(greatest(ahi, bhi)[1] - least(alo, blo)[1])::BIGINT AS lines FROM P""")
def span_overlaps_2d(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), scalars.span(F.expr("least(l_linenumber, 4)"), F.expr("l_partkey % 9 + 1"), F.expr("least(l_linenumber, 4) + l_suppkey % 3"), F.expr("l_suppkey % 9 + 1")).alias("s"))
    j = a.join(a.withColumnRenamed("s", "t"), "k")
    m = scalars.merge_spans(F.col("s"), F.col("t"))
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.sum(scalars.spans_overlap(F.col("s"), F.col("t")).cast("long")).alias("overlapping"), F.sum(m["hi"]["line"] - m["lo"]["line"]).alias("lines"))


@query("SELECT file, sum(lines)::BIGINT AS lines FROM (SELECT l_suppkey AS file, l_linenumber AS lines FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def clone_hotspots(spark, sf):
    return similarity.clone_hotspots(table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("lines")))


@query("WITH C AS (SELECT l_orderkey AS k, l_discount AS similarity, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'structural' ELSE 'similar' END AS kind, l_quantity AS places, l_linenumber AS clone FROM lineitem) SELECT k, clone FROM C QUALIFY row_number() OVER (PARTITION BY k ORDER BY similarity DESC, CASE kind WHEN 'exact' THEN 1 WHEN 'structural' THEN 2 ELSE 3 END, places DESC, clone) = 1")
def best_clones(spark, sf):
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_discount").alias("similarity"), F.expr("CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'structural' ELSE 'similar' END").alias("kind"), F.col("l_quantity").alias("places"), F.col("l_linenumber").alias("clone"))
    return similarity.best_clone(c, ["k"]).select("k", "clone")


def _own_edges(spark, sf):
    from .catalog import _edges as nation_edges

    return nation_edges(spark, sf)


def _edges_sql():
    from .catalog import _EDGES as edges

    return edges


@query(f"WITH RECURSIVE {_edges_sql()}, R(node, path) AS (SELECT 'n0', ['n0'] UNION ALL SELECT dst, list_append(path, dst) FROM R JOIN E ON src = node WHERE NOT list_contains(path, dst) AND len(path) < 26) SELECT node, array_to_string(min_by(path, (len(path), path)), '>') AS path FROM R GROUP BY node")
def shortest_paths(spark, sf):
    d = graph.paths(_own_edges(spark, sf), spark.createDataFrame([("n0",)], "node string"))
    return d.select("node", F.concat_ws(">", "path").alias("path"))


@query(f"WITH RECURSIVE {_edges_sql()}, R(node, source) AS (SELECT n, n FROM (VALUES ('n3'), ('n7')) t(n) UNION SELECT src, source FROM R JOIN E ON dst = node) SELECT node, source FROM R")
def infected_modules(spark, sf):
    return graph.infected(_own_edges(spark, sf), spark.createDataFrame([("n3",), ("n7",)], "node string"))


@query(f"WITH {_edges_sql()}, C AS (SELECT src AS module, count(DISTINCT dst) AS ce FROM E GROUP BY 1), A AS (SELECT dst AS module, count(DISTINCT src) AS ca FROM E GROUP BY 1), M AS (SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) AS instability FROM C FULL JOIN A USING (module)), X AS (SELECT 'n' || c_nationkey AS module, avg(CASE WHEN regexp_matches(c_mktsegment, '^[A-F]') OR contains(c_mktsegment, '.') THEN 1.0 ELSE 0.0 END) AS a FROM customer GROUP BY 1) SELECT module, ca, ce, instability, coalesce(a, 0.0) AS abstractness, abs(coalesce(a, 0.0) + instability - 1) AS distance FROM M LEFT JOIN X USING (module)")
def main_sequence(spark, sf):
    names = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("module"), F.when(F.col("c_mktsegment").rlike("^[A-F]"), F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("name"))
    return graph.main_sequence(graph.coupling(_own_edges(spark, sf)), graph.abstractness(names))


@query(f"WITH {_edges_sql()} SELECT 'n' || n_nationkey AS file, count(DISTINCT src) AS dependents FROM nation LEFT JOIN E ON dst = 'n' || n_nationkey GROUP BY 1")
def files_by_dependents(spark, sf):
    files = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("file"))
    return graph.by_dependents(files, _own_edges(spark, sf))


_FINDINGS = "H AS (SELECT l_suppkey AS file_id, 's' || l_suppkey AS path, l_returnflag AS category, 'r' || l_linenumber AS rule, (l_partkey % 4)::INT AS severity FROM lineitem)"


def _findings(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"), F.col("l_returnflag").alias("category"), F.concat(F.lit("r"), F.col("l_linenumber").cast("string")).alias("rule"), F.expr("int(l_partkey % 4)").alias("severity"))


@query(f"WITH {_FINDINGS}, O(owner, prefix) AS (VALUES ('a', 's1'), ('b', 's12'), ('b', 's2'), ('c', 's')) SELECT owner, count(DISTINCT path) AS files, count(*) AS issues, count(*) FILTER (severity = 0) AS errors FROM (SELECT DISTINCT owner, path, o.n FROM O JOIN (SELECT path, 1 AS n FROM H GROUP BY path) o ON starts_with(path, prefix)) P JOIN H USING (path) GROUP BY owner")
def findings_by_owner(spark, sf):
    owners = spark.createDataFrame([("a", "s1"), ("b", "s12"), ("b", "s2"), ("c", "s")], "owner string, prefix string")
    return reports.owned(_findings(spark, sf), owners, "path")


@query(f"WITH {_FINDINGS}, S AS (SELECT count(*) AS issues, count(*) FILTER (severity = 0) AS errors FROM H), M AS (SELECT 'errors' AS metric, 100.0::DOUBLE AS target, errors::DOUBLE AS actual, errors <= 100 AS met FROM S UNION ALL SELECT 'issues', 1000000.0, issues, issues <= 1000000 FROM S UNION ALL SELECT 'quality', 50.0, 60.0, true FROM S) SELECT *, avg(met::INT) OVER () * 100 AS compliance FROM M")
def sla_report(spark, sf):
    one = _findings(spark, sf).agg(F.count(F.lit(1)).alias("issues"), reports.count_if(F.col("severity") == 0).alias("errors"), F.lit(60.0).alias("quality"))
    return reports.sla(one, 100, 1000000, 50.0)


@query(f"WITH {_FINDINGS} SELECT 9::BIGINT AS checks, 9 - count(DISTINCT rule) AS passed, count(*) FILTER (category = 'R') AS violations, (9 - count(DISTINCT rule)) / 9 * 100 AS score, CASE WHEN count(*) FILTER (category = 'R') > 0 THEN 'partial' ELSE 'failed' END AS status FROM H")
def compliance_report(spark, sf):
    checks = spark.createDataFrame([(f"r{i}",) for i in range(1, 10)], "rule string")
    return reports.compliance(_findings(spark, sf), checks, "R")


@query(f"WITH {_FINDINGS} SELECT category, count(DISTINCT file_id) AS files, count(*) AS issues, count(*) FILTER (severity = 0) AS errors, count(*) FILTER (severity = 1) AS warnings, count(*) FILTER (severity > 1) AS others FROM H GROUP BY ROLLUP (category)")
def project_reports(spark, sf):
    return reports.projects(_findings(spark, sf), "category")


@query(f"WITH {_FINDINGS} SELECT category, rule, count(*) AS n FROM H GROUP BY GROUPING SETS ((category), (rule), ())")
def findings_by_category_and_rule(spark, sf):
    return reports.by_category_and_rule(_findings(spark, sf))


@query(f"WITH {_FINDINGS} SELECT rule, severity, count(*) AS n FROM H GROUP BY ALL")
def merged_results(spark, sf):
    h = _findings(spark, sf)
    part = lambda c: h.where(c).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
    return reports.merged([part(F.col("category") == "R"), part(F.col("category") != "R")])


@query("SELECT part, concat_ws(':', file, line, col) AS place, value FROM (SELECT 1 AS part, l_suppkey::VARCHAR AS file, lpad(l_linenumber::VARCHAR, 10, '0') AS line, lpad((l_partkey % 90)::VARCHAR, 10, '0') AS col, l_suppkey || ':' || l_linenumber || ':' || (l_partkey % 90) || ': ' || CASE l_partkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' WHEN 2 THEN 'suggestion' ELSE 'info' END || ': [' || l_returnflag || '] ' || l_linestatus AS value FROM lineitem)")
def plain_report(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("string(l_suppkey) AS file", "l_linenumber AS line", "int(l_partkey % 90) AS col", "int(l_partkey % 4) AS severity", "l_returnflag AS rule", "l_linestatus AS message")
    return documents.plain_document(d).select("part", F.concat_ws(":", F.slice("place", 1, 3)).alias("place"), "value")
