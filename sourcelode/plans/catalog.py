"""All registered queries of the engine's own operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprlang import to_column
from ..operators import baseline, complexity, fixes, graph, imports, metrics, reports, rules, similarity, suppress
from ..session import table
from ..sources import sinks, text
from ..streaming import cache

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Rules of the shapes the tables hold: words, phrases, secrets, licences, addresses.
RULES = [
    rules.Rule("licence-line", "Released under the MIT License", "licence", 3, "licence"),
    rules.Rule("gpl", "GNU General Public License", "licence", 2, "licence"),
    rules.Rule("word-that", "that", "word", 3, "words"),
    rules.Rule("word-with", "with", "word", 3, "words", within=("src1*",), excepted=("src10",)),
    rules.Rule("hard-secret", r'token = "[0-9a-f]+"', "secret", 0, "security", regex=True),
    rules.Rule("e-mail", r"[a-z0-9.]+@[a-z0-9.]+", "address", 1, "privacy", regex=True),
    rules.Rule("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "address", 1, "privacy", regex=True),
    rules.Rule("pair", "$X of $Y", "pair", 3, "style"),
    rules.Rule("off", "the", "never", 0, "words", enabled=False),
]
_LINES = """
L AS (SELECT doc_id AS file_id, source, unnest(range(1, len(t) + 1)) AS line_no, unnest(t) AS text FROM (
  SELECT doc_id, source, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS t FROM documents WHERE length(text) > 0))"""
_LINES = _LINES.replace("regexp_replace(text, '\\\\n$', '')", "CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END")


#: The rules' expressions for the SQL side, written apart from the compiler.
_SQL_PATTERNS = {
    "licence-line": r"\bReleased under the MIT License\b", "gpl": r"\bGNU General Public License\b", "word-that": r"\bthat\b", "word-with": r"\bwith\b",
    "hard-secret": r'token = "[0-9a-f]+"', "e-mail": r"[a-z0-9.]+@[a-z0-9.]+", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "pair": r"[a-zA-Z_][a-zA-Z0-9_']* of [a-zA-Z_][a-zA-Z0-9_']*",
}


def _rule_sql() -> str:
    parts = []
    for r in RULES:
        if not r.enabled:
            continue
        scope = " AND starts_with(source, 'src1') AND source <> 'src10'" if r.within else ""
        x = _SQL_PATTERNS[r.id].replace("'", "''")
        parts.append(f"SELECT file_id, source, line_no, '{r.id}' AS rule, '{r.category}' AS category, {r.severity} AS severity, regexp_extract(text, '{x}') AS matched, text FROM L WHERE regexp_matches(text, '{x}'){scope}")
    return f"WITH {_LINES}, H AS ({' UNION ALL '.join(parts)})"


_H = _rule_sql()


def _lines(spark, sf):
    d = table(spark, sf, "documents")
    return text.lines(d)


def _hits(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    body = F.when(F.col("text").endswith("\n"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    of = d.where(F.length("text") > 0).select(F.col("doc_id").alias("file_id"), "source", F.posexplode(F.split(body, "\n")).alias("at", "text")).withColumn("line_no", F.col("at") + 1)
    return rules.match(of, RULES, scope="source")


@query(_H + " SELECT rule, severity, count(*) AS n, count(DISTINCT file_id) AS files FROM H GROUP BY ALL")
def rule_hits_by_rule(spark, sf):
    return _hits(spark, sf).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_id").alias("files"))


@query(_H + " SELECT severity, category, count(*) AS n FROM H GROUP BY ALL")
def rule_hits_by_severity(spark, sf):
    return _hits(spark, sf).groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT rule, sum(strpos(text, matched)) AS cols FROM H WHERE category IN ('security', 'licence') GROUP BY rule")
def first_match_column(spark, sf):
    return _hits(spark, sf).where(F.col("category").isin("security", "licence")).groupBy("rule").agg(F.sum("col").alias("cols"))


@query(f"WITH {_LINES} SELECT regexp_extract(text, '([A-Za-z_][A-Za-z0-9_'']*) of ([A-Za-z_][A-Za-z0-9_'']*)', 1) AS x, count(*) AS n FROM L WHERE regexp_matches(text, '([A-Za-z_][A-Za-z0-9_'']*) of ([A-Za-z_][A-Za-z0-9_'']*)') GROUP BY 1")
def metavar_capture(spark, sf):
    hits = rules.match(_lines(spark, sf), [rules.Rule("pair", "$X of $Y")])
    return hits.groupBy(F.col("captures")["$X"].alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT source, count(*) AS n FROM H WHERE rule = 'word-with' GROUP BY source")
def within_except_scope(spark, sf):
    return _hits(spark, sf).where("rule = 'word-with'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT rule, CASE WHEN rule = 'ip' THEN 0 WHEN category = 'words' THEN 2 ELSE severity END AS severity, count(*) AS n FROM H GROUP BY ALL")
def effective_severity(spark, sf):
    return rules.effective_severity(_hits(spark, sf), {"ip": 0}, {"words": 2}).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT rule, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, row_number() OVER (ORDER BY count(*) DESC, rule) AS place FROM H GROUP BY rule")
def category_percent(spark, sf):
    by = _hits(spark, sf).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row per rule at most
    return by.select("rule", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"), F.row_number().over(Window.orderBy(F.desc("n"), "rule")).cast("long").alias("place"))


@query(_H + " SELECT rule, severity, source, count(*) AS n, grouping_id(rule, severity, source)::BIGINT AS g FROM H GROUP BY GROUPING SETS ((rule), (severity), (source), ())")
def stats_grouping_sets(spark, sf):
    _hits(spark, sf).createOrReplaceTempView("_hits")
    return spark.sql("SELECT rule, severity, source, count(*) AS n, grouping_id(rule, severity, source) AS g FROM _hits GROUP BY GROUPING SETS ((rule), (severity), (source), ())")


@query(_H + " SELECT source, category, count(*) AS n FROM H GROUP BY ROLLUP (source, category)")
def stats_rollup(spark, sf):
    return _hits(spark, sf).rollup("source", "category").agg(F.count(F.lit(1)).alias("n"))


@query(_H + " SELECT category, severity, count(*) AS n FROM H GROUP BY CUBE (category, severity)")
def stats_cube(spark, sf):
    return _hits(spark, sf).cube("category", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(_H + ", S AS (SELECT file_id, 1 + file_id % 3 AS lo, 1 + file_id % 3 + file_id % 2 AS hi, CASE WHEN file_id % 4 = 0 THEN 'word' END AS part FROM (SELECT doc_id AS file_id FROM documents WHERE doc_id % 2 = 0)) SELECT rule, count(*) AS n FROM H WHERE NOT EXISTS (SELECT 1 FROM S WHERE S.file_id = H.file_id AND line_no BETWEEN lo AND hi AND (part IS NULL OR contains(rule, part))) GROUP BY rule")
def suppress_range_anti(spark, sf):
    d = table(spark, sf, "documents").where("doc_id % 2 = 0")
    spans = d.select(F.col("doc_id").alias("file_id"), F.expr("1 + doc_id % 3").alias("lo"), F.expr("1 + doc_id % 3 + doc_id % 2").alias("hi"), F.expr("CASE WHEN doc_id % 4 = 0 THEN array('word') END").alias("rules"))
    return suppress.suppress(_hits(spark, sf), spans).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH D AS (SELECT l_orderkey AS file_id, (l_partkey % 97)::INTEGER AS line_no, CASE WHEN l_returnflag = 'N' THEN 'disable' ELSE 'enable' END AS kind FROM lineitem),
S AS (SELECT file_id, line_no AS lo, coalesce((SELECT min(e.line_no) FROM D e WHERE e.file_id = D.file_id AND e.kind = 'enable' AND e.line_no > D.line_no) - 1, 2147483647) AS hi FROM D WHERE kind = 'disable')
SELECT lo, hi, count(*) AS n FROM S GROUP BY ALL""")
def suppress_enable_disable(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.expr("int(l_partkey % 97)").alias("line_no"), F.expr("CASE WHEN l_returnflag = 'N' THEN 'disable' ELSE 'enable' END").alias("kind"), F.lit(None).cast("array<string>").alias("rules"))
    return suppress.intervals(d).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


_OLD = "SELECT l_suppkey::VARCHAR AS file, l_returnflag AS rule, l_linestatus AS message, l_linenumber AS line FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'"
_NEW = "SELECT l_suppkey::VARCHAR AS file, l_returnflag AS rule, l_linestatus AS message, l_linenumber AS line FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01'"


@query(f"WITH B AS ({_OLD}), X AS ({_NEW}), P AS (SELECT file, rule, message, count(*) AS n FROM X GROUP BY ALL), Q AS (SELECT file, rule, message, count(*) AS m FROM B GROUP BY ALL) SELECT rule, sum(least(coalesce(n, 0), coalesce(m, 0)))::BIGINT AS existing, sum(greatest(coalesce(n, 0) - coalesce(m, 0), 0))::BIGINT AS new, sum(greatest(coalesce(m, 0) - coalesce(n, 0), 0))::BIGINT AS resolved FROM P FULL JOIN Q USING (file, rule, message) GROUP BY rule")
def baseline_hash_match(spark, sf):
    """One-to-one pairing by fingerprint through row numbers and a full outer join."""
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("file"), F.col("l_returnflag").alias("rule"), F.col("l_linestatus").alias("message"), F.col("l_linenumber").alias("line"), "l_shipdate")
    key = ["file", "rule", "message"]
    number = F.row_number().over(Window.partitionBy(*key).orderBy("line"))
    new = d.where("l_shipdate >= TIMESTAMP '1995-06-01'").withColumn("n", number)
    old = d.where("l_shipdate < TIMESTAMP '1995-06-01'").withColumn("n", number)
    j = new.select(*key, "n", F.lit(1).alias("a")).join(old.select(*key, "n", F.lit(1).alias("b")), [*key, "n"], "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    return j.groupBy("rule").agg(count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("existing"), count(F.col("b").isNull()).alias("new"), count(F.col("a").isNull()).alias("resolved"))


@query("WITH X AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), B AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F') SELECT count(*) AS n FROM X WHERE EXISTS (SELECT 1 FROM B WHERE B.o_custkey = X.o_custkey AND abs(B.o_orderkey - X.o_orderkey) <= 300)")
def baseline_band_match(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    b = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))
    return o.where("o_orderstatus = 'O'").join(b, (F.col("o_custkey") == F.col("c")) & (F.abs(F.col("k") - F.col("o_orderkey")) <= 300), "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def semi_exists(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1")
def anti_missing(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_T = "count(value) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, stddev_samp(value) AS deviation, " + ", ".join(f"quantile_cont(value, {q}) AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))


@query(f"SELECT event_type, {_T} FROM events GROUP BY event_type")
def timing_percentiles(spark, sf):
    return metrics.timing(table(spark, sf, "events"), "event_type", "value")


@query("SELECT event_type, sum(value) AS ms, 100 * sum(value) / sum(sum(value)) OVER () AS pct FROM events GROUP BY event_type")
def timing_category_pct(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("ms"))
    return by.select("event_type", "ms", (100 * F.col("ms") / F.sum("ms").over(Window.partitionBy())).alias("pct"))


@query("PIVOT (SELECT dayofweek(ts) AS day, event_type, value FROM events) ON event_type IN ('signup', 'error', 'click', 'view', 'purchase') USING count(*) GROUP BY day")
def heatmap_pivot(spark, sf):
    e = table(spark, sf, "events").select((F.dayofweek("ts") - 1).alias("day"), "event_type")
    return e.groupBy("day").pivot("event_type", ["signup", "error", "click", "view", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


@query("""WITH D AS (SELECT event_type, ts::DATE AS day, avg(value) AS m FROM events GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS n FROM D)
SELECT event_type, avg(m) FILTER (n <= 3) AS recent, avg(m) FILTER (n BETWEEN 4 AND 6) AS before, CASE WHEN avg(m) FILTER (n BETWEEN 4 AND 6) = 0 THEN 0 ELSE (avg(m) FILTER (n <= 3) - avg(m) FILTER (n BETWEEN 4 AND 6)) / avg(m) FILTER (n BETWEEN 4 AND 6) * 100 END AS change FROM R GROUP BY event_type""")
def trend_last3_prev3(spark, sf):
    d = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))
    d = d.withColumn("n", n).groupBy("event_type").agg(F.avg(F.when(F.col("n") <= 3, F.col("m"))).alias("recent"), F.avg(F.when(F.col("n").between(4, 6), F.col("m"))).alias("before"))
    return d.withColumn("change", metrics.percentage_change(F.col("before"), F.col("recent")))


@query("WITH A AS (SELECT event_type, user_id, sum(value) AS a FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL), B AS (SELECT event_type, user_id, sum(value) AS b FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) SELECT event_type, user_id, a, b, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'removed' ELSE 'common' END AS state FROM A FULL JOIN B USING (event_type, user_id)")
def session_compare_full_outer(spark, sf):
    e, keys = table(spark, sf, "events"), ["event_type", "user_id"]
    a = e.where("ts < TIMESTAMP '2024-01-15'").groupBy(*keys).agg(F.sum("value").alias("a"))
    b = e.where("ts >= TIMESTAMP '2024-01-15'").groupBy(*keys).agg(F.sum("value").alias("b"))
    return a.join(b, keys, "full_outer").withColumn("state", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").otherwise("common"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL")
def tumbling_window(spark, sf):
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "v")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def sliding_window(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


@query("WITH G AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS open FROM events), S AS (SELECT *, sum(open) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM G) SELECT user_id, min(ts) AS start, count(*) AS n FROM S GROUP BY user_id, s")
def session_window(spark, sf):
    e = table(spark, sf, "events").groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return e.select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, count(json_extract_string(props, '$.k')) AS n FROM events GROUP BY event_type")
def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("k").alias("n"))


def _edges(spark, sf):
    """Modules: suppliers import the nations' numbers of their parts' sizes, a small directed graph with cycles."""
    s = table(spark, sf, "nation")
    a = s.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("string")).alias("dst"))
    b = s.where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), ((F.col("n_nationkey") * 2 + 1) % 25).cast("string")).alias("dst"))
    return a.union(b).where("src <> dst").distinct()


_EDGES = "E AS (SELECT DISTINCT src, dst FROM (SELECT 'n' || n_nationkey AS src, 'n' || ((n_nationkey * 7 + 3) % 25) AS dst FROM nation UNION ALL SELECT 'n' || n_nationkey, 'n' || ((n_nationkey * 2 + 1) % 25) FROM nation WHERE n_nationkey % 3 = 0) WHERE src <> dst)"


@query(f"WITH RECURSIVE {_EDGES}, R(node) AS (SELECT 'n0' UNION SELECT dst FROM R JOIN E ON src = node) SELECT node FROM R")
def reachable(spark, sf):
    return graph.reachable(_edges(spark, sf), spark.createDataFrame([("n0",)], "node string"))


@query(f"WITH RECURSIVE {_EDGES}, R(node) AS (SELECT 'n0' UNION SELECT dst FROM R JOIN E ON src = node) SELECT 'n' || n_nationkey AS node FROM nation EXCEPT SELECT node FROM R")
def unreachable(spark, sf):
    nodes = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.unreachable(nodes, _edges(spark, sf), spark.createDataFrame([("n0",)], "node string"))


@query(f"WITH RECURSIVE {_EDGES}, R(node, distance) AS (SELECT 'n0', 0 UNION SELECT dst, distance + 1 FROM R JOIN E ON src = node WHERE distance < 30) SELECT node, min(distance)::INTEGER AS distance FROM R GROUP BY node")
def shortest_path(spark, sf):
    return graph.distances(_edges(spark, sf), spark.createDataFrame([("n0",)], "node string"))


@query(f"WITH RECURSIVE {_EDGES}, B AS (SELECT src, dst FROM E UNION SELECT dst, src FROM E), R(node, seen) AS (SELECT src, src FROM B UNION SELECT node, dst FROM R JOIN B ON src = seen) SELECT node, min(seen) AS component FROM R GROUP BY node")
def connected_components(spark, sf):
    return graph.components(_edges(spark, sf))


@query(f"WITH RECURSIVE {_EDGES}, P(s0, e0, path) AS (SELECT src, dst, [src] FROM E WHERE dst >= src UNION ALL SELECT s0, dst, list_append(path, e0) FROM P JOIN E ON src = e0 WHERE e0 > s0 AND NOT list_contains(path, e0) AND dst >= s0 AND len(path) < 10) SELECT array_to_string(path, '>') AS cycle FROM P WHERE e0 = s0")
def cycles_bounded(spark, sf):
    return graph.cycles(_edges(spark, sf)).select(F.concat_ws(">", "cycle").alias("cycle"))


@query(f"WITH {_EDGES}, C AS (SELECT src AS module, count(DISTINCT dst) AS ce FROM E GROUP BY 1), A AS (SELECT dst AS module, count(DISTINCT src) AS ca FROM E GROUP BY 1) SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) AS instability FROM C FULL JOIN A USING (module)")
def coupling_metrics(spark, sf):
    return graph.coupling(_edges(spark, sf))


_LAYERS = [("low", ["n1"], []), ("mid", ["n2", "n3"], ["low"]), ("top", ["n4", "n5", "n6"], ["mid"])]


@query(f"WITH {_EDGES}, X AS (SELECT src, dst, " + ", ".join(f"CASE WHEN {c} LIKE 'n1%' THEN 'low' WHEN {c} LIKE 'n2%' OR {c} LIKE 'n3%' THEN 'mid' WHEN {c} LIKE 'n4%' OR {c} LIKE 'n5%' OR {c} LIKE 'n6%' THEN 'top' END AS {c}_layer" for c in ("src", "dst")) + " FROM E) SELECT * FROM X WHERE NOT ((src_layer = 'low' AND dst_layer = 'low') OR (src_layer = 'mid' AND dst_layer IN ('mid', 'low')) OR (src_layer = 'top' AND dst_layer IN ('top', 'mid')))")
def layer_violations(spark, sf):
    return graph.layer_violations(_edges(spark, sf), _LAYERS)


@query(f"WITH {_LINES} SELECT CASE WHEN trim(text) = '' THEN 'blank' WHEN regexp_matches(text, '^\\s*(--|\\{{-)') THEN 'comment' ELSE 'code' END AS kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM L GROUP BY 1")
def line_type_counts(spark, sf):
    return _lines(spark, sf).groupBy(text.line_kind(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {_LINES} SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_'']*')) AS token FROM L) GROUP BY token HAVING count(*) >= 20")
def token_counts_by_identifier(spark, sf):
    return text.tokens(_lines(spark, sf)).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("SELECT md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) >= 2")
def exact_clones(spark, sf):
    return similarity.exact_clones(table(spark, sf, "documents"), "doc_id", "text")


@query("WITH F AS (SELECT doc_id AS file, n AS line, coalesce(lead(n) OVER (PARTITION BY doc_id ORDER BY n), 1 + total) - 1 AS until FROM (SELECT doc_id, unnest(range(1, len(t) + 1)) AS n, unnest(t) AS x, len(t) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)) WHERE regexp_matches(x, '^[A-E]')) SELECT until - line AS size, count(*) AS n FROM F GROUP BY 1")
def function_segments_lead(spark, sf):
    parts = F.split("text", "\n")
    d = table(spark, sf, "documents").select("doc_id", F.size(parts).alias("total"), F.posexplode(parts).alias("at", "x")).where(F.col("x").rlike("^[A-E]"))
    after = F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))
    return d.select((F.coalesce(after, F.col("total")) - F.col("at") - 1).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


_EDITS = "X AS (SELECT l_orderkey AS file, l_linenumber AS fix, (l_partkey % 40)::INTEGER AS lo, (l_partkey % 40 + 1 + l_suppkey % 9)::INTEGER AS hi, l_returnflag = 'R' AS preferred FROM lineitem)"


def _edits(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("fix"), F.expr("int(l_partkey % 40)").alias("lo"), F.expr("int(l_partkey % 40 + 1 + l_suppkey % 9)").alias("hi"), (F.col("l_returnflag") == "R").alias("preferred"))


@query(f"WITH {_EDITS} SELECT a.file, a.fix AS fix1, b.fix AS fix2, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM X a JOIN X b ON a.file = b.file AND a.fix < b.fix AND a.lo < b.hi AND b.lo < a.hi")
def interval_overlap_pairs(spark, sf):
    return fixes.overlaps(_edits(spark, sf))


@query(f"WITH {_EDITS}, G AS (SELECT file, fix, max(preferred::INT) AS p FROM X GROUP BY ALL), C AS (SELECT DISTINCT a.file, a.fix AS x1, b.fix AS x2 FROM X a JOIN X b ON a.file = b.file AND a.fix < b.fix AND a.lo < b.hi AND b.lo < a.hi), K AS (SELECT C.file, CASE WHEN g2.p > g1.p THEN x1 ELSE x2 END AS fix FROM C JOIN G g1 ON g1.file = C.file AND g1.fix = x1 JOIN G g2 ON g2.file = C.file AND g2.fix = x2) SELECT preferred, count(*) AS n FROM X WHERE NOT EXISTS (SELECT 1 FROM K WHERE K.file = X.file AND K.fix = X.fix) GROUP BY preferred")
def conflict_resolution(spark, sf):
    e = _edits(spark, sf)
    return fixes.resolve(e, fixes.overlaps(e)).groupBy("preferred").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, sum(l_suppkey - l_partkey % 7) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS shift FROM lineitem")
def span_shift_running_sum(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.sum(F.col("l_suppkey") - F.col("l_partkey") % 7).over(w).alias("shift"))


@query("WITH H AS (SELECT o_custkey AS file, (o_orderkey % 500) AS line, o_totalprice AS cost FROM orders WHERE o_orderstatus = 'F'), D AS (SELECT o_custkey AS file, (o_orderkey % 500) AS line FROM orders WHERE o_orderstatus = 'O') SELECT D.file, D.line, max(cost) AS impact, count(*) AS n FROM D JOIN H ON D.file = H.file AND abs(D.line - H.line) <= 10 GROUP BY ALL")
def hotspot_band_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 500).alias("line"), "o_totalprice", "o_orderstatus")
    h = o.where("o_orderstatus = 'F'").select("file", F.col("line").alias("at"), F.col("o_totalprice").alias("cost"))
    near = o.where("o_orderstatus = 'O'").join(h, "file").where(F.abs(F.col("line") - F.col("at")) <= 10)
    return near.groupBy("file", "line").agg(F.max("cost").alias("impact"), F.count(F.lit(1)).alias("n"))


@query("WITH A AS (SELECT p_name, p_size FROM part WHERE p_partkey % 3 <> 0), A1 AS (SELECT p_name, max(p_size) AS a FROM A GROUP BY 1), B AS (SELECT p_name, max(p_size) AS b FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1) SELECT CASE WHEN b IS NULL THEN 'breaking' WHEN a IS NULL THEN 'addition' WHEN a <> b THEN 'breaking' ELSE 'same' END AS change, count(*) AS n FROM A1 FULL JOIN B USING (p_name) GROUP BY 1")
def api_diff(spark, sf):
    p = table(spark, sf, "part")
    a = p.where("p_partkey % 3 <> 0").groupBy("p_name").agg(F.max("p_size").alias("a"))
    b = p.where("p_partkey % 3 <> 1").groupBy("p_name").agg(F.max("p_size").alias("b"))
    change = F.when(F.col("b").isNull(), "breaking").when(F.col("a").isNull(), "addition").when(F.col("a") != F.col("b"), "breaking").otherwise("same")
    return a.join(b, "p_name", "full_outer").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, upper(source) || '-' || length(lang) AS s, length(text) // 7 * 2 - 3 AS i, (length(text) * -1) - floor((length(text) * -1)::DOUBLE / 7)::BIGINT * 7 AS m, list_sum(list_transform(list_filter([1, 2, 3, 4], lambda x: x > 1), lambda x: x * doc_id))::BIGINT AS t, list_sort(list_distinct([lang, source, lang])) AS u FROM documents")
def expr_language(spark, sf):
    d = table(spark, sf, "documents")
    e = {
        "s": 'toUpper(source) ++ "-" ++ show(length(lang))',
        "i": "length(text) / 7 * 2 - 3",
        "m": "(0 - length(text)) % 7",
        "t": r"sum(map(\x -> x * doc_id, filter(\x -> x > 1, [1, 2, 3, 4])))",
        "u": "fromList([lang, source, lang])",
    }
    return d.select("doc_id", *[to_column(v).alias(k) for k, v in e.items()])


@query("SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS n FROM part) WHERE n <= 3")
def topk_per_group(spark, sf):
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    return table(spark, sf, "part").withColumn("n", n).where("n <= 3").select("p_brand", "p_partkey", "p_size")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return metrics.first_by(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query(_H + ", Q AS (SELECT source, count(DISTINCT file_id) AS files, count(*) AS issues, sum((severity = 0)::INT)::BIGINT AS errors, sum((severity = 1)::INT)::BIGINT AS warnings FROM H GROUP BY source) SELECT source, files, issues, errors, warnings, greatest(0.0, 100.0 - least(50.0, issues * 0.5) - 10 * errors - 3 * warnings)::DOUBLE AS score FROM Q")
def quality_score(spark, sf):
    by = _hits(spark, sf).groupBy("source").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("issues"), F.sum((F.col("severity") == 0).cast("long")).alias("errors"), F.sum((F.col("severity") == 1).cast("long")).alias("warnings"))
    return by.withColumn("score", metrics.quality_score(*map(F.col, ("files", "issues", "errors", "warnings"))))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0")
def set_difference(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(table(spark, sf, "supplier").where("s_suppkey % 9 = 0").select("s_nationkey"))


@query(_H + " SELECT format('findings_total{{rule=\"{}\",severity=\"{}\"}} {}', rule, ['error', 'warning', 'suggestion', 'info'][severity + 1], count(*)) AS value FROM H GROUP BY rule, severity")
def sink_prometheus(spark, sf):
    return sinks.prometheus_rows(_hits(spark, sf))


@query(f"WITH {_EDGES} SELECT '  \"' || src || '\" -> \"' || dst || '\";' AS value FROM E")
def sink_dot(spark, sf):
    return sinks.dot_rows(_edges(spark, sf))


def _dag(spark, sf):
    n = table(spark, sf, "nation")
    return n.where("n_nationkey > 0").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("n"), F.expr("n_nationkey div 2")).alias("dst"))


@query("WITH RECURSIVE E AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey // 2) AS dst FROM nation WHERE n_nationkey > 0), R(node, level) AS (SELECT 'n0', 0 UNION ALL SELECT src, level + 1 FROM R JOIN E ON dst = node) SELECT node, max(level)::INTEGER AS level FROM R GROUP BY node")
def dependency_levels(spark, sf):
    return graph.levels(_dag(spark, sf))


@query("WITH RECURSIVE E AS (SELECT 'n' || n_nationkey AS src, 'n' || (n_nationkey // 2) AS dst FROM nation WHERE n_nationkey > 0), R(node) AS (SELECT 'n3' UNION SELECT src FROM R JOIN E ON dst = node) SELECT node FROM R")
def cache_invalidation(spark, sf):
    return cache.invalidated(spark.createDataFrame([("n3",)], "path string"), _dag(spark, sf))


@query("SELECT doc_id, (1 + n_case + n_if + n_guard + greatest(0, n_arrow - n_case))::BIGINT AS cyclomatic FROM (SELECT doc_id, (length(text) - length(replace(text, 'case ', ''))) / 5 AS n_case, (length(text) - length(replace(text, 'if ', ''))) / 3 AS n_if, (length(text) - length(replace(text, ' | ', ''))) / 3 AS n_guard, (length(text) - length(replace(text, ' -> ', ''))) / 4 AS n_arrow FROM documents)")
def cyclomatic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", complexity.cyclomatic(F.col("text")).alias("cyclomatic"))


@query("WITH A AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), B AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT CASE WHEN A.h IS NULL THEN 'added' WHEN B.h IS NULL THEN 'removed' WHEN A.h <> B.h THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM A FULL JOIN B USING (doc_id) GROUP BY 1")
def file_changes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    old = cache.content_hash(d.where("path % 7 <> 0"))
    new = cache.content_hash(d.where("path % 11 <> 0").withColumn("content", F.when(F.col("path") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return cache.changes(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(_H + ", B AS (SELECT * FROM H WHERE file_id % 3 = 0), N AS (SELECT file_id::VARCHAR AS file, rule, count(*) AS n FROM H GROUP BY ALL), O AS (SELECT file_id::VARCHAR AS file, rule, count(*) AS n FROM B GROUP BY ALL) SELECT sum(N.n - coalesce(O.n, 0))::BIGINT AS new, sum(coalesce(O.n, 0))::BIGINT AS existing, 0::BIGINT AS resolved, 0::BIGINT AS expired, sum(N.n - coalesce(O.n, 0)) <= 0 AS passed FROM N LEFT JOIN O USING (file, rule)")
def ci_gate(spark, sf):
    """Findings of all files against a baseline of a third of them."""
    h = _hits(spark, sf).select("file_id", F.col("file_id").cast("string").alias("file"), "rule", F.lit("m").alias("message"), F.col("line_no").alias("line"))
    return baseline.gate(baseline.diff(h.drop("file_id"), h.where("file_id % 3 = 0").drop("file_id")))


@query("WITH S AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT event_type, avg(value) FILTER (n <= c // 2) AS first_half, avg(value) FILTER (n > c // 2) AS second_half, var_samp(value) AS variance FROM S GROUP BY event_type")
def trend_halves(spark, sf):
    key = Window.partitionBy("event_type")
    e = table(spark, sf, "events").select("event_type", "value", F.row_number().over(key.orderBy("ts", "event_id")).alias("n"), F.expr("count(1) over (partition by event_type)").alias("c"))
    early = F.col("n") <= F.floor(F.col("c") / 2)
    return e.groupBy("event_type").agg(F.avg(F.when(early, F.col("value"))).alias("first_half"), F.avg(F.when(~early, F.col("value"))).alias("second_half"), F.var_samp("value").alias("variance"))


@query(_H + ", D AS (SELECT source, sum([10, 5, 2, 1][severity + 1])::BIGINT AS debt, count_if(severity = 0) AS errors, count_if(severity = 1) AS warnings, count(*) AS issues FROM H GROUP BY source) SELECT source, debt, CASE WHEN errors > 0 THEN 'critical' WHEN warnings > 10 THEN 'high' WHEN warnings > 5 OR issues > 50 THEN 'medium' WHEN issues > 10 THEN 'low' ELSE 'minimal' END AS risk FROM D")
def technical_debt(spark, sf):
    """Debt points by severity and a risk level."""
    sev = F.col("severity")
    by = _hits(spark, sf).groupBy("source").agg(F.sum(reports.debt(sev)).cast("long").alias("debt"), reports.count_if(sev == 0).alias("errors"), reports.count_if(sev == 1).alias("warnings"), F.count(F.lit(1)).alias("issues"))
    return by.select("source", "debt", reports.risk_level(F.col("errors"), F.col("warnings"), F.col("issues")).alias("risk"))


@query("SELECT r_name, count(*) AS n, sum(c_acctbal) AS bal FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def team_rollup(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("bal"))


@query("SELECT user_id, event_id, (SELECT min(b.ts) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.ts > a.ts) AS until FROM events a WHERE event_type = 'signup'")
def asof_next(spark, sf):
    """The next closing event after each opening one, by one window instead of a range join."""
    after = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(1, Window.unboundedFollowing)
    e = table(spark, sf, "events").where("event_type in ('signup', 'error')")
    return e.withColumn("until", F.min(F.when(F.col("event_type") == "error", F.col("ts"))).over(after)).where("event_type = 'signup'").select("user_id", "event_id", "until")


@query(_H + ", S AS (SELECT count(DISTINCT file_id) AS files, count(*) AS issues, count_if(severity = 0)::BIGINT AS errors, count_if(severity = 1)::BIGINT AS warnings, count_if(severity = 2)::BIGINT AS suggestions, count_if(severity = 3)::BIGINT AS infos, sum([10, 5, 2, 1][severity + 1])::BIGINT AS debt, count_if(category = 'security')::BIGINT AS security_issues FROM H) SELECT *, greatest(0.0, 100.0 - 10 * security_issues)::DOUBLE AS security_score, CASE WHEN errors > 0 THEN 'critical' WHEN warnings > 10 THEN 'high' WHEN warnings > 5 OR issues > 50 THEN 'medium' WHEN issues > 10 THEN 'low' ELSE 'minimal' END AS risk FROM S")
def executive_summary(spark, sf):
    return reports.summary(_hits(spark, sf))


@query(_H + " SELECT severity, count(*) AS n, count(*) / sum(count(*)) OVER () * 100 AS pct FROM H GROUP BY severity")
def severity_breakdown(spark, sf):
    return reports.breakdown(_hits(spark, sf), "severity")


@query(_H + " SELECT rule, ['Hard Secret', 'Word That', 'Word With', 'Licence Line', 'Gpl', 'E Mail', 'Ip', 'Pair'][list_position(['hard-secret', 'word-that', 'word-with', 'licence-line', 'gpl', 'e-mail', 'ip', 'pair'], rule)] AS name, count(*) AS n, count(DISTINCT file_id) AS files FROM H GROUP BY rule ORDER BY n DESC, rule LIMIT 3")
def top_issues(spark, sf):
    return reports.top_issues(_hits(spark, sf), 3)


@query(_H + " SELECT owner, count(DISTINCT source) AS files, count(*) AS issues, count_if(severity = 0)::BIGINT AS errors FROM H JOIN (VALUES ('one', 'src1'), ('all', 'src')) AS o(owner, prefix) ON starts_with(source, prefix) GROUP BY owner")
def team_report(spark, sf):
    owners = spark.createDataFrame([("one", "src1"), ("all", "src")], "owner string, prefix string")
    return reports.owned(_hits(spark, sf), owners, "source")


@query("SELECT event_type, sum(value) AS actual, (100 * count(*))::DOUBLE AS allowed FROM events GROUP BY event_type HAVING sum(value) > 100 * count(*)")
def baseline_limits(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type")
    limits = e.agg((F.count(F.lit(1)) * 100).cast("double").alias("allowed"))
    return reports.over_limit(e.agg(F.sum("value").alias("actual")), limits, "event_type")


@query("WITH T AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 50), S AS (SELECT *, CASE WHEN max(n) OVER () = min(n) OVER () THEN 0 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END AS scaled FROM T) SELECT *, least(floor(scaled * 5), 4)::BIGINT AS bucket FROM S")
def heatmap_buckets(spark, sf):
    return reports.heatmap(table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n")


@query("WITH S AS (SELECT user_id::VARCHAR AS rule, avg(value) AS mean, stddev_samp(value) AS deviation FROM events GROUP BY 1) SELECT rule, 'slow' AS issue FROM S WHERE mean > 20 AND mean <= 60 UNION ALL SELECT rule, 'very slow' FROM S WHERE mean > 60 UNION ALL SELECT rule, 'high variance' FROM S WHERE deviation > mean")
def rule_performance(spark, sf):
    stats = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("rule")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
    return reports.slow_rules(stats, 20, 60)


def _imports(spark, sf):
    """Imports told by order lines: file, module, and a list of two items."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 4).cast("string").alias("imported"), F.lit(False).alias("qualified"), F.lit(None).cast("string").alias("alias"), F.lit(False).alias("hiding"), F.array("l_returnflag", "l_linestatus").alias("items"))


_IMPORTS = "I AS (SELECT l_orderkey AS file_id, (l_suppkey % 4)::VARCHAR AS imported, unnest([l_returnflag, l_linestatus]) AS item FROM lineitem)"


@query(f"WITH {_IMPORTS}, U AS (SELECT DISTINCT l_orderkey AS f, l_linestatus AS n FROM lineitem WHERE l_linenumber = 1) SELECT file_id, imported, list_sort(list(DISTINCT item)) AS unused FROM I WHERE NOT EXISTS (SELECT 1 FROM U WHERE f = file_id AND n = item) GROUP BY ALL")
def unused_imports(spark, sf):
    used = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("file_id"), F.col("l_linestatus").alias("name"))
    return imports.unused(_imports(spark, sf), used)


@query(f"WITH {_IMPORTS} SELECT file_id, imported, count(*) // 2 AS times, list_sort(list(DISTINCT item)) AS items FROM I GROUP BY ALL HAVING count(*) > 2")
def merged_imports(spark, sf):
    return imports.merged(_imports(spark, sf)).select("file_id", "imported", "times", "items")


@query("WITH C AS (SELECT p_brand AS symbol, arg_min(p_type, p_partkey) AS module FROM part WHERE p_size > 40 GROUP BY 1) SELECT DISTINCT p_brand AS symbol, module FROM part LEFT JOIN C ON symbol = p_brand")
def best_import(spark, sf):
    p = table(spark, sf, "part")
    return imports.best_source(p.select(F.col("p_brand").alias("symbol")), p.where("p_size > 40").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("module"), F.col("p_partkey").alias("ord")))


@query(f"WITH {_EDITS}, P AS (SELECT o_orderkey AS file, (o_custkey % 40)::INTEGER AS point FROM orders), J AS (SELECT P.file, point, fix::VARCHAR AS name, hi - lo AS size FROM P JOIN X ON X.file = P.file AND point >= lo AND point < hi) SELECT file, point, name, size FROM (SELECT *, row_number() OVER (PARTITION BY file, point ORDER BY size, name) AS n FROM J) WHERE n = 1")
def innermost_span(spark, sf):
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.expr("int(o_custkey % 40)").alias("point"))
    return imports.innermost(points, _edits(spark, sf).select("file", F.col("fix").cast("string").alias("name"), "lo", "hi"))


@query("WITH B AS (SELECT l_orderkey AS file, l_linenumber AS line, l_returnflag AS rule, l_suppkey AS supp, CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END AS age FROM lineitem) SELECT file, line, rule, supp FROM (SELECT *, row_number() OVER (PARTITION BY file, line, rule ORDER BY age, supp) AS n FROM B) WHERE n = 1")
def baseline_merge(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("rule"), F.col("l_suppkey").alias("supp"), "l_partkey")
    return imports.merge_baselines(b.where("l_partkey % 2 = 0").drop("l_partkey"), b.where("l_partkey % 2 = 1").drop("l_partkey"), ["supp"])


@query(_H + " SELECT rule, substr(sha256(file_id || '|' || rule || '|' || matched), 1, 16) AS fingerprint, count(*) AS n FROM H WHERE category IN ('security', 'licence') GROUP BY ALL")
def finding_fingerprints(spark, sf):
    h = _hits(spark, sf).where(F.col("category").isin("security", "licence"))
    key = F.concat_ws("|", F.col("file_id").cast("string"), "rule", "matched")
    return h.groupBy("rule", F.substring(F.sha2(key, 256), 1, 16).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LINES} SELECT earlier, count(*) AS n FROM (SELECT coalesce(max(starts_with(text, 'Released')::INT) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS earlier FROM L) GROUP BY earlier")
def preceding_doc(spark, sf):
    """Lines by whether any earlier line of the file is a marker, by the least marker line of a file rather than a running window."""
    rows = _lines(spark, sf)
    first = rows.where(F.col("text").startswith("Released")).groupBy("file_id").agg(F.min("line_no").alias("first"))
    return rows.select("file_id", "line_no").join(first, "file_id", "left").groupBy(F.coalesce(F.col("first") < F.col("line_no"), F.lit(False)).alias("earlier")).agg(F.count(F.lit(1)).alias("n"))


def _times(token):
    return f"(length(text) - length(replace(text, {token}, ''))) // {len(eval(token.replace(' || chr(10)', ' + chr(10)').replace('chr(10) || ', 'chr(10) + ')))}"


@query("SELECT doc_id, (" + " + ".join(_times(t) for t in ("'case '", "' if '", "' | '", "' do' || chr(10)", "' do '", "' where' || chr(10)", "' let '", "chr(10) || 'let '", "' >>= '")) + f" + ({_times(chr(39) + ' . ' + chr(39))}) // 3 + greatest(0, list_max(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE length(x) - length(ltrim(x)) END)) // 2 - 4) * 2)::BIGINT AS cognitive FROM documents")
def cognitive(spark, sf):
    return table(spark, sf, "documents").select("doc_id", complexity.cognitive(F.col("text")).alias("cognitive"))
