import json
import os
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sourcelode import session
from sourcelode.functions import plugins
from sourcelode.operators import baseline, comments, fixgraph, graph, scalars, similarity, suppress, trends, unused
from sourcelode.sources import documents, profiles
from sourcelode.streaming import cache


def test_comment_scan():
    kinds = lambda t: [(k, t[a:b]) for k, a, b in comments.scan(t)]
    assert kinds("x -- a\ny") == [("line", "-- a")]
    assert kinds("a --> b -- c") == [("line", "-- c")]
    assert kinds("{- a {- b -} c -} d") == [("block", "{- a {- b -} c -}")]
    assert kinds("{-# LANGUAGE X #-}\n-- | doc\n{-| more -}") == [("pragma", "{-# LANGUAGE X #-}"), ("doc", "-- | doc"), ("doc", "{-| more -}")]
    assert kinds('f "a -- b" -- c') == [("string", '"a -- b"'), ("line", "-- c")]
    assert kinds(r'"a\"b" x') == [("string", r'"a\"b"')]
    assert kinds("'\"' -- q") == [("line", "-- q")] and kinds("x' -- q") == [("line", "-- q")]
    assert kinds("{- open") == [("block", "{- open")] and kinds("") == []
    deep = "{-" * 3000 + "-}" * 3000
    assert kinds(deep) == [("block", deep)]


def test_regions_and_places(spark):
    files = spark.createDataFrame([(1, "a -- b\n{- c\nd -} e \"s\"", 9), (2, None, 9), (3, "", 9)], "file_id long, content string, kind int")
    found = comments.regions(files)
    assert sorted((r.kind, r.line, r.col, r.end_line, r.end_col, r.text) for r in found.collect()) == [("block", 2, 1, 3, 5, "{- c\nd -}"), ("line", 1, 3, 1, 7, "-- b"), ("string", 3, 8, 3, 11, '"s"')]
    assert sorted(r.kind for r in comments.in_range(found, 3, 3).collect()) == ["block", "string"]
    hits = spark.createDataFrame([(1, 1, 1), (1, 1, 4), (1, 3, 1), (1, 3, 6), (1, 3, 9), (2, 1, 1)], "file_id long, line_no int, col int")
    assert sorted((r.file_id, r.line_no, r.col, r.region) for r in comments.region_of(hits, found).collect()) == [(1, 1, 1, "code"), (1, 1, 4, "line"), (1, 3, 1, "block"), (1, 3, 6, "code"), (1, 3, 9, "string"), (2, 1, 1, "code")]


def test_code_of_a_line(spark):
    line = spark.createDataFrame([('f "x -- y" >>= g {- >>= -} >>= h -- >>=',)], "t string").select(
        comments.count_in_code(F.col("t"), ">>=").alias("n"), comments.word_in_code(F.col("t"), "x").alias("x"), comments.word_in_code(F.col("t"), "g").alias("g"), comments.operators(F.col("t")).alias("ops")
    ).first()
    assert (line.n, line.x, line.g, line.ops) == (2, False, True, [">>=", ">>="])


def test_similar_functions_against_brute_force(spark):
    rnd = random.Random(4)
    base = [[rnd.choice("abcdefgh+*()=") for _ in range(rnd.randrange(4, 30))] for _ in range(12)]
    rows = []
    for f, b in enumerate(base * 3):
        b = list(b)
        for _ in range(rnd.randrange(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice("xyz-/")
        rows.append((f"f{f % 2}", f, " ".join(b)))
    got = similarity.functions_of(spark.createDataFrame(rows, "file string, key long, text string"), "key", "text")
    forms = {r.key: r for r in got.collect()}
    functions = got.join(spark.createDataFrame(rows, "file string, key long, text string").select("file", "key"), "key")
    pairs = {(r.hash1, r.hash2): r.similarity for r in similarity.similar_pairs(functions).collect()}

    def plain(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        return d[-1][-1]

    want = {}
    for f, i, _ in rows:
        for g, j, _ in rows:
            a, b = forms[i], forms[j]
            if f == g and a.hash < b.hash and (s := 1 - plain(a.tokens, b.tokens) / (len(a.tokens) + len(b.tokens))) >= 0.8:
                want[a.hash, b.hash] = s
    assert pairs == pytest.approx(want) and len(want) > 3
    assert similarity.functions_of(spark.createDataFrame([(1, "foo x = x + y"), (2, "bar a = a + b"), (3, None)], "key int, text string"), "key", "text").select("hash").distinct().count() == 2
    clusters = similarity.clone_clusters(got, similarity.similar_pairs(functions))
    d = similarity.duplication(got, clusters).first()
    assert d.functions == 36 and d.duplicated == clusters.count() and 0 < d.ratio <= 1


def test_conflict_strategies(spark):
    fixes = spark.createDataFrame([("f", 1, 0, 10, "a", False, 1), ("f", 2, 5, 8, "b", True, 1), ("f", 3, 20, 22, "c", False, 1), ("f", 4, 21, 29, "d", False, 3), ("f", 5, 40, 41, "e", False, 1)], "file string, fix int, lo int, hi int, text string, preferred boolean, edits int")
    conflicts = spark.createDataFrame([("f", 1, 2), ("f", 3, 4)], "file string, fix1 int, fix2 int")
    kept = lambda s: sorted(r.fix for r in fixgraph.resolve(fixes, conflicts, s).where("apply").collect())
    assert [kept(s) for s in fixgraph.STRATEGIES] == [[2, 3, 5], [2, 4, 5], [2, 3, 5], [5], [1, 3, 5], [2, 3, 5], [1, 2, 3, 4, 5]]
    with pytest.raises(ValueError):
        kept("newest")


def test_fix_order_dependencies_and_pipeline(spark):
    fixes = spark.createDataFrame([("f", 1, 0, 4, "longer text"), ("f", 2, 10, 12, "ab"), ("f", 3, 20, 22, "old + 1"), ("g", 4, 0, 1, "old")], "file string, fix int, lo int, hi int, text string")
    assert sorted((r.src, r.dst) for r in fixgraph.positional(fixes).collect()) == [(2, 1), (3, 1)]
    renames = spark.createDataFrame([("f", 1, "old")], "file string, fix int, old string")
    assert [(r.src, r.dst) for r in fixgraph.identifiers(fixes, renames).collect()] == [(3, 1)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "node int")
    needs = spark.createDataFrame([(2, 1), (3, 2), (4, 5), (5, 4)], "src int, dst int")
    assert {r.node: r.level for r in fixgraph.apply_order(nodes, needs).collect()} == {1: 0, 2: 1, 3: 2, 4: None, 5: None, 6: 0}
    p = fixgraph.Pipeline(("long", lambda d: d.where(F.length("text") > 2)), ("first", lambda d: fixgraph.ranked(d, "span").limit(1)), ("none", lambda d: d.where("false")), ("never", lambda d: d))
    assert p.with_stats(fixes)[1] == [("long", 4, 3), ("first", 3, 1), ("none", 1, 0)]
    both = fixgraph.Pipeline.conditional(F.col("file") == "f", lambda d: d.limit(1), lambda d: d)
    assert both(fixes).count() == 2 and fixgraph.Pipeline.parallel(both, both)(fixes).count() == 4 and p.retry(fixes, 2).count() == 0


def test_spans(spark):
    s = scalars.span(F.lit(1), F.lit(3), F.lit(2), F.lit(2))
    one = spark.range(1).select(
        scalars.span_text(F.lit("abcd\nefgh\nij"), s).alias("t"), scalars.delta(s, F.lit("XY")).alias("d"),
        scalars.adjust(scalars.span(F.lit(2), F.lit(3), F.lit(2), F.lit(5)), scalars.delta(s, F.lit("XY"))).alias("moved"),
        scalars.adjust(scalars.span(F.lit(1), F.lit(4), F.lit(2), F.lit(5)), scalars.delta(s, F.lit("XY"))).alias("lost"),
        scalars.replace_names(F.lit("a b' ab a"), {"a": "b'", "b'": "c"}).alias("r"), scalars.suggest_alias(F.lit("Data.Map.Strict"), {"Data.Text": "T"}).alias("alias"),
        scalars.wildcard(F.lit("Map k v"), "Map * v").alias("w"), scalars.format_heat(F.lit(1234567)).alias("h"),
    ).first()
    assert one.t == "cd\ne" and one.d.lines == -1 and one.d.cols == 3
    assert (tuple(one.moved.lo), tuple(one.moved.hi)) == ((1, 6), (1, 8)) and one.lost is None
    assert (one.r, one.alias, one.w, one.h) == ("b' c ab b'", "S", True, "1.2M")


def test_baseline_documents_and_expiry(spark, tmp_path):
    found = spark.createDataFrame([("a.hs", "r", "m|x", 3), ("b.hs", "r", None, 9)], "file string, rule string, message string, line int")
    doc = baseline.document(found, "known").first().value
    (tmp_path / "b.json").write_text(doc)
    back = baseline.read(spark, str(tmp_path / "b.json"))
    assert sorted((r.file, r.line, r.reason, len(r.fingerprint)) for r in back.collect()) == [("a.hs", 3, "known", 16), ("b.hs", 9, "known", 16)]
    assert json.loads(doc)["version"] == 1
    assert sorted(r.known for r in baseline.categorize(found.union(spark.createDataFrame([("a.hs", "r", "other", 6), ("a.hs", "r", "other", 7)], found.schema)), back).collect()) == [False, True, True, True]


def test_an_enable_ends_what_it_names(spark):
    rows = [(1, 1, "disable", ["a"]), (1, 2, "disable", None), (1, 3, "enable", ["b"]), (1, 5, "enable", ["a", "c"]), (1, 6, "disable", ["z"]), (1, 8, "enable", None), (2, 1, "disable", ["q"]), (2, 3, "ignore", ["q"])]
    got = suppress.intervals(spark.createDataFrame(rows, "file_id int, line_no int, kind string, rules array<string>"))
    assert sorted((r.file_id, r.lo, r.hi, ",".join(r.rules or [])) for r in got.collect()) == [(1, 1, 4, "a"), (1, 2, 2, ""), (1, 6, 7, "z"), (2, 1, 2147483647, "q"), (2, 4, 4, "q")]


def test_cache_update_and_empty_inputs(spark):
    entry = "path string, sha256 string, stored timestamp, result int"
    old, new = spark.createDataFrame([("a", "1", None, 1), ("b", "1", None, 1)], entry), spark.createDataFrame([("b", "2", None, 2)], entry)
    assert sorted((r.path, r.result) for r in cache.update(old, new).collect()) == [("a", 1), ("b", 2)]
    assert cache.counters(spark.createDataFrame([], "path string, state string")).first().hit_rate == 0.0
    assert trends.halves(spark.createDataFrame([(1, 2.0)], "k int, v double"), ["k"], ["v"], "v").first().direction == "stable"
    symbols = spark.createDataFrame([("M.f", "function", "f", 1, 1, False), ("M.main", "function", "f", 2, 1, None), ("M.$cshow", "function", "f", 3, 1, False), ("M.+#", "function", "f", 4, 1, False)], "name string, kind string, file string, line int, col int, th boolean")
    got = unused.detect(symbols, spark.createDataFrame([], "src string, dst string"), ["main$"]).collect()
    assert [(r.name, r.finding) for r in got] == [("M.f", "field"), ("M.f", "function")]


def test_report_documents(spark, tmp_path):
    rows = [("b.hs", 10, 1, 0, "r", 'say "<x>" | y'), ("a.hs", 2, 3, 1, "q", "m"), ("a.hs", 10, 1, 3, "r", None), ("a.hs", 10, 1, 3, "r", None)]
    found = spark.createDataFrame(rows, "file string, line int, col int, severity int, rule string, message string")
    text = lambda form, d=found: "\n".join(r.value for r in documents.FORMATS[form](d).orderBy("part", "place").collect())
    empty = found.limit(0)
    assert [(d["file"], d["line"]) for d in json.loads(text("json"))["diagnostics"]] == [("a.hs", 2), ("a.hs", 10), ("a.hs", 10), ("b.hs", 10)]
    assert json.loads(text("json", empty))["diagnostics"] == []
    run = json.loads(text("sarif"))["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["q", "r"] and len(run["results"]) == 4 and run["results"][0]["level"] == "warning"
    assert json.loads(text("sarif", empty))["runs"][0]["results"] == []
    for form, tag in (("checkstyle", "error"), ("junit", "failure")):
        root = ElementTree.fromstring(text(form).split("\n", 1)[1])
        assert len(list(root.iter(tag))) == 4 and [x.get("name") for x in root] == ["a.hs", "b.hs"]
    assert text("plain").startswith("a.hs:2:3: warning: [q] m\n") and text("markdown").count("\n") == 7 and "&lt;x&gt;" in text("html")
    documents.write(found, "sarif", str(tmp_path / "out"))
    assert json.loads("\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()))["version"] == "2.1.0"


def test_profile_readers(spark, tmp_path):
    rows = ["COST CENTRE MODULE SRC no. entries %time", "MAIN         Main    <built-in>       100   0    0.0    0.1  100.0  100.0", "  go         Data.A  src/A.hs:(3,1)-(5,9)  101   7   60.5   12.0   61.0   13.0"]
    got = profiles.cost_centres(spark.createDataFrame([(x,) for x in rows], "text string"))
    assert [(r.name, r.module, r.entries, r.time, r.depth) for r in got.collect()] == [("MAIN", "Main", 0, 0.0, 0), ("go", "Data.A", 7, 60.5, 2)]
    span = lambda s: spark.range(1).select(profiles.span_lines(F.lit(s)).alias("s")).first().s
    assert tuple(span("src/A.hs:(3,1)-(5,9)")) == ("src/A.hs", 3, 5) and tuple(span("B.hs:7:1-20")) == ("B.hs", 7, 7) and span("<built-in>") is None
    (tmp_path / "b.json").write_text(json.dumps([{"reportName": "x", "reportAnalysis": {"anMean": {"estPoint": 0.5}, "anStdDev": {"estPoint": 0.1}}}]))
    assert [tuple(r) for r in profiles.benchmarks(spark, str(tmp_path / "b.json")).collect()] == [("x", 0.5, 0.1)]
    profiles.append_snapshot(spark.createDataFrame([(3,)], "issues int"), str(tmp_path / "h"), "2024-01-01")
    profiles.append_snapshot(spark.createDataFrame([(4,)], "issues int"), str(tmp_path / "h"), "2024-01-02")
    assert sorted(r.issues for r in profiles.history(spark, str(tmp_path / "h"), "issues int").collect()) == [3, 4]
    paths = spark.createDataFrame([("a/b/x.cabal",), ("a/b/src/M.hs",), ("stack.yaml",)], "path string")
    assert sorted(r.root for r in profiles.projects(paths).collect()) == [".", "a/b"]
    (tmp_path / "i.toml").write_text('[modules]\n"Data.Map" = ["insert", "lookup"]\n"Data.Set" = ["insert"]\n')
    assert sorted(tuple(r) for r in profiles.import_table(spark, str(tmp_path / "i.toml")).collect()) == [("insert", "Data.Map", 0), ("insert", "Data.Set", 1), ("lookup", "Data.Map", 0)]
    assert profiles.settings("X_", {"X_A__B": "1", "Y": "2"}, {"c": "3"}) == {"a.b": "1", "c": "3"}


def test_hooks_packs_and_failing_plugins(spark):
    hooks = plugins.Hooks()
    hooks.add("after_rules", lambda d: d.where("x > 1"))
    hooks.add("after_rules", lambda d: 1 / 0)
    hooks.add("after_rules", lambda d: d.where("x > 2"))
    assert hooks.run("after_rules", spark.createDataFrame([(1,), (2,), (3,)], "x int")).count() == 1
    with pytest.raises(ValueError):
        hooks.add("later", lambda d: d)
    packs = {"a": {"include": ["b"], "rules": ["1"], "exclude": ["3"]}, "b": {"include": ["a"], "rules": ["2", "3"]}}
    assert plugins.expand_packs(packs, "a") == {"1", "2"} and plugins.merge_packs(list(packs.values())) == {"1", "2"}
    lines = spark.createDataFrame([(1, 1, "ok"), (1, 2, "boom")], "file_id long, line_no int, text string")
    got = plugins.run_plugin(lines, lambda t: [("r", 1, t)] if t == "ok" else [1 / 0]).collect()
    assert sorted((r.line_no, r.rule) for r in got) == [(1, "r"), (2, plugins.FAILED)]


def test_depth_of_a_chain(spark):
    assert graph.max_depth(spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")) == 40


def test_files_of_an_application_are_released(spark, tmp_path):
    kept = session.materialise(spark.range(3), "kept")
    folder = session.shared_dir(spark).removeprefix("file://")
    assert kept.count() == 3 and spark.sparkContext.applicationId in folder and os.listdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)


def test_durations_round_as_printf(spark):
    ms = [None, 1005.0, 2675.0, 4125.0, 8375.0, 59995.0, 0.005, 999.995, 1e6, float("nan"), float("inf"), -0.0]
    unit = lambda x: "µs" if x < 1 else "ms" if x < 1000 else "s" if x < 60000 else "m"
    scale = {"µs": lambda x: x * 1000, "ms": lambda x: x, "s": lambda x: x / 1000, "m": lambda x: x / 60000}
    want = [None if x is None else f"{scale[unit(x)](x):.2f}{unit(x)}" for x in ms]
    d = spark.createDataFrame(list(enumerate(ms)), "i int, ms double")
    assert [r[0] for r in d.orderBy("i").select(scalars.format_duration(F.col("ms"))).collect()] == want
