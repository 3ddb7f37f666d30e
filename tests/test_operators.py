import pytest
from pyspark.sql import functions as F

from sourcelode.functions import exprlang
from sourcelode.operators import baseline, fixes, graph, imports, metrics, reports, rules, suppress
from sourcelode.sources import sinks, text
from sourcelode.streaming import incremental


def lines_of(spark, *texts):
    return spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)], "file_id long, line_no int, text string")


def test_word_boundaries_and_captures(spark):
    rs = [rules.Rule("head", "head"), rules.Rule("len", "length $X == 0"), rules.Rule("rx", "a+", regex=True)]
    got = {(r.rule, r.line_no): (r.col, r.captures) for r in rules.match(lines_of(spark, "head xs", "ahead xs", "xs = length ys == 0"), rs).collect()}
    assert got == {("head", 1): (1, None), ("rx", 1): (3, None), ("rx", 2): (1, None), ("len", 3): (6, {"$X": "ys"})}


def test_targets_and_conditions(spark):
    ls = lines_of(spark, 'x = "bad"', "-- bad", "bad 3", "import bad")
    got = lambda **k: [r.line_no for r in rules.match(ls, [rules.Rule("r", "bad", **k)]).orderBy("line_no").collect()]
    assert got(target="string") == [1] and got(target="comment") == [2] and got(target="code") == [3, 4]
    assert got(conditions=(("and", ("not_in_import",), ("not", ("matches", "^--"))),)) == [1, 3]
    assert got(conditions=(("has_type", "$X", "Int"),)) == [1, 2, 3, 4] and got(conditions=(("not", ("has_type", "$X", "Int")),)) == []
    assert got(conditions=(("never",),)) == []


def test_file_and_literal_conditions_and_unknown_names(spark):
    rows = [(1, 1, "f e15", "src/A.hs", "Data.A", "import Data.Map"), (2, 1, "f xs", "test/A.hs", "Main", "{-# X #-}"), (3, 1, 'f ys "', "src/ASpec.hs", "Data.B", None)]
    ls = spark.createDataFrame(rows, "file_id long, line_no int, text string, path string, module string, content string")
    got = lambda *c, lines=ls: sorted(r.file_id for r in rules.match(lines, [rules.Rule("r", "f $X", conditions=c)]).collect())
    assert got(("not_in_test_file",)) == [1] and got(("not", ("in_test_file",))) == [1] and got(("in_test_file",)) == [2, 3]
    assert got(("in_module", "Data*")) == [1, 3] and got(("or", ("has_import", "Data.Map"), ("has_pragma", "X"))) == [1, 2]
    assert got(("is_numeric", "$X")) == [1] and got(("in_string_literal",)) == [3] and got(("type_contains", "$X", "s")) == [2, 3]
    assert got(("is_string", "$X")) == got(("is_list", "$X")) == got(("in_function_body",)) == []
    for bad in (("not_in_tset_file",), ("in_comment_type", "pragma")):
        with pytest.raises(ValueError):
            got(bad)
    with pytest.raises(ValueError):
        got(("in_test_file",), lines=ls.drop("path"))


def test_interpolated_message(spark):
    hits = rules.match(lines_of(spark, "length ys == 0"), [rules.Rule("r", "length $X == 0")])
    assert hits.select(rules.interpolate(F.lit("use null $X"), F.col("captures")).alias("m")).first().m == "use null ys"


def test_suppression(spark):
    ls = lines_of(spark, "a", "-- lint:ignore", "bad", "-- lint:disable word", "bad", "bad", "bad", "bad", "-- lint:enable", "bad")
    spans = suppress.intervals(suppress.directives(ls))
    found = spark.createDataFrame([(1, n, "word-bad") for n in (1, 3, 4, 5, 8, 9, 10)] + [(1, 5, "other")], "file_id long, line_no int, rule string")
    assert sorted((r.line_no, r.rule) for r in suppress.suppress(found, spans).collect()) == [(1, "word-bad"), (5, "other"), (9, "word-bad"), (10, "word-bad")]


def test_baseline_diff(spark):
    schema = "file string, rule string, message string, line int"
    new = spark.createDataFrame([("f", "r", "m", 1), ("f", "r", "m", 2), ("f", "s", "x", 13), ("f", "t", "y", 14)], schema)
    old = spark.createDataFrame([("f", "r", "m", 1), ("f", "s", "z", 10), ("f", "t", "z", 10), ("g", "r", "m", 1)], schema)
    got = sorted((r.file, r.rule, r.line, r.status) for r in baseline.diff(new, old).collect())
    assert got == sorted([("f", "r", 1, "existing"), ("f", "r", 2, "new"), ("f", "s", 13, "existing"), ("f", "t", 14, "new"), ("f", "t", 10, "resolved"), ("g", "r", 1, "resolved")])
    g = baseline.gate(baseline.diff(new, old), most_new=1).first()
    assert (g.new, g.existing, g.resolved, g.passed) == (2, 2, 2, False)


def test_expired_entries_also_count_in_the_band(spark):
    new = spark.createDataFrame([("f", "r", "m", 1), ("f", "s", "x", 13), ("f", "t", "x", 13), ("f", "u", "x", 13)], "file string, rule string, message string, line int")
    old = spark.createDataFrame([("f", "r", "m", 1, 5), ("f", "s", "z", 12, 5), ("f", "t", "z", 12, 50), ("f", "u", "z", 12, None)], "file string, rule string, message string, line int, expires int")
    got = {r.rule: r.status for r in baseline.diff(new, old, now=10).collect()}
    assert got == {"r": "expired", "s": "expired", "t": "existing", "u": "existing"}


def test_graph(spark):
    e = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A"), ("D", "A"), ("X", "Y")], "src string, dst string")
    roots = spark.createDataFrame([("A",)], "node string")
    assert {r.node: r.distance for r in graph.distances(e, roots).collect()} == {"A": 0, "B": 1, "C": 2}
    assert [r.cycle for r in graph.cycles(e).collect()] == [["A", "B", "C"]]
    assert {r.node: r.component for r in graph.components(e).collect()} == {"A": "A", "B": "A", "C": "A", "D": "A", "X": "X", "Y": "X"}


def test_graph_has_no_silent_depth_limit(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(7)], "src string, dst string")
    roots = spark.createDataFrame([("n00",)], "node string")
    with pytest.raises(ValueError):
        graph.distances(chain, roots, most=3)
    with pytest.raises(ValueError):
        graph.levels(chain, most=3)
    monkeypatch.setattr(graph, "PARTS", 2)
    assert {r.node: r.distance for r in graph.distances(chain, roots, most=7).collect()} == {f"n{i:02}": i for i in range(8)}
    assert {r.node: r.level for r in graph.levels(chain, most=8).collect()} == {f"n{i:02}": 7 - i for i in range(8)}


def test_scores_and_windows(spark):
    row = spark.range(1).select(metrics.quality_score(F.lit(3), F.lit(10), F.lit(1), F.lit(2)).alias("q"), metrics.percentage_change(F.lit(0.0), F.lit(5.0)).alias("a"), metrics.percentage_change(F.lit(10.0), F.lit(12.0)).alias("b")).first()
    assert (round(row.q, 4), row.a, row.b) == (79.0, 100.0, 20.0)  # 100 - 5 - 10 - 6
    df = spark.createDataFrame([("k", t) for t in (0, 4, 9, 10, 25)], "k string, t long")
    assert [r.window for r in metrics.anchored_windows(df, "k", "t", 10).orderBy("t").collect()] == [1, 1, 1, 2, 3]
    x = metrics.timing(spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 10)], "k string, v double"), "k", "v").first()
    assert round(x.p95, 6) == 9.1 and x.p50 == 3.0


def test_fixes(spark):
    edits = spark.createDataFrame([("f", 1, 1, 5, True), ("f", 2, 4, 8, False), ("f", 3, 8, 9, False), ("f", 4, 100, 300, False), ("f", 5, 200, 210, False)], "file string, fix int, lo int, hi int, preferred boolean")
    c = fixes.overlaps(edits)
    assert sorted((r.fix1, r.fix2) for r in c.collect()) == [(1, 2), (4, 5)]
    assert sorted(r.fix for r in fixes.resolve(edits, c).collect()) == [1, 3, 4]
    assert sorted(r.fix for r in fixes.resolve(edits, c, "prefer_smaller").collect()) == [1, 3, 5]
    assert sorted(r.fix for r in fixes.resolve(edits, c, "skip_all").collect()) == [3]
    files = spark.createDataFrame([("f", "hello world"), ("g", "x")], "file string, content string")
    e = spark.createDataFrame([("f", 6, 11, "all"), ("f", 0, 5, "bye"), ("f", 3, 8, "no")], "file string, lo int, hi int, text string")
    assert {r.file: r.content for r in fixes.apply_edits(files, e).collect()} == {"f": "bye all", "g": "x"}


@pytest.mark.parametrize(
    "source, want",
    [
        ("(0 - 7) / 2", -4), ("(0 - 7) % 2", 1), ("7 % (0 - 2)", -1), ("round(2.5)", 2), ('length("ab") + 1', 3), ('"a" ++ "b"', "ab"), ("1 : [2, 3]", [1, 2, 3]),
        ("2 in [1, 2]", True), ('contains("b", "abc")', True), ("let x = 3 in x * x", 9), ("if 1 < 2 then 10 else 20", 10), (r"foldl(\a b -> a + b, 0, [1, 2, 3])", 6),
        (r"foldr(\x a -> x - a, 0, [5, 3])", 2), ("tail([1, 2])", [2]), ("init([1, 2])", [1]), ("take(1, [1, 2])", [1]), ("drop(1, [1, 2])", [2]), ("union([1, 2], [2, 3])", [1, 2, 3]),
        ("isSubset([1], [1, 2])", True), ("product([2, 3])", 6), ("{a = 1, b = 2}.b", 2), ("[4, 5][1]", 5), ('isVariable("xs")', True), ('isLiteral("")', True), ('arity("f x y")', 2), ("not (1 == 2) && True", True),
        ('split(",", "a,b")', ["a", "b"]), (r"zipWith(\a b -> a * b, [1, 2], [3, 4])", [3, 8]), (r"all(\x -> x > 0, [1, 2])", True), ('strip("  a ")', "a"),
    ],
)
def test_expressions(spark, source, want):
    assert spark.range(1).select(exprlang.to_column(source).alias("v")).first().v == want


@pytest.mark.parametrize("source", ["1 +", "nope(1)", "(1", "#", "[1, 2", "1 2"])
def test_bad_expressions(source):
    with pytest.raises(exprlang.ExprError):
        exprlang.to_column(source)


def test_lines_imports_and_globs(spark, tmp_path):
    files = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None), (4, "import qualified Data.Map as M\nimport Data.List (nub, sort)\nimport X hiding (y)\n")], "doc_id long, text string")
    assert text.lines(files).groupBy("file_id").count().orderBy("file_id").collect() == [(1, 2), (4, 3)]
    got = [(r.imported, r.qualified, r.alias, r.hiding, r["items"]) for r in text.imports(text.lines(files)).orderBy("line_no").collect()]
    assert got == [("Data.Map", True, "M", False, None), ("Data.List", False, None, False, ["nub", "sort"]), ("X", False, None, True, ["y"])]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.hs").write_text("one\ntwo\n")
    (tmp_path / "y.txt").write_text("no")
    (tmp_path / "skip.hs").write_text("no")
    assert [r.content for r in text.read_files(spark, str(tmp_path), "*.hs", exclude=("**/skip.hs",)).collect()] == ["one\ntwo\n"]


def test_sinks(spark):
    f = spark.createDataFrame([("a.hs", 3, 7, 0, "r<1>", 'say "x" & y')], "file string, line int, col int, severity int, rule string, message string")
    assert '"severity":"error"' in sinks.json_rows(f).first().value
    assert '"level":"error"' in sinks.sarif_rows(f).first().value and '"startColumn":7' in sinks.sarif_rows(f).first().value
    assert sinks.checkstyle_rows(f).first().value == '<error line="3" column="7" severity="error" message="say &quot;x&quot; &amp; y" source="r&lt;1&gt;"/>'
    assert sinks.junit_suites(f).first().value == '<testsuite name="a.hs" tests="1" failures="1">'
    assert '"severity":"critical"' in sinks.code_climate_rows(f).first().value
    s = spark.createDataFrame([("c", "r", 1.4), ("c", "r", 1.4)], "category string, rule string, ms double")
    assert sinks.flame_rows(s).first().value == "c;r 3"


def test_streaming_matches_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("head xs\nno\n")
    (src / "b.txt").write_text("ahead\nhead\n")
    stream = spark.readStream.format("text").option("wholetext", True).schema("value string").load(str(src)).select(F.lit("f").alias("path"), F.col("value").alias("content"))
    hits = incremental.stream_hits(stream, [rules.Rule("head", "head")]).select("file_id", "line_no", "rule")
    q = hits.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    assert sorted(r.line_no for r in spark.read.parquet(str(out)).collect()) == [1, 2]


def test_rules_from_toml_and_precedence(spark, tmp_path):
    from sourcelode.sources import config

    (tmp_path / "r.toml").write_text('[[rules]]\nid = "a"\npattern = "head"\nseverity = "error"\nwithin = ["Data*"]\nwhere = [["not", ["not_in_import"]]]\n')
    mine = config.parse_rules(config.read_text(spark, str(tmp_path / "r.toml")))
    assert mine == [rules.Rule("a", "head", severity=0, within=("Data*",), conditions=(("not", ("not_in_import",)),))]
    assert config.merge([rules.Rule("a", "x"), rules.Rule("b", "y")], mine) == [*mine, rules.Rule("b", "y")]
    with pytest.raises(ValueError):
        config.parse_rules('[[rules]]\nid = "a"\npattern = "x"\nseverty = "error"\n')


def test_levels_and_plugin(spark):
    from sourcelode.functions.plugins import run_plugin

    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("a", "c")], "src string, dst string")
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"c": 0, "b": 1, "a": 2}
    found = run_plugin(lines_of(spark, "ok", "x" * 90), lambda t: [("long-line", 2, str(len(t)))] if len(t) > 80 else [])
    assert [(r.line_no, r.rule, r.message) for r in found.collect()] == [(2, "long-line", "90")]


def test_the_literal_gate_is_held_by_every_match():
    q = lambda p: rules.required_literal(rules.Rule("r", p, regex=True))
    assert [q(p) for p in ("a|b", "ab?cd*(efgh)+x{0,2}yz", r"\bfoo\s+bar", "[]abc]de+f", r"[0-9]{1,3}\.[0-9]", "(?i)abc")] == ["", "yz", "foo", "de", ".", ""]
    assert rules.required_literal(rules.Rule("r", "$X of $Y")) == " of "


def test_matching_keeps_the_first_match_with_its_captures_and_conditions(spark):
    lines = spark.createDataFrame([(1, 1, "a of b of c"), (1, 2, "nothing here"), (1, 3, None), (1, 4, "-- x of y"), (1, 5, "")], "file_id long, line_no int, text string")
    pair = rules.Rule("p", "$X of $Y", conditions=(("not_equal", "$X", "$Y"),))
    code = rules.Rule("c", "of", target="code")
    empty = rules.Rule("e", "z*", regex=True)
    got = sorted((r.line_no, r.rule, r.col, r.matched, r.captures) for r in rules.match(lines, [pair, code, empty]).collect())
    assert got == [(1, "c", 3, "of", None), (1, "p", 1, "a of b", {"$X": "a", "$Y": "b"}), (4, "p", 4, "x of y", {"$X": "x", "$Y": "y"})]
    assert rules.match(lines, []).count() == 0


def test_unused_items_know_children_and_leave_wildcards_and_hidings(spark):
    rows = [(1, "M", False, ["a", "T(x, y)", "U(..)", "(+++)"]), (1, "N", True, ["b"]), (1, "O", False, None), (2, "M", False, ["a"])]
    got = imports.unused(spark.createDataFrame(rows, "file_id long, imported string, hiding boolean, items array<string>"), spark.createDataFrame([(1, "y"), (2, "a"), (2, "a")], "file_id long, name string"))
    assert [tuple(r) for r in got.collect()] == [(1, "M", ["(+++)", "a"])]


def test_reports_on_no_findings(spark):
    none = spark.createDataFrame([], "file_id long, rule string, category string, severity int")
    r = reports.summary(none).first()
    assert (r.files, r.issues, r.debt, r.security_score, r.risk) == (0, 0, 0, 100.0, "minimal")
    assert reports.top_issues(none, 3).count() == 0 and reports.breakdown(none, "rule").count() == 0


def test_a_catalogue_of_1153_rules_gives_what_single_rules_give(spark):
    from sourcelode.operators import catalogue

    rs = [*catalogue.configurable(), rules.Rule("re", "[0-9]+x", regex=True), rules.Rule("scoped", "zap", within=("A*",), excepted=("AB",)), rules.Rule("code", "zap", target="code"), rules.Rule("cond", "f $X $N", conditions=(("not_equal", "$X", "$N"),))]
    rs += [rules.Rule(f"word-{i}", f"word{i}") for i in range(1153 - len(rs))]
    texts = ["length xs == 0", "concat $ map f xs", "let y = head (sort zs) in word7 word77", 'zap "zap"', '-- zap 12x', "f e 15", "trace msg value", "xs !! 3", None, "", "fromJust m >>= return x"]
    lines = spark.createDataFrame([(i, 1, t, ("AA", "AB", "B")[i % 3]) for i, t in enumerate(texts * 2)], "file_id long, line_no int, text string, module string")
    row = lambda r: (r.file_id, r.rule, r.severity, r.col, r.matched, str(sorted((r.captures or {}).items())))
    got = sorted(map(row, rules.match(lines, rs, scope="module").collect()))
    few = [r for r in rs if r.id in {g[1] for g in got} or r.id in ("word-1", "re", "scoped", "code", "cond")][:60]
    want = sorted(map(row, rules.match(lines, few, scope="module").collect()))
    assert len(rs) == 1153 and got == want and {"performance/length-null", "scoped", "code", "cond", "re", "word-7", "partial/bang-index"} <= {g[1] for g in got}


def test_typed_metavariables(spark):
    one = lambda pattern, text, **k: (rules.match(lines_of(spark, text), [rules.Rule("r", pattern, **k)]).collect() or [None])[0]
    assert one("take $N $X", "take 5 xs").captures == {"$N": "5", "$X": "xs"} and one("take $N $X", "take n xs") is None
    assert one("$T -> $F", "Int -> go").captures == {"$T": "Int", "$F": "go"} and one(":: $T", ":: int") is None
    assert one("a _y", "a b").captures == {"_y": "b"} and one("f $X", "f 3") is None
    assert one("head $X", "x = head (sort ys)", dialect="any").captures == {"$X": "(sort ys)"}
    assert one("$X + $X", "a + b").captures == {"$X": "a"}
    hits = rules.match(lines_of(spark, "f ab cd"), [rules.Rule("r", "f $X $XS")])
    assert hits.select(rules.interpolate(F.lit("$XS $X"), F.col("captures")).alias("m")).first().m == "cd ab"
