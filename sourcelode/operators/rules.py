"""Declarative line rules, matched in one pass over the lines.

Up to WIDE rules become one array of match structs per line, a column expression.
More are rows of a table: one multi-pattern scan finds the rules whose required
literal a line holds, and only these pairs meet the rule's expression. Either
way lines are scanned once and never shuffled; rows appear only for matches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ("error", "warning", "suggestion", "info")  # ordinal 0 is the worst
WORD_EDGE = re.compile(r"[A-Za-z0-9_']")
DOLLAR, UNDERSCORE = re.compile(r"\$[A-Z][A-Z0-9_]*"), re.compile(r"_[a-z][a-zA-Z0-9_]*")
WIDE = 64
#: Conditions that need types or a syntax tree; they hold in text mode.
HOLD = frozenset(
    "has_type has_type_class type_matches is_maybe is_monad is_pure is_application is_lambda free_in not_free_in complexity_lt complexity_gt complexity_cond "
    "not_bind is_eta_reducible no_deriving_strategy wildcard_not_last has_pattern_overlap is_pattern_incomplete has_ambiguous_type uses_default_options in_context".split()
)
#: Columns of the lines that conditions about a file read.
READS = {"in_test_file": "path", "not_in_test_file": "path", "in_module": "module", "has_import": "content", "has_pragma": "content"}
# What a metavariable stands for, by name; others stand for an identifier, in the dialect "any" for anything.
FUNCTION, NUMBER, TYPE, IDENTIFIER, ANYTHING = r"([a-z][a-zA-Z0-9'_]*)", r"([0-9]+)", r"([A-Z][a-zA-Z0-9'_]*)", r"([a-zA-Z_][a-zA-Z0-9_']*)", r"(.+)"
CAPTURES = {"identifier": {"$F": FUNCTION, "$FUNC": FUNCTION, "$N": NUMBER, "$T": TYPE, "$TYPE": TYPE}, "any": {"$F": FUNCTION, "$FUNC": FUNCTION, "$N": NUMBER}}


@dataclass(frozen=True)
class Rule:
    """pattern is literal text (with $X or _x metavariables) or, if regex, a regular expression."""

    id: str
    pattern: str
    message: str = ""
    severity: int = 1
    category: str = "general"
    regex: bool = False
    enabled: bool = True
    within: tuple[str, ...] = ()
    excepted: tuple[str, ...] = ()
    target: str = "any"  # any, code, comment, string
    conditions: tuple = field(default=())
    replacement: str | None = None
    dialect: str = "identifier"  # or any: what $X stands for


def smart_boundary(text: str) -> str:
    """Literal pattern; word boundaries only where its ends are word characters."""
    before = r"\b" if text and WORD_EDGE.match(text[0]) else ""
    after = r"\b" if text and WORD_EDGE.match(text[-1]) else ""
    return before + escaped(text) + after


def escaped(text: str) -> str:
    return re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", text)


def metavariables(rule: Rule) -> list[str]:
    """Names of a pattern's metavariables, each once: those with a dollar sign, then those with an underscore (not in the dialect any)."""
    if rule.regex:
        return []
    found = DOLLAR.findall(rule.pattern) + (UNDERSCORE.findall(rule.pattern) if rule.dialect != "any" else [])
    return list(dict.fromkeys(found))


def compile_pattern(rule: Rule) -> tuple[str, list[str]]:
    """Regular expression and the names that its groups give values to, in order.

    A pattern with a dollar sign or a metavariable has no word boundaries. Names go to groups by position, so a
    repeated metavariable shifts the names behind it; equal values are not asked for.
    """
    if rule.regex:
        return rule.pattern, []
    names = metavariables(rule)
    if not names and "$" not in rule.pattern:
        return smart_boundary(rule.pattern), []
    out, classes = escaped(rule.pattern), CAPTURES[rule.dialect]
    for name in reversed(names):
        out = out.replace(escaped(name), classes.get(name, ANYTHING if rule.dialect == "any" else IDENTIFIER))
    return out, names


def required_literal(rule: Rule) -> str:
    """A text that every match of the rule holds; empty if none is certain. A cheap gate before the expression."""
    if not rule.regex:
        names = sorted(metavariables(rule), key=len, reverse=True)
        return max(re.split("|".join(map(re.escape, names)), rule.pattern), key=len) if names else rule.pattern
    x, runs, run, depth, i = rule.pattern, [], "", 0, 0
    if "|" in x or "(?" in x or r"\Q" in x:
        return ""
    while i < len(x):
        c, i = x[i], i + 1
        known = ""
        if c == "\\" and i < len(x):
            known, i = ("" if x[i].isalnum() else x[i]), i + 1
        elif c == "[":
            i += 1 + (x[i : i + 1] == "^")  # a bracket that stands first belongs to the class
            while i < len(x) and x[i] != "]":
                i += 1 + (x[i] == "\\")
            i += 1
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$*+?{}":
            known = c
        if known and depth == 0 and x[i : i + 1] not in ("*", "?", "{"):
            run += known
            if x[i : i + 1] != "+":
                continue
        runs.append(run)
        run = ""
        if x[i : i + 1] == "{":
            i = x.find("}", i) + 1 or len(x)
    return max([*runs, run], key=len)


def glob_match(name: Column, glob: str) -> Column:
    """*x* infix, *x suffix, x* prefix, else equality."""
    if glob == "*":
        return F.lit(True)
    if len(glob) > 1 and glob[0] == glob[-1] == "*":
        return name.contains(glob[1:-1])
    if glob.startswith("*"):
        return name.endswith(glob[1:])
    if glob.endswith("*"):
        return name.startswith(glob[:-1])
    return name == glob


def in_scope(rule: Rule, scope: Column) -> Column:
    """Exceptions win; without a within list every scope is in."""
    out = F.lit(True)
    if rule.within:
        out = F.lit(False)
        for g in rule.within:
            out = out | glob_match(scope, g)
    for g in rule.excepted:
        out = out & ~glob_match(scope, g)
    return F.coalesce(out, F.lit(not rule.within))


def region(text: Column, column: Column) -> Column:
    """comment, string or code at a column of a line, by what stands before it."""
    before = F.substring(text, F.lit(1), column - 1)
    quotes = F.regexp_count(F.regexp_replace(before, r'\\\\.', ""), F.lit('"'))
    return F.when(before.rlike(r"(^|\s)--") | before.contains("{-"), "comment").when(quotes % 2 == 1, "string").otherwise("code")


def side_condition(condition: tuple, text: Column, captures: Column) -> Column:
    """Text-mode side conditions as a column; a condition is a tuple of its name and arguments.

    Conditions that need types or a syntax tree (HOLD) hold in text mode; a name
    that is not known is an error, and so is in_comment_type, which needs an index
    of a file's comments. Conditions about a file read the columns in READS.
    """
    name, *args = condition
    var = lambda: captures[args[0]]
    match name:
        case "and" | "or":
            parts = [side_condition(c, text, captures) for c in args]
            out = parts[0] if parts else F.lit(name == "and")
            for p in parts[1:]:
                out = (out & p) if name == "and" else (out | p)
            return out
        case "not":
            return ~side_condition(args[0], text, captures)
        case "always" | "never":
            return F.lit(name == "always")
        case "not_in_comment":
            return ~text.rlike(r"^\s*--")
        case "not_in_string":
            return F.regexp_count(text, F.lit('"')) % 2 == 0
        case "not_in_import":
            return ~F.ltrim(text).startswith("import ")
        case "is_literal":
            return F.coalesce(var().rlike(r'^([0-9.]*|".*"|\'.*\')$'), F.lit(False))
        case "is_variable":
            return F.coalesce(var().rlike(r"^[a-z_][A-Za-z0-9_']*$"), F.lit(False))
        case "is_constructor":
            return F.coalesce(var().rlike(r"^[A-Z]"), F.lit(False))
        case "is_atomic":
            return F.coalesce(~var().contains(" "), F.lit(False))
        case "not_equal":
            return F.coalesce(captures[args[0]] != captures[args[1]], F.lit(True))
        case "not_in":
            return F.coalesce(~var().isin(*args[1]), F.lit(True))
        case "matches":
            return text.rlike(args[0])
        case "in_function_body":
            return text.rlike(r"^\s*$")  # the reference negates "any non-blank line is at the top level"
        case "in_string_literal":
            return F.regexp_count(text, F.lit('"')) % 2 == 1
        case "is_numeric":
            return F.coalesce(var().rlike(r"^-*(?=[^-])[0-9.eE_+-]*$") & var().rlike("[0-9]"), F.lit(True))
        case "is_string":
            return F.coalesce((F.length(var()) >= 2) & var().startswith('"') & var().endswith('"'), F.lit(True))
        case "is_list":
            return F.coalesce((F.length(var()) >= 2) & var().startswith("[") & var().endswith("]"), F.lit(True))
        case "type_contains":
            return F.coalesce(var().contains(args[1]), F.lit(True))
        case "has_import" | "has_pragma":
            return F.coalesce(F.col(READS[name]).contains(args[0]), F.lit(False))
        case "in_module":
            return F.coalesce(glob_match(F.col(READS[name]), args[0]), F.lit(False))
        case "in_test_file" | "not_in_test_file":
            test = F.coalesce(F.col(READS[name]).rlike("Test|Spec|tests?/"), F.lit(False))
            return test if name == "in_test_file" else ~test
    if name not in HOLD:
        raise ValueError(f"unknown or unsupported side condition {name}")
    return F.lit(True)


def columns_read(conditions: tuple) -> set[str]:
    """Columns of the lines, besides the text, that conditions read."""
    out = set()
    for name, *args in conditions:
        out |= columns_read(tuple(args)) if name in ("and", "or", "not") else {READS[name]} if name in READS else set()
    return out


def match(lines: DataFrame, rules: list[Rule], scope: str | None = None) -> DataFrame:
    """file_id, line_no, rule, category, severity, col (from 1), matched, captures: the first match of each rule on each line.

    One pass finds the position of every rule's match, searching a line for a
    rule's expression once and only if it holds the rule's literal part. What
    was matched is worked out from there, for matches only.
    """
    text, at = F.col("text"), F.col("hit.at")
    rules = [r for r in rules if r.enabled]
    if len(rules) > WIDE:
        return _match_table(lines, rules, scope)
    found, what, captures, ok = [], F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"), F.lit(True)
    for i, r in enumerate(rules):
        regex, names = compile_pattern(r)
        gate, needed = F.lit(True), required_literal(r)
        if scope and (r.within or r.excepted):
            gate = gate & in_scope(r, F.col(scope))
        if needed:
            gate = gate & text.contains(needed)
        found.append(F.struct(F.lit(i).alias("i"), F.when(gate, F.regexp_instr("text", F.lit(regex))).otherwise(0).alias("at")))
        this = F.col("hit.i") == i
        rest, anchored = F.expr("substring(text, hit.at)"), "^(?:" + regex + ")"
        mine = F.regexp_extract(text, regex, 0) if r.regex else F.regexp_extract(rest, anchored, 0) if names else F.lit(r.pattern)
        what = F.when(this, mine).otherwise(what)
        caught = F.lit(None).cast("map<string,string>")
        if names:
            caught = F.create_map(*[x for k, n in reversed(list(enumerate(names))) for x in (F.lit(n), F.regexp_extract(rest, anchored, k + 1))])
            captures = F.when(this, caught).otherwise(captures)
        holds = [region(text, at) == r.target] * (r.target != "any") + [side_condition(c, text, caught) for c in r.conditions]
        for h in holds:
            ok = ok & (~this | h)
    keep = ["file_id", "line_no", *([scope] if scope else [])]
    read = {c for r in rules for c in columns_read(r.conditions)}
    if read - set(lines.columns):
        raise ValueError(f"conditions need lines with the columns {sorted(read - set(lines.columns))}")
    more = sorted(read - {*keep, "text"})
    if not rules:
        rules, found = [Rule("", "")], [F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"))]
    hits = F.filter(F.array(*found), lambda x: x["at"] > 0)
    # the outer form, because the plain one makes the optimizer add filters that work the whole array out again
    rows = lines.select(*keep, *more, "text", F.explode_outer(hits).alias("hit")).where("hit IS NOT NULL").where(ok)
    named = F.array(*[F.struct(F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity")) for r in rules])
    rows = rows.select(*keep, named[F.col("hit.i")].alias("r"), at.alias("col"), what.alias("matched"), captures.alias("captures"))
    return rows.where("length(matched) > 0").select(*keep, "r.*", "col", "matched", "captures")


def _candidates(lines: DataFrame, rules: list[Rule]) -> DataFrame:
    """lines with the array rules: places of the rules whose required literal the line holds, and of those without one."""
    import ahocorasick
    import pyarrow as pa

    always = [i for i, r in enumerate(rules) if not required_literal(r)]
    by: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        if literal := required_literal(r):
            by.setdefault(literal, []).append(i)

    def run(batches):
        machine = ahocorasick.Automaton()
        for literal, places in by.items():
            machine.add_word(literal, places)
        if by:
            machine.make_automaton()
        for b in batches:
            keep, found = [], []
            for n, t in enumerate(b.column(b.schema.get_field_index("text")).to_pylist()):
                if t is not None:
                    hits = {i for _, places in machine.iter(t) for i in places} if by else set()
                    if hits or always:
                        keep.append(n)
                        found.append(sorted([*hits, *always]))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep, pa.int32())).columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, "rules"])

    schema = T.StructType([*lines.schema.fields, T.StructField("rules", T.ArrayType(T.IntegerType()))])
    return lines.mapInArrow(run, schema)


def _match_table(lines: DataFrame, rules: list[Rule], scope: str | None) -> DataFrame:
    """match() for many rules: pairs of a line and a rule from one scan for literals, then the rule's expression from its row."""
    keep = ["file_id", "line_no", *([scope] if scope else [])]
    read = {c for r in rules for c in columns_read(r.conditions)}
    if read - set(lines.columns):
        raise ValueError(f"conditions need lines with the columns {sorted(read - set(lines.columns))}")
    more = sorted(read - {*keep, "text"})
    compiled, special = [compile_pattern(r) for r in rules], {}
    for r in rules:  # rules with equal checks share one
        key = (r.target, r.conditions, *((r.within, r.excepted) if scope else ((), ())))
        if key != ("any", (), (), ()):
            special.setdefault(key, (len(special), r))
    rows = []
    for i, (r, (regex, names)) in enumerate(zip(rules, compiled)):
        key = (r.target, r.conditions, *((r.within, r.excepted) if scope else ((), ())))
        rows.append((i, r.id, r.category, r.severity, regex, names, special.get(key, (-1,))[0]))
    table = lines.sparkSession.createDataFrame(rows, "i int, rule string, category string, severity int, regex string, names array<string>, special int")
    pairs = _candidates(lines.select(*dict.fromkeys([*keep, *more, "text"])), rules)
    pairs = pairs.withColumn("i", F.explode("rules")).drop("rules").join(F.broadcast(table), "i")  # a row a rule
    pairs = pairs.withColumn("col", F.expr("regexp_instr(text, regex)")).where("col > 0")
    pairs = pairs.withColumn("matched", F.expr("regexp_extract(text, regex, 0)")).where("length(matched) > 0")
    caught = F.expr("CASE WHEN size(names) > 0 THEN map_from_arrays(names, transform(names, (n, k) -> regexp_extract(text, regex, k + 1))) END")
    pairs = pairs.withColumn("captures", caught)
    ok = F.lit(True)
    for at, r in special.values():
        holds = [region(F.col("text"), F.col("col")) == r.target] * (r.target != "any") + [side_condition(c, F.col("text"), F.col("captures")) for c in r.conditions]
        if scope and (r.within or r.excepted):
            holds.append(in_scope(r, F.col(scope)))
        for h in holds:
            ok = ok & ((F.col("special") != at) | h)
    return pairs.where(ok).select(*keep, "rule", "category", "severity", "col", "matched", "captures")


def effective_severity(hits: DataFrame, by_rule: dict[str, int], by_category: dict[str, int]) -> DataFrame:
    """Severity overridden by rule, else by category."""
    lookup = lambda d, c: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(c)] if d else F.lit(None).cast("int")
    return hits.withColumn("severity", F.coalesce(lookup(by_rule, "rule"), lookup(by_category, "category"), "severity"))


def interpolate(message: Column, captures: Column) -> Column:
    """A message with its metavariables replaced by their captures."""
    pairs = F.map_entries(captures)
    by_length = F.array_sort(pairs, lambda a, b: F.length(b["key"]) - F.length(a["key"]))  # so that $X never cuts $XS
    return F.when(captures.isNull(), message).otherwise(F.aggregate(by_length, message, lambda m, e: F.replace(m, e["key"], e["value"])))
