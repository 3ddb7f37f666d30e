r"""A small typed expression language compiled to Spark columns.

Literals, variables, calls f(a, b), lambdas \x -> e, let x = e in e, if a then b
else c, lists, records {a = 1}, field access r.a, indexing l[i], and operators
|| && == /= < <= > >= in ++ : + - * / %. Integer division floors, the remainder
takes the divisor's sign, and division by zero is an error. Nothing is evaluated
on the driver: the result is one column that Catalyst plans like any other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r'\s*(?:(\d+\.\d+|\d+)|("(?:[^"\\]|\\.)*")|(\$?[A-Za-z_][A-Za-z0-9_\']*)|(\+\+|->|==|/=|<=|>=|&&|\|\||[-+*/%<>()\[\]{},:=.\\]))')
LEVELS = [["||"], ["&&"], ["==", "/=", "<", "<=", ">", ">=", "in"], [":"], ["++"], ["+", "-"], ["*", "/", "%"]]
RIGHT = {":", "++"}


class ExprError(ValueError):
    """The text is no expression, or names something unknown."""


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ExprError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        out.append(m.group(0).strip())
        at = m.end()
    return out


def parse(text: str):
    """Nested tuples: ("lit", v), ("var", n), ("call", f, args), ("lam", x, e), ("let", x, a, b), ("if", a, b, c), ("op", o, a, b), ("list", xs), ("rec", kv), ("field", e, n), ("at", e, i)."""
    toks, pos, plain = tokenize(text), 0, 0  # plain: depth of let values, where "in" ends the value

    def peek():
        return toks[pos] if pos < len(toks) else None

    def take(want=None):
        nonlocal pos
        t = peek()
        if t is None or (want and t != want):
            raise ExprError(f"expected {want or 'more'}, found {t}")
        pos += 1
        return t

    def expr():
        if peek() == "\\":
            take()
            names = [take()]
            while peek() != "->":
                names.append(take())
            take("->")
            return ("lam", names, expr())
        if peek() == "let":
            nonlocal plain
            take()
            name = take()
            take("=")
            plain += 1
            value = expr()
            plain -= 1
            take("in")
            return ("let", name, value, expr())
        if peek() == "if":
            take()
            a = expr()
            take("then")
            b = expr()
            take("else")
            return ("if", a, b, expr())
        return binary(0)

    def binary(level):
        if level == len(LEVELS):
            return unary()
        left = binary(level + 1)
        while peek() in LEVELS[level] and not (plain and peek() == "in"):
            o = take()
            left = ("op", o, left, binary(level if o in RIGHT else level + 1))
            if o in RIGHT:
                break
        return left

    def unary():
        if peek() == "-":
            take()
            return ("op", "-", ("lit", 0), unary())
        if peek() == "not" and pos + 1 < len(toks) and toks[pos + 1] != "(":
            take()
            return ("call", "not", [unary()])
        return postfix()

    def postfix():
        e = atom()
        while peek() in ("(", "[", "."):
            t = take()
            if t == "(":
                args = items(")")
                if e[0] != "var":
                    raise ExprError("only named functions are called")
                e = ("call", e[1], args)
            elif t == "[":
                e = ("at", e, expr())
                take("]")
            else:
                e = ("field", e, take())
        return e

    def items(close):
        out = []
        while peek() != close:
            out.append(expr())
            if peek() == ",":
                take()
            elif peek() != close:
                raise ExprError(f"expected , or {close}, found {peek()}")
        take(close)
        return out

    def atom():
        t = take()
        if t == "(":
            e = expr()
            take(")")
            return e
        if t == "[":
            return ("list", items("]"))
        if t == "{":
            fields = []
            while peek() != "}":
                name = take()
                take("=")
                fields.append((name, expr()))
                if peek() == ",":
                    take()
            take("}")
            return ("rec", fields)
        if t[0].isdigit():
            return ("lit", float(t) if "." in t else int(t))
        if t[0] == '"':
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if t in ("True", "False"):
            return ("lit", t == "True")
        if re.match(r"[$A-Za-z_]", t):
            return ("var", t)
        raise ExprError(f"unexpected {t}")

    tree = expr()
    if peek() is not None:
        raise ExprError(f"unexpected {peek()}")
    return tree


def _mod(a, b):
    safe = F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(b)
    return ((a % safe) + safe) % safe


def _fold(f, z, xs):
    return F.aggregate(xs, z, f)


_KEYWORDS = ("if", "case", "let", "where", "do")
FUNCTIONS: dict[str, Callable[..., Column]] = {
    # strings
    "length": lambda s: F.length(s), "size": lambda xs: F.size(xs), "toUpper": F.upper, "toLower": F.lower,
    "strip": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""), "split": lambda d, s: F.split(s, F.concat(F.lit(r"\Q"), d, F.lit(r"\E"))),
    "contains": lambda a, s: F.contains(s, a), "startsWith": lambda a, s: F.startswith(s, a), "endsWith": lambda a, s: F.endswith(s, a),
    "replace": lambda a, b, s: F.replace(s, a, b), "regexMatch": lambda r, s: F.regexp_like(s, r), "regexFind": lambda r, s: F.regexp_extract_all(s, r, F.lit(0)),
    # lists
    "head": lambda xs: F.get(xs, F.lit(0)), "last": lambda xs: F.try_element_at(xs, F.lit(-1)),
    "tail": lambda xs: F.slice(xs, 2, F.greatest(F.size(xs), F.lit(1))), "init": lambda xs: F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))),
    "take": lambda n, xs: F.slice(xs, 1, F.greatest(n.cast("int"), F.lit(0))), "drop": lambda n, xs: F.slice(xs, F.greatest(n.cast("int"), F.lit(0)) + 1, F.greatest(F.size(xs), F.lit(1))),
    "reverse": F.reverse, "sort": F.array_sort, "nub": F.array_distinct, "concat": F.flatten, "flatten": F.flatten,
    "filter": lambda f, xs: F.filter(xs, f), "map": lambda f, xs: F.transform(xs, f), "foldl": _fold,
    "foldr": lambda f, z, xs: F.aggregate(F.reverse(xs), z, lambda a, x: f(x, a)),
    "all": lambda f, xs: F.forall(xs, f), "any": lambda f, xs: F.exists(xs, f), "elem": lambda x, xs: F.array_contains(xs, x), "notElem": lambda x, xs: ~F.array_contains(xs, x),
    "zip": lambda a, b: F.transform(F.slice(a, 1, F.least(F.size(a), F.size(b))), lambda x, i: F.struct(x.alias("fst"), F.get(b, i).alias("snd"))),
    "zipWith": lambda f, a, b: F.transform(F.slice(a, 1, F.least(F.size(a), F.size(b))), lambda x, i: f(x, F.get(b, i))),
    # sets are sorted lists without repeats
    "fromList": lambda xs: F.array_sort(F.array_distinct(xs)), "toList": lambda xs: xs, "union": lambda a, b: F.array_sort(F.array_union(a, b)),
    "intersect": lambda a, b: F.array_sort(F.array_intersect(a, b)), "difference": lambda a, b: F.array_sort(F.array_except(a, b)), "isSubset": lambda a, b: F.size(F.array_except(a, b)) == 0,
    # numbers
    "abs": F.abs, "max": F.greatest, "min": F.least, "sum": lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x),
    "product": lambda xs: F.aggregate(xs, F.lit(1).cast("bigint"), lambda a, x: a * x), "ceiling": F.ceil, "floor": F.floor, "round": lambda x: F.bround(x).cast("bigint"),
    # source text
    "complexity": lambda s: F.length(F.regexp_replace(s, "[^()$.|&]", "")) + 2 * reduce(lambda a, b: a + b, [F.contains(s, F.lit(k)).cast("int") for k in _KEYWORDS]),
    "isLiteral": lambda s: s.rlike(r'^([0-9.]*|".*"|\'.*\')$'), "isVariable": lambda s: s.rlike(r"^[a-z_][A-Za-z0-9_']*$"), "isApplication": lambda s: F.contains(s, F.lit(" ")),
    "isLambda": lambda s: F.startswith(F.ltrim(s), F.lit("\\")), "isAtomic": lambda s: ~F.contains(s, F.lit(" ")), "arity": lambda s: F.size(F.split(F.trim(s), r"\s+")) - 1,
    "freeVars": lambda s: F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b([a-z_][A-Za-z0-9_']*)"), F.lit(1)))),
    # control
    "if": lambda c, a, b: F.when(c, a).otherwise(b), "not": lambda a: ~a, "error": lambda m: F.raise_error(m), "trace": lambda m, x: x, "show": lambda x: x.cast("string"), "read": lambda s: F.expr("null") if s is None else s.try_cast("bigint"),
}


def to_column(text: str, context: dict[str, Column] | None = None) -> Column:
    """The column of an expression; variables come from context, else they are columns of the row."""

    def build(t, env):
        kind = t[0]
        if kind == "lit":
            return F.lit(t[1]).cast("bigint") if isinstance(t[1], int) and not isinstance(t[1], bool) else F.lit(t[1])
        if kind == "var":
            return env[t[1]] if t[1] in env else F.col(t[1].lstrip("$"))
        if kind == "lam":
            if len(t[1]) == 1:
                return lambda x: build(t[2], env | {t[1][0]: x})
            return lambda x, y: build(t[2], env | dict(zip(t[1], (x, y))))
        if kind == "let":
            return build(t[3], env | {t[1]: build(t[2], env)})
        if kind == "if":
            return F.when(build(t[1], env), build(t[2], env)).otherwise(build(t[3], env))
        if kind == "list":
            return F.array(*[build(x, env) for x in t[1]])
        if kind == "rec":
            return F.struct(*[build(v, env).alias(k) for k, v in t[1]])
        if kind == "field":
            return build(t[1], env)[t[2]]
        if kind == "at":
            return F.get(build(t[1], env), build(t[2], env).cast("int"))
        if kind == "call":
            if t[1] not in FUNCTIONS:
                raise ExprError(f"unknown function {t[1]}")
            return FUNCTIONS[t[1]](*[build(x, env) for x in t[2]])
        o, a, b = t[1], build(t[2], env), build(t[3], env)
        whole = lambda x: x[0] == "lit" and isinstance(x[1], int) or x[0] == "op" and x[1] in "+-*/%" and whole(x[2]) and whole(x[3]) or x[0] == "call" and x[1] in ("length", "size", "sum", "product", "round", "floor", "ceiling")
        match o:
            case "||":
                return a | b
            case "&&":
                return a & b
            case "==":
                return a.eqNullSafe(b)
            case "/=":
                return ~a.eqNullSafe(b)
            case "in":
                return F.contains(b, a) if t[3][0] == "lit" else F.array_contains(b, a)
            case "++":
                return F.concat(a, b)
            case ":":
                return F.array_prepend(b, a)
            case "/":
                return ((a - _mod(a, b)) / b).cast("bigint") if whole(t[2]) and whole(t[3]) else a / b
            case "%":
                return _mod(a, b)
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "+": a + b, "-": a - b, "*": a * b}[o]

    return build(parse(text), dict(context or {}))
