"""Row expressions of rules (R03): a small Python-like language as Spark columns.

``compile_expression`` turns an expression such as ``"price > 0 and status.lower() in ('a', 'b')"`` into a
boolean column: true where a row passes, false where it breaks the rule, NULL where the rule does not apply to
the row, because evaluating it fails there: arithmetic or an order on a missing value, values of types that do not
go together, a method of something that is no text, division by zero.  No row can make the job fail: every step is
total (``try_`` arithmetic, guarded conversions), so rules stay in one shared aggregate.

Grammar: names of columns, numbers, texts, ``True``/``False``/``None``; ``+ - * / // %``, unary ``+ -``; ``and or not``;
chains of ``== != < <= > >=``, ``in``/``not in`` a list or a text, ``is (not) None``; ``x if c else y``; the functions and
methods below.  Everything else is refused when the rule is compiled, with ``ExpressionError``.

A missing value is itself a value: it equals only another missing value, is false, and fails in arithmetic
and orders.  ``and``/``or`` and conditionals look only at the branch they take.  Whole numbers are 64 bits wide, beyond
which a result does not apply; floats written out as text outside [1e-3, 1e7) do not apply either.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.columns import col

# ---- fixed values -----------------------------------------------------------
FUNCTIONS = ("abs", "len", "min", "max", "round", "int", "float", "bool", "str")
METHODS = (
    "lower",
    "upper",
    "strip",
    "lstrip",
    "rstrip",
    "isalpha",
    "isdigit",
    "isnumeric",
    "isalnum",
    "isspace",
    "startswith",
    "endswith",
    "isdecimal",
    "title",
    "capitalize",
)
# ---- end of fixed values ----------------------------------------------------

BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_CLASSES = {
    "isalpha": r"\p{L}",
    "isdecimal": r"\p{Nd}",
    "isdigit": r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]",
    "isnumeric": r"\p{N}",
    "isalnum": r"[\p{L}\p{N}]",
    "isspace": BLANK,
}
_NUMBERS = ("bool", "int", "float")


class ExpressionError(ValueError):
    """The expression is not in the language, or names something unknown."""


@dataclass(frozen=True)
class Typed:
    """A compiled part.

    ``fails`` says where evaluating it fails.  None means that it is ``strict``: then NULL is a failure; otherwise NULL is
    the missing value.
    """

    kind: str
    value: Column
    fails: Column | None = None

    @property
    def strict(self) -> bool:
        return self.fails is None

    @property
    def failing(self) -> Column:
        return self.value.isNull() if self.strict else self.fails

    @property
    def bad(self) -> Column:
        """Where it is no use as an operand: failing or missing."""
        return self.value.isNull() if self.strict else self.fails | self.value.isNull()

    @property
    def operand(self) -> Column:
        """The value, NULL where it is no use as an operand."""
        return self.value if self.strict else F.when(~self.fails, self.value)

    def truth(self) -> Column:
        """Python's truth of the value, where evaluating it does not fail."""
        if self.kind == "none":
            return F.lit(False)
        test = {
            "bool": self.value,
            "mixed": self.value,
            "int": self.value != 0,
            "float": self.value != 0,
            "str": F.length(self.value) > 0,
        }.get(self.kind, self.value.isNotNull())
        return F.coalesce(test, F.lit(False))


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "str"
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(t, T.NullType):
        return "none"
    return "other"


def _failure(kind: str = "bool") -> Typed:
    """Fails on every row."""
    return Typed(kind, F.lit(None).cast({"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}[kind]))


def _number(t: Typed, kind: str) -> Column:
    return t.operand.cast({"bool": "int", "int": "bigint", "float": "double"}[kind])


def _joined_kind(a: Typed, b: Typed) -> str:
    """The kind of a value that is one or the other; ``mixed`` values can only be tested for truth."""
    if a.kind == b.kind or b.kind == "none":
        return a.kind
    if a.kind == "none":
        return b.kind
    if a.kind in _NUMBERS and b.kind in _NUMBERS and "bool" not in (a.kind, b.kind):
        return "float"
    return "mixed"


def _choice(test: Column, fails_first: Column | None, a: Typed, b: Typed) -> Typed:
    """``a`` where ``test`` holds, else ``b``; nothing where ``fails_first``."""
    kind = _joined_kind(a, b)
    if kind == "mixed":
        # Values of different kinds: only their truth is known further on.
        a, b = (Typed("bool", x.truth(), x.failing) for x in (a, b))
    elif kind == "float":
        a, b = (Typed("float", x.value.cast("double"), x.fails) for x in (a, b))
    value = F.when(test, a.value).otherwise(b.value)
    if kind != "mixed" and a.strict and b.strict:
        return Typed(kind, value if fails_first is None else F.when(~fails_first, value))
    fails = F.when(test, a.failing).otherwise(b.failing)
    return Typed(kind, value, fails if fails_first is None else fails_first | fails)


class _Compiler:
    def __init__(self, df: DataFrame):
        self.schema = {f.name: f.dataType for f in df.schema.fields}
        self.names: set[str] = set()

    def build(self, node: ast.AST) -> Typed:
        step = getattr(self, f"on_{type(node).__name__}", None)
        if step is None:
            raise ExpressionError(f"not allowed in an expression: {type(node).__name__}")
        return step(node)

    def usable(self, node: ast.AST) -> Typed:
        t = self.build(node)
        if t.kind in ("mixed", "other"):
            raise ExpressionError(f"a value of several types can only be tested: {ast.unparse(node)}")
        return t

    # -- values ---------------------------------------------------------------
    def on_Expression(self, node: ast.Expression) -> Typed:
        return self.build(node.body)

    def on_Name(self, node: ast.Name) -> Typed:
        if node.id not in self.schema:
            raise ExpressionError(f"unknown name: {node.id}")
        self.names.add(node.id)
        kind, c = _kind(self.schema[node.id]), col(node.id)
        c = {"int": lambda: c.cast("bigint"), "float": lambda: c.cast("double"), "str": lambda: c.cast("string")}.get(kind, lambda: c)()
        return Typed(kind, c, F.lit(False))

    def on_Constant(self, node: ast.Constant) -> Typed:
        v = node.value
        if v is None:
            return Typed("none", F.lit(None), F.lit(False))
        if isinstance(v, bool):
            return Typed("bool", F.lit(v))
        if isinstance(v, int):
            if not -(1 << 63) <= v < 1 << 63:
                raise ExpressionError(f"number too large: {v}")
            return Typed("int", F.lit(v).cast("bigint"))
        if isinstance(v, float):
            return Typed("float", F.lit(v))
        if isinstance(v, str):
            return Typed("str", F.lit(v))
        raise ExpressionError(f"not allowed in an expression: {v!r}")

    # -- arithmetic -----------------------------------------------------------
    def on_UnaryOp(self, node: ast.UnaryOp) -> Typed:
        if isinstance(node.op, ast.Not):
            t = self.build(node.operand)
            return Typed("bool", F.when(~t.failing, ~t.truth()))
        t = self.usable(node.operand)
        if not isinstance(node.op, (ast.USub, ast.UAdd)):
            raise ExpressionError("not allowed in an expression: ~")
        if t.kind not in _NUMBERS:
            return _failure("int")
        kind = "int" if t.kind == "bool" else t.kind
        v = _number(t, kind) if t.kind != "bool" else t.operand.cast("bigint")
        if isinstance(node.op, ast.UAdd):
            return Typed(kind, v)
        return Typed(kind, -v if kind == "float" else F.try_subtract(F.lit(0).cast("bigint"), v))

    def on_BinOp(self, node: ast.BinOp) -> Typed:
        a, b, op = self.usable(node.left), self.usable(node.right), type(node.op).__name__
        if op not in ("Add", "Sub", "Mult", "Div", "FloorDiv", "Mod"):
            raise ExpressionError(f"not allowed in an expression: {op}")
        if "str" in (a.kind, b.kind):
            return self.text_arithmetic(a, b, op)
        if not {a.kind, b.kind} <= {*_NUMBERS}:
            return _failure("float" if op == "Div" else "int")
        kind = "float" if "float" in (a.kind, b.kind) or op == "Div" else "int"
        x, y = (t.operand.cast("double" if kind == "float" else "bigint") for t in (a, b))
        if op in ("Add", "Sub", "Mult"):
            if kind == "float":
                return Typed(kind, {"Add": x + y, "Sub": x - y, "Mult": x * y}[op])
            return Typed(kind, {"Add": F.try_add, "Sub": F.try_subtract, "Mult": F.try_multiply}[op](x, y))
        there = y != 0
        if op == "Div":
            return Typed(kind, F.when(there, F.try_divide(x, y)))
        # Rounded down, and a rest with the sign of the divisor.
        rest = F.try_mod(x, y)
        moved = (rest != 0) & ((rest < 0) != (y < 0))
        if op == "Mod":
            return Typed(kind, F.when(there, F.when(moved, rest + y).otherwise(rest)))
        if kind == "float":
            return Typed(kind, F.when(there, F.rint((x - F.when(moved, rest + y).otherwise(rest)) / y)))
        # The one quotient that does not fit is left out.
        least = (x == F.lit(-(1 << 63)).cast("bigint")) & (y == -1)
        quotient = F.call_function("div", x, F.when(there & ~least, y))
        return Typed(kind, F.when(moved, quotient - 1).otherwise(quotient))

    def text_arithmetic(self, a: Typed, b: Typed, op: str) -> Typed:
        if op == "Add" and a.kind == b.kind == "str":
            return Typed("str", F.concat(a.operand, b.operand))
        if op == "Mult" and {a.kind, b.kind} <= {"str", "int", "bool"} and a.kind != b.kind:
            text, times = (a, b) if a.kind == "str" else (b, a)
            times = F.least(F.greatest(times.operand.cast("bigint"), F.lit(0)), F.lit(1 << 20)).cast("int")
            return Typed("str", F.when(times.isNotNull(), F.repeat(text.operand, times)))
        if op == "Mod" and a.kind == "str":
            raise ExpressionError("texts are not formatted in expressions")
        return _failure("str")

    # -- logic ----------------------------------------------------------------
    def on_BoolOp(self, node: ast.BoolOp) -> Typed:
        parts = [self.build(v) for v in node.values]
        stops = (lambda t: ~t.truth()) if isinstance(node.op, ast.And) else (lambda t: t.truth())
        # From the right: each part decides, or leaves it to those after it.
        def decide(rest: Typed, t: Typed) -> Typed:
            # Where ``t`` itself fails is said by the choice.
            return _choice(stops(t), t.failing, t if t.strict else Typed(t.kind, t.value, F.lit(False)), rest)

        return reduce(decide, reversed(parts[:-1]), parts[-1])

    def on_IfExp(self, node: ast.IfExp) -> Typed:
        test = self.build(node.test)
        return _choice(test.truth(), test.failing, self.build(node.body), self.build(node.orelse))

    # -- comparisons ----------------------------------------------------------
    def on_Compare(self, node: ast.Compare) -> Typed:
        left, found = node.left, []
        for op, right in zip(node.ops, node.comparators):
            found.append(self.compared(left, op, right))
            left = right
        return reduce(lambda rest, t: _choice(~t.truth(), t.failing, t, rest), reversed(found[:-1]), found[-1])

    def compared(self, left: ast.AST, op: ast.cmpop, right: ast.AST) -> Typed:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Constant) and right.value is None):
                raise ExpressionError("'is' is only for None")
            t = self.build(left)
            absent = F.lit(True) if t.kind == "none" else t.value.isNull()
            return Typed("bool", F.when(~t.failing, absent if isinstance(op, ast.Is) else ~absent))
        if isinstance(op, (ast.In, ast.NotIn)):
            t = self.within(left, right)
            return t if isinstance(op, ast.In) else Typed("bool", ~t.value)
        a, b = self.usable(left), self.usable(right)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            same = self.equal(a, b)
            return same if isinstance(op, ast.Eq) else Typed("bool", ~same.value)
        alike = a.kind == b.kind and a.kind not in ("none", "other")
        if not (alike or {a.kind, b.kind} <= {*_NUMBERS}):
            return _failure()
        x, y = a.operand, b.operand
        if not alike:
            kind = "double" if "float" in (a.kind, b.kind) else "bigint"
            x, y = x.cast(kind), y.cast(kind)
        held = {ast.Lt: x < y, ast.LtE: x <= y, ast.Gt: x > y, ast.GtE: x >= y}[type(op)]
        if "float" in (a.kind, b.kind):
            held = held & ~F.isnan(x) & ~F.isnan(y)
        return Typed("bool", held)

    def equal(self, a: Typed, b: Typed) -> Typed:
        if "none" in (a.kind, b.kind):
            other = b if a.kind == "none" else a
            same = F.lit(True) if other.kind == "none" else other.value.isNull()
        elif a.kind == b.kind:
            same = a.value.eqNullSafe(b.value)
        elif {a.kind, b.kind} <= {*_NUMBERS}:
            kind = "double" if "float" in (a.kind, b.kind) else "bigint"
            same = a.value.cast(kind).eqNullSafe(b.value.cast(kind))
        else:
            same = a.value.isNull() & b.value.isNull()
        if "float" in (a.kind, b.kind) and {a.kind, b.kind} <= {*_NUMBERS}:
            # Not a number equals nothing, itself included.
            same = same & ~F.coalesce(F.isnan(a.value.cast("double")), F.lit(False))
        return Typed("bool", F.when(~a.failing & ~b.failing, same))

    def within(self, left: ast.AST, right: ast.AST) -> Typed:
        a = self.usable(left)
        if isinstance(right, ast.Dict):
            members = right.keys
        elif isinstance(right, (ast.Tuple, ast.List, ast.Set)):
            members = right.elts
        else:
            b = self.usable(right)
            if a.kind != "str" or b.kind != "str":
                return _failure()
            return Typed("bool", F.contains(b.operand, a.operand))
        if None in members:
            raise ExpressionError("not allowed in an expression: **")
        # Members are all evaluated first, so one that fails makes the test fail.
        tests = [self.equal(a, self.usable(m)).value for m in members]
        return Typed("bool", reduce(lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x | y), tests, F.when(~a.failing, F.lit(False))))

    # -- functions and methods ------------------------------------------------
    def on_Call(self, node: ast.Call) -> Typed:
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise ExpressionError("arguments are given by position")
        if isinstance(node.func, ast.Attribute):
            if node.func.attr not in METHODS:
                raise ExpressionError(f"unknown method: {node.func.attr}")
            return self.method(node.func.attr, self.usable(node.func.value), node.args)
        if not isinstance(node.func, ast.Name) or node.func.id not in FUNCTIONS:
            raise ExpressionError(f"unknown function: {ast.unparse(node.func)}")
        name = node.func.id
        if name in ("min", "max"):
            return self.extreme(name, node.args)
        most = 2 if name == "round" else 1
        if not 1 <= len(node.args) <= most:
            raise ExpressionError(f"{name} takes {most} argument" + "s" * (most > 1))
        if name == "bool":
            t = self.build(node.args[0])
            return Typed("bool", F.when(~t.failing, t.truth()))
        return getattr(self, f"call_{name}")(self.usable(node.args[0]), *node.args[1:])

    def call_abs(self, t: Typed) -> Typed:
        if t.kind not in _NUMBERS:
            return _failure("int")
        if t.kind == "float":
            return Typed("float", F.abs(t.operand))
        v = t.operand.cast("bigint")
        return Typed("int", F.when(v >= 0, v).otherwise(F.try_subtract(F.lit(0).cast("bigint"), v)))

    def call_len(self, t: Typed) -> Typed:
        return Typed("int", F.length(t.operand).cast("bigint")) if t.kind == "str" else _failure("int")

    def call_round(self, t: Typed, digits: ast.AST | None = None) -> Typed:
        sign = isinstance(digits, ast.UnaryOp) and isinstance(digits.op, ast.USub)
        number = digits.operand if sign else digits
        if number is not None and not (isinstance(number, ast.Constant) and type(number.value) is int):
            raise ExpressionError("round takes a whole number of digits")
        places = 0 if number is None else -number.value if sign else number.value
        if t.kind not in _NUMBERS:
            return _failure("int")
        if t.kind != "float":
            return Typed("int", t.operand.cast("bigint") if places >= 0 else F.bround(t.operand.cast("bigint"), places))
        rounded = F.bround(t.operand, places)
        return Typed("float", rounded) if digits is not None else Typed("int", self.whole(rounded))

    @staticmethod
    def whole(x: Column) -> Column:
        """A float as a whole number, where 64 bits hold it."""
        return F.when((F.abs(x) < float(1 << 63)) & ~F.isnan(x), x).cast("bigint")

    def call_int(self, t: Typed) -> Typed:
        if t.kind == "str":
            text = F.regexp_replace(t.operand, f"^{BLANK}+|{BLANK}+$", "")
            return Typed("int", F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")))
        if t.kind not in _NUMBERS:
            return _failure("int")
        return Typed("int", self.whole(t.operand) if t.kind == "float" else t.operand.cast("bigint"))

    def call_float(self, t: Typed) -> Typed:
        if t.kind == "str":
            text = F.regexp_replace(t.operand, f"^{BLANK}+|{BLANK}+$", "")
            shape = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
            # Only one spelling of "not a number" is read as such everywhere.
            number = F.when(text.rlike("(?i)nan"), F.lit("NaN")).otherwise(text).try_cast("double")
            return Typed("float", F.when(text.rlike(shape), number))
        return Typed("float", t.operand.cast("double")) if t.kind in _NUMBERS else _failure("float")

    def call_str(self, t: Typed) -> Typed:
        if t.kind == "none":
            return Typed("str", F.lit("None"))
        if t.kind == "float":
            size = F.abs(t.value)
            text = F.when((t.value == 0) | (size >= 1e-3) & (size < 1e7), t.value.cast("string")).when(F.isnan(t.value), F.lit("nan"))
            told = F.when(t.value.isNull(), F.lit("None")).otherwise(text)
        elif t.kind == "bool":
            told = F.when(t.value.isNull(), F.lit("None")).when(t.value, F.lit("True")).otherwise(F.lit("False"))
        else:
            told = F.coalesce(t.value.cast("string"), F.lit("None"))
        return Typed("str", F.when(~t.failing, told))

    def extreme(self, name: str, args: list[ast.AST]) -> Typed:
        if len(args) == 1 and isinstance(args[0], (ast.Tuple, ast.List, ast.Set)):
            args = args[0].elts
        elif len(args) == 1:
            raise ExpressionError(f"{name} takes several values or a list of them")
        if not args:
            raise ExpressionError(f"{name} of nothing")
        parts = [self.usable(a) for a in args]
        if len(parts) == 1:
            return parts[0]
        kinds = {p.kind for p in parts}
        if kinds <= {*_NUMBERS}:
            kind = "float" if "float" in kinds else "int" if "int" in kinds else "bool"
        elif len(kinds) == 1 and not kinds & {"none", "other"}:
            (kind,) = kinds
        else:
            return _failure("int")
        cast = {"float": "double", "int": "bigint"}.get(kind)
        values = [p.operand.cast(cast) if cast else p.operand for p in parts]
        others = values[1:]
        if kind == "float":
            # Nothing is less or more than "not a number": it is the result where it comes first, and passed over elsewhere.
            others = [F.when(~F.isnan(v), v) for v in others]
        picked = (F.least if name == "min" else F.greatest)(values[0], *others)
        if kind == "float":
            picked = F.when(F.isnan(values[0]), values[0]).otherwise(picked)
        return Typed(kind, F.when(reduce(lambda x, y: x & y, [v.isNotNull() for v in values]), picked))

    def method(self, name: str, t: Typed, args: list[ast.AST]) -> Typed:
        plain = name not in ("startswith", "endswith", "strip", "lstrip", "rstrip")
        if plain and args or len(args) > 1 or name.endswith("with") and not args:
            raise ExpressionError(f"wrong number of arguments: {name}")
        if t.kind != "str":
            for a in args:
                self.build(a) if not isinstance(a, (ast.Tuple, ast.List)) else None
            return _failure("str" if name in ("lower", "upper", "strip", "lstrip", "rstrip", "title", "capitalize") else "bool")
        s = t.operand
        if name in _CLASSES:
            return Typed("bool", s.rlike(f"^{_CLASSES[name]}+\\z"))
        if name in ("startswith", "endswith"):
            return self.edge(name, s, args[0])
        if name.endswith("strip"):
            return Typed("str", self.stripped(name, s, args))
        if name == "title":
            letters = F.split(s, "")
            inside = lambda i: (i > 0) & F.coalesce(F.try_element_at(letters, i).rlike(r"^\p{L}$"), F.lit(False))
            return Typed("str", F.array_join(F.transform(letters, lambda c, i: F.when(inside(i), F.lower(c)).otherwise(F.upper(c))), ""))
        made: dict[str, Callable[[], Column]] = {
            "lower": lambda: F.lower(s),
            "upper": lambda: F.upper(s),
            "capitalize": lambda: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30))),
        }
        return Typed("str", made[name]())

    def edge(self, name: str, s: Column, arg: ast.AST) -> Typed:
        test = F.startswith if name == "startswith" else F.endswith
        parts = [self.usable(a) for a in (arg.elts if isinstance(arg, ast.Tuple) else [arg])]
        if any(p.kind != "str" for p in parts):
            return _failure()
        return Typed("bool", reduce(lambda x, y: x | y, [test(s, p.operand) for p in parts], F.when(s.isNotNull(), F.lit(False))))

    def stripped(self, name: str, s: Column, args: list[ast.AST]) -> Column:
        inside = BLANK
        if args:
            if not (isinstance(args[0], ast.Constant) and isinstance(args[0].value, str)):
                raise ExpressionError(f"{name} takes a constant text")
            if not args[0].value:
                return s
            inside = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in args[0].value) + "]"
        for side, pattern in (("l", f"^{inside}+"), ("r", f"{inside}+\\z")):
            if name in (f"{side}strip", "strip"):
                s = F.regexp_replace(s, pattern, "")
        return s


def parse(expression: str) -> ast.Expression:
    try:
        return ast.parse(expression.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError) as exc:
        raise ExpressionError(f"invalid expression: {exc}") from exc


def compile_expression(df: DataFrame, expression: str) -> Column:
    """True: passes, false: broken, NULL: does not apply."""
    t = _Compiler(df).build(parse(expression))
    return F.when(~t.failing, t.truth())


def names_in(expression: str) -> list[str]:
    """The names an expression uses, in the order they appear."""
    tree = parse(expression)
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return list(dict.fromkeys(n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called))
