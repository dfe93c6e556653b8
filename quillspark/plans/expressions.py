"""A subset of XPath compiled to Columns over one node row.

Axis steps that predicates ask for are answered from the arrays of names that shredding leaves on each node, so a
compiled predicate is a narrow expression. What the subset lacks is reported by ``Unsupported``; as a predicate it is
then constantly false, as in a rule whose expression can never be evaluated.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import registry, text

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\")|(?P<op>!=|<=|>=|\|\||::|//|\.\.|[-+*/=<>()\[\],.@$|?])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))")
_AXIS_ARRAY = {"ancestor": "anc_tags", "child": "child_tags", "preceding-sibling": "before_tags", "following-sibling": "after_tags"}


class Unsupported(ValueError):
    """An expression outside the subset."""


class Value:
    """A compiled expression: a Column and whether it is a boolean, a sequence (array of strings) or a plain item."""

    def __init__(self, column: Column, kind: str) -> None:
        self.column, self.kind = column, kind

    def truth(self) -> Column:
        """Of a test: a boolean is itself, anything else holds if it is not the empty sequence."""
        if self.kind == "bool":
            return F.coalesce(self.column, F.lit(False))
        return F.size(self.column) > 0 if self.kind == "seq" else self.column.isNotNull()

    def string(self) -> Column:
        return F.try_element_at(self.column, F.lit(1)) if self.kind == "seq" else self.column.cast("string")


class _Parser:
    def __init__(self, source: str, variables: dict[str, object] | None = None) -> None:
        self.tokens, self.at, self.variables = [], 0, variables or {}
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise Unsupported(f"cannot read {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()

    def peek(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else None

    def kind(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.kind() != "str":
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise Unsupported(f"expected {wanted!r}, found {self.peek()!r}")

    def parse(self) -> Value:
        out = self.either()
        if self.at != len(self.tokens):
            raise Unsupported(f"unexpected {self.peek()!r}")
        return out

    def either(self) -> Value:
        left = self.both()
        while self.take("or"):
            left = Value(left.truth() | self.both().truth(), "bool")
        return left

    def both(self) -> Value:
        left = self.compare()
        while self.take("and"):
            left = Value(left.truth() & self.compare().truth(), "bool")
        return left

    def compare(self) -> Value:
        left = self.sum()
        if op := self.take("=", "!=", "<", "<=", ">", ">=", "eq", "ne", "lt", "le", "gt", "ge"):
            op = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.get(op, op)
            return Value(self._compared(left, op, self.sum()), "bool")
        return left

    @staticmethod
    def _compared(left: Value, op: str, right: Value) -> Column:
        number = "num" in (left.kind, right.kind)
        test = lambda a, b: {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        item = lambda c: c.try_cast("double") if number else c
        if left.kind == "seq" and right.kind == "seq":
            if op == "=":
                return F.arrays_overlap(left.column, right.column)
            return F.exists(left.column, lambda a: F.exists(right.column, lambda b: test(item(a), item(b))))
        if left.kind == "seq":
            return F.exists(left.column, lambda a: test(item(a), item(right.column)))
        if right.kind == "seq":
            return F.exists(right.column, lambda b: test(item(left.column), item(b)))
        return test(item(left.column), item(right.column))

    def sum(self) -> Value:
        left = self.union()
        while op := self.take("+", "-", "||"):
            right = self.union()
            if op == "||":
                left = Value(F.concat(F.coalesce(left.string(), F.lit("")), F.coalesce(right.string(), F.lit(""))), "str")
            else:
                a, b = left.string().try_cast("double"), right.string().try_cast("double")
                left = Value(a + b if op == "+" else a - b, "num")
        return left

    def union(self) -> Value:
        left = self.primary()
        while self.take("|"):
            right = self.primary()
            as_seq = lambda v: v.column if v.kind == "seq" else F.array_compact(F.array(v.string()))
            left = Value(F.concat(as_seq(left), as_seq(right)), "seq")
        return left

    def primary(self) -> Value:
        kind, tok = self.kind(), self.peek()
        if kind == "num":
            self.at += 1
            return Value(F.lit(float(tok)), "num")
        if kind == "str":
            self.at += 1
            return Value(F.lit(tok[1:-1].replace(tok[0] * 2, tok[0])), "str")
        if self.take("("):
            if self.take(")"):
                return Value(F.array().cast("array<string>"), "seq")
            inner = self.either()
            self.need(")")
            return inner
        if self.take("$"):
            return self.variable()
        if self.take("."):
            return Value(F.col("string_value"), "str")
        if self.take("@"):
            return self.attribute("attrs")
        if self.take(".."):
            if self.take("/") and self.take("@"):
                return self.attribute("parent_attrs")
            return Value(F.element_at("anc_tags", -1), "str")
        if kind == "name":
            if self.peek(1) == "(" and tok not in ("text", "node"):
                return self.call()
            return self.step()
        raise Unsupported(f"unexpected {tok!r}")

    def variable(self) -> Value:
        name = self.peek()
        self.at += 1
        if name == "parameters" and self.take("?"):
            name = self.peek()
            self.at += 1
            return Value(F.lit(self.variables.get("parameters", {}).get(name)).cast("string"), "str")
        if name not in self.variables:
            raise Unsupported(f"variable ${name} is not set")
        v = self.variables[name]
        return Value(F.lit(v), "bool" if isinstance(v, bool) else "num" if isinstance(v, int | float) else "str")

    def attribute(self, column: str) -> Value:
        name = self.peek()
        self.at += 1
        return Value(F.try_element_at(F.col(column), F.lit(name)), "str")

    def step(self) -> Value:
        axis = "child"
        if self.peek(1) == "::":
            axis = self.peek()
            self.at += 2
        name = self.peek()
        self.at += 1
        if self.peek() == "(":
            raise Unsupported(f"node test {name}()")
        if self.peek() in ("/", "//", "["):
            if self.take("/") and self.take("@") and axis == "parent":
                value = self.attribute("parent_attrs")
                return Value(F.when(F.element_at("anc_tags", -1) == name, value.column), "str")
            raise Unsupported("a path of several steps or a nested predicate")
        local = name.split(":")[-1]
        pick = lambda a: a if name == "*" else F.filter(a, lambda t: t == local)
        if axis in _AXIS_ARRAY:
            return Value(pick(F.col(_AXIS_ARRAY[axis])), "seq")
        me, up = F.array("tag"), F.when(F.size("anc_tags") > 0, F.slice("anc_tags", -1, 1)).otherwise(F.array().cast("array<string>"))
        if axis == "self":
            return Value(pick(me), "seq")
        if axis == "parent":
            return Value(pick(up), "seq")
        if axis == "ancestor-or-self":
            return Value(pick(F.concat(F.col("anc_tags"), me)), "seq")
        raise Unsupported(f"axis {axis}")

    def call(self) -> Value:
        name = self.peek()
        self.at += 2
        args: list[Value] = []
        while not self.take(")"):
            args.append(self.either())
            self.take(",")
        s = lambda i: F.coalesce(args[i].string(), F.lit("")) if i < len(args) else F.col("string_value")
        n = name.removeprefix("fn:")
        if n.startswith("tp:"):
            if f := registry.lookup(n[3:]):
                return Value(f(*[a.string() for a in args]), "str")
            raise Unsupported(f"function {name} is not registered")
        table = {
            "true": lambda: Value(F.lit(True), "bool"),
            "false": lambda: Value(F.lit(False), "bool"),
            "not": lambda: Value(~args[0].truth(), "bool"),
            "exists": lambda: Value(args[0].truth(), "bool"),
            "empty": lambda: Value(~args[0].truth(), "bool"),
            "boolean": lambda: Value(args[0].truth(), "bool"),
            "count": lambda: Value((F.size(args[0].column) if args[0].kind == "seq" else args[0].column.isNotNull().cast("int")).cast("double"), "num"),
            "string": lambda: Value(s(0), "str"),
            "normalize-space": lambda: Value(text.clean(s(0)), "str"),
            "string-length": lambda: Value(F.length(s(0)).cast("double"), "num"),
            "concat": lambda: Value(F.concat(*[s(i) for i in range(len(args))]), "str"),
            "contains": lambda: Value(F.contains(s(0), s(1)), "bool"),
            "starts-with": lambda: Value(F.startswith(s(0), s(1)), "bool"),
            "ends-with": lambda: Value(F.endswith(s(0), s(1)), "bool"),
            "matches": lambda: Value(F.regexp_like(s(0), s(1)), "bool"),
            "replace": lambda: Value(F.regexp_replace(s(0), s(1), s(2)), "str"),
            "translate": lambda: Value(F.call_function("translate", s(0), s(1), s(2)), "str"),
            "substring": lambda: Value(F.substring(s(0), args[1].column.cast("int"), args[2].column.cast("int") if len(args) > 2 else F.length(s(0))), "str"),
            "substring-after": lambda: Value(_after(s(0), s(1)), "str"),
            "substring-before": lambda: Value(_before(s(0), s(1)), "str"),
            "upper-case": lambda: Value(F.upper(s(0)), "str"),
            "lower-case": lambda: Value(F.lower(s(0)), "str"),
            "tokenize": lambda: Value(F.split(text.clean(s(0)) if len(args) < 2 else s(0), " " if len(args) < 2 else s(1)), "seq"),
            "string-join": lambda: Value(F.array_join(args[0].column, "") if len(args) < 2 else F.call_function("array_join", args[0].column, s(1)), "str"),
            "distinct-values": lambda: Value(F.array_distinct(args[0].column), "seq"),
            "number": lambda: Value(s(0).try_cast("double"), "num"),
            "local-name": lambda: Value(F.col("tag"), "str"),
            "name": lambda: Value(F.col("tag"), "str"),
            "xs:date": lambda: Value(s(0).try_cast("date"), "date"),
            "format-integer": lambda: Value(args[0].string().try_cast("double").cast("long").cast("string"), "str"),
            "position": lambda: Value(F.col("tag_ord").cast("double"), "num"),
        }
        if n not in table:
            raise Unsupported(f"function {name}()")
        return table[n]()


def _after(x: Column, mark: Column) -> Column:
    at = F.call_function("instr", x, mark)
    return F.when(at > 0, F.substring(x, at + F.length(mark), F.length(x))).otherwise("")


def _before(x: Column, mark: Column) -> Column:
    at = F.call_function("instr", x, mark)
    return F.when(at > 0, F.substring(x, F.lit(1), at - 1)).otherwise("")


def compile_value(source: str, variables: dict[str, object] | None = None) -> Value:
    """A value over node rows with ``attrs, tag, anc_tags, child_tags, before_tags, after_tags, string_value``."""
    return _Parser(source, variables).parse()


def compile_test(source: str, variables: dict[str, object] | None = None) -> tuple[Column, str | None]:
    """A predicate: never null, false on errors. The second item says why it can never hold, if so."""
    try:
        return compile_value(source, variables).truth(), None
    except Unsupported as why:
        return F.lit(False), str(why)


def compile_parameter(source: str, variables: dict[str, object] | None = None) -> Column:
    """A parameter as text; the shortest forms (``.``, ``@name``, a literal) come out as the plain column."""
    try:
        return compile_value(source, variables).string()
    except Unsupported:
        return F.lit(None).cast("string")
