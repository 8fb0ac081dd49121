"""Text expressions over columns: arithmetic, comparisons, conditionals and a few functions.

``compile_expression("where(depth > 2, sqrt(depth), 0)", {...})`` gives a Column.
Names may refer to stored columns or to other (virtual) expressions; cycles and
unknown names are errors. Division by zero gives null; % has the divisor's sign.
"""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _modulo(a: Column, b: Column) -> Column:
    return a - b * F.floor(F.try_divide(a, b))


_BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide, ast.Mod: _modulo, ast.Pow: F.pow, ast.BitXor: F.pow}
_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.Eq: operator.eq, ast.NotEq: operator.ne}
#: Function names, with the number of arguments.
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "abs": (1, F.abs), "fabs": (1, F.abs), "sqrt": (1, F.sqrt), "exp": (1, F.exp), "log": (1, F.log), "sin": (1, F.sin), "cos": (1, F.cos), "tan": (1, F.tan),
    "pow": (2, F.pow), "maximum": (2, F.greatest), "minimum": (2, F.least), "max": (2, F.greatest), "min": (2, F.least),
    "where": (3, lambda c, a, b: F.when(c, a).otherwise(b)),
}
CONSTANTS = {"pi": math.pi, "M_PI": math.pi}


class ExpressionError(ValueError):
    pass


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := _dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def _parsed(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None


def names(text: str) -> set[str]:
    """The column names that an expression reads."""
    found, todo = set(), [_parsed(text)]
    while todo:
        node = todo.pop()
        if name := _dotted(node):
            found |= {name} - CONSTANTS.keys()
        elif isinstance(node, ast.Call):
            todo += node.args
        else:
            todo += list(ast.iter_child_nodes(node))
    return found


def compile_expression(text: str, resolve: Callable[[str], Column]) -> Column:
    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant):
            if isinstance(node.value, bool):
                return F.lit(node.value)
            if isinstance(node.value, (int, float)):
                return F.lit(float(node.value))
        elif name := _dotted(node):
            return F.lit(CONSTANTS[name]) if name in CONSTANTS else resolve(name)
        elif isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        elif isinstance(node, ast.UnaryOp):
            x = build(node.operand)
            return -x if isinstance(node.op, ast.USub) else ~x if isinstance(node.op, ast.Not) else x
        elif isinstance(node, ast.BoolOp):
            return reduce(operator.and_ if isinstance(node.op, ast.And) else operator.or_, map(build, node.values))
        elif isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
            sides = [build(x) for x in (node.left, *node.comparators)]
            return reduce(operator.and_, (_COMPARE[type(o)](a, b) for o, a, b in zip(node.ops, sides, sides[1:])))
        elif isinstance(node, ast.IfExp):
            return F.when(build(node.test), build(node.body)).otherwise(build(node.orelse))
        elif isinstance(node, ast.Call) and not node.keywords and (name := _dotted(node.func)) in FUNCTIONS:
            count, f = FUNCTIONS[name]
            if len(node.args) != count:
                raise ExpressionError(f"{name} takes {count} arguments")
            return f(*map(build, node.args))
        raise ExpressionError(f"{text!r}: {ast.unparse(node)} is not supported")

    return build(_parsed(text))


def with_virtual(df: DataFrame, virtual: Mapping[str, str]) -> DataFrame:
    """``df`` with the virtual columns; they may use each other, in any order, but not in a circle."""
    done: dict[str, Column] = {}

    def column(name: str, above: tuple[str, ...]) -> Column:
        if name in above:
            raise ExpressionError("circular: " + " -> ".join((*above, name)))
        if name in virtual:  # a virtual column hides a stored one
            if name not in done:
                done[name] = compile_expression(virtual[name], lambda n: column(n, (*above, name)))
            return done[name]
        if name not in df.columns:
            raise ExpressionError(f"unknown column {name}")
        return F.col(f"`{name}`")

    return df.withColumns({name: column(name, ()) for name in virtual})


def dependency_order(virtual: Mapping[str, str]) -> list[str]:
    """The virtual names so that each comes after those it uses, else in alphabetical order; a circle is an error."""
    needs = {name: names(text) & virtual.keys() for name, text in virtual.items()}
    out: list[str] = []
    while len(out) < len(needs):
        ready = sorted(n for n, used in needs.items() if n not in out and used <= set(out))
        if not ready:
            raise ExpressionError(f"circular: {sorted(set(needs) - set(out))}")
        out.append(ready[0])
    return out


def constants(df: DataFrame, named: Mapping[str, str]) -> dict[str, str]:
    """Values computed once over ``df``, as expressions to be used by name: ``{"top": "max(depth)"}`` gives ``{"top": "3.5"}``.

    Each is one of mean, sum, max, min or count of an expression.
    """
    kinds = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    picked = []
    for name, text in named.items():
        node = _parsed(text)
        if not (isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in kinds and len(node.args) == 1):
            raise ExpressionError(f"{text!r}: one of {sorted(kinds)} of an expression")
        inner = with_virtual(df, {"_x": ast.unparse(node.args[0])})
        picked.append((name, kinds[node.func.id], inner))
    out = {}
    for name, kind, inner in picked:
        value = inner.agg(kind("_x")).first()[0]
        if value is None:
            raise ExpressionError(f"{name} has no value")
        out[name] = repr(float(value))
    return out
