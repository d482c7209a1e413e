"""Unit conversion, a calculator without eval, and dates."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units by kind, in metres, grams and bytes, and the names of the temperatures
LENGTH = {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mile": 1609.344, "yard": 0.9144, "foot": 0.3048, "inch": 0.0254, "米": 1.0, "千米": 1000.0, "厘米": 0.01, "毫米": 0.001}
WEIGHT = {"g": 1.0, "kg": 1000.0, "mg": 0.001, "ton": 1000000.0, "lb": 453.592, "oz": 28.3495, "克": 1.0, "千克": 1000.0, "毫克": 0.001, "吨": 1000000.0}
DATA = {"B": 1.0, "KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3, "TB": 1024.0**4, "byte": 1.0, "bit": 0.125}
CELSIUS, FAHRENHEIT = ("celsius", "c", "摄氏度"), ("fahrenheit", "f", "华氏度")


def conversion(value: Column, unit: Column, to: Column) -> Column:
    """struct<result, error>: value in another unit of its kind. Temperatures in either case; other units as they are written."""
    kinds = F.create_map(*[F.lit(x) for kind, units in (("length", LENGTH), ("weight", WEIGHT), ("data", DATA)) for u in units for x in (u, kind)])
    factors = F.create_map(*[F.lit(x) for units in (LENGTH, WEIGHT, DATA) for kv in units.items() for x in kv])
    warm = lambda u, names: F.lower(u).isin(*names)
    up, down = warm(unit, CELSIUS) & warm(to, FAHRENHEIT), warm(unit, FAHRENHEIT) & warm(to, CELSIUS)
    a, b = F.try_element_at(kinds, unit), F.try_element_at(kinds, to)
    error = F.when(up | down, None).when(a.isNull() | b.isNull(), "unsupported_unit").when(a != b, "category_mismatch")
    result = F.when(up, value * 9 / 5 + 32).when(down, (value - 32) * 5 / 9).when(error.isNull(), value * F.try_element_at(factors, unit) / F.try_element_at(factors, to))
    return F.struct(result.alias("result"), error.alias("error"))


def convert(value: Column, unit: Column, to: Column) -> Column:
    """The result of conversion; null where it is an error."""
    return conversion(value, unit, to)["result"]


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}
#: Names that an expression may use.
NAMES = {name: getattr(math, name) for name in "sqrt sin cos tan asin acos atan sinh cosh tanh log log10 log2 exp floor ceil factorial gcd pi e radians degrees".split()}
NAMES |= {"abs": abs, "round": round, "min": min, "max": max, "sum": sum, "pow": pow}


def calculate(expression: str) -> str:
    """The value of an arithmetic expression over NAMES, whole floats as integers; what is wrong with it otherwise. Nothing is evaluated but its syntax tree."""

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and (abs(b) > 1000 or abs(a) > 1e100):
                raise ValueError("too large")
            return _BINARY[type(node.op)](a, b)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and callable(NAMES.get(node.func.id)) and not node.keywords:
            return NAMES[node.func.id](*map(value, node.args))
        if isinstance(node, ast.Name) and isinstance(NAMES.get(node.id), float):
            return NAMES[node.id]
        if isinstance(node, (ast.List, ast.Tuple)):
            return [value(x) for x in node.elts]
        raise ValueError("not allowed")

    try:
        out = value(ast.parse(expression, mode="eval").body)
    except ZeroDivisionError:
        return "error: division by zero"
    except (ValueError, TypeError, SyntaxError, OverflowError, RecursionError) as e:
        return f"error: {type(e).__name__}"
    return str(int(out)) if isinstance(out, float) and math.isfinite(out) and out == int(out) else str(out)
