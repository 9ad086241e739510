"""Exact arithmetic over decimal numbers: + - * / ** and signs, nothing else."""

from __future__ import annotations

import ast
import operator
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_SIGNS = {ast.UAdd: operator.pos, ast.USub: operator.neg}
MOST = 1000


def evaluated(expression: str) -> Decimal:
    """The value; ValueError for anything but arithmetic, or an exponent beyond MOST."""

    def walk(node: ast.expr) -> Decimal:
        if isinstance(node, ast.Constant) and isinstance(node.value, int | float) and not isinstance(node.value, bool):
            return Decimal(ast.get_source_segment(expression, node) or str(node.value))
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            left, right = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Pow) and abs(right) > MOST:
                raise ValueError("exponent too large")
            return _BINARY[type(node.op)](left, right)
        if isinstance(node, ast.UnaryOp) and type(node.op) in _SIGNS:
            return _SIGNS[type(node.op)](walk(node.operand))
        raise ValueError(f"not arithmetic: {expression!r}")

    try:
        expression = expression.strip()
        return walk(ast.parse(expression, mode="eval").body)
    except (SyntaxError, ArithmeticError) as e:
        raise ValueError(f"not arithmetic: {expression!r}") from e


@F.pandas_udf(T.StringType())
def arithmetic(expressions: pd.Series) -> pd.Series:
    """The value as text, `error: ...` where there is none, NULL for NULL."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            return format(evaluated(x).normalize(), "f")
        except ValueError as e:
            return f"error: {e}"

    return expressions.map(one)
