"""Formulas as columns: "a*sin(x)^2 + 1" becomes an expression that Spark compiles."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = {n: getattr(F, n) for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "exp", "sqrt", "abs", "floor", "ceil")} | {"log": F.ln, "ln": F.ln, "log10": F.log10}
TWO = {"pow": F.pow, "atan2": F.atan2, "min": F.least, "max": F.greatest}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


class FormulaError(ValueError):
    """The formula is not of this language."""


def _build(node: ast.AST, names: set[str] | None) -> Column:
    if isinstance(node, ast.Expression):
        return _build(node.body, names)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        if names is not None and node.id not in names:
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
            raise FormulaError(f"unknown name {node.id}")
        return F.col(node.id).cast("double")
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        x = _build(node.operand, names)
        return -x if isinstance(node.op, ast.USub) else x
    if isinstance(node, ast.BinOp):
        a, b = _build(node.left, names), _build(node.right, names)
        ops = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Pow: lambda: F.pow(a, b)}
        if type(node.op) in ops:
            return ops[type(node.op)]()
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args = [_build(x, names) for x in node.args]
        if node.func.id in ONE and len(args) == 1:
            return ONE[node.func.id](args[0])
        if node.func.id in TWO and len(args) == 2:
            return TWO[node.func.id](*args)
        raise FormulaError(f"unknown function {node.func.id} of {len(args)}")
    raise FormulaError(f"not of this language: {ast.dump(node)[:60]}")


def formula(text: str, names: list[str] | None = None) -> Column:
    """The column of a formula; ^ is the power. names: the columns that it may use (None: any)."""
    try:
        tree = ast.parse(text.replace("^", "**").strip(), mode="eval")
    except SyntaxError as e:
        raise FormulaError(str(e)) from e
    return _build(tree, set(names) if names is not None else None)
