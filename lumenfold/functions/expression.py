"""User expressions of named arguments, compiled to columns.

The text is parsed by Python's own expression grammar and rebuilt from a fixed set of operators and functions, so
nothing but arithmetic reaches Spark.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": F.log, "sqrt": F.sqrt, "abs": F.abs, "sinh": F.sinh, "cosh": F.cosh,
    "tanh": F.tanh, "atan2": F.atan2, "pow": F.pow, "min": F.least, "max": F.greatest,
}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def compile_expression(text: str, arguments: dict[str, Column]) -> Column:
    """The column of ``text``, in which ``^`` is a power. Names other than arguments, functions and constants are refused."""
    clash = set(arguments) & (set(FUNCTIONS) | set(CONSTANTS))
    if clash:
        raise ValueError(f"arguments hide functions or constants: {sorted(clash)}")

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in arguments:
            return arguments[node.id].cast("double")
        if isinstance(node, ast.Name) and node.id in CONSTANTS:
            return F.lit(CONSTANTS[node.id])
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords:
            return FUNCTIONS[node.func.id](*map(build, node.args))
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    try:
        tree = ast.parse(text.replace("^", "**"), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    return build(tree.body)
