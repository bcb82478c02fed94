"""The typed expression language and the data types."""

from millrace.functions.expr import Expr, coalesce, col, if_else, lit

__all__ = ["Expr", "coalesce", "col", "if_else", "lit"]
