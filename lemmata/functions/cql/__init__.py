"""A three-valued clinical expression language: parsed once, compiled to a Spark Column."""

from .compiler import Entity, compile_expression, evaluate
from .parser import CqlError, CqlTypeError, ParseError, parse

__all__ = ["CqlError", "CqlTypeError", "Entity", "ParseError", "compile_expression", "evaluate", "parse"]
