"""Analyses, one function per question.  Each takes ``t: Roles`` and returns a DataFrame."""

from emporia.operators import customers, feedback, logistics, market, sales  # noqa: F401
