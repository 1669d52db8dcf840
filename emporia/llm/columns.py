"""Column helpers for the native operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + term(x))


ROW, NEW = "__document_row", "__document_text"


def narrowed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row in one column, so that no other column's name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias(ROW))


def widened(rows: DataFrame, columns: list[str], text: Column | None = None) -> DataFrame:
    """The columns of the documents again, with ``text`` (and n_chars with it) if it is given."""
    # The new text is a column of its own first: in one projection lambdas would see the alias instead of the old text.
    if text is not None:
        rows = rows.select(ROW, text.alias(NEW))

    def value(name):
        if text is not None and name == "text":
            return F.col(NEW)
        if text is not None and name == "n_chars":
            return F.length(NEW).cast("long")
        return F.col(ROW).getField(name)

    return rows.select(*[value(c).alias(c) for c in columns])
