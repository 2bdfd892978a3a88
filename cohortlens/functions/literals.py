"""Small literal tables as one SQL expression.

A table of a few dozen literal rows (a check list, a schema inventory) is
written as ``inline(array(named_struct(...), ...))`` and parsed once by the
JVM, instead of one round trip per literal.  Cells are Python values
(quoted here) or ``Ref`` column references.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Ref(str):
    """A cell that names a column of the input instead of a literal."""


def sql_name(c: str) -> str:
    """Quoted column name."""
    return "`" + c.replace("`", "``") + "`"


def sql_literal(v: object, dtype: T.DataType | None = None) -> str:
    if isinstance(v, Ref):
        text = sql_name(v)
    elif v is None:
        text = "NULL"
    elif isinstance(v, bool):
        text = "true" if v else "false"
    elif isinstance(v, int):
        text = str(v)
    elif isinstance(v, float):
        text = f"CAST('{v!r}' AS DOUBLE)"
    else:
        text = "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({text} AS {dtype.simpleString()})" if dtype is not None else text


def inline_rows(fields: Sequence[str], rows: Sequence[Sequence[object]],
                types: Sequence[T.DataType] | None = None) -> Column:
    """``inline(array(named_struct(...)))`` generator over literal rows."""
    types = list(types) if types is not None else [None] * len(fields)
    structs = []
    for row in rows:
        parts = ", ".join(f"'{f}', {sql_literal(v, t)}" for f, v, t in zip(fields, row, types))
        structs.append(f"named_struct({parts})")
    return F.expr(f"inline(array({', '.join(structs)}))")
