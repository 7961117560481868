"""Columns of any name under plain ones while an operator works on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A name as ``F.col`` takes it: dots and backticks belong to the name."""
    return "`" + name.replace("`", "``") + "`"


class Named:
    """A table whose columns are called ``c0``, ``c1``, ... for a while.

    ``added`` are the names of an operator's results: columns of the table with such a
    name, in any case, are replaced by them.  ``df`` has all columns under their plain
    names, ``plain(name)`` is that of a named input (exactly as written, else in any
    case), ``kept`` those that the operator gives back, in order, and ``back`` gives them
    their own names again.
    """

    def __init__(self, docs: DataFrame, added: Sequence[str], carry: Sequence[str] | None = None):
        self.names = list(docs.columns)
        self.df = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        new = {a.lower() for a in added}
        chosen = range(len(self.names)) if carry is None else [self._place(c) for c in carry]
        self.kept = [f"c{i}" for i in chosen if self.names[i].lower() not in new]

    def _place(self, name: str) -> int:
        if name in self.names:
            return self.names.index(name)
        folded = [n.lower() for n in self.names]
        if name.lower() not in folded:
            raise ValueError(f"no column {name!r} in {self.names}")
        return folded.index(name.lower())

    def plain(self, name: str) -> str:
        return f"c{self._place(name)}"

    def own(self, plain: str) -> str:
        return self.names[int(plain[1:])]

    def fields(self) -> list[T.StructField]:
        """Schema of the kept columns under their plain names, all nullable."""
        return [T.StructField(c, self.df.schema[c].dataType, True) for c in self.kept]

    def back(self, df: DataFrame, *more: str | Column) -> DataFrame:
        """The kept columns under their own names, then ``more``."""
        return df.select(*[F.col(c).alias(self.own(c)) for c in self.kept], *more)
