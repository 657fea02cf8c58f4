"""RowTable: rows with dense ids, read back by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.plans.frames import with_position
from keyweave.sources.arrow import ensure_compatible, row_width


class RowTable:
    """append gives rows ids that go on from the last; take reads rows by id."""

    def __init__(self, schema: T.StructType):
        self.schema = schema
        self.n_rows = 0
        self._parts: list[DataFrame] = []

    @property
    def row_width(self) -> int:
        return row_width(self.schema)

    def append(self, df: DataFrame, *order_by) -> int:
        """Adds df's rows, in the given order or as they come; returns the id of the first."""
        ensure_compatible(df.schema, self.schema)
        first = self.n_rows
        placed = with_position(df.toDF(*self.schema.names), "row_id", *order_by)
        self._parts.append(placed.withColumn("row_id", F.col("row_id") + first))
        self.n_rows += placed.count()
        return first

    @property
    def rows(self) -> DataFrame:
        """All rows with row_id."""
        if not self._parts:
            raise ValueError("no rows have been appended")
        out = self._parts[0]
        for part in self._parts[1:]:
            out = out.unionByName(part)
        return out

    def take(self, indices: DataFrame, pos: str = "pos", row_id: str = "row_id") -> DataFrame:
        """pos and the row for each wanted id; ids may repeat, unknown ones give nothing."""
        wanted = indices.select(F.col(pos).alias("pos"), F.col(row_id).alias("row_id"))
        return wanted.join(self.rows, "row_id").select("pos", *self.schema.names)

    def reset(self) -> None:
        self._parts, self.n_rows = [], 0
