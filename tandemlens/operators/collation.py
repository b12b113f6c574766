"""Collation of token lists into padded batches, as a table function over rows that come batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.functions import udtf


@udtf(returnType="batch bigint, n bigint, width bigint, ids array<array<bigint>>, mask array<array<bigint>>")
class Collate:
    """One row a batch: its rows in order, each cut or padded with 0 to the longest one, `limit` at most.

    A row is (batch, ids, limit); null ids count as an empty list. Memory is one batch's, whose size the caller fixes
    when rows are dealt to batches.
    """

    def __init__(self):
        self.batch, self.rows, self.limit = None, [], 0

    def eval(self, row: Row) -> None:
        self.batch, self.limit = row["batch"], row["limit"]
        self.rows.append(list(row["ids"] or [])[: row["limit"]])

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        width = max(map(len, self.rows))
        ids = [r + [0] * (width - len(r)) for r in self.rows]
        mask = [[1] * len(r) + [0] * (width - len(r)) for r in self.rows]
        yield self.batch, len(self.rows), width, ids, mask


def collate(df: DataFrame, batch: str, position: str, ids: str, limit: int) -> DataFrame:
    """(batch, n, width, ids, mask) of each batch of `df`, rows in the order of `position`, which is unique in a batch."""
    rows = df.selectExpr(f"`{batch}` AS batch", f"`{position}` AS position", f"`{ids}` AS ids", f"CAST({limit} AS INT) AS limit")
    return Collate(rows.asTable().partitionBy("batch").orderBy("position"))
