"""A place in a corpus that can be saved, resumed and rewound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.batches import global_offsets


class Cursor:
    """Documents by ordinal in the order of a key; the state is two numbers and survives the session.

    Ordinals come from block-wise running counts and are written once, so a take is a range filter.
    """

    def __init__(self, docs: DataFrame, order: str, place: int = 0):
        self.docs = global_offsets(docs.withColumn("_one", F.lit(1).cast("bigint")), order, "_one").withColumnRenamed("offset", "ordinal").drop("_one")
        self.total, self.place = docs.count(), place

    @classmethod
    def resume(cls, docs: DataFrame, order: str, state: dict) -> Cursor:
        out = cls(docs, order, state["place"])
        if out.total != state["total"]:
            raise ValueError(f"the corpus has {out.total} documents, the saved place is of one with {state['total']}")
        return out

    def state(self) -> dict:
        return {"place": self.place, "total": self.total}

    def progress(self) -> dict:
        """How far the reader is: documents read, all, and the share."""
        return {"read": self.place, "total": self.total, "share": self.place / self.total if self.total else 1.0}

    def skip(self, n: int) -> None:
        self.place = min(self.total, self.place + n)

    def take(self, n: int) -> DataFrame:
        """The next n documents (fewer at the end); the place moves on."""
        a = self.place
        self.skip(n)
        return self.docs.filter((F.col("ordinal") >= a) & (F.col("ordinal") < self.place))

    def rest(self) -> DataFrame:
        return self.take(self.total - self.place)

    def rewind(self) -> None:
        self.place = 0
