"""Programs over streams: facts arrive in micro-batches, what follows from them is derived from the additions alone.

Only programs without negation and aggregates can grow this way (what they derive is never taken back); others are refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..checks.stratify import reads
from ..errors import ProgramError
from ..program import Program, Result


class Incremental:
    """An evaluated program that takes further facts."""

    def __init__(self, program: Program, spark: SparkSession):
        self.result: Result = program.evaluate(spark)
        if any(strict for r in self.result.rules for _, strict in reads(r.body)):
            raise ProgramError("E0602", "only a program without negation and aggregates can grow")

    def add(self, rel: str, df: DataFrame) -> int:
        """Adds rows (columns by position) to a relation; how many were new."""
        sym = self.result.program.types.rels[rel]
        plain = df.toDF(*[f"c{i}" for i in range(sym.arity)]).dropna()
        return self.result.engine.extend(self.result.rules, {rel: plain})[rel]

    def stream(self, rel: str, source: DataFrame, checkpoint: str, after: Callable[[Result, int], None] | None = None):
        """Feeds a relation from a streaming DataFrame; after gets the result and the number of each batch. A batch that is
        delivered again adds nothing, as relations are sets."""

        def batch(df: DataFrame, number: int) -> None:
            self.add(rel, df)
            if after:
                after(self.result, number)

        return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


