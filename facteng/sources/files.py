"""Files as relations: fact texts read in parallel, and Spark's own formats."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ast import Lit
from ..errors import ProgramError
from ..program import Program
from ..text import read_facts

_SPARK = {"int": "long", "float": "double", "string": "string"}


def fact_lines(spark: SparkSession, path: str, program: Program, rel: str) -> DataFrame:
    """The facts of one relation in a text of one fact per line, parsed by the executors. Arguments are literals; files with
    nested terms go through Program.load_facts."""
    sym = program.types.rels[rel]
    kinds = [program.types.base(c.type) for c in sym.columns]
    if "id" in kinds:
        raise ProgramError("E0801", f"{rel} has columns of facts, load its text as a whole")
    schema = ", ".join(f"c{i} {_SPARK[k]}" for i, k in enumerate(kinds))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for a in read_facts("\n".join(b["value"])):
                if a.rel == rel:
                    if len(a.args) != len(kinds) or not all(isinstance(x, Lit) for x in a.args):
                        raise ProgramError("E0801", f"{rel} has {len(kinds)} columns of literals")
                    rows.append([x.value for x in a.args])
            yield pd.DataFrame(rows, columns=[f"c{i}" for i in range(len(kinds))])

    lines = spark.read.text(path).where(F.trim("value").startswith(rel))
    return lines.mapInPandas(run, schema)


def table(spark: SparkSession, path: str, columns: list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Columns of a file in one of Spark's formats; only they are read."""
    return spark.read.format(fmt).options(**options).load(path).select(*columns)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).save(path)
