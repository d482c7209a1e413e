"""Named tools over columns: a catalogue, and a dispatcher that calls each row's tool."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """run takes the argument (a string column) and gives the output as a string, null where the tool fails."""

    name: str
    description: str
    run: Callable[[Column], Column]
    needs_permission: bool = False


class Tools:
    """Tools by name; a later one of the same name takes the place of the earlier."""

    def __init__(self, *tools: Tool):
        self._tools = {t.name: t for t in tools}

    def register(self, tool: Tool) -> None:
        self._tools[tool.name] = tool

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.description, t.needs_permission) for t in self._tools.values()]
        return spark.createDataFrame(rows, "name string, description string, needs_permission boolean")

    def call(self, tool: Column, argument: Column) -> Column:
        """struct<success, output, error>: an unknown tool and one that gives nothing are errors of their row."""
        known, output = F.lit(False), F.lit(None).cast("string")
        for name, t in self._tools.items():
            known, output = known | (tool == name), F.when(tool == name, t.run(argument)).otherwise(output)
        known = F.coalesce(known, F.lit(False))
        error = F.when(~known, F.concat(F.lit("unknown tool: "), F.coalesce(tool, F.lit("null")))).when(output.isNull(), F.lit("no output"))
        return F.struct((known & output.isNotNull()).alias("success"), output.alias("output"), error.alias("error"))
