"""Steps of one's own: named transforms with a declared input, chains of them, and a folder of plugins."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from sparkloom.operators.relational import remapped

#: Fixed value: steps of a chain at most.
MOST_STEPS = 10


@dataclass(frozen=True)
class Tool:
    """A transform and what it asks of its input: columns and their types."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: dict[str, str] = field(default_factory=dict)
    about: str = ""

    def __call__(self, df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        wrong = [f"{c} {t}" for c, t in self.needs.items() if types.get(c) != t]
        if wrong:
            raise ValueError(f"{self.name} needs {', '.join(wrong)}")
        return self.run(df)


class Registry:
    def __init__(self) -> None:
        self.tools: dict[str, Tool] = {}

    def add(self, tool: Tool) -> Tool:
        if tool.name in self.tools:
            raise ValueError(f"there is a tool {tool.name!r} already")
        self.tools[tool.name] = tool
        return tool

    def catalogue(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.about, sorted(t.needs.items())) for _, t in sorted(self.tools.items())]
        return spark.createDataFrame(rows, "name string, about string, needs array<struct<column:string,type:string>>")

    def load(self, folder: str) -> dict[str, str]:
        """Add the tools of every module in a folder (its ``TOOLS``); what is broken is left out and told by name."""
        broken = {}
        for path in sorted(Path(folder).glob("*.py")):
            try:
                spec = importlib.util.spec_from_file_location(path.stem, path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                for tool in module.TOOLS:
                    self.add(tool)
            except Exception as error:  # a plugin may fail in any way without harm to the others
                broken[path.stem] = f"{type(error).__name__}: {error}"
        return broken


@dataclass(frozen=True)
class Step:
    tool: str
    columns: dict[str, str] = field(default_factory=dict)


def chain(registry: Registry, steps: list[Step]) -> Callable[[DataFrame], DataFrame]:
    """One transform of several: each step sees the columns mapped to it, all of them without a mapping; the first fault ends it."""
    if not 1 <= len(steps) <= MOST_STEPS:
        raise ValueError(f"a chain has 1 to {MOST_STEPS} steps")
    if unknown := [s.tool for s in steps if s.tool not in registry.tools]:
        raise ValueError(f"no such tool: {', '.join(unknown)}")

    def run(df: DataFrame) -> DataFrame:
        for number, step in enumerate(steps):
            try:
                df = registry.tools[step.tool](remapped(df, step.columns))
            except Exception as error:
                raise RuntimeError(f"step {number} ({step.tool}) failed: {error}") from error
        return df

    return run


def register_agent(spark: SparkSession, name: str, events: Callable[[str], list[tuple[str, str]]]) -> None:
    """A table function of SQL: an input text gives rows (type, data), the last of type final, or error if it fails."""

    class Agent:
        def eval(self, text: str):
            try:
                yield from events(text)
            except Exception as error:  # an agent's failure is an event of its own
                yield ("error", f"{type(error).__name__}: {error}")

    spark.udtf.register(name, udtf(Agent, returnType="type: string, data: string"))
