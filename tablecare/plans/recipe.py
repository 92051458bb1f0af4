"""Cleaning recipe (J7, J8): an ordered list of named steps replayed lazily
over the source table.  A version is a prefix of the steps.

Each step re-analyses its input (statistics enter the next projection as
literals).  Lineage grows with every step, so every ``checkpoint_every``
steps the frame is checkpointed into the shared folder named by
``spark.checkpoint.dir``.

``VersionStore`` keeps step results instead: a version's table lies as Parquet
under a hash of its source and of the steps that led to it, so an earlier
version is read, not replayed, and a recipe that goes on from a kept version
runs its new steps only.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import astuple, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.analysis import Analysis
from ..operators.clean import clean


@dataclass(frozen=True)
class Step:
    issue: str
    method: str
    columns: tuple = ("all",)
    custom_value: str | None = None

    def describe(self) -> str:
        cols = "all columns" if not self.columns or list(self.columns) == ["all"] else ", ".join(map(str, self.columns))
        return f"{self.method} applied to {cols} for {self.issue}"


@dataclass
class Recipe:
    steps: list = field(default_factory=list)
    order_by: list | None = None
    checkpoint_every: int = 0

    def then(self, step: Step) -> "Recipe":
        return Recipe(self.steps + [step], self.order_by, self.checkpoint_every)

    def ignored(self, upto: int | None = None) -> dict:
        """Issues and columns the user chose to ignore so far."""
        out: dict = {}
        for s in self.steps[:upto]:
            if s.method == "Ignore":
                out.setdefault(s.issue, [])
                out[s.issue] += [c for c in s.columns if c not in out[s.issue]]
        return out

    def apply(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        """The table after the first ``upto`` steps (all when None; 0 = source)."""
        cur = df
        steps = self.steps[:upto]
        for i in range(len(steps)):
            cur = self.step(cur, i)
            if self.checkpoint_every and (i + 1) % self.checkpoint_every == 0 and i + 1 < len(steps):
                from ..session import checkpoint_dir
                checkpoint_dir(cur.sparkSession)
                cur = cur.checkpoint(eager=True)
        return cur

    def step(self, df: DataFrame, i: int) -> DataFrame:
        """The table that step ``i`` makes of version ``i``."""
        s = self.steps[i]
        return clean(Analysis(df, ignored=self.ignored(i)), s.issue, list(s.columns), s.method, s.custom_value, order_by=self.order_by)

    def analysis(self, df: DataFrame, upto: int | None = None) -> Analysis:
        """Flags and scores of a version, with the ignored issues applied."""
        n = len(self.steps) if upto is None else upto
        return Analysis(self.apply(df, upto), ignored=self.ignored(n))

    def log(self, spark) -> DataFrame:
        """J7 log: ``(step, text)``."""
        return spark.createDataFrame([(i + 1, s.describe()) for i, s in enumerate(self.steps)], "step int, text string")


def source_key(df: DataFrame) -> str:
    """What ``df`` is: its plan, and the files it reads as they are now."""
    from .profile_store import stat
    return f"{df.semanticHash()} {sorted(stat(df.sparkSession, f) for f in df.inputFiles())}"


class VersionStore:
    """Versions of tables under ``folder`` (shared storage).  Each is written once: a folder without Spark's mark of
    a finished write is written again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, recipe: Recipe, source: str, upto: int) -> str:
        steps = [astuple(s) for s in recipe.steps[:upto]]
        told = json.dumps([source, steps, recipe.order_by], default=str)
        return f"{self.folder}/{hashlib.sha256(told.encode()).hexdigest()}"

    def _read(self, path: str) -> DataFrame | None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            return None
        kept = self.spark.read.parquet(path)
        names = json.loads(self.spark.read.text(f"{path}.names", wholetext=True).first()[0])
        return kept.toDF(*names)

    def has(self, recipe: Recipe, df: DataFrame, upto: int, source: str | None = None) -> bool:
        return self._read(self._path(recipe, source or source_key(df), upto)) is not None

    def version(self, recipe: Recipe, df: DataFrame, upto: int | None = None, source: str | None = None) -> DataFrame:
        """The table after the first ``upto`` steps, from the nearest version that is kept; what is
        computed on the way is kept as well.  ``source`` names the source where its plan doesn't (see ``source_key``)."""
        upto = len(recipe.steps) if upto is None else min(upto, len(recipe.steps))
        source = source or source_key(df)
        at, cur = upto, None
        while at and cur is None:
            cur = self._read(self._path(recipe, source, at))
            at -= cur is None
        cur = df if cur is None else cur
        for i in range(at, upto):
            path = self._path(recipe, source, i + 1)
            made = recipe.step(cur, i)
            numbered = made.toDF(*[f"c{k}" for k in range(len(made.columns))])  # names may be anything
            self.spark.createDataFrame([(json.dumps(made.columns),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.names")
            numbered.write.mode("overwrite").parquet(path)
            cur = self._read(path)
        return cur
