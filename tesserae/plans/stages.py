"""Stage runner: named steps with persisted artifacts, skipped when complete and forced from a start stage on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Pipeline:
    """Each stage maps the previous stage's table to its own, which is written below root as Parquet."""

    spark: SparkSession
    root: str
    stages: list[tuple[str, Callable[[DataFrame | None], DataFrame]]]
    ran: list[str] = field(default_factory=list)

    def _complete(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def run(self, start: str | None = None) -> DataFrame:
        """Skip complete stages; from `start` on run all. A failing stage stops the run and leaves earlier artifacts."""
        forced, out = False, None
        for name, fn in self.stages:
            forced |= name == start
            if forced or not self._complete(name):
                fn(out).write.mode("overwrite").parquet(f"{self.root}/{name}")
                self.ran.append(name)
            out = self.spark.read.parquet(f"{self.root}/{name}")
        return out
