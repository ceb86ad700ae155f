"""Where a vault is kept between runs."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "entity string, value string, counter long, uses long, token string"


class VaultBackend(ABC):
    @abstractmethod
    def load(self) -> DataFrame: ...

    @abstractmethod
    def save(self, vault: DataFrame) -> None: ...

    def clear(self) -> None:
        empty = self.load().limit(0)
        self.save(empty)


class MemoryVault(VaultBackend):
    """For a session: a plan, not stored anywhere."""

    def __init__(self, spark: SparkSession):
        self._vault = spark.createDataFrame([], SCHEMA)

    def load(self) -> DataFrame:
        return self._vault

    def save(self, vault: DataFrame) -> None:
        self._vault = vault


class TableVault(VaultBackend):
    """Parquet generations below a path; the last whole one counts, so a failed save leaves the one before. A vault that is opened again goes on from what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _generations(self) -> tuple[int, int]:
        """The number of the last whole generation (0: none), and of the last one that was begun."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        begun = sorted(int(n) for n in names if n.isdigit())
        whole = [n for n in begun if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n:06d}/_SUCCESS"))]
        return whole[-1] if whole else 0, begun[-1] if begun else 0

    @property
    def generation(self) -> int:
        return self._generations()[0]

    def load(self) -> DataFrame:
        n = self.generation
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{n:06d}") if n else self.spark.createDataFrame([], SCHEMA)

    def save(self, vault: DataFrame) -> None:
        vault.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.parquet(f"{self.path}/{self._generations()[1] + 1:06d}")
