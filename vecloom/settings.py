"""Settings out of a configuration file: properties with a name and a value, as XML."""

from __future__ import annotations

from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql import SparkSession

from vecloom.config import LshConfig

#: Names of properties and what they set.
NUMBERS = {"kNeighbors": "k", "ratio": "ratio", "pruneFactor": "prune_factor", "querySetSize": "query_count", "partNum": "partitions", "blockNum": "blocks", "splitRows": "split_rows", "seed": "seed"}
PATHS = {"baseDir": "index", "dataSetFileName": "data", "querySetFileName": "queries", "groundTruthFileName": "truth", "localStatResultFile": "report", "resultDir": "results"}


@dataclass(frozen=True)
class Settings:
    config: LshConfig
    paths: dict[str, str]

    def path(self, name: str) -> str:
        if name not in self.paths:
            raise ValueError(f"no path is set for {name}: " + next(k for k, v in PATHS.items() if v == name))
        return self.paths[name]


def properties(spark: SparkSession, path: str) -> dict[str, str]:
    """Names and values of a configuration file, read by Spark, wherever it lies."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {p.findtext("name", "").strip(): p.findtext("value", "").strip() for p in ElementTree.fromstring(text).iter("property")}


def settings(values: dict[str, str]) -> Settings:
    """Validated settings; ValueError for names that nothing reads and for numbers that are none."""
    unknown = sorted(values.keys() - NUMBERS.keys() - PATHS.keys())
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    try:
        numbers = {NUMBERS[k]: int(v) for k, v in values.items() if k in NUMBERS}
    except ValueError as e:
        raise ValueError(f"a setting is no whole number: {e}") from None
    return Settings(LshConfig(**numbers), {PATHS[k]: v for k, v in values.items() if k in PATHS})
