"""Table sources.

Parquet is the default; a relational source is read through Spark's JDBC
reader with a partition column so that the load is split over executors.
"""

from __future__ import annotations

import json
import os
import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named table stored as ``{sf_dir}/{name}.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Tables:
    """Lazy accessor: ``Tables(spark, dir).orders`` reads orders.parquet once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def derived(self, key: str, builder) -> DataFrame:
        """A derived table written once per query plan (see ``sinks.materialize``)
        and re-read by every later step that needs it.  Safe to call from
        several threads: each key is built once."""
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            if key not in self._cache:
                from wardlens.sources.sinks import materialize
                self._cache[key] = materialize(builder(), key.replace(":", "_"))
        return self._cache[key]

    def release(self) -> None:
        """Delete the derived tables; call it when no DataFrame that reads them is used any more."""
        from wardlens.sources.sinks import release
        with self._guard:
            for key in list(self._locks):
                if key in self._cache:
                    release(self._cache.pop(key))

    def prefetch(self, *steps) -> None:
        """Run independent steps (each writes its derived tables) side by side:
        Spark runs jobs submitted from several driver threads concurrently, so
        small jobs overlap and large ones fill each other's idle task slots."""
        with ThreadPoolExecutor(max_workers=max(1, len(steps))) as pool:
            for f in [pool.submit(step) for step in steps]:
                f.result()

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_parquet(self.spark, self.sf_dir, name)
        return self._cache[name]


@dataclass
class JdbcSpec:
    """Connection settings of a relational source.

    ``partition_column`` with bounds splits the read into ``num_partitions``
    range queries; without it the whole result arrives in one task, which
    only suits small dictionaries.
    """

    url: str
    dbtable: str
    user: str | None = None
    password: str | None = None
    partition_column: str | None = None
    lower_bound: int | None = None
    upper_bound: int | None = None
    num_partitions: int | None = None
    fetch_size: int = 10_000
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str, dbtable: str, **kw) -> "JdbcSpec":
        """Read host/port/database/user/password from a JSON credentials file."""
        with open(path) as fh:
            conf = json.load(fh)
        url = conf.get("url") or (
            f"jdbc:postgresql://{conf['host']}:{conf.get('port', 5432)}/{conf['database']}")
        return cls(url=url, dbtable=dbtable, user=conf.get("user"),
                   password=conf.get("password"), **kw)


def read_table(spark: SparkSession, spec: JdbcSpec) -> DataFrame:
    """Load a table or a parenthesised subquery through JDBC."""
    reader = (spark.read.format("jdbc").option("url", spec.url)
              .option("dbtable", spec.dbtable).option("fetchsize", spec.fetch_size))
    if spec.user is not None:
        reader = reader.option("user", spec.user)
    if spec.password is not None:
        reader = reader.option("password", spec.password)
    if spec.partition_column:
        reader = (reader.option("partitionColumn", spec.partition_column)
                  .option("lowerBound", spec.lower_bound).option("upperBound", spec.upper_bound)
                  .option("numPartitions", spec.num_partitions or 64))
    for k, v in spec.extra.items():
        reader = reader.option(k, v)
    return reader.load()
