"""S3: persisted derived tables, dropped and rebuilt in dependency order.

A table is named, built from sources and from other tables, and has
parameters.  Its *digest* covers its name, its parameters, the versions of its
sources and the digests of the tables it reads, so a change anywhere
upstream changes the digests of everything built on it: ``refresh`` rebuilds
exactly the tables whose published digest differs, upstream first.

Every build writes a folder of its own.  A *pointer*, one small file, names the
published folder; pointers are numbered, the highest number holds, and a new one
appears by a rename to a name not used before, after the table's write has
ended.  So nothing is replaced in place: a reader always finds a whole version,
and a job that stops between write and publish leaves the old one.  Superseded
folders and pointers stay until ``sweep``, for the sake of jobs that still read them.

Only names and digests are handled on the driver; rows never are.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from wardlens.sources.sinks import file_system


def files_version(spark: SparkSession, path: str) -> str:
    """Version of a file source: its files' names, sizes and modification times (no data is read)."""
    fs, root = file_system(spark, path)
    found, files = fs.listFiles(root, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(files)).encode()).hexdigest()


@dataclass(frozen=True)
class Table:
    name: str
    build: Callable[..., DataFrame]
    reads: tuple[str, ...]
    params: dict


class DerivedTables:
    """The tables of one folder of a shared file system.

    ``source`` and ``table`` declare the graph, upstream first; nothing is read or written before ``refresh``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.sources: dict[str, tuple[Callable[[], DataFrame], str]] = {}
        self.tables: dict[str, Table] = {}

    # ---- graph -----------------------------------------------------------------------------

    def source(self, name: str, read: Callable[[], DataFrame], version: str) -> None:
        """A table kept elsewhere; ``version`` changes when its rows do."""
        self._new(name)
        self.sources[name] = (read, version)

    def table(self, name: str, build: Callable[..., DataFrame], reads: Sequence[str], params: dict | None = None) -> None:
        """``build(*inputs, **params)`` makes the table from ``reads``, sources or tables declared before."""
        self._new(name)
        missing = [r for r in reads if r not in self.sources and r not in self.tables]
        if missing:
            raise ValueError(f"{name} reads {missing}, which are not declared before it")
        self.tables[name] = Table(name, build, tuple(reads), dict(params or {}))

    def change(self, name: str, **params) -> None:
        """Other parameters for a declared table."""
        t = self.tables[name]
        self.tables[name] = Table(t.name, t.build, t.reads, t.params | params)

    def _new(self, name: str) -> None:
        if name in self.sources or name in self.tables:
            raise ValueError(f"{name} is declared already")
        if not name.replace("_", "a").isalnum():
            raise ValueError(f"{name!r} does not name a folder")

    def digest(self, name: str) -> str:
        """Digest of a table as declared, or the version of a source."""
        if name in self.sources:
            return self.sources[name][1]
        t = self.tables[name]
        text = json.dumps([t.name, t.params, [(r, self.digest(r)) for r in t.reads]], sort_keys=True,
                          default=lambda x: sorted(x) if isinstance(x, (set, frozenset)) else str(x))
        return hashlib.sha256(text.encode()).hexdigest()

    def built_on(self, name: str) -> list[str]:
        """The table and all tables that read it, directly or through others, in order."""
        hit = {name}
        for t in self.tables.values():  # declared upstream first
            if hit & set(t.reads):
                hit.add(t.name)
        return [n for n in self.tables if n in hit]

    # ---- published versions ----------------------------------------------------------------

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointer files, the one that holds last."""
        fs, folder = file_system(self.spark, os.path.join(self.root, name))
        if not fs.exists(folder):
            return []
        return sorted(n for f in fs.listStatus(folder) if (n := f.getPath().getName()).startswith("current-"))

    def published(self, name: str) -> dict | None:
        """``digest`` and ``folder`` of the published version, or None (never built, or dropped)."""
        while names := self._pointers(name):
            fs, path = file_system(self.spark, os.path.join(self.root, name, names[-1]))
            try:
                stream = fs.open(path)
            except Py4JJavaError as e:
                if "FileNotFound" in str(e.java_exception):
                    continue  # swept since it was listed: a newer one is there
                raise
            try:
                now = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            return now if now["folder"] else None
        return None

    def read(self, name: str) -> DataFrame:
        """The published version, whether or not its inputs have changed since."""
        if name in self.sources:
            return self.sources[name][0]()
        now = self.published(name)
        if now is None:
            raise LookupError(f"{name} has not been built")
        return self.spark.read.parquet(os.path.join(self.root, name, now["folder"]))

    def write(self, name: str) -> dict:
        """Build a table into a folder of its own, not published yet."""
        t = self.tables[name]
        version = {"digest": self.digest(name), "folder": f"version-{uuid.uuid4().hex}"}
        t.build(*(self.read(r) for r in t.reads), **t.params).write.parquet(os.path.join(self.root, name, version["folder"]))
        return version

    def publish(self, name: str, version: dict) -> None:
        """Point readers to a written version, in one step."""
        names = self._pointers(name)
        number = int(names[-1].split("-")[1]) + 1 if names else 0
        fs, draft = file_system(self.spark, os.path.join(self.root, name, f"draft-{uuid.uuid4().hex}"))
        out = fs.create(draft, True)
        out.write(json.dumps(version).encode())
        out.close()
        _, target = file_system(self.spark, os.path.join(self.root, name, f"current-{number:012d}-{uuid.uuid4().hex}"))
        if not fs.rename(draft, target):
            raise OSError(f"{draft.toString()} cannot be renamed")

    def refresh(self, *names: str) -> dict[str, bool]:
        """Bring tables (all, if none is named) and what they read up to date, upstream first; whether each was rebuilt."""
        wanted = set(names or self.tables)
        for n in reversed(list(self.tables)):
            if n in wanted:
                wanted |= set(self.tables[n].reads) & set(self.tables)
        done = {}
        for n in self.tables:
            if n in wanted:
                now = self.published(n)
                done[n] = now is None or now["digest"] != self.digest(n)
                if done[n]:
                    self.publish(n, self.write(n))
        return done

    def drop(self, name: str) -> list[str]:
        """Drop a table and all that were built on it; readers find them again after the next ``refresh``."""
        gone = self.built_on(name)
        for n in reversed(gone):  # downstream first: no table outlives what it was built from
            if self.published(n):
                self.publish(n, {"digest": None, "folder": None})
        return gone

    def sweep(self) -> int:
        """Delete the folders that are not published (superseded, dropped or lost before), and all pointers but the
        last; how many folders.  Not to be run beside a job that writes the same tables."""
        n = 0
        for name in self.tables:
            fs, folder = file_system(self.spark, os.path.join(self.root, name))
            if not fs.exists(folder):
                continue
            now, last = self.published(name), self._pointers(name)[-1:]
            for f in fs.listStatus(folder):
                kept = now is not None and f.getPath().getName() in (now["folder"], *last)
                n += not kept and f.isDirectory()
                if not kept:
                    fs.delete(f.getPath(), True)
            if now is None:
                fs.delete(folder, True)
        return n
