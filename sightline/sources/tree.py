"""Trees of small files as a data source: directories are columns, and a filter on them keeps what it rules out from being
listed or opened.

A pattern such as {camera_dir}/{date_dir}/events/{dir_name}/metadata.json names the levels below a root. The driver lists
the first levels only (dealt) and deals what it finds to tasks; these list the rest and read the files.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from .metadata import opened

EVENT_FILES = "{camera_dir}/{date_dir}/events/{dir_name}/metadata.json"
NAME = re.compile(r"^\{(\w+)\}$")
#: How a filter compares a directory's name.
TESTS: dict[type, Callable] = {
    EqualTo: lambda f: lambda name: name == f.value,
    In: lambda f: lambda name: name in f.value,
    GreaterThan: lambda f: lambda name: name > f.value,
    GreaterThanOrEqual: lambda f: lambda name: name >= f.value,
    LessThan: lambda f: lambda name: name < f.value,
    LessThanOrEqual: lambda f: lambda name: name <= f.value,
    StringStartsWith: lambda f: lambda name: name.startswith(f.value),
    IsNotNull: lambda f: lambda name: True,
}


@dataclass
class Places(InputPartition):
    """Directories below the root that one task reads, each as the names of its levels."""

    at: list[list[str]]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, pattern: str, dealt: int, together: int, content: bool):
        self.root, self.steps, self.dealt, self.together, self.content = root, pattern.split("/"), dealt, together, content
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        names = {m[1] for m in map(NAME.match, self.steps) if m}
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if type(f) in TESTS and len(column) == 1 and column[0] in names:
                self.filters.append(f)
            else:
                yield f

    def _fits(self, step: str) -> Callable[[str], bool]:
        """Whether a directory or file of that name belongs to a level."""
        named = NAME.match(step)
        if not named:
            return lambda name: name == step
        tests = [TESTS[type(f)](f) for f in self.filters if f.attribute == (named[1],)]
        return lambda name: all(test(name) for test in tests)

    def _below(self, system, top: str, steps: Sequence[str], last: bool) -> Iterator[list[str]]:
        """Names of the levels of all places below top; with last, files at the end, else directories."""
        from pyarrow.fs import FileSelector, FileType

        if not steps:
            yield []
            return
        end = last and len(steps) == 1
        kind = FileType.File if end else FileType.Directory
        if NAME.match(steps[0]):
            fits = self._fits(steps[0])
            found = [i.base_name for i in system.get_file_info(FileSelector(top, allow_not_found=True)) if i.type == kind and fits(i.base_name)]
        else:
            found = [steps[0]] if system.get_file_info(f"{top}/{steps[0]}").type == kind else []
        for name in sorted(found):
            for more in self._below(system, f"{top}/{name}", steps[1:], last):
                yield [name, *more]

    def partitions(self) -> list[Places]:
        system, top = opened(self.root)
        found = list(self._below(system, top, self.steps[: self.dealt], self.dealt == len(self.steps)))
        return [Places(found[k : k + self.together]) for k in range(0, len(found), self.together)] or [Places([])]

    def read(self, partition: Places) -> Iterator[tuple]:
        system, top = opened(self.root)
        for at in partition.at:
            for rest in self._below(system, "/".join([top, *at]), self.steps[self.dealt :], True):
                levels = [*at, *rest]
                path = "/".join([top, *levels])
                text = None
                if self.content:
                    with system.open_input_stream(path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                yield (*(n for n, s in zip(levels, self.steps, strict=True) if NAME.match(s)), path, text)


class Tree(DataSource):
    """Options: path, pattern, dealt (levels that the driver lists), together (places to a task), content (whether files
    are read)."""

    @classmethod
    def name(cls) -> str:
        return "sighting_tree"

    def schema(self) -> str:
        names = [m[1] for m in map(NAME.match, self.options["pattern"].split("/")) if m]
        return ", ".join([*(f"{n} string" for n in names), "file_path string", "text string"])

    def reader(self, schema) -> TreeReader:
        o = self.options
        return TreeReader(o["path"], o["pattern"], int(o.get("dealt", 1)), int(o.get("together", 8)), o.get("content", "true") == "true")


def read_tree(spark: SparkSession, root: str, pattern: str, dealt: int = 1, together: int = 8, content: bool = True) -> DataFrame:
    """The levels that pattern names, file_path and text (null without content) of each file below root that fits it.
    Filters on levels are pushed down to the listing. An empty or missing root gives no rows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
    options = {"pattern": pattern, "dealt": str(dealt), "together": str(together), "content": str(content).lower()}
    return spark.read.format("sighting_tree").options(**options).load(root)


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the fields of the objects in text, leniently as metadata.read_json reads them; what is no object is left
    out."""
    levels = [c for c in rows.columns if c != "text"]
    whole = F.from_json("text", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    an_object = F.from_json("text", "map<string,string>").isNotNull()
    return rows.filter(an_object).select(*levels, whole.alias("w_")).select(*levels, "w_.*").drop("bad")


def read_event_tree(spark: SparkSession, root: str, together: int = 8) -> DataFrame:
    """metadata.read_events, by camera and date: a filter on camera_dir or date_dir opens only what it leaves."""
    from .metadata import EVENTS

    rows = parsed(read_tree(spark, root, EVENT_FILES, 2, together), EVENTS)
    return rows.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), "dir_name"))


def read_clip_tree(spark: SparkSession, root: str, schema: str, file: str, together: int = 64) -> DataFrame:
    """Objects of one file of each clip's folder (clips/<clip>), by clip, where the clip has a video."""
    rows = parsed(read_tree(spark, root, f"clips/{{clip_name}}/{file}", 2, together), schema)
    videos = read_tree(spark, root, "clips/{clip_name}/clip.mp4", 2, together, content=False).select("clip_name")
    return rows.join(videos, "clip_name", "left_semi")
