"""Response files as a Python data source, batch and stream, that decodes only the fields asked for.

The schema's fields are those that a document is cut to while it is read: a projection of two fields decodes two. Fields
that the kind of request doesn't ask for aren't there. Equality filters on `kind` and ranges of `file` are taken at the
source and skip files. Partitions are ranges of files, so a folder of any size is read by as many tasks as it has parts.

A stream's offset is a number of files in the order of their names; files must be added under later names, as a crawl
does. A stream that starts again goes on after the last offset that its checkpoint holds.

Files are read through Arrow's file systems (local or mounted folders, and what its build knows of object stores); a store
that only Spark reads is for `profiles.responses`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from .profiles import KINDS, PROJECTIONS

FILES = 64  # in a partition
_OWN = ("file", "kind", "nth")  # columns that aren't fields of a document
_KIND = re.compile(r"(?:^|/)(profile|ancestors|descendants)[^/]*$")


def _listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the folder's JSON files, by name."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = where.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path[len(root) :].lstrip("/"), f.size) for f in found if f.is_file and f.path.endswith(".json"))


def _text(path: str, name: str) -> bytes:
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with where.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def kind_of(name: str) -> str:
    """The kind of request that a file's name begins with; profile otherwise."""
    found = _KIND.search(name)
    return found[1] if found else "profile"


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class Decoder:
    """Cuts responses to the schema's fields. `decoded` counts the values that were made."""

    def __init__(self, schema: StructType, kind: str | None) -> None:
        self.schema, self.kind, self.decoded = schema, kind, 0

    def rows(self, name: str, raw: bytes) -> Iterator[tuple]:
        kind = self.kind or kind_of(name)
        try:
            response = json.loads(raw)
        except ValueError:
            return
        first = response[0] if isinstance(response, list) and response and isinstance(response[0], dict) else {}
        found = first.get(kind)
        documents = found if isinstance(found, list) else [found]
        asked = set(PROJECTIONS[kind])
        for nth, document in enumerate(documents):
            if isinstance(document, dict):
                own = {"file": name, "kind": kind, "nth": nth}
                yield tuple(own[f.name] if f.name in own else self.value(document.get(f.name), f.dataType) if f.name in asked else None for f in self.schema.fields)

    def value(self, v, kind):
        self.decoded += 1
        if v is None:
            return None
        if isinstance(kind, StringType):
            return v if isinstance(v, str) else json.dumps(v)
        if isinstance(kind, BooleanType):
            return v is True or not isinstance(v, (bool, str)) and v == 1
        try:
            if isinstance(kind, (IntegerType, LongType)) and not isinstance(v, bool):
                n = int(v)
                return n if abs(n) < 1 << (31 if isinstance(kind, IntegerType) else 63) else None
            if isinstance(kind, DoubleType) and not isinstance(v, bool):
                return float(v)
        except (TypeError, ValueError):
            pass
        return None


class _Reading:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("the source needs a path")
        if options.get("kind") not in (None, *KINDS):
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        self.path, self.kind, self.schema = options["path"], options.get("kind"), schema
        self.files = max(1, int(options.get("filesperpartition", FILES)))

    def parts(self, names: list[str]) -> list[Files]:
        return [Files(tuple(names[k : k + self.files])) for k in range(0, len(names), self.files)]

    def read(self, partition: Files) -> Iterator[tuple]:
        decoder = Decoder(self.schema, self.kind)
        for name in partition.names:
            yield from decoder.rows(name, _text(self.path, name))


class ResponseReader(_Reading, DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality of kind and comparisons of file; Spark applies the others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("kind",), ("file",)) or isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("file",):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, name: str) -> bool:
        compare = {EqualTo: lambda a, b: a == b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b}
        return all(compare[type(f)](name if f.attribute == ("file",) else self.kind or kind_of(name), f.value) for f in self.filters)

    def partitions(self) -> list[Files]:
        return self.parts([name for name, _ in _listed(self.path) if self.wanted(name)]) or [Files(())]


class ResponseStreamReader(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_listed(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.parts([name for name, _ in _listed(self.path)[start["files"] : end["files"]]])

    def commit(self, end: dict) -> None:
        pass


class ResponseSource(DataSource):
    """Format `responses`; options path, kind (else by each file's name), filesPerPartition. Without a schema all fields of a profile, as text."""

    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        kind = self.options.get("kind") or "profile"
        return "file string, kind string, nth int, " + ", ".join(f"{f} string" for f in PROJECTIONS.get(kind, PROJECTIONS["profile"]))

    def reader(self, schema: StructType) -> ResponseReader:
        return ResponseReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> ResponseStreamReader:
        return ResponseStreamReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResponseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
