"""A Spark data source over repositories behind a Git REST service: ``spark.read.format("repository")``, also as a stream.

The driver lists paths only; executors fetch contents and commits, ``batch`` files to a partition. With ``pushdown``, filters
on the path are pushed to the listing, so files that no row needs are never fetched; Spark 4.1 keeps what one query
pushed for later queries on the same frame, so such a frame is good for a single query. As a stream, each micro-batch is the
next ``batch`` paths in order and the offset is the last of them: a restarted query goes on behind it.

Options: ``url``, ``repository``, ``branch``, ``path`` (a folder, or one file), ``recursive``, ``include`` and
``exclude`` (starts of paths, by commas), ``types`` (ends of paths), ``batch``, ``history`` (commits of each file), ``token``,
``tries``, ``pause`` (seconds before the second try, doubled after each) and ``missing`` (``skip`` files that can't be had, or ``fail``).
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, SimpleDataSourceStreamReader, StringEndsWith, StringStartsWith

SCHEMA = "repository string, branch string, file_path string, content string, commits array<struct<commit_id:string,short_id:string,author_name:string,author_date:string,message:string>>"
MAIN = "main"


class Service:
    """Listings, contents and commits of one repository. Answers 429 and 5xx are asked for again, with growing pauses."""

    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.name = self.options["repository"]
        self.branch = self.options.get("branch", MAIN).removeprefix("refs/heads/")
        self.base = f"{self.options['url'].rstrip('/')}/_apis/git/repositories"

    def _get(self, place: str, /, **query: str) -> bytes:
        request = urllib.request.Request(f"{self.base}{place}?{urllib.parse.urlencode(query)}")
        if token := self.options.get("token"):
            request.add_header("Authorization", "Basic " + base64.b64encode(f":{token}".encode()).decode())
        pause = float(self.options.get("pause", "1"))
        for left in range(int(self.options.get("tries", "4")) - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if not left or not (e.code == 429 or e.code >= 500):
                    raise
            except urllib.error.URLError:
                if not left:
                    raise
            time.sleep(pause)
            pause *= 2
        raise ValueError("tries must be positive")

    def paths(self) -> list[str]:
        """Files of the branch below the path, in order; a path that ends like a file is one."""
        below = self.options.get("path", "/")
        if not below.endswith("/") and "." in below.rsplit("/", 1)[-1]:
            return [below]
        level = "Full" if self.options.get("recursive", "true").lower() == "true" else "OneLevel"
        found = json.loads(self._get(f"/{urllib.parse.quote(self.name)}/items", scopePath=below, recursionLevel=level, **{"versionDescriptor.version": self.branch}))
        listed = lambda o: [x for x in self.options.get(o, "").split(",") if x]
        include, exclude, types = listed("include"), listed("exclude"), listed("types")
        kept = (x["path"] for x in found["value"] if x.get("gitObjectType") == "blob")
        return sorted({p for p in kept if (not include or p.startswith(tuple(include))) and not p.startswith(tuple(exclude)) and (not types or p.endswith(tuple(types)))})

    def rows(self, paths: list[str]) -> Iterator[tuple]:
        """Rows of the schema; files without content are none."""
        for path in paths:
            try:
                content = self._get(f"/{urllib.parse.quote(self.name)}/items", path=path, **{"versionDescriptor.version": self.branch, "$format": "text"}).decode("utf-8", "replace")
                commits = self._commits(path)
            except (urllib.error.HTTPError, urllib.error.URLError):
                if self.options.get("missing", "skip") == "fail":
                    raise
                continue
            if content:
                yield (self.name, self.branch, path, content, commits)

    def _commits(self, path: str) -> list[tuple]:
        most = int(self.options.get("history", "10"))
        if most < 1:
            return []
        query = {"searchCriteria.itemPath": path, "searchCriteria.itemVersion.version": self.branch, "searchCriteria.$top": str(most)}
        found = json.loads(self._get(f"/{urllib.parse.quote(self.name)}/commits", **query))["value"]
        return [(c["commitId"], c["commitId"][:8], c.get("author", {}).get("name"), c.get("author", {}).get("date"), c.get("comment", "")) for c in found]


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.tests: list[tuple[str, tuple]] = []

    def _wanted(self, path: str) -> bool:
        test = {"EqualTo": lambda v: path in v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith}
        return all(test[kind](values) for kind, values in self.tests)

    def partitions(self) -> list[Paths]:
        paths, n = [p for p in Service(self.options).paths() if self._wanted(p)], int(self.options.get("batch", "50"))
        return [Paths(paths[i : i + n]) for i in range(0, len(paths), n)]

    def read(self, partition: Paths | None) -> Iterator[tuple]:
        yield from Service(self.options).rows(partition.paths if partition else [])


class FilteringReader(RepositoryReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes tests of the path; Spark makes all others itself."""
        for f in filters:
            if getattr(f, "attribute", None) == ("file_path",) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith):
                self.tests.append((type(f).__name__, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f


class RepositoryStream(SimpleDataSourceStreamReader):
    """The driver fetches ``batch`` files for a micro-batch (Spark copies the iterator, so it is one of a list); its offset is the last path."""

    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"after": ""}

    def _between(self, after: str, upto: str | None) -> list[str]:
        return [p for p in Service(self.options).paths() if p > after and (upto is None or p <= upto)]

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        paths = self._between(start["after"], None)[: int(self.options.get("batch", "50"))]
        return iter(list(Service(self.options).rows(paths))), {"after": paths[-1] if paths else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return Service(self.options).rows(self._between(start["after"], end["after"]))


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepositoryReader:
        pushed = {k.lower(): v for k, v in self.options.items()}.get("pushdown") == "true"
        return FilteringReader(self.options) if pushed else RepositoryReader(self.options)

    def simpleStreamReader(self, schema) -> RepositoryStream:
        return RepositoryStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters be pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)


def repository(spark: SparkSession, stream: bool = False, **options: str | int) -> DataFrame:
    register(spark)
    return (spark.readStream if stream else spark.read).format("repository").options(**options).load()
