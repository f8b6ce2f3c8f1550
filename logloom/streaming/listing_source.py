"""A streaming source over the day files of an archive: its offset is the listing, its rows are what changed between two listings.

A file source remembers names, so a day that grows under its name never wakes it. Here the offset holds the size and time of each
day file; a new, grown, replaced or vanished day changes the offset, makes a batch and comes out as one row. The offset has one short
entry per day file of the archive, as long as its listing; contents are not read. Spark keeps the offsets in the
query's checkpoint, so a restarted stream goes on from the listing it committed.
"""

from __future__ import annotations

import datetime as dt
import itertools
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "env string, day date, rel_path string, size bigint, mtime_ns bigint, change string"
DAY_FILE = re.compile(r"^([^/.][^/]*)/(\d{4})/(\d{2})/(\d{8})\.txt$")
ROWS = 1000


def list_days(root: str) -> dict[str, str]:
    """``env/YYYY/MM/YYYYMMDD.txt`` → ``size:mtime`` of the day files under ``root``; other names are no day files."""
    from pyarrow import fs

    if "://" in root:
        store, base = fs.FileSystem.from_uri(root)
    else:
        store, base = fs.LocalFileSystem(), root.removeprefix("file:")
    out = {}
    for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.path[len(base.rstrip("/")) + 1:]
        m = DAY_FILE.match(name)
        if info.type == fs.FileType.File and m and m[4].startswith(m[2] + m[3]) and _day(m[4]):
            out[name] = f"{info.size}:{info.mtime_ns}"
    return out


def _day(stem: str) -> dt.date | None:
    try:
        return dt.datetime.strptime(stem, "%Y%m%d").date()
    except ValueError:
        return None


class Changed(InputPartition):
    """Some changed day files: (name, what it was, what it is)."""


class DayListing(DataSource):
    """``spark.readStream.format("day_listing").option("path", root)``"""

    @classmethod
    def name(cls) -> str:
        return "day_listing"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return DayListingReader(self.options["path"])


class DayListingReader(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return list_days(self.root)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        changed = [(n, start.get(n), end.get(n)) for n in sorted(start.keys() | end.keys()) if start.get(n) != end.get(n)]
        return [Changed(part) for part in itertools.batched(changed, ROWS)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for name, was, now in partition.value:
            env, stem = name.split("/", 1)[0], name.rsplit("/", 1)[1][:-4]
            size, mtime = map(int, now.split(":")) if now else (None, None)
            yield env, _day(stem), name, size, mtime, "new" if was is None else "gone" if now is None else "changed"

    def commit(self, end: dict) -> None:
        pass
