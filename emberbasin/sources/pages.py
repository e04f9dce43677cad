"""The paged feed as a data source of Spark's own: a partition for every page offset, or for some small pages in a row.

A pull of the feed lands its pages in a folder, each under the offset it was asked for: a file, or a folder with one file, whose name
holds ``offset=<number>``. All pages but the last are full, the last is short or empty. A gap in the offsets, a short page with
another behind it, a page of too many features, and a page without ``features`` are errors, so a pull that was cut short isn't taken for a whole one.

    spark.dataSource.register(FeedPages)
    spark.read.format("feed_pages").option("pageSize", 15000).load(folder)
    spark.readStream.format("feed_pages").option("pageSize", 15000).load(folder)

A stream takes the pages as they land, in the order of their offsets; a page after a gap waits until the gap is closed.
Folders may be local paths or any URI that pyarrow can open.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberbasin.schemas import FEED

# Fixed value: features that a pull asks for at a time.
PAGE_SIZE = 15_000
OFFSET = re.compile(r"offset=(\d+)")
#: Pages share a partition only where there are more than this, and only up to so many features.
PARTITIONS = 64
PARTITION_FEATURES = 25_000


@dataclass
class Page:
    """One landed page."""

    offset: int
    path: str
    last: bool


@dataclass
class Pages(InputPartition):
    """Landed pages in a row."""

    pages: list[Page]


def opened(folder: str) -> tuple[object, str]:
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if re.match(r"[a-z][a-z0-9]*:", folder) else (fs.LocalFileSystem(), folder)


def land(texts: DataFrame, folder: str) -> None:
    """Writes ``offset`` and ``value``, a page's text, as a file a page, each in one step under its name.

    Tasks write the files themselves: a folder, a check sum and two moves for each small page, as Spark's writer makes them, take longer than the page.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for offset, value in zip(batch["offset"].to_pylist(), batch["value"].to_pylist()):
                hidden = f"{base}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden, compression=None) as file:
                    file.write(value.encode())
                system.move(hidden, f"{base}/offset={offset}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["pages"])

    texts.select("offset", "value").mapInArrow(write, "pages long").agg({"pages": "sum"}).collect()


def landed(folder: str) -> tuple[object, dict[int, str]]:
    """The file system of a folder and the landed pages by offset."""
    from pyarrow import fs

    system, base = opened(folder)
    found: dict[int, str] = {}
    for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = info.path[len(base) :]
        offset = OFFSET.search(name)
        hidden = any(part.startswith((".", "_")) for part in name.split("/"))
        if info.type != fs.FileType.File or not offset or hidden:
            continue
        if int(offset[1]) in found:
            raise ValueError(f"two pages of offset {int(offset[1])} in {folder}")
        found[int(offset[1])] = info.path
    return system, found


def text_of(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


class _Pages:
    """What the batch and the stream reader share."""

    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.folder = options.get("path", "")
        self.size = int(options.get("pagesize", PAGE_SIZE))
        if not self.folder or self.size < 1:
            raise ValueError("feed_pages needs a folder and a page size of one at least")

    def dealt(self, pages: Sequence[Page]) -> list[Pages]:
        """A partition a page, or small pages in a row where there are many."""
        each = max(1, min(PARTITION_FEATURES // self.size, len(pages) // PARTITIONS))
        return [Pages(list(pages[i : i + each])) for i in range(0, len(pages), each)]

    def read(self, some: Pages | None) -> Iterator[pa.RecordBatch]:
        if some is None:  # where there are no partitions Spark asks for one without a page
            return
        system, _ = opened(self.folder)
        for page in some.pages:
            yield self.rows(system, page)

    def rows(self, system: object, page: Page) -> pa.RecordBatch:
        with system.open_input_stream(page.path, compression=None) as file:
            content = json.loads(file.read())
        if not isinstance(content, dict) or content.get("features") is None:
            raise ValueError(f"page of offset {page.offset} has no 'features'")
        rows = [feature["attributes"] for feature in content["features"]]
        if len(rows) > self.size:
            raise ValueError(f"page of offset {page.offset} has {len(rows)} features, more than {self.size}")
        if len(rows) < self.size and not page.last:
            raise ValueError(f"page of offset {page.offset} is short, but there are pages behind it")
        kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
        columns = []
        for name, kind in zip(self.names, self.kinds):
            values = [row.get(name) for row in rows]
            columns.append(pa.array(map(text_of, values) if kind == "string" else values, kinds[kind]))
        return pa.RecordBatch.from_arrays(columns, self.names)


class FeedPageReader(_Pages, DataSourceReader):
    def partitions(self) -> list[Pages]:
        _, found = landed(self.folder)
        last = max(found, default=-self.size)
        for offset in range(0, last + 1, self.size):
            if offset not in found:
                raise ValueError(f"the page of offset {offset} is missing in {self.folder}")
        if strange := [o for o in found if o % self.size]:
            raise ValueError(f"offset {min(strange)} isn't a multiple of the page size {self.size}")
        return self.dealt([Page(o, found[o], o == last) for o in sorted(found)])


class FeedPageStreamReader(_Pages, DataSourceStreamReader):
    """Offsets of the stream are numbers of pages from the first."""

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        _, found = landed(self.folder)
        pages = 0
        while pages * self.size in found:
            pages += 1
        return {"pages": pages}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        _, found = landed(self.folder)
        # Behind a page there may be one by now, though there was none when the batch was planned.
        last = max(found, default=0)
        return self.dealt([Page(k * self.size, found[k * self.size], k * self.size == last) for k in range(start["pages"], end["pages"])])

    def commit(self, end: dict) -> None:
        """Pages stay where they landed."""


class FeedPages(DataSource):
    """Format ``feed_pages``; the schema is the raw feed's unless one of long, double and string columns is given."""

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> StructType:
        return FEED

    def reader(self, schema: StructType) -> FeedPageReader:
        return FeedPageReader(schema, self.options)

    def streamReader(self, schema: StructType) -> FeedPageStreamReader:
        return FeedPageStreamReader(schema, self.options)


# Executors need pyarrow for it, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
