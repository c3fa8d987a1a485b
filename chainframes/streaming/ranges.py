"""Block ranges as a stream, so that batches are bounded by blocks.

The stream's rows are ranges only (``first_block, last_block``); the blocks of a
range are read by Spark, with its pushdown, inside the batch.  Offsets are block
numbers, so a restarted stream goes on behind the last range that was done.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

#: Blocks of a batch, unless told otherwise.
MAX_BLOCKS = 256


def read_head(uri: str) -> int:
    """The head of the chain from a small text file that whoever fetches blocks
    keeps; -1 while it is not there."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return -1
    with system.open_input_file(path) as file:
        return int(file.read().decode().strip() or -1)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.start, self.size = int(options.get("start", 0)), int(options.get("max_blocks", MAX_BLOCKS))
        self.end = int(options["end"]) if "end" in options else None
        self.head = options.get("head")
        if self.end is None and self.head is None:
            raise ValueError("block ranges need an 'end' or the file that holds the 'head'")
        if self.size < 1:
            raise ValueError("'max_blocks' is at least 1")

    def initialOffset(self) -> dict:
        return {"block": self.start - 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        last = start["block"] + self.size
        if self.end is not None:
            last = min(last, self.end)
        if self.head is not None:
            last = min(last, read_head(self.head))
        if last <= start["block"]:
            return iter(()), start
        return iter([(start["block"] + 1, last)]), {"block": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(start["block"] + 1, end["block"])] if end["block"] > start["block"] else [])


class BlockRanges(DataSource):
    """``spark.readStream.format("block_ranges")`` with the options ``start``,
    ``max_blocks``, ``end`` (inclusive) and ``head`` (a file)."""

    @classmethod
    def name(cls) -> str:
        return "block_ranges"

    def schema(self) -> str:
        return "first_block bigint, last_block bigint"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))
