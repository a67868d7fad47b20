"""A streaming source that follows a growing, rotating text file by whole lines.

    spark.dataSource.register(TailSource)
    spark.readStream.format("tail").option("path", p).option("startingPosition", "latest").load()

The offset is the file's inode and the byte after its last whole line, so a line that
is still being written waits for the next batch, and a checkpoint resumes in place.
A new inode, or a file shorter than the offset, starts again at 0.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: Bytes read in one batch, about; the rest follows in the next. A longer line is read whole.
MOST_BYTES = 64 << 20


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, start: str):
        if start not in ("latest", "earliest"):
            raise ValueError("startingPosition is latest or earliest")
        self.path, self.start = path, start

    def state(self) -> tuple[int, int]:
        """Inode and size; (0, 0) while there is no file."""
        try:
            found = os.stat(self.path)
            return found.st_ino, found.st_size
        except FileNotFoundError:
            return 0, 0

    def initialOffset(self) -> dict:
        inode, size = self.state()
        return {"inode": inode, "pos": size if self.start == "latest" else 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        inode, size = self.state()
        pos = start["pos"] if inode == start["inode"] and size >= start["pos"] else 0
        if not inode or size == pos:
            return iter(()), {"inode": inode or start["inode"], "pos": pos if inode else start["pos"]}
        with open(self.path, "rb") as f:
            f.seek(pos)
            raw = f.read(min(size - pos, MOST_BYTES))
            while b"\n" not in raw and pos + len(raw) < size and (more := f.read(min(size - pos - len(raw), MOST_BYTES))):
                raw += more[: more.find(b"\n") + 1] or more  # up to the end of the long line
        whole = raw.rfind(b"\n") + 1
        lines = raw[:whole].decode("utf-8", "replace").split("\n")[:-1]
        at, rows = pos, []
        for line, n in zip(lines, (len(x) + 1 for x in raw[:whole].split(b"\n")[:-1]), strict=True):
            rows.append((at, line))
            at += n
        return iter(rows), {"inode": inode, "pos": pos + whole}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The lines of a planned batch again; none if the file was replaced since."""
        inode, size = self.state()
        if inode != end["inode"] or size < end["pos"]:
            return iter(())
        pos = start["pos"] if start["inode"] == inode and start["pos"] <= end["pos"] else 0
        with open(self.path, "rb") as f:
            f.seek(pos)
            raw = f.read(end["pos"] - pos)
        at, rows = pos, []
        for part in raw.split(b"\n")[:-1]:
            rows.append((at, part.decode("utf-8", "replace")))
            at += len(part) + 1
        return iter(rows)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> StructType | str:
        return "_seq bigint, value string"

    def simpleStreamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options["path"], self.options.get("startingPosition", self.options.get("startingposition", "latest")))
