"""Lines of text members of zip containers, as a Spark data source and sink.

    spark.dataSource.register(ZipLines)
    spark.read.format("zip_lines").option("members", "DATA/*.txt").load("logs.zip")

One partition per container and member. A member is inflated in pieces; an unfinished
line, a carriage return whose line feed may follow, and a character's unfinished bytes
wait for the next piece, so memory holds a piece and a line, however long the member is.
Lines end at ``\\n``, ``\\r`` and ``\\r\\n`` as those of Spark's text source. A path is a container,
or a folder whose ``*.zip`` files are read in the order of their names; local paths and
those of file systems that Arrow knows (``hdfs:``, ``s3:``, ...).

Rows are (container, member, value): the line's bytes, still unchecked as UTF-8. Option
``encoding`` names another encoding, whose bad bytes are replaced. A member pattern that
nothing matches is an error, and so is a damaged member.

The sink writes one container per task, with one member per value of ``member``; rows
should come sorted by member, each member is written in the order of its rows.
"""

from __future__ import annotations

import codecs
import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

#: Bytes of a member that are inflated at once, and lines handed on at once.
PIECE_BYTES, BATCH_LINES = 1 << 20, 1 << 14
SCHEMA = StructType([StructField("container", StringType()), StructField("member", StringType()), StructField("value", BinaryType())])
_ARROW = pa.schema([("container", pa.string()), ("member", pa.string()), ("value", pa.binary())])


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def _open(path: str) -> zipfile.ZipFile:
    fs, name = _place(path)
    return zipfile.ZipFile(io.BufferedReader(fs.open_input_file(name), PIECE_BYTES))


def containers(path: str) -> list[str]:
    """The container itself, or those of a folder."""
    fs, name = _place(path)
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if fs.get_file_info(name).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(name))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name)
            if f.base_name.endswith(".zip")]


def lines_of(pieces: Iterator[bytes]) -> Iterator[list[bytes]]:
    """The lines of bytes that come in pieces, a list for each piece."""
    waiting: list[bytes] = []
    open_return = False
    for piece in pieces:
        if open_return:
            # The return that ended the piece before; a line feed would belong to it.
            piece = b"\r" + piece
        open_return = piece.endswith(b"\r")
        if open_return:
            piece = piece[:-1]
        found = piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        if len(found) > 1:
            waiting.append(found[0])
            found[0] = b"".join(waiting)
            waiting = []
            yield found[:-1]
        if found[-1]:
            waiting.append(found[-1])
    last = b"".join(waiting)
    if last or open_return:
        yield [last]


def _pieces(container: zipfile.ZipFile, member: str, encoding: str) -> Iterator[bytes]:
    plain = codecs.lookup(encoding).name == "utf-8"
    decoder = codecs.getincrementaldecoder(encoding)("replace")
    with container.open(member) as file:
        while piece := file.read(PIECE_BYTES):
            yield piece if plain else decoder.decode(piece).encode("utf-8", "replace")
    if not plain:
        yield decoder.decode(b"", final=True).encode("utf-8", "replace")


def read_member(path: str, member: str, encoding: str = "utf-8") -> Iterator[pa.RecordBatch]:
    """The lines of one member, as rows of the source."""
    with _open(path) as container:
        for found in lines_of(_pieces(container, member, encoding)):
            for i in range(0, len(found), BATCH_LINES):
                value = pa.array(found[i:i + BATCH_LINES], pa.binary())
                names = [pa.array([x]).take(pa.nulls(len(value), pa.int32()).fill_null(0)) for x in (path, member)]
                yield pa.RecordBatch.from_arrays([*names, value], schema=_ARROW)


@dataclass
class _Member(InputPartition):
    path: str
    member: str


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.encoding = options["path"], options.get("encoding", "utf-8")
        self.patterns = options.get("members", "*").split(",")

    def partitions(self) -> list[_Member]:
        found, used = [], set()
        for path in containers(self.path):
            with _open(path) as container:
                for member in container.infolist():
                    if not member.is_dir():
                        matched = [p for p in self.patterns if fnmatchcase(member.filename, p)]
                        used.update(matched)
                        if matched:
                            found.append(_Member(path, member.filename))
        missing = [p for p in self.patterns if p not in used]
        if missing:
            raise FileNotFoundError(f"no member {missing} in {self.path}")
        return found

    def read(self, partition: _Member) -> Iterator[pa.RecordBatch]:
        return read_member(partition.path, partition.member, self.encoding)


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _place(self.path)
        fs.create_dir(root, recursive=True)
        # Under a name of its own attempt; the final name comes with the commit.
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.zip.tmp"
        container = member = None
        current = None
        try:
            for batch in iterator:
                for key, value in zip(batch.column("member").to_pylist(), batch.column("value").to_pylist()):
                    if container is None:
                        stream = fs.open_output_stream(f"{root}/{name}")
                        container = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    if member is None or key != current:
                        if member is not None:
                            member.close()
                        if key in container.NameToInfo:
                            raise ValueError(f"rows of member {key} do not follow each other")
                        member, current = container.open(key, "w", force_zip64=True), key
                    member.write((value or b"") + b"\n")
        finally:
            if container is not None:
                if member is not None:
                    member.close()
                container.close()
                stream.close()
        return _Written([name] if container is not None else [])

    def commit(self, messages: list[_Written | None]) -> None:
        fs, root = _place(self.path)
        names = [n for m in messages if m is not None for n in m.names]
        if self.overwrite:
            for old in containers(self.path):
                fs.delete_file(f"{root}/{old.rsplit('/', 1)[-1]}")
        for name in names:
            fs.move(f"{root}/{name}", f"{root}/{name.removesuffix('.tmp')}")

    def abort(self, messages: list[_Written | None]) -> None:
        fs, root = _place(self.path)
        for message in messages:
            for name in message.names if message is not None else []:
                fs.delete_file(f"{root}/{name}")


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)
