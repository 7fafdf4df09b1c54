"""Media columns: payloads stored losslessly as images in archives, and a data source that reads them back.

Storing: each task writes its rows as 8-bit grey PNG images, 64 samples wide, into ZIP archives of about
``ARCHIVE_BYTES`` in the shared folder. An archive gets its name only when it is complete, and a repeated task writes the
same bytes under the same name, so a lost executor leaves nothing that is read.

Reading (``media_archive``): the driver lists the archives' names and sizes only and plans byte ranges of them. A task
reads the directory at its archive's end, takes the members that begin within its range, reads and checks each at its own
offset, again if that fails, without touching the others, and streams record batches of bounded size.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldspark.llm.common import shared_dir

WIDTH = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
ATTEMPTS = 4
#: Fixed value: the first bytes of every PNG file.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "member string, offset long, media binary, width int, height int, n_bytes long, payload binary, feature string"


# -- images ----------------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_image(data: bytes, level: int = 6) -> bytes:
    """A grey PNG whose samples are the bytes, filled up with zeros to rows of 64; a text chunk has their number."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    size = b"n_bytes\0" + str(len(data)).encode()
    return PNG_SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", size) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def decode_image(media: bytes) -> tuple[int, bytes]:
    """The number of stored bytes and the samples of an image that encode_image made; ValueError if it is damaged."""
    if not media.startswith(PNG_SIGNATURE):
        raise ValueError("not a PNG image")
    chunks: dict[bytes, bytes] = {}
    at = len(PNG_SIGNATURE)
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if len(data) != size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        chunks[kind] = data
        at += size + 12
    width, height, *kind = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(chunks[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if width != WIDTH or kind != [8, 0, 0, 0, 0] or rows[:, 0].any():
        raise ValueError("not an image of this module")
    return int(chunks[b"tEXt"].removeprefix(b"n_bytes\0")), rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, their entropy in bits, and 16 brightness levels from top to bottom."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    used = share[share > 0]
    mean = float(share @ np.arange(256))
    deviation = float(np.sqrt(share @ (np.arange(256) - mean) ** 2))
    bands = np.linspace(0, len(samples) // WIDTH, 17).astype(int)
    row_sums = np.concatenate([[0], np.cumsum(samples.reshape(-1, WIDTH).sum(1, dtype=np.int64))])
    levels = (row_sums[bands[1:]] - row_sums[bands[:-1]]) // np.maximum(1, (bands[1:] - bands[:-1]) * WIDTH * 16)
    return f"mean={mean:.4f} dev={deviation:.4f} bits={float(-(used @ np.log2(used))) + 0.0:.4f} bands={''.join(f'{x:x}' for x in levels)}"


# -- archives --------------------------------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _ArchiveWriter:
    """One archive at a time, closed under its final name when large enough."""

    def __init__(self, folder: str, task: int):
        self._fs, self._folder = _filesystem(folder)
        self._task, self._number, self._members, self._file = task, 0, 0, None

    def add(self, name: str, media: bytes) -> None:
        if self._file is None:
            self._temporary = f"{self._folder}/.{uuid.uuid4().hex}"
            self._stream = self._fs.open_output_stream(self._temporary, buffer_size=1 << 20)
            self._file, self._size = zipfile.ZipFile(self._stream, "w", zipfile.ZIP_STORED), 0
        entry = zipfile.ZipInfo(f"{self._members:08d}-{name}.png")  # a date of its own would change the bytes
        self._file.writestr(entry, media)
        self._members += 1
        self._size += len(media)
        if self._size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
            self._stream.close()
            self._fs.move(self._temporary, f"{self._folder}/{self._task:06d}-{self._number:04d}.zip")
            self._file, self._number = None, self._number + 1


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> None:
    """Stores every row's whole text (UTF-8; null: empty) as a member of archives in the new folder. A member's name has
    the row's id, ``null`` for none; repeated rows are members of their own."""
    filesystem, path = _filesystem(folder)
    filesystem.create_dir(path, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer = _ArchiveWriter(folder, TaskContext.get().partitionId())
        members = 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer() if text.is_valid else None
                writer.add("null" if not name.is_valid else str(name.as_py()), encode_image(data.to_pybytes() if data else b"", level))
                members += 1
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([members], pa.int64())], ["members"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen.mapInArrow(run, "members long").agg(F.sum("members")).collect()


@dataclass
class ByteRange(InputPartition):
    path: str
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self._folder = options["path"]
        self._range = int(options.get("rangebytes", RANGE_BYTES))
        self._attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[ByteRange]:
        filesystem, path = _filesystem(self._folder)
        files = sorted((f.path, f.size) for f in filesystem.get_file_info(fs.FileSelector(path)) if f.path.endswith(".zip"))
        # an empty folder has no ranges; one without bytes reads nothing
        return [ByteRange(p, at, min(size, at + self._range)) for p, size in files for at in range(0, size, self._range)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        filesystem, _ = _filesystem(self._folder)
        schema = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("width", pa.int32()), ("height", pa.int32()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("feature", pa.string())])
        rows, size = [], 0
        with filesystem.open_input_file(partition.path) as file, zipfile.ZipFile(file) as directory:
            members = [m for m in directory.infolist() if partition.begin <= m.header_offset < partition.end]
        for member in members:
            media, n_bytes, payload = self._member(filesystem, partition.path, member)
            rows.append((member.filename, member.header_offset, media, WIDTH, len(payload) // WIDTH, n_bytes, payload, feature(payload)))
            size += len(media) + len(payload)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _member(self, filesystem: fs.FileSystem, path: str, member: zipfile.ZipInfo) -> tuple[bytes, int, bytes]:
        """The bytes stored at the member's offset and what they hold; read anew after an error."""
        for attempt in range(self._attempts):
            try:
                with filesystem.open_input_file(path) as file:
                    header = file.read_at(30, member.header_offset)
                    if header[:4] != b"PK\3\4":
                        raise ValueError("no member at this offset")
                    name, extra = struct.unpack_from("<HH", header, 26)
                    media = file.read_at(member.file_size, member.header_offset + 30 + name + extra)
                if len(media) != member.file_size or zlib.crc32(media) != member.CRC:
                    raise ValueError("damaged member")
                return media, *decode_image(media)
            except (OSError, ValueError, zlib.error) as error:
                problem = error
                time.sleep(0.05 * attempt)
        raise OSError(f"{path}, member at byte {member.header_offset}: {problem}")


class MediaArchive(DataSource):
    """spark.read.format("media_archive").option("rangebytes", n).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the columns of SCHEMA: every row's payload as stored and read back from archives in the shared folder.

    A null text is stored as an empty one, 64 zeros. Equal texts have equal images. Rows may repeat and ids be null. The
    archives stay until the shared folder is cleared, for the result is read from them."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, id_col, text_col)
    number = F.regexp_extract("member", r"^\d+-(-?\d+)\.png$", 1)
    return read_archives(spark, folder).select(F.when(number != "", number).cast("long").alias("doc_id"), "*")
