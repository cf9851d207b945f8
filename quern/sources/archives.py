"""Parts of files by ranged reads: the ends of text files, what zip archives hold, and their entries, each read by itself."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries of an archive, bytes of an entry and of all entries; characters of each end that are looked at.
ENTRIES, ENTRY_BYTES, TOTAL_BYTES = 200, 25 << 20, 100 << 20
END = 8192
#: Bytes that are decompressed at a time.
STEP = 1 << 20

Opener = Callable[[str], BinaryIO]


class _Ranged(io.RawIOBase):
    """A pyarrow file as Python's own readers expect one: a place before its start is an OSError."""

    def __init__(self, held: pa.NativeFile):
        self.held = held

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        some = self.held.read(len(into))
        into[: len(some)] = some
        return len(some)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.held.tell, self.held.size)[whence]() if whence else offset
        if at < 0:
            raise OSError("before the start of the file")
        return self.held.seek(at)

    def tell(self) -> int:
        return self.held.tell()

    def close(self) -> None:
        self.held.close()
        super().close()


def open_at(path: str) -> BinaryIO:
    """A file that can be read at any place, by the path that Spark has for it; for stores that pyarrow doesn't know hand in another opener."""
    from pyarrow import fs

    local = re.match("file:/+", path)
    store, at = fs.FileSystem.from_uri(path) if "://" in path and not local else (fs.LocalFileSystem(), path[local.end() - 1 :] if local else path)
    return io.BufferedReader(_Ranged(store.open_input_file(at)), 1 << 16)


def odd_characters(text: str) -> int:
    """How many characters are control characters (tab and line ends are not) or stand for bytes that are no UTF-8."""
    return len(re.findall("[\x00-\x08\x0b\x0c\x0e-\x1f�]", text))


def _ends(file: BinaryIO) -> str:
    """The first and last ``END`` characters of a file, or all of a file that has no more."""
    size, most = file.seek(0, 2), 4 * END
    file.seek(0)
    if size <= 2 * most:
        text = file.read().decode("utf-8", "replace")
        return text if len(text) <= 2 * END else text[:END] + text[-END:]
    first = codecs.getincrementaldecoder("utf-8")("replace").decode(file.read(most))
    file.seek(size - most)
    last = file.read(most).lstrip(bytes(range(0x80, 0xC0))).decode("utf-8", "replace")
    return first[:END] + last[-END:]


def text_files(spark: SparkSession, path: str, open_file: Opener = open_at) -> DataFrame:
    """(file, readable) of every file below ``path``, named as Spark's file metadata has it: not readable is one whose two ends are over a tenth odd characters.

    Only the ends are read. Empty files have no row, as the reader leaves them out; compressed ones (gz, bz2, zst, lz4, snappy) are taken as such unread.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            told = []
            for file in part["path"]:
                if re.search(r"\.(gz|bz2|zst|lz4|snappy)$", file):
                    told.append(True)
                    continue
                with open_file(file) as held:
                    text = _ends(held)
                told.append(odd_characters(text) * 10 <= len(text))
            yield pd.DataFrame({"file": part["file"], "readable": told})

    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    return files.mapInPandas(run, "file string, readable boolean")


def entry_name(name: str) -> str | None:
    """The name of an entry with / between folders; None if it is absolute, leads out of its folder or is empty."""
    name = name.replace("\\", "/")
    return None if not name or name.startswith("/") or "\0" in name or ".." in name.split("/") else name


def archive_entries(spark: SparkSession, path: str, kinds: list[str] | None = None, entries: int = ENTRIES, entry_bytes: int = ENTRY_BYTES, total_bytes: int = TOTAL_BYTES, open_file: Opener = open_at) -> DataFrame:
    """(file, entry, name, size, refused) of zip archives, folders left out; only their directories are read.

    ``refused`` says why an entry isn't to be extracted, else null: ``path`` (unsafe name) and ``kind`` (not one of ``kinds``) are single
    entries; an archive with more other entries than ``entries``, one of over ``entry_bytes`` or more than ``total_bytes`` of them in all is
    refused whole, as ``entries``, ``entry size`` or ``total size``. A file that is no archive is one row without entry, ``unreadable``; an empty
    file, like an archive without entries, has no row. Names that repeat
    are rows of their own. The three caps are the feature: they bound what one archive can do.
    """
    from quern.sources.files import kind_of

    def listed(file: str) -> list[tuple]:
        try:
            with open_file(file) as held, zipfile.ZipFile(held) as z:
                found = [(entry_name(i.filename), i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
        except (zipfile.BadZipFile, EOFError, NotImplementedError):
            return [(file, None, None, None, "unreadable")]
        single = ["path" if e is None else "kind" if kinds is not None and kind_of(e) not in kinds else None for e, _, _ in found]
        sizes = [n for (_, _, n), why in zip(found, single, strict=True) if why is None]
        whole = "entries" if len(sizes) > entries else "entry size" if max(sizes, default=0) > entry_bytes else "total size" if sum(sizes) > total_bytes else None
        return [(file, e, name, n, why or whole) for (e, name, n), why in zip(found, single, strict=True)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for file in part["path"]:
                yield pd.DataFrame(listed(file), columns=["file", "entry", "name", "size", "refused"]).astype({"size": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "file string, entry string, name string, size long, refused string")


def extract(listed: DataFrame, open_file: Opener = open_at, entry_bytes: int = ENTRY_BYTES) -> DataFrame:
    """(file, entry, content, refused) of the entries that ``archive_entries`` lists; refused ones keep their reason and have no content.

    Entries are dealt over tasks, whatever archive they are from, and each is decompressed by itself; one of at most ``entry_bytes`` is in memory
    at a time. One that holds more or other bytes than its directory says is refused as ``broken``, one that is locked or packed by an unknown
    method as ``method``. A name that repeats in an archive gives the last entry of that name, once for each row.
    """
    schema = pa.schema([("file", pa.string()), ("entry", pa.string()), ("content", pa.binary()), ("refused", pa.string())])

    def content(file: str, name: str) -> tuple[bytes | None, str | None]:
        try:
            with open_file(file) as held, zipfile.ZipFile(held) as z, z.open(name) as entry:
                parts, size = [], 0
                while some := entry.read(STEP):
                    parts.append(some)
                    size += len(some)
                    if size > entry_bytes:
                        return None, "entry size"
                if size != z.getinfo(name).file_size:
                    return None, "broken"
                return b"".join(parts), None
        except (zipfile.BadZipFile, zlib.error, EOFError):
            return None, "broken"
        except (NotImplementedError, RuntimeError):
            return None, "method"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, why = (None, row["refused"]) if row["refused"] else content(row["file"], row["name"])
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "entry": row["entry"], "content": held, "refused": why}], schema=schema)

    dealt = listed.select("file", "entry", "name", "refused").repartition("file", F.xxhash64("name"))
    return dealt.mapInArrow(run, "file string, entry string, content binary, refused string")
