"""The folder that driver and executors share, and files in it that workers write, rename and memory-map."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_OWN: dict[str, str] = {}


def shared_dir(spark) -> str:
    """The URI of a new folder under spark.checkpoint.dir; where that is unset, under a temporary one, if all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        base = _OWN.setdefault("dir", "") or tempfile.mkdtemp(prefix="kinfold-")
        _OWN["dir"] = base
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/kinfold-{uuid.uuid4().hex}"


def ensure_checkpoint(spark) -> None:
    """checkpoint() needs a folder; the session's own setting comes first."""
    if not spark.sparkContext.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark).rsplit("/", 1)[0]
        spark.sparkContext.setCheckpointDir(base)


def local_path(uri: str) -> str | None:
    """The path of a file: URI, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _fs(uri: str):
    from pyarrow import fs

    local = local_path(uri)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = _fs(uri)
    fs.create_dir(path, recursive=True)


def delete_dir(uri: str) -> None:
    from pyarrow import fs as afs

    fs, path = _fs(uri)
    if fs.get_file_info(path).type == afs.FileType.Directory:
        fs.delete_dir(path)


def exists(uri: str) -> bool:
    from pyarrow import fs as afs

    fs, path = _fs(uri)
    return fs.get_file_info(path).type == afs.FileType.File


#: Rows of a file, where it is known how many there are.
FILE_ROWS = 200_000


class Tables:
    """Tables that a job writes to a folder of its own and reads again, so that later steps neither repeat it nor depend on executors."""

    def __init__(self, spark):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        self.made: dict[str, DataFrame] = {}

    def folder(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}"

    def save(self, df, rows: int | None = None):
        """df as written. rows: about how many it has, so that few rows make few files; the last step then has as many tasks."""
        where = self.folder()
        if rows is not None:
            df = df.coalesce(rows // FILE_ROWS + 1)
        df.write.parquet(where)
        self.made[where] = out = self.spark.read.schema(df.schema).parquet(where)
        return out

    def keep(self, *frames) -> None:
        """Deletes what has been written but for these tables, which a result still reads."""
        kept = {where for where, df in self.made.items() if any(df is x for x in frames)}
        for k in range(1, self.n + 1):
            if (where := f"{self.root}/{k:04d}") not in kept:
                delete_dir(where)
                self.made.pop(where, None)

    def delete(self) -> None:
        """Deletes everything; what reads these tables can't be run any more."""
        delete_dir(self.root)


class Pending:
    """A file written under a temporary name; commit() renames it, so a retried task leaves no half file."""

    def __init__(self, folder: str, name: str):
        self.uri, self.temp = f"{folder}/{name}", f"{folder}/_tmp-{uuid.uuid4().hex}-{name}"
        self.fs, self.path = _fs(self.temp)
        self.out = self.fs.open_output_stream(self.path, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def commit(self) -> str:
        self.out.close()
        fs, final = _fs(self.uri)
        fs.move(self.path, final)  # over that of an earlier attempt, which is the same
        return self.uri


@cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives what allocators keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and release() at its end: Spark's workers stay for later tasks, and what they hold idle is missing there."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def write_file(folder: str, name: str, data: bytes) -> str:
    f = Pending(folder, name)
    f.write(data)
    return f.commit()


def read_file(uri: str) -> bytes:
    fs, path = _fs(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def map_array(uri: str, dtype) -> np.ndarray:
    """A file of numbers, memory-mapped; from a store without local paths it is first copied to the worker's scratch folder."""
    path = local_path(uri)
    if path is None:
        path = os.path.join(tempfile.gettempdir(), uri.replace("/", "_").replace(":", "_"))
        if not os.path.exists(path):
            with open(part := f"{path}.{os.getpid()}", "wb") as f:
                f.write(read_file(uri))
            os.replace(part, path)
    if not os.path.getsize(path):
        return np.empty(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")
