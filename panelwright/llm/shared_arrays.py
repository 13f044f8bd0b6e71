"""Arrays that tasks write to the shared folder and other tasks map into memory, and compact blobs for shuffles."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as Spark writes it, and the folder's path in it."""
    if folder.startswith("file:") or "://" not in folder:
        folder = "file://" + os.path.abspath("/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder)
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Write one array; a repeated attempt replaces it by the same contents."""
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(head.getvalue())
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    fs.move(part, f"{base}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    """Map an array into memory; from a remote store by a copy that is unlinked at once."""
    fs, base = _open(folder)
    path = f"{base}/{name}.npy"
    if isinstance(fs, pafs.LocalFileSystem):
        return _mapped(path)
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy, fs.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return _mapped(copy.name)


def _mapped(path: str) -> np.ndarray:
    try:
        return np.load(path, mmap_mode="r")
    except ValueError:  # an empty array cannot be mapped
        return np.load(path)


_CODEC = pa.Codec("zstd", compression_level=1)


def squeeze(values: np.ndarray) -> bytes:
    """An array as bytes: equal bytes of the numbers side by side, compressed."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T) if len(values) else values
    raw = planes.tobytes()
    return np.array([len(raw)], "<i8").tobytes() + values.dtype.str.encode().ljust(4) + (
        _CODEC.compress(raw, asbytes=True) if raw else b""
    )


def expand(blob: bytes) -> np.ndarray:
    size, kind = int(np.frombuffer(blob[:8], "<i8")[0]), np.dtype(blob[8:12].decode().strip())
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(_CODEC.decompress(blob[12:], size, asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def squeeze_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, kept as differences."""
    return squeeze(np.diff(values, prepend=values.dtype.type(0)))


def expand_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(values := expand(blob), dtype=values.dtype)


def per_group(df: DataFrame, keys: list[str], function: Callable, schema: str) -> DataFrame:
    """``function(key, batches)``, which yields record batches, for each group of ``df``."""

    def whole(key, table):
        return pa.Table.from_batches(list(function(key, table.to_batches())))

    return df.groupBy(*keys).applyInArrow(whole, schema)
