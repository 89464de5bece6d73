"""The container of a coded image: a magic line, a shift line in 4-D, a header, one stream."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

# The first lines of the two kinds of file.
MAGIC = {"2D": b"LFIF-2D\n", "4D": b"LFIF-4D\n"}


@dataclass(frozen=True)
class Header:
    kind: str
    size: tuple[int, ...]
    block: tuple[int, ...]
    depth_bits: int
    discarded_bits: int
    predicted: bool
    shift: tuple[int, int] | None = None


def packed(h: Header, payload: bytes) -> bytes:
    line = b"%d %d\n" % h.shift if h.kind == "4D" else b""
    fixed = struct.pack(">BB?", h.depth_bits, h.discarded_bits, h.predicted)
    return MAGIC[h.kind] + line + fixed + struct.pack(f">{2 * len(h.size)}Q", *h.size, *h.block) + payload


def parsed(data: bytes) -> tuple[Header, bytes]:
    """Raises ValueError if the magic is not known."""
    kind = next((k for k, m in MAGIC.items() if data.startswith(m)), None)
    if kind is None:
        raise ValueError("not a coded image")
    at, shift, dims = len(MAGIC[kind]), None, int(kind[0])
    if kind == "4D":
        end = data.index(b"\n", at)
        shift, at = tuple(map(int, data[at:end].split())), end + 1
    depth, discarded, predicted = struct.unpack_from(">BB?", data, at)
    numbers = struct.unpack_from(f">{2 * dims}Q", data, at + 3)
    return Header(kind, numbers[:dims], numbers[dims:], depth, discarded, predicted, shift), data[at + 3 + 16 * dims :]


def placed(folder: str, path: str, data: bytes) -> str:
    """Write a file under the last part of ``path``. It appears whole or not at all."""
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, path.rpartition("/")[2])
    temporary = f"{name}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(data)
    os.replace(temporary, name)
    return name


def write(files: DataFrame, folder: str) -> None:
    """One file for each row (path, data), in a folder of a file system that all executors share."""

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": [placed(folder, p, bytes(d)) for p, d in zip(part["path"], part["data"], strict=True)]})

    files.select("path", "data").mapInPandas(put, "path string").count()
