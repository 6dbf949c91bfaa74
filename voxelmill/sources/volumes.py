"""Volumes in NIfTI-1, NPZ and ZIP files as rows."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Numbers of the data types that the format defines.
_KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def parse_nifti(content: bytes) -> dict:
    """Shape, affine and values (first axis fastest, scaled) of a NIfTI-1 file, packed or not."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if len(data) < 348:
        return {"status": "unsupported_format"}
    order = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(order + "i", data)[0] != 348:
        return {"status": "unsupported_format"}
    dim = struct.unpack_from(order + "8h", data, 40)
    kind = _KINDS.get(struct.unpack_from(order + "h", data, 70)[0])
    if kind is None:
        return {"status": "unsupported_format"}
    start, slope, intercept = struct.unpack_from(order + "3f", data, 108)
    spacing = struct.unpack_from(order + "8f", data, 76)
    shape = [max(1, d) for d in dim[1 : 1 + dim[0]]]
    values = np.frombuffer(data, dtype=order + kind, count=int(np.prod(shape)), offset=int(start)).astype("float32")
    if slope and (slope, intercept) != (1.0, 0.0):
        values = values * np.float32(slope) + np.float32(intercept)
    rows = struct.unpack_from(order + "12f", data, 280)
    affine = list(rows) if struct.unpack_from(order + "h", data, 254)[0] > 0 else [spacing[1], 0, 0, 0, 0, spacing[2], 0, 0, 0, 0, spacing[3], 0]
    return {"shape": shape, "affine": [float(v) for v in affine] + [0.0, 0.0, 0.0, 1.0], "data": values, "status": "ok"}


def build_nifti(values: np.ndarray, affine: np.ndarray) -> bytes:
    """A packed single-file NIfTI-1 volume of floats."""
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, values.ndim, *values.shape, *[1] * (7 - values.ndim))
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)), *[1.0] * 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    return gzip.compress(bytes(head) + values.astype("<f4").tobytes(order="F"), mtime=0)


def parse_npz(content: bytes) -> dict:
    """The array called ``data``, else the first one."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as found:
            if not found.files:
                return {"status": "no_pixel_data"}
            values = found["data" if "data" in found.files else found.files[0]]
    except (ValueError, OSError, zipfile.BadZipFile):
        return {"status": "read_error"}
    return {"shape": list(values.shape), "affine": None, "data": values.astype("float32").ravel(), "status": "ok"}


def build_npz(values: np.ndarray) -> bytes:
    """A packed NPZ file with one array of floats called ``data``."""
    out = io.BytesIO()
    np.savez_compressed(out, data=values.astype("float32"))
    return out.getvalue()


def canonical(values: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes in the order and direction of right, anterior, superior, and the matrix that goes with it."""
    linear = affine[:3, :3]
    left, order = [0, 1, 2], [0, 0, 0]
    for world in np.argsort(-np.abs(linear).max(axis=1), kind="stable"):
        axis = max(left, key=lambda a: abs(linear[world, a]))
        order[world] = axis
        left.remove(axis)
    out, matrix = values.transpose(order), affine[:, [*order, 3]].copy()
    for k in range(3):
        if matrix[k, k] < 0:
            out = np.flip(out, k)
            matrix[:3, 3] += matrix[:3, k] * (values.shape[order[k]] - 1)
            matrix[:3, k] *= -1
    return out, matrix


_SCHEMA = "path string, shape array<int>, affine array<double>, data array<float>, status string"


def read_volumes(spark: SparkSession, path: str, glob: str = "*.{nii,nii.gz,npz}") -> DataFrame:
    """A row for each volume below ``path``; files that can't be read have no data and a ``status``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = (parse_npz if path_.lower().endswith(".npz") else parse_nifti)(bytes(content))
                except (ValueError, OSError, EOFError, struct.error):
                    found = {"status": "read_error"}
                made.append((path_, *[found.get(k) for k in ("shape", "affine", "data", "status")]))
            yield pd.DataFrame(made, columns=["path", "shape", "affine", "data", "status"])

    return files.mapInPandas(rows, _SCHEMA)


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """``archive, name, content`` of every file in every ZIP below ``path``; a broken archive gives one row without content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{zip,ZIP}").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as opened:
                        for item in opened.infolist():
                            if not item.is_dir():
                                yield pd.DataFrame({"archive": [archive], "name": [item.filename], "content": [opened.read(item)]})
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"archive": [archive], "name": [None], "content": [None]})

    return files.mapInPandas(rows, "archive string, name string, content binary")
