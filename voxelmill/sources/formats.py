"""Medical files as Spark data sources: ``dicom``, ``nifti`` and ``npz``, to read and to write.

    formats.register(spark)
    spark.read.format("dicom").option("tags", "Modality,PatientID").load(folder)
    slices.write.format("dicom").mode("append").save(folder)

Files are reached through Arrow's file systems, so a folder may lie in any store that
they know (``file:``, ``hdfs:``, ``s3:``, ``gs:``). Reading plans tasks by the bytes they
will read; a DICOM file without its pixels costs its head only. What can't be read is a
row with a ``status``. Writing goes to a folder of the job below the target; files are
moved to their places when all tasks are done, and a job that fails leaves none.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from voxelmill.sources import dicom, volumes

#: Bytes that a task reads, unless option ``taskBytes`` says otherwise.
TASK_BYTES = 128 << 20
#: The head of a file that is read first where pixels aren't asked for; it is doubled until the pixels are in sight.
HEAD_BYTES = 64 << 10
#: Bytes of content in one batch of rows; a larger file is a batch of its own.
BATCH_BYTES = 8 << 20


@dataclass
class Files(InputPartition):
    """Paths and sizes that one task reads."""

    files: list[tuple[str, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


def _is_true(value: str | None) -> bool:
    return (value or "").lower() == "true"


def plan(found: list[tuple[str, int]], most: int, cost: Callable[[int], int]) -> list[list[tuple[str, int]]]:
    """Files in order, in groups of at most so many bytes to read; a larger file is alone."""
    groups: list[list[tuple[str, int]]] = []
    size = 0
    for path, length in found:
        if not groups or size + cost(length) > most:
            groups.append([])
            size = 0
        groups[-1].append((path, length))
        size += cost(length)
    return groups


class FileReader(DataSourceReader):
    """Lists the files below a folder and turns each into a row by the source's ``row``."""

    def __init__(self, source: FileSource) -> None:
        self.source = source

    def partitions(self) -> list[InputPartition]:
        store, folder = self.source.place()
        names = self.source.options.get("glob", self.source.glob).split(",")
        info = store.get_file_info(fs.FileSelector(folder, recursive=True))
        hidden = lambda path: any(part[:1] in "_." for part in path[len(folder) :].split("/") if part)
        found = sorted((i.path, i.size) for i in info if i.type == fs.FileType.File and not hidden(i.path) and any(fnmatch.fnmatch(i.base_name.lower(), n) for n in names))
        most = int(self.source.options.get("taskBytes", TASK_BYTES))
        return [Files(group) for group in plan(found, most, self.source.cost)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self.source.place()
        schema, rows, size = self.source.arrow_schema(), [], 0
        for path, length in partition.files:
            rows.append(self.source.row(store, path, length))
            size += self.source.cost(length)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task left in the job's folder."""

    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    """Writes a file for each row; nothing is in its place before the whole job is done."""

    def __init__(self, source: FileSource, overwrite: bool) -> None:
        self.source, self.overwrite, self.job = source, overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, folder = self.source.place()
        # each attempt has a folder of its own, so that a second one never meets files of the first
        own, names = f"{folder}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        try:
            for row in iterator:
                content = self.source.build(row)
                if "/" in row["name"] or row["name"][:1] in ("", ".", "_"):
                    raise ValueError(f"{row['name']!r} can't be the name of a file")
                with store.open_output_stream(f"{own}/{row['name']}", compression=None) as file:
                    file.write(content)
                names.append(row["name"])
        except BaseException:
            store.delete_dir(own)
            raise
        return Written(own, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = self.source.place()
        told = [m for m in messages if m is not None]
        names = [n for m in told for n in m.names]
        try:
            if len(set(names)) < len(names):
                raise ValueError("two rows have the same file name")
            if self.overwrite:
                for info in store.get_file_info(fs.FileSelector(folder)):
                    if info.type == fs.FileType.File:
                        store.delete_file(info.path)
            for message in told:
                for name in message.names:
                    store.move(f"{message.folder}/{name}", f"{folder}/{name}")
        finally:
            store.delete_dir(f"{folder}/{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = self.source.place()
        # with it goes what a killed executor left behind
        if store.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{folder}/{self.job}")


class FileSource(DataSource):
    """What the three formats have in common."""

    glob = "*"

    def place(self) -> tuple[fs.FileSystem, str]:
        """The store and the folder in it that option ``path`` names."""
        path = self.options["path"]
        # Spark writes local places with one slash
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)

    def cost(self, length: int) -> int:
        """Bytes that reading a file of this length takes."""
        return length

    def row(self, store: fs.FileSystem, path: str, length: int) -> dict:
        raise NotImplementedError

    def build(self, row) -> bytes:
        raise NotImplementedError

    def arrow_schema(self) -> pa.Schema:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self, overwrite)


class DicomSource(FileSource):
    """A row for each DICOM file: ``path, length, tags, n_rows, n_cols, status`` and, with option ``pixels``, ``data``.

    Option ``tags`` lists the keywords to keep. Rows to write have ``name, tags, data``.
    """

    glob = "*.dcm"

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def _pixels(self) -> bool:
        return _is_true(self.options.get("pixels"))

    def schema(self) -> str:
        return "path string, length long, tags map<string,string>, n_rows int, n_cols int, status string" + (", data array<double>" if self._pixels() else "")

    def arrow_schema(self) -> pa.Schema:
        kinds = [("path", pa.string()), ("length", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("status", pa.string())]
        return pa.schema(kinds + [("data", pa.list_(pa.float64()))] * self._pixels())

    def cost(self, length: int) -> int:
        return length if self._pixels() else min(length, HEAD_BYTES)

    def row(self, store: fs.FileSystem, path: str, length: int) -> dict:
        wanted = self.options.get("tags")
        names = wanted.split(",") if wanted is not None else None
        try:
            with store.open_input_file(path) as file:
                if self._pixels():
                    found = dicom.parse(file.read(), names, pixels=True)
                else:
                    head = HEAD_BYTES
                    found = dicom.parse(file.read_at(min(head, length), 0), names, header=True)
                    while not found.get("at_pixels") and head < length:
                        head *= 2
                        found = dicom.parse(file.read_at(min(head, length), 0), names, header=True)
        except (OSError, struct.error, IndexError, ValueError):
            found = {"tags": {}, "data": None, "status": "read_error"}
        sizes = [found["tags"].get(k, "").strip() for k in ("Rows", "Columns")]
        rows, columns = (int(n) if n.isdigit() else 0 for n in sizes)
        told = {"path": path, "length": length, "tags": list(found["tags"].items()), "n_rows": rows, "n_cols": columns, "status": found["status"]}
        return told | ({"data": found["data"]} if self._pixels() else {})

    def build(self, row) -> bytes:
        return dicom.build(dict(row["tags"]), None if row["data"] is None else np.asarray(row["data"]))


class VolumeSource(FileSource):
    """Rows ``path, shape, affine, data, status`` of volume files, values with the format's own axis fastest. Rows to write have ``name, shape, affine, data``."""

    def schema(self) -> str:
        return "path string, shape array<int>, affine array<double>, data array<float>, status string"

    def arrow_schema(self) -> pa.Schema:
        return pa.schema([("path", pa.string()), ("shape", pa.list_(pa.int32())), ("affine", pa.list_(pa.float64())), ("data", pa.list_(pa.float32())), ("status", pa.string())])

    def parse(self, content: bytes) -> dict:
        raise NotImplementedError

    def row(self, store: fs.FileSystem, path: str, length: int) -> dict:
        try:
            with store.open_input_file(path) as file:
                found = self.parse(file.read())
        except (ValueError, OSError, EOFError, struct.error, zipfile.BadZipFile):
            found = {"status": "read_error"}
        return {"path": path} | {k: found.get(k) for k in ("shape", "affine", "data", "status")}


class NiftiSource(VolumeSource):
    """Volumes in packed or plain NIfTI-1 files; 4-D ones have all their volumes in ``data``."""

    glob = "*.nii,*.nii.gz"

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def parse(self, content: bytes) -> dict:
        return volumes.parse_nifti(content)

    def build(self, row) -> bytes:
        values = np.asarray(row["data"], dtype="float32").reshape(row["shape"], order="F")
        return volumes.build_nifti(values, np.asarray(row["affine"], dtype="float64").reshape(4, 4))


class NpzSource(VolumeSource):
    """Arrays in NPZ files: the one called ``data``, else the first."""

    glob = "*.npz"

    @classmethod
    def name(cls) -> str:
        return "npz"

    def parse(self, content: bytes) -> dict:
        return volumes.parse_npz(content)

    def build(self, row) -> bytes:
        return volumes.build_npz(np.asarray(row["data"], dtype="float32").reshape(row["shape"]))


def register(spark: SparkSession) -> None:
    """Make the three formats known to a session."""
    for source in (DicomSource, NiftiSource, NpzSource):
        spark.dataSource.register(source)
