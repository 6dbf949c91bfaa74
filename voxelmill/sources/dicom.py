"""DICOM files as rows: a small little-endian reader and writer over ``binaryFile``.

Explicit and implicit value representation are read; compressed pixel data, and files
deflated or big-endian, give rows whose ``status`` is ``unsupported_format``. A file that
ends inside an element is ``truncated``; what comes before is kept.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tags by keyword as the standard numbers them, with value representation.
TAGS = {
    "SOPClassUID": (0x0008, 0x0016, "UI"), "SOPInstanceUID": (0x0008, 0x0018, "UI"), "ImageType": (0x0008, 0x0008, "CS"), "StudyDate": (0x0008, 0x0020, "DA"), "SeriesTime": (0x0008, 0x0031, "TM"),
    "AccessionNumber": (0x0008, 0x0050, "SH"), "Modality": (0x0008, 0x0060, "CS"), "Manufacturer": (0x0008, 0x0070, "LO"), "SeriesDescription": (0x0008, 0x103E, "LO"), "ManufacturerModelName": (0x0008, 0x1090, "LO"),
    "PatientName": (0x0010, 0x0010, "PN"), "PatientID": (0x0010, 0x0020, "LO"), "BodyPartExamined": (0x0018, 0x0015, "CS"), "ScanningSequence": (0x0018, 0x0020, "CS"), "SequenceVariant": (0x0018, 0x0021, "CS"),
    "ScanOptions": (0x0018, 0x0022, "CS"), "MRAcquisitionType": (0x0018, 0x0023, "CS"), "SliceThickness": (0x0018, 0x0050, "DS"), "RepetitionTime": (0x0018, 0x0080, "DS"), "EchoTime": (0x0018, 0x0081, "DS"),
    "InversionTime": (0x0018, 0x0082, "DS"), "MagneticFieldStrength": (0x0018, 0x0087, "DS"), "SpacingBetweenSlices": (0x0018, 0x0088, "DS"), "EchoTrainLength": (0x0018, 0x0091, "IS"), "ProtocolName": (0x0018, 0x1030, "LO"),
    "FlipAngle": (0x0018, 0x1314, "DS"), "StudyInstanceUID": (0x0020, 0x000D, "UI"), "SeriesInstanceUID": (0x0020, 0x000E, "UI"), "SeriesNumber": (0x0020, 0x0011, "IS"), "InstanceNumber": (0x0020, 0x0013, "IS"),
    "ImagePositionPatient": (0x0020, 0x0032, "DS"), "ImageOrientationPatient": (0x0020, 0x0037, "DS"), "SliceLocation": (0x0020, 0x1041, "DS"), "SamplesPerPixel": (0x0028, 0x0002, "US"), "PhotometricInterpretation": (0x0028, 0x0004, "CS"),
    "Rows": (0x0028, 0x0010, "US"), "Columns": (0x0028, 0x0011, "US"), "PixelSpacing": (0x0028, 0x0030, "DS"), "BitsAllocated": (0x0028, 0x0100, "US"), "BitsStored": (0x0028, 0x0101, "US"),
    "PixelRepresentation": (0x0028, 0x0103, "US"), "WindowCenter": (0x0028, 0x1050, "DS"), "WindowWidth": (0x0028, 0x1051, "DS"), "RescaleIntercept": (0x0028, 0x1052, "DS"), "RescaleSlope": (0x0028, 0x1053, "DS"),
}
_BY_TAG = {(g, e): (name, vr) for name, (g, e, vr) in TAGS.items()}
_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UN", b"UR", b"UT"}
_PIXELS = (0x7FE0, 0x0010)
_ITEM, _ITEM_END, _SEQUENCE_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
_OPEN = 0xFFFFFFFF
_IMPLICIT, _EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"
_OTHER_BYTES = ("1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.2")


def is_dicom(content: str = "content"):
    """Whether a file's bytes carry the mark at offset 128."""
    return F.substring(content, 129, 4) == F.lit(b"DICM")


def _head(data: bytes, at: int, explicit: bool) -> tuple[bytes, int, int]:
    """Representation, length of the head and size of the element at ``at``; a head cut off has no end."""
    if not explicit:
        return b"", 8, struct.unpack_from("<I", data, at + 4)[0]
    vr = data[at + 4 : at + 6]
    if vr not in _LONG:
        return vr, 8, struct.unpack_from("<H", data, at + 6)[0]
    return (vr, 12, struct.unpack_from("<I", data, at + 8)[0]) if at + 12 <= len(data) else (vr, 12, 0)


def _after_open(data: bytes, at: int, explicit: bool) -> int | None:
    """Where the sequence of open length whose items begin at ``at`` ends; nothing if the file ends before or items are out of place."""
    inside = [("sequence", explicit)]
    while at + 8 <= len(data):
        kind, explicit = inside[-1]
        tag, size = struct.unpack_from("<HH", data, at), struct.unpack_from("<I", data, at + 4)[0]
        if tag == (_SEQUENCE_END if kind == "sequence" else _ITEM_END):
            inside.pop()
            at += 8
            if not inside:
                return at
        elif kind == "sequence":
            if tag != _ITEM:
                return None
            if size == _OPEN:
                inside.append(("item", explicit))
            at += 8 if size == _OPEN else 8 + size
        else:
            vr, head, size = _head(data, at, explicit)
            if size == _OPEN:
                # the items of an unknown representation are implicit
                inside.append(("sequence", explicit and vr != b"UN"))
            at += head if size == _OPEN else head + size
    return None


def _elements(data: bytes, at: int, explicit: bool) -> Iterator[tuple[tuple[int, int] | None, bytes, int, int]]:
    """(tag, representation, begin, end) of each element; sequences are stepped over.

    The end of open pixel data is -1. A last entry without a tag tells that the file
    ends inside an element.
    """
    while at + 8 <= len(data):
        tag = struct.unpack_from("<HH", data, at)
        vr, head, size = _head(data, at, explicit)
        begin = at + head
        if size == _OPEN:
            if tag == _PIXELS:
                yield tag, vr, begin, -1
            after = _after_open(data, begin, explicit and vr != b"UN")
            if after is None:
                yield None, b"", begin, len(data)
                return
            at = after
            continue
        yield tag, vr, begin, min(begin + size, len(data))
        at = begin + size
    if at != len(data):
        yield None, b"", len(data), len(data)


def parse(data: bytes, wanted: list[str] | None = None, pixels: bool = False, header: bool = False) -> dict:
    """Tags as text by keyword, and the pixel values if asked for; ``status`` tells what went wrong.

    With ``header`` the walk ends where the pixels begin, so that the head of a file is
    enough; ``at_pixels`` tells whether it got there.
    """
    if data[128:132] == b"DICM":
        at, syntax = 132, _EXPLICIT
        for tag, _, begin, end in _elements(data, 132, True):
            if tag is None or tag[0] != 2:
                break
            at = end
            if tag == (2, 0x10):
                syntax = data[begin:end].rstrip(b"\0 ").decode("ascii", "replace")
    elif len(data) >= 8 and struct.unpack_from("<H", data)[0] in (2, 8):
        at, syntax = 0, _IMPLICIT
    else:
        return {"tags": {}, "data": None, "status": "not_dicom"}
    if syntax in _OTHER_BYTES:
        return {"tags": {}, "data": None, "status": "unsupported_format"}
    tags, values, status, at_pixels = {}, None, "ok", False
    for tag, _, begin, end in _elements(data, at, syntax != _IMPLICIT):
        if tag is None:
            status = "truncated" if status == "ok" else status
            break
        if tag == _PIXELS:
            if header:
                at_pixels = True
                break
            if pixels:
                size = {"8": 1, "16": 2, "32": 4}.get(tags.get("BitsAllocated", "16"))
                if end < 0 or size is None or syntax not in (_IMPLICIT, _EXPLICIT):
                    status = "unsupported_format"
                else:
                    kind = f"<{'i' if tags.get('PixelRepresentation') == '1' else 'u'}{size}"
                    import numpy as np

                    values = np.frombuffer(data[begin : begin + (end - begin) // size * size], dtype=kind).astype("float64")
            continue
        known = _BY_TAG.get(tag)
        if known and end >= begin:
            name, vr = known
            raw = data[begin:end]
            text = str(struct.unpack_from("<H", raw)[0]) if vr == "US" and len(raw) >= 2 else raw.rstrip(b"\0 ").decode("utf-8", "replace")
            tags[name] = text
    if wanted is not None:
        keep = {"Rows", "Columns", *wanted}
        tags = {k: v for k, v in tags.items() if k in keep}
    return {"tags": tags, "data": values, "status": status, "at_pixels": at_pixels}


def build(tags: dict[str, str], values=None) -> bytes:
    """A file in explicit little-endian form with 16-bit pixels."""

    def element(group: int, number: int, vr: str, raw: bytes) -> bytes:
        raw += (b"\0" if vr in ("UI", "OW") else b" ") * (len(raw) % 2)
        head = struct.pack("<HH2s", group, number, vr.encode())
        return head + (b"\0\0" + struct.pack("<I", len(raw)) if vr.encode() in _LONG else struct.pack("<H", len(raw))) + raw

    meta = element(2, 0x10, "UI", _EXPLICIT.encode())
    out = b"\0" * 128 + b"DICM" + element(2, 0, "UL", struct.pack("<I", len(meta))) + meta
    for name, (group, number, vr) in sorted(TAGS.items(), key=lambda t: t[1][:2]):
        if name in tags:
            out += element(group, number, vr, struct.pack("<H", int(tags[name])) if vr == "US" else str(tags[name]).encode())
    return out if values is None else out + element(*_PIXELS, "OW", values.astype("<u2").tobytes())


_SCHEMA = "path string, length long, tags map<string,string>, n_rows int, n_cols int, data array<double>, status string"


def read(spark: SparkSession, path: str, tags: list[str] | None = None, pixels: bool = False, glob: str = "*.dcm") -> DataFrame:
    """A row for each file below ``path``; only the tags asked for are kept, pixels only on demand."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for path_, length, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                found = parse(bytes(content), tags, pixels)
                size = [int(found["tags"].get(k, 0) or 0) for k in ("Rows", "Columns")]
                made.append((path_, length, found["tags"], *size, found["data"], found["status"]))
            yield pd.DataFrame(made, columns=["path", "length", "tags", "n_rows", "n_cols", "data", "status"])

    return files.mapInPandas(rows, _SCHEMA)
