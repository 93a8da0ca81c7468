"""DICOM files (explicit VR, little endian): a data source of their metadata and images, and tags and images of files already loaded."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from fnmatch import fnmatch
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Value representations with a 32-bit length.
LONG = {"OB", "OD", "OF", "OL", "OW", "SQ", "UN", "UC", "UR", "UT"}
ROWS, COLUMNS, BITS, PIXELS = (0x0028, 0x0010), (0x0028, 0x0011), (0x0028, 0x0100), (0x7FE0, 0x0010)


#: Metadata columns, their tags in the standard and how the value is read.
FIELDS = {
    "patient_name": (0x0010, 0x0010, "text"), "patient_id": (0x0010, 0x0020, "text"), "patient_birth_date": (0x0010, 0x0030, "text"), "patient_sex": (0x0010, 0x0040, "text"),
    "study_instance_uid": (0x0020, 0x000D, "text"), "series_instance_uid": (0x0020, 0x000E, "text"), "sop_instance_uid": (0x0008, 0x0018, "text"), "study_date": (0x0008, 0x0020, "text"),
    "series_date": (0x0008, 0x0021, "text"), "modality": (0x0008, 0x0060, "text"), "body_part_examined": (0x0018, 0x0015, "text"), "manufacturer": (0x0008, 0x0070, "text"), "institution_name": (0x0008, 0x0080, "text"),
    "rows": (*ROWS, "u16"), "columns": (*COLUMNS, "u16"), "bits_allocated": (*BITS, "u16"), "bits_stored": (0x0028, 0x0101, "u16"), "high_bit": (0x0028, 0x0102, "u16"), "pixel_representation": (0x0028, 0x0103, "u16"),
    "samples_per_pixel": (0x0028, 0x0002, "u16"), "photometric_interpretation": (0x0028, 0x0004, "text"), "planar_configuration": (0x0028, 0x0006, "u16"), "window_center": (0x0028, 0x1050, "number"), "window_width": (0x0028, 0x1051, "number"),
    "rescale_intercept": (0x0028, 0x1052, "number"), "rescale_slope": (0x0028, 0x1053, "number"), "pixel_spacing": (0x0028, 0x0030, 2), "slice_thickness": (0x0018, 0x0050, "number"), "slice_location": (0x0020, 0x1041, "number"),
    "image_position": (0x0020, 0x0032, 3), "image_orientation": (0x0020, 0x0037, 6),
}
_ARROW = {"text": pa.string(), "u16": pa.int32(), "number": pa.float64()}
#: Columns made from the pixels; no other column makes a reader touch them.
_FRAMES = {"pixels": pa.binary(), "gray": pa.binary(), "windowed": pa.binary(), "rescaled": pa.list_(pa.float64())}
_SQL = {pa.string(): "string", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary", pa.list_(pa.float64()): "array<double>"}


def _type(name: str) -> pa.DataType:
    if name in ("path", "error"):
        return pa.string()
    return _FRAMES[name] if name in _FRAMES else _ARROW.get(FIELDS[name][2], pa.list_(pa.float64()))


def _ddl(names) -> str:
    return ", ".join(f"{n} {_SQL[_type(n)]}" for n in names)


#: A batch of output rows is closed at so many files or bytes of pixels.
ROWS_A_BATCH, BYTES_A_BATCH = 1024, 16 << 20
#: The default columns of a file: all metadata, no pixels.
METADATA = ["path", "error", *FIELDS]


#: Names of the fields by their tags.
_NAMES = {FIELDS[n][:2]: n for n in FIELDS}
_HEAD = struct.Struct("<HH2sH")


@lru_cache(1024)
def _vr(two: bytes) -> str:
    """A value representation as text, empty where it is none."""
    vr = two.decode("latin-1")
    return vr if vr.isalpha() and vr.isupper() else ""


def scan(stream: BinaryIO, size: int, skip: frozenset[tuple[int, int]] = frozenset()) -> Iterator[tuple[int, int, str, bytes]]:
    """(group, element, vr, value) in file order; values of the tags in `skip` are passed over unread, and empty. Reading stops at a tag that does not fit. ValueError without the DICM mark."""
    if stream.read(132)[128:] != b"DICM":
        raise ValueError("not a DICOM file")
    at = 132
    while at + 8 <= size:
        group, element, two, length = _HEAD.unpack(stream.read(8))
        vr = _vr(two)
        if not vr:
            return
        at += 8
        if vr in LONG:
            if at + 4 > size:
                return
            length, at = int.from_bytes(stream.read(4), "little"), at + 4
        if at + length > size:
            return
        if (group, element) in skip:
            stream.seek(at + length)
            yield group, element, vr, b""
        else:
            yield group, element, vr, stream.read(length)
        at += length


def tags(data: bytes) -> list[tuple[int, int, str, bytes]]:
    """All tags of a file's bytes; see scan()."""
    return list(scan(io.BytesIO(data), len(data)))


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace").rstrip("\0")


def _unsigned(value: bytes, size: int) -> int | None:
    return int.from_bytes(value[:size], "little") if len(value) >= size else None


def _numbers(value: bytes, least: int) -> list[float] | None:
    """The first numbers of a list split by backslashes: `least` of them, or null. An orientation may give three, the rest are 0."""
    parts = _text(value).strip().split("\\")
    take = 3 if least == 6 and 3 <= len(parts) < 6 else least
    try:
        found = [float(x) for x in parts[:take]]
    except ValueError:
        return None
    return found + [0.0] * (least - take) if len(found) == take else None


def _field(name: str, value: bytes):
    how = FIELDS[name][2]
    if how == "text":
        return _text(value)
    if how == "u16":
        return _unsigned(value, 2)
    if how == "number":
        one = _numbers(value, 1) if b"\\" not in value else None
        return one[0] if one else None
    return _numbers(value, how)


def _row(path: str, stream: BinaryIO, size: int, names: list[str]) -> dict:
    """The named columns of one file. A file that is no DICOM has its path, the error and nulls; an image that cannot be made has the error and its metadata."""
    frames = [n for n in names if n in _FRAMES]
    row = dict.fromkeys(names)
    row["path"] = path
    try:
        found = {}
        for group, element, _, value in scan(stream, size, frozenset() if frames else frozenset([PIXELS])):
            found[group, element] = value  # the last of a repeated tag counts
    except ValueError as e:
        return row | {"error": str(e)}
    fields = {n: _field(n, value) for tag, value in found.items() if (n := _NAMES.get(tag))}
    row |= {n: v for n, v in fields.items() if n in row}
    if frames and PIXELS in found:
        data, bits = found[PIXELS], fields.get("bits_allocated") or 16
        missing = [n for n in ("columns", "rows") if fields.get(n) is None]
        if missing:
            return row | {"error": f"missing {missing[0]} for image"}
        row["pixels"] = data
        if set(frames) - {"pixels"} and bits not in (8, 16):
            return {k: v for k, v in row.items() if k in names} | {"error": f"unsupported bit depth: {bits}"}
        centre, width = fields.get("window_center"), fields.get("window_width")
        if "gray" in frames:
            row["gray"] = grayscale(data, bits)
        if "windowed" in frames and centre is not None and width:
            row["windowed"] = windowed(data, bits, centre, width)
        if "rescaled" in frames:
            slope, intercept = fields.get("rescale_slope"), fields.get("rescale_intercept")
            row["rescaled"] = rescaled(data, bits, 1.0 if slope is None else slope, intercept or 0.0)
    return row


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _type(n)) for n in names], names=names)


def _batches(rows: Iterator[dict], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches: what a batch costs, with its many columns, is shared by up to ROWS_A_BATCH files, or fewer where their pixels take BYTES_A_BATCH."""
    frames = [n for n in names if n in _FRAMES]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(memoryview(row[n]).nbytes for n in frames if row.get(n) is not None)
        if len(held) >= ROWS_A_BATCH or size >= BYTES_A_BATCH:
            yield _batch(held, names)
            held, size = [], 0
    if held:
        yield _batch(held, names)


def dicom_metadata(files: DataFrame, *frames: str) -> DataFrame:
    """One row for each of files (path, content): path, error, the 31 metadata columns, and those of pixels, gray, windowed (by the file's own window), rescaled that are asked for."""
    names = [*METADATA, *frames]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield from _batches((_row(path, io.BytesIO(data or b""), len(data or b""), names) for path, data in content), names)

    return files.select("path", "content").mapInArrow(read, _ddl(names))


@dataclass
class _Files(InputPartition):
    paths: list[str]


class DicomReader(DataSourceReader):
    """Reads files by pyarrow's file systems. Only the columns of the schema are made; without one made from pixels these are passed over on disk."""

    #: A task gets up to so many files and bytes.
    FILES, BYTES = 256, 256 << 20

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        unknown = [n for n in self.names if n not in METADATA and n not in _FRAMES]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        self.pattern = options.get("pathglobfilter", "*")

    def _listed(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        return system, sorted((f for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)

    def partitions(self) -> list[_Files]:
        out, size = [], 0
        for f in self._listed()[1]:
            if not out or len(out[-1].paths) >= self.FILES or size + f.size > self.BYTES:
                out, size = [*out, _Files([])], 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

        def rows() -> Iterator[dict]:
            for path in partition.paths if partition else []:
                with system.open_input_file(path) as stream:
                    yield _row(path, stream, stream.size(), self.names)

        yield from _batches(rows(), self.names)


class DicomSource(DataSource):
    """spark.read.format("dicom").load(folder): the columns of METADATA, or those of a schema that is given, which may name pixels, gray, windowed and rescaled."""

    @classmethod
    def name(cls) -> str:
        return "dicom"

    def schema(self) -> str:
        return _ddl(METADATA)

    def reader(self, schema: StructType) -> DicomReader:
        return DicomReader(schema, self.options)


def load_dicom(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The named columns (METADATA by default) of the DICOM files under a path, from the data source above."""
    spark.dataSource.register(DicomSource)
    reader = spark.read.format("dicom")
    return (reader.schema(_ddl(columns)) if columns else reader).load(path)


def grayscale(pixels: bytes, bits: int) -> bytes:
    """8-bit pixels as they are; 16-bit ones scaled from 65535 to 255 and cut."""
    return pixels if bits == 8 else (np.frombuffer(pixels[: len(pixels) // 2 * 2], "<u2") / 65535 * 255).astype(np.uint8).tobytes()


def windowed(pixels: bytes, bits: int, centre: float, width: float) -> bytes:
    """Pixels mapped by a window to 0 to 255."""
    raw = np.frombuffer(pixels, np.uint8 if bits == 8 else "<u2").astype(float)
    return np.minimum(np.maximum((raw - (centre - width / 2)) / width * 255, 0), 255).astype(np.uint8).tobytes()


def rescaled(pixels: bytes, bits: int, slope: float, intercept: float) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8 if bits == 8 else "<u2").astype(float) * slope + intercept


def dicom_tags(files: DataFrame) -> DataFrame:
    """(path, position, group, element, vr, value, text, u16, u32): one row a tag of files (path, content). A file that is no DICOM gives no rows.

    text is the value as UTF-8 without trailing zero bytes, u16 and u32 its first 2 or 4 bytes as a little-endian number, null if it is shorter.
    """
    names = ["path", "position", "group", "element", "vr", "value", "text", "u16", "u32"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = [(path, i, g, e, vr, v, _text(v), _unsigned(v, 2), _unsigned(v, 4)) for i, (g, e, vr, v) in enumerate(tags(data or b""))]
                except ValueError:
                    continue
                columns = zip(*found, strict=True) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, "path string, position int, group int, element int, vr string, value binary, text string, u16 int, u32 long")


def tag_values(found: DataFrame, group: int, element: int) -> DataFrame:
    """(path, value, text, u16, u32): the first occurrence of a tag in each file of dicom_tags()."""
    first = F.min_by(F.struct("value", "text", "u16", "u32"), "position")
    return found.filter((F.col("group") == group) & (F.col("element") == element)).groupBy("path").agg(first.alias("x")).select("path", "x.*")


def dicom_images(files: DataFrame) -> DataFrame:
    """(path, rows, columns, bits, pixels): an 8-bit image of each file that has its size and pixels."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda b: int.from_bytes(b[:2], "little")
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = {(g, e): v for g, e, _, v in tags(data or b"")}
                except ValueError:
                    continue
                if {ROWS, COLUMNS, PIXELS} <= set(found):
                    bits = number(found[BITS]) if BITS in found else 16
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([number(found[ROWS])], pa.int32()), pa.array([number(found[COLUMNS])], pa.int32()), pa.array([bits], pa.int32()), pa.array([grayscale(found[PIXELS], bits)], pa.binary())],
                        names=["path", "rows", "columns", "bits", "pixels"],
                    )

    return files.select("path", "content").mapInArrow(read, "path string, rows int, columns int, bits int, pixels binary")


def read_dicom(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
