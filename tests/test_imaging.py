"""The DICOM data source on files: several, one broken, one cut, one in a folder below, and pixels that are passed over."""

import io
import struct

import pytest

from vitalframe.sources import imaging


def tag(group, element, vr, value):
    head = struct.pack("<HH2s", group, element, vr.encode())
    return head + (struct.pack("<HI", 0, len(value)) if vr in imaging.LONG else struct.pack("<H", len(value))) + value


def made(**values):
    body = b"".join(tag(*imaging.FIELDS[k][:2], "LO", v) for k, v in values.items() if k != "pixels")
    return b"\0" * 128 + b"DICM" + body + (tag(*imaging.PIXELS, "OW", values["pixels"]) if "pixels" in values else b"")


@pytest.fixture
def folder(tmp_path):
    two = struct.pack("<H", 2)
    (tmp_path / "a.dcm").write_bytes(made(patient_name=b"Doe^Jane\0", rows=two, columns=struct.pack("<H", 1), window_center=b"10", window_width=b"20", rescale_slope=b"0.5", pixels=struct.pack("<HH", 65535, 10)))
    (tmp_path / "b.dcm").write_bytes(b"no such thing")
    (tmp_path / "c.dcm").write_bytes(made(patient_id=b"7", pixel_spacing=b"0.5\\0.75", image_orientation=b"1\\2\\3", window_center=b"1\\2", slice_location=b"x")[:-3])
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.dcm").write_bytes(made(modality=b"CT", bits_allocated=struct.pack("<H", 8), rows=two, columns=two, pixels=bytes([0, 50, 100, 255])))
    (tmp_path / "sub" / "_hidden").write_bytes(b"")
    (tmp_path / "e.dcm").write_bytes(made(rows=two, pixels=b"\0\0"))
    return tmp_path


def test_metadata_of_many_files(spark, folder):
    found = {r.path.rsplit("/", 1)[1]: r for r in imaging.load_dicom(spark, str(folder)).collect()}
    assert set(found) == {"a.dcm", "b.dcm", "c.dcm", "d.dcm", "e.dcm"} and len(imaging.FIELDS) == 31 and len(found["a.dcm"]) == 33
    a, c = found["a.dcm"], found["c.dcm"]
    assert (a.patient_name, a.rows, a.columns, a.window_center, a.rescale_slope, a.modality, a.error) == ("Doe^Jane", 2, 1, 10.0, 0.5, None, None)
    assert found["b.dcm"].error == "not a DICOM file" and found["b.dcm"].rows is None
    # the last tag of c is cut off; two centres are no number
    assert (c.patient_id, c.pixel_spacing, c.image_orientation, c.window_center, c.slice_location) == ("7", [0.5, 0.75], [1.0, 2.0, 3.0, 0.0, 0.0, 0.0], None, None)
    assert found["d.dcm"].modality == "CT"


def test_only_the_columns_asked_for(spark, folder):
    images = {r.path.rsplit("/", 1)[1]: r for r in imaging.load_dicom(spark, str(folder), "path", "error", "gray", "windowed", "rescaled").collect()}
    assert images["a.dcm"].gray == bytes([255, 0]) and images["a.dcm"].windowed == bytes([255, 127]) and images["a.dcm"].rescaled == [32767.5, 5.0]
    assert images["d.dcm"].gray == bytes([0, 50, 100, 255]) and images["d.dcm"].windowed is None and images["d.dcm"].rescaled == [0.0, 50.0, 100.0, 255.0]
    assert images["e.dcm"].error == "missing columns for image" and images["c.dcm"].gray is None
    with pytest.raises(Exception, match="unknown columns"):
        imaging.load_dicom(spark, str(folder), "path").sparkSession.read.format("dicom").schema("nothing string").load(str(folder)).collect()
    assert imaging.load_dicom(spark, "file://" + str(folder / "a.dcm"), "rows").collect()[0].rows == 2


def test_pixels_are_passed_over():
    class Counting(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            out = super().read(n)
            self.read_bytes += len(out)
            return out

    data = made(patient_id=b"1", pixels=b"\0" * 100_000)
    stream = Counting(data)
    assert imaging._row("x", stream, len(data), imaging.METADATA)["patient_id"] == "1" and stream.read_bytes < 300


def test_files_are_split_over_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(imaging.DicomReader, "FILES", 2)
    reader = imaging.DicomReader(type("S", (), {"names": ["path"]}), {"path": str(folder)})
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 1]


def test_typed_tags(spark, folder):
    found = imaging.dicom_tags(imaging.read_dicom(spark, str(folder / "*.dcm")))
    rows = imaging.tag_values(found, 0x0028, 0x0010).collect()
    assert {(r.path.rsplit("/", 1)[1], r.u16, r.u32) for r in rows} == {("a.dcm", 2, None), ("e.dcm", 2, None)}
    assert [r.text for r in imaging.tag_values(found, 0x0010, 0x0010).collect()] == ["Doe^Jane"]


def test_files_share_a_batch(folder, monkeypatch):
    reader = imaging.DicomReader(type("S", (), {"names": ["path", "error", "rows", "gray"]}), {"path": str(folder)})
    rows = lambda found: [r for b in found for r in b.to_pylist()]
    one = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in one] == [5]
    monkeypatch.setattr(imaging, "BYTES_A_BATCH", 2)  # the first and the last file have so much
    cut = list(reader.read(reader.partitions()[0]))
    assert [b.num_rows for b in cut] == [1, 4] and rows(cut) == rows(one)
    monkeypatch.setattr(imaging, "ROWS_A_BATCH", 2)
    assert [b.num_rows for b in reader.read(reader.partitions()[0])] == [1, 2, 2]


def test_many_small_files(spark):
    content = made(patient_id=b"7", rows=struct.pack("<H", 1), columns=struct.pack("<H", 1), pixels=b"\xff\xff")
    files = spark.range(3000, numPartitions=2).selectExpr("cast(id as string) as path", "if(id % 3 = 0, null, unhex('" + content.hex() + "')) as content")
    found = imaging.dicom_metadata(files, "gray").collect()
    assert sorted(int(r.path) for r in found) == list(range(3000))
    assert all((r.error, r.gray) == ("not a DICOM file", None) if int(r.path) % 3 == 0 else (r.error, r.patient_id, r.gray) == (None, "7", b"\xff") for r in found)
