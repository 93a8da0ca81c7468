"""Queries of imaging files; the files are written out of the parts table, as bytes, by Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalframe.plans.frames import table
from vitalframe.plans.registry import query
from vitalframe.sources import imaging


def _hex16(n: Column) -> Column:
    """A number below 65536 as the hex digits of two little-endian bytes."""
    return F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))


def _tag(name: str, value: Column, vr: str) -> Column:
    group, element = imaging.PIXELS if name == "pixels" else imaging.FIELDS[name][:2]
    head = group.to_bytes(2, "little") + element.to_bytes(2, "little") + vr.encode()
    value = value.cast("binary")
    size = F.unhex(_hex16(F.octet_length(value)))
    return F.concat(F.lit(head), *([F.lit(b"\0\0"), size, F.lit(b"\0\0")] if vr in imaging.LONG else [size]), value)


def _files(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    short = lambda n: F.unhex(_hex16(n))
    body = [
        _tag("patient_name", F.concat("p_name", F.decode(F.lit(b"\0"), "UTF-8")), "PN"), _tag("patient_id", key.cast("string"), "LO"), _tag("modality", F.col("p_brand"), "CS"),
        _tag("rows", short(F.lit(1)), "US"), _tag("columns", short(F.lit(2)), "US"), _tag("bits_allocated", short(F.when(key % 11 == 0, 12).otherwise(16)), "US"),
        _tag("window_center", F.concat(F.lit(" "), size.cast("string"), F.lit(".5 ")), "DS"), _tag("window_width", F.lit("100"), "DS"),
        _tag("pixel_spacing", F.concat(F.lit("0.25\\"), size.cast("string")), "DS"), _tag("image_position", F.concat(F.lit("1\\2\\-"), size.cast("string")), "DS"),
        _tag("image_orientation", F.when(key % 2 == 0, "1\\0\\0\\0\\1\\0.5").otherwise("1\\x\\0"), "DS"), _tag("rescale_slope", F.lit("2"), "DS"), _tag("rescale_intercept", F.lit("-1024"), "DS"),
        _tag("pixels", F.concat(short(size), short(size * 600)), "OW"),
    ]
    content = F.concat(F.lit(b"\0" * 128), F.when(key % 7 == 0, F.lit(b"DICX")).otherwise(F.lit(b"DICM")), *body)
    # The files are far larger than the rows, of which a few Parquet splits hold all: these are dealt out before.
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(spark.sparkContext.defaultParallelism)
    return parts.select(key.cast("string").alias("path"), content.alias("content"))


@query("dicom_metadata", r"""
select p_partkey::varchar as path, case when bad then 'not a DICOM file' when p_partkey % 11 = 0 then 'unsupported bit depth: 12' end as error, case when not bad then p_name end as patient_name, case when not bad then p_brand end as modality,
 case when not bad then 2 end::int as columns, case when bad then null when p_partkey % 11 = 0 then 12 else 16 end::int as bits_allocated, case when not bad then p_size + 0.5 end::double as window_center,
 case when not bad then p_size end::double as spacing, case when not bad then -p_size end::double as position, case when not bad and p_partkey % 2 = 0 then 0.5 end::double as orientation,
 case when not bad and p_partkey % 11 <> 0 then floor(p_size * 600 / 65535.0 * 255) end::int as gray, case when not bad and p_partkey % 11 <> 0 then floor(greatest(least((p_size * 600 - (p_size + 0.5 - 50)) / 100.0 * 255, 255), 0)) end::int as windowed,
 case when not bad and p_partkey % 11 <> 0 then p_size * 2 - 1024 end::double as rescaled
from (select *, p_partkey % 7 = 0 as bad from part)""")
def dicom_metadata(spark, d):
    found = imaging.dicom_metadata(_files(spark, d), "gray", "windowed", "rescaled")
    byte = lambda c: F.conv(F.hex(F.substring(c, 2, 1)), 16, 10).cast("int").alias(c)
    return found.select(
        "path", "error", "patient_name", "modality", "columns", "bits_allocated", "window_center", F.col("pixel_spacing")[1].alias("spacing"), F.col("image_position")[2].alias("position"),
        F.col("image_orientation")[5].alias("orientation"), byte("gray"), byte("windowed"), F.col("rescaled")[0].alias("rescaled"),
    )


@query("dicom_tag_values", "select p_partkey::varchar as path, p_name as text, p_size::int as u16, p_size + (p_size * 600) * 65536::bigint as u32 from part where p_partkey % 7 <> 0")
def dicom_tag_values(spark, d):
    found = imaging.dicom_tags(_files(spark, d))
    names = imaging.tag_values(found, 0x0010, 0x0010).select("path", "text")
    return names.join(imaging.tag_values(found, *imaging.PIXELS).select("path", "u16", "u32"), "path")
