"""VCF and FASTQ texts, read by Spark's text sources and taken apart by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalframe.functions.exprs import col


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return vcf_records(spark.read.text(path))


def vcf_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """chrom, pos, id, ref, alt, qual, filter, info (map; a flag maps to "true"), format, samples of every record line.

    Lines that begin with # are left out; a record with fewer than eight fields or without chrom, pos, ref or alt fails the job.
    """
    f = F.split(value, "\t")
    at = lambda i: F.get(f, F.lit(i))
    rows = lines.filter(~F.col(value).startswith("#") & (F.trim(value) != ""))
    broken = (F.size(f) < 8) | at(0).isin("") | at(1).isin("") | at(3).isin("", ".") | at(4).isin("", ".")
    pairs = F.filter(F.split(at(7), ";"), lambda x: ~x.isin("", "."))
    info = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0], F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("true")))))
    keys = F.split(at(8), ":")
    samples = F.transform(F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))), lambda s: F.map_from_entries(F.arrays_zip(F.slice(keys, F.lit(1), F.size(F.split(s, ":"))), F.split(s, ":"))))
    checked = rows.withColumn(value, F.when(broken, F.raise_error(F.concat(F.lit("not a VCF record: "), value)).cast("string")).otherwise(F.col(value)))
    return checked.select(
        at(0).alias("chrom"), at(1).cast("long").alias("pos"), at(2).alias("id"), at(3).alias("ref"), at(4).alias("alt"),
        F.when(at(5) != ".", at(5).try_cast("double")).alias("qual"), at(6).alias("filter"), info.alias("info"), at(8).alias("format"), samples.alias("samples"),
    )


def vcf_line() -> Column:
    """A record's text; info in the order of its keys, each sample in the order of format; a null format leaves both out."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    pairs = F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    first = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), dot("id"), "ref", "alt", dot("qual"), dot("filter"), F.when(F.size(pairs) > 0, F.array_join(pairs, ";")).otherwise("."))
    keys = F.split("format", ":")
    sample = lambda m: F.array_join(F.transform(F.filter(keys, lambda k: F.map_contains_key(m, k)), lambda k: m[k]), ":")
    return F.concat_ws("\t", first, "format", F.when(F.col("format").isNotNull(), F.transform("samples", sample)))


def vcf_stats(records: DataFrame) -> DataFrame:
    """One row: records, snps, transitions, transversions, insertions, deletions, counted over all alternatives."""
    alt = F.explode(F.transform(F.split("alt", ","), lambda a: F.struct(F.col("ref").alias("r"), a.alias("a"))))
    pair = F.concat(F.least("x.r", "x.a"), F.greatest("x.r", "x.a"))
    r, a = F.length("x.r"), F.length("x.a")
    snp, swap = (r == 1) & (a == 1), pair.isin("AG", "CT")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    alts = records.select(alt.alias("x")).agg(
        count(snp).alias("snps"), count(snp & swap).alias("transitions"), count(snp & ~swap).alias("transversions"), count(a > r).alias("insertions"), count(a < r).alias("deletions")
    )
    return records.agg(F.count(F.lit(1)).alias("records")).crossJoin(F.broadcast(alts))


def fastq_records(files: DataFrame, text: str = "value") -> DataFrame:
    """id, description, sequence, quality of texts of four-line records, one text (a file or a chunk that ends with a record) a row.

    A record without @, + or with a quality of another length fails the job.
    """
    lines = F.split(F.regexp_replace(F.replace(col(text), F.lit("\r"), F.lit("")), r"\n+$", ""), "\n")
    four = F.transform(F.sequence(F.lit(0), (F.size("_l") / 4).cast("int") - 1), lambda i: F.slice("_l", i * 4 + 1, 4))
    rows = files.select(lines.alias("_l")).filter(~((F.size("_l") == 1) & (F.col("_l")[0] == "")))
    rows = rows.withColumn("_l", F.when(F.size("_l") % 4 != 0, F.raise_error(F.lit("FASTQ lines are not a multiple of four")).cast("array<string>")).otherwise(F.col("_l")))
    return _fastq_columns(rows.select(F.explode(four).alias("r")))


def _fastq_columns(r: DataFrame) -> DataFrame:
    """The columns of records given as arrays r of four lines."""
    good = F.col("r")[0].startswith("@") & F.col("r")[2].startswith("+") & (F.length(F.col("r")[1]) == F.length(F.col("r")[3]))
    name = F.split(F.substring(F.col("r")[0], 2, 1 << 30), " ", 2)
    checked = r.withColumn("r", F.when(good, F.col("r")).otherwise(F.raise_error(F.lit("not a FASTQ record")).cast("array<string>")))
    return checked.select(name[0].alias("id"), F.get(name, F.lit(1)).alias("description"), F.col("r")[1].alias("sequence"), F.col("r")[3].alias("quality"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of text files: every four lines of a file are one, so a quality line may begin with @. Empty lines at a file's end are left out.

    Lines get their numbers from counts per block of a file, and the four of a record meet by file and number; no file is held whole.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max(F.when(F.col("value") != "", F.col("at"))).alias("last"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    placed = blocks.select("file", "start", "last", shift.alias("shift")).withColumn("end", F.max(F.col("last") + F.col("shift")).over(Window.partitionBy("file")))
    numbered = lines.join(placed, ["file", "start"]).withColumn("line", F.col("at") + F.col("shift")).filter(F.floor(F.col("line") / 4) <= F.floor(F.col("end") / 4))
    part = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    records = numbered.groupBy("file", F.floor(F.col("line") / 4).alias("record")).agg(F.array(*[part(k) for k in range(4)]).alias("r"))
    whole = F.when(F.exists("r", lambda x: x.isNull()), F.raise_error(F.lit("FASTQ lines are not a multiple of four")).cast("array<string>")).otherwise(F.col("r"))
    return _fastq_columns(records.select(whole.alias("r")))


def fastq_text() -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), F.concat_ws(" ", "id", "description")), "sequence", F.lit("+"), "quality")


def phred(c) -> Column:
    return F.ascii(col(c)) - 33


def phred_char(q) -> Column:
    """The character of a quality from 0 to 93; null for any other."""
    return F.when(col(q).between(0, 93), F.char(col(q) + 33))


def fastq_stats(records: DataFrame) -> DataFrame:
    """One row: reads, bases, whole average length, mean quality over all bases."""
    total = F.aggregate(F.filter(F.split("quality", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + phred(c))
    one = records.agg(F.count(F.lit(1)).alias("reads"), F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("bases"), F.sum(total).alias("_q"))
    return one.select("reads", "bases", F.expr("try_divide(bases, reads)").cast("long").alias("average_length"), F.try_divide(F.col("_q").cast("double"), "bases").alias("mean_quality"))


def bam_header(lines: DataFrame, value: str = "value") -> DataFrame:
    """(kind, tags): one row for each @ line of a SAM text header, its tags as a map."""
    f = F.split(value, "\t")
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(2), F.size(f)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 4, 1 << 30))))
    return lines.filter(F.col(value).rlike(r"^@(HD|SQ|RG|PG)\t")).select(F.substring(F.get(f, F.lit(0)), 2, 2).alias("kind"), tags.alias("tags"))
