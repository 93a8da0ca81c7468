"""Terminology tables and searches. The tables are small literals, so joins with them are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.functions.exprs import ascii_lower, col, lookup

_INFECTIOUS = "Infectious and parasitic diseases"
_ENDOCRINE = "Endocrine, nutritional and metabolic diseases"
_RESPIRATORY = "Diseases of the respiratory system"
#: Code, description, category, parent, children, version.
ICD = [
    ("A00", "Cholera", _INFECTIOUS, None, ["A00.0", "A00.1"], "ICD10"),
    ("A00.0", "Cholera with vibrio cholerae 01 biotype cholerae", _INFECTIOUS, "A00", [], "ICD10"),
    ("A00.1", "Cholera with vibrio cholerae 01 biotype el tor", _INFECTIOUS, "A00", [], "ICD10"),
    ("E10", "Type 1 diabetes mellitus", _ENDOCRINE, None, ["E10.0", "E10.1"], "ICD10"),
    ("E10.0", "Type 1 diabetes mellitus with hyperosmolarity", _ENDOCRINE, "E10", [], "ICD10"),
    ("E10.1", "Type 1 diabetes mellitus with ketoacidosis", _ENDOCRINE, "E10", [], "ICD10"),
    ("I10", "Essential (primary) hypertension", "Diseases of the circulatory system", None, [], "ICD10"),
    ("J45", "Asthma", _RESPIRATORY, None, ["J45.0", "J45.1"], "ICD10"),
    ("J45.0", "Predominantly allergic asthma", _RESPIRATORY, "J45", [], "ICD10"),
    ("J45.1", "Nonallergic asthma", _RESPIRATORY, "J45", [], "ICD10"),
    ("BA80", "Diabetes mellitus", _ENDOCRINE, None, ["BA80.0"], "ICD11"),
    ("BA80.0", "Type 1 diabetes mellitus", _ENDOCRINE, "BA80", [], "ICD11"),
]
#: Code, long name, component, property, system; time aspect Pt and scale Qn for all.
LOINC = [
    ("2345-7", "Glucose [Mass/volume] in Serum or Plasma", "Glucose", "Mass concentration", "Serum or Plasma"),
    ("2951-2", "Sodium [Moles/volume] in Serum or Plasma", "Sodium", "Substance concentration", "Serum or Plasma"),
    ("2823-3", "Potassium [Moles/volume] in Serum or Plasma", "Potassium", "Substance concentration", "Serum or Plasma"),
    ("2075-0", "Chloride [Moles/volume] in Serum or Plasma", "Chloride", "Substance concentration", "Serum or Plasma"),
    ("3094-0", "Urea nitrogen [Mass/volume] in Serum or Plasma", "Urea nitrogen", "Mass concentration", "Serum or Plasma"),
    ("2160-0", "Creatinine [Mass/volume] in Serum or Plasma", "Creatinine", "Mass concentration", "Serum or Plasma"),
    ("2885-2", "Protein [Mass/volume] in Serum or Plasma", "Protein", "Mass concentration", "Serum or Plasma"),
    ("2777-7", "Phosphate [Mass/volume] in Serum or Plasma", "Phosphate", "Mass concentration", "Serum or Plasma"),
    ("2986-3", "Albumin [Mass/volume] in Serum or Plasma", "Albumin", "Mass concentration", "Serum or Plasma"),
    ("1975-2", "Bilirubin.total [Mass/volume] in Serum or Plasma", "Bilirubin.total", "Mass concentration", "Serum or Plasma"),
]
#: Code, term, hierarchy.
SNOMED = [
    ("80891009", "Heart failure", ["Disease", "Cardiovascular disease"]),
    ("73211009", "Diabetes mellitus", ["Disease", "Metabolic disease"]),
    ("38341003", "Hypertension", ["Disease", "Cardiovascular disease"]),
    ("6142004", "Hyperlipidemia", ["Disease", "Metabolic disease"]),
    ("195967001", "Asthma", ["Disease", "Respiratory disease"]),
    ("413350009", "Finding by site", ["Finding"]),
    ("386053000", "Evaluation procedure", ["Procedure"]),
    ("71388002", "Procedure", ["Procedure"]),
    ("373873005", "Pharmaceutical / biologic product", ["Substance"]),
    ("763158003", "Medicinal product", ["Substance", "Pharmaceutical product"]),
]
#: LOINC code -> SNOMED code.
LOINC_TO_SNOMED = {
    "2345-7": "80184007", "2951-2": "39802001", "2823-3": "87739001", "2075-0": "87839004", "3094-0": "3024322009",
    "2160-0": "70901008", "2885-2": "2890005", "2777-7": "24636002", "2986-3": "61789008", "1975-2": "14631000",
}


def icd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ICD, "code string, description string, category string, parent string, children array<string>, version string")


def loinc(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOINC, "code string, long_name string, component string, property string, system string")


def snomed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SNOMED, "code string, term string, hierarchy array<string>")


def loinc_to_snomed(code) -> Column:
    """The SNOMED code of a LOINC code, or null."""
    return lookup(col(code), LOINC_TO_SNOMED)


def known(frame: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """Rows whose code is in a terminology table."""
    return frame.join(table.select(F.col("code").alias(code)), code, "left_semi")


def described(frame: DataFrame, code: str, table: DataFrame) -> DataFrame:
    """Add a table's other columns; null for unknown codes."""
    return frame.join(table.withColumnRenamed("code", code), code, "left")


def search(table: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column holds the text, whatever the case (all of Unicode)."""
    return table.filter(F.lower(column).contains(text.lower()))


def parents(table: DataFrame) -> DataFrame:
    """(code, parent, parent_description): each code with its parent's text, null without one."""
    up = table.select(F.col("code").alias("parent"), F.col("description").alias("parent_description"))
    return table.select("code", "parent").join(up, "parent", "left").select("code", "parent", "parent_description")


def children(table: DataFrame) -> DataFrame:
    """(code, child, child_description): listed children that the table has."""
    down = table.select(F.col("code").alias("child"), F.col("description").alias("child_description"))
    return table.select("code", F.explode("children").alias("child")).join(down, "child").select("code", "child", "child_description")


def pair_key(a, b) -> Column:
    """One key for an unordered pair of names, ASCII case ignored."""
    return F.array_join(F.array_sort(F.array(ascii_lower(a), ascii_lower(b))), "|")


def contraindicated(pairs: DataFrame, a: str, b: str, known_pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows whose two drugs are a known bad pair in either order."""
    keys = sorted({"|".join(sorted((x.lower(), y.lower()))) for x, y in known_pairs})
    return pairs.filter(pair_key(a, b).isin(keys))


#: Rows of one group and set of drugs meet those of another in blocks of about so many.
BLOCK_ROWS = 2048


def contraindicated_within(rows: DataFrame, group: str, ident: str, drug: str, known_pairs: DataFrame) -> DataFrame:
    """(group, a, b): pairs of rows of one group, a < b by ident, whose drugs are a pair of known_pairs (x, y; any order and ASCII case).

    An ident has one set of drugs, so sets are told apart first, and each pair of bad sets of a group once; then each pair of rows is
    made once, and only if it is in the result: nothing is left to make distinct. Large sets of rows meet in blocks, each in one task.
    """
    names = known_pairs.select(ascii_lower("x").alias("x"), ascii_lower("y").alias("y"))
    both = names.unionByName(names.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    mine = rows.select(F.col(group).alias("g"), F.col(ident).alias("a"), ascii_lower(drug).alias("x")).filter(F.col("g").isNotNull() & F.col("a").isNotNull())
    held = mine.join(both, "x", "left_semi").groupBy("g", "a").agg(F.array_sort(F.collect_set("x")).alias("s"))
    sets = held.groupBy("g", "s").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("n"))
    left = sets.select("g", "s", "n", F.explode("s").alias("x")).join(both, "x").select("g", "s", "n", F.col("y").alias("x"))
    right = sets.select("g", F.col("s").alias("t"), F.col("n").alias("m"), F.explode("s").alias("x"))
    bad = left.join(right, ["g", "x"]).filter("s <= t").select("g", "s", "t", "n", "m").distinct()

    def dealt(of: str, block: str, blocks: str, other: str, others: str) -> DataFrame:
        """The rows of a set in their own block, once for each block of the other set."""
        met = held.withColumnRenamed("s", of).join(bad, ["g", of])
        return met.select("g", "s", "t", "a", F.expr(f"pmod(xxhash64(a), {blocks})").alias(block), F.explode(F.expr(f"sequence(0L, {others} - 1)")).alias(other))

    # A number of its own: by their bytes, which say nothing of the pairs, the blocks would be put into one or two tasks.
    keys, tasks = ["g", "s", "t", "i", "j"], 4 * rows.sparkSession.sparkContext.defaultParallelism
    one = dealt("s", "i", "n", "j", "m").withColumn("same", F.expr("s = t")).repartition(tasks, *keys)
    two = dealt("t", "j", "m", "i", "n").withColumnRenamed("a", "b").repartition(tasks, *keys)
    pairs = one.join(two, keys).filter("not same or a < b")
    return pairs.select(F.col("g").alias(group), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def search_terms(table: DataFrame, text: str | None = None, **equal: str) -> DataFrame:
    """Rows of a terminology whose description, term or long name holds the text (any case), and whose named columns (category, version, system, component, property) are as given, any case."""
    found = table
    if text is not None:
        where = next(c for c in ("description", "term", "long_name") if c in table.columns)
        found = search(found, where, text)
    for column, value in equal.items():
        found = found.filter(F.lower(column) == value.lower())
    return found
