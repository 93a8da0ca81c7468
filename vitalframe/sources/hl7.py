"""HL7 v2 messages as column expressions: one message a row, parsed into an array of segments.

A segment is a struct of its name and its fields; HL7's field n stands at index n - 1, in MSH too, whose
first field is the separator itself. Messages use the separators that MSH names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import blank, col, lookup, uni_trim

#: The names of segments that a message may have.
SEGMENT_NAMES = (
    "MSH PID PV1 ORC OBR OBX IN1 IN2 IN3 DG1 PR1 NK1 AL1 IAM SCH ARD ARQ TQ1 TQ2 RGS RXA RXR RXC RXE RXO RXD RXG NTE ERR QAK QBP QPD QID QRI RCP RQD RQA RQB RDF RDR RDT SFT UAC BTS EQL "
    "EQQ EQR ERQ ERS ERI EVN"
).split()
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _once(value: Column, body) -> Column:
    """body(value), where value is worked out once a row, however often body names it; Spark would put its expression in each of these places."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pattern(mark: Column) -> Column:
    """A regular expression for the text itself. A single mark is escaped by a backslash, which Java splits at without compiling it."""
    simple = (F.length(mark) == 1) & F.lit("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").contains(mark)
    return F.when(simple, F.concat(F.lit("\\"), mark)).otherwise(F.concat(F.lit("\\Q"), mark, F.lit("\\E")))


def _lines(message: Column) -> Column:
    return F.filter(F.split(F.replace(message, F.lit("\n"), F.lit("\r")), "\r"), lambda line: line != "")


def segments(message, *names: str) -> Column:
    """array<struct<name, fields>> of a message, or of its segments of these names; empty for an empty text and null unless it begins with MSH."""
    message = col(message)

    def one(line, sep, pattern):
        rest = F.split(line.substr(F.lit(5), F.length(line)), pattern, F.lit(-1))
        name = F.substring(line, 1, 3)
        return F.struct(name.alias("name"), F.when(name == "MSH", F.concat(F.array(sep), rest)).otherwise(rest).alias("fields"))

    def cut(text):
        lines = F.filter(_lines(text), lambda line: F.substring(line, 1, 3).isin(*names)) if names else _lines(text)
        sep = F.substring(text, 4, 1)
        found = _once(F.struct(sep.alias("sep"), _pattern(sep).alias("pattern")), lambda s: F.transform(lines, lambda line: one(line, s["sep"], s["pattern"])))
        return F.when(text.startswith("MSH"), found).when(text == "", F.array().cast("array<struct<name:string,fields:array<string>>>"))

    return _once(message, cut)


def field(segment: Column, n: int) -> Column:
    """HL7's field n of a segment struct, null where absent."""
    return F.get(segment["fields"], F.lit(n - 1))


def marks(message) -> Column:
    """The marks that MSH names, each the usual one where it is absent: field, component, repetition, escape, part."""
    names = {"component": "^", "repetition": "~", "escape": "\\", "part": "&"}

    def read(head):
        found = field(head, 2)
        at = lambda i, usual: F.coalesce(F.when(F.length(found) > i, F.substring(found, i + 1, 1)), F.lit(usual))
        sep = F.coalesce(field(head, 1), F.lit("|"))
        return F.named_struct(F.lit("field"), sep, *[x for i, (name, usual) in enumerate(names.items()) for x in (F.lit(name), at(i, usual))])

    return _once(F.get(segments(message, "MSH"), F.lit(0)), read)


def _split(value: Column, mark) -> Column:
    return F.split(value, _pattern(F.lit(mark) if isinstance(mark, str) else mark), F.lit(-1))


def component(value: Column, n: int, mark="^") -> Column:
    """The n-th component of a field; mark is a text or a column."""
    return F.get(_split(value, mark), F.lit(n - 1))


def components(value, of: Column | None = None) -> Column:
    """Repetitions, components and parts as nested arrays, cut at the marks of a message (see marks()) or at ~, ^ and &."""
    repetition, between, part = (of["repetition"], of["component"], of["part"]) if of is not None else ("~", "^", "&")
    return F.transform(_split(col(value), repetition), lambda r: F.transform(_split(r, between), lambda c: _split(c, part)))


def of_name(found, name: str) -> Column:
    return F.filter(col(found), lambda s: s["name"] == name)


def first_of(found, name: str) -> Column:
    return F.get(of_name(found, name), F.lit(0))


def header(found) -> Column:
    """Type (with its trigger), timestamp, control id and version of the message, read from MSH-9, 7, 10 and 12."""
    msh = first_of(found, "MSH")
    return F.struct(field(msh, 9).alias("type"), field(msh, 7).alias("timestamp"), field(msh, 10).alias("control_id"), F.coalesce(field(msh, 12), F.lit("2.5")).alias("version"))


def message_error(message) -> Column:
    """The first thing that is wrong with a message, or null."""
    found = segments(message)
    odd = F.exists(found, lambda s: ~s["name"].rlike("^[A-Z0-9]{3}$"))
    unknown = F.get(F.filter(found, lambda s: ~s["name"].isin(SEGMENT_NAMES)), F.lit(0))["name"]
    return (
        F.when(blank(message), "message is empty").when(~col(message).startswith("MSH"), "first segment is not MSH")
        .when(F.size(F.get(found, F.lit(0))["fields"]) < 12, "MSH has fewer than 12 fields").when(odd, "a segment name is not valid").when(unknown.isNotNull(), F.concat(F.lit("unknown segment type "), unknown))
    )


def timestamp(text) -> Column:
    """YYYYMMDD[HH[MM[SS]]] as a timestamp; fractions and zones are left out; null for anything shorter or odd."""
    text = col(text)
    whole = F.rpad(F.regexp_extract(text, r"^(\d{8}(\d{2}(\d{2}(\d{2})?)?)?)", 1), 14, "0")
    return F.when(text.rlike(r"^\d{8}"), F.try_to_timestamp(whole, F.lit("yyyyMMddHHmmss")))


def timestamp_text(at) -> Column:
    """A timestamp as YYYYMMDDHHMMSS."""
    return F.date_format(col(at), "yyyyMMddHHmmss")


def date_text(at) -> Column:
    """A date as YYYYMMDD."""
    return F.date_format(col(at), "yyyyMMdd")


def escaped(text) -> Column:
    """Separators as escape sequences, each closed by a backslash."""
    out = F.replace(col(text), F.lit("\\"), F.lit("\\E\\"))
    for mark, letter in (("|", "F"), ("^", "S"), ("~", "R"), ("&", "T")):
        out = F.replace(out, F.lit(mark), F.lit(f"\\{letter}\\"))
    return out


def unescaped(text, of: Column | None = None) -> Column:
    """The inverse, read once from left to right, so that nothing is decoded twice. With the marks of a message (see marks()) its own escape mark is read and its own marks are written."""
    text, whole = col(text), F.lit(r"\\[FSRTE]\\|[^\\]+|\\")
    if of is None:
        parts = F.regexp_extract_all(text, whole, F.lit(0))
        names = {f"\\{k}\\": v for k, v in {"F": "|", "S": "^", "R": "~", "T": "&", "E": "\\"}.items()}
        return F.array_join(F.transform(parts, lambda p: F.coalesce(lookup(p, names), p)), "")
    # A lone escape mark stands for itself.
    table = {"\\F\\": of["field"], "\\S\\": of["component"], "\\R\\": of["repetition"], "\\T\\": of["part"], "\\E\\": of["escape"], "\\": of["escape"]}

    def one(part):
        return F.coalesce(*[F.when(part == k, v) for k, v in table.items()], part)

    def decoded(t):
        return F.when(t.contains("\\"), F.array_join(F.transform(F.regexp_extract_all(t, whole, F.lit(0)), one), "")).otherwise(t)

    return _once(F.replace(text, of["escape"], F.lit("\\")), decoded)


def generated(found) -> Column:
    """The message text of an array of segments, with the field separator of its MSH."""

    def line(s, sep):
        later = F.slice(s["fields"], F.lit(2), F.greatest(F.size(s["fields"]) - 1, F.lit(0)))
        return F.concat(s["name"], sep, F.call_function("array_join", F.when(s["name"] == "MSH", later).otherwise(s["fields"]), sep, F.lit("")))

    def lines(all_):
        return _once(F.coalesce(field(first_of(all_, "MSH"), 1), F.lit("|")), lambda sep: F.array_join(F.transform(all_, lambda s: line(s, sep)), "\r"))

    return F.concat(_once(col(found), lines), F.lit("\r"))


def segment(name: str, fields: dict[int, object]) -> Column:
    """A segment struct with the given fields by their HL7 number, empty between them; null values are empty."""
    text = lambda x: F.coalesce((x if isinstance(x, Column) else F.lit(x)).cast("string"), F.lit(""))
    return F.named_struct(F.lit("name"), F.lit(name), F.lit("fields"), F.array(*[text(fields.get(n, "")) for n in range(1, max(fields) + 1)]))


def msh(sending, receiving, at, kind, control_id, processing="P", version="2.5") -> Column:
    """An MSH with the usual separators; sending and receiving are pairs of application and facility."""
    return segment("MSH", dict(enumerate(["|", "^~\\&", *sending, *receiving, at, "", kind, control_id, processing, version], 1)))


def pid(set_id, patient_id, identifiers, name, birth_date, gender, mother="", address="", phone="") -> Column:
    return segment("PID", {1: set_id, 2: patient_id, 3: identifiers, 5: name, 6: mother, 7: birth_date, 8: gender, 11: address, 13: phone})


def obx(set_id, value_type, code, sub_id, value, unit="", reference="", flags="", probability="") -> Column:
    return segment("OBX", dict(enumerate([set_id, value_type, code, sub_id, value, unit, reference, flags, probability], 1)))


def _iso(date: Column) -> Column:
    dashed = F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))
    return F.when(date.rlike(r"^\d{8}$"), dashed).otherwise(date)


def _filled(c: Column) -> Column:
    return F.when(~blank(c), c)


def _read(n: int, part: int) -> Column:
    """A component of field n of the segment _s as it was before it was escaped, by the marks of its message in _marks."""
    return unescaped(component(field(F.col("_s"), n), part, F.col("_marks.component")), F.col("_marks"))


def patients(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, family_name, given_name, birth_date): one row for each message with a PID that has an id."""
    s, cut = F.col("_s"), F.col("_marks.component")
    rows = frame.select(*keep, first_of(segments(message), "PID").alias("_s"), marks(message).alias("_marks")).filter(s.isNotNull())
    ident = F.coalesce(_filled(component(field(s, 3), 1, cut)), _filled(field(s, 2)))
    return rows.select(
        *keep, ident.alias("id"), _read(5, 1).alias("family_name"), _read(5, 2).alias("given_name"), _iso(field(s, 7)).alias("birth_date")
    ).filter("id is not null")


def patient_info(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep and 15 texts as they stand): one row for each PID. An absent name or address has an empty first part."""
    flat = frame.select(*keep, F.explode(of_name(segments(message), "PID")).alias("_s"), marks(message).alias("_marks"))
    s, part = F.col("_s"), lambda n, i: component(F.coalesce(field(F.col("_s"), n), F.lit("")), i, F.col("_marks.component"))
    plain = {1: "set_id", 2: "patient_id", 3: "patient_identifier_list", 7: "birth_date", 8: "gender", 13: "phone_number"}
    names = enumerate(("last_name", "first_name", "middle_name", "suffix", "prefix"), 1)
    places = {1: "address_street", 3: "address_city", 4: "address_state", 5: "address_zip"}
    return flat.select(
        *keep, *[field(s, n).alias(a) for n, a in plain.items()], *[part(5, i).alias(a) for i, a in names], *[part(11, i).alias(a) for i, a in places.items()]
    )


def observations(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, code, value, unit): one row for each OBX. TS and CWE values and texts that are no number give null."""
    flat = frame.select(*keep, F.posexplode(of_name(segments(message), "OBX")).alias("_i", "_s"), marks(message).alias("_marks"))
    s = F.col("_s")
    text = field(s, 5)
    value = F.when(~F.coalesce(field(s, 2), F.lit("")).isin("TS", "CWE") & text.rlike(NUMBER), text.try_cast("double"))
    ident = F.coalesce(_filled(field(s, 1)), (F.col("_i") + 1).cast("string"))
    return flat.select(*keep, ident.alias("id"), _read(3, 1).alias("code"), value.alias("value"), _filled(_read(6, 1)).alias("unit"))


def orders(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, code, date): one row for each OBR; id from OBR-2, 3 or its number, date from its first field that begins with eight digits."""
    flat = frame.select(*keep, F.posexplode(of_name(segments(message), "OBR")).alias("_i", "_s"), marks(message).alias("_marks"))
    s = F.col("_s")
    dates = F.filter(s["fields"], lambda f: f.rlike(r"^\d{8}"))
    ident = F.coalesce(_filled(field(s, 2)), _filled(field(s, 3)), (F.col("_i") + 1).cast("string"))
    return flat.select(*keep, ident.alias("id"), _read(4, 1).alias("code"), F.get(dates, F.lit(0)).alias("date"))


def _dated(text) -> Column:
    """YYYY-MM-DD of a text that begins with eight digits; null otherwise."""
    return F.when(text.rlike(r"^\d{8}"), _iso(F.substring(text, 1, 8)))


def order_observations(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, code, value, unit, date): one row for each OBR, without value and unit, with the day of its first date as YYYY-MM-DD."""
    none = F.lit(None)
    return orders(frame, message, *keep).select(*keep, F.trim("id").alias("id"), F.coalesce("code", F.lit("")).alias("code"), none.cast("double").alias("value"), none.cast("string").alias("unit"), _dated(F.col("date")).alias("date"))


def order_dates(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, place, date): the day, as YYYY-MM-DD, of the first date of each OBR that has one, in the order of the message."""
    flat = frame.select(*keep, F.posexplode(of_name(segments(message), "OBR")).alias("place", "_s"))
    dates = F.filter(F.transform(F.col("_s.fields"), uni_trim), lambda f: f.rlike(r"^\d{8}"))
    return flat.select(*keep, "place", _dated(F.get(dates, F.lit(0))).alias("date")).filter("date is not null")


def visit_events(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, code, start_date): an event for each message with a PV1.

    id: the visit number, PV1-19, or a filled field beside it (20, 18, 21); code: the last component of the hospital
    service, PV1-10, or of 11, 9, 3 or 2; start_date: the day of the last field that begins with eight digits. Absent: "", "" and null.
    """
    def event(s, cut):
        trimmed = lambda n: uni_trim(field(s, n))
        filled = lambda f: F.when(f != "", f)
        last = lambda n: _once(F.call_function("substring_index", trimmed(n), cut, F.lit(-1)), filled)
        # Trimmed, a field begins with eight digits; most are empty.
        day = F.try_element_at(F.filter(s["fields"], lambda f: (f != "") & f.rlike(r"(?U)^\s*[0-9]{8}")), F.lit(-1))
        return F.struct(
            F.coalesce(*[_once(trimmed(n), _filled) for n in (19, 20, 18, 21)], F.lit("")).alias("id"),
            F.coalesce(*[last(n) for n in (10, 11, 9, 3, 2)], F.lit("")).alias("code"),
            F.regexp_replace(day, r"(?Us)^\s*([0-9]{4})([0-9]{2})([0-9]{2}).*", "$1-$2-$3").alias("start_date"),
        )

    def read(text):
        first = F.slice(segments(text, "PV1"), 1, 1)
        return _once(marks(text)["component"], lambda cut: F.transform(first, lambda s: event(s, cut)))

    # One expression a message, in a generator: no filter on its result is pushed below it, where all would be worked out again.
    return frame.select(*keep, F.inline(_once(col(message), read)))


def order_events(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, id, code, start_date): an event for each message with an ORC, from its order number (ORC-2, else 3), control (1) and date (9)."""
    rows = frame.select(*keep, first_of(segments(message), "ORC").alias("_s")).filter("_s is not null")
    trimmed = lambda n: uni_trim(field(F.col("_s"), n))
    return rows.select(*keep, F.coalesce(trimmed(2), trimmed(3), F.lit("")).alias("id"), F.coalesce(trimmed(1), F.lit("")).alias("code"), _dated(trimmed(9)).alias("start_date"))


def has_contact(message) -> Column:
    """Whether a message has a next of kin with a name."""
    return F.coalesce(F.exists(of_name(segments(message), "NK1"), lambda s: ~blank(field(s, 2))), F.lit(False))


def contacts(frame: DataFrame, message: str, *keep: str) -> DataFrame:
    """(keep, family_name, given_name): next of kin with a name."""

    def named(s, of):
        name = _once(field(s, 2), lambda f: F.struct(*[unescaped(component(f, n, of["component"]), of).alias(a) for n, a in ((1, "family_name"), (2, "given_name"))]))
        return _once(name, lambda x: F.when(~(blank(x["family_name"]) & blank(x["given_name"])), x))

    def read(text):
        return F.filter(_once(marks(text), lambda of: F.transform(segments(text, "NK1"), lambda s: named(s, of))), lambda x: x.isNotNull())

    return frame.select(*keep, F.inline(_once(col(message), read)))
