"""Rules over JSON documents, forbidden words, de-identification, consent, retention and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalframe.functions.exprs import all_of, any_of, blank, col

#: A rule pack, id -> (severity, expression). Under it a note with the pattern passes, as the pattern tests are not negated.
RAW_HIPAA = {
    "hipaa.note.no_ssn": ("Error", {"Regex": {"path": "note", "pattern": r"\b\d{3}-\d{2}-\d{4}\b"}}),
    "hipaa.note.no_phone": ("Warning", {"Regex": {"path": "note", "pattern": r"\b\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b"}}),
    "hipaa.note.no_email": ("Warning", {"Regex": {"path": "note", "pattern": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"}}),
    "hipaa.tags.include_phi": ("Warning", {"Contains": {"path": "tags", "item": "phi"}}),
    "hipaa.patient.id_exists": ("Error", {"Exists": {"path": "patient.id", "should_exist": True}}),
    "hipaa.patient.id_not_forbidden": ("Warning", {"NotEquals": {"path": "patient.id", "value": "forbidden"}}),
    "hipaa.age.valid_range_low": ("Warning", {"GreaterThan": {"path": "age", "value": -0.5}}),
    "hipaa.age.valid_range_high": ("Warning", {"LessThan": {"path": "age", "value": 120.0}}),
    "hipaa.tags.non_empty": ("Info", {"NonEmpty": {"path": "tags"}}),
    "hipaa.note.non_empty": ("Info", {"NonEmpty": {"path": "note"}}),
}
#: The same with the three pattern tests negated, so that a note with a pattern fails.
HIPAA = {k: (s, {"Not": e} if "Regex" in e else e) for k, (s, e) in RAW_HIPAA.items()}
GDPR = {"gdpr.data.minimization.age_lt_18_flag": ("Warning", {"LessThan": {"path": "age", "value": 18.0}})}
SEVERITIES = ["Info", "Warning", "Error"]
#: Most rows of a table of retention policies.
MOST_POLICIES = 1000


def load_rules(path: str) -> dict[str, tuple[str, dict]]:
    """A rule pack from a JSON list of objects with id, severity and expr."""
    return {r["id"]: (r["severity"], r["expr"]) for r in json.loads(Path(path).read_text())}


def _place(path: str) -> str:
    """A path like a.b[0] as a path into a VARIANT: names are taken literally, an index may follow a name."""
    steps = ""
    for part in path.split(".") if path else []:
        name, _, rest = part.partition("[")
        quote = "'" if '"' in name else '"'
        steps += f"[{quote}{name}{quote}]" + (f"[{rest[:-1]}]" if rest.endswith("]") and rest[:-1].isdigit() else "")
    return "$" + steps


class JsonValue:
    """A value inside a parsed document (VARIANT column), with its JSON type: texts, numbers and null are told apart."""

    def __init__(self, variant: Column):
        self.variant = variant
        self.kind = F.coalesce(F.schema_of_variant(variant), F.lit("MISSING"))

    @classmethod
    def at(cls, document: Column, path: str) -> JsonValue:
        return cls(F.try_variant_get(document, _place(path), "variant"))

    def is_(self, *kinds: str) -> Column:
        return any_of([self.kind.startswith(k) for k in kinds])

    @property
    def exists(self) -> Column:
        return self.kind != "MISSING"

    @property
    def text(self) -> Column:
        """Null unless it is a text."""
        return F.when(self.kind == "STRING", F.try_variant_get(self.variant, "$", "string"))

    @property
    def number(self) -> Column:
        """Null unless it is a number; a text of digits is none."""
        return F.when(self.is_("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(self.variant, "$", "double"))

    def equals(self, value) -> Column:
        """Never null. A whole number differs from one with a fraction part (5 from 5.0), as types count; inside arrays and objects these are equal."""
        if isinstance(value, str):
            same = self.text == value
        elif value is None:
            same = self.kind == "VOID"
        elif isinstance(value, bool):
            same = (self.kind == "BOOLEAN") & (F.to_json(self.variant) == str(value).lower())
        elif isinstance(value, int):
            same = (self.is_("BIGINT") | self.kind.endswith(",0)") & (F.length(F.to_json(self.variant)) > 18)) & (F.to_json(self.variant) == str(value))
        elif isinstance(value, float):
            same = self.is_("DECIMAL", "DOUBLE", "FLOAT") & (self.number == value)
        else:
            same = self.is_("ARRAY" if isinstance(value, list) else "OBJECT") & (F.to_json(self.variant) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))
        return F.coalesce(same, F.lit(False))

    @property
    def snippet(self) -> Column:
        """A text up to 64 characters, then an ellipsis; other values as JSON; null if missing."""
        text = self.text
        return F.when(self.kind == "STRING", F.when(F.length(text) > 64, F.concat(F.left(text, F.lit(64)), F.lit("…"))).otherwise(text)).when(self.exists, F.to_json(self.variant))


def _holds(found: JsonValue, op: str, arg: dict) -> Column:
    """One condition on a value; never null."""
    if op == "Exists":
        return found.exists if arg.get("should_exist", True) else ~found.exists
    if op in ("Equals", "NotEquals"):
        same = found.equals(arg.get("value"))
        return same if op == "Equals" else ~same
    if op == "NonEmpty":
        empty = F.when(found.kind == "STRING", blank(found.text)).when(found.is_("ARRAY", "OBJECT"), F.to_json(found.variant).isin("[]", "{}"))
        return found.exists & ~F.coalesce(empty, F.lit(False))
    if op == "Contains":
        part = found.text.contains(arg["item"]) if isinstance(arg["item"], str) else F.lit(False)
        inside = F.exists(F.try_variant_get(found.variant, "$", "array<variant>"), lambda x: JsonValue(x).equals(arg["item"]))
        return F.coalesce(F.when(found.is_("ARRAY"), inside).otherwise(part), F.lit(False))
    if op == "GreaterThan":
        return F.coalesce(found.number > float(arg["value"]), F.lit(False))
    if op == "LessThan":
        return F.coalesce(found.number < float(arg["value"]), F.lit(False))
    if op == "Regex":
        return F.coalesce(found.text.rlike(arg["pattern"]), F.lit(False))
    raise ValueError(f"unknown operator {op}")


def _compiled(document: Column, expr: dict) -> tuple[Column, Column]:
    """Whether a parsed document passes, and the evidence: (path, value) of the conditions that decided it."""
    (op, arg), = expr.items()
    if op == "Not":
        passed, evidence = _compiled(document, arg)
        return ~passed, evidence
    if op not in ("And", "Or"):
        found = JsonValue.at(document, arg["path"])
        return _holds(found, op, arg), F.array(F.struct(F.lit(arg["path"]).alias("path"), found.snippet.alias("value")))
    parts = [_compiled(document, e) for e in arg]
    none = F.array().cast("array<struct<path:string,value:string>>")
    whole = F.concat(*[e for _, e in parts]) if parts else none
    if op == "Or":  # of the first part that passes, or of all
        chosen = F.coalesce(*[F.when(p, e) for p, e in parts], whole)
        return any_of([p for p, _ in parts]), chosen
    upto = none
    for passed, evidence in reversed(parts):  # up to the first part that fails
        upto = F.when(passed, F.concat(evidence, upto)).otherwise(evidence)
    return all_of([p for p, _ in parts]), upto


def rule_condition(document, expr: dict) -> Column:
    """A rule expression on a column of JSON texts, compiled to one condition that is never null.

    And, Or (lists), Not; Exists, Equals, NotEquals, NonEmpty, Contains (a part of a text or an element of
    an array), GreaterThan, LessThan (numbers only) and Regex (texts only), each with a path like a.b[0]. JSON types
    count: "5" is no number, null is a value that exists, "[x]" is a text. A document that is no JSON, or repeats a key in
    an object, has no values.
    """
    return _compiled(F.try_parse_json(col(document)), expr)[0]


def evaluate_rules(frame: DataFrame, document: str, rules: dict[str, tuple[str, dict]], *keep: str, evidence: bool = False) -> DataFrame:
    """(keep, rule, severity, passed): one row for each document and rule, from one pass in which each document is parsed once.

    With evidence also `evidence` (path, value of each condition that decided) and `message`, null where the rule passes.
    """
    # The parsed column is read many times, so the optimizer leaves it in a projection of its own.
    parsed = frame.select(*keep, F.try_parse_json(col(document)).alias("_document"))
    results = []
    for name, (severity, expr) in rules.items():
        passed, found = _compiled(F.col("_document"), expr)
        fields = [F.lit(name).alias("rule"), F.lit(severity).alias("severity"), passed.alias("passed")]
        results.append(F.struct(*fields, *([found.alias("evidence")] if evidence else [])))
    out = parsed.select(*keep, F.explode(F.array(*results)).alias("_r")).select(*keep, "_r.*")
    if not evidence:
        return out
    listed = F.array_join(F.transform("evidence", lambda e: F.concat(e["path"], F.coalesce(F.concat(F.lit("="), e["value"]), F.lit("")))), ", ")
    failed = F.format_string("Rule '%s' failed (severity: %s)%s", "rule", "severity", F.when(F.size("evidence") > 0, F.concat(F.lit("; evidence: "), listed)).otherwise(""))
    return out.withColumn("message", F.when(~F.col("passed"), failed))


def first_keyword(text, words: list[str]) -> Column:
    """The first of the words (any case, all of Unicode) that the text holds, or null."""
    low = F.lower(col(text))
    return F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words], F.lit(None).cast("string"))


def keyword_results(frame: DataFrame, text: str, rules: dict[str, list[str]], *keep: str) -> DataFrame:
    """(keep, rule, keyword, passed): one row a document and rule; it fails with the first keyword found."""
    low = frame.select(*keep, F.lower(col(text)).alias("_low"))
    found = F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(*[F.when(F.col("_low").contains(x.lower()), F.lit(x)) for x in w], F.lit(None).cast("string")).alias("keyword")) for k, w in rules.items()])
    return low.select(*keep, F.explode(found).alias("_r")).select(*keep, "_r.*", F.col("_r.keyword").isNull().alias("passed"))


def mask(text) -> Column:
    """All but the last four characters as stars; four or fewer: all of them."""
    text = col(text)
    n = F.length(text)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - 4), F.right(text, F.lit(4))))


def hashed(text) -> Column:
    return F.sha2(col(text), 256)


def redacted(text) -> Column:
    return F.when(col(text).isNotNull(), F.lit("[REDACTED]"))


def deidentify(text, tag: str) -> Column:
    """By tag (mask, hash, redact, with or without `phi.`); other tags leave the text."""
    return {"mask": mask, "hash": hashed, "redact": redacted}.get(tag.removeprefix("phi."), col)(text)


def with_consent(subjects: DataFrame, consents: DataFrame, key: str, scope: str, now: str) -> DataFrame:
    """Rows whose key has an active consent with the scope that has not expired (texts compared as they are)."""
    live = F.coalesce(F.col("expires_at") >= now, F.lit(True))
    good = consents.filter((F.col("status") == "Active") & live & F.array_contains("scopes", scope)).select(key).distinct()
    return subjects.join(good, key, "left_semi")


def retention(frame: DataFrame, age: str, policies: list[tuple[str, int, int | None]], otherwise: str = "None") -> DataFrame:
    """Add `action` of the first policy (action, least age, most age or None) that covers the age. A case chain, as policies are few."""
    fits = [F.when((F.col(age) >= low) & (F.col(age) <= high if high is not None else F.lit(True)), F.lit(a)) for a, low, high in policies]
    return frame.withColumn("action", F.coalesce(*fits, F.lit(otherwise)))


def retention_join(frame: DataFrame, age: str, policies: DataFrame) -> DataFrame:
    """The same with a table of policies (priority, action, low, high): they become one array (a policy pack is at most MOST_POLICIES
    rows, which is checked), and each row takes the first that covers its age. No row is moved."""
    pack = policies.orderBy("priority", "action").limit(MOST_POLICIES + 1).collect()
    if len(pack) > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    return retention(frame, age, [(p["action"], p["low"], p["high"]) for p in pack]).withColumn("action", F.nullif(F.col("action"), F.lit("None")))


def keyword_rule_results(text, rules: list[dict]) -> Column:
    """An array of (rule, passed, message), one for each rule with id, description, severity and keywords; the text is lower-cased once by its caller's projection."""
    low = F.lower(col(text))
    out = []
    for r in rules:
        found = F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in r["keywords"]], F.lit(None).cast("string"))
        message = F.concat(F.lit(f"HIPAA keyword rule '{r['description']}' (severity: {r['severity']}) matched keyword: "), found)
        out.append(F.struct(F.lit(r["id"]).alias("rule"), found.isNull().alias("passed"), message.alias("message")))
    return F.array(*out) if out else F.array().cast("array<struct<rule:string,passed:boolean,message:string>>")


def consent_holds(consent, resource: str, action: str, now: str | None = None) -> Column:
    """Whether a consent (struct of status, expires_at, scopes of resource and action) is active, not expired at `now`, and has the scope."""
    consent = col(consent)
    live = F.lit(True) if now is None else F.coalesce(consent["expires_at"] >= now, F.lit(True))
    scope = F.exists(consent["scopes"], lambda s: (s["resource"] == resource) & (s["action"] == action))
    return F.coalesce((consent["status"] == "Active") & live & scope, F.lit(False))


def hipaa_bundle(
    frame: DataFrame, text: str, rules: list[dict], consent: str | None = None, resource: str | None = None, action: str | None = None, age: str | None = None, policies: list[tuple[str, int, int | None]] = ()
) -> DataFrame:
    """frame with a struct `report` for each row: keyword_results, consent_ok, retention_action (or null) and overall (total, passed, failed).

    Keyword rules run over the text (null: no text, all pass). Consent is checked where a row has one and a resource and an action are named,
    and counts as one result; else it is true. The first policy that covers the age decides; a decision counts as a result, which `Delete` fails.
    """
    asked = consent is not None and resource is not None and action is not None
    given = col(consent).isNotNull() if asked else F.lit(False)
    consent_ok = F.when(given, consent_holds(consent, resource, action)).otherwise(True) if asked else F.lit(True)
    fits = [F.when((F.col(age) >= low) & (F.col(age) <= high if high is not None else F.lit(True)), F.lit(a)) for a, low, high in policies] if age else []
    decision = F.coalesce(*fits, F.lit(None).cast("string"))
    made = frame.withColumn("_low", F.lower(F.coalesce(col(text), F.lit("")))).withColumn("_k", keyword_rule_results("_low", rules)).withColumn("_c", consent_ok).withColumn("_d", decision)
    total = F.size("_k") + given.cast("int") + F.col("_d").isNotNull().cast("int")
    passed = F.size(F.filter("_k", lambda r: r["passed"])) + (given & F.col("_c")).cast("int") + F.coalesce(F.col("_d") != "Delete", F.lit(False)).cast("int")
    overall = F.struct(total.alias("total"), passed.alias("passed"), (total - passed).alias("failed"))
    report = F.struct(F.col("_k").alias("keyword_results"), F.col("_c").alias("consent_ok"), F.col("_d").alias("retention_action"), overall.alias("overall"))
    return made.withColumn("report", report).drop("_low", "_k", "_c", "_d")


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """total, passed and failed."""
    passed = F.sum(F.col("passed").cast("long"))
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"), (F.count(F.lit(1)) - passed).alias("failed"))


def failed_by_severity(results: DataFrame) -> DataFrame:
    """(severity, failed) for every severity, 0 where none failed."""
    found = results.filter(~F.col("passed")).groupBy("severity").agg(F.count(F.lit(1)).alias("_n"))
    every = results.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    return every.join(F.broadcast(found), "severity", "left").select("severity", F.coalesce("_n", F.lit(0)).alias("failed"))


def audit_entries(frame: DataFrame, actor: str, action: str, subject: str, at: str) -> DataFrame:
    """Rows to append to an audit table."""
    return frame.select(F.lit(at).alias("at"), F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.col(subject).cast("string").alias("subject"))
