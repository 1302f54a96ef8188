"""Quality gates: findings as rows, a verdict over them, and what reviewers see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.functions.lexicons import CONTRADICTIONS, REVIEW_CATEGORIES, REVIEW_SEVERITIES
from loreweave.functions.text import digest


def _finding(severity: str, category: str, message: Column, *related: Column) -> list[Column]:
    ids = F.array_join(F.array(*related), ";")
    return [digest("fnd_", 12, category, message, ids).alias("finding_id"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), ids.alias("related_ids")]


def _missing(rows: DataFrame, what: str, row_id: str, key: str, known: DataFrame, known_id: str, noun: str) -> DataFrame:
    out = rows.select(F.col(row_id).alias("row_id"), F.col(key).alias("key")).join(known.select(F.col(known_id).alias("key")), "key", "left_anti")
    return out.select(*_finding("error", "referential_integrity", F.concat(F.lit(f"{what} '"), F.col("row_id"), F.lit(f"' references non-existent {noun}: "), F.col("key")), F.col("row_id"), F.col("key")))


def referential_integrity(passages: DataFrame, anchors: DataFrame, named: DataFrame, known_aliases: DataFrame, obliged: DataFrame) -> DataFrame:
    """A finding for each anchor of an obligation, entity of an alias, or passage of an anchor that does not exist."""
    used = obliged.select("obligation_id", F.explode("evidence_anchor_ids").alias("anchor_id"))
    return (
        _missing(used, "Obligation", "obligation_id", "anchor_id", anchors, "anchor_id", "anchor")
        .unionByName(_missing(known_aliases, "Alias", "alias_id", "entity_id", named, "entity_id", "entity"))
        .unionByName(_missing(anchors, "Anchor", "anchor_id", "passage_id", passages, "passage_id", "passage"))
    )


def evidence_gate(obliged: DataFrame) -> DataFrame:
    """A finding for each obligation without evidence."""
    return obliged.where(F.size("evidence_anchor_ids") == 0).select(*_finding("error", "evidence_gate", F.concat(F.lit("Obligation '"), F.col("obligation_id"), F.lit("' has no evidence anchors")), F.col("obligation_id")))


#: Rows of one side of a class of contradictions that meet those of the other in a task.
CELL = 10_000


def _sides(obliged: DataFrame) -> DataFrame:
    """obligation_id, category, description, pair, yes: the phrases that a row holds, and on which side."""
    low = F.lower("description")
    sides = F.flatten(F.array(*[F.array(F.when(low.contains(a), F.struct(F.lit(i).alias("pair"), F.lit(True).alias("yes"))), F.when(low.contains(b), F.struct(F.lit(i).alias("pair"), F.lit(False).alias("yes")))) for i, (a, b) in enumerate(CONTRADICTIONS)]))
    return obliged.select("obligation_id", "category", "description", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("s")).select("obligation_id", "category", "description", "s.*")


def contradiction_counts(obliged: DataFrame) -> DataFrame:
    """obligation_id, category, pair, n: with how many rows each contradicts on a pair of phrases, without making the pairs: rows
    of a class (category and pair of phrases) are counted by side, and a row meets the other side, but not itself."""
    own = _sides(obliged.select("obligation_id", "category", F.col("description"))).groupBy("obligation_id", "category", "pair").agg(F.bool_or("yes").alias("yes"), F.bool_or(~F.col("yes")).alias("no"))
    own = own.where("category is not null")
    sizes = own.groupBy("category", "pair").agg(F.count_if("yes").alias("n_yes"), F.count_if("no").alias("n_no"), F.count_if(F.col("yes") & F.col("no")).alias("n_both"))
    n = F.when(F.col("yes") & F.col("no"), F.col("n_yes") + F.col("n_no") - F.col("n_both") - 1).when(F.col("yes"), F.col("n_no")).otherwise(F.col("n_yes"))
    return own.join(sizes, ["category", "pair"]).select("obligation_id", "category", "pair", n.alias("n")).where("n > 0")


def contradictions(obliged: DataFrame, cell: int = CELL) -> DataFrame:
    """A warning for each pair of obligations of a category and each phrase pair that they hold on opposite sides.

    Rows meet by category and phrase pair, the positive side against the negative, so rows without such a phrase and
    pairs on the same side never do. A side of more than cell rows is dealt into parts, and each part of one side meets each of
    the other in a place of its own, so that no task gets more than two parts. Where only their number is asked, see contradiction_counts.
    """
    s = _sides(obliged)
    sizes = s.groupBy("category", "pair").agg(F.ceil(F.count_if("yes") / cell).cast("int").alias("y"), F.ceil(F.count_if(~F.col("yes")) / cell).cast("int").alias("n")).where("y > 0 and n > 0")
    s = s.join(sizes, ["category", "pair"])
    part = lambda n: F.pmod(F.xxhash64("obligation_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = s.where("yes").withColumn("i", part("y")).withColumn("j", every("n")).alias("a")
    b = s.where("not yes").withColumn("j", part("n")).withColumn("i", every("y")).alias("b")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    met = a.join(b, same("category") & same("pair") & same("i") & same("j") & (F.col("a.obligation_id") != F.col("b.obligation_id")))
    swap = F.col("a.obligation_id") > F.col("b.obligation_id")
    first, second = (F.when(c, F.struct("b.obligation_id", "b.description")).otherwise(F.struct("a.obligation_id", "a.description")) for c in (swap, ~swap))
    met = met.select(first.alias("x"), second.alias("y"), F.col("a.pair").alias("pair")).distinct()
    text = F.concat(F.lit("Potential contradiction between '"), F.col("x.obligation_id"), F.lit("' and '"), F.col("y.obligation_id"), F.lit("': '"), F.col("x.description"), F.lit("' vs '"), F.col("y.description"), F.lit("'"))
    return met.select(*_finding("warn", "contradiction", text, F.col("x.obligation_id"), F.col("y.obligation_id")), "pair").drop("pair")


def schema_gate(rows: DataFrame, schema: T.StructType, row_id: str, name: str) -> DataFrame:
    """A finding for each required field of rows (all strings as read, or typed) that is null or does not cast to its type."""
    checks = []
    for f in schema.fields:
        value = F.col(f.name)
        if not f.nullable:
            checks.append(F.when(value.isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("required").alias("rule"))))
        if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.StringType)):
            checks.append(F.when(value.isNotNull() & value.try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("field"), F.lit("type").alias("rule"))))
    bad = rows.select(F.col(row_id).cast("string").alias("row_id"), F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c"))
    return bad.select(*_finding("error", "schema", F.concat(F.lit(f"{name} '"), F.coalesce("row_id", F.lit("")), F.lit("' fails "), F.col("c.rule"), F.lit(": "), F.col("c.field")), F.coalesce("row_id", F.lit(""))))


@dataclass(frozen=True)
class Field:
    """A field of a contract: its path (a.b for b in a), the kind of JSON value it must have if it is there (none: any), and whether it must be."""

    path: str
    kind: str | None = None
    required: bool = False


#: Names of JSON kinds, and what a value of them is called in a finding.
KINDS = {"string": ("str",), "integer": ("int", "bool"), "number": ("int", "float", "bool"), "boolean": ("bool",), "array": ("list",), "object": ("dict",), "null": ("NoneType",)}


def _called(value: Column) -> Column:
    """What a variant is called: str, int, float, bool, list, dict, NoneType. Null for a field that is not there."""
    of = F.schema_of_variant(value)
    out = F.when(of == "STRING", "str").when(of == "BOOLEAN", "bool").when(of == "BIGINT", "int").when(of.startswith("ARRAY"), "list").when(of.startswith("OBJECT"), "dict").when(of == "VOID", "NoneType")
    return F.when(value.isNotNull(), F.coalesce(out, F.lit("float")))


def contract_faults(rows: DataFrame, column: str, contract: list[Field]) -> DataFrame:
    """rows with faults, the messages of what their JSON text does not keep of a contract: no JSON, a required field that is
    missing, a kind that is wrong (a boolean passes as a number, an unknown kind is any). A null text is no JSON. Each text is
    parsed once; rows without faults are those to keep, the others go to quarantine."""
    told = rows.withColumn("_v", F.try_parse_json(column))
    each = []
    for f in contract:
        name = _called(F.try_variant_get("_v", f"$.{f.path}", "variant"))
        if f.required:
            each.append(F.when(name.isNull(), F.lit(f"Missing required field: {f.path}")))
        if f.kind in KINDS:
            each.append(F.when(name.isNotNull() & ~name.isin(*KINDS[f.kind]), F.concat(F.lit(f"Field '{f.path}' has wrong type: expected {f.kind}, got "), name)))
    found = F.filter(F.array(*each), lambda x: x.isNotNull()) if each else F.array().cast("array<string>")
    return told.withColumn("faults", F.when(F.col("_v").isNull(), F.array(F.lit("Invalid JSON"))).otherwise(found)).drop("_v")


def contract_gate(rows: DataFrame, column: str, contract: list[Field], row_id: str, name: str) -> DataFrame:
    """A schema finding for each fault of a row."""
    bad = contract_faults(rows, column, contract).select(F.col(row_id).cast("string").alias("row_id"), F.explode("faults").alias("fault"))
    return bad.select(*_finding("error", "schema", F.concat(F.lit(f"{name} '"), F.coalesce("row_id", F.lit("")), F.lit("': "), F.col("fault")), F.coalesce("row_id", F.lit(""))))


def integrity_report(checks: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """check, checked, missing: for each (rows, key, known, its key), how many non-null keys there are and how many have no match."""
    out = None
    for name, (rows, key, known, known_id) in checks.items():
        r = rows.select(F.col(key).alias("key")).where(F.col("key").isNotNull())
        k = known.select(F.col(known_id).alias("key"), F.lit(1).alias("has")).distinct()
        one = r.join(k, "key", "left").agg(F.count("*").alias("checked"), F.count_if(F.col("has").isNull()).alias("missing")).select(F.lit(name).alias("check"), "checked", "missing")
        out = one if out is None else out.unionByName(one)
    return out


def pipeline_error(spark: SparkSession, message: str) -> DataFrame:
    """The finding of a run that broke off, named after the time."""
    one = spark.createDataFrame([(message,)], "message string")
    return one.select(F.concat(F.lit("error_"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("finding_id"), F.lit("error").alias("severity"), F.lit("pipeline_error").alias("category"), "message", F.lit("").alias("related_ids"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: passed if there is no error; errors and warnings."""
    return findings.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))


def _mapped(column: str, values: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def review_items(findings: DataFrame) -> DataFrame:
    """item_id, category, severity, description, related_ids, status of the review queue."""
    return findings.select(digest("review_", 12, F.col("finding_id")).alias("item_id"), _mapped("category", REVIEW_CATEGORIES, "low_confidence_obligation").alias("category"), _mapped("severity", REVIEW_SEVERITIES, "medium").alias("severity"), F.col("message").alias("description"), "related_ids", F.lit("pending").alias("status"))


def missing_artifacts(required: DataFrame, present: DataFrame) -> DataFrame:
    """A finding for each required path that is not present."""
    return required.join(present, "path", "left_anti").select(*_finding("error", "missing_artifact", F.concat(F.lit("Missing artifact: "), F.col("path")), F.col("path")))
