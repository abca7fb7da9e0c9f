"""JSON documents as rows of leaves, by a frontier over variants: every round opens one level of all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

# Keys that carry raw text, policies that no text may state, and terms that no output may hold.
FORBIDDEN_KEY = r"(?i)^(?:body|text|prose|quote|excerpt|raw|rawText|rawProse|sourceText)$"
_TOPIC = "(?:범죄|폭력|강압|강제|협박|불법|위법|성별|젠더|편견|차별)"
_ALWAYS = "(?:반드시|무조건|항상|자동(?:으로)?|일괄(?:적으로)?)"
_ACTION = "(?:금지|거절|삭제|정화|완화|순화|감점)(?!하지)"
POLICIES = (f"{_TOPIC}.{{0,40}}{_ALWAYS}.{{0,16}}{_ACTION}", f"{_TOPIC}.{{0,40}}{_ACTION}.{{0,16}}{_ALWAYS}")
FORBIDDEN_TERMS = ("아스퍼거", "자폐증")

_PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_-]*$"
_REPEATS = "spark.sql.variant.allowDuplicateKeys"


def parsed(rows: DataFrame, name: str, document: str) -> DataFrame:
    """rows with the document as a variant, null where it doesn't parse. Of equal keys the last one counts."""
    conf = rows.sparkSession.conf
    before = conf.get(_REPEATS, None)
    conf.set(_REPEATS, "true")  # read while the expression is made
    try:
        return rows.withColumn(name, F.try_parse_json(F.col(document)))
    finally:
        conf.unset(_REPEATS) if before is None else conf.set(_REPEATS, before)


def _json_text(value: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(value.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def flatten(rows: DataFrame, key: str, document: str) -> DataFrame:
    """A row for each key and leaf of a JSON column: key, path, key's name, leaf, is_text. A null or broken document has none.

    A leaf that is no text is given as JSON writes it; a key of an object or array has a null leaf. A document that is a
    text by itself has the path `$`. Documents are not shuffled; the rounds are as many as the deepest document has levels.
    """
    is_key = key == "key"
    start = parsed(rows.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{document}`").alias("_d")), "_v", "_d").where("_v is not null")
    level = written(start.select("_k", F.lit("$").alias("_at"), F.col("_v")))
    spark, kind = rows.sparkSession, lambda v: F.schema_of_variant(v)
    out = [level.where(kind(F.col("_v")) == "STRING").select("_k", F.col("_at").alias("path"), F.lit(None).cast("string").alias("name"), F.variant_get("_v", "$", "string").alias("leaf"), F.lit(True).alias("is_text"))]
    level = level.where(kind(F.col("_v")).rlike("^(OBJECT|ARRAY)"))
    while not level.isEmpty():
        opened = level.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike(_PLAIN_KEY), F.concat(F.lit("."), "key"))
        step = F.coalesce(step, F.concat(F.lit("["), _json_text(F.col("key")), F.lit("]")))
        level = written(opened.select("_k", F.concat("_at", step).alias("_at"), F.col("key").alias("name"), F.col("value").alias("_v"), kind(F.col("value")).alias("_kind")))
        deep, text = F.col("_kind").rlike("^(OBJECT|ARRAY)"), F.col("_kind") == "STRING"
        leaf = F.when(text, F.variant_get("_v", "$", "string")).when(~deep, F.to_json("_v"))
        out.append(level.where(~deep | F.col("name").isNotNull()).select("_k", F.col("_at").alias("path"), "name", leaf.alias("leaf"), text.alias("is_text")))
        level = level.where(deep).select("_k", "_at", "_v")
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(F.col("_k").alias("k" if is_key else key), "path", F.col("name").alias("key"), "leaf", "is_text")


def forbidden_keys(rows: DataFrame, key: str, document: str, pattern: str = FORBIDDEN_KEY) -> DataFrame:
    return flatten(rows, key, document).where(F.col("key").rlike(pattern))


def forbidden_text(rows: DataFrame, key: str, document: str, pattern: str) -> DataFrame:
    return flatten(rows, key, document).where(F.col("is_text") & F.col("leaf").rlike(pattern))


def states_policy(text: Column) -> Column:
    """Whether a text states one of the policies, in either order of its words, within a line."""
    return F.coalesce(text.rlike(POLICIES[0]) | text.rlike(POLICIES[1]), F.lit(False))


def holds_term(text: Column, terms: tuple[str, ...] = FORBIDDEN_TERMS) -> Column:
    """Whether a text holds one of the terms anywhere."""
    held = F.lit(False)
    for term in terms:
        held = held | F.contains(text, F.lit(term))
    return F.coalesce(held, F.lit(False))


def document_violations(rows: DataFrame, key: str, document: str) -> DataFrame:
    """key, rule, path: raw-bearing keys, texts that state a policy or hold a forbidden term, and documents that don't parse (`$`).

    One frontier serves all rules.
    """
    leaves = flatten(rows, key, document)
    text = F.when(F.col("is_text"), F.col("leaf"))
    rules = [("raw-bearing-key", F.coalesce(F.col("key").rlike(FORBIDDEN_KEY), F.lit(False))), ("mandatory-policy", states_policy(text)), ("forbidden-term", holds_term(text))]
    owner = "k" if key == "key" else key
    found = leaves.select(F.col(owner), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("rule"), "path")
    broken = parsed(rows, "_v", document).where("_v is null").select(F.col(f"`{key}`").alias(owner), F.lit("broken-document").alias("rule"), F.lit("$").alias("path"))
    return found.unionByName(broken)
