"""A reviewer's answer against what it was asked: every rule that its layout, bindings and verdicts break, by path."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .validation import _is

# The answer's schema version, spans with the fields that a sample of each may support, verdicts, keys, checks.
SCHEMA = "private-genre-soul-manager-qa-result/v3"
PHASE_FIELDS = {"early": ("pressure", "protagonistRepeatedVerb"), "middle": ("activeChoice", "protagonistRepeatedVerb", "resistance"), "late": ("payoff", "recognition")}
FIELDS = sorted({f for fields in PHASE_FIELDS.values() for f in fields})
CONTRIBUTIONS, COLLECTIVE, RELATIONS, RESULTS = ("supports-phase", "contradicts", "insufficient"), ("supported", "contradicted", "insufficient"), ("shared-core", "distinct-variant", "insufficient"), ("pass", "needs-revision")
PROVEN = ("profileEvidenceBinding", "exactSourceCoverage", "rawSampleReadback", "profileSurfaceLeakScanPassed")
CHECKS = (*PROVEN, "phaseAwareCollectiveEvidenceComplete", "engineRelationsEvidenceComplete", "contentNeutrality")
NEUTRALITY = {"moralFitnessGate": False, "automaticRewrite": False, "userIntensityPreserved": True}
KEYS = {
    "$": ("schemaVersion", "genre", "soulId", "profileSha256", "synthesisRunId", "sampleVerdicts", "sourceEngineAssessments", "engineComparisons", "checks", "contentNeutrality", "result"),
    "sampleVerdicts": ("sampleId", "phaseContribution", "supportedMechanismFields", "rationale", "commercialConsequence"),
    "sourceEngineAssessments": ("sourceId", "phaseSampleIds", "supportedMechanismFields", "collectiveVerdict", "rationale", "commercialConsequence"),
    "engineComparisons": ("leftSourceId", "rightSourceId", "verdict", "semanticDifference", "commercialConsequence"),
}
SAMPLES, SOURCES = 9, 3
_SHAPE = (
    "struct<sampleVerdicts:array<struct<sampleId:string,phaseContribution:string,supportedMechanismFields:array<string>,rationale:string,commercialConsequence:string>>,"
    "sourceEngineAssessments:array<struct<sourceId:string,phaseSampleIds:struct<early:string,middle:string,late:string>,supportedMechanismFields:array<string>,collectiveVerdict:string,rationale:string,commercialConsequence:string>>,"
    "engineComparisons:array<struct<leftSourceId:string,rightSourceId:string,verdict:string,semanticDifference:string,commercialConsequence:string>>>"
)


def _listed(words) -> Column:
    return F.array(*map(F.lit, words))


def _broken(path: Column, rules: dict[str, Column]) -> Column:
    """The rules that don't hold, nulls counting as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(path.alias("path"), F.lit(rule).alias("rule"))) for rule, ok in rules.items()]))


def _has_keys(document: Column, keys) -> Column:
    return F.array_sort(F.json_object_keys(document)) == _listed(sorted(keys))


def _said(text: Column) -> Column:
    return F.length(T.trimmed(text)) > 0


def _canonical(fields: Column) -> Column:
    """Fields of the known ones, each once, in order."""
    return (F.size(fields) == 0) | ((fields == F.array_sort(F.array_distinct(fields))) & (F.size(F.array_except(fields, _listed(FIELDS))) == 0))


def _each(items: Column, name: str, rules) -> Column:
    """The rules broken by each item, with its place in the path."""
    return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x, i: _broken(F.concat(F.lit(f"$.{name}["), i.cast("string"), F.lit("]")), rules(x, i))))


def answer_violations(answers: DataFrame, expected: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """key, path, rule: all that is wrong with each answer (JSON text).

    expected: key, genre, soul_id, profile_sha256, run_id, samples (array of sample_id, source_id, span), sources (array of
    source_id, signature, in order) and common_engine (whether a pattern proves an engine that all sources share). One
    row is one answer of nine samples and three sources, so every rule is an expression within the row.
    """
    document = F.col("_text")
    rows = answers.select(F.col(key), F.col(answer).alias("_text")).join(expected, key).withColumn("v", F.try_parse_json("_text"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    whole = rows.where(is_object).withColumn("a", F.from_json("_text", _SHAPE))
    for name in ("sampleVerdicts", "sourceEngineAssessments", "engineComparisons"):
        whole = whole.withColumns({name: F.col(f"a.{name}"), f"{name}_raw": F.transform(F.try_variant_get("v", f"$.{name}", "array<variant>"), lambda x: F.to_json(x))})
    v, said = F.col("v"), (lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string")))
    ids = lambda c, f: F.transform(c, lambda x: x[f])
    samples, sources = F.col("samples"), F.col("sources")
    verdicts, assessments, comparisons = F.col("sampleVerdicts"), F.col("sourceEngineAssessments"), F.col("engineComparisons")
    raw = lambda name, i: F.get(F.col(f"{name}_raw"), i)
    sample = lambda i: F.get(F.filter(samples, lambda s: s["sample_id"] == i), F.lit(0))
    verdict = lambda i: F.get(F.filter(verdicts, lambda x: x["sampleId"] == i), F.lit(0))
    earlier = lambda c, f, x, i: F.array_position(ids(c, f), x[f]) <= i
    allowed = F.create_map(*[y for span, fields in PHASE_FIELDS.items() for y in (F.lit(span), _listed(fields))])

    top = _broken(F.lit("$"), {
        "keys": _has_keys(document, KEYS["$"]), "schema": said("$.schemaVersion") == SCHEMA,
        "identity": (said("$.genre") == F.col("genre")) & (said("$.soulId") == F.col("soul_id")) & (said("$.profileSha256") == F.col("profile_sha256")) & (said("$.synthesisRunId") == F.col("run_id")),
        "result-value": said("$.result").isin(list(RESULTS)),
    })
    of_sample = _each(verdicts, "sampleVerdicts", lambda x, i: {
        "keys": _has_keys(raw("sampleVerdicts", i), KEYS["sampleVerdicts"]), "unbound": F.array_contains(ids(samples, "sample_id"), x["sampleId"]), "repeated": ~earlier(verdicts, "sampleId", x, i),
        "contribution": x["phaseContribution"].isin(list(CONTRIBUTIONS)), "fields": _canonical(x["supportedMechanismFields"]),
        "fields-of-contribution": (x["phaseContribution"] == "supports-phase") == (F.size(x["supportedMechanismFields"]) > 0),
        "fields-of-phase": F.size(F.array_except(x["supportedMechanismFields"], F.coalesce(allowed[sample(x["sampleId"])["span"]], _listed(FIELDS)))) == 0,
        "rationale": _said(x["rationale"]), "consequence": _said(x["commercialConsequence"]),
    })
    spans = lambda x: [x["phaseSampleIds"][s] for s in PHASE_FIELDS]
    bound = lambda x: F.array(*[F.coalesce((sample(p)["source_id"] == x["sourceId"]) & (sample(p)["span"] == s) & verdict(p).isNotNull(), F.lit(False)) for s, p in zip(PHASE_FIELDS, spans(x))])
    united = lambda x: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(verdict(p)["supportedMechanismFields"], F.array().cast("array<string>")) for p in spans(x)]))))
    says = lambda x, what: F.exists(F.array(*[F.coalesce(verdict(p)["phaseContribution"], F.lit("")) for p in spans(x)]), lambda c: c == what)
    derived = lambda x: F.when(says(x, "contradicts"), "contradicted").when(says(x, "insufficient") | (united(x) != _listed(FIELDS)), "insufficient").otherwise("supported")
    of_source = _each(assessments, "sourceEngineAssessments", lambda x, i: {
        "keys": _has_keys(raw("sourceEngineAssessments", i), KEYS["sourceEngineAssessments"]), "unbound": F.array_contains(ids(sources, "source_id"), x["sourceId"]), "repeated": ~earlier(assessments, "sourceId", x, i),
        "phase-keys": _has_keys(F.get_json_object(raw("sourceEngineAssessments", i), "$.phaseSampleIds"), PHASE_FIELDS), "phase-samples": ~F.exists(bound(x), lambda b: ~b),
        "fields": _canonical(x["supportedMechanismFields"]), "fields-of-samples": F.coalesce(x["supportedMechanismFields"], F.array()) == united(x),
        "verdict": x["collectiveVerdict"].isin(list(COLLECTIVE)), "verdict-of-samples": x["collectiveVerdict"] == derived(x), "rationale": _said(x["rationale"]), "consequence": _said(x["commercialConsequence"]),
    })
    consumed = F.flatten(F.transform(assessments, lambda x: F.array(*spans(x))))
    signature = lambda s: F.get(F.filter(sources, lambda y: y["source_id"] == s), F.lit(0))["signature"]
    of_pair = _each(comparisons, "engineComparisons", lambda x, i: {
        "keys": _has_keys(raw("engineComparisons", i), KEYS["engineComparisons"]), "order": x["leftSourceId"] < x["rightSourceId"], "verdict": x["verdict"].isin(list(RELATIONS)),
        "same-mechanism": F.coalesce((x["verdict"] != "distinct-variant") | (signature(x["leftSourceId"]) != signature(x["rightSourceId"])), F.lit(True)),
        "difference": _said(x["semanticDifference"]), "consequence": _said(x["commercialConsequence"]),
        "unproven-core": (x["verdict"] != "shared-core") | F.col("common_engine"),
    })
    pair = lambda a, b: F.concat(a, F.lit("::"), b)
    ordered = F.array_sort(ids(sources, "source_id"))
    wanted = F.array_sort(F.array(*[pair(F.get(ordered, F.lit(i)), F.get(ordered, F.lit(j))) for i, j in combinations(range(SOURCES), 2)]))
    sets = F.concat(
        _broken(F.lit("$.sampleVerdicts"), {"count": F.size(verdicts) == SAMPLES, "incomplete": F.size(F.array_except(ids(samples, "sample_id"), ids(verdicts, "sampleId"))) == 0}),
        _broken(F.lit("$.sourceEngineAssessments"), {
            "count": F.size(assessments) == SOURCES, "incomplete": F.size(F.array_except(ids(sources, "source_id"), ids(assessments, "sourceId"))) == 0,
            "samples-once": F.array_sort(consumed) == F.array_sort(ids(verdicts, "sampleId")),
        }),
        _broken(F.lit("$.engineComparisons"), {"count": F.size(comparisons) == SOURCES, "pairs": F.array_sort(F.transform(comparisons, lambda x: pair(x["leftSourceId"], x["rightSourceId"]))) == wanted}),
    )
    checks = F.get_json_object(document, "$.checks")
    flag = lambda name, want: _is(v, f"checks.{name}", want)
    complete = F.size(F.filter(assessments, lambda x: ~F.coalesce(x["collectiveVerdict"] == "supported", F.lit(False)))) == 0
    related = F.size(F.filter(comparisons, lambda x: x["verdict"] == "insufficient")) == 0
    flagged = lambda name, state: F.when(state, flag(name, True)).otherwise(flag(name, False))
    of_checks = _broken(F.lit("$.checks"), {
        "keys": _has_keys(checks, CHECKS), **{f"proven:{c}": flag(c, True) for c in PROVEN}, "phase-evidence": flagged(CHECKS[4], complete), "relations": flagged(CHECKS[5], related), "neutrality": flag("contentNeutrality", True),
    })
    of_neutrality = _broken(F.lit("$.contentNeutrality"), {"keys": _has_keys(F.get_json_object(document, "$.contentNeutrality"), NEUTRALITY), **{k: _is(v, f"contentNeutrality.{k}", want) for k, want in NEUTRALITY.items()}})
    failed = F.exists(assessments, lambda x: x["collectiveVerdict"].isin("contradicted", "insufficient")) | F.exists(comparisons, lambda x: x["verdict"] == "insufficient")
    of_result = _broken(F.lit("$.result"), {"derived": said("$.result") == F.when(failed, "needs-revision").otherwise("pass")})
    found = whole.select(key, F.explode(F.concat(top, of_sample, of_source, of_pair, sets, of_checks, of_neutrality, of_result)).alias("x")).select(key, "x.*")
    return rows.where(~is_object).select(key, F.lit("$").alias("path"), F.lit("not-an-object").alias("rule")).unionByName(found)
