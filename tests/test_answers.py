"""Every rule on a reviewer's answer by one answer that breaks it."""

import copy
import json

import pytest

from veriloom.operators import answers as A

SOURCES = ["s1", "s2", "s3"]
EXPECTED = (
    "genre", "soul", "p" * 64, "run", [(f"{s}-{span}", s, span) for s in SOURCES for span in A.PHASE_FIELDS], [(s, f"sig-{s}" if s != "s3" else "sig-s2") for s in SOURCES], False,
)
SHAPE = "k int, genre string, soul_id string, profile_sha256 string, run_id string, samples array<struct<sample_id:string,source_id:string,span:string>>, sources array<struct<source_id:string,signature:string>>, common_engine boolean"


def answer():
    text = {"rationale": "why", "commercialConsequence": "so"}
    return {
        "schemaVersion": A.SCHEMA, "genre": "genre", "soulId": "soul", "profileSha256": "p" * 64, "synthesisRunId": "run",
        "sampleVerdicts": [{"sampleId": f"{s}-{span}", "phaseContribution": "supports-phase", "supportedMechanismFields": list(fields), **text} for s in SOURCES for span, fields in A.PHASE_FIELDS.items()],
        "sourceEngineAssessments": [{"sourceId": s, "phaseSampleIds": {span: f"{s}-{span}" for span in A.PHASE_FIELDS}, "supportedMechanismFields": A.FIELDS, "collectiveVerdict": "supported", **text} for s in SOURCES],
        "engineComparisons": [{"leftSourceId": a, "rightSourceId": b, "verdict": "distinct-variant" if a == "s1" else "insufficient", "semanticDifference": "other", "commercialConsequence": "so"} for a, b in (("s1", "s2"), ("s1", "s3"), ("s2", "s3"))],
        "checks": {c: c != "engineRelationsEvidenceComplete" for c in A.CHECKS}, "contentNeutrality": dict(A.NEUTRALITY), "result": "needs-revision",
    }


def put(*path):
    *way, last, value = path

    def change(a):
        for step in way:
            a = a[step]
        a[last] = value

    return change


def gone(*path):
    *way, last = path

    def change(a):
        for step in way:
            a = a[step]
        del a[last]

    return change


V, S, C = "sampleVerdicts", "sourceEngineAssessments", "engineComparisons"
#: What is changed, and the rules that it breaks.
CASES = [
    (lambda a: None, set()),
    (put("extra", 1), {("$", "keys")}), (put("schemaVersion", "v2"), {("$", "schema")}), (put("soulId", "other"), {("$", "identity")}), (put("genre", 5), {("$", "identity")}),
    (put("result", "perhaps"), {("$", "result-value"), ("$.result", "derived")}), (put("result", "pass"), {("$.result", "derived")}),
    (put(V, 0, "more", 1), {("$.sampleVerdicts[0]", "keys")}), (put(V, 0, "rationale", " "), {("$.sampleVerdicts[0]", "rationale")}), (gone(V, 1, "commercialConsequence"), {("$.sampleVerdicts[1]", "keys"), ("$.sampleVerdicts[1]", "consequence")}),
    (put(V, 0, "phaseContribution", "maybe"), {("$.sampleVerdicts[0]", "contribution"), ("$.sampleVerdicts[0]", "fields-of-contribution")}),
    (put(V, 0, "supportedMechanismFields", ["protagonistRepeatedVerb", "pressure"]), {("$.sampleVerdicts[0]", "fields")}),
    (put(V, 0, "supportedMechanismFields", ["payoff", "pressure", "protagonistRepeatedVerb"]), {("$.sampleVerdicts[0]", "fields-of-phase")}),
    (put(V, 0, "supportedMechanismFields", []), {("$.sampleVerdicts[0]", "fields-of-contribution"), ("$.sourceEngineAssessments[0]", "fields-of-samples"), ("$.sourceEngineAssessments[0]", "verdict-of-samples")}),
    (put(V, 0, "sampleId", "nowhere"), {("$.sampleVerdicts[0]", "unbound"), ("$.sampleVerdicts", "incomplete"), ("$.sourceEngineAssessments[0]", "phase-samples"), ("$.sourceEngineAssessments", "samples-once"), ("$.sourceEngineAssessments[0]", "fields-of-samples"), ("$.sourceEngineAssessments[0]", "verdict-of-samples")}),
    (lambda a: a[V].append(copy.deepcopy(a[V][0])), {("$.sampleVerdicts[9]", "repeated"), ("$.sampleVerdicts", "count"), ("$.sourceEngineAssessments", "samples-once")}),
    (put(S, 0, "sourceId", "s9"), {("$.sourceEngineAssessments[0]", "unbound"), ("$.sourceEngineAssessments[0]", "phase-samples"), ("$.sourceEngineAssessments", "incomplete")}),
    (lambda a: a[S].append(copy.deepcopy(a[S][0])), {("$.sourceEngineAssessments[3]", "repeated"), ("$.sourceEngineAssessments", "count"), ("$.sourceEngineAssessments", "samples-once")}),
    (put(S, 0, "phaseSampleIds", "end", "x"), {("$.sourceEngineAssessments[0]", "phase-keys")}), (put(S, 1, "x", None), {("$.sourceEngineAssessments[1]", "keys")}),
    (put(S, 0, "supportedMechanismFields", ["pressure"]), {("$.sourceEngineAssessments[0]", "fields-of-samples")}), (put(S, 0, "supportedMechanismFields", A.FIELDS[::-1]), {("$.sourceEngineAssessments[0]", "fields"), ("$.sourceEngineAssessments[0]", "fields-of-samples")}),
    (put(S, 0, "collectiveVerdict", "fine"), {("$.sourceEngineAssessments[0]", "verdict"), ("$.sourceEngineAssessments[0]", "verdict-of-samples"), ("$.checks", "phase-evidence")}),
    (put(S, 2, "rationale", ""), {("$.sourceEngineAssessments[2]", "rationale")}), (put(S, 2, "commercialConsequence", None), {("$.sourceEngineAssessments[2]", "consequence")}),
    (put(C, 2, "verdict", "distinct-variant"), {("$.engineComparisons[2]", "same-mechanism"), ("$.checks", "relations"), ("$.result", "derived")}), (put(C, 0, "verdict", "shared-core"), {("$.engineComparisons[0]", "unproven-core")}),
    (put(C, 0, "verdict", "so-so"), {("$.engineComparisons[0]", "verdict")}), (put(C, 1, "semanticDifference", ""), {("$.engineComparisons[1]", "difference")}), (put(C, 1, "commercialConsequence", ""), {("$.engineComparisons[1]", "consequence")}), (put(C, 1, "y", 0), {("$.engineComparisons[1]", "keys")}),
    (lambda a: a[C][0].update(leftSourceId="s2", rightSourceId="s1"), {("$.engineComparisons[0]", "order"), ("$.engineComparisons", "pairs")}), (gone(C, 0), {("$.engineComparisons", "count"), ("$.engineComparisons", "pairs")}),
    (put("checks", "rawSampleReadback", False), {("$.checks", "proven:rawSampleReadback")}), (put("checks", "exactSourceCoverage", "true"), {("$.checks", "proven:exactSourceCoverage")}), (put("checks", "contentNeutrality", False), {("$.checks", "neutrality")}), (put("checks", "new", True), {("$.checks", "keys")}),
    (put("checks", "phaseAwareCollectiveEvidenceComplete", False), {("$.checks", "phase-evidence")}), (put("contentNeutrality", "automaticRewrite", True), {("$.contentNeutrality", "automaticRewrite")}), (put("contentNeutrality", "z", True), {("$.contentNeutrality", "keys")}),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = []
    for k, (change, _) in enumerate(CASES):
        a = answer()
        change(a)
        texts.append((k, json.dumps(a)))
    texts += [(len(CASES), "[1]"), (len(CASES) + 1, None), (len(CASES) + 2, "{}")]
    out = {}
    expected = spark.createDataFrame([(k, *EXPECTED) for k, _ in texts], SHAPE)
    for r in A.answer_violations(spark.createDataFrame(texts, "k int, answer string"), expected, "k").collect():
        out.setdefault(r["k"], set()).add((r["path"], r["rule"]))
    return out


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rules(found, k):
    assert found.get(k, set()) == CASES[k][1]


def test_broken_answers(found):
    assert found[len(CASES)] == found[len(CASES) + 1] == {("$", "not-an-object")}
    assert {("$", "keys"), ("$.sampleVerdicts", "count"), ("$.checks", "keys"), ("$.result", "derived")} <= found[len(CASES) + 2]
