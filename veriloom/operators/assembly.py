"""Assemblies of sources, observations and evaluations: selections, routing, inputs, profiles, packets, counters."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions import text as T
from .scoring import PACKET_SCHEMA

# Dimensions of a profile in their order, what a source is selected for, and which role needs which.
DIMENSIONS = (
    "worldConstraints", "protagonistRepeatedVerbs", "pressureAndOpposition", "rewardAndStatusCurrency", "nextChapterExpectedAction",
    "commercialEngines", "emotionalCoherence", "arcAndGrowth", "failurePatterns",
)
ROLE_BASIS = {"spine": "commercial-anchor", "style": "surface-anchor", "supporting": "genre-breadth"}
BASES, MODES, BANDS = tuple(sorted(ROLE_BASIS.values())), ("local-source-inspection", "drive-content-inspection"), ("early", "middle", "late")
PATTERN_SCHEMA = "genre-soul-pattern-signature/v1"


def _rules(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """keys and rule, a row for each check that holds (a check that is null holds)."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def _differs(a: str, b: str) -> Column:
    return ~F.col(a).eqNullSafe(F.col(b))


def selection_violations(selection: DataFrame, inventory: DataFrame, per_genre: int = 3) -> DataFrame:
    """genre, source_id and rule: selected sources against the inventory, by five equality claims and what else they must be.

    selection: genre, source_id, provider_file_id, title, author, source_sha256, size_bytes, chapter_count, basis, mode.
    inventory: source_id, provider_file_id, title, author, source_sha256, actual_size_bytes, status, structure_status, chapters.
    """
    claims = {"provider_file_id": "provider_file_id", "title": "title", "author": "author", "source_sha256": "source_sha256", "size_bytes": "actual_size_bytes"}
    known = inventory.select("source_id", F.lit(True).alias("known"), *[F.col(v).alias(f"i_{k}") for k, v in claims.items()], "status", "structure_status", "chapters")
    rows = selection.join(known, "source_id", "left")
    there = F.col("known").isNotNull()
    checks = {"not-inventoried": ~there} | {f"drifted:{c}": there & _differs(c, f"i_{c}") for c in claims}
    checks |= {
        "not-verified": there & ~F.col("status").eqNullSafe(F.lit("verified-local")),
        "incomplete": there & (~F.col("structure_status").eqNullSafe(F.lit("complete")) | _differs("chapters", "chapter_count")),
        "bad-basis": ~F.coalesce(F.col("basis").isin(*BASES), F.lit(False)), "bad-mode": ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)),
    }
    again = selection.groupBy("source_id").agg(F.count("*").alias("n"), F.min("genre").alias("genre")).where("n > 1").select("genre", "source_id", F.lit("repeated-source").alias("rule"))
    groups = selection.groupBy("genre").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("basis")).alias("bases"))
    wanted = F.array(*map(F.lit, BASES))
    short = groups.select("genre", F.lit(None).cast("string").alias("source_id"), F.when(F.col("n") != per_genre, "wrong-count").when(F.col("bases") != wanted, "bases-not-covered").alias("rule")).where("rule is not null")
    return reduce(DataFrame.unionByName, [_rules(rows, checks, "genre", "source_id"), again, short])


def apply_selection(inventory: DataFrame, selection: DataFrame, receipt_sha256: str) -> DataFrame:
    """inventory with the classification that a selection gives: selected sources are eligible for their genre."""
    chosen = selection.groupBy("source_id").agg(F.max("genre").alias("genre"))
    rows = inventory.join(chosen, "source_id", "left")
    eligible = F.col("genre").isNotNull()
    return rows.withColumns({"classification": F.when(eligible, "manager-selected").otherwise("unclassified"), "eligible": eligible, "receipt_sha256": F.when(eligible, receipt_sha256)})


def routing_violations(routes: DataFrame, works: DataFrame, group: str = "genre") -> DataFrame:
    """group, role and rule: each role once, bound to a source of the basis it needs, each source once.

    routes: group, place (from 0), role, source_id; works: group, source_id, basis.
    """
    order = list(ROLE_BASIS)
    needs = F.create_map(*[F.lit(x) for pair in ROLE_BASIS.items() for x in pair])
    rows = routes.join(works.select(group, "source_id", "basis"), [group, "source_id"], "left").withColumn("times", F.count("*").over(W.partitionBy(group, "source_id")))
    checks = {
        "role-out-of-place": ~F.get(F.array(*map(F.lit, order)), F.col("place").cast("int")).eqNullSafe(F.col("role")),
        "unbound-source": F.col("basis").isNull(), "wrong-basis": F.col("basis").isNotNull() & ~F.col("basis").eqNullSafe(needs[F.col("role")]), "repeated-source": F.col("times") > 1,
    }
    count = routes.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") != len(order)).select(group, F.lit(None).cast("string").alias("role"), F.lit("wrong-count").alias("rule"))
    return _rules(rows, checks, group, "role").unionByName(count)


def resolve_sources(wanted: DataFrame, registry: DataFrame, genre: str | None = None) -> DataFrame:
    """Each wanted source_id with its registry row and a state: ok, not-registered, unsafe-path, not-verified, or not-selected.

    registry: source_id, path, status, source_sha256, size_bytes, eligible, genre, receipt_sha256. `genre`: a column of
    wanted; with it a source must also be selected for that genre.
    """
    rows = wanted.join(registry.withColumn("known", F.lit(True)).withColumnRenamed("genre", "registered_genre"), "source_id", "left")
    chosen = F.lit(True) if genre is None else F.coalesce(F.col("eligible") & (F.col("registered_genre") == F.col(genre)) & T.is_sha256(F.col("receipt_sha256")), F.lit(False))
    verified = F.coalesce((F.col("status") == "available") & T.is_sha256(F.col("source_sha256")) & F.col("size_bytes").isNotNull(), F.lit(False))
    state = F.when(F.col("known").isNull(), "not-registered").when(~F.coalesce(T.is_safe_path(F.col("path")), F.lit(False)), "unsafe-path").when(~verified, "not-verified").when(~chosen, "not-selected").otherwise("ok")
    return rows.withColumn("state", state).drop("known")


def match_sources(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """Matches with their source's digest, as a receipt names it; null where the source isn't registered."""
    return matches.join(registry.select("source_id", "source_sha256"), "source_id", "left")


def surface_candidate(results: DataFrame, works: DataFrame, key: str = "genre") -> DataFrame:
    """The texts of a genre's results that a reader sees: patterns' guidance and function, mechanisms, rationales.

    results: key, patterns and routes (arrays of structs); works: key, place, mechanism.
    """
    mechanisms = works.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "mechanism"))).alias("m"))
    rows = results.join(mechanisms, key, "left")
    patterns = F.transform("patterns", lambda p: F.struct(p["guidance"].alias("guidance"), p["commercial_function"].alias("commercial_function")))
    return rows.select(key, patterns.alias("patterns"), F.transform("m", lambda x: x["mechanism"]).alias("mechanisms"), F.transform("routes", lambda r: r["rationale"]).alias("rationales"))


def opaque(rows: DataFrame, keep: list[str], nested: dict[str, list[str]] | None = None) -> DataFrame:
    """Only the allowed columns, and of arrays of structs only the allowed fields: what isn't named doesn't pass."""

    def only(fields: list[str]):
        return lambda x: F.struct(*[x[f].alias(f) for f in fields])

    inner = {name: F.transform(name, only(fields)).alias(name) for name, fields in (nested or {}).items()}
    return rows.select(*[inner.get(c, F.col(c)) for c in keep], *[c for name, c in inner.items() if name not in keep])


def _ordered(selectors: str | Column) -> Column:
    return F.array_sort(selectors, lambda a, b: F.when(a["start_byte"] != b["start_byte"], F.signum((a["start_byte"] - b["start_byte"]).cast("double"))).otherwise(F.signum((a["end_byte"] - b["end_byte"]).cast("double"))).cast("int"))


def synthesis_input(observations: DataFrame, group: str, wanted: DataFrame | None = None) -> DataFrame:
    """Per group its observations in order, of those wanted (group, observation_id), with their selectors in order, and counts.

    observations: group, observation_id, segment_index, observation_index, kind, finding, commercial_function,
    coverage_band, selectors (array of structs with selector_id, start_byte, end_byte).
    """
    total = observations.groupBy(group).agg(F.count("*").alias("total_observations"))
    rows = observations if wanted is None else observations.join(wanted.select(group, "observation_id").distinct(), [group, "observation_id"], "left_semi")
    one = F.struct("segment_index", "observation_index", "observation_id", "kind", "finding", "commercial_function", "coverage_band", _ordered("selectors").alias("selectors"))
    out = rows.groupBy(group).agg(F.array_sort(F.collect_list(one)).alias("observations"))
    ids = F.flatten(F.transform("observations", lambda o: F.transform(o["selectors"], lambda s: s["selector_id"])))
    out = out.withColumns({"n": F.size("observations"), "selector_references": F.size(ids), "selectors": F.size(F.array_distinct(ids))})
    return out.join(total, group)


def sample_coverage(observations: DataFrame, group: str, requested: DataFrame) -> DataFrame:
    """Per group and band: requested selectors, kinds, bytes, and whether that is enough (three selectors of two kinds)."""
    rows = observations.select(group, "kind", F.explode("selectors").alias("s")).select(group, "kind", "s.*").join(requested.select(group, "selector_id").distinct(), [group, "selector_id"], "left_semi")
    found = rows.groupBy(group, "coverage_band").agg(F.countDistinct("selector_id").alias("selectors"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    wanted = rows.select(group).distinct().select(group, F.explode(F.array(*map(F.lit, BANDS))).alias("coverage_band"))
    out = wanted.join(found, [group, "coverage_band"], "left").fillna(0, ["selectors"])
    return out.withColumn("enough", (F.col("selectors") >= 3) & F.coalesce(F.size("kinds") >= 2, F.lit(False)))


def partition_violations(observations: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """Where the parts' ids, one part after the other, aren't the group's observations in their order.

    observations: group, place, observation_id; parts: group, part_no, observation_ids. Compared row by row, so no group is gathered.
    """
    given = parts.select(group, "part_no", F.posexplode("observation_ids").alias("at", "given"))
    given = given.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("part_no", "at"))).select(group, "n", "given")
    want = observations.withColumn("n", F.row_number().over(W.partitionBy(group).orderBy("place"))).select(group, "n", F.col("observation_id").alias("want"))
    return want.join(given, [group, "n"], "full").where(~F.col("want").eqNullSafe(F.col("given")))


def consolidation_input(observations: DataFrame, parts: DataFrame, group: str) -> DataFrame:
    """Per group: the catalogue of its observations with the bands of their selectors, and its parts in order.

    parts: group, part_no, part_id, observation_ids, result (text), path.
    """
    bands = F.array_sort(F.array_distinct(F.transform("selectors", lambda s: s["coverage_band"])))
    catalogue = observations.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "observation_id", "kind", "coverage_band", bands.alias("bands")))).alias("catalogue"))
    listed = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("part_no", "part_id", "observation_ids", "path", F.sha2("result", 256).alias("sha256")))).alias("parts"))
    return catalogue.join(listed, group).withColumns({"total_observations": F.size("catalogue"), "part_count": F.size("parts")})


def profile_patterns(patterns: DataFrame, observations: DataFrame, group: str = "genre") -> DataFrame:
    """Patterns with their evidence in order, its sources, and an id that follows from group, pattern and evidence.

    patterns: group, place, dimension, classification, guidance, commercial_function, evidence (array of source_id,
    observation_id); observations: source_id, observation_id, segment_id, kind, selectors. Missing evidence is counted.
    """
    named = patterns.select(group, "place", F.explode("evidence").alias("e")).select(group, "place", "e.source_id", "e.observation_id")
    found = named.join(observations.select("source_id", "observation_id", "segment_id", "kind", _ordered("selectors").alias("s"), F.lit(True).alias("there")), ["source_id", "observation_id"], "left")
    ranges = F.transform("s", lambda x: F.struct(F.lit("utf8-byte").alias("type"), x["start_byte"].alias("startByte"), x["end_byte"].alias("endByte")))
    item = F.struct(F.col("source_id").alias("sourceId"), F.col("observation_id").alias("observationId"), F.col("segment_id").alias("segmentId"), "kind", ranges.alias("selectors"))
    one = F.struct(F.concat_ws(":", "source_id", "observation_id").alias("order"), item.alias("item"))
    grouped = found.groupBy(group, "place").agg(F.array_sort(F.collect_list(F.when(F.col("there"), one))).alias("x"), F.count_if(F.col("there").isNull()).alias("missing"))
    rows = patterns.drop("evidence").join(grouped, [group, "place"]).withColumn("evidence", F.transform("x", lambda y: y["item"])).drop("x")
    signature = F.to_json(F.struct(F.lit(PATTERN_SCHEMA).alias("schemaVersion"), F.col(group).alias("genre"), "dimension", "classification", "guidance", F.col("commercial_function").alias("commercialFunction"), "evidence"))
    sources = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["sourceId"])))
    return rows.withColumns({"source_ids": sources, "pattern_id": F.concat(F.lit("pattern-"), F.substring(F.sha2(T.canonical_json(signature), 256), 1, 24))})


def profile_engines(engines: DataFrame, observations: DataFrame, group: str = "genre") -> DataFrame:
    """Each source's commercial engine with its evidence by span, its signature and an id that follows from it.

    engines: group, source_id, the fields of MECHANISM, and evidence (struct of an observation id for each band);
    observations as for profile_patterns. `missing` counts spans without an observation of the source.
    """
    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(span).alias("span"), F.col(f"evidence.{span}").alias("observation_id")) for i, span in enumerate(BANDS)])
    named = engines.select(group, "source_id", F.explode(spans).alias("e")).select(group, "source_id", "e.*")
    seen = observations.select("source_id", "observation_id", "segment_id", "kind", _ordered("selectors").alias("s"), F.lit(True).alias("there"))
    found = named.join(seen, ["source_id", "observation_id"], "left")
    ranges = F.transform("s", lambda x: F.struct(F.lit("utf8-byte").alias("type"), x["start_byte"].alias("startByte"), x["end_byte"].alias("endByte")))
    item = F.struct("i", F.struct(F.col("source_id").alias("sourceId"), F.col("observation_id").alias("observationId"), F.col("segment_id").alias("segmentId"), "kind", "span", ranges.alias("selectors")).alias("item"))
    evidence = found.groupBy(group, "source_id").agg(F.array_sort(F.collect_list(F.when(F.col("there"), item))).alias("x"), F.count_if(F.col("there").isNull()).alias("missing"))
    signed = engines.select(group, "source_id", F.struct(*T.MECHANISM).alias("mechanism"), T.mechanism_signature([F.col(c) for c in T.MECHANISM], F.col("source_id").cast("string")).alias("signature_sha256"))
    rows = signed.join(evidence, [group, "source_id"]).withColumn("engine_id", F.concat(F.lit("engine-"), F.substring("signature_sha256", 1, 24)))
    return rows.select(group, "source_id", "engine_id", "mechanism", "signature_sha256", F.transform("x", lambda y: y["item"]).alias("evidence"), "missing")


def engine_violations(engines: DataFrame, sources: DataFrame, group: str = "genre", most: int = 3) -> DataFrame:
    """group, source_id and rule: one engine for each source of the group and no other, distinct ids, whole evidence.

    engines as profile_engines gives them; sources: group, source_id.
    """
    times = engines.groupBy(group, "source_id").agg(F.count("*").alias("times"), F.max("missing").alias("missing"), F.max("engine_id").alias("engine_id"))
    shared = engines.groupBy(group, "engine_id").agg(F.count("*").alias("sharing"))
    both = sources.select(group, "source_id", F.lit(True).alias("bound")).distinct().join(times, [group, "source_id"], "full").join(shared, [group, "engine_id"], "left")
    checks = {"unbound-source": F.col("bound").isNull(), "no-engine": F.col("times").isNull(), "repeated-source": F.coalesce(F.col("times") > 1, F.lit(False)), "repeated-id": F.coalesce((F.col("sharing") > 1) & (F.col("times") == 1), F.lit(False)), "missing-span": F.coalesce(F.col("missing") > 0, F.lit(False))}
    count = sources.groupBy(group).agg(F.countDistinct("source_id").alias("n")).where(F.col("n") != most).select(group, F.lit(None).cast(sources.schema["source_id"].dataType).alias("source_id"), F.lit("wrong-count").alias("rule"))
    return _rules(both, checks, group, "source_id").unionByName(count)


# The routing catalogue's schema, and what it may and may not do.
ROUTING_SCHEMA = "genre-soul-reference-routing-catalog/v1"
ROUTING_AUTHORITY = {"scope": "reference-lab-advisory-only", "mayWriteInkOSCanon": False, "mayActivateRetrieval": False, "mayPromoteSoul": False, "ownerDecisionRequired": True}


def routing_catalogue(profiles: DataFrame, routes: DataFrame, group: str = "genre") -> DataFrame:
    """group and catalogue (JSON): a profile's candidate routes in their places, each planned and none active, and its digest.

    profiles: group, soul_id, version, profile_path, profile_sha256, input_sha256; routes: group, place, role, source_id, rationale.
    """
    needs = F.create_map(*[F.lit(x) for pair in ROLE_BASIS.items() for x in pair])
    one = F.struct("role", F.col("source_id").alias("sourceId"), needs[F.col("role")].alias("selectionBasis"), "rationale", F.lit(True).alias("planned"), F.lit(False).alias("retrievalActive"))
    listed = routes.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", one.alias("route")))), lambda x: x["route"]).alias("routes"))
    body = F.struct(
        F.lit(ROUTING_SCHEMA).alias("schemaVersion"), F.lit("candidate").alias("state"), F.col(group).cast("string").alias("genre"), F.col("soul_id").alias("soulId"), "version",
        F.struct(F.col("profile_path").alias("path"), F.col("profile_sha256").alias("sha256")).alias("profile"), F.coalesce("routes", F.array().cast(listed.schema["routes"].dataType)).alias("routes"),
        F.struct(*[F.lit(v).alias(k) for k, v in ROUTING_AUTHORITY.items()]).alias("authority"), F.col("input_sha256").alias("privateRunInputDigest"),
    )
    rows = profiles.join(listed, group, "left").select(group, T.canonical_json(F.to_json(body, {"ignoreNullFields": "false"})).alias("catalogue"))
    return rows.withColumn("sha256", F.sha2("catalogue", 256))


def profile_dimensions(patterns: DataFrame, group: str = "genre") -> DataFrame:
    """Per group and dimension, in the fixed order, the sorted ids of its patterns; none is left out."""
    every = patterns.select(group).distinct().select(group, F.posexplode(F.array(*map(F.lit, DIMENSIONS))).alias("place", "dimension"))
    ids = patterns.groupBy(group, "dimension").agg(F.array_sort(F.collect_list("pattern_id")).alias("pattern_ids"))
    return every.join(ids, [group, "dimension"], "left").withColumn("pattern_ids", F.coalesce("pattern_ids", F.array().cast("array<string>")))


def semantic_subset(findings: DataFrame, wanted: DataFrame, group: str, finding: str = "finding_id", body: str = "body") -> DataFrame:
    """Per group the wanted findings in order of their ids, as a list of bodies, and the digest of the list."""
    rows = findings.join(wanted.select(group, finding).distinct(), [group, finding], "left_semi")
    listed = F.array_sort(F.collect_list(F.struct(finding, body)))
    out = rows.groupBy(group).agg(listed.alias("x"))
    return out.select(group, F.transform("x", lambda y: y[finding]).alias("finding_ids"), F.sha2(F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y[body]), ","), F.lit("]")), 256).alias("set_sha256"))


#: Fixed value: what names a packet, and isn't part of what its digest covers.
PACKET_NAMES = ("schemaVersion", "packetId", "packetSha256")


@F.pandas_udf(StructType([StructField("schema_ok", BooleanType()), *[StructField(c, StringType()) for c in ("packet_id", "packet_sha256", "sha256")]]))
def _packet(packet: pd.Series) -> pd.DataFrame:
    out = []
    for raw in packet:
        try:
            value = json.loads(raw)
        except (TypeError, ValueError):
            value = None
        if not isinstance(value, dict):
            out.append((False, None, None, None))
            continue
        body = json.dumps({k: v for k, v in value.items() if k not in PACKET_NAMES}, ensure_ascii=False, separators=(",", ":"))
        text = lambda k: value.get(k) if isinstance(value.get(k), str) else None
        out.append((value.get("schemaVersion") == PACKET_SCHEMA, text("packetId"), text("packetSha256"), hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()))
    return pd.DataFrame(out, columns=["schema_ok", "packet_id", "packet_sha256", "sha256"])


def packet_identity(packets: DataFrame, key: str, packet: str = "packet") -> DataFrame:
    """Per packet (JSON text): the digest of what it holds besides its names, and whether schema, id and digest agree with it."""
    rows = packets.select(key, _packet(F.col(packet)).alias("p"))
    same = F.col("p.schema_ok") & (F.col("p.packet_sha256") == F.col("p.sha256")) & (F.col("p.packet_id") == F.concat(F.lit("frp-"), F.substring("p.sha256", 1, 24)))
    return rows.select(key, F.col("p.sha256").alias("sha256"), F.coalesce(same, F.lit(False)).alias("genuine"))


def owner_outcome(decisions: DataFrame, group: str, decision: str = "decision") -> DataFrame:
    """rejected where any finding is to be protected, else approved."""
    return decisions.groupBy(group).agg(F.when(F.bool_or(F.coalesce(F.col(decision) == "protected-reject", F.lit(False))), "rejected").otherwise("approved").alias("outcome"))


def usage_totals(outputs: DataFrame, group: str) -> DataFrame:
    """Per group: exact reads, tokens and calls over its outputs; what an output doesn't tell counts as none."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c)
    return outputs.groupBy(group).agg(F.count("*").alias("segments"), total("exact_read_count"), total("total_tokens"), total("api_calls"))


def candidate_counts(evaluations: DataFrame, group: str) -> DataFrame:
    """Per group: neutrality violations of each candidate in order of their ids, contradictions and leaks of all.

    evaluations: group, candidate, violations, contradictions, leaks (arrays; null counts as empty).
    """
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    one = F.array_sort(F.collect_list(F.struct("candidate", n("violations").alias("n"))))
    rows = evaluations.groupBy(group).agg(one.alias("x"), F.sum(n("contradictions")).alias("contradictions"), F.sum(n("leaks")).alias("leaks"))
    return rows.select(group, F.map_from_entries("x").alias("violations"), "contradictions", "leaks")
