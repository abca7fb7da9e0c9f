"""Invariants of packs, core manifests and whole works, as tables of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import written
from . import evidence as E

# Fixed values of a reference pack.
CHAPTERS, ARCS, PHASES, SAMPLES = 751, 131, 5, 15
SOURCE_FIELDS = r'"(?:text|quote|excerpt|prose|topPatterns)"\s*:'
# Fixed values of a core manifest.
CORE = {
    "version": 1, "id": "chaebol-reference-core-v1", "bindingPolicy": "opt-in-per-book", "stylePolicy": "separate-style-guide-and-profile",
    "routingPolicy": "primary-chassis-plus-secondary-event-bank", "similarityPolicy": "do-not-penalize-industry-event-order-or-reward-similarity",
    "directCopyPolicy": "forbid-verbatim-prose-fictional-proper-nouns-and-dialogue",
}
ROLES, CARDS, LEAST_EVIDENCE = ("Spine", "Engine", "Payoff", "Emotion", "Hook", "Wildcard"), 6, 2
CARD_MARKERS = ("## 목적", "## 입력 조건", "## 재사용 판단", "## 장면 표면", "## 출력 계약", "## 실패 신호", "## 직접 전사 금지", "## 근거와 승인")
CARD_BYTES = 1_500


def _listed(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(rule)) for rule, c in checks.items()]))
    return rows.select(key, F.explode(found).alias("rule"))


def _is(document: Column, path: str, want: bool | int | str) -> Column:
    """Whether the value at a path of a variant is `want`, in type and value: "1" isn't 1. 1.0 is, as JSON has one kind of number."""
    found = F.try_variant_get(document, f"$.{path}", "variant")
    if isinstance(want, bool) or isinstance(want, str):
        same = F.schema_of_variant(found).eqNullSafe(F.lit("BOOLEAN" if isinstance(want, bool) else "STRING")) & F.try_variant_get(document, f"$.{path}", "boolean" if isinstance(want, bool) else "string").eqNullSafe(F.lit(want))
    else:
        same = F.schema_of_variant(found).rlike(r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$") & F.try_variant_get(document, f"$.{path}", "double").eqNullSafe(F.lit(float(want)))
    return F.coalesce(same, F.lit(False))


def pack_violations(packs: DataFrame, key: str, pack: str = "pack") -> DataFrame:
    """packs: key, pack (JSON text). A row for each invariant of a reference pack that a pack breaks."""
    v = F.try_parse_json(F.col(pack))
    size = lambda path: F.size(F.try_variant_get(v, f"$.{path}", "array<variant>"))
    other = lambda path, want: ~_is(v, path, want)
    count = lambda path, want: ~F.coalesce(size(path) == want, F.lit(False))
    policy = "commercialPolicy.minimumDistanceScore"
    spaced = F.regexp_replace(pack, r"\s+", " ")
    checks = {
        "identity": other("version", 1) | other("kind", "reference-transformation-pack"), "language": other("language", "ko"),
        "chapter-count": other("source.chapterCount", CHAPTERS), "arc-count": other("source.naturalArcCount", ARCS),
        "phase-count": count("phases", PHASES), "indexed-chapters": other("storyRetrieval.indexedChapterCount", CHAPTERS), "sample-count": count("styleRetrieval.samples", SAMPLES),
        "similarity-penalty": other("commercialPolicy.similarityPenalty", False),
        "distance-score": ~F.coalesce(F.is_variant_null(F.try_variant_get(v, f"$.{policy}", "variant")), F.lit(False)),
        "source-bearing-fields": spaced.rlike(SOURCE_FIELDS),
    }
    return _listed(packs, key, checks)


_EVIDENCE = "array<struct<workSlug:string,status:string,qa:string,referenceCard:string>>"
_CARDS = "array<struct<id:string,status:string,path:string,roles:array<string>>>"


def manifest_violations(manifests: DataFrame, key: str, manifest: str = "manifest") -> DataFrame:
    """manifests: key, manifest (JSON text). key, rule and item for each invariant of a core manifest that is broken."""
    schema = f"struct<productionEvidence:{_EVIDENCE},cards:{_CARDS}>"
    v = F.try_parse_json(F.col(manifest))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    stated = F.struct(*[_is(v, c, want).alias(c) for c, want in CORE.items()])
    rows = manifests.select(key, F.when(is_object, F.from_json(manifest, schema)).alias("m"), stated.alias("is"))
    missing = rows.where("m is null").select(key, F.lit("not-an-object").alias("rule"), F.lit(None).cast("string").alias("item"))
    rows = rows.where("m is not null")
    checks = {f"other:{c}": ~F.col(f"is.{c}") for c in CORE}
    checks["too-little-evidence"] = ~F.coalesce(F.size("m.productionEvidence") >= LEAST_EVIDENCE, F.lit(False))
    six = F.coalesce(F.size("m.cards") == CARDS, F.lit(False))
    checks["card-count"] = ~six
    whole = _listed(rows, key, checks).withColumn("item", F.lit(None).cast("string"))
    proof = rows.select(key, F.explode("m.productionEvidence").alias("e")).withColumn("item", F.coalesce("e.workSlug", F.lit("unknown")))
    not_this = lambda c, want: ~F.col(c).eqNullSafe(F.lit(want))
    proven = {"evidence-not-approved": not_this("e.status", "GOLD_APPROVED"), "evidence-qa": not_this("e.qa", "15/15 PASS"), "evidence-card": ~F.coalesce(F.col("e.referenceCard").endswith("gold_reference_card.md"), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in proven.items()]))
    proof = proof.select(key, F.explode(found).alias("rule"), "item")
    cards = rows.where(six).select(key, F.posexplode("m.cards").alias("place", "c")).select(key, "place", "c.*")
    earlier = lambda c: F.row_number().over(W.partitionBy(key, c).orderBy("place")) > 1
    cards = cards.withColumns({"id_again": earlier("id"), "path_again": earlier("path")})
    path = F.col("path")
    safe = path.startswith("materials/") & ~F.contains(path, F.lit("..")) & ~path.startswith("/")
    roles = (F.size("roles") > 0) & (F.size(F.array_except("roles", F.array(*map(F.lit, ROLES)))) == 0)
    of_card = {
        "card-id": ~F.coalesce(F.col("id").rlike(r"^CHB-CORE-0[1-6]\z"), F.lit(False)), "card-id-again": F.col("id_again"), "card-not-ready": not_this("status", "production_ready"),
        "card-path": ~F.coalesce(safe, F.lit(False)), "card-path-again": F.col("path_again"), "card-roles": ~F.coalesce(roles, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(rule)) for rule, c in of_card.items()]))
    cards = cards.select(key, F.explode(found).alias("rule"), F.coalesce("id", F.lit("missing")).alias("item"))
    return E.union([missing, whole, proof, cards])


def card_violations(cards: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Cards' texts: the first heading names the card, enough bytes, every section, no path of a private source."""
    body = F.coalesce(F.col(text), F.lit(""))
    checks = {"heading": ~body.startswith(F.concat(F.lit("# "), F.col(key))), "too-short": F.octet_length(body) < CARD_BYTES, "private-path": F.contains(body, F.lit("private_sources/"))}
    checks |= {f"missing:{m}": ~F.contains(body, F.lit(m)) for m in CARD_MARKERS}
    return _listed(cards, key, checks)


# Fixed values of a whole work: columns whose repeats are told, scores, weights, formulas of pacing notes.
REPEATS = {
    "chapters": ("entry_state", "reader_promise", "protagonist_goal", "resistance_or_cost", "paid_reward", "state_change", "closed_loops", "opened_loops"),
    "arcs": ("main_characters", "main_locations", "central_question", "promise", "pressure_escalation", "relationship_change", "status_or_ability_change", "residual_cost", "boundary_signals"),
    "pacing": ("pacing_note",),
}
SCORES = ("tension_1_10", "reward_1_10", "hook_1_10")
WEIGHTS = ("information_weight", "action_weight", "relationship_weight", "emotion_weight", "material_or_status_weight")
FORMULAS = (("pacing_note", "다음 추진=", 0.25), ("concrete_event", rf"[{T.SPACE}]→[{T.SPACE}]", 0.6))


def mixed_scales(rows: DataFrame, group: str, values: list[Column]) -> DataFrame:
    """Per group: how many rows are of each scale, of none and not numeric, and whether more than one scale is in use."""
    scale = E.row_scale(values)
    ok = F.coalesce(E.scale_sum_ok(scale, values), F.lit(False))
    one = {"non_numeric": scale == "non-numeric", "invalid": scale == "invalid", "intensity": scale == "intensity", "ratio": scale == "ratio", "percentage": scale == "percentage"}
    bad = {"bad_ratio_sums": (scale == "ratio") & ~ok, "bad_percentage_sums": (scale == "percentage") & ~ok}
    out = rows.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in {**one, **bad}.items()])
    used = sum((F.col(c) > 0).cast("int") for c in ("intensity", "ratio", "percentage"))
    return out.withColumn("mixed", used > 1)


def _numbered(c: str) -> Column:
    return T.strict_number(F.col(c))


def _covering_arcs(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, row_no, expected_arc: of the arcs that cover a row's chapter the one that begins last.

    Spans of any length are cut into aligned blocks of powers of two, at most two of a size, and a chapter lies in one
    block of each size that occurs: an equi-join of a few rows for each side, however long arcs are.
    """
    ends = lambda c: F.col(c).cast("decimal(20,0)").cast("long")
    whole = spans.where("e >= s and s % 1 = 0 and e % 1 = 0 and abs(s) < 1e15 and abs(e) < 1e15").select(key, "arc_id", F.struct("s", "row_no").alias("o"), ends("s").alias("a"), (ends("e") + 1).alias("b"))
    # Block (k, i) holds the chapters i * 2^k to (i + 1) * 2^k - 1. It is taken if it lies within the span and its double doesn't.
    level = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k")).withColumn("w", F.expr("shiftleft(1L, k)")).where("w <= b - a")
    up = level.withColumns({"lo": F.expr("-floor(-a / w)").cast("long"), "hi": F.expr("floor(b / w)").cast("long")})
    inside = lambda i: (F.expr("2 * w") * F.floor(i / 2) >= F.col("a")) & (F.expr("2 * w") * (F.floor(i / 2) + 1) <= F.col("b"))
    edges = F.filter(F.array_distinct(F.array("lo", F.col("lo") + 1, F.col("hi") - 1, F.col("hi") - 2)), lambda i: (i >= F.col("lo")) & (i < F.col("hi")) & ~inside(i))
    blocks = up.select(key, "arc_id", "o", "k", F.explode(edges).alias("i"))
    sizes = F.array(*[F.lit(r["k"]) for r in blocks.select("k").distinct().collect()]).cast("array<int>")  # 51 at most
    at = rows.where("sequence_no % 1 = 0 and abs(sequence_no) < 1e15").select(key, "row_no", ends("sequence_no").alias("q"), F.explode(sizes).alias("k")).withColumn("i", F.expr("floor(q / shiftleft(1L, k))").cast("long"))
    return at.join(blocks, [key, "k", "i"]).groupBy(key, "row_no").agg(F.max_by("arc_id", "o").alias("expected_arc"))


def _parts(rows: DataFrame) -> int:
    """Said outright, so that partitions aren't made larger than the sorts of their windows hold in memory."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _spans(arcs: DataFrame, key: str) -> DataFrame:
    """arcs with their numbers s, e and n, the start that the arc before asks for, and whether their id is a repeat."""
    spans = arcs.select(key, "row_no", "arc_id", _numbered("start_sequence").alias("s"), _numbered("end_sequence").alias("e"), _numbered("episode_count").alias("n")).repartition(_parts(arcs), key)
    order = W.partitionBy(key).orderBy(F.col("s").asc_nulls_last(), "row_no")
    return written(spans.withColumns({"expected": F.coalesce(F.lag("e").over(order) + 1, F.lit(1.0)), "again": F.row_number().over(W.partitionBy(key, "arc_id").orderBy(F.col("s").asc_nulls_last(), "row_no")) > 1}))


def _told(rows: DataFrame, key: str, checks: list[tuple[Column, Column | str, Column]], severity: str) -> DataFrame:
    """key, severity, rule, detail of the checks (condition, rule, detail) that fail, all in one pass."""
    one = lambda c, rule, detail: F.when(c, F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))
    return rows.select(key, F.lit(severity).alias("severity"), F.explode(F.array_compact(F.array(*[one(*c) for c in checks]))).alias("x")).select(key, "severity", "x.*")


def _judged(chapters: DataFrame, pacing: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, name, row_no, sequence, arc_id, place, known, q, expected_arc, deep: rows of both tables against the arcs.

    Rows and arcs meet in one shuffle by work; places, known ids and the arc that began last come from windows in
    it. `deep`: that arc ended before the row, but an earlier one may still cover it.
    """
    number = _numbered("sequence")
    rows = E.union([t.select(key, F.lit(n).alias("name"), "row_no", "sequence", "arc_id", F.when((number % 1 == 0) & (F.abs(number) < 1e15), number).alias("q"), F.lit(None).cast("double").alias("e")) for n, t in (("chapters", chapters), ("pacing", pacing))])
    fits = F.expr("e >= s and s % 1 = 0 and e % 1 = 0 and abs(s) < 1e15 and abs(e) < 1e15")
    both = rows.unionByName(spans.select(key, F.lit("").alias("name"), "row_no", F.lit(None).cast("string").alias("sequence"), "arc_id", F.when(fits, F.col("s")).alias("q"), F.when(fits, F.col("e")).alias("e"))).repartition(_parts(spans), key)
    is_arc, so_far = F.col("name") == "", W.partitionBy(key).orderBy(F.col("q").asc_nulls_first(), "name", "row_no").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumns({
        "place": F.row_number().over(W.partitionBy(key, "name").orderBy("row_no")),
        "known": F.max(is_arc).over(W.partitionBy(key, "arc_id")) & F.col("arc_id").isNotNull() & F.col(key).isNotNull(),
        "last": F.last(F.when(F.col("e").isNotNull(), F.struct("e", "arc_id")), True).over(so_far), "reach": F.max("e").over(so_far),
    }).where(~is_arc)
    asked = F.col("q").isNotNull() & F.col(key).isNotNull()
    expected, deep = F.when(asked & (F.col("last.e") >= F.col("q")), F.col("last.arc_id")), F.coalesce(asked & (F.col("last.e") < F.col("q")) & (F.col("reach") >= F.col("q")), F.lit(False))
    return both.select(key, "name", "row_no", "sequence", "arc_id", "place", "known", "q", expected.alias("expected_arc"), deep.alias("deep"))


def work_errors(works: DataFrame, chapters: DataFrame, arcs: DataFrame, pacing: DataFrame, key: str = "work", spans: DataFrame | None = None) -> DataFrame:
    """The errors of work_violations."""
    spans = _spans(arcs, key) if spans is None else spans
    whole = lambda c: c.isNotNull() & (c % 1 == 0)
    s, e, arc_id = F.col("s"), F.col("e"), F.col("arc_id")
    out = [_told(spans, key, [
        (F.coalesce(arc_id, F.lit("")) == "", "arcs:no-id", F.col("row_no")), (F.col("again"), "arcs:id-again", arc_id), (~s.eqNullSafe(F.col("expected")), "arcs:start", arc_id),
        (~F.coalesce(whole(e) & (e >= s), F.lit(False)), "arcs:end", arc_id), (~F.col("n").eqNullSafe(e - s + 1), "arcs:episode-count", arc_id),
    ], "error")]
    last = works.join(spans.groupBy(key).agg(F.max_by("e", F.struct("s", "row_no")).alias("last")), key, "left")
    out.append(_told(last, key, [(~F.coalesce(F.col("last"), F.lit(0.0)).eqNullSafe(F.col("marker_count").cast("double")), "arcs:coverage", F.col("last").cast("long"))], "error"))
    # Only what a rule tells, or is still open, keeps its cells.
    judged = _judged(chapters, pacing, spans, key)
    of = lambda rule: F.concat("name", F.lit(rule))
    other = F.coalesce(F.col("expected_arc").isNotNull() & ~arc_id.eqNullSafe(F.col("expected_arc")), F.lit(False))
    found = {"sequence_off": ~_numbered("sequence").eqNullSafe(F.col("place").cast("double")), "unknown": ~F.coalesce("known", F.lit(False)), "other": other}
    judged = judged.withColumns(found)
    open_, shown = F.col("deep"), lambda c, when: F.when(when, F.col(c)).alias(c)
    some = F.col("sequence_off") | F.col("unknown") | F.col("other") | open_
    judged = written(judged.select(key, "name", shown("row_no", open_), shown("sequence", some), shown("arc_id", F.col("unknown") | open_), shown("q", open_), "deep", *found))
    counts = judged.groupBy(key).agg(*[F.count_if(F.col("name") == n).alias(n) for n in ("chapters", "pacing")])
    counts = works.join(counts, key, "left").fillna(0, ["chapters", "pacing"])
    out.append(_told(counts, key, [(F.col(n) != F.col("marker_count"), f"{n}:row-count", F.col(n)) for n in ("chapters", "pacing")], "error"))
    out.append(_told(judged, key, [(F.col("sequence_off"), of(":sequence"), F.col("sequence")), (F.col("unknown"), of(":unknown-arc"), arc_id), (F.col("other"), of(":other-arc"), F.col("sequence"))], "error"))
    deep = judged.where("deep")
    if not deep.isEmpty():  # overlapping arcs
        for name in ("chapters", "pacing"):
            rows = deep.where(F.col("name") == name)
            laid = rows.join(_covering_arcs(rows.select(key, "row_no", F.col("q").alias("sequence_no")), spans, key), [key, "row_no"])
            out.append(_told(laid, key, [(F.col("expected_arc").isNotNull() & ~arc_id.eqNullSafe(F.col("expected_arc")), f"{name}:other-arc", F.col("sequence"))], "error"))
    return E.union(out)


def work_warnings(works: DataFrame, chapters: DataFrame, arcs: DataFrame, pacing: DataFrame, key: str = "work", spans: DataFrame | None = None) -> DataFrame:
    """The warnings of work_violations."""
    spans = _spans(arcs, key) if spans is None else spans
    by = lambda rows, names, value: rows.select(F.col(key), "row_no", F.explode(F.array(*[F.struct(F.lit(f"{said}").alias("rule"), value(c).alias("value")) for said, c in names])).alias("x")).select(F.struct(F.col(key).alias("key"), F.col("x.rule").alias("rule")).alias("_g"), "row_no", F.col("x.value").alias("value"))
    back = lambda rows, check, detail: _told(rows.withColumn(key, F.col("_g.key")), key, [(check, F.col("_g.rule"), detail)], "warning")
    cells = E.union([by(rows, [(f"{name}:repeated:{c}", c) for c in REPEATS[name]], lambda c: F.col(c).cast("string")) for name, rows in (("chapters", chapters), ("arcs", arcs), ("pacing", pacing))])
    out = [back(E.modal_value(cells, "_g", "value", "row_no"), F.col("warned"), F.col("count"))]
    scores = by(pacing, [(f"pacing:scores:{c}", c) for c in SCORES], _numbered)
    out.append(back(E.score_shape(scores, "_g", "value"), F.col("verdict") != "ok", F.col("verdict")))
    # Numbers first: in the sums each would be read anew wherever it is named.
    scales = mixed_scales(pacing.select(key, *[_numbered(c).alias(c) for c in WEIGHTS]), key, [F.col(c) for c in WEIGHTS])
    uneven = [(F.col(c) > 0, f"pacing:weights:{c}", F.col(c)) for c in ("non_numeric", "invalid", "bad_ratio_sums", "bad_percentage_sums")]
    out.append(_told(scales, key, [*uneven, (F.col("mixed"), "pacing:weights:mixed", F.concat_ws(":", "intensity", "ratio", "percentage"))], "warning"))
    n = F.col("n")
    fair = spans.groupBy(key).agg(F.bool_and(F.coalesce(n.isNotNull() & (n % 1 == 0) & (n >= 1), F.lit(False))).alias("fair")).where("fair")
    shape = E.length_shape(spans.join(fair, key, "left_semi"), key, "n")
    out.append(_told(shape, key, [(F.col("packet_like"), "arcs:packet-like", F.col("short"))], "warning"))
    for column, pattern, share in FORMULAS:
        told = E.formula_frequency(pacing, key, column, pattern, share)
        out.append(_told(told, key, [(F.col("formulaic"), f"pacing:formula:{column}", F.col("hits"))], "warning"))
    return E.union(out)


def work_violations(works: DataFrame, chapters: DataFrame, arcs: DataFrame, pacing: DataFrame, key: str = "work") -> DataFrame:
    """key, severity, rule, detail: a work's three tables (all cells strings) against each other and its number of chapters.

    works: key, marker_count; each table: key, row_no (place in its file), and its own columns. They are read several
    times, so a caller gives tables that are cheap to read.
    """
    spans = _spans(arcs, key)
    return work_errors(works, chapters, arcs, pacing, key, spans).unionByName(work_warnings(works, chapters, arcs, pacing, key, spans))
