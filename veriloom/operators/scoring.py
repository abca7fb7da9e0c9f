"""Scores, verdict lattices and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up


def commercial_score(main: list[Column], side: list[Column]) -> Column:
    """0.7 of the mean of the main scores and 0.3 of the mean of the others, to one digit; null outside 0 to 100."""
    mean = lambda xs: sum(xs[1:], xs[0]) / float(len(xs))
    fine = F.lit(True)
    for x in [*main, *side]:
        fine = fine & x.between(0, 100)
    return F.when(fine, round_half_up(0.7 * mean(main) + 0.3 * mean(side), 1))


def collective_verdict(rows: DataFrame, group: str, verdict: str) -> DataFrame:
    """contradicted before insufficient before supported."""
    rank = F.when(F.col(verdict) == "contradicted", 2).when(F.col(verdict) == "insufficient", 1).otherwise(0)
    return rows.groupBy(group).agg(F.max(rank).alias("r")).select(group, F.element_at(F.array(*map(F.lit, ("supported", "insufficient", "contradicted"))), F.col("r") + 1).alias("verdict"))


def phase_verdicts(samples: DataFrame, group: str, contribution: str, fields: str, canonical: list[str]) -> DataFrame:
    """A source's verdict from its phase samples: any contradiction, then any gap in contributions or fields."""
    says = lambda v: F.bool_or(F.col(contribution) == v)
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list(fields))))
    out = samples.groupBy(group).agg(says("contradicts").alias("c"), says("insufficient").alias("i"), union.alias("fields"))
    whole = F.col("fields") == F.array(*map(F.lit, sorted(canonical)))
    return out.select(group, "fields", F.when(F.col("c"), "contradicted").when(F.col("i") | ~whole, "insufficient").otherwise("supported").alias("verdict"))


def comparison_violations(compared: DataFrame, sources: DataFrame, group: str, left: str, right: str, verdict: str, source: str, signature: str) -> DataFrame:
    """Missing, repeated or disordered pairs of a group's sources, and distinct variants with one signature."""
    a = sources.select(group, F.col(source).alias(left), F.col(signature).alias("ls"))
    b = sources.select(group, F.col(source).alias(right), F.col(signature).alias("rs"))
    want = a.join(b, group).where(F.col(left) < F.col(right))
    times = compared.groupBy(group, left, right).agg(F.count("*").alias("times"), F.max(verdict).alias("v"))
    both = want.join(times, [group, left, right], "full")
    rule = F.when(F.col("ls").isNull(), "unbound-pair").when(F.col("times").isNull(), "missing-pair").when(F.col("times") > 1, "repeated-pair").when((F.col("v") == "distinct-variant") & (F.col("ls") == F.col("rs")), "same-mechanism")
    return both.select(group, left, right, rule.alias("rule")).where("rule is not null")


def reasoned_verdict(rows: DataFrame, group: str, reasons: dict[str, Column]) -> DataFrame:
    """Sorted codes of the reasons that hold for some row, and fail where there is any."""
    flags = rows.groupBy(group).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(k) for k, c in reasons.items()])
    codes = F.array_compact(F.array(*[F.when(F.col(k), F.lit(k)) for k in sorted(reasons)]))
    return flags.select(group, codes.alias("reasons"), F.when(F.size(codes) > 0, "fail").otherwise("pass").alias("verdict"))


def outcome(rows: DataFrame, group: str, verdict: str, blocking: str, open_: str) -> DataFrame:
    """Counts of verdicts; blocked before pending_hil before pass."""
    v = F.col(verdict)
    out = rows.groupBy(group).agg(F.count_if(v == blocking).alias("blocking"), F.count_if(v == open_).alias("open"), F.count("*").alias("n"))
    return out.withColumn("outcome", F.when(F.col("blocking") > 0, "blocked").when(F.col("open") > 0, "pending_hil").otherwise("pass"))


def effective_decisions(decisions: DataFrame, coverage: DataFrame, key: str, decision: str, complete: str) -> DataFrame:
    """A decision whose windows weren't complete counts as uncertain."""
    rows = decisions.join(coverage.select(key, complete), key, "left")
    return rows.withColumn("effective", F.when(F.coalesce(F.col(complete), F.lit(False)), F.col(decision)).otherwise("uncertain"))


def support_rule(classification: Column, sources: Column) -> Column:
    """Whether the number of sources fits: common 3, conditional 2-3, specific 1, failure 1-3."""
    return F.when(classification == "common", sources == 3).when(classification == "conditional", sources.between(2, 3)).when(classification == "specific", sources == 1).when(classification == "failure", sources.between(1, 3)).otherwise(False)


def promotion(rows: DataFrame, group: str, pair: str, gain: str, score: str, leaks: str) -> DataFrame:
    """Promotion thresholds per group: three pairs, two wins, mean 85, least winning gain 2, no leaks; each as a gate."""
    win = F.col(gain) > 0
    out = rows.groupBy(group).agg(F.countDistinct(pair).alias("pairs"), F.count_if(win).alias("wins"), F.avg(score).alias("mean_score"), F.min(F.when(win, F.col(gain))).alias("least_gain"), F.sum(leaks).cast("long").alias("leaks"))
    gates = {"pairs_ok": F.col("pairs") == 3, "wins_ok": F.col("wins") >= 2, "score_ok": F.col("mean_score") >= 85, "gain_ok": F.coalesce(F.col("least_gain") >= 2, F.lit(False)), "leaks_ok": F.col("leaks") == 0}
    out = out.withColumns(gates)
    return out.withColumn("eligible", F.col("pairs_ok") & F.col("wins_ok") & F.col("score_ok") & F.col("gain_ok") & F.col("leaks_ok"))


#: Fixed values of a promotion: lists of exactly three digests, and what else it must hold.
THREE_DIGESTS = ("review_packets", "blind_reviews", "content_neutral", "surface_comparisons")
PACKET_SCHEMA = "firefly_review_packet/v2"


def _digests(c: str, least: int, most: int | None = None) -> Column:
    """Whether an array holds sorted, different SHA-256 values, as many as asked for."""
    fine = (F.col(c) == F.array_sort(F.array_distinct(c))) & F.forall(c, lambda x: x.rlike("^[0-9a-f]{64}$")) & (F.size(c) >= least)
    return fine if most is None else fine & (F.size(c) <= most)


def _names(c: str, n: int) -> Column:
    return (F.col(c) == F.array_sort(F.array_distinct(c))) & (F.size(c) == n)


def promotion_violations(evidence: DataFrame, key: str) -> DataFrame:
    """key and rule: every condition that a promotion's evidence, a row of counts, flags and lists, doesn't meet; null meets none."""
    c = F.col
    holds = {
        "status": c("status") == "pass", "deep-reads": c("deep_read_sources") >= 3, "packet-schema": c("packet_schema") == PACKET_SCHEMA,
        "blind-pairs": (c("blind_pairs") == 3) & (c("blind_runs") == 3),
        "commercial": (c("soul_wins") >= 2) & (c("average_score") >= 85) & (c("least_gain") >= 2),
        "genre-identity": c("genre_identity_passed") == 3, "content-neutral": (c("neutral_violations") == 0) & (c("canon_writes") == 0),
        "surface": c("surface_classified") & (c("canon_leaks") == 0), "qa-and-leaks": c("manager_qa_passed") & (c("leak_matches") == 0),
        "owner-decision": c("owner_required") & c("owner_decision_id").isNull(),
        "authority": (c("authority.scope") == "analysis-only") & ~c("authority.may_write") & ~c("authority.may_promote") & c("authority.owner_required"),
        **{f"digests:{name}": _digests(name, 3, 3) for name in THREE_DIGESTS},
        "digests:deep_reads": _digests("deep_reads", 3), "digests:manager_qa": c("manager_qa_sha256").rlike("^[0-9a-f]{64}$"), "digests:leak_scan": c("leak_scan_sha256").rlike("^[0-9a-f]{64}$"),
        "runs": _names("generation_runs", 6) & _names("blind_run_ids", 3), "digests:inputs": _digests("inputs", 0),
    }
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in holds.items()]))
    return evidence.select(key, F.explode(broken).alias("rule"))


def admissible(recommendation: Column, confidence: Column) -> Column:
    return (recommendation == "keep") & confidence.between(0, 1)


def consistent(violations: Column, evidence: list[Column], passed: Column, complete: Column) -> Column:
    """passed exactly when nothing was violated, complete exactly when every evidence list holds something."""
    full = F.lit(True)
    for e in evidence:
        full = full & (F.size(e) > 0)
    return (passed == (F.size(violations) == 0)) & (complete == full)


def band_sample(selectors: DataFrame, group: str, band: str, selector: str, start: str, end: str, kind: str) -> DataFrame:
    """Three selectors of each band: the smallest, the smallest that brings a new kind, then the smallest left.

    selectors: one row for each selector and kind. Ties go by start, end and name.
    """
    from pyspark.sql import Window as W

    one = selectors.groupBy(group, band, selector).agg(F.min(start).alias("s"), F.min(end).alias("e"), F.array_sort(F.collect_set(kind)).alias("kinds"))
    by = [(F.col("e") - F.col("s")).asc(), F.col("s"), F.col("e"), F.col(selector)]
    ranked = one.withColumn("rank", F.row_number().over(W.partitionBy(group, band).orderBy(*by)))
    first = F.first("kinds").over(W.partitionBy(group, band).orderBy("rank"))
    fresh = (F.size(first) < 2) & (F.size(F.array_except("kinds", first)) > 0) & (F.col("rank") > 1)
    new = ranked.withColumn("fresh", fresh)
    second = F.min(F.when(F.col("fresh"), F.col("rank"))).over(W.partitionBy(group, band))
    turn = F.when(F.col("rank") == 1, 0).when(F.col("rank") == F.col("second"), 1).otherwise(2)
    placed = new.withColumn("second", second).withColumn("turn", turn)
    pick = F.row_number().over(W.partitionBy(group, band).orderBy("turn", "rank"))
    return placed.withColumn("pick", pick).where("pick <= 3").select(group, band, selector, "pick", "kinds")
