"""Terms that a text shows on its surface, and findings where candidates and samples share them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.nested import flatten
from ..shared import spread, written
from ..shipping import ship
from .overlap import MOST_CHARACTERS, automaton_of, contained, held_in, surface_copies, term_containment
from .surface import QUOTED, Surface, composed, runs, tokens  # noqa: F401

#: Tokens of which a worker keeps what they give, and terms that are broadcast to all workers, at most.
MOST_TOKENS, MOST_SHARED = 200_000, 200_000
#: Terms found, with their texts, in a batch.
_BATCH = 200_000


def _each(rows: DataFrame, key: str, text: str, reader) -> DataFrame:
    """kind, term, keys: the pairs that reader() makes of each text in NFC, in one pass over the texts, each with the texts of a batch that have it."""
    ship(rows.sparkSession)

    def run(batches):
        found = reader()

        def given(keys, held):
            ends = np.cumsum([0, *map(len, held.values())])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array([i for x in held.values() for i in x], pa.int64())))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in zip(*held)], lists], names=["kind", "term", "keys"])

        for batch in batches:
            held, n = {}, 0
            for i, value in enumerate(batch.column(1)):
                told = found(composed(value.as_py()))
                n += len(told)
                for pair in told:
                    if pair in held:
                        held[pair].append(i)
                    else:
                        held[pair] = [i]
                if n >= _BATCH:
                    yield given(batch.column(0), held)
                    held, n = {}, 0
            if held:
                yield given(batch.column(0), held)

    texts = rows.select(key, F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return texts.mapInArrow(run, f"kind string, term string, keys array<{rows.schema[key].dataType.simpleString()}>")


def _by_key(rows: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    return rows.select(F.explode("keys").alias(key), *columns)


def _terms(rows: DataFrame, key: str, text: str = "text", most_tokens: int = MOST_TOKENS) -> DataFrame:
    """surface_terms of rows as they are dealt; a term of a row comes once."""
    return _by_key(_each(rows, key, text, lambda: Surface(most_tokens).terms), key, "kind", "term")


def surface_terms(rows: DataFrame, key: str, text: str = "text", most_tokens: int = MOST_TOKENS) -> DataFrame:
    """key, kind, term.

    Kinds: exact, anchored (persons named by an attached role, exact terms of candidates only), person, surname,
    org_stem, org_full, attribution, quoted, latin. A text is read once, by the rules of surface.py.
    """
    return _terms(spread(rows.select(key, text)), key, text, most_tokens).distinct()


#: Which kinds of a candidate's and of a sample's terms a rule compares, each pair a class of its own.
CLASSES = {
    "p1": ("person-overlap", ["exact", "anchored"], ["person"]), "p2": ("person-overlap", ["person"], ["exact"]),
    "s": ("surname-overlap", ["surname"], ["surname"]),
    "o1": ("org-stem-overlap", ["exact", "anchored", "org_stem", "attribution"], ["org_stem"]), "o2": ("org-stem-overlap", ["org_stem"], ["exact", "org_stem", "attribution"]),
}
SHAPES = ["quoted", "latin", "org_full"]


def _classed(terms: DataFrame, side: int, *keep: str) -> DataFrame:
    """class, term and what is kept: a term for each class that its kind belongs to on this side."""
    classes = F.array_compact(F.array(*[F.when(F.col("kind").isin(c[side]), F.lit(name)) for name, c in CLASSES.items()]))
    return terms.select(F.explode(classes).alias("class"), "term", *keep)


def _rule() -> Column:
    return F.create_map(*[F.lit(x) for name, c in CLASSES.items() for x in (name, c[0])])[F.col("class")].alias("rule")


def _shape(terms: DataFrame) -> DataFrame:
    return terms.where(F.col("kind").isin(SHAPES) & (F.length("term") >= 2))


def _overlap() -> Column:
    return F.concat("kind", F.lit("-overlap")).alias("rule")


def _reader(keys, words, most_tokens: int):
    """What a candidate's text is asked for: its terms in the samples' classes (kind is the class), its shape terms, and the samples' shape terms that its form contains (no kind)."""

    def made():
        asked: dict[str, list] = {}
        shared: dict[str, set[str]] = {}
        for name, term in keys.value:
            shared.setdefault(name, set()).add(term)
        for name, terms in shared.items():
            for kind in CLASSES[name][1]:
                asked.setdefault(kind, []).append((name, terms))
        surface, automaton = Surface(most_tokens, asked | {kind: [(kind, None)] for kind in SHAPES}), automaton_of(words.value)
        return lambda text: [*surface.terms(text), *[("", term) for term in held_in(automaton, surface.form)]]

    return made


def _sides(candidates: DataFrame, samples: DataFrame, candidate: str, sample: str, text: str, most: int, most_tokens: int = MOST_TOKENS) -> tuple[DataFrame, ...]:
    """mine, a, held and theirs, b, other: of either side its terms by class that the other has, its shape terms, and the other's shape terms that its texts contain.

    The candidates' have keys, lists of candidates; a candidate may be in several, or twice. The samples' terms come first.
    Up to `most` of them are broadcast, and a candidate's text, read once, only gives what meets them, and its own shape
    terms; past that all of its terms are written and met by shuffles.
    """
    spark = candidates.sparkSession
    told = written(_terms(samples, sample, text).distinct())
    theirs, b = written(_classed(told, 2, sample).distinct()), _shape(told)
    keys, words = theirs.select("class", "term").distinct(), written(b.select("term").distinct())
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("c")).first()
    if keys.count() + size["n"] <= most and size["c"] <= MOST_CHARACTERS:
        shared = spark.sparkContext.broadcast([tuple(r) for r in keys.collect()]), spark.sparkContext.broadcast([r[0] for r in words.collect()])
        rows = written(_each(candidates, candidate, text, _reader(*shared, most_tokens)))
        mine, held = rows.where(F.col("kind").isin(list(CLASSES))).withColumnRenamed("kind", "class"), rows.where("kind = ''").select("term", "keys")
    else:
        rows = written(_each(candidates, candidate, text, lambda: Surface(most_tokens).terms))
        mine = written(_classed(rows, 1, "keys").join(keys, ["class", "term"], "left_semi"))
        held = written(contained(candidates, words, candidate, text).select("term", F.array(candidate).alias("keys")))
    a = _shape(rows)
    return mine, a, held, theirs, b, written(contained(samples, a.select("term").distinct(), sample, text))


def overlaps(candidates: DataFrame, samples: DataFrame, candidate: str, sample: str, text: str = "text", most: int = MOST_SHARED) -> DataFrame:
    """rule, term, candidate, sample of every ambiguous overlap.

    Shape terms (quoted, latin, org_full) are sought by containment in both directions, the others by equality.
    """
    mine, a, held, theirs, b, other = _sides(candidates, samples, candidate, sample, text, most)
    parts = [held.join(b, "term").select(_overlap(), "term", "keys", sample), a.join(other, "term").select(_overlap(), "term", "keys", sample), mine.join(theirs, ["class", "term"]).select(_rule(), "term", "keys", sample)]
    return reduce(lambda x, y: x.unionByName(y), parts).select("rule", "term", F.explode("keys").alias(candidate), sample).distinct()


def findings(candidates: DataFrame, samples: DataFrame, candidate: str, sample: str, text: str = "text", most: int = MOST_SHARED) -> DataFrame:
    """All ambiguous overlaps, rolled up by rule and term with sorted locations and references.

    In each class, and for each contained term, every candidate that has it meets every sample that has it. So the two
    sides are rolled up on their own, and the pairs are never made.
    """
    mine, a, held, theirs, b, other = _sides(candidates, samples, candidate, sample, text, most)
    one = lambda rows: rows.withColumn("keys", F.array(sample))
    places, sources = [mine.select(_rule(), "term", "keys")], []
    sources.append(one(theirs.join(mine.select("class", "term").distinct(), ["class", "term"], "left_semi")).select(_rule(), "term", "keys"))
    for found, terms, of_texts, own in ((held, one(b), places, sources), (one(other), a, sources, places)):
        met = terms.join(found.select("term").distinct(), "term", "left_semi")
        of_texts.append(found.join(met.select("kind", "term").distinct(), "term").select(_overlap(), "term", "keys"))
        own.append(met.select(_overlap(), "term", "keys"))
    rolled = lambda parts, name: reduce(lambda x, y: x.unionByName(y), parts).groupBy("rule", "term").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias(name))
    return rolled(places, "locations").join(rolled(sources, "references"), ["rule", "term"])


def candidate_strings(rows: DataFrame, candidate: str, document: str) -> DataFrame:
    """candidate, location (`$.a[0]`) and text of each string of a JSON document, in NFC."""
    leaves = flatten(rows.select(F.col(candidate).alias("_candidate"), F.col(document).alias("_document")), "_candidate", "_document").where("is_text")
    return leaves.select(F.col("_candidate").alias(candidate), F.col("path").alias("location"), T.composed(F.col("leaf")).alias("text"))


# The rules that block a candidate.
COPY_RULE, IDENTITY_RULE = "exact-private-surface-copy/v1", "exact-selection-identity/v1"


def _copied(size: int):
    return lambda: lambda text: [("", " ".join(x)) for x in runs(tokens(text), size)]


def _blocking(copied, words, size: int):
    """The samples' runs of tokens and the protected terms that a text has, both by its tokens in lower case."""

    def made():
        wanted, automaton = {tuple(x.split(" ")) for x in copied.value}, automaton_of(words.value)

        def found(text: str) -> list[tuple[str, str]]:
            listed = tokens(text)
            form = "".join(listed).replace("_", "").replace("-", "")
            return [("copy", " ".join(x)) for x in wanted.intersection(runs(listed, size))] + [("name", x) for x in held_in(automaton, form)]

        return found

    return made


def surface_blockers(strings: DataFrame, samples: DataFrame, protected: DataFrame, candidate: str, sample: str, reference: str, text: str = "text", size: int = 5, most: int = MOST_SHARED) -> DataFrame:
    """candidate, rule, location, ref: strings that copy a sample or hold a protected name, each once.

    A string is read once for both; past `most` runs of the samples' tokens, or terms for one automaton, each rule reads it by itself.
    """
    spark = strings.sparkSession
    placed = strings.select(F.struct(candidate, "location").alias("at"), F.col(text).alias("text"))
    own = samples.select(sample, F.col(text).alias("text"))
    row = lambda found, rule, ref: found.select(F.col(f"at.{candidate}").alias(candidate), F.lit(rule).alias("rule"), F.col("at.location").alias("location"), F.col(ref).cast("string").alias("ref"))
    copied = written(_by_key(_each(own, sample, "text", _copied(size)), sample, "term").distinct())
    names = written(protected.select(reference, T.surface_norm(F.col("term")).alias("term")).where("length(term) >= 2").distinct())
    words, grams = names.select("term").distinct(), copied.select("term").distinct()
    if grams.count() <= most and (words.agg(F.sum(F.length("term"))).first()[0] or 0) <= MOST_CHARACTERS:
        shared = [spark.sparkContext.broadcast([r[0] for r in x.collect()]) for x in (grams, words)]
        found = written(_each(placed, "at", "text", _blocking(*shared, size)))
        of = lambda kind, refs, ref: _by_key(found.where(F.col("kind") == kind).join(refs, "term"), "at", ref)
        copies, held = of("copy", copied, sample), of("name", names, reference)
    else:
        copies, held = surface_copies(placed, own, "at", sample, size=size), term_containment(placed, protected, "at", reference)
    return row(copies, COPY_RULE, sample).unionByName(row(held, IDENTITY_RULE, reference)).distinct()


def placed_findings(strings: DataFrame, samples: DataFrame, candidate: str, sample: str, text: str = "text") -> DataFrame:
    """candidate, rule, term, locations, references: a candidate's findings, each with its places in order."""
    placed = strings.select(F.struct(candidate, "location").alias("at"), F.col(text).alias("text"))
    rows = overlaps(placed, samples.select(sample, F.col(text).alias("text")), "at", sample).select(F.col(f"at.{candidate}").alias(candidate), "rule", "term", F.col("at.location").alias("location"), sample)
    return rows.groupBy(candidate, "rule", "term").agg(F.array_sort(F.collect_set("location")).alias("locations"), F.array_sort(F.collect_set(sample)).alias("references"))


def gate_report(strings: DataFrame, samples: DataFrame, protected: DataFrame, candidate: str, sample: str, reference: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The blockers of all candidates, and the findings of those that nothing blocks: blocked ones go before terms are sought."""
    strings = written(spread(strings.select(candidate, "location", text)))
    blockers = written(surface_blockers(strings, samples, protected, candidate, sample, reference, text))
    free = strings.join(blockers.select(candidate).distinct(), candidate, "left_anti")
    return blockers, placed_findings(free, samples, candidate, sample, text)


def surface_gate(candidates: DataFrame, samples: DataFrame, protected: DataFrame, candidate: str, sample: str, reference: str, text: str = "text", strings: DataFrame | None = None) -> DataFrame:
    """Per candidate: blockers, findings and the gate: blocked, pending_semantic_review or pass. A blocked candidate has no findings.

    `strings` (candidate, location, text) are the candidates' strings where they are documents; else each is one text.
    """
    held = candidates.select(candidate, F.lit("$").alias("location"), F.col(text).alias(text)) if strings is None else strings
    blockers, found = gate_report(held, samples, protected, candidate, sample, reference, text)
    count = lambda rows, name: rows.groupBy(candidate).agg(F.count("*").alias(name))
    out = candidates.select(candidate).join(count(blockers, "blockers"), candidate, "left").join(count(found, "findings"), candidate, "left").fillna(0, ["blockers", "findings"])
    return out.withColumn("gate", F.when(F.col("blockers") > 0, "blocked").when(F.col("findings") > 0, "pending_semantic_review").otherwise("pass"))
