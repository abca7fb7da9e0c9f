"""Documents to lines, chapters, spans and windows with exact byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import trimmed
from .overlap import is_boundary

MARKER = "ⓚ"
#: Where a line begins, besides the text's start; forms of a chapter line in the order in which they are tried.
LINE_STARTS = r"\n\r\x{2028}\x{2029}"
CHAPTER_FORMS = (
    rf"^{MARKER}([0-9]{{1,4}})(?:화)?",
    rf"^{MARKER}<([0-9]{{1,4}})>",
    rf"^{MARKER}[^\r\n]{{0,120}}?(?<![A-Za-z0-9_])([0-9]{{1,4}})화(?:[{T.SPACE}]|\z)",
)
WINDOW_BYTES = 12_000


def lines_with_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", end: str = "\n") -> DataFrame:
    """key, line_no (from 0), line, start_byte, end_byte (without what ends the line, one byte of `end`). One shuffle, by document."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), end, -1)).alias("line_no", "line"))
    before = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines.withColumn("start_byte", start).withColumn("end_byte", F.col("start_byte") + F.octet_length("line"))


def evidence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line that isn't blank, trimmed, as a byte range with its digest. Lines end at LF and at CR; line_no counts both."""
    lines = lines_with_bytes(docs, key, text, "[\r\n]").withColumn("span", trimmed(F.col("line"))).where("span <> ''")
    lead = F.octet_length("line") - F.octet_length(F.regexp_replace("line", rf"^[{T.SPACE}]+", ""))
    start = (F.col("start_byte") + lead).cast("long")
    return lines.select(key, "line_no", start.alias("start_byte"), (start + F.octet_length("span")).alias("end_byte"), F.sha2("span", 256).alias("span_sha256"))


def line_slice(docs: DataFrame, first: int, last: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines first to last (from 1) as one byte range with its digest; documents with fewer lines have none."""
    lines = lines_with_bytes(docs, key, text).where(F.col("line_no").between(first - 1, last - 1))
    found = lines.groupBy(key).agg(F.count("*").alias("n"), F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("slice"))
    return found.where(F.col("n") == last - first + 1).select(key, "start_byte", "end_byte", F.sha2("slice", 256).alias("slice_sha256"))


def chapters(docs: DataFrame, marker: str = rf"{MARKER}(?=[0-9])", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Marked chapters: sequence, marker line, prose, start and end offset in UTF-16 units. Text before the first marker goes."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), rf"(?<![^{LINE_STARTS}])(?={marker})")
    rows = docs.select(key, F.posexplode(parts).alias("at", "part"))
    units = F.length("part") + F.regexp_count("part", F.lit(r"[\x{10000}-\x{10ffff}]"))
    by = W.partitionBy(key).orderBy("at")
    rows = rows.withColumn("units", units.cast("long")).withColumn("end_offset", F.sum("units").over(by))
    rows = rows.withColumn("start_offset", F.col("end_offset") - F.col("units")).where(F.col("part").rlike(rf"^(?:{marker})"))
    rows = rows.withColumn("sequence", F.row_number().over(by)).withColumn("part", trimmed(F.col("part")))
    cut = F.instr("part", "\n")
    head = trimmed(F.when(cut > 0, F.substring("part", F.lit(1), cut - 1)).otherwise(F.col("part")))
    prose = F.when(cut > 0, trimmed(F.substring("part", cut + 1, F.length("part")))).otherwise("")
    return rows.select(key, "sequence", head.alias("marker"), prose.alias("prose"), "start_offset", "end_offset")


def chapter_number(line: Column) -> Column:
    """The number of a chapter line by the first form that fits, else null."""
    return F.coalesce(*[F.when(line.rlike(f), F.regexp_extract(line, f, 1).cast("int")) for f in CHAPTER_FORMS])


def chapter_index(docs: DataFrame, number=chapter_number, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Byte range of each numbered chapter: from its marker to the next one's or the end."""
    lines = lines_with_bytes(docs, key, text, "[\r\n]").withColumn("size", F.max("end_byte").over(W.partitionBy(key)))
    form = rf"(?s)^(?:.*?[\x{{2028}}\x{{2029}}])??({MARKER}.*)\z"  # a marker may follow a line separator within
    marks = lines.where(F.contains("line", F.lit(MARKER))).withColumn("marker", F.regexp_extract("line", form, 1)).withColumn("chapter_number", number(F.col("marker"))).where("chapter_number is not null")
    start = (F.col("start_byte") + F.octet_length("line") - F.octet_length("marker")).cast("long")
    order = W.partitionBy(key).orderBy("line_no")
    marks = marks.withColumn("start_byte", start)
    return marks.select(key, F.row_number().over(order).alias("sequence"), "chapter_number", "start_byte", F.coalesce(F.lead("start_byte").over(order), "size").alias("end_byte"))


def structure(text: Column, number=chapter_number) -> Column:
    """A text's structure as a struct, within its row: whether it is valid UTF-8 (for binary columns), marker lines, chapters
    among them, steps between their numbers other than one, first and last number, replacement characters, status."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    valid = F.is_valid_utf8(whole)
    clean = F.when(valid, whole).otherwise("")
    markers = F.regexp_extract_all(clean, F.lit(rf"(?<![^{LINE_STARTS}]){MARKER}[^\r\n]*"), F.lit(0))
    numbers = F.filter(F.transform(markers, lambda m: number(m)), lambda n: n.isNotNull())
    steps = F.zip_with(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.slice(numbers, 1, F.greatest(F.size(numbers) - 1, F.lit(0))), lambda b, a: b - a)
    issues = F.size(F.filter(steps, lambda d: d != 1))
    damaged = F.regexp_count(clean, F.lit("\ufffd"))
    status = F.when(valid & (F.size(numbers) > 0) & (issues == 0) & (damaged == 0), "complete").otherwise("needs-review")
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        status.alias("status"), valid.alias("utf8_valid"), long(F.size(markers), "marker_lines"), long(F.size(numbers), "chapters"),
        long(F.size(markers) - F.size(numbers), "unparsed"), long(issues, "gaps"), long(F.get(numbers, F.lit(0)), "first_number"),
        long(F.when(F.size(numbers) > 0, F.element_at(numbers, -1)), "last_number"), long(damaged, "replacements"),
    )


def structure_profile(docs: DataFrame, number=chapter_number, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The structure of each document's text; no shuffle."""
    return docs.select(key, structure(F.col(text), number).alias("s")).select(key, "s.*")


#: Fixed value: a file below this size is suspicious.
SMALL_FILE = 100_000


def integrity_hints(size: Column, s: Column) -> Column:
    """What is odd about a source of a size and a structure, in a fixed order."""
    hints = [
        F.when(size < SMALL_FILE, "suspiciously-small"), F.when(~s["utf8_valid"], "utf8-invalid"),
        F.when(s["replacements"] > 0, "replacement-character"), F.when(s["chapters"] == 0, "chapter-markers-missing"),
        F.when(s["unparsed"] > 0, "chapter-markers-unparsed"), F.when(s["gaps"] > 0, "chapter-sequence-anomaly"),
    ]
    return F.array_compact(F.array(*hints))


def survey_count(n: Column) -> Column:
    return F.greatest(F.lit(5), F.ceil(n / 100.0)).cast("long")


def survey_picks(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Systematic sample of 1..n: window ids, phases and the chapter sequences at equal distances."""
    k = survey_count(F.col(n))
    rows = counts.where(F.col(n) > 0).select(key, F.col(n).alias("n"), k.alias("k"), F.posexplode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i", "_"))
    at = F.floor(F.col("i") * (F.col("n") - 1) / (F.col("k") - 1) + 0.5) + 1
    number = (F.col("i") + 1).cast("string")
    name = F.concat(F.lit("w"), F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number))
    phase = F.when(F.col("i") == 0, "opening").when(F.col("i") == F.col("k") - 1, "ending").otherwise(F.concat(F.lit("distributed-"), F.col("i").cast("string")))
    return rows.select(key, name.alias("window_id"), at.cast("long").alias("chapter_sequence"), phase.alias("phase"))


def survey_windows(docs: DataFrame, number=chapter_number, key: str = "doc_id", text: str = "text", size: int = WINDOW_BYTES) -> DataFrame:
    """The picks of each document as byte ranges: from the chapter's start, `size` bytes or to its end, back to a whole character."""
    index = chapter_index(docs, number, key, text)
    picks = survey_picks(index.groupBy(key).agg(F.count("*").alias("n")), key)
    rows = picks.join(index.withColumnRenamed("sequence", "chapter_sequence"), [key, "chapter_sequence"])
    data = docs.select(key, F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))
    most = F.least("end_byte", F.col("start_byte") + size)
    back = F.when(is_boundary(F.col("data"), most), 0).when(is_boundary(F.col("data"), most - 1), 1).when(is_boundary(F.col("data"), most - 2), 2).otherwise(3)
    return rows.join(data, key).select(key, "window_id", "chapter_sequence", "chapter_number", "start_byte", (most - back).cast("long").alias("end_byte"), "phase")


def coverage_band(start: Column, end: Column, size: Column) -> Column:
    """Third of the document in which the range's middle lies, by whole numbers."""
    middle = (start + end) * 3
    return F.when(middle < size * 2, "early").when(middle < size * 4, "middle").otherwise("late")


#: How corpus files are named, where they lie, and their type.
CORPUS_NAME, CORPUS_FOLDER, CORPUS_TYPE = r"(?s)^(.+)_([^_]+)_합본\.txt\z", "private_sources/korean_webnovel_corpus", "text/plain"


def identity_of(file: Column) -> tuple[Column, Column]:
    """Title and author from <title>_<author>_합본.txt, by the last underscore before the ending."""
    return F.nullif(F.regexp_extract(file, CORPUS_NAME, 1), F.lit("")), F.nullif(F.regexp_extract(file, CORPUS_NAME, 2), F.lit(""))


def corpus_identity(files: DataFrame, id_col: str = "provider_file_id", title: str = "title", kind: str = "mime_type", size: str = "size_bytes", modified: str = "modified_at") -> DataFrame:
    """files with source_id, author and repo_relative_path, or the first problem that keeps them from having these."""
    name = F.col(title)
    author = identity_of(name)[1]
    problem = (
        F.when(F.coalesce(F.col(id_col), F.lit("")) == "", "no-file-id")
        .when(~F.coalesce(name.endswith("_합본.txt"), F.lit(False)), "not-a-corpus-name")
        .when(name.rlike(r"[\\/\x00]"), "unsafe-title")
        .when(~F.col(kind).eqNullSafe(F.lit(CORPUS_TYPE)), "not-plain-text")
        .when(~F.coalesce(F.col(size) >= 1, F.lit(False)), "bad-size")
        .when(F.try_to_timestamp(F.col(modified).cast("string")).isNull(), "bad-time")
        .when(author.isNull(), "no-author")
    )
    found = {"source_id": F.concat(F.lit("gdrive-"), F.col(id_col)), "author": author, "repo_relative_path": F.concat_ws("/", F.lit(CORPUS_FOLDER), author, name)}
    return files.withColumn("problem", problem).withColumns({k: F.when(F.col("problem").isNull(), v) for k, v in found.items()})


def observation_selectors(observations: DataFrame, index: DataFrame, key: str, name: str, sequences: str, ranges: str) -> DataFrame:
    """Selectors of observations that name either chapters or byte ranges, in order, with repeats marked.

    observations: key, name, array of chapter sequences, array of structs (start_byte, end_byte). An observation with
    both or neither gives no selectors: see `mode`.
    """
    has_c, has_r = F.coalesce(F.size(sequences) > 0, F.lit(False)), F.coalesce(F.size(ranges) > 0, F.lit(False))
    rows = observations.where(has_c != has_r)
    by_chapter = rows.select(key, name, F.explode(sequences).alias("sequence")).join(index.select(key, "sequence", "start_byte", "end_byte"), [key, "sequence"], "left")
    by_range = rows.select(key, name, F.lit(None).cast("int").alias("sequence"), F.explode(ranges).alias("r")).select(key, name, "sequence", "r.start_byte", "r.end_byte")
    both = by_chapter.select(key, name, "sequence", "start_byte", "end_byte").unionByName(by_range)
    order = W.partitionBy(key, name).orderBy("start_byte", "end_byte", F.coalesce("sequence", F.lit(-1)))
    again = (F.lag("start_byte").over(order) == F.col("start_byte")) & (F.lag("end_byte").over(order) == F.col("end_byte"))
    return both.withColumn("place", F.row_number().over(order)).withColumn("repeated", F.coalesce(again, F.lit(False)))
