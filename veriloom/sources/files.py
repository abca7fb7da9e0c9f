"""Readers and writers of text, CSV and JSON, and reconciliation of files with inventories."""

from __future__ import annotations

import codecs
import hashlib
import re
import uuid
from collections.abc import Callable
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import is_safe_path, is_sha256, trimmed
from ..operators.segment import integrity_hints, structure
from ..shared import commit, delete, exists, new_path, written
from ..shipping import ship


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, digest and text of whole files."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content", F.is_valid_utf8(F.col("content").cast("string")).alias("is_utf8"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


#: Bytes of a file that are in memory at a time.
PIECE = 8 << 20
_STREAMED = "path string, size_bytes long, sha256 string, is_utf8 boolean, lines long, marked long, error string"


def stream_digest(pieces, marker: bytes | None = None) -> tuple[int, str, bool, int, int]:
    """Of a file's pieces in order: bytes, SHA-256, whether it is UTF-8, line feeds, and lines that begin with the marker."""
    size, digest, decoder, lines, marked = 0, hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), 0, 0
    sought, before = b"\n" + (marker or b""), b"\n"
    for piece in pieces:
        size += len(piece)
        digest.update(piece)
        lines += piece.count(b"\n")
        if marker:
            marked += (before + piece).count(sought)
            before = (before + piece)[-(len(sought) - 1) :]
        if decoder is not None:
            try:
                decoder.decode(piece)
            except UnicodeDecodeError:
                decoder = None
    if decoder is not None:
        try:
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            decoder = None
    return size, digest.hexdigest(), decoder is not None, lines, marked


def _opened(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow import fs

    plain = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(quote(path, safe="/:@"))


def streamed_digests(spark: SparkSession, path: str | DataFrame, marker: str | None = None) -> DataFrame:
    """path, size_bytes, sha256, is_utf8, lines, marked (lines that begin with the marker) and error of files of any size.

    Files are listed by Spark, or given as a table of paths; an executor then reads each in pieces by Arrow's file
    systems, so memory doesn't depend on a file's size and many files are read at a time. A digest is sequential: one
    file is one task's. A file that can't be read has an error instead. The paths must be of a store that Arrow can open
    (shared folders, HDFS, S3, GCS).
    """
    ship(spark)
    mark = marker.encode() if marker else None

    def run(batches):
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                try:
                    system, at = _opened(name)
                    with system.open_input_stream(at) as stream:
                        rows.append((name, *stream_digest(iter(lambda: stream.read(PIECE), b""), mark), None))  # noqa: B023
                except (OSError, pa.ArrowInvalid) as error:
                    rows.append((name, *[None] * 5, str(error)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=_STREAMED_NAMES)

    listed = path.select("path") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return listed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(run, _STREAMED)


def write_files(rows: DataFrame, folder: str) -> int:
    """Each text of rows (at, text) as the file `at` of a folder, by Arrow's file systems; how many files were written.

    Spark's partitioned writer moves every file twice when it commits. Here a task writes its files in place, as the rows
    come, so a caller spreads them; if it is repeated, it writes the same ones. `at` tells rows apart.
    """
    ship(rows.sparkSession)

    def run(batches):
        system, root = _opened(folder)
        made = None
        for batch in batches:
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                inner = at.rpartition("/")[0]
                if inner != made:  # a folder's files come together
                    system.create_dir(f"{root}/{inner}", recursive=True)
                    made = inner
                with system.open_output_stream(f"{root}/{at}") as out:
                    out.write(text.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("at", "text").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def holds_any(pieces, sought: list[bytes]) -> tuple[int, bool]:
    """Of a file's pieces in order: bytes, and whether one of the byte strings occurs, also across pieces."""
    size, held, before, most = 0, False, b"", max(map(len, sought), default=1) - 1
    for piece in pieces:
        size += len(piece)
        if not held:
            near = before + piece
            held = any(x in near for x in sought)
            before = near[len(near) - min(most, len(near)) :]
    return size, held


def read_files(folders: DataFrame, key: str, whole: list[str], split: list[str] = (), scanned: list[str] = (), terms: list[str] = (), most: int = PIECE) -> DataFrame:
    """key, name, size, content and held of the files by these names in the folder of each row (key, folder).

    Nothing is listed: a task opens the files of its folders by Arrow's file systems; one that can't be read isn't there.
    Files of `whole` have their content, those of `split` if it is `most` bytes at most; files of `scanned` are read in pieces
    and tell whether they hold one of the terms. No byte of a term's UTF-8 form can begin or end within another character.
    """
    ship(folders.sparkSession)
    kind, sought = folders.schema[key].dataType.simpleString(), [t.encode() for t in terms]

    def told(system, at: str, name: str):
        with system.open_input_stream(at) as stream:
            if name in scanned:
                return *holds_any(iter(lambda: stream.read(PIECE), b""), sought), None
            content = stream.read() if name in whole else stream.read(most + 1)
        if name in whole or len(content) <= most:
            return len(content), None, content
        return system.get_file_info(at).size, None, None

    def given(rows: list, kinds):
        columns = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kinds, pa.string(), pa.int64(), pa.bool_(), pa.binary()])], names=["k", "name", "size", "held", "content"])

    def run(batches):
        rows, held, kinds = [], 0, None
        for batch in batches:
            kinds = batch.schema.field(0).type
            for k, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _opened(folder)
                for name in (*whole, *split, *scanned):
                    try:
                        size, found, content = told(system, f"{at}/{name}", name)
                    except (OSError, pa.ArrowInvalid):
                        continue
                    rows.append((k, name, size, found, content))
                    held += len(content or b"")
                    if held >= PIECE or len(rows) >= 10_000:
                        yield given(rows, kinds)
                        rows, held = [], 0
        if rows:
            yield given(rows, kinds)

    dealt = folders.select(key, "folder").repartition(max(1, int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)
    return dealt.mapInArrow(run, f"k {kind}, name string, size long, held boolean, content binary").withColumnRenamed("k", key)


_STREAMED_NAMES = [c.split(" ")[0] for c in _STREAMED.split(", ")]


def receipt_violations(receipts: DataFrame, found: DataFrame, key: str, sha256: str = "sha256", marked: str | None = None) -> DataFrame:
    """key and rule for each receipt that its source breaks: unreadable, sha256, size, markers.

    receipts: key, sha256, and where they are stated size_bytes and the count of marked lines; found: key and the
    columns of streamed_digests.
    """
    own = found.select(F.col(key).alias("_k"), F.col("sha256").alias("_sha"), F.col("size_bytes").alias("_size"), F.col("marked").alias("_marked"), "error")
    rows = receipts.join(own, F.col(key) == F.col("_k"), "left")
    there = F.col("_sha").isNotNull()
    rules = {"unreadable": ~there, "sha256": there & ~F.col("_sha").eqNullSafe(F.col(sha256))}
    if "size_bytes" in receipts.columns:
        rules["size"] = there & ~F.col("_size").eqNullSafe(F.col("size_bytes").cast("long"))
    if marked:
        rules["markers"] = there & ~F.col("_marked").eqNullSafe(F.col(marked).cast("long"))
    return rows.select(key, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("rule"))


#: A field: plain characters and quoted parts in any order; then a comma, a line feed or the end.
_FIELD = re.compile(r'((?:[^",\n]|"(?:[^"]|"")*")*)(,|\n|\Z)')
_QUOTED = re.compile(r'"((?:[^"]|"")*)"')


def parse_csv(text: str) -> list[list[str]]:
    """The cells of each row. A quote opens a quoted part wherever it stands; an unclosed one is an error.

    Rows end at LF, before which one CR goes; only rows of a single empty cell are dropped; a mark of byte order goes.
    """
    rows, row, at = [], [], 0
    while True:
        found = _FIELD.match(text, at)
        if not found:
            raise ValueError("CSV has an unclosed quoted field")
        raw, end = found[1], found[2]
        field = _QUOTED.sub(lambda m: m[1].replace('""', '"'), raw) if '"' in raw else raw
        at = found.end()
        if end == ",":
            row.append(field)
            continue
        if end == "\n" or field or row:
            row.append(field.removesuffix("\r"))
            rows.append(row)
            row = []
        if not end:
            break
    if rows and rows[0]:
        rows[0][0] = rows[0][0].removeprefix("\ufeff")
    return [r for r in rows if r != [""]]


def csv_cells_of(rows: DataFrame, key: str, text: str, tolerant: bool = False) -> DataFrame:
    """key, row_no (0 is the header), cells, header of each CSV text. One text is read by one task, as quoted parts may hold line feeds.

    An unclosed quote is an error; tolerant readers drop the rows of its text.
    """
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType

    def run(batches):
        cells = pa.list_(pa.string())

        def given(keys, owner, places, parts, headers):
            return pa.RecordBatch.from_arrays([keys.take(pa.array(owner, pa.int64())), pa.array(places, pa.int64()), pa.array(parts, cells), pa.array(headers, cells)], names=["k", "row_no", "cells", "header"])

        for batch in batches:
            owner, places, parts, headers = [], [], [], []
            for n, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    found = parse_csv(raw or "")
                except ValueError:
                    if not tolerant:
                        raise
                    continue
                for i, part in enumerate(found):
                    owner.append(n)
                    places.append(i)
                    parts.append(part)
                    headers.append(found[0])
                    if len(owner) >= 10_000:
                        yield given(batch.column(0), owner, places, parts, headers)
                        owner, places, parts, headers = [], [], [], []
            if owner:
                yield given(batch.column(0), owner, places, parts, headers)

    return rows.select(key, text).mapInArrow(run, f"k {kind.simpleString()}, row_no long, cells array<string>, header array<string>").withColumnRenamed("k", key)


#: Fixed by parse_csv: a record of so few characters may be one empty cell, which is no row.
_MAYBE_EMPTY = 8


def _scan_lines(batches):
    """Lines in the order of their splits, with what a split can tell alone: both states that it may begin in.

    A split begins outside a quoted part (state 0) or inside one (1); a line is a record's first one if as many quotes,
    modulo 2, lie before it in the split. For each state the line's record start so far and number of rows so far.
    """
    split, n, inside, starts, rows = None, 0, 0, [None, None], [0, 0]
    for batch in batches:
        names, keys = batch.column("path"), batch.column("block").to_pylist()
        quotes = pc.count_substring(batch.column("line"), '"').to_pylist()
        out: dict = {c: [] for c in ("no", "inside", "odd", "start0", "start1", "rows0", "rows1", "kept")}
        for path, block, line, q in zip(names.to_pylist(), keys, batch.column("line"), quotes):
            if (path, block) != split:
                split, n, inside, starts, rows = (path, block), 0, 0, [None, None], [0, 0]
            kept = True
            if q % 2 == 0:
                text = line.as_py() if len(line.as_buffer()) <= _MAYBE_EMPTY else None
                kept = text is None or bool(parse_csv(text))
            starts[inside] = n
            for c, v in zip(out, (n, inside, q % 2, starts[0], starts[1], rows[0], rows[1], kept)):
                out[c].append(v)
            rows[inside] += kept
            n, inside = n + 1, inside ^ (q % 2)
        kinds = [pa.int64()] + [pa.int32()] * 2 + [pa.int64()] * 4 + [pa.bool_()]
        yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, k) for v, k in zip(out.values(), kinds)]], names=[*batch.schema.names, *out])


_SCANNED = "path string, block long, line string, no long, inside int, odd int, start0 long, start1 long, rows0 long, rows1 long, kept boolean"


def csv_lines(spark: SparkSession, path: str, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """The lines of CSV files, whatever a file's size, one task for each split: path, block (where the split begins), line and what the split alone can tell."""
    ship(spark)
    read = spark.read.option("lineSep", "\n").text(path)  # a line belongs to the split that it begins in
    if only is not None:
        read = read.where(only(F.col("_metadata.file_path")))  # on the path alone: other files aren't opened
    lines = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.make_valid_utf8("value").alias("line"))
    mark = (F.col("block") == 0) & (F.col("no") == 0)
    return lines.mapInArrow(_scan_lines, _SCANNED).withColumn("line", F.when(mark, F.regexp_replace("line", "^\ufeff", "")).otherwise(F.col("line")))


def _csv_splits(lines: DataFrame, tolerant: bool = False) -> DataFrame:
    """One row for each split: the state it begins in, the record that goes on into it, and the rows before it.

    An exclusive-or over the splits before gives the state; a file that ends within quotes is an error, or has no rows.
    """
    of = lines.groupBy("path", "block").agg(
        F.bit_xor("odd").alias("odd"), *[F.max(f"start{p}").alias(f"last{p}") for p in (0, 1)], *[F.count_if((F.col("inside") == p) & F.col("kept")).alias(f"n{p}") for p in (0, 1)]
    )
    by = W.partitionBy("path").orderBy("block")
    before, whole = by.rowsBetween(W.unboundedPreceding, -1), W.partitionBy("path")
    open_ = F.raise_error(F.concat(F.lit("CSV has an unclosed quoted field: "), "path")).cast("int")
    state = F.when(F.sum("odd").over(whole) % 2 == 1, open_).otherwise((F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    if tolerant:
        of = of.withColumn("quotes", F.sum("odd").over(whole)).where("quotes % 2 = 0")
    pick = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    last = F.when(pick("last").isNotNull(), F.struct("block", pick("last").alias("no")))
    known = of.withColumn("state", state).withColumn("came", last).withColumn("n", pick("n"))
    return known.select(
        F.col("path").alias("_p"), F.col("block").alias("_b"), "state", F.last("came", ignorenulls=True).over(before).alias("came"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )


def _parse_records(batches):
    for batch in batches:
        cells = [parse_csv(text)[0] for text in batch.column("record").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("row_no"), pa.array(cells, pa.list_(pa.string()))], names=["path", "row_no", "cells"])


#: So many splits or headers are broadcast at most; beyond that they are joined by a shuffle.
MOST_SPLITS = 200_000


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MOST_SPLITS else rows


def csv_cells(spark: SparkSession, path: str, tolerant: bool = False, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, row_no (0 is the header), cells and header of CSV files of any size, the same cells as parse_csv gives.

    Files are read in splits. A record of one line never leaves its task; only the lines of records over several lines
    meet by a shuffle, wherever the borders of splits lie. Bytes that aren't UTF-8 become replacement characters.
    An unclosed quote is an error; tolerant readers drop the rows of its file. `only` chooses files by their paths.
    """
    lines = csv_lines(spark, path, only)
    splits = _small(written(_csv_splits(lines, tolerant)))
    found = lines.join(splits, (F.col("path") == F.col("_p")) & (F.col("block") == F.col("_b")))
    first = F.col("inside") == F.col("state")
    own = F.when(F.col("state") == 0, F.col("start0")).otherwise(F.col("start1"))
    start = F.when(own.isNotNull(), F.struct("block", own.alias("no"))).otherwise(F.col("came"))
    row_no = F.col("base") + F.when(F.col("state") == 0, F.col("rows0")).otherwise(F.col("rows1"))
    whole = found.where(first & (F.col("odd") == 0) & F.col("kept")).select("path", row_no.alias("row_no"), F.col("line").alias("record"))
    parts = found.where(~first | (F.col("odd") == 1)).select("path", start.alias("start"), "block", "no", "line", F.when(first, row_no).alias("row_no"))
    lines_of = F.array_sort(F.collect_list(F.struct("block", "no", "line")))
    joined = parts.groupBy("path", "start").agg(F.max("row_no").alias("row_no"), F.array_join(F.transform(lines_of, lambda x: x["line"]), "\n").alias("record"))
    cells = whole.unionByName(joined.select("path", "row_no", "record")).mapInArrow(_parse_records, "path string, row_no long, cells array<string>")
    headers = _small(written(cells.where("row_no = 0").select(F.col("path").alias("_p"), F.col("cells").alias("header"))))
    return cells.join(headers, F.col("path") == F.col("_p")).drop("_p")


def csv_records(cells: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Data rows by the names in each header (of equal names the last): all strings, missing cells empty."""
    place = lambda c: F.size("header") - F.array_position(F.reverse("header"), c)
    value = lambda c: F.when(F.array_contains("header", c), F.coalesce(F.get("cells", place(c).cast("int")), F.lit("")))
    return cells.where("row_no > 0").select(*keys, *[value(c).alias(c) for c in columns])


def csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return csv_records(csv_cells(spark, path), columns)


def csv_shape_violations(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """path, row_no and rule: a header other than declared, rows with more or fewer cells than the header."""
    cells = csv_cells(spark, path)
    wrong = (F.col("row_no") == 0) & (F.col("cells") != F.array(*map(F.lit, columns)))
    uneven = (F.col("row_no") > 0) & (F.size("cells") != F.size("header"))
    return cells.withColumn("rule", F.when(wrong, "header").when(uneven, "cell-count")).where("rule is not null").select("path", "row_no", "rule")


def csv_header_matches(spark: SparkSession, path: str, columns: list[str]) -> bool:
    """Whether the first row of every file has just these cells; no file is no match."""
    files = csv_cells(spark, path).where("row_no = 0").agg(F.count("*").alias("n"), F.count_if(F.col("cells") != F.array(*map(F.lit, columns))).alias("other")).first()
    return files["n"] > 0 and files["other"] == 0


def json_documents(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False) -> DataFrame:
    """JSON files by a declared schema; tolerant readers drop files that don't parse, others fail."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="DROPMALFORMED" if tolerant else "FAILFAST")


def inspect_sources(inventory: DataFrame, files: DataFrame, key: str = "source_id", size: str = "size_bytes", content: str | None = None) -> DataFrame:
    """What each listed source is by presence and size: verified-local, drifted-local or remote-only; and its digest.

    With `content`, a column of files, also the structure of what was found and hints at what is odd about it.
    """
    found = files.select(key, F.col("sha256").alias("source_sha256"), F.col("size_bytes").alias("actual_size_bytes"), *([structure(F.col(content)).alias("structure")] if content else []))
    rows = inventory.join(found, key, "left").withColumn("size_matches", F.col("actual_size_bytes") == F.col(size))
    rows = rows.withColumn("status", F.when(F.col("actual_size_bytes").isNull(), "remote-only").when(F.col("size_matches"), "verified-local").otherwise("drifted-local"))
    return rows.withColumn("hints", integrity_hints(F.col(size), F.col("structure"))) if content else rows


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end)."""
    return F.substring(data, start + 1, end - start)


def proven_slices(rows: DataFrame, data: str, start: str, end: str, sha256: str) -> DataFrame:
    """Slices with whether range, digest and character boundaries hold."""
    piece = byte_slice(F.col(data), F.col(start), F.col(end))
    fine = (F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.col(end) <= F.octet_length(data))
    return rows.withColumn("slice", piece).withColumn("proven", F.coalesce(fine & (F.sha2("slice", 256) == F.col(sha256)) & F.is_valid_utf8(F.col("slice").cast("string")), F.lit(False)))


#: Characters that JSON writes in two and in six characters, and the version that a cursor names.
_SHORT_ESCAPES, CURSOR = '"\\\b\f\n\r\t', "firefly-hermes-read-cursor/v1"


def encoded_costs(text: str) -> np.ndarray:
    """How many code points JSON takes for each code point of a text, without the quotes around it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cost = np.ones(len(points), np.int64)
    cost[points < 32] = 6
    cost[np.isin(points, [ord(c) for c in _SHORT_ESCAPES])] = 2
    return cost


def split_by_budget(text: str, most: int) -> list[str]:
    """Maximal prefixes whose JSON encoding, with its quotes, fits the budget, one after the other."""
    if not text:
        return [""]
    upto = np.cumsum(encoded_costs(text))
    out, at, spent = [], 0, 0
    while at < len(text):
        end = int(np.searchsorted(upto, spent + most - 2, side="right"))
        if end == at:
            raise ValueError("a character doesn't fit the budget by itself")
        out.append(text[at:end])
        at, spent = end, int(upto[end - 1])
    return out


@F.pandas_udf(ArrayType(StructType([StructField("idx", IntegerType()), StructField("chunk", StringType())])))
def budgeted_chunks(text: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([[{"idx": i, "chunk": c} for i, c in enumerate(split_by_budget(t or "", b))] for t, b in zip(text, budget)])


def cursor_of(input_id: Column, sha256: Column, idx: Column) -> Column:
    return F.concat(F.lit("cursor-"), F.sha2(F.concat_ws("\0", F.lit(CURSOR), input_id.cast("string"), sha256, idx.cast("string")), 256))


def chunks(rows: DataFrame, key: str, text: str, budget: int = 75_000) -> DataFrame:
    """key, idx, chunk and the cursor that names the chunk: a digest of version, key, the text's digest and idx."""
    found = rows.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_sha"), F.explode(budgeted_chunks(F.col(text), F.lit(budget))).alias("x"))
    return found.select(key, "x.idx", "x.chunk", cursor_of(F.col(key), F.col("_sha"), F.col("x.idx")).alias("cursor"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def rows_digest(df: DataFrame, text: Column) -> str:
    """A digest of a table's rows in any order: sums of parts of the rows' digests, partly summed before the shuffle."""
    parts = df.select(F.sha2(text, 256).alias("h")).select(*[F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"p{i}") for i in range(4)])
    row = parts.agg(F.count("*").alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(4)]).first()
    return hashlib.sha256(":".join(str(x or 0) for x in row).encode()).hexdigest()


def publish_once(df: DataFrame, folder: str, name: str, text: Column) -> tuple[str, bool]:
    """Write under a name made from the content's digest, and never over anything: the path, and whether this call wrote it.

    Rows go to a folder of their own, are read back and digested, and get their name by a rename that fails where the
    name is taken. What is there already, or was there first, is read back as well: other content is an error.
    `text` is an expression of columns of df that tells rows apart.
    """
    spark, digest = df.sparkSession, rows_digest(df, text)
    path, staged = f"{folder}/{name}-{digest[:24]}", f"{folder}/.staged-{uuid.uuid4().hex}"
    holds = lambda at: rows_digest(spark.read.schema(df.schema).parquet(at), text) == digest
    new = False
    if not exists(spark, path):
        df.write.parquet(staged)
        if not holds(staged):
            delete(spark, staged)
            raise OSError(f"what was written for {path} reads back otherwise")
        new = commit(spark, staged, path)
    if not new and not holds(path):
        raise FileExistsError(f"{path} holds other rows than its name says")
    return path, new


def publish(df: DataFrame, folder: str, name: str, text: Column) -> str:
    return publish_once(df, folder, name, text)[0]


def _publish_lines(df: DataFrame, path: str) -> str:
    """One JSON object a line at `path`, which is made once; what is there already must hold the same rows."""
    spark = df.sparkSession
    digest = lambda rows: rows_digest(rows, F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    if not exists(spark, path):
        staged = f"{path.rpartition('/')[0]}/.staged-{uuid.uuid4().hex}"
        write_lines(df, staged)
        if commit(spark, staged, path):
            return path
    if digest(spark.read.schema(df.schema).json(path)) != digest(df):
        raise FileExistsError(f"{path} holds other rows")
    return path


def publish_with_receipt(data: DataFrame, receipt: DataFrame, folder: str, name: str, text: Column) -> tuple[str, str]:
    """Data first, the receipt that makes it visible last. A receipt that is there already must say the same; it is never overwritten."""
    path = publish(data, folder, name, text)
    return path, _publish_lines(receipt.withColumn("data_path", F.lit(path)).coalesce(1), f"{path}.receipt")


def publish_pack(tracked: DataFrame, receipt: DataFrame, folder: str, name: str, text: Column, private: DataFrame | None = None) -> dict[str, str]:
    """A pack: tracked rows, the private rows (else the same ones) as JSON lines, and last the receipt that names both."""
    data = publish(tracked, folder, name, text)
    lines = _publish_lines(tracked if private is None else private, f"{data}.lines")
    said = receipt.withColumns({"data_path": F.lit(data), "lines_path": F.lit(lines)})
    return {"data": data, "lines": lines, "receipt": _publish_lines(said.coalesce(1), f"{data}.pack")}


def is_published(spark: SparkSession, receipt: str) -> bool:
    """Data counts as published once its receipt is there."""
    return exists(spark, receipt)


def upsert_plan(stored: DataFrame, offered: DataFrame, key: str, digest: str) -> DataFrame:
    """What an upsert does to each card: installed, refreshed, reused, or kept when not offered."""
    a, b = stored.select(key, F.col(digest).alias("old")), offered.select(key, F.col(digest).alias("new"))
    action = F.when(F.col("old").isNull(), "installed").when(F.col("new").isNull(), "kept").when(F.col("old") == F.col("new"), "reused").otherwise("refreshed")
    return a.join(b, key, "full").select(key, action.alias("action"))


def overlay(base: DataFrame, later: DataFrame, key: str, first: int, low: int, high: int) -> DataFrame:
    """Base rows before `first`, later rows from it on, of those low to high in order."""
    return base.where(F.col(key) < first).unionByName(later.where(F.col(key) >= first)).where(F.col(key).between(low, high)).orderBy(key)


def manifest_violations(manifest: DataFrame, key: str, required: list[str], counts: list[str], dates: list[str], paths: list[str] = (), digests: list[str] = ()) -> DataFrame:
    """rule and key for each breach: empty fields, repeated keys, dates and counts that don't parse, unsafe paths, bad digests."""
    checks = [(f"empty:{c}", F.coalesce(trimmed(F.col(c).cast("string")), F.lit("")) == "") for c in required]
    checks += [(f"date:{c}", F.try_to_timestamp(F.col(c).cast("string")).isNull()) for c in dates]
    checks += [(f"count:{c}", ~F.coalesce(F.col(c).cast("string").rlike("^[1-9][0-9]*$"), F.lit(False))) for c in counts]
    checks += [(f"path:{c}", ~F.coalesce(is_safe_path(F.col(c)), F.lit(False))) for c in paths]
    checks += [(f"sha256:{c}", ~is_sha256(F.col(c))) for c in digests]
    found = manifest.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))).alias("rule"))
    repeated = manifest.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).cast("string").alias("key"), F.lit("repeated").alias("rule"))
    return found.unionByName(repeated)
