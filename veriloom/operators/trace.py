"""Audits of ordered message traces."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..functions.text import without_line_numbers
from ..shared import written
from ..sources.files import budgeted_chunks, cursor_of
from .ranges import numbered


def pairing(calls: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every call and result id with how often either side has it; one each is a pair."""
    a, b = calls.groupBy(*keys).agg(F.count("*").alias("calls")), results.groupBy(*keys).agg(F.count("*").alias("results"))
    out = a.join(b, keys, "full").fillna(0, ["calls", "results"])
    return out.withColumn("paired", (F.col("calls") == 1) & (F.col("results") == 1))


def turn_shape(messages: DataFrame, group: str, order: str, role: str, first: str = "user", last: str = "assistant", call: str = "user", answer: str = "assistant") -> DataFrame:
    """Per trace: whether it starts and ends with the right roles, and calls that aren't answered at once."""
    follows = F.lead(role).over(W.partitionBy(group).orderBy(order))
    rows = messages.withColumn("_open", F.coalesce((F.col(role) == call) & ~(follows.eqNullSafe(F.lit(answer))), F.lit(False)))
    ends = lambda f, want, name: (f(role, order) == want).alias(name)
    return rows.groupBy(group).agg(ends(F.min_by, first, "starts_right"), ends(F.max_by, last, "ends_right"), F.count_if("_open").alias("unanswered"), F.count("*").alias("n"))


def exact_reads(expected: DataFrame, calls: DataFrame, results: DataFrame, path: str = "path", content: str = "content", call: str = "call_id", answer: str = "answer") -> DataFrame:
    """Per expected file its state: called exactly once, answered, and the answer without its line numbers byte for byte the file.

    expected: path, content; calls: call_id, path; results: call_id, answer. ok, not-called, called-again, unanswered or drifted.
    """
    times = calls.groupBy(path).agg(F.count("*").alias("times"), F.min(call).alias(call))
    last = results.groupBy(call).agg(F.max(answer).alias(answer))
    rows = expected.join(times, path, "left").join(last, call, "left")
    state = (
        F.when(F.col("times").isNull(), "not-called").when(F.col("times") > 1, "called-again").when(F.col(answer).isNull(), "unanswered")
        .when(F.sha2(without_line_numbers(F.col(answer)), 256) != F.sha2(F.col(content), 256), "drifted").otherwise("ok")
    )
    return rows.select(path, state.alias("state"), F.when(state == "ok", F.sha2(F.col(content), 256)).alias("sha256"))


def chunk_chain(files: DataFrame, group: str, order: str, text: str, budget: int = 75_000) -> DataFrame:
    """The reads that a group's files in order demand: one cursor leads to the next chunk, over the files' ends.

    Per chunk: group, at (from 1 over all files), input_id, sha256, size_bytes, chunk_index, chunk_count, chunk_sha256,
    cursor (null for the first read), next_input_id, next_cursor (null at the end), content.
    """
    named = lambda n: F.concat(F.lit("input-"), F.when(F.length(n.cast("string")) < 3, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string")))
    texts = files.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    cut = texts.select("_g", "_o", F.sha2("t", 256).alias("sha256"), F.octet_length("t").cast("long").alias("size_bytes"), budgeted_chunks(F.col("t"), F.lit(budget)).alias("chunks"))
    files = written(cut.select("*", F.size("chunks").alias("chunk_count"), F.monotonically_increasing_id().alias("_row")))
    # Places, and the digest of the file after, go by rows without texts; texts meet them by row.
    narrow = written(numbered(files.select("_g", "_o", "_row", "sha256", "chunk_count"), "_g", ["_o", "_row"], F.col("chunk_count"), "_n", "before"))
    following = narrow.select(F.col("_g").alias("_h"), (F.col("_n") - 1).alias("_m"), F.col("sha256").alias("after"))
    places = narrow.join(following, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_n") == F.col("_m")), "left").select("_row", (F.col("_n") + 1).alias("place"), "before", "after")
    rows = files.join(places, "_row").withColumn("input_id", named(F.col("place"))).withColumnRenamed("_g", group)
    x = rows.select(group, "place", "input_id", "sha256", "size_bytes", "chunk_count", "after", "before", F.explode("chunks").alias("x")).select("*", "x.idx", "x.chunk")
    last = F.col("idx") + 1 == F.col("chunk_count")
    first = (F.col("idx") == 0) & (F.col("place") == 1)
    return x.select(
        group, (F.col("before") + F.col("idx") + 1).cast("long").alias("at"), "input_id", "sha256", "size_bytes", F.col("idx").alias("chunk_index"), "chunk_count", F.sha2("chunk", 256).alias("chunk_sha256"),
        F.when(~first, cursor_of(F.col("input_id"), F.col("sha256"), F.col("idx"))).alias("cursor"),
        F.when(~last, F.col("input_id")).when(F.col("after").isNotNull(), named(F.col("place") + 1)).alias("next_input_id"),
        F.when(~last, cursor_of(F.col("input_id"), F.col("sha256"), F.col("idx") + 1)).when(F.col("after").isNotNull(), cursor_of(named(F.col("place") + 1), F.col("after"), F.lit(0))).alias("next_cursor"),
        F.col("chunk").alias("content"),
    )


def replay(trace: DataFrame, chain: DataFrame, group: str, order: str) -> DataFrame:
    """Trace rows (group, order, input_id, cursor, chunk_sha256) against the chain: the n-th read of a group must be its n-th chunk."""
    trace = trace.select(F.col(group).alias("_g"), F.col(order).alias("_o"), "input_id", "cursor", "chunk_sha256")
    at = numbered(trace, "_g", ["_o"], F.lit(0), "_n", "_0").withColumn("at", F.col("_n") + 1).withColumnRenamed("_g", group)
    got = at.select(group, "at", F.lit(True).alias("read"), F.col("input_id").alias("got_id"), F.col("cursor").alias("got_cursor"), F.col("chunk_sha256").alias("got_sha"))
    both = got.join(chain.select(group, "at", "input_id", "cursor", "chunk_sha256"), [group, "at"], "full")
    state = (
        F.when(F.col("chunk_sha256").isNull(), "unexpected").when(F.col("read").isNull(), "missing").when(F.col("got_id") != F.col("input_id"), "wrong-input")
        .when(~F.col("got_cursor").eqNullSafe(F.col("cursor")), "wrong-cursor").when(F.col("got_sha") != F.col("chunk_sha256"), "wrong-content").otherwise("ok")
    )
    return both.select(group, "at", state.alias("state"))


#: Names in a transcript of reads.
READ_TOOL, READ_RESULT = "firefly_read_source", "firefly-hermes-read-result/v2"


@F.pandas_udf(LongType())
def _message_bytes(chain: pd.DataFrame) -> pd.Series:
    """Bytes of the call and the answer of each read as JSON, without what stands between messages."""

    def encoded(value) -> str:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))

    out = []
    for r in chain.itertuples(index=False):
        gone = lambda v: v is None or v != v
        arguments = {"inputId": r.input_id} | ({} if gone(r.cursor) else {"cursor": r.cursor})
        payload = {
            "schemaVersion": READ_RESULT, "inputId": r.input_id, "sha256": r.sha256, "sizeBytes": int(r.size_bytes), "chunkIndex": int(r.chunk_index), "chunkCount": int(r.chunk_count),
            "chunkSha256": r.chunk_sha256, "nextInputId": None if gone(r.next_input_id) else r.next_input_id, "nextCursor": None if gone(r.next_cursor) else r.next_cursor, "content": r.content,
        }
        name = f"call-{int(r.at):04d}-" + "0" * 128
        call = {"role": "assistant", "finish_reason": "tool_calls", "compacted": 0, "tool_calls": [{"id": name, "function": {"name": READ_TOOL, "arguments": encoded(arguments)}}]}
        answer = {"role": "tool", "tool_call_id": name, "tool_name": READ_TOOL, "compacted": 0, "content": encoded(payload)}
        out.append(len((encoded(call) + encoded(answer)).encode()))
    return pd.Series(out, dtype="int64")


def transcript_bytes(chain: DataFrame, group: str) -> DataFrame:
    """Per group: chunks, and the bytes of the whole transcript as a JSON list. Each read is measured by itself and the rest is added up."""
    columns = ["at", "input_id", "sha256", "size_bytes", "chunk_index", "chunk_count", "chunk_sha256", "cursor", "next_input_id", "next_cursor", "content"]
    rows = chain.select(group, _message_bytes(F.struct(*columns)).alias("b")).groupBy(group).agg(F.count("*").alias("chunks"), F.sum("b").alias("b"))
    return rows.select(group, "chunks", (F.col("b") + 2 * F.col("chunks") + 1).alias("transcript_bytes"))  # commas and brackets
