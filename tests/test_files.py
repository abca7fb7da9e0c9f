"""Files in splits, publishing, digests of streams: against plain readings of the same bytes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from veriloom.sources import files as S


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "32", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k in keys:
        spark.conf.unset(k)


def cells_of(spark, path):
    return sorted((os.path.basename(r["path"]), r["row_no"], r["cells"], r["header"]) for r in S.csv_cells(spark, str(path)).collect())


def test_csv_splits_give_the_cells_of_the_whole_text(small_splits, tmp_path):
    rnd, expected = random.Random(2), []
    for n in range(25):
        bits = ['"', '""', ",", "\n", "\r\n", "a", "é漢", " ", '"x\ny"', "\n\n", '"\n,\n"']
        text = rnd.choice(["", "﻿", "\n", "h1,h2\n"]) + "".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 90)))
        if text.count('"') % 2:
            text += '"'
        (tmp_path / f"f{n:02}.csv").write_bytes(text.encode())
        rows = S.parse_csv(text)
        expected += [(f"f{n:02}.csv", i, r, rows[0]) for i, r in enumerate(rows)]
    assert S.csv_lines(small_splits, str(tmp_path)).select("path", "block").distinct().count() > 60
    assert cells_of(small_splits, tmp_path) == sorted(expected)


def test_csv_of_one_field_over_many_splits(small_splits, tmp_path):
    text = 'a,b\r\n1,"' + "line, with comma\n" * 60 + 'and ""quotes"" "\r\n\r\n2,"short"\n'
    (tmp_path / "x.csv").write_bytes(text.encode())
    assert cells_of(small_splits, tmp_path) == [("x.csv", i, r, ["a", "b"]) for i, r in enumerate(S.parse_csv(text))]
    (tmp_path / "x.csv").write_bytes((text + '"open\n').encode())
    with pytest.raises(Exception, match="unclosed quoted field"):
        S.csv_cells(small_splits, str(tmp_path)).collect()


def test_headers_of_every_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿"x","y\nz"\n1,2\n')
    assert S.csv_header_matches(spark, str(tmp_path), ["x", "y\nz"])
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    assert not S.csv_header_matches(spark, str(tmp_path), ["x", "y\nz"])


def test_publishing_never_trusts_or_overwrites(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, text string")
    text = F.concat_ws("\0", F.col("k").cast("string"), F.coalesce("text", F.lit("~")))
    path, new = S.publish_once(rows, str(tmp_path), "t", text)
    assert new and S.publish_once(rows.orderBy(F.desc("k")), str(tmp_path), "t", text) == (path, False)
    receipt = rows.agg(F.count("*").alias("n"))
    first = S.publish_with_receipt(rows, receipt, str(tmp_path), "t", text)
    assert S.publish_with_receipt(rows, receipt, str(tmp_path), "t", text) == first and S.is_published(spark, first[1])
    with pytest.raises(FileExistsError):
        S.publish_with_receipt(rows, receipt.withColumn("n", F.lit(7).cast("long")), str(tmp_path), "t", text)
    rows.withColumn("text", F.lit("tampered")).write.mode("overwrite").parquet(path)
    with pytest.raises(FileExistsError):
        S.publish(rows, str(tmp_path), "t", text)


def test_two_writers_leave_one_result(spark, tmp_path, monkeypatch):
    """The second writer sees no result before it writes, and finds the name taken when it commits."""
    rows = spark.createDataFrame([(1, "a")], "k long, text string")
    real, calls = S.exists, []

    def blind(session, path):
        calls.append(path)
        return False if len(calls) <= 2 else real(session, path)

    monkeypatch.setattr(S, "exists", blind)
    results = [S.publish_once(rows, str(tmp_path), "t", F.col("text")) for _ in range(2)]
    assert [new for _, new in results] == [True, False] and results[0][0] == results[1][0]
    assert [n for n in os.listdir(tmp_path) if n.startswith(".staged")] == []
    assert spark.read.parquet(results[0][0]).count() == 1


def test_streamed_digests_of_small_pieces():
    import hashlib

    rnd = random.Random(1)
    for _ in range(200):
        data = b"".join(rnd.choice([b"\n", "ⓚ".encode(), "가a".encode(), b"x", b"\xff", b"\r\n"]) for _ in range(rnd.randrange(0, 30)))
        at, pieces = 0, []
        while at < len(data):
            n = rnd.randrange(1, 5)
            pieces.append(data[at : at + n])
            at += n
        try:
            data.decode()
            fine = True
        except UnicodeDecodeError:
            fine = False
        marked = sum(line.startswith("ⓚ".encode()) for line in data.split(b"\n"))
        assert S.stream_digest(pieces, "ⓚ".encode()) == (len(data), hashlib.sha256(data).hexdigest(), fine, data.count(b"\n"), marked)


def test_digests_of_a_file_of_three_gigabytes(spark, tmp_path):
    """Sparse, so it takes no disk; its content wouldn't fit a row."""
    import hashlib

    size = 3 << 30
    with open(tmp_path / "large file.txt", "wb") as out:
        out.truncate(size)
    (tmp_path / "small.txt").write_text("ⓚ1\nⓚ2", encoding="utf-8")
    found = {os.path.basename(r["path"]).replace("%20", " "): r for r in S.streamed_digests(spark, str(tmp_path), "ⓚ").collect()}
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size >> 24):
        digest.update(zeros)
    large, small = found["large file.txt"], found["small.txt"]
    assert (large["size_bytes"], large["sha256"], large["is_utf8"], large["lines"], large["error"]) == (size, digest.hexdigest(), True, 0, None)
    assert (small["lines"], small["marked"]) == (1, 2)


def test_receipts_of_drifted_sources(spark, tmp_path):
    import hashlib

    for name, text in {"a": "ⓚ1\n", "b": "ⓚ1\nx", "c": "z"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = S.streamed_digests(spark, str(tmp_path), "ⓚ").withColumn("id", F.element_at(F.split("path", "/"), -1))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    receipts = spark.createDataFrame([("a", sha("ⓚ1\n"), 5, 1), ("b", sha("ⓚ1\ny"), 7, 2), ("d", sha(""), 0, 0)], "id string, sha256 string, size_bytes long, n long")
    got = sorted(map(tuple, S.receipt_violations(receipts, found, "id", marked="n").collect()))
    assert got == [("b", "markers"), ("b", "sha256"), ("b", "size"), ("d", "unreadable")]


def test_write_files_places_each_text_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"work={i}/name=a b.md/part.txt", f"글 {i}\n") for i in range(40)], "at string, text string")
    assert S.write_files(rows, f"file://{tmp_path}/x") == 40 and S.write_files(rows.limit(0), f"{tmp_path}/y") == 0
    assert {str(p.relative_to(tmp_path / "x")): p.read_text() for p in (tmp_path / "x").rglob("*") if p.is_file()} == {r["at"]: r["text"] for r in rows.collect()}


def test_term_across_pieces_of_a_file():
    rnd = random.Random(5)
    for _ in range(300):
        data = b"".join(rnd.choice(["자", "폐", "증", "자폐", "x"]).encode() for _ in range(rnd.randrange(0, 12))) + rnd.choice([b"", b"\xec"])
        pieces, at = [], 0
        while at < len(data):
            n = rnd.randrange(1, 6)
            pieces.append(data[at : at + n])
            at += n
        assert S.holds_any(pieces, ["자폐증".encode(), b"xx"]) == (len(data), "자폐증" in data.decode(errors="replace") or b"xx" in data)


def test_work_files_are_read_by_folder_and_never_listed(spark, tmp_path):
    """60 works: a listing of their folders would be a stage of 60 tasks. Tables over `most` bytes are read in splits, with the same result."""
    from veriloom.operators import works as X

    head = X.TABLES["arc_map.csv"] + "\n"
    texts = {
        "a b+%/arc_map.csv": head + 'A1,"two\nlines",1,2\n', "a b+%/chapter_map.csv": X.TABLES["chapter_map.csv"] + '\n1,"자폐증"\n', "a b+%/arc_pacing.csv": '"open\n',
        "a b+%/arc_atlas.md": "x" * 15_000 + "자폐증", "a b+%/completion_receipt.md": "short", "a b+%/source_receipt.json": '{"markerCount":2,"sourceSha256":"0"}',
        "other/arc_atlas.md": "not listed", "w1/arc_map.csv": head,
    }
    S.write_files(spark.createDataFrame(list(texts.items()), "at string, text string"), str(tmp_path))
    ids = ["a b+%", *[f"w{i}" for i in range(59)]]
    works = spark.createDataFrame([(w, "0", 2) for w in ids], "work string, sha256 string, marker_count int")
    sources = S.streamed_digests(spark, works.select(F.concat(F.lit(f"{tmp_path}/"), "work", F.lit("/source.txt")).alias("path")), X.MARK).withColumn("work", F.regexp_extract("path", "/([^/]+)/source.txt$", 1))
    told = lambda **more: sorted(map(tuple, X.work_file_violations(spark, works, sources, str(tmp_path), **more).where("severity = 'error'").collect()))
    spark.sparkContext.setJobGroup("work files", "")
    found = told()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("work files") for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) > 10 and all(s is None or s.numTasks < 60 for s in stages)
    own = {(r, d) for w, _, r, d in found if w == "a b+%"}
    assert {("receipt:analysisCoverage", ""), ("document:forbidden-term", "arc_atlas.md"), ("document:too-small", "completion_receipt.md"), ("table:unreadable", "arc_pacing.csv"), ("table:cell-count", "arc_map.csv"), ("table:forbidden-term", "chapter_map.csv"), ("source:unreadable", "")} <= own
    assert not {("receipt:unreadable", ""), ("table:header", "arc_map.csv"), ("table:unreadable", "chapter_map.csv")} & own and ("w1", "error", "table:unreadable", "arc_map.csv") not in found
    assert {w for w, *_ in found} == set(ids) and told(most=20) == found
