"""Merkle manifests, conversation repair and SimHash against plain versions, with odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriloom.llm import conversations, merkle, queries, simhash

H = lambda text: hashlib.sha256(text.encode()).hexdigest()
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Merkle manifest


def plain_leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_levels(nodes):
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], levels


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    none_first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (none_first(r[0]), plain_leaf(r))) for s in sources}
    built = {s: plain_levels([plain_leaf(r) for r in rs]) for s, rs in trees.items()}
    root, above = plain_levels([built[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(trees[s]):
            other = r[:4] + (r[4].translate(LOWER) if r[4] is not None else None,) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else r
            node, proof, at = plain_leaf(other), [], i
            for levels, start in ((built[s][1], i), (above, k)):
                at = start
                for level in levels:
                    run = level[at // 16 * 16 : at // 16 * 16 + 16]
                    proof += run[: at % 16] + run[at % 16 + 1 :]
                    node = H("".join(run[: at % 16] + [node] + run[at % 16 + 1 :]))
                    at //= 16
            out.append((r[0], plain_leaf(r), built[s][0], root, H("".join(proof)), node, node == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree long, Leaf string, part int")
    found = merkle.manifest(df, tampering={"text": F.translate("text", queries.CAPITALS, queries.SMALL)}, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **more)
    return sorted(map(tuple, found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


ODD_DOCS = [(None, None, None, None, None), (1, None, "", 0, ""), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABC"), (1, "a", "en", 3, "ABd"), (2, "é", "en", 9, "X" * 100_000), (3, "Z", None, None, "é漢😀 Q"), (None, "a", "de", 1, "T")]


def test_manifest_of_odd_rows(spark):
    assert manifest_of(spark, ODD_DOCS) == plain_manifest(ODD_DOCS)
    assert manifest_of(spark, []) == []
    assert manifest_of(spark, ODD_DOCS[2:3]) == plain_manifest(ODD_DOCS[2:3])


@pytest.mark.parametrize("n", [16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_with_many_blocks_and_sources(spark):
    rows = [(i, f"s{i % 40}" if i % 3 else "hot", "en", i, f"Text {i}") for i in range(2000)]
    merkle_path = [manifest_of(spark, rows, most_top=m, deep=1) for m in (4096, 50, 3)]  # none, reduced blocks, a tree of sources reduced as well
    assert merkle_path[0] == plain_manifest(rows)
    assert merkle_path[1] == merkle_path[0] and merkle_path[2] == merkle_path[0]


def test_manifest_of_documents_and_its_proofs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, queries.op11_merkle_manifest(spark, SF).collect()), key=repr) == plain_manifest(rows)
    for r in merkle.manifest(docs, with_proof=True).take(20):
        assert hashlib.sha256(bytes(r["proof"])).hexdigest() == r["proof_sha256"] and r["verified"]


def test_manifest_shows_any_change(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(40)]
    before = manifest_of(spark, rows)[0][3]
    assert before != manifest_of(spark, rows[:-1])[0][3]
    assert before != manifest_of(spark, [*rows[:-1], (39, "s", "en", 39, "text 39.")])[0][3]


# conversation repair


def plain_repair(turns):
    """turns: (letter, kind). Dijkstra over (place, state) with audits compared as strings."""
    heap, done = [(0, "", 0, 0)], {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = cost, audit
        if i == len(turns) and state in (0, 3):
            return cost, audit
        to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, to))
        if i < len(turns):
            letter, kind = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state))
            if kind != 2:
                extra = 5 * (kind == 1)
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, to))
                step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((letter, state))
                if step:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step))


def every_audit(turns, most=13):
    """All edits of cost up to `most`, by enumeration."""
    out = []

    def go(i, state, cost, audit):
        if cost > most:
            return
        if i == len(turns) and state in (0, 3):
            out.append((cost, audit))
        to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        go(i, to, cost + 5, audit + "I")
        if i < len(turns):
            letter, kind = turns[i]
            go(i + 1, state, cost + 2, audit + "D")
            if kind != 2:
                go(i + 1, to, cost + 1 + 5 * (kind == 1), audit + "R")
                step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((letter, state))
                if step:
                    go(i + 1, step, cost + 5 * (kind == 1), audit + "K")

    go(0, 0, 0, "")
    return min(out)


def symbols(turns):
    return bytes(3 * "suax".index(letter) + kind for letter, kind in turns)


def test_layers_give_the_least_audit():
    kinds = list(itertools.product("suax", (0, 1, 2)))
    for n in range(4):
        for turns in itertools.product(kinds, repeat=n):
            assert conversations.repair(symbols(turns)) == every_audit(turns)
    rnd = random.Random(3)
    for _ in range(300):
        turns = [rnd.choice(kinds) for _ in range(rnd.randrange(4, 12))]
        assert conversations.repair(symbols(turns)) == plain_repair(turns)


def test_layers_with_dear_deletion(monkeypatch):
    """With other costs inserts win, so their layers and letters are tried as well."""
    monkeypatch.setattr(conversations, "DELETE", 9)
    monkeypatch.setattr(conversations, "INSERT", 1)
    assert conversations.repair(symbols([("u", 0)])) == (1, "KI")
    assert conversations.repair(symbols([("a", 0)])) == (1, "IK")
    assert conversations.repair(symbols([("u", 0), ("u", 0)])) == (1, "KR")
    assert conversations.repair(symbols([("s", 0)])) == (2, "IR")


@pytest.mark.parametrize("span", [1, 2, 5, 64])
def test_spans_of_long_conversations(monkeypatch, span):
    monkeypatch.setattr(conversations, "SPAN", span)
    rnd = random.Random(span)
    kinds = list(itertools.product("suax", (0, 1, 2)))
    for n in (1, 2, 9, 65, 200):
        for _ in range(10):
            turns = [rnd.choice(kinds) for _ in range(n)]
            assert conversations.repair(symbols(turns)) == plain_repair(turns)


def plain_summaries(rows):
    said = lambda v: " " if v is None else v
    out = []
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = said(role), said(text)
            hit = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
            if hit == 0:
                continue
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            turns += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], H(t[2])))
        seen, faults = set(), []
        for _, role, text in turns:
            inner = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = [r[:1] for _, r, _ in turns]
        cost, audit = plain_repair([(x if x and x in "sua" else "x", {"": 0, "truncated": 1}.get(f, 2)) for x, f in zip(letters, faults)])
        state, lines, i = 0, [], 0
        for e in audit:
            if e != "I":
                _, role, text = turns[i]
                i += 1
            if e == "D":
                continue
            if e != "K":
                role, text = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state], "" if e == "I" else text
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, H("\n".join(lines))))
    return sorted(out, key=repr)


def summaries_of(spark, rows):
    df = spark.createDataFrame([(*r, 0, "h") for r in rows], "conv_id long, turn long, role string, text string, place long, HEADER string")
    return sorted(map(tuple, conversations.repair_summaries(df).collect()), key=repr)


def test_repair_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", None), (1, None, None, "x"), (2, 5, "", "t."), (2, 5, "user", "t."), (2, 5, "user", "t."), (2, 9, "assistant", "y" * 200_000)]
    rows += [(3, t, "user", "same.") for t in range(40)] + [(4, t, "tool", " \t\n") for t in range(5)] + [(5, 0, "user", "漢。"), (5, 1, "assistant", "é! \n")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"{t}.") for c in range(10, 60) for t in range(6)]
    dropped = [(c, 0, "user", "a.") for c in range(100, 400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rows += dropped[:3]
    assert dropped and summaries_of(spark, rows) == plain_summaries(rows)
    assert summaries_of(spark, []) == []


def test_repair_of_a_conversation_over_many_batches(spark):
    rnd = random.Random(1)
    rows = [(7, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["a.", "b", "", f"{t}!"])) for t in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert summaries_of(spark, rows) == plain_summaries(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repair_of_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op12_conversation_repair(spark, SF).collect()), key=repr) == plain_summaries(rows)


# SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(points):
    """points: (id, fingerprint)."""
    of = list(range(len(points)))

    def find(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    fps = np.array([f for _, f in points], np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 4):
            of[find(i)] = find(i + 1 + int(j))
    least: dict = {}
    for i, (d, _) in enumerate(points):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(find(i))) for i, (d, f) in enumerate(points)), key=repr)


def simhash_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp long, Salt string")
    return sorted(((r[0], f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in simhash.near_components(df).collect()), key=repr)


def test_simhash_of_odd_rows(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (2, "One"), (9, "one"), (8, "a b c d e"), (7, "a b c"), (None, "one"), (None, "lonely words here now"), (8, "other text of eight"), (6, "é漢 😀 x y z")]
    rows += [(100 + i, "same text again and again " * 9) for i in range(300)]
    expected = plain_components([(d, plain_fingerprint(t)) for d, t in rows])
    assert simhash_of(spark, rows) == expected
    assert simhash_of(spark, []) == []


def test_fingerprints_of_long_texts(monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(simhash, "PIECE", 37)
    for n in (1, 3, 4, 5, 50, 400):
        text = "".join(rnd.choice(["a", "B", "é"]) + rnd.choice(["", "", " ", "\t\n"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    assert simhash.fingerprint(b"x" * 1000) == plain_fingerprint("x" * 1000)
    assert simhash.fingerprint(b" " * 1000 + b"y") == plain_fingerprint("y")


def test_embedding_bounds_the_distance(spark):
    rnd = random.Random(7)
    x = np.array([rnd.getrandbits(64) for _ in range(500)], np.uint64)
    y = x ^ np.array([rnd.getrandbits(64) & rnd.getrandbits(64) & rnd.getrandbits(64) for _ in range(500)], np.uint64)
    counts = lambda v: np.stack([((v >> np.uint64(2 * k)) & np.uint64(1)) + ((v >> np.uint64(2 * k + 1)) & np.uint64(1)) for k in range(32)]).astype(int)
    manhattan = np.abs(counts(x) - counts(y)).sum(0)
    assert (np.bitwise_count(simhash._embed(x) ^ simhash._embed(y)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(x ^ y)).all()
    got = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long").select(simhash._embedded(F.col("fp"))).collect()
    assert [r[0] & (1 << 64) - 1 for r in got] == simhash._embed(x).tolist()


@pytest.mark.parametrize("most,often,blocks", [(256, 24, 8), (3, 1 << 30, 8), (3, 1, 8), (256, 24, 10), (256, 24, 12)])
def test_links_keep_all_components(spark, most, often, blocks):
    """In pairs, through midpoints of cells that turn out large, and of cells that the sample finds."""
    rnd = random.Random(11)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(centres) | {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(40):
            f = c
            for b in rnd.sample(range(64), rnd.randrange(1, 7)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from veriloom.llm.components import components

    roots = {r["node"] & (1 << 64) - 1: r["root"] for r in components(simhash.links(table, most, often, blocks)).collect()}
    got = {}
    for f in fps:
        got.setdefault(roots.get(f, f), set()).add(f)
    expected = {}
    for f, (_, _, least) in zip(fps, sorted(plain_components(list(enumerate(fps))))):
        expected.setdefault(least, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_grids_cover_all_segments():
    for blocks, most in simhash.GRIDS:
        masks, choices, first = simhash._grid(blocks)
        assert sum(masks) == (1 << 64) - 1 and all(m & 0x5555555555555555 << 1 == (m & 0x5555555555555555) << 1 for m in masks)
        assert first[(1 << blocks) - 1] == 0 and first[0] == -1 and simhash.grid_for(most) == blocks


def test_simhash_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_simhash(spark, "/root/testdata/sf0.01").collect()), key=repr)
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t in rows])


# SQL


@pytest.mark.parametrize("name,table", [("op11_merkle_manifest", "documents"), ("op12_conversation_repair", "conversations")])
def test_sql_of_tables_and_odd_rows(spark, tmp_path, name, table):
    import duckdb

    odd = {
        "documents": (ODD_DOCS + [(i, "many", "en", i, f"T {i}") for i in range(300)], "doc_id long, source string, lang string, n_chars long, text string"),
        "conversations": ([(c, t, r, x) for c in (None, *range(60)) for t in (None, *range(7)) for r, x in [(["user", "assistant", "system", "tool", None][hash((c, t)) % 5], ["a.", "b", "", None, "c! "][hash((t, c)) % 5])]], "conv_id long, turn long, role string, text string"),
    }
    rows, schema = odd[table]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    for folder, files in (("/root/testdata/sf0.01", ""), (str(tmp_path), "/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet{files}')")
        answer, found = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, folder)
        assert answer.columns == found.columns
        assert sorted(map(tuple, answer.fetchall()), key=repr) == sorted(map(tuple, found.collect()), key=repr)
