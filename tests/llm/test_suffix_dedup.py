import hashlib
import random

import numpy as np
import pytest

from veriloom.llm import suffix_dedup as S
from veriloom.llm.suffix_sort import BlindTrie, equal_classes

SCHEMA = "doc_id long, text string, spans string, bucket int"


def brute(rows):
    """rows: id, text. By id: n_bytes, n_removed, n_spans, kept."""
    seen, out = set(), {}
    for name, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - S.LENGTH + 1):
            window = raw[i : i + S.LENGTH]
            if window in seen:
                gone[i : i + S.LENGTH] = b"\1" * S.LENGTH
            seen.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[name] = (len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone) if not g))
    return out


def ran(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in S.remove_repeats(df, **options).collect()}


@pytest.mark.parametrize("bits", [64, 1])
def test_equal_to_brute_force(spark, bits):
    """With hashes of one bit unlike segments collide all the time."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(200), make(60)
    rows = [(0, base), (1, None), (2, ""), (3, "x" * 700), (4, "x" * 99), (5, "ab" * 400), (None, base)]
    for i in range(10, 40):
        parts = base.split()
        for _ in range(rng.randrange(6)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, " ".join(parts)))
    rows += [(i, make(30) + " " + passage + " " + make(rng.randrange(40))) for i in range(40, 60)]
    rows += [(60, passage + passage), (61, base), (62, base)]
    rng.shuffle(rows)
    assert ran(spark, rows, bits=bits) == brute(rows)


def test_colliding_hashes_in_one_scan_task_are_told_apart():
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab") for _ in range(300)).encode() for _ in range(20)]
    texts += [texts[3], texts[5][:200] + texts[4]]
    scan = S._Scan(4, 1)
    for i, t in enumerate(texts):
        scan.add(i, 0, t)
    gone = {}
    for row in scan.flush():
        if row[3]:
            gone[row[1]] = sorted(S.np.frombuffer(row[3], S._SPAN).tolist())
    assert gone[20] == [(0, 300)]
    assert all(texts[i][a:b] in b"|".join(texts[:i]) for i, spans in gone.items() for a, b in spans)


def test_long_text_over_several_blocks(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij ") for _ in range(1_300_000))
    rows = [(1, text), (2, "y" * 1000 + text[1_000_000:1_100_000] + "z" * 50), (3, "q" + text)]
    assert ran(spark, rows) == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    assert ran(spark, []) == {}
    df = spark.createDataFrame([(1, "a" * 50, "", 1)] * 3, SCHEMA)
    assert [(r["n_removed"], r["n_bytes"]) for r in S.remove_repeats(df).collect()] == [(0, 50)] * 3


def test_repeated_and_nameless_rows_over_the_length(spark):
    rng = random.Random(7)
    text, other = ("".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    rows = [(1, text), (None, other), (3, text[:250]), (4, text + text[:150])]
    want = brute(rows)
    assert want[1][1] == want[None][1] == 0 and want[3][1] == 250
    df = spark.createDataFrame([(i, t, "", 1) for i, t in rows * 3], SCHEMA)
    for parts in (1, 5):
        got = [(r["id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in S.remove_repeats(df.repartition(parts)).collect()]
        assert sorted(got, key=repr) == sorted([(i, want[i]) for i, _ in rows * 3], key=repr)


def test_sort_orders_and_groups():
    rng = np.random.default_rng(0)
    for shallow in (8, 16):
        for _ in range(40):
            buffer = np.concatenate([np.tile(rng.integers(97, 99, 40, dtype=np.uint8), 4), rng.integers(97, 99, 60, dtype=np.uint8)])
            length = int(rng.integers(17, 60))
            starts = rng.permutation(len(buffer) - length + 1)
            order, number = equal_classes(buffer, starts, length, shallow)
            got = [buffer[starts[i] : starts[i] + length].tobytes() for i in order]
            assert got == sorted(got)
            assert all((number[i] == number[i - 1]) == (got[i] == got[i - 1]) for i in range(1, len(got)))


def test_blind_trie():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(300)]
    trie, of = BlindTrie(), dict(enumerate(texts))
    for i, t in of.items():
        trie.add(t, i, of)
    leaves = list(trie.leaves())
    assert [of[leaf[0]] for leaf in leaves] == sorted(set(texts))
    assert sorted(i for leaf in leaves for i in leaf) == list(range(300))


def test_digest(spark):
    df = spark.createDataFrame([(1, "abc", "", 1)], SCHEMA)
    row = S.remove_repeats(df).collect()[0]
    assert hashlib.sha256(bytes(row["kept"])).hexdigest() == hashlib.sha256(b"abc").hexdigest()
