"""Edge cases and brute-force comparisons of the operators for training data."""

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from veriloom.llm import bpe, exact_dedup, jaccard, line_dedup, mixing, quality, queries, toxicity, topk, url_filter
from veriloom.llm.components import components

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, content string, key long, digest string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (5, "abc"), (6, "a  bc"), (7, "x" * 300_000), (None, "abc"), (8, "é漢 😀"), (4, "a b c")]


def docs(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, source, "c", 1, "d") for i, t in rows], SCHEMA)


# exact dedup


def exact_brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((i, t or ""))
    out = []
    for content, members in groups.items():
        best = min(range(len(members)), key=lambda n: (-len(members[n][1]), members[n][0] is None, members[n][0] or 0))  # the first of equals
        out += [(i, members[best][0], len(members), n == best, hashlib.sha256(content.encode()).hexdigest()) for n, (i, _) in enumerate(members)]
    return sorted(out, key=str)


def test_exact_dedup(spark):
    got = exact_dedup.exact_groups(docs(spark, ODD)).collect()
    assert sorted(map(tuple, got), key=str) == exact_brute(ODD)
    assert exact_dedup.exact_groups(docs(spark, [])).collect() == []
    kept = exact_dedup.keep_one_copy(docs(spark, ODD))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 7, 8]


def test_exact_dedup_of_repeated_ids_and_clashing_names(spark):
    rows = [(1, "a b"), (1, "a   b"), (1, "other"), (None, "a b"), *[(None, "n n")] * 5, (5, "same"), (5, "same")]
    df = spark.createDataFrame([(i, t, *"vwxyz") for i, t in rows], "doc_id long, text string, mark string, MARK_ string, winner string, __digest string, __id string")
    kept = exact_dedup.keep_one_copy(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, "a   b"), (1, "other"), (None, "n n"), (5, "same")], key=str)
    got = exact_dedup.exact_groups(df)
    assert sorted(got.where("kept").select("id").collect(), key=str) == sorted([(1,), (1,), (None,), (5,)], key=str)  # one a group
    assert got.count() == len(rows) and got.where("id = 5 and not kept").count() == 1
    assert [r["group_size"] for r in got.where("id is null").collect()].count(5) == 5


def test_exact_dedup_compares_content_when_digests_collide(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"text {i % 7}") for i in range(60)]
    got = exact_dedup.exact_groups(docs(spark, rows), digest=lambda c: F.substring(F.sha2(c, 256), 1, 0)).collect()
    assert sorted((r["id"], r["keep_id"], r["group_size"]) for r in got) == sorted(r[:3] for r in exact_brute(rows))


# byte-level BPE


def codecs():
    import tiktoken

    table = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines())}
    return bpe.Codec.parse(table, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken():
    own, theirs = codecs()
    rng = random.Random(1)
    kinds = ["abc '", "é漢 \x1c\x85x1 ", "a", "ab1 \n\t'sd", "".join(map(chr, range(0x20, 0x2100, 7)))]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randrange(60)))
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    for text in ("ab" * 30_000, "=" * 50_000, "".join(rng.choice("etaoin") for _ in range(50_000))):
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_bpe_query(spark):
    own, _ = codecs()
    got = bpe.encode_digests(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(ODD)
    for i, text in ODD[:8]:
        ids = own.encode(text or "")
        want = (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        assert want in [tuple(r) for r in got]
    whole = bpe.encode_documents(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert {bytes(r["decoded"]) for r in whole} == {(t or "").encode() for _, t in ODD}
    assert bpe.encode_digests(docs(spark, []), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect() == []


# URL filter


def url_brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_filter(spark):
    from veriloom.llm.queries import URL_RULES

    urls = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x", "http://example.org/en/12?q", "http://org/", "http://x.com/de/", "http://xcom/de/", "ftp://ü.com/fr/é#f", "http://a..org/", "http://org?x=/", "x://example.org/en/2\n/y"]
    urls += [f"http://h{i}.example.org/en/{i}" for i in range(300)]
    rows = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows, URL_RULES).collect()}
    assert got == {i: url_brute(u, URL_RULES) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(rows.limit(0), URL_RULES).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("cast(id as string) as key")
    listed = universe.where("cast(key as int) % 9 = 0")
    for rate in (0.2, None):
        cascade = url_filter.BloomCascade.build(listed, universe, rate=rate)
        assert len(cascade.levels) > 2
        assert universe.where(cascade.holds(spark, universe["key"]) != (universe["key"].cast("int") % 9 == 0)).count() == 0


def test_cascade_holds_millions_of_keys(spark):
    universe = spark.range(4_000_000).selectExpr("concat('h', id, '.org\n/') as key", "id")
    listed = universe.where("id % 4 <> 0").select("key")
    cascade = url_filter.BloomCascade.build(listed, universe.select("key"))
    assert sum(bits for bits, _, _ in cascade.levels) < 12 * 3_000_000
    assert universe.where(cascade.holds(spark, universe["key"]) != (universe["id"] % 4 != 0)).count() == 0


def test_url_filter_repeats_ties_and_long_urls(spark):
    from veriloom.llm.queries import URL_RULES

    urls = ["http://example.org/es/" + "x" * 200_000, "http://org/", "http://org/", "HTTP://a.com/fr/"]
    rows = spark.createDataFrame([(1, u, "k", "a", 3, 4) for u in urls], "page_id long, url string, keys string, hit string, a long, b long")
    got = sorted((r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(rows, URL_RULES).collect())
    assert got == sorted(url_brute(u, URL_RULES) for u in urls)
    tied = [("a.org", "/", "allow"), ("org", "/", "block"), ("org", "/x", "allow")]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(["http://a.org/x", "http://b.org/x", "http://b.org/y"])], "page_id long, url string")
    assert {r["id"]: r["rule"] for r in url_filter.filter_urls(rows, tied).collect()} == {0: "a.org/", 1: "org/x", 2: "org/"}
    assert {r["verdict"] for r in url_filter.filter_urls(rows, []).collect()} == {"allow"}

# top k


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(700, 20)) * rng.gamma(1.0, size=(700, 1))).astype(np.float32)
    x[600:650] = x[5]
    rows = [(i, v.tolist(), "s") for i, v in enumerate(x)] + [(800, None, "s"), (801, [float("nan")] * 20, "s"), (802, [None] * 20, "s"), (803, [1.0], "s"), (804, [float("inf")] * 20, "s"), (None, [1.0] * 20, "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, "id % 50 = 0").collect())
    y, want = np.floor(256 * x.astype(float)).astype(np.int64), []
    for q in range(0, 700, 50):
        s = y @ y[q]
        best = sorted((-int(v), i) for i, v in enumerate(s) if i != q)[:5]
        want += [(q, r + 1, i, -v) for r, (v, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), "id % 50 = 0").collect() == []
    few = topk.top_k(df.where("vec_id in (0, 1)"), "id % 50 = 0").collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]


def top_brute(rows, k=5):
    ints = [(i, [math.floor(v * 256) if math.isfinite(v * 256) else math.floor(v) * 256 for v in x]) for i, x in rows]
    out = []
    for q, x in ints:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(9)
    for top in (8388608.0, 1e7, 3e12, 1e30, 1e306):
        x = rng.normal(size=(120, 6))
        x[::7, 2] = top
        x[3::7, 1] = -top
        x[50, :] = x[57, :]
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, "id % 50 = 0").collect())
        assert got == top_brute(rows), top


def test_top_k_keeps_every_dimension_and_repeats(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(200)] + [(900, [1.0, 2.0]), (7, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as dim", "3 as square", "4 as lane")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, "id % 50 = 0").collect())
    assert got == top_brute(rows)


def test_top_k_broadcasts_no_queries(spark):
    rows = spark.range(400).selectExpr("id vec_id", "array(cast(id as float), cast(id % 7 as float), 1f) embedding")
    found = topk.top_k(rows, "id % 50 = 0")
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 8 * 5


def test_top_k_prunes():
    rng = np.random.default_rng(4)
    y = (rng.normal(size=(20_000, 64)) * np.geomspace(3000, 1, 20_000)[:, None]).astype(np.int64)
    rotation = np.linalg.svd(y.T.astype(float) @ y)[0]
    search = topk.Searcher(np.arange(50) + 10**6, y[::400][:50], rotation, 5)
    search.scan(np.arange(20_000), y[np.argsort(-(y**2).sum(1))])
    assert search.multiplied < 50 * 20_000 / 5


# mixing


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(200))), rng.choice(["a", "b", "c", "d", None]), "c", 1, "d") for i in range(400)]
    rows += [(1000, None, "e", "c", 1, "d"), (1001, "", "a", "c", 1, "d"), (None, "x y z", "a", "c", 1, "d")] + [(2000 + i, "w " * 3000, "huge", "c", 1, "d") for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by, total = {}, sum(r["size"] for r in got)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0, r["source_size"]])[1] += r["taken"]
    for target, taken, size in by.values():
        assert abs(taken - target) < 1 and target <= 2 * size + 1e-6
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-3
    assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(df.limit(0)).collect() == []


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([("a", 60_000, 5.0, 50_000.0), ("b", 60_000, 2.0, 20_000.0), ("c", 9_000, 1.0, 10_000.0)], "source string, source_size long, weight double, target double")
    rows = mixing.schedule(targets, 64).orderBy("slot").collect()
    for source, share in (("a", 5 / 8), ("b", 2 / 8), ("c", 1 / 8)):
        seen = list(itertools.accumulate(r["source"] == source for r in rows))
        assert max(abs(n - share * (i + 1)) for i, n in enumerate(seen)) < 12
        assert sum(r["words"] for r in rows if r["source"] == source) == {"a": 50_000, "b": 20_000, "c": 10_000}[source]


def test_mix_in_order_keeps_the_shares(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(1, 120))), rng.choice("aaaab"), *"wxyz") for i in range(900)] + [(i, "w " * 200, "c", *"wxyz") for i in range(900, 960)]
    rows += [(960, "", "a", *"wxyz"), (961, None, None, *"wxyz")] + [(None, "no id at all", "a", *"wxyz")] * 3 + [(5, "again " * 9, "b", *"wxyz")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string, slot string, of string, turns string")
    table, taken = mixing.in_order(df), mixing.mix(df).collect()
    assert table.columns == df.columns
    got = table.collect()
    assert [r["doc_id"] for r in got].count(960) == [r["doc_id"] for r in got].count(961) == 1
    whole = {r["id"]: r["taken"] / r["size"] for r in taken if r["size"] and r["id"] is not None and r["id"] != 5}
    for i, times in whole.items():
        assert abs(sum(r["doc_id"] == i for r in got) - times) <= 0.5
    assert sum(r["doc_id"] is None for r in got) == round(sum(r["taken"] / r["size"] for r in taken if r["id"] is None))
    target = {r["source"]: r["target"] for r in taken}
    total, seen, n = sum(target.values()), dict.fromkeys(target, 0), 0
    for r in got:
        size = len((r["text"] or "").split())
        seen[r["source"]], n = seen[r["source"]] + size, n + size
        if total / 20 < n < total * 0.9:  # any prefix but the shortest, up to where closing slots begin
            assert all(abs(seen[s] - n * target[s] / total) < 1500 for s in ("a", "b", "c"))
    slots = {r["id"]: r["first_slot"] for r in taken}
    order = [slots[r["doc_id"]] for r in got if slots.get(r["doc_id"]) is not None]
    assert sum(a <= b for a, b in zip(order, order[1:])) > 0.5 * len(order)
    assert mixing.in_order(df.limit(0)).collect() == []


# toxicity and quality


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(6)
    clean = ["alpha", "beta", "gamma", "delta", "omega", "sigma"] + [f"word{chr(97 + i)}" for i in range(20)]
    sample = []
    for i in range(600):
        sentences = [" ".join(rng.choice(clean) for _ in range(6)) for _ in range(rng.randrange(1, 8))]
        if i % 4 == 0:
            k = rng.randrange(len(sentences))
            sentences[k] += " " + rng.choice(["vile", "rotten"])
        sample.append((". ".join(sentences) + ".", int(i % 4 == 0)))
    model = toxicity.fit(sample)
    assert all((model.score(t) >= 0.5) == bool(y) for t, y in sample)
    rows = docs(spark, [(1, "alpha beta. you vile gamma. omega."), (2, "alpha. beta."), (3, None), (None, "")])
    found = toxicity.offending_sentences(rows, model).collect()
    assert [(r["id"], r["start"], r["end"]) for r in found] == [(1, 11, 26)]
    scored = {r["id"]: r for r in toxicity.score_documents(rows, model).collect()}
    assert scored[1]["predicted"] == 1 and scored[2]["predicted"] == scored[3]["predicted"] == 0
    assert sorted(r["doc_id"] or 0 for r in toxicity.keep_clean(rows, model).collect()) == [0, 2, 3]
    assert toxicity.fit([]).score("x") == toxicity.fit([]).score("")


def test_toxicity_is_independent_of_length(spark):
    model = toxicity.Model(-8.5, {"vile": 11.0, "stray": 3.0}, {"odd": 1.0})
    for n in (1_000, 10_000, 50_000):
        clean = "alpha beta stray. gamma odd delta. " * (n // 2)
        assert model.score(clean) < 0.01
        assert model.score(clean + "you vile gamma.") > 0.9
    assert model.score("") == model.score("alpha. " * 10_000) == toxicity.fit([]).score("x. " * 10_000) == 0


def test_toxicity_learns_from_long_texts(spark, monkeypatch):
    rows = docs(spark, [(i, "alpha beta. " * (5_000 if i % 4 == 0 else 5)) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, weigh: seen.extend(sample))
    toxicity.fit_model(rows, labels)
    assert any(len(t) > 40_000 for t, _ in seen) and any(len(t) < 1_000 for t, _ in seen)


def test_quality(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # needs an interaction
    model = quality.fit(x[:2000], y[:2000], np.ones(2000))
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    assert quality.Model().score(np.zeros((2, 4))).tolist() == [0.5, 0.5]
    rows = docs(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    got = quality.score_documents(rows, quality.fit_model(rows, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert len(quality.measure(b"")) == len(quality.FEATURES) == len(quality.measure("é a\nA".encode()))


def slow_toxicity(model, text):
    """Noisy-or of the sentences above the floor, one word after the other."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]+", (text or "").lower()):
        logit = model.bias
        for word in re.findall(r"[^\W\d_]+", sentence):
            logit += model.weights.get(word, 0.0) + model.stems.get(word[: toxicity.STEM], 0.0)
        if logit > toxicity.FLOOR:
            clean *= 1 - 1 / (1 + math.exp(-logit))
    return 1 - clean


def slow_quality(model, features):
    """One look into each table."""
    total, bins = model.bias, []
    for j, edges in enumerate(model.edges):
        bins.append(sum(1 for e in edges if features[j] >= e))
        total += model.tables[j][bins[j]]
    for i, j, table in model.pairs:
        total += table[bins[i] * quality.COARSE // quality.BINS][bins[j] * quality.COARSE // quality.BINS]
    return 1 / (1 + math.exp(-total))


def test_scores_equal_slow_twins(spark):
    folder = "/root/testdata/sf0.001"
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    model = toxicity.fit_model(rows, labels)
    for r in toxicity.score_documents(rows, model).collect():
        assert r["score"] == pytest.approx(slow_toxicity(model, texts[r["id"]]), abs=1e-9)
    model = quality.fit_model(rows, labels)
    for r in quality.score_documents(rows, model).collect():
        assert r["score"] == pytest.approx(slow_quality(model, quality.measure((texts[r["id"]] or "").encode())), abs=1e-9)


def test_toxicity_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    of_bag = np.repeat(np.arange(12), rng.integers(1, 4, 12))
    words, of_sentence = rng.integers(0, 6, 60), np.sort(rng.integers(0, len(of_bag), 60))
    y, share, w = (np.arange(12) % 3 == 0).astype(float), rng.random(12), rng.normal(size=6)
    data = (words, of_sentence, of_bag, y, share)
    _, g, g_bias = toxicity.loss_and_slopes(w, -1.0, *data)
    for i in range(6):
        step = np.eye(6)[i] * 1e-5
        assert g[i] == pytest.approx((toxicity.loss_and_slopes(w + step, -1.0, *data)[0] - toxicity.loss_and_slopes(w - step, -1.0, *data)[0]) / 2e-5, rel=1e-4, abs=1e-7)
    assert g_bias == pytest.approx((toxicity.loss_and_slopes(w, -1 + 1e-5, *data)[0] - toxicity.loss_and_slopes(w, -1 - 1e-5, *data)[0]) / 2e-5, rel=1e-4)


def test_classifiers_take_odd_rows(spark):
    rows = docs(spark, ODD + [(1, "vile words. " * 60_000), (4, "a b c")])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)] + [(1, 1, 1), (None, 1, 1), (2, None, 7)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.fit_model(rows, labels)
        got = module.score_documents(rows, model).collect()
        assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["id"] == 4}) == 1
        assert module.score_documents(rows.limit(0), model).collect() == []
        assert module.fit_model(rows.limit(0), labels.limit(0)) is not None
    assert toxicity.keep_clean(rows.limit(0), model=toxicity.Model(0.0, {}, {})).collect() == []


def judged(spark, folder, module, label):
    rows, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = module.score_documents(rows, module.fit_model(rows, labels)).withColumnRenamed("id", "doc_id")
    found = scored.join(labels, "doc_id").where("held_out").selectExpr("predicted p", f"{label} y").collect()
    hits = sum(r["p"] == r["y"] == 1 for r in found)
    return hits / max(1, sum(r["y"] for r in found)), hits / max(1, sum(r["p"] for r in found)), sum(r["p"] == r["y"] for r in found) / len(found)


def test_held_out_toxicity(spark):
    recall, precision, _ = judged(spark, "/root/testdata/sf0.1", toxicity, "toxic")
    assert recall >= 0.78 and precision >= 0.88


def test_held_out_quality(spark):
    recall, precision, right = judged(spark, "/root/testdata/sf0.01", quality, "quality")
    assert right >= 0.97 and recall >= 0.95 and precision >= 0.95


# Jaccard join


def jaccard_brute(rows):
    texts = {}
    for i, t in rows:
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        texts.setdefault(words, []).append(i)
    names = {min(v): k for k, v in texts.items() if k}
    sets = {n: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for n, w in names.items()}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = {n: n for n in names}
    for _ in names:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    out = {}
    for words, members in texts.items():
        for i in members:
            n = min(members)
            out[i] = (root[n], sum(n in p for p in links), len(members) - 1) if words else (i, 0, 0)
    return out


def family_rows(rng, sizes, first=10):
    words, rows = [f"w{i}" for i in range(4000)], []
    for size in sizes:
        base = [rng.choice(words) for _ in range(150)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(150)] = rng.choice(words)
            rows.append((first + len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("chunk,dense,sample,hot", [(4, 64, 64, 32), (512, 64, 64, 32), (512, 3, 64, 32), (7, 64, 1, 2)])
def test_jaccard(spark, monkeypatch, chunk, dense, sample, hot):
    """Plain; with many chunks; with nearly all trie nodes dense; with nearly all nodes hot."""
    for name, value in (("CHUNK", chunk), ("SAMPLE", sample), ("HOT", hot)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "one  two "), (4, "one two three"), (5, "z " * 40)]
    rows += family_rows(rng, (1, 2, 3, 30))
    name = 10 + 36
    rows += [(name, rows[8][1]), (name + 1, rows[8][1].replace(" ", "\n"))]
    rng.shuffle(rows)
    got = {r["id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in jaccard.near_classes(docs(spark, rows), dense=dense).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_edges(spark):
    assert jaccard.near_classes(docs(spark, [])).collect() == []
    got = jaccard.near_classes(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted((str(r["class_id"]), r["n_copies"]) for r in got if r["id"] is None) == [("5", 1)]
    assert jaccard.floor_depth() == 5
    kept = jaccard.keep_one_of_class(docs(spark, [(3, "a b c"), (1, "a b c"), (2, "x")])).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 2]


def test_jaccard_repeated_and_missing_ids(spark):
    rng = random.Random(4)
    base = " ".join(f"w{rng.randrange(9)}{i}" for i in range(60))
    near = base + " end"
    rows = [(1, base), (2, base), (2, "an entirely different text of words"), (None, near), (None, "on its own"), (None, "on its own"), (None, ""), (7, ""), (7, ""), (8, near)]
    df = spark.createDataFrame([(i, t, *"pqrst") for i, t in rows], "doc_id long, text string, mark string, words string, gone string, __gone string, MARK_ string")
    kept = jaccard.keep_one_of_class(df)
    assert kept.columns == df.columns
    want = [(1, base), (2, rows[2][1]), (None, "on its own"), (None, ""), (7, ""), (7, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    alone = jaccard.near_classes(spark.createDataFrame([(None, base), (None, near)], "doc_id long, text string")).collect()
    assert [(r["class_id"], r["n_links"]) for r in alone] == [(None, 1)] * 2 and sum(r["stays"] for r in alone) == 1
    full = jaccard.near_classes(spark.createDataFrame([((1 << 63) - 1, base), (-(1 << 62), near), (-(1 << 62), "x")], "doc_id long, text string")).collect()
    assert sorted((r["class_id"], r["n_links"]) for r in full) == [(-(1 << 62), 0), (-(1 << 62), 1), (-(1 << 62), 1)]


def test_prefixes_are_shortened_until_the_recall(spark):
    rows = [(n, d) for n, depths in enumerate([[8] * 25, [8] * 3, [7] * 10 + [6] * 15, [6] * 2, [8] * 12]) for d in depths]
    below = spark.createDataFrame(rows, "node int, depth int")
    for recall in (0.9, 0.99, 0.9995):
        floor = jaccard.floor_depth(recall=recall)
        got = {r["node"]: r["steps"] for r in jaccard.shortened(below.where(f"depth > {floor}"), 0.8, 25, floor, recall).collect()}
        for n in got:
            own = [d for m, d in rows if m == n and d > floor]
            reached = lambda k: 1 - math.prod(1 - 0.8 ** max(floor, d - k) for d in own) * (1 - 0.8**floor) ** (25 - len(own)) >= recall
            assert got[n] == next(k for k in range(9 - floor) if reached(k) or k == 8 - floor)


def test_dense_prefixes_stay_longer(spark):
    """Texts that only share a dense prefix aren't tied by it where other trees give the recall; without shortening they'd be lost."""
    forest = jaccard.Forest()
    near = family_rows(random.Random(1), (2,))
    labels = [forest.labels(jaccard.shingles(t.encode())).ravel() for _, t in near]
    rng = np.random.default_rng(2)
    crowd = [rng.integers(0, 1 << 64, 50, dtype=np.uint64) for _ in range(40)]
    for i, x in enumerate(crowd):
        x[0], x[1] = labels[0][0], (int(labels[0][1]) & ~((1 << 48) - 1)) | i << 32  # the first five values of the first tree
    table = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate([*labels, *crowd])], "node long, labels binary")
    ties = lambda dense: {tuple(sorted(r)) for r in jaccard._ties(table, 4, 0.8, 25, 0.9995, dense)[0].collect()}
    assert len(ties(100)) >= 41 and (0, 1) in ties(100)
    assert (0, 1) in ties(8) and len(ties(8)) < 10


def test_differences_give_the_same_links():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [base]
    for _ in range(30):
        keep = base[rng.random(len(base)) > rng.choice([0.0, 0.05, 0.2, 0.6])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.choice([0, 8, 60])), dtype=np.uint64)])))
    every = np.arange(len(sets))
    parts = [jaccard.difference(s, base) for s in sets]
    got = jaccard.linked([x for x, _ in parts], every, every, 0.8, np.array([len(s) for s in sets]), np.array([n for _, n in parts]), len(base))
    want = [[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets]
    apart = ~np.eye(len(sets), dtype=bool)  # a text isn't compared with itself
    assert (got == np.array(want))[apart].all() and got[apart].sum() > 20 and (jaccard.linked(sets, every, every) == got)[apart].all()


def inverted_links(rows):
    """Number of links of each text by its least id, over an inverted index of shingles of all rows."""
    first = {}
    for i, t in sorted(rows):
        words = tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        if words:
            first.setdefault(words, i)
    sets = {i: {w[j : j + 5] for j in range(max(1, len(w) - 4))} for w, i in first.items()}
    holders, links = {}, dict.fromkeys(sets, 0)
    for i, shingles in sets.items():
        seen = {}
        for g in shingles:
            for j in holders.setdefault(g, []):
                seen[j] = seen.get(j, 0) + 1
            holders[g].append(i)
        for j, both in seen.items():
            if both / (len(shingles) + len(sets[j]) - both) >= 0.8:
                links[i], links[j] = links[i] + 1, links[j] + 1
    return links


def test_jaccard_recall_over_all_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = inverted_links([tuple(r) for r in table.collect()])
    got = {r["id"]: r["n_links"] for r in jaccard.near_classes(table).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values()) > 0


def test_components_of_hubs(spark):
    edges = [(0, i) for i in range(1, 1200)] + [(i, 2000 + i) for i in range(1, 40)] + [(5000, 5001)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: 5000 if n >= 5000 else 0 for e in edges for n in e}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)]
    root = list(range(500))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root[n] for e in edges for n in e if e[0] != e[1]}


# line dedup


def line_brute(rows):
    """By id: kept, lines, lines removed, chunks removed, with first occurrences by id and line."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, kept, gone, n = (t or "").encode().split(b"\n"), [], 0, 0
        for a, b in line_dedup.chunks_of(lines):
            content = b"\n".join(lines[a:b])
            if b - a > 1 and sum(1 for x in lines[a:b] if x.strip()) > 1 and content in seen:
                gone, n = gone + b - a, n + 1
            else:
                kept += lines[a:b]
                seen.add(content)
        out[i] = (b"\n".join(kept).decode(), len(lines), gone, n)
    return out


@pytest.mark.parametrize("digest", [line_dedup.digest_of, lambda content: (0, len(content) % 2)])
def test_line_dedup(spark, digest):
    rng = random.Random(11)
    lines = [f"line number {i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "same\n" * 50), (4, "one line")]
    passage = "\n".join(f"passage {i}" for i in range(20))
    for i in range(10, 40):
        own = [rng.choice(lines) for _ in range(rng.randrange(8))]
        rows.append((i, "\n".join([*own, passage, *own[::-1]]) if i % 2 else "\n".join(own)))
    rows += [(50, rows[20][1]), (None, rows[21][1])]
    got = {r["id"]: (r["kept"], r["n_lines"], r["n_removed"], r["n_chunks"]) for r in line_dedup.remove_repeated_chunks(docs(spark, rows), digest=digest).collect()}
    assert got == line_brute(rows)
    assert line_dedup.remove_repeated_chunks(docs(spark, [])).collect() == []


def run_brute(rows):
    """Repeated runs by comparing lines from every earlier place: no pairs, no chunks."""
    texts = [(i, (t or "").split("\n")) for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    gone, places = {}, [(n, j) for n, (_, lines) in enumerate(texts) for j in range(len(lines))]
    for n, j in places:
        for m, k in places[: places.index((n, j))]:
            size = 0
            while j + size < len(texts[n][1]) and k + size < len(texts[m][1]) and texts[n][1][j + size] == texts[m][1][k + size]:
                size += 1
            full = [x for x in range(j, j + size) if texts[n][1][x].strip()]
            if len(full) > 1:
                gone.setdefault(n, set()).update(range(full[0], full[-1] + 1))
    out = {}
    for n, (i, lines) in enumerate(texts):
        drop = gone.get(n, set())
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in drop), len(lines), len(drop), sum(k - 1 not in drop for k in drop))
    return out


@pytest.mark.parametrize("digest", [line_dedup.digest_of, lambda content: (0, len(content) % 2)])
def test_repeated_runs_go_whole(spark, digest):
    rng = random.Random(12)
    rows = [(0, None), (1, ""), (2, "\n\n\n"), (3, "same\n" * 6), (4, "one line")]
    passages = {n: [f"passage {n} {k}" for k in range(n)] for n in (2, 3, 5, 12)}
    passages[4] = ["a", "", " ", "b"]
    for i in range(10, 34):
        name = (2, 3, 4, 5, 12)[i % 5]
        rows.append((i, "\n".join([f"head {i}", *passages[name], *(["", "x"] if i % 2 else []), f"tail {i}"])))
    rows += [(40, "\n".join(rng.choice("abcd") for _ in range(12))), (50, rows[9][1]), (None, rows[12][1])]
    rng.shuffle(rows)
    found = line_dedup.remove_repeated_runs(docs(spark, rows), digest=digest).collect()
    got = {r["id"]: (r["kept"], r["n_lines"], r["n_removed"], r["n_chunks"]) for r in found}
    assert got == run_brute(rows)
    assert got[15][0].split("\n")[:1] == ["head 15"] and got[16][2] == 3  # a passage of three lines goes as a whole
    assert line_dedup.remove_repeated_runs(docs(spark, [])).collect() == []


def test_line_dedup_query_takes_whole_runs(spark, tmp_path):
    passage = "\n".join(f"line {k}" for k in range(3))
    docs(spark, [(i, f"head {i}\n{passage}\ntail {i}") for i in range(20)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_removed"] for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {i: 3 if i else 0 for i in range(20)}


def test_chunks_resist_shifts():
    lines = [f"line {i}".encode() for i in range(300)]
    cut = lambda x: {b"\n".join(x[a:b]) for a, b in line_dedup.chunks_of(x)}
    assert len(cut(lines) - cut([b"new", *lines])) <= 1
    assert line_dedup.chunks_of([]) == []


def test_line_dedup_of_long_texts_and_odd_names(spark):
    text = "\n".join(f"line {i}" for i in range(40_000))
    rows = [(1, text), (2, "head\n" + text + "\ntail"), (2, "head\n" + text + "\ntail"), (None, None)]
    df = spark.createDataFrame([(i, t, *"abcde") for i, t in rows], "doc_id long, text string, key string, tie string, salt string, gone string, spans string")
    got = sorted((r["n_lines"], r["n_removed"], r["n_chunks"]) for r in line_dedup.remove_repeated_runs(df).collect())
    assert got == [(1, 0, 0), (40_000, 0, 0), (40_002, 40_000, 1), (40_002, 40_000, 1)]


# pipeline


def test_pipeline_equals_brute_force(spark):
    """Each stage's rows against plain Python on what the stage before kept."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram jaccard join", "source mixing", "byte-level bpe"]
    now = [(r["doc_id"], r["text"]) for r in rows.collect()]

    def ran(name):
        nonlocal rows
        out = stages[name](spark, rows, folder)
        assert name == "byte-level bpe" or out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
        return rows

    model = toxicity.fit_model(rows, spark.read.parquet(f"{folder}/labels.parquet"))
    now = [(i, t) for i, t in now if slow_toxicity(model, t) < toxicity.THRESHOLD]
    assert sorted(r["doc_id"] for r in ran("toxicity").collect()) == sorted(i for i, _ in now)
    now = [(i, t) for i, t in now if (i, True) in {(r[0], r[3]) for r in exact_brute(now)}]
    assert sorted(r["doc_id"] for r in ran("exact dedup").collect()) == sorted(i for i, _ in now)
    classes = jaccard_brute(now)
    now = [(i, t) for i, t in now if classes[i][0] == i]
    assert sorted(r["doc_id"] for r in ran("n-gram jaccard join").collect()) == sorted(i for i, _ in now)
    times = {r["id"]: r["taken"] / r["size"] if r["size"] else 1 for r in mixing.mix(rows).collect()}
    got = [r["doc_id"] for r in ran("source mixing").collect()]
    assert set(got) <= set(times) and all(abs(got.count(i) - n) <= 0.5 for i, n in times.items())
    _, theirs = codecs()
    texts = dict(now)
    coded = ran("byte-level bpe").collect()
    assert sorted(r["doc_id"] for r in coded) == sorted(got)
    for r in coded:
        ids = theirs.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())


def test_pipeline_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one two three", "a"), (4, "other words here", "b"), (None, "no id", "b"), (None, "no id", "b"), (5, long, "a"), (6, long + " x", "a"), (6, long + " x", "a")]
    schema = "doc_id long, text string, source string, __gone string, __id string, mark string, words string, slot string"
    df = spark.createDataFrame([(*r, *"abcde") for r in rows], schema)
    spark.createDataFrame([(4, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, part in (("some", df), ("none", df.limit(0))):
        folder = tmp_path / name
        part.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "labels.parquet")).write.parquet(str(folder / "labels.parquet"))
        kept = part
        for stage, function in corpus_pipeline.STAGES[:3]:
            kept = function(spark, kept, str(folder))
            assert kept.columns == df.columns, stage
        found = sorted({(r["doc_id"], (r["text"] or "")[:5].strip()) for r in kept.collect()}, key=str)
        assert found == ([] if name == "none" else sorted({(3, ""), (4, "one t"), (4, "other"), (None, "no id"), (5, "w0 w1")}, key=str))
        final = corpus_pipeline.run(spark, str(folder))
        assert final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and (final.count() > 0) == (name == "some")


def test_pairs_know_their_chunk():
    lines = [f"line {i}".encode() if i % 5 else b"" for i in range(200)]
    spans = line_dedup.all_spans(lines)
    chunks = {(a, b) for a, b, kind, _ in spans if kind == 0}
    assert chunks == set(line_dedup.whole_chunks(lines)) and len(chunks) > 20
    for a, b, kind, inside in spans:
        if kind == 1:
            assert inside == next((x for x, y in chunks if x <= a and b <= y), -1)
