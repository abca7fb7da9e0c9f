"""A Merkle manifest of a table: leaves, subroots of sources, the root, proofs, and folds that show tampering.

Each row is a leaf; the leaves of a source, by id, form a tree of fan-out 16, and the sources' roots form one more.
The upper tree is small and broadcast:

1. large blocks: rows get their places in their source by ranges (placing.py), 4,096 successive leaves meet in one
   row of a written table, and each block is reduced by three levels to one node. While more than `MOST_TOP` nodes are
   left, blocks of nodes are reduced again in the same way, trees of one node each as the leaves of the tree of sources;
2. the driver gets at most `MOST_TOP` nodes, builds the upper tree and broadcasts the path of each of them to the root:
   at most six levels of 15 siblings, so 23 MB at most;
3. executors finish: a scan of the written blocks, without a shuffle, completes every row's proof and folds its leaf.

Statements. H is SHA-256 as lowercase hex over concatenated inputs. A column is `-` if null, else its length in UTF-8
bytes, `:` and the value, so texts of any length and empty ones are plain values. Null ids come first in their source,
the null source is one of its own and comes first; rows that repeat an id are ordered by leaf, and rows that agree in
that too are interchangeable. A row without id is never tampered with. An empty table gives no rows. Other columns,
whatever their names, are not touched.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, ship
from .placing import placed

FAN, ROUNDS = 16, 3
#: The driver gets so many nodes at most.
MOST_TOP = 4096
DIGEST = 64


def leaf_of(values: list[Column]) -> Column:
    fields = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*fields), 256)


def _hash(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def rounds_of(n: int) -> int:
    """Levels above n nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // FAN), out + 1
    return out


def _runs(nodes: list[bytes], rounds: int) -> tuple[bytes, list[list[bytes]]]:
    """The node above, and for each level its runs of siblings, concatenated."""
    levels = []
    for _ in range(rounds):
        levels.append([b"".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [_hash(run) for run in levels[-1]]
    return nodes[0] if len(nodes) == 1 else b"", levels


def _path(levels: list[list[bytes]], place: int) -> list[bytes]:
    """What lies before and after the node at `place`, for each level in turn."""
    out = []
    for runs in levels:
        run, at = runs[place // FAN], place % FAN * DIGEST
        out += [run[:at], run[at + DIGEST :]]
        place //= FAN
    return out


def fold(node: bytes, path: list[bytes]) -> bytes:
    for before, after in zip(path[::2], path[1::2]):
        node = _hash(before + node + after)
    return node


def _block_reducer(deep: int):
    """Rows (tree, block, n, nodes) to the node of each block and the paths of its members, `deep` levels up."""

    def reduce(batches):
        for batch in batches:
            trees, blocks, sizes, digests, paths = [], [], [], [], []
            for tree, block, n, nodes in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "nodes"))):
                top, levels = _runs([x["digest"] for x in nodes], min(deep, rounds_of(n)))
                trees.append(tree), blocks.append(block), sizes.append(-(-n // FAN**deep)), digests.append(top)
                paths.append([{"at": x["place"], "path": _path(levels, i)} for i, x in enumerate(nodes)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees, pa.int64()), pa.array(blocks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(paths, pa.list_(pa.struct([("at", pa.int64()), ("path", pa.list_(pa.binary()))])))],
                names=["tree", "place", "n", "digest", "paths"],
            )

    return reduce


_REDUCED = "tree long, place long, n long, digest binary, paths array<struct<at: long, path: array<binary>>>"


def _leaf_reducer(deep: int):
    """The node of each block of leaves."""

    def reduce(batches):
        for batch in batches:
            members, sizes, digests, at = batch.column("rows"), batch.column("n").to_pylist(), [], 0
            leaves = [x.hex().encode() for x in members.flatten().field("leaf").to_pylist()]
            for n, length in zip(sizes, members.value_lengths().to_pylist()):
                digests.append(_runs(leaves[at : at + length], min(deep, rounds_of(n)))[0])
                at += length
            above = pa.array([-(-n // FAN**deep) for n in sizes], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("block"), above, pa.array(digests, pa.binary())], names=["tree", "place", "n", "digest"])

    return reduce


def _finisher(top, kind: str, deep: int):
    """Proofs and folds of a block's rows; top: the broadcast paths by node."""

    def finish(batches):
        schema = pa.schema([("id", pa.int64()), ("place", pa.int64())] + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("proof", pa.binary())] * (kind == "proof"))
        for batch in batches:
            for tree, at, n, lower, rows in zip(*(batch.column(c) for c in ("up_tree", "up_place", "n", "path", "rows"))):
                path = (lower.as_py() or []) + top.value[tree.as_py(), at.as_py()]
                rounds, rows = rounds_of(n.as_py()), rows.values
                leaves = [x.hex().encode() for x in rows.field("leaf").to_pylist()]
                changed = rows.field("changed").to_pylist()
                here = min(deep, rounds)
                node, levels = _runs(leaves, here)
                subroot = fold(node, path[: 2 * (rounds - here)])
                root = fold(subroot, path[2 * (rounds - here) :])
                above, columns = {}, [[] for _ in range(4)]
                for i, leaf in enumerate(leaves):
                    if i // FAN not in above:
                        up = (_path(levels[1:], i // FAN) if levels else []) + path
                        above[i // FAN] = up, b"".join(up)
                    up, joined = above[i // FAN]
                    own = _path(levels[:1], i)
                    siblings = b"".join(own) + joined
                    start = changed[i].hex().encode() if changed[i] is not None else leaf
                    columns[0].append(leaf.decode())
                    columns[1].append(sha256(siblings).hexdigest())
                    columns[2].append(fold(start, own + up).decode())
                    if kind == "proof":
                        columns[3].append(siblings)
                whole = lambda x: pa.array([x.decode()] * len(leaves), pa.string())  # noqa: E731, B023
                parts = [rows.field("id"), rows.field("place"), pa.array(columns[0], pa.string()), whole(subroot), whole(root), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                yield pa.RecordBatch.from_arrays(parts + ([pa.array(columns[3], pa.binary())] if kind == "proof" else []), schema=schema)

    return finish


def _top_paths(nodes: list) -> dict:
    """nodes: (tree, place, n, digest) in order, all that is left of every tree. The path of each to the root."""
    trees: dict[int, list] = {}
    for tree, _, n, digest in nodes:
        trees.setdefault(tree, []).append((n, bytes(digest)))
    built = {t: _runs([d for _, d in members], rounds_of(members[0][0])) for t, members in trees.items()}
    levels = _runs([top for top, _ in built.values()], rounds_of(len(built)))[1] if built else []
    return {(t, i): _path(built[t][1], i) + _path(levels, k) for k, (t, members) in enumerate(trees.items()) for i in range(len(members))}


def _as_leaves(nodes: DataFrame, n: int) -> DataFrame:
    """Roots of n trees as the leaves of one tree, numbered 0: of (the tree they root), tree, place, n, digest."""
    found = placed(nodes.select(F.lit(0).alias("all"), F.col("tree").alias("of"), "digest"), "all", ["of"])
    return found.select("of", F.lit(0).cast("long").alias("tree"), "place", F.lit(n).cast("long").alias("n"), "digest")


def manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"),
    tampering: dict[str, Column] | None = None, tampered: Column | None = None, with_proof: bool = False, most_top: int = MOST_TOP, deep: int = ROUNDS,
) -> DataFrame:
    """One row a row of docs: id, place in its source, leaf, subroot, root, proof_sha256, folded_root, verified.

    `tampering` gives other values of columns, taken where `tampered` holds: folded_root is what the leaf of those
    values gives with the proof, else what the row's own leaf gives. `with_proof` adds the siblings' digests, as hex.
    Blocks are `deep` levels high.
    """
    spark = ship(docs.sparkSession)
    own = leaf_of([F.col(f"`{c}`") for c in columns])
    other = leaf_of([(tampering or {}).get(c, F.col(f"`{c}`")) for c in columns])
    changed = F.when(F.coalesce(tampered, F.lit(False)), F.unhex(other)) if tampering else F.lit(None).cast("binary")
    leaves = cut(docs.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(own).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("uid")))
    rows = placed(leaves, "source", ["id", "leaf", "uid"])
    member = F.struct("place", "id", "leaf", "changed")
    blocks = cut(rows.groupBy("tree", "n", F.floor(F.col("place") / FAN**deep).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("rows")))  # FAN ** deep rows at most
    discard(leaves)
    nodes = cut(blocks.mapInArrow(_leaf_reducer(deep), "tree long, place long, n long, digest binary"))
    steps = []
    while (left := nodes.count()) > most_top:
        if nodes.where("n > 1").isEmpty():  # one node a tree: from now on they are the leaves of one
            ranked = cut(_as_leaves(nodes, left))
            steps.append(ranked.select("of", F.lit(0).cast("long").alias("place"), F.array().cast("array<binary>").alias("more"), F.col("tree").alias("tree0"), F.col("place").alias("place0")).withColumnRenamed("of", "tree"))
            nodes = ranked.select("tree", "place", "n", "digest")
            continue
        grouped = nodes.groupBy("tree", "n", F.floor(F.col("place") / FAN**deep).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("nodes"))
        reduced = cut(grouped.mapInArrow(_block_reducer(deep), _REDUCED))
        member = F.explode("paths").alias("m")
        steps.append(reduced.select("tree", F.col("place").alias("place0"), member).select("tree", F.col("m.at").alias("place"), F.col("m.path").alias("more"), F.col("tree").alias("tree0"), "place0"))
        nodes = reduced.select("tree", "place", "n", "digest")
    paths = _top_paths([tuple(r) for r in nodes.orderBy("tree", "place").collect()])
    top = spark.sparkContext.broadcast(paths)
    up = blocks.withColumn("up_tree", F.col("tree")).withColumn("up_place", F.col("block")).withColumn("path", F.array().cast("array<binary>"))
    for step in steps:
        s = step.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), "more", "tree0", "place0")
        up = up.join(s, (F.col("up_tree") == F.col("_t")) & (F.col("up_place") == F.col("_p")))
        up = up.withColumn("path", F.concat("path", "more")).withColumn("up_tree", F.col("tree0")).withColumn("up_place", F.col("place0")).drop("_t", "_p", "more", "tree0", "place0")
    kind = "proof" if with_proof else ""
    shape = "id long, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string" + (", proof binary" if with_proof else "")
    found = up.select("up_tree", "up_place", "n", "path", "rows").mapInArrow(_finisher(top, kind, deep), shape)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
