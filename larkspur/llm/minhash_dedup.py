"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's set holds its distinct word shingles. Documents with equal sets are collapsed first. The rest
walk down random trees: in every node a few minhash functions are drawn from the node's own key, and a
document moves to the child named by the function and the document's minimum under it, so that similar
documents share children. A node with few members is compared exhaustively; a larger one first compares all
members with one pivot, near to most of them, which gathers a family of near copies in linear time, and then
branches; members known to be of one component are not compared again. Several
independent trees run side by side. All candidate pairs are confirmed on the full sets.

Minimums hardly tell the members of a dense node apart. Such a node branches by shingles in which its members
differ from the pivot p: let D(x) hold the shingles of just one of x and p. For sizes |x|, |y| and similarity s, a
link needs |D(x) - D(y)| + |D(y) - D(x)| <= r (|x| + |y|), r = (1 - s) / (1 + s). So a linked pair that isn't wholly linked with
the pivot shares more than (|D(y)| - r (|y| - |p|)) / 2 of D(y), and as a rule few of its many members share that: D is put
in order, those first that the fewest members' D hold, and two members meet at a shingle only if as much of both D is left
from there on as they must share. No linked pair is lost there. Such a node ends there, whatever its size: rows are
as many as its differences, and pairs as many as meet at rare ones.

At a similarity of 0.8 a pair shares a child with probability 1 - 0.2^3 in each tree's first level and
1 - 0.2^2 on later ones; three trees find it with probability above 1 - 1e-5 at any depth used here.

Defined results: null text, empty text or text without words gives an empty set, linked with nothing; null
doc_id rows are never linked and keep a null component; repeated rows share their fate; rows that share a doc_id
but not a text are each judged by their own text, and others link with such a doc_id if they do with any of its
texts. Extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm import textnp as tx
from larkspur.llm.common import BROADCAST_ROWS, small, written
from larkspur.llm.graph import connected_components

TREES, FIRST_BRANCHES, BRANCHES = 3, 3, 2
#: Minhash functions, of which a node draws its own; bits of the sketch that drops candidates far below the threshold.
COORDINATES, SKETCH_BITS = 48, 128
#: Steps through the coordinates, none with a factor in common with their number.
STRIDES = (5, 7, 11, 13, 17, 19, 23)
#: A node whose pairs to compare are at most LEAF / 2 for each member is compared exhaustively.
LEAF = 32
#: Random members of a large node that its pivot should be near.
SAMPLES = 4
#: Large nodes whose members differ from random ones in this many bits of the sketch or fewer, on average, do not
#: branch well; they, and all large nodes one level above the last, are compared by their differences from the pivot.
DENSE, MAX_DEPTH = 36, 4
#: Differences that a task hands on at once.
HANDED = 1_000_000
#: Tasks that the members of one pivot are dealt to, at most.
SALTS = 32

SIGNED = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, k1 bigint, k2 bigint, mh array<int>"


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240817)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(offs: np.ndarray, data: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles; a shorter word sequence counts as one."""
    words = tx.split(data, offs, tx.SPACE, lower=True)
    hashes = words.hashes()
    runs = tx.run_hashes(hashes, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield tx.run_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield hashes[:0]


def _signer(width: int):
    def sign(batches):
        mul, add = _multipliers(max(COORDINATES, SKETCH_BITS))
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            offs, data = tx.text_buffers(batch.column(1))
            ids = batch.column(0)
            out = {k: [] for k in ("n", "d1", "d2", "k1", "k2", "mh")}
            for at, to in tx.row_slices(offs):
                part = offs[at : to + 1] - offs[at]
                for own in shingle_sets(part, data[offs[at] : offs[to]], width):
                    low = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
                    for i in range(0, len(own), 2048):
                        np.minimum(low, (own[i : i + 2048, None] * mul + add).min(axis=0), out=low)
                    low = tx.mix(low)
                    bits = low[:SKETCH_BITS] & np.uint64(1)
                    out["n"].append(len(own))
                    out["d1"].append(own.sum(dtype=np.uint64))
                    out["d2"].append(tx.mix(own + np.uint64(0x5BD1E995)).sum(dtype=np.uint64))
                    out["k1"].append((bits[:64] * weights).sum(dtype=np.uint64))
                    out["k2"].append((bits[64:] * weights).sum(dtype=np.uint64))
                    out["mh"].append((low[:COORDINATES] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            n = len(ids)
            values = np.concatenate(out["mh"]) if n else np.zeros(0, np.int32)
            mh = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COORDINATES), pa.array(values))
            longs = [pa.array(np.array(out[k], np.uint64).view(np.int64)) for k in ("d1", "d2", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n"], pa.int64()), *longs, mh], names=["doc_id", "n_shingles", "d1", "d2", "k1", "k2", "mh"])

    return sign


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """One row per document: set size, a 128-bit digest of the set (d1, d2), a sketch (k1, k2), minhashes (mh)."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_signer(width), SIGNED)


def _apart(a1: F.Column, a2: F.Column, b1: F.Column, b2: F.Column) -> F.Column:
    """In how many bits two sketches differ."""
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def _near(x: str, y: str, percent: int) -> F.Column:
    """Whether sizes allow the similarity, and sketches agree as such pairs do (the miss rate at the threshold is about 1e-6)."""
    similarity = percent / 100
    differ = (1 - similarity) / 2
    most = int(SKETCH_BITS * differ + 5.5 * (SKETCH_BITS * differ * (1 - differ)) ** 0.5)
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = _apart(*(F.col(f"{v}.{k}") for v in (x, y) for k in ("k1", "k2")))
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (apart <= most)


def _children(node: F.Column, branches: int) -> F.Column:
    """The child keys: the member's minimum under the first coordinates of the node's own sequence at which it differs from
    the pivot's (what most members share, such as a common passage, would not divide them)."""
    stride = F.element_at(F.array(*[F.lit(x) for x in STRIDES]), F.pmod(F.xxhash64(node), F.lit(len(STRIDES))).cast("int") + 1)
    sequence = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda j: F.pmod(F.xxhash64(node, F.lit(1)) % COORDINATES + j * stride, F.lit(COORDINATES)).cast("int"))
    drawn = F.slice(F.filter(sequence, lambda i: F.element_at("mh", i + 1) != F.element_at("pivot_mh", i + 1)), 1, branches)
    return F.explode(F.transform(drawn, lambda i: F.xxhash64(node, i, F.element_at("mh", i + 1))))


def _confirm(width: int, percent: int):
    def confirm(batches):
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            sides = [(batch.column(i).to_pylist(), *tx.text_buffers(batch.column(i + 2))) for i in (0, 1)]
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                pair = []
                for ids, offs, data in sides:
                    own = known.get(ids[i])
                    if own is None:
                        if len(known) > 200:
                            known.clear()
                        own = known[ids[i]] = next(shingle_sets(offs[i : i + 2] - offs[i], data[offs[i] : offs[i + 1]], width))
                    pair.append(own)
                a, b = pair
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return confirm


def _distinct(texts: DataFrame) -> DataFrame:
    """(doc_id, text) without repeated rows, dealt by doc_id."""
    return texts.groupBy("doc_id").agg(F.collect_set("text").alias("own")).select("doc_id", F.explode("own").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. texts: (doc_id, text); repeated rows are read once."""
    pairs = written(pairs)
    n = pairs.count()
    if not n:
        return pairs
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    asked = _distinct(texts.join(small(ids if 2 * n <= BROADCAST_ROWS else ids.distinct(), 2 * n), "doc_id", "left_semi"))
    a, b = asked.toDF("a", "ta"), asked.toDF("b", "tb")
    return written(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(width, percent), "a bigint, b bigint"))


def links(reps: DataFrame, texts: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """Confirmed links (a, b), a <> b, that leave the same components as all links; groups of near copies are linked
    through pivots, so not every pair of such a group is a row."""
    member = ["doc_id", "n_shingles", "k1", "k2", "grp"]
    rows = reps.select(
        F.explode(F.array([F.xxhash64(F.lit(t), F.lit(j), F.element_at("mh", t * FIRST_BRANCHES + j + 1)) for t in range(TREES) for j in range(FIRST_BRANCHES)])).alias("node"), *member[:-1], F.col("doc_id").alias("grp")
    )
    candidates, found, dense, n_pivots = None, None, None, 0
    for depth in range(1, MAX_DEPTH):
        groups = rows.groupBy("node", "grp").agg(F.count("*").alias("c")) if depth > 1 else rows.select("node", "grp", F.lit(1).alias("c"))
        nodes = groups.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s2"), F.max(F.struct("c", "grp"))["grp"].alias("top")).where("n * n > s2")
        work = (F.col("n") * F.col("n") - F.col("s2")) / 2
        nodes = written(nodes.select("node", "top", (work <= F.col("n") * LEAF / 2).alias("leaf"), "n"))
        n_nodes, n_large = nodes.agg(F.count("*"), F.count_if(~F.col("leaf"))).first()
        inner = rows.join(small(nodes.where("leaf").select("node", "top"), 2 * n_nodes), "node")
        met = inner.where("grp <> top").alias("x").join(inner.alias("y"), (F.col("x.node") == F.col("y.node")) & _pair() & _near("x", "y", percent))
        met = met.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b"))
        # Each level's candidates are written by themselves: one plan for all levels would hold all their broadcasts at once.
        # Repeated ones go when all levels are put together.
        met = written(met)
        candidates = met if candidates is None else candidates.union(met)
        if not n_large:
            break
        # The pivot is the member nearest to a few random ones: in a family of copies, its origin. What has a row for each large
        # node is small as a rule; then the members of large nodes, of which most rows may be, aren't shuffled to meet it.
        outer = written(rows.join(small(nodes.where("not leaf").select("node", "top"), n_large), "node"))
        others = outer.where("grp <> top")
        drawn = [F.min(F.struct(F.xxhash64(F.lit(i), "doc_id").alias("h"), "k1", "k2")).alias(f"s{i}") for i in range(SAMPLES)]
        apart = sum((_apart(F.col("k1"), F.col("k2"), F.col(f"s{i}.k1"), F.col(f"s{i}.k2")) for i in range(1, SAMPLES)), _apart(F.col("k1"), F.col("k2"), F.col("s0.k1"), F.col("s0.k2")))
        nearest = others.join(small(others.groupBy("node").agg(*drawn), n_large), "node").select("node", F.struct(apart.alias("far"), "doc_id", "n_shingles", "k1", "k2", "grp").alias("x"))
        pivots = written(nearest.groupBy("node").agg(F.min("x").alias("x"), (F.avg("x.far") <= DENSE * SAMPLES).alias("dense")))
        star = outer.select("node", F.struct("doc_id", "n_shingles", "k1", "k2").alias("y")).join(small(pivots, n_large), "node").where((F.col("x.doc_id") != F.col("y.doc_id")) & _near("x", "y", percent))
        star = confirmed(star.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), texts, width, percent)
        found = star if found is None else found.union(star)
        linked = star.union(star.select("b", "a")).toDF("pivot", "doc_id").withColumn("linked", F.lit(True))
        of_node = pivots.select("node", F.col("x.doc_id").alias("pivot"), F.col("x.grp").alias("pgrp"), (F.col("dense") | F.lit(depth == MAX_DEPTH - 1)).alias("dense"))
        met = outer.join(small(of_node, n_large), "node").join(small(linked, 2 * star.count()), ["pivot", "doc_id"], "left")
        met = met.withColumn("linked", F.coalesce("linked", F.lit(False)) | (F.col("pivot") == F.col("doc_id")))
        # Where the pivot is linked into the node's main group, its family joins that group.
        joins = met.groupBy("node").agg(F.max(F.col("linked") & (F.col("grp") == F.col("top"))).alias("joins"))
        family = F.when(F.col("joins"), F.col("top")).otherwise(F.col("pgrp"))
        grouped = met.join(small(joins, n_large), "node").withColumn("grp", F.when((F.col("linked") & (F.col("grp") == F.col("doc_id"))) | (F.col("grp") == F.col("pgrp")), family).otherwise(F.col("grp")))
        grouped = written(grouped.select("node", "dense", "pivot", *member))
        of_pivot = reps.join(small(pivots.select(F.col("x.doc_id").alias("doc_id")).distinct(), n_large), "doc_id", "left_semi").select(F.col("doc_id").alias("pivot"), F.col("mh").alias("pivot_mh"))
        spread = grouped.where("not dense").join(reps.select("doc_id", "mh"), "doc_id").join(small(of_pivot, 10 * n_large), "pivot").select(_children(F.col("node"), BRANCHES).alias("node"), *member)
        ended = grouped.where("dense").drop("node", "dense")
        dense, n_pivots = ended if dense is None else dense.union(ended), n_pivots + n_large
        if depth < MAX_DEPTH - 1:
            rows = written(spread)
    # Dense nodes of all levels are taken together: many have the same pivot, or linked ones, and much the same members.
    if dense is not None and not dense.isEmpty():
        met, of_pivots = _by_differences(dense, n_pivots, found, texts, width, percent)
        candidates, found = candidates.union(met), found.union(of_pivots)
    direct = confirmed(candidates.distinct(), texts, width, percent)
    return direct if found is None else direct.union(found)


def _by_differences(rows: DataFrame, n_pivots: int, found: DataFrame, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (pivot, doc_id, n_shingles, k1, k2, grp) of at most n_pivots pivots, and links (a, b) found, to candidates (a, b), which
    hold all links of members of one pivot but those of its family, and the links (a, b) of pivots. Nodes whose pivots are linked are
    taken together, so that a family is dealt once."""
    pivots = written(rows.select("pivot").distinct())
    linked = found.union(found.select("b", "a")).toDF("pivot", "other")
    for side in ("pivot", "other"):
        linked = linked.join(small(pivots.toDF(side), n_pivots), side, "left_semi")
    same = linked.groupBy("pivot").agg(F.min("other").alias("other"))
    named = rows.join(small(same, n_pivots), "pivot", "left").withColumn("pivot", F.least("pivot", "other"))
    named = written(named.groupBy("pivot", "doc_id", "n_shingles", "k1", "k2").agg(F.min("grp").alias("grp")))
    ids = written(named.select("doc_id").union(named.select("pivot")).distinct())
    asked = _distinct(texts.join(small(ids, ids.count()), "doc_id", "left_semi"))
    # Most members may have one pivot, so its text (one of them, if several have its doc_id) is dealt to several tasks.
    own = asked.toDF("pivot", "own").join(small(named.select("pivot").distinct(), n_pivots), "pivot", "left_semi").groupBy("pivot").agg(F.min("own").alias("own")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = named.join(asked, "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(own, ["pivot", "salt"]).select("pivot", "doc_id", "n_shingles", "k1", "k2", "grp", "own", "text")
    kind = "pivot bigint, doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, grp bigint, linked boolean, n bigint, first bigint, differ array<bigint>"
    told = written(pairs.mapInArrow(_differences(width, percent), kind))
    # A difference that no other member has only moves the others back.
    member = ["pivot", "doc_id", "linked", "n", "n_shingles"]
    each = told.select(*member, "first", "k1", "k2", "grp", F.explode("differ").alias("e"))
    often = each.groupBy("pivot", "e").agg(F.count("*").alias("c")).where("c > 1")
    own_rows = Window.partitionBy(*member, "k1", "k2")
    meeting = each.join(often, ["pivot", "e"]).withColumn("i", F.col("n") - F.count("*").over(own_rows) + F.row_number().over(own_rows.orderBy("c", "e")) - 1)
    placed = written(meeting.where("i < first").select(*member, "k1", "k2", "grp", "e", "i"))
    x, y = placed.alias("x"), placed.alias("y")
    share = F.col("x.n") + F.col("y.n") - (F.col("x.n_shingles") + F.col("y.n_shingles")) * (100 - percent) / (100 + percent)
    left = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    apart = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.grp") != F.col("y.grp")) & ~(F.col("x.linked") & F.col("y.linked"))
    met = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & (F.col("x.e") == F.col("y.e")) & apart & (2 * left >= share - 1e-6) & _near("x", "y", percent))
    met = written(met.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct())
    return met, told.where("linked and pivot <> doc_id").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b"))


def _differences(width: int, percent: int):
    """(pivot, doc_id, n_shingles, k1, k2, grp, own text of the pivot, text) to whether the two are linked, how many differences
    there are, how many of the first of them (in any order) hold one that a linked member shares, and the differences."""

    def differ(batches):
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            pivots, sides = batch.column(0).to_pylist(), [tx.text_buffers(batch.column(i)) for i in (6, 7)]
            sizes = batch.column(2).to_pylist()
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for i, pivot in enumerate(pivots):
                p, x = (_set_at(i, *side, width) if k or pivot not in known else known[pivot] for k, side in enumerate(sides))
                if len(known) > 200:
                    known.clear()
                known[pivot] = p
                if len(x) == sizes[i]:  # else it is another text of the same doc_id, which has a row of its own
                    both = np.setxor1d(x, p, assume_unique=True).view(np.int64)
                    n = len(both)
                    of_pivot = n * (100 + percent) <= (len(x) + len(p)) * (100 - percent)
                    first = min(n, len(x) * (100 - percent) // percent + 1)
                    if of_pivot:  # meets only members that aren't linked with the pivot, so shares more of its own differences
                        first = min(first, n - max(0, (n * (100 + percent) - (len(x) - len(p)) * (100 - percent)) // (2 * (100 + percent))))
                    for values, value in zip(out, (i, of_pivot, first, both), strict=True):
                        values.append(value)
                    held += n
                if out[0] and (held >= HANDED or i + 1 == len(pivots)):
                    columns = [pa.array(out[1], pa.bool_()), pa.array([len(v) for v in out[3]], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(out[0])) for k in range(6)), *columns], names=[*batch.schema.names[:6], "linked", "n", "first", "differ"])
                    out, held = ([], [], [], []), 0

    return differ


def _set_at(i: int, offs: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    return next(shingle_sets(offs[i : i + 2] - offs[i], data[offs[i] : offs[i + 1]], width))


def _pair() -> F.Column:
    """Members of different groups, one of them outside the node's main group; two outside it meet once."""
    return (F.col("x.grp") != F.col("y.grp")) & ((F.col("y.grp") == F.col("x.top")) | (F.col("x.doc_id") < F.col("y.doc_id")))


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """docs (doc_id, text): one row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable
    through links of similarity percent / 100 or more, itself included), kept (doc_id is its component's smallest)."""
    signed = written(signatures(docs, width))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "k1", "k2", "mh")).alias("r"))
    reps = written(classes.select("r.doc_id", "n_shingles", "d1", "d2", "r.k1", "r.k2", "r.mh"))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("doc_id is not null and text is not null")
    edges = links(reps, texts, width, percent)
    components = connected_components(edges)
    of_class = reps.select("n_shingles", "d1", "d2", "doc_id").join(components.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("n_shingles", "d1", "d2", F.coalesce("component", "doc_id").alias("component"))
    joined = signed.select("doc_id", "n_shingles", "d1", "d2").where("n_shingles > 0 and doc_id is not null").join(of_class, ["n_shingles", "d1", "d2"], "left")
    empty = signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    return (
        joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component")).union(empty)
        .select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
    )
