"""Near duplicates by a chosen-path set similarity join.

A document is the set of its distinct word shingles, with a signature of ``POSITIONS``
minwise tokens.  Equal sets are one vertex.  Each of several independent trees branches
recursively: a node picks ``BRANCHES`` signature positions by a hash of its path, and a
vertex goes to the child named by its token there.  After ``DEPTH`` levels dissimilar
vertices have parted, and two at the threshold still share a node of a tree with
probability ``survival``; the number of trees follows from the threshold and the target
recall.  The threshold is a fraction of integers, 85/100 for the query and ``STAGE`` for the
stage of the pipeline.

A node is settled when its members are known to be linked, directly or over others.  All
nodes first compare their members with one pivot (linear in the members).  What is then not
settled is compared exhaustively for links between different classes: small nodes pair by
pair, and large nodes in pairs of blocks, each once for a cluster of overlapping nodes.  A
group whose copies are linked over its pivot costs its size, not its square; no link
between different classes is lost, and no pairs but links leave a task.  Every link is
confirmed on full sets of shingles of the whole texts.

Rows that meet: members of a node meet only as minima and counts (partial aggregates) and
as joins with one row for each node; comparisons are dealt by pivot and by blocks of at
most ``BLOCK`` partners, or ``BLOCK_ROWS`` rows and ``BLOCK_SHINGLES`` shingles.

Depth is fixed: texts of which a large common part is boilerplate, without being similar, share
large nodes that no further level parts, and their comparison in blocks grows with its square.

Cases: texts that are null, empty or without words have no shingles, link with nothing and
are their own component; texts of fewer words than a shingle are one shingle; rows that
repeat an id are one document, whose texts are linked; rows with a null id have a null
component and are kept; extra columns pass through the stage untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import components
from .shared import discard, load, partitions, stored
from .textbuf import SPACE, Hasher, buffer, mix, slices, word_hashes

SHINGLE, NUM, DEN = 5, 85, 100
STAGE = (80, 100)
POSITIONS, DEPTH, BRANCHES, RECALL = 64, 3, 2, 0.9999
SMALL, BLOCK, BLOCK_ROWS, BLOCK_SHINGLES = 12, 256, 1500, 600_000
MULTIPLIERS = np.random.default_rng(7).integers(1, 2**62, POSITIONS * 2, dtype=np.uint64).reshape(2, -1) * np.uint64(2) + np.uint64(1)


def survival(similarity, depth=DEPTH, branches=BRANCHES):
    """Probability that two sets share a node at this depth of one tree."""
    lost = 0.0
    for _ in range(depth):
        lost = (1 - similarity + similarity * lost) ** branches
    return 1 - lost


def trees_for(recall=RECALL, similarity=NUM / DEN):
    """Independent trees for the recall; the signature's sampling error is allowed for."""
    p = survival(similarity - 2 * math.sqrt(similarity * (1 - similarity) / POSITIONS))
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingle_sets(column, hasher, size=SHINGLE):
    """(distinct shingle hashes of each text in order, offsets of each text in them)."""
    data, offsets = buffer(column)
    words, _, _, first = word_hashes(data, offsets, hasher, SPACE)
    steps = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.diff(first)
    full = np.zeros(len(words), np.uint64)
    if len(words) >= size:
        m = len(words) - size + 1
        for j in range(size):
            full[:m] += words[j : j + m] * steps[j]
    sets = []
    full = mix(full)
    for d in range(len(n)):
        a, b = first[d], first[d + 1]
        if b - a >= size:
            h = np.sort(full[a : b - size + 1])
            sets.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:
            short = words[a:b] * steps[: b - a]
            sets.append(mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            sets.append(words[:0])
    return sets


def signatures(column, hasher):
    """(sizes, 16-byte set ids, signatures of POSITIONS uint32 as bytes) of the texts."""
    sets = shingle_sets(column, hasher)
    sizes = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(sizes)
    keys, sig = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), POSITIONS), np.uint32)
    if len(some):
        flat = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[some]
        keys[some, 0] = np.add.reduceat(mix(flat), at)
        keys[some, 1] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
        for k in range(POSITIONS):
            least = np.minimum.reduceat((flat ^ MULTIPLIERS[0, k]) * MULTIPLIERS[1, k], at)
            sig[some, k] = mix(least) >> np.uint64(32)
    return sizes, keys, sig


def branch(nodes, sig, branches=BRANCHES):
    """Children of each row's node: a rows x branches array of node hashes."""
    out = np.empty((len(nodes), branches), np.uint64)
    rows = np.arange(len(nodes))
    p = mix(nodes) % np.uint64(POSITIONS)
    for j in range(branches):
        out[:, j] = mix(nodes * np.uint64(0x2545F4914F6CDD1D) + mix(sig[rows, p].astype(np.uint64) + (p << np.uint64(32))))
        p = (p + np.uint64(1) + mix(nodes ^ np.uint64(j + 1)) % np.uint64(POSITIONS - 1)) % np.uint64(POSITIONS)
    return out


def leaves(sig, trees, depth=DEPTH):
    """Node hashes of every row at the given depth of all trees (rows x nodes)."""
    nodes = np.repeat(mix(np.arange(1, trees + 1, dtype=np.uint64))[None, :], len(sig), 0)
    for _ in range(depth):
        wide = np.repeat(sig, nodes.shape[1], 0)
        nodes = branch(nodes.reshape(-1), wide).reshape(len(sig), -1)
    return nodes


def table_of(docs: DataFrame) -> DataFrame:
    """(id, n, k1, k2, sig) of every row."""

    def run(batches):
        hasher = Hasher()
        for b in slices(batches, "text"):
            n, keys, sig = signatures(b.column(1), hasher)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["id", "n", "k1", "k2", "sig"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long, sig binary")


def _sig(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), POSITIONS)


def memberships(vertices: DataFrame, trees: int, depth=DEPTH) -> DataFrame:
    """(node, v, n): each vertex in its distinct nodes of all trees."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                nodes = np.sort(leaves(_sig(part.column(2)), trees, depth), 1)
                fresh = np.c_[np.ones(len(nodes), bool), nodes[:, 1:] != nodes[:, :-1]]
                times = fresh.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[fresh].view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), times)), pa.array(np.repeat(part.column(1).to_numpy(), times))], ["node", "v", "n"])

    return vertices.select("v", "n", "sig").mapInArrow(run, "node long, v long, n long")


def fitting(similarity=(NUM, DEN)):
    """Sizes that allow the similarity."""
    num, den = similarity
    return F.least("an", "bn") * den >= F.greatest("an", "bn") * num


def star_pairs(members: DataFrame, similarity=(NUM, DEN)) -> DataFrame:
    """(a, b, an, bn): each member with its node's pivot.

    The pivot is the member whose nodes hold the most members altogether: of a group of
    edited copies that is a copy near the original, to which the others are likely linked.
    """
    sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    central = members.join(sizes, "node").groupBy("v").agg(F.sum("k").alias("score"))
    pivots = members.join(central, "v").groupBy("node").agg(F.max(F.struct("score", (-F.col("v")).alias("w"), "n")).alias("p"))
    pivots = pivots.select("node", (-F.col("p.w")).alias("a"), F.col("p.n").alias("an"))
    pairs = members.join(pivots, "node").where("v <> a")
    return pairs.select("a", F.col("v").alias("b"), "an", F.col("n").alias("bn")).where(fitting(similarity)).distinct().select("a", "b")


def small_pairs(members: DataFrame, similarity=(NUM, DEN)) -> DataFrame:
    """(a, b): all pairs of different classes in nodes of at most SMALL members."""
    groups = members.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("v", "n", "c"))).alias("all"))
    one = groups.select("all", F.explode("all").alias("l")).select("l", F.explode("all").alias("r"))
    pairs = one.where("l.v < r.v and l.c <> r.c").select(F.col("l.v").alias("a"), F.col("r.v").alias("b"), F.col("l.n").alias("an"), F.col("r.n").alias("bn"))
    return pairs.where(fitting(similarity)).select("a", "b").distinct()


def block_links(docs: DataFrame, members: DataFrame, block=BLOCK_ROWS, similarity=(NUM, DEN)) -> DataFrame:
    """(a, b): links between different classes within large nodes, compared in full.

    Nodes of one group of texts overlap, so the vertices of overlapping nodes form one
    cluster and every pair in it is compared once.  A cluster is cut into blocks and each
    pair of blocks is a task of bounded size; only links leave it, never pairs.
    """
    spark = docs.sparkSession
    low = members.groupBy("node").agg(F.min("v").alias("a"))
    cluster = components(members.join(low, "node").select("a", F.col("v").alias("b")))
    held = members.select("v", "n", "c").distinct().join(cluster.select(F.col("u").alias("v"), F.col("v").alias("g")), "v", "left").select("v", "n", "c", F.coalesce("g", "v").alias("g"))
    sizes = held.groupBy("g").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    dealt = held.join(sizes, "g").select("g", "v", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "v", "c")
    texts = dealt.join(docs.select(F.col("id").alias("v"), "text"), "v").select("g", "i", "j", "side", "v", "c", "text")
    texts = texts.repartition(partitions(spark), "g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "v")

    def run(batches):
        hasher, key, rows = Hasher(), None, []
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column(6), hasher)
            got = []
            for g, i, j, side, v, c, s in zip(*[b.column(k).to_pylist() for k in range(6)], sets):
                if (g, i, j) != key:
                    got += compare(rows, key, similarity)
                    key, rows = (g, i, j), []
                rows.append((side, v, c, s))
            yield pairs_batch(got)
        yield pairs_batch(compare(rows, key, similarity))

    return texts.mapInArrow(run, "a long, b long").distinct()


def pairs_batch(got):
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])


def compare(rows, key, similarity=(NUM, DEN)):
    """Links of different classes between the two sides of a pair of blocks (or within one block).

    Shingles that many rows share are bits, the rest are counted: common bits and the smaller
    rest bound the intersection from above, and only pairs that pass are intersected.
    """
    if not rows:
        return []
    num, den = similarity
    sets = [r[3] for r in rows]
    n = np.array([len(s) for s in sets], np.int64)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= max(2, len(rows) // 20)
    place = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(rows)), n)
    hit = shared[code]
    bits = np.zeros((len(rows), (int(shared.sum()) + 63) // 64 * 64), np.uint8)
    bits[owner[hit], place[code[hit]]] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    rest = n - np.bincount(owner[hit], minlength=len(rows))
    side, vs, cs = np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows], np.int64)
    within = key[1] == key[2]
    left = np.arange(len(rows)) if within else np.flatnonzero(side == 0)
    right = np.arange(len(rows)) if within else np.flatnonzero(side == 1)
    out = []
    for x in left.tolist():
        ys = right[right > x] if within else right
        most = np.bitwise_count(words[ys] & words[x]).sum(1, dtype=np.int64) + np.minimum(rest[ys], rest[x])
        ys = ys[(most * (den + num) >= num * (n[ys] + n[x])) & (cs[ys] != cs[x])]
        known = set()
        for y in ys.tolist():
            if int(cs[y]) not in known and similar(sets[x], sets[y], similarity):
                known.add(int(cs[y]))
                out.append((vs[x], vs[y]))
    return out


def similar(a, b, similarity=(NUM, DEN)) -> bool:
    """Whether two sorted sets have the similarity, in integers."""
    num, den = similarity
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return den * both >= num * (len(a) + len(b) - both)


def confirm(docs: DataFrame, pairs: DataFrame, block=BLOCK, similarity=(NUM, DEN)) -> DataFrame:
    """(a, b) of the pairs whose full sets are similar.  Partners of one a come in blocks."""
    spark = docs.sparkSession
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / block)).alias("part"))
    need = dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("v")).distinct().union(dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("v")))
    texts = need.join(docs.select(F.col("id").alias("v"), "text"), "v")
    texts = texts.select("a", "part", "role", "v", "text").repartition(partitions(spark), "a", "part").sortWithinPartitions("a", "part", "role", "v")

    def run(batches):
        hasher, key, own = Hasher(), None, []
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column(4), hasher)
            got = []
            for a, part, role, v, s in zip(*[b.column(i).to_pylist() for i in range(4)], sets):
                if (a, part) != key:
                    key, own = (a, part), []
                if role == 0:
                    own.append(s)
                    continue
                if any(similar(o, s, similarity) for o in own):
                    got.append((a, v))
            yield pairs_batch(got)

    return texts.mapInArrow(run, "a long, b long").distinct()


def classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (node, v, n) with the class c of each vertex, itself where it has no link."""
    return members.join(classes.select(F.col("u").alias("v"), F.col("v").alias("c")), "v", "left").select("node", "v", "n", F.coalesce("c", "v").alias("c"))


def unsettled(members: DataFrame) -> DataFrame:
    mixed = members.groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("node", "k")
    return members.join(mixed, "node")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", recall=RECALL, similarity=(NUM, DEN)) -> DataFrame:
    """(id, n_shingles, component_id) of every row; sets whose Jaccard similarity is the fraction at least are linked."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    table = stored(table_of(base), "minhash")
    known = table.where("n > 0 and id is not null")
    vertices = stored(known.groupBy("k1", "k2", "n").agg(F.min("id").alias("v"), F.min("sig").alias("sig")), "vertices")
    # Rows of one id are one document: its vertices are linked as they are.
    again = known.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id")
    same = known.join(again, "id").select("id", "k1", "k2", "n").join(vertices, ["k1", "k2", "n"]).select(F.col("id").alias("a"), F.col("v").alias("b"))
    members = memberships(vertices, trees_for(recall, similarity[0] / similarity[1]))
    shared = members.groupBy("node").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("node")
    members = stored(members.join(shared, "node").select("node", "v", "n"), "members")
    # The texts of vertices that share any node, once: later joins move only these.
    texts = stored(base.join(members.select(F.col("v").alias("id")).distinct(), "id"), "texts")
    stars = stored(star_pairs(members, similarity), "pairs")
    links = stored(confirm(texts, stars, similarity=similarity).union(same), "links")
    classes = components(links)
    open_ = stored(unsettled(classed(members, classes)), "open")
    pairs = small_pairs(open_.where(F.col("k") <= SMALL), similarity).join(stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")
    more = stored(confirm(texts, pairs, similarity=similarity).union(block_links(texts, open_.where(F.col("k") > SMALL), similarity=similarity)), "links")
    discard(members, texts, stars, open_)
    classes = components(links.union(more))
    named = vertices.select("k1", "k2", "n", "v").join(classes.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("k1", "k2", "n", F.coalesce("root", "v").alias("root"))
    named = known.select("id", "k1", "k2", "n").join(named, ["k1", "k2", "n"]).groupBy("id").agg(F.min("root").alias("root"))
    rows = table.select("id", "n")
    return rows.join(named, "id", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))


def op1_minhash_join(spark, sf_dir):
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def stage(spark, docs, sf_dir):
    """One document of each component stays, the one with the smallest id; all rows of that id and rows of null id stay."""
    gone = near_duplicates(docs, similarity=STAGE).where("id <> component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
