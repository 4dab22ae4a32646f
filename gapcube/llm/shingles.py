"""Near copies: SimHash fingerprints find most pairs, shingles those that fingerprints miss; all pairs of at least 0.8.

Fingerprints of all texts are linked at three bits or fewer, as in simhash.py, and each link is checked on the sets of
five-word shingles. What that connects starts out as one group, so the search for the rest, by prefix filtering, compares
texts of different groups only.

The shingles of a text are sorted, rare ones first. If two sets have a Jaccard similarity of at least 4/5, the first
n - ceil(4n / 5) + 1 of each have a shingle in common, so no pair is missed, whatever the order. Texts with equal sets
are one node. At every prefix shingle one text after the other is compared with all that are not connected to it yet: a
linear number of pairs each time, which joins a group of copies in a few turns. What is still apart then is paired: one
pair of every text is compared at a time, a few times over, which joins groups of copies, and all that are left at the end.

A set also has a sketch, the parity of its shingles at each of a number of bits in proportion to its size. Sketches differ in
at most as many bits as the sets differ in shingles, so pairs whose sketches differ too much are left out before texts are
fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcube.llm.common import batches, flat, text_or_empty
from gapcube.llm.components import connected
from gapcube.llm.simhash import SEED, fingerprints, links_of, shingle_hashes, smallest, verdict
from gapcube.session import discard, settled, written

WORDS = 5
#: Least similarity: 4 / 5.
OVER, UNDER = 4, 5
#: Texts of a shingle that are compared with all others before the rest is paired (results don't depend on it).
TURNS = 3
#: Times that one pair of every text is compared before all pairs are (results don't depend on it).
STEPS = 2
#: Most words of 64 bits of a sketch; a power of two.
SKETCH = 256
#: Stands for a null id in joins.
NO_ID = -(1 << 63)
#: Texts and shingles that tell common shingles from rare ones (bounds; results don't depend on the draw).
SAMPLE, COMMON = 4096, 1 << 16


def sets_of(data: np.ndarray, at: np.ndarray, words: int, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, rare ones first, and the n + 1 offsets. `common` is ascending, `rank` its order."""
    h, base = shingle_hashes(data, at, words, SEED)
    row = np.repeat(np.arange(len(at) - 1), base[1:] - base[:-1])
    place = np.zeros(len(h), np.int64)
    if len(common) and len(h):
        i = np.minimum(np.searchsorted(common, h), len(common) - 1)
        place = np.where(common[i] == h, rank[i], 0)
    order = np.lexsort((h, place, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(at) - 1))]).astype(np.int64)


def sketches(h: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the sketch of each row's set, and the n + 1 offsets: two to four bits a shingle, a power of two."""
    n = base[1:] - base[:-1]
    size = np.minimum(1 << np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64), SKETCH)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    place = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
    odd = np.bincount(64 * np.repeat(at[:-1], n) + (place & (64 * np.repeat(size, n) - 1)), minlength=64 * at[-1]) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8"), at


def nodes_of(words: int, common: np.ndarray, rank: np.ndarray):
    """(id, check, fp, node, n, prefix, sketch) of each text: its fingerprint; the node is a digest of the set."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 1 << 18):
            h, base = sets_of(*flat(b.column(1)), words, common, rank)
            n = base[1:] - base[:-1]
            node = np.zeros(len(n), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                node[some] = np.add.reduceat(h, base[some])
            length = np.where(n > 0, n - -(-OVER * n // UNDER) + 1, 0)
            kept = np.arange(len(h)) - np.repeat(base[:-1], n) < np.repeat(length, n)
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(h[kept].view(np.int64)))
            fp = pa.array(fingerprints(*flat(b.column(1))).view(np.int64))
            bits, at = sketches(h, base)
            sketch = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bits))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fp, pa.array(node.view(np.int64)), pa.array(n, pa.int64()), prefix, sketch], names=["id", "check", "fp", "node", "n", "prefix", "sketch"])
    return run


def shingles_of(words: int):
    """(node, shingles) of rows (node, text)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in batches(it, 1 << 18):
            h, base = sets_of(*flat(b.column(1)), words, none.view(np.uint64), none)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(base, pa.int32()), pa.array(h.view(np.int64)))], names=["node", "shingles"])
    return run


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one sampled text in ascending order, and their rank: the most common one is last."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    drawn = rows.filter(F.pmod(F.xxhash64("id", "check", F.lit("common")), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
    sets = drawn.select(F.col("check").alias("node"), "text").mapInArrow(shingles_of(words), "node long, shingles array<long>")
    top = sets.select(F.explode("shingles").alias("h")).groupBy("h").count().filter("count > 1").orderBy(F.desc("count"), "h").limit(COMMON).collect()
    h = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def alike(n: Column, m: Column, shared: Column) -> Column:
    """Sets of n and m shingles with `shared` in common have the least similarity."""
    return shared * (OVER + UNDER) >= (n + m) * OVER


def differing(x: str, y: str) -> Column:
    """Bits in which two sketches differ, the longer one folded; sets that can be alike have one at most twice as long."""
    def folded(c: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(c) > half, F.zip_with(F.slice(c, F.lit(1), half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(c))
    bits = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(bits, F.lit(0), lambda total, k: total + k)


class Verifier:
    """Exact comparison of pairs (a, b) of nodes. Only the sketches and texts of nodes in question are fetched."""

    def __init__(self, rows: DataFrame, made: DataFrame, distinct: DataFrame, words: int):
        self.rows, self.made, self.distinct, self.words = rows, made, distinct, words

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose sets are alike."""
        return settled(lambda: self.exact(self.likely(pairs, name), name), name)

    def likely(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that may be alike by their sketches: sets that differ in d shingles share (n + m - d) / 2."""
        pairs = written(pairs, name + "-pairs")
        chosen = self.made.join(nodes_in(pairs, name), "node", "left_semi").select("node", "n", "sketch").dropDuplicates(["node"])
        chosen = written(chosen, name + "-sketches")
        x, y = (chosen.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("sketch").alias(f"sketch_{e}")) for e in "ab")
        near = alike(F.col("n_a"), F.col("n_b"), F.least("n_a", "n_b")) & (differing("sketch_a", "sketch_b") * (OVER + UNDER) <= (F.col("n_a") + F.col("n_b")) * (UNDER - OVER))
        return written(pairs.join(x, "a").join(y, "b").filter(near).select("a", "b"), name + "-likely")

    def exact(self, some: DataFrame, name: str) -> DataFrame:
        """Stored pairs whose sets are alike, by all shingles."""
        chosen = self.distinct.join(nodes_in(some, name), "node", "left_semi").select("node", F.coalesce("first.id", F.lit(NO_ID)).alias("_id"), F.col("first.check").alias("check"))
        texts = self.rows.select(F.coalesce("id", F.lit(NO_ID)).alias("_id"), "check", "text").join(written(chosen, name + "-chosen"), ["_id", "check"]).select("node", "text")
        sets = written(texts.dropDuplicates(["node"]).mapInArrow(shingles_of(self.words), "node long, shingles array<long>"), name + "-sets")
        x, y = (sets.select(F.col("node").alias(e), F.col("shingles").alias(f"set_{e}")) for e in "ab")
        close = alike(F.size("set_a"), F.size("set_b"), F.size(F.array_intersect("set_a", "set_b")))
        return some.join(x, "a").join(y, "b").filter(close).select("a", "b")

    def joined(self, pairs: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Links that connect what all alike pairs and the links so far connect. A pair of every text is compared first and
        again after pairs of connected texts have been left out; then all that are left."""
        pairs = settled(lambda: self.likely(pairs, name), name + "-left")
        for step in range(STEPS):
            if pairs.isEmpty():
                return links
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            nearest = both.groupBy("a").agg(F.min("b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            tried = written(nearest, name + "-tried")
            links = links.unionByName(settled(lambda: self.exact(tried, name), f"{name}-{step}"))
            labels = settled(lambda: connected(links), name + "-labels")
            x, y = (labels.select(F.col("node").alias(e), F.col("component").alias(f"of_{e}")) for e in "ab")
            apart = pairs.join(tried, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left").filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            before, pairs = pairs, written(apart.select("a", "b"), name + "-left")
            discard(before, tried, labels)
        return links.unionByName(settled(lambda: self.exact(pairs, name), name))


def nodes_in(pairs: DataFrame, name: str) -> DataFrame:
    """The nodes of stored pairs, stored, so that their size is known to the joins that follow."""
    return written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name + "-nodes")


def bounded(x: str, y: str) -> Column:
    """At the first common shingle of alike sets, what is left of both bounds what they share. A place holds the size of
    the set and the position in its prefix."""
    n, m = (F.shiftright(F.col(f"{c}.place"), 32) for c in (x, y))
    left = [size - F.col(f"{c}.place").bitwiseAND((1 << 32) - 1) for c, size in ((x, n), (y, m))]
    return alike(n, m, F.least(*left))


def fingerprint_pairs(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect what links of fingerprints connect: a node with the smallest of its fingerprint, and of
    each fingerprint that node with its smallest neighbour and the smallest of its component. A number of pairs that is
    linear in the nodes, however many links a cluster has."""
    distinct = distinct.select("fp", "node")
    heads = written(distinct.groupBy("fp").agg(F.min("node").alias("node")), "heads")
    links = written(links_of(heads), "fingerprint-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    roots = connected(links).select(F.col("node").alias("a"), F.col("component").alias("b"))
    same = distinct.join(heads.withColumnRenamed("node", "a"), "fp").select("a", F.col("node").alias("b"))
    found = same.unionByName(nearest).unionByName(roots).filter("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per input row: id, node, component_id, text_check, first.

    Texts are linked if the Jaccard similarity of their sets of shingles is at least 4/5; a component is what links
    connect. Words are those of SimHash; a text of fewer words is one shingle; texts without words are alike. `first`
    marks the rows with the component's smallest (id, text_check). Repeated rows give repeated rows. Null ids belong to
    a component and name it only if all its ids are null. An empty table gives no rows; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("check"))
    made = written(rows.mapInArrow(nodes_of(words, *common_shingles(rows, words)), "id long, check long, fp long, node long, n long, prefix array<long>, sketch array<long>"), "nodes")
    distinct = written(made.groupBy("node").agg(*smallest(), F.min("fp").alias("fp")), "distinct")
    verifier = Verifier(rows, made, distinct, words)
    links = verifier.links(fingerprint_pairs(distinct), "simhash")
    labels = written(relabelled(links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0), links), "labels")
    place = F.shiftleft("n", 32) + F.col("pos")
    keys = made.select("node", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "node", place.alias("place")).repartition("key")
    # `place` is read here too, so that both sides are the same exchange, which is made once
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.max("place").alias("any")).filter("low < high AND any IS NOT NULL").select("key")
    hits = keys.join(shared, "key", "left_semi").dropDuplicates(["key", "node"])
    hits = written(hits.join(labels, "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label"), "hits")
    stored, hubs = hits, hits.select("key", F.col("node").alias("hub")).limit(0)
    for turn in range(TURNS + 1):
        # keys whose nodes are not all known to be connected; all pairs with the hubs so far are compared
        mixed = written(hits.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key"), "mixed")
        if mixed.isEmpty():
            break
        hits = written(hits.join(mixed, "key", "left_semi").join(hubs, "key", "left").filter("hub IS NULL OR node > hub").drop("hub"), "open")
        discard(stored, mixed, hubs)
        stored = hits
        x = hits.alias("x")
        if turn < TURNS:
            # one node of a key against all others, the next one in every turn: a linear number of pairs
            hubs = written(hits.groupBy("key").agg(F.min("node").alias("hub")), "hubs")
            y = hits.join(hubs.withColumnRenamed("hub", "node"), ["key", "node"]).alias("y")
        else:
            y = x.select("key", "node", "place", "component").alias("y")
        both = x.join(y, F.col("x.key") == F.col("y.key")).filter((F.col("x.node") > F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & bounded("x", "y"))
        pairs = both.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
        if turn == TURNS:
            links = verifier.joined(pairs, links, f"turn{turn}")
        else:
            found = verifier.links(pairs, f"turn{turn}")
            links = links.unionByName(found)
            labels = written(relabelled(labels, found), "labels")
            hits = hits.join(labels, "node", "left").withColumn("component", F.coalesce("label", "component")).drop("label")
    return verdict(made.select("id", "check", "node"), distinct, connected(links), "node")


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after one step over new links: the smallest label beside a node. Equal labels mean connected, though
    connected nodes may differ, which is enough to leave pairs out."""
    def end(e: str) -> DataFrame:
        return labels.select(F.col("node").alias(e), F.col("label").alias(f"of_{e}"))
    known = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("x"), F.coalesce("of_b", "b").alias("y"))
    least = F.least("x", "y")
    steps = known.select(F.explode(F.array(F.struct(F.col("a").alias("node"), least.alias("label")), F.struct(F.col("b").alias("node"), least.alias("label")))).alias("s")).select("s.*")
    return steps.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
