"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Texts of the same words are one class from the start. Each class has a
signature in every trie of the forest; two signatures that share a prefix in
some trie are candidates. The prefix is shortened from full depth until the
expected recall at the threshold reaches its target. Candidates are verified
on their whole sets of word n-grams.

A trie's node may hold any number of near copies: it is cut into blocks, and
each pair of blocks is a task of bounded size, which returns link counts and a
spanning forest, never the pairs. A pair that meets in several tries is
verified in the first alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfabric.llm.common import SPACE, as_long, cut, few_rows, give_back, hot_lookup, once, text_column, without
from voxfabric.llm.shingles import Words, mix

#: Classes in a block, and n-grams of all of them, on average; a task verifies the pairs of two blocks.
BLOCK = 512
BLOCK_GRAMS = 400_000


def prefix_depth(threshold: float, tries: int, depth: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some trie with probability recall, 1 at least."""
    while depth > 1 and 1 - (1 - threshold**depth) ** tries < recall:
        depth -= 1
    return depth


def _class(words: Words) -> str:
    """Names the texts of the same words in the same order, by 128 bits."""
    return hashlib.md5(b" ".join(words.words)).hexdigest()


def ngrams(words: Words, n: int) -> np.ndarray:
    """The distinct word n-grams' hashes, sorted; a text of fewer words has one n-gram, all of them, and an empty one none."""
    return np.unique(words.runs(n if words.n >= n else words.n))


class Forest:
    """Signatures of n-gram sets: for each trie a path of `depth` minima of random hashes."""

    def __init__(self, tries: int, depth: int, seed: int = 20):
        r = np.random.default_rng(seed)
        self.tries, self.depth = tries, depth
        self.xor = r.integers(0, 1 << 63, tries * depth).astype(np.uint64)[:, None]
        self.times = (r.integers(0, 1 << 62, tries * depth).astype(np.uint64) * np.uint64(2) + np.uint64(1))[:, None]

    def paths(self, grams: np.ndarray) -> np.ndarray:
        """tries * depth minima."""
        out = np.full(len(self.xor), ~np.uint64(0))
        for i in range(0, len(grams), 8192):
            out = np.minimum(out, ((grams[i : i + 8192] ^ self.xor) * self.times).min(1))
        return out.reshape(self.tries, self.depth)

    def keys(self, grams: np.ndarray, depth: int) -> np.ndarray:
        """One number per trie that stands for the path's prefix of the given depth."""
        paths = self.paths(grams)
        key = np.arange(self.tries, dtype=np.uint64)
        for d in range(depth):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + paths[:, d])
        return key


def _new_pairs(keys: np.ndarray, trie: int, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Which pairs of a node's rows (upper triangle) are to be verified here: those of blocks i and j that met in no earlier trie."""
    new = np.triu(np.ones((len(keys), len(keys)), bool), 1)
    if i != j:
        new &= block[:, None] != block[None, :]
    for t in range(trie):
        new &= keys[:, t, None] != keys[None, :, t]
    return new


def _similar(grams: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have at least this Jaccard similarity, in whole numbers."""
    n, size = len(grams), np.array([len(g) for g in grams])
    values, column, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times[column] > 1  # an n-gram of one set is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    common = np.zeros((n, n))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, (1 << 22) // max(n, 1))  # 16 MB at a time
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [a, a + width])
        has = np.zeros((n, min(width, int(column[-1]) + 1 - a)), np.float32)
        has[row[x:y], column[x:y] - a] = 1
        common += has @ has.T
    least = Fraction(str(threshold))  # common / (a + b - common) >= least
    common = common.astype(np.int64)
    return common * (least.denominator + least.numerator) >= least.numerator * (size[:, None] + size[None, :])


def _roots(n: int, pairs: np.ndarray) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, int]:
    own = np.array(rows["class"].to_pylist(), object)
    keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), "<u8").reshape(len(own), -1)
    return own, keys, rows["block"].to_numpy(), rows["trie"][0].as_py(), rows["i"][0].as_py(), rows["j"][0].as_py()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of each connected component of edges (a, b); nodes without an edge are not there.

    Each round every node takes the least label around it and then its
    label's label. Nodes of many edges are looked up by broadcast, fewer than
    a thousand at a time.
    """
    both = edges.where("a <> b").distinct()
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    count = both.count()
    labels = cut(both.groupBy("a").agg(F.count("*").alias("degree"), F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:  # labels only fall, and a path's length shrinks by a factor each round
        table = labels.select(F.col("node").cast("string").alias("name"), "degree", "label")
        near = hot_lookup(both.withColumn("name", F.col("b").cast("string")), table, "name", "degree", count, "b_", spread="a")
        least = near.groupBy("a").agg(F.min("b_label").alias("near"))
        moved = cut(labels.join(least, F.col("node") == F.col("a")).select("node", "degree", "label", F.least("label", "near").alias("new")))
        weights = moved.groupBy("new").agg(F.count("*").alias("n"))
        jumps = weights.join(moved.select(F.col("node").alias("to_node"), F.col("new").alias("to")), F.col("new") == F.col("to_node"))
        jumps = jumps.select(F.col("new").cast("string").alias("name"), "n", "to")
        after = hot_lookup(moved.withColumn("name", F.col("new").cast("string")), jumps, "name", "n", count, "j_", spread="node")
        after = cut(after.select("node", "degree", "label", F.least("new", F.coalesce("j_to", "new")).alias("new")))
        if after.where("new < label").isEmpty():
            return labels.select("node", "label")
        labels = after.select("node", "degree", F.col("new").alias("label"))


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, tries: int = 20, depth: int = 6, recall: float = 0.99999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, copies, n_links, words_md5, class_md5.

    Words are runs other than ASCII white space; similarity is the Jaccard
    similarity of the sets of n-grams of words, by 64-bit hashes. copy_id is
    the smallest id among rows of the same words in order (copies in number),
    n_links the number of such groups at least threshold similar to this one,
    its own apart. class_id is the smallest id that such links lead to, over
    any number of steps. A text of fewer than n words has one n-gram, all of
    it; null and empty texts are copies of each other and link to nothing.
    Rows that repeat an id are told apart by their words, whose md5 (joined by
    one space) is words_md5; class_md5 is that of the class's row of the
    smallest id, the first if several words have it. Ids are compared as
    longs; those that are none count as null. Rows with null ids join their
    copies' class; copies whose ids are all null link to nothing
    and have no class. A text of any length is one set of n-grams, held by one
    task. An empty table gives an empty result; further columns of docs are
    ignored, whatever their names.
    """
    at = prefix_depth(threshold, tries, depth, recall)
    forest = Forest(tries, depth)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [Words(t) for t in batch.column(1).to_pylist()]
            sets = [ngrams(w, n) for w in texts]
            keys = [forest.keys(g, at).tobytes() if len(g) else None for g in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class(w) for w in texts]), pa.array(keys, pa.binary()), pa.array([len(g) for g in sets], pa.int64())], names=["doc_id", "class", "keys", "n_grams"])

    rows = docs.select(as_long(docs, doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(sign, "doc_id long, class string, keys binary, n_grams long"))
    total = signed.count()
    classes = cut(signed.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"), F.any_value("n_grams").alias("n_grams")))

    # Nodes of two or more classes, and who is in them.
    known = classes.where("rep is not null and keys is not null")
    names = [F.concat_ws("-", F.lit(str(t)), F.hex(F.substring("keys", 8 * t + 1, 8))) for t in range(tries)]
    leaves = known.select("class", "n_grams", F.posexplode(F.array(*names)).alias("trie", "node"))
    nodes = leaves.groupBy("node").agg(F.count("*").alias("size"), F.sum("n_grams").alias("all_grams")).where("size > 1")
    nodes = cut(nodes.select("node", "size", F.least("size", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("all_grams") / BLOCK_GRAMS))).cast("int").alias("blocks")))
    members = hot_lookup(leaves.drop("n_grams"), nodes, "node", "size", total * tries, "n_", spread="class").where("n_size is not null")

    # Blocks of a node, and the pairs of blocks that each member belongs to.
    placed = members.withColumnRenamed("n_blocks", "blocks").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select("class", "node", "trie", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    paired = paired.join(known.select("class", "keys"), "class").select("class", "node", "trie", "block", "i", "j", "keys")

    def choose(group: tuple, table: pa.Table) -> pa.Table:
        """The rows that have a pair to verify here."""
        _, keys, block, trie, i, j = _group(table)
        new = _new_pairs(keys, trie, block, i, j)
        return table.filter(pa.array((new | new.T).any(1)))

    wanted = cut(paired.groupBy("node", "i", "j").applyInArrow(choose, "class string, node string, trie int, block int, i int, j int, keys binary"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            texts = [Words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_class(w) for w in texts]), pa.array([ngrams(w, n).tobytes() for w in texts], pa.binary())], names=["class", "grams"])

    asked = wanted.select("class").distinct().join(known.select("class", F.col("rep").alias("asked")), "class").select("asked")
    texts = rows.join(asked, F.col("doc_id") == F.col("asked"), "left_semi")
    grams = texts.select("text").mapInArrow(collect, "class string, grams binary").groupBy("class").agg(F.any_value("grams").alias("grams"))

    def verify(group: tuple, table: pa.Table) -> pa.Table:
        """Links of each row, and one edge to the least row of its component here."""
        own, keys, block, trie, i, j = _group(table)
        sets = [np.frombuffer(g, "<u8") for g in table["grams"].to_pylist()]
        linked = _new_pairs(keys, trie, block, i, j) & _similar(sets, threshold)
        links = linked.sum(0) + linked.sum(1)
        root = own[_roots(len(own), np.argwhere(linked))]
        keep = links > 0
        del sets, linked
        give_back()
        return pa.table([pa.array(own[keep], pa.string()), pa.array(root[keep], pa.string()), pa.array(links[keep], pa.int64())], names=["class", "root", "links"])

    found = cut(wanted.join(grams, "class").groupBy("node", "i", "j").applyInArrow(verify, "class string, root string, links long"))
    links = found.groupBy("class").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = classes.select("class", "rep", "copies").join(links, "class", "left").join(labels, F.col("class") == F.col("node"), "left")
    named = cut(named.select("class", "rep", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "class").alias("label")))
    first = named.groupBy("label").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "class"))).alias("least"), F.count("*").alias("size"))
    first = cut(first.select("label", "size", F.col("least.rep").alias("class_id"), F.col("least.class").alias("class_md5")))
    named = hot_lookup(named, first, "label", "size", total, "f_", spread="class")
    named = cut(named.select("class", "copies", F.col("f_class_id").alias("class_id"), F.col("f_class_md5").alias("class_md5"), F.col("rep").alias("copy_id"), "n_links"))
    out = hot_lookup(signed.select("doc_id", "class"), named, "class", "copies", total, "c_")
    return out.select("doc_id", F.col("c_class_id").alias("class_id"), F.col("c_copy_id").alias("copy_id"), F.col("c_copies").alias("copies"), F.col("c_n_links").alias("n_links"), F.col("class").alias("words_md5"), F.col("c_class_md5").alias("class_md5"))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each class, that of the smallest id; columns unchanged, whatever their names.

    Of several rows of that id the first by words stays, and of rows that
    repeat id and words the first by content. A row goes for its own words,
    not for those of another row of its id. Rows with null ids (or ids that
    are no longs) stay, and so do null and empty texts but copies of theirs
    with larger ids. Texts of any length are compared by all their n-grams. An
    empty table gives an empty result.
    """
    found = join(docs, doc_id=doc_id, text=text, **options).where("doc_id is not null")
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("words_md5").eqNullSafe(F.col("class_md5"))
    rows = cut(found.groupBy("doc_id", "words_md5").agg(F.any_value(stays).alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"))
    own = {"doc_id": as_long(docs, doc_id), "words_md5": F.md5(F.trim(F.regexp_replace(text_column(text), SPACE, " ")))}
    stay = without(docs, own, rows.where("not stays"))
    twins = rows.where("stays")
    return stay if twins.isEmpty() else once(stay, own, twins)
