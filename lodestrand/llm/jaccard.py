"""N-gram Jaccard join by a MinHash LSH forest and exact verification.

A text is its set of hashes of five words in a row (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased; a
shorter text is one shingle). Texts with equal sets are copies and one class; all that follows is
done with one row per class, and a class's links are counted once.

The forest has TREES trees. A class has in each a string of DEPTH MinHash values, and the strings of
a tree, sorted over all tasks, are its prefix trie: classes below one node are neighbours in the order, and
equal strings are told apart by the class, so no node has to fit into one task. Only classes that share
a prefix of the least length with a neighbour go on. Each class then looks for partners in all trees,
first below its whole strings; its prefixes are shortened, one level of one tree at a time, until
the chance to meet a partner at the threshold, 1 - (1 - t^d1)(1 - t^d2)..., reaches TARGET. The trees whose next
node is small come first, in a fixed order, then those with larger nodes: a class below a node of
many others stays deep there and goes further up elsewhere. How many others a small node has does
not count, as leaving out the trees in which a class has met none would leave out its partner. A node that any class
has chosen takes all classes below it, and of chosen nodes on one path the shortest prefix counts.

Below each node, classes are held together by sketches of one byte per hash, with a margin of over
five standard deviations, and by their numbers of shingles; that says which of them need their whole
sets. A pair that shares several nodes belongs to that of the first tree, so it is verified once. Nodes with many
classes or shingles are cut into blocks, of which each pair takes two, and different tasks take the
pairs of blocks: neither step emits pairs, and there is no cap on a node. Whole sets are read from the texts,
without shuffling the texts: a filter of fixed size over the wanted ids goes to the tasks that read them.

Defined results: texts without words are copies of those with the same bytes (null as empty) and
have no links; repeated rows are copies; an empty table gives an empty one; extra columns are not read. A null doc_id
is left out of the choice of class ids (null if a class has no other).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm import common
from lodestrand.llm.components import connected_components
from lodestrand.llm.decontaminate import words

NGRAM = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 6
TARGET = 0.9999
#: Standard deviations by which the share of equal sketch places may lie under the threshold.
MARGIN = 5.5
#: Classes below a node that do not count for the order of shortening.
SMALL_NODE = 64
#: Classes, and bytes of shingle hashes, that a block of a node takes from each of its two sides.
NODE_BLOCK = 1024
BLOCK_BYTES = 16 << 20
MEMO = 300_000

HASHES = TREES * DEPTH
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_PLACES = _rng.integers(0, 1 << 63, NGRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def recall(depths: list[int], similarity: float = THRESHOLD) -> float:
    """The chance that a pair of that similarity shares a prefix of the given length in some tree."""
    return 1 - math.prod(1 - similarity**d for d in depths)


def depth_range(similarity: float = THRESHOLD, target: float = TARGET) -> tuple[int, int]:
    """The least and the greatest prefix length: one less than what all trees alike would need, and DEPTH."""
    alike = DEPTH
    while alike > 1 and recall([alike] * TREES, similarity) < target:
        alike -= 1
    return max(1, alike - 1), DEPTH


def sketch_margin(threshold: float) -> float:
    """Pairs whose sketches agree in a smaller share of the places are not similar."""
    return threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / HASHES)


def shortened(sizes: dict[tuple[int, int], int], similarity: float = THRESHOLD, target: float = TARGET) -> list[int]:
    """The prefix length to search in each tree; sizes: of the nodes (tree, depth) that hold others too."""
    least, most = depth_range(similarity, target)
    gain = [math.log1p(-(similarity**d)) if similarity**d < 1 else -math.inf for d in range(most + 1)]
    depths, missed, goal = [most] * TREES, TREES * gain[most], math.log1p(-target)

    def cost(tree: int) -> tuple[int, int, int]:
        size = sizes.get((tree, depths[tree] - 1), 1)
        return (size // SMALL_NODE).bit_length(), -depths[tree], tree

    while missed > goal:
        tree = min((t for t in range(TREES) if depths[t] > least), key=cost, default=None)
        if tree is None:
            break
        missed += gain[depths[tree] - 1] - gain[depths[tree]]
        depths[tree] -= 1
    return depths


class WordHashes(dict):
    """64-bit hashes of words; a bounded number is remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMO:
            self[word] = value
        return value


_hashes = WordHashes()
common.remembers(__name__, _hashes.clear)


def shingles(raw: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's n-grams of words, in order."""
    parts = words(raw)
    if not parts:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    if len(own) < NGRAM:
        mixed = (own * _PLACES[: len(own)]).sum(keepdims=True) + np.uint64(len(own))
    else:
        mixed = own[: len(own) - NGRAM + 1] * _PLACES[0]
        for k in range(1, NGRAM):
            mixed += own[k : len(own) - NGRAM + 1 + k] * _PLACES[k]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    mixed = np.sort(mixed)
    return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES functions over the shingles."""
    low = hashes.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(out, (low[at : at + 2048, None] * _MULTIPLY + _ADD).min(0), out=out)
    return out


def sketch(values: np.ndarray) -> bytes:
    """A byte for each value of a signature."""
    return ((values >> np.uint32(24)) ^ values ^ (values >> np.uint32(12))).astype(np.uint8).tobytes()


def wordless(raw: bytes | None) -> bytes:
    """What stands for the set of a text without words: its bytes."""
    return xxhash.xxh3_128_digest(b"\0no words\0" + (raw or b""))


SIGNED = T.StructType(
    [T.StructField("set", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType())]
)


def _sign() -> Callable[[list], Iterator[tuple]]:
    def work(texts: list) -> Iterator[tuple]:
        for raw in texts:
            own = shingles(raw)
            if len(own):
                values = signature(own)
                yield xxhash.xxh3_128_digest(own.tobytes()), len(own), values.astype(">u4").tobytes(), sketch(values)
            else:
                yield wordless(raw), 0, None, None

    return work


MET = T.StructType(
    [T.StructField("set", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("tree", T.IntegerType()), T.StructField("depth", T.IntegerType()), T.StructField("node", T.LongType())]
)


def _met(least: int) -> Callable:
    """From the sorted strings (tree, prefix, set, size) of a task: the nodes, of each length from least, of
    all classes that share the least prefix with a neighbour, and of the first and the last string, whose
    neighbours another task has."""

    def nodes(rows: pa.Table, values: np.ndarray, trees: np.ndarray, chosen: np.ndarray) -> list[pa.RecordBatch]:
        held = np.flatnonzero(chosen)
        mixed, out = _mixed(trees[held].astype(np.uint64) + np.uint64(1)), []
        for depth in range(1, DEPTH + 1):
            mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + values[held, depth - 1] + np.uint64(1))
            if depth >= least:
                # Zero stands for no node.
                out.append(np.where(mixed == 0, np.uint64(1), mixed).view(np.int64))
        n = len(out)
        place = pa.array(np.tile(held, n))
        depths = np.repeat(np.arange(least, DEPTH + 1, dtype=np.int32), len(held))
        columns = [rows.column(2).take(place), rows.column(3).take(place), pa.array(np.tile(trees[held], n).astype(np.int32)), pa.array(depths), pa.array(np.concatenate(out))]
        return pa.Table.from_arrays(columns, names=MET.names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, shares = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            trees, values = rows.column(0).to_numpy(), np.frombuffer(b"".join(rows.column(1).to_pylist()), ">u4").reshape(-1, DEPTH).astype(np.uint64)
            same = (trees[1:] == trees[:-1]) & (values[1:, :least] == values[:-1, :least]).all(1)
            chosen = np.concatenate([[shares], same]) | np.concatenate([same, [False]])
            shares = bool(same[-1]) if len(same) else shares
            # The last string waits for its next neighbour.
            yield from nodes(rows, values, trees, np.concatenate([chosen[:-1], [False]]))
            rest = rows.slice(rows.num_rows - 1)
        if rest is not None:
            values = np.frombuffer(rest.column(1)[0].as_py(), ">u4").reshape(1, DEPTH).astype(np.uint64)
            yield from nodes(rest, values, rest.column(0).to_numpy(), np.array([True]))

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEARCHED = T.StructType(
    [
        T.StructField("set", T.BinaryType()),
        T.StructField("tree", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("shingles", T.LongType()),
        T.StructField("chosen", T.BooleanType()),
    ]
)


def _choose(threshold: float, target: float) -> Callable:
    """From (set, nodes) all nodes with others of a class, and whether the class has chosen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            rows = []
            for name, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                depths = shortened({(x["tree"], x["depth"]): x["n"] for x in found}, threshold, target)
                rows += [(name, x["tree"], x["depth"], x["node"], x["n"], x["shingles"], x["depth"] == depths[x["tree"]]) for x in found]
            columns = zip(*rows) if rows else [[]] * len(SEARCHED)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), common.to_arrow_type(f.dataType)) for x, f in zip(columns, SEARCHED, strict=True)], names=SEARCHED.names)

    return run


PLACED = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("chunks", T.IntegerType()), T.StructField("set", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("nodes", T.BinaryType())]
)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (set, size, sketch, nodes) a row for each node, of a tree's nodes the one with the shortest prefix."""
    for part in common.slices(batches):
        rows = []
        for name, size, own, found in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
            nodes, chunks = np.zeros(TREES, "<i8"), {}
            for x in sorted(found, key=lambda x: -x["depth"]):
                nodes[x["tree"]] = x["node"]
                chunks[x["node"]] = math.ceil(max(x["n"] / NODE_BLOCK, 8 * x["shingles"] / BLOCK_BYTES))
            rows += [(x, chunks[x], name, size, own, nodes.tobytes()) for x in nodes.tolist() if x]
        columns = zip(*rows) if rows else [[]] * len(PLACED)
        yield pa.RecordBatch.from_arrays([pa.array(list(x), common.to_arrow_type(f.dataType)) for x, f in zip(columns, PLACED, strict=True)], names=PLACED.names)


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, with chunk, and once for each pair (i, j) of chunks of their node that its chunk is part of."""
    cut = rows.withColumn("chunk", F.pmod(F.xxhash64("set", "node"), F.col("chunks")).cast("int"))
    both = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    return both.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", "chunks")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with the blocks (node, i, j) together, these columns first."""
    first = ("node", "i", "j")
    rows = rows.select(*first, *(x for x in rows.columns if x not in first))
    return rows.repartition(common.shuffle_partitions(rows.sparkSession), "node", "i", "j").sortWithinPartitions("node", "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the first n_keys columns, whole across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        keys = [batch.column(k).to_pylist() for k in range(n_keys)]
        for own in keys:
            change |= np.fromiter((a != b for a, b in zip(own, own[1:])), bool, batch.num_rows - 1)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(own[a] for own in keys)
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


SETS = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("hashes", T.BinaryType())])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.turn_to(__name__)
    for part in common.slices(batches, 0):
        own = [shingles(x).tobytes() for x in common.as_bytes(part.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in own], pa.binary()), pa.array(own, pa.binary())], names=SETS.names)


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all pairs of sets."""
    sizes = np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common_count = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[a:b], column[a:b] - k * width] = 1
        common_count += matrix @ matrix.T
    return common_count / np.maximum(sizes[:, None] + sizes[None, :] - common_count, 1)


NEEDED = T.StructType(
    [T.StructField("node", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("set", T.BinaryType()), T.StructField("chunk", T.IntegerType()), T.StructField("nodes", T.BinaryType())]
)


def _block(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool, int]:
    """A block's nodes [classes, trees], chunks, whether pairs must lie across chunks, and the number of its tree."""
    nodes = np.frombuffer(b"".join(group.column("nodes").to_pylist()), "<i8").reshape(group.num_rows, TREES)
    tree = int(np.flatnonzero(nodes[0] == group.column("node")[0].as_py())[0])
    return nodes, group.column("chunk").to_numpy(), group.column("i")[0].as_py() != group.column("j")[0].as_py(), tree


def _needed(threshold: float) -> Callable:
    """The rows of classes that have, in their block, a partner by sketch and size that no earlier tree gives them."""
    margin = sketch_margin(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            nodes, chunks, across, tree = _block(group)
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
            sizes = group.column("size").to_numpy()
            wanted = np.zeros(len(nodes), bool)
            # A class that another has found is not compared again: only whether it has a partner matters here.
            for k in range(len(nodes)):
                if wanted[k]:
                    continue
                near = np.minimum(sizes, sizes[k]) >= threshold * np.maximum(sizes, sizes[k]) - 1e-6
                if across:
                    near &= chunks != chunks[k]
                near[k] = False
                found = np.flatnonzero(near)
                found = found[~((nodes[found, :tree] == nodes[k, :tree]) & (nodes[k, :tree] != 0)).any(1)]
                found = found[(sketches[found] == sketches[k]).mean(1) >= margin]
                if len(found):
                    wanted[k] = True
                    wanted[found] = True
            if wanted.any():
                yield from group.select(NEEDED.names).take(pa.array(np.flatnonzero(wanted))).combine_chunks().to_batches()

    return run


LINKS = T.StructType([T.StructField("set", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("parent", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("similarity", T.DoubleType())])


def _block_links(group: pa.Table, threshold: float) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A block's classes, their similarities, and which pairs the block is to count and link."""
    nodes, chunks, across, tree = _block(group)
    names = group.column("set").to_pylist()
    linked = chunks[:, None] != chunks[None, :] if across else ~np.eye(len(names), dtype=bool)
    for t in range(tree):
        linked &= (nodes[:, t, None] != nodes[None, :, t]) | (nodes[:, t, None] == 0)
    similar = similarities([np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()])
    return names, similar, linked & (similar >= threshold - 1e-7)


def _verify(threshold: float, pairs: bool) -> Callable:
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            names, _, linked = _block_links(group, threshold)
            parents: list[bytes | None] = [None] * len(names)
            todo = np.ones(len(names), bool)
            for root in range(len(names)):
                stack = [root] if todo[root] else []
                todo[root] = False
                while stack:
                    own = stack.pop()
                    found = np.flatnonzero(linked[own] & todo).tolist()
                    todo[found] = False
                    stack += found
                    for k in found:
                        parents[k] = names[own]
            n = linked.sum(1)
            own = np.flatnonzero(n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own], pa.binary()), pa.array(n[own], pa.int64()), pa.array([parents[k] for k in own], pa.binary())], names=LINKS.names)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            names, similar, linked = _block_links(group, threshold)
            a, b = np.nonzero(np.triu(linked, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in a], pa.binary()), pa.array([names[k] for k in b], pa.binary()), pa.array(similar[a, b].astype(float))], names=PAIRS.names
            )

    return listed if pairs else counts


class JaccardJoin:
    """The join's stages over a table: members, classes, the forest, and verified links."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = TARGET):
        if recall([1] * TREES, threshold) < target:
            raise ValueError(f"{TREES} trees find a pair of similarity {threshold} with probability {recall([1] * TREES, threshold):.4f} at most, not {target}")
        self.spark = common.prepare(docs.sparkSession)
        common.ensure_checkpoints(self.spark)
        self.threshold, self.target = threshold, target
        self.docs = docs.select(F.col(doc_id).alias("id"), common.utf8(text).alias("text"))
        self.members = common.written(common.append_columns(self.docs, "text", _sign, SIGNED, ["text"]), "signatures")
        # Equal sets have equal signatures: any row's will do, and copies meet pre-aggregated.
        same = (F.first(name).alias(name) for name in ("size", "signature", "sketch"))
        self.classes = common.written(self.members.groupBy("set").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *same), "classes")
        self.needed = common.written(_blocks(_dealt(self._placed())).mapInArrow(_needed(threshold), NEEDED), "needed")

    def tries(self) -> DataFrame:
        """(tree, prefix, set, size): all trees' strings in order."""
        cut = F.expr(f"explode(transform(sequence(0, {TREES - 1}), t -> struct(t AS tree, substring(signature, t * {4 * DEPTH} + 1, {4 * DEPTH}) AS prefix)))")
        strings = self.classes.where("signature is not null").select("set", "size", cut.alias("x")).select("x.tree", "x.prefix", "set", "size")
        order = ("tree", "prefix", "set")
        return strings.repartitionByRange(common.shuffle_partitions(self.spark), *order).sortWithinPartitions(*order)

    def searched(self) -> DataFrame:
        """SEARCHED: the nodes with others of each class, and whether it has chosen them."""
        met = common.written(self.tries().mapInArrow(_met(depth_range(self.threshold, self.target)[0]), MET), "met")
        sizes = met.groupBy("node").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
        known = common.hot_join(met.drop("size"), common.written(sizes, "nodes"), "node", "n")
        by_class = known.groupBy("set").agg(F.collect_list(F.struct("tree", "depth", "node", "n", "shingles")).alias("nodes"))
        return by_class.mapInArrow(_choose(self.threshold, self.target), SEARCHED)

    def _placed(self) -> DataFrame:
        """PLACED: the classes below each node that counts."""
        searched = common.written(self.searched(), "searched")
        chosen = common.written(searched.where("chosen").groupBy("node").agg(F.max("n").alias("weight")), "chosen")
        held = common.hot_join(searched.drop("chosen"), chosen, "node", "weight").drop("weight")
        by_class = held.groupBy("set").agg(F.collect_list(F.struct("tree", "depth", "node", "n", "shingles")).alias("nodes"))
        return self.classes.select("set", "size", "sketch").join(by_class, "set").select("set", "size", "sketch", "nodes").mapInArrow(_place, PLACED)

    def _verified(self, pairs: bool) -> DataFrame:
        """LINKS or PAIRS, from the shingle sets of the classes that need them."""
        names = common.written(self.needed.select("set").distinct().join(self.classes.select("set", "id"), "set"), "wanted")
        texts = common.IdFilter(names, "id").split(self.docs, "id")[0].select("text")
        # Rows that share an id, or a place in the filter, may have other texts: the set itself decides, and each is taken once.
        sets = texts.mapInArrow(_sets, SETS).join(names.select("set"), "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes"))
        kind, schema = _verify(self.threshold, pairs), PAIRS if pairs else LINKS
        return _blocks(self.needed.join(sets, "set")).mapInArrow(kind, schema)

    def pairs(self) -> DataFrame:
        """(id_a, id_b, similarity): each pair of classes with at least the threshold, by their smallest ids."""
        names = self.classes.select("set", "id")
        left = names.select(F.col("set").alias("a"), F.col("id").alias("id_a"))
        right = names.select(F.col("set").alias("b"), F.col("id").alias("id_b"))
        return self._verified(True).join(left, "a").join(right, "b").select("id_a", "id_b", "similarity")

    def documents(self) -> DataFrame:
        """(id, class_id, copy_id, n_links) of every row: the smallest id of all texts that links join
        with its own, the smallest id of its copies, and the number of other classes it is similar to."""
        links = common.written(self._verified(False), "links")
        counts = links.groupBy("set").agg(F.sum("n").alias("n_links"))
        joined = connected_components(links.where("parent is not null").select(F.col("set").alias("a"), F.col("parent").alias("b")))
        classes = self.classes.select("set", F.col("id").alias("copy_id"), "copies")
        named = common.written(classes.join(joined.select(F.col("node").alias("set"), "component"), "set").join(counts, "set"), "linked")
        least = named.groupBy("component").agg(F.min("copy_id").alias("class_id"), F.count("*").alias("n"))
        groups = common.hot_join(named, common.written(least, "groups"), "component", "n").select("set", "class_id", "n_links")
        every = common.written(classes.join(groups, "set", "left"), "all")
        out = common.hot_join(self.members.select("id", "set"), every, "set", "copies", "left")
        return out.select("id", F.coalesce("class_id", "copy_id").alias("class_id"), "copy_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(common.documents(spark, sf_dir, "doc_id", "text")).documents().withColumnRenamed("id", "doc_id")


def without_near_duplicates(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group that links join, columns unchanged: the first in the table's
    order. Only the rows that a filter of the ids to drop lets pass are joined with those."""
    row = common.fresh(docs.columns, "row")
    # The row numbers are written with the rows, so that every later reading finds the same ones.
    numbered = common.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = JaccardJoin(numbered, row, text, threshold).documents()
    gone = common.written(found.where("id <> class_id").select(F.col("id").alias("gone")), "gone")
    may_go, stay = common.IdFilter(gone, "gone").split(numbered, row)
    return stay.unionByName(may_go.join(gone, F.col(row) == F.col("gone"), "left_anti")).select(docs.columns)


#: DuckDB: classes of equal shingle sets, exact similarities over shared shingles, and their closure.
ORACLE = """
WITH RECURSIVE dw AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT row_no, doc_id, t, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' '))) END AS s FROM dw
), keyed AS (
  SELECT row_no, doc_id, s, sha256(CASE WHEN len(s) = 0 THEN 'text ' || t ELSE 'set ' || array_to_string(list_sort(s), '|') END) AS key FROM sets
), classes AS (SELECT key, min(doc_id) AS copy_id, any_value(s) AS s FROM keyed GROUP BY key),
grams AS (SELECT key, len(s) AS size, unnest(s) AS gram FROM classes),
links AS (
  SELECT a.key AS a, b.key AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.key <> b.key
  GROUP BY a.key, b.key, a.size, b.size HAVING 5 * count(*) >= 4 * (a.size + b.size - count(*))
), reach AS (
  SELECT key AS a, key AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), groups AS (SELECT r.a AS key, min(c.copy_id) AS class_id FROM reach r JOIN classes c ON r.b = c.key GROUP BY r.a),
counts AS (SELECT a AS key, count(*) AS n FROM links GROUP BY a)
SELECT k.doc_id, g.class_id, c.copy_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links
FROM keyed k JOIN classes c USING (key) JOIN groups g USING (key) LEFT JOIN counts n USING (key)
"""
