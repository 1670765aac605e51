"""Exact Jaccard join on word n-grams by vertical partitioning.

All n-grams of the corpus have one global order: by hash, with the frequent
ones last.  A document's set, in that order, is cut into fragments, each a
range of the order.  Two sets are compared fragment by fragment, by separate
tasks; the partial overlaps are summed for each pair.

Before that, pairs that can't reach the threshold are kept from arising:

* equal sets are one class, and only classes are compared;
* two classes that link share an n-gram in the first
  ``n - ceil(threshold x n) + 1`` of their sets (prefix filter).  Putting
  frequent n-grams last keeps shared boilerplate out of the prefixes;
* sizes must fit, and a parity bitmap of each set bounds the overlap from
  above without reading the sets.

Only components are asked for, so not every link within a group of near
copies is made: each class first meets one other class of its prefix groups;
after that, only pairs from different components are left to compare, and of
these none is left out.  A prefix group is compared in blocks of bounded size,
and a task gives back only the pairs that bitmaps can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tulkki.llm.components import components
from tulkki.llm.store import broadcast_if_few, discard, materialise
from tulkki.llm.words import Prefix, Words, mix, pieces

CELL_BITS = 23
BLOCK_BITS = 15
#: What a task works on at once: text, rows with bitmaps, bytes of bitmaps of compared pairs.
TEXT_BYTES, SLICE_ROWS, AT_ONCE_BYTES = 1 << 19, 2048, 8 << 20
#: Stands for a null doc_id inside the join: larger than any other.
NO_ID = (1 << 63) - 1
SKETCH = "doc_id long, tag long, node long, n int, prefix array<long>, bitmap binary"


class Sets:
    """Distinct word n-grams of the texts of one piece, sorted by row and
    global order: ``gram`` with the bounds of each row in ``first``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int, hot: np.ndarray | None = None):
        words = Words(data, offsets, lower=True)
        rows, total = len(offsets) - 1, len(words.hash)
        sums = Prefix(words.hash, 3)
        at = np.arange(max(0, total - k + 1))
        at = at[words.row[at] == words.row[at + k - 1]]
        counts = np.diff(words.first)
        short = np.flatnonzero((counts > 0) & (counts < k))
        begin = np.concatenate([at, words.first[short]])
        end = np.concatenate([at + k, words.first[short + 1]])
        row = np.concatenate([words.row[at], short])
        gram = sums.ranges(begin, end)
        cell = gram >> np.uint64(64 - CELL_BITS)
        late = hot[cell >> np.uint64(3)] << (cell & np.uint64(7)).astype(np.uint8) & 128 if hot is not None else np.zeros(len(gram), np.uint8)
        order = np.lexsort((gram, late, row))
        gram, row = gram[order], row[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        self.gram, self.row = gram[new], row[new]
        self.first = np.searchsorted(self.row, np.arange(rows + 1))
        self.n = np.diff(self.first)
        # the identity of a set: a sum over its members, so that their order doesn't matter
        each = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.gram ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        self.node = mix((each[self.first[1:]] - each[self.first[:-1]]) + self.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def prefix(self, percent: int, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Which grams are in the prefix of their set (or in ``times`` as many), and how many each row has."""
        size = np.where(self.n > 0, np.minimum(self.n, times * (self.n - -(-self.n * percent // 100) + 1)), 0)
        place = np.arange(len(self.gram)) - np.repeat(self.first[:-1], self.n)
        return place < np.repeat(size, self.n), size


def _cells(k: int, percent: int):
    """How many of the first grams of each set, in hash order, fall in each cell of the hash range.

    Twice the prefix is counted, as a prefix reaches further where grams go last."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text"), TEXT_BYTES):
                sets = Sets(data, offsets, k)
                cells, times = np.unique(sets.gram[sets.prefix(percent, 2)[0]] >> np.uint64(64 - CELL_BITS), return_counts=True)
                counts[cells] += times.astype(np.uint32)
        for block, some in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            cells = np.flatnonzero(some)
            if len(cells):
                times = some[cells]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([cells.astype(np.uint16).tobytes()], pa.binary()),
                                                  pa.array([times.astype(np.uint16 if times.max() < 1 << 16 else np.uint32).tobytes()], pa.binary())],
                                                 names=["block", "cells", "counts"])
    return task


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the cell counts of each block that this task holds."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells, times in zip(batch.column("block").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
            at, raw = np.frombuffer(cells.as_buffer(), np.uint16), times.as_buffer()
            if block not in sums:
                sums[block] = np.zeros(1 << BLOCK_BITS, np.int64)
            sums[block][at] += np.frombuffer(raw, np.uint16 if raw.size == 2 * len(at) else np.uint32)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())],
                                         names=["block", "counts"])


def _over(limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [np.packbits(np.frombuffer(x.as_buffer(), np.int64) >= limit).tobytes() for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(marks, pa.binary())], names=["block", "marks"])
    return task


def frequent_cells(docs: DataFrame, k: int, percent: int) -> np.ndarray:
    """The cells of the hash range (2**23 of them, a bit each, whatever the
    corpus) with far more grams than others; their grams go last in the global
    order.  Any order gives the same result, a good one gives few pairs."""
    parts = docs.mapInArrow(_cells(k, percent), "block int, cells binary, counts binary").repartition("block").mapInArrow(_add, "block int, counts binary")
    parts = materialise(parts, "cells")
    total = parts.mapInArrow(_totals, "total long").agg(F.sum("total")).first()[0] or 0
    limit = max(16, 3 * total >> CELL_BITS)
    hot = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), bool)
    for block, marks in parts.mapInArrow(_over(limit), "block int, marks binary").collect():
        hot[block] = np.unpackbits(np.frombuffer(marks, np.uint8)).astype(bool)
    return np.packbits(hot)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column("counts")]
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["total"])


def _sketch(k: int, percent: int, hot: np.ndarray):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id"), batch.column("tag")
            for lo, hi, data, offsets in pieces(batch.column("text"), TEXT_BYTES):
                sets = Sets(data, offsets, k, hot)
                chosen, size = sets.prefix(percent)
                bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    ids[lo:hi], tags[lo:hi], pa.array(sets.node.view(np.int64)), pa.array(sets.n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(sets.gram[chosen].view(np.int64))),
                    pa.array([parity(sets.gram[a:b]) for a, b in zip(sets.first[:-1], sets.first[1:], strict=True)], pa.binary()),
                ], names=["doc_id", "tag", "node", "n", "prefix", "bitmap"])
    return task


def parity(grams: np.ndarray) -> bytes:
    """One bit for each residue class of the hashes: whether it has an odd number of them.  Two bits a gram at least."""
    bits = 64 << max(0, 2 * int(len(grams)) - 1 >> 6).bit_length()
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of some rows, by size, to compare pairs of rows."""

    def __init__(self, column: pa.Array):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        _, offsets, data = column.buffers()
        # bitmaps are whole 64-bit words, one behind the other
        offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] // 8
        self.words = np.diff(offsets)
        self.place = np.zeros(len(column), np.int64)
        self.of: dict[int, np.ndarray] = {}
        raw = np.frombuffer(data, np.uint64, offsets[-1]) if len(column) and offsets[-1] else np.zeros(0, np.uint64)
        for size in np.unique(self.words):
            rows = np.flatnonzero(self.words == size)
            self.place[rows] = np.arange(len(rows))
            self.of[int(size)] = raw[offsets[rows][:, None] + np.arange(size)]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of rows, how many classes differ in parity: no more than grams that only one of them has."""
        out = np.zeros(len(x), np.int64)
        kinds = self.words[x] * (1 << 20) + self.words[y]
        for kind in np.unique(kinds):
            every = np.flatnonzero(kinds == kind)
            # so many pairs at once that their bitmaps take AT_ONCE_BYTES
            step = max(1, AT_ONCE_BYTES // (8 * int(self.words[x[every[0]]] + self.words[y[every[0]]])))
            for lo in range(0, len(every), step):
                mine = every[lo:lo + step]
                first, second = self._get(x[mine]), self._get(y[mine])
                while first.shape[1] > second.shape[1]:
                    first = first[:, :first.shape[1] // 2] ^ first[:, first.shape[1] // 2:]
                while second.shape[1] > first.shape[1]:
                    second = second[:, :second.shape[1] // 2] ^ second[:, second.shape[1] // 2:]
                out[mine] = np.bitwise_count(first ^ second).sum(axis=1)
        return out

    def _get(self, rows: np.ndarray) -> np.ndarray:
        return self.of[int(self.words[rows[0]])][self.place[rows]]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(lo, SLICE_ROWS)


def _may_link(percent: int):
    """Keep the pairs whose bitmaps leave room for the threshold."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            n = batch.num_rows
            both = Bitmaps(pa.concat_arrays([batch.column("bitmap_a"), batch.column("bitmap_b")]))
            most = (sizes - both.apart(np.arange(n), np.arange(n, 2 * n))) // 2
            yield batch.select(["a", "b", "n_a", "n_b", "votes"]).filter(pa.array(100 * most >= percent * (sizes - most)))
    return task


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pairs_within(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size > 64:
        return np.triu_indices(size, 1)
    if size not in _triangles:
        _triangles[size] = np.triu_indices(size, 1)
    return _triangles[size]


def _compare(percent: int, at_once: int = 1 << 17):
    """Pairs of rows of one cell (gram, i, j) that may link and are in different components.

    Rows come sorted by cell.  A cell has the members of one block of a gram's
    group (i = j) or of two blocks, which are compared across."""
    def keep(batch: pa.RecordBatch, bitmaps: Bitmaps, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        node, root, n, at = (batch.column(c).to_numpy() for c in ("node", "root", "n", "at"))
        n = n.astype(np.int64)
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        # of the first common gram of two sets that link, what is left from there on suffices for the overlap
        left = np.minimum(n[x] - at[x], n[y] - at[y])
        fits = (root[x] != root[y]) & (100 * least >= percent * most) & (left * (100 + percent) >= (least + most) * percent)
        x, y = x[fits], y[fits]
        if len(x):
            bound = (n[x] + n[y] - bitmaps.apart(x, y)) // 2
            fits = 100 * bound >= percent * (n[x] + n[y] - bound)
            x, y = x[fits], y[fits]
        swap = node[x] > node[y]
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(n[a].astype(np.int32)), pa.array(n[b].astype(np.int32))],
                                          names=["a", "b", "n_a", "n_b"])

    def whole(batch: pa.RecordBatch, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, xs, ys, count, bitmaps = batch.column("side").to_numpy(), [], [], 0, Bitmaps(batch.column("bitmap"))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            ones = np.flatnonzero(side[lo:hi])
            if len(ones):
                zeros = np.flatnonzero(side[lo:hi] == 0)
                x, y = np.repeat(zeros, len(ones)), np.tile(ones, len(zeros))
            elif batch.column("i")[lo].as_py() == batch.column("j")[lo].as_py():
                x, y = _pairs_within(hi - lo)
            else:
                continue
            for at in range(0, len(x), at_once):
                xs.append(x[at:at + at_once] + lo)
                ys.append(y[at:at + at_once] + lo)
                count += len(xs[-1])
                if count >= at_once:
                    yield keep(batch, bitmaps, np.concatenate(xs), np.concatenate(ys))
                    xs, ys, count = [], [], 0
        if count:
            yield keep(batch, bitmaps, np.concatenate(xs), np.concatenate(ys))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _slices(batches):
            if rest is not None:
                batch = pa.concat_batches([rest, batch])
            gram, i, j = (batch.column(c).to_numpy() for c in ("gram", "i", "j"))
            new = np.flatnonzero((gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = np.concatenate([[0], new])
            yield from whole(batch, edges)
            rest = batch.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield from whole(rest, np.array([0, rest.num_rows]))
    return task


def _fragments(k: int, bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hi, data, offsets in pieces(batch.column("text"), TEXT_BYTES):
                sets = Sets(data, offsets, k)
                fragment = (sets.gram >> np.uint64(64 - bits)).astype(np.int64)
                cut = sets.row * (1 << bits) + fragment
                start = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]])) if len(cut) else np.zeros(0, np.int64)
                bounds = np.append(start, len(cut)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(sets.node[sets.row[start]].view(np.int64)), pa.array(fragment[start].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(sets.gram.view(np.int64))),
                ], names=["node", "fragment", "grams"])
    return task


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, votes) that sizes and bitmaps leave."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bitmap").alias(f"bitmap_{x}"))
    fits = F.least("n_a", "n_b").cast("long") * 100 >= F.greatest("n_a", "n_b").cast("long") * percent
    return (pairs.join(side("a"), "a").join(side("b"), "b").where(fits)
            .select("a", "b", "n_a", "n_b", "votes", "bitmap_a", "bitmap_b")
            .mapInArrow(_may_link(percent), "a long, b long, n_a int, n_b int, votes long"))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, bits: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: partial overlaps of each fragment, summed for each pair."""
    pairs = materialise(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "doc_id", "tag"), "node")
    asked = materialise(asked.select("doc_id", "tag").distinct(), "asked")
    sets = docs.join(broadcast_if_few(asked), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"]).select("text")
    sets = materialise(sets.mapInArrow(_fragments(k, bits), "node long, fragment int, grams array<long>"), "fragments")
    ours = sets.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("x"))
    theirs = sets.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("y"))
    partial = (pairs.join(ours, "a").join(theirs, ["b", "fragment"])
               .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("part")))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return summed.where(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent).select("a", "b")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, fragment_bits: int = 2, block: int = 512) -> DataFrame:
    """Components of documents whose sets of word ``k``-grams have a Jaccard
    similarity of ``percent`` / 100 at least.

    One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable by links, itself included), tag (a hash of doc_id and
    text) and root (a number for each component).  A-Z are lower-cased.  A text
    of fewer words than ``k`` has its whole sequence as one gram; a null text
    or one without words has none, and is its own component.  Rows with a null
    doc_id link like others but lend no id; where a component has no id, it is
    null.  Repeated rows are copies of each other.  Other columns are left
    out; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hot = frequent_cells(docs.select("text"), k, percent)
    tagged = docs.withColumn("tag", F.xxhash64("doc_id", "text")).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    sketch = materialise(tagged.select("doc_id", "tag", "text").mapInArrow(_sketch(k, percent, hot), SKETCH), "sketch")

    labels = materialise(sketch.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "tag")).alias("one"))
                         .select("node", "one.doc_id", "one.tag"), "labels")
    classes = materialise(sketch.join(broadcast_if_few(labels), ["node", "doc_id", "tag"]).dropDuplicates(["node"]), "classes")
    nodes = materialise(sketch.select("doc_id", "tag", "node", "n"), "nodes")
    discard(sketch)
    tokens = classes.select(F.posexplode("prefix").alias("at", "gram"), "node", "n")
    common = tokens.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    shared = materialise(tokens.join(common, "gram"), "shared")

    # every class meets the class that most of its prefix groups name: each names the member with the most common grams
    known = shared.groupBy("gram").agg(F.count("*").alias("c"))
    fame = shared.join(known, "gram").groupBy("node").agg(F.sum("c").alias("fame"))
    centres = shared.join(fame, "node").groupBy("gram").agg(F.max(F.struct("fame", "node"))["node"].alias("b"))
    votes = (shared.join(centres, "gram").where("node != b").groupBy(F.col("node").alias("a"), "b")
             .agg(F.count("*").alias("votes")))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.col("votes").desc(), "b"))
    first = _pruned(votes, classes, percent).withColumn("r", best).where("r = 1").drop("r", "votes")
    links = materialise(_linked(first, tagged, classes, k, percent, fragment_bits), "links")

    # then all pairs that share a prefix gram and are still in different components
    roots = components(links)
    placed = (shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
              .select("gram", "node", "root", "n", "at"))
    split = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    placed = materialise(placed.join(split, "gram"), "placed")
    # the group of a gram is cut into blocks of bounded size, and blocks meet in pairs; pairs that bitmaps rule out never leave the task
    sizes = placed.groupBy("gram").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.expr("CAST(pmod(xxhash64(node), blocks) AS int)")
    rows = (placed.join(sizes, "gram").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root", "n", "at")
            .join(classes.select("node", "bitmap"), "node"))
    pairs = (rows.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
             .mapInArrow(_compare(percent), "a long, b long, n_a int, n_b int").distinct())
    late = _linked(pairs, tagged, classes, k, percent, fragment_bits)
    roots = materialise(components(links.unionByName(late)), "roots")

    ids = (labels.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(least, "root").select("node", "root", "component_id")
    unset = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return (nodes.join(named, "node", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .select(unset("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), unset("component_id").alias("component_id"),
                    "tag", F.coalesce("root", "tag").alias("root")))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag", "root")


OP5_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS gram FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) r USING (doc_id)
"""
