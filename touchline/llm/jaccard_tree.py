"""N-gram Jaccard join by signature trees.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is ``NUM / DEN`` (0.75) or more. Equal sets form one class, so copies cost
nothing. The join between classes is exact:

1. Every shingle's document frequency is counted (map tasks send, for each shingle partition, one
   packed block: eight bytes a shingle and a table of the classes). A class of n
   shingles can only link if at least ceil(0.75 n) of them occur in another class; the others
   are done. The rest continue with their shared shingles alone: no overlap lies elsewhere.
2. Linked classes share one of their n - ceil(0.75 n) + 1 rarest shingles. Classes
   that share such a shingle are put into one candidate component; no link leaves it.
3. A component's classes are dealt to blocks of about ``BLOCK``; each block, sorted by size, forms a signature tree. A node holds the OR of its classes' token bitmaps, the range
   of their sizes, and the largest excess of tokens over bits; a pair of nodes is dropped when
   its sizes are too far apart or min(excess) + popcount(AND) is below the overlap that
   its smallest members would need. Pairs of leaves are verified on the sets.
   Nodes whose classes are connected already need no further links for components
   (``spanning=True``): a group of g near copies costs about g verifications, not g squared.
4. A component of more blocks first joins each block with itself and with the first, then,
   where that left parts unconnected, those pairs of blocks that may connect them. A task
   holds two blocks, however large the component.

Defined cases: null and wordless texts have size 0 and link to nothing (each its own
component); repeated rows and equal texts are in one class; null ids are in a class
but never name a component; empty tables give no rows; further columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.joins import bounded_broadcast
from touchline.llm.common import binary_texts, cut, give_back, map_arrow, pack_arrays, shuffle_partitions, text_slices, unpack_arrays
from touchline.llm.components import components
from touchline.llm.textops import distinct_sets, mix

NUM, DEN = 75, 100
BLOCK = 1024
FANOUT = 8
BITS = 2048
SLICE = 1 << 23
PART_SHINGLES = 4_000_000
MAX_BROADCAST = 500_000      # rows of two numbers
U = np.uint64


def least_shared(n):
    """Shingles that a set of n shares with every set it links to."""
    return -(-NUM * n // DEN)


def digest(s: np.ndarray) -> int:
    """64-bit name of a set of shingles, as a signed number."""
    if not len(s):
        return 0
    h = s.sum(keepdims=True) * U(3) + mix(s * U(0x9E3779B97F4A7C15)).sum(keepdims=True)
    return int(mix(mix(h) + U(len(s))).view(np.int64)[0])


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id (0: no shingles) of every row."""
    def run(batch):
        texts, ids = binary_texts(batch), batch.column("doc_id")
        for part in text_slices(texts):
            sets = distinct_sets(texts[part])
            yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(sets)), batch.column("text_hash").slice(part.start, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([digest(s) for s in sets], pa.int64())], names=["doc_id", "text_hash", "n_shingles", "class_id"])

    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return map_arrow(hashed, run, "doc_id long, text_hash long, n_shingles long, class_id long")


def shared_shingles(docs: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """sizes: class_id, n. Returns class_id, n, tokens: the classes with enough shared shingles; tokens are 8-byte numbers of
    the shingles that another class holds too, rarest first (document frequency, then number)."""
    def scatter(batch):
        texts = binary_texts(batch)
        for piece in text_slices(texts, SLICE):
            found: dict[int, np.ndarray] = {}
            for part in text_slices(texts[piece]):
                for s in distinct_sets(texts[piece][part]):
                    if len(s):
                        found[digest(s)] = s
            names = list(found)
            for first in range(0, len(names), 65_536):      # places are two bytes
                some = names[first:first + 65_536]
                yield from _scattered(np.array(some, np.int64), [found[k] for k in some], parts)

    def frequencies(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, values = [], []
        for data in table["data"].to_pylist():
            n, place, low, high = unpack_arrays(data)
            names.append(n[place])
            values.append(low.astype(np.uint64) | (high.astype(np.uint64) << U(32)))
        names, values = np.concatenate(names), np.concatenate(values)
        order = np.lexsort((names, values))
        names, values = names[order], values[order]
        once = np.concatenate(([True], (values[1:] != values[:-1]) | (names[1:] != names[:-1])))
        names, values = names[once], values[once]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        number = np.cumsum(new) - 1
        df = np.bincount(number)
        keep = df[number] > 1
        names, number, df = names[keep], number[keep], np.minimum(df[number][keep], 65_535)
        give_back()
        # back to the classes: blocks by the class's own partition
        home = names % parts
        order = np.lexsort((number, names, home))
        names, number, df, home = names[order], number[order].astype(np.uint32), df[order].astype(np.uint16), home[order]
        edges = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True]))) if len(home) else np.zeros(1, np.int64)
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            first = np.flatnonzero(np.concatenate(([True], names[a + 1:b] != names[a:b - 1])))
            rows.append(pack_arrays(names[a:b][first], np.diff(np.append(first, b - a)).astype(np.uint32), number[a:b], df[a:b]))
        return pa.table({"home": pa.array(home[edges[:-1]], pa.int32()), "origin": pa.array([key[0].as_py()] * len(rows), pa.int32()), "data": pa.array(rows, pa.binary())})

    def gather(key: tuple[pa.Scalar, ...], blocks: pa.Table, known: pa.Table) -> pa.Table:
        names, tokens, df = [], [], []
        for origin, data in zip(blocks["origin"].to_pylist(), blocks["data"].to_pylist()):
            name, count, number, d = unpack_arrays(data)
            names.append(np.repeat(name, count))
            tokens.append((U(origin) << U(32)) | number.astype(np.uint64))
            df.append(d)
        rows = []
        if names:
            names, tokens, df = np.concatenate(names), np.concatenate(tokens), np.concatenate(df)
            order = np.lexsort((tokens, df, names))
            names, tokens = names[order], tokens[order]
            edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True])))
            ids, n = np.array(known["class_id"]), np.array(known["n"])
            n = n[np.argsort(ids)][np.searchsorted(np.sort(ids), names[edges[:-1]])].tolist()
            rows = [(int(names[a]), size, tokens[a:b].astype("<u8").tobytes()) for a, b, size in zip(edges[:-1], edges[1:], n) if b - a >= least_shared(size)]
        return pa.table({"class_id": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64()), "tokens": pa.array([r[2] for r in rows], pa.binary())})

    blocks = (map_arrow(docs.select("text"), scatter, "part int, data binary")
              .groupBy("part").applyInArrow(frequencies, "home int, origin int, data binary"))
    known = sizes.withColumn("home", F.pmod("class_id", F.lit(parts)).cast("int"))
    return blocks.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(gather, "class_id long, n long, tokens binary")


def _scattered(names, sets, parts):
    flat, places = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # the upper bits choose the partition, the lower 48 tell shingles apart in it
    part = ((flat >> U(48)) * U(parts) >> U(16)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        some = order[edges[p]:edges[p + 1]]
        used, place = np.unique(places[some], return_inverse=True)
        values = flat[some]
        data = pack_arrays(names[used], place.astype(np.uint16), (values & U(0xFFFFFFFF)).astype(np.uint32), ((values >> U(32)) & U(0xFFFF)).astype(np.uint16))
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])


def _candidates(active: DataFrame) -> DataFrame:
    """(id, component): classes joined through the shingles of their prefixes."""
    def prefixes(batch):
        ids, tokens = [], []
        for c, n, data in zip(*(batch.column(x).to_pylist() for x in ("class_id", "n", "tokens"))):
            t = np.frombuffer(data, "<u8")
            # the n - len(t) shingles that no other class holds come first in the order
            t = t[:max(0, n - least_shared(n) + 1 - (n - len(t)))]
            ids.append(np.full(len(t), c, np.int64))
            tokens.append(t.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(tokens))], names=["id", "token"])

    postings = cut(map_arrow(active, prefixes, "id long, token long"))
    hubs = postings.groupBy("token").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub <> _last").drop("_last")
    return components(postings.join(hubs, "token").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))


class Tree:
    """Signature tree over sets sorted by size; level 0 holds the sets themselves."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray):
        self.tokens, self.sizes = tokens, sizes
        bits = np.zeros((len(tokens), BITS // 64), np.uint64)
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        where = (mix(np.concatenate(tokens)) % U(BITS)).astype(np.int64)
        np.bitwise_or.at(bits, (owner, where // 64), U(1) << (where % 64).astype(np.uint64))
        held = np.array([len(t) for t in tokens])
        self.levels = [(bits, sizes, sizes, held - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))


def _possible(a, b, i, j) -> np.ndarray:
    """May any set below node i of level ``a`` link to one below node j of level ``b``?"""
    (ba, la, ha, ea), (bb, lb, hb, eb) = a, b
    ok = (DEN * ha[i] >= NUM * lb[j]) & (DEN * hb[j] >= NUM * la[i])
    i, j = i[ok], j[ok]
    overlap = np.minimum(ea[i], eb[j]) + np.bitwise_count(ba[i] & bb[j]).sum(axis=1, dtype=np.int64)
    ok[ok] = (NUM + DEN) * overlap >= NUM * (la[i] + lb[j])
    return ok


def join_trees(a: Tree, b: Tree, parts: np.ndarray, spanning: bool = True):
    """Links (i, j, shared) between the sets of two trees, or of one tree with itself (``a is b``).

    ``parts``: union-find forest over a's sets, followed by b's unless ``a is b``; with
    ``spanning``, pairs connected already are passed over, and found links are entered."""
    shift = 0 if a is b else len(a.sizes)

    def root(x):
        while parts[x] != x:
            parts[x] = parts[parts[x]]
            x = parts[x]
        return x

    top = max(len(a.levels), len(b.levels)) - 1
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]
    pairs = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    links = []
    while pairs:
        k, i, j = pairs.pop()
        if spanning and k <= 1:
            joined = np.array([root(x) for x in range(len(parts))])
            if k == 0:
                keep = joined[i] != joined[j + shift]
                i, j = i[keep], j[keep]
        ok = _possible(level(a, k), level(b, k), i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if k == 0:
            for x, y in zip(i.tolist(), j.tolist()):
                if spanning and root(x) == root(y + shift):
                    continue
                shared = len(np.intersect1d(a.tokens[x], b.tokens[y], assume_unique=True))
                if DEN * shared >= NUM * (int(a.sizes[x]) + int(b.sizes[y]) - shared):
                    links.append((x, y, shared))
                    parts[max(root(x), root(y + shift))] = min(root(x), root(y + shift))
            continue
        if len(i) > 64:        # depth first, in pieces: links found early spare later pairs
            for s in range(0, len(i), 64):
                pairs.append((k, i[s:s + 64], j[s:s + 64]))
            continue
        down = lambda t, x: (np.arange(FANOUT) + x * FANOUT, len(level(t, k - 1)[0])) if len(t.levels) > k else (np.array([x]), len(level(t, k - 1)[0]))
        ni, nj = [], []
        for x, y in zip(i.tolist(), j.tolist()):
            (cx, mx), (cy, my) = down(a, x), down(b, y)
            gx, gy = (g.ravel() for g in np.meshgrid(cx[cx < mx], cy[cy < my], indexing="ij"))
            if a is b:
                half = gx < gy if k == 1 else gx <= gy
                gx, gy = gx[half], gy[half]
            ni.append(gx)
            nj.append(gy)
        pairs.append((k - 1, np.concatenate(ni), np.concatenate(nj)))
    return links


def _join_group(table: pa.Table, i: int, j: int, spanning: bool):
    ids, n, block, label = (np.array(table[x]) for x in ("class_id", "n", "block", "label"))
    order = np.lexsort((ids, n, block))
    ids, n, block, label = ids[order], n[order], block[order], label[order]
    data = table["tokens"].to_pylist()
    tokens = [np.sort(np.frombuffer(data[x], "<u8")) for x in order]
    m = int((block == i).sum()) if i != j else len(ids)
    if not m or (i != j and m == len(ids)):
        return []
    _, first, which = np.unique(label, return_index=True, return_inverse=True)
    parts = first[which]
    a = Tree(tokens[:m], n[:m])
    b = a if i == j else Tree(tokens[m:], n[m:])
    return [(int(ids[x]), int(ids[y + (0 if a is b else m)]), s) for x, y, s in join_trees(a, b, parts, spanning)]


def _joined(rows: DataFrame, spanning: bool) -> DataFrame:
    """rows: component, i, j, block, class_id, n, tokens, label."""
    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        links = _join_group(table, key[1].as_py(), key[2].as_py(), spanning)
        a, b, s = zip(*links) if links else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "shared": pa.array(s, pa.int64())})

    return rows.groupBy("component", "i", "j").applyInArrow(join, "a long, b long, shared long")


def class_links(docs: DataFrame, sizes: DataFrame, parts: int, spanning: bool = True) -> DataFrame:
    """(a, b, shared): links between classes; with ``spanning``, enough of them to connect what links connect."""
    active = cut(shared_shingles(docs, sizes, parts))
    return linked(cut(active.join(blocks_of(_candidates(active)), "class_id")), spanning)


def blocks_of(within: DataFrame) -> DataFrame:
    """within: id, component. Returns component, class_id, last, block."""
    # classes are dealt to a component's blocks by hash: no window gathers a large component
    counts = within.groupBy("component").agg(((F.count("*") - 1) / BLOCK).cast("int").alias("last"))
    return (within.join(counts, "component").withColumnRenamed("id", "class_id")
            .withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("last") + 1).cast("int")))


def linked(placed: DataFrame, spanning: bool = True) -> DataFrame:
    """(a, b, shared): links within components. placed (checkpointed): class_id, n, tokens, component, last, block."""
    zero, block = F.lit(0), F.col("block")
    # each block with itself, and with the first
    partners = F.when(block == 0, F.sequence(zero, F.col("last"))).otherwise(F.array(zero, block))
    first = (placed.withColumn("label", F.col("class_id")).withColumn("_with", F.explode(partners))
             .withColumns({"i": F.least(block, "_with"), "j": F.greatest(block, "_with")}).drop("_with", "last"))
    links = cut(_joined(first, spanning))
    large = placed.where("last > 1")
    if large.isEmpty():
        return links
    labels = components(links.select("a", "b")).withColumnRenamed("id", "class_id").withColumnRenamed("component", "label")
    large = cut(large.join(labels, "class_id", "left").withColumn("label", F.coalesce("label", "class_id")))
    nodes = (large.where("block > 0").groupBy("component", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")))
    other = nodes.select("component", *(F.col(c).alias(f"_{c}") for c in ("block", "lo", "hi", "least", "most")))
    open_pairs = nodes.join(other, "component").where(F.col("block") < F.col("_block")).where(DEN * F.col("most") >= NUM * F.col("_least"))
    if spanning:
        open_pairs = open_pairs.where("not (lo = hi and _lo = _hi and lo = _lo)")
    keys = open_pairs.select("component", F.col("block").alias("i"), F.col("_block").alias("j"))
    ends = keys.withColumn("block", F.col("i")).union(keys.withColumn("block", F.col("j")))
    return links.union(cut(_joined(large.join(ends, ["component", "block"]).drop("last"), spanning)))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, class_id, component (the name of one of its classes; null without shingles) of every row."""
    named = cut(classes(docs))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(min(65_536, max(shuffle_partitions(docs), -(-total // PART_SHINGLES))))
    sizes = named.where("class_id <> 0").groupBy("class_id").agg(F.max("n_shingles").alias("n"))
    joined = components(class_links(docs, sizes, parts).select("a", "b")).withColumnRenamed("id", "class_id")
    # a hot class is one key of many narrow rows; adaptive execution may split it
    return named.join(joined, "class_id", "left").withColumn("component", F.when(F.col("class_id") != 0, F.coalesce("component", "class_id")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id (the smallest id of the component) of every row."""
    rows = cut(grouped(docs))
    heads = rows.groupBy("component").agg(F.min("doc_id").alias("component_id")).where("component is not null")
    return rows.join(heads, "component", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one of each component: the smallest id stays (null
    is the largest), of equal ids the one with the smallest hash of its text, of equal rows one. Rows without shingles stay."""
    rows = cut(grouped(docs).where("component is not null"))
    rank = F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "text_hash")
    heads = rows.groupBy("component").agg(F.min(rank).alias("head"))
    marked = cut(rows.join(heads, "component").select("doc_id", "text_hash", (rank == F.col("head")).alias("stays")))
    names = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    # the row travels as one column, so its own columns may have any names
    carried = docs.select(F.struct("*").alias("_row"))
    key = F.xxhash64(F.coalesce("_row.text", F.lit("")))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_hash"))
    gone = cut(names(marked.where("not stays")).distinct())
    twice = cut(names(marked.where("stays")).groupBy("_id", "_hash").count().where("count > 1").drop("count"))
    kept = carried.join(bounded_broadcast(gone, MAX_BROADCAST), same, "left_anti")
    if not twice.isEmpty():
        repeated = carried.join(bounded_broadcast(twice, MAX_BROADCAST), same, "left_semi")
        once = repeated.withColumns({"_id": F.col("_row.doc_id"), "_key": key}).dropDuplicates(["_id", "_key"]).select("_row")
        kept = kept.join(bounded_broadcast(twice, MAX_BROADCAST), same, "left_anti").union(once)
    return kept.select("_row.*")
