"""Conversation prefixes by z-fast tries.

A conversation is the sequence of its turns; a turn counts by a 128-bit digest
of its role and text, a prefix by the digest chained over its turns. A z-fast
trie keeps the compacted trie's nodes in a hash table under their handles: a
node whose edge covers the depths (top, extent] lies under the prefix of the
two-fattest of these depths, the one divisible by the highest power of two. A
conversation's exit node is found by fat binary search: the two-fattest depth
of the open interval is looked up; a hit moves the lower end to that node's
extent (or is the exit node, if the conversation leaves its edge), a miss moves
the upper end below it. That takes a number of lookups that grows with the
logarithm of the conversation's length. Batches are located first and inserted
then, from the node found; insertion splits the exit edge where digests part.

Every task builds such tries over its share of the conversations (however they
are dealt) and expands their edges to one row for each prefix with partial
counts, so a first turn that a third of all conversations share is one row of
each task, not a group; Spark adds the rows of equal prefixes. A trie is expanded
and begun anew after ``TRIE_TURNS`` turns, so memory is bounded.

Sums over subtrees need no rounds: what members' turns hold adds up over the
members; what is counted once for a node is counted for its smallest member,
which also owns all deeper nodes of its path.

Defined cases: rows with a null conv_id take no part; null roles and texts are
empty; null turns come first; turns of equal number go by role, then by digest;
repeated rows are turns of their own; a conversation whose turns are all taken
by a shorter head may be turnless and ends at the root; conv_id % 20 has the
sign of conv_id; an empty table has no nodes, not even a root; further columns
are passed over. One row holds a conversation (24 bytes a turn, no texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import cut, map_arrow, shuffle_partitions, text_slices
from touchline.llm.textops import joined, word_spans

GROUP = 20              # conversations of a group share the head of its first
HEADS = 4               # the head's turns: crc32(conv_id) % HEADS
TRIE_TURNS = 400_000    # turns a task's trie takes before it is expanded
ID_BLOCK = 4096         # ids of one node that are listed together
WIDTH = 16              # bytes of a digest


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=WIDTH).digest()


def two_fattest(low: int, high: int) -> int:
    """The number of (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class Node:
    """A compacted node: its edge covers the depths (top, extent] of ``path``; n, least and words are of conversations that end here."""

    __slots__ = ("parent", "top", "extent", "path", "upto", "children", "n", "least", "words")

    def __init__(self, parent, top: int, extent: int, path: list[bytes], upto: list[int]):
        self.parent, self.top, self.extent, self.path, self.upto = parent, top, extent, path, upto
        self.children, self.n, self.least, self.words = {}, 0, None, 0


class ZFastTrie:
    """Conversations as (path: prefix digests by depth; upto: words of the prefixes, from depth 0; id)."""

    def __init__(self):
        self.root = Node(None, 0, 0, [], [0])
        self.handles: dict[bytes, Node] = {}
        self.turns = 0

    def _handle(self, node: Node) -> bytes:
        return node.path[two_fattest(node.top, node.extent) - 1]

    def locate(self, path: list[bytes], node: Node | None = None) -> tuple[Node, Node | None]:
        """The deepest node at or below ``node`` whose extent is a prefix of ``path``, and the exit node on the edge below it, if any."""
        node = node or self.root
        low, high = node.extent, len(path)
        while low < high:
            depth = two_fattest(low, high)
            hit = self.handles.get(path[depth - 1])
            if hit is None:
                high = depth - 1
            elif hit.extent <= len(path) and hit.path[hit.extent - 1] == path[hit.extent - 1]:
                node, low = hit, hit.extent
            else:
                return hit.parent, hit          # the search may have jumped over the parent
        return node, node.children.get(path[node.extent]) if len(path) > node.extent else None

    def _add(self, parent: Node, extent: int, path: list[bytes], upto: list[int]) -> Node:
        node = Node(parent, parent.extent, extent, path, upto)
        parent.children[path[parent.extent]] = node
        self.handles[self._handle(node)] = node
        return node

    def _split(self, exit_node: Node, path: list[bytes]) -> Node:
        """A new node where ``path`` leaves the edge of ``exit_node``."""
        low, high = exit_node.top + 1, min(exit_node.extent, len(path))      # equal at low; prefixes agree up to one depth
        while low < high:
            middle = (low + high + 1) // 2
            if exit_node.path[middle - 1] == path[middle - 1]:
                low = middle
            else:
                high = middle - 1
        del self.handles[self._handle(exit_node)]
        node = self._add(exit_node.parent, low, exit_node.path, exit_node.upto)
        exit_node.parent, exit_node.top = node, low
        node.children[exit_node.path[low]] = exit_node
        self.handles[self._handle(exit_node)] = exit_node
        return node

    def insert(self, batch: list[tuple[list[bytes], list[int], int]]) -> None:
        """Locates the whole batch, then inserts what leaves by the same node one after the other."""
        found = [self.locate(path)[0] for path, _, _ in batch]
        for i in sorted(range(len(batch)), key=lambda i: id(found[i])):
            path, upto, name = batch[i]
            node, exit_node = self.locate(path, found[i])
            if exit_node is not None:
                node = self._split(exit_node, path)
            if node.extent < len(path):
                node = self._add(node, len(path), path, upto)
            node.n += 1
            node.least = name if node.least is None else min(node.least, name)
            node.words += upto[-1]
            self.turns += len(path)

    def expanded(self) -> Iterator[tuple[int, bytes, bytes | None, int, int, int, int]]:
        """One row for each prefix: depth, digest, parent's digest, words of the last turn, members, smallest member, words
        of the members' turns from this depth on."""
        order = [self.root]
        for node in order:
            order.extend(node.children.values())
        for node in reversed(order):
            for depth in range(node.extent, node.top, -1):
                before = node.upto[depth - 1]
                yield (depth, node.path[depth - 1], node.path[depth - 2] if depth > 1 else b"", node.upto[depth] - before,
                       node.n, node.least, node.words - node.n * before)
            if node.parent is not None:
                node.parent.n += node.n
                node.parent.words += node.words
                node.parent.least = node.least if node.parent.least is None else min(node.parent.least, node.least)
        if self.root.n:
            yield 0, b"", None, 0, self.root.n, self.root.least, self.root.words


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, words of every row."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def counted(batch: pa.RecordBatch):
        roles, texts = (batch.column(n).cast(pa.binary()).to_pylist() for n in ("role", "text"))
        words = np.zeros(len(texts), np.int64)
        for part in text_slices(texts):
            buf, starts = joined(texts[part])
            words[part] = np.diff(np.searchsorted(word_spans(buf)[0], starts))
        names = [digest(len(r).to_bytes(8, "little"), r, t) for r, t in zip(roles, texts)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(names, pa.binary()), pa.array(words)],
                                         ["conv_id", "turn", "role", "digest", "words"])

    return map_arrow(rows, counted, "conv_id long, turn long, role string, digest binary, words long")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """conv_id, path (prefix digests, joined), upto (words of the prefixes from depth 0): conversations with their group's head."""
    own = (turns(conversations).groupBy("conv_id")
           .agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "digest", "words"))).alias("_own")))
    own = cut(own.select("conv_id", F.transform("_own", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("_own")))
    first = (own.where(F.col("conv_id") % group == 0)
             .select(F.col("conv_id").alias("_first"), F.slice("_own", 1, heads - 1).alias("_head")))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    both = own.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).join(first, "_first", "left").withColumn("_h", h)
    own_rest = F.slice("_own", F.col("_h") + 1, F.size("_own"))
    head = F.when(F.col("_head").isNull() | (F.col("_h") == 0), F.slice("_own", 1, 0)).otherwise(F.slice("_head", F.lit(1), F.greatest("_h", F.lit(1))))
    rows = both.select("conv_id", F.concat(head, own_rest).alias("turns"))
    rows = rows.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))

    def chained(batch: pa.RecordBatch):
        paths, upto = [], []
        for digests, words in zip(batch.column("digests").to_pylist(), batch.column("words").to_pylist()):
            path, last = [], b""
            for d in digests:
                last = digest(last, d)
                path.append(last)
            paths.append(b"".join(path))
            upto.append([0, *np.cumsum(words, dtype=np.int64).tolist()])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(paths, pa.binary()), pa.array(upto, pa.list_(pa.int64()))], ["conv_id", "path", "upto"])

    return cut(map_arrow(rows, chained, "conv_id long, path binary, upto array<long>"))


NODES = "depth long, prefix binary, parent binary, words long, n_convs long, conv_id long, held long"


def nodes(paths: DataFrame) -> DataFrame:
    """One row for each prefix: depth, prefix (digest), parent, words, n_convs, conv_id (smallest member), held (words from this depth on)."""
    def tries(batches):
        trie = ZFastTrie()
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

        def rows():
            out = [[] for _ in kinds]
            for row in trie.expanded():
                for column, value in zip(out, row):
                    column.append(value)
                if len(out[0]) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out = [[] for _ in kinds]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

        names = ["depth", "prefix", "parent", "words", "n_convs", "conv_id", "held"]
        for batch in batches:
            trie.insert([([p[i:i + WIDTH] for i in range(0, len(p), WIDTH)], upto, name) for p, upto, name in
                         zip(batch.column("path").to_pylist(), batch.column("upto").to_pylist(), batch.column("conv_id").to_pylist())])
            if trie.turns > TRIE_TURNS:
                yield from rows()
                trie = ZFastTrie()
        yield from rows()

    return (paths.mapInArrow(tries, NODES).groupBy("depth", "prefix")
            .agg(F.first("parent").alias("parent"), F.first("words").alias("words"), F.sum("n_convs").alias("n_convs"),
                 F.min("conv_id").alias("conv_id"), F.sum("held").alias("held")))


def prefix_at(depth: Column) -> Column:
    """The digest of a path's prefix."""
    return F.when(depth == 0, F.lit(b"")).otherwise(F.substring(F.col("path"), ((depth - 1) * WIDTH + 1).cast("int"), F.lit(WIDTH)))


def end_hashes(paths: DataFrame) -> DataFrame:
    """depth, prefix, ends_sha256 of prefixes at which conversations end.

    Ids are listed in blocks of ``ID_BLOCK`` possible ids; a node's blocks then
    stream in order through one hash, so what a task holds does not grow with them.
    """
    depth = (F.size("upto") - 1).cast("long")
    block = F.col("conv_id") - F.pmod("conv_id", F.lit(ID_BLOCK))
    lists = (paths.select(depth.alias("depth"), prefix_at(depth).alias("prefix"), block.alias("block"), "conv_id")
             .groupBy("depth", "prefix", "block").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
             .select("depth", "prefix", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")))

    def hashed(batches):
        last, state = None, None
        for batch in batches:
            done = []
            for at, name, ids in zip(batch.column("depth").to_pylist(), batch.column("prefix").to_pylist(), batch.column("ids").to_pylist()):
                if last == (at, name):
                    state.update(b"," + ids.encode())
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = (at, name), hashlib.sha256(ids.encode())
            yield out(done)
        if last is not None:
            yield out([(*last, state.hexdigest())])

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.string()))],
                                          ["depth", "prefix", "ends_sha256"])

    ordered = lists.repartition(shuffle_partitions(paths), "depth", "prefix").sortWithinPartitions("depth", "prefix", "block")
    return ordered.mapInArrow(hashed, "depth long, prefix binary, ends_sha256 string")


def trie_nodes(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Every node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = rebuilt(conversations, group, heads)
    key = ["depth", "prefix"]
    bare = cut(nodes(paths))
    below = bare.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("prefix")).agg(F.count("*").alias("n_children"))
    known = cut(bare.join(below, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # a conversation owns the nodes of its path from some depth on; the last of them is a leaf or not
    owners = known.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max_by(F.col("n_children") == 0, "depth").cast("long").alias("leaf"))
    steps = paths.join(owners, "conv_id").select("path", "upto", "top", "leaf", F.posexplode("upto").alias("depth", "_"))
    counted = F.greatest("depth", "top").cast("int")
    once = F.element_at("upto", -1) - F.when(counted == 0, F.lit(0)).otherwise(F.element_at("upto", F.greatest(counted, F.lit(1))))
    own = (steps.select(F.col("depth").cast("long").alias("depth"), prefix_at(F.col("depth")).alias("prefix"), once.alias("once"), "leaf")
           .groupBy(*key).agg(F.sum("once").alias("once"), F.sum("leaf").alias("n_leaves")))

    # the root's members are all conversations; other parents are found by their prefix
    parents = known.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("_above"))
    root = known.where("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("prefix").alias("parent"), F.col("conv_id").alias("_root"))
    # one row, the root
    found = known.join(parents, ["depth", "parent"], "left").join(F.broadcast(root), ["depth", "parent"], "left")
    return (found.join(own, key, "left").join(end_hashes(paths), key, "left")
            .select("conv_id", "depth", F.coalesce("_above", "_root").alias("parent_conv_id"), "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(0).cast("long")).alias("n_leaves"),
                    (F.col("held") - F.coalesce("once", F.lit(0).cast("long"))).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


ORACLE = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
sequences as (
  select conv_id, list(struct_pack(role := role, text := text) order by place) as own from turns group by conv_id),
heads as (
  select conv_id, own,
    (xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint), lambda crc, byte:
       list_reduce(list_prepend(xor(crc, byte), [1::bigint, 2, 3, 4, 5, 6, 7, 8]), lambda x, step:
         case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end), 4294967295::bigint), 4294967295::bigint) % 4) as h
  from sequences),
rebuilt as (
  select a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) as turns
  from heads a left join sequences b on b.conv_id = a.conv_id - a.conv_id % 20),
prefixes as (
  select conv_id, turns[1:d] as prefix, d as depth, len(turns) = d as ends
  from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from rebuilt)),
nodes as (
  select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '') as ends
  from prefixes group by prefix, depth),
children as (select prefix[1:depth - 1] as prefix, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all),
valued as (
  select n.*, coalesce(c.n, 0) as n_children,
    case when n.depth = 0 then 0 else (n.n_convs - 1) * len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) end as saved
  from nodes n left join children c on c.prefix = n.prefix and c.depth = n.depth),
above as (select v.*, unnest(range(v.depth + 1)) as up from valued v),
sums as (
  select prefix[1:up] as prefix, up as depth, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves
  from above group by all)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
  s.saved_tokens::bigint as saved_tokens, sha256(v.ends) as ends_sha256
from valued v join sums s on s.prefix = v.prefix and s.depth = v.depth
left join nodes p on p.depth = v.depth - 1 and p.prefix = v.prefix[1:v.depth - 1]
"""
