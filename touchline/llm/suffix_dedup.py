"""Suffix-array dedup: removal of byte runs covered by a string of ``LENGTH`` bytes that starts anywhere else.

The suffix order is built column by column over many strings at once: each
round puts one more symbol in front of every string, and updates the
collection's Burrows-Wheeler order and common prefixes from the round before (a stable sort
by the new symbol; a new common prefix is one more than the least on the way between
two neighbours). Symbols are read, and order and common prefixes written, as sequential external
files of the task; a last sequential pass finds the strings with a neighbour of ``LENGTH`` common bytes.

A round for every byte of the longest text would never end on a large corpus, so the collection is cut first,
without losing a match: of the ``LENGTH - GRAM + 1`` grams in a window of ``LENGTH`` bytes the one with the least hash
(the leftmost of equal ones) is its anchor. Equal windows have equal anchors at the
same place, so all windows of one anchor are compared with each other only, column by column
from the anchor. Runs of windows with one anchor form a segment of at most ``2 * LENGTH - GRAM`` bytes, which bounds the rounds.

1. Each text's anchors go, as packed blocks, to the partition of their hash; those that occur
   at one place only are done.
2. The segments of the others are brought together by anchor partition and compared.
3. Repeated window starts return to their texts, and the covered bytes go.

Equal texts are one class: with two rows or more, and ``LENGTH`` bytes, all their windows repeat; one row
stands for the class in step 2. The tables that return to the texts are broadcast below
``BROADCAST_BYTES`` by measured size, else joined by a shuffle.

Defined cases: null text counts as empty; a text shorter than ``LENGTH`` bytes keeps all; matches never cross
documents; overlapping occurrences count, also within one text; repeated rows are copies; null ids are kept; an empty
table gives no rows; ``deduplicated`` passes further columns on.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import binary_texts, cut, give_back, map_arrow, pack_arrays, shuffle_partitions, text_slices, unpack_arrays, whole_text
from touchline.llm.textops import joined, mix, powers, prefix_sums

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM        # an anchor lies at most this far behind its window's start
PIECE = 1 << 18              # window starts handled at once in one text
SLICE = 1 << 23
BROADCAST_BYTES = 64 << 20
U = np.uint64
_PLACE = U((1 << 20) - 1)


def _minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes]):
    """Runs of windows with one anchor: text, first start, last start, anchor's place, anchor's hash."""
    out = []
    # shorter texts have no window; without them a long text always forms a slice of its own
    held = np.array([i for i, t in enumerate(texts) if len(t) >= LENGTH], np.int64)
    windowed = [texts[i] for i in held]
    for part in text_slices(windowed, PIECE):
        some = windowed[part]
        if len(some) == 1 and len(some[0]) > PIECE + LENGTH:
            for b in range(0, len(some[0]) - LENGTH + 1, PIECE):
                t, *places, h = _anchors([some[0][b:b + PIECE + LENGTH - 1]])
                out.append((held[t + part.start], *(x + b for x in places), h))
        else:
            t, *rest = _anchors(some)
            out.append((held[t + part.start], *rest))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]


def _anchors(texts: list[bytes]):
    buf, starts = joined(texts)
    n = len(buf)
    if n > int(_PLACE):
        raise ValueError("places of this many bytes do not fit beside the hashes")
    sizes = np.diff(starts) - 1
    if n < LENGTH or not (sizes >= LENGTH).any():
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    sums = prefix_sums(buf)
    hashes = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1][:n - GRAM + 1])
    least = _minima((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), REACH + 1)
    at = (least & _PLACE).astype(np.int64)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    owner = np.repeat(np.arange(len(texts)), windows)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
    at = at[begin]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(new[1:], len(owner)) - 1
    base = starts[owner[new]]
    return owner[new], begin[new] - base, begin[last] - base, at[new] - base, hashes[at[new]]


def repeated_starts(segments: list[bytes], before: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start) of each window that another one equals.

    ``before``: bytes ahead of the segment's anchor; ``windows``: how many windows start in the segment."""
    m, width = len(segments), REACH + LENGTH
    sizes = np.array([len(s) for s in segments], np.int64)
    first = REACH - before                            # the segment's first column
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as found:
        grid = np.full((width, m), 256, np.uint16)    # 256: no symbol here
        for a in range(0, m, 1024):                   # a few segments at a time: the places take eight times the symbols' memory
            z = sizes[a:a + 1024]
            owner = np.repeat(np.arange(len(z)), z)
            column = np.arange(len(owner)) - np.repeat(np.cumsum(z) - z, z) + first[a + owner]
            grid[column, a + owner] = np.frombuffer(b"".join(segments[a:a + 1024]), np.uint8)
        grid[::-1].tofile(symbols)                    # in the order of the rounds
        del grid
        symbols.seek(0)
        order, common = np.arange(m), np.zeros(m, np.int16)
        for c in range(width - 1, -1, -1):
            symbol = np.fromfile(symbols, np.uint16, m)[order]
            order, common = _insert(symbol, order, common)
            if c <= REACH:
                order.astype(np.int32).tofile(found)
                common.tofile(found)
        found.seek(0)
        out = []
        for c in range(REACH, -1, -1):
            order, common = np.fromfile(found, np.int32, m), np.fromfile(found, np.int16, m)
            same = common >= LENGTH
            same[:-1] |= same[1:]
            who = order[same]
            start = c - first[who]
            fits = (start >= 0) & (start < windows[who])
            out.append((who[fits], start[fits]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _insert(symbol: np.ndarray, order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: ``symbol`` precedes each string in the present order; ``common[i]`` is shared by strings i - 1 and i."""
    by = np.argsort(symbol, kind="stable")
    out = np.zeros(len(by), np.int16)
    if len(by) > 1:
        a, b = by[:-1], by[1:]
        same = np.flatnonzero((symbol[a] == symbol[b]) & (symbol[a] != 256))
        lo, hi = a[same] + 1, b[same]                 # least of common[lo..hi]
        least = common[hi].copy()
        near = lo == hi
        if not near.all():
            # doubling table of minima, as far as the longest way needs
            level = np.zeros(len(lo), np.int64)
            span = hi - lo + 1
            level[:] = np.floor(np.log2(span))
            table, k = common, 0
            while True:
                at = np.flatnonzero(level == k)
                if k and len(at):
                    least[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k) + 1])
                if k >= level.max():
                    break
                table = np.minimum(table[:-(1 << k)], table[1 << k:])
                k += 1
        out[same + 1] = np.minimum(least + 1, LENGTH)
    return order[by], out


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted starts to covered byte ranges [a, b), merged."""
    new = np.concatenate(([True], starts[1:] > starts[:-1] + LENGTH))
    edge = np.flatnonzero(new)
    return starts[edge], starts[np.append(edge[1:], len(starts)) - 1] + LENGTH


def _checked_broadcast(df: DataFrame, column: str) -> DataFrame:
    """Broadcast while the (checkpointed) table's measured size is below the bound."""
    size = df.agg(F.sum(F.octet_length(column) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _class(docs: DataFrame) -> DataFrame:
    return docs.withColumn("class_id", F.xxhash64("text", F.octet_length("text")))


def covered(docs: DataFrame, parts: int) -> DataFrame:
    """class_id, ranges (packed starts and ends of the covered bytes) of each text with a repeated window.
    docs: doc_id, text (no nulls), class_id."""
    def scatter(batch):
        texts, names = binary_texts(batch), np.array(batch.column("class_id"))
        for piece in text_slices(texts, SLICE):
            some, called = texts[piece], names[piece]
            called, first = np.unique(called, return_index=True)
            for x in range(0, len(called), 65_536):
                t, start, _, _, h = anchors([some[i] for i in first[x:x + 65_536]])
                part = (h % U(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    i = order[edges[p]:edges[p + 1]]
                    used, place = np.unique(t[i], return_inverse=True)
                    yield _row(("part", int(p)), pack_arrays(called[x + used], place.astype(np.uint16), start[i].astype(np.uint32), h[i]))

    def several(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = [unpack_arrays(x) for x in table["data"].to_pylist()]
        name, start, h = (np.concatenate(x) for x in zip(*((g[0][g[1]], g[2], g[3]) for g in got)))
        order = np.lexsort((start, name, h))
        name, start, h = name[order], start[order], h[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (name[1:] != name[:-1]) | (start[1:] != start[:-1])))
        name, start, h = name[once], start[once], h[once]
        same = np.concatenate(([False], h[1:] == h[:-1], [False]))
        keep = same[:-1] | same[1:]
        name, start = name[keep], start[keep]
        give_back()
        return _by_class("starts", name, start, lambda s: np.sort(s).astype("<u4").tobytes())

    blocks = map_arrow(docs.select("text", "class_id"), scatter, "part int, data binary").groupBy("part").applyInArrow(several, "class_id long, starts binary")

    def gather(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _by_class("starts", *_flat(table, "starts"), lambda s: np.sort(s).astype("<u4").tobytes())

    home = F.pmod("class_id", F.lit(parts)).alias("home")
    wanted = cut(blocks.select(home, "class_id", "starts").groupBy("home").applyInArrow(gather, "class_id long, starts binary"))
    # one row stands for each class
    heads = docs.groupBy("class_id").agg(F.min(F.coalesce("doc_id", F.lit(0))).alias("_head"))
    wanted = _checked_broadcast(cut(wanted.join(heads, "class_id")), "starts")
    texts = docs.withColumn("_head", F.coalesce("doc_id", F.lit(0))).join(wanted, ["class_id", "_head"]).select("text", "class_id", "starts")

    def segments(batch):
        texts, names, wanted = binary_texts(batch), np.array(batch.column("class_id")), batch.column("starts").to_pylist()
        for piece in text_slices(texts, 1 << 21):
            some, called = texts[piece], names[piece]
            t, start, last, at, h = anchors(some)
            ask = [np.frombuffer(x, "<u4") for x in wanted[piece]]
            asked = np.concatenate([(np.int64(i) << 40) | a.astype(np.int64) for i, a in enumerate(ask)])
            keep = np.isin((t << 40) | start, asked)
            t, start, last, at, h = (x[keep] for x in (t, start, last, at, h))
            part = (h % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                i = order[edges[p]:edges[p + 1]]
                cut_out = [some[x][a:b + LENGTH] for x, a, b in zip(t[i].tolist(), start[i].tolist(), last[i].tolist())]
                yield _row(("part", int(p)), pack_arrays(called[t[i]], start[i].astype(np.uint32), (at[i] - start[i]).astype(np.uint8), (last[i] - start[i] + 1).astype(np.uint8),
                                                         np.array([len(x) for x in cut_out], np.uint16), np.frombuffer(b"".join(cut_out), np.uint8)))

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, starts, before, windows, pieces = [], [], [], [], []
        for data in table["data"].to_pylist():
            n, s, b, w, size, raw = unpack_arrays(data)
            raw, ends = raw.tobytes(), np.cumsum(size, dtype=np.int64)
            pieces += [raw[e - z:e] for e, z in zip(ends.tolist(), size.tolist())]
            for to, x in ((names, n), (starts, s), (before, b), (windows, w)):
                to.append(x)
        name, start, before, windows = (np.concatenate(x) for x in (names, starts, before, windows))
        who, offset = repeated_starts(pieces, before.astype(np.int64), windows.astype(np.int64))
        give_back()
        return _by_class("starts", name[who], start[who].astype(np.int64) + offset, lambda s: _packed_ranges(*_ranges(np.unique(s))))

    found = map_arrow(texts, segments, "part int, data binary").groupBy("part").applyInArrow(compare, "class_id long, starts binary")

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, rows = [], []
        ids, data = np.array(table["class_id"]), table["starts"].to_pylist()
        order = np.argsort(ids, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], ids[order][1:] != ids[order][:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:]):
            pairs = np.concatenate([np.frombuffer(data[i], "<u4").reshape(-1, 2) for i in order[a:b]]).astype(np.int64)
            names.append(int(ids[order[a]]))
            rows.append(_packed_ranges(*_united(pairs[np.argsort(pairs[:, 0], kind="stable")])))
        return pa.table({"class_id": pa.array(names, pa.int64()), "ranges": pa.array(rows, pa.binary())})

    return cut(found.select(home, "class_id", "starts").groupBy("home").applyInArrow(merge, "class_id long, ranges binary"))


def _united(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges sorted by start, joined where they touch or overlap."""
    reach = np.maximum.accumulate(pairs[:, 1])
    edge = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return pairs[edge, 0], reach[np.append(edge[1:], len(pairs)) - 1]


def _packed_ranges(a: np.ndarray, b: np.ndarray) -> bytes:
    return np.stack([a, b], axis=1).astype("<u4").tobytes()


def _row(key: tuple[str, int], data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int32()), pa.array([data], pa.binary())], names=[key[0], "data"])


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    data = [np.frombuffer(x, "<u4") for x in table[column].to_pylist()]
    return np.repeat(np.array(table["class_id"]), [len(x) for x in data]), np.concatenate(data)


def _by_class(column: str, names: np.ndarray, values: np.ndarray, to_bytes) -> pa.Table:
    order = np.argsort(names, kind="stable")
    names, values = names[order], values[order]
    edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True]))) if len(names) else np.zeros(1, np.int64)
    return pa.table({"class_id": pa.array(names[edges[:-1]], pa.int64()), column: pa.array([to_bytes(values[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})


def _kept(text: bytes, ranges: bytes | None, copied: bool) -> tuple[bytes, int]:
    """The remaining bytes and the number of removed runs."""
    if copied and len(text) >= LENGTH:
        return b"", 1
    if ranges is None:
        return text, 0
    pairs = np.frombuffer(ranges, "<u4").reshape(-1, 2).tolist()
    at, out = 0, []
    for a, b in pairs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), len(pairs)


def _with_ranges(docs: DataFrame) -> DataFrame:
    """docs (text without nulls, class_id) with ``ranges`` and ``copied``."""
    slim = docs.select("doc_id", "text", "class_id")
    named = cut(slim.select("class_id", F.octet_length("text").alias("n")).groupBy("class_id").agg(F.count("*").alias("rows"), F.max("n").alias("n")))
    total = named.agg(F.sum("n")).first()[0] or 0
    parts = int(min(65_536, max(2 * shuffle_partitions(docs), -(-total // (8 << 20)))))
    found = covered(slim, parts)
    copied = named.where((F.col("rows") > 1) & (F.col("n") >= LENGTH)).select("class_id", F.lit(True).alias("copied"))
    side = cut(copied.join(found, "class_id", "full").select("class_id", F.coalesce("copied", F.lit(False)).alias("copied"), F.when(F.col("copied"), None).otherwise(F.col("ranges")).alias("ranges")))
    return docs.join(_checked_broadcast(side, "ranges"), "class_id", "left")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    rows = _with_ranges(_class(docs.select("doc_id", whole_text().alias("text"))))

    def run(batch):
        texts = binary_texts(batch)
        kept = [_kept(t, r, bool(c)) for t, r, c in zip(texts, batch.column("ranges").to_pylist(), batch.column("copied").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, (k, _) in zip(texts, kept)], pa.int64()),
                                          pa.array([s for _, s in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept])],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(rows.select("doc_id", "text", "ranges", "copied"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the remaining text of every row (bytes of a character cut apart go too)
    and, where there is such a column, ``n_chars`` counted anew."""
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), "doc_id", whole_text().alias("text"))
    rows = _with_ranges(_class(rows))

    def run(batch):
        texts = binary_texts(batch)
        kept = [_kept(t, r, bool(c))[0].decode("utf-8", "ignore") for t, r, c in zip(texts, batch.column("ranges").to_pylist(), batch.column("copied").to_pylist())]
        row = batch.column("_row")
        columns = dict(zip(names, row.flatten()))
        columns["text"] = pa.array(kept, pa.string())
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(k) for k in kept]).cast(columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return map_arrow(rows.select("_row", "text", "ranges", "copied"), run, docs.schema)
