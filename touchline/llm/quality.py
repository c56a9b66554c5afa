"""Quality classifier: histogram gradient-boosted trees over document statistics.

``statistics`` turns a whole text into a fixed row of numbers; ``fit`` grows
boosted trees on binned columns (gradient and Hessian histograms, best gain
split, Newton leaf values of the logistic loss); the trees are flattened into
five arrays, and ``Model.score`` walks all rows through all trees at once in
numpy. Scoring runs as one ``mapInArrow`` over the documents: no shuffle, and
the model (a few kilobytes) travels in the task.

Learning uses at most ``MAX_TRAIN`` labelled documents, those with the
smallest hash of their id; scores, and everything else, cover all documents.

Defined cases: null text counts as empty; empty texts get the score of a row
of zeros; null or missing labels teach nothing; a document labelled more than
once counts once, with the rounded mean; with no labels, or only one class,
every score is the smoothed share of ones. Ids may repeat or be null (each row
is scored for itself). Further columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import binary_texts, map_arrow, text_slices
from touchline.llm.textops import LOWER, joined, mix, word_hashes, word_spans

MAX_TRAIN = 20_000
THRESHOLD = 0.7
TREES, LEAVES, RATE, BINS, MIN_LEAF, L2 = 60, 12, 0.15, 64, 10, 1.0

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it was with as on be by at this are or an from not have has "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de et en un une du que qui dans pour pas sur plus par au ce il elle "
    "el los las y del se por con una su para lo como más o pero sus".split())

# Byte classes whose shares are statistics; each byte is in one class, the rest in the last.
_CLASSES = (b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".?", b",;:", b"!",
            b"|", b"\"'()-/", b"#$%&*@^~<>{}[]\\=+_", b"\n", bytes(range(128, 256)))
N_CLASSES = len(_CLASSES) + 1
_CLASS_OF = np.full(256, N_CLASSES - 1, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _i
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*!|")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?\"')")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
N_STATS = N_CLASSES + 12


def _word_set(words) -> np.ndarray:
    buf, starts = joined([w.encode() for w in words])
    return np.unique(word_hashes(buf, starts[:-1], starts[1:] - 1))


_FUNCTION = _word_set(sorted(FUNCTION_WORDS))


def _repeats(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per owner: number of distinct values, and how often the most frequent occurs."""
    shift = np.uint64(max(1, int(n).bit_length()))
    keys = np.sort((owner.astype(np.uint64) << (np.uint64(64) - shift)) | (values >> shift))
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    owners = (keys[new] >> (np.uint64(64) - shift)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, owners, np.diff(np.append(new, len(keys))))
    return np.bincount(owners, minlength=n), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of statistics for each text; the empty text gives zeros."""
    out = np.zeros((len(texts), N_STATS))
    for part in text_slices(texts):
        out[part] = _statistics(texts[part])
    return out


def _statistics(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    buf, starts = joined(texts)
    sizes = np.diff(starts) - 1
    of_byte = np.repeat(np.arange(n), sizes + 1)
    kinds = np.bincount(of_byte * N_CLASSES + _CLASS_OF[buf], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    kinds[:, _CLASS_OF[10]] -= 1                     # the line feed that joined() adds
    size = np.maximum(sizes, 1)
    begin, end = word_spans(buf)
    owner = of_byte[begin]
    n_words = np.bincount(owner, minlength=n)
    words = np.maximum(n_words, 1)
    lower = LOWER[buf]
    bare = end - (_PUNCT[buf[end - 1]] & (end - begin > 1))
    hashes = word_hashes(lower, begin, bare)
    distinct, most = _repeats(owner, hashes, n)
    same = owner[1:] == owner[:-1]
    pairs, _ = _repeats(owner[1:][same], mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same], n)
    known = np.bincount(owner, np.isin(hashes, _FUNCTION), n)
    marked = np.bincount(owner, _MARK[buf[end - 1]], n)
    # lines with a word on them: from the first word after a line feed to the line's last word
    breaks = np.cumsum(buf == 10)
    first = np.concatenate(([True], breaks[begin[1:]] != breaks[begin[:-1]])) if len(begin) else np.zeros(0, bool)
    head = np.flatnonzero(first)
    tail = np.append(head[1:], len(begin))[:len(head)] - 1
    lines = np.bincount(owner[head], minlength=n)
    line_kinds, _ = _repeats(owner[head], word_hashes(buf, begin[head], end[tail]), n)
    ended = np.bincount(owner[head], _STOP[buf[end[tail] - 1]], n)
    per_line = np.maximum(lines, 1)
    length = np.bincount(owner, end - begin, n)
    stats = np.column_stack([
        kinds / size[:, None], np.log1p(sizes), np.log1p(n_words), length / words, distinct / words, most / words,
        pairs / words, known / words, 1 - line_kinds / per_line, sizes / per_line, ended / per_line, marked / words, lines / words])
    stats[sizes == 0] = 0
    return stats


@dataclass
class Model:
    """Trees as flat arrays: node i tests ``x[feature[i]] <= cut[i]``, or is a leaf (feature -1) of ``value[i]``."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x))[:, None], np.full(len(x), self.base)
        if len(self.roots) and len(x):
            at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
            while (inner := self.feature[at] >= 0).any():
                goes = x[rows, np.maximum(self.feature[at], 0)] <= self.cut[at]
                at = np.where(inner, np.where(goes, self.left[at], self.right[at]), at)
            total = total + self.value[at].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, leaves: int = LEAVES) -> Model:
    """Boosted trees for labels 0 / 1; a constant model when only one class is seen."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        place = binned + np.arange(x.shape[1]) * BINS
        total = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            _grow(place, binned, p - y, p * (1 - p), edges, leaves, nodes, roots, total)
    arr = np.array(nodes, dtype=float).reshape(-1, 5)
    whole = lambda k: arr[:, k].astype(np.int64)
    return Model(base, np.array(roots, dtype=np.int64), whole(0), arr[:, 1], whole(2), whole(3), arr[:, 4])


def _grow(place, binned, g, h, edges, leaves, nodes, roots, total) -> None:
    """One tree, best leaf first; adds its nodes and updates the totals."""
    width = binned.shape[1]

    def leaf(rows):
        nodes.append([-1, 0, 0, 0, -RATE * g[rows].sum() / (h[rows].sum() + L2)])
        flat = place[rows].ravel()
        hist = [np.bincount(flat, np.repeat(v[rows], width) if v is not None else None, width * BINS).reshape(width, BINS)
                for v in (g, h, None)]
        lg, lh, ln = (np.cumsum(a, axis=1) for a in hist)
        gain = lg**2 / (lh + L2) + (lg[:, -1:] - lg) ** 2 / (lh[:, -1:] - lh + L2) - lg[:, -1:] ** 2 / (lh[:, -1:] + L2)
        gain[(ln < MIN_LEAF) | (ln[:, -1:] - ln < MIN_LEAF)] = -1
        best = int(np.argmax(gain))
        return float(gain.flat[best]), len(nodes) - 1, rows, best // BINS, best % BINS

    roots.append(len(nodes))
    open_leaves = [leaf(np.arange(len(g)))]
    while len(open_leaves) < leaves:
        top = max(range(len(open_leaves)), key=lambda i: open_leaves[i][0])
        gain, node, rows, j, b = open_leaves[top]
        if gain <= 1e-6 or b >= len(edges[j]):
            break
        goes = binned[rows, j] <= b
        open_leaves.pop(top)
        lo, hi = leaf(rows[goes]), leaf(rows[~goes])
        nodes[node] = [j, edges[j][b], lo[1], hi[1], 0.0]
        open_leaves += [lo, hi]
    for _, node, rows, _, _ in open_leaves:
        total[rows] += nodes[node][4]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id's text leaves remainder 2 modulo 4 are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """Fit on the labelled documents that are not held out, ``max_train`` at most."""
    sample = (labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
              .groupBy("_id").agg(F.round(F.avg("_y")).alias("_y"))
              .where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(max_train))
    # at most max_train rows of two numbers: broadcast is bounded by the parameter
    found = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(sample), "_id")
    # of rows that repeat an id the one with the least hash of its text counts; it goes by the hash, so map tasks send one narrow row for each id
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    chosen = found.select("_id", text_hash.alias("_hash")).groupBy("_id").agg(F.min("_hash").alias("_hash"))
    rows = (found.withColumn("_hash", text_hash).join(F.broadcast(chosen), ["_id", "_hash"])
            .groupBy("_id", "_y").agg(F.first("text", ignorenulls=True).alias("text")))

    def stats(batch):
        x = statistics(binary_texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    got = sorted(map_arrow(rows, stats, "_id long, _y double, x array<double>").toLocalIterator(), key=lambda r: (r[0], r[2]))
    return fit(np.array([r[2] for r in got]).reshape(-1, N_STATS), np.array([r[1] for r in got], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    def run(batch):
        x = statistics(binary_texts(batch))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``."""
    def run(batch):
        x = statistics(binary_texts(batch))
        yield batch.filter(pa.array(model.score(x) >= threshold))

    return map_arrow(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on) for every document."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
