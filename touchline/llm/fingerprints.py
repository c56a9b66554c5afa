"""Document fingerprints: MinHash signatures over five-word shingles.

``signatures`` applies ``PERMUTATIONS`` universal hash functions
(multiply-add-shift modulo 2**64) to all shingles of a batch of texts and
takes each text's minima; a fingerprint is the signature as hexadecimal text,
and the likeness of two fingerprints is the share of equal slots, an estimate
of the Jaccard similarity of their shingle sets.

* ``fingerprint_neighbours``: each document against its edited text and the
  next document. Documents are range-partitioned and sorted by id once and
  streamed; only the first and last row of each partition meet in a second,
  small join.
* Near duplicates: documents with equal shingle sets form one class. Signature
  bands are joined in Spark: classes that share a band lie in one candidate
  component (each member of a band is tied to the band's smallest class, so a band of g
  classes gives g - 1 ties, not g squared). The ties only gather candidates: within a component all pairs of classes
  are compared, by the exact tree join of ``jaccard_tree`` on whole shingle sets, in blocks of bounded size.
  So every pair that shares a band, and any other pair of its component, is verified. Only a link
  whose ends no chain of shared bands connects is not seen: two sets of similarity s share no band
  with a chance of (1 - s**ROWS)**BANDS, 0.3 % at 0.75.
  ``fingerprints`` gives the neighbours' rows with ``near_id``, the smallest document that verified links
  connect; there, pairs connected already need no further link. ``near_duplicates`` gives all links.

Defined cases: null text counts as empty; texts without words have the
fingerprint ``EMPTY``, alike only to itself, and are near to no other; rows are ordered by (doc_id, text),
null ids first, so repeated rows follow each other; after the last row comes the
first; a single row is its own next; further columns are passed over.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.joins import bounded_broadcast
from touchline.llm.common import binary_texts, cut, map_arrow, shuffle_partitions, text_slices, whole_text
from touchline.llm.components import components
from touchline.llm.jaccard_tree import DEN, MAX_BROADCAST, NUM, blocks_of, digest, linked
from touchline.llm.textops import distinct_sets, mix, shingle_hashes

PERMUTATIONS = 64
BANDS, ROWS = 16, 4
THRESHOLD = NUM / DEN
EMPTY = ""
_RNG = np.random.default_rng(7919)
_A = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x PERMUTATIONS) 16-bit minima, and which texts have any shingle."""
    out, filled = np.zeros((len(texts), PERMUTATIONS), np.uint16), np.zeros(len(texts), bool)
    for part in text_slices(texts, 1 << 19):
        flat, offsets = shingle_hashes(texts[part])
        has = np.flatnonzero(np.diff(offsets)) + part.start
        filled[has] = True
        if len(has):
            starts = offsets[has - part.start]
            for j in range(PERMUTATIONS):
                # the upper half is the hash value; the minimum's lower 16 bits name it
                low = np.minimum.reduceat((flat * _A[j] + _B[j]) >> np.uint64(32), starts)
                out[has, j] = low.astype(np.uint16)
    return out, filled


def as_bytes(signature: np.ndarray, filled: np.ndarray) -> list[bytes]:
    return [s.astype(">u2").tobytes() if f else EMPTY.encode() for s, f in zip(signature, filled)]


def class_names(texts: list[bytes]) -> tuple[list[int], list[int]]:
    """Name of each text's shingle set (0: no shingles), and its size."""
    names, sizes = [], []
    for part in text_slices(texts):
        for x in distinct_sets(texts[part]):
            names.append(digest(x))
            sizes.append(len(x))
    return names, sizes


def likeness(a, fa, b, fb) -> np.ndarray:
    """Share of equal slots; 1 for two texts without shingles, 0 if only one has none."""
    return np.where(fa & fb, (a == b).mean(axis=1), (~fa & ~fb).astype(float))


_OUT = ("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
        "near_edited double, near_next double, class_id long, n_shingles long, text_hash long")
_NAMES = [c.split()[0] for c in _OUT.split(", ")]


def _finish(ids: list, texts: list[str], hashes: list[int], nexts: list[str]) -> list[list]:
    """Output columns for texts whose next texts are known."""
    edited = []
    for t, n in zip(texts, nexts):
        k = len(t) // 4
        edited.append(t[:len(t) - k] + n[:k])
    raw = [t.encode() for t in texts]
    edited_raw = [t.encode() for t in edited]
    s, f = signatures(raw)
    es, ef = signatures(edited_raw)
    ns, nf = np.roll(s, -1, axis=0), np.roll(f, -1)
    # rows are consecutive: each row's next is the row below, the last row's is given
    ls, lf = signatures([nexts[-1].encode()])
    ns[-1], nf[-1] = ls[0], lf[0]
    return [ids, [len(t) for t in texts], [hashlib.sha256(t).digest() for t in edited_raw], as_bytes(s, f), as_bytes(es, ef),
            likeness(s, f, es, ef).tolist(), likeness(s, f, ns, nf).tolist(), *class_names(raw), hashes]


def _neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: the columns of ``_OUT`` (checkpointed)."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    parts = partitions or shuffle_partitions(docs)
    ordered = (rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
               .withColumn("part", F.spark_partition_id()).withColumn("text_hash", F.xxhash64("text")))
    types = _OUT + ", part int, kind string, text string"
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in types.split(", "))])

    def edge(part, kind, doc_id, text, text_hash):
        given = {"doc_id": [doc_id], "part": [part], "kind": [kind], "text": [text], "text_hash": [text_hash]}
        return pa.RecordBatch.from_pydict({n: given.get(n, [None]) for n in schema.names}, schema=schema)

    def stream(batches):
        held = None
        part = 0
        for batch in batches:
            all_ids, all_texts, all_hashes = (batch.column(c).to_pylist() for c in ("doc_id", "text", "text_hash"))
            for piece in text_slices(all_texts, 1 << 21):
                ids, texts, hashes = all_ids[piece], all_texts[piece], all_hashes[piece]
                if held is None:
                    part = batch.column("part")[0].as_py()
                    yield edge(part, "head", ids[0], texts[0], hashes[0])
                else:
                    ids, texts, hashes = [held[0], *ids], [held[1], *texts], [held[2], *hashes]
                if len(ids) > 1:
                    done = _finish(ids[:-1], texts[:-1], hashes[:-1], texts[1:])
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*done, [part] * n, ["row"] * n, [None] * n], schema.types)], schema=schema)
                held = ids[-1], texts[-1], hashes[-1]
        if held is not None:
            yield edge(part, "tail", *held)

    stored = cut(ordered.mapInArrow(stream, types))
    heads = stored.where("kind = 'head'").select("part", F.col("text").alias("next_text"))
    # one integer for each partition: which partition follows (the first after the last)
    order = sorted(r[0] for r in heads.select("part").collect())
    follows = docs.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1])) or [(0, 0)], "part int, next_part int")
    tails = (stored.where("kind = 'tail'").select("doc_id", "text", "text_hash", "part").join(follows, "part")
             .join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "text", "text_hash", "next_text"))

    def last(batches):
        for batch in batches:
            for i, t, h, n in zip(*(c.to_pylist() for c in batch.columns)):
                done = _finish([i], [t], [h], [n])
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(done, schema.types)], names=_NAMES)

    return stored.where("kind = 'row'").select(*_NAMES).unionByName(cut(tails.mapInArrow(last, _OUT)))


def _shown(rows: DataFrame, *further: str) -> DataFrame:
    names = lambda c: F.lower(F.hex(c)).alias(c)
    return rows.select("doc_id", "n_chars", names("edited_sha256"), names("fingerprint"), names("edited_fingerprint"), "near_edited", "near_next", *further)


def fingerprint_neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """See the module's docstring; one row for each row of ``docs``."""
    return _shown(_neighbours(docs, partitions))


def _classes(rows: DataFrame) -> DataFrame:
    """class_id, head_id (smallest document), text_hash (of one of its texts), n (shingles), rows of every class."""
    return cut(rows.where("class_id <> 0").groupBy("class_id")
               .agg(F.min("doc_id").alias("head_id"), F.min("text_hash").alias("text_hash"), F.max("n_shingles").alias("n"), F.count("*").alias("rows")))


def _candidates(rows: DataFrame) -> DataFrame:
    """(id, component): classes joined through the bands of their signatures."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def bands(batch):
        ids, first = np.unique(np.array(batch.column("class_id")), return_index=True)
        prints = batch.column("fingerprint").take(pa.array(first)).to_pylist()
        signature = np.frombuffer(b"".join(prints), ">u2").astype(np.uint16).reshape(-1, PERMUTATIONS)
        keys = mix(signature.view(np.uint64).reshape(-1, BANDS) ^ salt)      # a band's four minima, told apart by the band
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(keys.ravel().view(np.int64))], names=["id", "key"])

    keyed = map_arrow(rows.where("class_id <> 0").select("class_id", "fingerprint"), bands, "id long, key long")
    hubs = cut(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub <> _last").drop("_last"))
    return components(keyed.join(bounded_broadcast(hubs, MAX_BROADCAST), "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")))


def _links(docs: DataFrame, rows: DataFrame, classes: DataFrame, spanning: bool) -> DataFrame:
    """(a, b, shared): verified links between classes of one candidate component; with ``spanning``, enough of them to connect what links connect.

    rows: class_id, fingerprint, of the texts of ``docs``; classes: see ``_classes``."""
    wanted = cut(blocks_of(_candidates(rows)).join(classes.select("class_id", "text_hash", "n"), "class_id"))
    texts = docs.select("text", F.xxhash64(whole_text()).alias("text_hash")).join(bounded_broadcast(wanted, MAX_BROADCAST), "text_hash")

    def sets(batch):
        raw, ids = binary_texts(batch), batch.column("class_id").to_pylist()
        done = set()
        for part in text_slices(raw):
            found = distinct_sets(raw[part])
            keep = []
            for i, x in enumerate(found, part.start):
                if ids[i] not in done and digest(x) == ids[i]:
                    done.add(ids[i])
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("class_id", "n", "component", "last", "block")),
                                                  pa.array([found[i - part.start].astype("<u8").tobytes() for i in keep], pa.binary())],
                                                 names=["class_id", "n", "component", "last", "block", "tokens"])

    found = map_arrow(texts, sets, "class_id long, n long, component long, last int, block int, tokens binary")
    # one of a class's copies
    return linked(cut(found.groupBy("class_id", "n", "component", "last", "block").agg(F.first("tokens").alias("tokens"))), spanning)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of ``fingerprint_neighbours`` with ``near_id``: the smallest doc_id that verified links and
    equal shingle sets connect to the row, its own where there is none."""
    rows = _neighbours(docs)
    classes = _classes(rows)
    joined = components(_links(docs, rows, classes, True).select("a", "b")).withColumnRenamed("id", "class_id")
    named = classes.join(joined, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    heads = named.groupBy("component").agg(F.min("head_id").alias("near_id"), F.sum("rows").alias("_all")).where("_all > 1").drop("_all")
    near = cut(named.join(heads, "component").select("class_id", "near_id"))
    return _shown(rows.join(bounded_broadcast(near, MAX_BROADCAST), "class_id", "left").withColumn("near_id", F.coalesce("near_id", "doc_id")), "near_id")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, other_id, similarity): all links between classes of one candidate component, each class by its smallest document,
    with the exact Jaccard similarity of their shingle sets, ``threshold`` or more; and each further document of a class with its smallest (similarity 1).

    Rows with a null id or text, and documents without words, link to none."""
    if threshold < THRESHOLD:
        raise ValueError(f"links are verified from a similarity of {THRESHOLD} on")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")

    def mark(batch):
        raw = binary_texts(batch)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x, pa.int64()) for x in class_names(raw)), pa.array(as_bytes(*signatures(raw)), pa.binary())],
                                         names=["doc_id", "text_hash", "class_id", "n_shingles", "fingerprint"])

    rows = cut(map_arrow(docs.withColumn("text_hash", F.xxhash64("text")), mark, "doc_id long, text_hash long, class_id long, n_shingles long, fingerprint binary"))
    classes = _classes(rows)
    side = lambda x: classes.select(F.col("class_id").alias(x), F.col("head_id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"))
    links = (_links(docs, rows, classes, False).join(side("a"), "a").join(side("b"), "b")
             .select(F.greatest("a_id", "b_id").alias("doc_id"), F.least("a_id", "b_id").alias("other_id"), (F.col("shared") / (F.col("a_n") + F.col("b_n") - F.col("shared"))).alias("similarity")))
    copies = rows.join(classes.where("rows > 1"), "class_id").select("doc_id", F.col("head_id").alias("other_id"), F.lit(1.0).alias("similarity"))
    return links.union(copies).where(f"doc_id <> other_id and similarity >= {threshold}").distinct()
