"""Packing: documents' token ids into sequences of at most ``CAPACITY`` tokens.

Each document is tokenised once (a worker encodes each distinct word it meets once),
with id ``END`` appended, and stored in the shared checkpoint folder. Documents are dealt
by a hash to groups of about ``GROUP_TOKENS`` tokens; a group fits one task
whatever the corpus, and loses less than one sequence to padding.

Within a group: a document longer than a sequence first fills whole sequences;
what is left of each is placed in descending order of cost, into the open
sequence of lowest cost that still has room for it. The cost of n tokens is
``LINEAR * n + n**2 / CAPACITY``: the layers' linear work and the attention
within a document. When no sequence has room for a whole piece, the one with
most room takes as much as fits. There are as many sequences as the tokens
need, so all but their slack of less than ``CAPACITY`` is filled.

Defined cases: null and empty texts are documents of one token (``END``);
repeated rows and null ids are documents of their own; a text of any length is cut
into pieces; an empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import binary_texts, cut, map_arrow, text_slices
from touchline.llm.textops import LOWER, joined, word_hashes, word_spans

CAPACITY = 4096
END = 2
GROUP_TOKENS = 1 << 22
LINEAR = 6.0
TOKENIZER = "word_bpe_49k.json"
_WORDS_KEPT = 1_000_000
_WORDS_A_CALL = 8192       # bounds the tokenizer's own objects


# A run of these after an ASCII letter or digit is always a token sequence of its own.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*#%&$+=~^@/)]}")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True

# Words of these letters alone pass normalizer and pre-tokenizer as they are, so the model takes them directly.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def _byte_symbols() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Token ids of whole texts from one encoding of each distinct word.

    White space ends every token, the vocabulary is lower case, and marks that follow a letter or digit form tokens
    of their own; so a word's ASCII letters are lowered and trailing marks split off
    before the look-up. Known words are kept as flat sorted arrays, ``_WORDS_KEPT`` at most, then learnt anew.
    Slices with a ``<`` (special tokens are case-sensitive) are left as they are."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # one thread for each Spark core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.symbols = self.tokenizer.model, _byte_symbols()
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        return self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: plain ones by the model alone, the others by the whole tokenizer."""
        plain = [_LETTERS.fullmatch(w) is not None for w in words]
        others = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        tokenize, symbols = self.model.tokenize, self.symbols
        return [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(symbols))] if p else next(others).ids
                for w, p in zip(words, plain)]

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """``hashes`` come sorted."""
        sizes, flats = [], [self.flat]
        for at in range(0, len(words), _WORDS_A_CALL):
            ids = self._encoded(words[at:at + _WORDS_A_CALL])
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
        size = np.concatenate(sizes)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate(flats)
        hashes, begin, size = (np.concatenate(x) for x in ((self.hashes, hashes), (self.begin, begin), (self.size, size)))
        order = np.argsort(hashes, kind="stable")        # two sorted runs: a merge
        self.hashes, self.begin, self.size = hashes[order], begin[order], size[order]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        buf, starts = joined(texts)
        begin, end = word_spans(buf)
        if not (buf == ord("<")).any():
            buf = LOWER[buf]
            # the start of each word's tail: after the last byte that is no mark, if that is a letter or digit
            marks = np.flatnonzero(~_TAIL[buf])
            last = marks[np.searchsorted(marks, end) - 1] if len(marks) else end - 1
            split = (last >= begin) & (last < end - 1) & _PLAIN[buf[np.maximum(last, 0)]]
            tail = last[split] + 1
            end_ = end.copy()
            end_[split] = tail
            order = np.argsort(np.concatenate([begin, tail]), kind="stable")
            begin, end = np.concatenate([begin, tail])[order], np.concatenate([end_, end[split]])[order]
        hashes, first, which = np.unique(word_hashes(buf, begin, end), return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._known(hashes))
        if len(self.hashes) + len(new) > _WORDS_KEPT:
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            raw = buf.tobytes()
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())])
        at = np.searchsorted(self.hashes, hashes)[which] if len(hashes) else np.zeros(0, np.int64)
        counts = self.size[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[at] - (ends - counts), counts) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[np.searchsorted(begin, starts)]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_LOADED: dict[str, WordTokenizer] = {}


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n, ids (little-endian unsigned 32-bit, ``END`` last) of each document."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(batch):
        if path not in _LOADED:
            _LOADED[path] = WordTokenizer(path)
        texts, ids = binary_texts(batch), batch.column("doc_id")
        for part in text_slices(texts):
            got = [np.append(x, np.uint32(END)) for x in _LOADED[path].encode(texts[part])]
            yield pa.RecordBatch.from_arrays([ids.slice(part.start, len(got)), pa.array([len(x) for x in got], pa.int64()),
                                              pa.array([packed(x) for x in got], pa.binary())], names=["doc_id", "n", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, ids binary")


def packed(ids: np.ndarray) -> bytes:
    """Stored form: three bytes an id (vocabularies are smaller than 2**24)."""
    return np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def cost(n):
    return LINEAR * n + n * n / CAPACITY


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of one group."""
    pieces, rest = [], []
    sequences = 0
    for i, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(i, j * capacity, capacity, sequences + j, 0) for j in range(whole)]
        sequences += whole
        if n % capacity:
            rest.append((n % capacity, i, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_count = -(-sum(x[0] for x in rest) // capacity)
    room, costs = np.full(open_count, capacity, np.int64), np.zeros(open_count)
    for n, i, start in rest:
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits, costs, np.inf))) if fits.any() else int(np.argmax(room))
            take = min(n, int(room[at]))
            pieces.append((i, start, take, sequences + at, int(capacity - room[at])))
            room[at] -= take
            costs[at] += cost(take)
            n, start = n - take, start + take
    return pieces


def crc_of(ids: bytes) -> int:
    return zlib.crc32(unpacked(ids).tobytes())


def array_of(ids: bytes) -> np.ndarray:
    return unpacked(ids).astype(np.int32)


#: What becomes of a piece's ids: column, its SQL and Arrow types, and the function of their stored form.
STORED = ("ids", "binary", pa.binary(), lambda ids: ids)
DIGEST = ("ids_crc32", "long", pa.int64(), crc_of)
ARRAY = ("ids", "array<int>", pa.list_(pa.int32()), array_of)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, form: tuple = STORED) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (in ``form``), doc_tokens, sequence_id, offset."""
    stored = cut(tokenised(docs, path))
    total = stored.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    # the stored table's row number tells equal rows apart: a hot id or text is dealt out like any other
    dealt = stored.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    column, sql, kind, made = form

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.lexsort((np.array(table["n"]), np.array(table["doc_id"].fill_null(-1))))
        table = table.take(pa.array(order))
        lengths, all_ids = table["n"].to_pylist(), table["ids"].to_pylist()
        got = assign(lengths, capacity)
        d, start, length, seq, offset = (list(x) for x in zip(*got))
        ids = pa.array((made(all_ids[i][3 * s:3 * (s + n)]) for i, s, n in zip(d, start, length)), kind, size=len(d))
        return pa.table({"doc_id": table["doc_id"].take(pa.array(d)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), column: ids,
                         "doc_tokens": pa.array([lengths[i] for i in d], pa.int64()),
                         "sequence_id": pa.array([(key[0].as_py() << 24) + s for s in seq], pa.int64()), "offset": pa.array(offset, pa.int64())})

    return dealt.groupBy("group").applyInArrow(place, f"doc_id long, start long, length long, {column} {sql}, doc_tokens long, sequence_id long, offset long")


def pack_digest(docs: DataFrame) -> DataFrame:
    """``pack`` with the crc32 of each piece's ids in place of the ids."""
    return pack(docs, form=DIGEST)


def packed_sequences(docs: DataFrame) -> DataFrame:
    """``pack`` with the ids as an array of integers."""
    return pack(docs, form=ARRAY)
