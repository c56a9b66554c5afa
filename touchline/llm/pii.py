"""Personal data by weak supervision.

Candidates are the base spans (fixed patterns, see ``base_spans``) and spans of
wider patterns that no base span of their kind overlaps: national phone numbers,
numbers inside a run that the base patterns drop as a whole, spelled-out mail
addresses, 15-digit cards, long-form IPv6. Nine labelers vote on each candidate
(1 personal data of this kind, -1 not, 0 no opinion): the base patterns, format
and checksum, gazetteers of issuers, calling codes and domains, gazetteers of
placeholders, words before the span for and against, the span's edges, its
digits, and other kinds' spans across it. Spark counts the vote patterns of each kind over
all documents; expectation-maximisation estimates from the counts how often each
labeler votes which way on true and on false spans, and the probability that
each pattern stands for. These probabilities train the final classifier, a logistic
regression over votes, shape and neighbouring words, on at most ``MAX_TRAIN``
distinct candidates a kind, those of smallest hash. Candidates at 0.5 or more
are added; base spans always stay.

Every pattern runs in time linear in the text: runs are taken whole
(possessively), mail addresses are sought from their ``@``, wider patterns have
bounded length. What reaches the driver is bounded: at most 4 * 3^9 vote
patterns and 4 * ``MAX_TRAIN`` training rows.

Defined cases: null text counts as empty; every row has its result, also with
null or repeated ids and repeated rows; positions count code points, ends
are exclusive; no candidates, or of one sort only, leave the votes' prior; an
empty table gives no rows; further columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import cut, map_arrow

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 4000        # distinct candidates of a kind that the classifier learns from
BUCKETS = 1024          # of hashed features
BEFORE, AFTER = 40, 20  # code points of context

# The base patterns' character classes, and words and codes of the gazetteers.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_RUN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io co ai app dev me tv de fr es it nl be at ch uk ie pt pl cz se no fi dk "
                        "ru ua us ca mx br ar cl au nz jp cn kr in za eu".split())
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
                          "90 91 92 93 94 95 98".split())
CALLING_ZONES = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())      # of three-digit codes
ROLE_NAMES = frozenset("info noreply no-reply admin support sales contact webmaster postmaster help abuse newsletter".split())
TEST_CARDS = frozenset("4111111111111111 4242424242424242 5555555555554444 378282246310005".split())
CUES = {
    "email": frozenset("email e-mail mail mailto contact write courriel correo reach".split()),
    "ip": frozenset("ip address host server login from client connected adresse".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta pan payment".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone dial number whatsapp sms".split()),
}
AGAINST = frozenset("version ver v release isbn issn doi section chapter figure table page invoice order serial part ref id no build rfc pi sku".split())

_STRETCH = re.compile(r"[+(]?[0-9][0-9 ().+-]*+")
_WIDE_PHONE = re.compile(r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")
_WIDE_CARD = re.compile(r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])")
_WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_WIDE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}"
                        r"(?:(?: ?[\[(]dot[\])] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_SPELLED = re.compile(r"[\[(](?:at|dot)[\])]| dot ", re.I)
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_][\w-]*")

LABELERS = ("pattern", "format", "gazetteer", "placeholder", "words for", "words against", "edges", "digits", "overlap")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind: leftmost matches that do not overlap, those that fail their test dropped."""
    found = {kind: [] for kind in KINDS}
    if not _ANY.search(text):
        return found
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found["email"].append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(free, at + 1))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups())):
            found["ip"].append(m.span())
    for m in _RUN.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            found["phone"].append(m.span())
    return found


def _across(start: int, end: int, spans: list[tuple[int, int]]) -> bool:
    """Whether a span of the sorted, disjoint ``spans`` overlaps."""
    low, high = 0, len(spans)
    while low < high:
        middle = (low + high) // 2
        if spans[middle][1] <= start:
            low = middle + 1
        else:
            high = middle
    return low < len(spans) and spans[low][0] < end


def wide_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Spans of the wider patterns; those that a base span of their kind overlaps are left out."""
    def free(kind, start, end):
        if not _across(start, end, base[kind]):
            yield kind, start, end

    for stretch in _STRETCH.finditer(text):
        if stretch.end() - stretch.start() >= 10:
            for kind, pattern in (("phone", _WIDE_PHONE), ("card", _WIDE_CARD)):
                for m in pattern.finditer(stretch.group()):
                    yield from free(kind, m.start() + stretch.start(), m.end() + stretch.start())
    if text.count(":") >= 7:
        for m in _WIDE_IP.finditer(text):
            yield from free("ip", *m.span())
    if _SPELLED.search(text):
        for m in _WIDE_MAIL.finditer(text):
            if _SPELLED.search(m.group()):
                yield from free("email", *m.span())


def calling_code(digits: str) -> bool:
    return digits[:1] in CALLING_CODES or digits[:2] in CALLING_CODES or digits[:2] in CALLING_ZONES


def issued(digits: str) -> bool:
    """Whether a card number's beginning and length are an issuer's."""
    two, four, size = int(digits[:2]), int(digits[:4]), len(digits)
    return (digits[0] == "4" and size in (16, 19)) or (size == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or two in (60, 64, 65))) or \
        (size == 15 and two in (34, 37))


def votes(kind: str, span: str, before: str, after: str, is_base: bool, crossed: bool) -> tuple[int, ...]:
    """The labelers' votes, in the order of ``LABELERS``."""
    d = digits_of(span)
    words = [w.lower() for w in _WORD.findall(before)]
    if kind == "email":
        local, _, domain = span.partition("@")
        local = local if domain else re.split(r"[ (\[]", span)[0]
        top = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]"))[-1].lower()
        form, listed = (1 if top.isalpha() and len(top) > 1 else -1), int(top in TOP_DOMAINS)
        placeholder = -(local.lower() in ROLE_NAMES)
    elif kind == "ip":
        parts = span.split(".")
        form = 1 if ":" in span or all(str(int(p[-3:])) == p for p in parts) else -1
        listed = -1 if parts[0] in ("0", "10", "127", "255") or span.startswith(("192.168.", "169.254.")) else 0
        placeholder = -(len(set(parts)) == 1)
    elif kind == "card":
        form, listed, placeholder = (1 if luhn(d) else -1), (1 if issued(d) else -1), -(d in TEST_CARDS)
    else:
        form = 1 if 10 <= len(d) <= 13 else -1
        listed = (1 if calling_code(d.lstrip("0")) else -1) if span[0] == "+" or span.startswith("00") else 0
        placeholder = 0
    edges = (before[-1:] or " ") + (after[:1] or " ")
    open_edges = not any(c.isalnum() or c in "_/=#@" for c in edges)
    steps = {(int(b) - int(a)) % 10 for a, b in zip(d, d[1:])}
    return (int(is_base), form, listed, placeholder, int(bool(CUES[kind].intersection(words[-4:]))), -bool(AGAINST.intersection(words[-2:])),
            1 if open_edges else -1, -(len(d) > 7 and len(steps) == 1), -crossed)


def features(kind: str, span: str, before: str, after: str, cast: tuple[int, ...]) -> list[int]:
    """Buckets of the classifier's active features."""
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", span)))
    words = [w.lower() for w in _WORD.findall(before)][-2:] + ["|"] + [w.lower() for w in _WORD.findall(after)][:1]
    names = [f"{kind}:{name}:{v}" for name, v in zip(LABELERS, cast) if v] + [f"{kind}:shape:{shape[:40]}", f"{kind}:digits:{len(digits_of(span))}"]
    names += [f"{kind}:near:{w}" for w in words if w != "|"] + [kind]
    return sorted({zlib.crc32(n.encode()) % BUCKETS for n in names})


def candidates(text: str) -> list[tuple[int, int, int, bool, int, list[int]]]:
    """(kind's place, start, end, base, votes as a number of base 3, features), sorted."""
    base = base_spans(text)
    found = [(kind, a, b, True) for kind in KINDS for a, b in base[kind]]
    if _ANY.search(text) or _SPELLED.search(text):
        found += [(kind, a, b, False) for kind, a, b in wide_spans(text, base)]
    out = []
    for kind, a, b, is_base in found:
        before, after, span = text[max(0, a - BEFORE):a], text[b:b + AFTER], text[a:b]
        cast = votes(kind, span[:200], before, after, is_base, any(_across(a, b, base[k]) for k in KINDS if k != kind))
        code = sum((v + 1) * 3**i for i, v in enumerate(cast))
        out.append((KINDS.index(kind), a, b, is_base, code, features(kind, span[:200], before, after, cast)))
    return sorted(out)


FOUND = "doc_id long, kinds array<int>, starts array<long>, ends array<long>, base array<boolean>, votes array<int>, features array<array<int>>"


def found_spans(documents: DataFrame) -> DataFrame:
    """doc_id and all candidates of every row; stored."""
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.list_(pa.int32()))
    names = ["kinds", "starts", "ends", "base", "votes", "features"]

    def one(batch: pa.RecordBatch):
        rows = [candidates(t or "") for t in batch.column("text").to_pylist()]
        columns = [pa.array([[c[i] for c in row] for row in rows], pa.list_(t)) for i, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    return cut(map_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, FOUND))


def opinions(codes: np.ndarray) -> np.ndarray:
    """Vote numbers as rows of votes plus 1."""
    return codes[:, None] // 3 ** np.arange(len(LABELERS)) % 3


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns and their counts.

    Returns each pattern's probability of being true, the labelers' rates
    [true or false, labeler, vote] and the share of true spans. Priors of a
    few votes say that a labeler errs less often than not; they decide where votes do not.
    """
    cast = opinions(codes)
    truth = 1 / (1 + np.exp(-(cast - 1).sum(axis=1).astype(float)))
    prior = np.array([[4.0, 4.0, 1.0], [1.0, 4.0, 4.0]])          # false, true: votes -1, 0, 1
    rates, share = np.zeros((2, len(LABELERS), 3)), 0.5
    for _ in range(rounds):
        for y, weight in enumerate((counts * (1 - truth), counts * truth)):
            for j in range(len(LABELERS)):
                seen = np.bincount(cast[:, j], weight, 3) + prior[y]
                rates[y, j] = seen / seen.sum()
        share = ((counts * truth).sum() + 1) / (counts.sum() + 2)
        logs = np.log(rates)[:, np.arange(len(LABELERS)), cast].sum(axis=2)
        before, truth = truth, 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - share) - logs[1] - np.log(share), -500, 500)))
        if np.abs(before - truth).max(initial=0) < 1e-9:
            break
    return truth, rates, share


def fit(rows: list[list[int]], target: np.ndarray, rounds: int = 400, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression over active buckets, by full gradients with adaptive steps."""
    weights, square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    on = np.fromiter((f for r in rows for f in r), np.int64, len(at))
    for _ in range(rounds if len(rows) else 0):
        error = 1 / (1 + np.exp(-np.bincount(at, weights[on], len(rows)))) - target
        slope = np.bincount(on, error[at], BUCKETS) / len(rows) + shrink * weights
        square += slope * slope
        weights -= rate * slope / np.sqrt(square)
    return weights


def train(found: DataFrame) -> np.ndarray:
    """The classifier's weights, from the candidates of all documents."""
    single = found.select(F.explode(F.arrays_zip("kinds", "votes", "features")).alias("c")).select("c.kinds", "c.votes", "c.features")
    patterns = single.groupBy("kinds", "votes").count().collect()             # at most 4 * 3^9
    truth = {}
    for kind in range(len(KINDS)):
        some = [r for r in patterns if r["kinds"] == kind]
        codes = np.array([r["votes"] for r in some], np.int64)
        if len(codes):
            p, _, _ = estimate(codes, np.array([r["count"] for r in some], float))
            truth |= {(kind, int(c)): float(t) for c, t in zip(codes, p)}
    first = Window.partitionBy("kinds").orderBy(F.xxhash64("kinds", "votes", "features"), "votes", "features")
    sample = single.distinct().withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= MAX_TRAIN).collect()
    sample.sort(key=lambda r: (r["kinds"], r["_place"]))
    return fit([r["features"] for r in sample], np.array([truth[r["kinds"], r["votes"]] for r in sample]))


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(documents: DataFrame) -> DataFrame:
    """Every row's base spans (counts and digest) and all its spans, with those the classifier adds."""
    found = found_spans(documents)
    weights = train(found)

    def result(batch: pa.RecordBatch):
        out = []
        columns = [batch.column(n).to_pylist() for n in ("doc_id", "kinds", "starts", "ends", "base", "votes", "features")]
        for doc_id, *lists in zip(*columns):
            rows = list(zip(*lists))
            base = [(k, a, b) for k, a, b, is_base, _, _ in rows if is_base]
            likely = sorted((-weights[on].sum(), k, a, b) for k, a, b, is_base, _, on in rows if not is_base and weights[on].sum() >= 0)
            added = []
            for _, k, a, b in likely:                # the likeliest first; later ones that overlap it go
                if not any(k == j and a < d and c < b for j, c, d in added):
                    added.append((k, a, b))
            text = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
            out.append((doc_id, *(sum(k == j for k, _, _ in base) for j in range(len(KINDS))),
                        hashlib.sha256(text(base).encode()).hexdigest(), text(base + added), len(added)))
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)],
                                         ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return map_arrow(found, result, RESULT)
