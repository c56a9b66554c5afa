"""Personal data: base spans against plain patterns, the label model against known rates, added spans against planted ones."""

import hashlib
import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m.group())
            keep = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if keep:
                out[kind].append(m.span())
    return out


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="19.@+- (a_é", max_size=60))
def test_base_spans_of_small_alphabets(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4242 4242 4242 4242", "255.1.0.9", "256.1.1.1", "0000255.1.1.1", "a.b@c.d", "x@y", "+1 (212) 555-0147",
                                 "+49", " ", "-", ".", "@", "é", "7", "\n", "_b@c-d.e.f", "378282246310005"]), max_size=12))
def test_base_spans_of_glued_parts(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == plain(text)


def test_time_is_linear():
    for text in ("a" * 10**6, "1" * 10**6, "+1" + " " * 10**6, "@" * 10**6, "a@" * 400_000, "+1 " * 300_000, "(1 " * 300_000, "1 " * 400_000,
                 "a:" * 400_000, "a (at) " * 100_000, "a.b dot " * 100_000, "1-" * 400_000):
        began = time.perf_counter()
        pii.candidates(text)
        assert time.perf_counter() - began < 5, text[:8]


def test_label_model_finds_rates():
    rng = np.random.default_rng(0)
    n, share = 60_000, 0.3
    truth = rng.random(n) < share
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.75, 0.85, 0.9, 0.65, 0.8])
    silent = rng.random((n, 9)) < 0.3
    cast = np.where(silent, 0, np.where(rng.random((n, 9)) < right, 1, -1) * np.where(truth, 1, -1)[:, None])
    codes, counts = np.unique(((cast + 1) * 3 ** np.arange(9)).sum(axis=1), return_counts=True)
    p, rates, found = pii.estimate(codes, counts.astype(float))
    assert abs(found - share) < 0.02
    spoken = rates[1, :, 2] / (rates[1, :, 0] + rates[1, :, 2])
    assert np.abs(spoken - right).max() < 0.03
    each = p[np.searchsorted(codes, ((cast + 1) * 3 ** np.arange(9)).sum(axis=1))]
    assert ((each >= 0.5) == truth).mean() > 0.97


def planted(rng):
    """(text, spans to be added); clean and misleading ones have none."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    filler = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 12)))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = []
    for i in range(600):
        a, b = filler(), filler()
        phone, glued = f"+1 ({rng.randint(200, 999)}) 555-{digits(4)}", card()
        middle, spans = {
            0: (phone, []), 1: (f"{a[:3]}.{i}@mail.example.com", []), 2: (card(), []), 3: (f"{rng.randint(11, 250)}.{rng.randint(0, 255)}.3.4", []),
            4: (f"{phone} {glued}", [("card", len(phone) + 1, len(phone) + 17), ("phone", 0, len(phone))]),
            5: (f"call {phone[3:]}", [("phone", 5, 5 + len(phone) - 3)]),
            6: (f"order {digits(12)}", []), 7: (f"version {digits(1)}.{digits(2)}", []), 8: ("", []), 9: (f"see 1999-2004 and {digits(3)}", []),
        }[i % 10]
        at = len(a) + 1
        rows.append((f"{a} {middle} {b}", [(k, x + at, y + at) for k, x, y in spans]))
    return rows


def test_added_spans(spark):
    rows = planted(random.Random(2))
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    right = wrong = missed = 0
    for i, (text, spans) in enumerate(rows):
        base = plain(text)
        assert got[i].base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        all_spans = set(filter(None, got[i].spans.split(",")))
        added = all_spans - set(filter(None, line(base).split(",")))
        want = {f"{k}:{a}:{b}" for k, a, b in spans} - set(line(base).split(","))
        assert set(filter(None, line(base).split(","))) <= all_spans and got[i].n_added == len(added)
        right, wrong, missed = right + len(added & want), wrong + len(added - want), missed + len(want - added)
    assert right / (right + missed) >= 0.9 and right / (right + wrong) >= 0.9, (right, wrong, missed)


def test_given_table_and_odd_rows(spark, odd, empty, same):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for docs in (table, odd, same):
        result = pii.personal_data(docs).collect()
        rows = docs.select("doc_id", "text").collect()
        assert len(result) == len(rows)
        want = []
        for r in rows:
            base = plain(r.text or "")
            want.append((str(r.doc_id), *(len(base[k]) for k in PATTERNS), hashlib.sha256(line(base).encode()).hexdigest()))
        assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in result) == sorted(want)
    assert pii.personal_data(empty).count() == 0


def test_kind_order_and_code_points(spark):
    text = "é😀 +1 (212) 555-0147, 4111111111111111 1.2.3.4 a@b.c"
    r = pii.personal_data(spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string")).where("doc_id = 1").first()
    assert [s.split(":")[0] for s in r.spans.split(",")][0] == "email" and text[:2] == "é😀"
    assert "email:" + ":".join(map(str, re.search(PATTERNS["email"], text).span())) in r.spans
