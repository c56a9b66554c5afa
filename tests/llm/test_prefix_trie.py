"""The conversation trie against plain prefix sets, and the z-fast trie against a walk over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from touchline.llm import prefix_trie
from touchline.llm.prefix_trie import ZFastTrie, digest, two_fattest

SCHEMA = "conv_id long, turn int, role string, text string, path string, n_convs long, prefix long, depth int, words long"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), role, digest(len(role.encode()).to_bytes(8, "little"), role.encode(), text.encode()), text))
    own = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in own.items()}
    made = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(first, [])[:h] + t[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        value = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += value
            leaves[p[:d]] += not children[p]
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if made[c] == p).encode()).hexdigest()) for p, m in members.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4) for r in rows], SCHEMA)


def got(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(rng):
    texts = ["", " \t\n", "one", "two words", "three words here", "né e x", None, "a  b\x0bc"]
    rows = []
    for c in [*range(0, 130), 140, 163, 1000, 100_000, -3, -20, -41]:
        for turn in range(rng.randint(1, 6)):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(texts)))
    rows += [(7, None, "user", "before all"), (7, None, "system", "before too"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "assistant", "tie")]
    rows += [(None, 1, "user", "x"), (None, None, None, None)]
    rows += [(2000 + c, t, "user", f"shared {t}") for c in range(60) for t in range(3)]            # copies
    rows += [(3000 + c, t, "user", f"shared {t}" if t < 190 + c else f"own {c}") for c in range(4) for t in range(200)]    # long, late branches
    rng.shuffle(rows)
    return rows


def test_against_prefix_sets(spark, monkeypatch):
    rows = conversations(random.Random(12))
    want = plain(rows)
    table = frame(spark, rows)
    assert got(prefix_trie.trie_nodes(table.repartition(5))) == want
    monkeypatch.setattr(prefix_trie, "TRIE_TURNS", 1)            # tries of one batch each
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 16)             # a node's ids in many blocks
    assert got(prefix_trie.trie_nodes(table.repartition(11))) == want


def test_empty_and_turnless(spark):
    assert prefix_trie.trie_nodes(frame(spark, [])).count() == 0
    assert prefix_trie.trie_nodes(frame(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(c, 0, "user", "only") for c in (1, 2, 3, 4, 5, 6, 7)]          # their heads are absent, and take the only turn of most
    assert got(prefix_trie.trie_nodes(frame(spark, rows))) == plain(rows)


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 80):
            n = two_fattest(low, high)
            assert low < n <= high and all((m & -m) <= (n & -n) for m in range(low + 1, high + 1))


def test_locating_and_inserting():
    rng = random.Random(1)
    words = []
    for _ in range(400):
        base = words[rng.randrange(len(words))] if words and rng.random() < 0.8 else ()
        words.append((*base[:rng.randint(0, len(base))], *(rng.choice("abc") for _ in range(rng.randint(0, 40)))))
    path = lambda w: [digest(repr(w[:i + 1]).encode()) for i in range(len(w))]
    trie = ZFastTrie()
    for start in range(0, 400, 50):
        trie.insert([(path(w), [0, *range(1, len(w) + 1)], n) for n, w in enumerate(words[start:start + 50], start)])
        inserted = {w[:i] for w in words[:start + 50] for i in range(len(w) + 1)}
        for w in words:
            node, exit_node = trie.locate(path(w))
            depth = max(i for i in range(len(w) + 1) if w[:i] in inserted)        # how far the trie agrees
            assert node.extent <= depth and (exit_node is not None) == (depth > node.extent)
            if exit_node is not None:
                assert exit_node.top == node.extent and depth <= exit_node.extent and (depth < exit_node.extent or depth < len(w))
    members = defaultdict(set)
    for n, w in enumerate(words):
        for i in range(len(w) + 1):
            members[w[:i]].add(n)
    rows = list(trie.expanded())
    by_name = {path(p)[-1] if p else b"": (len(p), len(m), min(m), sum(len(words[n]) - max(0, len(p) - 1) for n in m)) for p, m in members.items()}
    assert len(rows) == len(members)
    assert {r[1]: (r[0], r[4], r[5], r[6]) for r in rows} == by_name
    assert all(h == n.path[two_fattest(n.top, n.extent) - 1] for h, n in trie.handles.items())
