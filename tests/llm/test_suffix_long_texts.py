"""Long texts beside empty ones in a batch."""

import numpy as np

from touchline.llm import suffix_dedup


def _windows(found, text):
    t, first, last, at, h = (x.tolist() for x in found)
    return {(s, p, x) for i, a, b, p, x in zip(t, first, last, at, h) if i == text for s in range(a, b + 1)}


def test_anchors_do_not_depend_on_empty_neighbours():
    text = np.random.default_rng(6).integers(97, 123, 2_000_000, dtype=np.uint8).tobytes()
    alone = suffix_dedup.anchors([text])
    for batch in ([b"", text], [b"", b"short", text, b"", text[:300]]):
        found = suffix_dedup.anchors(batch)
        at = batch.index(text)
        mine = found[0] == at
        assert all((x[mine] == y).all() for x, y in zip(found[1:], alone[1:]))
    assert len(_windows(alone, 0)) == len(text) - 199


def test_matches_of_long_texts_beside_empty_ones(spark):
    rng = np.random.default_rng(7)
    text = bytearray(rng.integers(97, 123, 2_000_000, dtype=np.uint8).tobytes())
    passage = bytes(rng.integers(97, 123, 1000, dtype=np.uint8))
    for mark, at in zip(b"012", (262_144 - 450, 1_300_000, 1_800_000)):
        text[at - 1:at + 1001] = bytes([mark]) + passage + bytes([mark])
    rows = [(1, ""), (2, None), (3, text.decode()), (4, "")]
    got = {r.doc_id: r for r in suffix_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert (got[3].n_removed, got[3].n_spans) == (3000, 3) and not any(got[i].n_removed for i in (1, 2, 4))
