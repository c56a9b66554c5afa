"""Words of plain letters go to the model directly; their ids are the tokenizer's (op10_packing)."""

import public_tokenizers

from touchline.llm import packing

LETTERS = [chr(i) for i in (*range(97, 123), *range(0xDF, 0x100)) if i != 0xF7]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, words, **options):
        self.seen += words
        return self.tokenizer.encode_batch_fast(words, **options)


def test_plain_words_skip_the_tokenizer():
    own = packing.WordTokenizer(public_tokenizers.path(packing.TOKENIZER))
    own.tokenizer = counted = Counted(own.tokenizer)
    plain = LETTERS + [a + b + c for a in LETTERS for b in LETTERS for c in "aßé"]
    others = ["é.", "Éa", "x÷y", "it's", "a1b", "ǆ", "é", "日本", "ßÀ", "12", "\x85a"]
    words = [w for pair in zip(plain, others * len(plain)) for w in pair]
    wanted = [counted.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert own._encoded(words) == wanted
    assert set(counted.seen) == set(others)
    counted.seen.clear()
    text = " ".join(plain)
    assert own.encode([text.encode()])[0].tolist() == counted.tokenizer.encode(text, add_special_tokens=False).ids
    assert counted.seen == []
