"""The chunk tokenizer against the tokenizer itself."""

import random

import numpy as np
from tokenizers import Tokenizer

from ascribe.llm.tokens import ChunkTokenizer, HashTable, vocabulary_json

LETTERS = list("abZİıŞÇéß ,.!'-\n\t\x0b😀²½①ﬁŉǅ") + ["<", "don't", "İ!", "ŞEHRİ.", "SAHİBİ,", "J̌", "क़!", "é", "x" * 300, "</s>"]


def test_ids_equal_the_tokenizers():
    plain = Tokenizer.from_str(vocabulary_json())
    tokenizer = ChunkTokenizer(vocabulary_json())
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 25))) for _ in range(10_000)]
    texts += [f"{c}! a{c}, {c.upper()}{c}?" for c in map(chr, range(0x80, 0x2000)) if c.isalnum()] + [None, "", " \n"]
    for k in range(0, len(texts), 700):
        part = texts[k:k + 700]
        ids, offsets = tokenizer.encode(part)
        for j, t in enumerate(part):
            assert ids[offsets[j]:offsets[j + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_hash_table_keeps_both_halves():
    rng = np.random.default_rng(1)
    table, known = HashTable(16), {}
    for step in range(40):
        # few first halves, so that many keys share their place and their first half
        a, b = rng.integers(0, 50, 30, dtype=np.uint64), rng.integers(0, 40, 30, dtype=np.uint64)
        keys = sorted(set(zip(a.tolist(), b.tolist())))
        a, b = np.array([k[0] for k in keys], np.uint64), np.array([k[1] for k in keys], np.uint64)
        assert table.find(a, b).tolist() == [known.get(k, -1) for k in keys]
        new = [i for i, k in enumerate(keys) if k not in known]
        table.add(a[new], b[new], np.arange(len(known), len(known) + len(new)))
        known.update({keys[i]: len(known) + n for n, i in enumerate(new)})
        assert table.find(a, b).tolist() == [known[k] for k in keys]
