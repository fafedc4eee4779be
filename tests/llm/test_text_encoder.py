"""op3: all words of a slice are looked up at once; the ids are those of the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from logmix.llm import huffman_ids

ODD = ["", " ", "\n", "  two  blanks ", "a.", "a,", ".", "..", "a..", "3.", "3a.", "é.", "don't.", "it's, no", "a.\nb,\n", "x y.", "İstanbul. İ",
       "<|endoftext|>", "ab<|ENDOFTEXT|>cd", "<|StartOfText|>", "é. á", "日本語。 x", "\x00 \t a\tb.", "A.B. C,D,", "\U0001f600."]


def test_ids_are_the_library_s(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    draw = random.Random(3)
    words = ["".join(draw.choices("abcdeéß.,'3$", k=draw.randrange(1, 9))) for _ in range(3000)]
    texts = [*ODD, *(draw.choice([" ", "\n", "  "]).join(draw.choices(words, k=draw.randrange(30))) for _ in range(400))]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (1_000_000, 100):  # the smaller one forgets in between
        monkeypatch.setattr(huffman_ids, "_CACHED_WORDS", most)
        encoder = huffman_ids.TextEncoder(path)
        for _ in range(2):
            made = [x for a in range(0, len(texts), 7) for x in encoder.encode(texts[a : a + 7])]
            assert [np.frombuffer(x, encoder.kind).tolist() for x in made] == want


def test_known_words_are_sorted_runs():
    encoder = huffman_ids.TextEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(26)) for k in range(26)]
    first = [encoder.encode([t]) for t in texts]
    assert sum(len(keys) for keys, _, _ in encoder.runs) == 26 * 26
    assert all((np.diff(keys.astype(object)) > 0).all() for keys, _, _ in encoder.runs)
    assert [encoder.encode([t]) for t in texts] == first and sum(len(r[0]) for r in encoder.runs) == 26 * 26
