"""Word hashes, and token ids against the tokenizer itself on odd texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from barline.llm import arrays, packing

PIECES = ["İ", "I", "ı", "i", "ANKARA", "VALİLİĞİ", "MECLİSİ", "Straße", "ǅ", "Ω", "ﬁ", "É", "é", "̇", "x", "Part", "word", "12", "3.5", "don't", "Ŋ", "ẞ", "漢字", "🙂", "ñ"]
MARKS = [".", ",", "..", ".,", "!", "?", "-", "'", "", "", "", ".", ",", ")", "​"]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.encoder(path, 1)
    assert isinstance(own, packing.WordEncoder)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice(PIECES) for _ in range(rng.randint(1, 2))) + rng.choice(MARKS) for _ in range(rng.randint(1, 6))) for _ in range(6000)]
    texts += ["ANKARA VALİLİĞİ.", "MECLİSİ, 1920", "İ. İ, I. i."]
    data, offsets = arrays.utf8(pa.array(texts, pa.large_string()))
    ids, counts = own.encode(data, offsets)
    want = [[*e.ids, 1] for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_long_patterned_words_have_their_own_hashes():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    for values in (arrays.BYTE_VALUES, arrays.LOWER_VALUES):
        hashes = [arrays.Words(*arrays.utf8(pa.array([x])), values=values).hashes[0] for x in (a, b, a.upper())]
        assert hashes[0] != hashes[1] and (hashes[0] == hashes[2]) == (values is arrays.LOWER_VALUES)
    short = arrays.Words(*arrays.utf8(pa.array(["ab " * 5])))
    assert len(np.unique(short.hashes)) == 1


def test_remembered_words_stay_few_and_common_ones_are_kept(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), packing.encoder(path, 1)
    monkeypatch.setattr(packing, "REMEMBERED", 3000)
    texts = ["common, words. " + " ".join(f"w{k}x{i}." for i in range(300)) for k in range(40)]
    for text in texts:
        ids, counts = own.encode(*arrays.utf8(pa.array([text])))
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]
    assert own.words <= 3000
    common = arrays.Words(*arrays.utf8(pa.array(["common, words."]))).hashes
    assert (own.find(common) >= 0).all()
    own.forget()
    assert (own.find(common) >= 0).all() and own.words < 50


def test_remembered_words_take_little_memory():
    own = packing.encoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    texts = [" ".join(f"{i:x}q" for i in range(k, k + 20_000)) for k in range(0, 600_000, 20_000)]
    tracemalloc.start()
    try:
        for text in texts:
            own.encode(*arrays.utf8(pa.array([text])))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 16e6


def test_powers_of_nothing_in_a_new_process():
    kept = arrays.once_per_process("powers", dict)
    before = dict(kept)
    kept.clear()
    try:
        assert len(arrays.powers(3, 0)) == 0 and arrays.powers(3, 3).tolist() == [1, 3, 9]
    finally:
        kept.update(before)
