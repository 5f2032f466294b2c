"""The token ids of remembered words are those of the tokenizer, for few calls of it."""

import itertools

import numpy as np

from swipelake.llm import packing, registered

ODD = ["", None, "a<|b", "<|endoftext|> x", "Ünïcode, Straße; ÀB'S don't WE'LL 1a2b3c", "  z", "a\x1cb", "日本語 x", "ſs İx ﬁ", "\x00 \x07", "x,y;z-- '' 's'll"]


def test_encoder_gives_the_tokenizers_ids(monkeypatch):
    with open(registered.vocabulary_path(), encoding="utf-8") as file:
        own = packing.Encoder(file.read())
    words = ["".join(w) for w in itertools.product("abcdefghij", repeat=3)]
    texts = [*ODD, " ".join(words), "Abc, " + " ".join(words[:50])]
    want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    asked, real = [], own._ids
    monkeypatch.setattr(own, "_ids", lambda text: asked.append(text) or real(text))
    for room in (500_000, 20):
        monkeypatch.setattr(packing, "_CACHED_WORDS", room)
        monkeypatch.setattr(packing, "_CACHED_PARTS", room)
        own.words.clear()
        own.parts.clear()
        assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)] == want
        assert len(own.words) <= room and len(own.parts) <= room
    asked.clear()
    own._learn(set(words))
    assert len(asked) == 5


def test_plain_words_are_neither_divided_nor_normalized(monkeypatch):
    with open(registered.vocabulary_path(), encoding="utf-8") as file:
        own = packing.Encoder(file.read())
    want = {w: own.tokenizer.encode(w, add_special_tokens=False).ids for w in ("wonderful", "Shouting", "HTTP")}
    asked, real = [], own.divide
    monkeypatch.setattr(own, "divide", lambda word: asked.append(word) or real(word))
    own._learn({"x,y", "don't"})
    assert sorted(asked) == ["don't", "x,y"]
    own.tokenizer = None
    learned = own._learn(set(want))
    assert len(asked) == 2 and {w: np.frombuffer(ids, "<u4").tolist() for w, ids in learned.items()} == want
