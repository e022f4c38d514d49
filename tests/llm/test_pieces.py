"""Piece encoding against the sentencepiece library, and what it costs a word."""

import cProfile
import pstats
import random

import numpy as np
import public_tokenizers
import sentencepiece

from tidewatch.llm.pieces import Pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def made(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("etaoinshrdluéüß") for _ in range(r.randint(3, 9))) for _ in range(n)]


def test_equals_the_library_on_odd_words():
    odd = ["", " ", "a", "\n\n x", "𝔘nicode 𒀀𒀀 a𒀀b", "ab" * 60 + " " + "x𒀀" * 40, "=" * 200, "日本語" * 30, "é ​|", "0" * 99 + "𒀀", "𒀀"]
    texts = [*odd, " ".join(made(1, 500)), "\n".join(" ".join([w, *random.Random(w).choices(odd[2:], k=2)]) for w in made(2, 200))]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [np.frombuffer(b, np.int32).tolist() for b in Pieces(PATH).encode(texts)] == [sp.encode(t) for t in texts]


def test_a_new_word_costs_few_calls():
    words, pieces, calls = sorted(set(made(3, 20_000))), Pieces(PATH), cProfile.Profile()
    calls.runcall(pieces.encode, [" ".join(words)])
    assert pstats.Stats(calls).total_calls < 6 * len(words)
