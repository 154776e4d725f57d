"""Lattices of new words and the draws of texts taken together."""

import random
import sys

import numpy as np
import public_tokenizers
import pytest

from wattloom.llm import pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def lattice():
    out = pieces.lattice_of(PIECES, 1.0)
    out.clear()
    yield out
    out.clear()


def invented(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("aehinorst", k=rng.randint(4, 12))) for _ in range(n))


def test_new_words_take_less_than_a_python_line_per_character(lattice):
    text, lines = invented(3000, 1), 0

    def trace(frame, event, _):
        nonlocal lines
        if frame.f_code.co_filename != pieces.__file__:
            return None
        lines += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        got = pieces.segmentations(lattice, text, 2, 1)
    finally:
        sys.settrace(before)
    assert len(got) == 2 and all(pieces.spell(lattice, ids.tolist()) == lattice.sp.normalize(text) for ids, _, _ in got)
    assert lines < len(text)


def log_mass(lattice, word):
    """Log weight of all segmentations of a word, by the definition."""
    beta = [-np.inf] * len(word) + [0.0]
    for i in reversed(range(len(word))):
        steps = [lattice.weight[lattice.ids[word[i:j]]] + beta[j] for j in range(i + 1, len(word) + 1) if word[i:j] in lattice.ids]
        if word[i] not in lattice.ids:
            steps.append(sum(lattice.weight[lattice.of_byte[b]] for b in word[i].encode()) + beta[i + 1])
        beta[i] = np.logaddexp.reduce(steps)
    return beta[0]


def test_log_probabilities_by_definition(lattice):
    texts = [invented(40, 2), "a😀b￿ c漢字", "s" * 3000, "▁▁ x▁y  z", "it. (is) it?\n\nis"]
    found = pieces.drawn(lattice, lattice.starts(texts), 2, [1, 2, 3, 4, 5])
    for text, members in zip(texts, found, strict=True):
        whole = sum(log_mass(lattice, r) for r in pieces.runs_of(lattice.sp.normalize(text)))
        for rows, lp, _ in members:
            ids = lattice.spelled(rows)[0].tolist()
            assert pieces.spell(lattice, ids) == lattice.sp.normalize(text)
            assert abs(sum(lattice.weight[i] for i in ids) - whole - lp) < 1e-6


def test_texts_drawn_together_as_alone(lattice):
    texts = ["", "the cat", None, invented(50, 3), "😀", "the cat", "a", " ", invented(60, 4), "s" * 100]
    seeds = [7, 8, 9, 10, 11, 8, 12, 13, 14, 15]
    for k in (1, 2, 9):
        together = pieces.drawn(lattice, lattice.starts(texts), k, seeds)
        for text, seed, members in zip(texts, seeds, together, strict=True):
            alone = pieces.segmentations(lattice, text, k, seed)
            assert [lattice.spelled(rows)[0].tolist() for rows, _, _ in members] == [ids.tolist() for ids, _, _ in alone]
            assert np.allclose([x[1:] for x in members], [x[1:] for x in alone], rtol=1e-12, atol=1e-12)
            assert 1 <= len(alone) <= k and len({tuple(x[0].tolist()) for x in alone}) == len(alone)
        lattice.clear()


def test_lookup_keeps_keys_apart():
    keys = np.array(sorted(random.Random(5).sample(range(1 << 40), 5000)), np.int64)
    table = pieces.Lookup(keys, np.arange(len(keys)))
    assert table.find(keys).tolist() == list(range(len(keys)))
    assert (table.find(np.setdiff1d(keys + 1, keys)) == -1).all() and len(table.find(keys[:0])) == 0
