"""What Python workers hold: n-grams of a stretch, and what operators remember from task to task."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lintlake.llm import bpe, quality
from lintlake.llm.common import REMEMBERED, release


def test_release_forgets_what_other_operators_remember():
    path = public_tokenizers.path("byte_bpe_50k.json")
    before = list(bpe._bpe(path).encode(["so it goes", None]))
    assert bpe._workers
    release()
    assert not bpe._workers and list(bpe._bpe(path).encode(["so it goes", None])) == before


@pytest.mark.parametrize("cells", [0, 1 << 16])
def test_codes_of_windows(monkeypatch, cells):
    """Bytes from 0x80 on come first, too; every n-gram ends in the shorter one and stands after its context."""
    monkeypatch.setattr(quality, "CELLS", cells)
    text = np.frombuffer("日本 é日 é ab日本".encode(), np.uint8)
    g = quality.Grams.read(text, np.array([0]))
    assert [int(c) for c in quality.windows(text)[4:]] == [int.from_bytes(text[i : i + 5].tobytes(), "big") for i in range(len(text) - 4)]
    for n in range(1, quality.ORDER + 1):
        assert (g.codes[n] % 256 ** (n - 1) == g.codes[n - 1][g.suffix[n]]).all()
        own = g.at[n][n:]  # n-grams before which a byte of the text stands
        assert (g.codes[n][own] // 256 == g.codes[n - 1][g.contexts(n, own)]).all()


def test_asking_holds_little_for_a_byte():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshrdlu"), 5)) for _ in range(3000)]
    text = " ".join(rng.choice(words, 170_000))
    tracemalloc.start()
    try:
        quality.asked(["=en"], pa.array([text]))
        assert tracemalloc.get_traced_memory()[1] < 45 * len(text)
    finally:
        tracemalloc.stop()


def test_release_keeps_what_is_ones_own():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = bpe._bpe(path)
    other: dict = {"x": 1}
    REMEMBERED.append(other)
    try:
        release(bpe._workers)
        assert not other and bpe._bpe(path) is own
    finally:
        REMEMBERED.remove(other)


def test_beyond_memory_words_at_hand_stay(monkeypatch):
    """They are not learnt again; others are forgotten, and results stay the same."""
    b = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json"))
    text = " ".join(f"word{k % 500}" for k in range(100_000))
    next(b.encode([text]))
    monkeypatch.setattr(bpe, "MEMORY", 2000)
    want = [next(bpe.Bpe(public_tokenizers.path("byte_bpe_50k.json")).encode([t])) for t in ("word1 so it goes", text)]
    b.known |= {f"old{k}": ("0", 1, b"") for k in range(1500)}
    learnt, learn = [], b.learn
    monkeypatch.setattr(b, "learn", lambda new: learnt.extend(new) or learn(new))
    assert list(b.encode(["word1 so it goes", text])) == want
    assert sorted(learnt) == [" goes", " it", " so"]
    assert "old1" not in b.known and " word" in b.known and len(b.known) < 1500
