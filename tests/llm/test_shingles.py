"""What workers keep between tasks, and the shingles of many texts at once."""

import re

import numpy as np

from faultline.llm import minhash
from faultline.llm.common import Memo, lean
from tests.llm.helpers import EDGE


def test_memos_of_other_operators_are_dropped():
    memo, task = Memo(str.encode, 2), lean(lambda batches: (memo[b] for b in batches))
    assert list(task(["a", "b", "c"])) == [b"a", b"b", b"c"] and len(memo) + len(memo.old) == 3
    assert list(lean(iter)(["of another operator"])) and not memo and not memo.old
    assert list(task(["a", "a"])) == [b"a", b"a"] and len(memo) == 1


def test_near_duplicates_keep_no_words():
    before = len(Memo.all)
    sets = list(minhash.shingle_sets([f"word{i} of many{i} words{i}" for i in range(1000)]))
    assert [len(s) for s in sets] == [2] * 1000 and len(Memo.all) == before
    assert not any(isinstance(x, Memo) for x in vars(minhash).values())


def test_shingles_of_many_texts(monkeypatch):
    word = minhash._characters(0x110000)[0]
    assert all((minhash.WORD.fullmatch(chr(i)) is not None) == word[i] for i in range(0x110000))
    texts = [t for _, t in EDGE] + ["", "a", "a b", "b a", "a b c", "A b, C", "a b c a b c", "\n\n a_1 ²³ ½ É é x", "İx ΑΣ ΑΣ. σς", "\U00010400 \U0001d7d8 q w", "y" * 64 + " " + "y" * 65 + " z", " ".join(f"w{i % 700}" for i in range(2000))]
    spans = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        spans.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    for lot in (1, 50, 1 << 16):
        monkeypatch.setattr(minhash, "LOT", lot)
        sets = list(minhash.shingle_sets(texts))
        assert [len(s) for s in sets] == [len(s) for s in spans] and all((s[1:] > s[:-1]).all() for s in sets)
        assert all(np.array_equal(s, minhash.shingles(t)) for t, s in zip(texts, sets))
    for a, x in zip(spans, sets):
        for b, y in zip(spans, sets):
            assert len(np.intersect1d(x, y)) == len(a & b)
