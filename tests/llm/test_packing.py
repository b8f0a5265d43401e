import random

import numpy as np

from placeforge.llm import packing as P
from placeforge.llm import tokenizer as K

from .helpers import documents, empty, hard, hard_rows, words


def test_best_fit_decreasing_against_brute_force():
    r = random.Random(1)
    for length in (1, 7, 100, 2048):
        sizes = [r.randint(1, length) for _ in range(800)]
        rows = P.best_fit(sizes, length)
        assert sorted(k for row in rows for k in row) == list(range(len(sizes)))
        free = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [f for f in free if f >= sizes[k]]
            if fits:
                free[free.index(min(fits))] -= sizes[k]
            else:
                free.append(length - sizes[k])
        assert sorted(length - sum(sizes[k] for k in row) for row in rows) == sorted(free)


def unpacked(rows, length):
    """Segments by (document, start)."""
    out = []
    for r in rows:
        ids, positions = np.frombuffer(r.input_ids, f"<u{r.bits // 8}"), np.frombuffer(r.position_ids, f"<u{r.bits // 8}")
        assert len(ids) == len(positions) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= length
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert positions[a:b].tolist() == list(range(b - a))
            out.append((doc, start, ids[a:b].tolist()))
    return out


def test_round_trip(spark):
    encode = K.encoding(open(K.VOCABULARY, "rb").read())
    rows = P.pack(hard(spark), 64).collect()
    whole: dict = {}
    for doc, start, ids in sorted(unpacked(rows, 64), key=lambda s: (s[0] is not None, s[0] or 0, s[1])):
        whole.setdefault(doc, []).append((start, ids))
    assert sum(len(x) for own in whole.values() for _, x in own) == sum(len(encode.encode_ordinary(t or "")) + 1 for _, t, *_ in hard_rows())
    for i, t, *_ in hard_rows():
        if len({x[1] for x in hard_rows() if x[0] == i}) > 1:  # pieces of several texts under one id
            continue
        want = encode.encode_ordinary(t or "") + [encode.n_vocab]
        copies = sum(x[0] == i for x in hard_rows())
        got = sorted(whole[i])
        assert [x for s in got[::copies] for x in s[1]] == want and len({s for s, _ in got}) * copies == len(got)
    assert P.pack(empty(spark)).collect() == []


def test_rows_are_full(spark):
    rows = P.pack(documents(spark, [words(k, 10 + k * 13 % 150) for k in range(400)]).coalesce(1), 512).collect()
    assert sum(r.n_tokens for r in rows) > 0.97 * 512 * len(rows)
