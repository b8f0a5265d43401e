import hashlib

import pytest

from placeforge.llm import substring_dedup as S

from .helpers import documents, empty, hard, hard_rows, words


def brute(rows, text_hash=lambda t: 0):
    """(id, words, removed, kept) in falling precedence of smaller id, then smaller hash of the text."""
    first, out = {}, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]))):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - S.WINDOW + 1):
            window = tuple(w[i : i + S.WINDOW])
            place = (key, text, i)
            if first.setdefault(window, place) != place:
                gone[i : i + S.WINDOW] = [True] * S.WINDOW
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def run(df, **more):
    return [tuple(r) for r in S.remove_repeated_windows(df, **more).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


@pytest.mark.parametrize("hot", [1000, 1])
def test_against_brute_force(spark, hot):
    line = words(7, 25)
    texts = [words(k, 50) + " " + line + " " + words(100 + k, 40) for k in range(12)] + ["x y " * 60, "x y " * 60, words(3, 50), line, words(5, 19)] + [words(50, 70)] * 5
    df = documents(spark, texts)
    assert ordered(run(df, hot=hot)) == ordered(brute(list(enumerate(texts))))


def test_hard_rows(spark):
    rows = hard_rows()
    hashes = {r.text: r.h for r in hard(spark).selectExpr("text", "xxhash64(text) AS h").collect()}
    assert ordered(run(hard(spark))) == ordered(brute([(r[0], r[1]) for r in rows], hashes.get))
    assert run(empty(spark)) == []


def test_rows_that_share_an_id(spark):
    x, y = words(60, 30), words(61, 30)
    rows = [(3, f"{x} {x}"), (3, y), (4, y), (None, f"{y} {y}"), (None, x), (9, f"{x} {words(62, 22)}"), (9, words(62, 22)), (9, words(62, 22))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    for hot in (1000, 1):
        assert ordered(run(df, hot=hot)) == ordered(brute(rows, hashes.get))


def test_query_digest(spark, tmp_path):
    documents(spark, [words(1, 30), words(1, 30)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in S.query(spark, str(tmp_path)).collect()}
    assert rows[0].kept_sha256 == hashlib.sha256(words(1, 30).encode()).hexdigest() and rows[0].n_removed == 0
    assert rows[1].n_removed == 30 and rows[1].kept_sha256 == hashlib.sha256(b"").hexdigest()


def test_hashes_depend_on_the_word_alone(monkeypatch):
    import numpy as np

    texts = [b"a bb  ccc\tbb a", b"xyz ccc a", b" bb"]
    powers, known = S.Powers(), {}
    for block in (S.BLOCK, 4):
        monkeypatch.setattr(S, "BLOCK", block)
        for t in texts:
            for w, h in zip(t.split(), S.word_hashes(S.Words(S.joined(t)), powers).tolist(), strict=True):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known) == 4
    lines = [words(1, 3000).encode(), b"", words(2, 19).encode(), words(3, 20).encode(), words(4, 90).encode()]
    h, line, first, n = S.super_kmers(lines, powers)
    alone = [S.super_kmers([x], powers) for x in lines]
    for k in range(5):
        assert [c[line == k].tolist() for c in (h, first, n)] == [alone[k][c].tolist() for c in (0, 2, 3)]
        assert n[line == k].sum() == max(0, len(lines[k].split()) - S.WINDOW + 1)
        assert np.all(first[line == k][1:] == np.cumsum(n[line == k])[:-1])
    assert 5 < n[line == 0].mean() < 12
