import hashlib
import random

from placeforge.llm import winnow as N

from .helpers import documents, empty, hard, hard_rows, words


def test_winnowing_against_brute_force():
    r = random.Random(1)
    for text in [words(1, 80)[: r.randint(0, 400)] for _ in range(40)] + ["", "abc", "a" * 16, "a" * 120]:
        h = N.gram_hashes(text)
        assert len(h) == (max(1, len(text) - N.GRAM + 1) if text else 0)
        w = min(N.WINDOW, len(h))
        chosen = {max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)} if len(h) else set()
        got, at = N.winnow(h)
        assert at.tolist() == sorted(chosen) and got.tolist() == [h[j] for j in sorted(chosen)]


def test_rolling_hashes_depend_on_the_gram_alone():
    a, b = N.gram_hashes("xx" + words(2, 30)), N.gram_hashes("abcd" + words(2, 30))
    assert (a[2:] == b[4:]).all()


def test_shared_runs_share_an_entry():
    run = words(3, 60)[: N.GRAM + N.WINDOW - 1]
    _, a = N.fingerprint(words(4, 30) + run + words(5, 30))
    _, b = N.fingerprint(words(6, 30) + run + words(7, 30))
    assert N.likeness(a, b) > 0


def check(rows, texts):
    """texts: (id, text) in falling order."""
    assert len(rows) == len(texts)
    want = []
    for i, (key, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        k = len(text) // 2
        new = text[: len(text) - k] + following[:k]
        own, changed, other = N.fingerprint(text), N.fingerprint(new), N.fingerprint(following)
        want.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), own[0], changed[0], N.likeness(own[1], changed[1]), N.likeness(own[1], other[1])))
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert sorted(map(tuple, rows), key=order) == sorted(want, key=order)


def test_against_brute_force(spark, tmp_path):
    texts = [words(k, 3 + k * 7 % 90) for k in range(60)] + [None, "", words(1, 40)]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    check(N.query(spark, str(tmp_path)).collect(), [(i, texts[i] or "") for i in reversed(range(len(texts)))])


def test_hard_rows(spark, tmp_path):
    hard(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, t or "", r.h) for (i, t, *_), r in zip(hard_rows(), hard(spark).selectExpr("shiftrightunsigned(xxhash64(text), 1) AS h").collect(), strict=True)]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    check(N.query(spark, str(tmp_path)).collect(), [r[:2] for r in rows])
    assert N.fingerprints(empty(spark)).collect() == []
    one = N.fingerprints(documents(spark, ["only one text"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_an_id_with_most_rows_is_split(spark):
    rows = [(None, words(k, 12)) for k in range(150)] + [(7, words(200 + k, 12)) for k in range(150)] + [(k, words(400 + k, 12)) for k in range(1, 40)] + [(7, words(200, 12))] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = N.neighbours(df).filter("NOT ghost")
    assert dealt.groupBy("part").count().agg({"count": "max"}).first()[0] < 60
    order = {(r.doc_id, r.text): r.h for r in df.selectExpr("doc_id", "text", "shiftrightunsigned(xxhash64(text), 1) AS h").collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), order[r], r[1]))
    found = [tuple(r) for r in N.fingerprints(df).collect()]
    check([(None if r[0] == N.solid_id.__globals__["NULL_ID"] else r[0], *r[1:]) for r in found], rows)


def test_entries_in_blocks():
    r = random.Random(9)
    for n in (0, 5, 30, 100, 700):
        text = "".join(r.choice("ab ") for _ in range(n))
        h, at = N.winnow(N.gram_hashes(text))
        for block in (1, 17, 64, 300):
            got = N.entries(text, block)
            assert got[0].tolist() == h.tolist() and got[1].tolist() == at.tolist()


def test_a_short_text_that_keeps_half_shares_an_entry():
    for k in range(60):
        text = words(k, 40)[: 46 + k]
        assert N.likeness(N.fingerprint(text)[1], N.fingerprint(N.edited(text, words(100 + k, 60)))[1]) > 0
