import random

import numpy as np
import pytest
import xxhash

from placeforge.llm import simhash as S
from placeforge.llm.components import components

from .helpers import documents, empty, hard, hard_rows, words


def plain_fingerprint(text, size=3):
    w = [x for x in (text or "").encode().lower().split()]
    shingles = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """Smallest id reachable over links of at most three bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] < label[b]:
                    label[b], moved = label[a], True
    return label


def test_every_triple_is_covered():
    """Up to three differing bits miss some mask wholly."""
    r = random.Random(1)
    for _ in range(20_000):
        bits = sum(1 << b for b in r.sample(range(64), 3))
        table = [k for k, m in enumerate(S.MASKS) if not bits & m]
        assert table
        for k in table:
            assert any(not bits & b for b in S.BLOCKS[k])


@pytest.mark.parametrize("direct", [2000, 3])
def test_bucket_links_span_all_links(direct):
    r = random.Random(2)
    free = sum(1 << b for b in range(0, 60, 3))
    base = [sum((r.random() < 0.5) << b for b in range(0, 60, 3)) for _ in range(8)]
    fp = np.unique(np.array([b ^ sum(1 << x for x in r.sample(range(0, 60, 3), r.randint(0, 4))) for b in base for _ in range(30)], np.uint64))
    links = S.bucket_links(fp, free, direct)
    forest = S.Forest(len(fp))
    for a, b in links:
        assert (int(fp[a]) ^ int(fp[b])).bit_count() <= 3 and forest.join(a, b)
    full = S.Forest(len(fp))
    for i in range(len(fp)):
        for j in range(i):
            if (int(fp[i]) ^ int(fp[j])).bit_count() <= 3:
                full.join(i, j)
    assert [forest.top(i) for i in range(len(fp))] == [full.top(i) for i in range(len(fp))]


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (10, 11), (12, 11), (7, 7), (4, 5)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {5: 1, 4: 1, 3: 1, 2: 1, 1: 1, 10: 10, 11: 10, 12: 10, 7: 7} | {k: 100 for k in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_against_brute_force(spark):
    r = random.Random(3)
    texts = []
    for k in range(15):
        w = words(k, 300).split()
        for _ in range(4):
            copy = list(w)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["", None, "A b", "a B", "one"]
    rows = S.near_duplicates(documents(spark, texts)).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert prints == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.component_id for r in rows} == brute_classes(prints)


def test_large_buckets_are_dealt_again(spark):
    r = random.Random(4)
    fps = {0} | {sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(60)}
    nodes = spark.createDataFrame([(i, fp - 2**64 if fp >> 63 else fp) for i, fp in enumerate(sorted(fps))], "rep long, fp long")
    for most in (2, 2000):
        got = components(S.hamming_links(nodes, most)).collect()
        assert len(got) == len(fps) and {x.component for x in got} == {0}


def test_hard_rows(spark):
    rows = S.near_duplicates(hard(spark)).collect()
    assert len(rows) == len(hard_rows())
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == 1 and by[4] == by[5] == by[6] == 4 and by[9] == 9
    assert all(r.fingerprint == f"{plain_fingerprint(t):016x}" for r in rows for i, t, *_ in hard_rows() if i == r.doc_id and i not in (9, 11, None))
    assert S.near_duplicates(empty(spark)).collect() == []


def test_keep_one(spark):
    base = words(9, 400).split()
    close = list(base)
    for k in (50, 200, 350):
        close[k] = "changed"
    texts = [" ".join(base), " ".join(close), words(10, 400), words(11, 100) + " " + words(12, 300), words(11, 100) + " " + words(13, 300), " ".join(base)]
    kept = S.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4]
    odd = hard(spark)
    out = S.keep_one(odd)
    assert out.columns == odd.columns
    # all of 4, 5 and 6 have no words; 9 comes twice, 11 with two texts; null ids stay
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out.collect()) == sorted((i is not None, i or 0) for i in [1, 4, 7, 8, 9, 9, None, None, None, -5, 10, 11, 11, 12])
    assert S.keep_one(empty(spark)).collect() == []


def family(pairs, common, own, apart, seed=20):
    """Texts that share ``common`` words; each pair also shares ``own``, and each text has ``apart`` words alone."""
    out, base = [], words(seed, common)
    for k in range(pairs):
        mine = words(1000 + seed + k, own)
        out += [f"{base} {mine} {words(5000 + seed + 2 * k + x, apart)}" for x in (0, 1)]
    return out


def jaccard(a, b, size=5):
    x, y = ({tuple(t.split()[i : i + size]) for i in range(len(t.split()) - size + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_keep_one_confirms_links(spark):
    """Texts of a template below 0.8 all stay but for the true near copies among them."""
    texts = family(60, 320, 70, 1)
    assert jaccard(texts[0], texts[1]) > 0.97 and 0.65 < jaccard(texts[0], texts[2]) < 0.8
    assert sorted(r.doc_id for r in S.keep_one(documents(spark, texts)).collect()) == list(range(0, 120, 2))


@pytest.mark.parametrize("most, block", [(200, 2_000_000), (3, 2_000_000), (3, 3000), (200, 3000)])
def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch, most, block):
    """One bucket of a template: links just at the bound are found, whichever way it is dealt."""
    texts = family(40, 300, 66, 39, seed=40)
    sure = [k for k in range(0, 80, 2) if jaccard(texts[k], texts[k + 1]) >= 0.8]
    assert len(sure) == 40 and jaccard(texts[0], texts[2]) < 0.8
    docs = documents(spark, texts)
    made = docs.select("doc_id", "text").mapInArrow(S._bands(5), "doc_id long, fp long, key long, n int, bands array<long>")
    distinct = made.selectExpr("key", "doc_id AS rep", "n", "array(1L, 2L) AS bands")
    prints = made.selectExpr("key", "doc_id AS component_id")
    links = S.overlap_links(docs.select("doc_id", "text"), distinct, prints, 0.8, 5, most, block).distinct().collect()
    assert sorted(tuple(sorted((r.a, r.b))) for r in links) == [(k, k + 1) for k in range(0, 80, 2)]


@pytest.mark.parametrize("batch", [200_000, 40])
def test_prefixes_against_brute_force(spark, batch):
    """Rare shingles first, over all sets, however these are dealt; every pair with the overlap meets."""
    r = random.Random(6)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 30))), np.int64) for _ in range(50)]
    sets += [np.array(sorted({*s[1:].tolist(), 99}), np.int64) for s in sets if len(s) > 12]
    df = spark.createDataFrame([(k, len(s), bytearray(s.tobytes())) for k, s in enumerate(sets)], "key long, n int, set binary")
    got = {}
    for x in S.prefix_groups(df, 0.8, batch).collect():
        got.setdefault(x.key, set()).add(x.g)
    uses = {}
    for t in (t for s in sets for t in s.tolist()):
        uses[t] = uses.get(t, 0) + 1
    for k, s in enumerate(sets):
        first = sorted(s.tolist(), key=lambda t: (uses[t], t))[: len(s) - int(np.ceil(0.8 * len(s) - 1e-9)) + 1]
        assert got.get(k, set()) == {t for t in first if uses[t] > 1}
    for i, a in enumerate(sets):
        for k in range(i):
            both = len(np.intersect1d(a, sets[k]))
            if both >= 0.8 * (len(a) + len(sets[k]) - both):
                assert got[i] & got[k]


def test_recall_and_false_removals_by_overlap(spark):
    """Pairs with a known overlap among texts that share most of their words: who is linked and who isn't."""
    texts, pairs = [], []
    base = words(900, 330)
    for k in range(150):
        apart = [2, 8, 14, 20, 26, 40][k % 6]
        mine = words(2000 + k, 60)
        pairs.append((len(texts), len(texts) + 1))
        texts += [f"{base} {mine} {words(7000 + 2 * k + x, apart)}" for x in (0, 1)]
    near = {(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8}
    kept = {r.doc_id for r in S.keep_one(documents(spark, texts)).collect()}
    lost = [(a, b) for a, b in near if b in kept]
    assert len(near) > 100 and len(lost) / len(near) <= 0.1
    assert all(a in kept for a, _ in pairs)
    assert all(b in kept for a, b in pairs if (a, b) not in near and all(jaccard(texts[b], texts[x]) < 0.8 for x in range(len(texts)) if x != b))
