from placeforge.llm import decontam as D

from . import helpers
from .helpers import documents, empty, words
from .helpers import first_hard as hard
from .helpers import first_rows as hard_rows

ITEM = "A train leaves Paris at 9 and travels 120 km before it meets Anna, who has walked 3 km since 7 in the morning; how far is Paris"
ITEMS = [(1, ITEM), (2, words(70, 40)), (3, None), (4, ""), (5, "What is two times seven"), (6, words(71, 30))]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def judged(spark, texts):
    return {r.doc_id: r for r in D.judge(documents(spark, texts), items(spark)).collect()}


def test_leaks_and_clean_documents(spark):
    pad, tail = words(1, 50), words(2, 50)
    renamed = ITEM.replace("Paris", "London").replace("120", "340").replace("Anna", "Peter").replace(" 3 ", " 5 ")
    muddled = ITEM.replace("Paris", "London", 1).replace("120", "340")
    texts = [f"{pad} {ITEM} {tail}", f"{pad} {renamed} {tail}", f"{pad} {muddled} {tail}", pad, f"{pad} {words(70, 40)}", f"{pad} {' '.join(words(70, 40).split()[:9])} {tail}", "Well, what IS two times seven?", words(71, 30).upper()]
    got = judged(spark, texts)
    assert [got[k].contaminated for k in range(8)] == [True, True, False, False, True, False, True, True]
    assert got[1].reparameterised and not got[0].reparameterised and got[4].item_id == 2 and got[4].coverage > 0.9


def test_shuffled_way_is_the_same(spark, monkeypatch):
    texts = [words(k, 30) + " " + ITEM for k in range(5)] + [words(70, 40), "short"]
    a = judged(spark, texts)
    monkeypatch.setattr(D, "MOST_BROADCAST", 0)
    assert judged(spark, texts) == a


def test_hard_rows(spark):
    rows = D.judge(hard(spark), items(spark)).collect()
    assert len(rows) == len(hard_rows()) and not any(r.contaminated for r in rows)
    none = items(spark).filter("false")
    assert not any(r.contaminated for r in D.judge(hard(spark), none).collect())
    assert D.judge(empty(spark), items(spark)).collect() == []
    df = hard(spark)
    out = D.keep_clean(df, spark.createDataFrame([(1, words(4, 40)), (2, words(3, 60))], "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == sorted((i or 0) for i, *_ in hard_rows() if i not in (9, None))


def test_rows_of_one_id_are_judged_apart(spark):
    df = helpers.hard(spark)
    leaks = [words(4, 40), words(3, 60), words(7, 45)]
    bench = spark.createDataFrame(list(enumerate(leaks)), "item_id long, text string")
    rows = D.judge(df, bench).collect()
    assert len(rows) == len(helpers.hard_rows())
    assert sorted((r.doc_id or 0) for r in rows if r.contaminated) == [0, 9, 9, 11]
    kept = D.keep_clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t, *_ in helpers.hard_rows() if t not in leaks)


def test_main_path_is_native(spark):
    plan = D.judge(documents(spark, [ITEM]), items(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(texts, items, cover=D.COVER):
    """The rules in plain Python: {document: {item: (coverage, reparameterised)}}."""
    import regex

    def tokens(text):
        """(kind, lowered) with kind w, n, u or q."""
        out = []
        for w in regex.findall(r"[0-9]+(?:[.,:/][0-9]+)*|\p{L}+|[^\P{N}0-9]+", text or ""):
            kind = "n" if w[0] in "0123456789" else "q" if regex.match(r"\p{Lu}\p{Ll}", w) else "u" if w.lower() in D.UNITS and out and out[-1][0] == "n" else "w"
            out.append((kind, w.lower()))
        return out

    numbers = lambda ts: [k if k in "nu" else v for k, v in ts]
    names = lambda ts: [k if k in "nuq" else v for k, v in ts]
    literal = lambda ts: [v for _, v in ts]
    out = {}
    for d, text in enumerate(texts):
        a = tokens(text)
        for item, question in items:
            b = tokens(question)
            if len(b) < D.SHORT:
                continue
            if len(b) < D.WIDTH:
                if any(literal(a[i : i + len(b)]) == literal(b) for i in range(len(a))):
                    out.setdefault(d, {})[item] = (1.0, False)
                continue
            lines = {}
            for j in range(len(b) - D.WIDTH + 1):
                own = b[j : j + D.WIDTH]
                words, bare = sum(k in "wq" for k, _ in own), sum(k == "w" for k, _ in own)
                ways = [(numbers, "nu")] if words >= D.LEAST_WORDS else [(literal, "")]
                if bare >= D.LEAST_WORDS:
                    ways.append((names, "nuq"))
                for i in range(len(a) - D.WIDTH + 1):
                    for form, kinds in ways:
                        if form(a[i : i + D.WIDTH]) == form(own):
                            pairs = frozenset((j + x, q[1], p[1]) for x, (q, p) in enumerate(zip(own, a[i : i + D.WIDTH])) if q[0] in kinds)
                            lines.setdefault(i - j, set()).add((j, pairs))
            covered, changed = set(), False
            for windows in lines.values():
                votes = {p for _, pairs in windows for p in pairs}
                met = {}
                for _, i, v in votes:
                    met.setdefault(i, []).append(v)
                most = {i: [v for v in set(vs) if 2 * vs.count(v) > len(vs)] for i, vs in met.items()}
                as_is = all(len(set(vs)) > 1 or vs[0] == i for i, vs in met.items())
                becomes = {i: (found or ([i] if as_is and i in met[i] else [None]))[0] for i, found in most.items()}
                if None in becomes.values():
                    continue
                good = [(at, pairs) for at, pairs in windows if all(becomes[i] == v for _, i, v in pairs)]
                covered |= {at for at, _ in good}
                changed |= any(i != v for _, pairs in good for _, i, v in pairs)
            if len(covered) / (len(b) - D.WIDTH + 1) >= cover:
                out.setdefault(d, {})[item] = (len(covered) / (len(b) - D.WIDTH + 1), changed)
    return out


def test_against_brute_force(spark):
    import random

    r, texts = random.Random(8), []
    for k in range(60):
        q = r.choice([ITEM, words(70, 40), words(71, 30), "What is two times seven"]).split()
        q = [str(r.randint(1, 999)) if w.isdigit() and r.random() < 0.5 else w for w in q]
        a, b = sorted((r.randrange(len(q) + 1), r.randrange(len(q) + 1)))
        texts.append(" ".join([words(k, 20), *q[a:b], words(100 + k, 20), *(q if k % 7 == 0 else q[: len(q) // 2])]))
    want = brute(texts, ITEMS)
    got = {k: g for k, g in judged(spark, texts).items() if g.contaminated}
    assert set(got) == set(want) and want
    for d, found in want.items():
        assert (got[d].n_items, got[d].item_id, got[d].reparameterised) == (len(found), min(found), any(x[1] for x in found.values()))
        assert abs(got[d].coverage - max(x[0] for x in found.values())) < 1e-6


def test_coinciding_numbers_and_an_altered_repeat(spark):
    q = "Tom buys 3 apples and then 4 pears at the old shop near the river, eats some of the fruit on the long way home with 3 friends and counts what is left in the bag before supper with 3 cousins"
    one = q.replace("3", "5").replace("4", "5")
    altered = q.replace("3 friends", "8 friends")
    twice = "A box holds 6 red balls that were bought in the town last week and nobody has opened it since, while a crate in the cellar of the house holds 6 blue ones"
    half = twice.replace("6 blue", "7 blue")
    texts = [f"{words(1, 30)}. {x}. {words(2, 30)}" for x in (one, altered, half, q)]
    found = D.judge(documents(spark, texts), spark.createDataFrame([(1, q), (2, twice)], "item_id long, text string")).collect()
    got = {r.doc_id: (r.contaminated, r.item_id, r.reparameterised) for r in found}
    assert got == {0: (True, 1, True), 1: (True, 1, False), 2: (True, 2, False), 3: (True, 1, False)}
    assert {r.doc_id: r.coverage for r in found}[1] < 1 == {r.doc_id: r.coverage for r in found}[3]


def test_names_whatever_stands_before_them(spark):
    q = "Natalia sold clips to her old friends in the spring. Natalia gave half as many to the new ones in May. Natalia kept none; how many clips did she part with"
    inside = "Every day the tall boy Marcus walks to the far end of the park with his dog, and there Marcus meets his aunt before supper"
    texts = [q.replace("Natalia", "Maria"), q.lower(), inside.lower(), inside.replace("boy Marcus", 'boy "Peter"').replace("Marcus", "Peter"), words(9, 40)]
    texts = [f"{words(1, 30)}. {x}. {words(2, 30)}" for x in texts]
    found = D.judge(documents(spark, texts), spark.createDataFrame([(1, q), (2, inside)], "item_id long, text string")).collect()
    assert {r.doc_id: (r.contaminated, r.item_id) for r in found} == {0: (True, 1), 1: (True, 1), 2: (True, 2), 3: (True, 2), 4: (False, None)}


def test_short_items_and_lists_of_numbers(spark):
    numbers = "3 1 4 1 5 9 2 6 5 3 5 8 9 7 9"
    own = [(1, "42"), (2, "Yes"), (3, "Is it 7 or 9"), (4, numbers), (5, "yes no yes no")]
    texts = ["yes, the answer is 42", f"{words(1, 20)} is it 7 or 9? {words(2, 20)}", "Is it 8 or 9", f"{words(3, 20)} {numbers}", " ".join(str(k) for k in range(200)), "Yes no yes no"]
    found = D.judge(documents(spark, texts), spark.createDataFrame(own, "item_id long, text string")).collect()
    assert {r.doc_id: r.item_id for r in found} == {0: None, 1: 3, 2: None, 3: 4, 4: None, 5: 5}
    want = brute(texts, own)
    assert {k: min(v) for k, v in want.items()} == {1: 3, 3: 4, 5: 5}


def test_rows_that_share_an_id_are_judged_apart(spark):
    rows = [(None, f"{words(1, 9)} {ITEM}"), (None, words(2, 30)), (None, None), (4, ITEM), (4, words(3, 30)), (4, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = spark.createDataFrame([(1, ITEM), (1, ITEM), (1, words(77, 30)), (None, words(78, 30))], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated, r.n_items) for r in D.judge(docs, twice).collect())
    assert got == [(0, False, 0), (0, False, 0), (0, True, 1), (4, False, 0), (4, True, 1), (4, True, 1)]
    assert sorted((r.text or "") for r in D.keep_clean(docs, twice).collect()) == sorted(["", words(2, 30), words(3, 30)])


def test_long_documents_go_in_blocks(spark, monkeypatch):
    text = f"{words(1, 400)} {ITEM} {words(2, 400)}"
    want = D.judge(documents(spark, [text]), items(spark)).collect()
    assert want[0].contaminated and want[0].coverage == 1
    for size in (9, 100, 411):
        parts = D.blocks(documents(spark, [text]), size).collect()
        assert len(parts) > 1 and all(len(p.words) < size + D.WIDTH for p in parts)
    monkeypatch.setattr(D.blocks, "__defaults__", (50,))
    assert D.judge(documents(spark, [text]), items(spark)).collect() == want


def test_short_items_at_the_edge_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(D.blocks, "__defaults__", (50,))
    short = "seven tall cows ate one blue hat"
    texts = [" ".join([words(1, at), short, words(2, 70)]) for at in range(40, 60)] + [f"{words(1, 51)} {short[:-4]}"]
    found = D.judge(documents(spark, texts), spark.createDataFrame([(1, short)], "item_id long, text string")).collect()
    assert {r.doc_id for r in found if r.contaminated} == set(range(20))


def by_sql(docs, benchmark):
    import duckdb

    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", benchmark.select("item_id", "text").toPandas().astype({"item_id": "Int64"}))
    return sorted(con.execute(D.SQL).fetchall(), key=repr)


def test_sql_gives_the_same(spark):
    import random

    r = random.Random(4)
    short = [(7, "Is it 7 or 9"), (8, "3 1 4 1 5 9 2 6 5 3 5 8"), (9, "5 km 7 kg 9 mm 4 l 3 h the end"), (10, "Yes"), (10, words(72, 20))]
    own = spark.createDataFrame(ITEMS + short + ITEMS[:1], "item_id long, text string")
    texts = []
    for k in range(90):
        q = r.choice([t for _, t in ITEMS + short if t]).split()
        if k % 3:
            q = [r.choice(["3", "9", "120", w]) if w.isdigit() else r.choice(["Paris", "Rome", w]) if w[0].isupper() else w for w in q]
        a, b = sorted((r.randrange(len(q) + 1), r.randrange(len(q) + 1)))
        texts.append(" ".join([words(k, 12), *q[a:b], words(100 + k, 12), *(q if k % 2 else q[: len(q) // 2])]))
    for docs in (documents(spark, texts), helpers.hard(spark), empty(spark)):
        for asked in (own, spark.createDataFrame([(1, words(7, 45)), (2, words(4, 40))], "item_id long, text string"), own.filter("false")):
            got = sorted((tuple(x) for x in D.judge(docs, asked).collect()), key=repr)
            assert got == by_sql(docs, asked)
    assert sum(x[1] for x in by_sql(documents(spark, texts), own)) > 20
