import random
import zlib

from placeforge.llm import toxicity as T

from .helpers import COLUMNS, empty, hard, hard_rows, words

BAD = ["idiot", "scumbag", "morons"]


def corpus(n=600):
    r, rows, labels = random.Random(1), [], []
    for i in range(n):
        text, toxic = words(i, 40), int(i % 5 == 0)
        if toxic:
            w = r.choice(BAD) + r.choice(["", "ic", "!!", "s"])
            text = text.replace(" ", f" {w} ", 1) + f" you {r.choice(BAD)}."
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_folding():
    assert T.fold("1d10t $TUPID mоron м0rоn") == "idiot stupid moron moron"
    assert T.fold("clown### $5.00 2024") == "clown### $5.00 2024"


def test_held_out(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in T.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out]
    assert held and all(got[k].predicted == labels[k][2] for k in held)
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_exceptions():
    lexicon = T.Lexicon({"scum": 3.0}, frozenset(["pond scum"]), (-1.0, 1.0, 1.0))
    a = lexicon.automaton()
    assert T.weigh("some pond scum here", a, lexicon.exceptions) == (0.0, 4)
    assert T.weigh("some Scum here", a, lexicon.exceptions) == (3.0, 3)
    assert T.weigh("discuscum", a, lexicon.exceptions) == (0.0, 1)
    assert T.weigh(None, a, lexicon.exceptions) == (0.0, 0)


def test_choice_keeps_the_longest_of_equal_support():
    counts = {"idi": (50, 0), "idio": (50, 0), "idiot": (50, 0), "idiots": (20, 0), "the": (100, 900), "rar": (1, 0)}
    assert list(T.choose(counts, 100, 900)) == ["idiot"]


def test_hard_rows(spark):
    rows, labels = corpus(200)
    lexicon = T.learn(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (5, 1, None)], "doc_id long, quality int, toxic int"))
    out = T.assess(hard(spark), lexicon).collect()
    assert len(out) == len(hard_rows()) and len({r.score for r in out}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.learn(empty(spark), none) == T.Lexicon()
    assert {r.score for r in T.assess(hard(spark), T.Lexicon()).collect()} == {0.0}
    df = hard(spark)
    kept = T.keep_clean(df, none)
    assert kept.columns == df.columns and kept.count() == len(hard_rows())
    assert T.assess(empty(spark), lexicon).collect() == []


def naive_weight(text, lexicon):
    """Without an automaton: every word's beginnings one by one."""
    import re

    folded, total = T.fold(text or ""), 0.0
    spans = [m.span() for m in re.finditer(r"[^\W\d_]+", folded)]
    for k, (a, b) in enumerate(spans):
        for n in range(1, b - a + 1):
            w = lexicon.stems.get(folded[a : a + n])
            if w is None:
                continue
            near = [folded[slice(*spans[k - 1])] + " " + folded[a:b]] if k and a - spans[k - 1][0] <= 40 else []
            near += [folded[a:b] + " " + folded[slice(*spans[k + 1])]] if k + 1 < len(spans) and spans[k + 1][1] - b <= 40 else []
            total += 0.0 if lexicon.exceptions & set(near) else w
    return total


def test_matching_against_brute_force():
    r = random.Random(5)
    parts = ["id", "idi", "idiot", "scum", "pond", "bag", "s", "mor", "on", "x1", "m0r0n"]
    lexicon = T.Lexicon({"idi": 1.0, "idiot": 2.0, "scum": 3.0, "moron": 4.0, "s": 0.5}, frozenset(["pond scum", "idiot bag", "moron s"]), (0.0, 1.0, 1.0))
    a = lexicon.automaton()
    for _ in range(400):
        text = " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + r.choice(["", ".", "!", " 5"]) for _ in range(r.randint(0, 12)))
        assert abs(T.weigh(text, a, lexicon.exceptions)[0] - naive_weight(text, lexicon)) < 1e-9


def test_counts_against_brute_force(spark):
    """What is learned from, counted plainly; documents that share an id and repeated texts included."""
    rows, labels = corpus(80)
    rows = [*rows, (3, "another text of three", "en", "a", 1), (70, rows[0][1], "en", "a", 1)]
    labels = [*labels, (3, 1, 1), (3, 1, 0)]
    df, known = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxic = {}
    for i, _, t in labels:
        if zlib.crc32(str(i).encode()) % 5:
            toxic[i] = max(toxic.get(i, 0), t)
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    learned = {(min((r[1] for r in rows if r[0] == i), key=hashes.get), t) for i, t in toxic.items()}
    stems = {}
    for text, t in learned:
        for s in {w[:k] for w in T.WORD.findall(T.fold(text)) for k in range(T.STEM[0], min(len(w), T.STEM[1]) + 1)}:
            stems.setdefault(s, [0, 0])[1 - t] += 1
    pos = sum(t for _, t in learned)
    want = T.choose({s: tuple(c) for s, c in stems.items() if c[0] >= 3 and c[0] >= 0.5 * sum(c)}, pos, len(learned) - pos)
    got = T.learn(df, known)
    assert set(got.stems) <= set(want) and all(abs(got.stems[s] - want[s]) < 1e-12 for s in got.stems) and got.stems


def test_everything_is_learned_from_a_hot_id(spark):
    rows, labels = corpus(60)
    rows += [(1, f"hot text {k}", "en", "a", 1) for k in range(300)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert T.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).curve is not None
