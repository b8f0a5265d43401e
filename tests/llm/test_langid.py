import random
import zlib

from placeforge.llm import langid as L

from .helpers import COLUMNS, empty, hard, hard_rows


def text(lang: str, seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = {"en": ["th", "er", "ing", "on", "the"], "de": ["sch", "ein", "ung", "ß", "ü"], "fr": ["eau", "que", "é", "oi", "ment"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark, tmp_path):
    rows = [(i, text(lang, i, 5 + i % 60), lang, "a", 1) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.query(spark, str(tmp_path)).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_profiles_match_a_plain_count(spark):
    ranks = L.Letters()
    sample = "Das ist ein Haus, das! 12 ß"
    counts = {}
    for w in ["das", "ist", "ein", "haus", "das", "ß"]:
        padded = f" {w} "
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if g != " " and not (k == 3 and g[1] == " "):
                    counts[g] = counts.get(g, 0) + 1
    codes, n = L.grams(ranks.codes(sample))

    def spell(code):
        out = ""
        while code:
            out, code = chr(code & (1 << 21) - 1) + out, code >> 21
        return out

    assert {spell(int(c)): int(k) for c, k in zip(codes, n, strict=True)} == counts


def test_hard_rows(spark):
    profiles = L.learn(hard(spark))
    rows = L.identify(hard(spark), profiles).collect()
    assert len(rows) == len(hard_rows())
    by = {r.doc_id: r for r in rows}
    assert sum(r.lang_pred == "und" for r in rows) == 5
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (4, 5, 6, 7))
    assert L.learn(empty(spark)) == {} and L.identify(empty(spark), {}).collect() == []
    assert {r.lang_pred for r in L.identify(hard(spark), {}).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify(hard(spark), {"en": profiles["en"]}).collect()} == {"und", "en"}


def test_distances_against_brute_force():
    """Rank by rank, without tables."""
    profiles, letters = {}, L.Letters()
    for lang in ("en", "de", "fr"):
        profiles[lang] = L.profile(*letters.counts(text(lang, 1, 400))).tolist()
    ranks = L.Ranks(profiles)
    for k in range(60):
        sample = text(["en", "de", "fr"][k % 3], 100 + k, 1 + k % 30)
        counts = dict(zip(*(x.tolist() for x in L.grams(letters.codes(sample))), strict=True))
        own = sorted(counts, key=lambda g: (-counts[g], g))[: L.TOP]
        far = {lang: sum(abs(p.index(g) - i) if g in p else L.TOP for i, g in enumerate(own)) for lang, p in profiles.items()}
        first, second = sorted(far, key=lambda lang: (far[lang], lang))[:2]
        assert ranks.predict(sample) == (first, (far[second] - far[first]) / far[second])


def test_counting_in_blocks():
    letters = L.Letters()
    for sample in ("Ein Haus, das  steht!! 12 ß", "  a", "a b", "x" * 50, "1 2 3", "", "\U00030000\U00031350 far letters", " , ,a, ,b"):
        whole = L.grams(letters.codes(sample))
        for block in (1, 2, 3, 7):
            assert [x.tolist() for x in letters.counts(sample, block)] == [x.tolist() for x in whole]
    assert len(letters.codes("\U00030000\U00031350")) == 4


def test_rare_languages_keep_their_rows(spark):
    rows = [(i, text("en", i, 9), "en", "a", 1) for i in range(900)] + [(None, text("fr", i, 9), "fr", "a", 1) for i in range(900)] + [(2001, text("de", 1, 30), "de", "a", 1)]
    made = L.learn(spark.createDataFrame(rows, COLUMNS), most=60)
    assert set(made) == {"en", "fr", "de"} and len(made["de"]) > 20 and len(made["fr"]) > 20
