import random

from pyspark.sql import functions as F

from placeforge.llm import token_counts as T
from placeforge.llm import tokenizer as K

from .helpers import documents, empty, hard, hard_rows, words

VOCABULARY = open(K.VOCABULARY, "rb").read()
PIECES = ["a", "the", " ", "  ", "\n", " \n", "'", "'s", "l", "12", ".", " x", "é", "日本", "\t", "!!"]


def test_edits_equal_counting_anew():
    counts, plain, r = T.Counts(VOCABULARY), K.encoding(VOCABULARY).encode_ordinary, random.Random(1)
    for _ in range(400):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 400)))
        tree = T.Tree(text, counts)
        for _ in range(4):
            at, gone, new = r.randint(0, len(text)), r.choice([0, 1, 7, 60, 900]), "".join(r.choice(PIECES) for _ in range(r.randint(0, 9)))
            tree.edit(at, gone, new)
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text and tree.total == (len(text), len(T.SPLIT.findall(text)), len(plain(text)))


def test_only_the_edited_region_is_encoded():
    tree = T.Tree(words(1, 5000), T.Counts(VOCABULARY))
    tree.edit(10_000, 5, "new words")
    assert 0 < tree.encoded < 20


def test_encoder_is_exact():
    encoder, r = K.Encoder(VOCABULARY), random.Random(2)
    import numpy as np

    for _ in range(500):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(encoder.ids(text), encoder.type).tolist() == encoder.plain.encode_ordinary(text)


def test_hard_rows(spark):
    plain = K.encoding(VOCABULARY).encode_ordinary
    edits = F.array(F.struct(F.lit(3).alias("pos"), F.lit(2).alias("deleted"), F.lit(" in ").alias("inserted")), F.lit(None))
    rows = T.count_edits(hard(spark).withColumn("edits", F.when(F.col("doc_id") != 7, edits))).collect()
    assert len(rows) == len(hard_rows())
    want = []
    for i, t, *_ in hard_rows():
        t = t or ""
        changed = t if i in (7, None) else t[:3] + " in " + t[5:]
        want.append((i or 0, len(t), len(plain(t)), len(plain(changed))))
    assert sorted((r.doc_id or 0, r.n_chars, r.n_tokens, r.n_tokens_edited) for r in rows) == sorted(want)
    assert T.count_edits(empty(spark).withColumn("edits", edits)).collect() == []


def test_query(spark, tmp_path):
    documents(spark, [words(1, 200), None, "x"]).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in T.query(spark, str(tmp_path)).collect()) == [0, 1, 2]


def test_kept_trees(spark, tmp_path):
    """Trees written, read again and edited twice give the counts of the edited texts, and encode little."""
    long_ = words(21, 6000)
    texts = [long_, "", None, "a b", " x" * 90_000, "y" * 100_000]
    T.trees(documents(spark, texts)).write.parquet(f"{tmp_path}/trees")
    kept = spark.read.parquet(f"{tmp_path}/trees")
    edits = "array(struct(3 AS pos, 2 AS deleted, 'new word' AS inserted), null, struct(20 AS pos, 0 AS deleted, ' end' AS inserted))"
    once = T.edit_trees(kept.withColumn("edits", F.expr(edits)))
    once.write.parquet(f"{tmp_path}/once")
    twice = {r.doc_id: r for r in T.edit_trees(spark.read.parquet(f"{tmp_path}/once").withColumn("edits", F.expr(edits))).collect()}

    def changed(t):
        for pos, n, new in ((3, 2, "new word"), (20, 0, " end")):
            t = t[:pos] + new + t[pos + n :]
        return t

    want = [changed(changed(t or "")) for t in texts]
    fresh = {r.doc_id: r for r in T.trees(documents(spark, want)).collect()}
    for k, t in enumerate(want):
        assert "".join(leaf.text for leaf in twice[k].leaves) == t
        assert [twice[k][c] for c in ("n_chars", "n_pretokens", "n_tokens")] == [fresh[k][c] for c in ("n_chars", "n_pretokens", "n_tokens")]
    assert twice[0].n_encoded < 40 and T.trees(empty(spark)).collect() == []
