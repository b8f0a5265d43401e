import corpus_pipeline as C
from placeforge.llm import decontam, mixing, packing, simhash, toxicity

from .helpers import CLASHING, COLUMNS, documents, hard, words
from .test_decontam import ITEM
from .test_toxicity import BAD, corpus


def test_stages_against_their_operators(spark, tmp_path):
    rows, labels = corpus(120)
    extra = [r[1] for r in rows[1:60:3]] + [words(500, 40) + " " + ITEM]
    texts = [r[1] for r in rows] + extra
    documents(spark, texts, sources=[f"s{k % 4}" for k in range(len(texts))]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in C.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns, name
        seen.append(sorted(r.doc_id for r in docs.collect()))
    copies = set(range(120, 140))
    toxic = {i for i, t in enumerate(texts) if any(b in t for b in BAD)}
    assert set(seen[0]) == set(range(len(texts))) - toxic
    assert not copies & set(seen[1]) - {140}
    assert set(seen[2]) == set(seen[1]) - {140} and 140 in seen[1]
    assert set(seen[3]) <= set(seen[2])
    packed = C.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(d for r in packed for d in r.doc_ids) == seen[3]
    assert sorted(d for r in C.run(spark, str(tmp_path)).collect() for d in r.doc_ids) == seen[3]
    assert [len(C.STAGES), C.ORACLE_SQL] == [5, None]
    assert all((toxicity, simhash, decontam, mixing, packing))


def test_hard_rows_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, own = hard(spark), [c for c in CLASHING if c not in COLUMNS]
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert all(r[c] == f"extra {c}" for r in docs.collect() for c in own)
    assert docs.count()
    assert C.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).collect() == []
