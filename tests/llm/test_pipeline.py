import corpus_pipeline
from data import words
from pyspark.sql import functions as F

from lexiprint.llm import mixing


def test_stages_on_planted_cases(spark, tmp_path):
    """Planted toxic documents, copies and leaks go; clean documents stay through every stage."""
    item = words(40, 7777)
    rows, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = words(60, i) + (" vilkgrub! snorbit " + words(5, i) if bad else "")
        rows.append((i, text, "en", f"src{i % 3}", len(text)))
        labels.append((i, int(i % 5 > 0), int(bad)))
    clean = {r[0] for r in rows if r[0] % 8}
    rows += [(5000 + i, rows[i][1], "en", "src0", 9) for i in range(1, 8)] + [(2000, f"{words(50, 990)} {item} {words(50, 991)}", "en", "src1", 9), (3000, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic, single, clear, mixed, out = seen
    assert len(toxic & {r[0] for r in rows if r[0] < 1200 and r[0] % 8 == 0}) <= 6 and len(clean - toxic) <= 10
    assert not single & set(range(5001, 5008)) and clean & toxic <= single
    assert 2000 in single and clear == single - {2000}
    assert mixed == clear == out
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {r[0] for r in run.select("doc_id").collect()} == out
    assert run.agg(F.sum("n_tokens")).first()[0] == run.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
    assert mixing.KEEPING >= 1
