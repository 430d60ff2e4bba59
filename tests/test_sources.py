import json

from lexiprint.sources import readers, writers


def test_json_shapes(spark, tmp_path):
    one = {"sample_id": "a", "text": "x", "word_count": 1}
    (tmp_path / "list.json").write_text(json.dumps([one, one]))
    (tmp_path / "held.json").write_text(json.dumps({"samples": [one], "metadata": {}}))
    (tmp_path / "lines.jsonl").write_text(json.dumps(one) + "\nbroken\n")
    assert readers.samples(spark, str(tmp_path / "list.json")).count() == 2
    assert readers.samples(spark, str(tmp_path / "held.json")).first()["text"] == "x"
    assert readers.lines(spark, str(tmp_path / "lines.jsonl")).filter("text is not null").count() == 1


def test_archive_months_tables_and_texts(spark, tmp_path):
    for m in ("2021-01", "2021-02", "2022-05"):
        (tmp_path / f"RC_{m}.jsonl").write_text(json.dumps({"text": m}) + "\n")
    got = readers.archive(spark, str(tmp_path), "2021-02", "2021-12", "text string").collect()
    assert [r["text"] for r in got] == ["2021-02"]
    assert readers.archive(spark, str(tmp_path), "2030-01", "2030-02", "text string").count() == 0
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert readers.table(spark, str(tmp_path / "t.tsv"), "\t").first()["b"] == "2"
    (tmp_path / "x.xml").write_text("<rows><row><a>1</a></row><row><a>2</a></row></rows>")
    assert readers.rows_of_xml(spark, str(tmp_path / "x.xml")).count() == 2
    (tmp_path / "doc.txt").write_text("hello")
    assert readers.texts(spark, str(tmp_path / "doc.txt")).first()["text"] == "hello"
    assert readers.texts(spark, str(tmp_path / "doc.txt"), 10).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1, (2, "x")), ("m2", 2, (3, "y"))], "model string, id int, source struct<n: int, name: string>")
    assert writers.flattened(df, "source").columns == ["model", "id", "source_n", "source_name"]
    path = str(tmp_path / "fp")
    writers.fingerprints(df.drop("source"), path)
    writers.fingerprints(df.drop("source"), path)
    plan = spark.read.parquet(path).filter("model = 'm1'")
    assert plan.count() == 2 and "PartitionFilters: [isnotnull(model" in plan._jdf.queryExecution().executedPlan().toString()
    writers.audit(df, str(tmp_path / "audit"), "stored")
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    writers.corpus(df, str(tmp_path / "c"))
    writers.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "c")).count() == 2
