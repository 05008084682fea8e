"""The pipeline's stages on a small corpus, each against a plain version of its own input."""

import corpus_pipeline
from tests.llm.test_texts import brute_components

GOOD = ["the", "that", "with", "thing", "other", "stand", "hand", "ation", "would", "river", "stone", "light"]


def prose(i):
    return " ".join(GOOD[(i * 5 + k * k + k * i) % len(GOOD)] + ("" if k % 3 else str(i)) for k in range(60))


def test_stages(spark, tmp_path):
    rows = []
    for i in range(200):
        text = prose(i)
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 5 == 0:
            text += " you rotter and wretch"
        rows.append((i, text, "en", "s", len(text), int(i % 4 != 0), int(i % 5 == 0)))
    rows += [(1000 + i, prose(i) + " extra", "en", "s", 1, None, None) for i in range(0, 60, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality int, toxic int")
    df.drop("quality", "toxic").write.parquet(f"{tmp_path}/documents.parquet")
    df.filter("quality IS NOT NULL").select("doc_id", "quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").distinct().collect()}
    before, after = map(ids, seen["toxicity"])
    assert {i for i in before - after if i < 1000} == {i for i in before if i < 1000 and i % 5 == 0}
    before, after = map(ids, seen["quality"])
    assert {i for i in before - after if i < 1000} == {i for i in before if i < 1000 and i % 4 == 0} and {i for i in after if i >= 1000}
    before, after = seen["near_copies"]
    _, label, _ = brute_components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == {i for i in label if label[i] == i} and len(ids(after)) < before.count()
    before, pieces = seen["packing"]
    assert ids(pieces) == ids(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, no labels, and columns with the operators' own names."""
    long = " ".join(f"{w}{i}" for i, w in enumerate(GOOD * 900))
    rows = [(None, prose(1)), (None, None), (1, None), (2, ""), (3, "  \n"), (4, long), (5, prose(5)), (5, prose(5)), (6, prose(5)), (6, "another text of the sixth one here"), (7, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, "en", None, None, "c", 1, 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, cls string, row int, score double")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        kept[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    # Without labels nothing is toxic and every score of quality is one half, which stays; of copies the smallest id stays, once.
    assert kept["toxicity"] == kept["quality"] == sorted(rows, key=str)
    assert kept["near_copies"] == sorted([r for i, r in enumerate(rows) if i not in (7, 8, 9)], key=str)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {None, 1, 2, 3, 4, 5, 7}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
