"""Corpus operators on repeated ids and other whole-table cases, against plain versions."""

from tallyspark.llm import jaccard_tree, license_scan

A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
REPEATED = [
    (5, A), (5, B), (3, B + " end"), (9, A + " end"), (5, ""), (7, "alone in the table it is"), (7, "alone in the table it is"), (3, B + " end"),
    (3, "another text of the third one"), (8, ""), (8, ""), (None, A), (None, A),
]


def test_texts_of_one_id_join_their_links(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    found = [(r["doc_id"], r["component_id"]) for r in jaccard_tree.jaccard_join(docs).collect()]
    assert len(found) == len(REPEATED)
    assert set(found) == {(5, 3), (3, 3), (9, 3), (7, 7), (8, 8), (None, None)}


def test_equal_rows_stay_once(spark):
    docs = spark.createDataFrame(REPEATED, "doc_id long, text string").repartition(3)
    kept = jaccard_tree.one_of_each(docs)
    assert kept.columns == docs.columns
    want = [(3, "another text of the third one"), (3, B + " end"), (7, "alone in the table it is"), (8, ""), (None, A), (None, A)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_one_version_is_reported(spark):
    gpl = "This work is licensed under the GNU General Public License, version {}."
    rows = [(i, "x " * i + gpl.format(2 + i % 2) + " y" * 30) for i in range(24)]
    rows += [(100, gpl.format(2) + " z" * 40 + " " + gpl.format(3)), (101, gpl.format(3) + " z" * 40 + " " + gpl.format("two"))]
    found = {(r["doc_id"], r["license"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {(i, f"gpl-{2 + i % 2}.0") for i in range(24)} | {(i, f"gpl-{v}.0") for i in (100, 101) for v in (2, 3)}
    assert found == want
