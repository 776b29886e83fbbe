"""The stages of the corpus pipeline on nulls, repeated rows, repeated ids, empty tables, extra columns."""

import hashlib

import corpus_pipeline as cp
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
T = "one two three four five six seven eight nine ten"
U = "another text of quite different words that nothing else holds at all"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, i % 2, None if i == 5 else 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_near_duplicates_tell_rows_apart_by_id_and_text(spark, root):
    rows = [(5, T, "a"), (7, T, "a"), (7, U, "a"), (9, T, "b"), (9, T, "b"), (None, U, "a"), (1, None, "a"), (1, None, "a"), (2, "", None), (3, T + " eleven", "a")]
    got = cp.near_duplicates(spark, frame(spark, rows), root)
    assert got.columns == cp.COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(3, T + " eleven"), (7, U), (1, None), (1, None), (2, "")], key=str)


def test_lines_keep_every_document(spark, root):
    rows = [(1, f"{T}\n{U}", "a"), (2, f"{U}\nown", "a"), (None, T, "a"), (3, None, None), (4, "", "b")]
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.lines(spark, frame(spark, rows), root).collect()}
    assert got == {1: (f"{T}\n{U}", len(T) + len(U) + 1), 2: ("own", 3), None: ("", 0), 3: (None, None), 4: ("", 0)}


def test_toxic_without_both_classes_keeps_all(spark, root):
    rows = [(i, t, "a") for i, t in enumerate([T, U, None, "", T])] + [(None, T, None)]
    got = cp.toxic(spark, frame(spark, rows), root)
    assert got.columns == cp.COLUMNS and got.count() == 6


def test_mix_and_encode_of_odd_rows(spark, root):
    rows = [(1, T, "a"), (1, T, "a"), (2, None, "a"), (3, "", None), (None, U, None)]
    mixed = cp.mix(spark, frame(spark, rows), root)
    assert mixed.columns == cp.COLUMNS and mixed.where("text is not null and text <> ''").count() >= 2
    out = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in cp.encode(spark, frame(spark, rows), root).collect()}
    assert out[2] == out[3] == (0, hashlib.sha256(b"").hexdigest()) and out[1][1] == hashlib.sha256(T.encode()).hexdigest()


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=lambda f: f.__name__)
def test_empty_tables_and_extra_columns(spark, root, stage):
    empty = spark.createDataFrame([], SCHEMA)
    assert stage(spark, empty, root).count() == 0
    rows = frame(spark, [(i, f"{t} {i}", "a") for i, t in enumerate([T, U] * 2)]).selectExpr("*", "1 AS weight", "2 AS _gone", "3 AS size")
    assert "_gone" not in stage(spark, rows, root).columns
