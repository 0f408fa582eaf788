"""The registered queries: DuckDB where SQL can express them, and the pipeline against its stages by hand."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillgraph.llm import queries


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, data, db, name):
    df = entry.queries()[name](spark, data)
    cursor = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    """Toxic documents, texts in no language and all copies but one go; everything else reaches the tokens."""
    words = lambda i, stem: " ".join(f"{stem}{random.Random(i * 100 + j).randrange(997)}" for j in range(40))
    clean = [(i, f"plain {words(i, 'w')}.", "en", "a", 1) for i in range(0, 120)]
    french = [(i, f"le texte {words(i, 'mot')}.", "fr", "b", 1) for i in range(200, 240)]
    toxic = [(i, f"you idiot {words(i, 'w')}.", "en", "a", 1) for i in range(300, 360)]
    copies = [(400 + i, clean[3][1], "en", "c", 1) for i in range(30)]
    odd = [(500, None, "en", "c", 1), (501, "", None, "c", 1), (502, "123 456", "en", None, None)]
    rows = clean + french + toxic + copies + odd
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, int(r in toxic)) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == (columns if name != "bpe" else ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    ids = lambda part: {r[0] for r in part}
    assert set(kept["toxicity"]) == ids(rows) - ids(toxic)
    assert set(kept["language_id"]) == ids(clean + french + copies)
    assert sorted(kept["simhash_near_dedup"]) == sorted(ids(clean + french))
    assert set(kept["mixing"]) == ids(clean + french) and len(kept["mixing"]) > len(clean + french)
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])


def test_near_dedup_keeps_rows_that_share_an_id_but_no_text(spark):
    words = lambda stem: " ".join(f"{stem}{j}" for j in range(50))
    rows = [(1, words("a"), "en"), (1, words("b"), "en"), (1, words("b"), "fr"), (1, words("b") + " x", "en"), (2, words("a"), "en"), (2, words("c"), "en"), (None, words("a"), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {tuple(sorted(((r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), "").collect()), key=repr)) for n in (1, 4)}
    assert len(seen) == 1
    got = list(seen.pop())
    assert len(got) == 4 and {rows[0], rows[5], rows[6]} < set(got) and sum(t.startswith("b0") for _, t, _ in got) == 1


def test_language_stage_drops_texts_near_chance_and_keeps_clean_ones(spark):
    """Texts of either language stay; one whose positions are split between both goes, as does one without letters."""
    words = lambda i, stem: " ".join(f"{stem}{'abcdefghij'[random.Random(i * 100 + j).randrange(10)]}" for j in range(40))
    clean = [(i, words(i, "the w") if i % 2 else words(i, "le mot"), "en" if i % 2 else "fr") for i in range(200)]
    split = [(300 + i, " ".join(x for j in range(60) for x in (words(j, "the w"), words(j, "le mot"))), None) for i in range(3)]
    docs = spark.createDataFrame(clean + split + [(400, "12 34", "en")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.drop_unknown_language(spark, docs, "").collect()}
    assert kept == {r[0] for r in clean}
    assert corpus_pipeline.least_language_score(4) == pytest.approx(0.4) and corpus_pipeline.least_language_score(1) == 0.0


def test_pipeline_of_empty_and_odd_tables(spark, tmp_path):
    """Empty tables, null columns, repeated ids and rows, and names that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, row int, component string, rate double, p int"
    words = " ".join(f"word{j}" for j in "abcdefghij" for _ in range(5))
    rows = [(i, f"{words} {'abcdefgh'[i % 8] * 5} {i}", "en", None, None, 1.5, "x", 1, "c", 2.5, 7) for i in range(40)]
    rows += [(1, words + " another text with the same id", "en", None, 3, None, None, None, None, None, None), rows[2], rows[2], (None, None, None, None, None, None, None, None, None, None, None), (None, "no id " + words, None, None, None, None, None, None, None, None, None)]
    for name, some in (("empty", []), ("odd", rows)):
        folder = str(tmp_path / name)
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for stage_name, stage in corpus_pipeline.STAGES[:4]:
            stage(spark, docs, folder).write.parquet(f"{folder}/{stage_name}")
            docs = spark.read.parquet(f"{folder}/{stage_name}")
            assert docs.columns == columns
        out = corpus_pipeline.run(spark, folder)
        assert (out.count() > 0) == bool(some)
        if some:
            assert {r.score for r in docs.where("doc_id = 5").collect()} <= {1.5}
            assert docs.where("doc_id is null and text is not null").count() >= 1
