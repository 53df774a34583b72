"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import langid, matroska, packing, pieces, secrets, simhash, token_count, toxicity, urlfilter, vectors

LONG = "lorem ipsum " * 40_000
TEXTS = [(1, None, "en"), (2, "", "en"), (3, LONG, "en"), (4, "the cat sat on the mat here", "en"), (4, "the cat sat on the mat here", "en"), (None, "le chat est sur la table", "fr"), (6, "...!!! 123", None), (7, " \n\t", "de"), (8, "\U0001f600 \u6f22\u2581x", None)]
#: Names that operators use inside, as columns of the input.
CLASH = ["_id", "fp", "_t", "key", "route", "score", "_spans", "_bin", "length", "ids", "_p", "_d", "_k", "component", "text_", "start"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 0, "x"), (3, 1, "x"), (1, None, "x"), (None, 1, "x"), (8, 0, "x")], "doc_id long, toxic int, _id string")


OPERATORS = {
    "toxicity": lambda d, s: toxicity.score_documents(d, s.createDataFrame([(4, 0), (3, 1), (1, None), (8, 0)], "doc_id long, toxic int")),
    "token_count": lambda d, s: token_count.count_tokens(d),
    "pieces": lambda d, s: pieces.round_trip(d),
    "langid": lambda d, s: langid.identify(d),
    "simhash": lambda d, s: simhash.near_duplicates(d),
    "secrets": lambda d, s: secrets.scan(d),
    "matroska": lambda d, s: matroska.media_columns(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, docs, name):
    got = OPERATORS[name](docs, spark).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(t[0]) for t in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](docs.where("false"), spark).collect() == []


def test_packing(spark, docs):
    got = packing.pack_documents(docs).collect()
    for sequence in {r["sequence_id"] for r in got}:
        own = sorted((r for r in got if r["sequence_id"] == sequence), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert sum(r["length"] for r in own) <= packing.SEQUENCE
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 2 * next(r["doc_tokens"] for r in got if r["doc_id"] == 4)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack_documents(docs.where("false")).collect() == []


def test_defined_values(spark, docs, labels):
    empty = ("", None)
    text = {t[0]: t[1] for t in TEXTS}
    tokens = {r["doc_id"]: r for r in token_count.count_tokens(docs).collect()}
    assert all((tokens[k]["n_bytes"], tokens[k]["n_tokens"]) == (0, 0) for k in text if text[k] in empty)
    langs = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all((langs[k]["lang_pred"], langs[k]["score"]) == ("und", 0.0) for k in (1, 2, 6, 7))
    prints = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert prints[1]["fingerprint"] == "0" * 16 and {prints[k]["component_id"] for k in (1, 2, 7)} == {1}
    found = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and found[1]["spans"] == ""
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labels).collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert max(r["score"] for r in toxicity.score_documents(docs, labels.where("false")).collect()) < 1e-9
    assert all(r["lossless"] for r in pieces.round_trip(docs).collect())


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.NET/en/x?q#f"), (5, "x://net/"), (6, "x://net"), (7, "x://b.org/fr/"), (None, "http://example.com/de/"), (8, "http://ads.x/é" + "a" * 50_000), (8, "://")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("_j", F.lit(1))
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.filter_urls(df).where("page_id is null or page_id < 8").collect()}
    assert got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5][2:] == ("net/", "block") and got[6][2:] == (None, "allow") and got[7][2:] == ("org/fr/", "allow") and got[None][2:] == ("example.com/de/", "block")
    assert urlfilter.filter_urls(df.where("false")).collect() == []


def test_vectors(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 1), (2, [2.0, 0.1, 0.0], 1), (3, e, 2), (4, None, 1), (5, [0.0] * 3, 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, e, None), (None, e, 1), (1, e, 1), (9, [1e300, 0.0, 0.0], 1), (10, [1.0], 1), (11, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("_v", F.lit(1)).withColumn("component", F.lit(2))
    got = [tuple(r) for r in vectors.link_vectors(df).collect()]
    assert len(got) == len(rows)
    assert set(got) == {(1, 2, 1, True), (2, 2, 1, False), (9, 2, 1, False), (None, 0, None, True), *((k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 10, 11))}
    assert vectors.link_vectors(df.where("false")).collect() == []


def test_vectors_of_a_repeated_id(spark):
    e, f = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, e, 1), (1, [0.0] * 3, 1), (1, [-1.0, None, 0.0], 0), (2, e, 1), (3, e, 1), (3, [1.0, 0.01, 0.0], 1), (3, f, 2), (4, f, 2), (5, f, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in vectors.link_vectors(df).collect()]
    assert len(got) == len(rows)
    assert set(got) == {(1, 3, 1, True), (2, 3, 1, False), (3, 5, 1, False), (4, 1, 1, False), (5, 0, 5, True)}


def test_pipeline_stages(spark, tmp_path):
    documents = [(k, t, lang, "s", 0) for k, t, lang in TEXTS]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 0), (4, 0), (6, 0), (7, 0), (9, 0), (11, 0), (8, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs.withColumn("_spans", F.lit(1)), str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(str(tmp_path / f"out{k}"))
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_one_document_of_each_group_stays(spark, tmp_path):
    long = " ".join(f"word{k}" for k in range(200))
    cat = "the cat sat on the mat here while another dog slept under an old wooden table"
    rows = [(4, cat), (4, cat), (9, cat), (None, cat), (None, long), (None, long), (7, "entirely different words about ships and harbours in winter"), (7, "nothing alike: prices, tariffs, ledgers, invoices and receipts")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("4", cat), ("None", long), ("7", rows[6][1]), ("7", rows[7][1])])
