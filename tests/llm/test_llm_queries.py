"""The registered queries against their SQL, and the pipeline against plain versions."""

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from engagement.llm.queries import ORACLE, QUERIES
from engagement.llm.scratch import stored
from engagement.llm.shingle_join import distinct_documents, similar_documents


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "conversations"):
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_rows_as_sql(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    expected = duck.execute(ORACLE[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    got = [tuple(row) for row in df.select(*columns).collect()]
    assert ordered(got) == ordered(tuple(row[i] for i in places) for row in expected.fetchall())


def test_tokens_and_pieces_of_whole_tables(spark, folder):
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op1_token_counts"](spark, folder).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in rows} == {
        i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()
    }
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op3_sentence_pieces"](spark, folder).collect()
    assert {x["doc_id"]: pieces.decode(x["pieces"]) for x in rows} == texts


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [stored(docs)]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], folder)))
    raw, good, single, private, mixed, encoded = kept
    assert all(df.columns == columns for df in kept[:-1])
    predicted = {x["doc_id"]: x["predicted"] for x in QUERIES["op10_quality_classifier"](spark, folder).collect()}
    assert {x["doc_id"] for x in good.collect()} == {i for i, p in predicted.items() if p}
    groups = similar_documents(good, 5, 80).collect()
    assert sorted(x["doc_id"] for x in single.collect()) == sorted({x["component_id"] for x in groups})
    assert private.select("doc_id", "source").exceptAll(single.select("doc_id", "source")).isEmpty()
    assert private.count() == single.count()
    assert {tuple(x) for x in mixed.collect()} <= {tuple(x) for x in private.collect()}
    assert encoded.count() == mixed.count() and encoded.where("not lossless").isEmpty()
    assert corpus_pipeline.run(spark, folder).select(*columns).exceptAll(mixed).isEmpty()


DOCS = "doc_id long, text string, lang string, source string, n_chars long, sim__key string"
WORDS = " ".join(f"w{i}" for i in range(60))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)


def test_no_document_is_lost_by_its_id(spark, folder):
    other = WORDS.replace("w1", "v1").replace("w2", "v2").replace("w3", "v3")
    near = WORDS.replace("w59", "end")
    rows = [(7, WORDS), (7, other), (7, other), (3, near), (9, other + " more"), (None, WORDS), (None, WORDS), (4, None), (4, ""), (4, None), (5, "a b"), (6, "a b"), (8, WORDS)]
    found = corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), folder).collect()
    kept = sorted(((x["doc_id"], x["text"]) for x in found), key=str)
    # Of the texts like WORDS the one of id 3 stays, of those like the other one that of id 7.
    expected = [(3, near), (7, other), (None, WORDS), (None, WORDS), (4, None), (4, ""), (4, None), (5, "a b")]
    assert kept == sorted(expected, key=str)
    assert distinct_documents(docs_of(spark, [])).count() == 0
    assert distinct_documents(docs_of(spark, rows)).columns == [c.split(" ")[0] for c in DOCS.split(", ")]


def test_pipeline_stages_on_odd_rows(spark, folder):
    card = "Mail bob@mail.example.com now. "
    rows = [(1, card + WORDS), (1, card + WORDS), (1, "other " + WORDS[::-1]), (None, None), (None, ""), (2, None), (3, ""), (4, "\n" * 50), (5, "x" * 200_000), (6, "語" * 20_000)]
    for given in (rows, []):
        docs = docs_of(spark, given).drop("sim__key")
        stages = dict(corpus_pipeline.STAGES)
        good = stages["quality classifier"](spark, docs, folder)
        assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()
        private = stages["personal data"](spark, docs, folder)
        assert private.count() == len(given) and private.where("contains(text, 'bob@')").isEmpty()
        mixed = stages["source mixture"](spark, docs, folder)
        assert mixed.columns == docs.columns and mixed.distinct().exceptAll(docs.distinct()).isEmpty()
        pieces = stages["sentence pieces"](spark, docs, folder)
        assert pieces.count() == len(given) and pieces.where("not lossless and text is not null").isEmpty()
