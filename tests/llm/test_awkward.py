"""All operators on documents: columns that clash with theirs, long texts, and a pipeline without documents."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reachlens.llm import lm, media, packing, quality, simhash, suffix_dedup, token_counts, toxicity
from tests.llm import data

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that the operators use for their own columns.
CLASH = ("held_out", "score", "n_tokens", "n_bytes", "kept_sha256", "media", "width", "p_toxic", "is_toxic", "start", "sequence_id", "over_limit", "fp", "fingerprint", "component_id", "n_words", "kept", "_id", "_text", "_mix", "key", "node", "root")


def models(spark, docs):
    labels = data.labels(spark)
    return toxicity.fit(docs, labels), quality.fit(docs, labels)


OPERATORS = {
    "lm": lambda d, m: lm.score_texts(d), "suffix": lambda d, m: suffix_dedup.dedup(d), "media": lambda d, m: media.text_media(d), "toxicity": lambda d, m: toxicity.toxicity(d, m[0]),
    "packing": lambda d, m: packing.pack(d, BPE).groupBy("doc_id").agg(F.sum("length").alias("length"), F.max("doc_tokens").alias("doc_tokens")), "tokens": lambda d, m: token_counts.token_counts(d, PIECES),
    "simhash": lambda d, m: simhash.near_duplicates(d), "quality": lambda d, m: quality.quality_rules(d, m[1])}


@pytest.fixture(scope="module")
def fitted(spark):
    return models(spark, data.frame(spark))


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(spark, fitted, name):
    docs = data.frame(spark, data.rows(24))
    other = docs.withColumns({c: F.lit("clash") for c in CLASH})
    rows = lambda d: sorted(repr(tuple(r)) for r in OPERATORS[name](d, fitted).collect())
    assert rows(other) == rows(docs)


@pytest.mark.parametrize("name", OPERATORS)
def test_long_texts_are_whole(spark, fitted, name):
    """A text of 600 KB beside short ones: what can be told from the whole text alone agrees, and its copy gets the same."""
    long = " ".join(f"word{k % 977}.{k % 31}" for k in range(50_000)) + "\nthe last line"
    docs = spark.createDataFrame([(1, long, "en", "a", 1), (2, long, "en", "a", 1), (3, long + " and more", "en", "b", 1), (4, "short text", "en", "a", 1)], data.SCHEMA)
    got = {r.doc_id: r.asDict() for r in OPERATORS[name](docs, fitted).collect()}
    assert set(got) == {1, 2, 3, 4}
    if name != "suffix":  # the second copy's bytes go
        told = [{k: v for k, v in got[i].items() if k not in ("doc_id", "held_out")} for i in (1, 2)]
        assert told[0] == told[1]
    if name == "lm":
        assert got[1]["n_tokens"] == len(long.split()) + 1
    elif name == "suffix":
        assert (got[1]["n_removed"], got[2]["n_removed"]) == (0, len(long)) and 0 < len(long) + 9 - got[3]["n_removed"] <= 9
    elif name == "media":
        assert got[1]["n_bytes"] == len(long) and got[1]["payload_sha256"] == hashlib.sha256(media.padded(long.encode())).hexdigest()
    elif name == "packing":
        assert got[1]["length"] == got[1]["doc_tokens"] == 1 + len(Tokenizer.from_file(BPE).encode(long, add_special_tokens=False).ids)
    elif name == "tokens":
        assert got[1]["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(long)) and got[1]["over_limit"]
    elif name == "simhash":
        assert got[2]["component_id"] == 1 and got[1]["fingerprint"] == f"{simhash.fingerprint(long.encode()):016x}"
    elif name == "quality":
        assert got[1]["n_words"] == len(long.split()) and got[1]["word_chars"] == sum(map(len, long.split()))


def test_pipeline_without_documents(spark, tmp_path):
    import corpus_pipeline

    data.frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    data.labels(spark).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
