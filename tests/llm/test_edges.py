"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprint, langid, minhash, packing, pii, sharding, tokencount, topk, wrappers
from tidemark.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a", "same text here", "same text here", "Same  TEXT\nhere", "😀́" * 3, "x" * 100_000, "word " * 60_000, "İİ <b>&amp;</b>", "4111 1111 1111 1111", "\x1c\x1d tab\t"]
#: Names that the operators use inside or add.
CLASHES = ["key", "node", "band", "bands", "rep", "host", "rule", "wrapper", "digest", "form", "proof", "part", "kind", "number", "length", "__order", "lang_pred", "score", "shared", "held_out", "__shard", "__bucket", "__place", "ids", "decoded", "file", "doc_no", "row", "v", "b", "q", "n_replaced", "sequence_id"]


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).repartition(3)


def profiles():
    return {"en": langid.top(*langid.gram_counts("the cat and the dog")).tolist(), "de": langid.top(*langid.gram_counts("der Hund und die Katze")).tolist()}


OPERATORS = {
    "op1": lambda d: minhash.near_duplicates(d),
    "op1 keep": lambda d: minhash.keep_first(d),
    "op2": lambda d: pii.pseudonymise(d, b"k"),
    "op3": lambda d: wrappers.main_text(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumn("url", F.when(F.col("page_id") != 3, F.lit("http://h.example/x")))),
    "op4": lambda d: fingerprint.compared(d),
    "op5": lambda d: packing.pack_documents(d, tokenizer_path(), ids=True),
    "op6": lambda d: langid.predict(d, profiles()),
    "op7": lambda d: sharding.placed(d),
    "op7 whole": lambda d: sharding.external_shuffle(d),
    "op8": lambda d: bpe.round_trip_digests(d, tokenizer_path()),
    "op8 ids": lambda d: bpe.encode_documents(d, tokenizer_path()),
    "op10": lambda d: tokencount.document_token_counts(d, tokenizer_path(), 49407, block_bytes=4096),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_documents_of_all_kinds(spark, name):
    rows = [(None if i % 5 == 4 else i // 2, t, None if i % 3 else "en") for i, t in enumerate(TEXTS)]
    rows += rows[:4]
    got = OPERATORS[name](documents(spark, rows))
    n = got.count()
    if name == "op1 keep":
        assert n == len({tuple(minhash.words_of(t)) for _, t, _ in rows})
    elif name == "op5":
        assert got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").distinct().count() == n >= len(rows)
    else:
        assert n == len(rows)
    if name in ("op2", "op6", "op7 whole", "op8 ids"):  # other columns pass as they are
        kept = set(CLASHES) - {"n_replaced", "lang_pred", "score", "ids", "decoded", "__shard", "__bucket", "__place"}
        assert all(r[c] == f"mine {c}" for r in got.select(*sorted(kept)).collect() for c in kept)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_but_nulls(spark, name):
    assert OPERATORS[name](documents(spark, [(None, None, None)] * 3)).count() == (1 if name == "op1 keep" else 3)


def test_vectors_of_all_kinds(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (2, None), (3, []), (50, [1.0]), (100, [float("nan"), 1.0]), (150, [1.0, None]), (200, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("row", "score", "rank", "size", "b", "q", "v", "query_id")})
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors).collect())
    both = [(0, 1, 0, 5 * 65_536), (0, 2, 1, 5 * 65_536), (0, 3, 200, 0)]
    assert got == sorted([*both, *both, (200, 1, 0, 0), (200, 2, 0, 0), (200, 3, 1, 0)])
    assert topk.top_k(vectors.limit(0)).count() == 0
