"""Document fingerprints: canonical exact digest.

The canonical form is NFKC, case folding, NFKC again, runs of white space as one space, trimmed. Its
128-bit xxh3 hash is the digest. Within a digest that several documents share, canonical bytes are
compared: the least and the greatest form of each digest are found with partial aggregation and are equal
exactly if all forms are; where they differ, every further form gets a number after the digest, in byte
order. Two equal texts always get equal fingerprints.

Edited texts take part: whether one shares its digest with another form shows in a second, independent
hash of the form, and where any digest has two forms, documents and edited texts are numbered together by
their bytes.

Null texts count as empty. Null ids come last, repeated ids and rows are rows of their own, and a table of
one row is its own next. An empty table gives no rows. The likeness of two fingerprints is 1 or 0: an exact
digest knows no middle.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from tidemark.llm.common import map_rows, materialise

#: Repeated digests are sent to every executor up to so many; beyond, the join is dealt by digest.
SEND = 200_000


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes, bits: int = 128) -> str:
    return xxhash.xxh3_128_hexdigest(form)[: bits // 4]


def with_digest(docs: DataFrame, bits: int = 128, form: bool = False) -> DataFrame:
    """doc_id, digest and, if asked for, the canonical form of every row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.StringType()), *([T.StructField("form", T.BinaryType())] if form else [])])

    def make():
        def work(cols: dict) -> dict:
            forms = [canonical(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "digest": [digest(f, bits) for f in forms], "form": forms}

        return work

    return map_rows(docs.select("doc_id", "text"), make, schema)


def unequal(docs: DataFrame, repeated: DataFrame, bits: int = 128) -> DataFrame:
    """digest of the repeated ones under which the documents' canonical bytes differ."""
    few = repeated.count() <= SEND
    forms = with_digest(docs, bits, form=True).drop("doc_id").join(F.broadcast(repeated) if few else repeated, "digest")
    return forms.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("digest")


def numbered(forms: DataFrame, digests: DataFrame) -> DataFrame:
    """digest, form, number (from 1) of each form (digest, form) that shares its digest with a lesser one."""
    distinct = forms.join(digests, "digest").distinct()
    ranked = distinct.withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)
    return ranked.where("number > 0")


def clashes(docs: DataFrame, bits: int = 128) -> DataFrame:
    """digest, form, number of each canonical form of a document that shares its digest with a lesser one."""
    repeated = materialise(with_digest(docs, bits).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "repeated")
    differing = materialise(unequal(docs, repeated, bits), "unequal")
    if differing.isEmpty():
        return docs.sparkSession.createDataFrame([], "digest string, form binary, number int")
    return numbered(with_digest(docs, bits, form=True).drop("doc_id"), differing)


def marked(digest_of: str, number: str) -> Column:
    return F.concat(digest_of, F.coalesce(F.concat(F.lit("-"), F.col(number).cast("string")), F.lit("")))


def fingerprints(docs: DataFrame, bits: int = 128) -> DataFrame:
    """doc_id and fingerprint of every row: equal exactly where the canonical forms are equal bytes."""
    further = clashes(docs, bits)
    if further.isEmpty():
        return with_digest(docs, bits).withColumnRenamed("digest", "fingerprint")
    joined = with_digest(docs, bits, form=True).join(further, ["digest", "form"], "left")
    return joined.select("doc_id", marked("digest", "number").alias("fingerprint"))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = {
    "part": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "proof": pa.int64(), "edited_proof": pa.int64(), "form": pa.binary(), "edited_form": pa.binary(), "text": pa.string(),
}
OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
WHOLE, FIRST, LAST = 0, 1, 2


class Marks:
    """A text with its canonical form, digest and second hash."""

    __slots__ = ("text", "form", "digest", "proof")

    def __init__(self, text: str, bits: int):
        self.text, self.form = text, canonical(text)
        self.digest, self.proof = digest(self.form, bits), xxhash.xxh3_64_intdigest(self.form, 1) - (1 << 63)


def compare(one: Marks, following: Marks, bits: int, forms: bool) -> dict:
    edited = Marks(edited_text(one.text, following.text), bits)
    return {
        "kind": WHOLE, "n_chars": len(one.text), "edited_sha256": hashlib.sha256(edited.text.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": one.digest,
        "edited_fingerprint": edited.digest, "near_edited": float(one.form == edited.form), "near_next": float(one.form == following.form), "proof": one.proof,
        "edited_proof": edited.proof, **({"form": one.form, "edited_form": edited.form} if forms else {}),
    }


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in FIELDS.items()], names=list(FIELDS))


def against_next(docs: DataFrame, bits: int = 128, forms: bool = False) -> DataFrame:
    """Each document beside its edited text and the next document, in descending doc_id (ties by text hash).

    Documents are range-partitioned and sorted; neighbours meet while a task reads its rows. Only the first
    and the last text of each partition are kept aside, to pair partitions with one another.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order[1].alias("h"), order[2].alias("i"))
    dealt = keyed.repartitionByRange(F.col("doc_id").desc_nulls_last(), "h", "i").sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "h", "i").select("doc_id", "text")
    schema = T.StructType([T.StructField(n, from_arrow_type(t)) for n, t in FIELDS.items()])

    def run(batches):
        part, held, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                now = Marks(text, bits)
                if held is None:
                    rows.append({"part": part, "kind": FIRST, "doc_id": key, "text": text})
                else:
                    rows.append({"part": part, "doc_id": last, **compare(held, now, bits, forms)})
                held, last = now, key
            yield packed(rows)
        if held is not None:
            yield packed([{"part": part, "kind": LAST, "doc_id": last, "text": held.text}])

    rows = materialise(dealt.mapInArrow(run, schema), "neighbours")
    ends = rows.where(F.col("kind") == LAST).select("part", "doc_id", "text")
    parts = ends.select("part")
    # one number a partition: the next partition that has rows, or the first of all
    following = parts.withColumn("next", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(1)))))
    firsts = rows.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))
    pairs = ends.join(following, "part").join(firsts, "next").select("doc_id", "text", "following")

    def close(batches):
        for batch in batches:
            yield packed([{"doc_id": k, **compare(Marks(t, bits), Marks(f, bits), bits, forms)} for k, t, f in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "following")))])

    return rows.where(F.col("kind") == WHOLE).unionByName(pairs.mapInArrow(close, schema)).drop("part", "kind", "text")


def compared(docs: DataFrame, bits: int = 128) -> DataFrame:
    """`against_next`, with the fingerprints of forms that share a digest told apart."""
    rows = materialise(against_next(docs, bits), "compared")
    marks = rows.select(F.col("fingerprint").alias("digest"), "proof").unionByName(rows.select(F.col("edited_fingerprint").alias("digest"), F.col("edited_proof").alias("proof")))
    met = materialise(marks.groupBy("digest").agg(F.count("*").alias("n"), (F.min("proof") < F.max("proof")).alias("differ")).where("n > 1").select("digest", "differ"), "repeated")
    differing = met.where("differ").select("digest").unionByName(unequal(docs, met.where("not differ").select("digest"), bits))
    differing = materialise(differing, "unequal")
    if differing.isEmpty():
        return rows.select(OUT)
    rows = materialise(against_next(docs, bits, forms=True), "compared")
    own = rows.select(F.col("fingerprint").alias("digest"), "form")
    edited = rows.select(F.col("edited_fingerprint").alias("digest"), F.col("edited_form").alias("form"))
    further = materialise(numbered(own.unionByName(edited), differing), "numbers")
    for name, form in (("fingerprint", "form"), ("edited_fingerprint", "edited_form")):
        found = further.select(F.col("digest").alias(name), F.col("form").alias(form), F.col("number").alias("__number"))
        rows = rows.join(found, [name, form], "left").withColumn(name, marked(name, "__number")).drop("__number")
    return rows.select(OUT)
