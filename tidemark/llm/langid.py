"""Language identification by rank-order profiles.

A profile lists the most frequent 1- to 3-grams of letters and word edges, most frequent first. A
document's own profile is compared to each language's by the out-of-place distance: the sum over its
n-grams of how far the two ranks lie apart, or the profile length where the language lacks the n-gram.
The nearest language is predicted.

Null texts and texts without a letter get `und` with score 0. A text whose n-grams no profile holds gets
the first language in name order with score 0. Ties, whose score is 0 as well, go to the first language in name order. Very long
texts are counted in blocks, with the same counts as in one. An empty training set makes every prediction
`und`. Repeated rows and ids are fine. A null doc_id counts as the empty text where held-out documents are
told apart.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import lean, map_rows, materialise

#: n-grams of a profile; training documents of each language, about, at most; characters counted at a time.
PROFILE, TRAIN_DOCS, BLOCK = 400, 1000, 1 << 20
#: Languages there may be: their counts and profiles are sent to every executor.
MANY_LANGUAGES = 10_000
#: Code points with a case or letter property of interest; those beyond count as themselves.
KNOWN = 0x30000

_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Each code point's lower-case letter, or a space for what is no letter; built once a worker."""
    if not _fold:
        table = np.full(KNOWN, 32, np.uint32)
        for x in range(KNOWN):
            c = chr(x)
            if c.isalpha():
                low = c.lower()
                table[x] = ord(low) if len(low) == 1 else x
            elif unicodedata.category(c) == "Mn":
                table[x] = x
        _fold.append(table)
    return _fold[0]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def folded(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The text's letters with runs of anything else as one space, block by block; each block after the two code
    points before it, with how many of its first are those."""
    table, carry, n = fold_table(), np.array([32], np.int64), max(1, len(text))
    for at in range(0, n, BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(codes < KNOWN, table[np.minimum(codes, KNOWN - 1)], 32).astype(np.int64)
        codes = np.concatenate((carry, codes, np.full(int(at + BLOCK >= n), 32, np.int64)))
        space = codes == 32
        again = space & np.concatenate(([False], space[:-1]))
        again[: len(carry)] = False
        codes = codes[~again]
        yield codes, len(carry)
        carry = codes[-2:]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All 1- to 3-grams of a text, packed with 21 bits a character, and how often each occurs."""
    keys, counts = [], []
    for codes, old in folded(text):
        one = codes[old:]
        two = (codes[:-1] << 21 | codes[1:])[max(0, old - 1) :]
        three = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[max(0, old - 2) :]
        key, count = np.unique(np.concatenate((one[one != 32], two, three)), return_counts=True)
        keys.append(key)
        counts.append(count)
    if len(keys) == 1:
        return keys[0], counts[0]
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent keys, by count and then key."""
    if len(keys) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:most]


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, most: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from rows with text and lang.

    A language with more than `train_docs` documents is fitted on about that many, drawn row by row: equal
    texts are drawn apart. The result is a few hundred numbers a language; more than MANY_LANGUAGES values of
    `lang` are an error.
    """
    rows = labelled.where("text is not null and lang is not null")
    totals = materialise(rows.groupBy("lang").agg(F.count("*").alias("total")), "totals")
    if totals.count() > MANY_LANGUAGES:
        raise ValueError(f"more than {MANY_LANGUAGES} languages")
    share = F.pmod(F.xxhash64("text", F.monotonically_increasing_id(), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = rows.select("lang", "text", share.alias("share"))
    sample = drawn.join(F.broadcast(totals), "lang").where(F.col("share") * F.col("total") < train_docs)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def make():
        def work(cols: dict) -> dict:
            by: dict[str, list] = {}
            for lang, text in zip(cols["lang"], cols["text"]):
                by.setdefault(lang, []).append(gram_counts(text))
            out: dict = {"lang": [], "gram": [], "n": []}
            for lang, found in by.items():
                key, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                out["lang"] += [lang] * len(key)
                out["gram"] += key.tolist()
                out["n"] += np.bincount(at, np.concatenate([c for _, c in found])).astype(np.int64).tolist()
            return out

        return work

    grams = map_rows(sample.select("lang", "text"), make, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = grams.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("lang", "rank", "gram")
    profiles: dict[str, list[int]] = {}
    for row in sorted(best.collect()):
        profiles.setdefault(row.lang, []).append(row.gram)
    return profiles


def any_letter(column: str) -> Column:
    """Whether the text of a column has a letter, as has_letter tells, up to letters newer than one side's tables."""
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


class Judge:
    """Compares documents to the profiles."""

    def __init__(self, profiles: dict[str, list[int]], most: int = PROFILE):
        self.names, self.most, self.sides = sorted(profiles), most, []
        for name in self.names:
            keys = np.array(profiles[name], np.int64)
            order = np.argsort(keys)
            self.sides.append((keys[order], order))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 minus the nearest distance over the runner-up's, 0 where they tie or nothing was in common."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the text shares an n-gram with a profile."""
        if not self.names or not has_letter(text):
            return "und", 0.0, False
        grams = top(*gram_counts(text), self.most)
        ranks = np.arange(len(grams))
        distances = []
        for keys, order in self.sides:
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            distances.append(int(np.where(keys[at] == grams, np.abs(order[at] - ranks), self.most).sum()))
        near = int(np.argmin(distances))
        worst = self.most * len(grams)
        rest = min([d for i, d in enumerate(distances) if i != near], default=worst)
        return self.names[near], float(1 - distances[near] / rest) if rest else 0.0, distances[near] < worst


def predict(docs: DataFrame, profiles: dict[str, list[int]], shared: bool = False) -> DataFrame:
    """Add lang_pred and score, and shared on demand, from the text alone; columns of those names are replaced."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shared", T.BooleanType())][: 2 + shared]
    clash = {f.name for f in added} & set(docs.columns)
    schema = T.StructType([*docs.drop(*clash).schema.fields, *added])
    packed = json.dumps(profiles)

    def run(batches):
        judge = Judge(json.loads(packed))
        for batch in batches:
            found = [judge.judge(t) for t in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n not in clash]
            new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_())[: len(added)])]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new], names=[*kept, *(f.name for f in added)])

    return docs.mapInArrow(lean(run), schema)


def held_out() -> Column:
    """Documents that no profile may learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
