"""Phrase operators: neighbours, partials, swaps, splits, schedules, word cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.sampling import numbered, ranked
from tidemark.sources.tables import order_key, share


def words(text: Column) -> Column:
    """Lower case, split at white space, without edge punctuation."""
    return F.filter(F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.btrim(w, F.lit(",.!?"))), lambda w: w != "")


def vocabulary(texts: DataFrame, column: str = "text", pattern: str = "^[a-z]+$") -> DataFrame:
    """word of all distinct words of letters: tokens are made distinct, on the map side first, before any is looked at."""
    tokens = texts.select(F.explode(F.split(F.lower(F.col(column)), r"\s+")).alias("token")).distinct()
    return tokens.select(F.btrim("token", F.lit(",.!?")).alias("word")).where(F.col("word").rlike(pattern)).distinct()


def deletions(words_: DataFrame, column: str, distance: int = 1) -> DataFrame:
    """column, form: each word and all forms of it with up to `distance` characters left out.

    One character goes at a time, from left to right, as rows and not as arrays, so that all is compiled.
    """
    rows = words_.select(F.col(column), F.col(column).alias("form"), F.lit(0).alias("from"))
    out = rows
    for _ in range(distance):
        cut = rows.where(F.col("from") < F.length("form")).select(column, "form", F.explode(F.sequence(F.col("from"), F.length("form") - 1)).alias("from"))
        rows = cut.select(column, F.concat(F.substring(F.col("form"), F.lit(1), F.col("from")), F.substring(F.col("form"), F.col("from") + 2, F.length("form"))).alias("form"), "from")
        out = out.unionByName(rows)
    return out.select(column, "form")


#: Words up to this length meet on forms with characters left out, longer ones on pieces.
SHORT = 8


def pieces(word: Column, length: Column, parts: int) -> Column:
    """The word cut into `parts` pieces of nearly equal length: number and text."""
    size, longer = F.floor(length / parts), F.pmod(length, F.lit(parts))
    start = lambda i: i * size + F.greatest(F.lit(0), i - (parts - longer))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("part"), F.substring(word, (start(i) + 1).cast("int"), (start(i + 1) - start(i)).cast("int")).alias("text")))


def neighbours(left: DataFrame, right: DataFrame, distance: int = 1) -> DataFrame:
    """word, neighbour, distance: words of the two lists within an edit distance of 1 to `distance`.

    Two short words that close share a form with as many characters left out. Of a longer word cut into
    distance + 1 pieces, one piece stands unchanged in every word that close, shifted by the distance at most.
    Either way the join has an equality key, no word meets words that are far from it, and a word gives a
    number of keys that does not depend on its length.
    """
    near, d = F.col("neighbour"), distance
    right = right.select(F.col("word").alias("neighbour"))
    short = max(SHORT, d + 1)
    a = deletions(left.where(F.length("word") <= short + d), "word", d)
    b = deletions(right.where(F.length(near) <= short), "neighbour", d)
    met = a.join(b, "form").select("word", "neighbour")
    cut = right.where(F.length(near) > short).select("neighbour", F.length(near).alias("n"), F.explode(pieces(near, F.length(near), d + 1)).alias("p")).select("neighbour", "n", "p.part", "p.text")
    n, parts = F.col("n"), d + 1
    probe = left.where(F.length("word") > short - d).select("word", F.explode(F.sequence(F.greatest(F.lit(short + 1), F.length("word") - d), F.length("word") + d)).alias("n"))
    probe = probe.select("word", "n", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("part"), F.floor(n / parts).alias("size"), F.pmod(n, F.lit(parts)).alias("longer"))
    start = F.col("part") * F.col("size") + F.greatest(F.lit(0), F.col("part") - (parts - F.col("longer")))
    long = F.col("size") + F.when(F.col("part") >= parts - F.col("longer"), 1).otherwise(0)
    probe = probe.select("word", "n", "part", start.alias("start"), long.alias("long"))
    probe = probe.select("word", "n", "part", "long", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.col("start") - d), F.col("start") + d)).alias("at")).where(F.col("at") + F.col("long") <= F.length("word"))
    probe = probe.select("word", "n", "part", F.substring(F.col("word"), (F.col("at") + 1).cast("int"), F.col("long").cast("int")).alias("text"))
    met = met.unionByName(probe.join(cut, ["n", "part", "text"]).select("word", "neighbour")).where("word <> neighbour").distinct()
    return met.withColumn("distance", F.levenshtein("word", "neighbour", distance)).where(F.col("distance").between(1, distance))


#: One character for each phoneme there may be: a stretch of the Han block, where all are letters of one code unit.
SYMBOLS = "".join(chr(0x4E00 + i) for i in range(512))


def spelled_phones(phones: Column, inventory: Column) -> Column:
    """Phonemes without stress as a text of one character each, by their place in the sorted inventory."""
    return F.array_join(F.transform(strip_stress(phones), lambda p: F.substring(F.lit(SYMBOLS), F.array_position(inventory, p).cast("int"), F.lit(1))), "")


def pronounced(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, sound, n: the dictionary's words among `words`, their phonemes as one text and their number."""
    inventory = dictionary.select(F.explode(strip_stress(F.col("phones"))).alias("p")).agg(F.array_sort(F.collect_set("p")).alias("inventory"))
    checked = inventory.select(F.when(F.size("inventory") <= len(SYMBOLS), F.col("inventory")).alias("inventory"))  # one row; beyond, no word has a sound
    known = dictionary.join(words.select("word").distinct(), "word", "left_semi").where(F.size("phones") > 0)
    return known.join(F.broadcast(checked)).select("word", spelled_phones(F.col("phones"), F.col("inventory")).alias("sound"), F.size("phones").alias("n")).where("sound is not null")


def phonetic_neighbours(words: DataFrame, dictionary: DataFrame, distance: int | None = None, least: int = 3) -> DataFrame:
    """word, neighbour, distance: dictionary words 1 to `distance` phoneme edits away; stress does not count.

    Without a distance it is 1 for words under five phonemes and 2 for others. Words of fewer than `least`
    phonemes have none; homophones, the word itself and one-letter words are left out.
    """
    own = pronounced(words, dictionary).where(F.col("n") >= least)
    every = pronounced(dictionary, dictionary)
    far = distance or 2
    sounds = neighbours(own.select(F.col("sound").alias("word")).distinct(), every.select(F.col("sound").alias("word")).distinct(), far)
    near = every.select(F.col("word").alias("neighbour"), F.col("sound").alias("other"))
    met = own.join(sounds.withColumnRenamed("word", "sound").withColumnRenamed("neighbour", "other"), "sound").join(near, "other")
    allowed = F.lit(distance) if distance else F.when(F.col("n") < 5, 1).otherwise(2)
    return met.where((F.col("distance") <= allowed) & (F.col("word") != F.col("neighbour")) & (F.length("neighbour") >= 2)).select("word", "neighbour", "distance")


def sound_alike(words: DataFrame, other: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, neighbour of the two lists that are homophones or one phoneme apart."""
    a, b = pronounced(words, dictionary), pronounced(other, dictionary)
    right = b.select(F.col("word").alias("neighbour"), F.col("sound").alias("other"))
    near = neighbours(a.select(F.col("sound").alias("word")).distinct(), b.select(F.col("sound").alias("word")).distinct(), 1).select(F.col("word").alias("sound"), F.col("neighbour").alias("other"))
    same = a.select("sound", F.col("sound").alias("other")).distinct()
    return a.join(near.unionByName(same), "sound").join(right, "other").select("word", "neighbour").distinct()


def common_words(texts: DataFrame, column: str, n: int, pattern: str = "^[a-z]+$") -> DataFrame:
    """The n most frequent words, ties in order of the alphabet: a table of words to swap in."""
    every = texts.select(F.explode(words(F.col(column))).alias("word")).where(F.col("word").rlike(pattern))
    return every.groupBy("word").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "word").limit(n).select("word")


def word_swaps(phrases: DataFrame, vocabulary: DataFrame, dictionary: DataFrame) -> DataFrame:
    """phrase, variant: each word in turn by every word of a fixed list, but for words that sound alike and for the phrases themselves."""
    placed = phrases.select("phrase", words(F.col("phrase")).alias("tokens")).select("phrase", "tokens", F.posexplode("tokens").alias("at", "word"))
    swap = vocabulary.select(F.col("word").alias("swap")).distinct()
    alike = sound_alike(placed.select("word").distinct(), vocabulary, dictionary).withColumnRenamed("neighbour", "swap")
    pairs = placed.select("word").distinct().join(F.broadcast(swap)).where("word <> swap").join(alike, ["word", "swap"], "left_anti")  # a list of fixed length
    made = placed.join(pairs, "word").select("phrase", F.array_join(substitute(F.col("tokens"), F.col("at"), F.col("swap")), " ").alias("variant"))
    own = phrases.select(F.array_join(words(F.col("phrase")), " ").alias("variant"))
    return made.join(own, "variant", "left_anti").select("phrase", "variant").distinct()


def expanded(phrases: DataFrame, dictionary: DataFrame) -> DataFrame:
    """phrase, tokens: words that the dictionary lacks are cut into two that it has, where they can be."""
    placed = phrases.select("phrase").distinct().select("phrase", F.posexplode(words(F.col("phrase"))).alias("at", "word"))
    unknown = placed.select("word").distinct().join(dictionary.select("word"), "word", "left_anti")
    cuts = known_cut(unknown, dictionary.select("word").distinct())
    parts = placed.join(cuts, "word", "left").select("phrase", "at", F.when(F.col("left").isNotNull(), F.array("left", "right")).otherwise(F.array("word")).alias("parts"))
    return parts.groupBy("phrase").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))), lambda x: x["parts"])).alias("tokens"))


def adversarial_phrases(targets: DataFrame, dictionary: DataFrame, partial: float = 1.0, input_words: float = 0.2, distance: int | None = None, n: int | None = None) -> DataFrame:
    """phrase, kind: near misses of the targets (phrase), in hashed order and cut to n where that is given.

    Each word in turn is put by its phonetic neighbours (near_miss), left out (partial, of a share of the
    targets) or stands alone (word, a share of them). Nothing that is a target, as it stands or expanded, is
    among them. A phrase of several kinds has the first in name order.
    """
    known = expanded(targets, dictionary)
    placed = known.select("phrase", "tokens", F.posexplode("tokens").alias("at", "word"))
    pairs = phonetic_neighbours(placed.select("word").distinct(), dictionary, distance)
    near = placed.join(pairs, "word").select(F.array_join(substitute(F.col("tokens"), F.col("at"), F.col("neighbour")), " ").alias("phrase"), F.lit("near_miss").alias("kind"))
    without = known.where(share(F.col("phrase"), "partial") < partial).select(F.explode(leave_one_out(F.col("tokens"))).alias("phrase"), F.lit("partial").alias("kind"))
    alone = placed.where(share(F.concat("phrase", F.lit("/"), F.col("at").cast("string")), "input word") < input_words).select(F.col("word").alias("phrase"), F.lit("word").alias("kind"))
    own = known.select(F.array_join("tokens", " ").alias("phrase")).unionByName(targets.select(F.array_join(words(F.col("phrase")), " ").alias("phrase")))
    found = near.unionByName(without).unionByName(alone).where("phrase <> ''").groupBy("phrase").agg(F.min("kind").alias("kind")).join(own, "phrase", "left_anti")
    return found if n is None else found.orderBy(order_key(F.col("phrase"), "adversarial"), "phrase").limit(n)


def token_distance(one: Column, other: Column, symbols: Column, cap: int) -> Column:
    """Edit distance of two token arrays, -1 over the cap: every token becomes one character by its place in `symbols`."""
    text = lambda tokens: F.array_join(F.transform(tokens, lambda t: F.substring(F.lit(SYMBOLS), F.array_position(symbols, t).cast("int"), F.lit(1))), "")
    return F.levenshtein(text(one), text(other), cap)


def strip_stress(phones: Column) -> Column:
    return F.transform(phones, lambda p: F.regexp_replace(p, r"\d+", ""))


def substitute(tokens: Column, at: Column, by: Column) -> Column:
    return F.transform(tokens, lambda w, i: F.when(i == at, by).otherwise(w))


def leave_one_out(tokens: Column) -> Column:
    """All phrases with one word left out; none of a single word."""
    places = F.sequence(F.lit(0), F.size(tokens) - 1)
    return F.when(F.size(tokens) > 1, F.transform(places, lambda k: F.array_join(F.filter(tokens, lambda w, i: i != k), " "))).otherwise(F.array().cast("array<string>"))


def swaps(phrases: DataFrame, pairs: DataFrame) -> DataFrame:
    """phrase, variant: each word in turn by each of its neighbours, without the phrases themselves."""
    placed = phrases.select("phrase", words(F.col("phrase")).alias("tokens")).select("phrase", "tokens", F.posexplode("tokens").alias("at", "word"))
    made = placed.join(pairs.select("word", "neighbour"), "word").select("phrase", F.array_join(substitute(F.col("tokens"), F.col("at"), F.col("neighbour")), " ").alias("variant"))
    return made.join(phrases.select(F.col("phrase").alias("variant")), "variant", "left_anti").select("phrase", "variant").distinct()


def bernoulli_words(tokens: Column, key: Column, p: float, purpose: str = "keep") -> Column:
    """Each word kept with probability p, by a hash of key and place."""
    return F.filter(tokens, lambda w, i: share(F.concat(key.cast("string"), F.lit("/"), i.cast("string")), purpose) < p)


def cut_at(tokens: Column, key: Column) -> Column:
    """A phrase of two words or more in two parts at a hashed boundary."""
    at = (F.floor(share(key, "cut") * (F.size(tokens) - 1)) + 1).cast("int")
    return F.when(F.size(tokens) > 1, F.array(F.slice(tokens, F.lit(1), at), F.slice(tokens, at + 1, F.size(tokens))))


def clauses(text: Column) -> Column:
    """clause, mark pairs of a text split at clause punctuation."""
    parts = F.regexp_extract_all(text, F.lit(r"([^,.;:!?]+[,.;:!?]*)"), 1)
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(p, r"[,.;:!?]+$", "")).alias("clause"), F.regexp_extract(p, r"([,.;:!?]*)$", 1).alias("mark")))


def holdout(items: DataFrame, column: str, fraction: float, purpose: str = "holdout") -> DataFrame:
    """Add side: `test` for clamp(round-half-even(n * fraction), 1, n - 1) items in hashed order, `train` for the rest.

    With fewer than two items, or no fraction, every item is on both sides.
    """
    total = items.agg(F.count("*").alias("__total"))
    n = F.col("__total")
    tested = F.greatest(F.lit(1), F.least(F.bround(n * F.lit(float(fraction))).cast("long"), n - 1))
    placed = ranked(items.withColumn("__key", F.col(column)), "__key", purpose).join(F.broadcast(total))  # one row
    both = F.when((n < 2) | F.lit(fraction <= 0), F.array(F.lit("train"), F.lit("test"))).otherwise(F.array(F.when(F.col("rank") < tested, "test").otherwise("train")))
    return placed.select(*items.columns, F.explode(both).alias("side"))


def schedule(groups: DataFrame, phrases: DataFrame, n: int) -> DataFrame:
    """clip_idx, grp, phrase for n clips: each group its share, phrases of a group in turn.

    groups: grp, share; phrases: grp, phrase. Shares of groups that have phrases are made to add up to 1; what
    rounding down leaves goes one by one to the largest shares, ties in name order.
    """
    spark = groups.sparkSession
    ordered = numbered(phrases.distinct(), "k", F.substring(F.md5(F.col("phrase").cast("binary")), 1, 3), [F.md5(F.col("phrase").cast("binary")), "phrase"], ("grp",))
    sizes = phrases.distinct().groupBy("grp").agg(F.count("*").alias("size"))
    everything = Window.partitionBy(F.lit(1))  # a row a group
    active = groups.where("share > 0").join(sizes, "grp").withColumn("share", F.col("share") / F.sum("share").over(everything))
    filled = active.withColumn("count", F.floor(F.round(F.col("share") * n, 9)))
    filled = filled.withColumn("rest", F.lit(n) - F.sum("count").over(everything)).withColumn("place", F.row_number().over(Window.orderBy(F.desc("share"), "grp")))
    filled = filled.withColumn("count", F.col("count") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0))
    spans = filled.withColumn("from", F.coalesce(F.sum("count").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("count > 0")
    clips = spark.range(0, n).select(F.col("id").alias("clip_idx"))
    dealt = clips.join(F.broadcast(spans), (F.col("clip_idx") >= F.col("from")) & (F.col("clip_idx") < F.col("from") + F.col("count")))  # a row a group
    return dealt.withColumn("k", F.pmod(F.col("clip_idx") - F.col("from"), F.col("size"))).join(ordered, ["grp", "k"]).select("clip_idx", "grp", "phrase")


def known_cut(unknown: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """word, left, right: the cut into two known words with the longest left part."""
    # lengths that known words have: a word of any length gives as many cuts at most
    lengths = known.agg(F.array_sort(F.collect_set(F.length("word"))).alias("lengths"))
    able = unknown.where(F.length("word") >= 2 * least).join(F.broadcast(lengths))  # one row
    fits = lambda n: (n >= least) & (F.length("word") - n >= least) & F.array_contains("lengths", F.length("word") - n)
    cut = able.select("word", F.explode(F.filter("lengths", fits)).alias("at"))
    parts = cut.select("word", "at", F.substring(F.col("word"), F.lit(1), F.col("at")).alias("left"), F.substring(F.col("word"), F.col("at") + 1, F.length("word")).alias("right"))
    met = parts.join(known.select(F.col("word").alias("left")), "left").join(known.select(F.col("word").alias("right")), "right")
    return met.groupBy("word").agg(F.max_by(F.struct("left", "right"), "at").alias("c")).select("word", "c.left", "c.right")


def pad_ids(ids: Column, pad: int, length: Column) -> Column:
    """Ids with `pad` before, between and after, filled up to `length`."""
    between = F.concat(F.array(F.lit(pad)), F.flatten(F.transform(ids, lambda i: F.array(i, F.lit(pad)))))
    return F.concat(between, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), length - F.size(between))))


def symbol_ids(text: Column, table: Column) -> Column:
    """Ids of a text's characters by a map from character to id; characters that it lacks are left out.

    The text is to be in decomposed form, as `decomposed` gives it.
    """
    ids = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.try_element_at(table, c))
    return F.filter(ids, lambda i: i.isNotNull())


def decomposed(texts: DataFrame, column: str) -> DataFrame:
    """The column in Unicode normal form NFD: Arrow batches, as no built-in function normalises."""
    import unicodedata

    import pyarrow as pa

    at = texts.columns.index(column)

    def run(batches):
        for batch in batches:
            values = [None if t is None else unicodedata.normalize("NFD", t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.names[at], pa.array(values, pa.string()))

    return texts.mapInArrow(run, texts.schema)
