import corpus_pipeline as cp


def test_stages_keep_clean_documents(spark, tmp_path):
    rows = [(1, "the quick brown fox jumps over the lazy dog again", "en", "s", 50), (2, "The quick brown fox jumps over the lazy dog again!", "en", "s", 50), (3, "12345 67890", "en", "s", 11), (4, None, None, None, None), (5, "call +1 (736) 555-2678 for the tall story of a mild winter", "en", "s", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.language(spark, docs, "")
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == [1, 2, 5]
    two = cp.near_duplicates(spark, one, "")
    assert sorted(r.doc_id for r in two.collect()) == [1, 5]
    three = {r.doc_id: r for r in cp.private_data(spark, two, "").collect()}
    assert "736" not in three[5].text.replace("555", "") and three[1].text == rows[0][1] and three[5].n_chars == len(three[5].text)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted({r.doc_id for r in cp.run(spark, str(tmp_path)).collect()}) == [1, 5]


def test_language_keeps_ties(spark):
    texts = ["the quick brown fox", "the quick brown dog"]
    rows = [(10 * i + j, t, lang, "s", len(t)) for i, lang in enumerate(("en", "xx")) for j, t in enumerate(texts * 5)]
    rows += [(100, "the fox", None, "s", 7), (101, "\u0436\u0449\u044e", None, "s", 3), (102, "12 34", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    profiles = {"en": [1 << 40, *cp.langid.gram_counts("the fox")[0].tolist()]}
    profiles["xx"] = profiles["en"]
    assert cp.langid.Judge(profiles).judge("the fox") == ("en", 0.0, True)
    trained, cp.langid.train = cp.langid.train, lambda _: profiles
    try:
        got = sorted(r.doc_id for r in cp.language(spark, docs, "").collect())
    finally:
        cp.langid.train = trained
    assert got == sorted(r[0] for r in rows if r[0] not in (101, 102))


def test_no_labels_keep_every_document_with_a_letter(spark):
    rows = [(1, "some words", None, "s", 10), (None, "more \u0436", None, None, None), (2, "12", None, "s", 2), (3, None, None, "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in cp.language(spark, docs, "").collect()) == ["1", "None"]


def test_stages_take_empty_tables_and_more_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, shared boolean, key string, n_replaced int")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, "").columns == cp.COLUMNS and stage(spark, docs, "").count() == 0
    assert cp.pack(spark, docs, "").count() == 0


def test_whole_pipeline_is_its_plain_version(spark, tmp_path):
    """Every stage beside a plain loop over the rows that its predecessor kept."""
    import random

    from tidemark.llm import bpe, langid, minhash, pii
    from tidemark.llm.queries import tokenizer_path

    rng = random.Random(6)
    vocabulary = {"en": "the cat and dog ran over that hill with some old friends today".split(), "de": "der hund und die katze liefen über den hügel mit alten freunden heute".split()}
    rows = []
    for i in range(120):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 60)))
        rows.append((i, text + (f" call +1 (736) 555-{i:04d}" if i % 9 == 0 else ""), lang, "s", len(text)))
    rows += [(200 + i, rows[i][1] + "!", "en", "t", 1) for i in range(0, 40, 2)] + [(300, "123", "en", "s", 3), (301, None, "en", "s", 0), (7, rows[7][1], "en", "s", 0), (None, "ein kurzer text mit worten und der katze", "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [r for r in rows if r[1] and langid.has_letter(r[1])]
    sets = [set(minhash.shingles(minhash.words_of(r[1]))[0].tolist()) for r in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first: dict = {}
    for i, r in enumerate(kept):
        first[group[i]] = min(first.get(group[i], (True, 0, i)), (r[0] is None, r[0] or 0, i))
    p, want = pii.Pseudonymiser(pii.DEMO_KEY), []
    t = bpe.transducer(tokenizer_path())
    for *_, i in first.values():
        n = sum(len(b) for b in t.encode(p.replace(kept[i][1])[0])) // 4 + 1
        want.append((str(kept[i][0]), n))
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted(want)
    assert all(len(r.ids) == r.length and r.ids[-1] == 1 for r in got)
