import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_path

ALPHABET = ["a", "b", "the", "'", "'s", "!", "é", "é", "ᅡ", "ᄀ", "ᆨ", "9", " ", "\n", "Σ", "İ", "漢", "字", "ﬁ", "<|endoftext|>", "😀", "\x1c", " "]


def texts(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        weights = [rng.random() ** 3 + 1e-4 for _ in ALPHABET]
        text = "".join(rng.choices(ALPHABET, weights, k=rng.randint(0, 2500 if k % 10 == 0 else 200)))
        yield text.replace(" ", "").replace("\n", "") if k % 3 == 0 else text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_text_match_the_library_in_small_blocks(name, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    t, library = bpe.Transducer(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    for text in texts(150, 3):
        ids = np.frombuffer(b"".join(t.encode(text)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids
        d = t.decoder()
        assert "".join(d.feed([i]) for i in ids) + d.close() == library.decode(ids, skip_special_tokens=False)


def test_one_word_without_end_is_streamed():
    t, library = bpe.Transducer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    word = "".join(rng.choices(["the", "ing", "x", "a", "tion"], k=3000))
    assert list(t.stream([word[i : i + 7] for i in range(0, len(word), 7)], True)) == library.encode(word, add_special_tokens=False).ids
    assert 0 < t.lookahead < 5000


def test_lookahead_of_a_chain():
    rules = [(("a",), ("b",)), (("c",), ("a", "b")), (("d",), ("c", "a"))]
    assert bpe.sufficient_lookahead(rules[:2]) == 2  # ab, then c before it
    with pytest.raises(ValueError):
        bpe.sufficient_lookahead(rules)


def test_rows_of_all_kinds(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "Hello, world", None), (4, "Hello, world", "x"), (5, "ab " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_documents(df, tokenizer_path()).collect()
    assert [len(r.ids) for r in got] == [0, 0, 3, 3, 100_000] and got[0].decoded == ""
    digests = bpe.round_trip_digests(df, tokenizer_path()).collect()
    assert digests[2].ids_sha256 == hashlib.sha256(" ".join(map(str, got[2].ids)).encode()).hexdigest()
    assert bpe.round_trip_digests(df.limit(0), tokenizer_path()).count() == 0


def test_words_shared_by_chunks_and_a_small_cache(monkeypatch):
    """Chunks with marks, capitals and digits at their ends, with a cache that long texts drive them out of."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from tidemark.llm import bpe
    from tidemark.llm.queries import tokenizer_path

    rng = random.Random(5)
    stems = ["word", "Élan", "straße", "don't", "e\u0301t", "x1", "...", "naïve", "ΣΑΣ", "\u0301a", "日本", "a" * 90]
    chunk = lambda: rng.choice(["", "(", '"']) + rng.choice(stems) + rng.choice("abcdef") * rng.randrange(3) + rng.choice(["", ",", ".", "1", "!?", "\u0301", "'s"])
    texts = [" ".join(chunk() for _ in range(rng.randrange(60))) for _ in range(60)] + [" ".join(chunk() + str(i) for i in range(9000))] + [None, "", " <|endoftext|> a"]
    texts += texts[:20]
    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation(), library.no_padding()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "CACHED", 50)
    t = bpe.Transducer(tokenizer_path())
    for _ in range(2):
        got = [np.frombuffer(b"".join(blocks), "<u4").tolist() for blocks in bpe.encoded(t, texts)]
        assert got == want
