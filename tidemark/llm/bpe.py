"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Encoding. Merge rules apply in rank order, so text that is not read yet can change tokens to its left
only through a chain of rules: rule k takes its left part u_k into the changed region, and the next
rule of the chain (of a higher rank) must have a right part that starts with u_k. The longest such
chain, weighted by the lengths of the u_k, is the merge list's sufficient lookahead. A token that ends
that many symbols before the end of what is read is final, and the rest may be encoded on its own from
there, as no merge crossed the boundary. A word of any length thus needs a buffer of constant size; a
document is read in blocks of constant size.

Decoding. Ids are mapped to tokens one by one. A byte-level decoder feeds the tokens' bytes to an
incremental UTF-8 state machine; a tokenizer file without a decoder joins its tokens by one space.

Null texts count as empty: no ids, an empty decoded text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import map_rows

END = "</w>"
#: Characters read at a time, and words of each cache generation.
BLOCK, CACHED = 1 << 16, 300_000
#: No merge; two odd multipliers of the pair hash.
NONE, M1, M2 = 1 << 60, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Characters that Python splits at though the patterns do not count them as white space.
CONTROL = "\x1c\x1d\x1e\x1f"
#: The pre-tokenizer pattern of the byte-level files, which their JSON leaves implicit.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def sufficient_lookahead(rules: Iterable[tuple[tuple, tuple]]) -> int:
    """Symbols that must follow a token before it is final. rules: (left, right) symbol tuples by rank.

    Raises ValueError where a rule's part is only made by a later rule: then rank order is not the order
    of application and the bound does not hold.
    """
    made_at: dict[tuple, int] = {}
    chain: dict[tuple, int] = {}  # left part -> longest weighted chain that ends with it
    longest = 0
    listed = list(rules)
    for rank, (left, right) in enumerate(listed):
        made_at.setdefault(left + right, rank)
    for rank, (left, right) in enumerate(listed):
        if any(len(p) > 1 and made_at.get(p, len(listed)) >= rank for p in (left, right)):
            raise ValueError(f"merge {rank} uses a part that no earlier merge makes")
        before = max((chain.get(right[:i], 0) for i in range(1, len(right) + 1)), default=0)
        length = before + len(left)
        chain[left] = max(chain.get(left, 0), length)
        longest = max(longest, length)
    return longest


class Transducer:
    """Encoder and decoder of one tokenizer file (`tokenizers` JSON: BPE, byte-level symbols)."""

    def __init__(self, path: str, special_in_text: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        parts = json.dumps(spec.get("normalizer") or {})
        self.compose, self.lower = '"NFC"' in parts, '"Lowercase"' in parts
        pre = spec["pre_tokenizer"]
        split = [p for p in pre.get("pretokenizers", [pre]) if p["type"] == "Split"]
        self.pattern = regex.compile(split[0]["pattern"]["Regex"] if split else BYTE_LEVEL_PATTERN)
        self.drops_space = bool(split)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(map(regex.escape, self.added))) if self.added and special_in_text else None
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a] << 20) | self.vocab[b]: (r << 20) | self.vocab[a + b] for r, (a, b) in enumerate(pairs)}
        self.lookahead = sufficient_lookahead((self.symbols(a), self.symbols(b)) for a, b in pairs)
        shown = byte_symbols()
        self.inner = [self.vocab[c] for c in shown]
        self.final = [self.vocab[c + self.suffix] for c in shown]
        self.bytes_of = {c: b for b, c in enumerate(shown)}
        self.window = max(256, 4 * self.lookahead)
        self.inner_table, self.final_table = np.array(self.inner, np.int64), np.array(self.final, np.int64)
        self.tables()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def symbols(self, token: str) -> tuple:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1:] + self.suffix)
        return tuple(token)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list to symbol ids, lowest rank and then leftmost first."""
        get, none = self.rank.get, 1 << 60
        ranks = [get((a << 20) | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i] = token = low & 0xFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((token << 20) | ids[i + 1], none)
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | token, none)
        return ids

    def merge_all(self, words: list[str]) -> list[bytes]:
        """Packed ids of many pre-tokens: the merges of all words of similar length run side by side."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes] = [b""] * len(raw)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        by = {w: np.flatnonzero((sizes <= w) & (sizes > low)).tolist() for low, w in ((0, 8), (8, 16), (16, 32), (32, 64))}
        for i in np.flatnonzero(sizes > 64).tolist():
            if len(raw[i]) > self.window:
                out[i] = np.fromiter(self.stream([words[i]], True), "<u4").tobytes()
            else:
                out[i] = np.array(self.merge([*(self.inner[b] for b in raw[i][:-1]), self.final[raw[i][-1]]]), "<u4").tobytes()
        for width, rows in by.items():
            if len(rows) < 100:
                for i in rows:
                    out[i] = np.array(self.merge([*(self.inner[b] for b in raw[i][:-1]), self.final[raw[i][-1]]]), "<u4").tobytes()
                continue
            for at in range(0, len(rows), 20_000):
                some = rows[at : at + 20_000]
                for i, packed in zip(some, self.side_by_side([raw[i] for i in some], width)):
                    out[i] = packed
        return out

    def side_by_side(self, raw: list[bytes], width: int) -> list[bytes]:
        n = len(raw)
        size = np.fromiter(map(len, raw), np.int64, n)
        every = np.arange(n)
        live = np.arange(width) < size[:, None]
        grid = np.zeros((n, width), np.uint8)
        grid[live] = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner_table[grid]
        ids[every, size - 1] = self.final_table[grid[every, size - 1]]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        rank = np.full((n, width), NONE, np.int64)
        rank[:, :-1] = np.where(live[:, 1:], self.lookup(ids[:, :-1], ids[:, 1:]), NONE)
        rows = every
        while len(rows):
            sub = rank[rows]
            at = sub.argmin(1)
            low = sub[np.arange(len(rows)), at]
            on = low < NONE
            rows, at, low = rows[on], at[on], low[on]
            if not len(rows):
                break
            token = low & 0xFFFFF
            gone = after[rows, at]
            ids[rows, at] = token
            live[rows, gone] = False
            rank[rows, gone] = NONE
            following = after[rows, gone]
            after[rows, at] = following
            more = following < size[rows]
            rank[rows, at] = NONE
            r, f, a = rows[more], following[more], at[more]
            before[r, f] = a
            rank[r, a] = self.lookup(token[more], ids[r, f])
            left = before[rows, at]
            some = left >= 0
            r, p = rows[some], left[some]
            rank[r, p] = self.lookup(ids[r, p], token[some])
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(1)) * 4
        starts = [0, *ends[:-1].tolist()]
        return [flat[s:e] for s, e in zip(starts, ends.tolist())]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and result of each pair, NONE where no rule has it; two hash tables of one slot a key."""
        key = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        first, second = (key * M1) >> np.uint64(44), (key * self.m2) >> np.uint64(44)
        return np.where(self.keys1[first] == key, self.values1[first], np.where(self.keys2[second] == key, self.values2[second], NONE))

    def tables(self) -> None:
        keys = np.fromiter(self.rank.keys(), np.uint64, len(self.rank))
        values = np.fromiter(self.rank.values(), np.int64, len(self.rank))
        self.keys1, self.values1 = np.full(1 << 20, ~np.uint64(0)), np.full(1 << 20, NONE, np.int64)
        self.keys2, self.values2 = self.keys1.copy(), self.values1.copy()
        slot = ((keys * M1) >> np.uint64(44)).astype(np.int64)
        _, chosen = np.unique(slot, return_index=True)
        self.keys1[slot[chosen]], self.values1[slot[chosen]] = keys[chosen], values[chosen]
        rest = np.setdiff1d(np.arange(len(keys)), chosen)
        self.m2 = M2
        while len(np.unique(slot := ((keys[rest] * self.m2) >> np.uint64(44)).astype(np.int64))) < len(rest):
            self.m2 = np.uint64((int(self.m2) * int(M1) | 1) & 0xFFFFFFFFFFFFFFFF)
        self.keys2[slot], self.values2[slot] = keys[rest], values[rest]

    def stream(self, pieces: Iterable[str], ended: bool) -> Iterator[int]:
        """Ids of one pre-token that comes in pieces, each given out once no later symbol can change it."""
        buffer: list[int] = []
        held: int | None = None
        for piece in pieces:
            for b in piece.encode("utf-8", "surrogatepass"):
                if held is not None:
                    buffer.append(self.inner[held])
                held = b
                if len(buffer) >= self.window:
                    merged, stable, used = self.merge(buffer[:]), [], 0
                    for t in merged:
                        n = self.width(t)
                        if used + n > len(buffer) - self.lookahead:
                            break
                        stable.append(t)
                        used += n
                    yield from stable
                    buffer = buffer[used:]
        if ended and held is not None:
            yield from self.merge([*buffer, self.final[held]])

    def width(self, token: int) -> int:
        text = self.tokens[token]
        return len(text) - (len(self.suffix) if self.suffix and text.endswith(self.suffix) else 0)

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower() if self.lower else text
        if self.compose:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text

    def blocks(self, text: str) -> Iterator[str]:
        """Pieces of about BLOCK characters; each but the last ends where nothing joins across it."""
        at, n = 0, len(text)
        while n - at > BLOCK:
            cut = max(text.rfind(" ", at, at + BLOCK), text.rfind("\n", at, at + BLOCK)) + 1
            if not self.drops_space:
                cut -= 1  # a space there belongs to the word after it
            if cut <= at or not self.drops_space and text[cut - 1].isspace():
                cut = self.inert(text, at + BLOCK)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def inert(self, text: str, at: int) -> int:
        """The next position where composition cannot join the two sides."""
        while at < len(text) and not (text[at] < "̀" or self.compose and not _joins(text[at])):
            at += 1
        return at

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids packed as little-endian unsigned 32-bit integers, block by block."""
        at = 0
        for m in self.special.finditer(text or "") if self.special else ():
            yield from self.plain(text[at : m.start()])
            yield self.added[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self.plain((text or "")[at:])

    def plain_chunks(self, text: str | None) -> bool:
        """Whether a text is short and nothing but chunks between white space."""
        return bool(text) and self.drops_space and len(text) <= BLOCK and not any(c in text for c in CONTROL) and not (self.special and any(x in text for x in self.added))

    def together(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts that are nothing but chunks between white space.

        Chunks are numbered over all texts, each different one is taken apart into words once, each different word
        looked up or merged once; the ids of the texts are then gathered by number.
        """
        try:
            parts = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
        except (pa.ArrowInvalid, UnicodeEncodeError):  # a lone surrogate
            parts = pa.array([[c.encode("utf-8", "surrogatepass") for c in x.split()] for x in texts], pa.list_(pa.binary()))
        numbered = parts.flatten().dictionary_encode()
        listed = [x.decode("utf-8", "surrogatepass") for x in numbered.dictionary.cast(pa.binary()).to_pylist()]
        # nothing composes across a line break, and no chunk has one: all are brought into normal form at once
        normals = self.normal("\n".join(listed)).split("\n")
        alone = np.fromiter(map(str.isalpha, normals), bool, len(normals))
        counts, mixed, find = alone.astype(np.int64), [], self.pattern.findall
        for i in np.flatnonzero(~alone).tolist():
            n = normals[i]
            words = [n[:-1], n[-1]] if n[:-1].isalpha() else find(n)
            counts[i] = len(words)
            mixed += words
        of_mixed = np.repeat(~alone, counts)
        different: dict[str, int] = {}
        number = different.setdefault
        word = np.empty(len(of_mixed), np.int64)
        word[~of_mixed] = [number(n, len(different)) for n, a in zip(normals, alone.tolist()) if a]
        word[of_mixed] = [number(w, len(different)) for w in mixed]
        packed = self.of_words(list(different))
        flat, sizes = gathered(np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4, word)
        ends, after = np.concatenate(([0], np.cumsum(sizes))), np.cumsum(counts)
        flat, sizes = gathered(flat, ends[after] - ends[after - counts], numbered.indices.to_numpy())
        at = (np.concatenate(([0], np.cumsum(sizes)))[parts.offsets.to_numpy()] * 4).tolist()
        raw = flat.tobytes()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def of_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of different words: from a cache of two generations of bounded size, the others merged together."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        missing = []
        for i in [i for i, x in enumerate(out) if x is None]:
            if (known := old.get(words[i])) is not None:
                out[i] = young[words[i]] = known
            else:
                missing.append(i)
        new = [words[i] for i in missing]
        for i, w, x in zip(missing, new, self.merge_all(new)):
            out[i] = young[w] = x
        return out

    def plain(self, text: str) -> Iterator[bytes]:
        if not text:
            return
        if len(text) <= BLOCK:
            yield self.whole(text)
            return
        carry = ""
        size = len(text)
        seen = 0
        for block in self.blocks(text):
            seen += len(block)
            if not carry and (seen == size or self.drops_space and block[-1].isspace()):
                yield self.whole(block)
                continue
            carry += self.normal(block)
            if seen == size or self.drops_space and block[-1].isspace():
                done, carry = self.pattern.findall(carry), ""
            else:
                done, carry = self.settled(carry)
                if not done and len(carry) >= 8 * BLOCK:  # one pre-token so far
                    yield from self.streamed(carry, text, seen)
                    return
            yield self.words(done)

    def settled(self, text: str) -> tuple[list[str], str]:
        """The pre-tokens that are certain now, and the text of those that later text may still change."""
        spans = [m.span() for m in self.pattern.finditer(text)]
        if len(spans) < 5:
            return [], text
        return [text[i:j] for i, j in spans[:-4]], text[spans[-4][0] :]

    def streamed(self, carry: str, text: str, seen: int) -> Iterator[bytes]:
        """The rest of a text from a pre-token of many blocks on: symbol by symbol until that ends."""
        spans = [m.span() for m in self.pattern.finditer(carry)]
        yield self.known(carry[: spans[-1][0]])
        word = carry[spans[-1][0] :]
        kind = regex.compile(r"\p{L}+" if regex.search(r"\p{L}$", word) else r"[^\s\p{L}\p{N}]+")
        rest: list[str] = []

        def pieces() -> Iterator[str]:
            yield word
            at = seen
            while at < len(text) and not rest:
                end = self.inert(text, min(len(text), at + BLOCK))
                block = self.normal(text[at:end])
                m = kind.match(block)
                taken = m.end() if m else 0
                yield block[:taken]
                at = end
                if taken < len(block):
                    rest.extend((block[taken:], text[at:]))

        batch: list[int] = []
        for t in self.stream(pieces(), True):
            batch.append(t)
            if len(batch) >= BLOCK:
                yield np.array(batch, "<u4").tobytes()
                batch = []
        yield np.array(batch, "<u4").tobytes()
        if rest:
            yield from self.plain(rest[0] + rest[1])

    def whole(self, text: str) -> bytes:
        """Ids of a text that is cut where no pre-token crosses."""
        if self.drops_space and not any(c in text for c in CONTROL):
            return self.together([text])[0]
        return self.known(self.normal(text))

    def known(self, normal: str) -> bytes:
        """Ids of a text in normal form."""
        return self.words(self.pattern.findall(normal))

    def words(self, words: list[str]) -> bytes:
        """Ids of pre-tokens in normal form."""
        different = list(dict.fromkeys(words))
        ids = dict(zip(different, self.of_words(different)))
        return b"".join(map(ids.__getitem__, words))

    def decoder(self) -> Decoder:
        return Decoder(self)


def gathered(flat: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `flat`, of these sizes one after another, in the order of `numbers`; their sizes."""
    starts, wanted = np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.cumsum(wanted)
    return flat[np.repeat(starts[numbers] - ends + wanted, wanted) + np.arange(ends[-1] if len(ends) else 0)], wanted


class Decoder:
    """Ids to text, in any split: `feed` gives what is settled, `close` the rest."""

    def __init__(self, owner: Transducer):
        self.tokens, self.byte_level, self.bytes_of, self.added = owner.tokens, owner.byte_level, owner.bytes_of, set(owner.added.values())
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if not self.byte_level:
            text = " ".join(map(self.tokens.__getitem__, ids))
            text = " " + text if self.begun else text
            self.begun = True
            return text
        return "".join(self.state.decode(self.raw(i)) for i in ids)

    def raw(self, token: int) -> bytes:
        text = self.tokens[token]
        return text.encode() if token in self.added else bytes(self.bytes_of[c] for c in text)

    def close(self) -> str:
        return self.state.decode(b"", True) if self.byte_level else ""


def _joins(c: str, known: set[str] = set()) -> bool:  # noqa: B006  filled once a process
    """Whether the character may compose with, or be reordered before, what stands left of it."""
    if not known:
        known.update(chr(x) for x in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)))
        for x in range(0x110000):
            d = unicodedata.decomposition(chr(x)).split()
            if len(d) == 2 and d[0][0] != "<":
                known.add(chr(int(d[1], 16)))
    return unicodedata.combining(c) > 0 or c in known


_loaded: dict[tuple, Transducer] = {}


def transducer(path: str, special_in_text: bool = True) -> Transducer:
    """The transducer of a file, built once a Python worker."""
    key = (path, special_in_text)
    if key not in _loaded:
        _loaded[key] = Transducer(path, special_in_text)
    return _loaded[key]


def groups(texts: list, chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about that many characters together."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encoded(t: Transducer, texts: list) -> Iterator[Iterator[bytes]]:
    """For each text its blocks of packed ids."""
    for begin, end in groups(texts):
        some = texts[begin:end]
        easy = [t.plain_chunks(text) for text in some]
        packed = iter(t.together([text for text, e in zip(some, easy) if e]))
        for text, e in zip(some, easy):
            yield iter((next(packed),)) if e else t.encode(text)


def encode_documents(docs: DataFrame, path: str, text: str = "text", special_in_text: bool = True) -> DataFrame:
    """Add `ids array<int>` and `decoded string` to every row; columns of those names are replaced, others pass."""
    clash = {"ids", "decoded"} & set(docs.columns)
    schema = T.StructType([*docs.drop(*clash).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        t = transducer(path, special_in_text)
        for batch in batches:
            ids, decoded = [], []
            for blocks in encoded(t, batch.column(text).to_pylist()):
                one, d, out = [], t.decoder(), []
                for block in blocks:
                    some = np.frombuffer(block, "<u4").tolist()
                    one += some
                    out.append(d.feed(some))
                ids.append(one)
                decoded.append("".join([*out, d.close()]))
            kept = [n for n in batch.schema.names if n not in clash]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*kept, "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and text go to the hashes block by block."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        t = transducer(path)
        shown = [str(i) for i in range(max(t.tokens) + 1)]

        def work(cols: dict) -> dict:
            n, left, right = [], [], []
            for blocks in encoded(t, cols["text"]):
                count, decoder, ids_hash, text_hash = 0, t.decoder(), hashlib.sha256(), hashlib.sha256()
                for block in blocks:
                    if block:
                        ids = np.frombuffer(block, "<u4").tolist()
                        ids_hash.update(((" " if count else "") + " ".join([shown[i] for i in ids])).encode())
                        text_hash.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
                        count += len(ids)
                text_hash.update(decoder.close().encode())
                n.append(count)
                left.append(ids_hash.hexdigest())
                right.append(text_hash.hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": left, "decoded_sha256": right}

        return work

    return map_rows(docs.select("doc_id", "text"), make, schema)
