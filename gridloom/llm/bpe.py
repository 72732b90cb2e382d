"""Exact BPE encoding by backtracking, and decoding by an offset table.

A tokenizer file of the `tokenizers` library gives the vocabulary and merges. A word's encoding is the one sequence of tokens
whose neighbours are all *compatible*: no merge across their border would have come before the merges that built them. The
encoder takes the longest token at each position (all matches come from one Aho-Corasick pass), falls back to that token's
next shorter prefix when it is not compatible with its left neighbour, and steps back when no prefix fits. Each position is
given up at most once, so the work is linear in the word's length. Decoding gathers byte ranges of one blob of all tokens'
strings through a table of offsets.

Texts with characters that the interpreter's Unicode tables don't have yet are normalized by the tokenizer file's own normalizer.

Null texts count as empty: no tokens, an empty decoded text. Rows are independent: repeated rows, null ids and extra columns
(which are dropped) make no difference. Memory is bounded by one batch plus a cache of WORDS words per worker.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Cache, parts


#: Words that a worker keeps encoded.
WORDS = 600_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else 256 onwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def has_newer(text: str) -> bool:
    """Whether a text holds characters that the interpreter's Unicode tables don't have."""
    return not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text))


class BpeTokenizer:
    """Encodes and decodes as the tokenizer file says. Supported: byte-level BPE with an end-of-word suffix, the normalizers
    NFC, white-space folding and lower-casing, a regex that keeps its matches, and special tokens found in raw text."""

    def __init__(self, path: str, cache: int = WORDS):
        import ahocorasick
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or model["dropout"] or not suffix or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError("not a plain BPE model with an end-of-word suffix")
        self.steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if self.steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"]:
            raise ValueError("unsupported normalizer or pre-tokenizer")
        # \s of the file's regex dialect is the White_Space property; U+001C to U+001F are not in it
        self.find_pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.newer = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.normalize_newer = Tokenizer.from_file(path).normalizer.normalize_str
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.find_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split

        # Tokens over an alphabet of 512 symbols: byte b, and b + 256 at the end of a word.
        byte_of = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> str:
            last = token.endswith(suffix)
            body = [byte_of[c] for c in (token[: -len(suffix)] if last else token)]
            if last:
                body[-1] += 256
            return "".join(map(chr, body))

        vocab = model["vocab"]
        self.merge: dict[tuple[int, int], int] = {}
        self.left, self.right, self.rank = {}, {}, {}
        for rank, (a, b) in enumerate(tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if z in self.rank or max(self.rank.get(x, -1), self.rank.get(y, -1)) >= rank:
                raise ValueError("merges are not in the order of training")
            self.merge[x, y], self.left[z], self.right[z], self.rank[z] = rank, x, y, rank
        self.fits = Cache(self._fits, 1 << 18)
        whole: dict[int, bool] = {}
        for token in sorted((t for t in vocab.values()), key=lambda t: self.rank.get(t, -1)):
            whole[token] = token not in self.rank or (whole[x := self.left[token]] and whole[y := self.right[token]] and self._first(x, y) >= self.rank[token])
        by_text = {symbols(k): v for k, v in vocab.items() if k not in special and whole[v]}
        self.length = {v: len(k) for k, v in by_text.items()}
        self.shorter = {v: next((t for n in range(len(k) - 1, 0, -1) if (t := by_text.get(k[:n])) is not None), None) for k, v in by_text.items()}
        automaton = ahocorasick.Automaton()
        for k, v in by_text.items():
            automaton.add_word(k, (len(k) - 1, v))
        automaton.make_automaton()
        self.matches = automaton.iter
        self.cache = Cache(self._chunk, cache)

        names = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for k, v in [*vocab.items(), *special.items()]:
            names[v] = b" " + k.encode()
        self.blob = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in names])]).astype(np.int64)

    def _edge(self, token: int, side: dict[int, int]) -> list[tuple[int, float]]:
        """The tokens that stood at one edge while `token` was built, each with the rank at which the next took its place."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in side:
                return out
            until, token = self.rank[token], side[token]

    def _first(self, a: int, b: int) -> float:
        """Rank of the first merge that would cross the border of a and b while both are being built, a's own end included."""
        found = float("inf")
        for x, x_until in self._edge(a, self.right):
            for y, y_until in self._edge(b, self.left):
                r = self.merge.get((x, y))
                # of equal merges the leftmost comes first: one inside a wins over the border, the border over one inside b
                if r is not None and r < x_until and r <= y_until:
                    found = min(found, r)
        return found

    def _fits(self, pair: int) -> bool:
        return self._first(pair >> 20, pair & 0xFFFFF) == float("inf")

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one piece of the pre-tokenizer."""
        raw = word.encode().decode("latin-1")
        text = raw[:-1] + chr(ord(raw[-1]) + 256)
        longest = [None] * (len(text) + 1)
        for end, (back, token) in self.matches(text):
            longest[end - back] = token  # ends ascend, so the longest stays
        length, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        given_up, at, token = set(), 0, longest[0]
        while token is not None:
            end = at + length[token]
            if end not in given_up and (not out or fits[out[-1] << 20 | token]):
                out.append(token)
                at, token = end, longest[end]
            elif (nxt := shorter[token]) is not None:
                token = nxt
            else:
                given_up.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def pieces(self, text: str) -> list[str]:
        if has_newer(text):  # as the library's tables have them
            return [x for x, _ in self.newer.pre_tokenize_str(text)]
        return self.find_pieces(text)

    def _chunk(self, chunk: str) -> bytes:
        return np.array([t for piece in self.pieces(chunk) for t in self.encode_word(piece)], dtype="<u4").tobytes()

    def normalize(self, text: str) -> str:
        if has_newer(text):
            return self.normalize_newer(text)
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing goes letter by letter: no final sigma
        return text.lower()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<" not in text:
            return self._plain(text)
        parts = self.find_special(text)
        return b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def _plain(self, text: str) -> bytes:
        text = self.normalize(text)
        cached = self.cache.__getitem__
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._chunk(text)
        return b"".join(map(cached, text.split()))  # no piece holds white space

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens' strings, joined by blanks."""
        if not ids:
            return b""
        k = np.frombuffer(ids, dtype="<u4")
        start = self.offsets[k]
        size = self.offsets[k + 1] - start
        before = np.cumsum(size) - size
        return self.blob[np.repeat(start - before, size) + np.arange(before[-1] + size[-1])][1:].tobytes()


_loaded: dict[str, BpeTokenizer] = {}


def tokenizer(path: str) -> BpeTokenizer:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = BpeTokenizer(path)
    return _loaded[path]


#: Columns that encode_documents can make, from the ids and the decoded text.
OUTPUTS = {
    "n_tokens": (T.LongType(), pa.int64(), lambda ids, text: len(ids) // 4),
    "token_ids": (T.BinaryType(), pa.binary(), lambda ids, text: ids),
    "decoded": (T.StringType(), pa.string(), lambda ids, text: text().decode()),
    "ids_sha256": (T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(ids).hexdigest()),
    "decoded_sha256": (T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(text()).hexdigest()),
}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """id_col and the chosen OUTPUTS for each row of docs. token_ids packs little-endian unsigned 32-bit integers."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), *(T.StructField(k, OUTPUTS[k][0]) for k in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in parts(batches):
            made: list[list] = [[] for _ in outputs]
            for text in batch.column("text").to_pylist():
                ids = t.encode(text)
                got: list[bytes] = []

                def decoded(ids=ids, got=got) -> bytes:
                    if not got:
                        got.append(t.decode(ids))
                    return got[0]

                for column, k in zip(made, outputs, strict=True):
                    column.append(OUTPUTS[k][2](ids, decoded))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, OUTPUTS[k][1]) for v, k in zip(made, outputs, strict=True))], names=["id", *outputs])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """id_col and decoded, from packed ids; null ids decode to an empty text."""
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in parts(batches):
            texts = [t.decode(x or b"").decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "decoded"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
