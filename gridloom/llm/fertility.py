"""Quality rules on tokeniser fertility.

Each word of a text is encoded on its own by public subword vocabularies: one of pieces with byte fallback, one of bytes. Three
measures of each say how well the text suits it: characters per token, the share of byte-fallback tokens (for a vocabulary of bytes:
tokens that are no whole characters), and the entropy of the tokens in bits. A text is rejected if a measure leaves the band of its
script (that of most of its letters). Entropy can't exceed the logarithm of the number of tokens, so its bound is that share of the
logarithm until ENTROPY_TOKENS tokens, and constant from there on.

Where a language column is given, characters per token and entropy must also lie in the bands of the language: the median over all
its texts of MIN_WORDS words or more (for entropy: those with as many tokens, up to a factor of 2), give or take WIDTH times the median
deviation, or WIDTH times the median deviation for a text of this many words (deviations times the root of the number of words),
whichever is wider. Medians are exact on a grid of 1 / GRID, so reruns agree.

Cheap counts come along: words, characters in words, symbols, repeated lines, words in repeated three-word windows.

Null texts count as empty: all counts 0, base_failed, not kept. Rows are independent: repeated rows, null ids and extra columns
(which are dropped) make no difference; a text that lies on a bound is kept; an empty table gives no rows. A null language is one of
the languages. Whole texts are read; a worker holds one batch and a bounded cache of words; a word of more than PIECE characters is
encoded in pieces of as many.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Cache, cut, parts

#: Bands by script, the same for each vocabulary: least and most characters per token, most byte-fallback share, least entropy as
#: share of its logarithm.
BANDS = {
    "latin": (1.5, 9.0, 0.2, 0.8),
    "greek": (0.8, 6.0, 0.5, 0.75),
    "cyrillic": (0.8, 6.0, 0.4, 0.75),
    "semitic": (0.6, 5.0, 0.6, 0.75),
    "indic": (0.25, 5.0, 0.95, 0.6),
    "east_asian": (0.25, 4.0, 0.95, 0.7),
    "none": (0.25, 9.0, 0.95, 0.6),
}
ENTROPY_TOKENS = 90
#: Blocks of letters by script.
SCRIPTS = {
    "latin": r"[A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ]+",
    "greek": r"[Ͱ-Ͽἀ-῿]+",
    "cyrillic": r"[Ѐ-ԯ]+",
    "semitic": r"[֐-ۿݐ-ݿ]+",
    "indic": r"[ऀ-෿]+",
    "east_asian": r"[぀-ヿ㐀-鿿가-힯]+",
}
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Half the width of a language's band in median deviations, and the least deviation of characters per token and of entropy that
#: counts, as shares of the median.
WIDTH, LEAST_DEVIATION = 5.0, (0.005, 0.014)
GRID, PIECE = 1000, 4096
#: Words that a worker keeps encoded: each by all vocabularies.
WORDS = 800_000

_COUNTS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("script", "string")]
_MEASURES = [("n_tokens", "long"), ("chars_per_token", "double"), ("byte_share", "double"), ("entropy", "double")]


def _suffix(k: int) -> str:
    """Of the k-th vocabulary's measures: none, _2, _3, ..."""
    return f"_{k + 1}" if k else ""


def script_of(text: str) -> str:
    """Script of most letters; the first of SCRIPTS among equals, none without letters of these."""
    if text.isascii():
        return "latin" if re.search("[A-Za-z]", text) else "none"
    if 2 * sum(map(len, re.findall(SCRIPTS["latin"], text))) >= len(text):
        return "latin"
    count = {k: sum(map(len, re.findall(v, text))) for k, v in SCRIPTS.items()}
    best = max(count, key=count.__getitem__)
    return best if count[best] else "none"


def repeated_words(words: list[bytes]) -> int:
    """Words covered by a three-word window that is found twice or more."""
    if len(words) < 4:
        return 0
    index: dict[bytes, int] = {}
    codes = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    _, pairs = np.unique(codes[:-1] * len(index) + codes[1:], return_inverse=True)
    _, which, count = np.unique(pairs[:-1] * np.int64(len(index)) + codes[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


class Vocabulary:
    """Token ids of single words, by a SentencePiece model or a file of ranked bytes (.tiktoken)."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.space, self.byte = " ", np.zeros(max(ranks.values()) + 1, dtype=bool)
            for token, rank in ranks.items():
                self.byte[rank] = len(token.decode("utf-8", "ignore").encode()) != len(token)
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode, self.space = (lambda word: model.encode(word, num_threads=1)), ""
            self.byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])

    def tokens(self, word: bytes) -> bytes:
        text = self.space + word.decode()
        if len(text) <= PIECE:
            return array("I", self.encode(text)).tobytes()
        return np.array([t for at in range(0, len(text), PIECE) for t in self.encode(text[at : at + PIECE])], dtype="<u4").tobytes()

    def measure(self, tokens: Sequence[bytes], chars: int) -> tuple[int, float, float, float]:
        """Of a text's words, each encoded."""
        ids = np.frombuffer(b"".join(tokens), dtype="<u4")
        tokens = len(ids)
        _, count = np.unique(ids, return_counts=True)
        share = count / max(1, tokens)
        return tokens, chars / max(1, tokens), float(self.byte[ids].sum() / max(1, tokens)), max(0.0, float(-(share * np.log2(share)).sum()))


class FertilityRules:
    def __init__(self, vocabularies: tuple[str, ...], bands: dict[str, tuple[float, float, float, float]], cache: int = WORDS):
        self.vocabularies, self.bands = [Vocabulary(path) for path in vocabularies], bands
        self.tokens = Cache(lambda word: tuple(v.tokens(word) for v in self.vocabularies), cache).__getitem__

    def measure(self, text: str) -> tuple:
        words = text.encode().split()  # bytes split on ASCII white space only
        n, chars = len(words), len(text) - sum(map(text.count, SPACES))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        repeat = repeated_words(words)
        script = script_of(text)
        least, most, fallback_most, entropy_least = self.bands[script]
        kept = not (failed := n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n)
        tokens = zip(*map(self.tokens, words), strict=True) if words else ((),) * len(self.vocabularies)
        measures = [v.measure(own, chars) for v, own in zip(self.vocabularies, tokens, strict=True)]
        for n_tokens, per_token, fallback, entropy in measures:
            kept = kept and bool(least <= per_token <= most and fallback <= fallback_most and entropy >= entropy_least * np.log2(max(1, min(n_tokens, ENTROPY_TOKENS))))
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, kept, script, *(x for m in measures for x in m)


_loaded: dict[tuple[str, ...], FertilityRules] = {}


def fertility_rules(docs: DataFrame, vocabularies: str | Sequence[str], bands: dict[str, tuple[float, float, float, float]] = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """id_col, the counts and measures (of the second vocabulary with _2 and so on), base_failed and kept for each row. vocabularies:
    paths of SentencePiece models or .tiktoken files. lang_col: None for the bands of scripts only."""
    paths = (vocabularies,) if isinstance(vocabularies, str) else tuple(vocabularies)
    lang = F.lit(None).cast("string") if lang_col is None else F.col(lang_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = [*_COUNTS, *((name + _suffix(k), kind) for k in range(len(paths)) for name, kind in _MEASURES)]
    schema = T.StructType([*source.schema.fields[:2], *(T.StructField(k, T._parse_datatype_string(v)) for k, v in made)])
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _loaded:
            _loaded[paths] = FertilityRules(paths, bands)
        rules = _loaded[paths]
        rules.bands = bands
        for batch in parts(batches):
            columns = list(zip(*map(rules.measure, batch.column("text").to_pylist()), strict=True)) or [[] for _ in made]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), *(pa.array(v, kinds[k]) for v, (_, k) in zip(columns, made, strict=True))], names=["id", "lang", *(k for k, _ in made)])

    measured = source.mapInArrow(run, schema)
    if lang_col is not None:
        measured = _by_language(cut(measured), len(paths))
    return measured.drop("lang").withColumnRenamed("id", id_col)


def _middle(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys, name: the median of the values on the grid (of an even number the lower one). One row for each value goes to a window."""
    counted = rows.groupBy(*keys, F.round(F.col(value) * GRID).cast("long").alias("at")).agg(F.count("*").alias("c"))
    w = W.partitionBy(*keys)
    upto = F.sum("c").over(w.orderBy("at"))
    halves = counted.withColumns({"upto": upto, "all": F.sum("c").over(w)}).where(2 * F.col("upto") >= F.col("all"))
    return halves.groupBy(*keys).agg((F.min("at") / GRID).alias(name))


def _by_language(measured: DataFrame, vocabularies: int) -> DataFrame:
    """measured, with kept only where characters per token and entropy lie in the bands of the language."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    octave = lambda k: F.floor(F.log2(F.greatest(F.lit(1), F.col("n_tokens" + _suffix(k))).cast("double"))).cast("int")
    per_token = [F.struct(F.lit(2 * k).alias("m"), F.lit(0).alias("octave"), F.col("chars_per_token" + _suffix(k)).alias("v")) for k in range(vocabularies)]
    entropy = [F.struct(F.lit(2 * k + 1).alias("m"), octave(k).alias("octave"), F.col("entropy" + _suffix(k)).alias("v")) for k in range(vocabularies)]
    values = F.array(*per_token, *entropy)
    keys = ["of", "m", "octave"]
    rows = measured.where(F.col("n_words") >= MIN_WORDS).select(lang.alias("of"), F.sqrt(F.col("n_words").cast("double")).alias("root"), F.inline(values))
    medians = cut(_middle(rows, keys, "v", "median"))
    off = F.abs(F.col("v") - F.col("median"))
    apart = rows.join(medians, keys).select(*keys, off.alias("off"), (off * F.col("root")).alias("by_root"))
    widths = _middle(apart, keys, "off", "wide").join(_middle(apart, keys, "by_root", "by_root"), keys).join(medians, keys)
    key = lambda m, octave: m * 100 + octave
    band = F.struct(key(F.col("m"), F.col("octave")).alias("key"), F.struct("median", F.greatest("wide", F.col("median") * F.when(F.col("m") % 2 == 0, LEAST_DEVIATION[0]).otherwise(LEAST_DEVIATION[1])).alias("wide"), "by_root").alias("band"))
    bands = cut(widths.groupBy("of").agg(F.map_from_entries(F.collect_list(band)).alias("bands")))  # a row for each language, a band for each octave
    root = F.sqrt(F.col("n_words").cast("double"))

    def fits(x):
        own = F.try_element_at("bands", key(x.m, x.octave))
        return F.coalesce(F.abs(x.v - own.median) <= WIDTH * F.greatest(own.wide, own.by_root / root) + 1 / GRID, F.lit(True))

    return measured.join(bands, lang == F.col("of"), "left").withColumn("kept", F.col("kept") & F.forall(values, fits)).select(measured.columns)
