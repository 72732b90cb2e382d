"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into blocks of BLOCK bytes, each block
is compressed with either dictionary, and the difference of the two total sizes, divided by the text's size in bytes, says which
kind of text it is like. A logistic curve, fitted on labelled rows that the dictionaries have not seen, turns it into the
probability of a good text.

Fitting reads whole texts of a bounded sample of labelled rows: of those of FIT_TEXT_BYTES bytes or less, in the order of a hash of
their id, the first FIT_ROWS (of rows that share an id, the text of least hash), and no more than FIT_BYTES bytes in all (fewer where there are fewer). All their blocks count, so the
driver holds at most FIT_BYTES. Scoring reads every whole text, however long.

Nulls: a null text counts as empty and gets the score of difference 0; rows with a null label or id are not learnt from.
Repeated rows score alike; extra columns are dropped (keep_good keeps them, whatever their names). Rows whose ids have one hash are
taken by id, then by label. A score at THRESHOLD is good. Without labelled rows of both kinds, every score is the share of good rows, or
0.5 without any. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, forget, parts

FIT_ROWS, FIT_BYTES, FIT_TEXT_BYTES, BLOCK = 6000, 32 << 20, 1 << 20, 512
DICTIONARY_BYTES, LEVEL = 65536, 3
#: Of the remainders of crc32(id as text) by 4: the one that is never learnt from, and the one that the curve is fitted on.
HELD_OUT, CALIBRATION = 2, 3
THRESHOLD = 0.7


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % 4


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    offset: float
    slope: float

    def compressors(self) -> list:
        import zstandard

        out = []
        for raw in (self.good, self.bad):
            kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            d = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        return out


def difference(text: bytes, compressors: list) -> float:
    """(size by the bad dictionary - size by the good one) / size of the text."""
    good, bad = compressors
    return sum(len(bad(b)) - len(good(b)) for b in blocks(text)) / max(1, len(text))


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary themselves
        return b"".join(samples)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope by Newton's method, with a slight pull towards 0 and the prior of the labels as a start."""
    scale = float(np.abs(x).mean()) or 1.0
    design, w = np.c_[np.ones(len(x)), x / scale], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), design.T @ (y - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
    return float(w[0]), float(w[1] / scale)


def _measure(rows: DataFrame, model: QualityModel) -> DataFrame:
    """id, label, text -> id, label, difference."""
    schema = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("difference", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in parts(batches):
            made = [difference(x.encode(), compressors) for x in batch.column("text").to_pylist()]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made, pa.float64())], names=[*rest, "difference"])

    return rows.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> QualityModel:
    """A model from the labelled rows (label 1 or 0) whose fold is not HELD_OUT."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id")) != HELD_OUT))
    known = known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    chosen = known.orderBy(F.xxhash64("id"), "id", "label").limit(rows)  # at most `rows` short rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    least = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text"))).alias("t")
    found = texts.join(F.broadcast(chosen.distinct()), "id").groupBy("id", "label").agg(least).select("id", "label", "t.text", F.octet_length("t.text").cast("long").alias("bytes"))
    found = cut(found.where(F.col("bytes") <= FIT_TEXT_BYTES))
    upto = F.sum("bytes").over(W.orderBy(F.xxhash64("id"), "id", "label").rowsBetween(W.unboundedPreceding, 0))  # at most `rows` short rows
    taken = found.select("id", "label", upto.alias("upto")).where(F.col("upto") <= FIT_BYTES).select("id", "label")
    sample = cut(found.join(F.broadcast(taken), ["id", "label"]).select("id", "label", "text"))
    forget(found)
    if sample.isEmpty():
        return QualityModel(b"", b"", 0.0, 0.0)
    kept = sample.where(fold(F.col("id")) != CALIBRATION).collect()  # at most FIT_BYTES
    kept.sort(key=lambda r: (r.id, r.label))
    by_label = {q: [x for r in kept if r.label == q for x in blocks(r.text.encode())] for q in (0, 1)}
    share = sample.agg(F.avg("label")).first()[0]
    if not by_label[0] or not by_label[1]:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(b"", b"", float(np.log(p / (1 - p))), 0.0)
    for own in by_label.values():
        random.Random(0).shuffle(own)
    model = QualityModel(_dictionary(by_label[1]), _dictionary(by_label[0]), 0.0, 0.0)
    measured = sorted((r.difference, r.label) for r in _measure(sample.where(fold(F.col("id")) == CALIBRATION), model).select("label", "difference").collect())
    if len({y for _, y in measured}) < 2:  # too few rows to leave some out
        measured = sorted((r.difference, r.label) for r in _measure(sample, model).select("label", "difference").collect())
    model.offset, model.slope = _logistic(*(np.array(v, dtype=float) for v in zip(*measured, strict=True)))
    forget(sample)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, difference, score (0 to 1) and predicted (1 if score >= THRESHOLD) for each row."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    score = 1 / (1 + F.exp(-(F.lit(model.offset) + F.lit(model.slope) * F.col("difference"))))
    return _measure(texts, model).withColumn("score", score).select(F.col("id").alias(id_col), "difference", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores THRESHOLD or more. One pass, no shuffle."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # columns may share a name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in parts(batches):
            made = np.array([difference((x or "").encode(), compressors) for x in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-(model.offset + model.slope * made)))
            yield batch.filter(pa.array(score >= THRESHOLD))

    at = docs.columns.index(text_col)
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema, strict=True)])
    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)
