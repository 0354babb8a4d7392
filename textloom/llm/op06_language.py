"""Language ID by compression with per-language zstandard dictionaries.

Every learned language has a raw-content dictionary: a bounded sample of its texts, whole. A text is
reduced to lower-case letters and single spaces and cut into pieces of ``PIECE`` bytes (else a long text
would serve as its own dictionary), each piece of it is compressed with each dictionary, and the language
with the smallest total wins. The margin to the second decides about rejection. Scoring is one narrow pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, bounded_sample, fold, released

PIECE, LEVEL = 8192, 5
#: Bounds of the training sample: different texts considered for each language, bytes of those that are taken.
SAMPLE_DOCS, DICTIONARY = 400, 262144
#: A text is rejected if the best total is not at least this share below the second.
MARGIN = 0.01
LETTER = re.compile(r"[^\W\d_]")


#: ASCII bytes that are no letters become spaces; bytes of other letters stay.
_SPACED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def reduced(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "ignore").translate(_SPACED).split())


def _pieces(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


@dataclass
class Model:
    """Dictionary bytes by language, the language of most training texts first: it wins where totals are equal."""

    dictionaries: dict[str, bytes]
    compressors: list | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def totals(self, text: str) -> np.ndarray:
        """Compressed size of the whole text for each language, less the frames' fixed part."""
        if self.compressors is None:
            self.compressors = []
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        parts = _pieces(reduced(text))
        return np.array([sum(len(c(p)) for p in parts) for c in self.compressors], np.float64) - 5 * len(parts)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). Texts without a letter, or without a model, are ``und``."""
        if not text or not LETTER.search(text) or not self.dictionaries:
            return "und", 0.0, 0.0
        if len(self.dictionaries) == 1:
            return next(iter(self.dictionaries)), 1.0, 1.0
        t = self.totals(text)
        order = np.argsort(t, kind="stable")
        best, second = t[order[0]], t[order[1]]
        margin = float((second - best) / max(second, 1.0))
        return list(self.dictionaries)[order[0]], float(1 / (1 + np.exp(-40 * margin))), margin


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Learn from documents with a language outside the held-out fold.

    Equal texts of a language teach once, whatever their ids. Of each language about SAMPLE_DOCS different
    texts are chosen by a hash of the text, and of these, in hash order, whole ones while they fit DICTIONARY
    bytes together; these bytes are all that the driver sees of a language. Only of a language that has no text
    as short as that, one text's first DICTIONARY characters are taken. Null texts and languages teach nothing.
    """
    scratch = Scratch(docs.sparkSession)
    known = docs.filter("lang is not null and text is not null").filter(fold(F.col("doc_id"), folds) != held_out)
    h = F.xxhash64("text").alias("h")
    slim = known.select("lang", h, F.octet_length("text").alias("bytes")).groupBy("lang", "h").agg(F.max("bytes").alias("bytes"))
    slim = scratch.save(slim, "texts")
    counts = {r["lang"]: r["n"] for r in slim.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("lang").orderBy(F.col("bytes") > DICTIONARY, F.xxhash64(F.lit("order"), "h"), "h")  # some SAMPLE_DOCS rows each
    few = bounded_sample(slim, "lang", SAMPLE_DOCS, "h").withColumn("upto", F.sum("bytes").over(order)).withColumn("rank", F.row_number().over(order))
    few = scratch.save(few.filter((F.col("upto") <= DICTIONARY) | (F.col("rank") == 1)).select("lang", "h"), "chosen")
    # bounded: SAMPLE_DOCS rows of a language
    texts = known.select("lang", h, "text").join(F.broadcast(few), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    by: dict[str, list[bytes]] = {}
    for r in texts.select("lang", "h", F.substring("text", 1, DICTIONARY).alias("text")).orderBy("lang", "h").collect():
        by.setdefault(r["lang"], []).append(reduced(r["text"]))
    return Model({k: b" ".join(by[k]) or b" " for k in sorted(by, key=lambda k: (-counts[k], k))})


def classify(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected): one row per row of docs, repeated rows and null ids included.

    Null texts and texts without a letter are ``und``, score 0. Where totals are equal the language of more
    training texts is predicted, with score 0.5 and margin 0, so such a text is rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column("text")]
            lang, score, gap = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(gap, pa.float64()), pa.array([x[0] == "und" or x[2] < margin for x in found], pa.bool_())],
                ["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def accepted(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose language is clear, columns unchanged; the text never leaves its task."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = (model.predict(t.as_py()) for t in b.column("text"))
            yield b.filter(pa.array([x[0] != "und" and x[2] >= margin for x in found], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema).select(*columns)
