"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a learned lexicon (words and word beginnings that mark toxic training
texts; none is given), how near hits stand to second-person words, and rates of capitals,
punctuation and obfuscated spellings. One dictionary lookup per token turns a text into a string
of flag bytes; everything else is arithmetic on those bytes.

Training: labels give a bounded sample (``per_class`` documents of either class). Each half of it
teaches a lexicon that describes the other half, so the trees see lexicon hits as they will be on
new texts; the model's own lexicon is then learned from both. Out-of-fold scores of the trees are
calibrated. Scoring is one narrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Scratch, bounded_sample, fold
from textloom.llm.trees import Boosted, Isotonic

# Second-person words of the four languages.
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted tus vosotros".split()
# Characters that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})

PREFIXES = (4, 5, 6)
HIT, WEAK, YOU, CAPS, PUNCT, HIDDEN, DIGIT, SINGLE = (1 << i for i in range(8))
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_INNER = re.compile(r"[\W_]+")
_SPELLED = re.compile(rb"[\x80-\xff]{4,}")
FEATURES = (
    "log_words", "hit_density", "log_hits", "weak_density", "log_weak", "best_window", "you_density", "near_you", "log_near_you",
    "caps_rate", "punct_rate", "hidden_rate", "digit_rate", "single_rate", "upper_ratio", "bang_rate", "hidden_hits",
)


def normal(word: str) -> str:
    return _EDGE.sub("", word.lower())


def revealed(word: str) -> str:
    """A word without the marks and look-alikes that hide it."""
    return _INNER.sub("", word.lower().translate(LEET))


def pieces(word: str) -> list[str]:
    """Lexicon keys of a normal word: itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)] if word else []


@dataclass
class Lexicon:
    strong: frozenset
    weak: frozenset

    def level(self, word: str) -> int:
        keys = pieces(word)
        if any(k in self.strong for k in keys):
            return 2
        return int(any(k in self.weak for k in keys))


class Flags(dict):
    """Flag byte of a raw token, remembered for the commonest tokens up to a fixed number."""

    LIMIT = 300_000

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.second = lexicon, frozenset(SECOND)
        self.lengths = sorted({len(w) for w in lexicon.strong if len(w) > 3 and not w.endswith("*")})

    def spelled(self, joined: str) -> int:
        """At how many offsets of a run of letters a strong word of four letters or more, or a strong beginning, is spelled."""
        strong, n = self.lexicon.strong, len(joined)
        return sum(
            any(joined[i : i + k] in strong for k in self.lengths if i + k <= n) or any(joined[i : i + k] + "*" in strong for k in PREFIXES if i + k < n) for i in range(n - 3)
        )

    def __missing__(self, raw: str) -> int:
        word = normal(raw)
        level, out = self.lexicon.level(word), 0
        inner = word and not word.isalpha()
        if (inner or raw[:1] in "0134571@$!|€") and level < 2:
            shown = self.lexicon.level(revealed(raw))
            if shown == 2:
                out, level = HIDDEN, 2
        out |= (HIT if level == 2 else WEAK if level else 0) | (YOU if word in self.second else 0)
        letters = [c for c in raw if c.isalpha()]
        out |= CAPS if len(letters) > 1 and all(c.isupper() for c in letters) else 0
        out |= PUNCT if len(raw) > len(letters) and not raw.isalnum() else 0
        out |= DIGIT if any(c.isdigit() for c in raw) else 0
        out |= SINGLE if len(raw) == 1 and letters else 0
        if len(self) >= self.LIMIT:
            self.clear()
        self[raw] = out
        return out


def features(text: str | None, flags: Flags) -> list[float]:
    """The dense features of one whole text; an empty or null text has zeros."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    code = bytes(map(flags.__getitem__, words))
    a, n = np.frombuffer(code, np.uint8), len(words)
    hit = np.flatnonzero(a & HIT)
    spelled = 0
    for m in _SPELLED.finditer(code):  # a word written letter by letter
        joined = "".join(words[m.start() : m.end()]).lower()
        spelled += flags.spelled(joined)
    rate = lambda bit: float(np.count_nonzero(a & bit)) / n
    hits, weak = len(hit) + spelled, int(np.count_nonzero(a & WEAK))
    you = np.flatnonzero(a & YOU)
    near = best = 0.0
    if len(hit):
        best = float((np.searchsorted(hit, hit + 50) - np.arange(len(hit))).max()) / 50
        if len(you):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(hit - you[np.maximum(at - 1, 0)]))
            near = float(np.count_nonzero(gap <= 5))
    raw = np.frombuffer((text or "").encode("utf-8", "ignore"), np.uint8)
    upper = int(np.count_nonzero((raw >= 65) & (raw <= 90)))
    lower = int(np.count_nonzero((raw >= 97) & (raw <= 122)))
    bang = int(np.count_nonzero((raw == 33) | (raw == 63)))
    return [
        float(np.log1p(n)), hits / n, float(np.log1p(hits)), weak / n, float(np.log1p(weak)), best, len(you) / n, near / n, float(np.log1p(near)),
        rate(CAPS), rate(PUNCT), rate(HIDDEN), rate(DIGIT), rate(SINGLE), upper / max(1, upper + lower), bang / n,
        float(np.log1p(spelled + np.count_nonzero(a & HIDDEN))),
    ]


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, toxic, clean): in how many texts of either label a piece occurs, for each batch."""
    for b in batches:
        found = (Counter(), Counter())
        for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set((text or "").split())
            found[int(y)].update({p for w in words for x in {normal(w), revealed(w)} for p in pieces(x)})
        keys = list(found[0] | found[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())],
            ["piece", "toxic", "clean"],
        )


def learn_lexicon(rows: DataFrame, size: int = 4000) -> Lexicon:
    """The pieces with the most significant excess in toxic texts; ``size`` bounds what the driver gets."""
    base = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {int(r["toxic"]): r["n"] for r in base}
    pos, neg = n.get(1, 0), n.get(0, 0)
    strong, weak = set(), set()
    if pos and neg:
        t, c = F.col("toxic"), F.col("clean")
        rate, all_rate = t / (t + c), pos / (pos + neg)
        gain = 2 * (t * F.log(rate / all_rate) + F.when(c > 0, c * F.log((1 - rate) / (1 - all_rate))).otherwise(0.0))
        counted = rows.mapInArrow(_document_counts, "piece string, toxic long, clean long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        lift = (t / pos) / ((c + 0.5) / (neg + 1))
        picked = counted.filter((t >= 3) & (lift >= 4)).withColumn("gain", gain).filter("gain >= 9").withColumn("lift", lift)
        for r in picked.orderBy(F.desc("gain"), "piece").limit(size).collect():
            (strong if r["gain"] >= 16 and r["lift"] >= 8 else weak).add(r["piece"])
    return Lexicon(frozenset(strong), frozenset(weak - strong))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic
    flags: Flags | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"flags": None}

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        self.flags = self.flags if self.flags is not None else Flags(self.lexicon)
        return np.array([features(t, self.flags) for t in texts], np.float64).reshape(-1, len(FEATURES))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.calibration.predict(self.trees.raw(self.matrix(texts))) if texts else np.zeros(0)


def _extract(lexicons: tuple[Lexicon, Lexicon]):
    """Features of the sampled texts, by the lexicon of the half that a text is not in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = [Flags(x) for x in lexicons]
        for b in batches:
            x = [features(t, flags[1 - h]) for t, h in zip(b.column("text").to_pylist(), b.column("half").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, per_class: int = 6000) -> Model:
    """Learn from labelled documents outside the held-out fold.

    The sample is bounded by about ``per_class`` labelled documents of either class: at most 2 x per_class
    rows of (id, label) are broadcast, and as many texts and feature rows reach trees and driver. Rows with
    a null label or id, and labels without document, teach nothing; of contradictory labels of a document
    the toxic one counts; of rows that repeat an id the least text teaches. Without both classes the score
    is the share of toxic labels.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(fold(F.col("doc_id"), folds) != held_out)
    few = F.broadcast(bounded_sample(known, "toxic", per_class))
    half = (F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2))).cast("int").alias("half")
    one = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = Scratch(docs.sparkSession).save(one.select("doc_id", "toxic", half, "text"), "labelled")
    halves = tuple(learn_lexicon(rows.filter(F.col("half") == h).select("text", "toxic")) for h in (0, 1))
    table = rows.mapInArrow(_extract(halves), "doc_id long, toxic int, x array<double>").toPandas()
    table = table.sort_values("doc_id", kind="stable")
    x = np.array(table["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = table["toxic"].to_numpy(np.float64)
    trees = Boosted().fit(x, y)
    out = np.zeros(len(y))
    part = np.arange(len(y)) % 4
    for k in range(4):
        if (part != k).any() and (part == k).any():
            out[part == k] = Boosted().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(learn_lexicon(rows.select("text", "toxic")), trees, Isotonic().fit(out, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document; a null or empty text is scored like any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
