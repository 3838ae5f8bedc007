"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then calibrated by one temperature.

Texts are lower-cased, runs of other characters than letters become one space,
and n-grams of one to three characters are hashed into a fixed number of
features.  A feature's value is its share of the text's n-grams times its
inverse document frequency.  Document frequencies are counted over all
labelled rows; the weights are fitted on a bounded sample of each language
(the rows whose hash of the key is below a threshold, about ``per_language``),
a fifth of it held back for the temperature.  A text of any length is read whole, in chunks.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows without a language or key are not learned from; without any labelled row
every text is ``und``; repeated rows get equal predictions; extra columns pass
through (columns named like a result are replaced).
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import order_hash, require

BITS = 16
GRAMS = 3
CHUNK = 1 << 20
SCALE = 20.0             # shares are small numbers; keeps steps near one
PER_LANGUAGE = 500       # bound of the rows the weights are fitted on, for each language
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.01
UND = "und"

_LETTER: list = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, as a table."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def chunks(text: str):
    """Hashed n-grams of a text (int arrays), piece by piece; empty without letters."""
    letter, held = _letters(), np.array([32], np.uint64)
    for i in range(0, len(text), CHUNK):
        cp = np.frombuffer(text[i:i + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        cp = np.where(letter[cp], cp, 32).astype(np.uint64)
        cp = np.concatenate([held, cp])
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
        if i + CHUNK >= len(text) and cp[-1] != 32:
            cp = np.append(cp, np.uint64(32))
        out, h = [], cp
        for k in range(GRAMS):
            if k:
                h = h[:-1] * np.uint64(0x100000001B3) + cp[k:]
            new = h if i == 0 else h[max(0, len(held) - k):]   # those that end in this chunk
            if k == 0:
                new = new[new != 32]
            mixed = (new + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            out.append(((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64))
        if len(cp) > 2 or (cp != 32).any():
            yield np.concatenate(out)
        held = cp[-(GRAMS - 1):]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, shares) of a text."""
    total = np.zeros(1 << BITS, np.int64)
    for c in chunks(text):
        total += np.bincount(c, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray      # features x languages, times inverse document frequency
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UND, 0.0
        logits, n = np.zeros(len(self.languages)), 0
        for c in chunks(text):
            logits += self.weights.take(c, axis=0).sum(axis=0, dtype=np.float64)
            n += len(c)
        p = _softmax(SCALE * logits / max(1, n) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features x classes) by follow-the-regularised-leader (proximal), one row at a time."""
    z, n = np.zeros((1 << BITS, n_classes)), np.zeros((1 << BITS, n_classes))

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, y = rows[r]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - step * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
    a, b, r = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(labelled: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents per feature) over all rows (text): one partial count per task, summed by feature."""
    import pyarrow as pa

    def run(batches):
        df, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                seen = np.zeros(1 << BITS, bool)
                for c in chunks(value.as_py() or ""):
                    seen[c] = True
                df[:-1] += seen
                n += 1
        df[-1] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["g", "n"])

    rows = labelled.select("text").mapInArrow(run, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << BITS) + 1, np.int64)     # one row per feature at most
    for r in rows:
        out[r["g"]] = r["n"]
    return int(out[-1]), out[:-1]


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from rows (key, text, lang)."""
    import pyarrow as pa
    labelled = labelled.where("lang is not null and key is not null and text is not null")
    docs, df = document_frequencies(labelled)
    if not docs:
        return Model([], np.zeros((1, 0)), 1.0)
    # about per_language rows of each language: those whose hash is below the language's threshold
    h = order_hash(F.col("key"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()    # one row per language
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, per_language / r["n"]) * 2 ** 60))])
    sample = labelled.withColumn("h", h).where(F.col("h") < F.element_at(below, F.col("lang"))).select("h", "lang", "text")

    def run(batches):
        for batch in batches:
            for h, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                at, share = counts_of(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h], pa.int64()), pa.array([lang]), pa.array([at.astype("<i4").tobytes()], pa.binary()),
                     pa.array([share.astype("<f4").tobytes()], pa.binary())], ["h", "lang", "at", "share"])

    rows = sorted(sample.mapInArrow(run, "h bigint, lang string, at binary, share binary").collect())
    languages = sorted({r["lang"] for r in rows})
    idf = np.log((1 + docs) / (1 + df)) + 1.0
    data = []
    for r in rows:
        at = np.frombuffer(r["at"], "<i4")
        data.append((at, SCALE * np.frombuffer(r["share"], "<f4") * idf[at], languages.index(r["lang"]), r["h"] % 5 == 0))
    train = [d[:3] for d in data if not d[3]] or [d[:3] for d in data]
    held = [d for d in data if d[3]] or data
    w = ftrl(train, len(languages))
    logits = np.stack([x @ w[at] for at, x, _, _ in held])
    t = temperature(logits, np.array([d[2] for d in held]))
    return Model(languages, (w * idf[:, None]).astype(np.float32), t)


def learnable(key: Column) -> Column:
    """Rows that may be learned from: crc32 of the key as text leaves no remainder of 1 by 3."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Columns of ``df`` plus the predicted language and its calibrated probability."""
    import pyarrow as pa
    require(df, text_col)
    new = [lang_col, score_col]
    keep = [c for c in df.columns if c not in new or c == text_col]
    src = df.select(*[df[c].alias(f"c_{i}") for i, c in enumerate(keep)])
    at = keep.index(text_col)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = [model.predict(t) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()),
                                                  pa.array([f[1] for f in found], pa.float64())],
                                                 [*part.schema.names, "n_0", "n_1"])

    schema = T.StructType([*src.schema.fields, T.StructField("n_0", T.StringType()), T.StructField("n_1", T.DoubleType())])
    done = src.mapInArrow(run, schema)
    return done.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep) if c not in new],
                       *[F.col(f"n_{k}").alias(c) for k, c in enumerate(new)])
