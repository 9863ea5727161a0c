"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed
character n-grams predicts that bit of a text.  Decoding weighs every bit's
loss by how well that bit's classifier told its two sides apart on training
texts and takes the language with the least weighted loss, so a few wrong bits
are outvoted.  The margin between the two best languages flags ambiguous texts.

Texts are read whole: all their n-grams (one to three UTF-8 bytes, lower-cased,
digits and ASCII punctuation folded to a blank) count.

Defined cases: a null text and a text without a letter are ``und`` with score 0;
with no labelled row at all every text is ``und``; with one language only it is
predicted with score 1; ties go to the language first by code point; repeated
rows get equal results; an empty table gives no rows; further columns are kept
on request, and those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.llm.sampling import MAX_TEXTS, drawn, fitted
from strandline.llm.workspace import Batches, absent, cased, crc_mod, text_steps, worker

#: Bounds of the training sample: texts, and bytes of features (6 each).
TEXTS_PER_LANGUAGE = 300
SAMPLE_BYTES = 48_000_000
#: Lead in probability over the next language below which a text is flagged.
AMBIGUOUS_BELOW = 0.1
BITS = 14  # of the n-gram hash
_LETTER = regex.compile(r"\p{L}")

# Bytes as classes: letters lower-cased, digits and ASCII punctuation to a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
for _low, _high in ((0, 65), (91, 97), (123, 128)):
    _FOLD[_low:_high] = 32
#: Texts are cut into strides of so many bytes for counting (bounds memory).
_STRIDE = 1 << 20


def features(text: str) -> np.ndarray:
    """Share of each hashed n-gram among the text's n-grams, square-rooted."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    count = np.zeros(1 << BITS, dtype=np.float64)
    for at in range(0, len(raw), _STRIDE):
        b = _FOLD[raw[at : at + _STRIDE + 2]].astype(np.uint32)
        b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]  # one blank for many
        if len(b) < 3:
            b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
        tri = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        grams = np.concatenate([tri * np.uint32(0x9E3779B1), ((tri >> 8) | (2 << 24)) * np.uint32(0x85EBCA6B), ((tri >> 16) | (1 << 24)) * np.uint32(0xC2B2AE35)])
        count += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(count / count.sum()).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1/-1: all splits for few languages, else well separated random ones."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 5:
        cols = [[1, *[1 if (m >> k) & 1 else -1 for k in range(n - 1)]] for m in range(2 ** (n - 1) - 1)]
        return np.array(cols, dtype=np.int8).T
    rng, best, width = np.random.default_rng(seed), None, int(np.ceil(15 * np.log2(n)))
    for _ in range(max(1, min(200, CODE_STEPS // n**2))):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        m = m[:, np.abs(m.sum(axis=0)) < n]  # a bit with one side only says nothing
        apart = _least_distance(m)
        if best is None or apart > best[0]:
            best = (apart, m)
    return best[1]


#: Pairs of codewords that are compared in the search for separated ones.
CODE_STEPS = 400_000_000


def _least_distance(code: np.ndarray) -> int:
    """Bits in which the two nearest codewords differ, by products of strips."""
    c, least = code.astype(np.float32), code.shape[1]
    for at in range(0, len(c), 512):
        same = c[at : at + 512] @ c.T
        same[np.arange(len(same)), at + np.arange(len(same))] = -c.shape[1]
        least = min(least, int(c.shape[1] - same.max()) // 2)
    return least


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows add up to 1

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of every language for rows of features."""
        margin = x @ self.weights + self.bias
        high = self.trust * (self.code > 0)
        return np.logaddexp(0, -margin) @ high.T + np.logaddexp(0, margin) @ (self.trust - high).T


def _encode(text: str) -> bytes:
    """The features of a text that are not zero: their numbers, then their values."""
    x = features(text)
    at = np.flatnonzero(x)
    return at.astype("<u2").tobytes() + x[at].astype("<f4").tobytes()


def _shortened(code: bytes, size: int) -> bytes:
    """The features with the largest values, in so many bytes; one at least."""
    n = len(code) // 6
    at, x = np.frombuffer(code, "<u2", n), np.frombuffer(code, "<f4", n, 2 * n)
    kept = np.sort(np.argsort(-x, kind="stable")[: max(1, size // 6)])
    return at[kept].tobytes() + x[kept].tobytes()


class _Rows:
    """Encoded texts, as dense rows on demand."""

    def __init__(self, codes: Sequence[bytes]):
        self._codes = codes

    def __len__(self) -> int:
        return len(self._codes)

    def dense(self, part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(part), 1 << BITS), np.float32)
        for row, i in zip(x, part.tolist()):
            code = self._codes[i]
            n = len(code) // 6
            row[np.frombuffer(code, "<u2", n)] = np.frombuffer(code, "<f4", n, 2 * n)
        return x


def fit(texts: Sequence[tuple[str, str]], **how) -> Model:
    """``(language, text)`` pairs to a model: a logistic classifier for each bit."""
    return fit_encoded([(name, _encode(t)) for name, t in texts], **how)


def fit_encoded(texts: Sequence[tuple[str, bytes]], epochs: int = 15, rate: float = 4.0, seed: int = 3) -> Model:
    """The same of encoded texts, in small steps: no more than 64 rows are dense."""
    names = sorted({name for name, _ in texts})
    code = codewords(len(names))
    index = {name: i for i, name in enumerate(names)}
    label = np.array([index[name] for name, _ in texts], dtype=int)
    rows = _Rows([c for _, c in texts])
    strips = np.array_split(np.arange(len(rows)), max(1, len(rows) // 64))
    mean = sum((rows.dense(s).sum(axis=0) for s in strips), np.zeros(1 << BITS, np.float32)) / max(1, len(rows))
    y = code[label].astype(np.float32)
    w, b = np.zeros((1 << BITS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    size = np.bincount(label, minlength=len(names)).astype(np.float32)
    importance = (1 / size[label] if len(texts) else size)[:, None]  # languages count alike, whatever their share
    importance = importance / importance.mean() if len(texts) else importance
    rng = np.random.default_rng(seed)
    for epoch in range(epochs if len(names) > 1 else 0):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            x = rows.dense(part) - mean
            g = -importance[part] * y[part] / (1 + np.exp(y[part] * (x @ w + b)))
            step = rate / (1 + 0.1 * epoch)
            w -= step * (x.T @ g / len(part) + 1e-5 * w)
            b -= 0.1 * step * g.mean(axis=0)
    margin = np.concatenate([(rows.dense(s) - mean) @ w + b for s in strips]) if len(rows) else y
    trust = np.array([[((margin[label == i, k] * code[i, k]) > 0).mean() for k in range(code.shape[1])] for i in range(len(names))])
    trust = np.maximum(trust.reshape(code.shape), 1e-3)
    return Model(names, code.astype(np.float32), w, b - mean @ w, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(model: Model, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and margin over the second best."""
    ok = [t is not None and bool(model.languages) and _LETTER.search(t) is not None for t in texts]
    name, score, margin = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    at = np.flatnonzero(ok)
    for part in (at[k : k + 64] for k in range(0, len(at), 64)):
        loss = model.losses(np.array([features(texts[i]) for i in part])).astype(np.float64)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * model.code.shape[1])
        p /= p.sum(axis=1, keepdims=True)
        best = np.argmin(loss, axis=1)
        for i, k, row in zip(part, best, p):
            name[i], score[i] = model.languages[k], row[k]
            margin[i] = row[k] - (np.partition(row, -2)[-2] if len(row) > 1 else 0.0)
    return name, score, margin


def train(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE, max_texts: int = MAX_TEXTS) -> Model:
    """Fits on documents outside fold 2 whose language is known: a sample bounded in
    texts, characters of each and bytes of features, drawn and fitted in tasks.  Where
    the languages are so many that a text's features exceed its language's share, the
    strongest of them stay, so that every language is learnt."""
    rows = docs.filter(crc_mod(F.col("doc_id")) != 2).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return fitted(drawn(rows, "lang", per_language, max_texts), _encode, fit_encoded, SAMPLE_BYTES, _shortened)


RESULTS = ("lang_pred", "score", "ambiguous")


def identify(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",), ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """``columns`` and lang_pred, score, ambiguous of every document.  The caller's
    columns that are named like a result, in whatever case, give way to it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BITS and the code
    columns = absent(columns, RESULTS)
    out = docs.select(*[f"`{c}`" for c in columns]).schema
    at = cased(docs.select(*[f"`{c}`" for c in columns]), "text") if "text" in map(str.lower, columns) else len(out)  # a text is sent once
    keep = docs.select(*[f"`{c}`" for c in columns], *[F.col("text").alias("__text")] * (at == len(out)))
    schema = StructType([*out, *StructType.fromDDL("lang_pred string, score double, ambiguous boolean")])

    @worker
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in text_steps(batches, at):
            name, score, margin = predict(m, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(name, pa.string()), pa.array(score), pa.array(margin < ambiguous_below)], names=schema.names)

    return keep.mapInArrow(run, schema)


def clear(docs: DataFrame, model: Model, least_lead: float = AMBIGUOUS_BELOW) -> DataFrame:
    """The documents with a letter whose language leads the next by ``least_lead`` or
    more, rows and columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = cased(docs, "text")

    @worker
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in text_steps(batches, at):
            name, _, margin = predict(m, b.column(at).to_pylist())
            yield b.filter(pa.array([n != "und" and x >= least_lead for n, x in zip(name, margin)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
