"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are surface measures of the line and of
its neighbours, and the chain's transitions let runs of bad lines support each
other.  The field is fitted by conditional likelihood on documents whose
quality is known, each line taking its document's label.  A document's score is
the length-weighted mean of its lines' forward-backward marginals for good,
calibrated on the training texts to a probability.

Defined cases: a null or empty text has one empty line and the score that the
field gives it; lines are separated by newlines; repeated rows get equal
scores; with no labelled rows, or one label only, every score is the label's
share (0.5 without labels); an empty table gives no rows; further columns are
kept on request.  Features of a very long text are made piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.llm.sampling import drawn, fitted, lot, part_of_lots
from strandline.llm.workspace import Batches, absent, cased, crc_mod, text_steps, worker

#: Bounds of the training sample: texts, and bytes of line features.
TEXTS_PER_LABEL = 1200
SAMPLE_BYTES = 24_000_000
#: Lines of a document are scored in strides of so many characters.
_STEP = 2_000_000

# Byte classes: 0 lower case, 1 upper case, 2 digit, 3 sentence punctuation,
# 4 other ASCII signs, 5 white space, 6 beyond ASCII (parts of letters mostly)
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[:128] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:?!'\"-()"]] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
N_CLASSES = 7
OWN = 20


def own_features(lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Measures of each line alone, and the lines' sizes in bytes."""
    raw = [x.encode("utf-8", "replace") for x in lines]
    size = np.array([len(r) for r in raw], dtype=np.int64)
    # every line gets a blank in front, so that no segment is empty
    flat = np.frombuffer(b"".join([b" " + r for r in raw]), dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kind = _CLASS[flat]
    count = np.stack([np.add.reduceat(kind == k, at, dtype=np.int64) for k in range(N_CLASSES)], axis=1).astype(np.float64)
    count[:, 5] -= 1
    signs = [np.add.reduceat(flat == ord(c), at, dtype=np.int64) for c in "!.,"]
    before = np.concatenate([[32], flat[:-1]])
    word = np.add.reduceat((kind != 5) & (_CLASS[before] == 5), at, dtype=np.int64)
    # a run of the same sign twice, and a sign at a word's end
    double = np.add.reduceat((flat == before) & ((kind == 3) | (kind == 4)), at, dtype=np.int64)
    after = np.concatenate([kind[1:], [5]])
    ends = np.add.reduceat(((kind == 3) | (kind == 4)) & (after == 5), at, dtype=np.int64)
    lone = np.add.reduceat(((kind == 3) | (kind == 4)) & (after == 5) & (_CLASS[before] == 5), at, dtype=np.int64)
    upper_start = np.add.reduceat((kind == 1) & (_CLASS[before] == 5), at, dtype=np.int64)
    variety, repeat = np.empty(len(lines)), np.empty(len(lines))
    for i, x in enumerate(lines):
        words = x.split()
        variety[i] = len(set(words)) / max(1, len(words))
        repeat[i] = len({*zip(words, words[1:], words[2:])}) / max(1, len(words) - 2)
    n, w = np.maximum(size, 1), np.maximum(word, 1)
    letters = count[:, 0] + count[:, 1] + count[:, 6]
    own = [
        *(count[:, k] / n for k in range(N_CLASSES)),
        count[:, 1] / np.maximum(count[:, 0] + count[:, 1], 1),
        signs[0] / w,
        signs[1] / w,
        signs[2] / w,
        double / w,
        ends / w,
        lone / w,
        upper_start / w,
        np.minimum(letters / w, 30) / 10,
        variety * np.minimum(1, np.log1p(word) / 5),
        repeat * np.minimum(1, np.log1p(word) / 5),
        np.log1p(word) / 5,
        size == 0,
    ]
    return np.stack([x.astype(np.float32) for x in own], axis=1), size


def with_neighbours(own: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A line's features: its own, the line before's and the line after's (zeros at
    a text's ends), and whether it is its text's first and last."""
    none = np.zeros((1, OWN), np.float32)
    previous = np.where(first[:, None], 0, np.concatenate([none, own[:-1]]))
    following = np.where(last[:, None], 0, np.concatenate([own[1:], none]))
    return np.concatenate([own, previous, following, first[:, None], last[:, None]], axis=1, dtype=np.float32)


def _ends(per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.zeros(int(per_text.sum()), bool)
    first[np.concatenate([[0], np.cumsum(per_text)[:-1]])] = True
    return first, np.concatenate([first[1:], [True]])


def line_features(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, lines a text, and each line's weight (its length)."""
    own, size = own_features([x for t in texts for x in t.split("\n")])
    per_text = np.array([t.count("\n") + 1 for t in texts], dtype=np.int64)
    return with_neighbours(own, *_ends(per_text)), per_text, np.maximum(size, 1).astype(np.float64)


def _line_pieces(text: str, step: int) -> Iterator[list[str]]:
    """A text's lines in pieces of some characters each (a longer line alone)."""
    at = 0
    while at <= len(text):
        end = text.find("\n", min(len(text), at + step))
        end = len(text) if end < 0 else end
        yield text[at:end].split("\n")
        at = end + 1


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares for the line itself, and a constant."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z[:, :OWN] ** 2 / 6, np.ones((len(z), 1), z.dtype)], axis=1)


def _messages(score: np.ndarray, per_text: np.ndarray, move: np.ndarray) -> np.ndarray:
    """At each line, the log of the summed weights of all labellings up to it that
    end in bad or good.

    Chains are cut into parts of about the root of the longest one's lines, and all
    parts advance together: once from either label, which gives what a part does
    to a message that enters it, and once more from the message that does.
    """
    step = max(8, int(np.sqrt(per_text.max())))
    parts = -(-per_text // step)
    text = np.repeat(np.arange(len(per_text)), parts)
    head = np.cumsum(parts) - parts
    place = (np.arange(len(text)) - head[text]) * step
    start = (np.cumsum(per_text) - per_text)[text] + place
    size = np.minimum(step, per_text[text] - place)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")

    def sweep(into: np.ndarray) -> np.ndarray:
        out = np.zeros_like(score)
        out[start] = score[start] + into
        for t in range(1, len(live)):
            at = start[order[: live[t]]] + t
            a = out[at - 1]
            out[at] = score[at] + np.logaddexp(a[:, :1] + move[0], a[:, 1:] + move[1])
        return out

    into = np.zeros((len(text), 2))
    if parts.max() > 1:
        end, never = start + size - 1, -1e30
        through = np.stack([sweep(np.broadcast_to([0, never], into.shape))[end], sweep(np.broadcast_to([never, 0], into.shape))[end]], axis=1)
        for k in range(int(parts.max()) - 1):
            at = head[parts > k + 1] + k
            a = into[at][:, :, None] + through[at]
            a = np.logaddexp(a[:, 0], a[:, 1])
            into[at + 1] = np.logaddexp(a[:, :1] + move[0], a[:, 1:] + move[1])
    return sweep(into)


def marginals(good: np.ndarray, per_text: np.ndarray, move: np.ndarray, transitions: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over all chains at once.

    ``good``: the lines' log-odds for good; ``move``: 2 x 2 scores of bad/good
    followed by bad/good.  Returns each line's probability of good and, unless
    they are not wanted, each text's expected counts of the four transitions.
    """
    if not len(per_text):
        return np.zeros(0), np.zeros((0, 4))
    score = np.stack([np.zeros_like(good), good], axis=1)
    alpha = _messages(score, per_text, move)
    beta = _messages(score[::-1], per_text[::-1], move.T)[::-1]  # the line's own score included
    both = alpha + beta - score
    p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
    if not transitions:
        return p, None
    text = np.repeat(np.arange(len(per_text)), per_text)
    at = np.flatnonzero(text[1:] == text[:-1]) + 1
    joint = (alpha[at - 1][:, :, None] + move[None] + beta[at][:, None, :]).reshape(len(at), 4)
    joint = np.exp(joint - joint.max(axis=1, keepdims=True))
    joint /= joint.sum(axis=1, keepdims=True)
    return p, np.stack([np.bincount(text[at], joint[:, k], minlength=len(per_text)) for k in range(4)], axis=1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    move: np.ndarray
    slope: float
    shift: float

    def _chain(self, good: np.ndarray, per_text: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.full(len(good), 0.5) if self.weights is None else marginals(good, per_text, self.move, False)[0]
        at = np.concatenate([[0], np.cumsum(per_text)[:-1]])
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at), good

    def _emit(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.weights is None else (_expand(x, self.mean, self.scale) @ self.weights).astype(np.float64)

    def raw(self, texts: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Length-weighted mean marginal of every text, and the lines' marginals."""
        x, per_text, weight = line_features(texts)
        mean, good = self._chain(self._emit(x), per_text, weight)
        return mean, np.split(good, np.cumsum(per_text)[:-1])

    def raw_long(self, text: str, step: int) -> np.ndarray:
        """The same mean for one text, whose features are made piece by piece: of
        all lines only their scores and sizes are held."""
        score, weight = [], []
        before, held, first = np.zeros((1, OWN), np.float32), None, True

        def emit(own: np.ndarray, after: np.ndarray, last: bool) -> None:
            nonlocal before, first
            x = np.concatenate([before, own, after])
            ends = np.zeros((2, len(x)), bool)
            ends[0, 1], ends[1, -2] = first, last
            score.append(self._emit(with_neighbours(x, *ends)[1:-1]))
            before, first = own[-1:], False

        for lines in _line_pieces(text, step):
            own, size = own_features(lines)
            weight.append(np.maximum(size, 1).astype(np.float64))
            if held is not None:
                emit(held, own[:1], False)
            held = own
        emit(held, np.zeros((1, OWN), np.float32), True)
        score, weight = np.concatenate(score), np.concatenate(weight)
        return self._chain(score, np.array([len(score)]), weight)[0]

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        step, size = [], 0
        for i, t in enumerate(texts):
            if t is not None and len(t) > _STEP:
                out[i] = self._calibrated(self.raw_long(t, _STEP))[0]
            else:
                step.append(i)
                size += len(t or "")
            if step and (size >= _STEP or i + 1 == len(texts)):
                out[step] = self._calibrated(self.raw([texts[k] or "" for k in step])[0])
                step, size = [], 0
        return out

    def _calibrated(self, p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _encode(text: str) -> bytes:
    """A text's lines: how many, their own features, their sizes."""
    own, size = own_features(text.split("\n"))
    return len(own).to_bytes(8, "little") + own.astype("<f4").tobytes() + size.astype("<i8").tobytes()


def fit(texts: Sequence[tuple[str, str]], **how) -> Model:
    """``(label '0' or '1', text)`` pairs to a model, by Adam on the whole sample."""
    return fit_encoded([(name, _encode(t)) for name, t in texts], **how)


def fit_encoded(texts: Sequence[tuple[str, bytes]], steps: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """The same of encoded texts."""
    label = np.array([name == "1" for name, _ in texts], dtype=bool)
    zero = np.zeros(3 * OWN + 2, np.float32)
    if not len(label) or label.all() or not label.any():
        p = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
        return Model(zero, zero + 1, None, np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    per_text = np.array([int.from_bytes(c[:8], "little") for _, c in texts])
    own = np.concatenate([np.frombuffer(c, "<f4", n * OWN, 8).reshape(n, OWN) for (_, c), n in zip(texts, per_text.tolist())])
    weight = np.concatenate([np.frombuffer(c, "<i8", n, 8 + 4 * n * OWN) for (_, c), n in zip(texts, per_text.tolist())])
    weight = np.maximum(weight, 1).astype(np.float64)
    x = with_neighbours(own, *_ends(per_text))
    mean, scale = x.mean(axis=0), x.std(axis=0) + np.float32(1e-3)
    x = _expand(x, mean, scale)
    y = np.repeat(label, per_text)
    # labels weigh alike, and so do documents, however many lines they have
    importance = 0.5 / np.where(label, label.sum(), (~label).sum())
    line = np.repeat(importance / per_text, per_text)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    truth = np.zeros((len(texts), 4))
    truth[np.arange(len(texts)), np.where(label, 3, 0)] = per_text - 1
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        p, pairs = marginals((x @ w.astype(np.float32)).astype(np.float64), per_text, move)
        slope = ((p - y) * line).astype(np.float32) @ x
        g = np.concatenate([slope + ridge * w, ((pairs - truth) * (importance / per_text)[:, None]).sum(axis=0) + ridge * move.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        d = rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        w, move = w - d[:-4], move - d[-4:].reshape(2, 2)
    model = Model(mean, scale, w.astype(np.float32), move, 1.0, 0.0)
    raw = np.clip(model._chain((x @ model.weights).astype(np.float64), per_text, weight)[0], 1e-4, 1 - 1e-4)
    z, a, b = np.log(raw / (1 - raw)), 1.0, 0.0
    for _ in range(200):  # Platt scaling, labels weighing alike
        q = 1 / (1 + np.exp(-(a * z + b)))
        r = (q - label) * importance
        a, b = a - 0.5 * ((r * z).sum() + 1e-3 * (a - 1)), b - 0.5 * r.sum()
    model.slope, model.shift = float(max(a, 0.05)), float(b)
    return model


def train(docs: DataFrame, labels: DataFrame, per_label: int = TEXTS_PER_LABEL) -> Model:
    """Fits on labelled documents outside fold 2: a sample bounded in texts,
    characters of each and bytes of features, drawn and fitted in tasks."""
    known = labels.filter(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id")) != 2)).select("doc_id", F.col("quality").cast("string").alias("label"))
    ids = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    # the sample is drawn among the labels, so that texts meet few rows only
    total = {r[0]: r[1] for r in ids.groupBy("label").count().collect()}
    bound = F.lit(-1)
    for name, n in total.items():
        bound = F.when(F.col("label") == name, F.lit(part_of_lots(2 * per_label / n))).otherwise(bound)
    chosen = ids.filter(lot(11, "doc_id") <= bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # some 4 * per_label ids
    return fitted(drawn(rows, "label", per_label), _encode, fit_encoded, SAMPLE_BYTES)


def score(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``columns`` and the quality score of every document.  A caller's column named
    like the result, in whatever case, gives way to it."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes
    columns = absent(columns, ["score"])
    out = docs.select(*[f"`{c}`" for c in columns]).schema
    at = cased(docs.select(*[f"`{c}`" for c in columns]), "text") if "text" in map(str.lower, columns) else len(out)  # a text is sent once
    keep = docs.select(*[f"`{c}`" for c in columns], *[F.col("text").alias("__text")] * (at == len(out)))
    schema = StructType([*out, StructField("score", DoubleType())])

    @worker
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in text_steps(batches, at):
            s = m.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(s, pa.float64())], names=schema.names)

    return keep.mapInArrow(run, schema)


def good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The documents that score ``least`` or more, rows and columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = cased(docs, "text")

    @worker
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in text_steps(batches, at):
            yield b.filter(pa.array(m.score(b.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
