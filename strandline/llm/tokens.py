"""Encoding of whole texts to token ids, fast enough for corpus passes.

``Encoder`` reads a byte-level BPE file of the ``tokenizers`` library and gives
that library's ids.  Ordinary prose repeats its words, so each batch encodes
its distinct words once and gathers (a single blank between two non-blank
characters always starts a new pre-token, so cutting there changes no id; texts
with other white space beside a blank are encoded whole); the merge loop itself runs in ``tiktoken``
over the same vocabulary when the file's ids are in merge order (else in
``tokenizers``).  ``tests/llm`` holds both against ``tokenizers``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that one vectorised step takes at most (a longer single
#: text is a step of its own).
STEP_CHARS = 2_000_000


def _byte_table() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: bytes that print stand for
    themselves, the others are moved to code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        table[chr(256 + k)] = b
    return table


_BLANK = next(c for c, b in _byte_table().items() if b == 32)


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


class Encoder:
    """Text to little-endian unsigned ids (``width`` bytes each)."""

    def __init__(self, path: str):
        self._path, self._tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"] if isinstance(spec["model"].get("vocab"), dict) else self._slow.get_vocab(with_added_tokens=False)
        names = {i: t for t, i in [*vocab.items(), *added.items()]}
        size = max(names, default=0) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self._special = list(added)
        self._fast = self._merge_engine(spec, vocab)
        # ids whose bytes begin with a blank: where a word starts
        self._lead = np.array([names.get(i, "").startswith(_BLANK) for i in range(size)])

    @property
    def _slow(self):
        """The library's own tokenizer, for texts that need it."""
        if self._tokenizer is None:
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self._path)
        return self._tokenizer

    def _merge_engine(self, spec: dict, vocab: dict):
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and not model.get("dropout")
        )
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
        ids = [vocab.get(a + b, -1) for a, b in merges] if plain else [-1]
        if not plain or ids != sorted(ids) or ids[:1] == [-1]:
            return None
        import public_tokenizers
        import tiktoken

        table = _byte_table()
        ranks = {bytes(table[c] for c in t): i for t, i in vocab.items() if t not in self._special}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> np.ndarray:
        if self._fast and not any(x in text for x in self._special):
            return np.array(self._fast.encode_ordinary(text), dtype=self.dtype)
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _step(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts one after another, and how many each has."""
        plain = np.array([bool(t) and self._fast is not None and not any(x in t for x in self._special) for t in texts], dtype=bool)
        split = pc.split_pattern(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string()), " ")
        offsets, words = split.offsets.to_numpy(), split.values
        flat, sizes = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if len(words):
            coded = words.dictionary_encode()
            codes, known = coded.indices.to_numpy(), coded.dictionary
            # pieces that a blank does not cut off cleanly
            bad = pc.or_(pc.equal(pc.binary_length(known), 0), pc.not_equal(pc.utf8_trim_whitespace(known), known)).to_numpy(zero_copy_only=False)
            lead = pc.binary_join_element_wise(_large(""), pc.if_else(pa.array(bad), _large("x"), known), _large(" "))
            ids = np.array(self._fast.encode_ordinary(lead.buffers()[2].to_pybytes().decode()), dtype=self.dtype)
            at = np.flatnonzero(self._lead[ids])
            firsts = [self._fast.encode_ordinary(w) for w in words.take(pa.array(offsets[:-1])).to_pylist()]
            # the distinct words' ids, then the first words' ids, addressed by piece
            pool = np.concatenate([ids, np.array([i for f in firsts for i in f], dtype=self.dtype)])
            first_size = np.array([len(f) for f in firsts], dtype=np.int64)
            start = np.concatenate([at, len(ids) + np.cumsum(first_size) - first_size])
            size = np.concatenate([np.diff(np.append(at, len(ids))), first_size])
            piece = codes.astype(np.int64)
            piece[offsets[:-1]] = len(known) + np.arange(len(firsts))
            n = size[piece]
            ends = np.cumsum(n)
            flat = pool[np.repeat(start[piece] - ends + n, n) + np.arange(ends[-1])]
            sizes = np.add.reduceat(n, offsets[:-1])
            plain[np.flatnonzero(plain)[np.logical_or.reduceat(bad[codes], offsets[:-1])]] = False
            if plain.all():
                return flat, sizes
        out, counts, k = [], np.zeros(len(texts), dtype=np.int64), 0
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        for i, (t, p) in enumerate(zip(texts, plain)):
            tried = bool(t) and self._fast is not None and not any(x in t for x in self._special)
            out.append(flat[cuts[k] : cuts[k + 1]] if p else self._whole(t) if t else np.zeros(0, self.dtype))
            counts[i] = len(out[-1])
            k += tried
        return np.concatenate(out), counts

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null is empty."""
        flats, counts, step, size = [], [], [], 0
        for t in texts:
            step.append(t or "")
            size += len(step[-1])
            if size >= STEP_CHARS:
                f, c = self._step(step)
                flats.append(f)
                counts.append(c)
                step, size = [], 0
        f, c = self._step(step) if step else (np.zeros(0, self.dtype), np.zeros(0, np.int64))
        return np.concatenate([*flats, f]), np.concatenate([*counts, c])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
