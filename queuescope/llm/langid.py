"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import shards, text_buffer

UNDETERMINED = "und"

#: Bytes that the network reads in one go. A text is cut into segments of this length, all of them
#: read, so any text is a number of equal steps; only a text's last segment is filled up.
SEGMENT = 64
HIDDEN = 8
#: Training texts: at most so many per language, chosen by hash, and a piece of so many characters of each.
SAMPLE_PER_LANG = 256
SAMPLE_BYTES = 512
EPOCHS = 5
BATCH = 128
#: Bytes of text in memory at a time, and segments that step together.
SHARD_BYTES = 8_000_000
LANES = 4096

_PAD = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(seed: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    return {
        # Rows: update gate, reset gate, candidate.
        "input": seed.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32),
        "state": seed.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32),
        "bias": np.zeros((3 * hidden, 1), np.float32),
    }


def _read(p: dict[str, np.ndarray], data: np.ndarray, trace: bool = False):
    """States after each step of (steps, lanes) bytes; for training also the gates."""
    size = p["state"].shape[1]
    table = p["input"] + p["bias"]
    h = np.zeros((size, data.shape[1]), np.float32)
    out = np.empty((len(data), size, data.shape[1]), np.float32)
    kept = []
    for t, column in enumerate(data):
        x = table.take(column, axis=1, mode="clip")
        g = p["state"] @ h
        x[: 2 * size] += g[: 2 * size]
        gates = _sigmoid(x[: 2 * size])
        update, reset = gates[:size], gates[size:]
        inner = g[2 * size :]
        candidate = np.tanh(x[2 * size :] + reset * inner)
        if trace:
            kept.append((h, update, reset, inner, candidate))
        h = candidate + update * (h - candidate)
        out[t] = h
    return (out, kept) if trace else out


def _back(p: dict[str, np.ndarray], data: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients by backpropagation through time; ``d_out`` belongs to the states of each step."""
    size = p["state"].shape[1]
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    d_h = np.zeros_like(d_out[0])
    flat = np.zeros((256, 3 * size), np.float32)
    for t in range(len(data) - 1, -1, -1):
        before, update, reset, inner, candidate = kept[t]
        d_h = d_h + d_out[t]
        d_candidate = d_h * (1 - update) * (1 - candidate**2)
        d_update = d_h * (before - candidate) * update * (1 - update)
        d_reset = d_candidate * inner * reset * (1 - reset)
        d_x = np.concatenate([d_update, d_reset, d_candidate])
        d_g = np.concatenate([d_update, d_reset, d_candidate * reset])
        np.add.at(flat, data[t], d_x.T)
        grad["state"] += d_g @ before.T
        d_h = d_h * update + p["state"].T @ d_g
    grad["input"] = flat.T
    grad["bias"] = flat.sum(axis=0)[:, None]
    return grad


@dataclass
class Network:
    """Two readers, one in each direction, and a label for every position."""

    languages: list[str]
    forward: dict[str, np.ndarray]
    backward: dict[str, np.ndarray]
    out: np.ndarray  #: languages x (2 * hidden)
    bias: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        n = len(languages)
        out = rng.normal(0, 0.3, (n, 2 * hidden)).astype(np.float32)
        return cls(languages, _steps(rng, hidden), _steps(rng, hidden), out, np.zeros((n, 1), np.float32))

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        """(steps, languages, lanes): the label of every position, given the whole segment."""
        ahead = _read(self.forward, data)
        back = _read(self.backward, data[::-1])[::-1]
        size = ahead.shape[1]
        score = self.out[:, :size] @ ahead
        score += self.out[:, size:] @ back
        score += self.bias
        score -= score.max(axis=1, keepdims=True)
        score -= np.log(np.exp(score).sum(axis=1, keepdims=True))
        return score

    def pooled(self, data: np.ndarray, lengths: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): sums of the positions' log probabilities over each document's segments."""
        total = np.zeros((n, len(self.languages)))
        for at in range(0, data.shape[1], LANES):
            lanes = slice(at, at + LANES)
            part = self.log_probabilities(np.ascontiguousarray(data[:, lanes]))
            full = lengths[lanes] >= len(data)
            own = part.sum(axis=0)
            if not full.all():
                rest = np.flatnonzero(~full)
                inside = np.arange(len(data))[:, None] < lengths[lanes][rest]
                own[:, rest] = (part[:, :, rest] * inside[:, None, :]).sum(axis=0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc[lanes], own[k], n)
        return total

    def train(self, data: np.ndarray, lengths: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02) -> None:
        """Adam on the mean cross-entropy of all positions; each language weighs the same."""
        rng = np.random.default_rng(11)
        number = np.bincount(label, minlength=len(self.languages))
        weight = (len(label) / len(self.languages) / np.maximum(number, 1)).astype(np.float32)
        values = [self.out, self.bias, *self.forward.values(), *self.backward.values()]
        first, second, turn = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        size = self.out.shape[1] // 2
        for epoch in range(epochs):
            loss, order = 0.0, rng.permutation(len(label))
            for at in range(0, len(order), BATCH):
                lanes = order[at : at + BATCH]
                x, y = np.ascontiguousarray(data[:, lanes]), label[lanes]
                inside = (np.arange(len(x))[:, None] < lengths[lanes]) * weight[y]
                inside = (inside / inside.sum()).astype(np.float32)
                ahead, kept_ahead = _read(self.forward, x, trace=True)
                back, kept_back = _read(self.backward, x[::-1], trace=True)
                state = np.concatenate([ahead, back[::-1]], axis=1)
                score = self.out @ state + self.bias
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                p /= p.sum(axis=1, keepdims=True)
                loss -= float((np.log(p[:, y, np.arange(len(y))] + 1e-9) * inside).sum())
                p[:, y, np.arange(len(y))] -= 1
                d_score = p * inside[:, None, :]
                d_state = self.out.T @ d_score
                ahead_grad = _back(self.forward, x, kept_ahead, d_state[:, :size])
                back_grad = _back(self.backward, x[::-1], kept_back, d_state[::-1, size:])
                grads = [np.einsum("tkb,thb->kh", d_score, state), d_score.sum(axis=(0, 2))[:, None]]
                grads += [*ahead_grad.values(), *back_grad.values()]
                turn += 1
                norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
                for k, (v, g) in enumerate(zip(values, grads, strict=True)):
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    step = rate * (1 - 0.9 * epoch / epochs)
                    v -= step * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
            self.losses.append(loss / max(1, -(-len(order) // BATCH)))


def segments(texts: pa.Array, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, lanes) bytes of all texts, bytes in each lane, and the text of each lane."""
    data, starts = text_buffer(texts)
    size = np.diff(starts)
    lanes = -(-size // length)
    doc = np.repeat(np.arange(len(size)), lanes)
    begin = starts[:-1][doc] + length * (np.arange(len(doc)) - (np.cumsum(lanes) - lanes)[doc])
    lengths = np.minimum(length, starts[1:][doc] - begin)
    padded = np.concatenate([data, np.full(length, _PAD, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, length)[begin]  # a copy as long as the texts
    short = np.flatnonzero(lengths < length)
    out[short] = np.where(np.arange(length) < lengths[short, None], out[short], np.uint8(_PAD))
    return out.T, lengths, doc


def sample(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """(lang, text): at most ``per_lang`` pieces of up to ``SAMPLE_BYTES`` characters for each language.

    Rows fall into buckets by a hash of the text, and the smallest hash of each bucket is taken, which
    is a partial aggregate: no language is gathered in one task.
    """
    own = F.xxhash64(text_col)
    at = 1 + F.pmod(own, F.greatest(F.length(text_col) - SAMPLE_BYTES, F.lit(0)) + 1).cast("int")
    piece = F.struct(F.xxhash64(F.lit(3), text_col).alias("order"), F.col(text_col).substr(at, F.lit(SAMPLE_BYTES)).alias("text"))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(own, F.lit(per_lang)).alias("bucket"), piece.alias("piece"))
    return rows.groupBy("lang", "bucket").agg(F.min("piece").alias("piece")).select("lang", "piece.text")


def train(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_lang: int = SAMPLE_PER_LANG) -> Network | None:
    """A network fitted on a bounded sample; None where no row has a language and a letter."""
    rows = sorted((r.lang, r.text) for r in sample(labelled, lang_col, text_col, per_lang).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    data, lengths, doc = segments(pa.array([t for _, t in rows], pa.string()))
    network = Network.new(languages)
    network.train(data, lengths, np.array([languages.index(lang) for lang, _ in rows])[doc])
    return network


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def label(texts: pa.Array, network: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text.

    The score is the language's share after the positions' mean log probabilities are turned back to
    probabilities, weighted as if up to ``SEGMENT`` positions were independent evidence.
    """
    if network is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    data, lengths, doc = segments(texts)
    size = np.bincount(doc, lengths, len(texts))
    total = network.pooled(data, lengths, doc, len(texts))
    total *= (np.minimum(size, SEGMENT) / np.maximum(size, 1))[:, None]
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    letters = has_letter(texts)
    names = [network.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, share.max(axis=1), 0.0)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``lang_pred``, ``score``.

    Every byte of the text is read in both directions and labelled; the labels of all positions are
    pooled. A text that is NULL or has no letter is ``und`` with score 0, and so is every text where
    the network is None. Repeated rows and rows without an id give a row each; an empty table gives an
    empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in shards(whole, whole.column(1), SHARD_BYTES):
                names, score = label(texts, network)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
                )

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def drop_undetermined(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """The rows that ``identify`` does not call ``und``, whatever their score, with all columns of ``docs``.

    Without a network no language can be told, and the rows whose text has a letter stay.
    """
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in shards(whole, whole.column(place).cast(pa.string()), SHARD_BYTES):
                stays = has_letter(texts)
                if network is not None:
                    names, _ = label(texts, network)
                    stays &= np.array([n != UNDETERMINED for n in names], bool)
                yield batch.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
