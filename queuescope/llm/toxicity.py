"""Toxicity: a weighted lexicon, matched after homoglyphs and digit substitutions are folded."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuescope.llm.common import Scratch, mix

#: Labelled rows the lexicon is learned from: at most so many of either label, chosen by hash, and so
#: many characters for each of them on average. Texts are whole; one that does not fit any more is left out.
SAMPLE_TOXIC = 1500
SAMPLE_CLEAN = 3000
SAMPLE_CHARS = 4_000
#: Entries of a lexicon, the heaviest first.
MAX_ENTRIES = 5000
#: Places with different neighbours in which an entry must stand in toxic texts; copies add none.
MIN_PLACES = 4
MIN_WEIGHT = 2.0
#: First letters that may be an entry of their own, if so many different words have them.
STEM_LENGTHS = (4, 5, 6)
STEM_WORDS = 4

#: Letters of other scripts that look like Latin ones, and digits and signs written for letters
#: (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "ɡ": "g", "ɑ": "a",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: The digit 1 stands for either of two letters, so they count as one, in the lexicon as in texts.
SAME = {"l": "i"}
#: Harmless phrases with a word that may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "soap scum", "pond scum", "clown fish", "pathetic fallacy", "idiot proof")

_INNER_SIGN = re.compile(r"[@$](?=\w)|(?<=\w)[!|](?=\w)")


class _Fold(dict):
    """Character to folded characters, found when first met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)).lower():
            for d in unicodedata.normalize("NFKD", HOMOGLYPHS.get(c, c)):
                if unicodedata.category(d) in ("Mn", "Cf"):
                    continue
                d = HOMOGLYPHS.get(d, DIGITS.get(d, d))
                out += SAME.get(d, d) if d.isalnum() else " "
        self[code] = out
        return out


def fold(text: str | None, table: _Fold) -> str:
    """Folded words with one space before, between and after; marks and invisible signs are gone."""
    text = text or ""
    if any(c in text for c in SIGNS):
        text = _INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(table).split())} "


@dataclass
class Lexicon:
    """``entries``: " word " or " stem" with their weights; ``exceptions``: folded phrases."""

    entries: dict[str, float]
    exceptions: tuple[str, ...]
    #: Of the logistic score: for log density, for log weight, and the constant.
    coefficients: tuple[float, float, float] = (0.0, 0.0, -40.0)

    def automaton(self):
        import ahocorasick

        out = ahocorasick.Automaton()
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), None))
        for entry, weight in self.entries.items():
            if entry not in out:
                out.add_word(entry, (len(entry), weight))
        if len(out):
            out.make_automaton()
        return out

    def matches(self, folded: str, automaton) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the heaviest entry at each word outside exception phrases."""
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        safe = []
        for last, (size, weight) in automaton.iter(folded):
            start = last + 1 - size
            if weight is None:
                safe.append((start, last + 1))
            elif start not in best or best[start][1] < weight:
                best[start] = (last + 1, weight)
        return [(s, e, w) for s, (e, w) in best.items() if not any(a <= s < b - 1 for a, b in safe)]

    def measures(self, folded: str, automaton) -> tuple[int, float, float]:
        """Number of matches, their weight, and the weight per hundred words."""
        found = self.matches(folded, automaton)
        total = sum(w for _, _, w in found)
        words = max(0, folded.count(" ") - 1)
        return len(found), total, 100 * total / (words + 20)

    def score(self, total, density):
        a, b, c = self.coefficients
        x = a * np.log1p(density) + b * np.log1p(total) + c
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _places(ids: list[np.ndarray], part: np.ndarray | None = None) -> np.ndarray:
    """Distinct (entry, word before, word after, word); ``part`` maps words to entries, -1 for none."""
    rows = []
    for words in ids:
        padded = np.concatenate(([-1], words, [-1]))
        rows.append(np.stack([words if part is None else part[words], padded[:-2], padded[2:], words]))
    every = np.concatenate(rows, axis=1) if rows else np.zeros((4, 0), np.int64)
    every = every[:, every[0] >= 0]
    key = mix(mix(every[0].astype(np.uint64) + np.uint64(2)) + every[1].astype(np.uint64))
    _, first = np.unique(mix(key + every[2].astype(np.uint64)), return_index=True)
    return every[:, first]


def _weights(toxic: np.ndarray, clean: np.ndarray, n: int, all_toxic: int, all_clean: int) -> np.ndarray:
    """Log odds of an entry's places, less 1.64 standard errors, so that rare entries weigh little."""
    a, b = np.bincount(toxic[0], minlength=n), np.bincount(clean[0], minlength=n)
    odds = np.log((a + 0.5) / (all_toxic + 1)) - np.log((b + 0.5) / (all_clean + 1))
    odds -= 1.64 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return np.where(a >= MIN_PLACES, odds, -np.inf)


def learn(texts: list[str], toxic: list[bool], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from labelled texts: words and stems that stand in more places of toxic ones.

    A place is a pair of neighbours, so a copied text does not make its rare words toxic. Phrases of
    two words that clean texts have, but no toxic one, become exceptions.
    """
    table = _Fold()
    folded = [fold(t, table) for t in texts]
    empty = Lexicon({}, tuple(fold(e, table) for e in exceptions))
    if not any(toxic) or all(toxic):
        return empty
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in f.split()], np.int64) for f in folded]
    words = list(number)
    bad = [w for w, t in zip(ids, toxic, strict=True) if t]
    good = [w for w, t in zip(ids, toxic, strict=True) if not t]
    of_bad, of_good = _places(bad), _places(good)
    places = of_bad.shape[1], of_good.shape[1]
    weight = _weights(of_bad, of_good, len(words), *places)
    found = {f" {words[k]} ": float(weight[k]) for k in np.flatnonzero(weight > MIN_WEIGHT)}
    for size in STEM_LENGTHS:
        stems: dict[str, int] = {}
        part = np.array([stems.setdefault(w[:size], len(stems)) if len(w) > size else -1 for w in words])
        a, b = _places(bad, part), _places(good, part)
        different = np.bincount(np.unique(a[[0, 3]], axis=1)[0], minlength=len(stems))
        weight = np.where(different >= STEM_WORDS, _weights(a, b, len(stems), *places), -np.inf)
        names = list(stems)
        found |= {f" {names[k]}": float(weight[k]) for k in np.flatnonzero(weight > MIN_WEIGHT)}
    entries = dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES])
    lexicon = Lexicon(entries, empty.exceptions)
    seen = {True: {}, False: {}}
    automaton = lexicon.automaton()
    for f, t in zip(folded, toxic, strict=True):
        pairs = set()
        for start, _, _ in lexicon.matches(f, automaton):
            left = f.rfind(" ", 0, start)
            middle = f.find(" ", start + 1)
            right = f.find(" ", middle + 1)
            pairs |= {f[left : middle + 1]} if left >= 0 else set()
            pairs |= {f[start : right + 1]} if right >= 0 else set()
        for p in pairs:
            seen[t][p] = seen[t].get(p, 0) + 1
    learned = tuple(sorted(p for p, n in seen[False].items() if n >= 5 and p not in seen[True]))
    lexicon = Lexicon(entries, empty.exceptions + learned)
    automaton = lexicon.automaton()
    measures = np.array([lexicon.measures(f, automaton) for f in folded])
    lexicon.coefficients = _fit(measures[:, 2], measures[:, 1], np.array(toxic, float))
    return lexicon


def _fit(density: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, both labels of equal weight, with a small penalty."""
    x = np.stack([np.log1p(density), np.log1p(total), np.ones(len(y))], axis=1)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    penalty = np.diag([0.1, 0.1, 1e-3])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """A lexicon from a bounded sample of the labelled documents; with NULL labels left out."""
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("id_")).agg((F.max(label_col) > 0).alias("toxic_"))
    both = ((True, SAMPLE_TOXIC), (False, SAMPLE_CLEAN))
    # At most so many ids of each label, so the broadcast is bounded.
    ids = [marks.where(F.col("toxic_") == t).orderBy(F.xxhash64("id_"), "id_").limit(n) for t, n in both]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text_")
    found = docs.join(F.broadcast(ids[0].union(ids[1])), F.col(id_col) == F.col("id_")).select("id_", "toxic_", text)
    few = Scratch(docs.sparkSession, "toxicity").store(found, "sample")
    sizes = few.groupBy("id_", "toxic_").agg(F.sum(F.length("text_")).alias("chars"), F.count(F.lit(1)).alias("n"))
    chosen, used = [], {t: (0, 0) for t, _ in both}
    for r in sizes.orderBy(F.xxhash64("id_"), "id_").collect():
        most, (chars, n) = dict(both)[r.toxic_], used[r.toxic_]
        if chars + r.chars <= most * SAMPLE_CHARS and n + r.n <= 2 * most:
            chosen.append((r.id_,))
            used[r.toxic_] = chars + r.chars, n + r.n
    rows = []
    if chosen:
        ids = docs.sparkSession.createDataFrame(chosen, f"id_ {dict(marks.dtypes)['id_']}")
        rows = [(r.text_, r.toxic_) for r in few.join(F.broadcast(ids), "id_").collect()]
    rows.sort()
    return learn([t for t, _ in rows], [t for _, t in rows])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``score`` (0 to 1), ``hits``, ``weight``, ``density``.

    The whole text is folded and run through the automaton. The score is a logistic function of the
    matches' weight and of their weight per hundred words. A NULL or empty text has no matches and the
    score that goes with none; with an empty lexicon all scores are almost 0. Repeated rows and rows
    without an id give a row each; an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, table = lexicon.automaton(), _Fold()
        for batch in batches:
            found = [lexicon.measures(fold(t.as_py(), table), automaton) for t in batch.column(1)]
            frame = pd.DataFrame(found, columns=["hits", "weight", "density"])
            points = lexicon.score(frame["weight"].to_numpy(float), frame["density"].to_numpy(float))
            columns = [frame["hits"].astype("int64"), frame["weight"].astype(float), frame["density"].astype(float)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(points), *map(pa.array, columns)],
                names=["doc_id", "score", "hits", "weight", "density"],
            )

    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, score double, hits long, weight double, density double")
