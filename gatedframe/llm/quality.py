"""Quality rules: fixed counts over each text, and a hashed n-gram classifier learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.words import pieces, utf8

#: Labelled rows that the classifier is fitted on at most, those with the smallest hash of their id.
TRAIN_ROWS = 4000
#: A document whose calibrated probability of good quality is below this is rejected.
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Slots of each feature family: words, word pairs, and 3-grams of characters (code points, gaps included).
SLOTS = 1 << 15
FAMILIES = 3
#: Factor on relative frequencies, so that a few hundred steps of descent suffice.
SCALE = 30.0
MEMO_WORDS = 1 << 18

GAPS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: One for each byte that begins a character of a word.
LETTER = (~GAPS & ((np.arange(256) & 0xC0) != 0x80)).astype(np.uint8)
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.uint8)

RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


class _Words(dict):
    """Word to number, and number to feature slot; forgotten between texts when it has grown large."""

    def __init__(self) -> None:
        self.slot = np.zeros(1 << 16, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = len(self)
        if number == len(self.slot):
            self.slot = np.concatenate([self.slot, np.zeros_like(self.slot)])
        self.slot[number] = xxhash.xxh32_intdigest(word) % SLOTS
        self[word] = number
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more; ``ids`` are below ``distinct``."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 20:
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * distinct + ids[2:]
    ordered = np.sort(window)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    hit = np.isin(window, again)
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def _sums(table: np.ndarray, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of table[data] over each text."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    total, filled = np.zeros(len(ends), np.int64), starts < ends  # reduceat would give an empty text its neighbour's first byte
    if filled.any():
        total[filled] = np.add.reduceat(table[data], starts[filled], dtype=np.int64)
    return total


def _grams(text: bytes) -> np.ndarray:
    """Slots of the 3-grams of a text's characters."""
    points = np.frombuffer(text, np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    if len(points) < 3:
        return np.zeros(0, np.int64)
    key = (points[:-2] * np.uint32(65599) + points[1:-1]) * np.uint32(65599) + points[2:]  # modulo 2^32
    return ((key * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class Model:
    """Weights of the feature slots, and the calibrated logistic curve over their sum."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -50, 50)))


#: Used where labels are missing or all alike: every text counts as good.
ACCEPT_ALL = Model(np.zeros(FAMILIES * SLOTS, np.float32), 0.0, 50.0)


def _features(text: bytes, ids: np.ndarray, words: _Words) -> list[np.ndarray]:
    """Slots of each family, repeats included."""
    single = words.slot[ids]
    double = (single[:-1] * 31 + single[1:] * 17 + 7) % SLOTS
    return [single, double + SLOTS, _grams(text) + 2 * SLOTS]


def measure(texts: list[bytes], words: _Words, model: Model) -> list[np.ndarray]:
    """The columns of ``RULES`` for some texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
    letters, symbols = _sums(LETTER, data, ends), _sums(SYMBOL, data, ends)
    n_words, lines_again, repeats, z = (np.zeros(len(texts), k) for k in (np.int64, np.int64, np.int64, np.float64))
    for k, text in enumerate(texts):
        found = text.split()
        n_words[k] = len(found)
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            lines_again[k] = len(lines) - len(set(lines))
        ids = words.numbers(found)
        repeats[k] = repeat_words(ids, len(words))
        z[k] = sum(float(model.weights[f].mean()) for f in _features(text, ids, words) if len(f)) * SCALE
    failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    good = model.probability(z)
    return [n_words, letters, symbols, lines_again, repeats, failed, ~failed & (good >= KEEP_AT), good]


def fit(texts: list[bytes], good: np.ndarray, steps: int = 120, penalty: float = 1e-4) -> Model:
    """Logistic regression on four fifths of the rows, calibrated on the others (logistic curve of two parameters)."""
    good = np.asarray(good, np.float64)
    if len(texts) < 10 or good.min() == good.max():
        return ACCEPT_ALL
    held = np.arange(len(texts)) % 5 == 4
    if good[held].min() == good[held].max() or good[~held].min() == good[~held].max():
        held[:] = False
    words = _Words()

    def matrix(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slot, value, row) of the features of some texts."""
        slots, values, sizes = [], [], []
        for k in rows.tolist():
            families = _features(texts[k], words.numbers(texts[k].split()), words)
            counted = [np.unique(f, return_counts=True) for f in families]
            slots.append(np.concatenate([c[0] for c in counted]).astype(np.int32))
            values.append(np.concatenate([c[1] * (SCALE / max(1, len(f))) for c, f in zip(counted, families)]).astype(np.float32))
            sizes.append(len(slots[-1]))
        return np.concatenate(slots), np.concatenate(values), np.repeat(rows.astype(np.int32), sizes)

    x_slot, x_value, x_row = matrix(np.flatnonzero(~held))
    # classes weigh the same in the fit; calibration brings their true shares back
    share = good[~held].mean()
    weight = np.where(good > 0, 0.5 / share, 0.5 / (1 - share)) * ~held / max(1, (~held).sum())
    w, bias, m, v = np.zeros(FAMILIES * SLOTS), 0.0, np.zeros(FAMILIES * SLOTS + 1), np.zeros(FAMILIES * SLOTS + 1)
    for step in range(1, steps + 1):
        z = np.bincount(x_row, x_value * w[x_slot], len(texts)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good) * weight
        slope = np.append(np.bincount(x_slot, x_value * error[x_row], len(w)) + penalty * w, error.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    if held.any():
        x_slot, x_value, x_row = matrix(np.flatnonzero(held))
    z = np.bincount(x_row, x_value * w[x_slot], len(texts))
    test = held if held.any() else ~held
    slope, shift = 1.0, bias
    for _ in range(50):  # Newton steps of the two calibration parameters, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(slope * z[test] + shift, -50, 50)))
        g = np.array([((p - good[test]) * z[test]).sum() + 0.1 * (slope - 1), (p - good[test]).sum() + 0.1 * (shift - bias)])
        c = p * (1 - p)
        h = np.array([[(c * z[test] ** 2).sum() + 0.1, (c * z[test]).sum()], [(c * z[test]).sum(), c.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(d[0], -1, 1), shift - np.clip(d[1], -1, 1)
    return Model(w.astype(np.float32), float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """The classifier of ``labels`` (doc_id, quality 0 or 1).

    Fitted in one task on ``rows`` labelled documents at most, chosen by a hash of their id. An id labelled
    twice takes the lower label; null ids and labels are left out.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    # twice as many as are wanted go on to the sort, so that it stays small however many are labelled
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < min(1 << 30, (2 * rows << 30) // max(1, known.count())))
    chosen = known.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), "good")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the chosen rows are bounded by the parameter, so this side is small
    sample = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "good").agg(F.min("text").alias("text"))  # of rows that repeat an id the least text

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(xxhash.xxh64_intdigest(str(i).encode()), i, t, g) for b in batches for i, t, g in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist())]
        rows.sort()
        model = fit([r[2] for r in rows], np.array([r[3] > 0 for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("<f4").tobytes()]), pa.array([model.slope]), pa.array([model.shift])], ["weights", "slope", "shift"])

    found = sample.select("_id", "text", "good").repartition(1).mapInArrow(run, "weights binary, slope double, shift double").first()
    return Model(np.frombuffer(bytes(found.weights), "<f4"), found.slope, found.shift) if found else ACCEPT_ALL


def quality_rules(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) for every row.

    ``quality`` is the calibrated probability of a good text. A null text counts as empty and fails the base
    rules. Repeated rows each get a row, an empty table gives none, and other columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in pieces(batches):
            found = measure(utf8(batch.column(1)), words, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["doc_id", *(x.split()[0] for x in RULES.split(", "))])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, {RULES}")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the classifier keep, with all their columns, of whatever names.

    A null, empty or blank text has no words and goes. Repeated rows are judged alike, and an empty table stays one.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in pieces(batches):
            yield batch.filter(pa.array(measure(utf8(batch.column(at)), words, model)[6]))

    return docs.mapInArrow(run, docs.schema)
