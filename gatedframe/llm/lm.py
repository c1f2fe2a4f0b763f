"""Language-model scores by online logistic context mixing.

A word is coded by the twelve top bits of its hash, one binary decision after another, then by its share of the
training words with these bits, and a word unseen in training, which shares one place there, besides by its letters, bit by bit. For each decision
four predictors answer. Three hold counts gathered over the training documents: one knows the bits so far, one also the
word before, one the two words before; the contexts are hashed to tables. The fourth learns as the text is read: it expects the word that followed
when the same words were met before in the same document. Their answers are added in the logistic domain, with weights that a gate chooses by how
often the contexts were seen and whether something is expected. Weights, and a final map from the mixed to the observed probability,
start from what they have become over all training documents, each read as if the tables didn't hold the occurrence at hand, and adapt after every
bit through a document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch
from gatedframe.llm.words import ASCII_LOWER, pieces, utf8

BITS = 12
#: Each of the two hashed tables has 2 to a power of slots that grows with the bytes of the corpus, up to this one: 17 MB in each worker
#: that scores, 67 MB in one that counts. More than a corpus of some 5 MB fills them; raise it where workers have the memory.
MOST_SLOT_BITS, LEAST_SLOT_BITS = 22, 15
#: Slots of the two hashed contexts, then one chunk with those of the bits alone.
CHUNK_BITS = 15
#: Words through which the adaptive state is carried; in a longer document it starts anew behind them, so that the parts are read side by side.
#: From 256 to 2048 words scores of held-out documents rise by 0.15 %, and seconds double.
SEGMENT = 256
#: Documents that are read side by side, and words that are counted at once.
LANES, PART = 2048, 1 << 13
RATE, MAP_RATE, MAP_SHARE = 0.03, 0.02, 0.25
#: Mixed logits lie within +- LIMIT; the final map has so many cells between.
LIMIT, MAP_CELLS = 13.99, 42
#: Gates: how often both contexts were seen (0 to 3 each), and whether something is expected.
GATES = 16 * 2
#: Logit of a bit that the fourth predictor expects.
EXPECTED = 2.0
#: Bits of the tables of one, two and three letters.
SPELL_BITS = (16, 18, 20)
#: Sums of learned weights are kept in whole units of this, so that they don't depend on the order in which tasks end.
GRAIN = 2.0**-20
#: Words whose counts travel with the model, at most; the others' counts are joined.
FREQUENT = 1 << 17
#: Words that a task counts before it hands them on.
FLUSH = 500_000
END = b""
START = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
#: Constants of xxh64, and the bytes that part words.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def slot_bits(corpus_bytes: int) -> int:
    return max(LEAST_SLOT_BITS, min(MOST_SLOT_BITS, math.ceil(math.log2(max(1, corpus_bytes)))))


def _slot_count(width: int) -> int:
    return (2 << width) + (1 << CHUNK_BITS)


def _squeezed(data: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(data.tobytes(), asbytes=True)


def _loosened(data: bytes, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data, decompressed_size=size), kind)


def _packed(counts: np.ndarray) -> bytes:
    """Counts as compressed planes of their bytes, of which the upper ones are nearly empty."""
    return _squeezed(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(_loosened(data, 8 << CHUNK_BITS, "u1").reshape(4, -1).T).view("<u4").ravel()


def _tokens(text: bytes) -> list[bytes]:
    return [*text.translate(ASCII_LOWER).split(), END]


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _hashes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """xxh64 with seed 42 of words that lie in ``flat``, behind which are 8 bytes more; all words at once, those of 32 bytes and more by the library."""
    eights = np.ndarray((len(flat) - 7,), "<u8", flat.data, strides=(1,))
    h = lengths.astype(np.uint64) + np.uint64(42 + _P5 & 0xFFFFFFFFFFFFFFFF)
    for k in range(3):
        if not len(some := np.flatnonzero(lengths >= 8 * (k + 1))):
            break
        lane = eights[starts[some] + 8 * k] * np.uint64(_P2)
        h[some] = _turned(h[some] ^ (_turned(lane, 31) * np.uint64(_P1)), 27) * np.uint64(_P1) + np.uint64(_P4)
    rest = eights[starts + (lengths & ~7)]  # fewer than 8 bytes are left of each
    some = np.flatnonzero(lengths & 4)
    h[some] = _turned(h[some] ^ ((rest[some] & np.uint64(0xFFFFFFFF)) * np.uint64(_P1)), 23) * np.uint64(_P2) + np.uint64(_P3)
    rest[some] >>= np.uint64(32)
    for k in range(3):
        some = np.flatnonzero((lengths & 3) > k)
        h[some] = _turned(h[some] ^ (((rest[some] >> np.uint64(8 * k)) & np.uint64(255)) * np.uint64(_P5)), 11) * np.uint64(_P1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(_P2)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_P3)
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(flat[starts[k] : starts[k] + lengths[k]].tobytes(), 42)
    return h


@dataclass
class _Cut:
    """Where the tokens of texts that follow each other, as ``_tokens`` cuts them, lie in ``data``, and how many each text has. No word becomes a Python object."""

    data: bytes
    begins: np.ndarray
    lengths: np.ndarray
    sizes: np.ndarray

    def codes(self) -> np.ndarray:
        flat, codes = np.frombuffer(self.data, np.uint8), np.empty(len(self.begins), np.uint64)
        for at in range(0, len(codes), PART):
            codes[at : at + PART] = _hashes(flat, self.begins[at : at + PART], self.lengths[at : at + PART])
        return codes


def _cut(texts: list[bytes]) -> _Cut:
    data = b" ".join([b"", *texts, bytes(8)]).translate(ASCII_LOWER)
    gap = SPACES.take(np.frombuffer(data, np.uint8))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])[:-1] + 1  # but for the bytes behind the texts
    words = np.diff(np.searchsorted(starts, np.cumsum([1] + [len(t) + 1 for t in texts])))
    place = np.arange(len(starts)) + np.repeat(np.arange(len(texts)), words)
    begins, lengths = np.zeros((2, len(starts) + len(texts)), np.int64)  # a text's end has no bytes
    begins[place], lengths[place] = starts, np.flatnonzero(~gap[:-1] & gap[1:]) + 1 - starts
    return _Cut(data, begins, lengths, words + 1)


class _Lexicon:
    """log10(count + 1) of the words that the model carries, found by the hash and then by the bytes of a word."""

    def __init__(self, logs: dict[bytes, float]):
        self.data = b"".join([*logs, bytes(8)])
        lengths = np.array([len(w) for w in logs], np.int64)
        begins = np.cumsum(lengths) - lengths
        codes = _hashes(np.frombuffer(self.data, np.uint8), begins, lengths)
        order = np.argsort(codes)
        self.codes, self.begins, self.lengths, self.logs = codes[order], begins[order], lengths[order], np.array([*logs.values()], np.float64)[order]
        self.first = np.searchsorted(self.codes >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64))  # by the upper 20 bits

    def _same(self, cut: _Cut, tokens: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether tokens are these words, eight bytes at a time."""
        ours, theirs = (np.ndarray((len(d) - 7,), "<u8", d, strides=(1,)) for d in (self.data, cut.data))
        same, left = self.lengths[words] == cut.lengths[tokens], np.arange(len(tokens))
        for k in range(0, int(self.lengths[words].max(initial=0)), 8):
            left = left[same[left] & (self.lengths[words[left]] > k)]
            size = np.minimum(self.lengths[words[left]] - k, 8).astype(np.uint64)
            differ = ours[self.begins[words[left]] + k] ^ theirs[cut.begins[tokens[left]] + k]
            same[left] = (differ << ((np.uint64(8) - size) * np.uint64(8))) == 0
        return same

    def known(self, cut: _Cut, codes: np.ndarray) -> np.ndarray:
        """Of each token; NaN where the model doesn't carry the word."""
        found = np.full(len(codes), math.nan)
        top = (codes >> np.uint64(44)).view(np.int64)
        at, stop, left = self.first[top], self.first[top + 1], np.arange(len(codes))
        while len(left := left[at[left] < stop[left]]):
            hit = left[self.codes[at[left]] == codes[left]]
            hit = hit[self._same(cut, hit, at[hit])]
            found[hit] = self.logs[at[hit]]
            at[left] += 1
        return found


def _contexts(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, context of one word, context of two words) of each token of texts that begin at ``starts``."""
    one = np.concatenate([[np.uint64(START)], codes[:-1]])
    one[starts] = START
    two = np.concatenate([[np.uint64(START)], one[:-1]])
    two[starts] = START
    first = one * _MIX
    return (codes >> np.uint64(64 - BITS)).astype(np.int64), first, (first ^ (two >> np.uint64(7))) * _STEP + two


def _within() -> tuple[np.ndarray, np.ndarray]:
    """(answers, steps within a group) of the decisions of all bits, a row per decision."""
    every, depth = np.arange(1 << BITS), np.arange(BITS)[:, None]
    node = (1 << (depth & 3)) | ((every >> (BITS - depth)) & ((1 << (depth & 3)) - 1))
    return ((every >> (BITS - 1 - depth)) & 1).astype(np.uint8), (node * 5 & 15).astype(np.uint8)


ANSWERS, WITHIN = _within()


def _slots(bits: np.ndarray, first: np.ndarray, second: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots of the bits alone, of one word, of two words), each with a row per decision; ``width``: log2 of the slots of a table.

    The slots of four decisions after each other lie in one group of 16, which the context and the bits before them choose, so
    that memory is fetched three times a word rather than twelve.
    """
    depth = np.arange(BITS)[:, None]
    node = (1 << depth) | (bits >> (BITS - depth))
    salt = node[::4].astype(np.uint64) * _STEP
    within = WITHIN.take(bits, axis=1).reshape(BITS // 4, 4, -1)
    down = np.uint64(64 - width + 4)

    def hashed(context: np.ndarray, base: int) -> np.ndarray:
        h = context ^ salt
        h *= _MIX
        turn = (h >> np.uint64(20)).astype(np.uint8)
        h >>= down
        h <<= np.uint64(4)
        group = h.view(np.int64)
        group += base
        return (group[:, None] + ((turn[:, None] + within) & np.uint8(15))).reshape(BITS, -1)

    node += 2 << width
    return node, hashed(first, 0), hashed(second, 1 << width)


def _answers(bits: np.ndarray) -> np.ndarray:
    return ANSWERS.take(bits, axis=1)


def _gather(width: int):
    """Per task: counts of words, and the predictors' counts as compressed chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["word", "n", "chunk", "data"], [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
        rows = lambda *cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        counts, table, alone = Counter(), np.zeros(2 * _slot_count(width), np.uint32), np.zeros(1 << BITS, np.int64)
        for batch in pieces(batches):
            texts = [t for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) if not is_held_out(i)]
            if not texts:
                continue
            for text in texts:
                counts.update(_tokens(text))
            cut = _cut(texts)
            bits, first, second = _contexts(cut.codes(), np.cumsum(cut.sizes) - cut.sizes)
            alone += np.bincount(bits, minlength=1 << BITS)
            for at in range(0, len(bits), PART):
                part = slice(at, at + PART)
                answer = _answers(bits[part])
                for slots in _slots(bits[part], first[part], second[part], width)[1:]:
                    np.add.at(table, (2 * slots + answer).ravel(), np.uint32(1))
            if len(counts) > FLUSH:
                yield rows(list(counts), list(counts.values()), [None] * len(counts), [None] * len(counts))
                counts.clear()
        yield rows(list(counts), list(counts.values()), [None] * len(counts), [None] * len(counts))
        for depth in range(BITS):  # of the bits alone: nodes of a depth lie side by side, each with its two answers
            table[2 * ((2 << width) + (1 << depth)) :][: 2 << depth] = alone.reshape(2 << depth, -1).sum(axis=1)
        parts = table.reshape(-1, 2 << CHUNK_BITS)
        for k in range(len(parts)):
            if parts[k].any():
                yield rows([None], [None], [k], [_packed(parts[k])])

    return run


def _merged(chunks: DataFrame, *keys: str, last: bool = False) -> DataFrame:
    """Sums of the chunks of each key, added up one by one as they arrive; for the ``last`` time as what predictors answer, and without one occurrence of
    either answer (``rest``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, current = np.zeros(2 << CHUNK_BITS, np.uint64), None

        def row() -> pa.RecordBatch:
            data = _squeezed(_predictor(total)) if last else _packed(np.minimum(total, 0xFFFFFFFF))
            rest = _squeezed(_without_one(total)) if last else None
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([data]), pa.array([rest], pa.binary())], ["chunk", "data", "rest"])

        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != current:
                    if current is not None:
                        yield row()
                    total[:], current = 0, chunk
                total += _unpacked(data)
        if current is not None:
            yield row()

    return chunks.repartition(*keys).sortWithinPartitions("chunk").select("chunk", "data").mapInArrow(run, "chunk int, data binary, rest binary")


@dataclass
class Model:
    """``table`` holds for each slot the logit of its counts in 1/256, shifted left by two, and how often it was seen (0 to 3); so do ``letters``,
    three tables for the letters of words."""

    table: np.ndarray
    width: int
    bucket_log: np.ndarray
    frequent: dict[bytes, float]
    train_tokens: int
    train_words: int
    letters: list[np.ndarray]


def _predictor(counts: np.ndarray) -> np.ndarray:
    n0, n1 = counts.astype(np.float64).reshape(-1, 2).T
    logit = np.clip(np.log((n1 + 0.4) / (n0 + 0.4)), -15, 15)
    return (np.rint(logit * 256).astype(np.int64) * 4 + np.digitize(n0 + n1, [1, 3, 9])).astype("<i2")


def _without_one(counts: np.ndarray) -> np.ndarray:
    """What predictors answer where an occurrence of answer 0 is taken back from each slot, and of answer 1, side by side."""
    pairs, out = counts.astype(np.int64).reshape(-1, 2), np.empty(len(counts), "<i2")
    for answer in (0, 1):
        less = pairs.copy()
        less[:, answer] = np.maximum(less[:, answer] - 1, 0)
        out[answer::2] = _predictor(less.ravel())
    return out


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(letters of all words, each ended by a space; place of each word's first; contexts of one, two and three letters within the word)."""
    flat = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    begins = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    since = np.arange(len(flat)) - np.repeat(begins, [len(w) + 1 for w in words])
    contexts, so_far = [], np.zeros(len(flat), np.uint64)
    for back in (1, 2, 3):
        before = np.concatenate([np.zeros(min(back, len(flat)), np.uint64), flat[:-back]])
        so_far = so_far * np.uint64(257) + np.where(since >= back, before + np.uint64(1), np.uint64(0))
        contexts.append(so_far)
    return flat, begins, contexts


def _letter_slots(flat: np.ndarray, contexts: list[np.ndarray], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bit k of each letter, its slot in each table)."""
    node = (np.uint64(1) << np.uint64(k)) | (flat >> np.uint64(8 - k))
    bit = (flat >> np.uint64(7 - k)) & np.uint64(1)
    return bit.astype(np.int64), [(((c * _STEP) ^ (node * np.uint64(START))) * _MIX >> np.uint64(64 - w)).astype(np.int64) for c, w in zip(contexts, SPELL_BITS)]


def letter_counts(tables: list[np.ndarray], words: list[bytes]) -> None:
    if words:
        flat, _, contexts = _letters(words)
        for k in range(8):
            bit, slots = _letter_slots(flat, contexts, k)
            for table, slot in zip(tables, slots):
                np.add.at(table, 2 * slot + bit, np.uint32(1))


def letter_tables(words: list[bytes]) -> list[np.ndarray]:
    tables = [np.zeros(2 << w, np.uint32) for w in SPELL_BITS]
    letter_counts(tables, words)
    return [_predictor(t) for t in tables]


def spelled(letters: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    """log10 probability of each word's letters and its end."""
    flat, begins, contexts = _letters(words)
    weights, total = _hand_weights()[:16, :3].T.astype(np.float64), np.zeros(len(flat))
    for k in range(8):
        bit, slots = _letter_slots(flat, contexts, k)
        one, two, three = (t.take(s).astype(np.int64) for t, s in zip(letters, slots))
        gate = (two & 3) * 4 + (three & 3)
        z = sum(w.take(gate) * (f >> 2) / 256 for w, f in zip(weights, (one, two, three)))
        total -= np.logaddexp(0, np.where(bit == 1, -z, z)) / math.log(10)
    return np.add.reduceat(total, begins)


def train(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, Start, DataFrame]:
    """The model of all documents that aren't held out, what texts begin with, and (word, n) of every training token.

    The driver receives the predictors' tables, the sums of 2^12 buckets, the ``FREQUENT`` commonest words, and the tables of letters, each of bounded size.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    width = slot_bits(size.bytes or 0)
    gathered = scratch.table(slim.mapInArrow(_gather(width), "word binary, n long, chunk int, data binary"), "gathered")
    counts = scratch.table(gathered.where("chunk is null").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    salted = gathered.where("chunk is not null").select("chunk", "data", F.pmod(F.xxhash64("data"), F.lit(8)).alias("salt"))
    table, rest = np.zeros(_slot_count(width), np.int16), np.zeros(2 * _slot_count(width), np.int16)
    for row in _merged(_merged(salted, "chunk", "salt"), "chunk", last=True).collect():
        table[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] = _loosened(bytes(row.data), 2 << CHUNK_BITS, "<i2")
        rest[row.chunk << CHUNK_BITS + 1 : (row.chunk + 1) << CHUNK_BITS + 1] = _loosened(bytes(row.rest), 4 << CHUNK_BITS, "<i2")
    scratch.drop("gathered")
    bucket = F.shiftrightunsigned(F.xxhash64("word"), 64 - BITS)
    buckets = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, words = sum(r.n for r in buckets), sum(r.v for r in buckets)
    bucket_log = np.zeros(1 << BITS)
    for r in buckets:
        bucket_log[r.b] = math.log10(r.n + r.v + 1)
    frequent = {bytes(r.word): math.log10(r.n + 1) for r in _frequent(counts).collect()}
    model = Model(table, width, bucket_log, frequent, total, words, _learn_letters(counts))
    return model, _learn_start(slim, rest, width), counts


def _frequent(counts: DataFrame, most: int | None = None) -> DataFrame:
    """Words from that count on from which there are ``most`` at most, found by a histogram of counts, so that no task or driver sorts a vocabulary."""
    band = F.floor(F.log2("n") * 8)
    bands = sorted(((r.band, r.v) for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("v")).collect()), reverse=True)  # some 500 rows
    left, least = FREQUENT if most is None else most, None
    for at, v in bands:
        left -= v
        if left < 0:
            break
        least = at
    return counts.where(F.lit(False) if least is None else band >= least)


def _learn_letters(counts: DataFrame) -> list[np.ndarray]:
    """The tables of letters of all distinct training words, counted by many tasks and summed up chunk by chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << w, np.uint32) for w in SPELL_BITS]
        for batch in pieces(batches, 4096):
            letter_counts(tables, [w for w in batch.column(0).to_pylist() if w])
        parts = np.concatenate(tables).reshape(-1, 2 << CHUNK_BITS)
        for k in range(len(parts)):
            if parts[k].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(parts[k])], pa.binary())], ["chunk", "data"])

    flat = np.zeros(sum(1 << w for w in SPELL_BITS), "<i2")
    for row in _merged(counts.select("word").mapInArrow(run, "chunk int, data binary"), "chunk", last=True).collect():
        flat[row.chunk << CHUNK_BITS : (row.chunk + 1) << CHUNK_BITS] = _loosened(bytes(row.data), 2 << CHUNK_BITS, "<i2")
    return np.split(flat, np.cumsum([1 << w for w in SPELL_BITS])[:-1])


def _learn_start(slim: DataFrame, rest: np.ndarray, width: int) -> Start:
    """Weights and map after reading every training document, by many tasks: the mean over segments, of each gate over those that moved it."""
    shared = slim.sparkSession.sparkContext.broadcast((rest, width))  # a table of bounded size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _no_sums()
        for batch in pieces(batches, LANES):
            read_sums(*shared.value, [t for i, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1))) if not is_held_out(i)], None, sums)
        places = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(sums[0][places]), pa.array(sums[1][places])], ["place", "total", "moved"])

    found = slim.mapInArrow(run, "place long, total long, moved long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("moved").alias("moved")).collect()  # a row for each weight
    shared.destroy()
    sums = _no_sums()
    for r in found:
        sums[0][r.place], sums[1][r.place] = r.total, r.moved
    return mean_start(sums)


def _hand_weights() -> np.ndarray:
    """Weights to begin learning with: [gate, predictor]. A context seen more often counts more, at the expense of the shorter ones."""
    trust = np.array([0.0, 0.05, 0.2, 0.5])
    two = np.tile(trust * 0.6, 4)
    one = np.repeat(trust, 4) * (1 - two)
    known = np.stack([1 - one - two, one, two], axis=1)
    return np.concatenate([np.column_stack([known, np.full(16, w)]) for w in (0.0, 0.8)]).astype(np.float32)


def _hand_map() -> np.ndarray:
    centre = (np.arange(MAP_CELLS) + 0.5) * (28 / MAP_CELLS) - 14
    return (1 / (1 + np.exp(-centre))).astype(np.float32)


@dataclass
class Start:
    """Weights and final map that a text begins with."""

    weights: np.ndarray
    refined: np.ndarray


def _stable_order(key: np.ndarray) -> np.ndarray:
    """``argsort`` that keeps the order of equal keys: the upper bits of a key and its place are sorted as one number, unless different keys share these bits."""
    place = np.uint64((1 << len(key).bit_length()) - 1)
    both = (key & ~place) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = (both & place).view(np.int64)
    both &= ~place
    sorted_key = key.take(order)
    if ((both[1:] == both[:-1]) & (sorted_key[1:] != sorted_key[:-1])).any():
        return np.argsort(key, kind="stable")
    return order


def expectations(bits: np.ndarray, second: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected, met) of each token: the bits of the word that followed when its two words before were last met in the same document, and whether they were."""
    doc = np.repeat(np.arange(len(starts), dtype=np.uint64) * np.uint64(START), sizes)
    expected, met = np.zeros(len(bits), np.int64), np.zeros(len(bits), bool)
    key = (second ^ doc) * _MIX
    order = _stable_order(key)
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    at = order[again + 1]
    expected[at], met[at] = bits[order[again]], True
    return expected, met


def mixed_bits(model: Model, start: Start, tokens: tuple[np.ndarray, ...], starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of the bits of each segment; ``starts`` and ``lengths`` say where segments lie among ``tokens`` (bits, first, second,
    expected, met)."""
    return _mixed(model.table, model.width, start, tokens, starts, lengths)


def _mixed(
    table: np.ndarray, width: int, start: Start, tokens: tuple[np.ndarray, ...], starts: np.ndarray, lengths: np.ndarray, learned: list | None = None
) -> np.ndarray:
    """``mixed_bits`` by one table. ``learned``, if given, receives the weights and the map at the end of each segment, and ``table`` then is that of
    ``_without_one``: the text is one that was counted, and is read as if each occurrence had not been."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    lanes = len(starts)
    weights = np.repeat(start.weights, lanes, axis=0).ravel()  # of each gate the lanes, side by side, of each lane the predictors
    gates = weights.view(np.complex128)  # four weights that are fetched and put back as one
    refined = np.repeat(start.refined, lanes)
    rate, map_rate, share, one, limit, scale = map(np.float32, (RATE, MAP_RATE, MAP_SHARE, 1, LIMIT, MAP_CELLS / 28))
    bits, first, second, expected, known = tokens
    total = np.zeros(lanes)
    active = lanes
    for t in range(int(lengths[0]) if lanes else 0):
        while lengths[active - 1] <= t:
            active -= 1
        at = starts[:active] + t
        b = bits.take(at)
        answers = _answers(b)
        inputs = np.zeros((BITS, active, 4), np.float32)  # what the predictors say
        seen = np.zeros((BITS, active), np.int16)
        for j, (s, shift) in enumerate(zip(_slots(b, first.take(at), second.take(at), width), (None, 2, 0))):
            if learned is not None:
                s <<= 1
                s += answers
            found = table.take(s)
            if shift is not None:
                seen += (found & 3) << shift
            np.multiply((found >> 2).astype(np.float32), np.float32(1 / 256), out=inputs[:, :, j])
        few = np.flatnonzero(known.take(at))  # few texts expect anything; a bit is expected as long as all before it were right
        if len(few):
            hoped = expected.take(at.take(few))
            agreed = ((b.take(few) ^ hoped) >> (BITS - np.arange(BITS)[:, None])) == 0
            inputs[:, few, 3] = np.where(agreed, (2.0 * _answers(hoped) - 1) * EXPECTED, 0)
            seen[:, few] += 16 * agreed.astype(np.int16)
        lane = np.arange(active)
        gate = lane + seen.astype(np.int64) * lanes
        answer = answers.astype(np.float32)
        mixed, mapped = np.empty((BITS, active), np.float32), np.empty((BITS, active), np.float32)
        change = np.empty((active, 4), np.float32)
        for k in range(BITS):
            g, y, x, p, r = gate[k], answer[k], inputs[k], mixed[k], mapped[k]
            w = gates.take(g).view(np.float32).reshape(active, 4)
            np.multiply(w, x, out=change)
            z = change[:, 0] + change[:, 1]
            z += change[:, 2]
            z += change[:, 3]
            np.minimum(np.maximum(z, -limit, out=z), limit, out=z)
            np.negative(z, out=p)
            np.exp(p, out=p)
            p += one
            np.divide(one, p, out=p)
            step = y - p
            step *= rate
            for j in range(4):
                np.multiply(x[:, j], step, out=change[:, j])
            w += change
            gates[g] = w.view(np.complex128).ravel()
            z += np.float32(14)
            z *= scale
            cell = z.astype(np.int64)
            cell *= lanes
            cell += lane
            refined.take(cell, out=r, mode="clip")
            np.subtract(y, r, out=step)
            step *= map_rate
            step += r
            refined[cell] = step
        if learned is None:
            mapped -= mixed
            mapped *= share
            mapped += mixed
            np.subtract(1 - answer, mapped, out=mapped)
            np.abs(mapped, out=mapped)
            total[:active] += np.log10(np.multiply.reduce(mapped, axis=0, dtype=np.float64))  # the answers' probabilities
    if learned is not None:
        learned += [weights.reshape(GATES, lanes, 4).transpose(1, 0, 2), refined.reshape(MAP_CELLS, lanes).T]
    out = np.zeros(lanes)
    out[order] = total
    return out


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start among all tokens, length) of the segments of documents that follow each other."""
    starts = np.cumsum(sizes) - sizes
    parts = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), parts)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc, starts[doc] + within * SEGMENT, np.minimum(SEGMENT, sizes[doc] - within * SEGMENT)


def _no_sums() -> tuple[np.ndarray, np.ndarray]:
    """(sum in units of ``GRAIN``, segments that moved it) of each weight and then of each cell of the map."""
    return np.zeros(GATES * 4 + MAP_CELLS, np.int64), np.zeros(GATES * 4 + MAP_CELLS, np.int64)


def read_sums(rest: np.ndarray, width: int, texts: list[bytes], _: _Lexicon | None, sums: tuple[np.ndarray, np.ndarray]) -> None:
    """Adds to ``sums`` what weights and map are after reading each segment of training texts."""
    if not texts:
        return
    cut = _cut(texts)
    sizes = cut.sizes
    starts = np.cumsum(sizes) - sizes
    bits, first, second = _contexts(cut.codes(), starts)
    hand, learned = Start(_hand_weights(), _hand_map()), []
    _mixed(rest, width, hand, (bits, first, second, *expectations(bits, second, starts, sizes)), *_segments(sizes)[1:], learned)
    at = 0
    for after, before in zip(learned, (hand.weights, hand.refined)):
        moved, size = after != before, before.size
        sums[0][at : at + size] += np.where(moved, np.rint(after / np.float32(GRAIN)), 0).astype(np.int64).sum(axis=0).ravel()
        sums[1][at : at + size] += moved.sum(axis=0).ravel()
        at += size


def mean_start(sums: tuple[np.ndarray, np.ndarray]) -> Start:
    total, moved = sums
    hand = np.concatenate([_hand_weights().ravel(), _hand_map()])
    mean = np.where(moved > 0, total * GRAIN / np.maximum(moved, 1), hand).astype(np.float32)
    return Start(mean[: GATES * 4].reshape(GATES, 4), mean[GATES * 4 :])


def _score(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, start = shared.value
        lexicon, nth = _Lexicon(model.frequent), TaskContext.get().partitionId() << 40
        for batch in pieces(batches, LANES):
            ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            if not texts:
                continue
            cut = _cut(texts)
            codes, sizes = cut.codes(), cut.sizes
            starts, logs = np.cumsum(sizes) - sizes, lexicon.known(cut, codes)
            odd = np.flatnonzero(np.isnan(logs))
            words = [cut.data[a : a + n] for a, n in zip(cut.begins[odd].tolist(), cut.lengths[odd].tolist())]
            bounds = np.searchsorted(odd, [*starts, len(logs)]).tolist()
            rare, rare_n, ends = [], [], [0]
            for a, b in zip(bounds, bounds[1:]):
                counts = Counter(words[a:b])
                rare += counts
                rare_n += counts.values()
                ends.append(len(rare))
            bits, first, second = _contexts(codes, starts)
            doc, begins, lengths = _segments(sizes)
            scored = mixed_bits(model, start, (bits, first, second, *expectations(bits, second, starts, sizes)), begins, lengths)
            bucket = np.add.reduceat(model.bucket_log[bits], starts)
            cols = [
                pa.array(range(nth, nth + len(ids)), pa.int64()),
                batch.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([is_held_out(i) for i in ids]),
                pa.array(sizes),
                pa.array(np.add.reduceat((~np.isnan(logs)).astype(np.int64), starts)),
                pa.array(np.add.reduceat(np.nan_to_num(logs), starts)),
                pa.array(np.bincount(doc, scored, len(sizes)) - bucket),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.binary())),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare_n, pa.int64())),
            ]
            nth += len(ids)
            yield pa.RecordBatch.from_arrays(cols, ["nth", "doc_id", "n_bytes", "held_out", "n_tokens", "carried", "logs", "bits", "rare", "rare_n"])

    return run


def _spelled(words: DataFrame, shared) -> DataFrame:
    """(word, letters) with the log10 probability of each word's letters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled(shared.value[0].letters, batch.column(0).to_pylist()))], ["word", "letters"])

    return words.mapInArrow(run, "word binary, letters double")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, spelled_score, bits_per_byte) for every row of ``docs``.

    ``base_score`` is that of the smoothed single-word model and ``score`` the log10 probability of the text's words by context mixing. In both
    all words unseen in training are one. ``spelled_score`` is the log10 probability of the letters of these words; with it the text's words can be
    decoded, whatever they are, and ``bits_per_byte`` is the total of both in bits per byte of the text (null for an empty one). White space isn't coded. Tasks
    look frequent words up in a table of bounded size; counts of the others, and the letters of those never seen in training, are joined by word.

    A null text counts as empty and has its end alone; a null id is in training. Rows that repeat an id are rows of
    their own. An empty table gives an empty result and other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    model, start, counts = train(docs, scratch, id_col, text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast((model, start))  # tables of bounded size
    schema = "nth long, doc_id long, n_bytes long, held_out boolean, n_tokens long, carried long, logs double, bits double, rare array<binary>, rare_n array<long>"
    scored = scratch.table(slim.mapInArrow(_score(shared), schema), "scored")
    words = lambda df: df.select("nth", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select("nth", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("k"))
    # only held-out documents have words unseen in training
    unseen = words(scored.where("held_out")).select("word").distinct().join(counts, "word", "left_anti")
    unseen = scratch.table(_spelled(unseen, shared), "unseen")
    shared.unpersist()
    known = counts.select("word", "n", F.lit(0.0).alias("letters")).union(unseen.select("word", F.lit(0).cast("long"), "letters"))
    sums = [F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("more"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum(F.col("k") * F.col("letters")).alias("letters")]
    found = words(scored).join(known, "word").groupBy("nth").agg(*sums)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    score, letters = F.col("bits") + logs, F.coalesce("letters", F.lit(0.0))
    floor = math.log10(model.train_tokens + model.train_words + 1)
    return scored.drop("rare", "rare_n").join(found, "nth", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("carried") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * floor).alias("base_score"),
        score.alias("score"),
        letters.alias("spelled_score"),
        F.try_divide(-(score + letters) / math.log10(2), "n_bytes").alias("bits_per_byte"),
    )
