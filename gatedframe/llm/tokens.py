"""Token counts behind a cache keyed by digests of content and of the tokenizer."""

from __future__ import annotations

import hashlib
import os
import string
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatedframe.llm.storage import Scratch, exists, shared_dir
from gatedframe.llm.words import GAP, pieces, utf8

#: The pre-tokenisation pattern of lower-casing word-level BPE files, and the normalisers before it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

#: Words in which Python's and the library's case and letter tables agree and NFC changes nothing.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ɏ]*")
#: Words remembered by a worker, and the longest word remembered, in bytes.
MEMO_WORDS, MEMO_BYTES = 400_000, 64
#: Digests (32 bytes) that are broadcast at most.
FEW_MISSES = 100_000


#: The letters that stand for bytes in byte-level vocabularies, by their rule: visible ones for themselves, the others in order from U+0100 on.
_HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(_HIDDEN)}


class _Memo(dict):
    """Results of a function of words, forgotten when there are many."""

    def __init__(self, function):
        self.function = function

    def __missing__(self, word: bytes) -> bytes:
        found = self.function(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, as the file's own library gives them.

    Neither begin and end tokens nor padding or truncation are applied. For files of the kind
    ``drops_space`` (white space ends words and leaves no token), a text's ids are those of its words one
    after another, so that a word met before is not encoded again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.sentencepiece = self.tokenizer = None
        self.drops_space = False
        if path.endswith(".model"):
            import sentencepiece

            self.sentencepiece = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.drops_space = (
            (spec.get("normalizer") or {}).get("normalizers") == WORD_NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
            and not steps[1]["add_prefix_space"]
            and not steps[1]["use_regex"]
            and spec.get("post_processor") is None
            and not any(t["single_word"] for t in spec.get("added_tokens") or [])
        )
        if self.drops_space:
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            self.split = regex.compile(WORD_PATTERN).findall
            self.words = _Memo(self._encode_word)
            self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (found := self.parts.get(part)) is None:
            if len(self.parts) >= MEMO_WORDS:
                self.parts.clear()
            text = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()
            if len(part) <= MEMO_BYTES:
                self.parts[part] = found
        return found

    def _encode_word(self, word: bytes) -> bytes:
        text = word.decode()
        if PLAIN.fullmatch(text):
            if text.isalpha():
                return self._part(text.lower())
            if not any(s in text for s in self.special):
                letters = text.rstrip(string.punctuation)
                if letters.isalpha():
                    return self._part(letters.lower()) + self._part(text[len(letters) :])
                return b"".join(map(self._part, self.split(text.lower())))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of UTF-8 texts."""
        if self.drops_space:
            look_up = self.words.__getitem__
            return [b"".join(map(look_up, text.split())) for text in texts]
        decoded = [t.decode() for t in texts]
        if self.sentencepiece is not None:
            return [np.array(ids, "<u4").tobytes() for ids in self.sentencepiece.encode(decoded, num_threads=1)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(decoded, add_special_tokens=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, loaded once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and of the library's version: with either changed, stored counts no longer apply."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        content = hashlib.sha256(f.read())
    content.update((sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__).encode())
    return content.hexdigest()


def _encoded(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(key, n_tokens) of ``texts`` (key, text)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ids) // 4 for ids in encode(utf8(batch.column(1)))], pa.int64())], ["key", "n_tokens"])

    return texts.select("key", "text").mapInArrow(count, "key binary, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    The cache is a Parquet folder partitioned by tokenizer digest, with one count per content digest. Content is
    normalised before it is digested: where the tokenizer drops white space, each run of it becomes one space, which
    leaves the count as it is. Only distinct texts without a stored count are encoded, and their counts appended. The cache outlives
    the call: without ``cache_path`` it is the folder ``token-counts`` of the shared one, and a later call over the same texts encodes
    none. Counts that two calls append at once are equal and count once.

    Digests are compared first. Where at most ``FEW_MISSES`` have no count they are broadcast, and no other text leaves its task;
    with more, one text of each digest (chosen within tasks first) is shuffled.

    A null text counts as empty. Rows that repeat an id or a text each get a row. An empty table gives an
    empty result and other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-counts")
    version = tokenizer_digest(tokenizer_path)
    cache = cache_path or f"{shared_dir(spark)}/token-counts"
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = F.regexp_replace(text, GAP, " ") if encoder(tokenizer_path).drops_space else text
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("key"), text.alias("text"))
    rows = scratch.table(keyed.drop("text"), "rows")
    keys = scratch.table(rows.select("key").distinct(), "keys")

    def stored() -> DataFrame:
        if not exists(spark, cache):
            return spark.createDataFrame([], "key binary, n_tokens long")
        return spark.read.schema("key binary, n_tokens long, tokenizer string").parquet(cache).where(F.col("tokenizer") == version).select("key", "n_tokens")

    misses = scratch.table(keys.join(stored(), "key", "left_anti"), "misses")
    n = misses.count()
    if n:
        texts = keyed.select("key", "text")
        texts = texts.join(F.broadcast(misses), "key", "left_semi").dropDuplicates(["key"]) if n <= FEW_MISSES else texts.dropDuplicates(["key"]).join(misses, "key", "left_semi")
        _encoded(texts, tokenizer_path).withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    # written, so that the rows of one very common text can be dealt to several tasks
    counts = scratch.table(stored().join(keys, "key", "left_semi").groupBy("key").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    scratch.drop("keys", "misses")
    return rows.join(counts, "key").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
