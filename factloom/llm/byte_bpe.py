"""Byte-level BPE encoding and decoding.

Method: every *distinct word* of a task's documents is encoded by Spark
higher-order functions - ``aggregate`` folds ranked merges over the word's
bytes, looking merges up in a literal rank map - and documents are strings of
word numbers.  Decoding looks up each id's binary piece in a literal array and
concatenates the pieces.

Everything is one map stage, without a shuffle or a broadcast of corpus data:

1. ``mapInArrow`` splits whole texts by the pre-tokenizer pattern and writes a
   chunk of documents (``CHUNK_CHARS`` of text) as one row: the documents as
   lists of word numbers and the words this task has not sent before.
2. The fold encodes the chunk's new words (Catalyst expressions, JVM).
3. ``mapInArrow`` replaces word numbers by token ids.

Word numbers live in the task.  After ``MAX_WORDS`` of them, or ``MAX_WORD_CHARS``
characters, both Python sides start a new numbering at the same chunk (the row says
so), so memory is bounded whatever the partition holds, and a lost task is simply run
again.  The fold of one word takes time that grows with the square of its length
(a run of 8,000 letters without a space takes seconds); no word is cut.

Defined results: a null text encodes like the empty text (no ids, empty
decoded bytes); a null id keeps its row; repeated rows are encoded each; an
empty table gives an empty table.  Only the id and text columns are read, so
extra columns of any name have no effect.  Ids outside the vocabulary decode to
nothing; a null id array decodes to null.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of text gathered into one chunk row; words, and characters of them,
#: numbered before a task starts a new numbering (both Python sides hold them).
CHUNK_CHARS = 256_000
MAX_WORDS, MAX_WORD_CHARS = 300_000, 8_000_000

_BUCKETS = 1 << 16
#: Marks "no merge" and both ends of a word; larger than every id character.
_NONE = chr(0xD7FF)

# The characters of the Latin-1 range by Unicode category, for the
# fast form of the pre-tokenizer pattern (letters, numbers, white space).
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 piece and rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _char(token_id: int) -> str:
    """A token as one character, so that a word in work is a string and its
    merges are string operations.  Ids stay below the surrogate range."""
    return chr(token_id + 1)


def check_ranks(ranks: dict[bytes, int]) -> None:
    if max(ranks.values()) >= ord(_NONE) - 1:
        raise ValueError("rank files of at most 55,293 tokens are supported")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the rank file lacks single bytes")


def merge_table(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: two adjacent token characters -> the character of
    their merge, whose code is its rank.  It is cut into buckets by CRC, so that
    a lookup compares one or two keys; Spark searches a map from its start."""
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pair = _char(left) + _char(right)
                buckets[zlib.crc32(pair.encode()) % _BUCKETS][pair] = _char(rank)
    return F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,string>>")


def _lookup(table: Column, pair: Column) -> Column:
    """The merge of a pair of token characters, or ``_NONE``."""
    bucket = F.get(table, F.pmod(F.crc32(pair.cast("binary")), F.lit(_BUCKETS)).cast("int"))
    return F.coalesce(F.element_at(bucket, pair), F.lit(_NONE))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once (a lambda over one element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def encode_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """Token characters of one word, given as the characters of its single bytes.

    The state of the fold holds the pieces (with ``_NONE`` at both ends) and the
    merge of every adjacent pair; each step merges the leftmost pair of the
    smallest rank and looks up the two pairs that this creates."""
    return _let(merge_table(ranks), lambda table: _folded(word, table))


def _folded(word: Column, table: Column) -> Column:
    one, two = F.lit(1), F.lit(2)

    def lookup(pair: Column) -> Column:
        return _lookup(table, pair)

    def step(s: Column, _: Column) -> Column:
        def at(low: Column, j: Column) -> Column:
            def grown(pieces: Column) -> Column:
                merges = F.overlay(s["merges"], lookup(F.substring(pieces, j, two)), j, two)
                merges = F.overlay(merges, lookup(F.substring(pieces, j - 1, two)), j - 1, one)
                return F.struct(pieces.alias("pieces"), merges.alias("merges"))
            return _let(F.overlay(s["pieces"], low, j, two), grown)

        return _let(F.array_min(F.split(s["merges"], "")),
                    lambda low: F.when(low == F.lit(_NONE), s)
                    .otherwise(_let(F.instr(s["merges"], low), lambda j: at(low, j))))

    padded = F.concat(F.lit(_NONE), word, F.lit(_NONE))
    pairs = F.transform(F.sequence(one, F.length(padded) - 1), lambda i: lookup(F.substring(padded, i, two)))
    start = F.struct(padded.alias("pieces"), F.array_join(pairs, "").alias("merges"))
    return F.aggregate(F.sequence(one, F.greatest(F.length(word) - 1, one)), start, step, lambda s: s["pieces"])


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """Matches of the pre-tokenizer pattern.  Texts of Latin-1 characters take
    the standard module with the categories spelled out; others take ``regex``."""
    import public_tokenizers
    import regex

    whole = regex.compile(pattern)
    if pattern != public_tokenizers.PATTERN:
        return whole.findall
    fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+"
                      f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return whole.findall(text)
        return fast.findall(text)

    return split


class _Numbers(dict):
    """Word -> number, given out in the order of first sight after the words that
    are tokens as a whole; ``new`` are those of the chunk."""

    def __init__(self, known: list[str]):
        super().__init__(zip(known, range(len(known))))
        self.new: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        self.chars += len(word)
        return n


def _number_words(pattern: str, byte_chars: dict[int, str], known: list[str], id_type: pa.DataType):
    """Stage 1: chunks of documents as word numbers, and the chunk's new words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, numbers, fresh = _splitter(pattern), _Numbers(known), True
        ids: list = []
        docs: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, fresh, numbers
            offsets = np.cumsum([0] + [len(d) for d in docs])
            words = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(
                np.concatenate(docs) if docs else np.empty(0, np.int32), pa.int32()))
            coded = [w.encode().decode("latin-1").translate(byte_chars) for w in numbers.new]
            out = pa.record_batch({
                "fresh": pa.array([fresh]), "ids": pa.array([ids], pa.list_(id_type)),
                "docs": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), words),
                "new": pa.array([coded], pa.list_(pa.string()))})
            ids.clear()
            docs.clear()
            numbers.new, size, fresh = [], 0, False
            if len(numbers) > MAX_WORDS or numbers.chars > MAX_WORD_CHARS:
                numbers, fresh = _Numbers(known), True
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                words = split(text)
                docs.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(text) + 64
                if size >= CHUNK_CHARS:
                    yield flush()
        if ids:
            yield flush()

    return run


def _token_ids(batches: Iterator[pa.RecordBatch], known: list[int], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Stage 3: word numbers to token ids."""
    def tokens(words: list[str]) -> Iterator[bytes]:
        """Ids of words that each stand between two ``_NONE``."""
        units = np.frombuffer("".join(words).encode("utf-16-le"), "<u2")
        ends = 4 * np.flatnonzero(units == ord(_NONE))
        ids = (units.astype("<i4") - 1).tobytes()
        return (ids[a + 4:b] for a, b in zip(ends[::2].tolist(), ends[1::2].tolist()))

    whole = [np.int32(i).tobytes() for i in known]
    table: list[bytes] = []
    for batch in batches:
        for row in range(batch.num_rows):
            fresh, ids, docs, new = (batch.column(i)[row] for i in range(4))
            if fresh.as_py():
                table = list(whole)
            table += tokens(new.values.to_pylist())
            numbers, bounds = docs.values.values.to_numpy(), docs.values.offsets.to_numpy()
            parts = [b"".join(map(table.__getitem__, numbers[a:b].tolist())) for a, b in zip(bounds, bounds[1:])]
            offsets = np.cumsum([0] + [len(p) // 4 for p in parts])
            yield pa.record_batch({
                "id": ids.values.cast(id_type),
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()),
                                                pa.array(np.frombuffer(b"".join(parts), "<i4")))})


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: its id column and ``ids array<int>``."""
    check_ranks(ranks)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    id_type = to_arrow_type(src.schema["id"].dataType)
    byte_chars = {b: _char(ranks[bytes([b])]) for b in range(256)}
    # A word that is a token as a whole is not split, as the rank files' libraries do.
    known = {}
    for token, rank in ranks.items():
        try:
            known[token.decode()] = rank
        except UnicodeDecodeError:
            pass
    words, numbers = list(known), list(known.values())
    chunks = src.mapInArrow(_number_words(pattern, byte_chars, words, id_type),
                            f"fresh boolean, ids array<{kind}>, docs array<array<int>>, new array<string>")
    coded = chunks.withColumn("new", F.transform("new", lambda w: encode_word(w, ranks)))
    out = coded.mapInArrow(lambda batches: _token_ids(batches, numbers, id_type), f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """Bytes of a token id array: each id's piece from a literal array, joined
    (as hexadecimal digits, so that the cost is linear in the document)."""
    pieces = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex()
    table = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""))


def digests(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id") -> DataFrame:
    """Digest columns of encoded documents: token count, SHA-256 of the decimal
    ids joined by commas and of the decoded bytes."""
    return encoded.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(_let(F.col("ids").cast("string"), lambda s: F.replace(
            F.substring(s, F.lit(2), F.length(s) - 2), F.lit(", "), F.lit(","))), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))
