"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Method: whitespace-token anchors.  Both tokenizers encode the whole text; the
lengths of their tokens in bytes give every token's place.  A place where both
have a token that begins with a space is an anchor, so the texts before it are
verified to end together; anchors split the document into windows of token ids.
A window's alignment depends on its ids alone and is memoised by the two id
tuples; a chunk's new windows are aligned together.  Inside a window every place
where a token of either ends is one link (the two tokens that overlap before it),
every common end closes a group.

Corpus-wide counts of linked id pairs: a task gathers documents into chunks of
about ``CHUNK_BYTES`` of text and numbers the chunk's distinct pairs, so what is
shuffled is a pair once per chunk, with how many of the chunk's documents hold
it, not once per document.  Pairs are summed, the highest count of every id of
the first tokenizer is found among at most a vocabulary of partners, and each
chunk gets its pairs' counts back (co-grouped by chunk).

Memory of a task: a chunk and its distinct windows (a single document may be a
larger chunk); the memo starts afresh after ``MAX_WINDOWS`` windows, and windows
of over ``LONG`` bytes of ids are not remembered.

Defined results: a null or empty text, and one whose tokens' bytes are not
exactly a space and the text (a tokenizer that alters text), has no tokens: all
numbers are 0 and ``groups`` is empty.  Such documents count for no pair.  Rows
are aligned each for itself, so repeated rows count as two documents and null
ids are kept; an empty table gives an empty table.  Only the id and text columns
are read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import staged

CHUNK_BYTES = 4 << 20
MAX_WINDOWS = 200_000
LONG = 512
#: Stands between the ids of two sides; no run of ids holds it.
BETWEEN = b"\xff\xff\xff\xff"


class ByteLevel:
    """Byte-level BPE of the tokenizers library; ``tokens(text)`` of a space and the
    text, ``joined`` gives their bytes.  A file whose ids follow its merges is also a
    rank table, which the rank-based library merges several times faster (the tests
    hold both alike)."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path) as f:
            spec = json.load(f)
        # Byte-level alphabet: printable bytes stand for themselves, the others
        # for the characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in token)
        for t in spec.get("added_tokens", []):
            self.pieces += [b""] * (t["id"] + 1 - len(self.pieces))
            self.pieces[t["id"]] = t["content"].encode()
        added = {t["content"] for t in spec.get("added_tokens", [])}
        pre = spec.get("pre_tokenizer") or {}
        ranked = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                  and not spec.get("normalizer") and all(
                      vocab.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i
                      for i, m in enumerate(model["merges"])))
        if ranked:
            import tiktoken

            ranks = {self.pieces[i]: i for token, i in vocab.items() if token not in added}
            encoding = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.joined = encoding.encode_ordinary, encoding.decode_bytes
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            library.encode_special_tokens = True
            piece = self.pieces.__getitem__
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids
            self.joined = lambda ids: b"".join(map(piece, ids))

    def tokens(self, text: str) -> list[int]:
        return self.encode(" " + text)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokens(text), np.int32)


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = model.encode
        self.pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
                       for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
        piece = self.pieces.__getitem__
        self.joined = lambda ids: b"".join(map(piece, ids))


@cache
def tokenizer(path: str) -> tuple[ByteLevel | Pieces, np.ndarray, np.ndarray]:
    """One per worker process and file, with its tokens' lengths in bytes and
    whether they begin with a space."""
    own = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return (own, np.array([len(p) for p in own.pieces], np.int64),
            np.array([p.startswith(b" ") for p in own.pieces], bool))


def align_windows(a: np.ndarray, b: np.ndarray, last: np.ndarray, len_a: np.ndarray,
                  len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Links (id of a * 2^32 + id of b) of windows written one after the other, the
    number of links and of groups of each, and its groups as text.  ``last``: the
    number of a's tokens up to the end of each window.  Both sides of a window have
    the same bytes, so their ends run on together."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
    ends = ends[np.diff(ends, prepend=-1) > 0]
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    links = a[at_a].astype(np.int64) << 32 | b[at_b]
    # A common end closes a group of the tokens since the one before.
    closes = (end_a[at_a] == ends) & (end_b[at_b] == ends)
    stop_a, stop_b = at_a[closes] + 1, at_b[closes] + 1
    own_a, own_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    of_window = end_a[last - 1]
    n_links = np.diff(np.searchsorted(ends, of_window, "right"), prepend=0)
    groups = np.searchsorted(ends[closes], of_window, "right")
    # Written in the order a's tokens of a group, b's tokens of it; by id and
    # whether the token is its group's last.
    ids = np.empty(len(a) + len(b), np.int64)
    ids[np.arange(len(a)) + np.repeat(stop_b - own_b, own_a)] = a * 2
    ids[np.arange(len(b)) + np.repeat(stop_a, own_b)] = b * 2 + 2 * len(len_a)
    ids[stop_a - 1 + stop_b - own_b] += 1
    ids[stop_b - 1 + stop_a] += 1
    written = _written(len(len_a), len(len_b))
    whole = "".join(map(written.__getitem__, ids.tolist()))
    places = np.cumsum(_lengths(len(len_a), len(len_b))[ids])[(stop_a + stop_b)[groups - 1] - 1].tolist()
    texts = [whole[e:f - 1] for e, f in zip([0, *places], places)]
    return links, n_links, np.diff(groups, prepend=0), texts


@cache
def _written(n_a: int, n_b: int) -> list[str]:
    """Ids with what follows them inside and at the end of a group."""
    return [f"{i}{c}" for n, close in ((n_a, "|"), (n_b, ";")) for i in range(n) for c in (",", close)]


@cache
def _lengths(n_a: int, n_b: int) -> np.ndarray:
    return np.array([len(w) for w in _written(n_a, n_b)], np.int64)


class Windows(dict):
    """Number of every window met, by its two id tuples (32-bit ids as bytes, with
    ``BETWEEN``); by number its links, its count of groups and their text, once
    ``align`` has run."""

    def __init__(self, len_a: np.ndarray, len_b: np.ndarray):
        super().__init__()
        self.len_a, self.len_b = len_a, len_b
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.links, self.starts, self.groups, self.texts = array("q"), array("q", [0]), array("q"), []
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        number = len(self.texts) + len(self.new)
        self.new.append(key)
        if len(key) <= LONG:
            self[key] = number
        return number

    def align(self) -> None:
        """The windows met since the last call."""
        if self.new:
            sides = [key.split(BETWEEN) for key in self.new]
            a, b = (np.frombuffer(b"".join([side[i] for side in sides]), np.int32) for i in range(2))
            last = np.cumsum([len(side[0]) // 4 for side in sides])
            links, n_links, n_groups, texts = align_windows(a, b, last, self.len_a, self.len_b)
            self.starts.extend((len(self.links) + np.cumsum(n_links)).tolist())
            self.links.frombytes(links.tobytes())
            self.groups.extend(n_groups.tolist())
            self.texts += texts
            self.new = []


def _starts(ids: np.ndarray, lengths: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and byte places of the tokens that begin with a space, and of the
    first."""
    marked = space[ids]
    marked[0] = True
    at, size = np.flatnonzero(marked), lengths[ids]
    return at, (np.cumsum(size) - size)[at]


def windows_of(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, place_x: np.ndarray, at_y: np.ndarray,
               place_y: np.ndarray) -> list[bytes]:
    """The document's windows: ids of both sides between anchors, with ``BETWEEN``."""
    j = np.minimum(np.searchsorted(place_y, place_x), len(place_y) - 1)
    shared = place_y[j] == place_x
    p, q = np.append(at_x[shared], len(x)), np.append(at_y[j[shared]], len(y))
    number = np.arange(len(p) - 1)
    out = np.full(len(x) + len(y) + len(number), -1, np.int32)
    out[np.arange(len(x)) + np.repeat(number + q[:-1], np.diff(p))] = x
    out[np.arange(len(y)) + np.repeat(number + 1 + p[1:], np.diff(q))] = y
    raw, cuts = out.tobytes(), (4 * (p + q + np.arange(len(p)))).tolist()
    return [raw[e:f] for e, f in zip(cuts, cuts[1:])]


_FIRST = pa.schema([("id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("n_links", pa.int64()), ("groups", pa.string()), ("chunk", pa.int64()),
                    ("pair", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
                    ("keys", pa.list_(pa.int64())), ("held", pa.list_(pa.int64()))])


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by their owner among n, as lists."""
    ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


class _Chunk:
    """Documents aligned but not yet written."""

    def __init__(self) -> None:
        self.ids, self.n_a, self.n_b, self.windows, self.bytes = [], [], [], [], 0

    def add(self, doc_id: int | None, n_a: int, n_b: int, windows: list[int], size: int) -> None:
        for column, value in zip((self.ids, self.n_a, self.n_b), (doc_id, n_a, n_b)):
            column.append(value)
        self.windows.append(np.array(windows, np.int64))
        self.bytes += size

    def batch(self, number: int, memo: Windows) -> pa.RecordBatch:
        """A row a document, and one with the chunk's distinct pairs."""
        memo.align()
        n, text_of = len(self.ids), memo.texts.__getitem__
        texts = [";".join(map(text_of, w.tolist())) for w in self.windows]
        links = np.frombuffer(memo.links, np.int64) if memo.links else np.zeros(0, np.int64)
        starts, per_window = np.frombuffer(memo.starts, np.int64), np.array(memo.groups, np.int64)
        of_doc = np.repeat(np.arange(n), [len(w) for w in self.windows])
        window = np.concatenate([*self.windows, np.zeros(0, np.int64)])
        n_groups = np.bincount(of_doc, per_window[window], n).astype(np.int64)
        size = np.diff(starts)
        # The chunk's pairs are numbered by its distinct windows.
        used, where = np.unique(window, return_inverse=True)
        keys, pair = np.unique(_gather(links, starts[used], size[used]), return_inverse=True)
        first = np.cumsum(size[used]) - size[used]
        pairs = _gather(pair, first[where], size[window])
        owner = np.repeat(of_doc, size[window])
        n_links = np.bincount(owner, minlength=n)
        both, times = np.unique(owner * max(1, len(keys)) + pairs, return_counts=True)
        owner, pairs = both // max(1, len(keys)), both % max(1, len(keys))
        held = np.bincount(pairs, minlength=len(keys))
        rows = pa.record_batch([
            pa.array(self.ids, pa.int64()), pa.array(self.n_a, pa.int64()), pa.array(self.n_b, pa.int64()),
            pa.array(n_groups), pa.array(n_links, pa.int64()), pa.array(texts, pa.string()),
            pa.array(np.full(n, number)), _lists(pairs, owner, n, pa.int32()), _lists(times, owner, n, pa.int64()),
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=_FIRST)
        whole = pa.record_batch([pa.nulls(1, f.type) for f in _FIRST][:6] + [
            pa.array([number]), *[pa.nulls(1, f.type) for f in _FIRST][7:9],
            pa.array([keys], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.int64()))], schema=_FIRST)
        return pa.concat_batches([rows, whole])


def _gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of values, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row a document (``keys`` null) and a row a chunk (``keys`` its distinct
    pairs, ``held`` the number of its documents that hold each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, len_a, space_a), (b, len_b, space_b) = tokenizer(a_path), tokenizer(b_path)
        memo, chunk, number = Windows(len_a, len_b), _Chunk(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                raw = b" " + text.encode()
                x, y = (a.tokens(text), b.tokens(text)) if text else ([], [])
                if not x or a.joined(x) != raw or b.joined(y) != raw:
                    chunk.add(doc_id, 0, 0, [], 0)
                else:
                    x, y = np.array(x, np.int32), np.array(y, np.int32)
                    windows = windows_of(x, y, *_starts(x, len_a, space_a), *_starts(y, len_b, space_b))
                    chunk.add(doc_id, len(x), len(y), list(map(memo.__getitem__, windows)), len(raw))
                if chunk.bytes >= CHUNK_BYTES or len(chunk.ids) >= 10_000:
                    yield chunk.batch(number, memo)
                    chunk, number = _Chunk(), number + 1
                    if len(memo.texts) > MAX_WINDOWS:
                        memo.restart()
        if chunk.ids:
            yield chunk.batch(number, memo)

    return docs.mapInArrow(run, "id long, n_a long, n_b long, n_groups long, n_links long, groups string, chunk long, "
                                "pair array<int>, times array<long>, keys array<long>, held array<long>")


def _sums(lists: pa.ChunkedArray, values: np.ndarray) -> pa.Array:
    """Sum of the values of every list."""
    ends = np.r_[0, np.cumsum(lists.combine_chunks().value_lengths().to_numpy())]
    return pa.array(np.diff(np.r_[0, np.cumsum(values)][ends]), pa.int64())


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
          with_groups: bool = False) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best``, ``count_sum``, ``groups_sha256`` and, on request, ``groups``."""
    first = _aligned(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")),
                     a_path, b_path)
    first = first.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")))
    first = staged(first if with_groups else first.drop("groups"), "aligned")
    pairs = (first.filter("keys IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("keys", "held")))
             .select("chunk", F.col("pos").alias("no"), F.col("col.keys").alias("key"), F.col("col.held").alias("held")))
    counts = staged(pairs.groupBy("key").agg(F.sum("held").alias("count")), "pair-counts")
    counts = counts.withColumn("a", F.shiftright("key", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "a").select("key", "count", (F.col("count") == F.col("highest")).alias("best"))
    back = pairs.join(known, "key").select(F.col("chunk").alias("home"), "no", "count", "best")
    own = first.filter("keys IS NULL").drop("keys", "held")
    kept = [f for f in own.schema if f.name not in ("chunk", "pair", "times")]

    def finish(docs_: pa.Table, values: pa.Table) -> pa.Table:
        size = values.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        no = values["no"].to_numpy()
        count[no], best[no] = values["count"].to_numpy(), values["best"].to_numpy()
        lists = docs_["pair"]
        pair = lists.combine_chunks().flatten().to_numpy()
        times = docs_["times"].combine_chunks().flatten().to_numpy()
        return pa.table([docs_[f.name] for f in kept] + [_sums(lists, times * best[pair]), _sums(lists, times * count[pair])],
                        names=[f.name for f in kept] + ["n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n_best long, count_sum long"
    done = own.groupBy("chunk").cogroup(back.groupBy("home")).applyInArrow(finish, schema)
    return done.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                       "groups_sha256", *["groups"] if with_groups else [])
