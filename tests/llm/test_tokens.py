import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import best_fit, byte_bpe
from factloom.llm.tokens import WordTokenizer, rank_form

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_library_and_round_trips(odd_docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    encoded = byte_bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    got = {(r.doc_id, tuple(r.ids)): r for r in encoded.select("doc_id", "ids").collect()}
    digests = {(r.doc_id, r.ids_sha256): r for r in byte_bpe.digests(encoded, RANKS).collect()}
    assert encoded.count() == odd_docs.count()
    for row in odd_docs.collect():
        ids = library.encode_ordinary(row.text or "")
        assert (row.doc_id, tuple(ids)) in got
        d = digests[row.doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert d.n_tokens == len(ids)
        assert d.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert byte_bpe.encode(odd_docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_task_numbering_starts_afresh(docs_of, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 50)
    docs = docs_of([(i, f"word{i} tail{i % 7} common") for i in range(60)], 1)
    whole = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", 1)
    cut = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert whole == cut


def test_word_tokenizer_equals_library():
    library = Tokenizer.from_file(WORDS)
    own = WordTokenizer(WORDS)
    assert own.ranked is not None
    rng = random.Random(7)
    alphabet = "abcdeéßÜ'stre019 .,!-\n\t\xa0\x85Σ中🙂́"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for text in texts + ["", "\0", "a\0b", "<|endoftext|> x", "a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|>é",
                         "x<|startoftext|><|endoftext|>  中<|endoftext|", "\u212a<|endoftext|>İ"]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_vocabulary_token_merges_alike():
    """The rank form merges each whole-word token as the merge list does."""
    library = Tokenizer.from_file(WORDS)
    with open(WORDS) as f:
        spec = json.load(f)
    own = WordTokenizer(WORDS)
    for token, i in rank_form(spec).items():
        try:
            word = token.removesuffix(b"\0").decode()
        except UnicodeDecodeError:
            continue
        if word.isalpha() and word.isascii() and word.islower():
            assert own._merge(word) == library.encode(word, add_special_tokens=False).ids, (word, i)


def _check_packing(rows, capacity):
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_pieces_and_places(odd_docs, spark, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(best_fit, "GROUP", 4)
    odd_docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.lit("a <|endoftext|> b <|startoftext|>")))
    cut = best_fit.pieces(odd_docs, WORDS, 64, with_ids=True)
    rows = best_fit.pack(cut, 64).collect()
    want = []
    for row in odd_docs.collect():
        ids = np.asarray(library.encode(row.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(row.doc_id, p, a, len(ids[a:a + 64]), zlib.crc32(ids[a:a + 64].tobytes()))
                 for p, a in enumerate(range(0, len(ids), 64))]
    key = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(key, key=str) == sorted(want, key=str)
    n = _check_packing(rows, 64)
    assert n >= -(-sum(r.length for r in rows) // 64)
    joined = best_fit.sequences(best_fit.pack(cut, 64)).collect()
    assert sum(len(r["ids"]) for r in joined) == 4 * sum(r.length for r in rows)
    assert best_fit.pack(best_fit.pieces(odd_docs.limit(0), WORDS, 64), 64).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = best_fit.best_fit([6, 5, 4, 3, 2], 10)
    assert fills == [10, 10] and bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8]
