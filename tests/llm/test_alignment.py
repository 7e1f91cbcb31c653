"""Alignment of two tokenizers against a plain loop over tokens of the libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY_A = Tokenizer.from_file(A)
LIBRARY_A.encode_special_tokens = True
LIBRARY_B = sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """(id, bytes) of both tokenizers; none where the bytes are not the text's."""
    pieces = alignment.tokenizer(A)[0].pieces
    a = [(i, pieces[i]) for i in LIBRARY_A.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in LIBRARY_B.encode(text):
        p = LIBRARY_B.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if LIBRARY_B.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = text and b"".join(p for _, p in a) == whole and b"".join(p for _, p in b) == whole
    return (a, b) if same else ([], [])


def spans(toks):
    out, at = [], 0
    for i, p in toks:
        out.append((i, at, at + len(p)))
        at += len(p)
    return out


def brute(texts):
    """Rows without ids, one a text."""
    found = []
    for text in texts:
        a, b = map(spans, tokens(text or ""))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = ";".join(",".join(str(i) for i, s, e in a if lo < e <= hi) + "|"
                          + ",".join(str(j) for j, s, e in b if lo < e <= hi) for lo, hi in zip([0, *ends], ends))
        found.append((len(a), len(b), len(ends), links, groups))
    count = Counter(p for *_, links, _ in found for p in set(links))
    highest = Counter()
    for (i, _), c in count.items():
        highest[i] = max(highest[i], c)
    return [(n_a, n_b, n, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if n_a else "", g) for n_a, n_b, n, links, g in found]


def check(docs):
    rows = docs.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]))), key=str)
    got = sorted((tuple(r) for r in alignment.align(docs, A, B, with_groups=True).collect()), key=str)
    assert got == want
    assert alignment.align(docs, A, B).columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best",
                                                   "count_sum", "groups_sha256"]


TEXTS = ["don't <|endoftext|> stop </s> <s> now", "tab\there  two   spaces\n\n\nlines ", " leading", "▁mark ▁",
         "café café naïve 中文字 \U0001f642\U0001f642", "\x00nul\x00", "   wide　 spaces", "1234567 89.5e10"]


@pytest.mark.parametrize("size", [1, 200, 1 << 22])
def test_alignment_against_brute_force(docs_of, monkeypatch, size):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "MAX_WINDOWS", 5 if size == 200 else 10 ** 6)
    rng = random.Random(11)
    words = "the of unbelievable Thstion don't café 中文 x1 tokenization, antidisestablishmentarianism\n".split(" ")
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(40)]
    check(docs_of(list(enumerate(texts + texts[:4]))))


def test_odd_and_empty(odd_docs, docs_of):
    check(odd_docs)
    assert alignment.align(docs_of([]), A, B).count() == 0
    check(docs_of([(1, None), (2, "")]))


def test_ranks_equal_the_library():
    own = alignment.ByteLevel(A)
    rng = random.Random(2)
    alphabet = "abcde ABC'stre019 .,!-\n\t\xa0\x85Σ中\U0001f642́<|endoftext|>"
    for text in ["", *TEXTS, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(2000))]:
        assert own.ids(text).tolist() == LIBRARY_A.encode(" " + text, add_special_tokens=False).ids, text
