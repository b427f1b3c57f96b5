"""BPE, token counts and packing against the libraries."""

import base64
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import cases  # noqa: E402

from cladewise.llm import byte_bpe, packing, token_counts, word_ids  # noqa: E402
from cladewise.session import scratch_path  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "a  b", "x\n \ny", " \nb  ", "aaaaaaa aaaa", "日本語 ﬁ é 12³ don't 'S", "\x01 a", "\x85a \x85 b", "🎉🎉 🎉",
       "ÉCOLE İstanbul ΑΣ ß", "<|endoftext|> x", "!'s ''ll we'LL", "é ­ ²¼ª"]


def odd_texts(n=300):
    draw = random.Random(3)
    return ODD + ["".join(draw.choice("ab \n\t é日'sтe1.\x85<|") for _ in range(draw.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merge_replay_equals_the_library(tiktoken_encoding):
    encoder = byte_bpe.ByteEncoder(RANKS, public_tokenizers.PATTERN)
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == tiktoken_encoding.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_replay_keeps_the_order_of_merges_where_a_lower_rank_opens():
    # "abab": merging ab (4) opens no lower rank; "cdab" opens dab (3) under the rank of cd (5).
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"ab": 4, b"dab": 3, b"cd": 5, b"abab": 2, b"aa": 6, b"aaa": 1}
    replay = byte_bpe.MergeReplay(ranks)
    words = [bytes(random.Random(i).choices(b"abcd", k=i % 12)) for i in range(400)] + [b"aaaaaaa", b"ababab"]
    for word, ids in zip(words, replay.replay(words)):
        assert ids.tolist() == replay.alone(word), word


def test_round_trip_of_documents(spark, tiktoken_encoding):
    docs = cases.documents(spark)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    want = Counter((d, tuple(tiktoken_encoding.encode_ordinary(t or ""))) for d, t, *_ in cases.rows())
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == want
    decoded = byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in decoded) == Counter((d, (t or "").encode()) for d, t, *_ in cases.rows())
    assert byte_bpe.round_trip(cases.no_documents(spark), RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).count() == len(cases.rows())


def test_word_ids_equal_the_library():
    library, encoder = Tokenizer.from_file(WORDS), word_ids.WordEncoder(WORDS)
    texts = odd_texts()
    for text, ids in zip(texts, encoder.ids(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_counts_come_from_the_cache_the_second_time(spark, monkeypatch):
    docs, cache = cases.documents(spark), scratch_path(spark, "cache")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((d, len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in cases.rows())
    first = token_counts.token_counts(docs, PIECES, cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in first.collect()) == want
    stored = token_counts.read_cache(spark, cache)
    assert stored.count() == len({t or "" for _, t, *_ in cases.rows()})
    # A file that no tokenizer is made from: nothing may be encoded any more.
    monkeypatch.setattr(token_counts, "_counter", lambda path: 1 / 0)
    again = token_counts.token_counts(docs, PIECES, cache)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in again.collect()) == want
    assert token_counts.read_cache(spark, cache).count() == stored.count()


def test_counts_of_another_tokenizer_and_of_no_documents(spark):
    library = Tokenizer.from_file(WORDS)
    found = token_counts.token_counts(cases.documents(spark), WORDS).collect()
    want = Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in cases.rows())
    assert Counter((r.doc_id, r.n_tokens) for r in found) == want
    assert token_counts.token_counts(cases.no_documents(spark), PIECES).count() == 0


def test_differencing_is_a_partition_and_near_equal():
    draw = np.random.default_rng(1)
    for n, k in ((0, 1), (1, 3), (7, 3), (200, 20), (500, 7)):
        sizes = draw.integers(1, 513, n)
        part = packing.differenced(sizes, k)
        assert len(part) == n and (n == 0 or part.max() < k)
        if n > 10 * k:
            sums = np.bincount(part, weights=sizes, minlength=k)
            assert sums.max() - sums.min() <= 8
    assert sorted(packing.differenced(np.array([8, 7, 6, 5, 4]), 2).tolist()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])


def test_windows_rise_until_all_fit():
    part = packing.windows(np.array([60, 60, 60, 20]), 100)
    assert np.bincount(part, weights=[60, 60, 60, 20]).max() <= 100 and part.max() == 2


@pytest.mark.parametrize("group_tokens", [1 << 20, 4000])
def test_packed_pieces_hold_every_id_once(spark, group_tokens):
    library = Tokenizer.from_file(WORDS)
    found = packing.packed(packing.pieces(cases.documents(spark), WORDS), group_tokens=group_tokens).collect()
    want = {}
    for doc, text, *_ in cases.rows():
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        want.setdefault(doc, []).append(ids)
    by_row = {}
    for r in found:
        by_row.setdefault((r.doc_id, r.row), []).append(r)
    assert Counter(d for d, _ in by_row) == Counter({d: len(x) for d, x in want.items()})
    for (doc, _), parts in by_row.items():
        parts.sort(key=lambda r: r.start)
        at = 0
        for r in parts:
            assert r.start == at and 0 < r.length <= 2048
            assert any(len(i) == r.doc_tokens and zlib.crc32(i[at:at + r.length].tobytes()) == r.ids_crc32 for i in want[doc])
            at += r.length
        assert at == parts[0].doc_tokens
    windows = {}
    for r in found:
        windows.setdefault(r.sequence_id, []).append(r)
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.packed(packing.pieces(cases.no_documents(spark), WORDS)).count() == 0
