import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from thornwall.llm import packing, tokens, wavelet
from thornwall.llm.queries import QUERIES
from thornwall.llm.tokens import Encoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def library(path):
    found = Tokenizer.from_file(path)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_pieces_give_the_ids_of_whole_texts(path, monkeypatch):
    rng = random.Random(1)
    parts = "a B é Ü ß İ ſ ﬁ é 中 ½ 's 'll x 123 the . , ! ... ’ _ <|endoftext|> <|startoftext|> <|EndOfText|> 😀 Σ ŉ ́ - Word. Wörd, 1. x1, é. Word!! WÖRD.%%% é,$$$ A_&".split() + list("  \n\n\t\r \x1c\x85 ​\0")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", None, " ", "\n\n a  b \n"]
    whole = library(path)
    monkeypatch.setattr(tokens, "MEMO", 300)
    for text, ids in zip(texts, Encoder(path).encode(texts), strict=True):
        expected = whole(text)
        assert ids == struct.pack(f"<{len(expected)}I", *expected), repr(text)


def test_packing_places_every_id_once(odd, none):
    whole = library(BYTES)
    got = packing.pack(odd, BYTES).collect()
    texts = {}
    for r in odd.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append([*whole(r.text), 0])
    assert sum(r.length for r in got) == sum(len(ids) for own in texts.values() for ids in own)
    for r in got:
        assert any(crc(ids[r.start : r.start + r.length]) == r.ids_crc32 and len(ids) == r.doc_tokens for ids in texts[r.doc_id])
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded_to))
    assert set(by_sequence) == set(range(len(by_sequence)))
    for own in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and all(p == (at if at & (at - 1) == 0 else 1024) for _, _, p in own)
    ideal = sum(r.length for r in got) / 1024
    assert len(by_sequence) <= ideal * 1.02 + 2
    assert packing.pack(none, BYTES).count() == 0


def test_plans_hold_every_piece_and_waste_little():
    rng = np.random.default_rng(3)
    for many in (1, 7, 300, 40000):
        sizes = np.minimum(256, rng.lognormal(4.4, 1, many).astype(int) + 1)
        histogram = {int(a): int(b) for a, b in zip(*np.unique(sizes, return_counts=True), strict=True)}
        made = packing.plan(histogram, 256)
        room = {}
        for pattern, times in made:
            assert sum(s * n for s, n in pattern.items()) <= 256
            for s, n in pattern.items():
                room[s] = room.get(s, 0) + n * times
        assert room == histogram
        assert sum(times for _, times in made) <= np.ceil(sizes.sum() / 256) * 1.01 + 3 or many < 300


def test_special_tokens_are_as_in_the_library(spark):
    text = "a <|endoftext|> b<|startoftext|>"
    assert [struct.unpack(f"<{len(x) // 4}I", x) for x in Encoder(BYTES).encode([text])][0][:4] == (64, 220, 50256, 275)
    docs = spark.createDataFrame([(0, text), (1, "plain"), (2, "<|endoftext|>" * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in wavelet.token_files(docs, WORDS).collect()}
    for doc, words in ((0, text), (2, "<|endoftext|>" * 3)):
        ids = [*library(WORDS)(words), 2]
        assert (got[doc].n_tokens, got[doc].ids_crc32) == (len(ids), crc(ids))


def test_generated_columns_reach_the_bound_where_the_first_patterns_do_not():
    rng = np.random.default_rng(8)
    generated = 0
    for _ in range(12):
        sizes = np.sort(rng.choice(np.arange(20, 90), 12, replace=False))
        demand = rng.integers(1, 2000, 12).astype(float)
        basis, first = packing.first_patterns(sizes, demand, 100)
        assert np.allclose(basis @ first, demand) and (first >= 0).all() and (sizes @ basis <= 100).all()
        patterns, amounts = packing.relaxed_patterns(sizes, demand, 100)
        assert (patterns @ sizes <= 100).all() and (patterns.T @ amounts >= demand - 1e-6).all()
        # against all patterns there are
        every = list(_patterns(sizes.tolist(), 100))
        least = _cheapest(np.array(every), demand)
        assert least * (1 - 1e-9) <= amounts.sum() <= least * 1.005  # the bound below is itself some tenths of a percent low
        generated += first.sum() > amounts.sum() * 1.001
    assert generated > 4


def _patterns(sizes, room, first=0):
    """All maximal patterns."""
    if first == len(sizes):
        yield []
        return
    for many in range(room // sizes[first] + 1):
        for rest in _patterns(sizes, room - many * sizes[first], first + 1):
            yield [many, *rest]


def _cheapest(patterns, demand):
    """A lower bound of the sum of amounts with room for the demand, by multiplicative weights as prices."""
    weights = np.ones(len(demand))
    low = 0.0
    patterns = patterns[patterns.sum(1) > 0].astype(float)
    scaled = patterns / demand
    for _ in range(20_000):
        gains = scaled @ weights
        k = int(gains.argmax())
        low = max(low, weights.sum() / gains[k])
        weights *= np.exp(-0.02 * scaled[k] / scaled[k].max())
        weights /= weights.max()
    return low


def test_knapsack_is_optimal():
    rng = np.random.default_rng(4)
    for _ in range(20):
        sizes, values = rng.choice(np.arange(1, 13), 4, replace=False), rng.random(4)
        sack = packing.Knapsack(values, sizes, 17)
        best = np.zeros(18)
        for room in range(1, 18):
            best[room] = max([0, *(best[room - s] + v for s, v in zip(sizes, values, strict=True) if s <= room)])
            copies = sack.pattern(room)
            assert sack.best[room] == pytest.approx(best[room]) == pytest.approx((copies * values).sum()) and (copies * sizes).sum() <= room


def test_registered_queries_equal_the_library(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces, whole = {}, library(BYTES)
    for r in QUERIES["op4_packing"](spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for doc, text in texts.items():
        ids, at = [*whole(text), 0], 0
        for start, length, check, tokens in sorted(pieces.pop(doc)):
            assert start == at and tokens == len(ids) and check == crc(ids[start : start + length])
            at += length
        assert at == len(ids)
    assert not pieces
    start, whole = 0, library(WORDS)
    for r in sorted(QUERIES["op7_wavelet"](spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*whole(texts.pop(r.doc_id)), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert not texts


def test_a_wavelet_file_answers_like_a_list():
    rng = np.random.default_rng(5)
    tokens = np.concatenate([rng.integers(0, 49408, 70000), rng.integers(0, 5, 30000)]).astype(np.uint32)
    lengths = np.array([60000, 1, 39999])
    file = wavelet.WaveletFile(wavelet.encode_file(np.array([-4, 0, 9]), np.array([1, 0, 1]), lengths, tokens))
    assert (file.tokens() == tokens).all() and file.lengths.tolist() == lengths.tolist()
    assert file.doc_ids.tolist() == [-4, 0, 9] and file.known.tolist() == [True, False, True]
    for place in (0, 1, 32767, 32768, 65536, 99999):
        assert file.access(place) == tokens[place]
    for token in (0, 3, int(tokens[10]), 49407, 65535, 1 << 20):
        places = np.flatnonzero(tokens == token)
        assert file.count(token) == len(places) and file.count(token, 70000) == (places < 70000).sum()
        for k in (0, 1, len(places) - 1, len(places)):
            assert file.occurrence(token, k) == (places[k] if 0 <= k < len(places) else -1)
    empty = wavelet.WaveletFile(wavelet.encode_file(*[np.zeros(0, np.int64)] * 4))
    assert empty.tokens().size == 0 and empty.count(1) == 0 and empty.occurrence(0, 0) == -1


def test_blocks_that_compress_to_their_own_length_are_plain(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 64)
    rng = np.random.default_rng(7)
    shrink = wavelet.zstandard.ZstdCompressor(level=1).compress
    same = 0
    for share in np.linspace(0, 1, 60):  # from blocks that shrink to blocks that grow
        tokens = np.where(rng.random(9000) < share, rng.integers(0, 2, 9000), 0).astype(np.uint32)
        packed = np.packbits(tokens.astype(bool)).tobytes()
        same += sum(len(shrink(packed[i : i + 64])) == 64 for i in range(0, len(packed) - 64, 64))
        file = wavelet.WaveletFile(wavelet.encode_file(np.array([1]), np.array([1]), np.array([9000]), tokens))
        assert (file.tokens() == tokens).all() and file.access(8999) == tokens[8999]
    assert same > 0


def test_token_files_round_trip(odd, none, monkeypatch):
    monkeypatch.setattr(wavelet, "FILE_TOKENS", 20000)
    whole = library(WORDS)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    expected, start = [], 0
    for doc, text in rows:
        ids = [*whole(text), 2]
        expected.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in wavelet.token_files(odd, WORDS).collect()), key=lambda r: r[1]) == expected
    assert wavelet.token_files(none, WORDS).count() == 0
