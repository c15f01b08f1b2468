"""Operators 1, 4, 6 and 7, and the pipeline, against the libraries and by round trips."""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import packing, queries, telephony, token_store, tokens

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n\n a  b\t c", "<|endoftext|> x", "é" * 3000, "a b " * 20_000, "I'm  here  now\r\n", "日本語 テキスト"]


@pytest.fixture(scope="module")
def truth(spark):
    t = Tokenizer.from_file(PATH)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: (r.text or "", t.encode(r.text or "", add_special_tokens=False).ids) for r in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_counts(spark, truth):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op4_token_counts(spark, SF).collect()}
    assert got == {k: (len(t.encode()), len(ids), len(ids) > 512) for k, (t, ids) in truth.items()}


def test_counts_of_odd_texts(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], "doc_id long, text string, n_tokens int")
    t = Tokenizer.from_file(PATH)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()}
    assert got == {k: len(t.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(ODD)}
    assert tokens.count_tokens(docs.limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r  ab1'.<|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_encode_as_whole_texts(text):
    t = Tokenizer.from_file(PATH)
    assert tokens.encoder(PATH).encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing(spark, truth):
    rows = queries.op1_best_fit_packing(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == truth.keys()
    for k, pieces in by_doc.items():
        ids, at = [*truth[k][1], 0], 0
        for j, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (j, at, crc(ids[at : at + p.length]))
            assert p.length == 2048 or j == 0
            at += p.length
        assert at == len(ids)
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 2048) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_patterns_use_every_length(histogram):
    used = Counter()
    for lengths, times in packing.plan_patterns(histogram, 64):
        assert sum(lengths) <= 64 and times > 0
        for n in lengths:
            used[n] += times
    assert used == Counter(histogram)


def least_bins(lengths, capacity):
    """The fewest sequences, by trying every place for every piece, long ones first."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_patterns_are_near_the_fewest(lengths):
    used = sum(times for _, times in packing.plan_patterns(Counter(lengths), 20))
    assert least_bins(sorted(lengths, reverse=True), 20) <= used <= least_bins(sorted(lengths, reverse=True), 20) + 1


def test_exact_complements_are_found():
    for histogram in ({12: 5, 8: 5}, {10: 3, 6: 3, 4: 3}, {9: 2, 5: 2, 4: 2, 2: 2}):
        patterns = packing.plan_patterns(histogram, 20)
        assert all(sum(x) == 20 for x, _ in patterns)


def test_clashing_columns(spark):
    texts = [(1, "a b c", "x", "y", 7, b"q"), (1, "a b c", "x", "y", 7, b"q"), (2, None, None, None, None, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, sequence_id string, _salt string, offset long, ids binary")
    packed = packing.pack(packing.tokenize_pieces(docs, PATH, with_ids=False)).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == sorted((k, n) for k, n in ((1, 4), (1, 4), (2, 1)))
    extra = spark.createDataFrame([(1, 0, 5, "s", "o", "t")], "doc_id long, piece int, length long, sequence_id string, offset string, _salt string")
    r = packing.pack(extra).first()
    assert (r.sequence_id, r.offset) == (0, 0)
    named = docs.withColumns({"pid": F.lit("p"), "seq": F.lit("s"), "n_tokens": F.lit("n"), "start": F.lit("z")})
    got = token_store.read_documents(token_store.write_tokens(named, PATH)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 4), (1, 4), (2, 1)]


def test_store_lookup(spark, truth):
    written = token_store.write_tokens(spark.createDataFrame([(k, t) for k, (t, _) in truth.items()] + [(10**12, "twice"), (10**12, "twice"), (None, "n")], "doc_id long, text string"), PATH)
    keys = [*sorted(truth)[::37], -1, 10**12]
    got = sorted((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in token_store.lookup(written, keys).collect())
    twice = [*Tokenizer.from_file(PATH).encode("twice", add_special_tokens=False).ids, 0]
    want = [(k, len(truth[k][1]) + 1, crc([*truth[k][1], 0])) for k in keys if k in truth] + [(10**12, len(twice), crc(twice))] * 2
    assert got == sorted(want)


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{k}" for k in range(3000)])
    text = " ".join(words[rng.integers(0, 3000, 900_000)])
    t = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(1, text), (2, "short " * 3)], "doc_id long, text string")
    ids = t.encode(text, add_special_tokens=False).ids
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, PATH).collect()}
    assert got[1] == len(ids)
    pieces = packing.tokenize_pieces(docs, PATH).filter("doc_id = 1").orderBy("piece").collect()
    assert zlib.crc32(b"".join(bytes(p.ids) for p in pieces)) == crc([*ids, 0]) and all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)


def test_encoder_evicts_and_stays_right():
    t, enc = Tokenizer.from_file(PATH), tokens.ChunkEncoder(PATH, limit=300)
    rng = np.random.default_rng(9)
    for turn in range(12):
        texts = [" ".join(f"{'x' * int(k % 5)}{k}" for k in rng.integers(0, 100 * (turn + 1), 60)) for _ in range(5)]
        assert [x.tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert enc.counts(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


class Counting:
    """The tokenizer, and what it was asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, texts, **named):
        self.asked += texts
        return self.tokenizer.encode_batch_fast(texts, **named)


def test_new_chunks_are_encoded_together_and_without_their_signs():
    t, enc = Tokenizer.from_file(PATH), tokens.ChunkEncoder(PATH)
    enc.tokenizer = Counting(t)
    words = [f"{a}{b}" for a in ("stra\u00dfe", "tion", "\u00e9ro", "Th") for b in "abcdefghijklmnopqrstuvwxyz"]
    texts = [" ".join(f"x{w}{sign}" for w in words) for sign in ("", ",", ".", "!!", "$$$", ".&&&")]
    assert [x.tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(enc.tokenizer.asked) < 20 and sum(x.count("x") for x in enc.tokenizer.asked) <= len(words) + 2 * len(texts)


@functools.cache
def forgetful(widths):
    """The tokenizer, and an encoder that keeps no chunk for the next texts; without widths it finds no chunk's end in joined ones."""
    enc = tokens.ChunkEncoder(PATH, limit=0)
    enc.widths = enc.widths * widths
    return Tokenizer.from_file(PATH), enc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ\u00e9\u00df\u0301\u0430\u65e57.,!$%&#'\u2019-_<|>\u00bd\u2028\x1f\t \n"), min_size=1, max_size=8), max_size=12), st.booleans())
def test_signs_behind_any_character(words, widths):
    t, enc = forgetful(widths)
    texts = [" ".join(words), *words, "<|endoftext|>, <|endoftext|> I'll. I'll", "\n".join(words)]
    assert [x.tolist() for x in enc.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert enc.counts(texts).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_pack_odd(spark):
    pieces = spark.createDataFrame([(None, 0, 5), (None, 0, 5), (1, 0, 2048)], "doc_id long, piece int, length long")
    assert len({(r.sequence_id, r.offset) for r in packing.pack(pieces).collect()}) == 3
    assert packing.pack(pieces.limit(0)).count() == 0


def test_store(spark, truth):
    start, want = 0, {}
    for k in sorted(truth):
        ids = [*truth[k][1], 0]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op7_token_store(spark, SF).collect()} == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10**7), max_size=700))
def test_elias_fano(values):
    values.sort()
    ef = token_store.EliasFano(token_store.ef_encode(np.array(values, np.uint64)))
    assert ef.all().tolist() == values
    assert [ef.select(i) for i in range(0, len(values), 37)] == values[::37]


def test_store_odd(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (-5, "b c"), (2**62, "d"), (2**62, "d")], "doc_id long, text string")
    got = token_store.read_documents(token_store.write_tokens(docs, PATH)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (False, 0), (True, -5), (True, 2**62), (True, 2**62)]
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    assert token_store.read_documents(token_store.write_tokens(docs.limit(0), PATH)).count() == 0


def test_media_round_trip(spark, truth):
    for r in queries.op6_telephony(spark, SF).collect():
        raw = truth[r.doc_id][0].encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_codecs():
    mu, a = telephony.expansion("mulaw"), telephony.expansion("alaw")
    assert (mu[0], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    data = bytes(range(192)) * 2
    for codec in ("mulaw", "alaw", "adpcm"):
        media = telephony.write_wav(data, codec)
        assert telephony.codes_of(media) == data and telephony.read_wav(media)[0] == codec
    tone = (8000 * np.sin(np.arange(800) / 9)).astype(np.int16)
    up = telephony.resample(tone, 8000, 16000)
    assert len(up) == 1600 and np.abs(up[::2][20:-20].astype(int) - tone[20:-20]).max() <= 1


def adpcm_by_hand(block):
    """One sample at a time, as the format's text says."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(max(block[2], 0), 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            size = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                size += part if code & bit else 0
            value = max(-32768, min(32767, value - size if code & 8 else value + size))
            index = max(0, min(88, index + int(telephony.CHANGES[code & 7])))
            out.append(value)
    return out


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=20, max_size=20), min_size=1, max_size=5))
def test_adpcm_blocks_against_single_steps(blocks):
    got = telephony.decode_adpcm(np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 20))
    assert got.tolist() == [adpcm_by_hand(b) for b in blocks]


def test_resampling_in_blocks(monkeypatch):
    x = np.random.default_rng(1).integers(-9000, 9000, 5000).astype(np.int16)
    for to in (16000, 12000, 4000, 6000):
        whole = telephony.resample(x, 8000, to)
        monkeypatch.setattr(telephony, "BLOCK_SAMPLES", 640)
        assert (telephony.resample(x, 8000, to) == whole).all() and len(whole) == len(x) * to // 8000
        assert telephony.pcm_features(x) == features_by_hand(x)
        monkeypatch.undo()


def features_by_hand(x):
    v = [int(k) for k in x]
    zc = sum((a < 0) != (b < 0) for a, b in zip(v, v[1:], strict=False))
    return f"n={len(v)};peak={max(map(abs, v))};rms={math.isqrt(sum(k * k for k in v) // len(v))};zc={zc};pcm_crc32={zlib.crc32(x.tobytes())}"


def test_media_odd(spark):
    data = bytes(range(256)) * 30_000
    rows = [(1, bytearray(b"x" * 192), "adpcm", "p"), (2, None, "mulaw", "p"), (None, bytearray(b"y" * 192), None, "p"), (3, bytearray(data), "alaw", "p"), (3, bytearray(data), "adpcm", "p"), (4, bytearray(b""), "mulaw", "p")]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, codec string, media string")
    stored = telephony.store_media(df).cache()
    got = {(r.doc_id, r.codec): r for r in telephony.decode_media(stored).collect()}
    assert got[1, "adpcm"].codes == b"x" * 192 and got[2, None].codes is None and got[None, None].pcm is None
    assert got[3, "alaw"].codes == data and got[3, "adpcm"].codes == data and got[4, "mulaw"].codes == b""
    codec, rate, _, pcm = telephony.read_wav(bytes(got[3, "alaw"].pcm))
    assert (codec, rate, len(pcm)) == ("pcm", 16000, 4 * len(data))
    told = {(r.doc_id, r.payload_bytes): r for r in telephony.describe_media(stored).collect()}
    assert told[2, None].feature is None and told[4, 0].feature.startswith("mulaw;rate=16000;n=0")
    assert {r.feature for r in telephony.describe_media(stored).filter("doc_id = 3").collect()} >= {f"alaw;rate=16000;{telephony.pcm_features(np.frombuffer(pcm, '<i2'))}"}
    assert telephony.describe_media(stored.limit(0)).count() == 0 and telephony.decode_media(stored.limit(0)).count() == 0


def test_pipeline(spark):
    """Every stage keeps what it must keep, and the last one packs all that is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in queries.op8_toxicity(spark, SF).filter("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == corpus_pipeline.COLUMNS
        kept = {r.doc_id: r.text for r in after.collect()}
        assert kept.keys() <= before.keys()
        if name == "toxicity":
            assert kept.keys() == before.keys() - toxic
        if name in ("near_dedup", "decontamination"):
            assert all(before[k] == t for k, t in kept.items())
        docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in sorted(kept.items())], "doc_id long, text string, lang string, source string, n_chars long")
        before = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == before.keys()


def test_pipeline_odd(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "a b c d e f", "en", None, 11), (2, "", "en", "s", 0), (3, "you idiot " * 4000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, data, SF).collect()
    assert corpus_pipeline.STAGES[1][1](spark, docs, SF).count() == 5
