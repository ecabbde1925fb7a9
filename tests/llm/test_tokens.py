"""BPE against the public library, packing, TIFF codecs and sharding."""

import hashlib
import json
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from motifstream.llm import bpe, packing, queries, sharding, tiff
from motifstream.llm._arrow import text_chunks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "'", "''s 's", "don't I'LL we'll 'reabc it''s", " " * 9, "a  \n\n b\t\tc ", "a b c", "12 34٣x", "é" * 70, "ab" * 400, "\U0001f600 <|endoftext|> x", "x<|endoftext|>", "<|endoftext|>", "a\n", " a", "a ", "\r\n\r\n", "...!!! ?", "漢字 かな", "x" * 3000]


def encoded(texts, path=RANKS):
    out = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string()), 4096):
        ids, splits, *_ = bpe.encode_chunk(data, offsets, bpe.vocabulary(path), bpe.class_table())
        assert bpe.decode_chunk(ids, splits, bpe.vocabulary(path)) == [data.tobytes()[a:b] for a, b in zip(offsets, offsets[1:])]
        out += [ids[a:b].tolist() for a, b in zip(splits, splits[1:])]
    return out


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(RANKS).ranks, special_tokens={})


def test_odd_texts(library):
    assert encoded(ODD) == [library.encode_ordinary(x) for x in ODD]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("'srtevmdl  \n\t12.,aé中٣　"), st.characters(exclude_categories=("Cs",))), max_size=40), max_size=8))
def test_any_text(library, texts):
    assert encoded(texts) == [library.encode_ordinary(x) for x in texts]


def test_states_match_a_plain_walk():
    rng = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 20_000):
        symbols = rng.integers(0, 14, n)
        state, want = bpe.S_NONE, []
        for x in symbols.tolist():
            want.append(state)
            state = bpe._step(bpe.S_NONE if x >= bpe.FIRST else state, x % bpe.FIRST)
        assert bpe.states_before(symbols).tolist() == want


def test_long_and_short_merging_agree():
    vocab, rng = bpe.vocabulary(RANKS), random.Random(2)
    pieces = ["".join(rng.choice("abethr in'") for _ in range(rng.randrange(1, 60))).encode() for _ in range(400)]
    assert vocab.merge_all(pieces) == [vocab.merge_long(p) for p in pieces]


def docs(spark, rows, schema="doc_id long, text string, n_tokens string, ids int, shard string"):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], schema)


def test_op1_and_decode(spark, library, tmp_path):
    rows = [(i, x) for i, x in enumerate(ODD)] + [(5, ODD[5]), (None, "null id"), (99, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op1_bpe(spark, str(tmp_path)).collect() if r["doc_id"] is not None)
    want = []
    for i, x in rows:
        ids = library.encode_ordinary(x or "")
        if i is not None:
            want.append((False, i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()))
    assert got == sorted(want)
    again = bpe.decode(bpe.encode(docs(spark, rows), RANKS), RANKS).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in again) == sorted(x or "" for _, x in rows)
    assert bpe.encode(docs(spark, []), RANKS).count() == 0


def test_decompose():
    doc, start, length = packing.decompose(np.array([1, 7, 8, 21]), 8)
    assert list(zip(doc.tolist(), start.tolist(), length.tolist())) == [(0, 0, 1), (1, 0, 4), (1, 4, 2), (1, 6, 1), (2, 0, 8), (3, 0, 8), (3, 8, 8), (3, 16, 4), (3, 20, 1)]
    assert packing.decompose(np.array([2, 1]), 1)[2].tolist() == [1, 1, 1]


def test_op8(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate([*ODD, "word " * 5000])] + [(5, ODD[5]), (98, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(JSON)
    got = queries.op8_packing(spark, str(tmp_path)).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) and all(r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048 for r in got)
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, x in rows:
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]
        mine = sorted(set(pieces[i]))
        assert sum(p[1] for p in mine) == len(ids) and {p[3] for p in mine} == {len(ids)}
        for start, length, crc, _ in mine:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
    packing.write_buckets(packing.pack(docs(spark, rows), JSON, 64, keep=["doc_id"]), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("bucket <> length").count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, rows), JSON, 100)


def test_spans_are_decoded_by_offsets(spark):
    rng, rows = random.Random(9), []
    for i, x in enumerate([*ODD, None]):
        n = len((x or "").encode())
        a = rng.randrange(n + 1)
        rows += [(3 * i, x, a, rng.randrange(a, n + 1), "c"), (3 * i + 1, x, 0, n, "c"), (3 * i + 2, x, None, n, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, offsets string")
    got = {r["doc_id"]: r for r in bpe.decode_spans(bpe.encode(table, RANKS), RANKS, "a", "b").collect()}
    for i, x, a, b, _ in rows:
        raw = (x or "").encode()
        assert got[i]["decoded"] == (None if a is None else raw[a:b])
        pieces = [raw[s:e] for s, e in zip(got[i]["offsets"], [*got[i]["offsets"][1:], len(raw)])]
        assert [bpe.vocabulary(RANKS).ranks[p] for p in pieces] == got[i]["ids"]


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_round_trip(scheme):
    rng = np.random.default_rng(3)
    for predictor in (1, 2):
        for tile in (None, (16, 16)):
            for order in "<>":
                for planar in (1, 2):
                    for kind in (np.uint8, np.uint16, np.uint32):
                        pages = [rng.integers(0, 200, (37, 29, 3)).astype(kind), rng.integers(0, 3, (5, 70)).astype(kind)]
                        got = list(tiff.read_pages_of(tiff.write_file(pages, scheme, predictor, 8, tile, order, planar)))
                        assert (got[0].samples == pages[0]).all() and (got[1].samples[:, :, 0] == pages[1]).all()


def test_lzw_fixed_value():
    # The bytes of the format's description: codes 9 bits wide, most significant bit first, beginning with a clear code.
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_encode(raw) == packed and tiff.lzw_decode(packed, len(raw)) == raw
    assert tiff.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x80, 0x00, 0x01]), 11)[:10] == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4)


def plain_lzw(raw):
    """The format's decoding rules, one code at a time."""
    bits = "".join(f"{b:08b}" for b in raw)
    at, width, out, table, last = 0, 9, b"", [], None
    while True:
        code, at = int(bits[at : at + width], 2), at + width
        if code == 257:
            return out
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [None, None], 9, None
            continue
        piece = table[code] if code < len(table) else last + last[:1]
        if last is not None:
            table.append(last + piece[:1])
        out, last = out + piece, piece
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)


def test_lzw_of_all_widths():
    rng = random.Random(5)
    for n, kinds in ((0, 1), (1, 1), (300, 256), (700, 256), (3000, 256), (20_000, 256), (40_000, 4), (70_000, 1)):
        raw = bytes(rng.randrange(kinds) for _ in range(n))
        packed = tiff.lzw_encode(raw)
        assert plain_lzw(packed) == raw and tiff.lzw_decode(packed, n)[:n] == raw
        assert tiff.unpack_bits(tiff.pack_bits(raw), n) == raw
    # 17 different two-letter words: 9-bit codes up to entry 510, 10 bits from then on.
    first = [256, *range(255), 257]
    packed = tiff.lzw_encode(bytes(range(255)))
    bits = "".join(f"{c:09b}" if i < 255 else f"{c:010b}" for i, c in enumerate(first))
    assert packed == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_scheme_does_not_follow_from_length():
    seen = {}
    for n in (10, 100, 300, 2_000, 10_000):
        for k in range(150):
            page = next(tiff.read_pages_of(tiff.store_bytes(f"{k} ".encode() * (n // 2))))
            seen.setdefault(n, set()).add((page.compression, page.predictor, page.tiled))
    assert all(len(x) == 12 for x in seen.values())


def test_broken_files_raise_tiff_errors(spark):
    rng = random.Random(6)
    whole = [tiff.write_file([np.arange(640, dtype=np.uint8).reshape(10, 64)] * 2, scheme, 2, 4, tile) for scheme in (tiff.LZW, tiff.PACKBITS, tiff.DEFLATE, tiff.NONE) for tile in (None, (16, 16))]
    files = []
    for k in range(600):
        raw = bytearray(whole[k % len(whole)])
        for _ in range(rng.randrange(1, 4)):
            raw[rng.randrange(len(raw))] = rng.choice([0, 1, 255, rng.randrange(256)])
        files.append(bytes(raw[: rng.randrange(len(raw))] if k % 7 == 0 else raw))
    big = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 2**63 + 5)
    tags = [(256, 4, 1, 2**31), (257, 4, 1, 2**31), (258, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, 8)]
    huge = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    none = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 256, 4, 0, 0) + struct.pack("<I", 0)
    many = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 256, 4, 2**32 - 1, 0) + struct.pack("<I", 0)
    files += [big, huge, none, many]
    got = tiff.read_pages(spark.createDataFrame(list(enumerate(files)), "doc_id long, media binary").withColumn("error", F.lit("clash"))).collect()
    errors = {r["doc_id"]: r["error"] for r in got if r["error"]}
    assert {600, 601, 602, 603} <= set(errors) and len(errors) > 100
    assert tiff.read_pages(spark.createDataFrame([], "doc_id long, media binary")).count() == 0


def test_float_predictor():
    values = np.arange(12, dtype="<f4").reshape(3, 4) / 7
    grouped = values.astype(">f4").view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    coded = np.diff(grouped, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8)
    plain = tiff.write_file([values.view("<u4")], tiff.NONE, 1)
    body = bytearray(plain)
    body[8 : 8 + 48] = coded.tobytes()
    raw, at = bytes(body), plain.index(struct.pack("<HHI", 317, 3, 1))
    # The sample format tag takes the place of the planar one.
    raw = raw.replace(struct.pack("<HHII", 317, 3, 1, 1), struct.pack("<HHII", 317, 3, 1, 3)).replace(struct.pack("<HHII", 284, 3, 1, 1), struct.pack("<HHII", 339, 3, 1, 3))
    assert at and (list(tiff.read_pages_of(raw))[0].samples[:, :, 0] == values).all()


def test_op3_and_pages(spark, tmp_path):
    long = "long text " * 150_000
    rows = [(i, x) for i, x in enumerate([*ODD, long])] + [(5, ODD[5]), (98, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op3_tiff(spark, str(tmp_path)).collect():
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = tiff.store_bytes(raw)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
        steps = sum(abs(b - a) for i in range(0, len(payload), 64) for a, b in zip(payload[i : i + 63], payload[i + 1 : i + 64]))
        bins = ",".join(str(sum(32 * k <= x < 32 * k + 32 for x in payload)) for k in range(8))
        assert r["feature"] == f"n={len(payload)};sum={sum(payload)};squares={sum(x * x for x in payload)};steps={steps};bins={bins}"
        assert b"".join(page.samples.tobytes() for page in tiff.read_pages_of(media)) == payload
    want = {(i, k): hashlib.sha256(p.samples.tobytes()).hexdigest() for i, x in rows for k, p in enumerate(tiff.read_pages_of(tiff.store_bytes((x or "").encode())))}
    assert {(r["doc_id"], r["page"]): r["samples_sha256"] for r in queries.tiff_pages(spark, str(tmp_path)).collect()} == want
    assert tiff.store(docs(spark, [])).count() == 0
    files = tiff.store(docs(spark, rows), keep=["doc_id"]).select("doc_id", "media")
    broken = spark.createDataFrame([(1000, b"II*\0"), (1001, b""), (1002, None), (1003, tiff.write_file([np.zeros((4, 4), np.uint8)])[:-40])], "doc_id long, media binary")
    pages = tiff.read_pages(files.unionByName(broken)).collect()
    assert sorted(r["page"] for r in pages if r["doc_id"] == len(ODD)) == [0, 1]
    assert {r["doc_id"] for r in pages if r["error"]} == {1000, 1003}


def jump(key, shards):
    shard, nxt = 0, 0
    while nxt < shards:
        shard = nxt
        key = (key * 2862933555777941757 + 1) % 2**64
        nxt = int((shard + 1) * (2.0**31 / ((key >> 33) + 1)))
    return shard


@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=30), st.integers(1, 40))
def test_jump_hash(keys, shards):
    got = sharding.jump_hash(np.array(keys), shards)
    assert got.tolist() == [jump(k % 2**64, shards) for k in keys]
    grown = sharding.jump_hash(np.array(keys), shards + 1)
    assert all(a == b or b == shards for a, b in zip(got, grown))


def test_op4(spark, tmp_path):
    rows = [(i, f"text {i % 7} é") for i in range(400)] + [(7, None)] * 150 + [(None, "x")]
    docs(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] == jump(r["doc_id"] or 0, 9) and r["law"] == "key"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == sorted((i if i is not None else -1, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x in rows)
    assert sharding.assign(docs(spark, [])).count() == 0
    by_key = {}
    for r in got:
        by_key.setdefault(r["shard"], []).append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    assert all([k for _, k in sorted(x)] == sorted(k for _, k in x) for x in by_key.values())
    named = spark.createDataFrame([("a",), ("b",), (None,), ("a",), ("c" * 5000,)], "doc_id string").withColumn("text", F.lit("x"))
    found = sharding.assign(named, 5).collect()
    assert len({r["shard"] for r in found if r["doc_id"] == "a"}) == 1 and {r["shard"] for r in found if r["doc_id"] is None} == {jump(0, 5)}


def test_json_ranks_are_those_of_the_rank_file():
    assert bpe.vocabulary(JSON).ranks == bpe.vocabulary(RANKS).ranks
    assert len(json.load(open(JSON, encoding="utf-8"))["model"]["merges"]) == len(bpe.vocabulary(JSON).pairs)
