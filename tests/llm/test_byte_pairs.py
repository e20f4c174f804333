"""Byte-level BPE by tree joins, against the public encoder and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from studyweave.llm import byte_pairs, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pairs():
    return byte_pairs.Pairs(byte_pairs.read_ranks(RANKS))


@pytest.fixture(scope="module")
def public(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def texts(seed, n=300):
    rng = random.Random(seed)
    alphabets = ["ab", "aab ", "theing", "abcdefghijklmnopqrstuvwxyz", "=-_*#", "0123456789", "éüñç日本語한", "😀👍🏽", " \n\t\r  ", "'sretvmld", "aA1 .,'\n\x00\x85"]
    out = ["".join(rng.choice(some) for _ in range(rng.choice([1, 3, 9, 40, 150, 700]))) for some in rng.choices(alphabets, k=n)]
    return [*out, "", " ", "�", "a" * 5000, "ab" * 3000, "<|endoftext|>", "it's we'll I'D 'tis", "x" * 3001 + " " * 3001]


def test_tree_gives_the_public_encoders_ids(pairs, public):
    for text in texts(1):
        some = [piece for part in byte_pairs.parted(regex.compile(public_tokenizers.PATTERN), text) for piece in part]
        ids = [k for piece in some for k in pairs.piece(piece.encode())]
        assert ids == public.encode_ordinary(text)
        assert pairs.decoded(np.array(ids, np.int32)) == text.encode()


def test_joins_at_any_place_give_the_same_ids(pairs):
    rng = random.Random(2)
    for some in (b"a", b"ab", b"the ", b"ing=", b"\xe6\x97\xa5\xf0\x9f", bytes(range(256))):
        for _ in range(25):
            data = bytes(rng.choice(some) for _ in range(rng.randint(2, 160)))
            whole = pairs.merged(data)
            cuts = sorted(rng.sample(range(len(data) + 1), 2))
            a, b, c = (pairs.merged(data[i:j]) for i, j in zip([0, *cuts], [*cuts, len(data)], strict=True))
            assert pairs.join(pairs.join(a, b), c) == pairs.join(a, pairs.join(b, c)) == whole


def test_a_row_whose_neighbours_stay_apart_is_the_encoding(pairs):
    rng = random.Random(3)
    words = sorted(pairs.ranks, key=pairs.ranks.get)[:400]
    for _ in range(3000):
        ids = [pairs.ranks[rng.choice(words)] for _ in range(rng.randint(2, 4))]
        together = pairs.merged(b"".join(pairs.words[k] for k in ids))
        assert (together == ids) == all(pairs.apart(a, b) for a, b in zip(ids, ids[1:], strict=False))


def test_short_and_long_merges_agree(pairs):
    rng = random.Random(7)
    for some in (b"ab", b"theing ", b"=-", bytes(range(256))):
        for _ in range(100):
            data = bytes(rng.choice(some) for _ in range(rng.randint(1, 60)))
            assert pairs.short(data) == pairs.encoded(data) == pairs.merged(data)


def test_blanks_part_texts_without_a_change(pairs, public, monkeypatch):
    known = byte_pairs.Cached(pairs, regex.compile(public_tokenizers.PATTERN), most=50)
    spaces = [" a  b", "a \nb ", "  ", "\t x\x1c y\x85 z\u3000 w", "it's 's  've ' ll", " 1 2  3", "a\x1f b", "\u200b c", "so, it. is; the! end? x, 1, ª, ß: 日本, ,, , . a", "naïve, e\u0301, \u0903, ٣,"]
    for size in (byte_pairs.SLICE, 20):
        monkeypatch.setattr(byte_pairs.stretches, "__defaults__", (size,))
        some = [*spaces, *texts(8), *spaces]
        assert known.lists(some).to_pylist() == [public.encode_ordinary(text) for text in some]
        assert known.lists([]).to_pylist() == [] and known.lists(["", "", "a"]).to_pylist() == [[], [], [64]]
    assert len(known) <= 50 and len(known.bare) <= 50


@pytest.mark.parametrize("size", [4, 7, 64])
def test_slices_part_a_text_as_one(size):
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in texts(4, 120):
        assert [m for part in byte_pairs.parted(pattern, text, size) for m in part] == pattern.findall(text)


def test_long_pieces_take_time_in_proportion(pairs, public):
    rng = random.Random(5)
    for text in ("a" * 300_001, "".join(rng.choice("ab") for _ in range(200_000)), "日本語" * 40_000):
        ids = pairs.piece(text.encode())
        assert pairs.decoded(np.array(ids, np.int32)) == text.encode()
        assert ids == public.encode_ordinary(text)


def test_columns_nulls_and_repeated_rows(spark, public):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (None, None, 6), (2, "", 7)]
    given = spark.createDataFrame(rows, "doc_id long, text string, `IDS` int").withColumnRenamed("IDS", "Ids")
    encoded = byte_pairs.encode(given.withColumn("Decoded", given.doc_id), RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "Decoded", "ids"]
    out = byte_pairs.decode(encoded, RANKS)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    found = sorted(((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in out.collect()), key=str)
    hello = (1, public.encode_ordinary("Hello  world"), b"Hello  world")
    assert found == sorted([hello, hello, (0, [], b""), (2, [], b"")], key=str)
    assert byte_pairs.encode(given.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    odd = spark.createDataFrame([(None,), ([None],), ([1 << 30],), ([],)], "ids array<int>")
    assert [r.decoded for r in byte_pairs.decode(odd, RANKS).collect()] == [None, None, None, b""]


def test_bytes_that_are_no_text(spark, public):
    given = spark.sql("select cast(unhex('61FF62') as string) as text")
    assert byte_pairs.encode(given, RANKS, public_tokenizers.PATTERN).first().ids == public.encode_ordinary("a�b")


def test_query_over_the_whole_table(spark, public):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in queries.op11_tree_byte_pairs(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for row in rows:
        ids, got = public.encode_ordinary(row.text or ""), found[row.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
