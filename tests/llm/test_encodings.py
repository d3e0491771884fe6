"""Simple-8b files and byte-pair encoding: exact round trips and the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from peakloom.llm import bpe, token_files

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "it's  we'll\n\n x", "É\u0301 cafe\u0301 Σίσυφος ΟΔΟΣ", "\x1c\x85\u200b\u00a0\u3000x", "½²Ⅷ 12345",
       "日本語 한국어 \U0001f600\U0001f468\u200d\U0001f469", "x" * 3000, "ab" * 700 + " " + "é" * 500, "_a_ __ don't DON'T 'S",
       "a<|endoftext|>b<|startoftext|>", "<|endoftext|>", "İstanbul ẞ ŉ", "\ufffd\u0378\u0e01\u0905", "\t\r\n a \v\f"]


@given(st.text(st.sampled_from("ab, .\n\t '\u3000\u00a0s1"), max_size=30))
@settings(max_examples=400, deadline=None)
def test_white_space_runs_equal_library(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=60)))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(lists):
    payloads = token_files.encode([np.array(x, dtype=np.uint64) for x in lists])
    assert [x.tolist() for x in token_files.decode(payloads)] == lists


def test_blocks_escapes_and_density():
    draw = random.Random(5)
    lists = [[draw.randrange(2 ** draw.randrange(1, 64)) for _ in range(n)] for n in (0, 1, 511, 512, 513, 5000)]
    lists.append([2**64 - 1] * 700)
    assert [x.tolist() for x in token_files.decode(token_files.encode([np.array(x, np.uint64) for x in lists]))] == lists
    ones = token_files.encode([np.ones(512, np.uint64)])[0]
    assert len(ones) == 8 + 4 + 8 * 10  # 8 words of 60 IDs, one of 30 and one of 2
    assert token_files.encode([]) == [] and token_files.decode([]) == []


def test_tokenizer_equals_library():
    library, own = Tokenizer.from_file(BYTE), token_files.Tokenizer(BYTE)
    for text in ODD:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_tokenizer_equals_library_on_any_text(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


OWN, LIBRARY = token_files.Tokenizer(BYTE), Tokenizer.from_file(BYTE)
CODER, WORD_LIBRARY = bpe.WordBpe(WORD), Tokenizer.from_file(WORD)


@pytest.mark.parametrize("text", ODD)
def test_word_bpe_equals_library(text):
    ids = WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.encode(text).tolist() == ids
    assert CODER.decode(ids) == WORD_LIBRARY.decode(ids, skip_special_tokens=False)


@given(st.text(st.characters(max_codepoint=0x17F) | st.sampled_from("αΣςж中ก\u0301  \u2028'"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_word_bpe_equals_library_on_many_texts(text):
    assert CODER.encode(text).tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_heap_and_scan_agree():
    draw = random.Random(2)
    for _ in range(50):
        word = "".join(draw.choice("theinorstaé") for _ in range(draw.randrange(1, 120))).encode()
        parts = [*map(CODER.inner.__getitem__, word[:-1]), CODER.final[word[-1]]]
        assert CODER.merge_long(parts) == CODER.merge(word)


def test_word_cache_stays_bounded():
    from peakloom.llm.common import WordCache

    seen = []
    cache = WordCache(lambda w: seen.append(w) or w * 2, size=10)
    assert [cache[i % 25] for i in range(200)] == [(i % 25) * 2 for i in range(200)]
    assert len(cache) <= 10 and len(cache.old) <= 10


def test_token_files(spark, tmp_path):
    rows = [(5, "five five"), (2, None), (9, ""), (2, "two"), (None, "none"), (7, "x" * 200_000), (5, "five five")]
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id int, text string, part string, start int")
    token_files.write_token_files(docs, f"{tmp_path}/t", BYTE)
    read = token_files.read_token_files(spark, f"{tmp_path}/t").withColumn("ids", token_files.token_ids(F.col("payload")))
    found = read.withColumn("crc", token_files.ids_crc32(F.col("ids"))).orderBy("start").collect()
    want = [LIBRARY.encode(t or "", add_special_tokens=False).ids + [0]
            for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert [r.ids for r in found] == want
    assert [r.doc_id for r in found] == [None, 2, 2, 5, 5, 7, 9]
    assert [r.start for r in found] == [sum(map(len, want[:i])) for i in range(7)]
    assert [r.crc for r in found] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    digests = read.select("start", token_files.payload_digest(F.col("payload")).alias("d")).orderBy("start").collect()
    assert [tuple(r.d) for r in digests] == [(len(r.ids), r.crc) for r in found]
    token_files.write_token_files(docs.limit(0), f"{tmp_path}/none", BYTE)
    assert token_files.read_token_files(spark, f"{tmp_path}/none").collect() == []


def test_bpe_columns(spark):
    docs = spark.createDataFrame([(None,), ("",), ("Hello  world",), ("Hello  world",)], "text string")
    coded = docs.select(bpe.bpe_encode(F.col("text"), WORD).alias("ids"))
    rows = coded.withColumn("back", bpe.bpe_decode(F.col("ids"), WORD)).collect()
    assert [r.back for r in rows] == ["", "", "hello</w> world</w>", "hello</w> world</w>"] and rows[0].ids == []
    assert coded.limit(0).collect() == []
    lists = spark.createDataFrame([([320, None, 10**6, -1, 320],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in lists.select(bpe.bpe_decode(F.col("ids"), WORD)).collect()] == ["a</w> a</w>", "", ""]
