import hashlib
import os
import random
import struct
import sys

import public_tokenizers
import pytest
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from helpers import SF01, frame, texts_of  # noqa: E402
from thawline.llm import byte_bpe, registry  # noqa: E402

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", None, "hello world", "  two  blanks \n\n end ", "it's we'll I'VE 'sort", "naïve café 中文字符 \U0001f600\U0001f600", "\x1c\x1d a\x85b\x1f c",
         "١٢٣ 123 ½", "a" * 300, "!!!!????====", "\r\n\r\n a\t\tb   ", "Supercalifragilistic" * 40, "中文" * 400, " ", "\n", "<|endoftext|>",
         "\xa0\xa0x   y", "hello world", "é ‍ ﻿", " " * 5000, "-" * 3000]


def ids_of(r):
    return list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))


@pytest.mark.parametrize("hot_words,at_once", [(byte_bpe.HOT_WORDS, byte_bpe.WORDS_AT_ONCE), (0, 7), (3, 50)])
def test_encoding_is_the_library_s_and_decodes_to_the_text(spark, hot_words, at_once):
    texts = TEXTS + TEXTS[2:6]
    got = byte_bpe.encode(frame(spark, texts), RANKS, hot_words=hot_words, at_once=at_once).collect()
    assert len(got) == len(texts)
    for r in got:
        assert ids_of(r) == LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()


def test_decode_by_higher_order_functions(spark):
    docs = byte_bpe.encode(frame(spark, TEXTS), RANKS).select("doc_id", "ids")
    for r in byte_bpe.decode(docs, RANKS).collect():
        assert bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode()


def test_folds_agree_on_distinct_words(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeinrst éß中") for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["the", "xyz" * 60]
    docs = spark.createDataFrame([(w,) for w in words], "word string")
    vocabulary = byte_bpe.Vocabulary(RANKS)
    native = {r.word: r.ids for r in docs.select("word", byte_bpe._let(vocabulary.tables, lambda v: vocabulary.merged(v, byte_bpe.F.col("word"))).alias("ids")).collect()}
    folder = byte_bpe.Folder(RANKS, {})
    for w in words:
        want = LIBRARY._encode_single_piece(w.encode())
        assert native[w] == want == folder.fold(w.encode()) == folder._with_heap([folder.start[b] for b in w.encode()])


def test_repeated_rows_null_ids_and_empty_table(spark):
    got = byte_bpe.report(byte_bpe.encode(frame(spark, ["a b", "a b", "c"], [4, 4, None]), RANKS)).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in got) == [(False, 2), (False, 2), (True, 1)]
    assert byte_bpe.encode(frame(spark, []), RANKS).count() == 0


def test_table(spark):
    texts = texts_of(spark, SF01)
    for r in registry.op9_byte_bpe(spark, SF01).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
