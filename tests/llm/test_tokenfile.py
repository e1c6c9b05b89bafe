import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canopyspark.llm import tokenfile
from canopyspark.llm.bpe import TOKENIZER


def back(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = tokenfile.pack(ids)
    return tokenfile.unpack(words, offsets, len(ids)).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_round_trip(ids):
    assert back(ids) == ids


def test_density_and_blocks():
    assert len(tokenfile.pack(np.zeros(1020, np.uint64))[0]) == 17
    assert back([50256] * 5000 + [2**60] * 3 + [0] * 2000) == [50256] * 5000 + [2**60] * 3 + [0] * 2000


def test_file_against_library(spark, tmp_path):
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    texts = {5: "one two", 1: None, 9: "", 3: "x<|endoftext|>y", 7: "long text " * 9000, 2: "ünï çödé 漢字"}
    rows = [*texts.items(), (5, "one two"), (2**60, "big id")]
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "t"), partitions=3)
    got = sorted(map(tuple, tokenfile.read_tokens(spark, str(tmp_path / "t")).collect()))
    start, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table_and_null_id(spark, tmp_path):
    schema = "doc_id long, text string, start int"
    tokenfile.write_tokens(spark.createDataFrame([], schema), str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).count() == 0
    tokenfile.write_tokens(spark.createDataFrame([(None, "a", 1), (0, "b", 2)], schema), str(tmp_path / "n"))
    assert [r["doc_id"] for r in tokenfile.read_tokens(spark, str(tmp_path / "n")).orderBy("start").collect()] == [None, 0]
