import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from canopyspark.llm import bpe

PATH = public_tokenizers.path(bpe.TOKENIZER)
VOCAB = bpe.Vocabulary(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def check(texts):
    flat, counts = bpe.bpe_encoder(VOCAB).encode(texts)
    ids, at = flat.tolist(), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert ids[at : at + n] == want, text
        at += n
    assert bpe.decode(VOCAB, flat, counts) == [LIBRARY.decode(LIBRARY.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for t in texts]


def test_fixed_texts():
    check(["", None, " ", "a", "aaaa aaaaa", "  two  spaces ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "tab\t\tnew\n\nline\x1c\x85 end", "it's we'LL 'tis", "naïve Übermaß ñandú 漢字 🙂🙂 é", "1234 ½ ٣ !!! ...", "###", "<|endoftext|", "日本語テキスト"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])), max_size=6))
def test_any_text(texts):
    check(texts)


def test_words_by_chance():
    draw = random.Random(3)
    check([" ".join("".join(draw.choices("aeioutnsrhäß é", k=draw.randint(1, 14))) for _ in range(300)) for _ in range(20)])


def test_query_handles_odd_rows(spark):
    rows = [(1, "a b"), (None, "x"), (2, None), (3, ""), (1, "a b"), (4, "word " * 50000)]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0
    assert by[4]["n_tokens"] == len(LIBRARY.encode("word " * 50000).ids)
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string, n_tokens int")).count() == 0
