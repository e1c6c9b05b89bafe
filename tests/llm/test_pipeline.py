import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from canopyspark.llm import mixing
from canopyspark.llm.bpe import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    draw = random.Random(5)
    words = [f"{a}{b}{c}" for a in ("sto", "riv", "hou", "gre") for b in ("ne", "er", "se", "en") for c in ("", "ly", "ed", "ing")]
    line = lambda: " ".join(draw.choices(words, k=draw.randint(8, 14)))
    shared = line()
    rows = [(i, "\n".join([line() for _ in range(draw.randint(2, 4))] + ([shared] if i % 3 == 0 else [])), "en", "abc"[i % 3]) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail", "en", "b") for i in range(4)]  # all lines but the last are copies
    rows += [(200, None, None, "a"), (201, "123 456 !!!", None, "c"), (202, "", "en", None)]
    return [(*r, len(r[1] or "")) for r in rows]


def without_lines(rows):
    """One edit of a word or less from an earlier line, by all pairs."""
    kept, seen = [], []
    for doc_id, text, *rest in sorted(rows):
        lines = []
        for x in text.split("\n"):
            w = x.split()
            far = len(w) < 5 or all(edits(w, v) > 1 for v in seen)
            if far:
                lines.append(x)
            if len(w) >= 5:
                seen.append(w)
        kept.append((doc_id, "\n".join(lines), *rest))
    return kept


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
    a, b = a[head:], b[head:]
    return 0 if not a and not b else 1 if a[1:] == b[1:] or a[1:] == b or a == b[1:] else 2


def one_of_each_group(rows):
    def grams(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = {r[0]: grams(r[1]) for r in rows}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    out = []
    texts = {r[0]: r[1] for r in rows}
    for doc_id, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall():
        out += [(doc_id, texts[doc_id])] * (taken // size if size else 0)
        if size and taken % size:
            out.append((doc_id, " ".join(texts[doc_id].split()[: taken % size])))
    return out


def test_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    clean = [r for r in rows if r[1] and re.search("[A-Za-z]", r[1])]
    kept = one_of_each_group(without_lines(clean))
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    want = []
    for doc_id, text in mixed(kept):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert len(kept) < len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(*r, 1, "x") for r in corpus()], SCHEMA + ", cut int, row_key string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
