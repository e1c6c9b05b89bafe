import hashlib
import random

import numpy as np
import pytest

from canopyspark.llm import suffixdedup as S


def brute(rows):
    seen, out = {}, []
    order = sorted((d, S.tie_of((t or "").encode()), i) for i, (d, t) in enumerate(rows) if d is not None)
    marks = {}
    for d, tie, i in order:
        data = (rows[i][1] or "").encode()
        flags = [False] * len(data)
        for at in range(len(data) - S.WINDOW + 1):
            w = data[at : at + S.WINDOW]
            if seen.setdefault(w, (d, tie, at)) < (d, tie, at):
                flags[at : at + S.WINDOW] = [True] * S.WINDOW
        marks[i] = flags
    for i, (d, t) in enumerate(rows):
        data = (t or "").encode()
        flags = marks.get(i, [False] * len(data))
        spans = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        kept = bytes(b for b, f in zip(data, flags, strict=True) if not f)
        out.append((d, len(data), sum(flags), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string").repartition(3)
    found = S.dedup_substrings(docs)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found.collect()), key=str)


def sample(seed, n):
    draw = random.Random(seed)
    word = lambda: draw.choice(["stone", "río", "house", "日本", "quiet", "a", "b"])
    passages = [" ".join(word() for _ in range(draw.randint(15, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [draw.choice(passages) if draw.random() < 0.5 else " ".join(word() for _ in range(draw.randint(1, 50))) for _ in range(draw.randint(1, 5))]
        rows.append((i, " ".join(parts)))
    return rows


def test_against_brute_force(spark):
    rows = sample(3, 60)
    got = run(spark, rows)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("hot", [150, 400, 1500])
def test_hot_keys_have_the_same_result(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_BYTES", hot)  # buckets, a second sort of what they leave, windows by hash
    rows = sample(4, 40)
    assert run(spark, rows) == brute(rows)


def test_many_copies_are_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_BYTES", 3000)
    text = sample(5, 1)[0][1] + " and then one passage that all of these documents share, word by word, from here to its end"
    rows = [(i, f"{i} {text}") for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog while thirteen wizards quietly mix seven jugs of very old liquor "
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "ab" * 9000), (5, "a" * 12000), (6, text + "é"), (None, text), (3, "x" + text), (7, "ab" * 60)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_lone_texts_of_short_period(spark):
    draw = random.Random(12)
    text = lambda n: "".join(draw.choices("abcdefgh", k=n))
    rows = [(1, "ab " * 100), (2, text(300) + "-" * 150 + text(200)), (3, text(85) * 3), (4, text(86) * 3), (5, text(90) + "Sich " * 60 + text(500)), (6, text(600)), (7, text(84) * 2 + text(300))]
    for row in rows:  # alone: no other document has its keys
        assert run(spark, [row]) == brute([row])
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1])[0][2] == 297  # all but the first period


def test_suffix_order_is_sorted():
    draw = random.Random(1)
    for alphabet in (2, 4, 200):
        strings = [bytes(draw.randrange(1, alphabet + 1) for _ in range(draw.randint(100, 400))) for _ in range(6)]
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        order = S.suffix_order(text)
        assert sorted(order.tolist()) == list(range(len(text)))
        # strings end at 0; up to there, WINDOW bytes are in order
        heads = [bytes(text[i : i + S.WINDOW]).split(b"\0")[0] for i in order]
        assert heads == sorted(heads)


def test_suffix_order_of_some_suffixes():
    draw = random.Random(2)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(100, 300))) for _ in range(6)] + [b"b" * 150, b"a" * 150]
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    starts = np.concatenate([np.arange(len(s) + 1) <= len(s) - S.WINDOW for s in strings])
    order = S.suffix_order(text, starts)
    order = order[starts[order]]
    assert sorted(order.tolist()) == np.flatnonzero(starts).tolist()
    heads = [bytes(text[i : i + S.WINDOW]) for i in order]
    assert heads == sorted(heads)


def test_rows_dealt_by_key_are_done_before_the_pieces_are_sorted(spark, monkeypatch):
    plans, own = {}, S.written

    def noted(df, prefix):
        plans[prefix] = df._jdf.queryExecution().executedPlan().toString()
        return own(df, prefix)

    monkeypatch.setattr(S, "written", noted)
    text = " ".join(f"w{i}" for i in range(60))
    found = S.dedup_substrings(spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 0, 2: len(text)}
    assert "_context_rows" not in plans["suffix-sorted"]
