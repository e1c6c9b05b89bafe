import re
from collections import Counter

from pyspark.sql import functions as F

from canopyspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return (n, sum(map(len, words)), sum(c in quality.SYMBOLS for c in text), dup, r, n < 10 or 100 * r > 20 * n)


TEXTS = [None, "", "   \n\t ", "one two", "a b c d e " * 4, "x\nx\n\nx \nx", "ü " * 12, "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 0 aa bb cc dd ee ff gg",
         "# $ <b>|& *% " * 3, "w" * 100000, " ".join(f"w{i % 997}" for i in range(30000)), "p q r s t u v w x y z\r\np q r s t\x0b1 2 3 4 5"]


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 1), (3, "one two", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, words int")
    got = quality.base_columns(frame, F.col("text"), "doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text and r.text[:50]


def test_ratio_keeps_prose_and_drops_marks(spark):
    prose = [f"the quiet river number {i} runs past old stone houses and green fields toward the sea" for i in range(60)]
    junk = [f"the### quiet$$$ river%%% num{i}*** runs### past$$$ old%%% stone*** houses### and$$$ green%%%" for i in range(60)]
    docs = spark.createDataFrame([*enumerate(prose + junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    kept = {r.doc_id for r in quality.judge(docs, model).collect() if r.kept}
    assert kept == set(range(60))
    again = quality.fit(docs, labels)
    assert (again.threshold, again.ratio) == (model.threshold, model.ratio)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.judge(docs, quality.fit(docs, labels)).collect()] == [True]
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_cut():
    inf = float("inf")
    assert quality.cut([(-2.0, False), (-1.0, False), (1.0, True), (2.0, True)]) == 0.0
    assert quality.cut([(1.0, True), (2.0, True)]) == -inf
    assert quality.cut([]) == -inf
