import random
import re

import pytest

from canopyspark.llm import jaccard


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids else doc_id))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    return sorted(map(tuple, jaccard.similar_groups(frame).collect()), key=str)


def corpus():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: draw.choices(words, k=n)
    rows = [" ".join(text(draw.randint(1, 80))) for _ in range(60)]
    for size, edits in ((120, 40), (60, 30), (200, 60)):  # chains of copies of copies, some near the threshold
        base = text(size)
        for _ in range(edits):
            base = list(base) if draw.random() < 0.4 else base
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            if draw.random() < 0.3:
                base = copy
            rows.append(" ".join(copy))
    passage = text(60)  # shared by texts that are not alike
    rows += [" ".join([*passage, *text(draw.randint(8, 30))]) for _ in range(40)]
    rows += ["Same Text here"] * 5 + ["same text here"] * 3 + ["a b c d e f"] * 4
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    rows = corpus()
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 60


def test_few_hubs_still_finds_all(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HUBS", 2)
    rows = corpus()
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "one"), (None, "one"), (None, "two"), (None, "two"), (7, "x " * 60000), (6, "x " * 50000), (8, "ONÉ"), (9, "oné")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_stage_keeps_one_of_each_group(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (9, None, "z"), (None, "a b c d e f g", "n")], "doc_id long, text string, source string")
    kept = jaccard.near_copy_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 9, None]


def test_stage_tells_rows_of_one_id_apart(spark):
    a, b = "a b c d e f g", "other words that nobody else has here at all"
    docs = spark.createDataFrame([(2, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (7, b, 5), (8, "", 6), (8, "", 7)], "doc_id long, text string, row_key int")
    kept = jaccard.near_copy_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, a), (5, b), (8, "")]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 100])
def test_prefix_length(n):
    assert jaccard.prefix_length(n) == n - -(-8 * n // 10) + 1


def test_later_rounds_take_the_sets_of_open_lists_only(spark, monkeypatch):
    pieces = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(8)]
    rows = [(i, f"{pieces[i]} {pieces[(i + 1) % 8]}") for i in range(8)]  # alike in parts, linked with nothing
    copies = " ".join(f"w{j}" for j in range(40))
    rows += [(100 + i, f"{copies} end{i // 2}") for i in range(6)]
    seen, own = [], jaccard._overlaps

    def noted(pairs, sets):
        seen.append(sets.count())
        return own(pairs, sets)

    monkeypatch.setattr(jaccard, "_overlaps", noted)
    found = {r.doc_id: r.component_id for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: i for i in range(8)} | {100 + i: 100 for i in range(6)}
    assert len(seen) > 1 and seen[1] < seen[0]
