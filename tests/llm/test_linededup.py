import random
import re

from canopyspark.llm import linededup


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if max(len(a), len(b)) > 200:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near(a, b):
    if a == b or distance(a.split(" "), b.split(" ")) <= 1:
        return True
    u, v = re.split("(?<=[.!?]) ", a), re.split("(?<=[.!?]) ", b)
    for i in range(max(len(u), len(v))):  # one sentence of a tenth of its line at most
        small = [i < len(x) and 10 * len(x[i]) <= len(line) for x, line in ((u, a), (v, b))]
        if small == [True, True] and u[:i] + u[i + 1 :] == v[:i] + v[i + 1 :]:
            return True
        if small[0] and u[:i] + u[i + 1 :] == v or small[1] and v[:i] + v[i + 1 :] == u:
            return True
    return False


def brute(rows):
    """All pairs of lines of all rows; rows are told apart by doc_id and text, in the order of run()."""
    lines = []
    for row in sorted({r for r in rows if r[0] is not None and r[1] is not None}, key=lambda r: (r[0], r[2])):
        for n, line in enumerate(row[1].split("\n")):
            plain = re.sub(r"[\x20\x09-\x0D]+", " ", line.lower()).strip(" ")
            if plain.count(" ") >= 4:
                lines.append((row, n, plain))
    gone = {(row, n) for k, (row, n, line) in enumerate(lines) if any(near(line, other) for _, _, other in lines[:k])}
    return sorted([(r[0], r[1] if r[1] is None else "\n".join(l for n, l in enumerate(r[1].split("\n")) if (r, n) not in gone)) for r in rows], key=str)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, removed string").repartition(3)
    ties = [r.tie for r in spark.createDataFrame([(t,) for _, t in rows], "text string").selectExpr("xxhash64(text) AS tie").collect()] if rows else []
    out = linededup.line_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == brute([(*r, t) for r, t in zip(rows, ties, strict=True)])
    return got


def edited(draw, line, words, edits):
    line = line.split(" ")
    for _ in range(edits):
        at = draw.randrange(len(line) + 1)
        new = [draw.choice(words)] if draw.random() < 0.6 else []
        line[at : at + draw.randint(0, 1)] = new
    return " ".join(line)


def test_against_brute_force(spark):
    draw = random.Random(7)
    words = ["Stone", "river", "house.", "green", "quiet", "field", "north!", "seven", "paper", "light", "über", "año"]
    pool = [" ".join(draw.choices(words, k=draw.choice([4, 5, 5, 6, 7, 8, 10, 13, 20, 60]))) for _ in range(30)]
    rows = [(i, "\n".join(edited(draw, draw.choice(pool), words, draw.choice([0, 1, 1, 2])) for _ in range(draw.randint(0, 5)))) for i in range(110)]
    got = run(spark, rows)
    assert sum(len(t) for _, t in got) < 0.8 * sum(len(t) for _, t in rows)


def test_whole_sentences(spark):
    draw = random.Random(3)
    words = "stone river house green quiet field north seven paper light".split()
    sentence = lambda k: " ".join(draw.choices(words, k=k)).capitalize() + draw.choice(".!?")
    pool = [[sentence(draw.randint(2, 5)) for _ in range(draw.choice([1, 2, 3, 12, 14, 20]))] for _ in range(12)]
    rows = []
    for i in range(70):
        line = list(draw.choice(pool))
        at = draw.randrange(len(line) + 1)
        line[at : at + draw.randint(0, 1)] = [sentence(draw.randint(2, 5))] if draw.random() < 0.6 else []
        rows.append((i, " ".join(line)))
    assert sum(t == "" for _, t in run(spark, rows)) > 10


def test_template_lines_are_one_group(spark):
    rows = [(i, f"This is page {i} of the long report") for i in range(300)] + [(1000, "This is page of the long report")]
    got = run(spark, rows)
    assert [r for r in got if r[1]] == [rows[0]]


def test_odd_rows(spark):
    line = "One two three four five. Six seven eight. Nine ten."
    long = "Alpha beta gamma delta epsilon. " * 300
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, f"{line}\n{line}\nshort\nshort"), (None, line), (5, "one  TWO three four five. six seven eight. nine  ten."), (6, long), (7, long + "x"), (8, "\n\n")]
    got = run(spark, rows)
    assert (4, "short\nshort") in got and (None, line) in got and (7, "") in got
    assert run(spark, []) == []


def test_rows_that_share_a_doc_id_keep_their_own_lines(spark):
    line, other = "one two three four five six", "nothing that any other row has in it"
    rows = [(1, line), (5, line + "\nkeep this line here for me"), (5, other + "\nmore words of that row only")]
    assert (5, other + "\nmore words of that row only") in run(spark, rows)


def test_very_long_line(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w777 ", "")), (3, long.replace("w20000 ", "other ")), (4, long.replace("w5 ", "").replace("w6 ", ""))], "doc_id long, text string")
    got = {r.doc_id: len(r.text) for r in linededup.line_stage(spark, docs, "").collect()}
    assert got[1] == len(long) and got[2] == got[3] == 0 and got[4] > 0


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    plan = linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
