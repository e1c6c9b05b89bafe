import duckdb

from canopyspark.llm import mixing


def run(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in mixing.op6_mixing(spark, str(folder)).select("doc_id", "size", "source_size", "target", "taken").orderBy("doc_id").collect()]


def test_targets_and_bounds(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), ["a", "b", "c", None][i % 4] if i % 3 else "a") for i in range(300)]
    got = run(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE}) ORDER BY doc_id").fetchall()
    assert [(*r[:3], round(r[3], 6), r[4]) for r in got] == [(*r[:3], round(r[3], 6), r[4]) for r in wanted]
    sources = {}
    for d, size, _, target, taken in got:
        assert 0 <= taken <= 3 * size
        s = sources.setdefault(rows[d][2], [target, 0])
        s[1] += taken
    for target, taken in sources.values():
        assert abs(target - taken) <= 1


def test_odd_rows(spark, tmp_path):
    got = run(spark, tmp_path / "odd", [(1, None, None), (2, "", "a"), (3, "one two", "a"), (4, "x " * 50000, "b")])
    assert [r[1] for r in got] == [0, 0, 2, 50000] and got[0][4] == 0
    assert run(spark, tmp_path / "none", []) == []


def test_reruns_agree_with_ties_and_clashing_names(spark):
    texts = ["one two three", "one two three four", "five", None, "six seven"]
    rows = [(None, texts[i % 5], "ab"[i % 2], i) for i in range(40)] + [(7, t, "a", 1) for t in texts] * 2 + [(i, "x y z", "c", 2) for i in range(50)]
    schema = "doc_id long, text string, source string, cut int"
    found = []
    for parts in (1, 3, 7):
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        mixed = mixing.mixed_documents(docs)
        assert mixed.columns == docs.columns
        plan = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
        found.append((plan, sorted((str(r.doc_id), str(r.text)) for r in mixed.collect())))
    assert found[0] == found[1] == found[2]


def test_mixed_rows_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(1 + i % 9)), "abc"[i % 3]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    words = dict.fromkeys(taken, 0)
    for r in mixing.mixed_documents(docs).collect():
        assert rows[r.doc_id][1].startswith(r.text)
        words[r.doc_id] += len(r.text.split())
    assert words == taken
