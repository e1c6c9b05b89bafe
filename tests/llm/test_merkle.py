import hashlib
import random
import zlib

import duckdb
import pytest
from canopyspark.llm import merkle
from canopyspark.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def reduce(nodes, own):
    """The last node, and the siblings before and after own level by level."""
    path = []
    while len(nodes) > 1:
        run = own - own % 8
        path.append(("".join(nodes[run:own]), "".join(nodes[own + 1 : run + 8])))
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        own //= 8
    return nodes[0], path


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: sorted(groups[g], key=lambda x: x[:3]) for g in order}
    subs = [reduce([x[2] for x in own[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for i, (_, _, own_leaf, row) in enumerate(own[g]):
            sub, path = reduce([x[2] for x in own[g]], i)
            root, above = reduce(subs, k)
            path += above
            now = own_leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                now = leaf((*row[:4], row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            for before, after in path:
                now = sha(before + now + after)
            out.append((row[0], own_leaf, sub, root, sha("".join(b + a for b, a in path)), now, now == root))
    return sorted(out, key=str)


def run(spark, rows, more="", **options):
    return sorted((tuple(r) for r in merkle.verified(spark.createDataFrame(rows, SCHEMA + more), **options).collect()), key=str)


def made(n, langs, seed=1):
    draw = random.Random(seed)
    return [(i * 7 % 100003, draw.choice([None, "", "src"]), draw.choice(langs), draw.choice([None, i]), draw.choice([None, "", "Über Ä", "Text %d" % i, "lower"])) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(700, [None, "", "de", "en", "én"]), (1, ["x"]), (8, ["x"]), (9, [None]), (65, ["a", "b"])])
def test_against_brute_force(spark, n, langs):
    rows = made(n, langs)
    assert run(spark, rows) == brute(rows)


def test_all_routes_of_large_tables(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    rows = made(600, ["a", None, *[f"g{k}" for k in range(40)]])  # 42 groups: numbered as leaves themselves
    assert run(spark, rows, top_nodes=5) == brute(rows)
    assert run(spark, rows, top_nodes=100) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "a", "", 2, "X" * 200_000), (1, "a", "", 2, "y"), (1, "a", "", 2, "y"), (5, "-", "-", 1, "1:a"), (None, "s", "", 0, "Z")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(*r, 1, "x", "y", 3) for r in rows], ", pos int, grp string, root string, block int") == brute(rows)
    assert run(spark, []) == []


def test_tampering_is_seen(spark):
    rows = [(i, "s", "en", 5, "Hello" if i % 2 else "hello") for i in range(100)]
    for r in run(spark, rows):
        assert r[6] is not (zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[0] % 2 == 1)


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    frame = QUERIES["op12_merkle"](spark, d)
    want = sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op12_merkle']})").fetchall(), key=str)
    assert sorted((tuple(r) for r in frame.collect()), key=str) == want
