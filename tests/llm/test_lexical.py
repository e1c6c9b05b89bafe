import math
import random
import re
from collections import Counter

import duckdb
import pytest
from canopyspark.llm import lexical
from canopyspark.llm.queries import ORACLES, QUERIES


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, top=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    many, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = set(plain_terms(text))
        rows = []
        for i, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * many // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                rows.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


def run(spark, items, docs, more="", extra=(), **options):
    found = lexical.search(spark.createDataFrame([(*i, *extra) for i in items], "item_id long, text string" + more), spark.createDataFrame([(*d, *extra) for d in docs], "doc_id long, text string" + more), **options)
    rows = found.collect()
    return sorted((tuple(r)[:4] for r in rows), key=str), {r.tier for r in rows}


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(600)] + ["Über", "naïve", "x1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, weights, k=draw.randrange(1, 120)))) for i in range(n)]
    items = [(k, " ".join(draw.choices(words, weights, k=12))) for k in range(25)]
    for k in range(5):
        docs[k * 11] = (k * 11, docs[k * 11][1] + ", " + items[k][1].upper())
    return items, docs


@pytest.mark.parametrize("tiers", [lexical.TIERS, (1 / 50, 1 / 20, 1 / 3, 1.0), (1.0,)])
def test_against_brute_force(spark, tiers):
    items, docs = corpus(3000, 1)
    found, deepest = run(spark, items, docs, shares=tiers)
    assert found == brute(items, docs)
    assert len(tiers) == 1 or min(deepest) < len(tiers)


def test_rare_terms_are_proven_in_the_first_tier_and_blocks_agree(spark):
    items, docs = corpus(2000, 2)
    docs += [(10_000 + k, f"unique{k % 2} " * 3 + "w1 w2") for k in range(24)]
    items += [(900 + k, f"unique{k} Unique{k}") for k in range(2)]
    want = brute(items, docs)
    assert run(spark, items, docs)[0] == want
    assert run(spark, items, docs, block_pairs=20)[0] == want
    assert run(spark, items[-2:], docs)[1] == {1}


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!? \n"), (4, "a b"), (4, "a b"), (5, "A-B a"), (None, "a b"), (6, "c " * 50_000 + "zz"), (7, "ü a")] + [(20 + k, "a b") for k in range(30)]
    items = [(1, "a"), (1, "a"), (2, None), (3, "..."), (None, "b ZZ"), (4, "unknown"), (5, "c zz"), (6, "Ü A")]
    want = brute(items, docs)
    assert run(spark, items, docs)[0] == want
    assert run(spark, items, docs, ", score int, id string, terms int", (1, "x", 2))[0] == want
    assert run(spark, [], docs)[0] == run(spark, items, [])[0] == run(spark, [], [])[0] == []


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    frame = QUERIES["op13_lexical"](spark, d)
    want = sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES['op13_lexical']})").fetchall())
    assert sorted(tuple(r) for r in frame.collect()) == want
    assert want
