import random
import re

import numpy as np
import xxhash
from canopyspark.llm import simhash
from canopyspark.llm.queries import QUERIES


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    """Label of each place: the smallest place reachable by links, over all pairs."""
    prints = np.array(prints, np.uint64)
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits) + i + 1:
            a, b = root(i), root(int(j))
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    found = components(prints)
    ids = {}
    for (i, _), c in zip(rows, found, strict=True):
        ids.setdefault(c, []).extend([] if i is None else [i])
    return sorted(((i, f"{p:016x}", min(ids[c], default=None)) for (i, _), p, c in zip(rows, prints, found, strict=True)), key=str)


def run(spark, rows, more=""):
    return sorted((tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string" + more)).collect()), key=str)


def test_fingerprints(monkeypatch):
    draw = random.Random(1)
    texts = [None, "", " \n", "One", "one TWO", "Ä b c", "a b c d"] + [" ".join(draw.choice("ab cD éE".split()) for _ in range(n)) for n in (3, 4, 50, 500)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 100)
    long = " ".join(str(draw.randrange(1000)) for _ in range(3 * simhash.CHUNK + 7))
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def test_edges_of_clusters_and_split_nodes(spark):
    draw = random.Random(2)
    prints = {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1, 3, 2**63}
    for centre in [draw.getrandbits(64) for _ in range(12)]:
        for _ in range(60):
            prints.add(centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(4))}))
    hot = draw.getrandbits(64)  # below one node in two orders, many links
    prints |= {hot ^ (draw.getrandbits(9) << 50) for _ in range(300)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    distinct = spark.createDataFrame(signed, "fingerprint long")
    want = components(prints)
    assert len(set(want)) < len(prints)
    for node_rows, group_rows in ((50_000, 200_000), (20, 100)):
        edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.linked(distinct, node_rows=node_rows, group_rows=group_rows).collect()]
        at = {p: i for i, p in enumerate(prints)}
        label = simhash.Forest(len(prints))
        label.add(np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
        assert label.label.tolist() == want
        assert all(sum((x ^ y).bit_count() <= 2 for y in prints) > 1 for x, _ in edges)


def test_near_copies_and_odd_rows(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):
        text = draw.choices(words, k=300)
        for k in range(draw.randrange(1, 5)):
            copy = list(text)
            for _ in range(k):
                copy[draw.randrange(300)] = "new"
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(5000 - k, None) for k in range(3)] + [(6000, ""), (None, "lone text here"), (None, rows[0][1]), (7000, "lone text here"), (7000, "lone text here"), (1, rows[4][1])]
    draw.shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({r[2] for r in want}) < len({r[0] for r in want})
    assert run(spark, [(*r, 1, 2, "x") for r in rows], ", fingerprint int, a int, component string") == want
    assert run(spark, []) == []


def test_query_on_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_simhash"](spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == brute(docs)
