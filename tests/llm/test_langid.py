import random
import zlib
from collections import Counter, defaultdict

from canopyspark.llm import langid

WORDS = {
    "en": "the house and river with green stones over their quiet fields when many people walked home",
    "es": "la casa y el río con piedras verdes sobre los campos tranquilos cuando muchas personas caminaban",
    "de": "das haus und der fluss mit grünen steinen über ihre stillen felder wenn viele menschen nach hause gingen",
}


def test_held_out_accuracy(spark, tmp_path):
    draw = random.Random(11)
    rows = []
    for i in range(240):
        lang = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choices(WORDS[lang].split(), k=draw.randint(8, 60))), lang, "s"))
    rows += [(900, None, "en", "s"), (901, "123 456 !", "en", "s"), (902, "", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op1_langid(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    held = [(got[d].lang_pred, lang) for d, _, lang, _ in rows if got[d].held_out and d < 900]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(got[d].lang_pred == "und" for d in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())


def grams(text):
    """The 4-byte grams of a lower-cased text of letters and single spaces, by the module's rule, one by one."""
    data = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in f" {text.lower()} ".encode())
    found = [data[i : i + 4] for i in range(len(data) - 3)]
    return [g for g in found if b"  " not in g]


def brute(rows):
    """Languages of the grams by exact sets, no filters: a gram belongs to all languages with half its best rate or more."""
    docs, seen = Counter(), defaultdict(Counter)
    for doc_id, text, lang, _ in rows:
        if zlib.crc32(str(doc_id).encode()) % 4 != 2 and text is not None and lang is not None:
            docs[lang] += 1
            seen[lang].update(set(grams(text)))
    rate = {l: {g: n / docs[l] for g, n in c.items() if n >= 3} for l, c in seen.items()}
    best = {}
    for r in rate.values():
        for g, x in r.items():
            best[g] = max(best.get(g, 0), x)
    member = {l: {g for g, x in r.items() if x >= 0.5 * best[g]} for l, r in rate.items()}
    out = {}
    for doc_id, text, _, _ in rows:
        own = grams(text or "")
        share = {l: sum(g in m for g in own) / max(1, len(own)) for l, m in member.items()}
        out[doc_id] = max(sorted(share), key=share.get), share
    return out


def test_against_exact_sets(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for i in range(200):
        lang = draw.choice(list(WORDS))
        other = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choices(WORDS[lang].split(), k=draw.randint(5, 40)) + draw.choices(WORDS[other].split(), k=3)), lang, "s"))
    rows.append((300, " ".join(WORDS["es"].split() * 4000), "es", "s"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in langid.op1_langid(spark, str(tmp_path)).collect()}
    for doc_id, (lang, share) in brute(rows).items():
        assert abs(got[doc_id].score - share[lang]) < 0.02
        assert got[doc_id].lang_pred == lang or share[lang] - share[got[doc_id].lang_pred] < 0.02


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, score double, held_out int"
    rows = [(None, "the house and river", "en", "s", 1.0, 2), (1, "the house and river", None, None, None, None), (1, "the house and river", None, None, None, None), (2, "", "de", "s", 0.5, 1), (3, None, None, None, None, 3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = langid.op1_langid(spark, f"{tmp_path}/a").collect()
    assert len(got) == 5 and sum(r.lang_pred == "und" for r in got) == 2
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert langid.op1_langid(spark, f"{tmp_path}/b").count() == 0
