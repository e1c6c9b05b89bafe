"""Near-duplicate line removal by deletion neighbourhoods within one edit, with DataFrame functions only.

A line is lower-cased and its white space is collapsed. The edit bound: a line is near an earlier one if
it is equal to it or becomes equal by one edit, which puts in, leaves out or replaces one piece. Pieces
are single words, and whole sentences of at most a tenth of their line's characters, so that the bound
grows with the line.

Every variant within the bound is a hashed key: the line with a hole at piece i (replaced), the line
without piece i (left out), and the line with a gap before piece i, which meets the longer line without
its piece i (put in). All lines of a hole key are one edit from each other, and all lines of a gap key
are one edit from all lines that leave a piece out there. So the earliest line of a key decides for the
whole key, by an aggregate with map-side combine: no pairs are listed, and no partner is missed. The
edit is then verified on the two lines' pieces. Earlier means a smaller doc_id, then a smaller hash of
the text, then a smaller line number. The earlier line may itself be removed for a still earlier one.

Equal lines are found first, by a 128-bit hash; from there on each different line is one row. Two lines
one edit apart share their first or their last half of pieces, so a line of which no half occurs in
another line of its length, or of one piece more or less, has no partner and makes no variants. Joins
are by shuffle whatever the size, so that small inputs run the plan of large ones.

Defined results: lines of fewer than MIN_WORDS words are never removed and remove nothing; null
text stays null; a row with a null doc_id stays as it is and takes no part; rows that repeat a
doc_id with other text are rows of their own; rows that repeat doc_id and text are one place and do not
outrank each other; a text that loses all lines becomes empty; empty tables stay so. Variants are
written to the shared folder when dedup_lines is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import discard, table, tokens, written

MIN_WORDS = 5
MAX_SENTENCE_SHARE = 10
UNITS = ("words", "sentences")
SIDES = ("first", "last")
KINDS = ("replace", "gap", "without")
PLACE = ("doc_id", "tie", "line_no")


def plain_line(line: Column) -> Column:
    return F.array_join(tokens(F.lower(line)), " ")


def sentences(plain: Column) -> Column:
    return F.split(plain, " (?<=[.!?] )")


def pieces(plain: Column, unit: str) -> Column:
    return F.split(plain, " ") if unit == "words" else sentences(plain)


def removable(sentence_chars: Column, chars: Column) -> Column:
    """Whether the edit bound lets a sentence of so many characters go from a line of so many."""
    return MAX_SENTENCE_SHARE * sentence_chars <= chars


def half(shorter: Column) -> Column:
    """Pieces that lines of so many pieces, or one more, share at one end at least if they are one edit apart."""
    return F.greatest(F.lit(1), F.floor(shorter / 2).cast("int"))


def flag(unit: int, kind: str, side: str) -> int:
    return 1 << (unit * 6 + KINDS.index(kind) * 2 + SIDES.index(side))


def half_keys(array: Column, unit: str, some_removable: Column) -> list[Column]:
    """Keys of the halves of a line's pieces: as a line of n pieces, first and last, and as the longer of two lines."""

    def key(side: str, shorter: Column) -> Column:
        at = F.lit(1) if side == "first" else F.greatest(F.lit(1), F.size(array) - half(shorter) + 1)
        return F.xxhash64(F.lit(unit + side), shorter, F.slice(array, at, half(shorter)))

    longer = (F.size(array) > 1) & some_removable
    return [key(s, F.size(array)) for s in SIDES] + [F.when(longer, key(s, F.size(array) - 1)) for s in SIDES]


def texts_of(docs: DataFrame) -> DataFrame:
    known = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def different_lines(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines as written rows of hashes, and the earliest place and half keys of each different one."""
    lines = texts.select("doc_id", "tie", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.select(*PLACE, tokens(F.lower("line")).alias("w"))
    lines = lines.select(*PLACE, "w", F.array_join("w", " ").alias("line")).select("*", sentences(F.col("line")).alias("s"))
    short = removable(F.array_min(F.transform("s", lambda x: F.length(x))), F.length("line"))
    keys = F.array(*half_keys(F.col("w"), "words", F.lit(True)), *half_keys(F.col("s"), "sentences", short))
    rows = lines.select(*PLACE, F.size("w").alias("n"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), keys.alias("keys"))
    # short lines go after the write: a filter on n before it would cut each line twice
    hashed = written(rows, "line-hashes").where(F.col("n") >= MIN_WORDS).drop("n")
    # equal lines have equal keys
    return hashed, hashed.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE, "keys")).alias("at"), F.count("*").alias("many")).select("h1", "h2", "at.*", "many")


def possible_edits(different: DataFrame) -> DataFrame:
    """id, place and flags of the lines that share a half with a line of fitting length; ids rise with places."""
    halves = different.select(*PLACE, F.posexplode("keys").alias("code", "key")).where("key IS NOT NULL")
    longer = F.col("code").bitwiseAND(2) > 0
    shared = halves.groupBy("key").agg(F.count_if(~longer).alias("same"), F.count_if(longer).alias("longer"))
    shared = written(shared.where("same > 1 OR same > 0 AND longer > 0"), "line-halves")
    met = halves.join(shared.hint("merge"), "key")

    flags = F.lit(0)
    for u in range(len(UNITS)):
        for s, side in enumerate(SIDES):
            as_equal = F.when(F.col("same") > 1, flag(u, "replace", side)).otherwise(0) + F.when(F.col("longer") > 0, flag(u, "gap", side)).otherwise(0)
            flags = F.when(F.col("code") == u * 4 + s, as_equal).when(F.col("code") == u * 4 + 2 + s, flag(u, "without", side)).otherwise(flags)
    per_line = met.groupBy(*PLACE).agg(F.bit_or(flags).alias("flags"))
    return per_line.orderBy(*PLACE).select(F.monotonically_increasing_id().alias("id"), *PLACE, "flags")


def variants(lines: DataFrame) -> DataFrame:
    """key, unit, kind, at (the piece's place) and the line's id, for all edits that flags allow.

    A piece's hash holds its place, counted from the start before the edit and from the end behind it;
    running exclusive ors of them give each variant's key in one step.
    """
    # sizes are taken before the line is cut, so that no piece carries its line
    cuts = F.array(*[F.struct(F.lit(u).alias("unit"), pieces(F.col("line"), unit).alias("pieces")) for u, unit in enumerate(UNITS)])
    wanted = F.filter(cuts, lambda c: F.col("flags").bitwiseAND(F.when(c["unit"] == 0, 63).otherwise(63 << 6)) > 0)
    cut = lines.select("id", "uid", "flags", F.length("line").alias("chars"), F.explode(wanted).alias("c"))
    cut = cut.select("id", "uid", F.when(F.col("c.unit") == 0, F.col("flags")).otherwise(F.shiftright("flags", 6)).alias("flags"), "chars", "c.unit", F.size("c.pieces").alias("n"), "c.pieces")
    rows = cut.select("id", "uid", "flags", "chars", "unit", "n", F.posexplode("pieces").alias("i", "piece"))
    i, n = F.col("i"), F.col("n")
    free = (F.col("unit") == 0) | removable(F.length("piece"), F.col("chars"))
    rows = rows.select("id", "uid", "flags", "unit", "n", "i", free.alias("free"), F.xxhash64("piece", "i").alias("f"), F.xxhash64("piece", n - i).alias("b"))
    whole = Window.partitionBy("uid", "unit")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("head", F.coalesce(F.bit_xor("f").over(before), F.lit(0))).withColumn("tail", F.bit_xor("b").over(whole).bitwiseXOR(F.coalesce(F.bit_xor("b").over(before), F.lit(0))))
    rows = rows.withColumn("total", F.bit_xor("f").over(whole))
    h, longer_h = half(n), half(n - 1)
    here = {(k, s): F.col("flags").bitwiseAND(flag(0, k, s)) > 0 for k in KINDS for s in SIDES}

    def variant(kind: str, code: Column, at: Column, length: Column, where: Column) -> Column:
        key = F.xxhash64(F.lit("replace" if kind == "replace" else "gap"), "unit", code, at, length)
        return F.when(where, F.struct(key.alias("key"), F.lit(kind).alias("kind"), at.alias("at")))

    made = F.array(
        variant("replace", F.col("total").bitwiseXOR(F.col("f")), i, n, F.col("free") & (here["replace", "first"] & (i >= h) | here["replace", "last"] & (i < n - h))),
        variant("without", F.col("head").bitwiseXOR(F.col("tail").bitwiseXOR(F.col("b"))), i, n - 1, F.col("free") & (here["without", "first"] & (i >= longer_h) | here["without", "last"] & (i < n - longer_h))),
        variant("gap", F.col("head").bitwiseXOR(F.col("tail")), i, n, here["gap", "first"] & (i >= h) | here["gap", "last"] & (i <= n - h)),
        variant("gap", F.col("total"), n, n, (i == n - 1) & here["gap", "first"]),
    )
    return rows.select("id", "unit", F.explode(F.filter(made, lambda v: v.isNotNull())).alias("v")).select("v.*", "unit", "id")


def earliest_partners(found: DataFrame) -> DataFrame:
    """id, other (an earlier line one edit away), unit, kind and at, for every line that has one."""
    firsts = [F.min(F.when(F.col("kind") == k, F.col("id"))).alias(k) for k in KINDS]
    keys = written(found.groupBy("key").agg(F.count("*").alias("many"), *firsts).where("many > 1").drop("many"), "line-keys")
    other = F.when(F.col("kind") == "replace", F.col("replace")).when(F.col("kind") == "gap", F.col("without")).otherwise(F.col("gap"))
    met = found.join(keys, "key").select("id", other.alias("other"), "unit", "kind", "at").where("other < id")
    return met.groupBy("id").agg(F.min(F.struct("other", "unit", "kind", "at")).alias("e")).select("id", "e.*")


def verified(partners: DataFrame, lines: DataFrame) -> DataFrame:
    """The ids whose line is one edit, of the kind found, from the partner's."""
    text = lines.select("id", "line")
    both = partners.join(text, "id").join(text.select(F.col("id").alias("other"), F.col("line").alias("first_line")), "other")
    w, v, at, rest = F.col("w"), F.col("v"), F.col("at"), F.lit(2**31 - 1)
    cut = [F.when(F.col("unit") == 0, pieces(F.col(c), UNITS[0])).otherwise(pieces(F.col(c), UNITS[1])) for c in ("line", "first_line")]
    both = both.select("id", "kind", "at", cut[0].alias("w"), cut[1].alias("v"))
    mine = at + F.when(F.col("kind") == "gap", 1).otherwise(2)
    other = at + F.when(F.col("kind") == "without", 1).otherwise(2)
    same = (F.slice(w, F.lit(1), at) == F.slice(v, F.lit(1), at)) & (F.slice(w, mine, rest) == F.slice(v, other, rest))
    return both.where(same).select("id")


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tie (the text's hash) and the ascending numbers (from 0) of its lines that have an earlier near copy."""
    texts = texts_of(docs)
    hashed, different = different_lines(texts)
    different = written(different, "line-different")
    copied = different.where("many > 1").select("h1", "h2", F.struct(*PLACE).alias("first_at"))
    equal = hashed.drop("keys").join(copied.hint("merge"), ["h1", "h2"]).where(F.struct(*PLACE) > F.col("first_at")).select(*PLACE)

    asked = written(possible_edits(different), "line-asked")
    split = F.split("text", "\n")
    lists = asked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("line_no", "flags", "id")).alias("lines"))
    taken = F.transform("lines", lambda x: F.struct(x["id"].alias("id"), x["flags"].alias("flags"), F.get(split, x["line_no"]).alias("line")))
    lines = texts.join(lists.hint("merge"), ["doc_id", "tie"]).select(F.explode(taken).alias("l"))
    # rows that repeat doc_id and text share ids; uid tells their lines apart
    lines = written(lines.select("l.id", "l.flags", F.monotonically_increasing_id().alias("uid"), plain_line(F.col("l.line")).alias("line")), "line-texts")
    found = written(variants(lines), "line-variants")
    near = verified(earliest_partners(found), lines).join(asked, "id").select(*PLACE)
    gone = equal.unionByName(near)
    out = written(gone.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "line-removed")
    discard(hashed, different, asked, lines, found)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs without removed lines, and the columns n_lines and n_removed in front of theirs."""
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), "doc_id", F.xxhash64("text").alias("tie"))
    marked = keyed.join(removed_lines(docs).hint("merge"), ["doc_id", "tie"], "left")
    split = F.split("row.text", "\n")
    kept = F.array_join(F.filter(split, lambda l, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    counts = [F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed")]
    marked = marked.select(*counts, "row", text.alias("new_text"))
    new = {"text": F.col("new_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("new_text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in columns else None}
    return marked.select("n_lines", "n_removed", F.struct(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns]).alias("row"))


def op4_linededup(spark, sf_dir):
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))


def line_stage(spark, docs, sf_dir):
    """docs with near-duplicate lines removed; every document stays, n_chars follows its text."""
    return dedup_lines(docs).select("row.*")
