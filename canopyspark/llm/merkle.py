"""Merkle manifest of a table: a hash tree per group of rows, a tree over the groups, a proof for every row.

Rows are leaves, in order of an id within their group. While several nodes remain, every FANOUT consecutive
ones become the hash of their concatenation; a group's last node is its subroot, and the subroots,
by group name, are the leaves of the tree whose last node is the root.

Rows are numbered by a range partitioning and the counts of its parts, so no group is one task. Blocks of
FANOUT ** BLOCK_LEVELS consecutive leaves are reduced by Spark, each to its node. While more than TOP_NODES nodes are left,
they are numbered into blocks and reduced again; if that leaves one node for each of very many groups, these
become the leaves of the tree over groups. At most TOP_NODES nodes then reach the driver, which builds the top of the
tree and sends back the paths from these nodes to the root: a table of at most TOP_NODES rows, each with FANOUT - 1
hashes of 64 digits for each of the few levels left (15 MB for 4096 nodes and 8 levels). Executors finish each row's path
with it. Everything but the top is DataFrame functions.

Defined results: null fields are marked, so that null and empty differ; null groups come first; null ids come first
in their group, equal ids by leaf; repeated rows are leaves of their own; an empty table has no rows and no root. Columns that are no fields do not matter.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyspark.llm.common import table, written

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
BLOCK_LEVELS = 4
TOP_NODES = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Fixed by the contract: what tampering does to a text.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<before: string, after: string>"


def leaf(*fields: Column) -> Column:
    """Hash of the fields: each - if null, else its number of bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf gives with its path."""
    return F.aggregate(path, start, lambda own, s: F.sha2(F.concat(s["before"], own, s["after"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (grp and more) with pos, the place in the group from 0, and n, the group's size; order tells all rows apart."""
    keys = ["grp", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "merkle-ordered")
    parts = dealt.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("many").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("grp", "part", "first", before.alias("before"), F.sum("many").over(whole).alias("n"))
    return dealt.join(parts, ["grp", "part"]).select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n")


def blocks(nodes: DataFrame, *carry: str) -> DataFrame:
    """Nodes (grp, pos, n, digest, carry) as blocks: grp, block, height, left (nodes that remain in the group), rows, levels (its nodes by level, the last is one)."""
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.ceil(F.length(F.bin(F.col("n") - 1)) / FANOUT_BITS))
    height = F.least(F.lit(BLOCK_LEVELS), depth).cast("int")
    dealt = nodes.withColumn("height", height).withColumn("block", F.expr(f"shiftright(pos, {FANOUT_BITS} * height)"))
    made = dealt.groupBy("grp", "block").agg(F.first("height").alias("height"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", *carry))).alias("rows"))
    run = f"transform(sequence(0, (size(element_at(acc, -1)) - 1) div {FANOUT}), i -> sha2(array_join(slice(element_at(acc, -1), i * {FANOUT} + 1, {FANOUT}), ''), 256))"
    levels = F.expr(f"aggregate(slice(sequence(1, {BLOCK_LEVELS}), 1, height), array(transform(rows, x -> x.digest)), (acc, k) -> concat(acc, array({run})))")
    left = F.expr(f"((n - 1) div shiftleft(1L, {FANOUT_BITS} * height)) + 1").alias("left")
    return written(made.select("grp", "block", "height", left, F.transform("rows", lambda x: x.dropFields("digest")).alias("rows"), levels.alias("levels")), "merkle-blocks")


def _paths(found: DataFrame) -> DataFrame:
    """Each row of the blocks: grp, block, pos, digest, path to the block's node, and what its rows carry."""
    place, bits, last = "shiftright(i, {b} * k)", FANOUT_BITS, FANOUT - 1
    p = place.format(b=bits)
    step = f"named_struct('before', array_join(slice(level, {p} - ({p} & {last}) + 1, {p} & {last}), ''), 'after', array_join(slice(level, {p} + 2, {last} - ({p} & {last})), ''))"
    row = F.expr(f"transform(rows, (x, i) -> named_struct('row', x, 'digest', levels[0][i], 'path', transform(slice(levels, 1, height), (level, k) -> {step})))")
    return found.select("grp", "block", F.inline(row)).select("grp", "block", "row.*", "digest", "path")


def _climb(digests: list[str]) -> tuple[list[list[tuple[str, str]]], str | None]:
    """Each node's path to the last one, and that one."""
    import hashlib

    levels = [digests]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([hashlib.sha256("".join(low[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(low), FANOUT)])

    def path(i: int) -> list[tuple[str, str]]:
        out = []
        for level in levels[:-1]:
            run = i - i % FANOUT
            out.append(("".join(level[run:i]), "".join(level[i + 1 : run + FANOUT])))
            i //= FANOUT
        return out

    return [path(i) for i in range(len(digests))], levels[-1][0] if digests else None


def _top(nodes: list) -> tuple[list[tuple], str | None]:
    """grp, pos, suffix and subroot of every node left (sorted by group and place), and the root; TOP_NODES nodes at most."""
    groups = [(g, [r.digest for r in rows]) for g, rows in groupby(nodes, key=lambda r: r.grp)]
    own = [_climb(d) for _, d in groups]
    above, root = _climb([sub for _, sub in own])
    return [(g, pos, path + above[k], own[k][1]) for k, (g, _) in enumerate(groups) for pos, path in enumerate(own[k][0])], root


def manifest(rows: DataFrame, *carry: str, top_nodes: int = TOP_NODES) -> DataFrame:
    """rows (grp, id, tie, digest, carry) with leaf, subroot, root and path: the siblings before and after, level by level.

    grp is a string, ordered bytewise; tie tells repeated rows apart.
    """
    spark = rows.sparkSession
    first = now = blocks(numbered(rows, "id", "digest", "tie"), "id", *carry)
    steps, merged = [], False
    while True:
        nodes = now.select("grp", F.col("block").alias("pos"), F.col("left").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
        few = nodes.limit(top_nodes + 1).collect()
        if len(few) <= top_nodes:
            break
        if not merged and nodes.where("n > 1").isEmpty():
            # a node for each group: they are the leaves of the tree over groups
            over = numbered(nodes.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "name")
            now, merged = blocks(over, "name"), True
            path = _paths(now)
            steps.append(path.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("grp").alias("up"), "block", "path", F.col("digest").alias("own")))
        else:
            now = blocks(nodes)
            steps.append(_paths(now).select("grp", "pos", F.col("grp").alias("up"), "block", "path", F.lit(None).cast("string").alias("own")))
    top, root = _top(sorted(few, key=lambda r: (r.grp.encode(), r.pos)))
    suffix = spark.createDataFrame(top, f"grp string, pos long, suffix array<{_STEP}>, subroot string")
    if not steps:
        suffix = F.broadcast(suffix)  # top_nodes rows at most
    for step in reversed(steps):
        above = suffix.select(F.col("grp").alias("up"), F.col("pos").alias("block"), "suffix", "subroot")
        suffix = step.join(above, ["up", "block"]).select("grp", "pos", F.concat("path", "suffix").alias("suffix"), F.coalesce("own", "subroot").alias("subroot"))
    above = suffix.select("grp", F.col("pos").alias("block"), "suffix", "subroot")
    whole = _paths(first.join(above, ["grp", "block"]).withColumn("rows", F.expr("transform(rows, x -> named_struct('x', x, 'suffix', suffix, 'subroot', subroot))")))
    kept = whole.select("x.*", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.concat("path", "suffix").alias("path"))
    return kept.drop("pos")


def documents_manifest(docs: DataFrame, tampered: Column, group: str = "lang", id: str = "doc_id", fields=FIELDS, text: str = "text", top_nodes: int = TOP_NODES) -> DataFrame:
    """id, leaf, subroot, root, path of every row, and tampered_leaf, its hash with A-Z of the text in lower case, where tampered is true."""
    other = leaf(*[F.translate(F.col(f), UPPER, LOWER) if f == text else F.col(f) for f in fields])
    name = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("."), F.col(group)))
    leaves = docs.select(name.alias("grp"), F.col(id).alias("id"), F.monotonically_increasing_id().alias("tie"), leaf(*[F.col(f) for f in fields]).alias("digest"), F.when(tampered, other).alias("tampered_leaf"))
    return manifest(written(leaves, "merkle-leaves"), "tampered_leaf", top_nodes=top_nodes)


def verified(docs: DataFrame, top_nodes: int = TOP_NODES) -> DataFrame:
    """The manifest of documents, and for each row the root that its leaf gives, of tampered text where crc32 of the id is divisible by 3."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = documents_manifest(docs, tampered, top_nodes=top_nodes)
    rows = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.coalesce("tampered_leaf", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir):
    return verified(table(spark, sf_dir, "documents"))


#: Seven levels within a language and three above: enough for 2 million documents a language and 512 languages.
_LEVELS, _TOP_LEVELS = 7, 3


def _climb_sql(name: str, by: str, start: str, levels: int) -> str:
    """CTEs name0 .. (by, p, h): the nodes by level; a group with one node stays as it is."""
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(f"{name}{k + 1} AS (SELECT {by}, p // 8 AS p, CASE WHEN max(many) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE max(h) END AS h, (max(many) + 7) // 8 AS many FROM {name}{k} GROUP BY {by}, p // 8)")
    return ",\n".join(out)


def _siblings_sql(name: str, by: str, levels: int) -> str:
    return ",\n".join(f"{name}s{k} AS (SELECT {by}, p, many, coalesce(string_agg(h, '' ORDER BY p) OVER (PARTITION BY {by}, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '' ORDER BY p) OVER (PARTITION BY {by}, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})" for k in range(levels))


def _oracle() -> str:
    fields = [f"coalesce(octet_length(encode({f}::VARCHAR)) || ':' || {f}::VARCHAR, '-')" for f in FIELDS]
    other = [f.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')") for f in fields]
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {step}), 4294967295)"
    joins, proof, fold = "", [], "start"
    for name, levels in (("t", _LEVELS), ("u", _TOP_LEVELS)):
        for k in range(levels):
            key = f"{name}s{k}"
            on = f"{key}.g = d.g AND {key}.p = d.p // {8**k}" if name == "t" else f"{key}.p = d.gp // {8**k}"
            joins += f"\nJOIN {key} ON {on}"
            proof.append(f"{key}.b || {key}.a")
    folds, last = "", "start"
    for i, name in enumerate([f"ts{k}" for k in range(_LEVELS)] + [f"us{k}" for k in range(_TOP_LEVELS)]):
        folds += f",\nf{i + 1} AS (SELECT *, CASE WHEN {name}m > 1 THEN sha256({name}b || {last} || {name}a) ELSE {last} END AS x{i + 1} FROM f{i})"
        last = f"x{i + 1}"
    columns = ", ".join(f"{n}.b AS {n}b, {n}.a AS {n}a, {n}.many AS {n}m" for n in [f"ts{k}" for k in range(_LEVELS)] + [f"us{k}" for k in range(_TOP_LEVELS)])
    return f"""
WITH l AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '.' || lang END AS g, sha256({' || '.join(fields)}) AS h,
  CASE WHEN {crc} % 3 = 0 THEN sha256({' || '.join(other)}) END AS th FROM documents),
d0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, h) - 1 AS p, count(*) OVER (PARTITION BY g) AS many FROM l),
{_climb_sql('t', 'g', 'SELECT g, p, h, many FROM d0', _LEVELS)},
q AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS gp FROM t{_LEVELS}),
{_climb_sql('u', 'one', 'SELECT 1 AS one, gp AS p, h, count(*) OVER () AS many FROM q', _TOP_LEVELS)},
{_siblings_sql('t', 'g', _LEVELS)},
{_siblings_sql('u', 'one', _TOP_LEVELS)},
d AS (SELECT d0.*, q.h AS subroot, q.gp FROM d0 JOIN q ON q.g = d0.g),
f0 AS (SELECT d.doc_id, d.h AS leaf, d.subroot, (SELECT h FROM u{_TOP_LEVELS}) AS root, coalesce(d.th, d.h) AS start, sha256({' || '.join(proof)}) AS proof_sha256, {columns} FROM d{joins}){folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, {last} AS folded_root, {last} = root AS verified FROM f{_LEVELS + _TOP_LEVELS}
"""


ORACLE = _oracle()
