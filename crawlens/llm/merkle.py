"""A Merkle manifest of a data set, and a proof for every one of its rows.

Every row is a leaf; the leaves of a key form a tree of two children a node, the trees' roots form another one. Trees
are built a block at a time: 256 consecutive nodes, eight levels, one small group. What is stored is a row for each
node at the foot of a block: its hash, the siblings on its way to the block's top, and its parent, the top's own row.

Proofs are climbed by a recursive query: it starts at every leaf's row and follows the parents, appends their siblings
and folds the leaf's hash (or that of a changed leaf) with them, up to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlens.llm.common import query, table
from crawlens.scale import cut, ranked, spread_lookup

LEVELS = 8
BLOCK = 1 << LEVELS
#: The tree of the trees' roots.
TOP = 0


def framed(value: Column) -> Column:
    """A value for hashing: its UTF-8 byte count, ``:`` and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    """SHA-256 of the framed values, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(framed, values)), 256))


def climb_block(hashes: list[bytes], levels: int) -> tuple[bytes, list[str], list[bytes]]:
    """The top of a block ``levels`` above its nodes; for each node the sides (l, r or - for none) and the siblings on the way.

    Hashes are folded as lowercase hex text. A node without a sibling is hashed alone.
    """
    sides, siblings = [""] * len(hashes), [b""] * len(hashes)
    for level in range(levels):
        for i in range(len(sides)):
            at = i >> level
            if at % 2:
                sides[i], siblings[i] = sides[i] + "l", siblings[i] + hashes[at - 1]
            elif at + 1 < len(hashes):
                sides[i], siblings[i] = sides[i] + "r", siblings[i] + hashes[at + 1]
            else:
                sides[i] += "-"
        hashes = [sha256("".join(h.hex() for h in hashes[i : i + 2]).encode()).digest() for i in range(0, len(hashes), 2)]
    return hashes[0], sides, siblings


def _blocks(nodes: DataFrame, level: int) -> DataFrame:
    """The stored rows of ``nodes`` (tree, pos, n nodes in the tree at this level, hash and columns of the leaf)."""
    more = "level int, sides string, siblings binary, top binary, up_tree long, up_level int, up_pos long"
    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in more.split(", ")]
    schema = nodes.select("*", *blank).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.select(nodes_columns).sort_by("pos")
        tree, first, n = (group.column(c)[0].as_py() for c in ("tree", "pos", "n"))
        levels = min(LEVELS, (n - 1).bit_length())
        top, sides, siblings = climb_block(group.column("hash").to_pylist(), levels)
        last = n <= BLOCK  # the tree ends in this block: its root is a node of the tree of roots
        up = (None if tree == TOP else TOP, None if tree == TOP else 0, None if tree == TOP else tree - 1) if last else (tree, level + 1, first // BLOCK)
        size = group.num_rows
        same = [pa.array([v] * size, t) for v, t in zip((level, top, *up), (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))]
        columns = [*group.columns, same[0], pa.array(sides, pa.string()), pa.array(siblings, pa.binary()), *same[1:]]
        return pa.table(columns, names=schema.names)

    nodes_columns = nodes.columns
    return nodes.groupBy("tree", F.floor(F.col("pos") / BLOCK)).applyInArrow(run, schema)


@dataclass
class Manifest:
    """The stored node rows: leaves (with their id and, where given, changed hash), the nodes above them, each tree's root and the root."""

    leaves: DataFrame
    above: DataFrame
    trees: DataFrame
    root: bytes | None


def build(docs: DataFrame, row_id: Column, key: Column, leaf: Column, changed: Column | None = None) -> Manifest:
    """The manifest of ``docs``: a tree for each ``key``, its leaves by ``row_id``, the trees by key (null first, bytewise).

    ``leaf`` gives a row's hash as bytes, ``changed`` another hash to be folded in its stead (null: none). Rows with equal
    ids of a key go by their hash; equal rows are leaves of their own. A null id comes first. An empty table has no root.
    """
    # Null keys before all others: as text with a mark in front.
    marked = F.when(key.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), key.cast("string")))
    rows = docs.select(row_id.alias("id"), marked.alias("key"), leaf.alias("hash"), (F.lit(None).cast("binary") if changed is None else changed).alias("changed"))
    # The row number splits equal rows, however many there are.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = cut(ranked(rows, ["key", "id", "hash", "row"], "ordered"), "ranked")
    keys = cut(placed.groupBy("key").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "keys")
    trees = cut(ranked(keys, ["key"], "keys").withColumn("tree", F.col("rank") + 1).drop("rank"), "trees")
    nodes = spread_lookup(placed, trees, ["key"], F.col("row"), "inner", sizes=keys.select("key", "n"))
    leaves = cut(_blocks(nodes.select("tree", (F.col("rank") - F.col("first")).alias("pos"), "n", "hash", "id", "changed"), 0), "leaf-nodes")

    def grow(stored: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """The rows above ``stored``, level by level, and the trees' roots."""
        level, found, tops = 0, [], []
        while True:
            # A row of each block stands for its top.
            blocks = stored.where(F.col("pos") % BLOCK == 0)
            tops.append(blocks.where(F.col("n") <= BLOCK).select("tree", "top"))
            blocks = blocks.where(F.col("n") > BLOCK)
            if blocks.isEmpty():
                break
            level += 1
            upper = blocks.select("tree", F.col("up_pos").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("hash"))
            stored = cut(_blocks(upper, level), "nodes")
            found.append(stored)
        roots = tops[0]
        for more in tops[1:]:
            roots = roots.unionByName(more)
        return found, roots

    above, roots = grow(leaves)
    roots = cut(roots, "roots")
    count = roots.count()
    first = cut(_blocks(roots.select(F.lit(TOP).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(count).cast("long").alias("n"), F.col("top").alias("hash")), 0), "nodes")
    higher, root = grow(first)
    whole = first
    for more in (*above, *higher):
        whole = whole.unionByName(more)
    top = root.first()
    return Manifest(leaves, whole.drop("n", "hash", "top"), roots.select("tree", F.col("top").alias("subroot")), None if top is None else bytes(top["top"]))


#: A hash folded with the siblings of a stored row, level by level; hashes are joined as hex text.
_FOLD = """case when {sides} = '' then {hash} else unhex(aggregate(sequence(1, length({sides})), lower(hex({hash})), (acc, i) -> sha2(
    case substr({sides}, i, 1)
        when 'l' then concat(lower(hex(substr({siblings}, 1 + 32 * length(replace(substr({sides}, 1, i - 1), '-', '')), 32))), acc)
        when 'r' then concat(acc, lower(hex(substr({siblings}, 1 + 32 * length(replace(substr({sides}, 1, i - 1), '-', '')), 32))))
        else acc end, 256))) end"""
_CLIMB = f"""
with recursive climb (id, tree, leaf, folded, proof, up_tree, up_level, up_pos) as (
    select id, tree, hash, {_FOLD.format(sides="sides", siblings="siblings", hash="coalesce(changed, hash)")}, siblings, up_tree, up_level, up_pos from {{leaves}}
    union all
    select c.id, c.tree, c.leaf, {_FOLD.format(sides="n.sides", siblings="n.siblings", hash="c.folded")}, concat(c.proof, n.siblings), n.up_tree, n.up_level, n.up_pos
    from climb c join {{above}} n on n.tree = c.up_tree and n.level = c.up_level and n.pos = c.up_pos
)
select id, tree, leaf, folded, proof from climb where up_tree is null
"""


def prove(manifest: Manifest, spark: SparkSession) -> DataFrame:
    """A row for each leaf: id, leaf, subroot, root, proof and folded root, all bytes; written.

    ``proof`` holds the siblings from the leaf to the root, 32 bytes each; ``folded`` is the root that they give
    together with the changed hash of a leaf, or its own.
    """
    limit = "spark.sql.cteRecursionRowLimit"  # a guard against endless queries; this one ends at the root
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        proofs = spark.sql(_CLIMB, leaves=manifest.leaves, above=manifest.above).join(manifest.trees, "tree")
        return cut(proofs.select("id", "leaf", "subroot", F.lit(manifest.root).alias("root"), "proof", "folded"), "proofs")
    finally:
        spark.conf.set(limit, before)


_CRC = "xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint), lambda c, b: list_reduce(range(8), lambda r, i: if(r % 2 = 1, xor(r // 2, 3988292384), r // 2), xor(c, b)), 4294967295), 4294967295)"
_FRAME = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
_HEAD, _CHARS, _TEXT = " || ".join(_FRAME.format(c) for c in ("doc_id", "source", "lang")), _FRAME.format("n_chars"), _FRAME.format("text")
ORACLE = f"""
with recursive leaves as (select row_number() over () as r, doc_id, lang, sha256({_HEAD} || {_CHARS} || {_TEXT}) as leaf,
    sha256({_HEAD} || {_FRAME.format(f"(case when {_CRC} % 7 = 0 then n_chars + 1 else n_chars end)")} || {_TEXT}) as changed from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from leaves),
up as (select lang, 0 as lvl, pos, leaf as hash, n from placed
    union all select lang, lvl + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2 from up where n > 1 group by lang, lvl, pos // 2, n),
subroots as (select lang, hash as subroot, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n from up where n = 1),
top as (select 0 as lvl, pos, subroot as hash, n from subroots
    union all select lvl + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (n + 1) // 2 from top where n > 1 group by lvl, pos // 2, n),
steps as (select r, a.lvl, b.hash, case when b.hash is null then '-' when b.pos < a.pos then 'l' else 'r' end as side
        from placed p join up a on a.lang is not distinct from p.lang and a.n > 1 and a.pos = p.pos // (1 << a.lvl)
        left join up b on b.lang is not distinct from p.lang and b.lvl = a.lvl and b.pos = xor(a.pos, 1)
    union all select r, 100 + a.lvl, b.hash, case when b.hash is null then '-' when b.pos < a.pos then 'l' else 'r' end
        from placed p join subroots s on s.lang is not distinct from p.lang join top a on a.n > 1 and a.pos = s.pos // (1 << a.lvl)
        left join top b on b.lvl = a.lvl and b.pos = xor(a.pos, 1)),
paths as (select r, sha256(string_agg(coalesce(hash, ''), '' order by lvl)) as proof_sha256, list(side || coalesce(hash, '') order by lvl) as path from steps group by r),
folded as (select p.*, subroot, (select hash from top where n = 1) as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
    case when path is null then changed else list_reduce(path, lambda a, s: sha256(case s[1] when 'l' then s[2:] || a when 'r' then a || s[2:] else a end), changed) end as folded_root
    from placed p join subroots s on s.lang is not distinct from p.lang left join paths using (r))
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""


@query("op13_merkle_manifest", ORACLE)
def op13_merkle_manifest(spark, sf_dir):
    """Every document's place in the manifest by language, its proof, and whether its content, changed in one of seven, still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    # One more character than stated, where 7 divides the checksum of the id; the wider type keeps the largest value.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(touched, leaf_hash([*{**columns, "n_chars": more.cast("decimal(20,0)")}.values()]))
    proofs = prove(build(docs, F.col("doc_id"), F.col("lang"), leaf_hash([*columns.values()]), changed), spark)
    text = lambda c: F.lower(F.hex(c))
    return proofs.select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), F.sha2(text("proof"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
