"""Merkle manifests against a plain tree."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from crawlens.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, extra=0):
    doc_id, text, lang, source, n_chars = row
    return h(*map(framed, (doc_id, source, lang, None if n_chars is None else n_chars + extra, text)))


def tree(leaves):
    """The root, and for each leaf the list of (sibling, stands left) with None for a level without one."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            paths[k].append((leaves[other], other < i) if other < len(leaves) else None)
            at[k] = i // 2
        leaves = [h(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return leaves[0], paths


def fold(value, path):
    for step in path:
        value = h(value) if step is None else h(step[0], value) if step[1] else h(value, step[0])
    return value


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    built = [tree([leaf(r) for r in g]) for g in groups]
    root, tops = tree([b[0] for b in built])
    out = []
    for g, (subroot, paths), top in zip(groups, built, tops):
        for r, path in zip(g, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            whole = path + top
            folded = fold(leaf(r, int(changed)), whole)
            out.append((r[0], leaf(r), subroot, root, h(*(s[0] for s in whole if s)), folded, folded == root))
    return out


def check(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, str(folder)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


CASES = [(1, "a", "en", "s", 1), (2, None, "en", None, None), (None, "x", "en", "s", 1), (None, "y", None, "s", 2), (3, "", None, "s", 0), (3, "", None, "s", 0), (4, "é🙂", "é", "s", 2),
         (5, "z", "", "s", 1), (6, "t", "zz", "s", None), (14, "u" * 100_000, "en", "s", 2**63 - 1), (3, "other", None, "t", 0)]


def test_small_tables(spark, tmp_path):
    check(spark, tmp_path / "cases", CASES)
    check(spark, tmp_path / "one", [(7, "only", None, "s", 4)])
    check(spark, tmp_path / "repeated", [(8, "same", "de", "s", 4)] * 40)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op13_merkle_manifest(spark, str(tmp_path)).collect() == []


def test_trees_over_many_blocks(spark, tmp_path):
    rows = [(i * 3 % 1009, f"text {i}", "en" if i % 5 else "fr", "s", i) for i in range(1, 800)]
    check(spark, tmp_path / "wide", rows)


def test_many_stored_levels_and_many_trees(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(i, f"t{i}", f"l{i % 37:02}" if i % 3 else "hot", "s", i) for i in range(260)]
    check(spark, tmp_path / "deep", rows)


def test_changed_leaves_are_found_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"id{i}", f"k{i % 3}", f"v{i}", "tree", "pos") for i in range(30)], "name string, part string, value string, tree string, pos string")
    changed = F.when(F.col("name") == "id7", merkle.leaf_hash([F.lit("forged")]))
    built = merkle.build(docs, F.col("name"), F.col("part"), merkle.leaf_hash([F.col("name"), F.col("value")]), changed)
    rows = merkle.prove(built, spark).collect()
    assert len(rows) == 30 and [r["id"] for r in rows if r["folded"] != r["root"]] == ["id7"]
    assert {len(r["proof"]) % 32 for r in rows} == {0} and len({bytes(r["subroot"]) for r in rows}) == 3
    untouched = merkle.prove(merkle.build(docs, F.col("name"), F.col("part"), merkle.leaf_hash([F.col("name"), F.col("value")])), spark)
    assert untouched.where("folded <> root").isEmpty()


def test_the_limit_of_recursive_queries_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    docs = spark.range(5).select(F.col("id"), F.lit("k").alias("k"))
    merkle.prove(merkle.build(docs, F.col("id"), F.col("k"), merkle.leaf_hash([F.col("id")])), spark)
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_blocks(n):
    hashes = [sha256(bytes([i])).digest() for i in range(n)]
    top, sides, siblings = merkle.climb_block(hashes, (n - 1).bit_length())
    root, paths = tree([x.hex() for x in hashes])
    assert top.hex() == root
    for side, own, path in zip(sides, siblings, paths):
        assert side == "".join("-" if s is None else "l" if s[1] else "r" for s in path)
        assert own.hex() == "".join(s[0] for s in path if s)
