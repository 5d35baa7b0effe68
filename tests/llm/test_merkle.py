"""The Merkle manifest against a plain walk over all rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from aerolith.llm import merkle
from aerolith.llm.merkle import folded, merkle_manifest, proof_hash
from aerolith.llm.queries import QUERIES
from aerolith.operators import ordered

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Subroot or root, and for each leaf the siblings left and right of its way, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def naive(rows):
    """Leaf, subroot, root, proof's digest, root folded from the tampered row, for each row as (doc_id, ...)."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, H(*(part(r[c]) for c in COLUMNS)), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    found = {g: (sorted(v, key=lambda x: x[:3]), *tree([x[2] for x in sorted(v, key=lambda x: x[:3])])) for g, v in groups.items()}
    root, above = tree([found[g][1] for g in order]) if order else (None, [])
    out = []
    for k, g in enumerate(order):
        leaves, subroot, paths = found[g]
        for (_, _, leaf, r), path in zip(leaves, paths):
            path = path + above[k]
            h = leaf
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                h = H(*(part(text if c == "text" else r[c]) for c in COLUMNS))
            for left, right in path:
                h = H(left, h, right)
            out.append((r["doc_id"], leaf, subroot, root, H(*(a + b for a, b in path)), h, h == root))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def query_on(spark, rows, tmp_path, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    return QUERIES["op13_merkle_manifest"](spark, str(tmp_path))


def test_query_on_all_documents(spark, sf):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op13_merkle_manifest"](spark, sf)
    assert got(out) == naive(rows)
    assert {r.verified for r in out.collect()} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 130])
def test_sizes_around_a_run(spark, tmp_path, n):
    rows = [dict(zip(COLUMNS, (i, "s", "en", i % 7, f"Text {i}"))) for i in range(n)]
    rows += [dict(zip(COLUMNS, (1000 + i, "s", f"l{i}", 1, "Other"))) for i in range(n)]
    assert got(query_on(spark, [tuple(r.values()) for r in rows], tmp_path)) == naive(rows)


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, one id on several texts, and columns with names of the operator's own."""
    base = [(3, None, None, None, None), (None, "a", "en", 1, "Null Id"), (4, "a", "", 0, ""), (5, "ä", "é", 2, "Ünï"), (6, "a", "z", 9, "Long " * 200_000),
            (7, "a", "en", 1, "X"), (7, "a", "en", 1, "Y"), (7, "b", "en", None, "Y"), (-8, None, "en", 1, None), (2**62, "a", "EN", 1, "B")]
    base += [(100 + i, None, None, 1, "T") for i in range(20)]
    rows = [dict(zip(COLUMNS, b)) for b in base]
    out = query_on(spark, [(*b, "x", "y", 1, 2) for b in base], tmp_path, SCHEMA + ", g string, h string, i int, path int")
    assert got(out) == naive(rows)


def test_repeated_rows_and_hot_group(spark, tmp_path, monkeypatch):
    """A row that is most of the table is spread over ranges; equal rows are leaves each."""
    monkeypatch.setattr(ordered, "RANGE_ROWS", 64)
    rows = [(1, "s", "en", 1, "Same")] * 700 + [(i, "s", "de", 1, "t") for i in range(50)]
    out = query_on(spark, rows, tmp_path)
    assert got(out) == naive([dict(zip(COLUMNS, r)) for r in rows])
    named = spark.createDataFrame([("g", 5)] * 1000, "g string, v int").repartition(7)
    indexed = ordered.ordered_index(named, "g", ["v"])
    assert [r.i for r in indexed.orderBy("i").collect()] == list(range(1000))


def test_empty_table(spark, tmp_path):
    out = query_on(spark, [], tmp_path)
    assert out.count() == 0 and "verified" in out.columns


def test_any_change_breaks_the_proof(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = merkle.leaf_hash(*map(F.col, COLUMNS[:4]), F.concat(F.col("text"), F.lit("!")))
    out = merkle_manifest(docs, carry={"other": other})
    ok, broken = folded(F.col("leaf"), F.col("path")) == F.col("root"), folded(F.col("other"), F.col("path")) == F.col("root")
    assert out.where(~ok).count() == 0 and out.where(broken & F.col("other").isNotNull()).count() == 0
    assert out.select(proof_hash(F.col("path")).alias("p")).distinct().count() == out.count()


def test_other_fanout(spark):
    rows = spark.createDataFrame([(i, "s", "en", i, "t") for i in range(10)], SCHEMA)
    out = merkle_manifest(rows, fanout=2)
    assert {len(r.path) for r in out.collect()} == {4} and out.select("root").distinct().count() == 1
