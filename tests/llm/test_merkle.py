"""Operator 12 against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The top of a list of nodes and the path of each, as (before, after) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            k = at[i]
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
            at[i] = k // 16
        nodes = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    groups = sorted(groups.items(), key=lambda g: (g[0] is not None, (g[0] or "").encode()))
    trees = []
    for _, own in groups:
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(climb([leaf(r) for r in own]))
    root, above = climb([t[0] for t in trees])
    out = []
    for (_, own), (subroot, paths), top in zip(groups, trees, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            now = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], r[4].translate({k: k + 32 for k in range(65, 91)})))
            proof = h(*(x + y for x, y in path + top))
            for x, y in path + top:
                now = h(x, now, y)
            out.append((r[0], leaf(r), subroot, root, proof, now, now == root))
    return sorted(out, key=repr)


def told(spark, rows, **columns):
    df = spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in columns.items()})
    found = merkle.verified(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


def some(n, source, first=0):
    return [(first + k, source, "en", k, f"Text {k} of {source}" if k % 3 else f"no capitals {k}") for k in range(n)]


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (256, 257, 2), (4097, 255, 16, 1)])
def test_sizes(spark, sizes):
    rows = [r for k, n in enumerate(sizes) for r in some(n, f"s{k}", 10_000 * k)]
    assert told(spark, rows) == brute(rows)


def test_many_groups(spark):
    rows = [r for k in range(300) for r in some(1 + k % 3, f"{k:x}é", 10 * k)]
    assert told(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (0, None, "", 0, ""), (1, "", None, 1, "A"), (1, "", None, 1, "a"), (5, "ü", "x", -3, "É 😀 Z"), (8, "ü", "x", 3, "B" * 300_000)] + [(9, "same", "en", 4, "Same")] * 600
    want = brute(rows)
    assert told(spark, rows) == want
    assert told(spark, rows, node="n", place=1, grp="g", id=7, block=2, above="a", entry="e", root="r", up=0, _at=1) == want
    assert told(spark, rows[::-1]) == want


def test_tampering_shows_where_there_are_capitals(spark):
    rows = some(400, "s")
    found = {r[0]: r for r in told(spark, rows)}
    assert all(found[k][6] == (zlib.crc32(str(k).encode()) % 5 > 0 or k % 3 == 0) for k in range(400))
    assert len({r[3] for r in found.values()}) == 1


def test_no_rows(spark):
    assert told(spark, []) == []


def test_group_and_text_of_other_names(spark):
    df = spark.createDataFrame([(1, "b", "Same"), (2, "a", "x")], "key long, part string, body string")
    found = merkle.verified(df, "part", "key", ("key", "body"), "body").collect()
    assert {r.leaf for r in found} == {h("1:1", "4:Same"), h("1:2", "1:x")} and all(r.verified for r in found)
    assert found[0].root == h(h("1:2", "1:x"), h("1:1", "4:Same"))
