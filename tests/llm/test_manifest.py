"""The Merkle manifest against a plain computation over all rows."""

import hashlib
import zlib
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """(root, for each leaf its siblings by level as (left, right))."""
    paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for p, at in zip(paths, where):
            run = runs[at // 8]
            p.append((run[: at % 8], run[at % 8 + 1 :]))
        level, where = [H(*r) for r in runs], [at // 8 for at in where]
    return level[0], paths


def brute(rows):
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append(r)
    order = sorted(parts, key=lambda p: (p is not None, (p or "").encode()))
    found, subs = {}, []
    for p in order:
        mine = sorted(parts[p], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = tree([leaf(r) for r in mine])
        subs.append(sub)
        found[p] = list(zip(mine, paths))
    root, above = tree(subs)
    out = Counter()
    for p, sub, up in zip(order, subs, above):
        for r, path in found[p]:
            whole = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else leaf(r)
            for left, right in whole:
                at = H(*left, at, *right)
            out[(r[0], leaf(r), sub, root, H(*[x for left, right in whole for x in (*left, *right)]), at, at == root)] += 1
    return out


def of(spark, rows, folder, **more):
    spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in more.items()}).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return Counter(tuple(r) for r in merkle.op11_merkle_manifest(spark, str(folder)).collect())


def test_manifest_equals_brute_force(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(530)] + [(i, None, "fr", None, None) for i in range(65)] + [(i, "s", "de", 0, "") for i in range(8)]
    rows += [(7, "s", "es", 1, "Alone")] + [(i, "s", None, 2, "A b") for i in range(9)] + [(None, "S", "en", 3, "No ID")] * 2 + [(5, "s", "en", 4, "Again")] * 3 + [(5, "t", "en", 4, "again")]
    rows += [(900 + i, "s", f"l{i:03}", 1, "Many parts") for i in range(70)] + [(2_000, "s", "en", None, "Long " * 40_000)]
    got = of(spark, rows, tmp_path / "t", tree=1, lo=2, hi=3, at="x", part="y", digest="z")
    assert got == brute(rows) and any(k[-1] for k in got) and not all(k[-1] for k in got)


def test_copies_of_one_row_keep_their_places(spark, tmp_path):
    rows = [(1, "s", "en", 1, "Same")] * 700 + [(i, "s", "en", 1, "x") for i in range(50)]
    assert of(spark, rows, tmp_path / "t") == brute(rows)


def test_one_leaf_and_no_leaf(spark, tmp_path):
    one = [(3, "s", "en", 1, "One")]
    assert of(spark, one, tmp_path / "one") == brute(one)
    assert not of(spark, [], tmp_path / "none")


def test_nodes_cover_their_ranks(spark):
    rows = spark.range(75).select(F.when(F.col("id") < 74, "a").otherwise("b").alias("part"), F.col("id").alias("place"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("boolean").alias("carried"))
    made = merkle.manifest(rows)
    seen = {(r.part, r.level, r.lo, r.hi) for r in made.nodes().collect()}
    assert {x for x in seen if x[1]} == {("a", 1, i, min(i + 8, 74)) for i in range(0, 74, 8)} | {("a", 2, 0, 64), ("a", 2, 64, 74), ("a", 3, 0, 74)}
    assert made.root().count() == 1 and len(seen) == 75 + 13
