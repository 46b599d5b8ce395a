"""The Merkle manifest against plain loops."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, add=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(nodes, fanout):
    """The root, and for each node the siblings left and right of it, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            a = i // fanout * fanout
            paths[k].append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + fanout])))
        nodes = [H(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([leaf_of(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))], fanout) for g in order}
    root, tops = climbed([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops):
        for r, path in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))), trees[g][1]):
            way = path + top
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            f = leaf_of(r, int(changed))
            for a, b in way:
                f = H(a, f, b)
            out.append((r[0], leaf_of(r), trees[g][0], root, H(*[a + b for a, b in way]), f, f == root))
    return out


def table(n, seed, langs=(None, "en", "de", "", "é")):
    rng = random.Random(seed)
    lang = lambda: rng.choices(langs, [1, 9, 2, 1, 1])[0]
    rows = [(rng.choice([None, i, i, i, i // 2]), rng.choice([None, "s", ""]), lang(), rng.choice([None, 9, 10, i]), rng.choice([None, "", "é\n:", "x" * i])) for i in range(n)]
    return rows + rows[:3] + [(5, "one", "lone", 1, "alone")]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows, tmp_path, extra=True):
    d = spark.createDataFrame(rows, SCHEMA)
    if extra:
        d = d.withColumns({"grp": F.lit("x"), "place": F.lit(1), "ROW": F.lit(2)})
    d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return merkle.op12_merkle_manifest(spark, str(tmp_path))


@pytest.mark.parametrize(("block", "n"), [(4096, 300), (8, 300), (4, 61)])
def test_manifest_by_brute_force(spark, tmp_path, monkeypatch, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = table(n, n)
    got = run(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts(spark, monkeypatch, fanout):
    monkeypatch.setattr(merkle, "BLOCK", 30)
    rows = [(i, "s", "en" if i % 3 else "de", i, "t") for i in range(200)]
    d = spark.createDataFrame(rows, SCHEMA).select(F.concat(F.lit("="), "lang").alias("grp"), "doc_id", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("digest"))
    got = merkle.manifest(d.withColumn("claimed", F.col("digest")), fanout).collect()
    want = {r[0]: r for r in brute(rows, fanout)}
    assert len(got) == 200 and all((r.leaf, r.subroot, r.root, r.proof_sha256) == want[r.doc_id][1:5] and r.verified for r in got)


def test_one_row_and_none(spark, tmp_path):
    [row] = run(spark, [(2, "s", "en", 1, "t")], tmp_path).collect()
    assert tuple(row) == brute([(2, "s", "en", 1, "t")])[0] and row.proof_sha256 == H("") and row.leaf == row.subroot == row.root
    assert run(spark, [], tmp_path).count() == 0


def test_sql_by_brute_force():
    rows = table(120, 7)
    rows = [r for i, r in enumerate(rows) if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    assert Counter(con.sql(merkle.OP12_SQL).fetchall()) == Counter(brute(rows))
