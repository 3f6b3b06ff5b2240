"""The token-group join against all pairs and its SQL, with small groups and every way of reading texts."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm import group_join as G


def plain_sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def all_pairs(rows):
    sets, parent = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def made(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.randint(4, 90))] for _ in range(30)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.5:
            w = list(rng.choice(bases[: 3 if kind < 0.3 else 30]))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = [word()]
        elif kind < 0.7:
            w = passage + [word() for _ in range(rng.choice([2, 6, 60]))]
        else:
            w = [word() for _ in range(rng.randint(1, 60))]
        rows.append((i, rng.choice([" ", "\n"]).join(w).replace("a", rng.choice("aA"))))
    rows += [(None, rows[3][1]), (None, " ".join(bases[20])), (5, rows[9][1]), (5, rows[5][1]), (n + 1, None), (n + 2, ""), (n + 3, " \t"), (n + 4, "One two"), (n + 5, "one TWO")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"GROUP_ROWS": 6, "GROUP_TOKENS": 400, "QUERY_ROWS": 3, "BROADCAST_ROWS": 0, "SAMPLE": 1, "SEEN_IN_SAMPLE": 2}, {"BANDS": 1, "BAND_ROWS": 8, "SAMPLE": 2}])
def test_equals_all_pairs(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(G, name, value)
    rows = made(len(limits))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0)).withColumn("grp", F.lit("x")).withColumn("__id", F.lit(1))
    got = G.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == all_pairs(rows)


def test_first_tokens_meet():
    """Whatever tokens are frequent, similar enough sets share one of their first tokens."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = np.sort(rng.integers(0, 2**62, 80).astype(np.uint64))
        a, b = (np.sort(rng.choice(pool, rng.integers(60, 80), replace=False)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            often = np.sort(rng.choice(pool, 30, replace=False))
            counts = rng.integers(1, 5, 30)
            assert len(np.intersect1d(G.first_tokens(a, often, counts), G.first_tokens(b, often, counts)))


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(1)
    for n in (1, 5, 64, 500, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        for drop in (0, n // 10, n):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, drop + n // 3 * (drop == 0) + 1, dtype=np.uint64)]))
            assert G.differing(G.parities(a), G.parities(b)) <= len(np.setxor1d(a, b))
    far = [np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2)) for _ in range(2)]
    assert G.differing(*map(G.parities, far)) > 222 and G.differing(G.parities(far[0]), G.parities(far[0])) == 0


def test_bitmaps_of_a_group_differ_as_pairs_do():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 1200, dtype=np.uint64) * np.uint64(2))
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (1, 60, 63, 64, 90, 127, 128, 130, 250, 257, 1000, 1100)]
    bits = [G.parities(s) for s in sets]
    held = G.Bitmaps(bits)
    for a in bits:
        for y, b in enumerate(bits):
            only = np.where(np.arange(len(bits)) == y, G.differing(a, b), -1)
            assert held.near(a, only) and (only[y] == 0 or not held.near(a, np.where(only >= 0, only - 1, -1)))
        assert not held.near(a, np.full(len(bits), -1))


def test_members_that_stay_apart_are_no_rows(spark):
    """Askers far from every member of a large group: no operator of the plan makes a row of an asker and a member."""
    n, rng = 120, np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2)) for _ in range(2 * n)]
    nodes = spark.createDataFrame([(i, len(s), bytearray(G.parities(s)), i) for i, s in enumerate(sets)], "node long, n long, bits binary, comp long")
    pairs, members = spark.range(n).select(F.col("id").alias("node"), F.lit(9).cast("long").alias("grp")), spark.range(n, 2 * n).select(F.lit(9).cast("long").alias("grp"), F.col("id").alias("node"))
    near = G.near_enough(pairs, members, nodes)
    assert near.collect() == []
    same = G.near_enough(pairs, members, nodes.withColumn("bits", F.first("bits").over(W.orderBy(F.lit(0)))).withColumn("n", F.lit(60).cast("long")))
    assert sorted(r.node for r in same.collect()) == list(range(n))
    left = near._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in left and "other_comp" not in left


def test_empty_table(spark):
    assert G.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_queries_equal_their_sql(spark):
    import duckdb

    from factloom.llm.near_dedup import op7_near_dedup

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for query, sql in ((G.op11_group_join, G.OP11_SQL), (op7_near_dedup, G.OP7_SQL)):
        got = query(spark, "/root/testdata/sf0.001")
        want = con.execute(sql)
        assert [d[0] for d in want.description] == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
