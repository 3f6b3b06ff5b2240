"""Hard negatives against all pairs, over several groups, cells and pieces, and the defined cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives as H

SCHEMA = "vec_id long, label int, vec array<double>"


def all_pairs(rows, anchor):
    ids, labels = [r[0] for r in rows], [r[1] for r in rows]
    m = np.array([r[2] for r in rows])
    out = []
    for i in range(len(rows)):
        if not anchor(ids[i]):
            continue
        scores = (m @ m[i]).astype(int).tolist()
        ranked = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-scores[j], ids[j]))
        for p in [j for j in ranked if labels[j] == labels[i]][: H.POSITIVES]:
            band = [j for j in ranked if labels[j] != labels[i] and 30 * scores[p] <= 100 * scores[j] <= 90 * scores[p]]
            out += [(ids[i], ids[p], n, ids[j], scores[p], scores[j]) for n, j in enumerate(band[: H.NEGATIVES], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clustered", "even", "copies"])
def test_equals_all_pairs(spark, monkeypatch, kind):
    for name, value in {"MOST_PIVOTS": 12, "LEAST_PIVOTS": 8, "ANCHORS_PER_GROUP": 20, "BLOCK_ANCHORS": 16, "PIECE_ROWS": 60, "CELLS_AT_ONCE": 500}.items():
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(3)
    n, size = 700, 12
    centres = rng.normal(0, 40, (9, size))
    made = centres[rng.integers(0, 9, n)] + rng.normal(0, 9, (n, size)) if kind == "clustered" else rng.normal(0, 30, (n, size))
    if kind == "copies":
        made[:400] = made[0]
    vectors = np.floor(made)
    rows = [(int(i * 5), int(rng.integers(0, 4)), [float(x) for x in vectors[i]]) for i in rng.permutation(n)]
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    assert [f.simpleString() for f in got.schema] == [f"{c.split()[0]}:{'bigint' if c.split()[1] == 'long' else 'int'}" for c in H.RESULT.split(", ")]
    assert sorted(map(tuple, got.collect())) == all_pairs(rows, lambda i: i % 50 == 0)


def test_bounds_leave_far_cells_out(spark):
    """Two far clusters: no candidate of one is copied to the group of the other."""
    rng = np.random.default_rng(1)
    near = np.floor(np.vstack([rng.normal(0, 1, (300, 4)) + [900, 0, 0, 0], rng.normal(0, 1, (300, 4)) + [0, 900, 0, 0]]))
    rows = [(i, i % 2, near[i].tolist()) for i in range(600)]
    table = H.usable(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    space = H.Space(table.orderBy(F.xxhash64("vec_id")).limit(64).collect(), 4, float((near**2).sum(axis=1).max()), 8)
    asking = H.seeded(table.filter("anchor"), space).withColumn("part", F.col("label")).withColumn("split", F.lit(0))
    served = H.with_cells(table, space).withColumn("part", F.col("label")).join(H.bounds_of(asking, space), ["cell", "part"]).filter("r BETWEEN low AND high")
    groups = asking.select("grp", "part").distinct().count() / 2
    assert served.count() <= 600 * groups / 2 + 60


def test_defined_cases(spark, tmp_path):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 2 == 0).collect() == []
    rows = [
        (0, 1, [10.0, 0.0]), (2, 1, [10.0]), (2, 1, [10.0, 0.0]), (3, 2, [5.0, 0.0]), (5, 2, [5.0, 1.0]), (7, 2, [2.0, 0.0]), (9, 2, [9.5, 0.0]),
        (None, 2, [5.0, 0.0]), (11, None, [5.0, 0.0]), (13, 2, None), (15, 2, [5.0, None]), (17, 2, [5.0, math.nan]), (19, 2, [math.inf, 0.0]),
    ]
    odd = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("anchor", F.lit(None))
    got = [tuple(r) for r in H.hard_negatives(odd, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 2, 1, 3, 100, 50), (0, 2, 2, 5, 100, 50)]
    assert H.hard_negatives(spark.createDataFrame([(0, 1, [-1.0]), (1, 1, [1.0]), (2, 2, [-1.0])], SCHEMA), F.col("vec_id") == 0).collect() == []


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = H.op13_hard_negatives(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(H.OP13_SQL).fetchall())
