import math

import duckdb
import numpy as np
import pytest

from newsflow.llm import one_bit_search, queries
from newsflow.llm.one_bit_search import OneBit

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, every, k):
    held = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        held[i] = min(held.get(i, v), v)
    out = {}
    for q, a in held.items():
        if q % every:
            continue
        found = []
        for i, b in held.items():
            if i != q and len(b) == len(a):
                x, y = np.array(a), np.array(b)
                found.append((-round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))), 9), i))
        out |= {(q, n + 1): f for n, f in enumerate(sorted(found)[:k])}
    return out


def answers(got):
    return {(r["query_id"], r["rank"]): (-round(r["score"], 9), r["vec_id"]) for r in got}


def test_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = queries.QUERIES["op11_one_bit_search"](spark, folder)
    want = con.sql(queries.SQL["op11_one_bit_search"])
    assert got.columns == want.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("options", [OneBit(), OneBit(bits=64, block_bytes=2000, query_rows=7, first=2), OneBit(k=3, cells=100, block_bytes=4000)])
def test_equals_brute_force_on_odd_rows(spark, options):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.standard_normal(12).tolist()) for i in range(-150, 250)]
    hot = rng.standard_normal(12).tolist()
    rows += [(int(i), hot) for i in range(1000, 1400)]  # copies, queries among them
    rows += [(int(i), (np.array(hot) + 0.03 * rng.standard_normal(12)).tolist()) for i in range(1400, 1450)]
    rows += [(2000 + i, [4.0 * x for x in hot]) for i in range(3)]
    rows += [(10, rows[0][1]), (10, rows[0][1]), rows[5], rows[5]]  # an id with two vectors, repeated rows
    rows += [(3000, None), (3010, []), (3020, [0.0] * 12), (3030, [None] + [1.0] * 11), (3040, [float("nan")] + [1.0] * 11), (3050, [float("inf")] + [1.0] * 11)]
    rows += [(None, hot), (4000, [1.0, 2.0]), (4001, [2.0, 1.0]), (4010, [1e200, -1e200]), (4020, [1e-200, 3e-200]), (5000, [1.0] * 5)]
    rows = [(*r, 1, "x") for r in rows]
    got = one_bit_search.nearest(spark.createDataFrame(rows, SCHEMA).repartition(5), 10, options)
    scaled = [(i, v if not v or v[0] is None or abs(v[0]) not in (1e200, 1e-200) else [x / abs(v[0]) for x in v]) for i, v, *_ in rows]
    assert answers(got.collect()) == brute(scaled, 10, options.k)


def test_empty_and_lone_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0], 1, "x")], SCHEMA)
    assert one_bit_search.nearest(rows).count() == 0 and one_bit_search.nearest(rows.limit(0)).count() == 0


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(5)
    options = OneBit(bits=256)
    points, asked = rng.standard_normal((4000, 48)), rng.standard_normal((20, 48))
    codes, correction = one_bit_search.encode(points, options)
    turned = ((asked / one_bit_search.norms(asked)[:, None]) @ one_bit_search.rotation(48, options).T).astype(np.float32)
    true = (points / one_bit_search.norms(points)[:, None]) @ (asked / one_bit_search.norms(asked)[:, None]).T
    error = np.abs(one_bit_search.estimates(codes, correction, turned) - true) / np.sqrt(1 - true**2)
    bound = one_bit_search.spread(correction, 256, options)[:, None]
    assert (error > bound).mean() < 2e-4 and (error > bound / 4).mean() > 0.2
