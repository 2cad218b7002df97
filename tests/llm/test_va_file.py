import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import va_file as V

from .helpers import with_clashes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, step):
    live = []
    for i, v, _ in rows:
        if i is None or not v or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        live.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out, seen = [], set()
    for i, q in live:
        if i % step or (i, tuple(q)) in seen:
            continue
        seen.add((i, tuple(q)))
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in live if j != i)
        out += [(i, n + 1, j, -x) for n, (x, j) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale, block", [(0.1, 4096), (1.0, 4), (1e5, 4096)])
def test_against_brute_force(spark, scale, block):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * scale for _ in range(12)], 0) for i in range(300)]
    rows += [(400 + i, rows[3][1], 1) for i in range(40)]
    rows += [(500, None, 0), (510, [], 0), (520, [1.0] * 11 + [None], 0), (530, [float("nan")] * 12, 0), (540, [float("inf")] + [0.0] * 11, 0), (None, [1.0] * 12, 0), (550, [scale] * 3, 0), (560, [0.0] * 12, 0)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(3).drop("score"))
    got = V.top_k(df, F.col("vec_id") % 10 == 0, k=5, query_block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 10)


def test_few_rows(spark):
    d = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert V.top_k(d([]), F.lit(True)).count() == 0 and V.top_k(d([(1, None, 0)]), F.lit(True)).count() == 0
    assert V.top_k(d([(1, [1.0], 0)]), F.lit(True)).count() == 0
    two = sorted(map(tuple, V.top_k(d([(1, [1.0], 0), (2, [0.5], 0)]), F.lit(True)).collect()))
    assert two == [(1, 1, 2, 32768), (2, 1, 1, 32768)]


def test_cells_bound_all_products():
    r = np.random.default_rng(1)
    m, q = r.integers(-500, 300, (200, 7)), r.integers(-300, 300, (20, 7))
    cells = V.Cells(m.min(axis=0), m.max(axis=0))
    scan = V.Scan(np.arange(20), q, cells)
    mid, exact = scan.middles(cells.encode(m)), 2 * (q @ m.T)
    assert (mid - scan.off[:, None] <= exact).all() and (exact <= mid + scan.off[:, None]).all()
    one = V.Cells(np.array([5]), np.array([5]))
    assert V.Scan(np.array([1]), np.array([[2]]), one).middles(one.encode(np.array([[5]]))).tolist() == [[20]]


@pytest.mark.parametrize("bits", [1, 4, 6])
def test_repeated_rows_and_copies(spark, bits):
    """Rows of one id and vector are candidates of their own; a vector that
    thousands of rows share doesn't make thousands of candidates."""
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)], 0) for i in range(100)]
    rows += [rows[5], rows[5], rows[10], (5, rows[6][1], 0)]  # repeated, and another vector of the id
    rows += [(1000 + i, rows[20][1], 0) for i in range(2000)] + [(3000, rows[7][1], 0)] * 9
    reads = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = V.top_k(df, F.col("vec_id") % 50 == 0, bits=bits, reads=reads).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 50)
    assert reads.value < 46 * 150  # 46 distinct queries, 2115 rows


def test_query(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)], 0) for i in range(120)] + [(None, [1.0] * 8, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = V.op3_vector_top_k(spark, str(tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 50)


def test_reads_stop_when_certain(spark):
    """Cells hold several values each, and few exact vectors are read."""
    r = np.random.default_rng(2)
    m = r.normal(0, 0.25, (3000, 16)).astype(np.float32)
    rows = [(i, m[i].tolist(), 0) for i in range(3000)]
    reads = spark.sparkContext.accumulator(0)
    got = V.top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, bits=5, reads=reads).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 100)
    v = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    assert (V.Cells(v.min(axis=0), v.max(axis=0), 5).widths > 0).all()
    assert 30 * 5 <= reads.value < 30 * 3000 / 10
