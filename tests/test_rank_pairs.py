"""Rank correlations of pairs against plain ranks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbtide.operators import rank_pairs


def plain(pdf):
    found = {}
    names = sorted(pdf.columns)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            both = pdf[[a, b]].dropna()
            if len(both):
                r = both.rank()
                flat = both[a].nunique() < 2 or both[b].nunique() < 2
                found[a, b] = (len(both), None if flat else np.corrcoef(r[a], r[b])[0, 1])
    return found


def columns(n, seed=5):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"wide": rng.normal(size=n), "ties": np.round(rng.normal(size=n) * 20), "flag": rng.integers(0, 2, n).astype(float),
                      "mass": np.where(rng.random(n) < 0.4, -1.5, rng.normal(size=n)), "same": np.full(n, 7.0), "none": np.full(n, np.nan)})
    x["near"] = x.wide + 0.3 * x.mass
    for k, c in enumerate(("ties", "mass", "near", "same")):
        x.loc[rng.random(n) < 0.1 * (k + 1), c] = np.nan
    x.loc[x.flag == 1, "part"] = x.wide
    x.loc[x.flag == 0, "rest"] = x.wide
    return x


def frame(spark, pdf, parts):
    df = spark.createDataFrame(pdf).repartition(parts)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in pdf.columns])


@pytest.mark.parametrize("block, few, width", [(16_384, 256, 20_000), (400, 16, 90)])
def test_pairs_equal_plain_ranks(spark, monkeypatch, block, few, width):
    monkeypatch.setattr(rank_pairs, "BLOCK_ROWS", block)
    monkeypatch.setattr(rank_pairs, "FEW_VALUES", few)
    monkeypatch.setattr(rank_pairs, "RANGE_ROWS", width)
    pdf = columns(3000)
    want = plain(pdf)
    got = {(r.left_column, r.right_column): (r.rows, r.rho) for r in rank_pairs.spearman_pairs(frame(spark, pdf, 3), list(pdf)).collect()}
    assert got.keys() == want.keys() and ("part", "rest") not in got
    for pair, (n, rho) in want.items():
        assert got[pair][0] == n and (got[pair][1] is None if rho is None else abs(got[pair][1] - rho) < 1e-10)


def test_exchanged_rows_grow_with_columns_not_pairs(spark):
    pdf = columns(3000)
    blocks = rank_pairs._blocks(frame(spark, pdf, 2), sorted(pdf))
    splitters = rank_pairs._splitters(blocks, pdf.shape[1], 3)
    listed = rank_pairs._within(blocks, splitters).toPandas()
    names = sorted(pdf)
    assert sum(len(r) // 2 for r in listed["rows"]) <= pdf.notna().sum().sum()
    assert {names[c] for c in listed["at"]} == {"wide", "mass", "near", "part", "rest"}
    # Rows with the common value of ``mass`` stay where they are.
    assert sum(len(r) // 2 for r, c in zip(listed["rows"], listed["at"]) if names[c] == "mass") < (pdf.mass != -1.5).sum()


def test_odd_values(spark):
    odd = [0.0, -0.0, float("inf"), -float("inf"), float("nan"), None, 3.0, float("nan")]
    df = spark.createDataFrame([(v, float(i)) for i, v in enumerate(odd)], "a double, b double")
    rank = {0.0: 2.5, float("inf"): 5, -float("inf"): 1, 3.0: 4}
    a = [6.5 if v != v else rank[v] for v in odd if v is not None]
    b = range(len(a))
    found = rank_pairs.spearman_pairs(df, ["b", "a"]).first()
    assert found.rho == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-12) and found.rows == 7
    assert rank_pairs.spearman_pairs(df.limit(0), ["a", "b"]).count() == 0
