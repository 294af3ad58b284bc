"""Property tests for the distributed ordered index (the core of the split
and batch operators): equal to a global sort for any data, including one
group holding most rows."""

import hashlib

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cvframe.operators.index import ordered_index

rows_strategy = st.lists(
    st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 10_000)),
    min_size=1, max_size=300, unique_by=lambda t: t[2],
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, digits=st.sampled_from([1, 2]), hot=st.booleans())
def test_ordered_index_equals_global_rank(spark, rows, digits, hot):
    if hot:  # most rows in one (partition, group)
        rows = [(0, 0, i) if n % 4 else (p, g, i) for n, (p, g, i) in enumerate(rows)]
    pdf = pd.DataFrame(rows, columns=["p", "g", "id"])
    pdf["h"] = pdf["id"].map(lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())
    df = spark.createDataFrame(pdf)
    got = ordered_index(df, ["p"], ["g"], "h", "id", out_col="pos", digits=digits).toPandas()
    exp = pdf.sort_values(["p", "g", "h", "id"]).copy()
    exp["pos"] = exp.groupby("p").cumcount()
    merged = got.merge(exp, on="id", suffixes=("", "_exp"))
    assert len(merged) == len(pdf)
    assert (merged["pos"] == merged["pos_exp"]).all()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy)
def test_ordered_index_without_partition(spark, rows):
    pdf = pd.DataFrame(rows, columns=["p", "g", "id"])
    pdf["h"] = pdf["id"].map(lambda i: hashlib.md5(f"t:{i}".encode()).hexdigest())
    got = ordered_index(spark.createDataFrame(pdf), [], [], "h", "id", out_col="pos").toPandas()
    exp = pdf.sort_values(["h", "id"]).reset_index(drop=True)
    exp["pos"] = range(len(exp))
    m = got.merge(exp, on="id", suffixes=("", "_exp"))
    assert (m["pos"] == m["pos_exp"]).all() and sorted(got["pos"]) == list(range(len(pdf)))
