"""Connected components of all lines against union-find."""

from lodepath.plans.all_queries import QUERIES


def test_components_of_all_lines(spark, sf_dir):
    edges = [(r[0] * 10, r[1] * 10 + 1) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()]
    up = {v: v for e in edges for v in e}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert {r.v: r.root for r in QUERIES["components_all"](spark, sf_dir).collect()} == {v: root(v) for v in up}
