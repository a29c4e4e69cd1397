from weftgraph import PropertyGraph


def graph(spark, edges, directed=False, n=None):
    """From tuples (src, dst[, weight]); vertices 1 to n."""
    rows = [(i, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges, 1)]
    n = n or max((max(e[:2]) for e in edges), default=0)
    v = spark.createDataFrame([(i,) for i in range(1, n + 1)], "id long")
    return PropertyGraph(v, spark.createDataFrame(rows, "eid long, src long, dst long, weight double"), directed)


def column(df, key, value):
    """Values in order of the key."""
    return [r[value] for r in df.orderBy(key).select(key, value).collect()]


def partition(df, value="component"):
    groups = {}
    for r in df.collect():
        groups.setdefault(r[value], set()).add(r["id"])
    return sorted(map(sorted, groups.values()))
