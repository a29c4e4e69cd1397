"""Queries on small tables, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from weftgraph.plans import queries as q
from weftgraph.plans.derived import SUPPLIER_BASE

PAIRS = [(1, 1, 3, 0.0), (1, 2, 50, 0.1), (2, 2, 4, 0.05), (3, 3, 9, 0.02), (4, 3, 50, 0.1), (5, 4, 1, 0.0), (5, 4, 2, 0.0), (6, 5, 7, 0.1), (6, 6, 8, 0.0)]


def write(folder, name, columns, rows):
    pq.write_table(pa.table(dict(zip(columns, map(list, zip(*rows))))), folder / f"{name}.parquet")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def labelled(vertices, edges):
    least = {v: v for v in vertices}
    for _ in vertices:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    order = sorted(set(least.values()))
    return {v: order.index(c) + 1 for v, c in least.items()}


def test_part_supplier_queries_take_every_line_item(spark, tmp_path):
    write(tmp_path, "lineitem", ("l_partkey", "l_suppkey", "l_quantity", "l_discount"), PAIRS)
    sf = str(tmp_path)
    edges = sorted({(p, s + SUPPLIER_BASE) for p, s, *_ in PAIRS})
    vertices = sorted({v for e in edges for v in e})
    near = {v: sorted([b for a, b in edges if a == v] + [a for a, b in edges if b == v]) for v in vertices}
    assert rows(q.neighbours(spark, sf)) == [(v, ",".join(map(str, n)), len(n)) for v, n in near.items()]
    assert rows(q.remove_edges(spark, sf)) == [e for e in edges if e[0] % 2 == 0]
    assert rows(q.other_ends(spark, sf)) == sorted((a * SUPPLIER_BASE + b, a) for a, b in edges)
    new = {v: i for i, v in enumerate(vertices, 1)}
    assert rows(q.copy_renumbered(spark, sf)) == [(i, new[a], new[b]) for i, (a, b) in enumerate((e for e in edges if e[0] % 2 == 0), 1)]
    assert dict(rows(q.connected_components(spark, sf))) == labelled(vertices, edges)
    open_ = [v for v in vertices if v % 5]
    masked = labelled(open_, [e for e in edges if e[0] % 5 and e[1] % 5])
    assert dict(rows(q.connected_components_masked(spark, sf))) == {v: masked.get(v, 0) for v in vertices}


def partners(trade, kept):
    """The three largest partners of each nation."""
    of = {}
    for (a, b), w in trade.items():
        if kept(a, b):
            of.setdefault(a, []).append((-w, b))
    return [(a, b, -w) for a, found in of.items() for w, b in sorted(found)[:3]]


def test_flows_and_cuts_of_every_nation(spark, tmp_path):
    n, rng, trade = 16, random.Random(6), {}
    for a in range(n):
        for b in rng.sample(range(n), 6):
            trade[a, b] = rng.randint(1, 50)
    write(tmp_path, "nation", ("n_nationkey", "n_regionkey"), [(i, i % 5) for i in range(n)])
    write(tmp_path, "customer", ("c_custkey", "c_nationkey"), [(i, i) for i in range(n)])
    write(tmp_path, "supplier", ("s_suppkey", "s_nationkey"), [(i, i) for i in range(n)])
    write(tmp_path, "orders", ("o_orderkey", "o_custkey"), [(i, a) for i, (a, _) in enumerate(trade)])
    write(tmp_path, "lineitem", ("l_orderkey", "l_suppkey", "l_quantity"), [(i, b, w) for i, ((_, b), w) in enumerate(trade.items())])
    sf, sets = str(tmp_path), np.arange(1 << n)
    arcs, edges = partners(trade, lambda a, b: a != b), partners(trade, lambda a, b: a < b)

    def inside(i):
        return sets >> i & 1 == 1

    def cuts(sources, sinks, directed):
        of = sum(w * (inside(a) & ~inside(b) if directed else inside(a) != inside(b)) for a, b, w in (arcs if directed else edges))
        fits = np.all([inside(i) for i in sources] + [~inside(i) for i in sinks] + [sets >= 0], axis=0)
        return np.where(fits, of, np.inf)

    def value(df):
        return df.first().value

    assert value(q.maxflow_value(spark, sf)) == cuts([2], [11], True).min()
    assert value(q.maxflow_multiple(spark, sf)) == cuts([0, 1], [11, 12], True).min()
    two = cuts([2], [6], False)
    assert value(q.maxflow_value_undirected(spark, sf)) == two.min()
    assert value(q.mincut_value(spark, sf)) == cuts([], [], False)[1:-1].min()
    side = np.bitwise_and.reduce(sets[two == two.min()])
    group = labelled(range(n), [e[:2] for e in edges])
    assert dict(rows(q.cut_labels(spark, sf))) == {i: 1 if side >> i & 1 else 2 if group[i] == group[2] else 3 for i in range(n)}
