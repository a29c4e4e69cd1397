"""SQL for the same results, for engines that allow aggregates in recursive terms."""

from __future__ import annotations

_PS = "ps as (select distinct l_partkey as src, l_suppkey + 1000000000 as dst from lineitem)"


def _nations(directed: bool) -> str:
    cond = "<>" if directed else "<"
    return f"""trade as (select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, sum(l_quantity) as weight
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
 where c_nationkey {cond} s_nationkey group by 1, 2),
 na as (select src * 100 + dst as eid, src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) as r from trade) where r <= 3),
 nv as (select cast(n_nationkey as bigint) as id, n_regionkey as region from nation)"""


_ND, _NU = _nations(True), _nations(False)
_BOTH = "arc as (select eid, src, dst, weight from na union all select eid, dst, src, weight from na)"
_ONE = "arc as (select eid, src, dst, weight from na)"


def _users() -> str:
    return """bought as (select user_id, lead(user_id) over (partition by cast(ts as date) order by ts, event_id) as nxt from events where event_type = 'purchase'),
 us as (select distinct user_id as src, nxt as dst from bought where nxt is not null and nxt <> user_id)"""


def _components(edges: str, vertices: str) -> str:
    """CTEs: reach(id, m) for edges (src, dst) and vertices (id)."""
    return f"""twoway as (select src as a, dst as b from {edges} union select dst, src from {edges}),
 walk(id, m) using key (id) as (select id, id as m from {vertices} union
   select twoway.b, min(walk.m) from walk join twoway on twoway.a = walk.id join recurring.walk as old on old.id = twoway.b where walk.m < old.m group by twoway.b)"""


def _labels(edges: str, vertices: str) -> str:
    return f"select id, dense_rank() over (order by m) as label from walk"


def _closure(edges: str, vertices: str) -> str:
    return f"reach(a, b) as (select id, id from {vertices} union select reach.a, e.dst from reach join {edges} e on e.src = reach.b)"


_SCC = "scc as (select r.a as id, min(r.b) as component from reach r join reach s on s.a = r.b and s.b = r.a group by r.a)"
_WALKS = """walks(s, v, d, n) as (select id, id, 0, 1.0::double from nv union all select w.s, arc.dst, w.d + 1, sum(w.n) from walks w join arc on arc.src = w.v where w.d < 10 group by w.s, arc.dst, w.d + 1),
 best as (select s, v, min(d) as d from walks group by s, v),
 sp as (select best.s, best.v, best.d, walks.n from best join walks using (s, v, d))"""


def _vertex_sums(half: str, by: str) -> str:
    return f"""select nv.id, round(coalesce(x.b, 0) * {half} / {by}, 6) as betweenness from nv left join (
 select m.v as id, sum(m.n * t.n / st.n) as b from sp m join sp t on t.s = m.v join sp st on st.s = m.s and st.v = t.v
 where m.v <> m.s and m.v <> t.v and m.d + t.d = st.d group by m.v) x on x.id = nv.id"""


_HOPS = """hop(s, v, k, d) as (select id, id, 0, 0.0::double from nv union all select h.s, arc.dst, h.k + 1, min(h.d + arc.weight) from hop h join arc on arc.src = h.v where h.k < 12 group by h.s, arc.dst, h.k + 1),
 best as (select s, v, min(d) as d from hop group by s, v)"""
_TIES = """cnt(s, v, k, n) as (select s, v, 0, 1.0::double from best where s = v union all
  select c.s, arc.dst, c.k + 1, sum(c.n) from cnt c join best p on p.s = c.s and p.v = c.v join arc on arc.src = c.v join best q on q.s = c.s and q.v = arc.dst where p.d + arc.weight = q.d and c.k < 24 group by c.s, arc.dst, c.k + 1),
 sp as (select best.s, best.v, best.d, c.n from best join (select s, v, sum(n) as n from cnt group by s, v) c using (s, v))"""


def _cuts(sources: tuple[int, ...], sinks: tuple[int, ...], directed: bool, n: int = 25) -> str:
    """CTEs cut(m, w): weight of the arcs that leave each set of the n vertices with the sources and without the sinks; least(w)."""
    free, spread, at = [v for v in range(n) if v not in sources + sinks], [f"{1 << s}" for s in sources], 0
    while at < len(free):  # the bits of k, spread over the runs of free vertices
        run = next((i for i in range(at + 1, len(free)) if free[i] != free[i - 1] + 1), len(free)) - at
        spread.append(f"(((k >> {at}) & {(1 << run) - 1}) << {free[at]})")
        at += run
    crossed = "(m >> src) & 1 = 1 and (m >> dst) & 1 = 0" if directed else "((m >> src) & 1) <> ((m >> dst) & 1)"
    return f"""sets as (select {' | '.join(spread)} as m from range(0, {1 << len(free)}) t(k)),
 crossing as materialized (select m, sum(weight) as w from sets join na on {crossed} group by m),
 least as (select case when count(*) < {1 << len(free)} then 0.0 else min(w) end as w from crossing),
 cut as (select m, w from crossing union all select m, 0.0 from sets where (select w from least) = 0 and m not in (select m from crossing))"""


# x_i moves to the mean of its neighbours' potentials, weighted by conductance
_JACOBI = """x(i, k, v) as (select id, 0, case when id = 0 then 1.0::double else 0.0::double end from nv union all
  select p.i, p.k + 1, case when p.i = 0 then 1.0 when p.i = 24 then 0.0 else coalesce(sum(arc.weight * q.v) / sum(arc.weight), 0.0) end
  from x p left join arc on arc.src = p.i left join x q on q.i = arc.dst where p.k < 1500 group by p.i, p.k),
 pot as (select i as id, v from x where k = 1500)"""
_SIDE = 41
_MESH = f"""ck as (select c_custkey as k, (c_custkey // 2) % 40 as x, (c_custkey // 2) // 40 as y from customer),
 cell as (select k as id, case when k % 2 = 0 then [y * {_SIDE} + x, y * {_SIDE} + x + 1, (y + 1) * {_SIDE} + x] else [(y + 1) * {_SIDE} + x + 1, y * {_SIDE} + x + 1, (y + 1) * {_SIDE} + x] end as p from ck),
 cp as (select id, unnest(p) as point from cell)"""
_MINUS_1 = "na2 as (select na.* from na join nv on nv.id = na.src where nv.region <> 1)"


def oracle_sql() -> dict[str, str]:
    with_ = lambda *ctes, recursive=False: f"with {'recursive ' if recursive else ''}" + ",\n ".join(ctes) + "\n"
    rec = lambda *ctes: with_(*ctes, recursive=True)
    psv = "pv as (select src as id from ps union select dst from ps)"
    out = {
        "g_vertices": with_(_PS) + "select src as id from ps union select dst from ps",
        "g_edges": with_(_PS) + "select src, dst from ps",
        "degrees": with_(_PS) + "select id, count(*) as out_degree, count(*) as in_degree, count(*) as degree from (select src as id from ps union all select dst from ps) group by id",
        "neighbours": with_(_PS) + "select id, string_agg(cast(o as varchar), ',' order by o) as neighbours, cast(count(*) as int) as n_outgoing from (select src as id, dst as o from ps union all select dst, src from ps) group by id",
        "subgraph_edges": with_(_PS) + "select src, dst from ps where src % 3 = 0 and dst % 3 = 0 and (src % 2 = 0 or dst % 2 = 0)",
        "select_vertices": with_(_PS) + "select id from (select src as id from ps union select dst from ps) where id % 7 = 0",
        "select_edges": with_(_PS) + "select src * 1000000000 + dst as eid from ps where src % 7 = 0",
        "remove_vertices": with_(_ND) + "select na.src, na.dst from na join nv on nv.id = na.src where nv.region <> 1",
        "remove_orphaned_edges": with_(_ND) + "select na.src, na.dst from na join nv a on a.id = na.src join nv b on b.id = na.dst where a.region <> 1 and b.region <> 1",
        "orphan_edges": with_(_ND) + "select na.src, na.dst from na join nv a on a.id = na.src join nv b on b.id = na.dst where a.region <> 1 and b.region = 1",
        "remove_edges": with_(_PS) + "select src, dst from ps where src % 2 = 0",
        "add_edges": with_(_ND) + "select src as a, dst as b, cast(2 as bigint) as n_edges from na where dst = src + 1 and src < 24",
        "duplicate_edges": "select l_partkey as a, l_suppkey + 1000000000 as b, count(*) as n_edges from lineitem group by 1, 2 having count(*) > 1",
        "copy_renumbered": with_(_PS, psv, "vm as (select id, row_number() over (order by id) as new from pv)") + "select row_number() over (order by ps.src * 1000000000 + ps.dst) as eid, a.new as src, b.new as dst from ps join vm a on a.id = ps.src join vm b on b.id = ps.dst where ps.src % 2 = 0",
        "find_edges": with_(_ND) + "select nv.id as a, (nv.id * 7 + 3) % 25 as b, na.eid from nv left join na on na.src = nv.id and na.dst = (nv.id * 7 + 3) % 25",
        "other_ends": with_(_PS) + "select src * 1000000000 + dst as eid, src as other from ps",
        "bfs_levels": rec(_ND, _ONE, "w(s, v, d) as (select id, id, 0 from nv union select w.s, arc.dst, w.d + 1 from w join arc on arc.src = w.v where w.d < 24)") + "select s as source, v as id, min(d) as level from w group by s, v",
        "bfs_levels_bipartite": rec(_PS, "twoway as (select src as a, dst as b from ps union all select dst, src from ps)", "w(v, d) using key (v) as (select 1::bigint, 0 union select twoway.b, min(w.d) + 1 from w join twoway on twoway.a = w.v left join recurring.w as old on old.v = twoway.b where old.v is null group by twoway.b)") + "select v as id, d as level from w",
        "sssp_distance": rec(_ND, _ONE, _HOPS) + "select nv.id, best.d as distance from nv left join best on best.s = 0 and best.v = nv.id",
        "sssp_path": rec(_ND, _ONE, _HOPS, "kb as (select h.s, h.v, h.d, min(h.k) as k from hop h join best using (s, v, d) where h.s = 0 group by 1, 2, 3)", "back(v, d, k) as (select v, d, k from kb where v = 6 union all select * from (select kb.v, kb.d, kb.k from back join arc on arc.dst = back.v join kb on kb.v = arc.src where kb.d + arc.weight = back.d and kb.k + 1 = back.k order by kb.v limit 1))") + "select k as step, d as distance from back",
        "connected_components": rec(_PS, psv, _components("ps", "pv")) + _labels("ps", "pv"),
        "connected_components_masked": rec(_PS, psv, "mv as (select id from pv where id % 5 <> 0)", "me as (select * from ps where src % 5 <> 0 and dst % 5 <> 0)", _components("me", "mv")) + "select pv.id, coalesce(l.label, 0) as label from pv left join (" + _labels("me", "mv") + ") l on l.id = pv.id",
        "component_sizes": rec(_PS, psv, _components("ps", "pv")) + "select label, count(*) as n from (" + _labels("ps", "pv") + ") group by label",
        "weak_components_directed": rec(_users(), "pv as (select src as id from us union select dst from us)", _components("us", "pv")) + _labels("us", "pv"),
        "strong_components": rec(_ND, _closure("na", "nv"), _SCC) + "select id, component from scc",
        "strong_components_users": rec(_users(), "uv as (select src as id from us union select dst from us)", _closure("us", "uv"), _SCC) + "select id, component from scc",
        "topological_levels": rec("cv as (select conv_id * 10000 + turn as id from conversations)", "ce as (select a.id as src, b.id as dst from cv a join cv b on b.id = a.id + 1)", "lv(id, l) as (select id, 1 from cv union select ce.dst, lv.l + 1 from lv join ce on ce.src = lv.id)") + "select id, cast(max(l) as bigint) as level from lv group by id",
        "topological_levels_contracted": rec(_ND, _closure("na", "nv"), _SCC, "ce as (select distinct a.component as src, b.component as dst from na join scc a on a.id = na.src join scc b on b.id = na.dst where a.component <> b.component)", "lv(c, l) as (select distinct component, 1 from scc union select ce.dst, lv.l + 1 from lv join ce on ce.src = lv.c)") + "select scc.id, cast(max(l) as bigint) as level from scc join lv on lv.c = scc.component group by scc.id",
        "level_violations": with_(_ND) + "select src as id, dst as other from na where src >= dst",
        "betweenness_vertices": rec(_NU, _BOTH, _WALKS) + _vertex_sums("0.5", "1"),
        "betweenness_edges": rec(_ND, _ONE, _WALKS) + "select na.eid, round(coalesce(x.b, 0), 6) as betweenness from na left join (select na.eid, sum(a.n * b.n / st.n) as b from na join sp a on a.v = na.src join sp b on b.s = na.dst join sp st on st.s = a.s and st.v = b.v where a.d + 1 + b.d = st.d group by na.eid) x on x.eid = na.eid",
        "betweenness_normalized": rec(_ND, _ONE, _WALKS) + _vertex_sums("1.0", "(24.0 * 23.0)"),
        "betweenness_weighted": rec(_ND, _ONE, _HOPS, _TIES) + _vertex_sums("1.0", "1"),
        "maxflow_value": with_(_ND, _cuts((2,), (11,), True)) + "select round(w, 6) as value from least",
        "maxflow_value_undirected": with_(_NU, _cuts((2,), (6,), False)) + "select round(w, 6) as value from least",
        "cut_labels": rec(_NU, _cuts((2,), (6,), False), "side as (select bit_and(m) as m from cut where w = (select w from least))", "r(id) as (select 2::bigint union select case when s.src = r.id then s.dst else s.src end from r join na s on s.src = r.id or s.dst = r.id)") + "select nv.id, case when (side.m >> nv.id) & 1 = 1 then 1 when r.id is not null then 2 else 3 end as label from nv cross join side left join r on r.id = nv.id",
        "maxflow_multiple": with_(_ND, _cuts((0, 1), (11, 12), True)) + "select round(w, 6) as value from least",
        "mincut_value": with_(_NU, _cuts((0,), (), False)) + "select round(coalesce(min(w), 0), 6) as value from cut where m <> (1 << 25) - 1",
        "conductance_flow": rec(_NU, _BOTH, _JACOBI) + "select round(sum(arc.weight * (1.0 - pot.v)), 6) as value from arc join pot on pot.id = arc.dst where arc.src = 0",
        "conductance_potentials": rec(_NU, _BOTH, _JACOBI) + "select id, round(v, 9) as x from pot",
        "conductance_edge_flow": rec(_NU, _BOTH, _JACOBI) + "select na.eid, round(na.weight * (a.v - b.v), 6) as flow from na join pot a on a.id = na.src join pot b on b.id = na.dst",
        "mesh_dual": with_(_MESH) + "select a.id as src, b.id as dst from cp a join cp b on a.point = b.point and a.id < b.id group by 1, 2 having count(*) = 2",
        "mesh_oriented": with_(_MESH) + f", s as (select id, list_sort(p) as p from cell), t as (select *, ((p[2] % {_SIDE} - p[1] % {_SIDE}) * (p[3] // {_SIDE} - p[1] // {_SIDE}) - (p[2] // {_SIDE} - p[1] // {_SIDE}) * (p[3] % {_SIDE} - p[1] % {_SIDE})) as v from s) select id, case when v > 0 then p[1] || ',' || p[2] || ',' || p[3] else p[1] || ',' || p[3] || ',' || p[2] end as points from t",
        "mesh_find_cells": with_(_MESH) + "select a.point as query, a.id as cell from cp a join cp b on a.id = b.id and b.point = a.point + 1",
        "mesh_depending_cells": with_(_MESH) + "select point as id, string_agg(cast(id as varchar), ',' order by id) as cells from cp group by point",
        "string_functions": "select cast(n_nationkey as bigint) as id, cast(len(string_split(n_name, ' ')) as int) as parts, array_to_string(list_filter(string_split(n_name, ' '), lambda x: trim(x) <> ''), '|') as words, cast(n_nationkey as int) as number from nation",
        "number_functions": "select l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as suppliers, abs(avg(l_quantity) - max(l_quantity)) < 0.1 * greatest(1, abs(avg(l_quantity)), abs(max(l_quantity))) as alike from lineitem group by l_orderkey",
    }
    out |= {
        "add_vertices": with_(_ND) + "select id, region from nv union all select id + 100, null from nv",
        "index_of": with_(_ND) + "select id * 2 as id, id * 2 in (select id from nv) as found from nv",
        "sssp_to_target": rec(_ND, _ONE, _HOPS, "lim as (select coalesce(min(d), 1e300) as most from best where s = 0 and v = 6)") + "select nv.id, b.d as distance from nv left join (select v, d from best, lim where s = 0 and d <= most) b on b.v = nv.id",
        "completion_labels": rec(_ND, _closure("na", "nv"), _SCC, "ce as (select distinct b.component as src, a.component as dst from na join scc a on a.id = na.src join scc b on b.id = na.dst where a.component <> b.component)", "lv(c, l) as (select distinct component, 1 from scc union select ce.dst, lv.l + 1 from lv join ce on ce.src = lv.c)") + "select scc.id, dense_rank() over (order by m.l, m.c) as label from scc join (select c, max(l) as l from lv group by c) m on m.c = scc.component",
        "vtu_mesh_round_trip": with_(_MESH) + f"select row_number() over (order by id) as id, id as number, array_to_string(list_transform(p, lambda x: (x % {_SIDE}) || '/' || (x // {_SIDE})), ',') as corners from cell",
        "numbers_round_trip": "select n_nationkey + 1 as line, case when n_nationkey <> 3 then cast(n_nationkey as bigint) * -1000003 end as value from nation",
        "pattern_round_trip": "select cast(n_nationkey + 1 as bigint) as row, k as column, substr(lpad(cast(n_nationkey as varchar), 4, '.'), k, 1) as value from nation, (select unnest(range(1, 5)) as k)",
        "line_blocks": "select block, lines, (select count(*) + count(distinct n_regionkey) from nation) as all_lines from (select cast(n_regionkey + 1 as bigint) as block, count(*) as lines from nation group by 1 union all select max(n_regionkey) + 2, 0 from nation)",
        "value_functions": "select cast(c_custkey as bigint) as id, cast(c_custkey as bigint) * 10000000000 as large, cast(null as bigint) as no_number, cast(case when abs(c_acctbal - 5000) < 0.25 * greatest(1, abs(c_acctbal), 5000) then 0 when c_acctbal < 5000 then -1 else 1 end as int) as beside, cast(len(list_filter(range(1, 7), lambda i: substr(lpad(cast(c_custkey as varchar), 6, '0'), i, 1) = substr(lpad(cast(c_nationkey as varchar), 6, '0'), i, 1))) as int) as same_digits from customer",
        "vector_functions": "select id, cast(b * f - c * e as double) as x, cast(c * d - a * f as double) as y, cast(a * e - b * d as double) as z, cast(a * d + b * e + c * f as double) as inner from (select cast(c_custkey as bigint) as id, c_custkey % 7 as a, c_custkey % 5 as b, c_custkey % 3 as c, c_custkey % 2 as d, c_custkey % 11 as e, c_custkey % 13 as f from customer)",
        "masked_statistics": "select l_returnflag, round(avg(cast(l_quantity as double)) filter (l_partkey % 3 = 0), 6) as mean, round(var_pop(cast(l_quantity as double)) filter (l_partkey % 3 = 0), 6) as variance from lineitem group by l_returnflag",
    }
    rounds = {"maxflow_rounds": "maxflow_value", "mincut_rounds": "mincut_value", "strong_components_rounds": "strong_components", "betweenness_rounds": "betweenness_edges", "conductance_rounds": "conductance_flow"}
    out |= {name: out[same] for name, same in rounds.items()}
    out["vtu_round_trip"] = with_(_ND) + "select row_number() over (order by na.eid) as eid, na.src + 1 as src, na.dst + 1 as dst, na.weight, na.src as place, cast(nv.region as bigint) as region from na join nv on nv.id = na.src"
    out["text_round_trip"] = "select n_nationkey + 1 as line, n_name as value from nation"
    return out
