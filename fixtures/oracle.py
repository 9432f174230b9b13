"""The same fixtures and operators in SQL, for checking the Spark results with DuckDB.

Statements are put together from named common table expressions; ``sql(tail)`` adds those that
``tail`` needs, directly or through others. Doubles are rounded on both sides by the callers.
"""

from __future__ import annotations

import re


def walk_cost(cap: str, dh: str = "o.dh", dz: str = "(b.z - a.z)") -> str:
    decay = f"3.5::double * abs({dz} / {dh} + 0.05::double)"
    if cap == "speed":
        return f"({dh} / 1000.0::double) / greatest(6.0::double * exp(-({decay})), 1e-12::double)"
    return f"{dh} / 6000.0::double * exp(least({decay}, 80.0::double))"


_STEPS = ("select k, dr, dc, greatest(abs(dr), abs(dc)) as far, abs(dr * dc) as area from (values (8), (16), (24), (32), (64)) a(k), "
          "generate_series(-3, 3) b(dr), generate_series(-3, 3) c(dc)")

# (name, columns or recursion clause, body), in the order they may build on each other
PARTS: list[tuple[str, str, str]] = [
    ("g", "", "select max(p_partkey) // 40 + 1 as nrows, 40 as ncols, 30.0::double * (max(p_partkey) // 40 + 1) as y0 from part"),
    ("cells", "", "select p_partkey as cell_id, p_partkey // 40 as r, p_partkey % 40 as c, "
                  "p_size * 0.25::double + p_retailprice * 0.01::double as z from part"),
    ("raster", "", "select p_partkey as cell_id, case when p_partkey % 101 = 0 then null "
                   "when p_partkey % 97 = 0 then 'NaN'::double "
                   "else (p_partkey * 7 % 11) * 0.25::double - 0.25::double end as v from part"),
    ("steps", "", f"select k, dr, dc, sqrt((dr * 30.0::double) * (dr * 30.0::double) + (dc * 30.0::double) * (dc * 30.0::double)) as dh "
                  f"from ({_STEPS}) where far > 0 and (far = 1 or k = 64 or (k = 16 and area = 2) or (k in (24, 32) and far = 2) or (k = 32 and area = 3))"),
    ("pts", "", "select s_suppkey as point_id, ((s_suppkey * 11 + s_nationkey * 3) % 40 + 0.5::double) * 30 as x, "
                "y0 - ((s_suppkey * 7 + s_nationkey) % nrows + case when s_suppkey % 10 = 9 then nrows else 0 end + 0.5::double) * 30 as y "
                "from supplier, g"),
    ("dest_pts", "", "select c_custkey as point_id, ((c_custkey * 7 + c_nationkey * 5) % 40 + 0.5::double) * 30 as x, "
                     "y0 - ((c_custkey * 3 + c_nationkey) % nrows + case when c_custkey % 10 = 9 then nrows else 0 end + 0.5::double) * 30 as y "
                     "from customer, g"),
    ("placed", "", "select point_id, r * 40 + c as cell_id, r, c from (select point_id, "
                   "cast(floor((y - y0) / -30.0::double) as bigint) as r, cast(floor(x / 30.0::double) as bigint) as c from pts, g), g "
                   "where r between 0 and nrows - 1 and c between 0 and 39"),
    ("dests", "", "select point_id as dest_id, r * 40 + c as cell_id from (select point_id, "
                  "cast(floor((y - y0) / -30.0::double) as bigint) as r, cast(floor(x / 30.0::double) as bigint) as c from dest_pts, g), g "
                  "where r between 0 and nrows - 1 and c between 0 and 39"),
    ("origin_pt", "", "select 0::bigint as point_id, avg((c + 0.5::double) * 30) as x, avg(y0 - (r + 0.5::double) * 30) as y from placed, g"),
    ("org", "", "select cast(floor((y - y0) / -30.0::double) as bigint) * 40 + cast(floor(x / 30.0::double) as bigint) as s "
                "from origin_pt, g"),
    ("samples", "", "select cell_id as s, count(*) as m from placed group by 1"),
    # lines
    ("ends0", "", "select s_suppkey as k, s_nationkey as n, (s_suppkey * 3 + s_nationkey) % nrows as r0, "
                  "(s_suppkey * 5 + s_nationkey * 7) % 40 as c0 from supplier, g"),
    ("ends1", "", "select *, r0 + k % 7 - 3 as r1, c0 + (n * 11) % 9 - 4 as c1 from ends0"),
    ("ends2", "", "select *, r1 + n % 5 - 2 as r2, c1 + (k * 3) % 11 - 5 + case when k % 8 = 7 then 60 else 0 end as c2 from ends1"),
    ("segs", "", "select k as line_id, 0 as part, 0 as seg, (n % 5) * 0.75::double - 0.25::double as cost, r0 as ra, c0 as ca, r1 as rb, c1 as cb from ends2 "
                 "union all select k, case when k % 2 = 0 then 0 else 1 end, case when k % 2 = 0 then 1 else 0 end, "
                 "(n % 5) * 0.75::double - 0.25::double, case when k % 2 = 0 then r1 else r2 end, case when k % 2 = 0 then c1 else c2 end, "
                 "case when k % 2 = 0 then r2 else r0 end, case when k % 2 = 0 then c2 else c0 end from ends2"),
    ("line_ends", "", "select line_id, ra between 0 and nrows - 1 and ca between 0 and 39 as inside from segs, g "
                      "union all select line_id, rb between 0 and nrows - 1 and cb between 0 and 39 from segs, g"),
    ("walk", "", "select line_id, part, seg, i as step, cost, "
                 "ra + (case when ra < rb then 1 else -1 end) * (case when tall <= wide then minor else i end) as r, "
                 "ca + (case when ca < cb then 1 else -1 end) * (case when tall <= wide then i else minor end) as c "
                 "from (select *, case when n = 0 then 0 else (2 * i * m + n - 1) // (2 * n) end as minor "
                 "from (select *, unnest(generate_series(0, n)) as i from (select *, abs(cb - ca) as wide, abs(rb - ra) as tall, "
                 "greatest(abs(cb - ca), abs(rb - ra)) as n, least(abs(cb - ca), abs(rb - ra)) as m from segs)))"),
    ("line_cost", "", "select r, c, case when cost > 0 then cost else 1.0::double end as m from walk"),
    ("spread", "", "select b, (r + dr) * 40 + c + dc as cell_id, max(m) as m from line_cost, "
                   "(values (0), (1), (2)) bs(b), (select unnest(generate_series(-2, 2)) as dr) a, (select unnest(generate_series(-2, 2)) as dc) d, g "
                   "where abs(dr) <= b and abs(dc) <= b and r + dr between 0 and nrows - 1 and c + dc between 0 and 39 group by 1, 2"),
    ("lmult", "", "select cell_id, greatest(m, 1.0::double) as m from spread where b = 2"),
    ("rmult", "", "select cell_id, case when v is null or isnan(v) or v <= 0 then 1.0::double else v end as m from raster"),
    ("mult", "", "select cells.cell_id, coalesce(l.m, 1.0::double) * coalesce(r.m, 1.0::double) as m "
                 "from cells left join lmult l on l.cell_id = cells.cell_id left join rmult r on r.cell_id = cells.cell_id"),
    ("base16", "", f"select a.cell_id, coalesce(avg({walk_cost('speed')}), 0.0::double) as value from cells a cross join (select * from steps where k = 16) o "
                   "left join cells b on b.r = a.r + o.dr and b.c = a.c + o.dc where b.cell_id is not null group by 1"),
    # the wide terrain
    ("wg", "", "select max(o_orderkey) // 500 + 1 as nrows from orders"),
    ("wcells", "", "select o_orderkey as cell_id, o_orderkey // 500 as r, o_orderkey % 500 as c, "
                   "o_custkey % 40 * 0.25::double + o_totalprice * 0.00001::double as z from orders"),
    ("wplaced", "", "select (s_suppkey * 7 + s_nationkey) % nrows as r, (s_suppkey * 37 + s_nationkey * 3) % 500 as c from supplier, wg where s_suppkey % 10 <> 9"),
    ("wsamples", "", "select r * 500 + c as s, count(*) as m from wplaced group by 1"),
    ("wdests", "", "select c_custkey as dest_id, (c_custkey * 3 + c_nationkey) % nrows * 500 + (c_custkey * 17 + c_nationkey * 5) % 500 as cell_id "
                   "from customer, wg where c_custkey % 10 <> 9"),
    ("worg", "", "select cast(floor(avg(r + 0.5::double)) as bigint) * 500 + cast(floor(avg(c + 0.5::double)) as bigint) as s from wplaced"),
]


def _edges(name: str, cap: str, mult: bool, cells: str = "cells") -> tuple[str, str, str]:
    factor = " * mult.m" if mult else ""
    join = " join mult on mult.cell_id = b.cell_id" if mult else ""
    return (name, "", f"select a.cell_id as src, b.cell_id as dst, {walk_cost(cap)}{factor} as w from {cells} a "
                      "cross join (select * from steps where k = 16) o "
                      f"join {cells} b on b.r = a.r + o.dr and b.c = a.c + o.dc{join}")


def _paths(tag: str, edge: str, starts: str) -> list[tuple[str, str, str]]:
    """Distances, predecessors and (for ``dests``) paths over edge table ``edge``."""
    return [
        (f"d{tag}", "(s, v, dist) using key (s, v)",
         f"select s, s, 0.0::double from {starts} union "
         f"select s, v, dist from (select d{tag}.s, e.dst as v, min(d{tag}.dist + e.w) as dist from d{tag} join {edge} e on d{tag}.v = e.src group by 1, 2) n "
         f"where dist < coalesce((select rd.dist from recurring.d{tag} rd where rd.s = n.s and rd.v = n.v), 1e300)"),
        (f"dist{tag}", "", f"select * from d{tag}"),
        (f"pred{tag}", "",
         f"select d2.s as s, d2.v as v, arg_min(d1.v, (round((d1.dist + e.w) * 1e9), d1.v)) as p from dist{tag} d2 "
         f"join {edge} e on e.dst = d2.v join dist{tag} d1 on d1.s = d2.s and d1.v = e.src where d1.dist < d2.dist group by 1, 2"),
    ]


PARTS += [_edges("edge_s", "speed", False), _edges("edge_x", "exponent", False),
          _edges("edge_sm", "speed", True), _edges("edge_xm", "exponent", True)]
PARTS += _paths("_o", "edge_s", "org") + _paths("_om", "edge_sm", "org")
PARTS += _paths("_p", "edge_x", "samples") + _paths("_pm", "edge_xm", "samples")
PARTS += [_edges("edge_ws", "speed", False, "wcells"), _edges("edge_wx", "exponent", False, "wcells")]
PARTS += _paths("_wo", "edge_ws", "worg") + _paths("_wp", "edge_wx", "wsamples")
for _tag, _dests in (("_o", "dests"), ("_om", "dests"), ("_wo", "wdests")):
    PARTS += [
        (f"back{_tag}", "", f"select d.cell_id as dest, d.cell_id as cell, 0 as n from (select distinct cell_id from {_dests}) d join dist{_tag} t on t.v = d.cell_id "
                            f"union all select w.dest, p.p, w.n + 1 from back{_tag} w join pred{_tag} p on p.v = w.cell"),
        (f"path{_tag}", "", f"select dest, max(n) over (partition by dest) - n as step, cell from back{_tag}"),
        (f"num{_tag}", "", f"select cast(row_number() over (order by dest_id) - 1 as bigint) as path_id, dest_id, cell_id, dist from {_dests} join dist{_tag} on v = cell_id"),
    ]
for _tag, _samples in (("_p", "samples"), ("_pm", "samples"), ("_wp", "wsamples")):
    PARTS += [
        (f"tok{_tag}", "", f"select a.s as s, b.s as dest, b.s as cell, b.m as n from {_samples} a, {_samples} b where a.s <> b.s "
                           f"union all select w.s, w.dest, p.p, w.n from tok{_tag} w join pred{_tag} p on p.s = w.s and p.v = w.cell"),
        (f"pc{_tag}", "", f"select s, cell, cast(sum(n) as bigint) as n from tok{_tag} group by 1, 2"),
        (f"dens{_tag}", "", f"select cell, cast(sum(n * m) as bigint) as n from pc{_tag} join {_samples} using (s) group by 1"),
    ]

_NAMES = {name for name, _, _ in PARTS}


def _used(text: str) -> set[str]:
    return _NAMES & set(re.findall(r"[a-z_][a-z_0-9]*", text))


def sql(tail: str) -> str:
    """``tail`` with the table expressions it builds on."""
    bodies = {name: body for name, _, body in PARTS}
    needed, todo = set(), _used(tail)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= _used(bodies[name]) - needed
    chosen = []
    for name, clause, body in PARTS:
        if name in needed:
            recursive = bool(re.search(rf"\b{name}\b", body))
            chosen.append(f"{name}{clause or ''} as {'' if recursive else 'materialized '}({body})")
    return f"with recursive {', '.join(chosen)} {tail}" if chosen else tail


def boxed(counts: str, cell: str, b: int) -> str:
    """Box sum of radius ``b`` of a sparse count table, as a sub-query (cell_id, n)."""
    return (f"(select (cell // 40 + dr) * 40 + cell % 40 + dc as cell_id, sum(n) as n from (select {cell} as cell, n from {counts}), "
            f"(select unnest(generate_series(-{b}, {b})) as dr) a, (select unnest(generate_series(-{b}, {b})) as dc) d, g "
            "where cell // 40 + dr between 0 and nrows - 1 and cell % 40 + dc between 0 and 39 group by 1)")
