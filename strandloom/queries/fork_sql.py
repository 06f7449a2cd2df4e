"""SQL for tracts, initiations and terminations: what plans/forks.py does with a read, as recursive CTEs over all reads.

Each decision that sees earlier ones is a recursion: corners a level at a time, spikes a corner at a time, tracts that end with an unused
fall one fall at a time, overlaps one removal at a time, and pairs of neighbours one pair at a time. Tracts are lists of structs: s and e are
start and end, d the direction, c the score, j the jump's. Reads are numbers r; lists count from 1, and n, i and k from 0.
"""

from __future__ import annotations

from strandloom.plans.forks import Settings

#: CTEs that take the scaled signal of each read (r, i, x, yr) to its corner points, with narrow spikes flattened.
CORNERS = """seg as (select r, min(i) as a, max(i) as b from scaled group by r union all
      select r, unnest([a, far]), unnest([far, b]) from (select r, a, b, arg_max(i, {{'d': d, 'i': -i}}) as far, max(d) as d from (
        select g.r, g.a, g.b, p.i, abs((q.x - o.x) * (p.yr - o.yr) - (q.yr - o.yr) * (p.x - o.x)) / sqrt((q.x - o.x) * (q.x - o.x) + (q.yr - o.yr) * (q.yr - o.yr)) as d
        from seg g join scaled o on o.r = g.r and o.i = g.a join scaled q on q.r = g.r and q.i = g.b join scaled p on p.r = g.r and p.i > g.a and p.i < g.b) group by all) where d > {tolerance}),
    corner as (select r, x, yr as y, row_number() over (partition by r order by x) - 1 as n from scaled join (select r, a as i from seg union select r, b from seg) using (r, i)),
    near as (select *, lead(y) over w as y1, abs(lead(x) over w - lag(x) over w) as wide from corner window w as (partition by r order by n)),
    flat as (select r, n, x, y from near where n = 0 union all
      select w.r, w.n, w.x, case when w.wide < {spike} and abs(w.y1 - f.y) < 0.3::double and greatest(abs(w.y1 - w.y), abs(f.y - w.y)) > 0.6::double then (f.y + w.y1) / 2 else w.y end
      from flat f join near w on w.r = f.r and w.n = f.n + 1),
    line as (select r, list(x order by n) as x, list(y order by n) as y, count(*) - 1 as last from flat group by r having count(*) > 2)"""

#: Tracts that open with a rise: each by itself, then those of one end after an undecided one take its place, but keep its jump.
FORWARD = """rise as (select *, y[i + 2] - y[i + 1] as a, y[i + 3] - y[i + 2] as b from (select *, unnest(range(last - 1)) as i from line)),
    fall as (select *, list_filter(range(i + 2, last + 1), lambda q: y[q + 1] < y[i + 2] - {far})[1] - 1 as k0 from rise where a > {jump} or (a <= {jump} and b <= {jump} and a + b > {jump})),
    two as (select *, y[k0 + 1] - y[i + 2] as before, k0 + (k0 + 1 < last and y[k0 + 3] - y[k0 + 2] < 0 and (y[k0 + 3] - y[k0 + 2]) / (x[k0 + 3] - x[k0 + 2]) * 1e5 < -50)::int as k from fall where k0 is not null),
    top as (select *, 10 * (greatest(a, a + b, y[k + 1] - y[k + 2] - before) - {jump}) as j, i + list_position(y[i + 1:k + 1], list_max(y[i + 1:k + 1])) as t from two),
    side as (select *, (y[t] - y[i + 1]) / (x[t] - x[i + 1]) * 1e5 as up, (y[k + 2] - y[t]) / (x[k + 2] - x[t]) * 1e5 as down, y[k + 2] - y[i + 1] as gain from top),
    way as (select *, -1.5 * down < up or (gain > 0.075::double and k + 1 <> last) as rt, 1.5 * up < -down or (-gain > 0.075::double and i <> 0) as lt from side),
    opened as (select r, i, k, x[i + 1] as s, x[k + 2] as e, j, case when rt and not lt then 'R' when lt and not rt then 'L' else '?' end as d,
      case when rt and not lt then greatest(up / -down, 20 * gain) when lt and not rt then least(down / up, 20 * gain) else 0 end as c from way),
    told as (select *, (lag(e) over w is distinct from e or lag(d) over w <> '?')::int as new from opened window w as (partition by r order by i)),
    run as (select *, sum(new) over (partition by r order by i) as g from told),
    merged as (select r, g, arg_max(s, i) as s, arg_max(e, i) as e, arg_max(d, i) as d, arg_max(c, i) as c, arg_min(j, i) as j from run group by r, g),
    begun as (select r, list({{'s': s, 'e': e, 'd': d, 'c': c, 'j': j}} order by g) as l from merged group by r)"""

#: Tracts that end with a fall not used so far, in the order of the falls, each against all tracts there are at that time.
BACKWARD = """unused as (select *, y[k + 1] - y[k + 2] as a, y[k + 2] - y[k + 3] as b from (select *, unnest(range(last - 1)) as k from line) where (r, k) not in (select (r, k) from opened)),
    low as (select *, list_filter(range(k), lambda q: y[k + 1] - y[q + 1] > {far})[-1] as i from unused where a > {jump} or (a <= {jump} and b <= {jump} and a + b > {jump})),
    high as (select *, i + list_position(y[i + 1:k + 1], list_max(y[i + 1:k + 1])) as t from low where i is not null),
    slopes as (select *, (y[t] - y[i + 1]) / (x[t] - x[i + 1]) * 1e5 as up, (y[k + 2] - y[t]) / (x[k + 2] - x[t]) * 1e5 as down, y[k + 2] - y[i + 1] as gain from high),
    closed as (select r, row_number() over (partition by r order by k) as n, x[i + 1] as s, x[k + 2] as e, 10 * (greatest(a, a + b, y[k + 1] - y[i + 1]) - {jump}) as j,
      least(down / up, case when k + 1 = last or i = 0 then 0 else 20 * gain end) as c, -gain > 0.075::double or 1.5 * up < -down as sure from slopes),
    held as (select r, 0::bigint as n, coalesce(l, []) as l from line left join begun using (r) union all
      select r, n, case fate when 'lost' then l else l[:place - 1] || [{{'s': s, 'e': e, 'd': case when fate = 'won' and sure then 'L' else '?' end, 'c': case when fate = 'won' and sure then c else 0 end, 'j': j}}] || l[place + over:] end
      from (select * replace (case when not same then fate when l[m].d = 'R' then case when -2 * c <= l[m].c then 'lost' when -c < 2 * l[m].c then 'doubt' else 'won' end when l[m].d = '?' then 'doubt' when l[m].c < c then 'lost' else fate end as fate)
      from (select *, case when behind then len(l) + 1 else coalesce(m, len(l)) end as place, case when behind then 0 when m is null or same then 1 else 0 end as over,
        case when behind or rival is null then 'won' when -2 * c <= rival.c then 'lost' when -c < 2 * rival.c then 'doubt' else 'won' end as fate
      from (select *, coalesce(not behind and s = l[m].s, false) as same, list_filter(l[:coalesce(m - 1, len(l))], lambda o: s < o.s and o.d = 'R')[-1] as rival
      from (select h.r, t.n, h.l, t.s, t.e, t.j, t.c, t.sure, len(h.l) = 0 or coalesce(t.s > h.l[-1].s, false) as behind,
        list_filter(range(1, len(h.l) + 1), lambda p: t.s = h.l[p].s or (t.s < h.l[p].s and t.e <= h.l[p].s))[1] as m from held h join closed t on t.r = h.r and t.n = h.n + 1))))),
    all_tracts as (select r, arg_max(l, n) as l from held group by r),
    free as (select r, l from all_tracts union all select r, l[:out - 1] || l[out + 1:]
      from (select *, case when abs(l[p.a].c) > abs(l[p.b].c) then p.b else p.a end as out
      from (select r, l, flatten(list_transform(range(1, len(l) + 1), lambda a: list_transform(list_filter(range(1, len(l) + 1), lambda b: b <> a and l[b].s <= l[a].s and l[a].s < l[b].e), lambda b: {{'a': a, 'b': b}})))[1] as p from free)
      where p is not null)),
    apart as (select r, arg_min(l, len(l)) as l from free group by r)"""

#: Initiations, a pair of neighbours at a time as their directions follow, and terminations.
EVENTS = """track as (select r, list(x order by i) as px, list(yr order by i) as py from scaled group by r),
    step as (select r, 0::bigint as p, l, px, py, [] :: struct(mid double, s1 double, e1 double, s2 double, e2 double)[] as f from apart join track using (r) union all
      select r, p + 1, case when hit then l[:p] || [case when a.d = 'L' then a else {{'s': a.s, 'e': a.e, 'd': 'L', 'c': 5::double, 'j': 5::double}} end, case when b.d = 'R' then b else {{'s': b.s, 'e': b.e, 'd': 'R', 'c': 5::double, 'j': 5::double}} end] || l[p + 3:] else l end,
        px, py, case when hit then list_append(f, {{'mid': (a.e + b.s) / 2, 's1': a.s, 'e1': a.e, 's2': b.s, 'e2': b.e}}) else f end
      from (select *, {inits} and b.s - a.e > {distance} and coalesce(list_avg(py[least(p0, p1):greatest(p0, p1) - 1]) < {low}, false) as hit
      from (select *, list_position(px, a.e) as p0, list_position(px, b.s) as p1 from (select *, l[p + 1] as a, l[p + 2] as b from step where p + 1 < len(l))))),
    told_tracts as (select r, arg_max(l, p) as l, arg_max(f, p) as inits from step group by r),
    ends as (select r, l, inits, list_transform(list_filter(list_transform(range(1, greatest(1, len(l))), lambda p: {{'a': l[p], 'b': l[p + 1]}}), lambda p: {terms}
        and least(py[{left}], py[{left_beyond}]) < {low} and least(py[{right}], py[{right_beyond}]) < {low}), lambda p: {{'mid': (p.a.s + p.b.e) / 2, 's1': p.a.s, 'e1': p.a.e, 's2': p.b.s, 'e2': p.b.e}}) as terms
      from told_tracts join track using (r))"""


def _faces(sure: str, other: str, way: str, s: Settings, loose: bool) -> str:
    sign, opposite = ("-", "R") if way == "L" else ("", "L")
    doubt = "true" if loose else f"abs({other}.c) < {s.score}"
    return f"({sure}.d = '{way}' and {sign}({sure}.c) > {s.score} and ({other}.d = '{opposite}' or (abs({sure}.j) > {s.jump_score} and abs({other}.j) > {s.jump_score} and {doubt})))"


def _pair(a: str, b: str, first: str, second: str, s: Settings) -> str:
    strong = f"least(abs({a}.j), abs({b}.j)) > {s.jump_score / 3!r}::double"
    return f"({strong} and ({_faces(a, b, first, s, first == 'R' and not s.mirror)} or {_faces(b, a, second, s, second == 'R' and not s.mirror)}))"


def _closest(at: str) -> str:
    """Place of the position nearest to at, the first of equal ones."""
    away = f"list_transform(px, lambda v: abs(v - ({at})))"
    return f"list_position({away}, list_min({away}))"


def fork_sql(signal: str, s: Settings) -> str:
    """CTEs, after the word recursive, down to ends (r, l, inits, terms): the tracts, initiations and terminations of reads of signal, a select of (r, idx, x, y)."""
    n = s.smoothing
    scaled = f"""recursive known as ({signal}), ok as (select r from known group by r having stddev_pop(y) > {s.min_std}),
    smooth as (select r, idx, x, (sum(y) over (partition by r order by idx rows between current row and {n - 1} following) + sum(y) over (partition by r order by idx rows between {n - 1} preceding and current row)) / {2 * n} as y from known where r in (from ok)),
    reach as (select r, min(y) as lo, max(y) - min(y) as wide from smooth group by r),
    scaled as (select r, row_number() over (partition by r order by idx) - 1 as i, x, (y - lo) / wide as yr from smooth join reach using (r) where wide > {s.min_amplitude})"""
    limits = {
        "tolerance": s.tolerance, "spike": s.spike, "jump": f"{s.min_jump!r}::double", "far": f"{0.6 * s.min_jump!r}::double",
        "inits": _pair("a", "b", "L", "R", s), "terms": _pair("p.a", "p.b", "R", "L", s), "distance": s.min_distance, "low": f"{s.low_plateau!r}::double",
        "left": _closest("p.a.s"), "left_beyond": _closest(f"p.a.s - {s.flank}"), "right": _closest("p.b.e"), "right_beyond": _closest(f"p.b.e + {s.flank}"),
    }
    return ",\n    ".join([scaled, *(part.format(**limits) for part in (CORNERS, FORWARD, BACKWARD, EVENTS))])
