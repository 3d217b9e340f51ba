"""DuckDB statements of the registered queries, written apart from the operators (windows by offsets, not dilation; plain joins)."""

from __future__ import annotations

from . import fixtures
from .params import COARSE, Params
from .plans.experiments import draw_trials

P, G = Params(grid=COARSE), COARSE
#: The queries' parameters: angles that reach over the window of a coarse pixel, so that the sparse fixture has hits.
EVENTS = P.with_(detail_h=2.5 * G.h_res, detail_v=1.5 * G.v_res)
WIDE = P.with_(mcc_h=1.25 * G.h_res, mcc_v=1.25 * G.v_res)
#: Refinement works on object-sized neighbourhoods.
CLUSTERS = P.with_(cluster_epsilon=0.7, cluster_least=5)
#: Values of the threshold sweeps: 30 tolerances of the coarse pass, 30 thresholds of map consistency (in no order).
EPSILONS, THRESHOLDS = [round(0.05 * (7 * i % 30), 2) for i in range(30)], [round(0.0353 * (11 * i % 30) + 0.013, 4) for i in range(30)]
#: The trials of ``hyperband``: 9, 5 and 3 of them start with 1, 3 and 9 sweeps.
BUDGET, DRAWN = 9, draw_trials(17, {"epsilon": (0.02, 1.0), "vote": range(1, 10)}, seed=7)
#: Sweeps that the ground truth of ``evaluate_covered`` was made for, and where it found anything.
COVERED, FOUND = "scene_id = 1 or sweep_idx < 18", "not (scene_id = 1 and sweep_idx = 12)"


def _d(x: float) -> str:
    return f"{x!r}::double"


def _eps(depth: str, base: float, a) -> str:
    return f"greatest({_d(a.least)}, least({_d(a.most)}, case when {depth} > {_d(a.threshold)} then {_d(base)} * (1 + {_d(a.slope)} * ({depth} - {_d(a.threshold)})) else {_d(base)} end))"


def _projected(source: str, keys: str) -> str:
    """CTE body: rows of ``source`` (gx, gy, gz, scene_id, di) in image di."""
    edge = 1e-6
    fov = f"phi between {_d(G.phi_min - edge)} and {_d(G.phi_max + edge)} and theta between {_d(G.theta_min - edge)} and {_d(G.theta_max + edge)}"
    return f"""(
  select {keys}, depth, phi, theta, coalesce({fov}, false) as in_fov,
    case when {fov} then greatest(0, least({G.height - 1}, floor((theta - {_d(G.theta_min)}) / {_d(G.v_res)})::int)) end as v,
    case when {fov} then greatest(0, least({G.width - 1}, floor((phi - {_d(G.phi_min)}) / {_d(G.h_res)})::int)) end as h
  from (select {keys}, depth, case when depth > 1e-6 then atan2(ly, lx) end as phi, case when depth > 1e-6 then asin(greatest(-1, least(1, lz / depth))) end as theta
    from (select *, sqrt(lx * lx + ly * ly + lz * lz) as depth
      from (select q.*, r00 * q.gx + r10 * q.gy + r20 * q.gz - (r00 * tx + r10 * ty + r20 * tz) as lx, r01 * q.gx + r11 * q.gy + r21 * q.gz - (r01 * tx + r11 * ty + r21 * tz) as ly,
              r02 * q.gx + r12 * q.gy + r22 * q.gz - (r02 * tx + r12 * ty + r22 * tz) as lz
            from {source} q join sweeps s on s.scene_id = q.scene_id and s.sweep_idx = q.di))))"""


_BASE = f"""with sweeps as materialized ({fixtures.SWEEPS_DUCK}),
points as materialized ({fixtures.POINTS_DUCK}),
kept as (select *, sqrt(x * x + y * y + z * z) as rng from points where sqrt(x * x + y * y + z * z) between {_d(P.min_range)} and {_d(P.max_range)}),
gpoints as materialized (select k.scene_id, k.sweep_idx, k.point_idx, k.x, k.y, k.z, k.rng, r00 * x + r01 * y + r02 * z + tx as gx, r10 * x + r11 * y + r12 * z + ty as gy, r20 * x + r21 * y + r22 * z + tz as gz
  from kept k join sweeps using (scene_id, sweep_idx))"""
_OWN = f"""{_BASE},
own_in as (select *, sweep_idx as di from gpoints),
own as materialized {_projected("own_in", "scene_id, sweep_idx, point_idx, di")},
image as materialized (select scene_id, di, v, h, min(depth) as min_depth, max(depth) as max_depth, count(*) as n from own where in_fov group by all)"""
_OFFSETS = f"(select * from (select unnest(range({-P.window_v}, {P.window_v + 1})) as dv) cross join (select unnest(range({-P.window_h}, {P.window_h + 1})) as dh))"
_DILATED = f"""{_OWN},
cells as (select unnest(range({G.height})) as v), columns_ as (select unnest(range({G.width})) as h),
dilated as materialized (select i.scene_id, i.di, c.v, k.h, min(min_depth) as min_depth, max(max_depth) as max_depth, sum(n)::bigint as n
  from image i join cells c on c.v between i.v - {P.window_v} and i.v + {P.window_v} join columns_ k on k.h between i.h - {P.window_h} and i.h + {P.window_h} group by all)"""
_COARSE_LABELS = f"""{_DILATED},
steps as (select unnest(range(1, {P.frames + 1})) as k),
asked as (select g.*, k, g.sweep_idx - k as di from gpoints g, steps where g.sweep_idx >= {P.init_sweeps - 1} and g.sweep_idx - k >= 0
  and exists (select 1 from gpoints o where o.scene_id = g.scene_id and o.sweep_idx = g.sweep_idx - k)),
seen as materialized {_projected("asked", "scene_id, sweep_idx, point_idx, k, di")},
around as (select s.scene_id, s.sweep_idx, s.point_idx, s.k, any_value(s.in_fov) as in_fov, any_value(s.depth) as depth, min(i.min_depth) as least
  from seen s left join {_OFFSETS} o on s.in_fov left join image i on i.scene_id = s.scene_id and i.di = s.di and i.v = s.v + o.dv and i.h = s.h + o.dh group by all),
coarse as materialized (select scene_id, sweep_idx, point_idx, k, case when not in_fov then 1 when least is null then 2 when depth < least - {_d(P.epsilon)} then 0 else 1 end::tinyint as label from around)"""
_VOTED = f"""{_COARSE_LABELS},
votes as (select scene_id, sweep_idx, point_idx, max(label) filter (k = 1) as previous, count(*) filter (label = 0) as votes from coarse group by all),
voted as materialized (select g.scene_id, g.sweep_idx, g.point_idx, (case when votes >= {P.vote} then 0 else coalesce(previous, 3) end)::tinyint as label
  from gpoints g left join votes using (scene_id, sweep_idx, point_idx) where g.sweep_idx >= {P.init_sweeps - 1})"""
_BOXES = f""",
ann as materialized (select *, row_number() over (partition by scene_id, instance_id order by ts_us) as r from ({fixtures.ANNOTATIONS_DUCK})),
vel as materialized (select a.*,
    coalesce(case when n.ts_us - p.ts_us <= 3000000 and n.ts_us - p.ts_us > 1000 then (n.tx - p.tx) / ((n.ts_us - p.ts_us) / 1e6) end, case when a.ts_us - p.ts_us > 1000 then (a.tx - p.tx) / ((a.ts_us - p.ts_us) / 1e6) end, case when n.ts_us - a.ts_us > 1000 then (n.tx - a.tx) / ((n.ts_us - a.ts_us) / 1e6) end, 0) as vx,
    coalesce(case when n.ts_us - p.ts_us <= 3000000 and n.ts_us - p.ts_us > 1000 then (n.ty - p.ty) / ((n.ts_us - p.ts_us) / 1e6) end, case when a.ts_us - p.ts_us > 1000 then (a.ty - p.ty) / ((a.ts_us - p.ts_us) / 1e6) end, case when n.ts_us - a.ts_us > 1000 then (n.ty - a.ty) / ((n.ts_us - a.ts_us) / 1e6) end, 0) as vy, 0::double as vz
  from ann a left join ann p on p.scene_id = a.scene_id and p.instance_id = a.instance_id and p.r = a.r - 1 left join ann n on n.scene_id = a.scene_id and n.instance_id = a.instance_id and n.r = a.r + 1),
pairs as (select s.scene_id, s.sweep_idx, s.ts_us as t, i.instance_id from sweeps s join (select distinct scene_id, instance_id from ann) i using (scene_id)),
found as (select q.*, (select max(ts_us) from ann a where a.scene_id = q.scene_id and a.instance_id = q.instance_id and a.ts_us <= t) as pt, (select min(ts_us) from ann a where a.scene_id = q.scene_id and a.instance_id = q.instance_id and a.ts_us >= t) as nt from pairs q),
joined as (select f.scene_id, f.sweep_idx, f.instance_id, f.t, f.pt, f.nt, p.tx as px, p.ty as py, p.tz as pz, p.qw as pw, p.qz as pq, n.tx as nx, n.ty as ny, n.tz as nz, n.qw as nw, n.qz as nq, coalesce(p.vx, n.vx) as ex, coalesce(p.vy, n.vy) as ey,
    coalesce(p.w, n.w) as w, coalesce(p.l, n.l) as l, coalesce(p.h, n.h) as h
  from found f left join vel p on p.scene_id = f.scene_id and p.instance_id = f.instance_id and p.ts_us = f.pt left join vel n on n.scene_id = f.scene_id and n.instance_id = f.instance_id and n.ts_us = f.nt),
methods as (select *, case when pt = t then 'exact' when pt is not null and nt is not null then 'interpolated' when abs(t - coalesce(pt, nt)) <= {P.extrapolate_us} then 'extrapolated' end as method, (t - pt) / (nt - pt)::double as f,
    case when pw * nw + pq * nq < 0 then -1 else 1 end as sg, least(abs(pw * nw + pq * nq), 1) as c from joined),
turned as (select *, case when c > 0.9995 then 1 - f else sin((1 - f) * acos(c)) / sin(acos(c)) end as wa, sg * case when c > 0.9995 then f else sin(f * acos(c)) / sin(acos(c)) end as wb from methods where method is not null),
raw as (select *, wa * pw + wb * nw as aw, wa * pq + wb * nq as aq from turned),
boxes as materialized (select scene_id, sweep_idx, instance_id, method, w, l, h,
    case method when 'exact' then px when 'interpolated' then px + (nx - px) * f else coalesce(px, nx) + ex * ((t - coalesce(pt, nt)) / 1e6) end as tx,
    case method when 'exact' then py when 'interpolated' then py + (ny - py) * f else coalesce(py, ny) + ey * ((t - coalesce(pt, nt)) / 1e6) end as ty,
    coalesce(pz, nz) as tz, case when method = 'interpolated' then (nx - px) / ((nt - pt) / 1e6) else ex end as vx, case when method = 'interpolated' then (ny - py) / ((nt - pt) / 1e6) else ey end as vy, 0::double as vz,
    case when method = 'interpolated' then aw / sqrt(aw * aw + aq * aq) else coalesce(pw, nw) end as qw, 0::double as qx, 0::double as qy, case when method = 'interpolated' then aq / sqrt(aw * aw + aq * aq) else coalesce(pq, nq) end as qz from raw),
inside as materialized (select distinct g.scene_id, g.sweep_idx, g.point_idx, sqrt(b.vx * b.vx + b.vy * b.vy) >= {_d(P.speed_threshold)} as moves
  from gpoints g join boxes b using (scene_id, sweep_idx)
  where abs((1 - 2 * b.qz * b.qz) * (gx - b.tx) + 2 * b.qz * b.qw * (gy - b.ty)) <= b.l / 2 and abs(-2 * b.qz * b.qw * (gx - b.tx) + (1 - 2 * b.qz * b.qz) * (gy - b.ty)) <= b.w / 2 and abs(gz - b.tz) <= b.h / 2),
gt as materialized (select distinct scene_id, sweep_idx, point_idx from inside where moves)"""
_MATCHED = f"""{_VOTED}{_BOXES},
matched as materialized (select v.*, g.point_idx is not null as is_gt from voted v left join gt g using (scene_id, sweep_idx, point_idx)),
conf as (select scene_id, sweep_idx, count(*) filter (label = 0 and is_gt) as tp, count(*) filter (label = 0 and not is_gt) as fp, count(*) filter (label <> 0 and is_gt) as fn, count(*) filter (label <> 0 and not is_gt) as tn from matched group by all)"""
_IOU = "round(case when tp + fp + fn > 0 then tp / (tp + fp + fn)::double else 0 end, 6) as iou"
_TRIALS = f"""{_MATCHED},
trials as (select unnest(range(9)) as trial_id, unnest(range(1, 10)) as vote),
tried as (select t.trial_id, t.vote, case when v.votes >= t.vote then 0 else coalesce(v.previous, 3) end as label, g.point_idx is not null as is_gt from votes v cross join trials t left join gt g using (scene_id, sweep_idx, point_idx)),
scored as (select trial_id::int as trial_id, vote::int as vote, count(*) filter (label = 0 and is_gt) as tp, count(*) filter (label = 0 and not is_gt) as fp, count(*) filter (label <> 0 and is_gt) as fn, count(*) filter (label <> 0 and not is_gt) as tn from tried group by all)"""
_DISK = f"""{_BASE},
disk as (select *, row_number() over (partition by scene_id, sweep_idx order by point_idx) - 1 as rk, count(*) over (partition by scene_id, sweep_idx) as cnt from kept where x * x + y * y <= {_d(P.ground_radius**2)} and z between {_d(P.ground_z_min)} and {_d(P.ground_z_max)}),
tr as (select distinct scene_id, sweep_idx, cnt, trial from disk, (select unnest(range({P.ground_trials})) as trial) where cnt >= 3),
rk as (select *, (scene_id * 7919 + sweep_idx * 104729 + trial * 1299709 + 12345) % 2147483647 % cnt as k0, (scene_id * 7919 + sweep_idx * 104729 + trial * 1299709 + 15485863 + 12345) % 2147483647 % cnt as k1, (scene_id * 7919 + sweep_idx * 104729 + trial * 1299709 + 30971726 + 12345) % 2147483647 % cnt as k2 from tr),
tri as (select r.scene_id, r.sweep_idx, r.trial, a.x as x0, a.y as y0, a.z as z0, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as wx, c.y - a.y as wy, c.z - a.z as wz
  from rk r join disk a on a.scene_id = r.scene_id and a.sweep_idx = r.sweep_idx and a.rk = k0 join disk b on b.scene_id = r.scene_id and b.sweep_idx = r.sweep_idx and b.rk = k1 join disk c on c.scene_id = r.scene_id and c.sweep_idx = r.sweep_idx and c.rk = k2),
nrm as (select *, uy * wz - uz * wy as m0, uz * wx - ux * wz as m1, ux * wy - uy * wx as m2 from tri),
pln as (select scene_id, sweep_idx, trial, m0 / s * g as nx, m1 / s * g as ny, m2 / s * g as nz, -(m0 / s * g * x0 + m1 / s * g * y0 + m2 / s * g * z0) as d from (select *, sqrt(m0 * m0 + m1 * m1 + m2 * m2) as s, case when m2 < 0 then -1 else 1 end as g from nrm) where s > 1e-6),
inl as (select p.scene_id, p.sweep_idx, p.trial, any_value(nx) as nx, any_value(ny) as ny, any_value(nz) as nz, any_value(d) as d, count(*) filter (abs(nx * x + ny * y + nz * z + d) <= {_d(P.ground_inlier)}) as inliers from pln p join disk using (scene_id, sweep_idx) group by p.scene_id, p.sweep_idx, p.trial),
best as (select * from inl qualify row_number() over (partition by scene_id, sweep_idx order by inliers desc, trial) = 1)"""

_ID = "scene_id, sweep_idx, point_idx"


def _surfaces(name: str, gaps: str, a: Params) -> str:
    """CTEs: surface depth (``name``) at each row of ``gaps`` (point, di, phi, theta) from the first of the triplets of near static points that encloses it."""
    return f"""
{name}_ranked as (select g.{_ID.replace(", ", ", g.")}, g.di, g.phi, g.theta, s_phi, s_theta, s_depth, row_number() over (partition by g.scene_id, g.sweep_idx, g.point_idx, g.di order by abs(g.phi - s_phi) + abs(g.theta - s_theta), static_idx) - 1 as r
  from {gaps} g join static s on s.scene_id = g.scene_id and s.di = g.di and abs(g.phi - s_phi) <= {_d(a.mcc_h)} and abs(g.theta - s_theta) <= {_d(a.mcc_v)} qualify r < {a.mcc_neighbours}),
{name}_near as materialized (select *, count(*) over (partition by {_ID}, di) as n from {name}_ranked),
{name}_combos as (select n, i, j, k, row_number() over (partition by n order by i, j, k) - 1 as trial from (select unnest(range(3, {a.mcc_neighbours + 1})) as n), (select unnest(range({a.mcc_neighbours})) as i), (select unnest(range({a.mcc_neighbours})) as j), (select unnest(range({a.mcc_neighbours})) as k) where i < j and j < k and k < n qualify trial < {a.mcc_triplets}),
{name}_tried as (select a.{_ID.replace(", ", ", a.")}, a.di, trial, a.s_depth as da, b.s_depth as db, c.s_depth as dc, a.phi - a.s_phi as x, a.theta - a.s_theta as y, b.s_phi - a.s_phi as bx, b.s_theta - a.s_theta as by_, c.s_phi - a.s_phi as cx, c.s_theta - a.s_theta as cy
  from {name}_near a join {name}_combos t on t.n = a.n and t.i = a.r join {name}_near b on b.scene_id = a.scene_id and b.sweep_idx = a.sweep_idx and b.point_idx = a.point_idx and b.di = a.di and b.r = t.j join {name}_near c on c.scene_id = a.scene_id and c.sweep_idx = a.sweep_idx and c.point_idx = a.point_idx and c.di = a.di and c.r = t.k),
{name}_parts as (select *, (x * cy - cx * y) / nullif(bx * cy - cx * by_, 0) as wb, (bx * y - x * by_) / nullif(bx * cy - cx * by_, 0) as wc from {name}_tried),
{name} as materialized (select {_ID}, di, min_by((1 - wb - wc) * da + wb * db + wc * dc, trial) as surface from {name}_parts where wb >= -1e-9 and wc >= -1e-9 and 1 - wb - wc >= -1e-9 group by all)"""


def _labelling(gap: bool) -> str:
    """CTEs from the points to the labels after each stage; ``gap``: without one sweep."""
    base = _VOTED.replace(f"({fixtures.POINTS_DUCK})", f"(select * from ({fixtures.POINTS_DUCK}) where not (scene_id = 1 and sweep_idx = 14))") if gap else _VOTED
    back, ahead = _eps("c.rng", P.mcc_backward, P.mcc_backward_adaptive), _eps("c.rng", P.mcc_forward, P.mcc_forward_adaptive)
    detail = _eps("c.rng", EVENTS.detail_epsilon, EVENTS.detail_adaptive) if EVENTS.detail_adaptive.enabled else _d(EVENTS.detail_epsilon)
    ready = "exists (select 1 from gpoints o where o.scene_id = c.scene_id and o.sweep_idx = c.sweep_idx - k)"
    return f"""{base}{_DISK.removeprefix(_BASE)},
ground as materialized (select {_ID} from best b join kept k using (scene_id, sweep_idx) where abs(nx * x + ny * y + nz * z + d) <= {_d(P.ground_distance)}),
static as materialized (select scene_id, di, point_idx as static_idx, phi as s_phi, theta as s_theta, depth as s_depth, v as s_v, h as s_h from own o where in_fov and sweep_idx >= {P.init_sweeps - 1} and exists (select 1 from ground g where g.scene_id = o.scene_id and g.sweep_idx = o.sweep_idx and g.point_idx = o.point_idx)),
first as materialized (select v.* from voted v anti join ground using (scene_id, sweep_idx, point_idx) union all select {_ID}, 4::tinyint as label from ground where sweep_idx >= {P.init_sweeps - 1}),
m_asked as (select c.*, k, c.sweep_idx - k as di from (select g.* from gpoints g join first f using (scene_id, sweep_idx, point_idx) where f.label = 0) c, (select unnest(range({P.mcc_sweeps})) as k) where c.sweep_idx >= k and {ready}),
m_seen as materialized {_projected("m_asked", "scene_id, sweep_idx, point_idx, rng, di")},
m_in as materialized (select c.*, exists (select 1 from image i where i.scene_id = c.scene_id and i.di = c.di and i.v = c.v and i.h = c.h) as full_ from m_seen c where in_fov),
m_checked as materialized (select * from m_in c where exists (select 1 from static s where s.scene_id = c.scene_id and s.di = c.di)),
m_gaps as (select * from m_checked where not full_), m_wide as (select * from m_in where not full_),{_surfaces("surf", "m_gaps", P)},
m_hit as (select c.scene_id, c.sweep_idx, c.point_idx, c.di from m_checked c join static s on s.scene_id = c.scene_id and s.di = c.di and abs(c.phi - s_phi) <= {_d(P.mcc_h)} and abs(c.theta - s_theta) <= {_d(P.mcc_v)} where full_ and c.depth >= s_depth - {back} and c.depth <= s_depth + {ahead}
  union select c.scene_id, c.sweep_idx, c.point_idx, c.di from m_gaps c join surf s using (scene_id, sweep_idx, point_idx, di) where c.depth >= surface - {back} and c.depth <= surface + {ahead}),
m_score as materialized (select {_ID}, coalesce(checked, 0) as checked, coalesce(matched, 0) as matched, case when checked > 0 then coalesce(matched, 0) / checked::double else 0 end as score
  from (select {_ID} from first where label = 0) left join (select {_ID}, count(*) as checked from m_checked group by all) using (scene_id, sweep_idx, point_idx) left join (select {_ID}, count(*) as matched from m_hit group by all) using (scene_id, sweep_idx, point_idx)),
mapped as materialized (select f.scene_id, f.sweep_idx, f.point_idx, case when m.score >= {_d(P.mcc_threshold)} then 1 else f.label end::tinyint as label from first f left join m_score m using (scene_id, sweep_idx, point_idx)),
a_asked as (select c.*, k, c.sweep_idx - k as di from (select g.*, f.label as first_label from gpoints g join first f using (scene_id, sweep_idx, point_idx) join mapped m using (scene_id, sweep_idx, point_idx) where m.label = 1) c, (select unnest(range(1, {P.parallel_sweeps + 1})) as k) where c.sweep_idx >= k),
a_seen as materialized {_projected("a_asked", "scene_id, sweep_idx, point_idx, rng, first_label, di")},
a_near as (select c.scene_id, c.sweep_idx, c.point_idx, c.di, arg_min({{'v': i.v, 'h': i.h, 'most': i.max_depth}}, i.min_depth) as b from a_seen c join {_OFFSETS} o on c.in_fov join image i on i.scene_id = c.scene_id and i.di = c.di and i.v = c.v + o.dv and i.h = c.h + o.dh group by all),
a_ok as (select c.*, coalesce(abs(phi - ({_d(G.phi_min)} + (b.h + 0.5) * {_d(G.h_res)})) <= {_d(EVENTS.detail_h)} and abs(theta - ({_d(G.theta_min)} + (b.v + 0.5) * {_d(G.v_res)})) <= {_d(EVENTS.detail_v)} and depth > b.most + {detail}, false) as ok from a_seen c left join a_near using (scene_id, sweep_idx, point_idx, di)),
away as materialized (select {_ID}, any_value(first_label) as first_label from a_ok group by {_ID} having bool_and(ok)),
p_asked as (select c.*, k, c.sweep_idx - k as di from (select g.* from gpoints g join first f using (scene_id, sweep_idx, point_idx) where f.label = 3) c, (select unnest(range(1, {P.perpendicular_sweeps + 1})) as k) where c.sweep_idx >= k and {ready}),
p_seen as materialized {_projected("p_asked", "scene_id, sweep_idx, point_idx, rng, di")},
across as materialized (select distinct c.scene_id, c.sweep_idx, c.point_idx from p_seen c join static s on s.scene_id = c.scene_id and s.di = c.di and abs(s_v - c.v) <= {P.window_v} and abs(s_h - c.h) <= {P.window_h} where c.in_fov and abs(c.phi - s_phi) <= {_d(EVENTS.detail_h)} and abs(c.theta - s_theta) <= {_d(EVENTS.detail_v)} and c.depth < s_depth - {detail}),
final as materialized (select m.scene_id, m.sweep_idx, m.point_idx, case when a.point_idx is not null or c.point_idx is not null then 0 else m.label end::tinyint as label from mapped m left join away a using (scene_id, sweep_idx, point_idx) left join across c using (scene_id, sweep_idx, point_idx))"""


def _density(labels: str, epsilon: float = CLUSTERS.cluster_epsilon, least: int = CLUSTERS.cluster_least, tag: str = "") -> str:
    """CTEs (names with ``tag`` after them): clusters of the dynamic points of ``labels`` by closures of core points, noise dropped, hulls grown."""
    directions = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0), (1, 0, 1), (1, 0, -1), (0, 1, 1), (0, 1, -1), (1, 1, 1), (1, 1, -1), (1, -1, 1), (-1, 1, 1)]
    at = lambda d, t: f"({d[0]} * {t}.gx + {d[1]} * {t}.gy + {d[2]} * {t}.gz)"
    bounds = ", ".join(f"min({at(d, 'g')}) as lo{i}, max({at(d, 'g')}) as hi{i}" for i, d in enumerate(directions))
    inside = " and ".join(f"{at(d, 'g')} between lo{i} - 1e-9 and hi{i} + 1e-9" for i, d in enumerate(directions))
    return f""",
d_points{tag} as materialized (select g.* from gpoints g join {labels} l using (scene_id, sweep_idx, point_idx) where l.label = 0),
d_pairs{tag} as materialized (select a.scene_id, a.sweep_idx, a.point_idx, b.point_idx as other from d_points{tag} a join d_points{tag} b using (scene_id, sweep_idx) where (a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy) + (a.gz - b.gz) * (a.gz - b.gz) <= {_d(epsilon**2)}),
d_cores{tag} as materialized (select {_ID} from d_pairs{tag} group by all having count(*) >= {least}),
d_links{tag} as materialized (select p.* from d_pairs{tag} p join d_cores{tag} using (scene_id, sweep_idx, point_idx) join d_cores{tag} o on o.scene_id = p.scene_id and o.sweep_idx = p.sweep_idx and o.point_idx = p.other),
d_reach{tag} as (select * from d_links{tag} union select r.scene_id, r.sweep_idx, r.point_idx, l.other from d_reach{tag} r join d_links{tag} l on l.scene_id = r.scene_id and l.sweep_idx = r.sweep_idx and l.point_idx = r.other),
d_of{tag} as materialized (select {_ID}, min(other) as cluster from d_reach{tag} group by all),
clusters{tag} as materialized (select p.scene_id, p.sweep_idx, p.point_idx, min(o.cluster) as cluster from d_pairs{tag} p join d_of{tag} o on o.scene_id = p.scene_id and o.sweep_idx = p.sweep_idx and o.point_idx = p.other group by all),
quiet{tag} as materialized (select l.scene_id, l.sweep_idx, l.point_idx, case when l.label = 0 and c.cluster is null then 3 else l.label end::tinyint as label from {labels} l left join clusters{tag} c using (scene_id, sweep_idx, point_idx)),
hulls{tag} as materialized (select c.scene_id, c.sweep_idx, c.cluster, {bounds} from clusters{tag} c join gpoints g using (scene_id, sweep_idx, point_idx) group by all having count(*) >= 4 and hi0 > lo0 and hi1 > lo1 and hi2 > lo2),
grown{tag} as materialized (select distinct g.scene_id, g.sweep_idx, g.point_idx from gpoints g join hulls{tag} h using (scene_id, sweep_idx) where {inside}),
refined{tag} as materialized (select q.scene_id, q.sweep_idx, q.point_idx, case when g.point_idx is not null then 0 else q.label end::tinyint as label from quiet{tag} q left join grown{tag} g using (scene_id, sweep_idx, point_idx))"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


#: cluster_epsilon and cluster_least of the refinement's trials.
REFINEMENTS = ((0.5, 3), (0.7, 5), (1.2, 12))


def _refinements() -> str:
    parts = []
    for i, (epsilon, least) in enumerate(REFINEMENTS):
        parts.append(f", few{i} as (select scene_id, sweep_idx from final where label = 0 group by all having count(*) >= {least}), busy{i} as materialized (select * from final semi join few{i} using (scene_id, sweep_idx)){_density(f'busy{i}', epsilon, least, str(i))}")
    all_ = " union all ".join(f"select {i} as trial_id, {_d(e)} as cluster_epsilon, {n} as cluster_least, * from (select * from refined{i} union all select * from final anti join few{i} using (scene_id, sweep_idx))" for i, (e, n) in enumerate(REFINEMENTS))
    counts = "count(*) filter (label = 0 and g.point_idx is not null) as tp, count(*) filter (label = 0 and g.point_idx is null) as fp, count(*) filter (label <> 0 and g.point_idx is not null) as fn, count(*) filter (label <> 0 and g.point_idx is null) as tn"
    return f"{_recursive(_LABELS + ''.join(parts))}{_BOXES}, tried_all as ({all_}), conf as (select trial_id, cluster_epsilon, cluster_least, {counts} from tried_all l left join gt g using (scene_id, sweep_idx, point_idx) group by all) select *, {_IOU} from conf"


def _hyperband() -> str:
    """Each rung of each bracket (first trial, trials, budgets with how many go on) as a ranking of its own."""
    rungs, parts = [], []
    for b, (first, n, steps) in enumerate(((0, 9, ((1, 3), (3, 1), (9, 1))), (9, 5, ((3, 1), (9, 1))), (14, 3, ((9, 1),)))):
        before = f"(select unnest(range({first}, {first + n})) as trial_id)"
        for r, (budget, keep) in enumerate(steps):
            name = f"b{b}_{r}"
            parts.append(f"{name} as (select {b} as bracket, {r} as rung, {budget} as budget, trial_id, iou, row_number() over (order by iou desc, trial_id) <= {keep} as survives from (select trial_id, case when sum(tp + fp + fn) > 0 then sum(tp) / sum(tp + fp + fn)::double else 0 end as iou from per_sweep semi join {before} using (trial_id) where nth <= {budget} group by all))")
            rungs.append(f"select * from {name}")
            before = f"(select trial_id from {name} where survives)"
    u = lambda name: f"(('0x' || substr(md5('7:' || t || ':{name}'), 1, 8))::bigint / 4294967296.0::double)"
    return f"""{_VOTED}{_BOXES}, drawn as (select t as trial_id, 0.02::double + {u("epsilon")} * (1.0::double - 0.02::double) as epsilon, 1 + floor({u("vote")} * 9)::int as vote from (select unnest(range(17)) as t)),
      v as (select trial_id, scene_id, sweep_idx, point_idx, count(*) filter (in_fov and depth < least - epsilon) as n from around, drawn group by all),
      l as (select t.trial_id, p.sweep_idx, coalesce(v.n, 0) >= t.vote as dynamic, g.point_idx is not null as is_gt from voted p cross join drawn t left join v on v.trial_id = t.trial_id and v.scene_id = p.scene_id and v.sweep_idx = p.sweep_idx and v.point_idx = p.point_idx
        left join gt g on g.scene_id = p.scene_id and g.sweep_idx = p.sweep_idx and g.point_idx = p.point_idx),
      per_sweep as materialized (select trial_id, dense_rank() over (order by sweep_idx) as nth, count(*) filter (dynamic and is_gt) as tp, count(*) filter (dynamic and not is_gt) as fp, count(*) filter (not dynamic and is_gt) as fn from l group by trial_id, sweep_idx),
      {', '.join(parts)} select bracket::int as bracket, rung::int as rung, budget::int as budget, trial_id::int as trial_id, round(iou, 6) as iou, survives from ({' union all '.join(rungs)})"""


_LABELS, _GAP_LABELS = _labelling(False), _labelling(True)
_REFINED = _recursive(_VOTED + _density("voted"))
#: A sweep with too few dynamic points keeps its labels.
_FEW = f", few as (select scene_id, sweep_idx from final where label = 0 group by all having count(*) >= {CLUSTERS.cluster_least}), busy as materialized (select * from final semi join few using (scene_id, sweep_idx))"
_POINT_LABELS = _recursive(_LABELS + _FEW + _density("busy")) + ", labelled as materialized (select * from refined union all select * from final anti join few using (scene_id, sweep_idx))"

ORACLE_SQL = {
    "filter_range": f"{_BASE} select scene_id, sweep_idx, count(*) as n_kept from kept group by all",
    "to_global": f"{_BASE} select scene_id, sweep_idx, round(sum(gx), 3) as gx, round(sum(gy), 3) as gy, round(sum(gz), 3) as gz from gpoints group by all",
    "project_spherical": f"{_OWN} select scene_id, di, v, h, count(*) as n from own where in_fov group by all",
    "depth_image": f"{_OWN} select scene_id, di, v, h, round(min_depth, 6) as min_depth, round(max_depth, 6) as max_depth, n from image",
    "depth_image_dilated": f"{_DILATED} select scene_id, di, v::int as v, h::int as h, round(min_depth, 6) as min_depth, round(max_depth, 6) as max_depth, n from dilated",
    "unproject_pixel": f"""{_OWN},
loc as (select i.*, {_d(G.phi_min)} + (h + 0.5) * {_d(G.h_res)} as p, {_d(G.theta_min)} + (v + 0.5) * {_d(G.v_res)} as t from image i),
xyz as (select *, max_depth * cos(t) * cos(p) as x, max_depth * cos(t) * sin(p) as y, max_depth * sin(t) as z from loc)
select i.scene_id, di, v, h, round(r00 * x + r01 * y + r02 * z + tx, 6) as gx, round(r10 * x + r11 * y + r12 * z + ty, 6) as gy, round(r20 * x + r21 * y + r22 * z + tz, 6) as gz from xyz i join sweeps s on s.scene_id = i.scene_id and s.sweep_idx = i.di""",
    "adaptive_epsilon": f"{_BASE} select scene_id, sweep_idx, point_idx, round({_eps('rng', P.mcc_forward, P.mcc_forward_adaptive)}, 6) as eps from kept",
    "occlusion_coarse": f"{_COARSE_LABELS} select scene_id, sweep_idx, k::int as k, label, count(*) as n from coarse group by all",
    "occlusion_vote": f"{_VOTED} select scene_id, sweep_idx, label, count(*) as n from voted group by all",
    "ransac_ground": f"{_DISK} select b.scene_id, b.sweep_idx, count(*) as n_ground, any_value(inliers) as inliers from best b join kept k using (scene_id, sweep_idx) where abs(nx * x + ny * y + nz * z + d) <= {_d(P.ground_distance)} group by b.scene_id, b.sweep_idx",
    "track_velocity": """with e as (select user_id % 2 as scene_id, user_id as instance_id, epoch_us(ts) as ts_us, event_id, value::double as tx, (event_id % 97)::double as ty from events where ts is not null and value is not null),
o as (select scene_id, instance_id, ts_us, min_by(tx, event_id) as tx, min_by(ty, event_id) as ty from e group by all),
w as (select *, lag(ts_us) over q as pt, lag(tx) over q as px, lag(ty) over q as py, lead(ts_us) over q as nt, lead(tx) over q as nx, lead(ty) over q as ny from o window q as (partition by scene_id, instance_id order by ts_us))
select scene_id, instance_id, ts_us, round(coalesce(case when ts_us - pt > 1000 then (tx - px) / ((ts_us - pt) / 1e6) end, case when nt - ts_us > 1000 then (nx - tx) / ((nt - ts_us) / 1e6) end, 0), 6) as vx,
  round(coalesce(case when ts_us - pt > 1000 then (ty - py) / ((ts_us - pt) / 1e6) end, case when nt - ts_us > 1000 then (ny - ty) / ((nt - ts_us) / 1e6) end, 0), 6) as vy, 0::double as vz from w""",
    "boxes_asof": f"{_BASE}{_BOXES}, cnt as (select scene_id, sweep_idx, count(distinct point_idx) as n from inside group by all) select scene_id, sweep_idx, instance_id, method, " + ", ".join(f"round({c}, 6) as {c}" for c in ("tx", "ty", "tz", "vx", "vy", "vz", "qw", "qx", "qy", "qz")) + ", coalesce(n, 0) as n_inside from boxes left join cnt using (scene_id, sweep_idx)",
    "generate_gt": f"{_BASE}{_BOXES} select scene_id, sweep_idx, point_idx from gt",
    "gt_offsets": f"{_BASE}{_BOXES}, c as (select s.scene_id, s.sweep_idx, count(g.point_idx) as n from sweeps s left join gt g using (scene_id, sweep_idx) group by all) select *, sum(n) over (partition by scene_id order by sweep_idx)::bigint as until from c",
    "confusion": f"{_MATCHED} select *, {_IOU} from conf",
    "iou_report": f"{_MATCHED}, s as (select scene_id, sweep_idx, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn from conf group by rollup (scene_id, sweep_idx)) select *, {_IOU} from s",
    "error_class": f"{_MATCHED} select scene_id, sweep_idx, point_idx, case when label = 0 and is_gt then 'TP' when label = 0 then 'FP' when is_gt then 'FN' else 'TN' end as error_class from matched",
    "sweep_epsilon": f"""{_VOTED}{_BOXES}, t as (select unnest(range({len(EPSILONS)})) as trial_id, unnest([{', '.join(map(_d, EPSILONS))}]) as epsilon),
      v as (select trial_id, scene_id, sweep_idx, point_idx, count(*) filter (in_fov and depth < least - epsilon) as n from around, t group by all),
      l as (select t.trial_id, t.epsilon, coalesce(v.n, 0) >= {P.vote} as dynamic, g.point_idx is not null as is_gt from voted p cross join t left join v on v.trial_id = t.trial_id and v.scene_id = p.scene_id and v.sweep_idx = p.sweep_idx and v.point_idx = p.point_idx
        left join gt g on g.scene_id = p.scene_id and g.sweep_idx = p.sweep_idx and g.point_idx = p.point_idx),
      c as (select trial_id, epsilon, count(*) filter (dynamic and is_gt) as tp, count(*) filter (dynamic and not is_gt) as fp, count(*) filter (not dynamic and is_gt) as fn, count(*) filter (not dynamic and not is_gt) as tn from l group by all) select *, {_IOU} from c""",
    "sweep_mcc": f"""{_LABELS}{_BOXES}, t as (select unnest(range({len(THRESHOLDS)})) as trial_id, unnest([{', '.join(map(_d, THRESHOLDS))}]) as threshold),
      l as (select t.trial_id, t.threshold, f.label = 0 and m.score < t.threshold as dynamic, g.point_idx is not null as is_gt from first f cross join t left join m_score m on m.scene_id = f.scene_id and m.sweep_idx = f.sweep_idx and m.point_idx = f.point_idx
        left join gt g on g.scene_id = f.scene_id and g.sweep_idx = f.sweep_idx and g.point_idx = f.point_idx),
      c as (select trial_id, threshold, count(*) filter (dynamic and is_gt) as tp, count(*) filter (dynamic and not is_gt) as fp, count(*) filter (not coalesce(dynamic, false) and is_gt) as fn, count(*) filter (not coalesce(dynamic, false) and not is_gt) as tn from l group by all) select *, {_IOU} from c""",
    "evaluate_covered": f"""{_VOTED}{_BOXES}, known as (select * from gt where {FOUND}), made_for as (select scene_id, sweep_idx from sweeps where {COVERED}),
      scored as (select v.scene_id, v.sweep_idx, v.label = 0 as dynamic, f.point_idx is not null as is_gt from voted v semi join made_for using (scene_id, sweep_idx) left join known f using (scene_id, sweep_idx, point_idx)),
      c as (select scene_id, sweep_idx, count(*) filter (dynamic and is_gt) as tp, count(*) filter (dynamic and not is_gt) as fp, count(*) filter (not dynamic and is_gt) as fn, count(*) filter (not dynamic and not is_gt) as tn, count(*) filter (is_gt) as seen from scored group by all)
      select c.* exclude (seen), {_IOU}, (select count(*) from known f where f.scene_id = c.scene_id and f.sweep_idx = c.sweep_idx) as n_gt from c""",
    "gt_class": f"{_BASE}{_BOXES} select p.scene_id, p.sweep_idx, case when k.point_idx is null then 'filtered_out' when g.point_idx is not null then 'dynamic' else 'static' end as gt_class, count(*) as n from points p left join kept k using (scene_id, sweep_idx, point_idx) left join gt g using (scene_id, sweep_idx, point_idx) group by all",
    "sweep_geometric": f"{_TRIALS} select *, {_IOU} from scored",
    "best_trial": f"{_TRIALS} select * from (select *, {_IOU} from scored) order by iou desc, trial_id limit 1",
    "mcc_score": f"{_LABELS} select {_ID}, checked, matched, round(score, 6) as score from m_score",
    "mcc_interpolate": f"{_LABELS},{_surfaces('wide', 'm_wide', WIDE)} select {_ID}, di, round(surface, 6) as surface from wide",
    "event_parallel_away": f"{_LABELS.replace('where m.label = 1) c', 'where f.label = 1) c')} select {_ID} from away",
    "event_perpendicular": f"{_GAP_LABELS} select {_ID} from across",
    "label_geometric": f"{_LABELS} select {_ID}, label from final",
    "label_histogram": f"{_GAP_LABELS} select scene_id, sweep_idx, label, count(*) as n from final group by all",
    "label_points": f"{_POINT_LABELS} select {_ID}, label from labelled",
    "evaluate_labels": f"{_POINT_LABELS}{_BOXES}, conf as (select l.scene_id, l.sweep_idx, count(*) filter (label = 0 and g.point_idx is not null) as tp, count(*) filter (label = 0 and g.point_idx is null) as fp, count(*) filter (label <> 0 and g.point_idx is not null) as fn, count(*) filter (label <> 0 and g.point_idx is null) as tn from labelled l left join gt g using (scene_id, sweep_idx, point_idx) group by all) select *, {_IOU} from conf",
    "cluster_density": f"{_REFINED} select {_ID}, cluster from clusters",
    "drop_noise": f"{_REFINED} select {_ID}, label from quiet",
    "expand_hull_exact": f"""{_REFINED},
      x_all as (select c.scene_id, c.sweep_idx, c.cluster, c.point_idx, gx, gy, gz, count(*) over (partition by c.scene_id, c.sweep_idx, c.cluster) as n from clusters c join gpoints g using (scene_id, sweep_idx, point_idx)),
      x_p as materialized (select * from x_all where n >= 4),
      x_tri as (select a.scene_id, a.sweep_idx, a.cluster, a.gx as ax, a.gy as ay, a.gz as az, (b.gy - a.gy) * (c.gz - a.gz) - (b.gz - a.gz) * (c.gy - a.gy) as mx, (b.gz - a.gz) * (c.gx - a.gx) - (b.gx - a.gx) * (c.gz - a.gz) as my, (b.gx - a.gx) * (c.gy - a.gy) - (b.gy - a.gy) * (c.gx - a.gx) as mz
        from x_p a join x_p b on b.scene_id = a.scene_id and b.sweep_idx = a.sweep_idx and b.cluster = a.cluster and b.point_idx > a.point_idx join x_p c on c.scene_id = a.scene_id and c.sweep_idx = a.sweep_idx and c.cluster = a.cluster and c.point_idx > b.point_idx),
      x_n as (select row_number() over () as t, scene_id, sweep_idx, cluster, mx / size as nx, my / size as ny, mz / size as nz, (mx * ax + my * ay + mz * az) / size as d from (select *, sqrt(mx * mx + my * my + mz * mz) as size from x_tri) where size > 1e-6),
      x_side as (select t, any_value(n.scene_id) as scene_id, any_value(n.sweep_idx) as sweep_idx, any_value(n.cluster) as cluster, any_value(nx) as nx, any_value(ny) as ny, any_value(nz) as nz, any_value(d) as d, min(nx * gx + ny * gy + nz * gz - d) as least, max(nx * gx + ny * gy + nz * gz - d) as most
        from x_n n join x_p p using (scene_id, sweep_idx, cluster) group by t),
      x_face as materialized (select *, case when most <= 1e-9 then 1 else -1 end as s from x_side where (most <= 1e-9 and least < -1e-9) or (least >= -1e-9 and most > 1e-9)),
      x_box as (select scene_id, sweep_idx, cluster, min(gx) as x0, max(gx) as x1, min(gy) as y0, max(gy) as y1, min(gz) as z0, max(gz) as z1 from x_p semi join x_face using (scene_id, sweep_idx, cluster) group by all),
      x_near as (select g.*, cluster from gpoints g join x_box b using (scene_id, sweep_idx) where gx between x0 - 1e-9 and x1 + 1e-9 and gy between y0 - 1e-9 and y1 + 1e-9 and gz between z0 - 1e-9 and z1 + 1e-9),
      x_in as (select g.scene_id, g.sweep_idx, g.point_idx from x_near g join x_face f using (scene_id, sweep_idx, cluster) group by g.scene_id, g.sweep_idx, g.point_idx, g.cluster having max(s * (nx * gx + ny * gy + nz * gz - d)) <= 1e-9)
      select q.scene_id, q.sweep_idx, q.point_idx, case when i.point_idx is not null then 0 else q.label end::tinyint as label from quiet q left join (select distinct * from x_in) i using (scene_id, sweep_idx, point_idx)""",
    "expand_hull": f"{_REFINED} select {_ID}, label from refined",
    "trial_results": f"{_TRIALS}, t as (select *, case when tp + fp + fn > 0 then tp / (tp + fp + fn)::double else 0 end as i from scored) select trial_id, vote, tp, fp, fn, tn, round(i, 6) as iou, row_number() over (order by i desc, trial_id)::int as rank, round(max(i) over () - i, 6) as behind from t",
    "sweep_refinement": _refinements(),
    "hyperband": _hyperband(),
    "successive_halving": f"""{_TRIALS},
by_scene as (select t.trial_id, v.scene_id, count(*) filter (votes >= t.vote and g.point_idx is not null) as tp, count(*) filter (votes >= t.vote and g.point_idx is null) as fp, count(*) filter (votes < t.vote and g.point_idx is not null) as fn from votes v cross join trials t left join gt g using (scene_id, sweep_idx, point_idx) group by all),
so_far as (select trial_id, row_number() over w - 1 as rung, sum(tp) over w as tp, sum(fp) over w as fp, sum(fn) over w as fn from by_scene window w as (partition by trial_id order by scene_id)),
ious as (select trial_id, rung, case when tp + fp + fn > 0 then tp / (tp + fp + fn)::double else 0 end as iou from so_far),
r0 as (select *, row_number() over (order by iou desc, trial_id) <= ceil(count(*) over () / 3.0) as survives from ious where rung = 0),
r1 as (select i.*, row_number() over (order by i.iou desc, i.trial_id) <= ceil(count(*) over () / 3.0) as survives from ious i join r0 on r0.trial_id = i.trial_id and r0.survives where i.rung = 1)
select rung::int as rung, trial_id::int as trial_id, round(iou, 6) as iou, survives from (select * from r0 union all select * from r1)""",
}
