"""The registered tracking queries in SQL, stage by stage, for comparison with the DataFrame results."""

from __future__ import annotations

from fractions import Fraction

from .functions.geometry import ZONES
from .schemas import DEFAULT as P

#: Size of the court plan, alike on both frame sizes of the derived matches.
WIDTH, HEIGHT = 120, 240
#: The projective map of the corners (300, 200), (980, 210), (1200, 690), (80, 680) to the unit square, solved in fractions.
_U = ("52073004/26632156585", "47733587/53264313170", "-4079051980/5326431317"), ("-7225223/106528626340", "122828791/26632156585", "-4804773295/5326431317"), ("-228096/5326431317", "48256307/26632156585", "1/1")


def _r(x: str, digits: int = 4) -> str:
    return f"floor({x} * {10**digits} + 0.5::DOUBLE) / {10**digits}::DOUBLE"


def _number(x: str) -> str:
    """A fraction as the nearest double; written out, so that no engine rounds it otherwise."""
    return f"({float(Fraction(x))!r})::DOUBLE"


def _project(x: str, y: str, axis: int) -> str:
    """Pixel on the plan: by the corners' map, or from the box of all feet where there are no corners."""
    top, w = (" + ".join(f"{_number(c)} * {v}" for c, v in zip(_U[row], (x, y, "1"))) for row in (axis, 2))
    v, low, size = ("x", "x0", WIDTH) if axis == 0 else ("y", "y0", HEIGHT)
    value = f"CASE WHEN lost THEN {x if axis == 0 else y} * s{v} + t{v} ELSE {low} + {size} * (({top}) / ({w})) END"
    return f"trunc(greatest({low}, least({low} + {size}, {value})))::BIGINT"


def _filled(limit: int, table: str = "ball", columns: str = "cx cy") -> str:
    names = columns.split()
    value = "CASE WHEN {c} IS NOT NULL THEN {c} WHEN pf IS NOT NULL AND frame_num - pf <= {n} THEN CASE WHEN nf IS NULL THEN p{c} ELSE p{c} + (n{c} - p{c}) * (frame_num - pf) / (nf - pf) END WHEN nf - frame_num <= {n} THEN n{c} END AS {c}"
    near = ", ".join(f"last_value({c} IGNORE NULLS) OVER b AS p{c}, first_value({c} IGNORE NULLS) OVER a AS n{c}" for c in names)
    seen = f"CASE WHEN {names[0]} IS NOT NULL THEN frame_num END IGNORE NULLS"
    return f"""(SELECT match_id, frame_num, {", ".join(value.format(c=c, n=limit) for c in names)}, {names[0]} IS NULL AS filled FROM (
    SELECT *, last_value({seen}) OVER b AS pf, first_value({seen}) OVER a AS nf, {near}
    FROM {table} WINDOW b AS (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


def _velocity(table: str) -> str:
    return f"""(SELECT *, rolling - lag(rolling) OVER (PARTITION BY match_id ORDER BY frame_num) AS dy FROM (
    SELECT *, avg(cy) OVER (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN {P.roll - 1} PRECEDING AND CURRENT ROW) AS rolling FROM {table}))"""


def _chosen() -> str:
    """(match_id, frame_num, box): the anchored choice of the ball, by recursion over the frames of a match."""
    far = "sqrt(((x.x1 + x.x2) / 2 - ax) ** 2 + ((x.y1 + x.y2) / 2 - ay) ** 2)"
    return f"""(WITH RECURSIVE listed AS (SELECT match_id, frame_num, c FROM fr LEFT JOIN (
    SELECT match_id, frame_num, list({{'k': -conf, 'i': cand_idx, 'x1': cx - half, 'y1': cy - half, 'x2': cx + half, 'y2': cy + half}}) AS c FROM fine GROUP BY ALL) USING (match_id, frame_num)),
  walk AS (SELECT match_id, -1::BIGINT AS frame_num, NULL::DOUBLE AS ax, NULL::DOUBLE AS ay, 0 AS misses, NULL::STRUCT(k DOUBLE, i BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) AS box FROM m
  UNION ALL SELECT match_id, frame_num, CASE WHEN best IS NOT NULL THEN (best.x1 + best.x2) / 2 WHEN misses + 1 < {P.ball_lost_reset} THEN ax END, CASE WHEN best IS NOT NULL THEN (best.y1 + best.y2) / 2 WHEN misses + 1 < {P.ball_lost_reset} THEN ay END,
    CASE WHEN best IS NULL THEN misses + 1 ELSE 0 END, coalesce(best, likely) FROM (
      SELECT walk.match_id, l.frame_num, ax, ay, misses, list_sort(l.c)[1] AS likely, list_sort(list_filter(l.c, lambda x: ax IS NULL OR {far} <= {P.ball_max_jump}))[1] AS best
      FROM walk JOIN listed l ON l.match_id = walk.match_id AND l.frame_num = walk.frame_num + 1))
  SELECT match_id, frame_num, box FROM walk WHERE frame_num >= 0)"""


def _slots() -> str:
    """(match_id, frame_num, player_id, slot_ord, box): the four identities, by recursion over the frames of a match; every derived frame has detections."""
    ids = range(1, P.n_players + 1)
    det = "STRUCT(t BIGINT, cx BIGINT, cy BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
    kept = ", ".join(f"list_filter(d, lambda x: x.t = t{i})[1] AS k{i}" for i in ids)
    body = f"SELECT w.*, l.frame_num AS f, d, {kept} FROM walk w JOIN seen l ON l.match_id = w.match_id AND l.frame_num = w.frame_num + 1"
    none = " AND ".join(f"k{i} IS NULL AND x{i} IS NULL" for i in ids)
    body = f"SELECT *, list_filter(d, lambda x: NOT list_contains([{', '.join(f'k{i}.t' for i in ids)}], x.t) IS TRUE) AS free0, {none} AND len(d) >= {P.n_players} AS fresh FROM ({body})"
    for i in ids:
        by_place = f"list_sort(list_transform(free{i - 1}, lambda x: {{'cy': x.cy, 'cx': x.cx, 't': x.t, 'x': x}}))[1].x" if i == 1 else f"list_sort(list_transform(d, lambda x: {{'cy': x.cy, 'cx': x.cx, 't': x.t, 'x': x}}))[{i}].x"
        near = f"list_sort(list_transform(free{i - 1}, lambda x: {{'far': sqrt((x.cx - x{i}) ** 2 + (x.cy - y{i}) ** 2), 't': x.t, 'x': x}}))[1]"
        body = f"SELECT *, {near} AS n{i} FROM ({body})"
        body = f"SELECT *, CASE WHEN k{i} IS NOT NULL THEN NULL WHEN fresh THEN {by_place} WHEN x{i} IS NULL THEN list_sort(free{i - 1})[1] WHEN n{i}.far < {P.slot_accept} THEN n{i}.x END AS g{i} FROM ({body})"
        body = f"SELECT *, list_filter(free{i - 1}, lambda x: g{i} IS NULL OR x.t <> g{i}.t) AS free{i} FROM ({body})"
    given = lambda i: f"coalesce(k{i}, g{i})"
    state = ", ".join(f"{given(i)}.t AS t{i}, coalesce({given(i)}.cx, x{i}) AS x{i}, coalesce({given(i)}.cy, y{i}) AS y{i}" for i in ids)
    count = lambda c, upto: " + ".join(["0", *(f"({c}{j} IS NOT NULL)::INT" for j in ids if j < upto)])
    order = lambda i: f"CASE WHEN k{i} IS NOT NULL THEN {count('k', i)} ELSE {count('k', 9)} + {count('g', i)} END"
    out = ", ".join(f"{{'p': {i}::BIGINT, 'o': ({order(i)})::BIGINT, 'b': {given(i)}}}" for i in ids)
    start = ", ".join(f"NULL::BIGINT AS t{i}, NULL::BIGINT AS x{i}, NULL::BIGINT AS y{i}" for i in ids)
    return f"""(WITH RECURSIVE seen AS (SELECT match_id, frame_num, list({{'t': player_id, 'cx': foot_x, 'cy': foot_y - 45, 'x1': foot_x - 20.0::DOUBLE, 'y1': foot_y - 90.0::DOUBLE, 'x2': foot_x + 20.0::DOUBLE, 'y2': foot_y::DOUBLE}}::{det}) AS d FROM inside GROUP BY ALL),
  walk AS (SELECT match_id, -1::BIGINT AS frame_num, {start}, NULL::STRUCT(p BIGINT, o BIGINT, b {det})[] AS dealt FROM m
  UNION ALL SELECT match_id, f, {state}, [{out}] FROM ({body}))
  SELECT match_id, frame_num, z.p AS player_id, z.o AS slot_ord, z.b.x1 AS x1, z.b.y1 AS y1, z.b.x2 AS x2, z.b.y2 AS y2 FROM (SELECT match_id, frame_num, unnest(dealt) AS z FROM walk WHERE frame_num >= 0) WHERE z.b IS NOT NULL)"""


def base(fps: float | None = None, stateful: bool = False) -> str:
    """`stateful`: players and ball are those that the two steps in frame order choose, else the derived ones."""
    rate = f"{fps}::DOUBLE" if fps else f"CASE match_id % 3 WHEN 1 THEN 25.0 WHEN 2 THEN 30.0 ELSE {P.default_fps} END::DOUBLE"
    tracks = f"(SELECT match_id, frame_num, player_id, slot_ord, trunc((x1 + x2) / 2)::BIGINT AS foot_x, trunc(y2)::BIGINT AS foot_y FROM {_slots()})" if stateful else "(SELECT * FROM box)"
    filled = _filled(P.gap_limit)
    if stateful:
        boxes = "(SELECT match_id, frame_num, box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2 FROM " + _chosen() + ")"
        filled = f"(SELECT match_id, frame_num, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, filled FROM {_filled(P.gap_limit, boxes, 'x1 y1 x2 y2')})"
    longest = int(P.look_ahead * P.max_persist)
    metre = f"{P.court_width_m} / {WIDTH}::DOUBLE"
    return f"""WITH fr AS (SELECT user_id // 4 AS match_id, row_number() OVER (PARTITION BY user_id // 4 ORDER BY ts, event_id) - 1 AS frame_num,
  event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
m AS (SELECT match_id, count(*) AS total_frames, {rate} AS fps, match_id % 6 AS kind, match_id % 6 IN (3, 5) AS lost,
  CASE match_id % 2 WHEN 0 THEN 1137 ELSE 1773 END AS x0, CASE match_id % 2 WHEN 0 THEN 457 ELSE 813 END AS y0 FROM fr GROUP BY match_id),
kv(kind, min_x, max_x, min_y, max_y) AS (VALUES (0, 80.0::DOUBLE, 1200.0::DOUBLE, 200.0::DOUBLE, 690.0::DOUBLE), (1, 80, 1200, 200, 690), (2, 80, 1200, 200, 690), (4, 80, 1200, 200, 690), (5, 100, 1200, 100, 650)),
bounds AS (SELECT match_id, min_x - {P.court_pad} AS min_x, max_x + {P.court_pad} AS max_x, min_y - {P.court_pad} AS min_y, max_y + {P.court_pad} AS max_y FROM m JOIN kv USING (kind)),
ball AS (SELECT match_id, frame_num, CASE WHEN event_type <> 'error' THEN CAST(200 + 7 * k AS DOUBLE) END AS cx,
  CASE WHEN event_type <> 'error' THEN CAST(250 + abs(((frame_num * (7 + match_id % 3 * 2)) % 400) - 200) AS DOUBLE) + CAST(event_id % 5 AS DOUBLE) / 2 END AS cy FROM fr),
box AS (SELECT match_id, frame_num, p.player_id, p.player_id AS slot_ord, (CASE WHEN p.player_id % 2 = 1 THEN 300 ELSE 800 END + k * 2 + event_id % 7)::BIGINT AS foot_x,
  (CASE WHEN p.player_id <= 2 THEN 260 ELSE 560 END + floor(least(value, 200) / 4))::BIGINT AS foot_y
  FROM fr CROSS JOIN (VALUES (1::BIGINT), (2), (3), (4)) p(player_id) WHERE (event_id + p.player_id) % 11 <> 0),
cand AS (SELECT match_id, frame_num, cand_idx, (event_id * 37 + cand_idx * 29) % 100 / 100::DOUBLE AS conf, (200 + 7 * k + 300 * cand_idx)::DOUBLE AS cx, (250 + event_id % 97 * 4)::DOUBLE AS cy,
  (1 + (k * 2 + cand_idx * 31) % 200)::DOUBLE / 2 AS half FROM fr CROSS JOIN (VALUES (0::BIGINT), (1), (2)) c(cand_idx) WHERE event_type <> 'error'),
fine AS (SELECT * FROM cand WHERE 2 * half BETWEEN {P.ball_min_size} AND {P.ball_max_size} AND conf > 0),
inside AS (SELECT box.* FROM box LEFT JOIN bounds USING (match_id) WHERE foot_x BETWEEN coalesce(min_x, 0) AND coalesce(max_x, 10000) AND foot_y - 45 BETWEEN coalesce(min_y, 0) AND coalesce(max_y, 10000)),
trk AS {tracks},
feet AS (SELECT match_id, count(*) AS n, min(foot_x)::DOUBLE AS x0, min(foot_y)::DOUBLE AS y0, max(foot_x)::DOUBLE AS x1, max(foot_y)::DOUBLE AS y1 FROM {"trk" if stateful else "box"} GROUP BY match_id),
wide AS (SELECT match_id, n, x0 - (x1 - x0) * {P.feet_margin}::DOUBLE AS x0, y0 - (y1 - y0) * {P.feet_margin}::DOUBLE AS y0, x1 + (x1 - x0) * {P.feet_margin}::DOUBLE AS x1, y1 + (y1 - y0) * {P.feet_margin}::DOUBLE AS y1 FROM feet),
pm AS (SELECT m.match_id, m.x0, m.y0, lost, {WIDTH} / (w.x1 - w.x0) AS sx, {HEIGHT} / (w.y1 - w.y0) AS sy, m.x0 - w.x0 * ({WIDTH} / (w.x1 - w.x0)) AS tx, m.y0 - w.y0 * ({HEIGHT} / (w.y1 - w.y0)) AS ty FROM m LEFT JOIN wide w USING (match_id)),
gb AS {filled},
short AS {_filled(2)},
vel AS (SELECT *, lead(dy) OVER (PARTITION BY match_id ORDER BY frame_num) AS next_dy, list(coalesce(dy, 0)) OVER (PARTITION BY match_id ORDER BY frame_num ROWS BETWEEN 1 FOLLOWING AND {longest} FOLLOWING) AS ahead,
  count(*) OVER (PARTITION BY match_id) AS n FROM {_velocity("gb")} v),
keyed AS (SELECT *, greatest({P.min_persist}, least({P.max_persist}, n // {P.persist_divisor})) AS kk FROM vel),
looked AS (SELECT *, floor(kk * {P.look_ahead}::DOUBLE)::BIGINT AS look FROM keyed),
shots AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_num) - 1 AS shot_idx, frame_num FROM looked
  WHERE frame_num >= 1 AND frame_num < n - look AND dy * next_dy < 0 AND len(list_filter(ahead[1:look], lambda x: x * dy < 0)) >= kk - 1),
pp AS (SELECT match_id, frame_num, player_id, slot_ord, {_project("foot_x", "foot_y", 0)} AS mx, {_project("foot_x", "foot_y", 1)} AS my FROM trk JOIN pm USING (match_id)),
bp AS (SELECT match_id, frame_num, {_project("trunc(cx)", "trunc(cy)", 0)} AS bx, {_project("trunc(cx)", "trunc(cy)", 1)} AS by_ FROM gb JOIN pm USING (match_id) WHERE cx IS NOT NULL),
seg AS (SELECT s.*, (ef - sf) / fps AS dt, sqrt((b0.bx - b1.bx) ** 2 + (b0.by_ - b1.by_) ** 2) AS px, b0.bx AS bx0, b0.by_ AS by0, fps, total_frames FROM
  (SELECT match_id, shot_idx AS seg_idx, frame_num AS sf, lead(frame_num) OVER (PARTITION BY match_id ORDER BY shot_idx) AS ef FROM shots) s JOIN m USING (match_id)
  LEFT JOIN bp b0 ON b0.match_id = s.match_id AND b0.frame_num = sf LEFT JOIN bp b1 ON b1.match_id = s.match_id AND b1.frame_num = ef WHERE ef IS NOT NULL),
att AS (SELECT match_id, seg_idx, sf, ef, dt, player_id AS hitter, px * {metre} / dt * 3.6 AS speed FROM (
  SELECT seg.*, player_id, row_number() OVER (PARTITION BY seg.match_id, seg_idx ORDER BY sqrt((mx - bx0) ** 2 + (my - by0) ** 2), slot_ord) AS near
  FROM seg JOIN pp ON pp.match_id = seg.match_id AND pp.frame_num = sf WHERE px IS NOT NULL AND dt > 0) WHERE near = 1),
moved AS (SELECT att.match_id, sf AS frame_num, a.player_id, sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2) * {metre} / dt * 3.6 AS player_speed
  FROM att JOIN pp a ON a.match_id = att.match_id AND a.frame_num = sf JOIN pp b ON b.match_id = att.match_id AND b.frame_num = ef AND b.player_id = a.player_id),
ev AS (SELECT match_id, frame_num, player_id, max(shots) AS shots, max(shot_speed) AS shot_speed, max(player_speed) AS player_speed FROM (
  SELECT match_id, sf AS frame_num, hitter AS player_id, 1 AS shots, speed AS shot_speed, NULL::DOUBLE AS player_speed FROM att
  UNION ALL SELECT match_id, frame_num, player_id, 0, NULL, player_speed FROM moved) GROUP BY ALL),
ids AS (SELECT unnest([1::BIGINT, 2, 3, 4]) AS player_id),
acc AS (SELECT g.match_id, g.frame_num, g.player_id, coalesce(sum(shots) OVER w, 0)::BIGINT AS number_of_shots, coalesce(sum(shot_speed) OVER w, 0) AS total_shot_speed, coalesce(last_value(shot_speed IGNORE NULLS) OVER w, 0) AS last_shot_speed,
  coalesce(sum(player_speed) OVER w, 0) AS total_player_speed, coalesce(last_value(player_speed IGNORE NULLS) OVER w, 0) AS last_player_speed
  FROM (SELECT match_id, frame_num, player_id FROM fr CROSS JOIN ids) g LEFT JOIN ev USING (match_id, frame_num, player_id)
  WINDOW w AS (PARTITION BY g.match_id, g.player_id ORDER BY g.frame_num ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fs AS (SELECT *, CASE WHEN number_of_shots = 0 THEN 0 ELSE total_shot_speed / number_of_shots END AS average_shot_speed, total_player_speed / greatest(number_of_shots, 1) AS average_player_speed FROM acc),
mv AS (SELECT match_id, player_id, sum(step_m) AS distance_covered, avg(step_m * fps * 3.6) AS avg_player_speed, count(*) AS steps FROM (
  SELECT *, sqrt((mx - mx0) ** 2 + (my - my0) ** 2) * {metre} AS step_m FROM (
    SELECT *, lag(frame_num) OVER w AS f0, lag(mx) OVER w AS mx0, lag(my) OVER w AS my0 FROM pp WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_num)) WHERE f0 = frame_num - 1) JOIN m USING (match_id) GROUP BY ALL),
su AS (SELECT m.match_id, ids.player_id, coalesce(total_shots, 0)::BIGINT AS total_shots, coalesce(s / nullif(total_shots, 0), 0) AS avg_shot_speed, coalesce(max_shot_speed, 0) AS max_shot_speed,
  coalesce(avg_player_speed, 0) AS avg_player_speed, coalesce(distance_covered, 0) AS distance_covered
  FROM m CROSS JOIN ids LEFT JOIN (SELECT match_id, player_id, sum(shots) AS total_shots, sum(shot_speed) AS s, max(shot_speed) AS max_shot_speed FROM ev GROUP BY ALL) e USING (match_id, player_id) LEFT JOIN mv USING (match_id, player_id)),
tt AS (SELECT match_id, CASE WHEN player_id <= 2 THEN 'A' ELSE 'B' END AS team, sum(total_shots)::BIGINT AS total_shots, floor(avg({_r("avg_shot_speed", 2)}) + 0.5)::DOUBLE AS avg_shot_speed, max({_r("max_shot_speed", 2)}) AS max_shot_speed,
  floor(avg({_r("avg_player_speed", 2)}) + 0.5)::DOUBLE AS avg_player_speed, floor(sum({_r("distance_covered", 2)}) + 0.5)::DOUBLE AS distance_covered FROM su GROUP BY ALL),
sp AS (SELECT *, speed / greatest(max(speed) OVER (PARTITION BY match_id), 1) AS share FROM (SELECT *, coalesce(CASE WHEN dt > 0 THEN px / dt END, 0) AS speed FROM seg)),
sm AS (SELECT match_id, 0 AS kind, seg_idx AS ord, greatest(0, sf - {P.clip_frames})::BIGINT AS start_frame, least(total_frames - 1, sf + {P.clip_frames})::BIGINT AS end_frame, {_r("(sf / fps)", 2)} AS timestamp_seconds,
  'Fast Smash — ' || round_even(100 * share, 0)::INT || '% max speed' AS label FROM sp WHERE share >= {P.smash_share}),
sh AS (SELECT match_id, list(frame_num ORDER BY frame_num) AS f FROM shots GROUP BY match_id HAVING count(*) >= 2),
ra AS (SELECT match_id, 1 AS kind, x.i AS ord, greatest(0, f[x.st + 1] - {P.clip_frames})::BIGINT AS start_frame, least(total_frames - 1, f[x.i] + {P.clip_frames})::BIGINT AS end_frame, {_r("(f[x.st + 1] / fps)", 2)} AS timestamp_seconds,
  'Long Padel Rally — ' || (x.i - x.st) || ' shots (inc. wall bounces)' AS label FROM fold JOIN sh USING (match_id) JOIN m USING (match_id) WHERE fold.x IS NOT NULL),
hl AS (SELECT * FROM sm UNION ALL SELECT * FROM ra),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_frame > pe + {P.merge_frames} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY start_frame, kind, ord) AS island FROM (
  SELECT *, max(end_frame) OVER (PARTITION BY match_id ORDER BY start_frame, kind, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hl)),
mg AS (SELECT match_id, min(start_frame)::BIGINT AS start_frame, max(end_frame)::BIGINT AS end_frame, arg_min(timestamp_seconds, (start_frame, kind, ord)) AS timestamp_seconds, array_to_string(list_sort(list(DISTINCT label)), ' / ') AS label FROM isl GROUP BY match_id, island),
cp AS (SELECT match_id, player_id, frame_num, greatest(0, least(1, (mx - x0) / {WIDTH}::DOUBLE)) * {P.court_width_m} AS x_m, greatest(0, least(1, (my - y0) / {HEIGHT}::DOUBLE)) * {P.court_length_m} AS y_m FROM pp JOIN pm USING (match_id)),
bins AS (SELECT match_id, player_id, least(floor(x_m / {P.court_width_m} * {P.grid}), {P.grid - 1})::BIGINT AS bx, least(floor(y_m / {P.court_length_m} * {P.grid}), {P.grid - 1})::BIGINT AS by_, count(*) AS n FROM cp GROUP BY ALL),
kern AS (SELECT o, exp(-o * o / 50.0::DOUBLE) / sum(exp(-o * o / 50.0::DOUBLE)) OVER () AS w FROM (SELECT unnest(range(-20, 21)) AS o)),
kx AS (SELECT match_id, player_id, CASE WHEN bx + o < 0 THEN -(bx + o) - 1 WHEN bx + o > {P.grid - 1} THEN {2 * P.grid - 1} - bx - o ELSE bx + o END AS bx, by_, sum(n * w) AS v FROM bins CROSS JOIN kern GROUP BY ALL),
ky AS (SELECT match_id, player_id, bx, CASE WHEN by_ + o < 0 THEN -(by_ + o) - 1 WHEN by_ + o > {P.grid - 1} THEN {2 * P.grid - 1} - by_ - o ELSE by_ + o END AS by_, sum(v * w) AS v FROM kx CROSS JOIN kern GROUP BY ALL),
tr AS (SELECT *, sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2) AS step FROM (
  SELECT match_id, frame_num, greatest(0, least(1, (bx - x0) / {WIDTH}::DOUBLE)) * {P.court_width_m} AS x_m, greatest(0, least(1, (by_ - y0) / {HEIGHT}::DOUBLE)) * {P.court_length_m} AS y_m FROM bp JOIN pm USING (match_id)) WINDOW w AS (PARTITION BY match_id ORDER BY frame_num)),
jl AS (SELECT 'job_' || user_id AS job_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS status, event_type AS stage,
  json_extract_string(props, '$.k')::BIGINT AS progress, CASE WHEN event_type = 'purchase' THEN props END AS result, CASE WHEN event_type = 'error' THEN 'failed' END AS error, ts FROM events),
js AS (SELECT job_id, arg_max(status, seq) AS status, arg_max(stage, seq) AS stage, arg_max(progress, seq) FILTER (progress IS NOT NULL) AS progress, arg_max(result, seq) FILTER (result IS NOT NULL) AS result,
  arg_max(error, seq) FILTER (error IS NOT NULL) AS error, min(ts) AS created, max(ts) AS updated FROM jl GROUP BY job_id)
"""


def _fold() -> str:
    """The rallies of each match by recursion over its shots: (match_id, x = struct(st, i)), x null where none closes."""
    return f"""fold AS (SELECT match_id, CASE WHEN closed THEN {{'st': prev, 'i': i}} END AS x FROM (
  WITH RECURSIVE r AS (SELECT match_id, 0::BIGINT AS i, 0::BIGINT AS st, 0::BIGINT AS prev, false AS closed FROM sh
    UNION ALL SELECT match_id, i, CASE WHEN c THEN i ELSE st END, st, c FROM (
      SELECT r.match_id, r.i + 1 AS i, r.st, r.i + 1 - r.st >= {P.rally_shots} AND (f[r.i + 2] - f[r.i + 1] > {P.rally_gap_seconds} * fps OR r.i + 1 = len(f) - 1) AS c
      FROM r JOIN sh USING (match_id) JOIN m USING (match_id) WHERE r.i + 1 < len(f)))
  SELECT * FROM r)),
ra AS """


def query(select: str, fps: float | None = None, stateful: bool = False) -> str:
    return base(fps, stateful).replace("\nra AS ", "\n" + _fold(), 1) + select


def _zone(y: str) -> str:
    return "CASE " + " ".join(f"WHEN {y} >= {a} AND {y} < {b} THEN '{name}'" for a, b, name in ZONES) + f" WHEN {y} >= {ZONES[-1][1]} THEN '{ZONES[-1][2]}' END"


def _all(columns: str) -> str:
    return ", ".join(f"{_r(c)} AS {c}" for c in columns.split())


_METRICS = "avg_shot_speed max_shot_speed avg_player_speed distance_covered"
_METRIC_STRUCT = "{'total_shots': total_shots, " + ", ".join(f"'{c}': {_r(c, 2)}" for c in _METRICS.split()) + "}"
_HUD = (("shot", "last_shot_speed"), ("player", "last_player_speed"), ("avg_shot", "average_shot_speed"), ("avg_player", "average_player_speed"))
_RALLIES = "SELECT match_id, ord::BIGINT AS ord, start_frame, end_frame, timestamp_seconds, label FROM ra"

SQL = {
    "bbox_centers": query("SELECT match_id, frame_num, cand_idx, ((cx - half) + (cx + half)) / 2 AS cx, ((cy - half) + (cy + half)) / 2 AS cy, trunc(((cx - half) + (cx + half)) / 2)::BIGINT AS ix, trunc(((cy - half) + (cy + half)) / 2)::BIGINT AS iy, (cy + half) - (cy - half) AS h FROM cand"),
    "foot_points": query("SELECT match_id, frame_num, player_id AS track_id, foot_x, foot_y FROM trk"),
    "court_layout": query(f"SELECT match_id, CASE match_id % 2 WHEN 0 THEN 1280 ELSE 1920 END::BIGINT AS frame_w, CASE match_id % 2 WHEN 0 THEN 720 ELSE 1080 END::BIGINT AS frame_h, {WIDTH}::BIGINT AS width, {HEIGHT}::BIGINT AS height, x0::BIGINT AS x0, y0::BIGINT AS y0, (x0 + {WIDTH})::BIGINT AS x1, (y0 + {HEIGHT})::BIGINT AS y1 FROM m"),
    "court_corners": query("SELECT match_id, CASE WHEN kind IN (0, 1, 2, 4) THEN '300.0,200.0,980.0,210.0,1200.0,690.0,80.0,680.0' ELSE '100.0,100.0,600.0,350.0,1200.0,650.0,1100.0,600.0' END AS corners FROM m WHERE kind <> 3"),
    "court_lines": query("SELECT match_id, name, (x0 + 120 * ua)::DOUBLE AS ax, (y0 + 120 + da)::DOUBLE AS ay, (x0 + 120 * ub)::DOUBLE AS bx, (y0 + 120 + db)::DOUBLE AS by FROM m CROSS JOIN (VALUES ('TL-TR', 0.0::DOUBLE, -120.0::DOUBLE, 1.0::DOUBLE, -120.0::DOUBLE), ('BL-BR', 0, 120, 1, 120), ('TL-BL', 0, -120, 0, 120), ('TR-BR', 1, -120, 1, 120), ('TopSL_L-TopSL_R', 0, -83.4, 1, -83.4), ('BotSL_L-BotSL_R', 0, 83.4, 1, 83.4), ('TopCenter-NetCenter', 0.5, -83.4, 0.5, 0), ('BotCenter-NetCenter', 0.5, 83.4, 0.5, 0)) l(name, ua, da, ub, db)"),
    "court_keypoint_rows": query("""SELECT match_id, dense_rank() OVER (PARTITION BY match_id ORDER BY first) - 1 AS class_idx, class_name, row_number() OVER (PARTITION BY match_id, class_name ORDER BY frame_num, q) - 1 AS kp_idx, x, y FROM (
  SELECT match_id, frame_num, event_type AS class_name, min(frame_num) OVER (PARTITION BY match_id, event_type) AS first, q, CASE q WHEN 0 THEN k WHEN 1 THEN event_id % 2 * 9 ELSE 2 * k END::DOUBLE AS x, CASE q WHEN 0 THEN event_id % 50 WHEN 1 THEN 0 ELSE 7 END::DOUBLE AS y
  FROM fr CROSS JOIN (VALUES (0), (1), (2)) p(q) WHERE frame_num < 5) WHERE x > 0 OR y > 0"""),
    "point_helpers": query(f"SELECT match_id, frame_num, cand_idx, trunc(cx)::BIGINT AS foot_x, cy + half AS foot_y, 2 * half AS h, abs(cx - 640) AS dx, abs(cy - 360) AS dy, {_r('(frame_num / 10.0::DOUBLE * 12)')} AS px, (frame_num // 24 // 60) || ':' || lpad((frame_num // 24 % 60)::VARCHAR, 2, '0') AS clock FROM cand"),
    "raw_extents": query("SELECT match_id, 'player' AS entity, player_id, count(*) AS n, min(mx) AS min_x, max(mx) AS max_x, min(my) AS min_y, max(my) AS max_y FROM pp GROUP BY ALL UNION ALL SELECT match_id, 'ball', 0, count(*), min(bx), max(bx), min(by_), max(by_) FROM bp GROUP BY ALL"),
    "position_coverage": query("SELECT match_id, count(*) AS frames, count(p.frame_num) AS with_players, count(b.frame_num) AS with_ball FROM fr LEFT JOIN (SELECT DISTINCT match_id, frame_num FROM pp) p USING (match_id, frame_num) LEFT JOIN bp b USING (match_id, frame_num) GROUP BY match_id"),
    "project_positions": query("SELECT match_id, frame_num, 'player' AS entity, player_id, mx, my FROM pp UNION ALL SELECT match_id, frame_num, 'ball', 0, bx, by_ FROM bp"),
    "ball_candidates_filter": query("SELECT match_id, frame_num, cand_idx, conf FROM fine"),
    "ball_argmax": query("SELECT match_id, frame_num, conf, cx - half AS x1, cy - half AS y1, cx + half AS x2, cy + half AS y2 FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_num ORDER BY conf DESC, cand_idx) AS rn FROM fine) WHERE rn = 1"),
    "court_bounds": query("SELECT * FROM bounds"),
    "players_in_court": query("SELECT match_id, frame_num, player_id AS track_id, foot_x AS cx, foot_y - 45 AS cy FROM inside"),
    "court_estimate": query("SELECT * FROM wide"),
    "ball_gapfill": query(f"SELECT match_id, frame_num, {_all('cx cy')}, filled FROM gb"),
    "ball_gapfill_short": query(f"SELECT match_id, frame_num, {_all('cx cy')}, filled FROM short"),
    "ball_coverage": query("SELECT match_id, count(*) AS frames, count(*) FILTER (cx IS NOT NULL AND NOT filled) AS detected, count(cx) AS covered FROM short GROUP BY match_id"),
    "ball_velocity": query(f"SELECT match_id, frame_num, {_all('rolling dy')} FROM {_velocity('short')} v"),
    "shot_frames": query("SELECT match_id, shot_idx, frame_num FROM shots"),
    "shot_frames_ranged": query("SELECT match_id, shot_idx, frame_num FROM shots"),
    "shot_segments": query(f"SELECT match_id, seg_idx, sf, ef, {_all('dt px')} FROM seg"),
    "shot_attribution": query(f"SELECT match_id, seg_idx, sf, hitter, {_all('speed')} FROM att"),
    "player_distance": query(f"SELECT match_id, player_id, {_all('distance_covered avg_player_speed')}, steps FROM mv"),
    "frame_stats": query(f"SELECT match_id, frame_num, player_id, number_of_shots, {_all('total_shot_speed last_shot_speed total_player_speed last_player_speed average_shot_speed average_player_speed')} FROM fs"),
    "stat_spans": query("SELECT match_id, player_id, min(frame_num) AS valid_from, max(frame_num) AS valid_to, arg_max(number_of_shots, frame_num) AS number_of_shots, " + ", ".join(
        _r(f"arg_max({c}, frame_num)") + f" AS {c}" for c in ("total_shot_speed", "last_shot_speed", "total_player_speed", "last_player_speed", "average_shot_speed", "average_player_speed")
    ) + " FROM (SELECT fs.*, sum(CASE WHEN ev.frame_num IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY fs.match_id, fs.player_id ORDER BY fs.frame_num) AS island FROM fs LEFT JOIN ev ON ev.match_id = fs.match_id AND ev.frame_num = fs.frame_num AND ev.player_id = fs.player_id) GROUP BY match_id, player_id, island"),
    "hud_team_stats": query("SELECT match_id, frame_num, " + ", ".join(_r(f"(sum(CASE WHEN player_id IN {ids} THEN {c} ELSE 0 END) / 2)") + f" AS {n}_{t}" for t, ids in (("a", "(1, 2)"), ("b", "(3, 4)")) for n, c in _HUD) + " FROM fs GROUP BY ALL"),
    "match_player_summary": query(f"SELECT match_id, player_id, total_shots, {_all(_METRICS)} FROM su"),
    "team_totals": query("SELECT * FROM tt"),
    "head_to_head": query("SELECT match_id, metric, a, b, pct_a, 100 - pct_a AS pct_b, CASE WHEN a >= b THEN 'A' ELSE 'B' END AS leader FROM (SELECT match_id, metric, a, b, floor(100 * a / greatest(a + b, 1) + 0.5)::BIGINT AS pct_a FROM (" + " UNION ALL ".join(f"SELECT match_id, '{c}' AS metric, max({c}) FILTER (team = 'A')::DOUBLE AS a, max({c}) FILTER (team = 'B')::DOUBLE AS b FROM tt GROUP BY match_id" for c in ("total_shots " + _METRICS).split()) + "))"),
    "fast_smashes": query("SELECT match_id, ord, start_frame, end_frame, timestamp_seconds, label FROM sm"),
    "long_rallies": query(_RALLIES),
    "long_rallies_slow": query(_RALLIES, 12.0),
    "highlights_merged": query("SELECT * FROM mg"),
    "highlight_reel": query("""SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY clip_idx, k, i) - 1 AS seq, clip_idx, CASE k WHEN 0 THEN 'title' ELSE 'clip' END AS kind, frame_num FROM (
  SELECT match_id, clip_idx, 0 AS k, unnest(range(floor(fps)::BIGINT)) AS i, start_frame AS frame_num FROM cl JOIN m USING (match_id)
  UNION ALL SELECT match_id, clip_idx, 1, unnest(range(start_frame, end_frame + 1)) AS i, unnest(range(start_frame, end_frame + 1)) FROM cl)""").replace("jl AS (", "cl AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY start_frame) - 1 AS clip_idx FROM mg),\njl AS (", 1),
    "heatmap_bins": query("SELECT match_id, player_id, bx, by_ AS by, n FROM bins"),
    "heatmap_gate": query(f"SELECT match_id, player_id, n, {_all('sigma_x sigma_y')}, CASE WHEN n >= 2 AND (sigma_x > 0.05 OR sigma_y > 0.05) THEN 'density' ELSE 'scatter' END AS render_mode FROM (SELECT match_id, player_id, count(*) AS n, stddev_pop(x_m) AS sigma_x, stddev_pop(y_m) AS sigma_y FROM cp GROUP BY ALL)"),
    "heatmap_smoothed": query(f"SELECT match_id, player_id, bx::BIGINT AS bx, by_::BIGINT AS by, {_r('(v / (max(v) OVER (PARTITION BY match_id, player_id) + 1e-8))')} AS density FROM ky"),
    "ball_trajectory": query(f"SELECT match_id, frame_num, {_all('x_m y_m')}, {_zone('y_m')} AS zone, {_all('step')}, {_r('(step / greatest(max(step) OVER (PARTITION BY match_id), 1e-8))')} AS rel_speed, count(*) OVER (PARTITION BY match_id) < {P.min_positions} AS insufficient_data FROM tr"),
    "zone_occupancy": query(f"SELECT match_id, player_id, {_zone('y_m')} AS zone, count(*) AS frames FROM cp GROUP BY ALL"),
    "cache_plan": query("""SELECT match_id, total_frames AS frames, CASE WHEN held IS NULL THEN 'absent' WHEN version <> '1' THEN 'outdated' WHEN held < total_frames THEN 'short' ELSE 'cached' END AS status, gen
FROM m LEFT JOIN (SELECT match_id, arg_max(version, gen) AS version, arg_max(f, gen) AS held, max(gen) AS gen FROM (
  SELECT match_id, g AS gen, ((match_id + g) % 2)::VARCHAR AS version, total_frames - (match_id + g) % 3 AS f FROM m, (VALUES (0::BIGINT), (1), (2)) v(g) WHERE (match_id + g * 2) % 4 <> 0) GROUP BY match_id) USING (match_id)"""),
    "track_census": query("SELECT match_id, count(DISTINCT player_id) AS tracks, count(*) AS detections, array_to_string(list_sort(list(DISTINCT player_id)), ',') AS track_ids FROM trk GROUP BY match_id"),
    "job_status": query("SELECT job_id, status, stage, progress, error, strftime(created, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated_at FROM js"),
    "job_results": query("SELECT job_id, status, CASE WHEN status = 'done' THEN result END AS result, CASE WHEN status = 'done' AND result IS NOT NULL THEN '/outputs/' || job_id || '/video.mp4' END AS video_url, " + " ".join(f"CASE WHEN status = 'done' AND result IS NOT NULL THEN '/outputs/' || job_id || '/heatmap_p{i}.png' END AS heatmap_p{i}_url," for i in range(1, 5)) + " NULL::VARCHAR AS highlights_video_url, CASE WHEN status = 'done' AND result IS NOT NULL THEN '/outputs/' || job_id || '/shot_map.png' END AS shot_map_url, CASE WHEN status = 'error' THEN error END AS error FROM js"),
    "job_log_replay": query("""SELECT job_id, status, stage, progress, result, error FROM (
  SELECT job_id, arg_max(CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'processing' END, event_id) AS status,
    arg_max(CASE event_type WHEN 'signup' THEN 'Queued' WHEN 'purchase' THEN 'Done' WHEN 'error' THEN 'Error' ELSE event_type END, event_id) AS stage,
    arg_max(CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 100 ELSE k END, event_id) FILTER (event_type <> 'error') AS progress,
    arg_max(props, event_id) FILTER (event_type = 'purchase') AS result, arg_max('failed', event_id) FILTER (event_type = 'error') AS error
  FROM (SELECT 'job_' || user_id AS job_id, *, json_extract_string(props, '$.k')::BIGINT AS k, min(event_id) FILTER (event_type = 'signup') OVER (PARTITION BY user_id) AS born FROM events)
  WHERE event_id = born OR event_id > born AND event_type <> 'signup' GROUP BY job_id)"""),
    "analysis_document": query(f"SELECT match_id, to_json({{{', '.join(f"'player_{i}': p{i}" for i in range(1, 5))}, 'highlights': coalesce(h, []), 'total_frames': total_frames, 'fps': fps}})::VARCHAR AS document FROM m LEFT JOIN (SELECT match_id, {', '.join(f'any_value(s) FILTER (player_id = {i}) AS p{i}' for i in range(1, 5))} FROM (SELECT match_id, player_id, {_METRIC_STRUCT} AS s FROM su) GROUP BY match_id) USING (match_id) LEFT JOIN (SELECT match_id, list_sort(list({{'start_frame': start_frame, 'end_frame': end_frame, 'timestamp_seconds': timestamp_seconds, 'label': label}})) AS h FROM mg GROUP BY match_id) USING (match_id)"),
    "analysis_readback": query(f"SELECT match_id, player_id, s.*, total_frames, fps, coalesce(n, 0) AS n_highlights FROM (SELECT match_id, player_id, {_METRIC_STRUCT} AS s FROM su) JOIN m USING (match_id) LEFT JOIN (SELECT match_id, count(*) AS n FROM mg GROUP BY match_id) USING (match_id)").replace("s.*, total_frames", ", ".join(f"s.{c} AS {c}" for c in ("total_shots " + _METRICS).split()) + ", total_frames"),
    "ball_select_stateful": query("SELECT match_id, frame_num, box.x1 AS x1, box.y1 AS y1, box.x2 AS x2, box.y2 AS y2 FROM " + _chosen()),
    "player_slots": query("SELECT * FROM " + _slots()),
    "match_analysis": query(f"SELECT match_id, player_id, total_shots, {', '.join(f'{_r(c, 2)} AS {c}' for c in _METRICS.split())} FROM su", stateful=True),
}
