"""DuckDB forms of the queries on planned signals, on sounds and pictures; each stands for itself."""

from __future__ import annotations

from cadenza.sources import adapters

_N = adapters.LINE_SIZE

_VEC = "vec AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS video_id, CAST(vec_id % 50 AS INTEGER) AS t, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s, len(embedding) AS n FROM embeddings)"
_AROUND = "SELECT a.video_id, a.t, d, avg(b.v[d]) AS x FROM {src} AS a JOIN {src} AS b ON b.video_id = a.video_id AND abs(b.t - a.t) BETWEEN 3 AND 15, range(1, {size} + 1) AS r(d) GROUP BY ALL"
_LABELS = "['" + "', '".join(k for _, k in adapters.SCENES) + "']"


def _drift(src: str, size: int, dst: str) -> str:
    mean = f"SELECT video_id, t, list(x ORDER BY d) AS m FROM ({_AROUND.format(src=src, size=size)}) GROUP BY ALL"
    fine = "list_dot_product(v, v) > 0 AND list_dot_product(m, m) > 0"
    return f"{dst} AS (SELECT video_id, t, CASE WHEN {fine} THEN 1 - list_dot_product(v, m) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(m, m))) END AS drift FROM {src} LEFT JOIN ({mean}) USING (video_id, t))"


_SECONDS = f"""ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS pos, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS t, event_type, value FROM events),
spine AS (SELECT video_id, CAST(unnest(range((SELECT max(t) + 1 FROM ev))) AS INTEGER) AS t FROM (SELECT DISTINCT video_id FROM ev)),
newest AS (SELECT video_id, t, arg_max(event_type, pos) AS event_type, arg_max(value, pos) AS value FROM ev GROUP BY video_id, t),
av AS (SELECT s.video_id, s.t, CASE WHEN n.event_type = 'purchase' THEN 1 ELSE 0 END AS is_music, coalesce(n.value > 150, false) AS cut,
  [coalesce(floor(n.value) / 1024, 0) + 0.0625::DOUBLE, coalesce(n.value * 10, 0) / 1000, coalesce(n.value / 2000, 0) * 4, CASE WHEN n.event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END] AS sound,
  list_transform({_LABELS}, lambda k: CASE WHEN n.event_type IS NULL THEN 0.0::DOUBLE WHEN n.event_type = k THEN 0.625::DOUBLE ELSE 0.09375::DOUBLE END) AS scene FROM spine AS s LEFT JOIN newest AS n USING (video_id, t)),
sounds AS (SELECT video_id, t, sound AS v FROM av), scenes AS (SELECT video_id, t, scene AS v FROM av),
{_drift('sounds', 4, 'sound_drift')}, {_drift('scenes', len(adapters.SCENES), 'scene_drift')}"""

ORACLES: dict[str, str] = {
    "repeated_segments": f"""WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS video_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS t FROM documents),
placed AS (SELECT video_id, t, list_transform(regexp_extract_all(lower(line), '[^ \\t\\r]+'), lambda w: CAST('0x' || md5(w)[1:2] AS INTEGER) % {2 * _N}) AS place FROM lines),
seconds AS (SELECT video_id, t, list_transform(range({_N}), lambda d: CAST(len(list_filter(place, lambda p: p = d)) - len(list_filter(place, lambda p: p = d + {_N})) AS DOUBLE)) AS v FROM placed WHERE len(place) >= 3),
fine AS (SELECT video_id, t, v FROM seconds WHERE list_max(list_transform(v, lambda x: abs(x))) > 0),
nodes AS (SELECT v, row_number() OVER () AS node, CAST(v AS DOUBLE[{_N}]) AS a FROM (SELECT DISTINCT v FROM fine)),
near AS (SELECT p.node, q.node AS other, CASE WHEN p.node = q.node THEN 1.0 ELSE round(array_cosine_similarity(p.a, q.a), 9) END AS cosine FROM nodes AS p, nodes AS q WHERE array_cosine_similarity(p.a, q.a) >= 0.95),
told AS (SELECT video_id, t, node FROM fine JOIN nodes USING (v)),
found AS (SELECT p.video_id, p.t, q.video_id AS other_id, q.t AS other_t, cosine FROM told AS p JOIN near ON near.node = p.node JOIN told AS q ON q.node = near.other WHERE p.video_id <> q.video_id
  QUALIFY row_number() OVER (PARTITION BY p.video_id, p.t ORDER BY cosine DESC, q.video_id, q.t) <= 20),
one_way AS (SELECT DISTINCT least(video_id, other_id) AS video_id, greatest(video_id, other_id) AS other_id, CASE WHEN video_id < other_id THEN t ELSE other_t END AS t,
  CASE WHEN video_id < other_id THEN other_t - t ELSE t - other_t END AS shift, cosine FROM found),
islands AS (SELECT *, t - row_number() OVER (PARTITION BY video_id, other_id, shift ORDER BY t) AS island FROM one_way)
SELECT video_id, other_id, CAST(shift AS INTEGER) AS shift, CAST(min(t) AS INTEGER) AS start_sec, CAST(max(t) + 1 AS INTEGER) AS end_sec, count(*) AS n, round(avg(cosine), 6) AS cosine
FROM islands GROUP BY video_id, other_id, shift, island HAVING count(*) >= 3""",
    "upload_names": """WITH base AS (SELECT concat(event_type, '_', user_id % 20) AS name FROM events UNION SELECT event_type FROM events UNION SELECT concat(event_type, '_', user_id % 7, '_2') FROM events),
wanted AS (SELECT CASE user_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, '_', user_id % 40) ELSE concat(event_type, '_0', user_id % 5) END AS stem FROM events),
stems AS (SELECT stem, count(*) - CASE WHEN stem IN (SELECT name FROM base) THEN 0 ELSE 1 END AS later FROM wanted GROUP BY stem),
options AS (SELECT stem, later, concat(stem, '_', k) AS name, k FROM stems, (SELECT unnest(range(2, 30 + (SELECT max(later) + 40 FROM stems))) AS k)),
free AS (SELECT stem, later, name, row_number() OVER (PARTITION BY stem ORDER BY k) AS nth FROM options WHERE name NOT IN (SELECT name FROM base) AND name NOT IN (SELECT stem FROM stems))
SELECT stem, name FROM free WHERE nth <= later UNION ALL SELECT stem, stem FROM stems WHERE stem NOT IN (SELECT name FROM base)""",
    "broken_documents": """WITH ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS pos, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS t, event_type, value, user_id % 4 AS odd FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) - 1 AS k FROM ev),
info AS (SELECT DISTINCT video_id, odd FROM ev)
SELECT video_id, 'video_info.filename' AS path FROM info WHERE odd = 3 UNION ALL SELECT video_id, 'video_info.duration_sec' FROM info WHERE odd = 2
UNION ALL SELECT video_id, 'video_info.fps' FROM info WHERE odd <= 1 UNION ALL SELECT video_id, 'video_info.width' FROM info WHERE odd = 0 UNION ALL SELECT video_id, 'video_info.height' FROM info WHERE odd >= 1
UNION ALL SELECT video_id, concat('segments[', k, '].start_sec') FROM placed WHERE t < 100 UNION ALL SELECT video_id, concat('chapters[', k, '].start_sec') FROM placed WHERE t < 100
UNION ALL SELECT video_id, concat('segments[', k, '].label') FROM placed WHERE event_type NOT IN ('view', 'click', 'purchase')
UNION ALL SELECT video_id, concat('segments[', k, '].confidence') FROM placed WHERE value / 100 NOT BETWEEN 0 AND 1
UNION ALL SELECT video_id, concat('segments[', k, '].evidence') FROM placed WHERE pos % 11 = 0
UNION ALL SELECT video_id, concat('chapters[', k, '].chapter_id') FROM placed WHERE pos % 5 = 0 UNION ALL SELECT video_id, concat('chapters[', k, '].title') FROM placed WHERE pos % 2 = 1""",
    "sound_drift": f"WITH {_SECONDS} SELECT video_id, t, round(drift, 6) AS drift FROM sound_drift",
    "ad_block_of_drifts": f"""WITH {_SECONDS},
either AS (SELECT video_id, t, round(coalesce(max(drift), 0), 6) AS drift FROM (SELECT * FROM sound_drift UNION ALL SELECT * FROM scene_drift) GROUP BY video_id, t),
hot AS (SELECT video_id, t, t - row_number() OVER (PARTITION BY video_id ORDER BY t) AS island FROM either WHERE drift >= 0.5),
found AS (SELECT video_id, min(t) AS start_sec, max(t) + 1 AS end_sec FROM hot GROUP BY video_id, island HAVING count(*) >= 2)
SELECT f.video_id, f.start_sec, f.end_sec, CASE WHEN bool_or(cut AND abs(t - start_sec) <= 3) AND bool_or(cut AND abs(t - end_sec) <= 3) THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence
FROM found AS f JOIN av USING (video_id) GROUP BY ALL HAVING bool_or(is_music = 1 AND t >= start_sec AND t < end_sec)""",
    "sound_cepstra": f"""WITH {_VEC},
edges AS (SELECT i, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * exp((m - 15) * ln(6.4) / 27) END AS f FROM (SELECT i, 32 * 3 / 200.0::DOUBLE * i / 129 AS m FROM range(0, 130) AS r(i))),
weights AS (SELECT b, k, w * 2 / width AS w FROM (SELECT l.i AS b, k, greatest(0, least((k / 32.0::DOUBLE - l.f) / (c.f - l.f), (h.f - k / 32.0::DOUBLE) / (h.f - c.f))) AS w, h.f - l.f AS width
  FROM edges AS l JOIN edges AS c ON c.i = l.i + 1 JOIN edges AS h ON h.i = l.i + 2, range(0, 1025) AS q(k)) WHERE w > 0),
windowed AS (SELECT video_id, t, 1023 + j AS place, s[j] * (0.5 - 0.5 * cos(2 * pi() * (1023 + j) / 2048)) AS x FROM vec, range(1, n + 1) AS r(j)),
power AS (SELECT video_id, t, k, pow(sum(x * cos(2 * pi() * (k * place % 2048) / 2048)), 2) + pow(sum(x * sin(2 * pi() * (k * place % 2048) / 2048)), 2) AS p FROM windowed, range(0, 1025) AS q(k) GROUP BY ALL),
loud AS (SELECT video_id, t, b, 10 * log10(greatest(1e-10, sum(p * w))) AS db FROM power JOIN weights USING (k) GROUP BY ALL),
bands AS (SELECT video_id, t, b, coalesce(db, -100) AS db FROM (SELECT video_id, t, b FROM vec, range(0, 128) AS r(b)) LEFT JOIN loud USING (video_id, t, b)),
clipped AS (SELECT video_id, t, b, greatest(db, max(db) OVER (PARTITION BY video_id, t) - 80) AS db FROM bands)
SELECT video_id, t, CAST(k AS INTEGER) AS k, round_even(v * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 128.0::DOUBLE), 4) AS value
FROM (SELECT video_id, t, k, sum(db * cos(pi() * k * (2 * b + 1) / 256)) AS v FROM clipped, range(0, 20) AS q(k) GROUP BY video_id, t, k)""",
    "sound_features": f"""WITH {_VEC},
frames AS (SELECT video_id, t, f, j, CASE WHEN 32 * f + j BETWEEN 32 AND 95 THEN s[32 * f + j - 31] ELSE 0 END * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS x FROM vec, range(0, 3) AS q(f), range(0, 64) AS r(j)),
bins AS (SELECT video_id, t, f, k, sqrt(pow(sum(x * cos(2 * pi() * (k * j % 64) / 64)), 2) + pow(sum(x * sin(2 * pi() * (k * j % 64) / 64)), 2)) AS m FROM frames, range(0, 33) AS q(k) GROUP BY ALL),
mean AS (SELECT video_id, t, k, avg(m) + 1e-10 AS m FROM bins GROUP BY ALL),
share AS (SELECT video_id, t, k, m / sum(m) OVER (PARTITION BY video_id, t) AS p FROM mean),
centre AS (SELECT *, sum(k * p) OVER (PARTITION BY video_id, t) AS c FROM share),
spectral AS (SELECT video_id, t, any_value(c) AS c, sqrt(sum(pow(k - c, 2) * p)) AS b, -sum(p * log2(p + 1e-12)) AS e FROM centre GROUP BY ALL),
padded AS (SELECT video_id, t, list_concat(list_transform(range(1024), lambda i: s[1] < 0), list_transform(s, lambda x: x < 0), list_transform(range(1024), lambda i: s[n] < 0)) AS g FROM vec),
crossing AS (SELECT video_id, t, avg(len(list_filter(range(32 * f + 2, 32 * f + 2049), lambda i: g[i] <> g[i - 1])) / 2048) AS z FROM padded, range(0, 3) AS q(f) GROUP BY ALL)
SELECT video_id, t, round_even(sqrt(list_dot_product(s, s) / n), 6) AS rms_energy, round_even(c, 2) AS spectral_centroid, round_even(b, 2) AS spectral_bandwidth, round_even(z, 6) AS zero_crossing_rate, round_even(e, 4) AS spectral_entropy
FROM vec JOIN spectral USING (video_id, t) JOIN crossing USING (video_id, t)""",
    "frame_features": f"""WITH {_VEC},
pixels AS (SELECT video_id, t, i - 1 AS i, CAST(least(255, greatest(0, round(s[i] * 100 + 128))) AS BIGINT) AS p FROM vec, range(1, 65) AS r(i)),
counts AS (SELECT video_id, t, k, count(i) AS c FROM (SELECT video_id, t, k FROM vec, range(0, 8) AS r(k)) LEFT JOIN (SELECT video_id, t, i, p // 32 AS k FROM pixels) USING (video_id, t, k) GROUP BY ALL),
frames AS (SELECT *, lag(h) OVER w AS before, lag(ps) OVER w AS earlier FROM (SELECT video_id, t, list(c ORDER BY k) AS h FROM counts GROUP BY ALL)
  JOIN (SELECT video_id, t, list(p ORDER BY i) AS ps, sum(p) / 64 AS mean, sum(p * p) / 64 AS square FROM pixels GROUP BY ALL) USING (video_id, t) WINDOW w AS (PARTITION BY video_id ORDER BY t)),
detail AS (SELECT video_id, t, sum(c * c) / 4096 AS e FROM (
  SELECT video_id, t, u, v, sum(p * cos((2 * (i // 8) + 1) * u * pi() / 16) * cos((2 * (i % 8) + 1) * v * pi() / 16)) / 4 AS c FROM pixels, range(4, 8) AS q(u), range(4, 8) AS r(v) GROUP BY ALL) GROUP BY ALL),
told AS (SELECT *, CASE WHEN before IS NULL THEN 0 ELSE round_even(greatest(0, 1 - (list_dot_product(h, before) - 8) / sqrt((list_dot_product(h, h) - 8) * (list_dot_product(before, before) - 8))), 6) END AS d FROM frames JOIN detail USING (video_id, t))
SELECT video_id, t AS frame_index, CAST(t AS DOUBLE) AS timestamp_sec, d AS hist_diff_to_previous, d > 0.6 AS is_hard_cut, mean AS mean_luminance, square - mean * mean AS luminance_variance,
  mean < 10 AND square - mean * mean < 50 AS is_black_frame, CASE WHEN earlier IS NULL THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: abs(ps[i] - earlier[i]))) / 64 END AS motion_intensity,
  0.0::DOUBLE AS chroma_diff, round(e, 6) AS dct_hf_energy FROM told""",
    "stale_stages": """WITH stamps AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS done_at,
  CASE WHEN event_type IN ('view', 'click') THEN event_type WHEN event_type = 'purchase' THEN 'sound' WHEN event_type = 'signup' THEN 'pictures' WHEN event_id % 3 > 0 THEN 'fusion' ELSE 'export' END AS stage
  FROM events WHERE event_type IN ('error', 'signup') OR event_id % 7 = 0),
times AS (SELECT video_id, max(done_at) FILTER (WHERE stage = 'view') AS v, max(done_at) FILTER (WHERE stage = 'click') AS c, max(done_at) FILTER (WHERE stage = 'sound') AS s, max(done_at) FILTER (WHERE stage = 'pictures') AS p,
  max(done_at) FILTER (WHERE stage = 'fusion') AS f, max(done_at) FILTER (WHERE stage = 'export') AS e FROM stamps GROUP BY video_id),
first AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN s IS NULL THEN 'missing' WHEN v > s THEN 'older' END AS sound, CASE WHEN c IS NULL THEN NULL WHEN p IS NULL THEN 'missing' WHEN c > p THEN 'older' END AS pictures FROM times),
second AS (SELECT *, CASE WHEN v IS NULL OR c IS NULL THEN NULL WHEN f IS NULL THEN 'missing' WHEN s > f OR p > f THEN 'older' WHEN sound IS NOT NULL OR pictures IS NOT NULL THEN 'of stale' END AS fusion FROM first),
third AS (SELECT *, CASE WHEN v IS NULL OR c IS NULL THEN NULL WHEN e IS NULL THEN 'missing' WHEN f > e OR v > e THEN 'older' WHEN fusion IS NOT NULL THEN 'of stale' END AS export FROM second)
SELECT video_id, stage, reason FROM (SELECT video_id, unnest(['sound', 'pictures', 'fusion', 'export']) AS stage, unnest([sound, pictures, fusion, export]) AS reason FROM third) WHERE reason IS NOT NULL""",
}
