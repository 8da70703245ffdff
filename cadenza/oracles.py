"""DuckDB forms of the queries: a chain of common table expressions, and one SELECT for each query."""

from __future__ import annotations

from cadenza.config import DEFAULT, SCENES
from cadenza.sources import adapters


def _keyword_case(group: str, phrases: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') THEN '{group}:{p}'" for p in phrases) + " END"


def _group(name: str) -> str:
    return f"list_filter(matched_keywords, lambda m: starts_with(m, '{name}:'))[1]"


_KEYWORDS = ", ".join(_keyword_case(g, p) for g, p in adapters.PROSE.keywords.items())
_LABELS = ", ".join(f"'{s}'" for s, _ in adapters.SCENES)
_PROBS = ", ".join(f"CASE WHEN event_type = '{k}' THEN 0.625::DOUBLE ELSE 0.09375::DOUBLE END" for _, k in adapters.SCENES)
_MAPPED = "CASE " + " ".join(f"WHEN contains(scene, '{part}') THEN '{label}'" for part, label in SCENES) + " ELSE 'core_content' END"
_SCALED = "list_transform({v}, lambda x: greatest(1e-9, least(1.0, x)))"


def _runs(name: str, where: str, least: int, gap: int = 0) -> str:
    return f"""{name} AS (
  SELECT video_id, min(t) AS start_sec, max(t) + 1 AS end_sec FROM (
    SELECT video_id, t, sum(new) OVER (PARTITION BY video_id ORDER BY t) AS island FROM (
      SELECT video_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t) - 1 > {gap} THEN 1 ELSE 0 END AS new FROM grid WHERE {where}
    )
  ) GROUP BY video_id, island HAVING max(t) + 1 - min(t) >= {least}
)"""


def _window(name: str, group: str, label: str, before: int, after: int, conf: float, rank: int) -> str:
    return f"""{name} AS (
  SELECT video_id, CAST(greatest(0, floor("start" - {before})) AS INTEGER) AS start_sec, CAST(least((SELECT n FROM span), ceil("end" + {after})) AS INTEGER) AS end_sec,
    '{label}' AS label, {_group(group)} AS rule_name, {conf}::DOUBLE AS confidence, {rank} AS rule_rank, CAST(pos AS BIGINT) AS ord
  FROM txt WHERE {_group(group)} IS NOT NULL AND video_id IN (SELECT video_id FROM users)
)"""


def _merge(src: str, dst: str) -> str:
    return f"""{dst} AS (
  SELECT video_id, arg_min(segment_id, start_sec) AS segment_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, arg_min(label, start_sec) AS label,
    max(confidence) AS confidence, max(visual_score) AS visual_score, max(audio_score) AS audio_score, max(text_score) AS text_score,
    CASE WHEN count(*) = 1 THEN any_value(triggered_rules) ELSE list_sort(list_distinct(flatten(list(triggered_rules)))) END AS triggered_rules,
    max({{'n': length(summary), 'back': -start_sec, 'summary': summary}}).summary AS summary
  FROM (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_sec) AS island FROM (
    SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY video_id ORDER BY start_sec) THEN 0 ELSE 1 END AS new FROM {src}))
  GROUP BY video_id, island
)"""


_SEG = "{'segment_id': segment_id, 'start_sec': start_sec, 'end_sec': end_sec, 'label': label, 'confidence': confidence, 'visual_score': visual_score, 'audio_score': audio_score, 'text_score': text_score, 'triggered_rules': triggered_rules, 'summary': summary}"
_SEG_FROM = "{{'segment_id': {s}.segment_id, 'start_sec': {a}, 'end_sec': {b}, 'label': {s}.label, 'confidence': {s}.confidence, 'visual_score': {s}.visual_score, 'audio_score': {s}.audio_score, 'text_score': {s}.text_score, 'triggered_rules': {s}.triggered_rules, 'summary': {s}.summary}}"


def _absorb(src: str, dst: str) -> str:
    begin, s = "coalesce(carry, segs[i].start_sec)", "segs[i]"
    short = f"({s}.end_sec - {begin} < 2.0 AND len(segs) > 1)"
    left = "(i = len(segs) OR done[-1].confidence >= segs[i + 1].confidence)"
    longer = f"list_concat(done[1:len(done) - 1], [{_SEG_FROM.format(s='done[-1]', a='done[-1].start_sec', b='segs[i].end_sec')}])"
    added = f"list_concat(done, [{_SEG_FROM.format(s='segs[i]', a=begin, b='segs[i].end_sec')}])"
    carries = f"({short} AND ((len(done) = 0 AND i < len(segs)) OR (len(done) > 0 AND NOT {left})))"
    return f"""{dst}_list AS (SELECT video_id, list({_SEG} ORDER BY start_sec) AS segs FROM {src} GROUP BY video_id),
{dst}_fold AS (
  SELECT video_id, segs, CAST(1 AS BIGINT) AS i, segs[1:0] AS done, CAST(NULL AS DOUBLE) AS carry FROM {dst}_list
  UNION ALL
  SELECT video_id, segs, i + 1, CASE WHEN {carries} THEN done WHEN {short} AND len(done) > 0 THEN {longer} ELSE {added} END,
    CASE WHEN {carries} THEN {begin} END
  FROM {dst}_fold WHERE i <= len(segs)
),
{dst} AS (SELECT video_id, s.* FROM (SELECT video_id, unnest(done) AS s FROM {dst}_fold WHERE i = len(segs) + 1))"""


def _bridge(src: str, dst: str) -> str:
    by = "OVER (PARTITION BY video_id ORDER BY start_sec)"
    return f"""{dst}_marked AS (
  SELECT *, coalesce(label <> 'sponsorship' AND lag(label) {by} = 'sponsorship' AND lead(label) {by} = 'sponsorship' AND end_sec - start_sec <= 12.0, false) AS bridge FROM {src}
), {dst}_islands AS (
  SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) {by} AS island FROM (SELECT *, bridge OR coalesce(lag(bridge) {by}, false) AS joins FROM {dst}_marked)
), {dst} AS (
  SELECT video_id, arg_min(segment_id, start_sec) AS segment_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, arg_min(label, start_sec) AS label,
    coalesce(min(confidence) FILTER (WHERE label = 'sponsorship'), max(confidence)) AS confidence, max(visual_score) AS visual_score, max(audio_score) AS audio_score,
    max(text_score) AS text_score,
    CASE WHEN count(*) = 1 THEN any_value(triggered_rules) ELSE list_sort(list_distinct(list_concat(flatten(list(triggered_rules)), ['sponsorship_bridge']))) END AS triggered_rules,
    max({{'n': length(summary), 'back': -start_sec, 'summary': summary}}).summary AS summary
  FROM {dst}_islands GROUP BY video_id, island
)"""


def _represent(spans: str, key: str, dst: str, chars: int) -> str:
    return f"""{dst}_told AS (
  SELECT p.video_id, p.{key}, s.pos, s.text, e.unit FROM {spans} p JOIN txt s ON p.video_id = s.video_id AND s."end" > p.start_sec AND s."start" < p.end_sec
  LEFT JOIN units e ON e.video_id = s.video_id AND e.id = s.id
), {dst}_centre AS (
  SELECT video_id, {key}, list(x ORDER BY d) AS c, sqrt(sum(x * x)) AS norm FROM (
    SELECT video_id, {key}, d, avg(unit[d]) AS x FROM {dst}_told, range(1, 65) r(d) WHERE unit IS NOT NULL GROUP BY ALL) GROUP BY ALL
), {dst}_near AS (
  SELECT t.*, CASE WHEN c.norm > 1e-12 THEN round(list_dot_product(t.unit, c.c) / c.norm, 9) END AS near FROM {dst}_told t LEFT JOIN {dst}_centre c USING (video_id, {key})
), {dst} AS (
  SELECT video_id, {key}, left(regexp_replace(coalesce(
    max({{'near': near, 'back': -pos, 'text': text}}) FILTER (WHERE near IS NOT NULL).text, max({{'n': length(text), 'back': -pos, 'text': text}}).text), '^\\s+|\\s+$', '', 'g'), {chars}) AS text
  FROM {dst}_near GROUP BY video_id, {key}
)"""


CTES = [
    """ev AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS pos, CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS INTEGER) AS t, event_type, value FROM events)""",
    "users AS (SELECT DISTINCT video_id FROM ev)",
    "span AS (SELECT CAST(max(t) + 1 AS INTEGER) AS n FROM ev)",
    "spine AS (SELECT video_id, CAST(unnest(range(n)) AS INTEGER) AS t FROM users, span)",
    """newest AS (SELECT video_id, t, arg_max(event_type, pos) AS event_type, arg_max(value, pos) AS value FROM ev GROUP BY video_id, t)""",
    f"""av AS (SELECT s.video_id, s.t,
    CASE WHEN n.event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS is_speech, coalesce(floor(n.value) / 1024, 0) AS rms_energy,
    CASE WHEN n.event_type = 'purchase' THEN 1 ELSE 0 END AS is_music, coalesce(floor(n.value) / 512, 0) AS hist_diff, CASE WHEN n.value > 150 THEN 1 ELSE 0 END AS is_hard_cut,
    coalesce(n.value * 10, 0) AS spectral_centroid, coalesce(n.value * 5, 0) AS spectral_bandwidth, coalesce(n.value / 2000, 0) AS zero_crossing_rate,
    CASE WHEN n.event_type IS NULL THEN [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] ELSE [{_PROBS}] END AS scene
  FROM spine s LEFT JOIN newest n USING (video_id, t))""",
    """sent AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, CAST(turn AS INTEGER) AS pos, CAST(turn AS INTEGER) AS id,
    (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - length(text)) / 15 AS "start",
    sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) / 15 AS "end", text FROM conversations)""",
    "vec AS (SELECT CAST(vec_id // 50 AS VARCHAR) AS video_id, CAST(vec_id % 50 AS INTEGER) AS id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding FROM embeddings)",
    "units AS (SELECT video_id, id, list_transform(embedding, lambda x: x / n) AS unit FROM (SELECT *, CASE WHEN list_dot_product(embedding, embedding) = 0 THEN 1 ELSE sqrt(list_dot_product(embedding, embedding)) END AS n FROM vec))",
    f"""txt AS (SELECT s.*, round(list_cosine_similarity(v.embedding, lead(v.embedding) OVER (PARTITION BY s.video_id ORDER BY s.pos)) * 1048576) / 1048576 AS similarity_to_next,
    list_filter([{_KEYWORDS}], lambda m: m IS NOT NULL) AS matched_keywords FROM sent s LEFT JOIN vec v USING (video_id, id))""",
    """touched AS (SELECT video_id, unnest(range(CAST(greatest(0, floor("start")) AS INTEGER), CAST(least((SELECT n FROM span), ceil("end")) AS INTEGER))) AS t, pos, id, similarity_to_next
  FROM txt WHERE video_id IN (SELECT video_id FROM users))""",
    """spoken AS (SELECT video_id, t, arg_max(id, pos) AS id, arg_max(similarity_to_next, pos) FILTER (WHERE similarity_to_next IS NOT NULL) AS sim FROM touched GROUP BY video_id, t)""",
    """grid AS (SELECT a.*, s.sim AS text_sim_to_next, CASE WHEN s.id IS NULL THEN 0 ELSE 1 END AS has_text, CAST(coalesce(s.id, -1) AS INTEGER) AS text_sentence_id
  FROM av a LEFT JOIN spoken s USING (video_id, t))""",
    _runs("run_dead", "is_speech = 0 AND rms_energy < 0.01", DEFAULT.dead_air_run),
    _runs("run_hold", "hist_diff < 0.05 AND is_speech = 0", DEFAULT.holding_run),
    _runs("run_ad", "is_speech = 0", DEFAULT.ad_run, DEFAULT.ad_gap),
    _window("kw_sponsor", "sponsor", "sponsorship", 15, 15, 0.85, 2),
    _window("kw_promo", "self_promo", "self_promotion", 5, 5, 0.75, 3),
    _window("kw_recap", "recap", "recap", 5, 30, 0.7, 4),
    f"""kw_intro AS (
  SELECT video_id, 0 AS start_sec, CAST(least((SELECT n FROM span), ceil("end" + 10)) AS INTEGER) AS end_sec, 'intro' AS label, rule_name, 0.7::DOUBLE AS confidence, 5 AS rule_rank, CAST(pos AS BIGINT) AS ord FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS k FROM (
      SELECT *, {_group("intro")} AS rule_name, max("start" > 90) OVER (PARTITION BY video_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS late FROM txt WHERE video_id IN (SELECT video_id FROM users)
    ) WHERE NOT late AND rule_name IS NOT NULL) WHERE k = 1
)""",
    f"""kw_outro AS (
  SELECT video_id, CAST(greatest(0, floor("start" - 5)) AS INTEGER) AS start_sec, (SELECT n FROM span) AS end_sec, 'outro' AS label, rule_name, 0.8::DOUBLE AS confidence, 6 AS rule_rank, CAST(pos AS BIGINT) AS ord FROM (
    SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS k FROM (
      SELECT *, {_group("outro")} AS rule_name FROM txt WHERE "end" >= 630 AND video_id IN (SELECT video_id FROM users)
    ) WHERE rule_name IS NOT NULL) WHERE k = 1
)""",
    """hits AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY rule_rank, ord) AS INTEGER) AS hit_ord, start_sec, end_sec, label, rule_name, confidence FROM (
  SELECT video_id, start_sec, end_sec, 'dead_air' AS label, 'dead_air' AS rule_name, 0.9::DOUBLE AS confidence, 0 AS rule_rank, CAST(start_sec AS BIGINT) AS ord FROM run_dead
  UNION ALL SELECT video_id, start_sec, end_sec, 'holding_screen', 'holding_screen', 0.7::DOUBLE, 1, start_sec FROM run_hold
  UNION ALL SELECT * FROM kw_sponsor UNION ALL SELECT * FROM kw_promo UNION ALL SELECT * FROM kw_recap UNION ALL SELECT * FROM kw_intro UNION ALL SELECT * FROM kw_outro
  UNION ALL SELECT video_id, start_sec, end_sec, 'sponsorship', 'ad_break', 0.85::DOUBLE, 7, start_sec FROM run_ad))""",
    """lagged AS (SELECT *, lag(scene) OVER w AS scene_before, lag(is_speech) OVER w AS speech_before, lag(is_music) OVER w AS music_before FROM grid WINDOW w AS (PARTITION BY video_id ORDER BY t))""",
    f"""scaled AS (SELECT *, {_SCALED.format(v="scene")} AS p, {_SCALED.format(v="scene_before")} AS q FROM lagged WHERE scene_before IS NOT NULL AND scene <> scene_before)""",
    """shifts AS (SELECT video_id, t, divergence FROM (
  SELECT video_id, t, list_sum(list_transform(list_zip(p, q), lambda z: 0.5 * (z[1] / list_sum(p) - z[2] / list_sum(q)) * ln((z[1] / list_sum(p)) / (z[2] / list_sum(q))))) AS divergence FROM scaled
) WHERE divergence > 0.3)""",
    """flips AS (SELECT video_id, t, 'speech' AS kind FROM lagged WHERE is_speech <> speech_before UNION ALL SELECT video_id, t, 'music' FROM lagged WHERE is_music <> music_before)""",
    "lows AS (SELECT video_id, t + 1 AS t FROM grid WHERE text_sim_to_next < 0.35)",
    """cand AS (SELECT DISTINCT video_id, CAST(t AS INTEGER) AS t FROM (SELECT video_id, t FROM grid WHERE is_hard_cut = 1 UNION ALL SELECT video_id, t FROM shifts UNION ALL SELECT video_id, t FROM flips
  UNION ALL SELECT video_id, t FROM lows UNION ALL SELECT video_id, 0 FROM users UNION ALL SELECT video_id, (SELECT n FROM span) FROM users))""",
    """kept AS (
  SELECT video_id, cs, cs[1] AS b FROM (SELECT video_id, list(t ORDER BY t) AS cs FROM cand GROUP BY video_id)
  UNION ALL SELECT video_id, cs, list_filter(cs, lambda x: x >= b + 3)[1] FROM kept WHERE cs[-1] >= b + 3)""",
    "bounds AS (SELECT DISTINCT video_id, b FROM (SELECT video_id, b FROM kept UNION ALL SELECT video_id, (SELECT n FROM span) FROM users))",
    """seg AS (SELECT * FROM (SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS segment_id, b AS start_sec, lead(b) OVER w AS end_sec FROM bounds WINDOW w AS (PARTITION BY video_id ORDER BY b)) WHERE end_sec > start_sec)""",
    """means AS (SELECT s.video_id, s.segment_id, avg(is_speech) AS is_speech, avg(rms_energy) AS rms_energy, avg(is_music) AS is_music, avg(hist_diff) AS hist_diff, avg(is_hard_cut) AS is_hard_cut,
    avg(has_text) AS has_text, coalesce(avg(text_sim_to_next), 0) AS text_sim_to_next FROM seg s JOIN grid g ON g.video_id = s.video_id AND g.t >= s.start_sec AND g.t < s.end_sec GROUP BY ALL)""",
    f"""best AS (SELECT video_id, segment_id, m.prob AS prob, [{_LABELS}][-m.back] AS scene FROM (SELECT video_id, segment_id, max({{'prob': prob, 'back': -d}}) AS m FROM (
  SELECT s.video_id, s.segment_id, CAST(d AS INTEGER) AS d, round(avg(g.scene[d]), 9) AS prob FROM seg s JOIN grid g ON g.video_id = s.video_id AND g.t >= s.start_sec AND g.t < s.end_sec, range(1, 6) r(d) GROUP BY ALL) GROUP BY ALL))""",
    """cover AS (SELECT s.video_id, s.segment_id, max({'confidence': h.confidence, 'back': -h.hit_ord, 'label': h.label}) AS m, list(h.rule_name ORDER BY h.hit_ord) AS rules
  FROM seg s JOIN hits h ON h.video_id = s.video_id AND greatest(0, least(s.end_sec, h.end_sec) - greatest(s.start_sec, h.start_sec)) / greatest(1, s.end_sec - s.start_sec) >= 0.25 GROUP BY ALL)""",
    """longest AS (SELECT p.video_id, p.segment_id, left(regexp_replace(max({'inside': s."start" >= p.start_sec AND s."end" <= p.end_sec, 'n': length(s.text), 'back': -s.pos, 'text': s.text}).text, '^\\s+|\\s+$', '', 'g'), 200) AS summary
  FROM seg p JOIN txt s ON p.video_id = s.video_id AND ((s."start" >= p.start_sec AND s."end" <= p.end_sec) OR (s."end" > p.start_sec AND s."start" < p.end_sec)) GROUP BY ALL)""",
    f"""classified AS (SELECT s.video_id, s.segment_id, s.start_sec::DOUBLE AS start_sec, s.end_sec::DOUBLE AS end_sec,
    coalesce(c.m.label, CASE WHEN m.is_speech < 0.1 AND {_MAPPED} = 'core_content' THEN 'filler' ELSE {_MAPPED} END) AS label,
    round(coalesce(c.m.confidence, (b.prob + m.is_speech + m.has_text) / 3.0), 3) AS confidence, round(b.prob, 3) AS visual_score, round(m.is_speech, 3) AS audio_score, round(m.has_text, 3) AS text_score,
    coalesce(c.rules, []) AS triggered_rules, coalesce(l.summary, '') AS summary
  FROM seg s JOIN means m USING (video_id, segment_id) JOIN best b USING (video_id, segment_id) LEFT JOIN cover c USING (video_id, segment_id) LEFT JOIN longest l USING (video_id, segment_id))""",
    _merge("classified", "merged"),
    _absorb("merged", "absorbed"),
    _merge("absorbed", "again"),
    _bridge("again", "bridged"),
    "smoothed AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_sec) - 1 AS INTEGER) AS segment_id) FROM bridged)",
    _represent("smoothed", "segment_id", "rep", 200),
    """spans AS (SELECT video_id, CAST(island - 1 AS INTEGER) AS chapter_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM (
  SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY start_sec) AS island FROM (
    SELECT *, CASE WHEN label = 'core_content' AND coalesce(lag(label) OVER (PARTITION BY video_id ORDER BY start_sec), '') <> 'core_content' THEN 1 ELSE 0 END AS new FROM smoothed)
  ) WHERE label = 'core_content' GROUP BY video_id, island)""",
    _represent("spans", "chapter_id", "chap", 80),
]

_SEG_COLUMNS = "video_id, segment_id, start_sec, end_sec, label, confidence, visual_score, audio_score, text_score, list_aggregate(triggered_rules, 'string_agg', '|') AS rules, summary"


def oracle(select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(CTES) + "\n" + select


SELECTS: dict[str, str] = {
    "grid_audio": "SELECT video_id, t, is_speech, round(rms_energy, 6) AS rms_energy, round(spectral_centroid, 6) AS spectral_centroid, round(zero_crossing_rate, 6) AS zero_crossing_rate, is_music FROM av",
    "grid_scene": f"SELECT video_id, t, [{_LABELS}][CAST(d AS INTEGER)] AS label, scene[CAST(d AS INTEGER)] AS prob FROM av, range(1, 6) r(d)",
    "grid_text": "SELECT video_id, t, round(text_sim_to_next, 6) AS text_sim_to_next, has_text, text_sentence_id FROM grid",
    "runs_dead_air": "SELECT video_id, start_sec, end_sec FROM run_dead",
    "runs_holding": "SELECT video_id, start_sec, end_sec FROM run_hold",
    "runs_ad_break": "SELECT video_id, start_sec, end_sec FROM run_ad",
    "rule_keyword_windows": "SELECT video_id, start_sec, end_sec, label, rule_name, confidence FROM (SELECT * FROM kw_sponsor UNION ALL SELECT * FROM kw_promo UNION ALL SELECT * FROM kw_recap)",
    "rule_intro_first": "SELECT video_id, start_sec, end_sec, rule_name FROM kw_intro",
    "rule_outro_first": "SELECT video_id, start_sec, end_sec, rule_name FROM kw_outro",
    "rules_all": "SELECT * FROM hits",
    "kl_shift": "SELECT video_id, t, round(divergence, 6) AS divergence FROM shifts",
    "flips": "SELECT video_id, t, kind FROM flips",
    "low_similarity": "SELECT video_id, CAST(t AS INTEGER) AS t FROM lows",
    "boundary_candidates": "SELECT video_id, t FROM cand",
    "boundaries": "SELECT video_id, b AS boundary FROM bounds",
    "segment_means": "SELECT * FROM means",
    "rule_coverage": "SELECT video_id, segment_id, m.label AS label, m.confidence AS confidence, list_aggregate(rules, 'string_agg', '|') AS rules FROM cover",
    "scene_argmax": f"SELECT video_id, segment_id, round(prob, 6) AS prob, scene, {_MAPPED} AS label FROM best",
    "classified": f"SELECT {_SEG_COLUMNS} FROM classified",
    "merge_adjacent": f"SELECT {_SEG_COLUMNS} FROM merged",
    "absorb_short": f"SELECT {_SEG_COLUMNS} FROM absorbed",
    "bridge": f"SELECT {_SEG_COLUMNS} FROM bridged",
    "smoothed": f"SELECT {_SEG_COLUMNS} FROM smoothed",
    "summaries": "SELECT video_id, segment_id, summary FROM longest",
    "representative_sentence": "SELECT video_id, segment_id, text FROM rep",
    "chapters": """SELECT video_id, chapter_id, start_sec, end_sec, CASE WHEN coalesce(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), '') = '' THEN concat('Chapter ', chapter_id + 1)
  WHEN length(regexp_replace(c.text, '\\s+', ' ', 'g')) >= 80 THEN concat(regexp_replace(left(regexp_replace(c.text, '\\s+', ' ', 'g'), 77), ' [^ ]*$', ''), '...')
  ELSE regexp_replace(c.text, '\\s+', ' ', 'g') END AS title FROM spans LEFT JOIN chap c USING (video_id, chapter_id)""",
    "skip_list": "SELECT video_id, coalesce(string_agg(segment_id, ',' ORDER BY segment_id) FILTER (WHERE label <> 'core_content'), '') AS skip_suggestions FROM smoothed GROUP BY video_id",
    "next_segment": """SELECT p.video_id, p.now, min({'start_sec': s.start_sec, 'segment_id': s.segment_id}).start_sec AS start_sec, min({'start_sec': s.start_sec, 'segment_id': s.segment_id}).segment_id AS segment_id
  FROM (SELECT video_id, t + 0.5 AS now FROM ev GROUP BY ALL) p JOIN smoothed s ON p.video_id = s.video_id AND s.start_sec > p.now + 0.05 GROUP BY p.video_id, p.now""",
    "skip_target": """SELECT p.video_id, p.now, s.end_sec + 0.05 AS target FROM (SELECT video_id, t + 0.5 AS now FROM ev GROUP BY ALL) p
  JOIN smoothed s ON p.video_id = s.video_id AND p.now >= s.start_sec AND p.now < s.end_sec AND s.label <> 'core_content'""",
    "relabel": "SELECT video_id, segment_id, CASE WHEN segment_id = 1 THEN 'core_content' ELSE label END AS label, segment_id = 1 AS user_corrected FROM smoothed",
    "audio_class": "SELECT event_id, CASE WHEN value / 1000 < 0.001 THEN 'silence' WHEN value / 2000 > 0.1 THEN 'speech' WHEN value / 1000 > 0.01 THEN 'music' ELSE 'noise' END AS audio_class FROM events",
    "keyword_match": "SELECT video_id, pos, list_aggregate(matched_keywords, 'string_agg', '|') AS matched FROM txt",
    "similarity_to_next": "SELECT video_id, pos, similarity_to_next, coalesce(similarity_to_next < 0.35, false) AS is_potential_boundary FROM txt",
    "spectral_entropy_embed": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: -(abs(x::DOUBLE) / s) * log2(abs(x::DOUBLE) / s + 1e-12))), 6) AS entropy FROM (SELECT *, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS s FROM embeddings)",
    "black_frame_stats": "SELECT video_id, t, round(avg(value), 6) AS mean, round(var_pop(value), 6) AS variance, avg(value) < 10 AND var_pop(value) < 50 AS is_black FROM ev GROUP BY video_id, t",
    "list_videos": "SELECT video_id, count(*) AS n_segments, max(end_sec) AS duration_sec FROM smoothed WHERE video_id IN (SELECT video_id FROM sent) GROUP BY video_id",
    "cache_miss": "SELECT video_id FROM users WHERE video_id NOT IN (SELECT video_id FROM sent)",
}

_COMMERCIAL = " OR ".join(
    f"regexp_matches(text, '{p}')"
    for p in (
        r"(?i)\b(?:https?://|www\.)\S+|\b[a-z0-9-]+\.(?:com|net|org|io|co)\b",
        r"[$€£]\s?\d+(?:[.,]\d{2})?|\b\d+(?:[.,]\d{2})?\s?(?:usd|eur|gbp)\b",
        r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b",
        r"(?i)\b(?:order now|buy now|call now|shop now|sign up|free trial|limited time|use code|learn more)\b",
        "[™®©]",
    )
)

SELECTS |= {
    "documents": """SELECT video_id, concat(video_id, '.mp4') AS filename, '0.4.0' AS analysis_version, CAST(count(*) AS INTEGER) AS n_segments,
    CAST((SELECT count(*) FROM spans p WHERE p.video_id = s.video_id) AS INTEGER) AS n_chapters, CAST(count(*) FILTER (WHERE label <> 'core_content') AS INTEGER) AS n_skip FROM smoothed s GROUP BY video_id""",
    "unknown_keys": "SELECT event_id, coalesce(list_aggregate(list_filter(json_keys(props), lambda k: k NOT IN ('id', 'value')), 'string_agg', ','), '') AS unknown FROM events",
    "timeline": "SELECT video_id, segment_id, round((end_sec - start_sec) / (SELECT n FROM span) * 100, 6) AS width FROM smoothed",
    "safe_stems": r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(CASE WHEN regexp_matches(n, '.\.[^.]*$') THEN regexp_replace(n, '\.[^.]*$', '') ELSE n END, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'video') AS stem
  FROM (SELECT page_id, regexp_replace(url, '^.*/', '') AS n FROM pages)""",
    "free_names": """SELECT stem, CASE WHEN EXISTS (SELECT 1 FROM taken WHERE name = stem) THEN concat(stem, '_', (SELECT min(k) FROM range(2, 30) r(k) WHERE concat(stem, '_', k) NOT IN (SELECT name FROM taken))) ELSE stem END AS name
  FROM (SELECT DISTINCT event_type AS stem FROM events)""",
    "job_status": """SELECT job_id, status, CASE WHEN began IS NULL THEN 0.0 ELSE round(coalesce(ended, 1e9) - began, 1) END AS elapsed FROM (
  SELECT user_id AS job_id, arg_max(CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type IN ('click', 'view') THEN 'running' WHEN event_type = 'purchase' THEN 'done' ELSE 'error' END, event_id) AS status,
    min(event_id) FILTER (WHERE event_type IN ('click', 'view'))::DOUBLE AS began, max(event_id) FILTER (WHERE event_type IN ('purchase', 'error'))::DOUBLE AS ended FROM events GROUP BY user_id)""",
    "live_grid": "SELECT CAST(user_id AS VARCHAR) AS video_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS n, max(value) AS top FROM events GROUP BY ALL",
    "quiet_sessions": """SELECT video_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ts) AS island FROM (
    SELECT CAST(user_id AS VARCHAR) AS video_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE value < 30)
  ) GROUP BY video_id, island""",
    "commercial_text": f"SELECT doc_id, {_COMMERCIAL} AS commercial FROM documents",
    "rolling_energy": "SELECT video_id, t, round(avg(rms_energy) OVER (PARTITION BY video_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rms_energy FROM av",
    "style_drift": """SELECT a.video_id, a.id AS t, round(1 - list_cosine_similarity(any_value(a.embedding), any_value(m.mean)), 6) AS drift FROM vec a LEFT JOIN (
  SELECT video_id, id, list(x ORDER BY d) AS mean FROM (
    SELECT v.video_id, v.id, d, avg(o.embedding[d]) AS x FROM vec v JOIN vec o ON o.video_id = v.video_id AND abs(o.id - v.id) BETWEEN 3 AND 15, range(1, 65) r(d) GROUP BY ALL) GROUP BY ALL) m USING (video_id, id) GROUP BY ALL""",
}
_FEATURE_MEANS = ", ".join(f"avg({c}) AS {c}" for c in ("is_speech", "rms_energy", "is_music", "hist_diff", "is_hard_cut", "has_text", "text_sim_to_next"))
_SCENE_MEANS = ", ".join(f"avg(scene[{k + 1}]) AS scene_{k}" for k in range(len(adapters.SCENES)))
SELECTS["segment_features"] = f"""SELECT s.video_id, s.segment_id, {_FEATURE_MEANS}, {_SCENE_MEANS}, CAST(s.end_sec - s.start_sec AS DOUBLE) AS seconds, (s.start_sec + s.end_sec) / 2 / (SELECT n FROM span) AS place
  FROM seg s JOIN grid g ON g.video_id = s.video_id AND g.t >= s.start_sec AND g.t < s.end_sec GROUP BY s.video_id, s.segment_id, s.start_sec, s.end_sec"""
SELECTS |= {
    "document_segments": """SELECT video_id, segment_id, start_sec, end_sec, label, confidence, coalesce(r.text, '') AS summary, false AS user_corrected,
    CASE WHEN len(triggered_rules) > 0 THEN list_aggregate(triggered_rules, 'string_agg', '|') END AS rules FROM smoothed LEFT JOIN rep r USING (video_id, segment_id)""",
    "outro_of_spoken": f"""SELECT video_id, CAST(greatest(0, floor(arg_min("start", pos) - 5)) AS INTEGER) AS start_sec, CAST(any_value(n) AS INTEGER) AS end_sec, arg_min({_group('outro')}, pos) AS rule_name
  FROM txt JOIN (SELECT video_id, ceil(max("end")) AS n FROM sent GROUP BY video_id) d USING (video_id) WHERE "end" >= greatest(0, n - 90) AND {_group('outro')} IS NOT NULL GROUP BY video_id""",
    "speech_seconds": """SELECT DISTINCT video_id, CAST(unnest(range(CAST(floor("start") AS INTEGER), CAST(ceil("end") AS INTEGER))) AS INTEGER) AS t FROM sent WHERE pos % 2 = 0""",
    "broken_segments": """SELECT video_id, pos AS segment_id, CASE event_type WHEN 'view' THEN 'core_content' WHEN 'click' THEN 'intro' WHEN 'purchase' THEN 'sponsorship' ELSE event_type END AS label
  FROM ev WHERE event_type NOT IN ('view', 'click', 'purchase') OR value / 100 NOT BETWEEN 0 AND 1""",
    "point_get": "SELECT video_id, pos, text FROM sent WHERE video_id = '1'",
    "replaced_documents": """SELECT video_id, concat(video_id, '.mp4') AS filename, round(coalesce(n, (SELECT n FROM span)), 6) AS duration_sec, n IS NOT NULL AS verified_by_human
  FROM users LEFT JOIN (SELECT video_id, max("end") AS n FROM sent GROUP BY video_id) USING (video_id)""",
    "list_labels": """SELECT video_id, concat(video_id, '.mp4 (', (SELECT n FROM span), '.0s)', CASE WHEN video_id IN (SELECT video_id FROM sent) THEN ' ✓' ELSE '' END) AS label FROM users""",
    "scene_map": """SELECT vec_id, concat('scene ', d) AS scene, round(exp(embedding[d]::DOUBLE) / list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))), 6) AS prob FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)""",
    "ocr_gate": """SELECT video_id, t, last_value(CASE WHEN t % 3 = 0 AND NOT (mean < 10 AND variance < 50) THEN commercial END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t) AS commercial FROM (
  SELECT video_id, t, avg(value) AS mean, var_pop(value) AS variance, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS commercial FROM ev GROUP BY video_id, t)""",
    "ad_block": """SELECT * FROM (SELECT r.video_id, r.start_sec, r.end_sec, CASE WHEN bool_or(g.is_hard_cut = 1 AND abs(g.t - r.start_sec) <= 3) AND bool_or(g.is_hard_cut = 1 AND abs(g.t - r.end_sec) <= 3) THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS confidence
  FROM run_drift r JOIN grid g USING (video_id) GROUP BY ALL HAVING bool_or(g.is_music = 1 AND g.t >= r.start_sec AND g.t < r.end_sec))""",
    "stale_results": """SELECT video_id, max(pos) AS modified FROM ev GROUP BY video_id HAVING max(pos) > coalesce(max(pos) FILTER (WHERE event_type <> 'error'), -1)""",
}
CTES.append(_runs("run_drift", "is_speech = 0", 10))
CTES.append("taken AS (SELECT concat(event_type, '_', user_id % 20) AS name FROM events UNION SELECT event_type FROM events)")

ORACLES = {name: oracle(select) for name, select in SELECTS.items()}
