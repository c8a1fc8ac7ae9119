"""DuckDB SQL for the queries of `queries`, written on its own terms: naive joins and recursion in place of the plans there."""

from __future__ import annotations

HOPS = """hops AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hop, event_id,
 CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'near_miss' ELSE 'background' END AS kind,
 value / (value + 50.0::DOUBLE) AS score FROM events)"""
STREAM = "stream AS (SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS hop, vec_id, embedding::DOUBLE[] AS emb FROM embeddings)"


def fires(source: str, name: str = "fires", keys: str = "stream_id", skip: int = 25) -> str:
    """Greedy debounce by recursion over the candidates in `source` (keys, hop)."""
    on = " AND ".join(f"c.{k} = f.{k}" for k in keys.split(", "))
    cols = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""{name} AS (SELECT {keys}, min(hop) AS hop FROM {source} GROUP BY {keys}
 UNION ALL SELECT {cols}, (SELECT min(c.hop) FROM {source} c WHERE {on} AND c.hop >= f.hop + {skip}) FROM {name} f
 WHERE EXISTS (SELECT 1 FROM {source} c WHERE {on} AND c.hop >= f.hop + {skip}))"""


CANDIDATES = f"{HOPS}, cand AS (SELECT stream_id, hop FROM hops WHERE score >= 0.5::DOUBLE AND NOT isnan(score))"
FIRES = f"WITH RECURSIVE {CANDIDATES}, {fires('cand')}"
TARGETS = "targets AS (SELECT stream_id, event_id AS clip_no, hop AS start, hop + 2 AS stop FROM hops WHERE kind = 'positive')"


def sweep(steps: int, first: int, last: int) -> str:
    return f"""{HOPS}, sums AS (SELECT step, count(*) FILTER (kind = 'positive')::DOUBLE AS p, count(*) FILTER (kind <> 'positive')::DOUBLE AS q,
 count(*) FILTER (kind = 'positive' AND score >= step / {steps}.0::DOUBLE) AS tp, count(*) FILTER (kind <> 'positive' AND score >= step / {steps}.0::DOUBLE) AS fp
 FROM hops, range({first}, {last + 1}) t(step) GROUP BY step),
 swept AS (SELECT step, step / {steps}.0::DOUBLE AS threshold, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS recall, CASE WHEN q > 0 THEN fp / q ELSE 0 END AS fpr,
 CASE WHEN q <= 0 THEN 'inf'::DOUBLE ELSE fp / (q * 0.08::DOUBLE / 3600) END AS fpph,
 (CASE WHEN p > 0 THEN tp / p ELSE 0 END + CASE WHEN q > 0 THEN 1 - fp / q ELSE 0 END) / 2 AS accuracy FROM sums)"""


def best(target: float) -> str:
    return f"""(SELECT {target}::DOUBLE AS target, CASE WHEN recall >= 0.5 AND fpph <= {target} THEN 1 WHEN recall >= 0.5 THEN 2 ELSE 3 END AS tier, threshold,
 round(recall, 6) AS recall, round(fpph, 6) AS fpph, round(accuracy, 6) AS accuracy FROM swept
 ORDER BY tier, CASE tier WHEN 1 THEN -swept.recall WHEN 2 THEN -swept.accuracy ELSE abs(step - 50) END, threshold LIMIT 1)"""


WORDS = "trim(unnest(string_split_regex(trim(lower({0})), '\\s+')), ',.!?')"


def vocabulary(table: str, column: str, name: str) -> str:
    return f"{name} AS (SELECT DISTINCT word FROM (SELECT {WORDS.format(column)} AS word FROM {table}) WHERE regexp_full_match(word, '[a-z]+'))"


NEAR = f"""{vocabulary('part', 'p_name', 'pw')}, {vocabulary('documents', 'text', 'dw')},
 near AS (SELECT a.word, b.word AS neighbour, levenshtein(a.word, b.word) AS distance FROM pw a JOIN dw b ON abs(length(a.word) - length(b.word)) <= 2 WHERE a.word <> b.word AND levenshtein(a.word, b.word) <= 2)"""
def weighted(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda v, i: v * i)) / len({x})"


def share(key: str, purpose: str) -> str:
    return f"(('0x' || substr(md5('7|{purpose}|' || ({key})), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


STREAMS = """sets AS (SELECT stream_id, arg_min(kind, hop) AS kind, count(*) FILTER (score >= 0.1::DOUBLE) * 0.08::DOUBLE / 3600 AS hours FROM hops GROUP BY stream_id),
 spans AS (SELECT h.stream_id, h.event_id AS clip_no, h.hop AS start, h.hop + 2 AS stop FROM hops h JOIN sets s ON s.stream_id = h.stream_id AND s.kind = h.kind)"""
DET = f"""WITH RECURSIVE {HOPS}, cand AS (SELECT stream_id, hop, step FROM hops, range(1, 10) t(step) WHERE score >= step / 10.0::DOUBLE),
 {fires('cand', keys='stream_id, step')}, {STREAMS},
 hit AS (SELECT s.step, t.clip_no, x.kind, EXISTS (SELECT 1 FROM fires f WHERE f.stream_id = t.stream_id AND f.step = s.step AND f.hop BETWEEN t.start AND t.stop + 1) AS fired
 FROM spans t JOIN sets x ON x.stream_id = t.stream_id, range(1, 10) s(step)),
 miss AS (SELECT step, count(*) FILTER (kind = 'positive') AS clips, count(*) FILTER (kind = 'positive' AND NOT fired) AS misses, avg(fired::INT::DOUBLE) FILTER (kind = 'near_miss') AS near_miss_rate FROM hit GROUP BY step),
 fa AS (SELECT step, count(*) AS false_accepts FROM fires WHERE stream_id IN (SELECT stream_id FROM sets WHERE kind = 'background') GROUP BY step),
 length AS (SELECT coalesce(sum(hours), 0) AS hours FROM sets WHERE kind = 'background'),
 det AS (SELECT s.step::INT AS step, coalesce(misses, 0) AS misses, coalesce(clips, 0) AS clips, CASE WHEN clips > 0 THEN misses::DOUBLE / clips ELSE 0 END AS miss_rate, near_miss_rate,
 coalesce(false_accepts, 0) AS false_accepts, CASE WHEN hours > 0 THEN coalesce(false_accepts, 0) / hours ELSE 0 END AS fa_per_hour
 FROM range(1, 10) s(step) LEFT JOIN miss USING (step) LEFT JOIN fa USING (step), length)"""


def selected(target: float) -> str:
    return f"""(SELECT step, misses, clips, round(miss_rate, 6) AS miss_rate, round(near_miss_rate, 6) AS near_miss_rate, false_accepts, round(fa_per_hour, 6) AS fa_per_hour, fa_per_hour <= {target} AS "within", {target}::DOUBLE AS target FROM det
 ORDER BY CASE WHEN det.fa_per_hour <= {target} THEN 0 ELSE 1 END, CASE WHEN det.fa_per_hour <= {target} THEN det.miss_rate ELSE det.fa_per_hour END, CASE WHEN det.fa_per_hour <= {target} THEN -step ELSE 0 END, det.miss_rate, step LIMIT 1)"""


#: Phonemes by spelling, a character each: runs of vowels by their first letter, c and q as K, other letters in capitals.
SOUND = "array_to_string(list_transform(regexp_extract_all(word, '[aeiouy]+|[^aeiouy]'), lambda r: CASE WHEN regexp_matches(r, '^[aeiouy]') THEN r[1] ELSE upper(translate(r, 'cq', 'kk')) END), '')"
SOUNDS = f"""{vocabulary('part', 'p_name', 'pw')}, {vocabulary('documents', 'text', 'dw')}, dict AS (SELECT word, {SOUND} AS sound FROM (SELECT word FROM pw UNION SELECT word FROM dw)),
 phon AS (SELECT a.word, b.word AS neighbour, levenshtein(a.sound, b.sound) AS distance FROM dict a JOIN pw ON pw.word = a.word JOIN dict b ON abs(length(a.sound) - length(b.sound)) <= 2
 WHERE length(a.sound) >= 3 AND a.word <> b.word AND length(b.word) >= 2 AND levenshtein(a.sound, b.sound) BETWEEN 1 AND CASE WHEN length(a.sound) < 5 THEN 1 ELSE 2 END)"""
NEGATIVE = f"""{HOPS}, neg AS (SELECT stream_id, hop, score FROM hops WHERE kind <> 'positive'), clip AS (SELECT kind, score FROM hops WHERE kind <> 'background')"""


ORACLES = {
    "q01_clip_metrics": f"""WITH {HOPS}, s AS (SELECT count(*) FILTER (kind = 'positive')::DOUBLE p, count(*) FILTER (kind = 'positive' AND score >= 0.5::DOUBLE)::DOUBLE tp,
 count(*) FILTER (kind <> 'positive')::DOUBLE q, count(*) FILTER (kind <> 'positive' AND score >= 0.5::DOUBLE)::DOUBLE fp, count(*) FILTER (kind = 'near_miss')::DOUBLE m,
 count(*) FILTER (kind = 'near_miss' AND score >= 0.5::DOUBLE)::DOUBLE mp, count(*) FILTER (kind = 'background')::DOUBLE b, count(*) FILTER (kind = 'background' AND score >= 0.5::DOUBLE)::DOUBLE bp FROM hops)
 SELECT tp / p AS recall, bp / (b * 0.08::DOUBLE / 3600) AS fpph, (tp / p + (1 - fp / q)) / 2 AS accuracy, mp / m AS near_miss_rate, p::BIGINT AS positives, q::BIGINT AS negatives FROM s""",
    "q02_threshold_sweep": f"WITH {sweep(100, 1, 99)} SELECT threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(fpph, 6) AS fpph, round(accuracy, 6) AS accuracy FROM swept",
    "q03_best_threshold": f"WITH {sweep(100, 1, 99)} " + " UNION ALL ".join(best(t) for t in (0.5, 20000.0, 30000.0)),
    "q04_det_curve": f"WITH {sweep(1000, 0, 1000)} SELECT threshold, round(fpr, 6) AS fpr, round(1 - recall, 6) AS fnr FROM swept",
    "q05_aut": f"""WITH {sweep(1000, 0, 1000)}, c AS (SELECT fpr, 1 - recall AS fnr FROM swept)
 SELECT round(sum(a), 6) AS aut FROM (SELECT (fpr - lag(fpr) OVER w) * (fnr + lag(fnr) OVER w) / 2 AS a FROM c WINDOW w AS (ORDER BY fpr, fnr DESC))""",
    "q06_hop_windows": f"""WITH {STREAM}, s AS (SELECT stream_id, hop, {weighted('emb')} AS x FROM stream), f AS (SELECT stream_id, hop, list(x) OVER (PARTITION BY stream_id ORDER BY hop ROWS 15 PRECEDING) AS w FROM s),
 g AS (SELECT stream_id, max(hop) AS hop, list(x ORDER BY hop) AS x FROM s GROUP BY stream_id),
 p AS (SELECT stream_id, hop, list_concat(list_transform(range(greatest(0, 20 - len(x))), lambda i: 0.0::DOUBLE), x)[-20:] AS w FROM g)
 SELECT stream_id, hop, 'stride' AS kind, 16::INT AS n, round(w[1], 6) AS w0, round(w[8], 6) AS w7, round(w[16], 6) AS w15 FROM f WHERE len(w) = 16
 UNION ALL SELECT stream_id, hop, 'padded', 20::INT, round(w[1], 6), round(w[8], 6), round(w[16], 6) FROM p""",
    "q07_window_scores_maxpool": f"""WITH {STREAM}, s AS (SELECT stream_id, hop, sum({weighted('emb')}) OVER w AS t, count(*) OVER w AS n FROM stream WINDOW w AS (PARTITION BY stream_id ORDER BY hop ROWS 15 PRECEDING))
 SELECT stream_id, round(max(t / 16), 6) AS score FROM s WHERE n = 16 GROUP BY stream_id""",
    "q08_run_detection": f"""WITH {HOPS}, a AS (SELECT stream_id, hop, score >= 0.3::DOUBLE AS above FROM hops),
 b AS (SELECT *, max(CASE WHEN NOT above THEN hop END) OVER (PARTITION BY stream_id ORDER BY hop) AS low FROM a)
 SELECT stream_id, hop, CASE WHEN above THEN hop - coalesce(low, -1) ELSE 0 END AS run, CASE WHEN above AND hop - coalesce(low, -1) >= 3 THEN 1 ELSE 0 END AS fires FROM b""",
    "q09_debounced_detections": f"{FIRES} SELECT stream_id, hop FROM fires",
    "q10_stream_false_accepts": f"""WITH RECURSIVE {HOPS}, neg AS (SELECT * FROM hops WHERE kind <> 'positive'), cand AS (SELECT stream_id, hop FROM neg WHERE score >= 0.5::DOUBLE), {fires('cand')},
 h AS (SELECT stream_id, count(*) * 0.08::DOUBLE / 3600 AS hours FROM neg GROUP BY stream_id), f AS (SELECT stream_id, count(*) AS fires FROM fires GROUP BY stream_id)
 SELECT stream_id, round(hours, 6) AS hours, coalesce(fires, 0) AS fires, round(coalesce(fires, 0) / hours, 6) AS fa_per_hour FROM h LEFT JOIN f USING (stream_id)""",
    "q11_interval_hits": f"""{FIRES}, {TARGETS} SELECT t.stream_id, t.clip_no, t.start, count(f.hop) AS hits FROM targets t LEFT JOIN fires f ON f.stream_id = t.stream_id AND f.hop BETWEEN t.start AND t.stop + 1 GROUP BY ALL""",
    "q12_set_summary": f"""{FIRES}, {STREAMS}, m AS (SELECT stream_id, count(*) AS clips, count(*) FILTER (EXISTS (SELECT 1 FROM fires f WHERE f.stream_id = t.stream_id AND f.hop BETWEEN t.start AND t.stop + 1)) AS fired FROM spans t GROUP BY stream_id),
 k AS (SELECT stream_id, count(*) AS fires, count(*) FILTER (EXISTS (SELECT 1 FROM spans t WHERE f.stream_id = t.stream_id AND f.hop BETWEEN t.start AND t.stop + 1)) AS inside FROM fires f GROUP BY stream_id),
 j AS (SELECT stream_id, kind, hours, coalesce(clips, 0) AS clips, coalesce(fired, 0) AS fired, coalesce(fires, 0) AS fires, coalesce(inside, 0) AS inside FROM sets LEFT JOIN m USING (stream_id) LEFT JOIN k USING (stream_id)),
 g AS (SELECT stream_id, kind, sum(clips)::BIGINT AS clips, sum(fired)::BIGINT AS fired, sum(fires)::BIGINT AS fires, sum(inside)::BIGINT AS inside, sum(hours) AS hours FROM j GROUP BY GROUPING SETS ((stream_id, kind), (kind)))
 SELECT stream_id, kind, clips, CASE WHEN kind = 'positive' THEN clips - fired END AS misses, CASE WHEN kind = 'positive' THEN round(CASE WHEN clips > 0 THEN (clips - fired)::DOUBLE / clips ELSE 0 END, 6) END AS miss_rate, fires,
 CASE WHEN kind = 'positive' THEN fires - inside ELSE fires END AS false_accepts, CASE WHEN kind <> 'positive' THEN round(CASE WHEN clips > 0 THEN fired::DOUBLE / clips ELSE 0 END, 6) END AS fa_per_clip, round(hours, 6) AS hours,
 CASE WHEN kind = 'background' THEN round(CASE WHEN hours > 0 THEN fires / hours ELSE 0 END, 6) END AS fa_per_hour FROM g""",
    "q13_streaming_det": f"{DET} SELECT step, misses, clips, round(miss_rate, 6) AS miss_rate, round(near_miss_rate, 6) AS near_miss_rate, false_accepts, round(fa_per_hour, 6) AS fa_per_hour FROM det",
    "q13b_streaming_select": f"{DET} {selected(1500.0)} UNION ALL {selected(0.5)}",
    "q14_rolling_gate": f"""WITH {HOPS}, g AS (SELECT stream_id, hop, score, sum(CASE WHEN kind <> 'near_miss' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY hop ROWS 4 PRECEDING) >= 4 AS gate_open FROM hops)
 SELECT stream_id, hop, gate_open, round(CASE WHEN gate_open THEN score ELSE 0 END, 6) AS score FROM g""",
    "q15_verifier_gate": f"""{FIRES} SELECT h.stream_id, h.hop, round(CASE WHEN (event_id * 7919 % 1000) / 1000.0::DOUBLE >= 0.4::DOUBLE THEN score ELSE 0 END, 6) AS score, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS verifier_score,
 CASE kind WHEN 'positive' THEN 0.3::DOUBLE WHEN 'near_miss' THEN 0.6::DOUBLE END AS verifier FROM hops h JOIN fires f ON h.stream_id = f.stream_id AND h.hop = f.hop""",
    "q16_recall_threshold": f"""WITH {HOPS}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM hops WHERE kind = 'positive'),
 t AS (SELECT x.target, score AS threshold FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) x(target) WHERE r = greatest(1, ceil(round(x.target * n, 9))))
 SELECT target, round(threshold, 6) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'positive'), 6) AS recall,
 round(avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'near_miss'), 6) AS near_miss_accept FROM hops, t GROUP BY target, threshold""",
    "q17_checkpoint_select": """WITH c AS (SELECT dayofyear(ts)::INT AS step, coalesce(avg(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_type = 'purchase'), 0) AS recall,
 coalesce(sum(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) FILTER (event_type <> 'purchase'), 0) / 10 AS fpph, avg(CASE WHEN (event_type = 'purchase') = (value >= 50) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM events GROUP BY 1),
 l AS (SELECT quantile_cont(fpph, 0.1) AS f, quantile_cont(recall, 0.9) AS r, quantile_cont(accuracy, 0.9) AS a FROM c),
 m AS (SELECT c.*, fpph <= f AND recall >= r AND accuracy >= a AS good, row_number() OVER (ORDER BY recall DESC, step) AS place FROM c, l)
 SELECT step, round(recall, 6) AS recall, round(fpph, 6) AS fpph, round(accuracy, 6) AS accuracy, good FROM m WHERE good OR (place = 1 AND NOT EXISTS (SELECT 1 FROM m WHERE good))""",
    "q17b_checkpoint_average": f"""WITH l AS (SELECT label AS name, embedding::DOUBLE[] AS w FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id * 7 % 11 DESC, vec_id DESC) AS r FROM embeddings) WHERE r <= 3)
 SELECT name, 64::INT AS n, round(avg(w[1]), 6) AS w0, round(avg(w[32]), 6) AS w31, round(avg(w[64]), 6) AS w63, round(avg({weighted('w')}), 6) AS "all" FROM l GROUP BY name""",
    "q18_phonetic_neighbours": f"WITH {SOUNDS} SELECT word, neighbour, distance::INT AS distance FROM phon",
    "q18b_spelling_neighbours": f"WITH {NEAR} SELECT word, neighbour, distance::INT AS distance FROM near",
    "q19_partial_and_swap_phrases": f"""WITH {NEAR}, n AS (SELECT DISTINCT p_name AS phrase, string_split(p_name, ' ') AS t FROM part), i AS (SELECT phrase, t, unnest(range(1, len(t) + 1)) AS k FROM n),
 partial AS (SELECT DISTINCT phrase, array_to_string(list_concat(t[:k-1], t[k+1:]), ' ') AS variant, 'partial' AS kind FROM i WHERE len(t) > 1),
 swap AS (SELECT DISTINCT phrase, array_to_string(list_concat(list_concat(t[:k-1], [neighbour]), t[k+1:]), ' ') AS variant, 'swap' AS kind FROM i JOIN near ON t[k] = word WHERE distance = 1)
 SELECT * FROM partial UNION ALL SELECT * FROM swap WHERE variant NOT IN (SELECT phrase FROM n)""",
    "q20_split_holdout": """WITH n AS (SELECT DISTINCT p_name FROM part), r AS (SELECT p_name, row_number() OVER (ORDER BY md5('7|holdout|' || p_name), p_name) AS r, count(*) OVER () AS n FROM n)
 SELECT p_name, CASE WHEN r <= greatest(1, least(round_even(n * 0.2::DOUBLE, 0), n - 1)) THEN 'test' ELSE 'train' END AS side FROM r""",
    "q21_phrase_schedule": """WITH p AS (SELECT DISTINCT lower(p_type) AS grp, p_name AS phrase FROM part WHERE lower(p_type) IN ('economy', 'small')),
 o AS (SELECT grp, phrase, row_number() OVER (PARTITION BY grp ORDER BY md5(phrase), phrase) - 1 AS k, count(*) OVER (PARTITION BY grp) AS n FROM p)
 SELECT i AS clip_idx, grp, phrase FROM range(1000) t(i) JOIN o ON grp = CASE WHEN i < 625 THEN 'economy' ELSE 'small' END AND k = (CASE WHEN i < 625 THEN i ELSE i - 625 END) % n""",
    "q22_unknown_word_split": f"""WITH {vocabulary('benchmark', 'text', 'bw')}, {vocabulary('documents', 'text', 'dw')},
 c AS (SELECT word, unnest(range(2, length(word) - 1)) AS k FROM dw WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM bw))
 SELECT c.word, arg_max(l.word, k) AS "left", arg_max(r.word, k) AS "right" FROM c JOIN bw l ON l.word = c.word[:k] JOIN bw r ON r.word = c.word[k+1:] GROUP BY c.word""",
    "q23_pair_join": """SELECT a.conv_id, a.turn // 2 AS pair, length(a.text) AS "left", length(b.text) AS "right", length(a.text) + length(b.text) + 160 AS joined
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0""",
    "q24_context_layout": """WITH c AS (SELECT conv_id AS stream_id, turn AS hop, length(text) AS length FROM conversations), s AS (SELECT *, (32000 + coalesce(sum(length + 48000) OVER (PARTITION BY stream_id ORDER BY hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM c)
 SELECT *, start + length AS stop FROM s""",
    "q25_cyclic_batches": """WITH r AS (SELECT vec_id, CASE WHEN label = 0 THEN 'positive' WHEN label < 4 THEN 'near_miss' ELSE 'background' END AS cls FROM embeddings),
 o AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY vec_id) - 1 AS ord, count(*) OVER (PARTITION BY cls) AS n FROM r), s(cls, take) AS (VALUES ('positive', 7), ('near_miss', 11), ('background', 32))
 SELECT b AS batch, s.cls, k::INT AS k, vec_id, CASE WHEN s.cls = 'positive' THEN 1 ELSE 0 END AS label FROM range(40) t(b), range(32) u(k), s JOIN o ON o.cls = s.cls WHERE k < take AND ord = (b * take + k) % n""",
    "q26_mixed_radix": """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY md5(p_brand), p_brand) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part))
 SELECT i, p_brand, (i // 3 % 2)::INT AS d1, (i % 3)::INT AS d2 FROM b JOIN range(20 * (SELECT count(DISTINCT p_brand) FROM part)) t(i) ON k = i // 6 % n""",
    "q27_mixup_pairs": """WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY md5('7|mixup|' || vec_id), vec_id) AS b FROM embeddings)
 SELECT l.label, l.vec_id, r.vec_id AS partner, round(l.x[1] * 0.7::DOUBLE + r.x[1] * (1 - 0.7::DOUBLE), 6) AS x0, round(l.x[64] * 0.7::DOUBLE + r.x[64] * (1 - 0.7::DOUBLE), 6) AS x63, round(list_sum(list_transform(range(1, 65), lambda i: (l.x[i] * 0.7::DOUBLE + r.x[i] * (1 - 0.7::DOUBLE)) * i)) / 64, 6) AS "all" FROM e l JOIN e r ON l.label = r.label AND l.a = r.b""",
    "q28_schedules": """SELECT i AS step, round(CASE WHEN i < 100 THEN 0.001::DOUBLE * i / 100 WHEN i < 400 THEN 0.001::DOUBLE ELSE 0.001::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1, (i - 400) / 600.0::DOUBLE))) END, 9) AS rate,
 round(1 + 49 * i / 1000.0::DOUBLE, 6) AS weight FROM range(1000) t(i)""",
    "q29_snr_gain": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), j AS (SELECT a.vec_id, a.x, b.x AS n, list_sum(list_transform(a.x, lambda v: v * v)) / 64 AS px, list_sum(list_transform(b.x, lambda v: v * v)) / 64 AS pn FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 g AS (SELECT *, sqrt(px / (pn * 10.0::DOUBLE)) AS gain FROM j) SELECT vec_id, round(gain, 6) AS gain, round(sqrt(px), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, round(x[1] + gain * n[1], 6) AS first FROM g""",
    "q30_slerp": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), j AS (SELECT a.vec_id, a.x, b.x AS y, list_sum(list_transform(list_zip(a.x, b.x), lambda v: v[1] * v[2])) / (sqrt(list_sum(list_transform(a.x, lambda v: v * v))) * sqrt(list_sum(list_transform(b.x, lambda v: v * v)))) AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
 w AS (SELECT *, acos(greatest(-1, least(1, c))) AS t FROM j), f AS (SELECT *, CASE WHEN abs(c) > 0.9995 THEN 0.75::DOUBLE ELSE sin(0.75::DOUBLE * t) / sin(t) END AS a, CASE WHEN abs(c) > 0.9995 THEN 0.25::DOUBLE ELSE sin(0.25::DOUBLE * t) / sin(t) END AS b FROM w)
 SELECT vec_id, round(x[1] * a + y[1] * b, 5) AS z0, round(x[64] * a + y[64] * b, 5) AS z63, round(list_sum(list_transform(range(1, 65), lambda i: (x[i] * a + y[i] * b) * i)) / 64, 4) AS "all" FROM f""",
    "q31_reblock": f"""WITH {STREAM} SELECT stream_id, hop // 16 AS block, round(arg_min(emb[1], hop), 6) AS first, round(arg_max(emb[1], hop), 6) AS last FROM stream GROUP BY ALL HAVING count(*) = 16""",
    "q34_streaming_detector": f"{FIRES} SELECT stream_id, hop FROM fires",
    "q35_stream_metrics": f"""WITH RECURSIVE {NEGATIVE}, cand AS (SELECT stream_id, hop FROM neg WHERE score >= 0.5::DOUBLE), {fires('cand')},
 n AS (SELECT count(*)::DOUBLE AS hops, count(*) FILTER (score >= 0.5::DOUBLE)::DOUBLE AS over FROM neg), f AS (SELECT count(*) AS fires FROM fires),
 c AS (SELECT count(*) FILTER (kind = 'positive')::DOUBLE p, count(*) FILTER (kind = 'positive' AND score >= 0.5::DOUBLE)::DOUBLE tp, count(*) FILTER (kind <> 'positive')::DOUBLE m, count(*) FILTER (kind <> 'positive' AND score >= 0.5::DOUBLE)::DOUBLE mp FROM clip)
 SELECT round(fires / (hops * 0.08::DOUBLE / 3600), 6) AS fpph, round(mp / m, 6) AS near_miss_rate, round(tp / p, 6) AS recall, round((tp / p + 1 - (mp + over) / (m + hops)) / 2, 6) AS accuracy FROM n, f, c""",
    "q36_stream_best_threshold": f"""WITH RECURSIVE {NEGATIVE}, cand AS (SELECT stream_id, hop, step FROM neg, range(1, 10) t(step) WHERE score >= step / 10.0::DOUBLE), {fires('cand', keys='stream_id, step')},
 n AS (SELECT step, count(*)::DOUBLE AS hops, count(*) FILTER (score >= step / 10.0::DOUBLE)::DOUBLE AS over FROM neg, range(1, 10) t(step) GROUP BY step), f AS (SELECT step, count(*) AS fires FROM fires GROUP BY step),
 c AS (SELECT step, count(*) FILTER (kind = 'positive')::DOUBLE p, count(*) FILTER (kind = 'positive' AND score >= step / 10.0::DOUBLE)::DOUBLE tp, count(*) FILTER (kind <> 'positive')::DOUBLE m, count(*) FILTER (kind <> 'positive' AND score >= step / 10.0::DOUBLE)::DOUBLE mp FROM clip, range(1, 10) t(step) GROUP BY step),
 swept AS (SELECT step, step / 10.0::DOUBLE AS threshold, coalesce(fires, 0) / (hops * 0.08::DOUBLE / 3600) AS fpph, tp / p AS recall, (tp / p + 1 - (mp + over) / (m + hops)) / 2 AS accuracy FROM n LEFT JOIN f USING (step) JOIN c USING (step))
 """ + " UNION ALL ".join(best(t).replace("step - 50", "step - 5") for t in (0.5, 2000.0, 4000.0)),
    "q37_adversarial_phrases": f"""WITH {SOUNDS}, n AS (SELECT DISTINCT p_name AS phrase, string_split(lower(p_name), ' ') AS t FROM part), i AS (SELECT phrase, t, unnest(range(1, len(t) + 1)) AS k FROM n),
 a AS (SELECT array_to_string(list_concat(list_concat(t[:k-1], [neighbour]), t[k+1:]), ' ') AS phrase, 'near_miss' AS kind FROM i JOIN phon ON t[k] = word
 UNION ALL SELECT array_to_string(list_concat(t[:k-1], t[k+1:]), ' '), 'partial' FROM i WHERE len(t) > 1 AND {share('phrase', 'partial')} < 1.0
 UNION ALL SELECT t[k], 'word' FROM i WHERE {share("phrase || '/' || (k - 1)", 'input word')} < 0.2::DOUBLE)
 SELECT phrase, min(kind) AS kind FROM a WHERE phrase <> '' AND phrase NOT IN (SELECT lower(phrase) FROM n) GROUP BY phrase""",
    "q38_word_swaps": f"""WITH {SOUNDS}, every AS (SELECT {WORDS.format('text')} AS word FROM benchmark), swap AS (SELECT word FROM (SELECT word, count(*) AS c FROM every WHERE regexp_full_match(word, '[a-z]+') GROUP BY word ORDER BY c DESC, word LIMIT 40)),
 n AS (SELECT DISTINCT p_name AS phrase, string_split(lower(p_name), ' ') AS t FROM part), i AS (SELECT phrase, t, unnest(range(1, len(t) + 1)) AS k FROM n),
 v AS (SELECT i.phrase, array_to_string(list_concat(list_concat(t[:k-1], [s.word]), t[k+1:]), ' ') AS variant FROM i, swap s LEFT JOIN dict b ON b.word = s.word LEFT JOIN dict a ON a.word = t[k]
 WHERE s.word <> t[k] AND NOT coalesce(levenshtein(a.sound, b.sound) <= 1, false))
 SELECT DISTINCT phrase, variant FROM v WHERE variant NOT IN (SELECT lower(phrase) FROM n)""",
    "q39_gated_run_detection": f"""WITH RECURSIVE {HOPS}, g AS (SELECT stream_id, hop, CASE WHEN (event_id * 7919 % 1000) / 1000.0::DOUBLE >= 0.4::DOUBLE THEN score ELSE 0 END AS score FROM hops),
 cand AS (SELECT stream_id, hop FROM (SELECT stream_id, hop, score >= 0.3::DOUBLE AND lag(score) OVER (PARTITION BY stream_id ORDER BY hop) >= 0.3::DOUBLE AS ok FROM g) WHERE ok), {fires('cand')} SELECT stream_id, hop FROM fires""",
    "q40_incremental_scorer": f"""WITH {HOPS}, s AS (SELECT stream_id, list(score ORDER BY hop) AS x FROM hops GROUP BY stream_id), w AS (SELECT stream_id, x, unnest(range(4, len(x) // 2 + 1)) AS k FROM s),
 f AS (SELECT stream_id, k - 1 AS hop, list_transform(range(1, 8), lambda i: (x[2 * k - 8 + i] + x[2 * k - 8 + i + 1]) / 2) AS f FROM w), g AS (SELECT stream_id, hop, list_transform(f, lambda v: greatest(v, list_max(f) - 0.4::DOUBLE)) AS f FROM f)
 SELECT stream_id, hop, round((f[1] + f[2] + 2 * f[3] + f[4] + 2 * f[5] + f[6] + f[7]) / 9, 6) AS score FROM g""",
    "q41_class_counts": "SELECT event_type, ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL",
    "q42_context_placement": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), j AS (SELECT a.vec_id, a.x, b.x AS c, floor({share('a.vec_id', 'jitter')} * 20)::INT AS jitter, floor({share('a.vec_id', 'gap')} * 30)::INT AS gap, {share('a.vec_id', 'gain')} * -6 AS db FROM e a JOIN e b ON b.vec_id = a.vec_id - 1),
 p AS (SELECT *, 96 - jitter AS start, 96 - jitter - gap AS stop FROM j), q AS (SELECT *, c[greatest(1, 64 - stop + 1):] AS t FROM p),
 g AS (SELECT *, CASE WHEN list_sum(list_transform(x, lambda v: v * v)) > 0 THEN sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) / (sqrt(list_sum(list_transform(t, lambda v: v * v)) / len(t)) + 1e-8::DOUBLE) ELSE 1 END * pow(10.0::DOUBLE, db / 20) AS gain FROM q),
 w AS (SELECT vec_id, list_transform(range(160), lambda i: coalesce(x[CASE WHEN i >= start THEN i - start + 1 END], 0) + CASE WHEN i < stop AND i >= stop - len(t) THEN t[i - stop + len(t) + 1] * gain ELSE 0 END) AS w FROM g)
 SELECT vec_id, 160::INT AS n, round(w[1], 5) AS w0, round(w[41], 5) AS w40, round(w[71], 5) AS w70, round(w[121], 5) AS w120, round(w[160], 5) AS w159, round({weighted('w')}, 4) AS "all" FROM w""",
    "q43_background_clips": f"""WITH src AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, embedding::DOUBLE[] AS x, count(*) OVER () AS n FROM embeddings),
 c AS (SELECT i, floor({share('i', 'background')} * (SELECT count(*) FROM embeddings))::BIGINT AS ord FROM range(200) r(i)), j AS (SELECT i, c.ord, x FROM c JOIN src USING (ord)),
 t AS (SELECT i, ord, x, k, floor({share("i || '/' || k", 'turn')} * 64)::INT AS s, {share("i || '/' || k", 'backwards')} < 0.5::DOUBLE AS b FROM j, range(1, 3) u(k)),
 v AS (SELECT i, ord, k, CASE WHEN b THEN list_reverse(list_concat(x[s+1:], x[:s])) ELSE list_concat(x[s+1:], x[:s]) END AS x FROM t),
 l AS (SELECT i, ord, flatten(list(x ORDER BY k)) AS x FROM v GROUP BY i, ord), o AS (SELECT i, ord, x[floor({share('i', 'offset')} * 29)::INT + 1 : floor({share('i', 'offset')} * 29)::INT + 100] AS x FROM l)
 SELECT i AS clip_idx, ord, len(x)::INT AS n, round(x[1], 6) AS first, round({weighted('x')}, 6) AS "all" FROM o""",
    "q44_feature_blocks": f"""WITH {STREAM}, b AS (SELECT stream_id, hop // 16 AS block, list(emb ORDER BY hop) AS r FROM stream GROUP BY ALL HAVING count(*) = 16), f AS (SELECT stream_id, block, flatten(r[-12:]) AS x FROM b)
 SELECT stream_id, block, 12::INT AS steps, round({weighted('x')}, 6) AS "all" FROM f""",
    "q45_verifier_threshold": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN label = 0 THEN 'positive' WHEN label < 4 THEN 'near_miss' ELSE 'background' END AS kind FROM embeddings),
 m AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(x[i]) AS a FROM e, range(1, 65) t(i) WHERE kind = 'positive' GROUP BY i)),
 s AS (SELECT kind, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * c[i])), 6) AS score FROM e, m), r AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM s WHERE kind = 'positive'),
 t AS (SELECT x.target, score AS threshold FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE)) x(target) WHERE r = greatest(1, ceil(round(x.target * n, 9))))
 SELECT target, round(threshold, 6) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'positive'), 6) AS recall,
 round(avg(CASE WHEN score >= threshold THEN 1.0::DOUBLE ELSE 0 END) FILTER (kind = 'near_miss'), 6) AS near_miss_accept FROM s, t GROUP BY target, threshold""",
    "q46_cycled_settings": """SELECT i AS clip_idx, i // 16 AS batch_no, (i // 16 // 8 % 3)::INT AS d0, (i // 16 // 4 % 2)::INT AS d1, (i // 16 % 4)::INT AS d2, s_suppkey AS voice, s_name FROM range(500) t(i) JOIN supplier ON s_suppkey = i % 40 WHERE s_suppkey BETWEEN 0 AND 29""",
    "q47_latency_percentiles": """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    "q48_losses": f"""WITH {HOPS}, y AS (SELECT kind, greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, score)) AS p, CASE WHEN kind = 'positive' THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS y FROM hops)
 SELECT kind, round(avg(pow(1 - (p * y + (1 - p) * (1 - y)), 2) * -(y * ln(p) + (1 - y) * ln(1 - p)) * CASE WHEN y < 0.5 THEN 3.0::DOUBLE ELSE 1 END), 6) AS loss, count(*) AS n FROM y GROUP BY kind""",
    "q49_sample_formats": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), a AS (SELECT vec_id, x, list_transform(x, lambda v: trunc(greatest(-1, least(1, v)) * 32767)) AS s, 32767.0::DOUBLE / greatest(0.01::DOUBLE, list_max(list_transform(x, lambda v: abs(v)))) AS k,
 list_concat(x[-5:], x[:-6]) AS r, sqrt(list_sum(list_transform(x, lambda v: v * v)) / 64) AS q FROM e), b AS (SELECT *, list_transform(x, lambda v: trunc(greatest(-32767, least(32767, v * k)))) AS l FROM a)
 SELECT vec_id, round({weighted('s')}, 6) AS short, round({weighted('l')}, 6) AS loud, round(list_sum(list_transform(s, lambda v, i: v / 32768 * i)) / 64, 9) AS back, round(r[1], 6) AS rolled0, round({weighted('r')}, 6) AS rolled,
 round(greatest(0, least(1, (CASE WHEN q > 0 THEN 20 * log10(q) ELSE -60 END + 60) / 60)), 6) AS level FROM b""",
    "q50_phrase_draws": f"""WITH n AS (SELECT DISTINCT p_name AS phrase, string_split(lower(p_name), ' ') AS t FROM part), c AS (SELECT phrase, t, floor({share('phrase', 'cut')} * (len(t) - 1))::INT + 1 AS k FROM n),
 i AS (SELECT phrase, unnest(t) AS w, unnest(range(len(t))) AS i FROM n), b AS (SELECT phrase, string_agg(w, ' ' ORDER BY i) AS kept FROM i WHERE {share("phrase || '/' || i", 'keep')} < 0.5::DOUBLE GROUP BY phrase)
 SELECT phrase, coalesce(kept, '') AS kept, CASE WHEN len(t) > 1 THEN array_to_string(t[:k], ' ') END AS "left", CASE WHEN len(t) > 1 THEN array_to_string(t[k+1:], ' ') END AS "right" FROM c LEFT JOIN b USING (phrase)""",
    "q51_clauses": """WITH c AS (SELECT conv_id, turn, regexp_extract_all(text, '[^,.;:!?]+[,.;:!?]*') AS p FROM conversations), i AS (SELECT conv_id, turn, unnest(p) AS p, unnest(range(len(p))) AS place FROM c)
 SELECT conv_id, turn, place::INT AS place, trim(regexp_replace(p, '[,.;:!?]+$', '')) AS clause, regexp_extract(p, '([,.;:!?]*)$', 1) AS mark FROM i""",
    "q52_symbol_ids": """WITH n AS (SELECT DISTINCT p_name AS phrase FROM part), i AS (SELECT phrase, list_filter(list_transform(string_split(lower(phrase), ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz ', c)), lambda k: k > 0) AS t FROM n),
 j AS (SELECT phrase, list_concat([0], flatten(list_transform(t, lambda k: [k, 0]))) AS t FROM i), k AS (SELECT phrase, list_concat(t, list_transform(range(greatest(0, 40 - len(t))), lambda x: 0)) AS t FROM j) SELECT phrase, len(t)::INT AS n, array_to_string(t, ' ') AS ids FROM k""",
    "q53_random_pairs": f"""WITH c AS (SELECT o_orderkey AS clip_idx, floor({share('o_orderkey', 'speaker a')} * 25)::INT AS a, floor({share('o_orderkey', 'speaker b')} * 24)::INT + 1 AS s, floor({share('o_orderkey', 'room')} * 25)::INT AS room FROM orders)
 SELECT clip_idx, a, ((a + s) % 25)::INT AS b, n_name FROM c JOIN nation ON n_nationkey = room""",
    "q54_verified_stream": f"""WITH RECURSIVE {HOPS}, g AS (SELECT *, sum(CASE WHEN kind <> 'near_miss' THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY hop ROWS 4 PRECEDING) >= 4 AS opened, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS second FROM hops),
 cand AS (SELECT stream_id, hop FROM g WHERE opened AND second >= 0.4::DOUBLE AND score >= 0.5::DOUBLE), {fires('cand')} SELECT g.stream_id, g.hop, round(score, 6) AS score, second AS verifier_score FROM g JOIN fires f ON f.stream_id = g.stream_id AND f.hop = g.hop""",
    "q55_window_scorer": f"""WITH {STREAM}, s AS (SELECT stream_id, hop, {weighted('emb')} AS x FROM stream), w AS (SELECT stream_id, hop, avg(x) OVER v AS score, count(*) OVER v AS n FROM s WINDOW v AS (PARTITION BY stream_id ORDER BY hop ROWS 15 PRECEDING))
 SELECT stream_id, hop, round(score, 6) AS score FROM w WHERE n = 16""",
}
