"""SQL of the conversation engine's queries for DuckDB, over the same tables."""

from __future__ import annotations

from dialoom.functions import lexicon as X
from dialoom.sources import segments as S


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quote(pattern)})"


POOL_SQL = ", ".join(f"({k}, {quote(s)}, {quote(t)})" for k, (s, t) in enumerate(S.POOL))
SEG = f"""
pool(k, spk, text) AS (VALUES {POOL_SQL}),
e AS (SELECT user_id AS conv_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx,
        date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) // 6000000 AS start_ms,
        CAST(floor(value * CASE WHEN event_type = 'error' THEN 120 ELSE 40 END) AS BIGINT) AS dur_ms, (event_id * 7 + user_id * 3) % 24 AS k FROM events),
seg AS (SELECT e.conv_id, CAST(e.idx AS INT) AS idx, format('seg_{{:04d}}', e.idx) AS id, CAST(start_ms AS DOUBLE) / 1000 AS "start", CAST(start_ms + dur_ms AS DOUBLE) / 1000 AS "end",
        CASE WHEN event_id % 37 = 0 THEN 'speaker_unknown' WHEN (spk = 'A') = (event_id % 11 <> 0) THEN 'speaker_0' ELSE 'speaker_1' END AS speaker, text
        FROM e JOIN pool USING (k))"""
START_RE2 = X.QUESTION_START.replace("哪(?!怕)", "哪([^怕]|$)")
FEAT = f"""
f0 AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS bare FROM seg),
f1 AS (SELECT *, CAST(len(regexp_extract_all(bare, '{X.MEANINGFUL}')) AS INT) AS m, {rx("bare", X.QUESTION_WORD)} AS word FROM f0),
feat AS (SELECT *, CAST(CASE WHEN {rx("text", X.QUESTION_MARK)} THEN 2.0 ELSE 0 END + CASE WHEN {rx("text", X.INTERVIEWER_CONTROL)} THEN 2.0 ELSE 0 END
        + CASE WHEN {rx("bare", START_RE2)} AND word THEN 1.5 ELSE 0 END + CASE WHEN {rx("bare", X.QUESTION_END)} THEN 1.5 ELSE 0 END
        + CASE WHEN word THEN CASE WHEN m <= 30 THEN 1.0 ELSE 0.2 END ELSE 0 END AS DOUBLE) AS strength,
        CAST({rx("text", X.QUESTION_MARK)} AS INT) + CAST({rx("text", X.V1_QUESTION)} AS INT) AS v1_score,
        greatest(CAST(0 AS DOUBLE), "end" - "start") AS seconds FROM f1)"""
CLEAN = f"""
ch AS (SELECT conv_id, idx, unnest(regexp_extract_all(lower(text), '{X.MEANINGFUL}')) AS c FROM feat),
dom AS (SELECT conv_id, idx, max(n) AS top FROM (SELECT conv_id, idx, c, count(*) AS n FROM ch GROUP BY ALL) GROUP BY ALL),
pos AS (SELECT conv_id, idx, text, unnest(range(1, length(text) - 3)) AS i FROM feat WHERE length(text) >= 5),
run AS (SELECT DISTINCT conv_id, idx FROM pos WHERE substr(text, i, 5) = repeat(substr(text, i, 1), 5) AND NOT regexp_matches(substr(text, i, 1), '[\\s，。！？、,.!?]')),
c0 AS (SELECT feat.*, m / greatest(seconds, CAST(0.001 AS DOUBLE)) AS density, m >= 8 AND (run.idx IS NOT NULL OR top / m >= 0.68) AS noise, seconds <= 8 AND strength >= 2 AS short
        FROM feat LEFT JOIN dom USING (conv_id, idx) LEFT JOIN run USING (conv_id, idx)),
cl AS (SELECT *, concat_ws('|', CASE WHEN m = 0 THEN 'pure_or_repeated_punctuation' END, CASE WHEN m > 0 AND noise THEN 'repetitive_noise_transcription' END,
        CASE WHEN m > 0 AND NOT short AND seconds >= 25 AND density < 0.5 THEN 'long_duration_low_text_density'
             WHEN m > 0 AND NOT short AND seconds >= 12 AND m <= 5 THEN 'long_duration_very_little_text' END) AS reasons FROM c0),
clean AS (SELECT *, reasons = '' AS valid FROM cl)"""


def half_even(x: str, places: int) -> str:
    """``x`` rounded to the nearer decimal, as the exact value of the binary number decides: its double
    product with 2 * 10^places and that product's error, half-way cases to the even one."""
    k = f"CAST({2 * 10**places} AS DOUBLE)"
    high = f"(({x}) * CAST(134217729 AS DOUBLE) - (({x}) * CAST(134217729 AS DOUBLE) - ({x})))"
    product = f"(({x}) * {k})"
    over = f"({product} - (2 * floor({product} / 2) + 1))"
    error = f"(({high} * {k} - {product}) + (({x}) - {high}) * {k})"
    return f"(floor({product} / 2) + CASE WHEN {over} > 0 OR ({over} = 0 AND ({error} > 0 OR ({error} = 0 AND floor({product} / 2) % 2 = 1))) THEN 1 ELSE 0 END) / {10**places}"


def strength(text: str, bare: str, m: str, word: str) -> str:
    return f"""CAST(CASE WHEN {rx(text, X.QUESTION_MARK)} THEN 2.0 ELSE 0 END + CASE WHEN {rx(text, X.INTERVIEWER_CONTROL)} THEN 2.0 ELSE 0 END
        + CASE WHEN {rx(bare, START_RE2)} AND {word} THEN 1.5 ELSE 0 END + CASE WHEN {rx(bare, X.QUESTION_END)} THEN 1.5 ELSE 0 END
        + CASE WHEN {word} THEN CASE WHEN {m} <= 30 THEN 1.0 ELSE 0.2 END ELSE 0 END AS DOUBLE)"""


def has(reason: str) -> str:
    return f"CAST(count(*) FILTER (contains(reasons, '{reason}')) AS BIGINT)"


TOPIC_ROWS = ", ".join(f"({k}, {j}, {quote(label)}, {quote(w)})" for k, (label, ws) in enumerate(X.TOPICS.items()) for j, w in enumerate(ws))
ORACLES = {
    "segments": f"WITH {SEG} SELECT * FROM seg",
    "text_features": f"""WITH {SEG}, {FEAT} SELECT conv_id, idx, CAST(len(regexp_extract_all(text, '{X.MEANINGFUL}')) AS INT) AS m, v1_score,
        bare IN ({", ".join(map(quote, X.ACKNOWLEDGEMENTS))}) OR {rx("bare", X.ACKNOWLEDGEMENT)} AS ack, strength,
        format('{{:02d}}:{{:02d}}:{{:02d}}.{{:03d}}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS stamp
        FROM (SELECT *, CAST("start" * 1000 AS BIGINT) AS ms FROM feat)""",
    "cleanup": f"WITH {SEG}, {FEAT}, {CLEAN} SELECT conv_id, idx, m, strength, reasons, valid FROM clean",
    "statistics": f"""WITH {SEG}, {FEAT}, {CLEAN} SELECT conv_id, count(*) AS segment_count, CAST(count(*) FILTER (valid) AS BIGINT) AS valid_count,
        CAST(count(*) FILTER (NOT valid) AS BIGINT) AS invalid_count, CAST(count(*) FILTER (speaker = 'speaker_unknown') AS BIGINT) AS unknown_speaker_count,
        {has("pure_or")} AS n_punctuation, {has("repetitive_noise")} AS n_noise, {has("low_text_density")} AS n_sparse, {has("very_little")} AS n_little,
        max("end") AS duration, CAST(sum(m) AS BIGINT) AS meaningful_chars FROM clean GROUP BY conv_id""",
    "dictionary_topics": f"""WITH dict AS (SELECT item_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[ \\n.,;:!?]+'), lambda x: length(x) >= 5) AS all_w,
            list_filter(all_w, lambda x, i: list_position(all_w, x) = i) AS w FROM benchmark)),
        hit AS (SELECT doc_id, item_id, count(*) AS n, string_agg(word, '|' ORDER BY pos) AS keywords FROM documents JOIN dict ON contains(lower(text), lower(word)) GROUP BY ALL),
        best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, item_id) = 1)
        SELECT doc_id, coalesce('item_' || item_id, '{X.UNCLASSIFIED}') AS label, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN best USING (doc_id)""",
    "topic_classify": f"""WITH {SEG}, dict(p, j, label, word) AS (VALUES {TOPIC_ROWS}),
        hit AS (SELECT conv_id, idx, p, label, count(*) AS n, string_agg(word, '|' ORDER BY j) AS keywords FROM seg JOIN dict ON contains(lower(text), lower(word)) GROUP BY ALL),
        best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY conv_id, idx ORDER BY n DESC, p) = 1)
        SELECT conv_id, idx, coalesce(label, '{X.UNCLASSIFIED}') AS label, coalesce(keywords, '') AS keywords FROM seg LEFT JOIN best USING (conv_id, idx)""",
    "v1_roles": f"""WITH {SEG}, {FEAT}, s AS (SELECT conv_id, speaker, CAST(sum(v1_score) AS BIGINT) AS score FROM feat WHERE speaker <> 'speaker_unknown' GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, speaker) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY speaker) AS a,
        max(score) OVER (PARTITION BY conv_id) AS top, count(*) OVER (PARTITION BY conv_id) AS n FROM s)
        SELECT conv_id, speaker, score, CASE WHEN (CASE WHEN top >= 1 OR n = 1 THEN b ELSE a END) = 1 THEN 'interviewer' ELSE 'candidate' END AS role FROM r""",
    "v1_turns": f"""WITH {SEG}, a AS (SELECT *, coalesce(CAST(speaker <> lag(speaker) OVER w AS INT), 1) AS same FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
        b AS (SELECT *, sum(same) OVER (PARTITION BY conv_id ORDER BY idx) AS run FROM a),
        c AS (SELECT *, coalesce(CAST("start" - max("end") OVER (PARTITION BY conv_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > CAST(0.8 AS DOUBLE) AS INT), 1) AS fresh FROM b),
        d AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) AS turn_no FROM c)
        SELECT conv_id, turn_no, any_value(speaker) AS speaker, arg_min("start", idx) AS "start", max("end") AS "end", string_agg(id, ',' ORDER BY idx) AS segment_ids, string_agg(text, '' ORDER BY idx) AS text FROM d GROUP BY conv_id, turn_no""",
    "speaker_priors": f"""WITH {SEG}, {FEAT}, {CLEAN},
        s AS (SELECT conv_id, speaker, sum(CASE WHEN strength >= 2.5 THEN CAST(round(least(strength, 5.0) * 10) AS BIGINT) ELSE 0 END) AS asked,
        count(*) FILTER ({rx("text", X.INTERVIEWER_CONTROL)}) AS controls, sum(m) AS chars, count(*) FILTER ({rx("text", X.CANDIDATE_EVIDENCE)}) AS evidence, count(*) FILTER (m >= 60) AS lng
        FROM clean WHERE valid GROUP BY ALL),
        t AS (SELECT *, CAST(1.0 AS DOUBLE) + CAST(asked AS DOUBLE) * CAST(0.15 AS DOUBLE) + CAST(3.0 AS DOUBLE) * controls AS i0, CAST(1.0 AS DOUBLE) + CAST(chars AS DOUBLE) / CAST(45.0 AS DOUBLE) + CAST(3.0 AS DOUBLE) * evidence + CAST(2.0 AS DOUBLE) * lng AS c0 FROM s),
        u AS (SELECT *, i0 / sum(i0) OVER (PARTITION BY conv_id) AS i, c0 / sum(c0) OVER (PARTITION BY conv_id) AS c FROM t),
        v AS (SELECT *, i + greatest(CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE) - c) AS si, c + greatest(CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE) - i) AS sc FROM u)
        SELECT conv_id, speaker, {half_even("si / (si + sc)", 4)} AS interviewer, {half_even("sc / (si + sc)", 4)} AS candidate FROM v""",
    "markdown_escape": r"""SELECT conv_id, turn, regexp_replace(regexp_replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\'),
        '([`*_\[\]])', '\\\1', 'g'), '\r\n|\r|\n', '<br>', 'g') AS text FROM conversations""",
    "ordered_concat": "SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
}

# Phases: walks back as self-joins, sticky labels as a last value over events.
PHASE = f"""
tx AS (SELECT a.conv_id, a.idx, a.secs, a.w, string_agg(c.text, '' ORDER BY c.idx) AS text FROM (
        SELECT a.conv_id, a.idx, k.secs, coalesce(max(b.idx) FILTER (a."end" - b."start" > k.secs) + 1, 1) AS w
        FROM (SELECT *, max("end") OVER (PARTITION BY conv_id) AS duration FROM clean) a JOIN (VALUES (CAST(45 AS DOUBLE)), (CAST(20 AS DOUBLE))) k(secs) ON a.valid AND CASE WHEN k.secs = 45 THEN a."start" >= 120 ELSE a."start" >= duration * CAST(0.5 AS DOUBLE) END
        LEFT JOIN clean b ON b.conv_id = a.conv_id AND b.idx < a.idx GROUP BY ALL) a
        JOIN clean c ON c.conv_id = a.conv_id AND c.idx BETWEEN a.w AND a.idx GROUP BY ALL),
tf AS (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS bare, len(regexp_extract_all(regexp_replace(text, '\\s+', '', 'g'), '{X.MEANINGFUL}')) AS m FROM tx),
tk AS (SELECT *, CASE WHEN secs = 45 THEN {rx("text", X.PROJECT)} AND {rx("text", X.PROJECT_ADDRESSED)} AND {strength("text", "bare", "m", rx("bare", X.QUESTION_WORD))} >= 2
        ELSE {rx("text", X.CANDIDATE_QUESTION_CUE)} AND {rx("text", X.CANDIDATE_QUESTION_TOPIC)} END AS good FROM tf),
ctx AS (SELECT conv_id, arg_min(w, idx) FILTER (secs = 45 AND good) AS w45, arg_min(w, idx) FILTER (secs = 20 AND good) AS w20 FROM tk GROUP BY conv_id),
pd AS (SELECT *, max("end") OVER (PARTITION BY conv_id) AS duration FROM clean),
cue AS (SELECT conv_id, min(idx) FILTER (valid AND "start" >= 45 AND {rx("text", X.PROJECT_PROMPT)}) AS p, min(idx) FILTER (valid AND "start" >= 120 AND {rx("text", X.CODING_STRONG)}) AS c,
        min(idx) FILTER (valid AND "start" >= duration * CAST(0.5 AS DOUBLE) AND {rx("text", X.CANDIDATE_QUESTION_START)}) AS q,
        min(idx) FILTER (valid AND "start" >= duration * CAST(0.65 AS DOUBLE) AND {rx("text", X.END)}) AS e FROM pd GROUP BY conv_id),
cu2 AS (SELECT cue.conv_id, least(p, w45) AS p, c, coalesce(q, w20) AS q, e FROM cue LEFT JOIN ctx USING (conv_id)),
bk AS (SELECT u.conv_id, any_value(u.p) AS p1, any_value(u.c) AS c1, any_value(u.q) AS q0, any_value(u.e) AS e0,
        max(s.idx) FILTER (s.idx < u.p AND s."start" < ap."start" - 10) AS pe, max(s.idx) FILTER (s.idx < u.c AND s."start" < ac."start" - 10) AS ce
        FROM cu2 u LEFT JOIN clean ap ON ap.conv_id = u.conv_id AND ap.idx = u.p LEFT JOIN clean ac ON ac.conv_id = u.conv_id AND ac.idx = u.c JOIN clean s ON s.conv_id = u.conv_id GROUP BY u.conv_id),
st AS (SELECT conv_id, CASE WHEN p1 IS NOT NULL THEN coalesce(pe + 1, 1) END AS p0, CASE WHEN c1 IS NOT NULL THEN coalesce(ce + 1, 1) END AS c0, q0, e0 FROM bk),
sk AS (SELECT clean.*, p0, c0, q0, e0, idx < least(coalesce(c0, 1 << 30), coalesce(q0, 1 << 30), coalesce(e0, 1 << 30)) AS sticky, {rx("text", X.BEHAVIORAL)} AS beh, {rx("text", X.PROJECT_PROMPT)} AS pp FROM clean JOIN st USING (conv_id)),
lv AS (SELECT *, least(coalesce(p0, 1 << 30), coalesce(min(idx) FILTER (sticky AND (beh OR pp)) OVER (PARTITION BY conv_id), 1 << 30)) AS leave FROM sk),
ev0 AS (SELECT *, CASE WHEN NOT sticky THEN NULL WHEN beh THEN 'BEHAVIORAL' WHEN pp THEN 'PROJECT' WHEN {rx("text", X.TECH)} AND strength >= 2.5 AND idx >= leave THEN 'TECH_QA' WHEN idx = leave THEN 'PROJECT' END AS event FROM lv),
ph0 AS (SELECT *, CASE WHEN idx >= e0 THEN 'END' WHEN idx >= q0 THEN 'CANDIDATE_QUESTIONS' WHEN idx >= c0 THEN CASE WHEN {rx("text", X.CODING_DISCUSSION)} AND strength >= 2 THEN 'CODING_DISCUSSION' ELSE 'CODING' END
        ELSE coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 'INTRO') END AS phase FROM ev0),
ph AS (SELECT *, CASE WHEN phase LIKE 'CODING%' THEN 'CODING' WHEN phase IN ('PROJECT', 'TECH_QA') THEN 'INTERVIEW_QA' ELSE phase END AS family FROM ph0)"""
PRIOR = ORACLES["speaker_priors"].split("WITH ", 1)[1].split("s AS (SELECT conv_id, speaker", 1)[1].rsplit("SELECT conv_id, speaker, (floor", 1)
PRIORS = "s AS (SELECT conv_id, speaker" + PRIOR[0].rstrip() + ",\nprior AS (SELECT conv_id, speaker, (floor" + PRIOR[1] + ")"
ROLES = f"""{PHASE}, {PRIORS},
fe0 AS (SELECT ph.*, coalesce(prior.interviewer, 0.5) AS pi, coalesce(prior.candidate, 0.5) AS pc, strength >= 2.5 AS asks, phase = 'CANDIDATE_QUESTIONS' AS own, {rx("text", X.CANDIDATE_EVIDENCE)} AS evidence,
        lag(ph.speaker) OVER v AS bs, lag("end") OVER v AS be, {rx("text", X.QUESTION_MARK)} AS marked, {rx("text", X.DIRECT_ADDRESS)} AS direct
        FROM ph LEFT JOIN prior ON prior.conv_id = ph.conv_id AND prior.speaker = ph.speaker WINDOW v AS (PARTITION BY ph.conv_id, valid ORDER BY idx)),
fe AS (SELECT *, CAST(CASE WHEN asks THEN strength + CASE WHEN {rx("text", X.INTERVIEWER_CONTROL)} THEN 1.5 ELSE 0 END ELSE 0 END AS DOUBLE) + 2.0 * pi AS base_i,
        CAST(CASE WHEN evidence THEN 3 ELSE 0 END + CASE WHEN m >= 30 THEN 1 ELSE 0 END + CASE WHEN m >= 80 THEN 1 ELSE 0 END + CASE WHEN {rx("text", X.AFFIRMATIVE_START)} THEN 1 ELSE 0 END AS DOUBLE) + 2.0 * pc AS base_c,
        CASE WHEN asks AND NOT marked AND NOT direct THEN CAST(2 AS DOUBLE) ELSE 0 END AS echo, abs(pi - pc) AS gap, coalesce(speaker = bs AND "start" - be <= 1.0, FALSE) AS goes FROM fe0),
fold(conv_id, idx, expected, asker, last, role, sure) AS (
    SELECT DISTINCT conv_id, 0, '', '', '', 'unknown', CAST(0 AS DOUBLE) FROM fe
    UNION ALL
    SELECT conv_id, idx, CASE WHEN NOT asked THEN expected WHEN role = 'interviewer' THEN 'candidate' ELSE 'interviewer' END, CASE WHEN asked THEN speaker ELSE asker END, CASE WHEN valid THEN role ELSE last END,
        role, CASE WHEN NOT valid THEN 0 WHEN unsure THEN CAST(0.45 AS DOUBLE) ELSE {half_even("least(CAST(0.98 AS DOUBLE), CAST(0.54 AS DOUBLE) + abs(i - c) * CAST(0.09 AS DOUBLE) + gap * CAST(0.15 AS DOUBLE))", 2)} END
    FROM (SELECT *, valid AND asks AND (role = 'interviewer' OR role = 'candidate' AND own) AS asked FROM (SELECT *, CASE WHEN NOT valid OR unsure THEN 'unknown' WHEN i > c THEN 'interviewer' ELSE 'candidate' END AS role
    FROM (SELECT *, greatest(i, c) < 0.75 OR (abs(i - c) < 0.2 AND gap < 0.08) AS unsure
    FROM (SELECT *, base_i - CASE WHEN own AND asks THEN 1 ELSE 0 END + (CASE WHEN owed AND expected = 'interviewer' THEN CAST(1.25 AS DOUBLE) ELSE 0 END + CASE WHEN goes AND last = 'interviewer' THEN CAST(0.4 AS DOUBLE) ELSE 0 END) AS i,
        base_c + CASE WHEN expected = 'candidate' THEN echo ELSE 0 END + CASE WHEN own AND asks THEN 4 ELSE 0 END + (CASE WHEN owed AND expected = 'candidate' THEN CAST(1.25 AS DOUBLE) ELSE 0 END + CASE WHEN goes AND last = 'candidate' THEN CAST(0.4 AS DOUBLE) ELSE 0 END) AS c
    FROM (SELECT fe.conv_id, fe.idx, expected, asker, last, speaker, valid, asks, own, base_i, base_c, echo, goes, gap, expected <> '' AND NOT asks AND (speaker <> asker OR evidence OR m >= 35) AS owed
        FROM fold JOIN fe ON fe.conv_id = fold.conv_id AND fe.idx = fold.idx + 1)))))),
ro AS (SELECT fe.*, role, sure FROM fe JOIN fold USING (conv_id, idx))"""
TURNS = f"""
tv AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS k FROM ro WHERE valid),
tn(conv_id, k, no, role, family, "end") AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, '', '', CAST(0 AS DOUBLE) FROM tv
    UNION ALL
    SELECT conv_id, k, no + CASE WHEN joins THEN 0 ELSE 1 END, CASE WHEN joins THEN trole ELSE role END, CASE WHEN joins THEN tfamily ELSE family END, CASE WHEN joins THEN greatest("end", tend) ELSE "end" END
    FROM (SELECT tv.conv_id, tv.k, tn.no, tn.role AS trole, tn.family AS tfamily, tn."end" AS tend, tv.role, tv.family, tv."end",
        tn.no > 0 AND tn.family = tv.family AND tv."start" - tn."end" <= CAST(1.2 AS DOUBLE) AND ((tn.role = tv.role AND tv.role <> 'unknown') OR (tv.role = 'unknown' AND tn.role <> 'unknown' AND tv."start" - tn."end" <= CAST(0.7 AS DOUBLE) AND strength < 2)) AS joins
        FROM tn JOIN tv ON tv.conv_id = tn.conv_id AND tv.k = tn.k + 1))"""


AN = f"""
an0 AS (SELECT *, {rx("bare", X.ACKNOWLEDGEMENT)} OR bare IN ({", ".join(map(quote, X.ACKNOWLEDGEMENTS))}) AS ack, {rx("text", X.ADMIN)} AS admin, {rx("text", X.RESPONSE_START)} AS response,
        coalesce(lag({rx("text", X.EXAMPLE_CUE)}) OVER (PARTITION BY conv_id ORDER BY idx), FALSE) AND NOT direct AS vetoed,
        {rx("text", X.INVITATION)} OR ({rx("bare", X.NO_MORE_QUESTIONS)} AND NOT direct) AS barred FROM ro),
an1 AS (SELECT *, CASE WHEN NOT valid OR phase = 'END' OR vetoed OR ack OR admin OR barred THEN NULL
        WHEN phase = 'CANDIDATE_QUESTIONS' THEN CASE WHEN strength >= 2.5 OR {rx("text", X.PROMPT_MARKER)} THEN 'candidate' END
        WHEN family = 'CODING' THEN CASE WHEN strength >= 3 OR direct THEN 'interviewer' END
        WHEN role = 'interviewer' THEN CASE WHEN strength >= 2.5 OR direct OR (marked AND m >= 4 AND strength >= 2 AND {rx("text", X.QUESTION_WORD)}) THEN 'interviewer' END
        WHEN direct OR ({rx("text", X.PRECISE_MARKER)} AND strength >= 2) THEN 'interviewer' END AS asked_by FROM an0),
an AS (SELECT *, asked_by IS NOT NULL AS anchor, "start" - lag("end") OVER w AS wait, lag(valid AND asked_by IS NULL AND NOT response) OVER w AS b_ok, lag(family) OVER w AS b_family, lag(role) OVER w AS b_role FROM an1 WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
ah AS (SELECT a.conv_id, a.idx, any_value(CASE WHEN a.b_ok AND a.b_family = a.family AND a.b_role = a.asked_by AND a.wait <= CAST(0.8 AS DOUBLE) THEN a.idx - 1 ELSE a.idx END) AS lo,
        any_value(a.marked) AS marked, min(b.idx) FILTER (b.anchor OR NOT b.valid OR b.family <> a.family OR b.wait > CAST(1.2 AS DOUBLE) OR b."end" - a."start" > 8 OR b.response
          OR (b.role <> a.asked_by AND b.sure >= 0.6 AND b.speaker <> a.speaker)) AS stop_at, min(b.idx) FILTER (b.marked) AS mark_at, max(b.idx) AS top,
        any_value(a.asked_by) AS asked_by, any_value(a.family) AS family, any_value(a.phase) AS phase
        FROM an a LEFT JOIN an b ON b.conv_id = a.conv_id AND b.idx > a.idx WHERE a.anchor GROUP BY a.conv_id, a.idx),
sp AS (SELECT *, CASE WHEN marked THEN idx ELSE least(coalesce(stop_at - 1, 1 << 30), coalesce(mark_at, 1 << 30), coalesce(top, idx)) END AS hi FROM ah),
sp1 AS (SELECT sp.*, f."start" AS s0, t."end" AS s1, (SELECT max(sure) FROM an m WHERE m.conv_id = sp.conv_id AND m.idx BETWEEN sp.lo AND sp.hi) AS most FROM sp JOIN an f ON f.conv_id = sp.conv_id AND f.idx = sp.lo JOIN an t ON t.conv_id = sp.conv_id AND t.idx = sp.hi),
sp2 AS (SELECT *, coalesce(CAST((asked_by, family) IS DISTINCT FROM (lag(asked_by) OVER w, lag(family) OVER w) AS INT), 1) AS turned FROM sp1 WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
sp3 AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY idx) AS run FROM sp2),
sp4 AS (SELECT *, coalesce(CAST(s0 > max(s1) OVER (PARTITION BY conv_id, run ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + CAST(0.5 AS DOUBLE) AS INT), 1) AS fresh FROM sp3),
sp5 AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) AS prompt_no FROM sp4),
pm AS (SELECT DISTINCT sp5.conv_id, prompt_no, m.idx, m.id, m.speaker, m.text FROM sp5 JOIN an m ON m.conv_id = sp5.conv_id AND m.idx BETWEEN lo AND hi),
pmt AS (SELECT conv_id, prompt_no, string_agg(id, ',' ORDER BY idx) AS segment_ids, string_agg(text, '' ORDER BY idx) AS text FROM pm GROUP BY ALL),
pms AS (SELECT conv_id, prompt_no, string_agg(speaker, ',' ORDER BY i) AS speaker_ids FROM (SELECT conv_id, prompt_no, speaker, min(idx) AS i FROM pm GROUP BY ALL) GROUP BY ALL),
pr0 AS (SELECT conv_id, prompt_no, arg_min(s0, idx) AS "start", max(s1) AS "end", arg_min(asked_by, idx) AS asked_by, {half_even("greatest(CAST(0.55 AS DOUBLE), arg_min(most, idx))", 2)} AS role_confidence,
        arg_min(phase, idx) AS phase, arg_min(family, idx) AS family FROM sp5 GROUP BY ALL),
pr AS (SELECT pr0.*, text, segment_ids, speaker_ids, lead("start") OVER (PARTITION BY conv_id ORDER BY prompt_no) AS next FROM pr0 JOIN pmt USING (conv_id, prompt_no) JOIN pms USING (conv_id, prompt_no))"""
ANSWER = f"""
am AS (SELECT pr.conv_id, pr.prompt_no, s.* EXCLUDE (conv_id) FROM pr JOIN an s ON s.conv_id = pr.conv_id AND s.valid AND s.phase <> 'END' AND NOT s.ack AND NOT s.admin AND s."start" >= pr."end" AND (pr.next IS NULL OR s."start" < pr.next)
        AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.conv_id = pr.conv_id AND pm.prompt_no = pr.prompt_no AND pm.idx = s.idx)),
as_ AS (SELECT conv_id, prompt_no, string_agg(speaker, ',' ORDER BY i) AS speaker_ids FROM (SELECT conv_id, prompt_no, speaker, min(idx) AS i FROM am GROUP BY ALL) GROUP BY ALL),
aw AS (SELECT am.conv_id, am.prompt_no, CASE WHEN any_value(pr.asked_by) = 'interviewer' THEN 'candidate' ELSE 'interviewer' END AS role, list(sure ORDER BY idx) AS sures, arg_min(am."start", idx) AS "start", arg_max(am."end", idx) AS "end",
        string_agg(id, ',' ORDER BY idx) AS segment_ids, string_agg(am.text, '' ORDER BY idx) AS text FROM am JOIN pr USING (conv_id, prompt_no) GROUP BY ALL),
ans AS (SELECT aw.* EXCLUDE (sures), {half_even("list_aggregate(sures, 'sum') / len(sures)", 2)} AS role_confidence, speaker_ids FROM aw JOIN as_ USING (conv_id, prompt_no))"""
WORDS = "[" + ", ".join("{'p': %d, 'label': %s, 'words': [%s]}" % (k, quote(label), ", ".join(map(quote, ws))) for k, (label, ws) in enumerate(X.TOPICS.items())) + "]"


def topic(text: str) -> str:
    """{n, p, label, words} of the best label, {0, 99, unclassified, []} for none."""
    hits = f"[{{'n': -len([w for w in entry.words if contains(lower({text}), lower(w))]), 'p': entry.p, 'label': entry.label, 'words': [w for w in entry.words if contains(lower({text}), lower(w))]}} for entry in {WORDS}]"
    none = "{'n': 0, 'p': -1, 'label': '%s', 'words': CAST([] AS VARCHAR[])}" % X.UNCLASSIFIED
    return f"list_min(list_prepend({none}, {hits}))"


TREE = f"""
tp AS (SELECT *, {topic("text")}.label AS label, len(regexp_extract_all(text, '{X.MEANINGFUL}')) AS m, {rx("text", X.IMPERATIVE_START)} AS imp,
        CASE WHEN {rx("text", X.NEW_TOPIC)} THEN 'main_question' WHEN {rx("text", X.CLARIFICATION)} THEN 'clarification' WHEN {rx("text", X.FOLLOW_UP)} THEN 'follow_up' END AS own FROM pr),
nd(conv_id, prompt_no, root, child, kind, relation, r_asker, r_family, r_label, r_start) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '', '', '', '', '', CAST(0 AS DOUBLE) FROM tp
    UNION ALL
    SELECT conv_id, prompt_no, root + CAST(kind = 'main_question' AS INT), CASE WHEN kind = 'main_question' THEN 0 ELSE child + 1 END, kind, CASE WHEN root = 0 THEN 'first_question' WHEN kind = 'main_question' THEN 'topic_switch' ELSE 'same_topic' END,
        CASE WHEN kind = 'main_question' THEN asked_by ELSE r_asker END, CASE WHEN kind = 'main_question' THEN family ELSE r_family END, CASE WHEN kind = 'main_question' THEN label ELSE r_label END, CASE WHEN kind = 'main_question' THEN "start" ELSE r_start END
    FROM (SELECT tp.*, nd.root, nd.child, nd.r_asker, nd.r_family, nd.r_label, nd.r_start, CASE WHEN nd.root = 0 OR asked_by <> r_asker OR family <> r_family THEN 'main_question' WHEN own IS NOT NULL THEN own WHEN m <= 16 THEN 'follow_up'
        WHEN (label <> '{X.UNCLASSIFIED}' AND r_label <> '{X.UNCLASSIFIED}' AND label <> r_label) OR "start" - r_start >= 240 OR (imp AND nd.child > 0) THEN 'main_question' ELSE 'follow_up' END AS kind
        FROM nd JOIN tp ON tp.conv_id = nd.conv_id AND tp.prompt_no = nd.prompt_no + 1)),
tree AS (SELECT tp.*, root AS root_no, child AS child_no, kind AS node_type, relation, 'Q' || root || CASE WHEN child > 0 THEN '.' || child ELSE '' END AS node_id, CASE WHEN child > 0 THEN 'Q' || root END AS parent_id FROM nd JOIN tp USING (conv_id, prompt_no))"""
EVENT = f"""
ne AS (SELECT *, lead("start") OVER w AS n_start, lead(phase) OVER w AS n_phase, lead(id) OVER w AS n_id FROM ph WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
e0_ AS (SELECT conv_id, idx, 0 AS late, CASE WHEN contains(reasons, 'long_duration') THEN 'coding_low_speech_density' ELSE 'coding_noise' END AS event_type, phase, "start", "end", id AS ids, reasons FROM ph WHERE family = 'CODING' AND NOT valid
        UNION ALL SELECT conv_id, idx, 1, 'coding_silence', 'CODING', "end", n_start, id || ',' || n_id, 'gap_between_coding_segments' FROM ne WHERE phase LIKE 'CODING%' AND n_phase LIKE 'CODING%' AND n_start - "end" >= 8),
e1_ AS (SELECT *, row_number() OVER w AS seq_, coalesce(CAST(event_type <> lag(event_type) OVER w AS INT), 1) AS turned FROM e0_ WINDOW w AS (PARTITION BY conv_id ORDER BY "start", "end", late, idx)),
e2_ AS (SELECT *, sum(turned) OVER (PARTITION BY conv_id ORDER BY seq_) AS run FROM e1_),
e3_ AS (SELECT *, coalesce(CAST("start" > max("end") OVER (PARTITION BY conv_id, run ORDER BY seq_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 AS INT), 1) AS fresh FROM e2_),
e4_ AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY seq_) AS BIGINT) AS event_no FROM e3_),
evs AS (SELECT conv_id, event_no, any_value(event_type) AS event_type, arg_min(phase, seq_) AS phase, min("start") AS "start", max("end") AS "end", string_agg(ids, ',' ORDER BY seq_) AS segment_ids,
        array_to_string(list_sort(list_distinct(string_split(string_agg(reasons, '|'), '|'))), '|') AS reasons, format('event_{{:03d}}', event_no) AS id FROM e4_ GROUP BY conv_id, event_no)"""
V1TURNS = ORACLES["v1_turns"].split("WITH ", 1)[1].split("a AS (SELECT *", 1)[1].split("SELECT conv_id, turn_no", 1)[0]
V1ROLES = ORACLES["v1_roles"].split("s AS (SELECT", 1)[1].split("SELECT conv_id, speaker, score", 1)[0]
V1QA = f"""
vs AS (SELECT {V1ROLES.replace("r AS (", "vr AS (").replace("FROM s)", "FROM vs)").rstrip()},
vrole AS (SELECT conv_id, speaker, CASE WHEN (CASE WHEN top >= 1 OR n = 1 THEN b ELSE a END) = 1 THEN 'interviewer' ELSE 'candidate' END AS role FROM vr),
va AS (SELECT *{V1TURNS.replace("b AS (SELECT *, sum(same)", "vb AS (SELECT *, sum(same)").replace("FROM a)", "FROM va)").replace("c AS (SELECT *, coalesce", "vc AS (SELECT *, coalesce").replace("FROM b)", "FROM vb)").replace("d AS (SELECT *, CAST", "vd AS (SELECT *, CAST").replace("FROM c)", "FROM vc)").rstrip()},
vt0 AS (SELECT conv_id, turn_no, any_value(speaker) AS speaker, string_agg(id, ',' ORDER BY idx) AS ids, trim(string_agg(text, '' ORDER BY idx)) AS text FROM vd GROUP BY conv_id, turn_no),
vt1 AS (SELECT vt0.*, role, role = 'interviewer' AND text NOT IN ({", ".join(map(quote, X.ACKNOWLEDGEMENTS))}) AS asks, {" OR ".join(f"contains(text, {quote(c)})" for c in X.V1_NEW_TOPICS)} AS switches,
        {" OR ".join(f"starts_with(text, {quote(c)})" for c in X.V1_FOLLOW_UPS)} AS follows, {topic("text")} AS t FROM vt0 JOIN vrole USING (conv_id, speaker)),
vt AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_no) AS k FROM vt1 WHERE asks OR role = 'candidate'),
vq(conv_id, k, item, prompt, asked) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, '' FROM vt
    UNION ALL
    SELECT conv_id, k, CASE WHEN asks AND NOT on_ THEN item + 1 ELSE item END, CASE WHEN NOT asks THEN prompt WHEN on_ THEN prompt + 1 ELSE 0 END, CASE WHEN NOT asks THEN asked WHEN on_ THEN asked || ' ' || text ELSE text END
    FROM (SELECT *, item > 0 AND NOT switches AND (follows OR (o.label <> '{X.UNCLASSIFIED}' AND o.label = t.label) OR CASE WHEN len(o.words) > 0 AND len(t.words) > 0 THEN
            len(list_intersect(o.words, t.words)) / len(list_distinct(list_concat(o.words, t.words))) >= 0.25 ELSE FALSE END) AS on_
        FROM (SELECT vt.*, vq.item, vq.prompt, vq.asked, {topic("vq.asked")} AS o FROM vq JOIN vt ON vt.conv_id = vq.conv_id AND vt.k = vq.k + 1))),
vm AS (SELECT vt.*, item, prompt FROM vq JOIN vt USING (conv_id, k) WHERE item > 0),
vp AS (SELECT conv_id, item, prompt, CASE WHEN prompt = 0 THEN 'main' ELSE 'follow_up_' || prompt END AS name, string_agg(ids, ',' ORDER BY k) FILTER (asks) AS q_ids, string_agg(text, ' ' ORDER BY k) FILTER (asks) AS q, string_agg(ids, ',' ORDER BY k) FILTER (NOT asks) AS a_ids,
        string_agg(text, ' ' ORDER BY k) FILTER (NOT asks) AS a, string_agg(ids, ',' ORDER BY k) AS ids FROM vm GROUP BY conv_id, item, prompt),
vi AS (SELECT conv_id, item, arg_min(q_ids, prompt) AS question_ids, arg_min(q, prompt) AS question, coalesce(string_agg(name || '|' || q_ids || '|' || q, ';' ORDER BY prompt) FILTER (prompt > 0), '') AS follow_ups,
        coalesce(string_agg(name || '|' || a_ids || '|' || a, ';' ORDER BY prompt) FILTER (a IS NOT NULL), '') AS answers, string_agg(ids, ',' ORDER BY prompt) AS segment_ids, string_agg(q, ' ' ORDER BY prompt) AS whole FROM vp GROUP BY conv_id, item),
vz AS (SELECT *, {topic("whole")} AS t FROM vi),
v1qa AS (SELECT conv_id, format('qa_{{:03d}}', item) AS id, question_ids, question, follow_ups, answers, segment_ids, t.label AS label, array_to_string(t.words, '|') AS keywords, CASE WHEN item = 1 THEN 'first_topic'
        WHEN len(list_intersect(t.words, lag(t.words) OVER w)) > 0 OR (t.label <> '{X.UNCLASSIFIED}' AND t.label = lag(t.label) OVER w) THEN 'same_topic' ELSE 'new_or_unknown_topic' END AS relation FROM vz WINDOW w AS (PARTITION BY conv_id ORDER BY item))"""
BASE = f"WITH RECURSIVE {SEG}, {FEAT}, {CLEAN}"
IDS = "string_split(%s, ',')"


def replaced(text: str) -> list[tuple[str, str]]:
    """(kind, text that kind is looked for in) and lastly ('', redacted text), in SQL without look-around:
    runs of digits are fenced, so that a fence stands where no digit may."""
    out, pats = [], {
        "credential": r"(?i)\b(?:api[_-]?key|access[_-]?token|password|passwd|secret)\b\s*[:=]\s*[^\s,;]+", "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
        "phone": "(?:\\+?<86>[-\\s])?<(?:86)?1[3-9][0-9]{9}>", "cn_id": "<[0-9]{17}(?:[0-9]>|>[Xx])", "ipv4": "<(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])>(?:\\.<(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])>){3}",
    }
    for kind, p in pats.items():
        fenced = "<" in p
        p = p.replace("<", "\x01").replace(">", "\x02")
        look = f"regexp_replace({text}, '[0-9]+', chr(1) || '\\0' || chr(2), 'g')" if fenced else text
        out.append((kind, f"len(regexp_extract_all({look}, {quote(p)}))"))
        text = f"regexp_replace({look}, {quote(p)}, '[REDACTED_{kind.upper()}]', 'g')"
        text = f"translate({text}, chr(1) || chr(2), '')" if fenced else text
    return [*out, ("", text)]


NORMAL = "regexp_replace(text, '\\s+', ' ', 'g')"
for _key in sorted(X.REPLACEMENTS, key=len, reverse=True):
    _value = X.REPLACEMENTS[_key]
    _quoted = "".join(f"\\{c}" if c in "+.*?()[]{}|^$\\" else c for c in _key)
    if _key.isascii():
        # Fences at the borders of runs of letters and digits stand for look-around.
        _first, _last = ("\x01" if _key[0].isalnum() else "(^|[^A-Za-z0-9])"), ("\x02" if _key[-1].isalnum() else "")
        _inner = "".join(("\x02" + c if k and _quoted_prev.isalnum() and not c.isalnum() else ("\x01" + c if k and not _quoted_prev.isalnum() and c.isalnum() else c)).replace("+", "\\+") for k, c in enumerate(_key) for _quoted_prev in [_key[k - 1] if k else ""])
        NORMAL = f"translate(regexp_replace(regexp_replace({NORMAL}, '[A-Za-z0-9]+', chr(1) || '\\0' || chr(2), 'g'), {quote('(?i)' + _first + _inner + _last)}, {quote(_value)}, 'g'), chr(1) || chr(2), '')"
    else:
        NORMAL = f"regexp_replace({NORMAL}, {quote(_quoted)}, {quote(_value)}, 'g')"
NORMAL = f"trim(regexp_replace({NORMAL}, '\\s+([，。！？；：、,.!?;:])', '\\1', 'g'))"
DOC_KINDS = replaced("coalesce(text, '')")
FLAT = """fu AS (SELECT conv_id, root_no, arg_min(node_id, child_no) AS root_question_id, arg_min(t.segment_ids, child_no) AS question_ids, coalesce(string_agg(node_id || '|' || node_type || '|' || t.segment_ids, ';' ORDER BY child_no) FILTER (child_no > 0), '') AS follow_ups,
        coalesce(string_agg(node_id || '|' || a.segment_ids, ';' ORDER BY child_no) FILTER (a.role = 'candidate'), '') AS answers, string_agg(t.segment_ids || coalesce(',' || a.segment_ids, ''), ',' ORDER BY child_no) AS every, arg_min(label, child_no) AS label, arg_min(relation, child_no) AS relation_to_previous
        FROM tree t LEFT JOIN ans a USING (conv_id, prompt_no) GROUP BY conv_id, root_no),
fx AS (SELECT conv_id, root_no, string_agg(x, ',' ORDER BY k) AS segment_ids FROM (SELECT conv_id, root_no, x, min(k) AS k FROM (SELECT conv_id, root_no, unnest(string_split(every, ',')) AS x, unnest(range(len(string_split(every, ',')))) AS k FROM fu) GROUP BY ALL) GROUP BY ALL)"""
ORACLES |= {
    "normalized_text": f"WITH {SEG} SELECT conv_id, idx, {NORMAL} AS text FROM seg",
    "raw_segments": f"WITH {SEG} SELECT conv_id, idx, id, \"start\", \"end\", speaker, {NORMAL} AS text FROM (SELECT seg.* FROM seg JOIN e USING (conv_id, idx) WHERE event_id % 13 <> 0)",
    "redacted_text": f"WITH {SEG} SELECT conv_id, idx, substr({replaced('text')[-1][1]}, 1, 2400) AS text FROM seg",
    "redaction_counts": "SELECT doc_id, " + ", ".join(f"CAST({c} AS BIGINT) AS n_{k}" for k, c in DOC_KINDS[:-1]) + " FROM documents",
    "keyword_similarity": f"""WITH {SEG}, k AS (SELECT conv_id, idx, {topic("text")}.words AS w, lag({topic("text")}.words) OVER (PARTITION BY conv_id ORDER BY idx) AS b FROM seg)
        SELECT conv_id, idx, CASE WHEN len(w) = 0 OR len(b) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(len(list_intersect(w, b)) AS DOUBLE) / len(list_distinct(list_concat(w, b))) END AS similarity FROM k WHERE b IS NOT NULL""",
    "inline_code": "SELECT page_id, sha256(translate(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`', '&#96;'), chr(13) || chr(10), '  ')) AS code_sha256 FROM pages",
    "session_ids": r"""SELECT page_id, CASE WHEN stem = '' THEN 'interview' ELSE stem END || '-' || substr(sha256(u), 1, 8) AS session_id FROM (SELECT page_id, u, substr(regexp_replace(regexp_replace(
        CASE WHEN regexp_matches(name, '.\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END, '[^A-Za-z0-9._一-鿿-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g'), 1, 64) AS stem
        FROM (SELECT page_id, coalesce(url, '') AS u, string_split(coalesce(url, ''), '/')[-1] AS name FROM pages))""",
    "dedupe_ordered": f"WITH {SEG}, m AS (SELECT conv_id, speaker, min(idx) AS i FROM seg WHERE speaker <> 'speaker_unknown' GROUP BY ALL) SELECT conv_id, coalesce(string_agg(speaker, ',' ORDER BY i), '') AS speakers FROM m GROUP BY conv_id",
    "phase_labels": f"{BASE}, {PHASE} SELECT conv_id, idx, phase FROM ph",
    "phase_spans": f"""{BASE}, {PHASE}, z AS (SELECT *, coalesce(CAST(phase <> lag(phase) OVER (PARTITION BY conv_id ORDER BY idx) AS INT), 1) AS fresh FROM ph), y AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) AS span_no FROM z)
        SELECT conv_id, span_no, any_value(phase) AS phase, arg_min("start", idx) AS "start", arg_max("end", idx) AS "end", string_agg(id, ',' ORDER BY idx) AS segment_ids FROM y GROUP BY conv_id, span_no""",
    "coding_silence": f"""{BASE}, {PHASE}, {EVENT} SELECT conv_id, idx, phase, "end" AS "start", n_start AS "end", id || ',' || n_id AS segment_ids FROM ne WHERE phase LIKE 'CODING%' AND n_phase LIKE 'CODING%' AND n_start - "end" >= 8""",
    "events_merged": f"""{BASE}, {PHASE}, {EVENT} SELECT *, round("end" - "start", 3) AS duration_seconds FROM evs""",
    "role_scores": f"{BASE}, {ROLES} SELECT conv_id, idx, pi AS p_interviewer, pc AS p_candidate, base_i, base_c FROM fe",
    "role_fold": f"{BASE}, {ROLES} SELECT conv_id, idx, role, sure AS role_confidence FROM ro",
    "speaker_summary": f"""{BASE}, {ROLES} SELECT ro.conv_id, ro.speaker, CASE WHEN any_value(interviewer) IS NULL THEN 'unknown' WHEN any_value(interviewer) >= any_value(candidate) THEN 'interviewer' ELSE 'candidate' END AS dominant_role,
        coalesce({half_even("greatest(any_value(interviewer), any_value(candidate))", 2)}, 0) AS role_confidence,
        count(*) FILTER (valid AND role = 'interviewer') AS n_interviewer, count(*) FILTER (valid AND role = 'candidate') AS n_candidate, count(*) FILTER (valid AND role = 'unknown') AS n_unknown
        FROM ro LEFT JOIN prior ON prior.conv_id = ro.conv_id AND prior.speaker = ro.speaker GROUP BY ro.conv_id, ro.speaker""",
    "v2_turns": f"""{BASE}, {ROLES}, {TURNS}, tm AS (SELECT tv.*, no FROM tv JOIN tn USING (conv_id, k)), ts AS (SELECT conv_id, no, string_agg(speaker, ',' ORDER BY i) AS speaker_ids FROM (SELECT conv_id, no, speaker, min(idx) AS i FROM tm GROUP BY ALL) GROUP BY ALL)
        SELECT conv_id, no AS turn_no, arg_min("start", idx) AS "start", max("end") AS "end", any_value(speaker_ids) AS speaker_ids, arg_min(role, idx) AS role, {half_even("min(sure)", 2)} AS role_confidence, arg_min(phase, idx) AS phase,
        string_agg(text, '' ORDER BY idx) AS text, string_agg(id, ',' ORDER BY idx) AS segment_ids FROM tm JOIN ts USING (conv_id, no) GROUP BY conv_id, no""",
    "prompt_anchors": f"{BASE}, {ROLES}, {AN} SELECT conv_id, idx, asked_by FROM an WHERE anchor",
    "prompt_spans": f'{BASE}, {ROLES}, {AN} SELECT conv_id, prompt_no, "start", "end", speaker_ids, asked_by, role_confidence, phase, text, segment_ids FROM pr',
    "answers": f'{BASE}, {ROLES}, {AN}, {ANSWER} SELECT conv_id, prompt_no, role, role_confidence, "start", "end", speaker_ids, segment_ids, text FROM ans',
    "question_tree": f"{BASE}, {ROLES}, {AN}, {TREE} SELECT conv_id, prompt_no, node_id, parent_id, node_type, relation AS relation_to_previous, label, text FROM tree",
    "evidence_sets": f"""{BASE}, {ROLES}, {AN}, {ANSWER}, {TREE} SELECT conv_id, node_id, array_to_string(list_sort(list_distinct(string_split(t.segment_ids || coalesce(',' || a.segment_ids, ''), ','))), ',') AS evidence FROM tree t LEFT JOIN ans a USING (conv_id, prompt_no)""",
    "flat_qa": f"""{BASE}, {ROLES}, {AN}, {ANSWER}, {TREE}, {FLAT} SELECT conv_id, format('qa_v2_{{:03d}}', root_no) AS id, root_question_id, question_ids, follow_ups, answers, segment_ids, label, relation_to_previous FROM fu JOIN fx USING (conv_id, root_no)""",
    "v1_qa": f"{BASE}, {V1QA} SELECT * FROM v1qa",
    "run_statistics": f"""{BASE}, {ROLES}, {AN}, {ANSWER}, {TREE}, {EVENT}, {V1QA},
        g AS (SELECT ro.conv_id, count(*) AS raw_segment_count, count(*) FILTER (valid) AS valid_segment_count, count(*) FILTER (NOT valid) AS invalid_segment_count, count(*) FILTER (ro.role = 'unknown') AS unknown_role_count, count(*) FILTER (valid AND ro.role = 'unknown') AS valid_unknown_role_count,
            count(*) FILTER (valid AND ro.role <> 'unknown' AND vrole.role <> ro.role) AS role_correction_count FROM ro LEFT JOIN vrole ON vrole.conv_id = ro.conv_id AND vrole.speaker = ro.speaker GROUP BY ro.conv_id),
        rs AS (SELECT conv_id, string_agg(r || '=' || n, ',' ORDER BY r) AS cleanup_reason_counts FROM (SELECT conv_id, r, count(*) AS n FROM (SELECT conv_id, unnest(string_split(reasons, '|')) AS r FROM clean WHERE NOT valid) GROUP BY ALL) GROUP BY ALL),
        tc AS (SELECT conv_id, count(*) AS question_count, count(*) FILTER (child_no = 0) AS main_question_count, count(*) FILTER (node_type = 'follow_up') AS follow_up_count, count(*) FILTER (node_type = 'clarification') AS clarification_count,
            count(*) FILTER (child_no = 0 AND relation = 'topic_switch') AS topic_switch_count FROM tree GROUP BY ALL),
        h AS (SELECT conv_id, count(*) AS coding_event_count, count(*) FILTER (event_type = 'coding_silence') AS coding_silence_event_count FROM evs GROUP BY ALL), q1 AS (SELECT conv_id, count(*) AS v1_qa_count FROM v1qa GROUP BY ALL)
        SELECT g.*, coalesce(cleanup_reason_counts, '') AS cleanup_reason_counts, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("question_count", "main_question_count", "follow_up_count", "clarification_count", "topic_switch_count", "coding_event_count", "coding_silence_event_count", "v1_qa_count"))},
        coalesce(main_question_count, 0) AS qa_count FROM g LEFT JOIN rs USING (conv_id) LEFT JOIN tc USING (conv_id) LEFT JOIN h USING (conv_id) LEFT JOIN q1 USING (conv_id)""",
    "contract_violations": f"""{BASE}, {PHASE}, {EVENT}, n AS (SELECT user_id AS conv_id, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT *, conv_id % 10 AS d FROM n),
        f AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS d, unnest(['$.schema_version', '$.segments[0].role', '$.segments[', '$.statistics', '$.segments[0].role_confidence', '$', '$.phase_spans[0].segment_ids', '$.statistics.raw_segment_count', '$.conversation_structure.method']) AS path,
              unnest(['const', 'enum', 'minimum 0', 'type object', 'maximum 1', 'not JSON', 'uniqueItems', 'type integer', 'required']) AS rule)
        SELECT conv_id, 'conversation' AS contract, CASE WHEN d = 2 THEN path || (n - 1) || '].end' ELSE path END AS path, rule FROM d JOIN f USING (d)
        UNION ALL SELECT conv_id, 'analysis', '$.extra', 'not allowed' FROM d WHERE d = 9
        UNION ALL SELECT conv_id, 'conversation', '$.events[' || (event_no - 1) || '].segment_ids', 'uniqueItems' FROM evs
            WHERE conv_id % 10 <> 5 AND len(list_distinct(string_split(segment_ids, ','))) < len(string_split(segment_ids, ','))""",
    "none_analysis": f"""{BASE}, {ROLES}, {AN}, {ANSWER}, {TREE}, ex AS (SELECT conv_id, prompt_no, unnest(string_split(w, ',')) AS x, unnest(range(len(string_split(w, ',')))) AS k FROM (SELECT conv_id, prompt_no, t.segment_ids || coalesce(',' || a.segment_ids, '') AS w FROM tree t LEFT JOIN ans a USING (conv_id, prompt_no))),
        ey AS (SELECT conv_id, prompt_no, string_agg(x, ',' ORDER BY k) AS evidence FROM (SELECT conv_id, prompt_no, x, min(k) AS k FROM ex GROUP BY ALL) GROUP BY ALL)
        SELECT conv_id, count(*) OVER (PARTITION BY conv_id) AS question_count, CAST(prompt_no AS INT) AS place, node_id AS question_id, '未启用语义分析模型；仅保留可追溯的结构化问答。' AS summary, evidence FROM tree JOIN ey USING (conv_id, prompt_no)""",
}
ORACLES |= {"document_files": ORACLES["question_tree"], "raw_files": ORACLES["raw_segments"]}
