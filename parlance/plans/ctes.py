"""The table adapters of ``parlance.sources.tables`` once more, in plain SQL."""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TURNS = r"""turns AS (
  SELECT conv_id, turn, role, text, list_filter(string_split(text, ' '), lambda w: w <> '') AS items,
         -100 * (1 + turn % 5) AS logprob_milli
  FROM (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations))"""

WORDS = TURNS + r""",
words AS (
  SELECT conv_id, turn, logprob_milli, pos - 1 AS pos, word, 50 + (length(word) * 7) % 50 AS conf_pct
  FROM (SELECT conv_id, turn, logprob_milli, unnest(items) AS word, unnest(range(1, len(items) + 1)) AS pos FROM turns))"""

TIMED_WORDS = WORDS + r""",
timed AS (
  SELECT *, end_ms - (40 + 60 * length(word)) AS start_ms FROM (
    SELECT *, CAST(sum(40 + 60 * length(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS BIGINT) AS end_ms
    FROM words))"""

SESSION_WORDS = WORDS + r""",
timed AS (
  SELECT *, end_ms - (40 + 60 * length(word)) AS start_ms FROM (
    SELECT *, CAST(400 * turn_no + sum(40 + 60 * length(word)) OVER (PARTITION BY conv_id ORDER BY turn, pos) AS BIGINT) AS end_ms
    FROM words JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no FROM turns)
      USING (conv_id, turn)))"""

FRAMES = r"""frames AS (
  SELECT user_id AS session, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS f, max(value) AS value
  FROM events GROUP BY 1, 2)"""

SAMPLES = r"""samples AS (
  SELECT user_id AS clip, event_id AS idx, CAST(floor(value * 100) AS BIGINT) % 32768 AS sample FROM events)"""

PACKETS = r"""packets AS (
  SELECT user_id AS session, event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS at_s, event_type
  FROM events)"""

LINES = r"""lines AS (
  SELECT doc_id, lang, unnest(parts) AS line, unnest(range(len(parts))) AS line_no
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))"""

PATHS = r"""paths AS (
  SELECT label::BIGINT AS seg_id, vec_id AS time_idx, (list_position(l, list_max(l)) - 1)::BIGINT AS token_idx,
         list_transform(l, lambda x: x::DOUBLE) AS logits
  FROM (SELECT vec_id, label, embedding[1:4] AS l FROM embeddings))"""

# Speech segments: gaps of up to two frames bridged, at least two frames long.
SEGMENTS = FRAMES + r""",
segments AS (
  SELECT session, start_f, end_f FROM (
    SELECT session, min(f) AS start_f, max(f) + 1 AS end_f FROM (
      SELECT session, f, sum(brk) OVER (PARTITION BY session ORDER BY f) AS run FROM (
        SELECT session, f,
               CASE WHEN f - lag(f) OVER (PARTITION BY session ORDER BY f) - 1 <= 12 THEN 0 ELSE 1 END AS brk
        FROM frames WHERE value >= 50))
    GROUP BY session, run)
  WHERE end_f - start_f >= 2)"""

SPEECH_MAP = SEGMENTS + r""",
smap AS (
  SELECT *, start_f - obeg AS ioffset, obeg + end_f - start_f AS oend FROM (
    SELECT session, start_f, end_f,
           CAST(coalesce(sum(end_f - start_f) OVER (PARTITION BY session ORDER BY start_f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS obeg,
           row_number() OVER (PARTITION BY session ORDER BY start_f) - 1 AS seg_idx
    FROM segments))"""

TOKENS = TIMED_WORDS + r""",
cores AS (SELECT *, regexp_replace(word, '[.,!?]+$', '') AS core FROM timed),
marks AS (SELECT *, substr(word, length(core) + 1) AS mark FROM cores),
pieces AS (
  SELECT *, list_filter([
    ' ' || CASE WHEN length(core) > 6 THEN substr(core, 1, 4) ELSE core END,
    CASE WHEN length(core) > 6 THEN '-' || substr(core, 5) END,
    CASE WHEN mark = '' THEN NULL WHEN turn % 3 = 0 THEN mark || mark WHEN turn % 3 = 1 THEN ' ' || mark || mark ELSE mark END,
    CASE WHEN pos % 11 = 5 THEN ' ''x' END,
    CASE WHEN pos % 13 = 6 THEN ' #' END,
    CASE WHEN pos % 13 = 6 THEN ' -b' END], lambda x: x IS NOT NULL) AS ps FROM marks),
tokens AS (
  SELECT conv_id AS session, turn AS seg_idx, pos * 8 + i AS pos, token, start_ms + 10 * i AS start_ms, end_ms, conf_pct - i AS conf_pct
  FROM (SELECT *, unnest(ps) AS token, unnest(range(len(ps))) AS i FROM pieces))"""

# The glue rule followed token by token.
GLUED = TOKENS.replace("turns AS", "RECURSIVE turns AS", 1) + r""",
seq AS (SELECT *, row_number() OVER (PARTITION BY session, seg_idx ORDER BY pos) AS n,
               regexp_matches(token, '[\p{L}\p{N}]') AS alnum,
               length(ltrim(token)) > 1 AND contains('''-&@.,', substr(ltrim(token), 1, 1)) AS cand,
               ltrim(token) = token AS tight FROM tokens),
walk AS (
  SELECT session, seg_idx, n, 0 AS word_idx, token AS acc FROM seq WHERE n = 1
  UNION ALL
  SELECT s.session, s.seg_idx, s.n,
         CASE WHEN s.cand AND (s.tight OR NOT s.alnum OR NOT regexp_matches(w.acc, '[\p{L}\p{N}]')) THEN word_idx ELSE word_idx + 1 END,
         CASE WHEN s.cand AND (s.tight OR NOT s.alnum OR NOT regexp_matches(w.acc, '[\p{L}\p{N}]')) THEN acc || s.token ELSE s.token END
  FROM walk w JOIN seq s ON s.session = w.session AND s.seg_idx = w.seg_idx AND s.n = w.n + 1),
glued AS (
  SELECT session, seg_idx, word_idx, ltrim(string_agg(token, '' ORDER BY n)) AS word, min(start_ms) AS start_ms, max(end_ms) AS end_ms,
         sum(conf_pct)::BIGINT AS conf_sum, count(*) AS n_tokens,
         round_even(sum(conf_pct) / (100 * count(*)) * 100, 0) / 100 AS conf
  FROM walk JOIN seq USING (session, seg_idx, n) GROUP BY 1, 2, 3)"""

LABELLED = LINES + r""",
lw AS (SELECT doc_id, line_no, lang, unnest(ws) AS w, unnest(range(len(ws))) AS n FROM (
  SELECT *, list_filter(string_split(trim(regexp_replace(line, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS ws FROM lines)),
shaped AS (SELECT *, CASE WHEN core = lower(core) THEN 0 WHEN core = upper(core) AND length(core) > 1 THEN 1
    WHEN core = upper(substr(core, 1, 1)) || lower(substr(core, 2)) THEN 2 ELSE 3 END AS shape,
  CASE right(w, 1) WHEN ',' THEN 1 WHEN '.' THEN 2 WHEN '?' THEN 3 WHEN '!' THEN 4 ELSE 0 END AS label
  FROM (SELECT *, regexp_replace(w, '[,.!?]$', '') AS core FROM lw) WHERE core <> ''),
pieced AS (SELECT *, CASE WHEN lang = 'fr' THEN CASE WHEN length(base) > 8 THEN [substr(base, 1, 6), substr(base, 7) || '</w>'] ELSE [base || '</w>'] END
    ELSE CASE WHEN length(base) > 8 THEN [substr(base, 1, 6), '##' || substr(base, 7)] ELSE [base] END END AS pieces
  FROM (SELECT *, CASE WHEN shape = 3 THEN core ELSE lower(core) END AS base FROM shaped)),
labelled AS (SELECT doc_id, line_no, lang, n * 2 + i AS pos, token,
    CASE WHEN i = len(pieces) - 1 THEN label ELSE 0 END AS punc_label,
    CASE WHEN i = 0 OR shape IN (1, 3) THEN shape ELSE 0 END AS case_label
  FROM (SELECT *, unnest(pieces) AS token, unnest(range(len(pieces))) AS i FROM pieced))"""

SCORED = PATHS + r""",
scored AS (SELECT seg_id, time_idx, token_idx, exp(logits[token_idx + 1]) / (exp(logits[1]) + exp(logits[2]) + exp(logits[3]) + exp(logits[4])) AS score FROM paths)"""

CHAR_SEGMENTS = SCORED + r""",
csegs AS (
  SELECT seg_id, run, token_idx, min(time_idx) AS start, max(time_idx) + 1 AS "end", sum(score) / count(*) AS score FROM (
    SELECT *, sum(brk) OVER (PARTITION BY seg_id ORDER BY time_idx) AS run FROM (
      SELECT *, CASE WHEN token_idx = lag(token_idx) OVER (PARTITION BY seg_id ORDER BY time_idx) THEN 0 ELSE 1 END AS brk FROM scored))
  GROUP BY 1, 2, 3)"""

CHAR_WORDS = CHAR_SEGMENTS + r""",
clabels AS (SELECT * FROM (
  SELECT *, sum(CASE WHEN token_idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY start) AS g FROM csegs) WHERE token_idx <> 0),
cwords AS (
  SELECT seg_id, g, min(start) AS start, max("end") AS "end", sum(score * ("end" - start)) / sum("end" - start) AS score
  FROM clabels GROUP BY 1, 2),
cparts AS (
  SELECT seg_id, g, string_agg(['', 'a', 'b', 'c'][token_idx + 1], '' ORDER BY start) AS word
  FROM clabels GROUP BY 1, 2)"""

HYPS = TURNS + r""",
ws AS (SELECT conv_id || ':' || turn AS session, list_transform(items, lambda w, i: {
    'start': (600 * (i - 1) + 3000 * ((i - 1) // 16)) / 1000, 'end': (600 * (i - 1) + 3000 * ((i - 1) // 16) + 500) / 1000,
    'word': CASE WHEN (i - 1) % 16 = 15 THEN w || '.' ELSE w END}) AS ws FROM turns WHERE len(items) > 0),
steps AS (SELECT session, ws, unnest(range(1, CAST(ceil(len(ws) / 4) AS BIGINT) + 1)) AS iter FROM ws),
hyps AS (SELECT session, iter, ws, least(4 * iter, len(ws)) AS heard, greatest(4 * iter - 12, 0) AS lo,
    list_transform(ws[greatest(4 * iter - 12, 0) + 1 : least(4 * iter, len(ws))], lambda w, j: CASE
      WHEN greatest(4 * iter - 12, 0) + j = 4 * iter AND 4 * iter < len(ws) THEN {'start': w.start, 'end': w.end, 'word': w.word || '#'} ELSE w END) AS words,
    ws[least(4 * iter, len(ws))].end + CASE WHEN iter % 3 = 0 THEN 0.02::DOUBLE ELSE 0.1::DOUBLE END AS buffer_end
  FROM steps)"""


def agreement(pause: float, trimming: float, edge: float, marks: str, max_words: int = -1, final_min_words: int | None = None, partials_per_second: float = 0) -> str:
    """The live agreement followed hypothesis by hypothesis: ``agree`` has one row an emission.

    ``marks`` are the characters that a comparison of words leaves out and that end a final.
    """
    marks = marks.replace("'", "''")
    same = f"translate(lower(new[i].word), '{marks}', '') = translate(lower(waiting[i].word), '{marks}', '')"
    crowded = f"len(waiting) - i + 1 > {max_words}" if max_words > -1 else "false"
    complete = f"len(finals) > {final_min_words}" if final_min_words is not None else f"contains('{marks}', right(finals[-1].word, 1)) AND finals[-1].word <> ''"
    due = f"sent IS NULL OR buffer_end - sent > {1 / (partials_per_second + 1)!r}::DOUBLE" if partials_per_second else "true"
    joined = "coalesce(array_to_string(list_transform({0}, lambda w: w.word), ' '), '')".format
    none = "[]::STRUCT(\"start\" DOUBLE, \"end\" DOUBLE, word VARCHAR)[]"
    return HYPS.replace("turns AS", "RECURSIVE turns AS", 1) + rf""",
heard AS (
  SELECT *, list_transform(list_filter(range(len(words)), lambda j: (lo + j + 1) % 8 = 0 OR lo + j + 1 = heard), lambda j: words[j + 1].end) AS ends
  FROM (SELECT session, iter, lo, heard, words, buffer_end, false AS eof FROM hyps
        UNION ALL SELECT session, iter + 1, lo, heard, words, ws[-1].end + 0.5::DOUBLE, true FROM hyps WHERE 4 * iter >= len(ws))),
walk AS (
  SELECT session, 0::BIGINT AS iter, 0::DOUBLE AS last, 0::DOUBLE AS cut_at, {none} AS committed, {none} AS waiting, {none} AS finals,
         NULL::DOUBLE AS sent, NULL::VARCHAR AS kind, {none} AS shown, {none} AS rest
  FROM (SELECT DISTINCT session FROM heard)
  UNION ALL
  SELECT session, iter, last, cut_at, committed, waiting, CASE WHEN ready THEN {none} ELSE finals END,
         CASE WHEN ready THEN NULL WHEN sends THEN buffer_end ELSE sent END,
         CASE WHEN eof OR ready THEN 'final' WHEN sends THEN 'partial' END,
         CASE WHEN ready THEN finals ELSE finals || waiting END, CASE WHEN ready AND eof THEN waiting ELSE {none} END
  FROM (SELECT *, NOT ready AND len(finals) + len(waiting) > 0 AND ({due}) AS sends
  FROM (SELECT * REPLACE (coalesce(cut, cut_at) AS cut_at, CASE WHEN cut IS NULL THEN committed ELSE list_filter(committed, lambda w: w.end > cut) END AS committed),
           coalesce(len(finals) > 0 AND {complete} AND finals[-1].end <> 0
             AND finals[-1].end + {pause}::DOUBLE < CASE WHEN len(waiting) = 0 THEN buffer_end WHEN len(waiting) <= 3 THEN waiting[1].end END, false) AS ready
  FROM (SELECT * REPLACE (CASE WHEN len(waiting) > 0 AND buffer_end - waiting[-1].end < {edge}::DOUBLE THEN waiting[1 : len(waiting) - 1] ELSE waiting END AS waiting),
           CASE WHEN buffer_end - cut_at > {trimming}::DOUBLE AND len(ends) > 1 AND len(committed) > 0
             THEN list_max(list_filter(ends[1 : len(ends) - 1], lambda e: e <= last)) END AS cut
  FROM (SELECT * REPLACE (CASE WHEN n > 0 THEN new[n].end ELSE last END AS last, committed || new[1 : n] AS committed, finals || new[1 : n] AS finals, new[n + 1 : len(new)] AS waiting)
  FROM (SELECT *, coalesce(list_filter(range(1, least(len(new), len(waiting)) + 1), lambda i: NOT ({same} OR {crowded}))[1] - 1, least(len(new), len(waiting))) AS n
  FROM (SELECT * REPLACE (new[said + 1 : len(new)] AS new)
  FROM (SELECT *, CASE WHEN len(new) > 0 AND abs(new[1].start - last) < 1 THEN coalesce(list_filter(range(1, 6), lambda i: i <= least(len(committed), len(new)) AND
             list_transform(committed[len(committed) - i + 1 : len(committed)], lambda w: w.word) = list_transform(new[1 : i], lambda w: w.word))[1], 0) ELSE 0 END AS said
  FROM (SELECT h.*, last, cut_at, committed, waiting, finals, sent, list_filter(h.words, lambda w: w.start > last - 0.1::DOUBLE) AS new
        FROM walk k JOIN heard h ON h.session = k.session AND h.iter = k.iter + 1))))))))),
agree AS (
  SELECT session, iter, kind, list_min([shown[1].start, rest[1].start]) AS "start", list_max([shown[-1].end, rest[-1].end]) AS "end",
         {joined("shown")} || {joined("rest")} AS text
  FROM walk WHERE kind IS NOT NULL)"""
