"""The queries of ``trace_queries`` in SQL, over the projection of ``projection.STEPS_SQL``."""

from __future__ import annotations

from failscope.functions import taxonomy
from failscope.operators import judge
from failscope.plans.projection import STEPS_SQL
from failscope.plans.trace_queries import TEXTS

_TAIL = "i >= greatest(1, n - greatest(3, CAST(floor(n * 0.25) AS INTEGER)) + 1)"
_TOOL_ERROR = "observed AND regexp_matches(content, '(?i)not found|timed? ?out')"
_REFUSAL = f"{_TAIL} AND NOT observed AND regexp_matches(content, '(?i)unable to complete')"
_INCOMPLETE = f"{_TAIL} AND NOT observed AND regexp_matches(content, '(?i)unfortunately')"
_LEAKED = f"{_TAIL} AND regexp_matches(content, 'ValueError:|HTTP 503')"


def _event(kind: str, severity: str, where: str, source: str = "steps", told: str | None = None) -> str:
    """Events of one kind; ``told`` is the expression of their evidence."""
    evidence = "" if told is None else f", {told} AS evidence"
    return f"SELECT tid, i AS step_index, '{kind}' AS kind, round(CAST({severity} AS DOUBLE), 6) AS severity{evidence} FROM {source} WHERE {where}"


def _call(modulus: int, kind: str = "event_type") -> str:
    return f"{kind} || '({{\"k\": ' || k % {modulus} || '}})'"


def _tool_error(source: str = "steps") -> str:
    return _event("tool_error", "0.6", _TOOL_ERROR, source, "'tool error returned an error: ' || content")


def _refusal(source: str = "steps") -> str:
    return _event("refusal", "0.7", _REFUSAL, source, "'agent declines or gives up: …' || content || '…'")


def _incomplete(source: str = "steps") -> str:
    return _event("incomplete_outcome", "0.5", _INCOMPLETE, source, "'reports the task is incomplete: …' || content || '…'")


def _leaked(source: str = "steps") -> str:
    return _event("leaked_error", "0.6", _LEAKED, source, "'raw error surfaced in output: …' || content || '…'")


def _truncated(source: str = "steps") -> str:
    return _event("truncated_run", "0.45", "i = n AND acts", source, "'trajectory ends on tool activity with no closing response to the user'")


def _ceiling(steps: int, source: str = "steps") -> str:
    return _event("budget_anomaly", "0.25", f"i = n AND n >= {steps}", source, f"n || ' steps exceeds the default ceiling of {steps}'")


def _repeated(modulus: int, source: str = "steps") -> str:
    inner = f"SELECT *, count(*) OVER (PARTITION BY tid, event_type, k % {modulus}) AS c, min(i) OVER (PARTITION BY tid, event_type, k % {modulus}) AS f FROM {source} WHERE called"
    return _event("repeated_call", "least(0.3::DOUBLE + 0.15::DOUBLE * (c - 1), 0.85::DOUBLE)", "c >= 2 AND i > f", f"({inner})", f"'repeats the identical call ' || {_call(modulus)} || ' first made at step ' || f || ' (' || c || 'x total)'")


def _stall(window: int, source: str = "steps") -> str:
    cut = f"SELECT *, sum(CASE WHEN role = 'assistant' AND NOT acts AND trim(content) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY i) AS seg FROM {source}"
    runs = f"SELECT tid, min(i) AS i, count(*) AS c FROM ({cut}) WHERE acts GROUP BY tid, seg"
    return _event("stall", f"least(0.2::DOUBLE + 0.03::DOUBLE * (c - {window}), 0.45::DOUBLE)", f"c >= {window}", f"({runs})", "c || ' consecutive tool interactions from step ' || i || ' without responding to the user'")


def _no_progress(window: int, source: str = "steps") -> str:
    breaks = "(acts OR (role IN ('user', 'assistant') AND NOT thought))"
    cut = f"SELECT *, {breaks} AS b, sum(CASE WHEN {breaks} THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY i) AS isl FROM {source}"
    runs = f"SELECT tid, min(i) AS i, count(*) AS c FROM ({cut}) WHERE NOT b GROUP BY tid, isl"
    return _event("no_progress", f"least(0.2::DOUBLE + 0.05::DOUBLE * (c - {window}), 0.5::DOUBLE)", f"c >= {window}", f"({runs})", "c || ' consecutive steps of deliberation without acting, starting at step ' || i")


def _oscillation(modulus: int, source: str = "steps") -> str:
    """Common table expressions ``turns``, ``cand`` and ``taken``, and the events of them."""
    return f"""
, turns AS (SELECT tid, i, {_call(modulus)} AS c, row_number() OVER t AS turn, lead({_call(modulus)}, 1) OVER t AS c1, lead({_call(modulus)}, 2) OVER t AS c2, lead({_call(modulus)}, 3) OVER t AS c3, lead(i, 3) OVER t AS i3
    FROM {source} WHERE called WINDOW t AS (PARTITION BY tid ORDER BY i)),
cand AS (SELECT * FROM turns WHERE c = c2 AND c1 = c3 AND c <> c1),
taken AS (SELECT tid, min(turn) AS turn FROM cand GROUP BY tid
    UNION ALL SELECT t.tid, (SELECT min(c.turn) FROM cand c WHERE c.tid = t.tid AND c.turn >= t.turn + 4) AS turn FROM taken t WHERE EXISTS (SELECT 1 FROM cand c WHERE c.tid = t.tid AND c.turn >= t.turn + 4)),
swings AS (SELECT c.tid, c.i AS step_index, 'oscillation' AS kind, 0.65::DOUBLE AS severity, 'alternates between ' || c.c || ' and ' || c.c1 || ' across steps ' || c.i || '-' || c.i3 || ' without resolving' AS evidence
    FROM cand c JOIN taken t ON c.tid = t.tid AND c.turn = t.turn)
"""


_RECURSIVE = STEPS_SQL.replace("WITH base", "WITH RECURSIVE base")
#: The seven kinds of ``trace_queries.BATTERY``, their order of emission, and the events table.
EVENTS_SQL = (
    STEPS_SQL
    + ", ev AS ("
    + " UNION ALL ".join(
        f"SELECT *, {o} AS so FROM ({sql})"
        for o, sql in enumerate([_tool_error(), _repeated(10), _refusal(), _incomplete(), _leaked(), _truncated(), _stall(5)])
    )
    + ")"
)
_WEIGHT = "CASE kind WHEN 'stall' THEN 0.4 WHEN 'repeated_call' THEN 0.5 WHEN 'truncated_run' THEN 0.6 ELSE 1 END"
_CONFIDENCE = EVENTS_SQL + f"""
, strongest AS (SELECT tid, kind, max(severity * CAST({_WEIGHT} AS DOUBLE)) AS w FROM ev GROUP BY tid, kind),
conf AS (SELECT tid, 1 - product(1 - least(w, 1)) AS confidence FROM strongest GROUP BY tid)"""
_LABELS = """
, labels AS (SELECT tid, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) > (SELECT avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) FROM steps) AS label FROM steps GROUP BY tid),
sizes AS (SELECT CAST(count(*) FILTER (label) AS DOUBLE) AS np, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS nn FROM labels),
fired AS (SELECT DISTINCT e.tid, e.kind, l.label FROM ev e JOIN labels l ON e.tid = l.tid),
ratios AS (
    SELECT kind, ln(((count(*) FILTER (label) + 1) / (any_value(np) + 2)) / ((count(*) FILTER (NOT label) + 1) / (any_value(nn) + 2))) AS log_ratio
    FROM fired, sizes GROUP BY kind)"""
_FIT = EVENTS_SQL + _LABELS
_MASS = EVENTS_SQL + """
, mass AS (SELECT s.tid, s.i, s.n, s.thought, coalesce(m.own, 0) AS own FROM steps s LEFT JOIN (SELECT tid, step_index, sum(severity) AS own FROM ev GROUP BY tid, step_index) m ON s.tid = m.tid AND s.i = m.step_index),
spilled AS (SELECT a.tid, a.i, a.n, a.thought, sum(b.own * pow(0.5, abs(a.i - b.i))) AS t FROM mass a JOIN mass b ON a.tid = b.tid AND abs(a.i - b.i) <= 8 GROUP BY a.tid, a.i, a.n, a.thought),
scored AS (
    SELECT tid, i, n, round(CASE WHEN t > 0 AND n > 1 THEN t * w * (1 + 0.15::DOUBLE * (1 - (i - 1) / (n - 1)::DOUBLE)) ELSE t * w END, 9) AS score
    FROM (SELECT *, CASE WHEN thought THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS w FROM spilled)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY tid ORDER BY score DESC, i) AS INTEGER) AS rank, sum(score) OVER (PARTITION BY tid) AS s FROM scored),
prior AS (SELECT tid, CASE WHEN score > 0 THEN i ELSE n END AS step, CASE WHEN score > 0 THEN score / s ELSE 0 END AS confidence FROM ranked WHERE rank = 1)"""
_TRUTH = """
, named AS (SELECT *, CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 8 ELSE 9 END AS cas, row_number() OVER (PARTITION BY tid ORDER BY value DESC, i) = 1 AS root FROM steps),
truth AS (
    SELECT tid, max(CASE WHEN root THEN i END) AS critical_step, max(CASE WHEN root THEN cas END) AS root_cause_case, min_by(cas, i) AS earliest_case, max_by(cas, i) AS terminal_case,
           list_sort(list_distinct(list(cas))) AS all_cases
    FROM named WHERE root OR k % 7 = 0 GROUP BY tid)"""
#: Evidence windows, grown in the order of the scores (five at most, eight steps back and two on), and their texts.
_GROWN = """
, cand AS (SELECT tid, n, i AS peak, score, row_number() OVER (PARTITION BY tid ORDER BY score DESC, i) AS r FROM scored WHERE score > 0),
grow AS (
    SELECT tid, n, 0::BIGINT AS r, CAST([] AS STRUCT(s INTEGER, e INTEGER, peak INTEGER, score DOUBLE)[]) AS taken FROM (SELECT DISTINCT tid, n FROM cand)
    UNION ALL
    SELECT g.tid, g.n, c.r, CASE WHEN len(taken) >= 5 OR len(list_filter(taken, lambda w: c.peak BETWEEN w.s AND w.e)) > 0 THEN taken ELSE list_append(taken, struct_pack(
        s := greatest(1, c.peak - 8, coalesce(list_max(list_transform(list_filter(taken, lambda w: w.e < c.peak), lambda w: w.e)) + 1, 1)),
        e := least(g.n, c.peak + 2, coalesce(list_min(list_transform(list_filter(taken, lambda w: w.s > c.peak), lambda w: w.s)) - 1, g.n)), peak := c.peak, score := c.score)) END
    FROM grow g JOIN cand c ON c.tid = g.tid AND c.r = g.r + 1),
grown AS (SELECT tid, max_by(taken, r) AS taken FROM grow GROUP BY tid),
spans AS (
    SELECT tid, unnest(taken, recursive := true) FROM grown
    UNION ALL SELECT tid, greatest(1, n - 10) AS s, n AS e, n AS peak, 0.0 AS score FROM (SELECT DISTINCT tid, n FROM steps) t WHERE tid NOT IN (SELECT tid FROM grown)),
wins AS (SELECT *, CAST(row_number() OVER (PARTITION BY tid ORDER BY s) AS INTEGER) AS window_no FROM spans)"""
_WINDOWS = _MASS.replace("WITH base", "WITH RECURSIVE base") + _GROWN
_SUMMARY = "'[' || i || '] ' || coalesce(agent, role) || ': ' || CASE WHEN called THEN '-> ' || event_type || '({\"amount\":' || CAST(value AS VARCHAR) || ',\"k\":' || k % 10 || '})' WHEN observed THEN '<- ' || content ELSE content END"
_EXCERPT = _WINDOWS + f"""
, lines AS (SELECT tid, i, n, {_SUMMARY} AS line FROM steps),
bodies AS (SELECT w.tid, w.window_no, string_agg(line, chr(10) ORDER BY l.i) AS body, any_value(l.n) AS n FROM wins w JOIN lines l ON l.tid = w.tid AND l.i BETWEEN w.s AND w.e GROUP BY w.tid, w.window_no),
findings AS (SELECT w.tid, w.window_no, string_agg('  ! step ' || step_index || ' [' || kind || '] ' || evidence, chr(10) ORDER BY step_index, kind, so) AS found FROM wins w JOIN ev ON ev.tid = w.tid AND step_index BETWEEN w.s AND w.e WHERE w.score > 0 GROUP BY w.tid, w.window_no),
gaps AS (SELECT *, s - coalesce(lag(e) OVER t, 0) - 1 AS skipped, lead(s) OVER t IS NULL AS closing FROM wins WINDOW t AS (PARTITION BY tid ORDER BY window_no)),
parts AS (
    SELECT g.tid, g.window_no, CASE WHEN skipped > 0 THEN '… ' || skipped || ' step(s) omitted …' || chr(10) ELSE '' END || '--- steps ' || g.s || '-' || g.e || ' (suspicion ' || printf('%.2f', score) || ') ---' || chr(10) || body
        || coalesce(chr(10) || 'signals:' || chr(10) || found, '') || CASE WHEN closing AND n > g.e THEN chr(10) || '… ' || (n - g.e) || ' step(s) omitted …' ELSE '' END AS part
    FROM gaps g JOIN bodies b ON b.tid = g.tid AND b.window_no = g.window_no LEFT JOIN findings f ON f.tid = g.tid AND f.window_no = g.window_no),
excerpt AS (SELECT tid, string_agg(part, chr(10) ORDER BY window_no) AS text FROM parts GROUP BY tid)"""
_PAIRED = _MASS + _TRUTH + """
, paired AS (SELECT t.*, p.step, abs(p.step - t.critical_step) AS d, CASE WHEN p.step % 2 = 0 THEN 9 ELSE 3 END AS cas FROM prior p JOIN truth t ON p.tid = t.tid)"""


def _share(condition: str, name: str) -> str:
    return f"round(count(*) FILTER ({condition}) / CAST(count(*) AS DOUBLE), 6) AS {name}"


_RATES = """
SELECT round(recall, 6) AS recall, round(fpr, 6) AS false_positive_rate, round(prec, 6) AS precision, round(CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0 END, 6) AS f1,
       tp + fn AS n_positive, fp + tn AS n_negative{more}
FROM (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN fp + tn > 0 THEN fp / (fp + tn)::DOUBLE ELSE 0 END AS fpr, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS prec FROM counted)
"""
_ROWS = """
WITH base AS (SELECT CAST(n_nationkey AS INTEGER) AS n FROM nation),
rows_{name} AS (
    SELECT 'd' || (n % 2) AS domain, 's' || CAST(floor(n / 10) AS INTEGER) AS system, CAST(floor((n % 10) / 2) AS INTEGER) AS repeat, CAST(n % 10 + 20 AS BIGINT) AS nn, CASE WHEN n + {shift} = 13 THEN 2 ELSE 0 END AS err,
           ((n + {shift}) * 7 % 11) / 11::DOUBLE AS exact, CASE WHEN n % 5 <> 0 THEN (n * 3 % 7) / 7::DOUBLE END AS pm5, (n % 3) / 3::DOUBLE AS root_cause_cat FROM base)"""
_ROWS_A = _ROWS.format(name="a", shift=0)
_ROWS_AB = _ROWS_A + _ROWS.format(name="b", shift=3).replace("\nWITH base AS (SELECT CAST(n_nationkey AS INTEGER) AS n FROM nation),", ",")


def _text_list() -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEXTS) + "]"


_TEXT = f"WITH t AS (SELECT event_id, {_text_list()}[CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(TEXTS)} + 1] AS text FROM events), l AS (SELECT *, lower(trim(text)) AS c FROM t)"
_NORMAL = """
CASE WHEN text = '' THEN 'Unknown' WHEN contains(c, 'instruction') AND contains(c, 'adherence') THEN 'Instruction Adherence Failure'
     WHEN contains(c, 'invention') OR (contains(c, 'new') AND contains(c, 'information')) THEN 'Invention of New Information'
     WHEN contains(c, 'invalid') AND contains(c, 'invocation') THEN 'Invalid Invocation'
     WHEN contains(c, 'misinterpretation') OR contains(c, 'handoff') THEN 'Misinterpretation of Tool Output'
     WHEN contains(c, 'intent') AND (contains(c, 'plan') OR contains(c, 'misalignment')) THEN 'Intent Plan Misalignment'
     WHEN contains(c, 'underspecified') OR (contains(c, 'user') AND contains(c, 'intent') AND NOT contains(c, 'not')) THEN 'Underspecified User Intent'
     WHEN contains(c, 'not supported') THEN 'Intent Not Supported' WHEN contains(c, 'guardrail') THEN 'Guardrails Triggered'
     WHEN contains(c, 'system') AND contains(c, 'failure') THEN 'System Failure' WHEN contains(c, 'inconclusive') THEN 'Inconclusive' ELSE trim(text) END"""
_CASES = {
    "Instruction Adherence Failure": 1, "Invention of New Information": 2, "Invalid Invocation": 3, "Misinterpretation of Tool Output": 4, "Intent Plan Misalignment": 5,
    "Underspecified User Intent": 6, "Intent Not Supported": 7, "Guardrails Triggered": 8, "System Failure": 9, "Inconclusive": 10,
}
_NUMBER = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CASES.items()) + " WHEN '4' THEN 4 ELSE 10 END"
_NAME = "CASE n " + " ".join(f"WHEN {v} THEN '{k}'" for k, v in _CASES.items()) + " END"
_LINE = "'[' || (turn + 1) || '] ' || role || ': ' || CASE WHEN length(b) <= {w} THEN b ELSE substr(b, 1, {w} - 1) || '…' END"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: What is hashed for the query's two sets of tool schemas.
_FINGERPRINT_A = '{"policy":"be kind","schemas":[{"function":{"name":"click","parameters":{"properties":{"k":{}},"required":["k","order_id"]}}}]}'
_FINGERPRINT_B = '{"policy":"be kind","schemas":[{"name":"purchase"}]}'


ORACLES = {
    "steps_number": STEPS_SQL + "SELECT tid, i AS step_index, n AS n_steps, role FROM steps",
    "steps_contiguity_check": "SELECT conv_id AS tid, CAST(count(*) AS INTEGER) AS n_steps, min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*) AS contiguous FROM conversations GROUP BY conv_id",
    "steps_render": f"SELECT conv_id AS tid, string_agg({_LINE.format(w=160)}, chr(10) ORDER BY turn) AS text FROM (SELECT *, {_FLAT} AS b FROM conversations) GROUP BY conv_id",
    "step_summary": f"SELECT conv_id AS tid, CAST(turn + 1 AS INTEGER) AS step_index, {_LINE.format(w=60)} AS line FROM (SELECT *, {_FLAT} AS b FROM conversations)",
    "step_at_first": "SELECT conv_id AS tid, 1 AS step_index, role FROM conversations WHERE turn = 0",
    "calls_explode": STEPS_SQL + "SELECT tid, i AS step_index, 0 AS call_pos, event_type AS name, '{\"k\": ' || k || '}' AS args_key FROM steps WHERE called",
    "role_filter": "SELECT conv_id AS tid, CAST(turn + 1 AS INTEGER) AS step_index, role FROM conversations WHERE role NOT IN ('system', 'user')",
    "sig_tool_error": STEPS_SQL + _tool_error(),
    "sig_malformed_arguments": STEPS_SQL + _event("malformed_arguments", "0.8", "called AND k % 10 = 0", told="'arguments to ' || event_type || ' are not valid JSON: bad'"),
    "sig_unknown_tool": STEPS_SQL + _event("unknown_tool", "0.9", "event_type = 'purchase'", told="'called undeclared tool ''purchase'''"),
    "sig_argument_schema": STEPS_SQL + _event("argument_schema_violation", "0.75", "event_type = 'click'", told="'click missing required argument(s): order_id'") + " UNION ALL " + _event("argument_schema_violation", "0.4", "event_type = 'click'", told="'click passed undeclared argument(s): amount'"),
    "sig_repeated_call": STEPS_SQL + _repeated(10),
    "sig_oscillation": _RECURSIVE + _oscillation(2) + "SELECT * FROM swings",
    "sig_no_progress": STEPS_SQL + _no_progress(3),
    "sig_refusal": STEPS_SQL + _refusal(),
    "sig_incomplete_outcome": STEPS_SQL + _incomplete(),
    "sig_leaked_error": STEPS_SQL + _leaked(),
    "sig_truncated_run": STEPS_SQL + _truncated(),
    "sig_budget_absolute": STEPS_SQL + _ceiling(20),
    "sig_budget_zscore": STEPS_SQL + ", st AS (SELECT avg(c) AS m, stddev_pop(c) AS s FROM (SELECT count(*) AS c FROM steps GROUP BY tid)) SELECT tid, i AS step_index, 'budget_anomaly' AS kind, round(least(0.2::DOUBLE + 0.1::DOUBLE * ((n - m) / s - 2), 0.5::DOUBLE), 6) AS severity, n || ' steps is ' || printf('%.1f', (n - m) / s) || 'σ above the corpus mean of ' || printf('%.0f', round_even(m, 0)) AS evidence FROM steps, st WHERE i = n AND (n - m) / s >= 2",
    "corpus_stats": STEPS_SQL + "SELECT round(avg(c), 6) AS mean_steps, round(stddev_pop(c), 6) AS std_steps FROM (SELECT count(*) AS c FROM steps GROUP BY tid)",
    "sig_stall": STEPS_SQL + _stall(5),
    "sig_stall_user": STEPS_SQL + _stall(10, "user_steps"),
    "events_all_sorted": EVENTS_SQL + "SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY step_index, kind, so) AS INTEGER) AS ord, step_index, kind, severity, evidence FROM ev",
    "battery_counts": _RECURSIVE + _oscillation(100, "user_steps") + "SELECT kind, count(*) AS n, round(sum(severity), 4) AS mass, CAST(sum(length(evidence)) AS BIGINT) AS chars FROM (SELECT * FROM swings UNION ALL " + " UNION ALL ".join([
        _tool_error("user_steps"), _repeated(100, "user_steps"), _no_progress(6, "user_steps"), _refusal("user_steps"), _incomplete("user_steps"), _leaked("user_steps"), _truncated("user_steps"), _ceiling(80, "user_steps"), _stall(10, "user_steps")]) + ") GROUP BY kind",
    "con_require_before": STEPS_SQL + ", calls AS (SELECT *, coalesce(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM steps WHERE called) " + _event("constraint_violation", "0.8", "event_type = 'purchase' AND seen = 0", "calls"),
    "con_numeric_bound": STEPS_SQL + _event("constraint_violation", "0.85", "event_type = 'purchase' AND (value > 150 OR value < 2)"),
    "con_step": STEPS_SQL + _event("constraint_violation", "0.75", "contains(content, 'HTTP 503')"),
    "con_asof_latest": STEPS_SQL + ", latest AS (SELECT c.tid, c.i, any_value(c.value) AS amount, max_by(r.value, r.i) AS total FROM steps c JOIN steps r ON c.tid = r.tid AND r.event_type = 'view' AND r.i < c.i AND r.k % 3 = c.k % 3 WHERE c.event_type = 'purchase' GROUP BY c.tid, c.i) " + _event("constraint_violation", "0.9", "amount > total", "latest"),
    "det_kinds": EVENTS_SQL + "SELECT tid, kind, max(severity) AS severity FROM ev GROUP BY tid, kind",
    "det_confidence": _CONFIDENCE + "SELECT tid, round(confidence, 6) AS confidence FROM conf",
    "det_verdict_threshold": _CONFIDENCE + "SELECT t.tid, round(coalesce(confidence, 0), 6) AS confidence, coalesce(confidence, 0) >= 0.75 AS failed, 0.75::DOUBLE AS threshold FROM (SELECT DISTINCT tid FROM steps) t LEFT JOIN conf ON t.tid = conf.tid",
    "det_explain_topk": EVENTS_SQL + "SELECT tid, rank, step_index, kind, severity FROM (SELECT *, CAST(row_number() OVER (PARTITION BY tid ORDER BY severity DESC, step_index, kind, so) AS INTEGER) AS rank FROM ev) WHERE rank <= 3",
    "cal_fit_log_ratios": _FIT + "SELECT kind, round(log_ratio, 6) AS log_ratio FROM ratios",
    "cal_bias": _FIT + "SELECT round(ln(np / nn), 6) AS bias FROM sizes",
    "cal_top_weights": _FIT + "SELECT kind, round(log_ratio, 6) AS log_ratio FROM ratios ORDER BY abs(log_ratio) DESC, kind LIMIT 3",
    "cal_score": _FIT + ", z AS (SELECT l.tid, 1 / (1 + exp(-(any_value(ln(np / nn)) + coalesce(sum(log_ratio), 0)))) AS c FROM labels l CROSS JOIN sizes LEFT JOIN fired f ON l.tid = f.tid LEFT JOIN ratios r ON f.kind = r.kind GROUP BY l.tid) SELECT tid, round(c, 6) AS confidence, c >= 0.5 AS failed FROM z",
    "cal_cross_val": _FIT + """
, dealt AS (SELECT tid, label, (row_number() OVER (PARTITION BY label ORDER BY tid) - 1) % folds AS fold, folds, np, nn FROM labels, (SELECT *, CAST(greatest(2, least(5, np, nn)) AS INTEGER) AS folds FROM sizes)),
folds AS (SELECT DISTINCT fold FROM dealt),
train AS (SELECT f.fold, CAST(count(*) FILTER (label) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS q FROM folds f JOIN dealt d ON d.fold <> f.fold GROUP BY f.fold),
w AS (SELECT f.fold, x.kind, ln(((count(*) FILTER (d.label) + 1) / (any_value(t.p) + 2)) / ((count(*) FILTER (NOT d.label) + 1) / (any_value(t.q) + 2))) AS log_ratio
    FROM folds f JOIN train t ON t.fold = f.fold JOIN dealt d ON d.fold <> f.fold JOIN fired x ON x.tid = d.tid GROUP BY f.fold, x.kind),
z AS (SELECT d.tid, any_value(d.label) AS label, any_value(d.folds) AS folds, 1 / (1 + exp(-(any_value(ln(t.p / t.q)) + coalesce(sum(w.log_ratio), 0)))) >= 0.5 AS said
    FROM dealt d JOIN train t ON t.fold = d.fold LEFT JOIN fired x ON x.tid = d.tid LEFT JOIN w ON w.fold = d.fold AND w.kind = x.kind GROUP BY d.tid),
counted AS (SELECT any_value(folds) AS folds, count(*) FILTER (label AND said) AS tp, count(*) FILTER (label AND NOT said) AS fn, count(*) FILTER (NOT label AND said) AS fp, count(*) FILTER (NOT label AND NOT said) AS tn FROM z)""" + _RATES.format(more=", folds"),
    "loc_own_mass": _MASS + "SELECT tid, i AS step_index, round(own, 6) AS own_mass FROM mass",
    "loc_step_scores": _MASS + "SELECT tid, i AS step_index, round(score + 2e-9, 6) AS score FROM scored",
    "loc_prior": _MASS + "SELECT tid, step, round(confidence, 6) AS confidence FROM prior",
    "loc_ranked_topk": _MASS + "SELECT tid, rank, i AS step_index, round(score + 2e-9, 6) AS score FROM ranked WHERE rank <= 3",
    "loc_windows": _WINDOWS + "SELECT tid, window_no, s AS start, e AS \"end\", peak, round(score + 2e-9, 6) AS score FROM wins",
    "loc_window_text": _EXCERPT + "SELECT tid, text FROM excerpt",
    "schema_fingerprint": STEPS_SQL + f"SELECT tid, substr(sha256(CASE WHEN k % 2 = 0 THEN {_literal(_FINGERPRINT_A)} ELSE {_literal(_FINGERPRINT_B)} END), 1, 16) AS fingerprint FROM steps WHERE i = 1",
    "det_explain_text": _CONFIDENCE + """
, top AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY severity DESC, step_index, kind, so) AS rank FROM ev),
told AS (SELECT tid, string_agg('  step ' || step_index || ': [' || kind || '] ' || evidence, chr(10) ORDER BY rank) AS lines FROM top WHERE rank <= 5 GROUP BY tid)
SELECT t.tid, coalesce(CASE WHEN confidence >= 0.5 THEN 'FAILED' ELSE 'ok' END || ' (confidence ' || printf('%.2f', confidence) || ')' || chr(10) || lines, 'no signals fired') AS text
FROM (SELECT DISTINCT tid FROM steps) t LEFT JOIN conf c ON t.tid = c.tid LEFT JOIN told s ON t.tid = s.tid""",
    "score_window_recall": _WINDOWS + _TRUTH + """
, hit AS (SELECT t.tid, max(CASE WHEN t.critical_step BETWEEN w.s AND w.e THEN 1.0 ELSE 0.0 END) AS inside FROM truth t JOIN wins w ON w.tid = t.tid GROUP BY t.tid)
SELECT round(avg(inside), 6) AS window_recall, CAST(sum(step * 10) AS BIGINT) AS prompt_tokens, CAST(sum(step) AS BIGINT) AS completion_tokens, 0.5::DOUBLE AS mean_latency_s FROM hit JOIN prior ON hit.tid = prior.tid""",
    "judge_fake_report": _WINDOWS + """
SELECT p.tid, least(99, n) AS critical_step, 'System Failure' AS category, 0.7::DOUBLE AS confidence, CAST(shown AS INTEGER) AS steps_shown, n AS steps_total, 1 AS repairs, false AS degraded
FROM prior p JOIN (SELECT tid, sum(e - s + 1) AS shown FROM wins GROUP BY tid) w ON w.tid = p.tid JOIN (SELECT DISTINCT tid, n FROM steps) t ON t.tid = p.tid""",
    "judge_prompt": _EXCERPT + f"""
, strong AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY severity DESC, step_index, kind, so) AS r, count(*) OVER (PARTITION BY tid) AS m FROM ev),
logs AS (SELECT tid, string_agg('- step ' || step_index || ' [' || kind || ', severity ' || printf('%.2f', severity) || '] ' || evidence, chr(10) ORDER BY step_index, r) || CASE WHEN any_value(m) > 40 THEN chr(10) || '- … ' || (any_value(m) - 40) || ' weaker signal(s) omitted' ELSE '' END AS log FROM strong WHERE r <= 40 GROUP BY tid)
SELECT t.tid, '## Task' || chr(10) || 'Buy what the user asks for.' || chr(10) || chr(10) || '## Domain policy (excerpt)' || chr(10) || 'Never guess.' || chr(10) || chr(10)
    || coalesce('## Violation log' || chr(10) || {_literal(judge.CAVEAT)} || chr(10) || log || chr(10) || chr(10), '')
    || '## Evidence (excerpt)' || chr(10) || 'These are the most suspicious spans of a ' || n || '-step trajectory. Step numbers are absolute; omitted spans are marked.' || chr(10) || chr(10) || text || chr(10) || chr(10)
    || {_literal("## Failure taxonomy" + chr(10) + taxonomy.checklist() + chr(10) + chr(10) + judge.ANSWER)} AS prompt, CAST(shown AS INTEGER) AS steps_shown, n AS steps_total
FROM (SELECT DISTINCT tid, n FROM steps) t JOIN excerpt x ON x.tid = t.tid LEFT JOIN logs l ON l.tid = t.tid JOIN (SELECT tid, sum(e - s + 1) AS shown FROM wins GROUP BY tid) w ON w.tid = t.tid""",
    "loc_window_events": EVENTS_SQL + "SELECT e.tid, 3 AS start, least(7, s.n) AS \"end\", step_index, kind, severity FROM ev e JOIN (SELECT DISTINCT tid, n FROM steps WHERE n >= 3) s ON e.tid = s.tid WHERE step_index BETWEEN 3 AND least(7, s.n)",
    "tax_normalize": _TEXT + f"SELECT event_id, {_NORMAL} AS category FROM l",
    "tax_case_number": _TEXT + f", m AS (SELECT event_id, {_NORMAL} AS c FROM l), q AS (SELECT event_id, CASE WHEN c = 'FailureCase.SYSTEM_FAILURE' THEN 9 ELSE {_NUMBER} END AS n FROM m) SELECT event_id, n AS case_no, {_NAME} AS category FROM q",
    "price": "SELECT event_id, round(CASE event_id % 4 WHEN 0 THEN (k * 1000 * 5.0::DOUBLE + k * 10 * 25.0::DOUBLE) / 1000000 WHEN 1 THEN (k * 1000 * 3.0::DOUBLE + k * 10 * 15.0::DOUBLE) / 1000000 WHEN 2 THEN (k * 1000 * 1.0::DOUBLE + k * 10 * 5.0::DOUBLE) / 1000000 ELSE 0 END, 8) AS cost FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "score_ground_truth": STEPS_SQL + _TRUTH + "SELECT tid, critical_step, root_cause_case, earliest_case, terminal_case, array_to_string(all_cases, ',') AS all_cases FROM truth",
    "score_localization": _PAIRED + "SELECT count(*) AS n_scored, 0::BIGINT AS n_missing_root_cause, 0::BIGINT AS n_errors, " + ", ".join(_share(f"d <= {t}", f"within_{t}") for t in range(6)) + ", round(avg(d), 6) AS mean_step_distance FROM paired",
    "score_attribution": _PAIRED + "SELECT " + ", ".join([_share("cas = root_cause_case", "attr_root_cause"), _share("list_contains(all_cases, cas)", "attr_any"), _share("cas = earliest_case", "attr_earliest"), _share("cas = terminal_case", "attr_terminal")]) + " FROM paired",
    "score_table": _PAIRED + "SELECT count(*) AS n, 0::BIGINT AS err, CAST(round_even(sum(step * 11) / count(*)::DOUBLE, 0) AS BIGINT) AS tok, " + ", ".join([_share("d <= 0", "exact"), _share("d <= 5", "pm5")]) + ", CAST(round_even(sum(step * 10) / count(*)::DOUBLE, 0) AS BIGINT) AS in_tok, CAST(round_even(sum(step) / count(*)::DOUBLE, 0) AS BIGINT) AS out_tok, round(count(*) * 0.001::DOUBLE, 4) AS cost_usd, 0.5::DOUBLE AS latency_s FROM paired",
    "score_detection": _CONFIDENCE + _LABELS + ", counted AS (SELECT count(*) FILTER (label AND said) AS tp, count(*) FILTER (label AND NOT said) AS fn, count(*) FILTER (NOT label AND said) AS fp, count(*) FILTER (NOT label AND NOT said) AS tn FROM (SELECT label, coalesce(confidence, 0) >= 0.75 AS said FROM labels l LEFT JOIN conf c ON l.tid = c.tid))" + _RATES.format(more=""),
    "score_repeats": _ROWS_A + "SELECT domain, system, min_by(nn, repeat) AS n, round(avg(exact), 6) AS exact, round(avg(pm5), 6) AS pm5, CAST(sum(err) AS BIGINT) AS err, count(*) AS repeats, round(stddev_pop(exact), 6) AS exact_std, string_agg(CAST(err AS VARCHAR), ',' ORDER BY repeat) AS err_per_repeat FROM rows_a GROUP BY domain, system",
    "pool_weighted": _ROWS_A + ", c AS (SELECT *, (nn % 3) / 10::DOUBLE AS sd FROM rows_a WHERE repeat = 0), g AS (SELECT system, count(DISTINCT domain) AS m, CAST(sum(nn) AS BIGINT) AS n, sum(exact * nn) / sum(nn) AS exact, sum(pm5 * nn) / sum(nn) FILTER (pm5 IS NOT NULL) AS pm5, sum(root_cause_cat * nn) / sum(nn) AS root_cause_cat, sqrt(sum(pow(nn * sd, 2))) / sum(nn) AS pooled_std FROM c WHERE err = 0 GROUP BY system) SELECT system, n, round(exact, 6) AS exact, round(pm5, 6) AS pm5, round(root_cause_cat, 6) AS root_cause_cat, round(pooled_std, 6) AS pooled_std FROM g WHERE m = (SELECT count(DISTINCT domain) FROM c)",
    "compare_runs": _ROWS_AB + "SELECT a.domain, a.system, round(a.exact, 6) AS a, round(b.exact, 6) AS b, round(b.exact - a.exact, 6) AS delta FROM rows_a a JOIN rows_b b ON a.domain = b.domain AND a.system = b.system AND a.repeat = 0 AND b.repeat = 0 WHERE a.err = 0 AND b.err = 0",
    "run_rankings": _ROWS_A + "SELECT domain, string_agg(system, ' > ' ORDER BY exact DESC, system) AS ranking FROM rows_a WHERE repeat = 0 AND err = 0 GROUP BY domain",
    "join_semi_anti": STEPS_SQL + "SELECT tid, n AS n_steps, CASE WHEN n % 2 = 0 THEN 'semi' ELSE 'anti' END AS side FROM steps WHERE i = 1",
    "judge_signals_only": _MASS + "SELECT p.tid, step AS critical_step, 10 AS category_case, 0 AS steps_shown, n AS steps_total FROM prior p JOIN (SELECT DISTINCT tid, n FROM steps) s ON p.tid = s.tid",
}
