"""The same queries in DuckDB's SQL, written from the definitions rather than from the Spark code."""

from __future__ import annotations

_BASE = """
base AS (SELECT user_id, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS run_id, ts, event_id, value, event_type, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events),
steps AS (SELECT run_id, user_id, user_id::VARCHAR AS task_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) - 1 AS pos, value, k,
  CASE WHEN value >= 100 THEN 'error' ELSE 'ok' END AS status,
  CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' WHEN 'signup' THEN 'edit' WHEN 'purchase' THEN 'test' ELSE 'bash' END AS name FROM base),
lab AS (SELECT *, CASE WHEN status = 'ok' THEN 'test(pass)' ELSE 'test(fail)' END AS verdict,
  CASE name WHEN 'read' THEN 'explore' WHEN 'search' THEN 'explore' WHEN 'edit' THEN 'modify' WHEN 'test' THEN 'verify' ELSE 'execute' END AS phase,
  CASE WHEN name IN ('read', 'edit') THEN name || CASE k % 4 WHEN 0 THEN '(source)' WHEN 1 THEN '(test_file)' WHEN 2 THEN '(docs)' ELSE '(config)' END
    WHEN name = 'search' THEN CASE WHEN k % 2 = 0 THEN 'search(glob)' ELSE 'search(specific)' END
    WHEN name = 'test' OR k % 5 = 3 THEN CASE WHEN status = 'ok' THEN 'test(pass)' ELSE 'test(fail)' END
    ELSE CASE k % 5 WHEN 0 THEN 'search(grep_recursive)' WHEN 1 THEN 'bash(python)' WHEN 2 THEN 'bash(read)' ELSE 'bash(git)' END END AS label FROM steps),
runs AS (SELECT run_id, user_id, task_id, count(*) AS n, CASE WHEN arg_max(value, pos) < 10 THEN NULL ELSE arg_max(value, pos) < 60 END AS success FROM steps GROUP BY ALL),
vars AS (SELECT run_id, n, success, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS variant, (CAST(floor(user_id / 2) AS BIGINT) % 10)::VARCHAR AS task_id FROM runs)
"""



def _fisher(a: str, b: str, c: str, d: str) -> str:
    row, col, n = f"({a} + {b})::BIGINT", f"({a} + {c})::BIGINT", f"({a} + {b} + {c} + {d})::BIGINT"
    lf = lambda x: f"lgamma(({x}) + 1)"
    log_p = lambda x: f"{lf(col)} - {lf(x)} - {lf(f'{col} - {x}')} + {lf(f'{n} - {col}')} - {lf(f'{row} - {x}')} - {lf(f'{n} - {col} - {row} + {x}')} - {lf(n)} + {lf(row)} + {lf(f'{n} - {row}')}"
    return f"least(1.0, list_sum(list_transform(range(greatest(0, {row} + {col} - {n})::BIGINT, (least({row}, {col}) + 1)::BIGINT), lambda x: CASE WHEN exp({log_p('x')}) <= exp({log_p(a)}) + 1e-10 THEN exp({log_p('x')}) ELSE 0 END)))"


def _adjust(rows: str, by: str = "") -> str:
    part = f"PARTITION BY {by + ', ' if by else ''}p_value IS NULL"
    return f"""(SELECT *, CASE WHEN p_value IS NULL THEN NULL ELSE least(1.0, min(p_value * m / r) OVER ({part} ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) END AS q_value
FROM (SELECT *, count(p_value) OVER ({part}) AS m, row_number() OVER ({part} ORDER BY p_value) AS r FROM {rows}))"""


def _with(body: str, more: str = "") -> str:
    return f"WITH {_BASE}{', ' + more if more else ''} {body}"


_SIG = "sig AS (SELECT run_id, string_agg('tool:' || name, ' > ' ORDER BY pos) AS signature FROM steps GROUP BY run_id)"
_RLE = """isl AS (SELECT run_id, {c} AS v, pos, pos - row_number() OVER (PARTITION BY run_id, {c} ORDER BY pos) AS g FROM lab),
rle_{c} AS (SELECT run_id, string_agg(CASE WHEN c > 1 THEN v || '×' || c ELSE v END, ' → ' ORDER BY p) AS t FROM (SELECT run_id, v, count(*) AS c, min(pos) AS p FROM isl GROUP BY run_id, v, g) GROUP BY run_id)"""
_SIGN = "CASE WHEN {p} + {m} >= 5 THEN least(1.0, 2 * list_sum(list_transform(range(0, (least({p}, {m}) + 1)::BIGINT), lambda i: exp(lgamma({p} + {m} + 1) - lgamma(i + 1) - lgamma({p} + {m} - i + 1) - ({p} + {m}) * ln(2.0))))) END"
_FEATS = """
feats AS (
  SELECT r.run_id, r.task_id, r.success, c.v AS test_position_centroid, s.v AS symmetry_index, e.v AS edit_dispersion FROM runs r
  LEFT JOIN (SELECT l.run_id, avg(pos::DOUBLE / (r.n - 1)) AS v FROM lab l JOIN runs r USING (run_id) WHERE label LIKE 'test(%' AND r.n >= 5 GROUP BY l.run_id HAVING count(*) >= 2) c USING (run_id)
  LEFT JOIN (SELECT l.run_id, avg(1 - abs(pos::DOUBLE / (r.n - 1) - CASE phase WHEN 'explore' THEN 0.2 WHEN 'modify' THEN 0.5 ELSE 0.85 END)) AS v FROM lab l JOIN runs r USING (run_id) WHERE r.n >= 6 AND phase IN ('explore', 'modify', 'verify') GROUP BY l.run_id HAVING count(*) >= 4) s USING (run_id)
  LEFT JOIN (SELECT run_id, count(DISTINCT CASE k % 4 WHEN 0 THEN 'mod_' || k WHEN 1 THEN 'test_' || k WHEN 2 THEN 'md' || k ELSE 'cfg' END)::DOUBLE / count(*) AS v FROM lab WHERE name = 'edit' GROUP BY run_id HAVING count(*) >= 2) e USING (run_id))"""
_DELTAS = """
grp AS (SELECT task_id FROM runs GROUP BY task_id HAVING count(success) >= 10 AND count_if(success) > 0 AND count_if(NOT success) > 0),
long AS (SELECT task_id, success, feature, v FROM (
  SELECT task_id, success, 'test_position_centroid' AS feature, test_position_centroid AS v FROM feats UNION ALL SELECT task_id, success, 'symmetry_index', symmetry_index FROM feats UNION ALL SELECT task_id, success, 'edit_dispersion', edit_dispersion FROM feats)
  WHERE success IS NOT NULL AND v IS NOT NULL AND task_id IN (SELECT task_id FROM grp)),
cuts AS (SELECT task_id, feature, list_sort(list(v))[count(*) // 2 + 1] AS cut FROM long GROUP BY ALL HAVING count(*) >= 2),
deltas AS (SELECT task_id, feature, count_if(success AND v > cut)::DOUBLE / count_if(v > cut) - count_if(success AND v <= cut)::DOUBLE / count_if(v <= cut) AS delta FROM long JOIN cuts USING (task_id, feature) GROUP BY ALL HAVING count_if(v > cut) >= 1 AND count_if(v <= cut) >= 1)"""
_NEXT = """
nx AS (SELECT run_id, pos, label, lead(label) OVER w AS l2, lead(label, 2) OVER w AS l3 FROM lab WINDOW w AS (PARTITION BY run_id ORDER BY pos)),
flags AS (SELECT v.*, coalesce(f.te, false)::INT AS te, coalesce(f.fx, false)::INT AS fx, coalesce(f.se, false)::INT AS se, s.bad, s.tool::INT AS tool FROM vars v
  JOIN (SELECT run_id, bool_or(label LIKE 'edit%' AND coalesce(l2, '') LIKE 'test%') AS te, bool_or(label LIKE 'edit%' AND coalesce(l2, '') LIKE 'test%' AND coalesce(l3, '') LIKE 'edit%') AS fx, bool_or(label LIKE 'search%' AND coalesce(l2, '') LIKE 'edit%') AS se FROM nx GROUP BY run_id) f USING (run_id)
  JOIN (SELECT run_id, count_if(status <> 'ok') AS bad, bool_or(status = 'error' AND name = 'bash') AS tool FROM lab GROUP BY run_id) s USING (run_id)),
beh AS (SELECT variant, nr, unnest(['TEST_AFTER_EDIT_RATE', 'ITERATIVE_FIX_RATE', 'BLIND_SUBMIT_RATE', 'TOOL_TIMEOUT_ERROR_RATE', 'STEP_FAILURE_RATE', 'AVG_STEP_COUNT', 'SEARCH_BEFORE_EDIT_RATE', 'REASONING_DENSITY']) AS feature, unnest([te, fx, 0, tl, sf, ac, se, 0]) AS value
  FROM (SELECT variant, count(*) AS nr, avg(te) AS te, avg(fx) AS fx, avg(tool) AS tl, sum(bad) / sum(n) AS sf, avg(n) AS ac, avg(se) AS se FROM flags GROUP BY variant))"""
_SHIFTS = """
sh AS (SELECT feature, b AS baseline, c AS current, c - b AS shift, CASE WHEN feature = 'AVG_STEP_COUNT' THEN (c - b) / greatest(abs(b), abs(c), 1.0) ELSE 2 * asin(sqrt(c)) - 2 * asin(sqrt(b)) END AS effect_size,
  CASE WHEN feature <> 'AVG_STEP_COUNT' THEN c - b - 1.96 * sqrt(b * (1 - b) / nb + c * (1 - c) / nc) END AS ci_low, CASE WHEN feature <> 'AVG_STEP_COUNT' THEN c - b + 1.96 * sqrt(b * (1 - b) / nb + c * (1 - c) / nc) END AS ci_high
  FROM (SELECT feature, max(value) FILTER (WHERE variant = 'a') AS b, max(value) FILTER (WHERE variant = 'b') AS c, max(nr) FILTER (WHERE variant = 'a') AS nb, max(nr) FILTER (WHERE variant = 'b') AS nc FROM beh GROUP BY feature))"""


def _motif_rows(found: str, totals: str, by: str = "", digits: int = 6) -> str:
    on = f"USING ({by})" if by else "ON true"
    p = _fisher("n_pass", "(n_with - n_pass)", "(ap - n_pass)", "(ak - ap - n_with + n_pass)")
    rows = f"(SELECT {by + ', ' if by else ''}pattern, n_with, n_pass, avg_position, n_pass::DOUBLE / n_with AS success_rate, (n_pass::DOUBLE / n_with) / (ap::DOUBLE / ak) AS lift, {p} AS p_value FROM {found} JOIN {totals} {on} WHERE n_with >= 3 AND ap > 0 AND ap < ak)"
    return f"SELECT {by + ', ' if by else ''}pattern, n_with, n_pass, round(avg_position, {digits}) AS avg_position, round(success_rate, {digits}) AS success_rate, round(lift, {digits}) AS lift, round(p_value, {digits}) AS p_value, round(q_value, {digits}) AS q_value FROM {_adjust(rows, by)}"


def _gram(n: int) -> str:
    cols = " || ' → ' || ".join("label" if k == 0 else f"l{k + 1}" for k in range(n))
    return f"SELECT g.run_id, r.success, {cols} AS pattern, g.pos::DOUBLE / greatest(r.n - 1, 1) AS p FROM nx g JOIN runs r USING (run_id) WHERE l{n} IS NOT NULL"


_MEAN = "round(sum(round({p}, 12)::DECIMAL(28, 12))::DOUBLE / count(*), 9) AS avg_position"
_NX = "nx AS (SELECT run_id, pos, label, lead(label) OVER w AS l2, lead(label, 2) OVER w AS l3 FROM lab WINDOW w AS (PARTITION BY run_id ORDER BY pos))"
_FOUND = "(SELECT pattern, count(success) AS n_with, count_if(success) AS n_pass, " + _MEAN.format(p="p") + " FROM (SELECT run_id, success, pattern, min(p) AS p FROM g GROUP BY ALL) GROUP BY pattern)"
_TOTALS = "(SELECT count(success) AS ak, count_if(success) AS ap FROM runs)"
_GAPPED = """
freq AS (SELECT label FROM (SELECT label, count(DISTINCT run_id) AS c FROM lab JOIN runs USING (run_id) WHERE success IS NOT NULL GROUP BY label) WHERE c >= greatest(3, ceil(0.05 * (SELECT count(success) FROM runs)))),
kn AS (SELECT l.run_id, l.pos, l.label, r.n, r.success FROM lab l JOIN runs r USING (run_id) WHERE r.success IS NOT NULL AND l.label IN (SELECT label FROM freq)),
f1 AS (SELECT run_id, n, success, label AS a, min(pos) AS p FROM kn GROUP BY ALL),
f2 AS (SELECT f1.run_id, f1.n, f1.success, a || ' → ... → ' || label AS a, min(pos) AS p FROM f1 JOIN kn ON f1.run_id = kn.run_id AND kn.pos > f1.p GROUP BY ALL),
f3 AS (SELECT f2.run_id, f2.n, f2.success, a || ' → ... → ' || label AS a, min(pos) AS p FROM f2 JOIN kn ON f2.run_id = kn.run_id AND kn.pos > f2.p GROUP BY ALL)"""
_GAPPED_BY = """
kv AS (SELECT l.run_id, l.pos, l.label, v.variant, v.n, v.success FROM lab l JOIN vars v USING (run_id) WHERE v.success IS NOT NULL),
freq AS (SELECT variant, label FROM (SELECT variant, label, count(DISTINCT run_id) AS c FROM kv GROUP BY ALL) JOIN (SELECT variant, count(success) AS t FROM vars GROUP BY variant) USING (variant) WHERE c >= greatest(3, ceil(0.05 * t))),
kn AS (SELECT kv.* FROM kv JOIN freq USING (variant, label)),
f1 AS (SELECT variant, run_id, n, success, label AS a, min(pos) AS p FROM kn GROUP BY ALL),
f2 AS (SELECT f1.variant, f1.run_id, f1.n, f1.success, a || ' → ... → ' || label AS a, min(pos) AS p FROM f1 JOIN kn ON f1.run_id = kn.run_id AND kn.pos > f1.p GROUP BY ALL)"""
_CELLS = "cells AS (SELECT task_id AS group_id, run_id, success, pos AS col, label AS value FROM lab JOIN (SELECT run_id, success FROM runs) USING (run_id))"


def _gapped(n: int) -> str:
    found = f"(SELECT a AS pattern, count(*) AS n_with, count_if(success) AS n_pass, {_MEAN.format(p='p::DOUBLE / greatest(n - 1, 1)')} FROM f{n} GROUP BY a)"
    return _with(_motif_rows(found, _TOTALS), _GAPPED)


def _best(rows: str) -> str:
    """Of each pattern the row of least q, in which 0 counts as 1; ties by stratum."""
    cut = ", ".join(f"round({c}, 6) AS {c}" for c in ("avg_position", "success_rate", "lift", "p_value", "q_value"))
    return f"SELECT variant, pattern, n_with, n_pass, {cut} FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY round(CASE WHEN q_value = 0 THEN 1 ELSE coalesce(q_value, 1) END, 9), variant) AS best FROM ({rows})) WHERE best = 1"


def _pruned() -> str:
    found = lambda n: f"(SELECT a AS pattern, count(*) AS n_with, count_if(success) AS n_pass, 0 AS avg_position FROM f{n} GROUP BY a)"
    more = f"{_GAPPED}, p2 AS ({_motif_rows(found(2), _TOTALS, digits=9)}), p3 AS (SELECT *, string_split(pattern, ' → ... → ') AS x FROM ({_motif_rows(found(3), _TOTALS, digits=9)}))"
    return _with("SELECT pattern, n_with, n_pass, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value FROM p2 WHERE NOT EXISTS (SELECT 1 FROM p3 WHERE p3.n_with >= p2.n_with AND p3.q_value <= p2.q_value AND p2.pattern IN (x[1] || ' → ... → ' || x[2], x[1] || ' → ... → ' || x[3], x[2] || ' → ... → ' || x[3]))", more)


_ROOT_PI = "sqrt(pi())"


def _erfc(a: str) -> str:
    """For a of 0 or more: the series within 3, the continued fraction beyond."""
    series = f"1 - 2 / {_ROOT_PI} * list_sum(list_transform(range(0, 61), lambda i_: power(-1, i_) * power({a}, 2 * i_ + 1) / (gamma(i_ + 1) * (2 * i_ + 1))))"
    tail = f"list_reduce(list_concat([{a}::DOUBLE], list_transform(range(60, 0, -1), lambda i_: i_::DOUBLE)), lambda f_, i_: {a} + i_ / 2 / f_)"
    return f"CASE WHEN {a} < 3 THEN {series} ELSE exp(-{a} * {a}) / {_ROOT_PI} / ({tail}) END"


_POINTS = f"""{_CELLS}, bv AS (SELECT group_id, col, value, count(*) AS n, count_if(success) AS np, count_if(NOT success) AS nf FROM cells GROUP BY ALL),
cl AS (SELECT group_id, col, count(*) AS n_values, min(n) AS min_branch, sum(np) AS np, sum(nf) AS nf, count_if(np + nf > 0) AS nk, arg_min(np, value) AS p1, arg_min(nf, value) AS f1, arg_max(np, value) AS p2, arg_max(nf, value) AS f2 FROM bv GROUP BY ALL HAVING count(*) >= 2 AND min(n) >= 2),
ch AS (SELECT group_id, col, sum(CASE WHEN tp > 0 THEN power(np - n1 * tp / (tp + tf), 2) / (n1 * tp / (tp + tf)) ELSE 0 END + CASE WHEN tf > 0 THEN power(nf - n1 * tf / (tp + tf), 2) / (n1 * tf / (tp + tf)) ELSE 0 END) AS chi
  FROM (SELECT bv.*, (bv.np + bv.nf)::DOUBLE AS n1, cl.np::DOUBLE AS tp, cl.nf::DOUBLE AS tf FROM bv JOIN cl USING (group_id, col)) WHERE np + nf > 0 GROUP BY ALL),
zs AS (SELECT *, (power(chi / df, 1.0::DOUBLE / 3) - 1 + 2 / (9 * df)) / sqrt(2 / (9 * df)) / sqrt(2) AS z FROM (SELECT cl.*, coalesce(chi, 0)::DOUBLE AS chi, (nk - 1)::DOUBLE AS df FROM cl LEFT JOIN ch USING (group_id, col))),
tl AS (SELECT group_id, col, CASE WHEN df <= 0 OR chi <= 0 THEN 1.0 WHEN z < 0 THEN 0.5 * (2 - ({_erfc("(-z)")})) ELSE 0.5 * ({_erfc("z")}) END AS p_chi FROM zs),
en AS (SELECT group_id, col, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT group_id, col, n, sum(n) OVER (PARTITION BY group_id, col) AS t FROM bv) GROUP BY ALL)"""
_TESTED = f"(SELECT group_id, col, n_values, min_branch, entropy, CASE WHEN np + nf >= 4 AND np > 0 AND nf > 0 THEN CASE WHEN n_values = 2 THEN {_fisher('p1', 'f1', 'p2', 'f2')} ELSE p_chi END END AS p_value FROM cl JOIN en USING (group_id, col) JOIN tl USING (group_id, col))"


def _divergence() -> str:
    return _with(f"SELECT group_id, col, n_values, min_branch, round(entropy, 6) AS entropy, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value FROM {_adjust(_TESTED, 'group_id')}", _POINTS)


def _population() -> str:
    more = f"""{_POINTS}, pt AS (SELECT group_id, col, p_value, q_value FROM {_adjust(_TESTED, 'group_id')} WHERE q_value IS NOT NULL),
br AS (SELECT group_id, col, value, avg(success::INT) AS rate, count(*) AS n, min(run_id) FILTER (WHERE success) AS pr, min(run_id) FILTER (WHERE NOT success) AS fr FROM cells JOIN pt USING (group_id, col) GROUP BY ALL HAVING count(success) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY group_id, col ORDER BY rate DESC, value) AS best, row_number() OVER (PARTITION BY group_id, col ORDER BY rate, value) AS worst FROM br),
pp AS (SELECT b.group_id, b.col, b.pr AS pass_run, w.fr AS fail_run, b.value AS preferred, w.value AS dispreferred, b.rate AS preferred_rate, w.rate AS dispreferred_rate, b.n AS n_preferred, w.n AS n_dispreferred FROM rk b JOIN rk w ON b.group_id = w.group_id AND b.col = w.col AND b.best = 1 AND w.worst = 1 WHERE b.rate - w.rate >= 0.15 AND b.pr IS NOT NULL AND w.fr IS NOT NULL),
cx AS (SELECT pp.group_id, pp.col, string_agg(c.value, ' → ' ORDER BY c.col) AS context FROM pp JOIN cells c ON c.group_id = pp.group_id AND c.run_id = pp.pass_run AND c.col < pp.col AND c.col >= pp.col - 5 GROUP BY ALL)"""
    return _with("SELECT pp.group_id, pp.col, pass_run, fail_run, preferred, dispreferred, round(preferred_rate, 6) AS preferred_rate, round(dispreferred_rate, 6) AS dispreferred_rate, n_preferred, n_dispreferred, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, coalesce(context, '') AS context FROM pp JOIN pt USING (group_id, col) LEFT JOIN cx USING (group_id, col)", more)


#: The definitions' own patterns.
_KINDS = {
    "uncertainty_density": r"(?i)\bmaybe\b|\bmight\b|\bpossibly\b|\bactually,|\blet me (?:try|step back|reconsider)\b|\banother approach\b",
    "causal_density": r"(?i)\bbecause\b|\bsince\b|\btherefore\b|\bthus\b|\bcaused by\b|\bdue to\b|\bresult of\b",
    "diagnosis_density": r"(?i)\bthe issue is\b|\bthe problem is\b|\broot cause\b|\bthis happens when\b|\bfails? because\b|\berror.{0,20}because\b",
    "code_ref_density": r"\.py\b|line \d+|def \w+|class \w+|import \w+",
}
_HYPOTHESIS = (
    r"\bi think (?:the|this|it)\b|\bthe (?:root )?cause (?:is|might be|could be|seems)\b|\bthis (?:fails?|errors?|breaks?) because\b"
    r"|\bthe (?:issue|problem|bug|error) (?:is|seems|appears|might be)\b|\bmy (?:hypothesis|theory|guess)\b|\bi (?:suspect|believe|hypothesize)\b"
    r"|\bthis (?:is likely|is probably|seems to be|appears to be)\b|\bthe reason (?:is|for)\b|\bwhat(?:'s| is) happening (?:is|here)\b|\bthis (?:suggests?|indicates?|means?)\b"
)


def _hits(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"


def _activity() -> str:
    p = _fisher("ap", "af", "gp", "gf")
    more = f"{_CELLS}, ac AS (SELECT group_id, col, count_if(success) AS ap, count_if(NOT success) AS af FROM cells GROUP BY ALL), tt AS (SELECT task_id AS group_id, count_if(success) AS np, count_if(NOT success) AS nf FROM runs GROUP BY ALL), x AS (SELECT group_id, col, ap, af, np - ap AS gp, nf - af AS gf FROM ac JOIN tt USING (group_id))"
    rows = f"(SELECT *, {p} AS p_value FROM x WHERE ap + af > 0 AND gp + gf > 0)"
    return _with(f"SELECT group_id, col, ap, af, gp, gf, round(CASE WHEN ap + gp > 0 THEN ap::DOUBLE / (ap + gp) ELSE 0 END - CASE WHEN af + gf > 0 THEN af::DOUBLE / (af + gf) ELSE 0 END, 6) AS direction, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value FROM {_adjust(rows, 'group_id')}", more)


def _ranked() -> str:
    signs = ", ".join(f"count_if(delta {o} 0 AND {w}) AS {n}{t}" for t, w in (("a", "true"), ("0", "h = 0"), ("1", "h = 1")) for n, o in (("p", ">"), ("m", "<")))
    agg = f"(SELECT feature, 100 * avg(delta) AS delta_pp, count(*) AS n_tasks, {signs} FROM (SELECT *, (substr(md5('0:' || task_id), 1, 1) < '8')::INT AS h FROM deltas) GROUP BY feature)"
    s = lambda t: _SIGN.format(p=f"p{t}", m=f"m{t}")
    rows = f"(SELECT feature, delta_pp, n_tasks, {s('a')} AS p_value, coalesce({s('0')} < 0.05, false) AND coalesce({s('1')} < 0.05, false) AS holds_in_halves FROM {agg})"
    return _with(f"SELECT feature, round(delta_pp, 6) AS delta_pp, n_tasks, round(p_value, 6) AS p_value, holds_in_halves, round(q_value, 6) AS q_value FROM {_adjust(rows)}", _FEATS + ", " + _DELTAS)


_EXPERIMENT = """
ef AS (SELECT l.run_id, any_value(r.task_id) AS task_id, any_value(r.success) AS success, count(*) AS n_labels, any_value(r.n) AS nn, count_if(label LIKE 'read%' OR label LIKE 'search%')::DOUBLE / count(*) AS exploration_ratio, count_if(label LIKE 'edit%')::DOUBLE / count(*) AS edit_density,
  count_if(label LIKE 'bash%')::DOUBLE / count(*) AS bash_ratio, CASE WHEN count_if(label LIKE 'test(%') > 0 THEN count_if(label LIKE 'test(%' AND pos >= r.n // 2)::DOUBLE / count_if(label LIKE 'test(%') END AS late_test_ratio,
  count(DISTINCT CASE WHEN name = 'read' THEN (CASE WHEN k % 4 = 3 THEN -1 ELSE k END) END) AS files_read, count(DISTINCT CASE WHEN name = 'edit' THEN (CASE WHEN k % 4 = 3 THEN -1 ELSE k END) END) AS files_edited
  FROM lab l JOIN runs r USING (run_id) GROUP BY l.run_id),
seg AS (SELECT run_id, label, sum((label LIKE 'edit%')::INT) OVER (PARTITION BY run_id ORDER BY pos) AS g FROM lab),
lp AS (SELECT run_id, max(c) >= 3 AS test_fail_loop FROM (SELECT run_id, g, count_if(label = 'test(fail)') AS c FROM seg GROUP BY ALL) GROUP BY run_id)"""

_FILES = "fs AS (SELECT *, CASE k % 4 WHEN 0 THEN 'mod_' || k || '.py' WHEN 1 THEN 'test_' || k || '.py' WHEN 2 THEN k || '.md' ELSE 'cfg.json' END AS file FROM steps)"
_COMPLY = """
nl AS (SELECT run_id, name, k, lead(name = 'test' OR (name = 'bash' AND k % 5 = 3)) OVER (PARTITION BY run_id ORDER BY pos) AS nt FROM steps),
cm AS (SELECT run_id, count_if(name = 'edit' AND k % 4 <> 1) AS e, count_if(name = 'edit' AND k % 4 <> 1 AND coalesce(nt, false)) AS t FROM nl GROUP BY run_id)"""

ORACLE: dict[str, str] = {
    "experiment_features": _with("SELECT run_id, n_labels, round(exploration_ratio, 6) AS exploration_ratio, round(edit_density, 6) AS edit_density, round(bash_ratio, 6) AS bash_ratio, round(late_test_ratio, 6) AS late_test_ratio, test_fail_loop, files_read, files_edited FROM ef JOIN lp USING (run_id)", _EXPERIMENT),
    "exemplar_tasks": _with("SELECT task_id, round(a, 6) AS pass_mean, round(b, 6) AS fail_mean, n_pass, n_fail, round(abs(a - b), 6) AS gap FROM (SELECT task_id, avg(exploration_ratio) FILTER (WHERE success) AS a, avg(exploration_ratio) FILTER (WHERE NOT success) AS b, count_if(success) AS n_pass, count_if(NOT success) AS n_fail FROM ef GROUP BY task_id) WHERE n_pass >= 3 AND n_fail >= 3 AND abs(a - b) >= 0.05 ORDER BY abs(a - b) DESC, task_id LIMIT 10", _EXPERIMENT),
    "enriched_steps": _with("SELECT run_id, pos, label, phase, status FROM lab"),
    "compressed_runs": _with("SELECT run_id, a.t AS steps, b.t AS phases FROM rle_label a JOIN rle_phase b USING (run_id)", _RLE.format(c="label") + ", " + _RLE.format(c="phase").replace("isl ", "isl2 ").replace("FROM isl G", "FROM isl2 G")),
    "run_signatures": _with("SELECT run_id, signature, n AS n_steps, success FROM sig JOIN runs USING (run_id)", _SIG),
    "run_summary": _with("SELECT count(*) AS n_runs, round(avg(success::INT), 6) AS success_rate, round(avg(n), 6) AS avg_steps, median(n)::DOUBLE AS median_steps FROM runs"),
    "top_signatures": _with("SELECT signature, count(*) AS n FROM sig GROUP BY signature ORDER BY n DESC, signature LIMIT 10", _SIG),
    "phase_counts": _with("SELECT phase, count(*) AS n FROM lab GROUP BY phase"),
    "task_groups": _with("SELECT *, CASE WHEN n_known < 10 THEN 'too_few_runs' WHEN n_pass = 0 THEN 'all_fail' WHEN n_fail = 0 THEN 'all_pass' END AS skip_reason FROM (SELECT task_id, count(*) AS n_runs, count(success) AS n_known, count_if(success) AS n_pass, count_if(NOT success) AS n_fail FROM runs GROUP BY task_id)"),
    "mixed_tasks_unknown_fails": _with("SELECT task_id FROM runs GROUP BY task_id HAVING count_if(coalesce(success, false)) > 0 AND count_if(NOT coalesce(success, false)) > 0 AND count(*) >= 3"),
    "filtered_runs": _with("SELECT run_id, success, n AS n_steps FROM runs WHERE task_id = '7'"),
    "first_runs": _with("SELECT task_id, min(run_id) AS run_id, arg_min(n, run_id) AS n_steps FROM runs GROUP BY task_id"),
    "run_features": _with("SELECT run_id, round(test_position_centroid, 6) AS test_position_centroid, round(symmetry_index, 6) AS symmetry_index, round(edit_dispersion, 6) AS edit_dispersion FROM feats", _FEATS),
    "feature_deltas": _with("SELECT task_id, feature, round(delta, 6) AS delta FROM deltas", _FEATS + ", " + _DELTAS),
    "rank_features": _ranked(),
    "cohort_behaviours": _with("SELECT variant, nr AS n_runs, feature, round(value, 6) AS value FROM beh", _NEXT),
    "variant_shifts": _with("SELECT feature, round(baseline, 6) AS baseline, round(current, 6) AS current, round(shift, 6) AS shift, round(effect_size, 6) AS effect_size, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM sh", _NEXT + ", " + _SHIFTS),
    "task_breakdown": _with("SELECT task_id, round(b, 6) AS baseline_rate, round(c, 6) AS current_rate, nb AS baseline_runs, nc AS current_runs, round(c - b, 6) AS delta FROM (SELECT task_id, coalesce(avg(success::INT) FILTER (WHERE variant = 'a'), 0) AS b, coalesce(avg(success::INT) FILTER (WHERE variant = 'b'), 0) AS c, count_if(variant = 'a') AS nb, count_if(variant = 'b') AS nc FROM vars GROUP BY task_id)"),
    "cause_scores": _with("""SELECT cause_id, round(evidence, 6) AS evidence, round(w / sum(w) OVER (), 6) AS score FROM (SELECT cause_id, evidence, prior * exp(least(evidence, 50)) AS w FROM (
SELECT 'less_testing' AS cause_id, 1.0 / 3 AS prior, (SELECT sum(CASE WHEN shift < 0 THEN abs(effect_size) ELSE -0.5 * abs(effect_size) END) FROM sh WHERE feature IN ('TEST_AFTER_EDIT_RATE', 'ITERATIVE_FIX_RATE')) AS evidence
UNION ALL SELECT 'tool_trouble', 0.3, (SELECT sum(CASE WHEN shift > 0 THEN abs(effect_size) ELSE -0.5 * abs(effect_size) END) FROM sh WHERE feature IN ('TOOL_TIMEOUT_ERROR_RATE', 'STEP_FAILURE_RATE'))
UNION ALL SELECT '_unknown', 1.0 / 3, (SELECT coalesce(sum(abs(effect_size)), 0) FROM sh WHERE feature NOT IN ('TEST_AFTER_EDIT_RATE', 'ITERATIVE_FIX_RATE', 'TOOL_TIMEOUT_ERROR_RATE', 'STEP_FAILURE_RATE') AND abs(effect_size) > 0.1)))""", _NEXT + ", " + _SHIFTS),
    "exclusive_signatures": _with("SELECT signature, max(c) AS n, max(variant) AS side FROM (SELECT signature, variant, count(*) AS c FROM sig JOIN vars USING (run_id) GROUP BY ALL) GROUP BY signature HAVING count(*) = 1", _SIG),
    "contiguous_motifs": _with(_motif_rows(_FOUND, _TOTALS), f"{_NX}, g AS ({_gram(2)} UNION ALL {_gram(3)})"),
    "stratified_motifs": _with(_best(_motif_rows(
        f"(SELECT variant, pattern, count(success) AS n_with, count_if(success) AS n_pass, {_MEAN.format(p='p')} FROM (SELECT g.run_id, v.variant, g.success, pattern, min(p) AS p FROM g JOIN vars v USING (run_id) GROUP BY ALL) GROUP BY ALL)",
        "(SELECT variant, count(success) AS ak, count_if(success) AS ap FROM vars GROUP BY variant)", "variant", 12)), f"{_NX}, g AS ({_gram(2)})"),
    "stratified_gapped": _with(_best(_motif_rows(
        f"(SELECT variant, a AS pattern, count(*) AS n_with, count_if(success) AS n_pass, {_MEAN.format(p='p::DOUBLE / greatest(n - 1, 1)')} FROM f2 GROUP BY ALL)",
        "(SELECT variant, count(success) AS ak, count_if(success) AS ap FROM vars GROUP BY variant)", "variant", 12)), _GAPPED_BY),
    "pruned_gapped_pairs": _pruned(),
    "effect_magnitudes": _with("SELECT feature, CASE WHEN abs(effect_size) < 0.2 THEN 'negligible' WHEN abs(effect_size) < 0.5 THEN 'small' WHEN abs(effect_size) < 0.8 THEN 'medium' ELSE 'large' END AS magnitude FROM sh", _NEXT + ", " + _SHIFTS),
    "available_values": _with("SELECT 'variant' AS field, variant AS value, count(*) AS n FROM vars GROUP BY ALL UNION ALL SELECT 'task_id', task_id, count(*) FROM vars GROUP BY ALL"),
    "tagged_runs": _with("SELECT run_id, n AS n_steps FROM vars WHERE task_id = '3' AND variant = 'a' AND n >= 3"),
    "phase_summaries": _with("SELECT variant, sum(n)::BIGINT AS n_steps, string_agg(phase || ' ' || round(100.0::DOUBLE * n / t)::INT || '%', ', ' ORDER BY n DESC, phase) AS summary FROM (SELECT variant, phase, count(*) AS n, sum(count(*)) OVER (PARTITION BY variant) AS t FROM lab JOIN vars USING (run_id) GROUP BY variant, phase) GROUP BY variant"),
    "signature_stats": _with("""SELECT task_id, sum(c)::BIGINT AS n_runs, round(sum(p) / sum(k), 6) AS success_rate, round(sum(s) / sum(c), 6) AS avg_steps, arg_min(signature, (-c, signature)) AS prototype
FROM (SELECT task_id, signature, count(*) AS c, count(success) AS k, count_if(success) AS p, sum(n) AS s FROM vars JOIN sig USING (run_id) GROUP BY ALL) GROUP BY task_id""", _SIG),
    "test_centroids": _with("SELECT run_id, round(v, 6) AS centroid FROM runs LEFT JOIN (SELECT run_id, avg(pos::DOUBLE / greatest(n - 1, 1)) AS v FROM lab JOIN (SELECT run_id, n FROM runs) USING (run_id) WHERE label LIKE 'test(%' GROUP BY run_id) USING (run_id)"),
    "reasoning_metrics": f"SELECT {', '.join(f'round(sum({_hits(p)}) FILTER (WHERE said)::DOUBLE / count_if(said), 6) AS {k}' for k, p in _KINDS.items())}, round((sum(length(text)) FILTER (WHERE said))::DOUBLE / count(*), 6) AS reasoning_per_step, count_if(said) AS n_reasoning_steps FROM (SELECT text, role = 'assistant' AND coalesce(text, '') <> '' AS said FROM conversations) HAVING count_if(said) > 0",
    "reasoning_features": f"SELECT conv_id::VARCHAR AS run_id, round(sum(({_hits(_KINDS['uncertainty_density'])} > 0)::INT) FILTER (WHERE said)::DOUBLE / count_if(said), 6) AS uncertainty_density, round(sum({_hits(_HYPOTHESIS, 'lower(text)')}) FILTER (WHERE said)::DOUBLE / count_if(said), 6) AS reasoning_hypothesis_formation FROM (SELECT conv_id, text, role = 'assistant' AND coalesce(text, '') <> '' AS said FROM conversations) GROUP BY conv_id",
    "population_pairs": _population(),
    "converted_logs": _with("""SELECT run_id, 'family' AS task_family, pos::BIGINT AS pos, 'tool' AS type, CASE WHEN name = 'bash' AND k % 5 = 3 THEN 'test' ELSE name END AS name, CASE WHEN name IN ('read', 'edit') THEN file END AS file_path, CASE WHEN name = 'search' THEN CASE WHEN k % 2 = 0 THEN '*.py' ELSE 'needle' END END AS pattern,
CASE name WHEN 'test' THEN 'npm test' WHEN 'bash' THEN ['grep -r x .', 'python run.py', 'cat notes.txt', 'pytest -q', 'cd /srv && git status'][k % 5 + 1] END AS command, NULL AS result FROM fs UNION ALL SELECT run_id, 'family', n, 'system', 'result', NULL, NULL, NULL, 'done' FROM runs""", _FILES),
    "converted_dialogues": _with("""SELECT run_id, 'o__n' AS task_family, pos::BIGINT AS pos, 'tool' AS type, CASE WHEN name <> 'bash' THEN name ELSE ['search', 'bash', 'search', 'test', 'bash'][k % 5 + 1] END AS name,
CASE WHEN name = 'read' THEN file END AS file_path, 'Now' || chr(10) || '```' || chr(10) || said AS reasoning, said AS action, status AS result FROM (SELECT *,
CASE name WHEN 'read' THEN 'open ' || file || ' 10' WHEN 'edit' THEN 'edit 1:2' WHEN 'search' THEN 'search_dir needle' WHEN 'test' THEN 'pytest -q' ELSE ['grep -r x .', 'python run.py', 'cat notes.txt', 'pytest -q', 'cd /srv && git status'][k % 5 + 1] END AS said FROM fs)""", _FILES),
    "log_compliance": _with("SELECT run_id, e AS source_edits, t AS tested_edits, round(CASE WHEN e > 0 THEN t::DOUBLE / e END, 6) AS compliance_rate FROM cm", _COMPLY),
    "compliance_outcomes": _with("SELECT count_if(h AND success) AS high_pass, count_if(h AND NOT success) AS high_fail, count_if(NOT h AND success) AS low_pass, count_if(NOT h AND NOT success) AS low_fail FROM (SELECT success, t::DOUBLE / e >= 0.5 AS h FROM cm JOIN (SELECT run_id, success FROM runs) USING (run_id) WHERE e > 0 AND success IS NOT NULL)", _COMPLY),
    "step_histogram": _with("SELECT variant, least(3, floor(n * 4 / 6.0))::BIGINT AS bin, count(*) AS n FROM vars GROUP BY ALL"),
    "centred_correlation": _with(f"SELECT n, round(r, 6) AS r, round({_erfc('(abs(r) * sqrt(n) / sqrt(2))')}, 6) AS p_value FROM (SELECT count(*) AS n, corr(x, y) AS r FROM (SELECT n - avg(n) OVER (PARTITION BY task_id) AS x, success::INT - avg(success::INT) OVER (PARTITION BY task_id) AS y FROM runs WHERE success IS NOT NULL))"),
    "step_rank_test": _with(f"""SELECT n1, n2, u, round(2 * u / (n1 * n2) - 1, 6) AS rank_biserial, round(least(1.0, CASE WHEN z < 0 THEN 2 - ({_erfc('(-z)')}) ELSE {_erfc('z')} END), 6) AS p_value FROM (SELECT *, (abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) / sqrt(2) AS z FROM
(SELECT count_if(success)::DOUBLE AS n1, count_if(NOT success)::DOUBLE AS n2, sum(rk) FILTER (WHERE success) - count_if(success) * (count_if(success) + 1) / 2 AS u, sum(t * t - 1)::DOUBLE AS ties FROM (SELECT success, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS rk, count(*) OVER (PARTITION BY n) AS t FROM runs WHERE success IS NOT NULL)))"""),
    "gapped_pairs": _gapped(2),
    "gapped_triples": _gapped(3),
    "transition_signals": _with("""SELECT pair, n_raw, round(a, 6) AS pass_rate, round(b, 6) AS fail_rate, round(a - b, 6) AS delta FROM (SELECT pair, sum(c)::BIGINT AS n_raw, coalesce(avg(c / greatest(1, n - 1)) FILTER (WHERE success), 0) AS a, coalesce(avg(c / greatest(1, n - 1)) FILTER (WHERE NOT success), 0) AS b FROM
(SELECT nx.run_id, success, n, label || ' → ' || l2 AS pair, count(*)::DOUBLE AS c FROM nx JOIN runs USING (run_id) WHERE l2 IS NOT NULL AND success IS NOT NULL AND run_id IN (SELECT run_id FROM steps WHERE name = 'edit') GROUP BY ALL) GROUP BY pair HAVING sum(c) >= 10) ORDER BY abs(a - b) DESC, pair LIMIT 5""", _NX),
    "divergence_points": _divergence(),
    "position_consensus": _with("SELECT group_id, col, arg_min(value, (-n, value)) AS value FROM (SELECT group_id, col, value, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL", _CELLS),
    "column_activity": _activity(),
    "adjusted_p": f"SELECT user_id, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value FROM {_adjust('(SELECT user_id, CASE WHEN avg(value) < 70 THEN avg(value) / 100 END AS p_value FROM events GROUP BY user_id)')}",
    "preference_candidates": _with("SELECT a.task_id, a.run_id AS pass_run, b.run_id AS fail_run FROM c a JOIN c b ON a.task_id = b.task_id AND a.success AND NOT b.success", "c AS (SELECT * FROM (SELECT task_id, run_id, success, row_number() OVER (PARTITION BY task_id, success ORDER BY run_id) AS r FROM runs WHERE success IS NOT NULL) WHERE r <= 5)"),
}
