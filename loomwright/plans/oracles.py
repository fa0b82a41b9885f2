"""DuckDB SQL for the analytics queries, written from the operators' definitions."""

from __future__ import annotations

from ..functions.text import GUARD, KEYWORDS, QUIET
from ..operators import errors
from ..operators.retrieval import NO_ANSWER
from . import derived


def _text(value: str) -> str:
    """A SQL literal; line ends are spelled out."""
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n")) + ")"


LOG = f"""
log AS ({derived.ATTEMPT_LOG}),
totals AS (SELECT model, count(*) AS total FROM log GROUP BY model),
dense AS (SELECT model, total, i::INT AS i, (SELECT count(*) FROM log WHERE log.model = totals.model AND status = 'pass' AND attempt = i) AS s FROM totals, range(0, 6) AS r(i)),
steps AS (SELECT model, i, s, total, total - coalesce(sum(s) OVER (PARTITION BY model ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM dense),
hazard AS (SELECT *, CASE WHEN n > 0 THEN s::DOUBLE / n ELSE 0.0 END AS h, round_even(CASE WHEN n > 0 THEN s::DOUBLE / n ELSE 0.0 END * 100 * 10000, 0) / 10000 AS pct FROM steps)"""

FIT = f"""{LOG},
pts AS (SELECT model, list({{'t': i, 'y': pct}} ORDER BY i) FILTER (n > 0 AND pct > 0) AS p, first(pct ORDER BY i) AS e0, round_even(sum(s)::DOUBLE / first(total) * 100 * 10000, 0) / 10000 AS a_phi FROM hazard GROUP BY model),
halve AS (
  SELECT model, p, 0.0::DOUBLE AS low, 50.0::DOUBLE AS high, 0 AS k FROM pts WHERE len(p) >= 3
  UNION ALL
  SELECT model, p, CASE WHEN g > 0 THEN low ELSE m END, CASE WHEN g > 0 THEN m ELSE high END, k + 1 FROM (
    SELECT *, list_sum(list_transform(p, lambda x: x.y * x.t * exp(-m * x.t))) * list_sum(list_transform(p, lambda x: exp(-m * x.t * 2)))
      - list_sum(list_transform(p, lambda x: x.y * exp(-m * x.t))) * list_sum(list_transform(p, lambda x: x.t * exp(-m * x.t * 2))) AS g
    FROM (SELECT *, (low + high) / 2 AS m FROM halve WHERE k < 80))),
rate AS (SELECT model, p, (low + high) / 2 AS lam FROM halve WHERE k = 80),
height AS (SELECT *, list_sum(list_transform(p, lambda x: x.y * exp(-lam * x.t))) / list_sum(list_transform(p, lambda x: exp(-lam * x.t * 2))) AS e FROM rate),
fit AS (SELECT pts.model, pts.e0, pts.a_phi, lam, coalesce(e, e0) AS fe,
  CASE WHEN lam IS NULL THEN NULL ELSE 1 - list_sum(list_transform(pts.p, lambda x: (x.y - e * exp(-lam * x.t)) ** 2)) / list_sum(list_transform(pts.p, lambda x: (x.y - list_avg(list_transform(pts.p, lambda z: z.y))) ** 2)) END AS r2
  FROM pts LEFT JOIN height USING (model))"""

_LABEL = "CASE WHEN r2 IS NULL THEN 'N/A' WHEN r2 > 0.9 THEN 'excellent' WHEN r2 > 0.7 THEN 'good' ELSE 'poor' END"


def _r(e: str, digits: int = 4) -> str:
    return f"round_even(({e}) * {10**digits}, 0) / {10**digits}"


def ddi() -> dict[str, str]:
    scalars = f'{_r("lam")} AS "lambda", {_r("fe")} AS "fitted_E_0", {_r("r2")} AS r_squared, {_LABEL} AS fit_quality'
    t = "ln(100.0::DOUBLE / (100.0::DOUBLE - theta)) / lam"
    theta = "(VALUES (50), (80), (90), (95), (99)) AS v(theta)"
    lists = f"""list(theta ORDER BY theta) AS theta, list({_r(t, 3)} ORDER BY theta) AS t_theta, list(ceil({t})::BIGINT ORDER BY theta) AS t_theta_ceiling"""
    return {
        "ddi_pass_counts": f'WITH {LOG} SELECT model, i, s AS "S_i" FROM steps',
        "ddi_influence": f'WITH {LOG} SELECT model, i, s AS "S_i", n AS "N_i", {_r("h", 9)} AS "I_i", pct FROM hazard',
        "ddi_norm_effectiveness": f"WITH {LOG} SELECT model, CASE WHEN i = 0 THEN 'E_0' ELSE 'D_' || i END AS key, pct AS value FROM hazard WHERE n > 0",
        "ddi_overall": f'WITH {LOG} SELECT model, total AS total_problems, sum(s)::BIGINT AS total_solved, {_r("sum(s)::DOUBLE / total", 9)} AS overall_success_rate, {_r("sum(s)::DOUBLE / total * 100")} AS "A_phi" FROM steps GROUP BY model, total',
        "ddi_summary_lines": f"WITH {LOG} SELECT model, i, printf('Attempt %d: %d/%d = %.4f (%.2f%%)', i, s, n, h, h * 100) AS line FROM hazard WHERE n > 0",
        "ddi_fit": f"WITH RECURSIVE {FIT} SELECT model, {scalars} FROM fit",
        "ddi_thresholds": f"WITH RECURSIVE {FIT} SELECT model, theta, {_r(t, 3)} AS t_theta, ceil({t})::BIGINT AS t_theta_ceiling FROM fit, {theta} WHERE lam IS NOT NULL",
        "ddi_decay_curve": f"WITH RECURSIVE {FIT}, m AS (SELECT model, lam, fe, ceil(ln(100.0::DOUBLE) / lam) AS until FROM fit WHERE lam IS NOT NULL) SELECT model, k::INT AS k, {_r('k * until / 99', 3)} AS t, {_r('fe * exp(-lam * (k * until / 99))', 3)} AS e FROM m, range(0, 100) AS r(k)",
        "ddi_result": f'WITH RECURSIVE {FIT}, x AS (SELECT model, {lists} FROM fit, {theta} WHERE lam IS NOT NULL GROUP BY model) SELECT fit.model, e0 AS "E_0", {scalars}, x.theta, x.t_theta, x.t_theta_ceiling, a_phi AS "A_phi" FROM fit LEFT JOIN x USING (model)',
    }


def recorded() -> dict[str, str]:
    outcome = f"r AS ({derived.RUNS}), o AS (SELECT task, coalesce(min(attempt) FILTER (returncode = 0), max(attempt)) AS attempt, CASE WHEN min(returncode) = 0 THEN 'pass' ELSE 'fail' END AS status FROM r WHERE attempt <= 5 GROUP BY task)"
    return {
        "run_status": f"WITH {outcome} SELECT task, attempt, status, count(*) FILTER (status = 'pass') OVER w AS n_solved, count(*) FILTER (status = 'fail') OVER w AS n_unsolved FROM o WINDOW w AS (ORDER BY task ROWS UNBOUNDED PRECEDING)",
        "fresh_start_sessions": f"WITH r AS ({derived.RUNS}) SELECT task, attempt, returncode, attempt % 2 = 0 AS fresh_start, count(*) FILTER (attempt % 2 = 0) OVER (PARTITION BY task ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS session FROM r",
        "dataset_subset": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 100",
        "result_schema_dispatch": f"WITH l AS ({derived.ATTEMPT_LOG}) SELECT CASE WHEN task % 2 = 0 THEN task::VARCHAR END AS problem_id, CASE WHEN task % 2 = 0 THEN model END AS library, attempt AS fix_mode_attempt_count, status, CASE WHEN task % 2 <> 0 THEN task::VARCHAR END AS task_id FROM l",
    }


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(e: str) -> str:
    return _STRIP.format(e)


def errors_sql() -> dict[str, str]:
    nl = "chr(10)"
    blocks = f"list_transform(string_split(stderr, 'Traceback')[2:], lambda x: {_strip(f"'Traceback' || string_split(x, {nl} || {nl})[1]")})"
    # Blocks must end with an error or an exception; all of ours do.
    base = f"""s AS ({derived.STDERR_LOG}), b AS (SELECT *, {blocks} AS blocks FROM s),
      p AS (SELECT *, CASE WHEN contains(stderr, 'This is a generic error message.') THEN {_strip("replace(stderr, blocks[-1], '')")} ELSE {_strip("stderr")} END AS plain FROM b),
      e AS (SELECT *, list_filter(list_reverse(string_split(plain, {nl})), lambda l: regexp_matches(l, '^[A-Za-z.]+[Ee]rror.*')) AS hits FROM p),
      y AS (SELECT *, CASE WHEN contains(plain, 'Generated code is running infinite loop') THEN 'Infinite Loop' WHEN len(hits) > 0 THEN trim(string_split(hits[1], ':')[1]) END AS kind FROM e),
      z AS (SELECT *, CASE WHEN position('File "/usr/src/app/main.py"' IN plain) > 0 THEN substr(plain, position('File "/usr/src/app/main.py"' IN plain)) ELSE plain END AS short,
        len(list_filter(string_split(plain, {nl}), lambda l: l = 'OK' OR regexp_matches(l, '^Ran\\s+[0-9]+\\s+tests?\\s+in\\s+[0-9.]+s$') OR regexp_matches(l, '^FAILED\\s+\\((\\w+=[0-9]+,?\\s*)+\\)$'))) > 0 AS ut FROM y)"""
    case = f"CASE WHEN kind = 'AssertionError' THEN CASE WHEN contains(stderr, 'assert') AND contains(stderr, {nl} || 'AssertionError') THEN {_strip(f"replace(regexp_extract(stderr, '(?s)assert(.*)\\nAssertionError', 1), 'candidate', 'solve')")} END WHEN kind IS NOT NULL THEN '' END"
    fill = lambda t, *v: " || ".join(x for pair in zip([_text(p) for p in t.split("{}")], [*v, "''"]) for x in pair)
    rule = "'" + "-" * 50 + "'"
    unit = f"{_strip(fill(errors.UNITTEST_PROMPT, f"{rule} || {nl} || 'Error 1:' || {nl} || 'Error type: ' || kind || {nl} || blocks[1] || {rule}"))}"
    # A leading process name is cut off before anything else; it changes what is told only where nothing names the target.
    told = f"""CASE WHEN ut THEN {unit} WHEN kind = 'AssertionError' THEN {fill(errors.FAILED_ANY, "short")} WHEN kind = 'NameError' THEN {fill(errors.NAME_PROMPT, _strip(f"string_split(short, {nl})[-1]"))}
      WHEN kind = 'RecursionError' THEN {_text(errors.RECURSION_PROMPT)} WHEN kind IS NOT NULL THEN {fill(errors.OTHER_PROMPT, "kind", "short")} END"""
    chars = f"list_filter(string_split(lower(string_split(stderr, {nl})[1]), ''), lambda c: c <> '')"
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in errors.OUTCOMES.items())
    distinct = f"list_filter({chars}, lambda c, i: list_position({chars}, c) = i)"
    count = f"len(list_filter({chars}, lambda x: x = c))"
    summary = f"array_to_string(list_transform({distinct}, lambda c: 'Your solution ' || CASE c {words} ELSE 'got ' || c || ' in' END || ' ' || {count} || CASE WHEN {count} = 1 THEN ' test case.' ELSE ' test cases.' END), {nl})"
    return {
        "err_tracebacks": f"WITH {base} SELECT event_id, len(blocks)::INT AS n, array_to_string(blocks, {nl} || '~' || {nl}) AS blocks FROM b",
        "err_type": f"WITH {base} SELECT event_id, kind AS error_type FROM y",
        "err_target_only": f"WITH {base} SELECT event_id, short AS message FROM z",
        "err_test_case": f"WITH {base} SELECT event_id, {case} AS test_case FROM y",
        "err_name_line": f"WITH {base} SELECT event_id, CASE WHEN kind = 'NameError' THEN {_strip(f"string_split(stderr, {nl})[-1]")} ELSE stderr END AS line FROM y",
        "err_is_unittest": f"WITH {base} SELECT event_id, ut AS is_unittest FROM z",
        "err_unittest_summary": f"WITH {base} SELECT event_id, {summary} AS summary, len(list_filter({chars}, lambda c: c <> '.'))::INT AS failures FROM z WHERE ut",
        "err_prompt": f"WITH {base} SELECT event_id, {told} AS prompt FROM z",
    }


def responses_sql() -> dict[str, str]:
    r = f"r AS ({derived.RESPONSES})"
    req = r"regexp_extract(response, '(?s)### Requirements\s*(.*?)\s*###', 1)"
    code = _strip(r"regexp_extract(response, '(?s)### Code\s*```(?:python)?(.*?)```', 1)")
    names = f"list_filter(list_transform(string_split({req}, ','), lambda x: {_strip('x')}), lambda x: x <> '')"
    listed = f"CASE WHEN lower({_strip(req)}) = 'none' THEN [] ELSE {names} END"
    fence = r"```(?:python)?\s*([\s\S]*?)\s*```"
    c = f"c AS ({derived.CALLS})"
    bare = "regexp_replace(regexp_replace(word, '[^a-zA-Z0-9_]', '_', 'g'), '_+$', '')"
    keys = ", ".join(f"'{k}'" for k in KEYWORDS)
    tests = "def check(f):\n    assert f() == 1"
    tail = "def run_check():\n    check(f)\n\n" + GUARD.format(target="run_check", seconds=10)
    return {
        "resp_parse": f"WITH {r} SELECT item_id, array_to_string({listed}, '|') AS requirements, {code} AS code FROM r",
        # By the kinds of our responses: tagged, one section of code, a block in a section of another name, plain text.
        "resp_codellama": f"WITH {r} SELECT item_id, CASE item_id % 5 WHEN 2 THEN regexp_extract(response, '(?s)\\[PYTHON\\](.*)\\[\\\\PYTHON\\]', 1) WHEN 4 THEN '' ELSE {_strip(f"regexp_extract(response, '{fence}', 1)")} END AS code FROM r",
        "resp_stop_strings": f"SELECT doc_id, {_strip(f"string_split(string_split(text, chr(10))[1], '. ')[1]")} AS text FROM documents",
        "call_from_assert": f"WITH {c} SELECT call_id, CASE WHEN regexp_matches(call, 'assert\\s.*==') THEN regexp_extract(call, 'assert\\s(.*?)==', 1) END AS inner_call FROM c",
        "call_uncast": f"WITH {c} SELECT call_id, CASE WHEN regexp_matches(call, '^[a-z]{{0,5}}\\([a-z_]+\\([\\w,\\s]+\\)\\)') THEN regexp_extract(call, '^[a-z]{{0,5}}\\((.*)\\)', 1) ELSE call END AS inner_call FROM c",
        "call_unbracket": f"WITH {c} SELECT call_id, CASE WHEN call[1] = '(' THEN substr(trim(call), 2, length(trim(call)) - 2) ELSE call END AS inner_call FROM c",
        "ident_sanitise": f"WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \\n]')) AS word FROM documents), n AS (SELECT word, CASE WHEN regexp_matches({bare}, '^[0-9]') THEN '_' || {bare} WHEN {bare} = '' THEN '_' ELSE {bare} END AS x FROM w) SELECT word, CASE WHEN x IN ({keys}) THEN x || '_var' ELSE x END AS name FROM n",
        "program_text": f"WITH {r} SELECT item_id, sha256({_text(QUIET)} || chr(10) || chr(10) || {code} || chr(10) || chr(10) || {_text(tests)} || chr(10) || chr(10) || {_text(tail)}) AS program_sha256, array_to_string({listed}, chr(10)) AS requirements_file FROM r",
        "name_allowed": "WITH n AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', ' ') WHEN 1 THEN replace(c_name, '#', ':') ELSE c_name END AS name FROM customer) SELECT c_custkey, regexp_full_match(name, '[a-zA-Z0-9._:-]+') AS allowed, CASE WHEN regexp_full_match(name, '[a-zA-Z0-9._:-]+') THEN name END AS quoted FROM n",
        "model_tag": "WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ':7b' ELSE 'lab/' || p_brand END AS m FROM part) SELECT p_partkey, CASE WHEN contains(m, ':') THEN m ELSE m || ':latest' END AS model, replace(m, '/', '_') AS file FROM n",
    }


def chat_sql() -> dict[str, str]:
    qa = """t AS (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS asker FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      qa AS (SELECT conv_id, turn, q AS question, text AS answer FROM t WHERE role = 'assistant' AND asker = 'user'),
      h AS (SELECT *, coalesce(list({'q': question, 'a': answer}) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), []) AS history, first_value(question) OVER w AS original, coalesce(lag(question) OVER w, first_value(question) OVER w) AS last_question FROM qa WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
    flat = lambda body: f"array_to_string(list_transform(history, lambda p{', i' if 'i ||' in body else ''}: {body}), '')"
    past = "array_to_string(list_transform(list_filter(history, lambda p: trim(p.q) <> '' AND trim(p.a) <> ''), lambda p: 'user:' || p.q || '~assistant:' || p.a || '~'), '')"
    turn = "CASE role WHEN 'system' THEN text WHEN 'user' THEN chr(10) || chr(10) || 'Human: ' || text WHEN 'assistant' THEN chr(10) || chr(10) || 'Assistant: ' || text END"
    system = "You are a careful programmer."
    return {
        "chat_history_k3": f"WITH {qa} SELECT conv_id, turn, len(history)::INT AS n, array_to_string(list_transform(history, lambda p: p.q || '|' || p.a), '~') AS history, original, last_question FROM h",
        "chat_messages": f"WITH {qa} SELECT conv_id, turn, {past} || 'user:<context>' || chr(10) || '- ' || original || chr(10) || '</context>' || chr(10) || chr(10) || question AS messages FROM h",
        "chat_system_prompt": f"WITH {qa} SELECT conv_id, turn, '{system}' || CASE WHEN len(history) > 0 THEN chr(10) || chr(10) || '<original_question>' || chr(10) || original || chr(10) || '</original_question>' ELSE '' END AS prompt FROM h",
        "chat_flat": f"WITH {qa} SELECT conv_id, turn, '>> Original Question: ' || original || chr(10) || {flat("CASE WHEN p.q <> original THEN '>> Previous question ' || i || ': ' || p.q || chr(10) ELSE '' END || '>> Your previous response ' || i || ': ' || p.a || chr(10) || chr(10)")} AS text FROM h",
        "chat_template": f"SELECT conv_id, string_agg({turn}, '' ORDER BY turn) FILTER (trim(text) <> '') || chr(10) || chr(10) || 'Assistant:' AS text FROM conversations GROUP BY conv_id",
        "chat_dump": f"SELECT conv_id, '{system}' || chr(10) || chr(10) || string_agg('[' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id",
        "ft_records": f"WITH {qa} SELECT conv_id, turn, '<s>### Instruction:' || chr(10) || question || chr(10) || '### Response: ' || answer || '</s>' AS text FROM qa",
        "chat_template_pieces": f"SELECT conv_id, 0 AS piece, string_agg(CASE WHEN trim(text) <> '' THEN {turn} ELSE '' END, '' ORDER BY turn, role, text) || chr(10) || chr(10) || 'Assistant:' AS text FROM conversations GROUP BY conv_id",
        "ft_pairs_all": """WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS k FROM conversations)
          SELECT q.conv_id, q.k, q.text AS question, a.text AS answer FROM n q JOIN n a ON q.conv_id = a.conv_id AND q.k = a.k AND q.role = 'user' AND a.role = 'assistant'""",
        "ft_log_pairs": """WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
          a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
          SELECT conv_id, (k - 1)::INT AS k, replace(u.text, chr(10), ' ') || '-----' AS question, replace(a.text, chr(10), ' ') AS answer FROM u JOIN a USING (conv_id, k) WHERE k <= 50""",
    }


def retrieval_sql() -> dict[str, str]:
    top = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
      s AS (SELECT q.vec_id AS qid, b.vec_id, round_even(list_dot_product(q.e, b.e) / (q.n * b.n) * 1e9, 0) / 1e9 AS sim FROM v q, v b WHERE q.vec_id % 20 = 0),
      r AS (SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 3)"""
    return {
        "vec_topk": f"WITH {top} SELECT qid, vec_id, rank FROM r",
        "vec_index_topk": f"WITH {top} SELECT qid, vec_id, rank FROM r",
        "rag_context": f"WITH {top}, c AS (SELECT qid, string_agg('- ' || text, chr(10) ORDER BY rank, text) AS x FROM r JOIN documents ON doc_id = vec_id GROUP BY qid) SELECT qid, length(x)::INT AS n_chars, sha256(x) AS context_sha256 FROM c",
    }


def sources_sql() -> dict[str, str]:
    system = "You are a careful programmer."
    count = "coalesce(length(text), 0) - coalesce(length(replace(text, '{}', '')), 0)"
    embedding = " || ',' || ".join(f"({count.format(c)})::VARCHAR" for c in "aeiounrstl")
    reached = """({before} SELECT model, {n} AS intervention, {t}::DOUBLE AS target, min(happened) AS happened, arg_min(pct, happened) AS actual FROM p{since} WHERE pct >= {t}{after} GROUP BY model)"""
    first = reached.format(before="", n=1, t=30, since="", after="")
    second = reached.format(before="", n=2, t=60, since=" JOIN (SELECT model, happened AS since FROM i1) USING (model)", after=" AND happened > since")
    told = f"t AS (SELECT model, CASE WHEN completed >= 985 * 1048576 THEN 'success' ELSE status END AS status, completed, total, happened FROM ({derived.PULLS}))"
    rounds = f"""{told}, g AS (SELECT *, CASE WHEN happened - lag(happened) OVER (PARTITION BY model ORDER BY happened) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM t),
      h AS (SELECT *, sum(fresh) OVER (PARTITION BY model ORDER BY happened ROWS UNBOUNDED PRECEDING) AS k FROM g),
      rounds AS (SELECT model, min(happened) AS began, max(happened) AS ended, count(*) AS n, max(completed::DOUBLE / total * 100) AS top, bool_or(status = 'success') AS done FROM h GROUP BY model, k)"""
    third = reached.format(before="", n=3, t=90, since=" JOIN (SELECT model, happened AS since FROM i2) USING (model)", after=" AND happened > since")
    top = retrieval_sql()["rag_context"].replace("length(x)::INT AS n_chars, sha256(x) AS context_sha256", "x")
    return {
        "data_positions": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents",
        "data_keys": """SELECT event_id, coalesce(contains(props, '"k":'), false) AS has_k, coalesce(contains(props, '"k":') AND contains(props, '"other":'), false) AS has_both FROM events""",
        "data_selection": "SELECT 0 AS place, 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 1, 'orders', count(*) FROM orders",
        "data_projection": f"WITH log AS ({derived.ATTEMPT_LOG}) SELECT status, NULL::VARCHAR AS library, task FROM log",
        "data_mapped": "SELECT doc_id, upper(lang) AS lang, length(text) AS n_chars FROM documents",
        "vec_embed": f"SELECT doc_id, {embedding} AS embedding FROM documents",
        "rag_answer": f"SELECT qid // 20 AS qid, CASE WHEN (qid // 20) % 2 = 1 THEN {_text(NO_ANSWER)} ELSE 'characters: ' || length(x) END AS answer FROM ({top})",
        "pull_progress": f"WITH p AS ({derived.PULLS}) SELECT model, arg_max(status, happened) AS status, round(arg_max(completed, happened)::DOUBLE / arg_max(total, happened) * 100, 6) AS percent, round(arg_max(completed, happened)::DOUBLE / 1048576, 6) AS mb FROM p GROUP BY model",
        "pull_rounds": f"WITH {rounds} SELECT model, epoch_us(began) AS began, epoch_us(ended) AS ended, n, round(top, 6) AS top, done FROM rounds",
        "pull_retries": f"""WITH {rounds}, m AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY began) AS k FROM rounds)
          SELECT model, CASE WHEN count(*) FILTER (done) > 0 THEN 'pulled' WHEN max(k) >= 10 THEN 'failed' ELSE 'open' END AS outcome,
          (CASE WHEN count(*) FILTER (done) > 0 THEN min(k) FILTER (done) ELSE max(k) END)::INT AS rounds, round(max(top), 6) AS top FROM m WHERE k <= 10 GROUP BY model""",
        "pull_fallback": f"""WITH {told}, p AS (SELECT model, happened, completed::DOUBLE / total * 100 AS pct FROM t), i1 AS {first}, i2 AS {second}, i3 AS {third},
          s AS (SELECT model, max(happened) AS since FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3) GROUP BY model),
          b AS (SELECT model, coalesce(since, min(happened)) AS since FROM t LEFT JOIN s USING (model) GROUP BY model, since),
          r AS (SELECT model, floor((epoch_us(min(happened)) - epoch_us(since)) / 7200e6)::INT + 1 AS round FROM t JOIN b USING (model) WHERE status = 'success' AND happened >= since GROUP BY model, since)
          SELECT b.model, coalesce(round <= 10, false) AS pulled, CASE WHEN round <= 10 THEN round END AS round FROM b LEFT JOIN r USING (model)""",
        "pull_interventions": f"WITH p AS (SELECT model, happened, completed::DOUBLE / total * 100 AS pct FROM ({derived.PULLS})), i1 AS {first}, i2 AS {second}, i3 AS {third} SELECT model, intervention, target, round(actual, 6) AS actual FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3)",
        "chat_merged_system": f"SELECT conv_id, count(*)::INT AS n, '{system}' || chr(10) || chr(10) || arg_min(text, turn) AS first FROM conversations GROUP BY conv_id",
        "chat_prompt_switch": f"WITH r AS ({derived.RUNS}) SELECT task, attempt, CASE WHEN attempt > 0 THEN 'Mend the program.' ELSE 'Write the program.' END AS prompt FROM r",
    }


def all_sql() -> dict[str, str]:
    return sources_sql() | ddi() | recorded() | errors_sql() | responses_sql() | chat_sql() | retrieval_sql()
