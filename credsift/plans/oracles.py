"""DuckDB SQL for the scanner's queries, generated from the same dimension tables."""

from __future__ import annotations

import re

from ..functions.lists import (
    APP_PATHS, CALLS, CONFIDENCE, DUMMY_MARKERS, ENV_REFERENCES, EXTENSIONS, FIXTURE_PATHS, LANGUAGES, PLACEHOLDERS, PROVIDERS, REFERENCE_KEYS, SEEDS, SEVERITIES, UNVERIFIED,
)
from ..functions.endpoints import ENDPOINTS
from ..functions.patterns import any_pattern, patterns
from ..operators.catalog import sample_entries
from ..sources.corpus import CORPUS_SQL, TAG

#: A history made from orders: two commits each, with a changed, a deleted and an added file. Both engines read this text.
PATCH_SQL = """
SELECT concat('repo_', k) AS repo, concat(
  chr(1), md5(concat('a', k)), chr(31), 'add ', k, chr(10), chr(10), 'diff --git a/app/x.rb b/app/x.rb', chr(10), 'index 1..2 100644', chr(10), '--- a/app/x.rb', chr(10), '+++ b/app/x.rb', chr(10),
  '@@ -1,3 +', k % 100 + 1, ',4 @@ def x', chr(10), ' one', chr(10), '+key AK', 'IA', upper(substr(h, 1, 16)), chr(10), '-gone', chr(10), '+', '++ b/not a header', chr(10), ' two', chr(10),
  '@@ -20,1 +', k % 100 + 30, ',2 @@', chr(10), ' ctx', chr(10), '+token=gh', 'p_', h, substr(h, 1, 8), chr(10), chr(92), ' No newline at end of file', chr(10),
  'diff --git a/old.rb b/old.rb', chr(10), 'deleted file mode 100644', chr(10), '--- a/old.rb', chr(10), '+++ /dev/null', chr(10), '@@ -1 +0,0 @@', chr(10), '-password', chr(10),
  chr(1), md5(concat('b', k)), chr(31), 'second ', k, chr(10), chr(10), 'diff --git a/new_', k, '.py b/new_', k, '.py', chr(10), 'new file mode 100644', chr(10), '--- /dev/null', chr(10), '+++ b/new_', k, '.py', chr(10),
  '@@ -0,0 +1,2 @@', chr(10), '+import os', chr(10), '+password = "', substr(h, 1, 16), '"', chr(10)) AS text
FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS STRING)) AS h FROM {orders}) AS keyed
"""

SALT_INNER = "unhex('{}')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def has(value: str, words: list[str]) -> str:
    return f"regexp_matches({value}, {q(alternatives(words))})"


NAME = "regexp_extract(path, '([^/]*)$', 1)"
EXT = f"lower(regexp_extract({NAME}, '^.+\\.([^.]+)$', 1))"
SCANNED = f"(({EXT} IN ({', '.join(map(q, EXTENSIONS))}) OR starts_with({NAME}, '.env')) AND NOT regexp_matches(path, '(?:^|/)\\.claude/worktrees/'))"
REDACTED = "CASE WHEN length({0}) < 12 THEN {0} ELSE concat(left({0}, 4), '...', right({0}, 4)) END"
LANGUAGE = "CASE WHEN starts_with(" + NAME + ", '.env') THEN 'env' " + " ".join(f"WHEN {EXT} IN ({', '.join(map(q, x.split()))}) THEN {q(n)}" for n, x in LANGUAGES.items()) + " END"
CORPUS = f"corpus AS ({CORPUS_SQL.format(orders='orders')}), files AS (SELECT * FROM corpus WHERE {SCANNED})"
DOCS = "files AS (SELECT concat('docs_', doc_id, '.txt') AS path, text FROM documents)"
LINES = """lined AS (SELECT path, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\\r+$', '')) AS lines FROM files),
numbered AS (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS line FROM lined)"""
PRAGMA = f"list_transform(regexp_extract_all({{0}}, '(?i)#?\\s*{TAG}:allow(?:\\s+([a-z][a-z0-9_]*))?', 1), lambda x: lower(coalesce(x, '')))"


def findings(source: str) -> str:
    """CTEs up to ``found`` (all matches, with ``hushed``) and ``f`` (those that no comment suppresses)."""
    some = f"""cand AS (SELECT path, line, lines[line] AS text, lines[greatest(line - 3, 1):least(line + 3, len(lines))] AS context,
    list_concat({PRAGMA.format('lines[line]')}, CASE WHEN line > 1 THEN {PRAGMA.format('lines[line - 1]')} ELSE [] END) AS ids
  FROM numbered WHERE strlen(lines[line]) <= 8192 AND regexp_matches(lines[line], {q(any_pattern())}))"""
    parts = [
        f"SELECT path, line, context, ids, {q(p.id)} AS pattern, {p.ord} AS pattern_ord, {q(p.severity)} AS severity, regexp_extract_all(text, {q(p.gap)}, 0) AS w, regexp_extract_all(text, {q(p.gap)}, 1) AS b, regexp_extract_all(text, {q(p.gap)}, 2) AS v FROM cand WHERE regexp_matches(text, {q(p.regex)})"
        for p in patterns()
    ]
    return f"""{source}, {LINES}, {some}, hits AS ({' UNION ALL '.join(parts)}),
places AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM hits),
found AS (SELECT path, line, (coalesce(list_sum(list_transform(w[1:i - 1], lambda x: strlen(x))), 0) + strlen(b[i]) + 1)::INT AS "column", v[i] AS match, pattern, pattern_ord, severity, context,
  list_contains(ids, '') OR list_contains(ids, pattern) AS hushed FROM places),
f AS (SELECT * EXCLUDE (hushed) FROM found WHERE NOT hushed)"""


BARE = "regexp_replace(trim(match), '^[\"''`]+|[\"''`]+$', '', 'g')"
RANK = "CASE severity " + " ".join(f"WHEN {q(s)} THEN {i}" for i, s in enumerate(SEVERITIES)) + " END"
FIXTURE = has("replace(path, '\\', '/')", FIXTURE_PATHS)
STEP = f"""CASE WHEN catalog_verdict = 'FIXTURE' THEN 'catalog_fixture' WHEN catalog_verdict = 'KNOWN_LEAKED' THEN 'catalog_leaked' WHEN catalog_verdict = 'HONEYTOKEN' THEN 'catalog_honeytoken'
 WHEN status = 'verified' THEN 'verified' WHEN status = 'invalid' THEN 'invalid' WHEN {FIXTURE} THEN 'fixture_path' WHEN {has('lower(match)', DUMMY_MARKERS)} THEN 'dummy'
 WHEN regexp_matches(bare, '(?s)^\\$\\{{.*\\}}$') OR regexp_matches(bare, '^\\$[A-Za-z_][A-Za-z0-9_]*$') OR (strlen(bare) > 2 AND regexp_matches(bare, '(?s)^%.*%$')) OR {has('lower(bare)', ENV_REFERENCES)} THEN 'env_reference'
 WHEN bare = '' OR regexp_matches(bare, '(?s)^(?:[#$%]?\\{{.*\\}}|<.*>)$') OR {has('bare', PLACEHOLDERS)} OR (regexp_matches(bare, '^[*xX._-]+$') AND strlen(bare) >= 3) OR (strlen(bare) >= 8 AND len(list_distinct(string_split(bare, ''))) <= 2) THEN 'placeholder'
 WHEN len(list_filter(context, lambda x: contains(x, bare) AND {has('lower(x)', REFERENCE_KEYS)})) > 0 OR (regexp_matches(bare, '^[a-z0-9/._-]*$') AND regexp_matches(bare, '[^/]/+[^/]')) THEN 'secret_reference'
 WHEN {RANK} >= 3 AND regexp_matches(path, {q('^(?:' + alternatives(APP_PATHS) + ')')}) THEN 'app_path' ELSE 'inconclusive' END"""
VERIFIERS = "verifiers(pattern, provider, ord) AS (VALUES " + ", ".join([f"({q(p)}, {q(n)}, {i})" for i, (n, h, _, _) in enumerate(PROVIDERS) for p in h.split()] + [f"({q(p.id)}, 'external_scanner', {len(PROVIDERS)})" for p in patterns() if p.id not in UNVERIFIED]) + ")"
RESPONSES = """asked AS (SELECT DISTINCT provider, match FROM f JOIN verifiers USING (pattern) WHERE provider <> 'external_scanner'),
answers AS (SELECT provider, match, CASE WHEN d < '5' THEN 200 WHEN d < '8' THEN 401 WHEN d < 'a' THEN 500 WHEN d < 'c' THEN 403 END AS code, d FROM (SELECT *, substr(md5(match), 1, 1) AS d FROM asked))"""
BAD = " OR ".join(f"(provider = {q(n)} AND code IN ({', '.join(s.split())}))" for n, _, s, _ in PROVIDERS if s)
TOLD = f"""told AS (SELECT provider, match, CASE WHEN d >= 'c' THEN 'unverified' WHEN (code = 200 AND ((provider = 'slack' AND d >= '3') OR (provider = 'datadog' AND d >= '2'))) OR {BAD} THEN 'invalid' WHEN code = 200 THEN 'verified' ELSE 'unverified' END AS status, code, d FROM answers),
said AS (SELECT *, CASE WHEN d >= 'c' THEN 'network: timed out' WHEN status = 'unverified' THEN concat('unexpected HTTP ', coalesce(code::VARCHAR, '-')) END AS status_reason FROM told)"""
JUDGED = """ranked AS (SELECT pattern, match, provider, status, status_reason, row_number() OVER (PARTITION BY pattern, match ORDER BY CASE status WHEN 'verified' THEN 3 WHEN 'invalid' THEN 2 ELSE 1 END DESC, CASE WHEN status = 'verified' THEN -ord ELSE ord END DESC) AS rn
  FROM (SELECT DISTINCT pattern, match FROM f) JOIN verifiers USING (pattern) JOIN said USING (provider, match)),
j AS (SELECT f.*, provider, status, status_reason FROM f LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) USING (pattern, match))"""
CATALOG = "entries(pos, id, kind, strategy, value, verdict) AS (VALUES " + ", ".join("(" + ", ".join([str(e[0]), *map(q, e[1:])]) + ")" for e in sample_entries()) + ")"
LOOKUP = """known AS (SELECT match, (SELECT arg_max(struct_pack(id := id, verdict := verdict), CASE strategy WHEN 'exact' THEN 3000 + pos WHEN 'exact_hash' THEN 2000 + pos ELSE 1000 - pos END) FROM entries
  WHERE (strategy = 'exact' AND value = match) OR (strategy = 'exact_hash' AND lower(value) = sha256(match)) OR (strategy = 'regex' AND regexp_matches(match, value))) AS e FROM (SELECT DISTINCT match FROM f)),
c AS (SELECT j.*, e.id AS catalog_id, e.verdict AS catalog_verdict FROM j LEFT JOIN known USING (match))"""


def hmac(value: str, salt: bytes) -> str:
    key = salt.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in key).hex() for x in (0x36, 0x5C))
    return f"rtrim(translate(to_base64(unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({value})))))), '+/', '-_'), '=')"


def ladder(source: str = "c") -> str:
    return f"""stepped AS (SELECT *, {STEP} AS step FROM (SELECT *, {BARE} AS bare FROM {source})),
full_ AS (SELECT * REPLACE (CASE step WHEN 'catalog_leaked' THEN 'high' WHEN 'catalog_honeytoken' THEN 'critical' ELSE severity END AS severity),
  CASE WHEN step IN ('catalog_leaked', 'catalog_honeytoken', 'verified', 'app_path') THEN 'real' WHEN step = 'inconclusive' THEN 'unknown' ELSE 'fixture' END AS verdict,
  CASE step {' '.join(f'WHEN {q(k)} THEN {v}::DOUBLE' for k, v in CONFIDENCE.items())} END AS confidence,
  CASE WHEN starts_with(step, 'catalog') THEN concat('known value: ', catalog_id) WHEN step = 'verified' THEN concat('verified with ', provider) WHEN step = 'invalid' THEN concat(provider, ' rejects it')
    WHEN step <> 'inconclusive' THEN concat('heuristic: ', step) WHEN status = 'unverified' THEN concat('inconclusive; ', provider, ' could not tell: ', coalesce(status_reason, '')) ELSE 'inconclusive; not verified' END AS reason FROM stepped)"""


def build() -> dict[str, str]:
    from .queries import NOW, SALT

    F = "WITH " + findings(CORPUS)
    V = f"{F}, {VERIFIERS}, {RESPONSES}, {TOLD}"
    J = f"{V}, {JUDGED}"
    A = f"{J}, {CATALOG}, {LOOKUP}, {ladder()}, a AS (SELECT *, {hmac('match', SALT)} AS fingerprint FROM full_)"
    OLD = f"""{A}, old AS (SELECT fingerprint, kind, 'old' AS key_preview, CASE WHEN d < '4' THEN 'rotated' WHEN d < '8' THEN 'ignored' ELSE 'active' END AS status, TIMESTAMP '2023-01-01' AS first_seen_at,
      NULL::TIMESTAMP AS last_verified_at, 2 AS verification_attempts, d < '6' AS ever_verified, 'old/path' AS first_path, 1 AS first_line
      FROM (SELECT fingerprint, min(pattern) AS kind, substr(md5(fingerprint), 2, 1) AS d FROM a GROUP BY 1 HAVING substr(md5(fingerprint), 1, 1) < '8'))"""
    place = '(path, line, "column", pattern_ord)'

    def merge(old: str) -> str:
        return f"""SELECT fingerprint, coalesce(b.kind, s.f.pattern) AS kind, coalesce(b.key_preview, s.f.preview) AS key_preview,
  CASE WHEN n IS NULL THEN b.status WHEN last_v THEN 'active' WHEN coalesce(b.ever_verified, false) OR any_v THEN 'rotated' WHEN any_f THEN 'fixture' ELSE coalesce(b.status, 'active') END AS status,
  coalesce(b.first_seen_at, TIMESTAMP '{NOW}') AS first_seen_at, CASE WHEN any_v THEN TIMESTAMP '{NOW}' ELSE b.last_verified_at END AS last_verified_at,
  (coalesce(b.verification_attempts, 0) + coalesce(n, 0))::INT AS verification_attempts, coalesce(b.ever_verified, false) OR coalesce(any_v, false) AS ever_verified,
  coalesce(b.first_path, s.f.path) AS first_path, coalesce(b.first_line, s.f.line)::INT AS first_line
FROM {old} b FULL OUTER JOIN (SELECT fingerprint, count(*) AS n, bool_or(coalesce(status = 'verified', false)) AS any_v, bool_or(verdict = 'fixture') AS any_f, arg_max(coalesce(status = 'verified', false), {place}) AS last_v,
  arg_min(struct_pack(pattern := pattern, preview := {REDACTED.format('match')}, path := path, line := line), {place}) AS f FROM a GROUP BY 1) s USING (fingerprint)"""

    out: dict[str, str] = {}
    docs = f"WITH {DOCS}, {LINES}"
    out["doc_lines"] = f"{docs} SELECT path, line::INT AS line, strlen(lines[line])::BIGINT AS n_bytes, md5(lines[line]) AS digest FROM numbered"
    out["long_line_skip_stats"] = f"WITH {CORPUS.replace('files AS', 'kept AS')}, files AS (SELECT path, text FROM kept UNION ALL SELECT concat('docs_', doc_id, '.txt'), text FROM documents), {LINES} SELECT count(*) AS lines, count(*) FILTER (WHERE strlen(lines[line]) > 8192) AS long_lines, sum(strlen(lines[line]))::BIGINT AS bytes FROM numbered"
    scanned = f"WITH {findings(DOCS)} SELECT path, line::INT AS line, \"column\", pattern, {REDACTED.format('match')} AS match_redacted FROM f"
    out["scan_documents"] = out["stream_scan"] = scanned
    out["scan_corpus_all_patterns"] = f"{F} SELECT path, line::INT AS line, \"column\", match, pattern, severity, array_to_string(context, chr(10)) AS context FROM f"
    out["pattern_counts"] = f"{F} SELECT pattern, severity, count(*) AS n, count(DISTINCT match) AS n_values, count(DISTINCT path) AS n_files FROM f GROUP BY ALL"
    out["scan_overlap_pairs"] = f"{F} SELECT a.pattern AS first_pattern, b.pattern AS second_pattern, count(*) AS n FROM f a JOIN f b USING (path, line, match) WHERE a.pattern_ord < b.pattern_ord GROUP BY ALL"
    out["prefilter_selectivity"] = f"{F} SELECT (SELECT count(*) FROM numbered) AS lines, (SELECT count(*) FROM cand) AS candidates"
    out["pragma_suppressed"] = f"{F} SELECT path, line::INT AS line, \"column\", match, pattern, severity FROM found WHERE hushed"
    out["pragma_rows"] = f"WITH {CORPUS}, {LINES} SELECT path, line::INT AS line, unnest({PRAGMA.format('lines[line]')}) AS pattern_id FROM numbered"
    out["path_filter"] = f"WITH {CORPUS} SELECT path, {SCANNED} AS scanned, {FIXTURE} AS fixture_path, {LANGUAGE} AS language FROM corpus"
    out["redacted_view"] = f"{A} SELECT path, line::INT AS line, \"column\", {REDACTED.format('match')} AS match_redacted, pattern, severity, verdict, reason, confidence, status, provider, fingerprint FROM a"
    out["fingerprint_hmac"] = f"{F} SELECT md5(match) AS digest, {hmac('match', SALT)} AS fingerprint FROM (SELECT DISTINCT match FROM f)"
    out["catalog_lookup"] = f"{F}, {CATALOG}, j AS (SELECT * FROM f), {LOOKUP} SELECT catalog_id, catalog_verdict, pattern, count(*) AS n FROM c WHERE catalog_id IS NOT NULL GROUP BY ALL"
    out["classify_ladder"] = f"{A} SELECT path, line::INT AS line, \"column\", pattern, severity, step, verdict, confidence, reason FROM a"
    offline = "(SELECT *, NULL::VARCHAR AS catalog_id, NULL::VARCHAR AS catalog_verdict, NULL::VARCHAR AS status, NULL::VARCHAR AS provider, NULL::VARCHAR AS status_reason FROM f)"
    out["classify_offline"] = f"{F}, {ladder(offline)} SELECT pattern, step, verdict, count(*) AS n, avg(confidence) AS confidence FROM full_ GROUP BY ALL"
    out["verdict_summary"] = f"{A} SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'real') AS real, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) FILTER (WHERE verdict = 'unknown') AS unknown FROM a"
    out["severity_verdict_rollup"] = f"{A} SELECT severity, verdict, count(*) AS n FROM a GROUP BY ROLLUP (severity, verdict)"
    out["per_path_groups"] = f"{A} SELECT path, count(*) AS n, string_agg(pattern, ',' ORDER BY line, \"column\", pattern_ord) AS patterns FROM a GROUP BY path"
    out["exit_codes"] = f"""{OLD}, s AS (SELECT bool_or(verdict = 'real') AS r, bool_or(verdict <> 'fixture') AS y, coalesce(bool_or(status = 'verified'), false) AS v FROM a), e AS (SELECT bool_or(ever_verified) AS ever FROM old)
SELECT mode, code::INT AS code FROM (SELECT unnest(['none', 'any', 'real', 'verified', 'best_effort', 'only_verified', 'ever_verified']) AS mode, unnest([false, y, r, v, r, v, v OR ever]) AS code FROM s, e)"""
    dims = ", ".join(f"({p.ord}, {q(p.id)}, {q(p.severity)}, {p.locked}, {q(p.regex)})" for p in patterns())
    dim = f"dim(pattern_ord, pattern, severity, locked, regex) AS (VALUES {dims})"
    out["pattern_dim"] = f"WITH {dim} SELECT pattern_ord::INT AS pattern_ord, pattern, severity, locked, regex FROM dim"
    out["verifier_dim"] = f"WITH {VERIFIERS} SELECT pattern, provider, ord::INT AS ord FROM verifiers"
    out["patterns_without_verifier"] = f"WITH {dim}, {VERIFIERS} SELECT pattern, severity FROM dim WHERE pattern NOT IN (SELECT pattern FROM verifiers)"
    out["provider_rules"] = "SELECT * FROM (VALUES " + ", ".join(f"({q(n)}, {q(s)}, {q(x)})" for n, _, s, x in PROVIDERS) + ") t(provider, invalid_statuses, kept_fields)"
    out["verify_outcomes"] = f"{V} SELECT provider, status, status_reason, count(*) AS n FROM said GROUP BY ALL"
    out["best_outcome"] = f"{J} SELECT path, line::INT AS line, \"column\", pattern, provider, status, status_reason FROM j"
    host = "regexp_extract(concat(array_to_string(context, chr(10)), chr(10), match), {}, 1)"
    out["paired_host"] = f"{F} SELECT provider, arg_min(host, place) AS host FROM (" + " UNION ALL ".join(f"SELECT {q(n)} AS provider, {host.format(q(r))} AS host, {place} AS place FROM f" for n, r in (("shopify", r"([a-zA-Z0-9][a-zA-Z0-9-]*\.myshopify\.com)"), ("databricks", r"([a-zA-Z0-9-]+\.cloud\.databricks\.com|adb-[0-9]+\.[0-9]+\.azuredatabricks\.net)"))) + ") WHERE host <> '' GROUP BY provider"
    out["paired_secret"] = f"{F} SELECT pattern, md5(arg_max(match, {place})) AS digest FROM f WHERE pattern IN ('aws_secret_key', 'aws_session_token') GROUP BY pattern"
    out["baseline_merge"] = f"{OLD} {merge('old')}"
    out["baseline_merge_initial"] = f"{OLD} {merge('(SELECT * FROM old WHERE false)')}"
    out["baseline_new"] = f"{OLD} SELECT path, line::INT AS line, \"column\", pattern, fingerprint FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM old)"
    out["baseline_present"] = f"{OLD} SELECT fingerprint, status, ever_verified FROM old WHERE fingerprint IN (SELECT fingerprint FROM a)"
    out["baseline_stats"] = f"{OLD}, here AS (SELECT * FROM old WHERE fingerprint IN (SELECT fingerprint FROM a)) SELECT (SELECT count(*) FROM a) AS findings, (SELECT count(*) FROM a WHERE fingerprint NOT IN (SELECT fingerprint FROM old)) AS new, (SELECT count(*) FROM here) AS present, (SELECT count(*) FROM here WHERE ever_verified) AS ever_verified, (SELECT count(*) FROM here WHERE status = 'rotated') AS rotated"
    out["history_events"] = f"""{A} SELECT TIMESTAMP '{NOW}' AS ts, event, fingerprint, NULL::VARCHAR AS "commit", path, line::INT AS line, CASE WHEN event = 'VERIFIED_LIVE' THEN concat('{{"provider":"', provider, '","method":"live_api_call"}}') END AS extra
FROM (SELECT *, unnest(CASE WHEN status = 'verified' THEN ['DETECTED', 'VERIFIED_LIVE'] ELSE ['DETECTED'] END) AS event FROM a)"""
    take = "nullif(regexp_extract({0}, {1}, 1), '')"
    name = f"""regexp_replace(regexp_replace(upper(coalesce({take.format('source', q(r'\b([A-Z][A-Z0-9_]+)\s*[:=]'))}, {take.format('source', q(r'\b([a-z_][a-z0-9_]*)\s*[:=]'))},
  regexp_replace({take.format('source', q(r'\b([a-zA-Z_][a-zA-Z0-9_]*)\s*:'))}, '(.)([A-Z])', '\\1_\\2', 'g'), pattern)), '[^A-Z0-9_]', '_', 'g'), '^_+|_+$', '', 'g')"""
    call = "CASE language " + " ".join(f"WHEN {q(n)} THEN " + "concat(" + ", ".join(q(x) for x in _around(c)).replace("'\x00'", "env_var") + ")" for n, c in CALLS.items()) + " END"

    def put(target: str) -> str:
        return f"WHEN contains(source, {target}) THEN concat(left(source, instr(source, {target}) - 1), call, substr(source, instr(source, {target}) + length({target})))"

    propose = f"""{A}, sourced AS (SELECT *, {LANGUAGE} AS language, list_filter(context, lambda x: contains(x, match))[1] AS source FROM a WHERE verdict IN ('real', 'unknown')),
named AS (SELECT *, {name} AS env_var FROM sourced WHERE source IS NOT NULL), called AS (SELECT *, {call} AS call FROM named),
p AS (SELECT *, CASE {put("concat('''', match, '''')")} {put("concat('\"', match, '\"')")} {put('match')} ELSE source END AS new_line FROM called WHERE call IS NOT NULL)"""
    seed = {b: "concat(" + ", ".join(_seed(t)) + ")" for b, t in SEEDS.items()}
    out["rewrite_lines"] = f"{propose} SELECT path, line::INT AS line, \"column\", pattern, env_var, language, replace(source, match, {REDACTED.format('match')}) AS old_line, new_line, concat(env_var, '=') AS env_example_line, {seed['env']} AS seed_command FROM p WHERE new_line <> source"
    out["env_example_entries"] = f"{propose} SELECT DISTINCT concat(env_var, '=') AS env_example_line FROM p WHERE new_line <> source AND NOT contains('PASSWD=' || chr(10), env_var)"
    out["seed_commands"] = f"{propose} SELECT DISTINCT env_var, {', '.join(f'{x} AS {b}' for b, x in seed.items())} FROM p WHERE new_line <> source"
    out["sarif_results"] = f"{A} SELECT pattern AS rule_id, CASE WHEN verdict = 'fixture' THEN 'note' WHEN verdict = 'unknown' THEN 'warning' WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, concat(pattern, ': ', {REDACTED.format('match')}, ' (', verdict, ')') AS message, path AS uri, line::INT AS start_line, \"column\" AS start_column FROM a"
    place_of = "row_number() OVER (ORDER BY string_split(path, '/'), line, \"column\", pattern_ord) - 1"
    out["prompt_candidates"] = f"{F} SELECT ({place_of})::VARCHAR AS id, path, line::INT AS line, \"column\", pattern, severity, {REDACTED.format('match')} AS match_redacted, array_to_string(list_transform(context, lambda x: replace(x, match, {REDACTED.format('match')})), chr(10)) AS context FROM f"
    out["findings_in_order"] = f"{F} SELECT path, line::INT AS line, \"column\", pattern, {place_of} AS nth FROM f"
    out["cache_keys"] = f"{F} SELECT path, line::INT AS line, \"column\", pattern, sha256(concat(pattern, chr(0), {REDACTED.format('match')}, chr(0), array_to_string(list_transform(context, lambda x: concat(x, chr(10))), ''))) AS cache_key FROM f"
    out["only_verified"] = f"{A} SELECT path, line::INT AS line, \"column\", pattern, provider FROM a WHERE status = 'verified'"
    out["shown_confidence"] = f"{A} SELECT pattern, verdict, round(confidence * 100)::INT AS percent, count(*) AS n FROM a GROUP BY ALL"
    out["catalog_counts"] = f"WITH {CATALOG} SELECT strategy, verdict, count(*) AS n, count(DISTINCT kind) AS n_kinds FROM entries GROUP BY ALL"
    answered = "CASE id WHEN 1 THEN {} WHEN 2 THEN {} WHEN 7 THEN {} ELSE {} END"
    out["apply_host_verdicts"] = f"""{A}, numbered_ AS (SELECT *, {place_of} AS id FROM a) SELECT id, path, line::INT AS line, "column", pattern, {answered.format("'fixture'", "'unknown'", "'real'", 'verdict')} AS verdict,
  {answered.format("'later'", 'NULL', 'NULL', 'reason')} AS reason, {answered.format('0.75', 'NULL', 'NULL', 'confidence')}::DOUBLE AS confidence FROM numbered_"""
    out["org_union"] = f"{A} SELECT repo, pattern, count(*) AS n, count(DISTINCT concat(repo, '/', path)) AS n_files FROM a, (SELECT unnest(['acme/one', 'acme/two']) AS repo) GROUP BY ALL"
    git = f"""WITH patch AS ({PATCH_SQL.format(orders='orders')}), commits AS (SELECT repo, unnest(string_split(text, chr(1))) AS patch FROM patch),
split AS (SELECT repo, row_number() OVER () AS seq, regexp_extract(patch, '^([^\\x1f\\n]*)', 1) AS sha, regexp_extract(patch, '^[^\\x1f\\n]*\\x1f([^\\n]*)', 1) AS subject, string_split(patch, chr(10)) AS raws FROM commits WHERE patch <> ''),
rows_ AS (SELECT repo, seq, sha, subject, unnest(raws) AS raw, generate_subscripts(raws, 1) AS n FROM split),
file_ AS (SELECT *, sum(CASE WHEN starts_with(raw, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY n) AS file FROM rows_ WHERE n > 1),
hunk_ AS (SELECT *, sum(CASE WHEN starts_with(raw, '@@ ') THEN 1 ELSE 0 END) OVER (PARTITION BY seq, file ORDER BY n) AS hunk FROM file_),
path_ AS (SELECT *, max(CASE WHEN hunk = 0 AND starts_with(raw, '+++ b/') THEN substr(raw, 7) END) OVER (PARTITION BY seq, file ORDER BY n) AS path, max(CASE WHEN starts_with(raw, '@@ ') THEN regexp_extract(raw, '\\+([0-9]+)', 1)::INT END) OVER (PARTITION BY seq, file, hunk) AS first FROM hunk_),
line_ AS (SELECT *, first + sum(CASE WHEN regexp_matches(raw, '^[+ ]') THEN 1 ELSE 0 END) OVER (PARTITION BY seq, file, hunk ORDER BY n) - 1 AS line FROM path_ WHERE hunk > 0),
added AS (SELECT repo, sha, subject, path, line::INT AS line, substr(raw, 2) AS text FROM line_ WHERE starts_with(raw, '+') AND path IS NOT NULL)"""
    # Places of commits within a repository's text aren't compared: the query numbers them by patch.
    out["git_added_lines"] = f"{git} SELECT repo, sha, subject, path, line, text FROM added"
    parts = " UNION ALL ".join(f"SELECT repo, sha, subject, path, line, {q(p.id)} AS pattern, {p.ord} AS ord, regexp_extract_all(text, {q(p.gap)}, 1) AS b, regexp_extract_all(text, {q(p.gap)}, 2) AS v FROM added WHERE regexp_matches(text, {q(p.regex)})" for p in patterns())
    out["git_scan"] = f"{git}, hits AS ({parts}) SELECT repo, sha, subject, path, line, (strlen(b[1]) + 1)::INT AS \"column\", pattern, md5(v[1]) AS digest FROM hits"
    out["per_commit_groups"] = f"{git}, hits AS ({parts}) SELECT repo, left(sha, 8) AS \"commit\", path, count(*) AS n, string_agg(pattern, ',' ORDER BY line, strlen(b[1]), ord) AS patterns FROM hits GROUP BY repo, sha, path"
    out["verification_requests"] = _requests(F, place, host)
    # The rules as expressions written out by hand.
    out["ignored_paths"] = f"""WITH corpus AS ({CORPUS_SQL.format(orders='orders')}),
rules(folder, kind, line, rule, regex, back, folders) AS (VALUES
  ('', 1, 0, '*.js', '^(.*/)?[^/]*\\.js$', false, false), ('', 1, 1, '!x_7*.js', '^(.*/)?x_7[^/]*\\.js$', true, false), ('', 1, 2, '/docs/', '^docs$', false, true),
  ('', 1, 4, 'svc_1*/', '^(.*/)?svc_1[^/]*$', false, true), ('', 1, 5, '!svc_1*/.env.local', '^svc_1[^/]*/\\.env\\.local$', true, false),
  ('lib', 0, 0, concat('!x_3*.js', chr(13)), '^(.*/)?x_3[^/]*\\.js$', true, false), ('lib', 0, 1, 'x_31*.js', '^(.*/)?x_31[^/]*\\.js$', false, false),
  ('app', 1, 0, 'config_?.rb  ', '^(.*/)?config_[^/]\\.rb$', false, false), ('app', 1, 1, 'config_1[0-4]*.rb', '^(.*/)?config_1[0-4][^/]*\\.rb$', false, false), ('app', 1, 2, '!config_12*.rb', '^(.*/)?config_12[^/]*\\.rb$', true, false),
  ('', 2, 0, 'spec/**', '^spec/.+$', false, false), ('', 2, 1, 'infra/*_1*.yaml', '^infra/[^/]*_1[^/]*\\.yaml$', false, false)),
every AS (SELECT * FROM rules UNION ALL SELECT concat('svc_', o_orderkey), 1, 0, '.env*', '^(.*/)?\\.env[^/]*$', false, false FROM orders WHERE o_orderkey % 9 = 5 AND o_orderkey % 4 = 0
  UNION ALL SELECT concat('svc_', o_orderkey), 1, 1, '!.env.local', '^(.*/)?\\.env\\.local$', true, false FROM orders WHERE o_orderkey % 9 = 5 AND o_orderkey % 8 = 0),
parts AS (SELECT path, string_split(path, '/') AS p FROM corpus),
entries AS (SELECT path, n < len(p) AS is_folder, array_to_string(p[1:n], '/') AS entry, p[1:n] AS e FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS n FROM parts)),
folders AS (SELECT DISTINCT entry, is_folder, array_to_string(e[1:m], '/') AS folder FROM (SELECT entry, is_folder, e, unnest(range(0, len(e))) AS m FROM entries)),
hits AS (SELECT entry, is_folder, back, rule, row_number() OVER (PARTITION BY entry, is_folder ORDER BY kind, length(folder) DESC, line DESC) AS nth FROM folders JOIN every USING (folder)
  WHERE regexp_matches(CASE WHEN folder = '' THEN entry ELSE substr(entry, length(folder) + 2) END, regex) AND (is_folder OR NOT folders)),
gone AS (SELECT path, arg_min(entry, length(entry)) AS decided_at, arg_min(rule, length(entry)) AS rule FROM entries JOIN hits USING (entry, is_folder) WHERE nth = 1 AND NOT back GROUP BY path)
SELECT DISTINCT path, decided_at IS NOT NULL AS ignored, decided_at, rule FROM corpus LEFT JOIN gone USING (path)"""
    return out


def _around(call: str) -> list[str]:
    """A call's text cut at its variable, with a mark where the name goes."""
    mark = {"System.getenv": '"N"', "os.Getenv": '"N"'}
    for head, token in mark.items():
        if call.startswith(head):
            a, b = call.split(token)
            return [a + '"', "\x00", '"' + b]
    if call.startswith("std::"):
        return ['std::env::var("', "\x00", '").expect("missing ', "\x00", '")']
    for token in ("'N'", "{N}"):
        if token in call:
            a, b = call.split(token)
            return [a + token[0], "\x00", token[-1] + b]
    a, _, b = call.rpartition("N")
    return [a, "\x00", b] if b else [a, "\x00"]


def _seed(text: str) -> list[str]:
    words = {"N": "env_var", "D": "replace(lower(env_var), '_', '-')", "P": "concat('<paste-', lower(env_var), '-value-here>')"}
    return [words.get(x, q(x)) for x in re.split(r"\b([NDP])\b", text) if x]


def _padded(key: str, byte: int) -> str:
    return f"unhex(array_to_string(list_transform(range(0, 64), lambda i: format('{{:02x}}', xor(('0x' || substr({key}, 2 * i + 1, 2))::INT, {byte}))), ''))"


def _signed(key: str, message: str) -> str:
    """HMAC-SHA256 in hex; the key as 128 hex digits."""
    return f"sha256({_padded(key, 0x5C)} || unhex(sha256({_padded(key, 0x36)} || encode({message}))))"


def _requests(found: str, place: str, host: str) -> str:
    """What each provider is asked, from the table of endpoints; a signature in steps."""
    stamp, date = "20240102T030405Z", "20240102"
    body = next(e[5] for e in ENDPOINTS if e[0] == "aws")
    names = "concat('content-type;host;x-amz-date', CASE WHEN token IS NOT NULL THEN ';x-amz-security-token' ELSE '' END)"
    lines = f"concat('content-type:application/x-www-form-urlencoded; charset=utf-8', chr(10), 'host:sts.amazonaws.com', chr(10), 'x-amz-date:{stamp}', chr(10), CASE WHEN token IS NOT NULL THEN concat('x-amz-security-token:', token, chr(10)) ELSE '' END)"
    whole = f"concat('POST', chr(10), '/', chr(10), chr(10), {lines}, chr(10), {names}, chr(10), sha256({q(body)}))"
    scope = f"{date}/us-east-1/sts/aws4_request"
    shop = host.format(q(r"([a-zA-Z0-9][a-zA-Z0-9-]*\.myshopify\.com)"))
    steps = [
        f"paired AS (SELECT (SELECT arg_max(match, {place}) FROM f WHERE pattern = 'aws_secret_key') AS secret, (SELECT arg_max(match, {place}) FROM f WHERE pattern = 'aws_session_token') AS token, (SELECT arg_min(h, p) FROM (SELECT {shop} AS h, {place} AS p FROM f) WHERE h <> '') AS shop)",
        "k0 AS (SELECT *, rpad(hex(encode('AWS4' || secret)), 128, '0') AS k FROM paired)",
    ]
    for n, part in enumerate((date, "us-east-1", "sts", "aws4_request")):
        steps.append(f"k{n + 1} AS (SELECT * EXCLUDE k, rpad({_signed('k', q(part))}, 128, '0') AS k FROM k{n})")
    to_sign = f"concat('AWS4-HMAC-SHA256', chr(10), '{stamp}', chr(10), '{scope}', chr(10), sha256({whole}))"
    steps.append(f"signed AS (SELECT *, {names} AS names, {_signed('k', to_sign)} AS signature FROM k4)")
    parts = []
    for provider, method, url, sends, headers, text in ENDPOINTS:
        handled = next(p[1] for p in PROVIDERS if p[0] == provider).split()
        said = {k: q(v) for k, v in headers.items()}
        missing = {"twilio": "'TWILIO_AUTH_TOKEN'", "shopify": "CASE WHEN shop IS NULL THEN 'SHOPIFY_DOMAIN' END", "databricks": "'DATABRICKS_HOST'", "aws": "CASE WHEN secret IS NULL THEN 'AWS_SECRET_ACCESS_KEY' END"}.get(provider, "NULL")
        kind, _, rest = sends.partition(" ")
        if kind == "bearer":
            said["Authorization"] = "concat('Bearer ', match)"
        elif kind == "header":
            said[rest] = "match"
        elif kind == "basic":
            a, b = rest.split("M", 1)
            said["Authorization"] = f"concat('Basic ', to_base64(encode(concat({q(a)}, match, {q(b)}))))"
        else:
            said |= {"x-amz-date": q(stamp), "authorization": f"concat('AWS4-HMAC-SHA256 Credential=', match, '/{scope}, SignedHeaders=', names, ', Signature=', signature)"}
        shown = ", chr(10), ".join(f"'{k}=', {v}" for k, v in sorted(said.items()))
        if kind == "signed":
            shown += ", CASE WHEN token IS NOT NULL THEN concat(chr(10), 'x-amz-security-token=', token) ELSE '' END"
        address = f"replace({q(url)}, '{{SHOPIFY_DOMAIN}}', coalesce(shop, ''))"
        parts.append(f"SELECT {q(provider)} AS provider, pattern, md5(match) AS digest, {missing} AS lacks, {q(method)} AS method, {address} AS url, md5(concat({shown})) AS headers, {'NULL' if text is None else q(text)} AS body FROM (SELECT DISTINCT pattern, match FROM f), signed WHERE pattern IN ({', '.join(map(q, handled))})")
    made = ", ".join(f"CASE WHEN lacks IS NULL THEN {c} END AS {c}" for c in ("method", "url", "headers", "body"))
    return f"{found}, {', '.join(steps)}, asked AS ({' UNION ALL '.join(parts)}) SELECT provider, pattern, digest, {made}, lacks || ' not found near the value' AS missing FROM asked"
