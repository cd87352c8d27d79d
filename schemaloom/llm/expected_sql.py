"""DuckDB SQL for the queries that SQL can express. The others are tested against brute force."""

from __future__ import annotations

from schemaloom.llm import clustering as C
from schemaloom.llm import url_filter as U
from schemaloom.llm.line_dedup import MIN_SITES
from schemaloom.llm.queries import WEIGHTS

_WORD = r"[^\x20\x09-\x0D]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINES = rf"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
line AS (SELECT doc_id, source, unnest(range(len(parts))) AS pos, unnest(parts) AS raw FROM split),
trimmed AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM line),
wide AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM trimmed WHERE line <> '' GROUP BY line
         HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT t.*, w.first IS NOT NULL AND (w.first.d <> t.doc_id OR w.first.p <> t.pos) AS gone
           FROM trimmed t LEFT JOIN wide w ON t.line = w.line),
kept AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS gone,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN sha256(k.text) END
AS kept_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS size, sha1(html) AS sha FROM p),
g AS (SELECT *, min(page_id) OVER (PARTITION BY sha, size) AS first FROM h)
SELECT page_id, size AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr(
'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT)
>> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> first THEN first END AS refers_to, true AS intact FROM g"""


def _url() -> str:
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rules = sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    kind = " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in rules)

    listed = "two IN (" + ", ".join(f"'{x}'" for x in U.SUFFIXES) + ")"
    address = r"regexp_matches(site, '^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$')"

    def level(name: str, table: str, above: str, key: str) -> str:
        return f"""
{name}_m AS (SELECT n.*, a.alpha / (a.alpha + a.beta) AS mean, a.trials AS above FROM {table} n JOIN {above} a USING ({key})),
{name}_s AS ({moments(f'{name}_m')}),
{name}_p AS (SELECT m.*, w * mean + bad AS alpha, w * (1 - mean) + trials - bad AS beta FROM {name}_m m, {name}_s)"""

    def moments(t: str) -> str:
        return f"""SELECT CASE WHEN n < 3 OR NOT total - within > 0 THEN {U.WEIGHT} WHEN between_ <= within THEN {U.MOST}
            ELSE least({U.MOST}, greatest({U.LEAST}, (total - between_) / (between_ - within))) END AS w FROM (SELECT count(*) AS n,
            sum(trials * (bad / trials - mean) * (bad / trials - mean)) AS between_, sum(mean * (1 - mean)) AS within,
            sum(trials * mean * (1 - mean)) AS total FROM {t} WHERE trials > 0)"""

    return rf"""
WITH urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_AZ}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
seen AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS site FROM urls),
outcome AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
tried AS (SELECT site, count(bad) AS trials, coalesce(sum(bad), 0)::DOUBLE AS bad, CASE WHEN contains(site, '.') THEN
    split_part(site, '.', -2) || '.' || split_part(site, '.', -1) ELSE site END AS two
    FROM seen LEFT JOIN outcome ON page_id = doc_id GROUP BY site),
hosts AS (SELECT site, trials, bad, CASE WHEN {address} THEN site WHEN {listed} THEN two ELSE split_part(site, '.', -1) END AS suffix,
    CASE WHEN {address} THEN site WHEN {listed} AND site <> two THEN split_part(site, '.', -3) || '.' || two ELSE two END AS domain FROM tried),
domains AS (SELECT domain, suffix, sum(trials)::DOUBLE AS trials, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(trials) AS trials, sum(bad) AS bad FROM domains GROUP BY ALL),
suf_m AS (SELECT s.*, (SELECT CASE WHEN sum(trials) > 0 THEN sum(bad) / sum(trials) ELSE 0 END FROM suffixes) AS mean FROM suffixes s),
suf_s AS ({moments('suf_m')}),
suf_p AS (SELECT m.*, w * mean + bad AS alpha, w * (1 - mean) + trials - bad AS beta FROM suf_m m, suf_s),
{level('dom', 'domains', 'suf_p', 'suffix')}, {level('hst', 'hosts', 'dom_p', 'domain')},
judged AS (SELECT site, above > 0 AND alpha / (alpha + beta) - {U.BOUND} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    > {U.TOLERATED} AS bad_host FROM hst_p)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {kind} WHEN bad_host THEN 'block' ELSE 'allow' END AS verdict
FROM seen JOIN judged USING (site)"""


SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w WHERE len(words) >= 50),
windows AS (SELECT doc_id, s, md5(array_to_string(words[s:s + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM windows JOIN firsts USING (h) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM hit),
positions AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM positions p ANTI JOIN gone g ON p.doc_id = g.doc_id
    AND p.i = g.i GROUP BY p.doc_id), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id LEFT JOIN lost l ON w.doc_id = l.doc_id"""


def mixing(weights: dict, percent: int = 100, epochs: int = 2, seed: int = 42, docs: str = "documents", end: str = "") -> str:
    """The mixture's rows, or what `end` selects from them (as `mixed`)."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in weights[level].items()) + " ELSE 1 END" if weights.get(level) else "1"
    levels = ["domain", "lang", "source"]
    out = rf"""
rows AS (SELECT doc_id, coalesce(CASE CAST(nullif(regexp_extract(source, '(\d{{1,9}})$', 1), '') AS INT) % 3 WHEN 0 THEN 'web' WHEN 1
    THEN 'news' WHEN 2 THEN 'books' END, 'none') AS domain, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens FROM {docs}),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS HUGEINT) AS capacity FROM rows GROUP BY ALL),
b0 AS (SELECT least(sum(tokens) * {percent} // 100, sum(capacity)) AS budget FROM leaf)"""
    for k in (1, 2, 3):
        keys, parent = ", ".join(levels[:k]), ", ".join(levels[:k - 1])
        part, level = f"PARTITION BY {parent}" if parent else "", levels[k - 1]
        join = f"JOIN b{k - 1} USING ({parent})" if parent else ", b0"
        out += f""",
n{k} AS (SELECT {keys}, sum(capacity)::HUGEINT AS capacity, ({weight(level)})::HUGEINT AS weight FROM leaf GROUP BY {keys}),
s{k} AS (SELECT *, budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM n{k} {join}
    WINDOW o AS ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level})),
f{k} AS (SELECT *, min(CASE WHEN capacity * open <= room * weight THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND
    CURRENT ROW) AS filled FROM s{k} WINDOW o AS ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level})),
u{k} AS (SELECT *, max(CASE WHEN filled = 0 THEN room END) OVER (a) AS rest, max(CASE WHEN filled = 0 THEN open END) OVER (a) AS wide,
    sum(CASE WHEN filled = 0 THEN weight ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM f{k}
    WINDOW o AS ({part} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level}), a AS ({part})),
b{k} AS (SELECT {keys}, CASE WHEN filled = 1 THEN capacity ELSE (rest * upto)::HUGEINT // wide::HUGEINT - (rest * (upto - weight))::HUGEINT // wide::HUGEINT END::HUGEINT AS budget FROM u{k})"""
    out += f""",
plan AS (SELECT domain, lang, source, CAST(budget AS BIGINT) AS budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
summed AS (SELECT r.*, budget, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY
    md5('{seed}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) AS upto FROM rows r JOIN plan USING (domain, lang, source)),
mixed AS (SELECT doc_id, domain, lang, source, n_tokens, budget, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT)
    AS copies FROM summed)
"""
    return "WITH " + out.strip() + (end or "SELECT * FROM mixed")


EXACT = f"""
WITH r AS (SELECT doc_id, translate(coalesce(text, ''), {_AZ}) AS text, doc_id * 2 < (SELECT min(doc_id) + max(doc_id) FROM documents) AS old
    FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256,
bool_or(old) OVER g AS in_history FROM r WINDOW g AS (PARTITION BY text)"""


def clustering(k: int = C.CLUSTERS, rounds: int = C.ROUNDS) -> str:
    """All rounds written out; vectors and centroids are lists of whole numbers."""
    odd = "list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))"
    out = f"""
v0 AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({C.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE len(embedding) = {C.DIMENSIONS} AND NOT {odd}),
v AS MATERIALIZED (SELECT * FROM v0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{C.SEED}:' || vec_id), v) - 1 AS INTEGER) AS c, v AS w FROM v
    QUALIFY row_number() OVER (ORDER BY sha256('{C.SEED}:' || vec_id), v) <= {k})"""
    far = "CAST(list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    for i in range(rounds + 1):
        out += f""",
a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, {far} AS d FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
        if i < rounds:
            out += f""",
u{i} AS (SELECT c, unnest(range({C.DIMENSIONS})) AS j, unnest(v) AS x FROM a{i}),
m{i} AS (SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM u{i} GROUP BY c, j),
f{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS w FROM m{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(f{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN f{i} ON c{i}.c = f{i}.c)"""
    return f"""WITH {out.strip()}
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.w, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline
    out = {"op1_line_dedup": LINES, "op3_warc_convert": WARC, "op5_url_filter": _url(), "op8_substring_dedup": SUBSTRING,
           "op9_mixing": mixing(WEIGHTS), "op10_exact_dedup": EXACT, "op13_clustering": clustering()}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
