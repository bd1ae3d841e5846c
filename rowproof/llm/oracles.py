"""DuckDB SQL for those of the twelve queries that SQL can express."""

from .license_rules import rules

_TWO = "'co.uk','org.uk','ac.uk','gov.uk','com.au','net.au','org.au','co.nz','co.jp','or.jp','com.br','com.cn','com.mx','com.ar','co.in','co.za','com.tr','co.kr'"


def _level(name: str, source: str, k: str, n: str, mean: str, keep: str, out: str) -> str:
    """One level of shrinkage: strength by moments, then posterior mean and deviation."""
    return f"""
{name}_f AS (SELECT sum({n} * ({k} / {n} - {mean}) * ({k} / {n} - {mean}) - {mean} * (1 - {mean})) AS over, sum({mean} * (1 - {mean}) * ({n} - 1)) AS room FROM {source} WHERE {n} > 0),
{name}_r AS (SELECT round(least(greatest(CASE WHEN room <> 0 THEN coalesce(over, 0) / room ELSE 0 END, 0.001), 0.5), 6) AS rho FROM {name}_f),
{name}_s AS (SELECT coalesce((SELECT (1 - rho) / rho FROM {name}_r), 999.0) AS m),
{name}_p AS (SELECT s.*, m * {mean} + {k} AS pa, m * (1 - {mean}) + {n} - {k} AS pb FROM {source} s, {name}_s),
{name} AS (SELECT {keep}, pa / (pa + pb) AS {out}, sqrt(pa * pb / ((pa + pb) * (pa + pb) * (pa + pb + 1))) AS {out}_sd FROM {name}_p)"""


def _license() -> str:
    """Words stand between spaces of their own, so that a pattern with its outer spaces never shares one."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(lb)}, {p}, {c}, {quoted(' ' + k)}, {quoted(' (?:' + r.replace(' ', '  ') + ') ')})" for lb, p, c, k, r in rules())
    return rf"""
WITH rules(label, prio, conf, kw, pat) AS (VALUES {table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(regexp_replace(' ' || coalesce(text, '') || ' ', '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
w AS (SELECT rid, doc_id, s, length(s) - length(replace(s, ' ', '')) - 1 AS n_words, CASE WHEN s = ' ' THEN '' ELSE ' ' || replace(s[2:-2], ' ', '  ') || ' ' END AS ss FROM d),
hit AS (SELECT rid, label, prio, conf, ss, string_split_regex(ss, pat) AS pieces, regexp_extract_all(ss, pat) AS found FROM w JOIN rules ON contains(s, kw)),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hit),
sp AS (SELECT rid, label, prio, conf, ss, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS start, length(found[i]) AS n FROM each),
ivs AS (SELECT *, start + n AS stop FROM sp),
base AS (SELECT rid, count(*) AS n_base, min((start - length(replace(ss[1:start], ' ', ''))) // 2) AS first_word, max((start - length(replace(ss[1:start], ' ', ''))) // 2) AS last_word FROM (SELECT rid, ss, CAST(start AS BIGINT) AS start FROM ivs WHERE prio = 0) b GROUP BY rid),
kept AS (SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY rid ORDER BY start, stop DESC, prio DESC, label, conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ivs) k WHERE reach IS NULL OR stop > reach),
lab AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM kept UNION SELECT rid, label FROM ivs WHERE prio = 0) u GROUP BY rid),
blab AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM ivs WHERE prio = 0 GROUP BY rid),
sc AS (SELECT rid, max(conf) AS score FROM kept GROUP BY rid)
SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN blab USING (rid) LEFT JOIN lab USING (rid) LEFT JOIN sc USING (rid)"""


SQL = {
    "op3_license_scan": _license(),
    "op2_url_reputation": rf"""
WITH pg AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, TRY_CAST(regexp_extract(url, '(?s)^.*?://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) AS number FROM pages),
lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
cnt AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM pg LEFT JOIN lab ON number = doc_id GROUP BY host),
hp AS (SELECT host, n, k, string_split(host, '.') AS parts FROM cnt),
hs AS (SELECT host, n, k, CASE WHEN array_to_string(parts[-2:], '.') IN ({_TWO}) THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
  CASE WHEN array_to_string(parts[-2:], '.') IN ({_TWO}) THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM hp),
dm AS (SELECT domain, suffix, sum(n) AS dn, sum(k) AS dk FROM hs GROUP BY ALL),
sf AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk, (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) FROM hs) AS base FROM dm GROUP BY suffix),
{_level('s', 'sf', 'sk', 'sn', 'base', 'suffix', 'smean')},
dj AS (SELECT * FROM dm JOIN s USING (suffix)),
{_level('d', 'dj', 'dk', 'dn', 'smean', 'domain', 'dmean')},
hj AS (SELECT * FROM hs JOIN d USING (domain)),
{_level('h', 'hj', 'k', 'n', 'dmean', 'host', 'rate')},
rules(verdict, rule, rh, rp) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
fit AS (SELECT pg.*, (SELECT arg_max({{'rule': rule, 'verdict': verdict}}, length(rule)) FROM rules WHERE (pg.host = rh OR ends_with(pg.host, '.' || rh)) AND starts_with(pg.path, rp)) AS r FROM pg)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN round(rate - 1.645 * rate_sd, 6) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 6) AS host_rate, round(rate - 1.645 * rate_sd, 6) AS host_bound
FROM fit JOIN h USING (host)""",
    "op9_mixing": r"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS tokens FROM documents),
every AS (SELECT source, sum(tokens) AS total, count(*) AS n FROM t GROUP BY source),
tot AS (SELECT source, total, n FROM every WHERE total > 0),
al AS (SELECT sum(total) AS b, count(*) AS k FROM tot),
sh AS (SELECT source, total, total / b AS p FROM tot, al),
e(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM
  (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * (lo + hi) / 2 * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM sh) >= 0.98 * ln((SELECT k FROM al)) AS ok FROM e WHERE i < 40) q),
r(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) UNION ALL SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM
  (SELECT i, lo, hi, (lo + hi) / 2 AS mid, (SELECT max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) FROM sh) > 4.0 AS ok FROM r WHERE i < 40) q),
x AS (SELECT CASE WHEN (SELECT k FROM al) < 2 THEN 1.0 ELSE round(greatest((SELECT lo FROM e WHERE i = 40), (SELECT lo FROM r WHERE i = 40)), 4) END AS a),
w AS (SELECT source, total, n, CASE WHEN total > 0 THEN CAST(floor(round(pow(CAST(total AS DOUBLE), a) / (SELECT sum(pow(CAST(total AS DOUBLE), a)) FROM tot, x) * b, 3)) AS BIGINT) ELSE 0 END AS goal FROM every, x, al),
pl AS (SELECT source, CASE WHEN total > 0 THEN goal // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN goal - (goal // total) * total ELSE 0 END AS rest, CAST(ceil(greatest(total, n) / 32768) AS BIGINT) AS blocks FROM w),
dealt AS (SELECT t.*, whole, rest, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % blocks AS part FROM t JOIN pl USING (source)),
bl AS (SELECT source, part, sum(tokens) AS size, any_value(whole) AS whole, any_value(rest) AS rest FROM dealt GROUP BY ALL),
us AS (SELECT *, unnest(range(0, CAST(whole + 1 AS BIGINT))) AS epoch FROM bl),
ord AS (SELECT *, row_number() OVER v AS block, coalesce(sum(size) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM us WINDOW v AS (PARTITION BY source, epoch ORDER BY md5('mix:' || source || ':' || part || ':' || epoch), part)),
room AS (SELECT source, part, epoch, block, size, whole, CASE WHEN epoch < whole THEN size ELSE rest - before END AS room FROM ord),
pos AS (SELECT d.doc_id, d.source, d.tokens, r.epoch, r.block, r.size, r.room, row_number() OVER v AS position, sum(d.tokens) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM dealt d JOIN room r ON d.source = r.source AND d.part = r.part AND (r.room > 0 OR r.epoch < r.whole) WINDOW v AS (PARTITION BY d.source, d.part, r.epoch ORDER BY md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || r.epoch), d.doc_id, d.tokens))
SELECT doc_id, source, tokens, epoch, block, position FROM pos WHERE room >= size OR upto <= room""",
    "op5_exact_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
     r AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
                  row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) AS rn FROM t)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r""",
    "op11_target_resample": r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
hx AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM w UNION SELECT w FROM bw)),
bk AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS b FROM hx, tab),
s AS (SELECT b, count(*) AS s FROM w JOIN bk USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bk USING (w) GROUP BY b),
al AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ss, coalesce((SELECT sum(t) FROM t), 0) AS tt),
gain AS (SELECT r.b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (tt + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM (SELECT unnest(range(10000)) AS b) r LEFT JOIN s USING (b) LEFT JOIN t USING (b), al),
f AS (SELECT rid, count(*) AS n, sum(g) AS g FROM w JOIN bk USING (w) JOIN gain USING (b) GROUP BY rid),
sc AS (SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(g, 0) AS BIGINT) AS weight,
  CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN f USING (rid)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM sc),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) END AS r, count(*) FILTER (n_features >= 20) OVER () AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM o""",
    "op12_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) q),
e AS (SELECT *, regexp_replace(text, '(<|\[)(\\*(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]))', '\1\\\2', 'g') AS shown, regexp_replace(role, '(<|\[)(\\*(?:/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TEXT\]))', '\1\\\2', 'g') AS name FROM c),
r AS (SELECT *, CASE role WHEN 'assistant' THEN ' ' || shown || '</s>' WHEN 'system' THEN '[SYS] ' || shown || ' [/SYS]' WHEN 'user' THEN '[INST] ' || shown || ' [/INST]'
  ELSE '[ROLE] ' || name || ' [TEXT] ' || shown || ' [/ROLE]' END AS piece FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(piece)) AS BIGINT) AS formatted_chars FROM r GROUP BY conv_id""",
}
