"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def quality_ctes(documents: str = "documents") -> str:
    """counted, merged, fenced and judged as WITH entries; judged has a row per document."""
    from keyweave.llm.quality import BASE_FAILED, FENCES, PRIOR, RATES, REACH

    rates = {k: v.replace(" div ", " // ") for k, v in RATES.items()}
    rows = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, {v} AS value FROM counted WHERE NOT ({BASE_FAILED})" for k, v in rates.items())
    low = lambda k: f"min(bin) FILTER (rate = '{k}' AND upto >= {FENCES[k].low} * n)"
    high = lambda k: f"min(bin) FILTER (rate = '{k}' AND upto >= {FENCES[k].high} * n)"
    spread = lambda k: f"{REACH} * greatest({high(k)} - {low(k)}, {FENCES[k].least})"
    sides = ", ".join(f"{high(k)} + {spread(k)} AS hi_{k}, {low(k)} - {spread(k)} AS lo_{k}" for k in FENCES)
    inside = " AND ".join(f"coalesce({v} <= hi_{k}, true)" + (f" AND coalesce({v} >= lo_{k}, true)" if FENCES[k].two_sided else "") for k, v in rates.items())
    return f"""
texts AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS text FROM {documents}),
words AS (SELECT uid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT uid, regexp_extract_all(text, '{WORD}') AS w FROM texts)),
windows AS (SELECT uid, pos, [word, lead(word) OVER o, lead(word, 2) OVER o] AS win, count(*) OVER (PARTITION BY uid) AS n FROM words WINDOW o AS (PARTITION BY uid ORDER BY pos)),
flagged AS (SELECT uid, pos, win[1] AS word, (pos <= n - 2 AND count(*) OVER (PARTITION BY uid, win) > 1)::INT AS again FROM windows),
covered AS (SELECT uid, word, max(again) OVER (PARTITION BY uid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS again FROM flagged),
by_word AS (SELECT uid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, sum(again)::BIGINT AS n_repeat_words FROM covered GROUP BY uid),
lines AS (SELECT uid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT uid, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '{WORD}') GROUP BY uid),
counted AS (SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM texts LEFT JOIN by_word USING (uid) LEFT JOIN lines USING (uid)),
rates AS ({rows}),
binned AS (SELECT *, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bin FROM rates),
marks AS (SELECT DISTINCT rate, bin FROM binned),
groups AS (SELECT DISTINCT lang, source, rate FROM binned),
merged AS (SELECT lang, source, rate, bin, (SELECT count(*) FROM binned b WHERE b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.rate = g.rate AND b.bin <= m.bin) AS upto0,
  (SELECT count(*) FROM binned b WHERE b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.rate = g.rate) AS all0 FROM groups g JOIN marks m USING (rate)),
by_lang AS (SELECT lang, rate, bin, (SELECT count(*) FROM binned b WHERE b.lang IS NOT DISTINCT FROM g.lang AND b.rate = g.rate AND b.bin <= m.bin) AS upto1,
  (SELECT count(*) FROM binned b WHERE b.lang IS NOT DISTINCT FROM g.lang AND b.rate = g.rate) AS all1 FROM (SELECT DISTINCT lang, rate FROM groups) g JOIN marks m USING (rate)),
overall AS (SELECT rate, bin, (SELECT count(*) FROM binned b WHERE b.rate = m.rate AND b.bin <= m.bin) AS upto2, (SELECT count(*) FROM binned b WHERE b.rate = m.rate) AS all2 FROM marks m),
quantiles AS (SELECT g.lang, g.source, rate, bin, upto0 + {PRIOR} * ((upto1 + {PRIOR} * (upto2 / all2)) / (all1 + {PRIOR})) AS upto, all0 + {PRIOR} AS n
  FROM merged g JOIN by_lang l USING (rate, bin) JOIN overall USING (rate, bin) WHERE g.lang IS NOT DISTINCT FROM l.lang),
limits AS (SELECT lang, source, {sides} FROM quantiles GROUP BY lang, source),
judged AS (SELECT c.*, {BASE_FAILED} AS base_failed, NOT ({BASE_FAILED}) AND {inside} AS kept
  FROM counted c LEFT JOIN limits t ON c.lang IS NOT DISTINCT FROM t.lang AND c.source IS NOT DISTINCT FROM t.source)"""


def oracle_sql() -> dict[str, str]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rules = ", ".join(f"('{v}', '{r}')" for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
    render = lambda x: f"array_to_string(list_transform({x}, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '')"
    before = lambda x: f"coalesce(list_sum(list_transform({x}[1:i - 1], lambda t: length(t.role) + length(t.text) + 24)), 0)"
    spans = lambda x: f"array_to_string(list_transform(list_filter(range(1, len({x}) + 1), lambda i: {x}[i].role = 'assistant'), lambda i: ({before(x)} + length({x}[i].role) + 13)::BIGINT::VARCHAR || '+' || (length({x}[i].text) + 10)::VARCHAR), ',')"
    group = lambda i: f"('0x' || substr(hex, {5 * i + 1}, 5))::BIGINT"
    base32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({group(i)} >> {shift}) & 31)::INT + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
    return {
        "op6_warc": f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM payloads)
SELECT page_id, strlen(html) AS payload_bytes, {base32} AS payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, nullif(original, page_id) AS refers_to FROM placed""",
        "op7_chat_formatting": f"""
WITH turns AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 = 0 AS is_chosen, alone, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations)),
sides AS (SELECT pair_id, coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (is_chosen), []) AS c, coalesce(list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) FILTER (NOT is_chosen OR is_chosen IS NULL), []) AS r FROM turns GROUP BY pair_id, alone),
counted AS (SELECT *, coalesce(list_min(list_filter(range(0, least(len(c), len(r))), lambda i: c[i + 1] <> r[i + 1])), least(len(c), len(r)))::INT AS n FROM sides),
rest AS (SELECT *, c[n + 1:] AS cr, r[n + 1:] AS rr FROM counted)
SELECT pair_id, n AS n_prompt_turns, {render("c[1:n]")} AS prompt, CASE WHEN len(c) > 0 THEN {render("cr")} END AS chosen, CASE WHEN len(r) > 0 THEN {render("rr")} END AS rejected,
  CASE WHEN len(c) > 0 THEN {spans("cr")} END AS chosen_mask, CASE WHEN len(r) > 0 THEN {spans("rr")} END AS rejected_mask FROM rest""",
        "op3_quality_rules": f"WITH {quality_ctes()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines FROM judged",
        "op4_url_filters": f"""
WITH rest AS (SELECT row_number() OVER () AS uid, page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^?#]*') ELSE '' END AS rest FROM pages),
parts AS (SELECT uid, page_id, translate(regexp_extract(rest, '^[^/]*'), '{upper}', '{upper.lower()}') AS host, CASE WHEN contains(rest, '/') THEN rest[strpos(rest, '/'):] ELSE '' END AS path FROM rest),
rules AS (SELECT verdict, rule, regexp_extract(rule, '^[^/]*') AS rule_host, rule[strpos(rule, '/'):] AS rule_path FROM (VALUES {rules}) r(verdict, rule)),
best AS (SELECT uid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY uid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (uid)""",
    }
