"""Oracles that state a rule step by step: chunks, frontiers, histories, greedy matches, state machines, the Hebrew calendar.

What is sequential folds an ordered list with list_reduce; the state is a struct.
"""

from __future__ import annotations

from ..functions import text as tx
from ..functions import urls as u
from ..operators import crawl, schedule
from ..streaming import stateful
from .inputs import with_views


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def digest(name: str) -> str:
    return f"sha256(coalesce({name}, '')) AS {name}_sha, length(coalesce({name}, '')) AS {name}_len"


# ---- documents in chunks and slices


def chunks(source: str, target: int = tx.TARGET, overlap: int = tx.OVERLAP) -> str:
    """CTEs up to `chunked` (id, c): the passages of every document, a document that fits being its only one."""
    window = f"(?s)\\S.{{0,{target - 1}}}$|\\S.{{{target // 2},{target - 2}}}[\\n\\x{{05be}} ]|\\S.{{0,{target - 1}}}"
    marked, bold = "(?s)^#{1,6}\\s+(.*)$", "(?s)^\\*\\*([^*]+)\\*\\*$"
    heading = f"""CASE WHEN regexp_matches(p, '{marked}') THEN regexp_extract(p, '{marked}', 1)
    WHEN regexp_matches(p, '{bold}') THEN regexp_extract(p, '{bold}', 1)
    WHEN length(p) < 80 AND regexp_matches(p, '^[^.!?\\n]+$') THEN p END"""
    in_force = "coalesce(x.h, s.h)"
    longer = "CASE WHEN s.cur = '' THEN x.p ELSE s.cur || chr(10) || chr(10) || x.p END"
    fits = f"(s.cur = '' OR length({longer}) <= {target})"
    lead = f"CASE WHEN starts_with(x.p, {in_force}) THEN '' ELSE {in_force} END"
    cut = f"regexp_replace(right(s.cur, {overlap}), '^\\S*\\s', '')"
    tail = f"CASE WHEN length(s.cur) > {overlap} THEN {strip(cut)} ELSE '' END"
    return f"""clean AS (SELECT id, {strip("replace(coalesce(content, ''), chr(13) || chr(10), chr(10))")} AS t FROM {source}),
  paragraphs AS (SELECT id, unnest(regexp_split_to_array(t, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array(t, '\\n\\s*\\n'), 1) AS n FROM clean WHERE length(t) > {target}),
  pieces AS (SELECT id, n, unnest(x) AS p, generate_subscripts(x, 1) AS k FROM (
    SELECT id, n, CASE WHEN length({strip('p')}) <= {target} * 1.6 THEN [{strip('p')}] ELSE regexp_extract_all({strip('p')}, '{window}') END AS x FROM paragraphs)),
  headed AS (SELECT id, n, k, p, {strip("replace(" + heading + ", '**', '')")} AS h FROM (SELECT id, n, k, {strip('p')} AS p FROM pieces) WHERE p <> ''),
  folded AS (SELECT id, list_reduce(list({{'p': p, 'h': h}} ORDER BY n, k), lambda s, x: {{
    'out': CASE WHEN {fits} THEN s.out ELSE list_append(s.out, s.cur) END,
    'cur': CASE WHEN {fits} THEN {longer} ELSE array_to_string(list_filter([{lead}, {tail}, x.p], lambda y: y <> ''), chr(10)) END,
    'h': {in_force}}}, {{'out': []::varchar[], 'cur': '', 'h': ''}}) AS f FROM headed GROUP BY id),
  chunked AS (SELECT id, list_append(f.out, f.cur) AS c FROM folded UNION ALL SELECT id, CASE WHEN t = '' THEN [] ELSE [t] END FROM clean WHERE length(t) <= {target})"""


def slices(source: str, limit: int = tx.SLICE) -> str:
    """CTEs up to `sliced` (id, c): groups of whole paragraphs."""
    longer = "CASE WHEN s.held = '' THEN p ELSE s.held || chr(10) || chr(10) || p END"
    full = f"(s.held <> '' AND length(s.held) + length(p) + 2 > {limit})"
    return f"""grouped AS (SELECT id, content, CASE WHEN length(content) > {limit} THEN list_reduce(regexp_split_to_array(content, '\\n\\s*\\n'), lambda s, p: {{
    'out': CASE WHEN {full} THEN list_append(s.out, s.held) ELSE s.out END, 'held': CASE WHEN {full} THEN p ELSE {longer} END}}, {{'out': []::varchar[], 'held': ''}}) END AS f FROM {source}),
  sliced AS (SELECT id, CASE WHEN f IS NULL THEN [content] WHEN trim(f.held) = '' THEN f.out ELSE list_append(f.out, f.held) END AS c FROM grouped)"""


TEXTS = {
    "tx10_chunk_documents": f"""WITH {chunks('#knowledge')}
  SELECT parent_id, chunk_index, {digest('content')} FROM (SELECT id AS parent_id, generate_subscripts(c, 1) - 1 AS chunk_index, unnest(c) AS content FROM chunked WHERE len(c) > 1)""",
    "tx11_slice_documents": f"""WITH {slices('#knowledge')}
  SELECT id, slice_index, {digest('content')} FROM (SELECT id, generate_subscripts(c, 1) - 1 AS slice_index, unnest(c) AS content FROM sliced)""",
    "tx12_apply_rewrites": f"""WITH {slices("(SELECT id, content FROM #knowledge WHERE cast(id AS bigint) % 2 = 0)")},
  new AS (SELECT id, array_to_string(list_transform(c, lambda x: CASE WHEN cast(id AS bigint) % 4 = 0 THEN 'short' ELSE trim(lower(x)) END), chr(10) || chr(10)) AS t FROM sliced),
  judged AS (SELECT k.id, k.content AS old, t, coalesce(length(k.content) <= 120000 AND length(t) >= least(200, length(k.content) * 0.4), false) AS normalized FROM #knowledge k LEFT JOIN new USING (id))
  SELECT id, normalized, {digest('content')} FROM (SELECT id, normalized, CASE WHEN normalized THEN t ELSE old END AS content FROM judged)""",
    "ag08_document_list": f"WITH {chunks('#knowledge')} SELECT id, title, CASE WHEN len(c) > 1 THEN len(c) ELSE 0 END AS chunks, false AS has_original FROM #knowledge LEFT JOIN chunked USING (id)",
    "ag13_backfill_report": f"""WITH {chunks('#knowledge')}
  SELECT id, length(content) AS chars, CASE WHEN len(c) > 1 THEN len(c) ELSE 0 END AS chunks, source_url NOT LIKE '%3' AND length(content) <= 120000 AS eligible FROM #knowledge LEFT JOIN chunked USING (id)""",
}

# ---- search in both vocabularies

_WORDS_OF = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_REGION = "^[^aeiouy]*[aeiouy]*[^aeiouy]?"


def short_end(w: str) -> str:
    return f"(regexp_matches({w}, '^[aeiouy][^aeiouy]$') OR regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$'))"


def cut_end(n: int, to: str = "", w: str = "w") -> str:
    return f"left({w}, length({w}) - {n}) || '{to}'"


def first_ending(pairs: list[tuple[str, str]], region: str, rest: str = "") -> str:
    """The first ending that fits is replaced if it lies in the region."""
    cases = " ".join(f"WHEN ends_with(w, '{end}') THEN CASE WHEN length(w) - {len(end)} >= {region} THEN {cut_end(len(end), to)} ELSE w END" for end, to in pairs)
    return f"CASE {cases} {rest} ELSE w END"


def stemmed(words: str) -> str:
    """CTEs up to `stemmed` (word, s): the Porter2 stem of each of the distinct words, null for stop words; each step is one projection."""
    special = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tx._SPECIAL.items())
    vowel = lambda x: f"regexp_matches({x}, '[aeiouy]')"
    base, b = "CASE " + " ".join(f"WHEN ends_with(w, '{e}') THEN {cut_end(len(e))}" for e in ("ingly", "edly", "ing", "ed")) + " END", "b"
    repaired = f"""CASE WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {cut_end(1, w=b)}
      WHEN {short_end('b')} AND r1 >= length(b) THEN b || 'e' ELSE b END"""
    ogi = f"WHEN ends_with(w, 'ogi') AND length(w) - 3 >= r1 AND regexp_matches(w, 'logi$') THEN {cut_end(1)} WHEN length(w) - 2 >= r1 AND regexp_matches(w, '[cdeghkmnrt]li$') THEN {cut_end(2)}"
    steps = [
        ("s1", f"CASE WHEN ends_with(w, 'sses') THEN {cut_end(2)} WHEN regexp_matches(w, 'ie[ds]$') THEN CASE WHEN length(w) > 4 THEN {cut_end(2)} ELSE {cut_end(1)} END WHEN regexp_matches(w, '[^us]s$|^s$') AND {vowel('left(w, length(w) - 2)')} THEN {cut_end(1)} ELSE w END"),
        ("s2", f"CASE WHEN w IN ({', '.join(repr(x) for x in sorted(tx._STAY))}) THEN w WHEN regexp_matches(w, 'eed(ly)?$') THEN {first_ending([('eedly', 'ee'), ('eed', 'ee')], 'r1')} WHEN b IS NOT NULL AND {vowel('b')} THEN {repaired} ELSE w END"),
        ("s3", f"CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {cut_end(1, 'i')} ELSE w END"),
        ("s4", first_ending(tx._STEP2, "r1", ogi)),
        ("s5", first_ending(tx._STEP3, "r1", f"WHEN ends_with(w, 'ative') AND length(w) - 5 >= r2 THEN {cut_end(5)}")),
        ("s6", first_ending([(e, "") for e in tx._STEP4], "r2", f"WHEN length(w) - 3 >= r2 AND regexp_matches(w, '[st]ion$') THEN {cut_end(3)}")),
        ("s7", f"CASE WHEN ends_with(w, 'e') THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT {short_end(cut_end(1))}) THEN {cut_end(1)} ELSE w END WHEN ends_with(w, 'll') AND length(w) - 1 >= r2 THEN {cut_end(1)} ELSE w END"),
    ]
    out = f"""s0 AS (SELECT word, w, r1, r1 + length(regexp_extract(substr(w, r1 + 1), '{_REGION}')) AS r2, false AS stays FROM (SELECT word, w, CASE WHEN regexp_matches(w, '^(gener|arsen)') THEN 5 WHEN starts_with(w, 'commun') THEN 6 ELSE length(regexp_extract(w, '{_REGION}')) END AS r1
    FROM (SELECT DISTINCT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {words})))"""
    for n, (name, step) in enumerate(steps):
        stays = f"w IN ({', '.join(repr(x) for x in sorted(tx._STAY))})" if name == "s2" else "stays"
        source = f"(SELECT *, {base} AS b FROM s{n})" if name == "s2" else f"s{n}"
        out += f",\n  {name} AS (SELECT word, CASE WHEN stays THEN w ELSE {step} END AS w, r1, r2, {stays} AS stays FROM {source})"
    stop = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
    return out + f",\n  stemmed AS (SELECT word, CASE WHEN word IN ({stop}) THEN NULL WHEN length(word) <= 2 THEN word ELSE CASE word {special} ELSE replace(w, 'Y', 'y') END END AS s FROM s7)"


_UNITS = f"""{chunks('#knowledge')},
  units AS (SELECT CASE WHEN len(c) > 1 THEN id || '#' || k ELSE id END AS unit_id, agent_id, title, content FROM (
    SELECT id, agent_id, title, c, generate_subscripts(x, 1) - 1 AS k, unnest(x) AS content FROM (SELECT k.*, c, CASE WHEN len(c) > 1 THEN c ELSE [content] END AS x FROM #knowledge k LEFT JOIN chunked USING (id))))"""
_FOUND = f"""{_UNITS},
  unit_words AS (SELECT unit_id, agent_id, word, count(*) AS tf FROM (SELECT unit_id, agent_id, unnest({_WORDS_OF.format("coalesce(title, '') || ' ' || coalesce(content, '')")}) AS word FROM units) GROUP BY ALL),
  question_words AS (SELECT DISTINCT query_id, agent_id, unnest({_WORDS_OF.format('question')}) AS word FROM #questions),
  {stemmed('(SELECT word FROM unit_words UNION ALL SELECT word FROM question_words)')},
  lexemes AS (SELECT unit_id, agent_id, lexeme, sum(tf) AS tf FROM (SELECT unit_id, agent_id, word AS lexeme, tf FROM unit_words UNION ALL SELECT unit_id, agent_id, s, tf FROM unit_words JOIN stemmed USING (word) WHERE s IS NOT NULL) GROUP BY ALL),
  asked AS (SELECT query_id, agent_id, 'simple' AS vocabulary, word AS lexeme FROM question_words UNION SELECT query_id, agent_id, 'english', s FROM question_words JOIN stemmed USING (word) WHERE s IS NOT NULL),
  counted AS (SELECT *, count(*) OVER (PARTITION BY query_id, agent_id, vocabulary) AS n FROM asked),
  ranks AS (SELECT query_id, unit_id, vocabulary, sum(0.1::double * list_sum(list_transform(range(1, cast(least(tf, 256) AS bigint) + 1), lambda j: 1.0::double / (j * j))) / 1.64493406685::double) / max(n) AS rank FROM lexemes JOIN counted USING (agent_id, lexeme) GROUP BY ALL),
  best AS (SELECT query_id, unit_id, round(max(rank), 9) AS rank FROM ranks GROUP BY ALL),
  found AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, unit_id) AS int) AS position FROM best QUALIFY position <= 6)"""
SEARCH = {
    "tx13_lexemes_english": f"""WITH counted AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest({_WORDS_OF.format('content')}) AS word FROM #knowledge) GROUP BY ALL), {stemmed('counted')}
  SELECT id, lexeme, cast(sum(tf) AS bigint) AS tf FROM (SELECT id, word AS lexeme, tf FROM counted UNION ALL SELECT id, s, tf FROM counted JOIN stemmed USING (word) WHERE s IS NOT NULL) GROUP BY ALL""",
    "tk01_posting_lists": f"""WITH {_FOUND}
  SELECT agent_id, lexeme, count(*) AS units, round(0.1::double * list_sum(list_transform(range(1, cast(least(max(tf), 256) AS bigint) + 1), lambda j: 1.0::double / (j * j))) / 1.64493406685::double, 9) AS top FROM lexemes GROUP BY ALL""",
    "tk01_search": f"WITH {_FOUND} SELECT query_id, unit_id, rank, position FROM found",
    "tx20_build_contexts": f"""WITH {_FOUND},
  passages AS (SELECT q.agent_id AS id, string_agg('[' || title || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY f.query_id, f.position, title, content) AS p FROM found f JOIN units USING (unit_id) JOIN #questions q USING (query_id) GROUP BY 1)
  SELECT b.id, 'You are ' || name || chr(10) || chr(10) || coalesce(p || chr(10) || chr(10), '') || strftime(timestamp '2024-01-15 21:30:00' AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jerusalem', 'Today is %A, %Y-%m-%d %H:%M') AS prompt FROM #bots b LEFT JOIN passages p ON p.id = b.id""",
}

# ---- addresses

_SITE = "regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


def canonical(url: str) -> str:
    """An http(s) address in one spelling; the tables' hosts have no ports, and each parameter comes once."""
    host, path = f"lower(regexp_extract({url}, '://([^/?#]*)', 1))", f"regexp_extract({url}, '://[^/?#]*([^?#]*)', 1)"
    plain = f"array_to_string(list_transform(string_split({path}, ''), lambda y: CASE WHEN regexp_matches(y, '^[A-Za-z0-9/%:@!$&''()*+,;=~._-]$') THEN y ELSE url_encode(y) END), '')"
    single = f"regexp_replace(regexp_replace({plain}, '/+', '/', 'g'), '/$', '')"
    tracking = "^(" + "|".join([p + ".*" for p in u.TRACKING_PREFIXES] + u.TRACKING) + ")$"
    kept = f"list_sort(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda y: y <> '' AND NOT regexp_matches(lower(split_part(y, '=', 1)), '{tracking}')))"
    query = f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"
    return f"lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || {host} || CASE WHEN {single} = '' THEN '/' ELSE {single} END || {query}"


def crawlable(path: str) -> str:
    return f"NOT (regexp_matches({path}, '(?i)\\.({'|'.join(u.ASSETS)})$') OR regexp_matches({path}, '(?i)/({'|'.join(u.SYSTEM_PATHS)})(/|$)'))"


HREF = """(?i)<a\\b[^>]*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)"""
FRONTIER = f"""WITH p AS (SELECT {_SITE} AS site, regexp_replace(url, '#.*$', '') AS url, page_id AS position FROM #web_pages),
  seen AS (SELECT DISTINCT site, url FROM p WHERE position % 10 = 0),
  candidates AS (SELECT site, url, min({{'reserve': position % 2, 'position': position}}) AS o FROM p WHERE {crawlable(_PATH)} GROUP BY ALL),
  allowed AS (SELECT site, url, o, {_PATH} AS path, contains(url, '?') AS q FROM (SELECT *, regexp_extract(url, '://[^/]*(.*)', 1) AS asked FROM candidates ANTI JOIN seen USING (site, url))
    WHERE CASE WHEN asked LIKE '/fr/8%' THEN true WHEN asked LIKE '/fr/%' THEN false ELSE asked NOT LIKE '/%/' END),
  counted AS (SELECT a.*, row_number() OVER (PARTITION BY a.site, a.path, q ORDER BY o, a.url) + coalesce(v, 0) AS variant FROM allowed a
    LEFT JOIN (SELECT site, {_PATH} AS path, count(*) AS v FROM seen WHERE contains(url, '?') GROUP BY ALL) s ON s.site = a.site AND s.path = a.path),
  open AS (SELECT c.* FROM counted c LEFT JOIN (SELECT site, count(*) AS n FROM seen GROUP BY site) s ON s.site = c.site
    WHERE (NOT q OR variant <= {crawl.VARIANTS}) AND coalesce(n, 0) <= 10 * {crawl.SEEN_FACTOR})
  SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY o, url) AS rank FROM open QUALIFY rank <= 10"""
ADDRESSES = {
    "tx04_normalize_url": f"SELECT page_id, {canonical('url')} AS url FROM #web_pages",
    "tx06_internal_links": f"""WITH h AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*') AS base, url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM #web_pages),
  r AS (SELECT page_id, url, base || replace(trim(trim(href, '"''')), '&amp;', '&') AS target FROM h WHERE trim(href, '"''') LIKE '/%'),
  l AS (SELECT DISTINCT page_id, {canonical('target')} AS link FROM r)
  SELECT page_id, link FROM l WHERE {crawlable("regexp_extract(link, '://[^/?#]*([^?#]*)', 1)")}""",
    "tk04_next_frontier": FRONTIER,
}

# ---- pages as text


def page_text(source: str) -> str:
    """CTEs up to `texted` (page_id, t): every tag says what it writes and whether a line (1) or a paragraph (2) ends before it; lines are joined again by what ended them.

    Of character references only those of the tables are decoded.
    """
    unread = "|".join(["<!--.*?-->", *[f"<{n}(?:[^a-z0-9:>-][^>]*)?>.*?</{n}>" for n in tx.UNREAD]])
    block = ", ".join(f"'{n}'" for n in tx.PARAGRAPHS)
    decoded = "line"
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        decoded = f"regexp_replace({decoded}, '&{name};?', '{sign}', 'g')"
    heads = "regexp_matches(tag, '^h[1-6]$')"
    return f"""tokens AS (SELECT page_id, x, generate_subscripts(x, 1) AS n FROM (SELECT page_id, regexp_extract_all(regexp_replace(coalesce(html, ''), '(?si){unread}', '<->', 'g'), '<[^>]+>|[^<]+|<') AS x FROM {source})),
  tags AS (SELECT page_id, n, x[n] AS tok, starts_with(x[n], '<') AND length(x[n]) > 1 AS is_tag, starts_with(x[n], '</') AS ends, coalesce(nullif(lower(regexp_extract(x[n], '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)), ''), '-') AS tag FROM tokens),
  marked AS (SELECT *, is_tag AND {heads} AS head, is_tag AND ends AND tag IN ({block}) AS closes FROM tags),
  stated AS (SELECT *, coalesce(last_value(CASE WHEN head AND NOT ends THEN true WHEN closes OR head THEN false END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM marked),
  written AS (SELECT page_id, n, CASE WHEN NOT is_tag THEN replace(tok, chr(10), CASE WHEN inside THEN ' ' ELSE chr(1) END) WHEN head THEN chr(2) || CASE WHEN ends THEN '' ELSE repeat('#', least(cast(tag[2] AS int) + 1, 6)) || ' ' END
    WHEN inside AND NOT closes THEN ' ' WHEN tag = 'br' OR (tag = 'li' AND NOT ends) THEN chr(1) || CASE tag WHEN 'li' THEN '- ' ELSE '' END
    WHEN closes THEN chr(2) WHEN ends AND tag IN ('td', 'th') THEN chr(9) ELSE ' ' END AS w FROM stated),
  pages_written AS (SELECT page_id, string_agg(w, '' ORDER BY n) || chr(1) AS t FROM written GROUP BY page_id),
  ended AS (SELECT page_id, k, trim(regexp_replace(replace({decoded.replace('line', 'x[k][:-2]')}, chr(160), ' '), '[ \t]{{2,}}', ' ', 'g'), ' ' || chr(9)) AS line, x[k][-1] = chr(2) AS blank
    FROM (SELECT page_id, x, generate_subscripts(x, 1) AS k FROM (SELECT page_id, regexp_extract_all(t, '(?s)[^\x01\x02]*[\x01\x02]') AS x FROM pages_written))),
  kept AS (SELECT *, line <> '' AND NOT regexp_matches(line, '^(-|#+)$') AS keeps FROM ended),
  runs AS (SELECT page_id, g, any_value(line) FILTER (keeps) AS line, bool_or(blank OR line = '') AS gap FROM (SELECT *, count(*) FILTER (keeps) OVER (PARTITION BY page_id ORDER BY k) AS g FROM kept) GROUP BY page_id, g),
  texted AS (SELECT p.page_id, coalesce({strip('r.t')}, '') AS t FROM {source} p LEFT JOIN (SELECT page_id, string_agg(line || CASE WHEN gap THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY g) AS t FROM runs WHERE g > 0 GROUP BY page_id) r USING (page_id))"""


_ONE = f"pages_of AS (SELECT page_id, html, {canonical('url')} AS url FROM #web_pages QUALIFY row_number() OVER (PARTITION BY {canonical('url')} ORDER BY page_id) = 1)"
_CRAWLED = f"""{_ONE}, {page_text('pages_of')},
  crawled AS (SELECT page_id, {_SITE} AS site, url, substr(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'si'), '<[^>]+>', '', 'g')), 1, 200) AS title,
    CASE WHEN length(t) > {crawl.MOST_CHARS} THEN substr(t, 1, {crawl.MOST_CHARS}) || chr(10) || chr(10) || '[…truncated]' ELSE t END AS content, length(t) > {crawl.MOST_CHARS} AS truncated
    FROM pages_of JOIN texted USING (page_id) WHERE length(t) >= {crawl.LEAST_CHARS})"""
_READ = _CRAWLED.replace(f"WHERE length(t) >= {crawl.LEAST_CHARS})", ")")
PAGES = {
    "tx01_html_to_text": f"WITH {page_text('#web_pages')} SELECT page_id, sha256(t) AS text FROM texted",
    "tx09_crawl_documents": f"WITH {_CRAWLED} SELECT page_id, site, url, title, sha256(content) AS content, truncated FROM crawled",
    "ag09_crawl_report": f"""WITH {_READ},
  stored AS (SELECT site, count(*) FILTER (length(content) >= {crawl.LEAST_CHARS}) AS pages, sum(length(content)) FILTER (length(content) >= {crawl.LEAST_CHARS}) AS chars, count(*) FILTER (length(content) < {crawl.THIN_CHARS}) AS thin, count(*) FILTER (truncated) AS truncated FROM crawled GROUP BY site),
  asked AS (SELECT site, count(DISTINCT url) AS found, count(*) FILTER (NOT CASE WHEN path LIKE '/fr/8%' THEN true WHEN path LIKE '/fr/%' THEN false ELSE path NOT LIKE '/%/' END) AS blocked FROM (SELECT {_SITE} AS site, url, {_PATH} AS path FROM #web_pages) GROUP BY site)
  SELECT site, coalesce(pages, 0) AS pages, cast(coalesce(chars, 0) AS bigint) AS chars, coalesce(thin, 0) AS thin, coalesce(truncated, 0) AS truncated, found, blocked FROM asked LEFT JOIN stored USING (site)""",
}

# ---- conversations

_HISTORY = """talk AS (SELECT id, len(roles) AS n, list_filter(list_zip(roles, texts)[-500:], lambda m: m[1] IN ('user', 'assistant')) AS t FROM #chat_sessions),
  tails AS (SELECT *, t[-20:] AS tail FROM talk),
  recents AS (SELECT *, tail[nullif(coalesce(list_position(list_transform(tail, lambda m: m[1]), 'user'), 0), 0):] AS r FROM tails),
  judged AS (SELECT *, CASE WHEN n = 0 THEN 'messages array required'
    WHEN len(list_filter(t, lambda m: m[2] IS NULL)) > 0 THEN 'Message content must be text'
    WHEN len(list_filter(t, lambda m: m[1] = 'user' AND length(m[2]) > 4000)) > 0 THEN 'A message can be at most 4000 characters long'
    WHEN NOT list_contains(list_transform(tail, lambda m: m[1]), 'user') OR len(tail) = 0 OR r[-1][1] <> 'user' OR trim(r[-1][2]) = '' THEN 'The last message must be the person''s, with some text' END AS error FROM recents)"""
_CUT = "CASE WHEN m[1] = 'assistant' THEN substr(m[2], 1, 8000) ELSE replace(m[2], 'the', '***') END"
_TOLD = "sha256(array_to_string(list_transform({0}, lambda m: m[1] || ':' || CASE WHEN m[1] = 'assistant' THEN substr(m[2], 1, 8000) ELSE m[2] END), chr(10)))"
CONVERSATIONS = {
    "ar01_public_history": f"WITH {_HISTORY} SELECT id, error, CASE WHEN error IS NULL THEN {_TOLD.format('r')} END AS recent, {_TOLD.format('t')} AS kept FROM judged",
    "ar02_stored_transcript": f"""WITH {_HISTORY}, s AS (SELECT id, list_append(list_transform(t, lambda m: {_CUT}), 'Thanks')[-500:] AS stored FROM judged)
  SELECT id, len(stored) AS stored, sha256(array_to_string(stored, '|')) AS sha FROM s""",
    "jn09_match_replies": """WITH m AS (SELECT id AS message_id, number_id, phone, ts, id % 4 = 0 AS answers FROM #messages WHERE NOT from_me),
  w AS (SELECT id AS run_id, number_id, phone, id % 2 = 0 AS approval, ts AS started_at FROM #messages WHERE from_me AND id % 3 = 0),
  met AS (SELECT number_id, phone, list({'m': message_id, 'r': run_id} ORDER BY ts, message_id, NOT approval, started_at, run_id) AS c
    FROM m JOIN w USING (number_id, phone) WHERE started_at <= ts AND ts <= started_at + to_hours(48) AND (NOT approval OR answers) GROUP BY ALL),
  taken AS (SELECT unnest(list_reduce(c, lambda s, x: CASE WHEN len(list_filter(s, lambda y: y.m = x.m OR y.r = x.r)) > 0 THEN s ELSE list_append(s, x) END, [{'m': -1::bigint, 'r': -1::bigint}])) AS x FROM met)
  SELECT x.m AS message_id, x.r AS run_id FROM taken WHERE x.m >= 0""",
    "tx18_resolve_mentions": """SELECT id, 'hi @' || phone || ' and @' || chat || ' ' || text AS text,
    1 + (chat <> phone AND EXISTS (SELECT 1 FROM #messages o WHERE o.chat = m.chat AND o.phone = m.chat))::int AS mentions FROM #messages m""",
    "ex01_assign_branches": """WITH b AS (SELECT 'b' || id AS branch_id, cast(cast(id AS int) % 10 AS string) AS agent_id, cast(id AS int) % 4 AS weight FROM #bots WHERE cast(id AS int) % 5 > 0 AND cast(id AS int) % 4 > 0),
  c AS (SELECT agent_id, branch_id, weight, sum(weight) OVER (PARTITION BY agent_id ORDER BY branch_id) AS hi FROM b),
  s AS (SELECT id, agent_id, cast(id AS int) % 3 = 0 AS decided, cast('0x' || substr(md5(id || ':7'), 1, 8) AS bigint) % 10000 / 100 AS roll FROM #chat_sessions)
  SELECT id, s.agent_id, CASE WHEN decided THEN 'old' ELSE c.branch_id END AS branch_id FROM s LEFT JOIN c ON c.agent_id = s.agent_id AND roll >= hi - weight AND roll < hi""",
}

# ---- state machines


def replayed(source: str, key: str, step: str, start: str, to: str) -> str:
    """Rows (key, id, e) of source folded in time order; the state's `out` holds an answer a row."""
    return f"""WITH src AS ({source}), runs AS (SELECT {key}, list(id ORDER BY us, id) AS ids, list(e ORDER BY us, id) AS es FROM (SELECT *, e.us AS us FROM src) GROUP BY {key}),
  folds AS (SELECT {key}, ids, list_reduce(es, lambda s, x: {step}, {start}) AS f FROM runs)
  SELECT {key}, unnest(ids) AS id, unnest(f.out) AS {to} FROM folds"""


def _limiter(limit: int, window: int, lock: int) -> str:
    fresh = f"(s.opened IS NULL OR x.us - s.opened > {window * 10**6})"
    hits = f"(CASE WHEN {fresh} THEN 1 ELSE s.hits + 1 END)"
    until = f"(CASE WHEN {hits} > {limit} THEN x.us + {lock * 10**6} ELSE s.until END)"
    refused = f"coalesce(x.us < {until}, false)"
    return f"""{{'hits': CASE WHEN x.cleared THEN 0 WHEN x.success AND NOT {refused} THEN {hits} - 1 ELSE {hits} END, 'opened': CASE WHEN x.cleared THEN NULL WHEN {fresh} THEN x.us ELSE s.opened END,
    'until': CASE WHEN x.cleared THEN NULL ELSE {until} END, 'out': list_append(s.out, NOT x.cleared AND {refused})}}"""


def _loops(fast: int, most: int, pause: int) -> str:
    paused = "coalesce(x.us < s.until, false)"
    counts = f"(NOT x.me AND NOT {paused} AND s.awaiting AND coalesce(x.us - s.replied >= -1000000, false))"
    streak = f"(CASE WHEN x.us - s.replied < {fast * 10**6} THEN s.streak + 1 ELSE 0 END)"
    stops = f"({counts} AND {streak} >= {most})"
    return f"""{{'replied': CASE WHEN x.me THEN x.us ELSE s.replied END, 'awaiting': x.me OR (s.awaiting AND NOT {counts}),
    'streak': CASE WHEN {stops} THEN 0 WHEN {counts} THEN {streak} ELSE s.streak END, 'until': CASE WHEN {stops} THEN x.us + {pause * 10**6} ELSE s.until END,
    'out': list_append(s.out, NOT x.me AND ({paused} OR {stops}))}}"""


MACHINES = {
    "st04_rate_limit": replayed("SELECT phone AS bucket, id, {'us': epoch_us(ts), 'success': id % 5 = 0, 'cleared': id % 41 = 0} AS e FROM #messages", "bucket", _limiter(3, 86_400, 86_400), "{'hits': 0::bigint, 'opened': NULL::bigint, 'until': NULL::bigint, 'out': []::boolean[]}", "refused"),
    "st05_detect_loops": replayed("SELECT chat, id, {'us': epoch_us(ts), 'me': from_me} AS e FROM #messages", "chat", _loops(600, 2, 1800), "{'replied': NULL::bigint, 'awaiting': false, 'streak': 0::bigint, 'until': NULL::bigint, 'out': []::boolean[]}", "paused"),
}


def _admission() -> str:
    """What settled before a call is a running sum, as it doesn't depend on decisions; the fold over all calls holds the open holds. Amounts are billionths."""
    live = f"list_filter(s.holds, lambda h: h.us > x.us - {stateful.HOLD_SECONDS * 10**6})"
    held = lambda keep: f"coalesce(list_sum(list_transform(list_filter({live}, lambda h: {keep}), lambda h: h.v)), 0)"
    refusal = f"""CASE WHEN x.all_spent + {held("true")} + x.v > x.cap THEN 'platform'
      WHEN x.person IS NULL AND x.public_spent + {held("h.org = x.org AND h.person IS NULL")} + x.v > x.public_cap THEN 'org-public'
      WHEN x.balance - x.org_spent - {held("h.org = x.org")} < x.v THEN 'balance'
      WHEN x.item IS NOT NULL AND x.item_spent + {held("h.org = x.org AND h.item = x.item")} + x.v > 300000000 THEN 'item'
      WHEN x.person IS NOT NULL AND x.person_spent + {held("h.org = x.org AND h.person = x.person")} + x.v > x.member_cap THEN 'member' END"""
    mine = "{'us': x.us, 'call': x.call, 'org': x.org, 'item': x.item, 'person': x.person, 'v': x.v}"
    step = f"""{{'holds': CASE WHEN x.kind <> 'ask' THEN list_filter({live}, lambda h: h.call <> x.call) WHEN ({refusal}) IS NULL THEN list_append({live}, {mine}) ELSE {live} END,
    'out': CASE WHEN x.kind = 'ask' THEN list_append(s.out, {{'id': x.call, 'refusal': {refusal}}}) ELSE s.out END}}"""
    hold = "STRUCT(us bigint, \"call\" bigint, org varchar, item varchar, person varchar, v bigint)[]"
    nanos = lambda c, times="1e9": f"cast(round(cast({c} AS double) * {times}) AS bigint)"
    spent = lambda part, when="true": f"coalesce(sum(CASE WHEN kind = 'settle' AND {when} THEN v ELSE 0 END) OVER ({part} ORDER BY us, kind, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint"
    columns = "org_id AS org, item, user_id AS person, public_cap, balance, member_cap"
    names = "us, kind, call, org, item, person, public_cap, balance, member_cap, v, cap, all_spent, org_spent, public_spent, item_spent, person_spent".split(", ")
    return f"""WITH u AS (SELECT l.*, item_type || ':' || item_id AS item, {nanos('public_monthly_cap_usd')} AS public_cap, {nanos('balance_usd')} AS balance,
    {nanos('m.monthly_usd')} AS member_cap FROM #llm_usage l LEFT JOIN #org_billing b ON b.org_id = l.org_id
    LEFT JOIN #usage_limits m ON m.kind = 'member' AND m.org_id = l.org_id AND m.target_id = l.user_id WHERE l.org_id IS NOT NULL),
  e AS (SELECT epoch_us(at) AS us, 'ask' AS kind, id AS call, id AS n, {columns}, {nanos('cost_usd', '2e9')} AS v FROM u
    UNION ALL SELECT epoch_us(at) + 30000000, 'settle', id, -id - 1, {columns}, {nanos('cost_usd')} FROM u WHERE id % 7 <> 0
    UNION ALL SELECT epoch_us(at) + 20000000, 'release', id, -id - 1, {columns}, 0 FROM u WHERE id % 7 = 0),
  w AS (SELECT *, {spent('')} AS all_spent, {spent('PARTITION BY org')} AS org_spent, {spent('PARTITION BY org', 'person IS NULL')} AS public_spent, {spent('PARTITION BY org, item')} AS item_spent,
    {spent('PARTITION BY org, person')} AS person_spent, (SELECT cast(floor(cast(sum(cost_usd) AS double) * 0.9) AS bigint) * 1000000000 FROM u WHERE id % 7 <> 0) AS cap FROM e),
  g AS (SELECT list({{{', '.join(f"'{c}': {c}" for c in names)}}} ORDER BY us, kind, n) AS es FROM w),
  f AS (SELECT unnest(list_reduce(es, lambda s, x: {step}, {{'holds': []::{hold}, 'out': []::STRUCT(id bigint, refusal varchar)[]}}).out) AS o FROM g)
  SELECT o.id AS id, o.refusal AS refusal FROM f"""


MACHINES["st06_admit_calls"] = _admission()
MACHINES["st02_stream_bursts"] = """WITH m AS (SELECT *, ts - lag(ts) OVER (PARTITION BY number_id, chat ORDER BY ts, id) AS quiet FROM #messages),
  b AS (SELECT *, count(*) FILTER (quiet IS NULL OR quiet >= to_minutes(10)) OVER (PARTITION BY number_id, chat ORDER BY ts, id) AS burst FROM m)
  SELECT number_id, chat, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS messages, bool_or(id % 3 = 0) AS addressed, sha256(string_agg(text, chr(10) ORDER BY ts, id)) AS text FROM b GROUP BY number_id, chat, burst"""
MACHINES["st03_stream_rates"] = "SELECT chat, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM #messages GROUP BY 1, 2"
MACHINES["st10_stream_triggers"] = """SELECT r.id AS row_id, 'a' || b.id AS automation_id FROM #table_rows r JOIN #bots b ON cast(b.id AS int) % 4 > 0 AND cast(cast(b.id AS int) % 5 AS string) = r.table_id
  AND b.org_id = cast(r.id % 25 AS string) WHERE b.id <> cast(r.id % 50 AS string)"""

# ---- calendars

# The Hebrew calendar from its arithmetic: mean conjunctions, postponements, the lengths of years and months.
_HEBREW = """conjunctions AS (SELECT y, m * 29 + (12084 + 13753 * m) // 25920 AS d FROM (SELECT y, (235 * y - 234) // 19 AS m FROM range(5550::bigint, 5900) t(y))),
  postponed AS (SELECT y, CASE WHEN 3 * (d + 1) % 7 < 3 THEN d + 1 ELSE d END AS e FROM conjunctions),
  starts AS (SELECT y, e + CASE WHEN lead(e) OVER (ORDER BY y) - e = 356 THEN 2 WHEN e - lag(e) OVER (ORDER BY y) = 382 THEN 1 ELSE 0 END - 1373427 AS first FROM postponed),
  years AS (SELECT y, first, lead(first) OVER (ORDER BY y) - first AS days, (7 * y + 1) % 19 < 7 AS leap FROM starts),
  months AS (SELECT y, first, unnest(list_concat([{'n': 'Tishri', 'len': 30}, {'n': 'Heshvan', 'len': CASE WHEN days % 10 = 5 THEN 30 ELSE 29 END}, {'n': 'Kislev', 'len': CASE WHEN days % 10 = 3 THEN 29 ELSE 30 END}, {'n': 'Tevet', 'len': 29}, {'n': 'Shevat', 'len': 30}],
    CASE WHEN leap THEN [{'n': 'Adar I', 'len': 30}, {'n': 'Adar II', 'len': 29}] ELSE [{'n': 'Adar', 'len': 29}] END,
    [{'n': 'Nisan', 'len': 30}, {'n': 'Iyar', 'len': 29}, {'n': 'Sivan', 'len': 30}, {'n': 'Tamuz', 'len': 29}, {'n': 'Av', 'len': 30}, {'n': 'Elul', 'len': 29}])) AS x, generate_subscripts(range(12 + leap::int), 1) AS k FROM years WHERE y BETWEEN 5600 AND 5890),
  placed AS (SELECT y AS hyear, x.n AS hmonth, x.len AS len, first + sum(x.len) OVER (PARTITION BY y ORDER BY k) - x.len AS begins FROM months),
  hebrew AS (SELECT date '0001-01-01' + cast(begins + n - 1 AS int) AS day, n + 1 AS hday, hmonth, hyear FROM placed, unnest(range(len)) u(n))"""


def _wave(first: float, terms: list[tuple[float, str, int]]) -> str:
    return " + ".join([str(first), *[f"({c}) * {f}({k} * g)" for c, f, k in terms]])


def _sunset(day: str) -> str:
    """Seconds of the UTC day at sunset, by the NOAA equation."""
    g = f"(2 * pi() / 365 * (dayofyear({day}) - 1 + 0.5))"
    equation = "229.18 * (" + _wave(0.000075, [(0.001868, "cos", 1), (-0.032077, "sin", 1), (-0.014615, "cos", 2), (-0.040849, "sin", 2)]).replace("g)", f"{g})") + ")"
    tilt = "(" + _wave(0.006918, [(-0.399912, "cos", 1), (0.070257, "sin", 1), (-0.006758, "cos", 2), (0.000907, "sin", 2), (-0.002697, "cos", 3), (0.00148, "sin", 3)]).replace("g)", f"{g})") + ")"
    angle = f"degrees(acos(cos(radians(90.833)) / (cos(radians(lat)) * cos({tilt})) - tan(radians(lat)) * tan({tilt})))"
    return f"cast(floor((720 - 4 * (lon - {angle}) - {equation}) * 60) AS bigint)"


def _clock(day: str, minutes: str) -> str:
    return f"strftime((cast({day} AS timestamp) + to_seconds({_sunset(day)}) + to_minutes({minutes})) AT TIME ZONE 'UTC' AT TIME ZONE '{schedule.ZONE}', '%H:%M')"


_CITIES = "(VALUES " + ", ".join(map(str, schedule.CITIES)) + ") c(city, lat, lon, before)"
_DATES = """dates AS (SELECT id, cast(id AS int) % 29 + 1 AS d, cast(id AS int) % 12 + 1 AS m, CASE WHEN cast(id AS int) % 5 > 0 THEN 1950 + cast(id AS int) % 60 END AS y, cast(id AS int) % 3 = 0 AS by_hebrew FROM #users WHERE cast(id AS int) % 17 > 0)"""
CALENDARS = {
    "dt05_calendar": f"""WITH {_HEBREW} SELECT e.day, n, dayofweek(e.day) AS weekday, hday, hmonth, hyear FROM (SELECT cast(ts AS date) AS day, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN hebrew h ON h.day = e.day""",
    "dt05_sabbath_times": f"""WITH days AS (SELECT DISTINCT cast(ts AS date) AS day FROM events WHERE dayofweek(ts) = 5)
  SELECT day, city, {_clock('day', '-before')} AS candles, {_clock('(day + 1)', str(schedule.ENDS_AFTER_SUNSET))} AS ends FROM days, {_CITIES}""",
    "dt06_anniversaries": f"""WITH {_HEBREW}, {_DATES}, n AS (SELECT * FROM hebrew WHERE day = date '2024-02-28'), t AS (SELECT * FROM hebrew WHERE day = date '2024-02-29'),
  born AS (SELECT dates.*, h.hday, h.hmonth, h.hyear FROM dates LEFT JOIN hebrew h ON by_hebrew AND h.day = try_cast(printf('%d-%02d-%02d', y, m, d) AS date)),
  kept AS (SELECT born.*, n.hyear AS now, CASE WHEN by_hebrew AND y IS NOT NULL THEN
      (born.hmonth = n.hmonth OR (born.hmonth LIKE 'Adar%' AND n.hmonth LIKE 'Adar%' AND (n.hmonth = 'Adar' OR (born.hmonth = 'Adar' AND n.hmonth = 'Adar II'))))
      AND (born.hday = n.hday OR (born.hday = 30 AND n.hday = 29 AND t.hday = 1)) ELSE m = 2 AND d = 28 END AS due FROM born, n, t)
  SELECT id, CASE WHEN by_hebrew THEN now - hyear ELSE 2024 - y END AS years FROM kept WHERE due""",
}

# ---- rules over inputs that differ by row

_SNAPSHOT = "coalesce((SELECT list({{'t': {title}, 'c': content}} ORDER BY id)[:200] FROM #knowledge k WHERE k.agent_id = b.id), [])"
_WORDS = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_RAW_PHONE = "CASE cast(id AS int) % 4 WHEN 0 THEN '050-' || lpad(id, 7, '1') WHEN 1 THEN '00972 5' || lpad(id, 8, '2') WHEN 2 THEN '5' || lpad(id, 8, '3') ELSE '0' || id END"
_CONTROL = """SELECT id, CASE WHEN starts_with(d, '0') THEN '972' || substr(d, 2) ELSE d END AS phone FROM (
  SELECT id, regexp_replace(regexp_replace({raw}, '[^0-9]', '', 'g'), '^00', '') AS d FROM #users)"""
RULES = {
    "tx17_normalize_phone": """WITH r AS (SELECT id, CASE cast(id AS int) % 4 WHEN 0 THEN '050-' || lpad(id, 7, '1') WHEN 1 THEN '00972 5' || lpad(id, 8, '2') WHEN 2 THEN '5' || lpad(id, 8, '3') ELSE id END AS raw FROM #users),
  d AS (SELECT id, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^00', '') AS d FROM r),
  h AS (SELECT id, CASE WHEN length(d) = 10 AND starts_with(d, '0') THEN '972' || substr(d, 2) WHEN length(d) = 9 AND starts_with(d, '5') THEN '972' || d ELSE d END AS d FROM d)
  SELECT id, CASE WHEN length(d) BETWEEN 8 AND 15 THEN d END AS phone FROM h""",
    "tx17_control_phone": f"SELECT id, phone FROM ({_CONTROL.format(raw=_RAW_PHONE)})",
    "tx17_recipient_of": f"""SELECT id, CASE WHEN cast(id AS int) % 5 = 4 THEN 'g-' || id || '@g.us' WHEN length(phone) BETWEEN 8 AND 15 THEN phone END AS recipient FROM ({_CONTROL.format(raw=_RAW_PHONE)})""",
    "tx22_read_answer": f"""WITH t AS (SELECT id, CASE id % 5 WHEN 0 THEN ' Yes! ' WHEN 1 THEN 'no.' WHEN 2 THEN 'כן' WHEN 3 THEN 'maybe' ELSE text END AS said, CASE id % 2 WHEN 0 THEN 'שלום' ELSE text END AS other FROM #messages),
  b AS (SELECT *, lower(regexp_replace(ltrim(said), '\\s*[.!]*\\s*$', '')) AS bare FROM t)
  SELECT id, CASE WHEN bare IN {_WORDS(tx.YES)} THEN 'yes' WHEN bare IN {_WORDS(tx.NO)} THEN 'no' END AS answer, regexp_matches(other, '[\\x{{0590}}-\\x{{05ff}}]') AS hebrew FROM b""",
    "pf12_valid_session_id": """WITH v AS (SELECT id, CASE id % 4 WHEN 0 THEN text WHEN 1 THEN 'wa_' || wa_id WHEN 2 THEN number_id || ':' || wa_id ELSE repeat(wa_id, 60) END AS value FROM #messages)
  SELECT id, length(value) <= 120 AND regexp_matches(value, '^[A-Za-z0-9_.:+-]+$') AND NOT regexp_matches(value, '(?i)^wal?_') AS valid FROM v""",
    "ss06_append_exchange": """WITH e AS (SELECT id, agent_id, CASE WHEN cast(id AS int) % 2 = 0 THEN source ELSE 'x' END AS source, list_concat(roles, texts) AS new FROM #chat_sessions WHERE cast(id AS int) % 3 = 0)
  SELECT s.id, sha256(array_to_string(CASE WHEN new IS NULL THEN list_transform(list_zip(roles, texts), lambda m: m[1] || ':' || m[2])
    ELSE list_concat(list_transform(list_zip(roles, texts), lambda m: m[1] || ':' || m[2]), list_transform(list_zip(roles, texts), lambda m: m[1] || ':' || m[2])) END, chr(10))) AS messages
  FROM #chat_sessions s LEFT JOIN e ON e.id = s.id AND e.agent_id = s.agent_id AND e.source = s.source""",
    "jn05_find_tables": """WITH w AS (SELECT id, org_id, CASE WHEN cast(id AS int) % 2 = 0 THEN org_id ELSE 'nation-' || org_id END AS ref FROM #users)
  SELECT w.id AS request_id, o.id AS table_id FROM w JOIN #organizations o ON o.id = w.org_id AND (o.id = w.ref OR translate(lower(o.name), '_-. ', '') = translate(lower(w.ref), '_-. ', ''))""",
    "ag11_starter_drift": f"SELECT id, {_SNAPSHOT.format(title='title')} <> {_SNAPSHOT.format(title="CASE WHEN agent_id = '3' THEN upper(title) ELSE title END")} AS drifted FROM #bots b",
}

QUERIES: dict = {}
ORACLES = {k: with_views(v) for group in (TEXTS, SEARCH, ADDRESSES, PAGES, CONVERSATIONS, MACHINES, CALENDARS, RULES) for k, v in group.items()}
