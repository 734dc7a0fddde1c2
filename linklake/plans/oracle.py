"""The same results in plain SQL for the checking engine, written independently of the operators.

Each text is one SELECT over the raw tables. Rules are restated with list functions, windows and
recursive queries; only the fixed value lists are shared.
"""

from __future__ import annotations

from .. import rules
from .bridge import FETCH_LOG, KEYSTROKES, MESSAGES, POSTS, SIGHTINGS, SITE_LOG

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


WS = "chr(32) || chr(9) || chr(10) || chr(13)"
LOCALE = "|".join(rules.LOCALE_LABELS)
DEPTH = "depth(h, d) AS (VALUES " + ", ".join(f"({q(h)}, {n})" for h, n in rules.PATH_DEPTH.items()) + ")"


def canon(src: str, out: str, url: str = "url") -> str:
    """CTEs that give ``out``: rows of ``src`` with ``host, path, params, query, frag, canon``."""
    return f"""
{out}_0 AS (SELECT *, rtrim(trim({url}, {WS}), {q(rules.TRAILING_PUNCTUATION)}) AS s0 FROM {src}),
{out}_1 AS (SELECT *, CASE WHEN regexp_matches(s0, '^(?i:https?://)') THEN s0
   WHEN regexp_matches(s0, '^(?i:[a-z0-9-]+(\\.[a-z0-9-]+)+(/|$))') THEN 'https://' || s0 END AS s1 FROM {out}_0),
{out}_2 AS (SELECT *, regexp_extract(s1, '^[A-Za-z]+:/+([^/?#]*)', 1) AS auth, regexp_replace(s1, '^[A-Za-z]+:/+[^/?#]*', '') AS tail
   FROM {out}_1 WHERE s1 IS NOT NULL),
{out}_3 AS (SELECT *, rtrim(regexp_replace(lower(regexp_replace(auth, '^.*@', '')), ':(80|443)?$', ''), '.') AS host,
   split_part(tail, '#', 1) AS pq, CASE WHEN strpos(tail, '#') > 0 THEN substr(tail, strpos(tail, '#')) ELSE '' END AS frag0 FROM {out}_2),
{out}_4 AS (SELECT *, CASE WHEN rtrim(split_part(pq, '?', 1), '/') = '' THEN '/' ELSE rtrim(split_part(pq, '?', 1), '/') END AS path,
   list_sort(list_filter(string_split(CASE WHEN strpos(pq, '?') > 0 THEN substr(pq, strpos(pq, '?') + 1) ELSE '' END, '&'),
     lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), {q(rules.TRACKING_PARAM)}))) AS params,
   CASE WHEN frag0 IN ('#', '#/') THEN '' ELSE frag0 END AS frag FROM {out}_3 WHERE regexp_matches(host, '^[^\\s<>^|%:]+$')),
{out} AS (SELECT * EXCLUDE (s0, s1, auth, tail, pq, frag0),
   CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS query,
   'https://' || host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END || frag AS canon FROM {out}_4)"""


def site_of(host: str = "host") -> str:
    root = f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.')"
    rest = f"regexp_replace({host}, '^(({LOCALE})\\.)+', '')"
    return (
        f"CASE WHEN list_contains({lst(rules.USER_SPACE_HOSTS)}, {root}) AND {host} <> {root} THEN {host} "
        f"WHEN contains({rest}, '.') THEN {rest} ELSE {root} END"
    )


def keyed(src: str, out: str) -> str:
    """CTEs that add ``site`` and the resource ``key`` to rows with host and path."""
    return f"""
{DEPTH},
{out}_s AS (SELECT *, {site_of()} AS site FROM {src}),
{out} AS (SELECT s.* , CASE WHEN coalesce(t.d, 0) = 0 THEN s.site ELSE concat_ws('/', s.site, nullif(lower(array_to_string(
    list_slice(list_filter(string_split(s.path, '/'), lambda x: x <> ''), 1, t.d), '/')), '')) END AS key
  FROM {out}_s s LEFT JOIN depth t ON s.site = t.h OR ends_with(s.site, '.' || t.h))"""


def link_key() -> str:
    post = "regexp_extract(canon, '(?i)(?:twitter|x)\\.com/[^/]+/status(?:es)?/(\\d+)', 1)"
    path = "rtrim(regexp_replace(path, '(?i)\\.git$', ''), '/')"
    return (
        f"CASE WHEN {post} <> '' THEN 'x.com/status/' || {post} ELSE {site_of()} || "
        f"CASE WHEN {path} <> '' THEN {path} WHEN query <> '' THEN '/' ELSE '' END || query END"
    )


def screened(src: str, out: str, blocked: bool = False) -> str:
    """CTEs that add ``reasons, is_private, ancestor``; ``blocked`` expects a list column of that name."""
    k = "split_part(x, '=', 1)"
    v = "substr(x, strpos(x, '=') + 1)"
    hard, soft = lst(rules.HARD_PATHS), lst(rules.SOFT_PATHS)
    extra = "list_transform(coalesce(blocked, []), lambda b: 'blocklist:' || b)" if blocked else "[]"
    no_block = "AND len(coalesce(blocked, [])) = 0" if blocked else ""
    return f"""
{out}_a AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs,
  CASE WHEN regexp_matches(host, {q(rules.PRIVATE_NETWORK)}) THEN 'private-network' END AS r1,
  list_filter(list_slice(string_split(host, '.'), 1, greatest(len(string_split(host, '.')) - 2, 0)), lambda x: list_contains({lst(rules.PRIVATE_LABELS)}, x))[1] AS r2,
  list_filter({hard}, lambda p: contains(lower(path), p))[1] AS r3, list_filter({soft}, lambda p: contains(lower(path), p))[1] AS r4,
  list_filter(params, lambda x: regexp_matches({k}, {q(rules.SECRET_PARAM)}) OR (length({v}) > 60 AND regexp_matches({v}, {q(rules.OPAQUE_VALUE)})))[1] AS r5
 FROM {src}),
{out}_b AS (SELECT *, list_filter(list_concat([r1, 'host-prefix:' || r2, 'path:' || r3, 'soft-path:' || r4,
   'query:' || split_part(r5, '=', 1) || CASE WHEN regexp_matches(split_part(r5, '=', 1), {q(rules.SECRET_PARAM)}) THEN '' ELSE '(opaque)' END,
   CASE WHEN frag <> '' AND regexp_matches(frag, {q(rules.SECRET_FRAGMENT)}) THEN 'fragment-credential' END,
   CASE WHEN regexp_matches(lower(path), {q(rules.FILE_PATH)}) THEN 'direct-file' END], {extra}), lambda r: r IS NOT NULL) AS reasons FROM {out}_a),
{out}_c AS (SELECT *, len(reasons) > 0 AND NOT (len(list_filter(reasons, lambda r: NOT starts_with(r, 'soft-path:'))) = 0 AND len(segs) <= 1 AND query = '') AS is_private FROM {out}_b),
{out} AS (SELECT * EXCLUDE (labels, r1, r2, r3, r4, r5),
  CASE WHEN is_private AND r1 IS NULL AND r2 IS NULL {no_block} THEN 'https://' || host || list_filter(list_transform(range(len(segs) - 1, -1, -1),
    lambda i: '/' || array_to_string(list_slice(segs, 1, i), '/')),
    lambda p: len(list_filter({hard}, lambda w: contains(lower(p), w))) = 0 AND NOT regexp_matches(lower(p), {q(rules.FILE_PATH)})
      AND (len(list_filter(string_split(p, '/'), lambda z: z <> '')) <= 1 OR len(list_filter({soft}, lambda w: contains(lower(p), w))) = 0))[1] END AS ancestor
  FROM {out}_c)"""


RANK = "len(list_filter(string_split(path, '/'), lambda x: x <> '')) * 100000000 + (query <> '')::INT * 10000000 + (frag <> '')::INT * 1000000 + length(canon)"


def placed(src: str = "v", out: str = "placed") -> str:
    """Sightings with their final address, flag, key and rank."""
    return f"""{canon(src, 'pc')}, {screened('pc', 'ps')},
pf AS (SELECT * EXCLUDE (path, query, frag, canon, url), CASE WHEN ancestor IS NOT NULL THEN substr(ancestor, length('https://' || host) + 1) ELSE path END AS path,
  CASE WHEN ancestor IS NOT NULL THEN '' ELSE query END AS query, CASE WHEN ancestor IS NOT NULL THEN '' ELSE frag END AS frag,
  coalesce(ancestor, canon) AS canon, CASE WHEN is_private THEN CASE WHEN ancestor IS NOT NULL THEN 'demoted' ELSE 'private' END END AS flag FROM ps),
{keyed('pf', 'pk')}, {out} AS (SELECT *, {RANK} AS rank,
  -- sources that differ only in who gave them are one source: the first one given
  first_value(src_by IGNORE NULLS) OVER (PARTITION BY key ORDER BY sighting_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS mby FROM pk)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(x.strip() for x in ctes) + "\n"


V = f"v AS ({SIGHTINGS})"
M = f"m AS ({MESSAGES})"

ORACLE["canonical_urls"] = with_(V, canon("v", "k")) + "SELECT sighting_id, canon AS canonical_url, host FROM k"
ORACLE["resource_keys"] = with_(V, canon("v", "k"), keyed("k", "r")) + "SELECT sighting_id, site, key FROM r"
ORACLE["best_urls"] = (
    with_(V, canon("v", "k"), keyed("k", "r"), f"z AS (SELECT key, canon, row_number() OVER (PARTITION BY key ORDER BY {RANK}, sighting_id) AS n FROM r)")
    + "SELECT key, canon AS url FROM z WHERE n = 1"
)
URLS_IN = "regexp_extract_all(text, 'https?://\\S+')"
ORACLE["link_keys"] = (
    with_(M, f"u AS (SELECT msg_id, unnest({URLS_IN}) AS url, unnest(range(len({URLS_IN}))) AS n FROM m)", canon("u", "k"))
    + f"SELECT msg_id, CAST(n AS INT) AS n, {link_key()} AS key, nullif(regexp_extract(canon, '(?i)(?:twitter|x)\\.com/[^/]+/status(?:es)?/(\\d+)', 1), '') AS post_id FROM k"
)
ORACLE["privacy_screen"] = with_(V, canon("v", "k"), screened("k", "s")) + (
    "SELECT sighting_id, CASE WHEN is_private THEN 'private' ELSE 'public' END AS kind, is_private, array_to_string(reasons, '|') AS reasons, "
    "ancestor AS public_ancestor FROM s"
)
BLOCK = canon("pages", "bk") + f", bl AS (SELECT DISTINCT {site_of()} AS domain FROM bk WHERE regexp_matches(host, 'pills|spam'))"
ORACLE["blocklist_screen"] = with_(
    V, BLOCK, canon("v", "k"),
    "hb AS (SELECT host AS h, list_sort(list(domain)) AS blocked FROM (SELECT DISTINCT host FROM k) JOIN bl ON host = domain OR ends_with(host, '.' || domain) GROUP BY 1)",
    "kb AS (SELECT k.*, hb.blocked FROM k LEFT JOIN hb ON k.host = hb.h)", screened("kb", "s", True),
) + "SELECT sighting_id, is_private, array_to_string(reasons, '|') AS reasons, ancestor AS public_ancestor FROM s"

# --- posts -------------------------------------------------------------------------------

P = f"p AS ({POSTS})"
LINK = r"""https?://[^\s<>"'）)】\]，,；;]+"""
ANY = r"""https?://[^\s<>"'）)】\]]+"""
SP = r"[\s\x{00a0}\x{3000}]"
ORD = rf"^{SP}*(?:[（(]?\d{{1,3}}[.)、．:：]|[-*·•‣・▪]|[①-⑳]|[⓪-⓿]){SP}*"
SEP_AFTER = r"[：:\-—–|｜>》→\s]+$"
SEP_BEFORE = r"^[\s：:\-—–|｜(（【\[]*(?:——|--)?[\s：:\-—–]*"
LEAD = r"^[👉➡️→▶️\s·•\-—:：]*"


def trimmed(x: str) -> str:
    return f"trim({x}, {WS})"


def cleaned(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, {q(rules.EMOJI)}, '', 'g'), '\\s+', ' ', 'g'))"


def named(x: str) -> str:
    return cleaned(f"regexp_replace(regexp_replace({x}, {q(ORD)}, ''), {q(SEP_AFTER)}, '')")


def label(x: str) -> str:
    bare = trimmed(f"regexp_replace({x}, {q(rules.EMOJI)}, '', 'g')")
    return (
        f"({bare} <> '' AND NOT regexp_matches({x}, {q(LINK)}) AND NOT regexp_matches({x}, {q(ORD)}) AND NOT regexp_matches({bare}, {q(rules.LABEL_END)}) "
        f"AND NOT regexp_matches({bare}, {q(rules.NARRATION)}) AND CASE WHEN regexp_matches({bare}, {q(rules.CJK_LETTER)}) THEN length({bare}) <= 8 "
        f"ELSE len(regexp_split_to_array({bare}, '\\s+')) <= 3 AND length({bare}) <= 24 END)"
    )


LINES = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"
ROWS = f"ln AS (SELECT post_id, unnest({LINES}) AS line, unnest(range(len({LINES}))) AS n FROM p)"
ORACLE["post_links"] = with_(
    P, f"u AS (SELECT post_id, unnest(regexp_extract_all(text, {q(ANY)})) AS url, unnest(range(len(regexp_extract_all(text, {q(ANY)})))) AS pos FROM p)", canon("u", "k"),
    "f AS (SELECT post_id, pos, canon AS url, starts_with(canon, 'https://t.co/') AS shortened FROM k)",
) + "SELECT post_id, CAST(min(pos) AS INT) AS pos, url, shortened FROM f GROUP BY post_id, url, shortened, CASE WHEN shortened THEN pos END"
POST_CTES = (
    P, ROWS,
    f"""l1 AS (SELECT *, {trimmed('line')} = '' AS blank, regexp_matches(line, {q(LINK)}) AS linked, {label('line')} AS label,
      len(regexp_extract_all(line, {q(LINK)})) = 1 AND starts_with(regexp_replace({trimmed('line')}, {q(LEAD)}, ''), regexp_extract(line, {q(LINK)})) AS bare FROM ln)""",
    """l2 AS (SELECT *, first_value(CASE WHEN NOT blank THEN bare END IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bare,
      lag({'t': line, 'b': blank, 'k': linked}, 1) OVER w AS u1, lag({'t': line, 'b': blank, 'k': linked}, 2) OVER w AS u2,
      lead({'t': line, 'b': blank, 'k': linked}, 1) OVER w AS dn FROM l1 WINDOW w AS (PARTITION BY post_id ORDER BY n))""",
    f"""l3 AS (SELECT *, last_value(CASE WHEN NOT linked AND NOT blank AND label AND NOT coalesce(next_bare, FALSE) THEN {cleaned('line')} END IGNORE NULLS)
      OVER (PARTITION BY post_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sec,
      CASE WHEN u1.t IS NOT NULL AND NOT u1.b THEN u1 WHEN u2.t IS NOT NULL AND NOT u2.b THEN u2 END AS up FROM l2)""",
    f"""l4 AS (SELECT post_id, n, line, nullif(sec, '') AS section, CASE WHEN bare AND NOT up.k THEN {named(trimmed('up.t'))} END AS above,
      CASE WHEN dn.t IS NOT NULL AND NOT dn.b AND NOT dn.k AND NOT {label(trimmed('dn.t'))} AND NOT regexp_matches({trimmed('dn.t')}, {q(ORD)}) THEN {cleaned('dn.t')} END AS below,
      unnest(regexp_extract_all(line, {q(LINK)})) AS raw, unnest(range(len(regexp_extract_all(line, {q(LINK)})))) AS k FROM l3 WHERE linked)""",
    canon("l4", "c4", "raw"),
    f"""f1 AS (SELECT post_id, n, k, canon AS url, section, coalesce(nullif({named("substr(line, 1, strpos(line, raw) - 1)")}, ''), above, '') AS nm,
      coalesce(nullif({cleaned("regexp_replace(substr(line, strpos(line, raw) + length(raw)), " + q(SEP_BEFORE) + ", '')")}, ''), below, '') AS nt
      FROM c4 WHERE NOT starts_with(canon, 'https://t.co/'))""",
    """f2 AS (SELECT *, length(nm) > 40 OR regexp_matches(nm, '[。！？]') AS prose FROM f1)""",
    """f3 AS (SELECT post_id, n, k, url, nullif(CASE WHEN prose THEN '' ELSE nm END, '') AS name, nullif(CASE WHEN prose AND nt = '' THEN nm ELSE nt END, '') AS note,
      CASE WHEN count(*) OVER (PARTITION BY post_id, section) >= 2 THEN section END AS section FROM f2)""",
    """f4 AS (SELECT *, row_number() OVER (PARTITION BY post_id, url ORDER BY (name IS NOT NULL)::INT * 2 + (note IS NOT NULL)::INT + (section IS NOT NULL)::INT DESC, n, k) AS best,
      first_value(n) OVER (PARTITION BY post_id, url ORDER BY n, k) AS n0, first_value(k) OVER (PARTITION BY post_id, url ORDER BY n, k) AS k0 FROM f3)""",
)
ORACLE["post_resources"] = with_(*POST_CTES) + "SELECT post_id, CAST(n0 AS INT) AS line, CAST(k0 AS INT) AS k, url, name, note, section FROM f4 WHERE best = 1"
ORACLE["post_library"] = with_(
    *POST_CTES, "fx AS (SELECT f4.post_id, f4.url AS link, p.author, f4.n0, f4.k0 FROM f4 JOIN p USING (post_id) WHERE best = 1)",
    canon("fx", "fc", "link"), keyed("fc", "fk"),
) + f"""SELECT key, count(DISTINCT author) AS mentions, '' AS flags FROM fk GROUP BY key"""
ORACLE["post_contexts"] = with_(
    P, ROWS, f"b AS (SELECT post_id, min(n) AS cut FROM ln WHERE regexp_matches(line, {q(LINK)}) GROUP BY 1)",
    f"c AS (SELECT ln.post_id, string_agg({trimmed('line')}, ' ' ORDER BY n) AS t FROM ln LEFT JOIN b USING (post_id) WHERE (cut IS NULL OR n < cut) AND {trimmed('line')} <> '' GROUP BY 1)",
) + "SELECT p.post_id, nullif(c.t, '') AS context FROM p LEFT JOIN c USING (post_id)"
LEADS = (
    f"b AS (SELECT post_id, n, {cleaned('regexp_split_to_array(' + trimmed('regexp_replace(line, ' + q(ORD) + ', ' + q('') + ')') + ', ' + q(rules.LEAD_STOP) + ')[1]')} AS name FROM ln "
    f"WHERE regexp_matches(line, {q(ORD)}) AND NOT regexp_matches(line, {q(LINK)}))"
)
ORACLE["post_leads"] = with_(P, ROWS, LEADS) + "SELECT post_id, name, CAST(min(n) AS INT) AS pos FROM b WHERE name <> '' GROUP BY 1, 2"
ORACLE["collected_inputs"] = with_(
    *POST_CTES, LEADS, V, f"pu AS (SELECT post_id, unnest(regexp_extract_all(text, {q(ANY)})) AS url FROM p)", canon("pu", "pk"),
    "pl AS (SELECT DISTINCT post_id FROM pk WHERE NOT starts_with(canon, 'https://t.co/'))",
    "pn AS (SELECT post_id, count(DISTINCT name) AS names FROM b WHERE name <> '' GROUP BY 1)",
    "aq AS (SELECT sighting_id, CAST(page_id AS VARCHAR) AS post_id FROM v WHERE page_id % 3 = 1)",
    "st AS (SELECT aq.*, p.post_id IS NOT NULL AS read, pl.post_id IS NOT NULL AS linked, names FROM aq LEFT JOIN p USING (post_id) LEFT JOIN pl USING (post_id) LEFT JOIN pn USING (post_id))",
    "iv AS (SELECT sighting_id, CASE page_id % 3 WHEN 0 THEN url ELSE 'no link ' || url END AS raw FROM v WHERE page_id % 3 <> 1)", canon("iv", "ic", "raw"),
    """al AS (SELECT 'x' AS what, count(*) AS n FROM f4 WHERE best = 1 AND post_id IN (SELECT post_id FROM aq)
 UNION ALL SELECT 'manual', count(DISTINCT sighting_id) FROM ic WHERE canon IS NOT NULL
 UNION ALL SELECT 'not a URL', count(*) FROM iv WHERE sighting_id NOT IN (SELECT sighting_id FROM ic WHERE canon IS NOT NULL)
 UNION ALL SELECT CASE WHEN NOT read THEN 'post could not be read' WHEN names IS NOT NULL THEN 'no links in the post, but it names resources' ELSE 'post had no links' END, count(*) FROM st WHERE NOT linked GROUP BY 1
 UNION ALL SELECT 'leads', sum(names) FROM st WHERE NOT linked AND names IS NOT NULL)""",
) + "SELECT what, CAST(n AS BIGINT) AS n FROM al WHERE n > 0"
ENT = "h"
for _p, _t in [("&(?:amp|#38);", "&"), ("&(?:lt|#60);", "<"), ("&(?:gt|#62);", ">"), ("&(?:quot|#34);", '"'), ("&(?:apos|#39);", "'"), ("&nbsp;", " ")]:
    ENT = f"regexp_replace({ENT}, {q(_p)}, {q(_t)}, 'g')"


def title_of(html: str) -> str:
    raw = f"trim(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1), {WS})"
    return f"nullif(regexp_replace({ENT.replace('(h,', '(' + raw + ',')}, '\\s+', ' ', 'g'), '')"


ORACLE["page_metadata"] = (
    f"SELECT page_id, {title_of('html')} AS title, CAST(NULL AS VARCHAR) AS og_title, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS site_name, "
    "CAST(NULL AS VARCHAR) AS image, nullif(regexp_extract(html, '(?i)<html[^>]+lang\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), '') AS lang FROM pages"
)

# --- links in messages -------------------------------------------------------------------

ML = rules.MESSAGE_LINK
PICKS = f"""m0 AS (SELECT * EXCLUDE (text), regexp_replace(text, '(?m)^[^\\S\\n]*>[^\\n]*', '', 'g') AS own FROM m WHERE NOT regexp_matches(text, {q(rules.RELAYED)})),
m1 AS (SELECT *, regexp_extract_all(own, {q(ML)}) AS ls, regexp_split_to_array(own, {q(ML)}) AS gs FROM m0),
m2 AS (SELECT msg_id, session, cwd, tm, own, unnest(ls) AS hit, unnest(range(len(ls))) AS idx,
  unnest(list_transform(range(len(ls)), lambda i: coalesce(list_sum(list_transform(gs[1:i+1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(ls[1:i], lambda g: length(g))), 0))) AS pos FROM m1),
m3 AS (SELECT *, regexp_replace(hit, '[.,;:!?*]+$', '') AS raw FROM m2),
m4 AS (SELECT *, substr(own, CAST(greatest(pos - 100, 0) AS BIGINT) + 1, CAST(least(pos, 100) AS BIGINT)) AS b0, substr(own, CAST(pos AS BIGINT) + length(raw) + 1, 100) AS a0 FROM m3),
m5 AS (SELECT * EXCLUDE (own, hit), CASE WHEN pos - 100 > 0 THEN regexp_replace(b0, '^[^。！？!?\\n]*[。！？!?\\n]', '') ELSE b0 END AS b1,
  CASE WHEN pos + length(raw) + 100 < length(own) AND regexp_matches(a0, '[。！？!?\\n]') THEN regexp_extract(a0, '(?s)^(.*[。！？!?\\n])', 1) ELSE a0 END AS a1 FROM m4),
m6 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b1 || ' ' || a1, {q(ML)}, ' ', 'g'), '</?pasted_content[^>]*>', ' ', 'g'), '\\[Image #\\d+\\]', ' ', 'g'), '\\s+', ' ', 'g')) AS said FROM m5),
{canon('m6', 'mc', 'raw')}, {screened('mc', 'ms')},
mk AS (SELECT msg_id, session, cwd, tm, idx, said, canon AS url, {link_key()} AS key FROM ms WHERE NOT is_private AND regexp_matches(host, '(?i)\\.[a-z]{{2,}}$') AND NOT regexp_matches(host, '^\\d+(\\.\\d+){{3}}$')),
mn AS (SELECT *, row_number() OVER (PARTITION BY msg_id, key ORDER BY idx) AS nth FROM mk WHERE """ + " AND ".join(
    f"NOT regexp_matches(key, {q(r.replace('i/(?!web/status)', 'i/home'))})" for r in rules.NOT_A_RESOURCE
) + "), pk AS (SELECT * FROM mn WHERE nth = 1)"
ORACLE["captured_links"] = with_(M, PICKS) + "SELECT msg_id, key, url, said FROM pk"
ORACLE["ignored_links"] = with_(
    M, PICKS, BLOCK, canon("pages", "gk"), f"g1 AS (SELECT DISTINCT regexp_extract({link_key()}, '^[^/]+/(?:en|de)') AS pre FROM gk)",
) + """SELECT msg_id, key FROM pk WHERE NOT EXISTS (SELECT 1 FROM bl WHERE regexp_extract(lower(key), '^[^/?#]*') = domain OR ends_with(regexp_extract(lower(key), '^[^/?#]*'), '.' || domain))
 AND NOT EXISTS (SELECT 1 FROM g1 WHERE pre <> '' AND (lower(key) = pre OR starts_with(lower(key), pre || '/')))"""

# --- library -----------------------------------------------------------------------------

MENTION = "CASE src_type WHEN 'x' THEN 'x:' || coalesce(src_author, src_post_id, '') WHEN 'chrome' THEN 'chrome:' || coalesce(src_folder, 'default') ELSE src_type || ':' || coalesce(mby, '') END"
SHADOW = lambda x: "(" + " OR ".join(f"contains({x}, {q(n)})" for n in rules.SHADOW_NAMES) + ")"
WORDS = lambda x: f"regexp_matches({x}, {q(rules.RISK_WORDS)})"
LIB = f"""{V}, {placed()},
lead AS (SELECT *, coalesce(rank < min(rank) OVER (PARTITION BY key ORDER BY sighting_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS leads FROM placed),
lf AS (
 SELECT key, flag FROM placed WHERE flag IS NOT NULL
 UNION SELECT key, unnest(['legal_risk', 'shadow_library']) FROM lead WHERE leads AND ({SHADOW('canon')} OR {SHADOW('key')})
 UNION SELECT key, 'legal_risk' FROM lead WHERE {WORDS('name')} OR {WORDS('note')} OR {WORDS('section')} OR {WORDS('key')} OR (leads AND {WORDS('canon')})
 UNION SELECT key, 'legal_risk' FROM placed GROUP BY key HAVING bool_or(regexp_matches(section, {q(rules.MEDIA_SECTION)}))
   AND bool_or(regexp_matches(note, {q(rules.FREE_FRAMING)}) OR (src_type <> 'chrome' AND regexp_matches(section, {q(rules.FREE_FRAMING)})))
 UNION SELECT key, unnest(['ephemeral', 'legal_risk']) FROM lead WHERE leads AND regexp_matches(canon, {q(rules.SHARE_HOST)})),
head AS (SELECT key, arg_min(canon, {{'r': rank, 's': sighting_id}}) AS url, count(DISTINCT {MENTION}) AS mentions, min(seen_at) AS first_seen, max(seen_at) AS last_seen,
  bool_or(src_type <> 'chrome') AS vouched, arg_min(name, sighting_id) AS name1, arg_min(note, sighting_id) AS claim1, arg_min(tag, sighting_id) AS tag1,
  arg_min(section, sighting_id) FILTER (src_type <> 'chrome') AS sec1, arg_min(section, sighting_id) FILTER (src_type = 'chrome') AS lsec1 FROM placed GROUP BY key)"""


def ordered(name: str, value: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT key, string_agg(x, '|' ORDER BY o) AS x FROM (SELECT key, {value} AS x, min(sighting_id) AS o FROM placed WHERE {where} GROUP BY 1, 2) GROUP BY 1)"


TS = lambda x: f"strftime({x}, '%Y-%m-%d %H:%M:%S')"
ORACLE["library_upsert"] = with_(LIB) + f"""SELECT key, 'name' AS kind, name AS value, NULL AS origin, min(sighting_id) AS place FROM placed WHERE name <> '' GROUP BY ALL
 UNION ALL SELECT key, CASE src_type WHEN 'chrome' THEN 'local_section' ELSE 'section' END, section, NULL, min(sighting_id) FROM placed WHERE section <> '' GROUP BY ALL
 UNION ALL SELECT key, 'tag', tag, NULL, min(sighting_id) FROM placed WHERE tag <> '' GROUP BY ALL
 UNION ALL SELECT key, 'claim', note, arg_min(CASE src_type WHEN 'chrome' THEN src_folder ELSE src_type END, sighting_id), min(sighting_id) FROM placed WHERE note <> '' GROUP BY key, note
 UNION ALL SELECT key, 'flag', flag, NULL, NULL FROM lf
 UNION ALL SELECT key, 'n_sources', CAST(count(DISTINCT concat_ws('~', src_type, coalesce(src_post_id, src_folder, ''), coalesce(src_author, ''))) AS VARCHAR), NULL, NULL FROM placed GROUP BY key
 UNION ALL SELECT key, 'url', url, NULL, NULL FROM head UNION ALL SELECT key, 'mentions', CAST(mentions AS VARCHAR), NULL, NULL FROM head
 UNION ALL SELECT key, 'first_seen', {TS('first_seen')}, NULL, NULL FROM head UNION ALL SELECT key, 'last_seen', {TS('last_seen')}, NULL, NULL FROM head"""
ORACLE["upsert_created"] = with_(V, placed()) + (
    "SELECT key, count(*) AS sightings, key NOT IN (SELECT key FROM placed WHERE sighting_id % 4 = 0) AS created FROM placed WHERE sighting_id % 4 <> 0 GROUP BY key"
)
ORACLE["corroboration"] = with_(V, placed()) + f"SELECT key, count(DISTINCT {MENTION}) AS mentions FROM placed GROUP BY key"
ORACLE["risk_flags"] = with_(LIB) + "SELECT key, flag FROM lf"
ORACLE["flag_list"] = with_(LIB) + "SELECT key, mentions FROM head JOIN lf USING (key) WHERE flag = 'demoted'"

# --- fetches -----------------------------------------------------------------------------

STATUS = """CASE WHEN regexp_matches(error, '(?i)abort|timeout') THEN 'unknown' WHEN regexp_matches(error, '(?i)ENOTFOUND|EAI_AGAIN|getaddrinfo|dns') THEN 'dead'
 WHEN regexp_matches(error, '(?i)ECONNREFUSED|ECONNRESET|EHOSTUNREACH|ENETUNREACH') THEN 'dead' WHEN error IS NOT NULL THEN 'unknown'
 WHEN code BETWEEN 200 AND 299 THEN CASE WHEN challenge THEN 'blocked' ELSE 'alive' END WHEN code IN (403, 429, 503) THEN 'blocked' WHEN code IN (404, 410) THEN 'dead' ELSE 'unknown' END"""
NOTE = """CASE error WHEN 'timeout' THEN 'timeout' WHEN 'ENOTFOUND' THEN 'dns-failure' WHEN 'ECONNREFUSED' THEN 'unreachable'
 ELSE CASE WHEN code IN (403, 429, 503) THEN CASE WHEN challenge THEN 'bot-challenge' ELSE 'http ' || code END WHEN code >= 500 THEN 'server error ' || code END END"""
FL = f"""fl0 AS ({FETCH_LOG}), fl1 AS (SELECT *, regexp_matches(html, {q(rules.CHALLENGE_PAGE)}) AS challenge FROM fl0)"""
ORACLE["liveness_verdicts"] = with_(FL) + f"SELECT page_id, {STATUS} AS status, {NOTE} AS note FROM fl1"


def checked() -> str:
    """Library plus the latest verdict per key, as ``ck``."""
    k1 = canon("fl1", "fc")
    k2 = keyed("fc", "fk").replace(DEPTH + ",", "", 1)
    return f"""{LIB}, {FL}, {k1}, {k2},
fv AS (SELECT key, page_id, code, final_url, checked_at, {STATUS} AS status, CASE WHEN error IS NULL THEN {title_of('html')} END AS title,
  CASE WHEN error IS NULL THEN nullif(regexp_extract(html, '(?i)<html[^>]+lang\\s*=\\s*["'']([^"'']+)["'']', 1), '') END AS lang FROM fk),
fw AS (SELECT * FROM fv WHERE key IN (SELECT key FROM head) QUALIFY row_number() OVER (PARTITION BY key ORDER BY checked_at DESC) = 1),
cf AS (SELECT key, flag FROM lf UNION SELECT key, 'legal_risk' FROM fw WHERE status <> 'dead' AND {WORDS('title')}),
cx AS (SELECT key, list_sort(list(flag)) AS flags FROM cf GROUP BY 1),
ck AS (SELECT h.*, coalesce(cx.flags, []) AS flags, w.status, w.code, w.final_url, w.checked_at, CASE WHEN w.status <> 'dead' THEN w.title END AS title,
  CASE WHEN w.status <> 'dead' THEN w.lang END AS lang FROM head h LEFT JOIN cx USING (key) LEFT JOIN fw w USING (key)),
gate AS (SELECT *, CASE WHEN list_contains(flags, 'private') THEN 'private' WHEN list_contains(flags, 'legal_risk') THEN 'legal_risk'
  WHEN list_contains(flags, 'demoted') AND NOT vouched THEN 'demoted-without-public-source' WHEN status = 'dead' THEN 'dead' END AS why FROM ck)"""


CK = checked()
ORACLE["publish_gate"] = with_(CK) + "SELECT key, why, mentions FROM gate"
ORACLE["held_counts"] = with_(CK) + "SELECT why, count(*) AS n FROM gate WHERE why IS NOT NULL GROUP BY 1"
ORACLE["published_sources"] = with_(
    CK, """sd AS (SELECT key, src_type, coalesce(src_post_id, src_folder, '') AS place, coalesce(src_author, '') AS au, arg_min(src_author, sighting_id) AS author,
      arg_min(seen_at, sighting_id) AS tm FROM placed WHERE key IN (SELECT key FROM gate WHERE why IS NULL) GROUP BY 1, 2, 3, 4)""",
) + """SELECT key, CASE src_type WHEN 'chrome' THEN 'bookmark' ELSE src_type END AS type, count(*) AS n, count(author) AS authors, CAST(0 AS BIGINT) AS folders, CAST(0 AS BIGINT) AS people,
 CAST(CASE src_type WHEN 'x' THEN 19 ELSE 7 END AS BIGINT) AS at_chars FROM sd GROUP BY key, src_type"""
ORACLE["library_stats"] = with_(CK) + """SELECT 'entries' AS metric, 'all' AS label, count(*) AS n FROM ck
 UNION ALL SELECT 'corroborated', 'all', count(*) FROM ck WHERE mentions > 1
 UNION ALL SELECT 'liveness', coalesce(status, 'unchecked'), count(*) FROM ck GROUP BY 2
 UNION ALL SELECT 'flags', f, count(*) FROM (SELECT unnest(CASE WHEN len(flags) > 0 THEN flags ELSE ['clean'] END) AS f FROM ck) GROUP BY 2
 UNION ALL SELECT 'sources', src_type, count(*) FROM (SELECT DISTINCT key, src_type, coalesce(src_post_id, src_folder, ''), coalesce(src_author, '') FROM placed) GROUP BY 2"""
ORACLE["status_counts"] = with_(CK) + "SELECT status, count(*) AS n FROM ck WHERE status IS NOT NULL GROUP BY 1"
ORACLE["refresh_due"] = with_(CK) + f"""SELECT key, CASE WHEN starts_with(key, 'github.com/') THEN 'repo' ELSE 'web' END AS fetcher, {TS('checked_at')} AS checked_at FROM ck
 WHERE NOT list_contains(flags, 'private') AND (checked_at IS NULL OR checked_at < TIMESTAMP '2024-01-25 00:00:00')"""
ORACLE["verified_library"] = with_(CK) + "SELECT key, title, lang, status, CAST(code AS BIGINT) AS code, mentions FROM ck"
ORACLE["brief_entries"] = with_(
    CK, "bt AS (SELECT key, string_agg(x, '|' ORDER BY o) AS tags FROM (SELECT key, tag AS x, min(sighting_id) AS o, row_number() OVER (PARTITION BY key ORDER BY min(sighting_id)) AS r FROM placed GROUP BY 1, 2) GROUP BY 1)",
    "bc AS (SELECT key, string_agg(x, '|' ORDER BY o) AS claimed FROM (SELECT key, note AS x, min(sighting_id) AS o, row_number() OVER (PARTITION BY key ORDER BY min(sighting_id)) AS r FROM placed GROUP BY 1, 2) GROUP BY 1)",
) + "SELECT key, coalesce(title, name1) AS name, claim1 AS description, tags, claimed, coalesce(status, 'unchecked') AS status, mentions AS sources FROM ck JOIN bt USING (key) JOIN bc USING (key)"
ED0 = canon("(SELECT key AS src, final_url FROM ck WHERE final_url <> '' AND status <> 'dead')", "ec", "final_url")
EDGES = f"""{ED0}, {keyed('ec', 'ek').replace(DEPTH + ',', '', 1)}, ed AS (SELECT src, key AS dst FROM ek WHERE src <> key),
cn AS (SELECT dst, count(*) AS claimants FROM ed GROUP BY 1)"""
ORACLE["redirect_edges"] = with_(CK, EDGES) + "SELECT src, dst, claimants FROM ed JOIN cn USING (dst)"
MERGE = f"""{EDGES}, us AS (SELECT src, dst FROM ed JOIN cn USING (dst) WHERE claimants < 3),
walk(src, cur, seen) AS (SELECT src, dst, [src, dst] FROM us UNION ALL SELECT w.src, u.dst, list_append(w.seen, u.dst) FROM walk w JOIN us u ON u.src = w.cur WHERE NOT list_contains(w.seen[1:-2], w.cur)),
wl AS (SELECT src, arg_max(cur, len(seen)) AS last, arg_max(seen, len(seen)) AS seen FROM walk GROUP BY 1),
tm AS (SELECT src, CASE WHEN last IN (SELECT src FROM us) THEN list_min(seen[list_position(seen, last):]) ELSE last END AS dst FROM wl),
mv AS (SELECT src, dst, dst IN (SELECT key FROM head) OR row_number() OVER (PARTITION BY dst ORDER BY src) > 1 AS merged FROM tm WHERE src <> dst)"""
ORACLE["redirect_merge"] = with_(
    CK, MERGE, "re AS (SELECT p.* EXCLUDE (key), coalesce(mv.dst, p.key) AS key FROM placed p LEFT JOIN mv ON mv.src = p.key)",
    "al AS (SELECT dst AS key, string_agg(src, '|' ORDER BY src) AS aliases FROM mv GROUP BY 1)", recursive=True,
) + f"SELECT key, count(DISTINCT {MENTION}) AS mentions, any_value(aliases) AS aliases, {TS('min(seen_at)')} AS first_seen FROM re LEFT JOIN al USING (key) GROUP BY key"
ORACLE["lookup_alias"] = with_(
    CK, MERGE, "fm AS (SELECT h.key, coalesce(mv.dst, h.key) AS tm, coalesce(mv.merged, FALSE) AS merged, list_contains(ck.flags, 'private') AS pr FROM head h JOIN ck USING (key) LEFT JOIN mv ON mv.src = h.key)",
    "pv AS (SELECT tm, bool_or(pr) AS pr FROM fm GROUP BY 1)", recursive=True,
) + "SELECT fm.key AS name, fm.tm AS key FROM fm JOIN pv USING (tm) WHERE NOT pv.pr"
ORACLE["browse"] = with_(
    LIB, "ok AS (SELECT key FROM head WHERE key NOT IN (SELECT key FROM lf WHERE flag IN ('private', 'legal_risk')))",
) + """SELECT key, mentions FROM head WHERE key IN (SELECT key FROM ok) AND key IN (SELECT key FROM placed WHERE src_type <> 'chrome' AND contains(section, 'ction3'))
 AND key IN (SELECT key FROM placed WHERE tag = 'tag3') ORDER BY mentions DESC, key LIMIT 200"""
REPO = "SELECT *, CASE WHEN p_size % 10 = 0 THEN 404 WHEN p_size % 10 = 1 THEN 451 WHEN p_size % 10 = 2 THEN 500 ELSE 200 END AS code FROM part"
ORACLE["repo_facts"] = f"""WITH r AS ({REPO}) SELECT 'github.com/p/' || p_partkey AS key, CASE code WHEN 200 THEN 'alive' ELSE 'dead' END AS status,
 CASE code WHEN 404 THEN 'repo not found' WHEN 451 THEN 'taken down (451)' END AS note, CASE code WHEN 200 THEN p_name END AS title, CASE code WHEN 200 THEN p_type END AS description,
 CASE code WHEN 200 THEN CAST(p_size AS BIGINT) END AS stars, CASE code WHEN 200 THEN len(string_split(p_name, ' ')) END AS n_topics, CASE code WHEN 200 THEN p_size > 25 END AS archived
 FROM r WHERE code <> 500"""
SUB = f"""{CK}, sv0 AS (SELECT sighting_id, url, note FROM v), {canon('sv0', 'sc')}, {screened('sc', 'ss')}, {keyed('ss', 'sk').replace(DEPTH + ',', '', 1)},
fa AS (SELECT * FROM fv QUALIFY row_number() OVER (PARTITION BY key ORDER BY checked_at DESC) = 1),
sx AS (SELECT k.sighting_id, k.key, k.canon, k.note, k.is_private, k.ancestor, a.status, CASE WHEN a.status <> 'dead' THEN a.title END AS title, h.mentions AS known,
  CASE WHEN k.is_private THEN 'private' WHEN a.status = 'dead' THEN 'dead' END AS reason FROM sk k LEFT JOIN fa a USING (key) LEFT JOIN head h USING (key)),
sy AS (SELECT *, CASE WHEN reason IS NULL THEN list_sort(list_distinct(list_concat(CASE WHEN {SHADOW('canon')} OR {SHADOW('key')} THEN ['legal_risk', 'shadow_library'] ELSE [] END,
  CASE WHEN {WORDS("concat_ws(' ', key, canon, title, note)")} THEN ['legal_risk'] ELSE [] END, CASE WHEN regexp_matches(canon, {q(rules.SHARE_HOST)}) THEN ['ephemeral', 'legal_risk'] ELSE [] END))) END AS flags FROM sx)"""
ORACLE["submissions"] = with_(SUB) + """SELECT sighting_id AS submission_id, key, reason IS NULL AS accepted, reason, ancestor AS suggested_url, status, known IS NOT NULL AS duplicate, known AS known_mentions,
 array_to_string(flags, '|') AS flags, CASE WHEN reason IS NULL THEN coalesce((status = 'blocked')::INT, 0) + list_contains(flags, 'legal_risk')::INT + (title IS NULL)::INT END::BIGINT AS n_warnings FROM sy"""
ORACLE["submission_entries"] = with_(
    SUB, "se AS (SELECT sy.*, v.src_by FROM sy JOIN v USING (sighting_id) WHERE reason IS NULL)", 
) + "SELECT key, count(DISTINCT coalesce(src_by, '2024-02-01')) FILTER (first) AS mentions, arg_min(note, sighting_id) AS first_claim FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sighting_id) = 1 AS first FROM se) GROUP BY key"

# No page of the test tables bears a description, and no submission names a post.
ORACLE["issue_bodies"] = with_(SUB) + """SELECT sighting_id AS submission_id, 'Add: ' || coalesce(sy.title, key) AS title, array_to_string(list_filter([
 '**URL:** ' || canon, '**Key:** `' || key || '`', '', '### Result of the fetch', '', '| | |', '|---|---|',
 '| Liveness | `' || coalesce(sy.status, 'unchecked') || '`' || CASE WHEN coalesce(fa.code, 0) <> 0 THEN ' (HTTP ' || fa.code || ')' ELSE '' END ||
  coalesce(' — checked ' || strftime(fa.checked_at, '%Y-%m-%dT%H:%M:%SZ'), '') || ' |',
 '| Title | ' || coalesce(replace(sy.title, '|', '\\|'), '_not found_') || ' |', '| Description | _none_ |',
 CASE WHEN len(flags) > 0 THEN '| Flags | ' || array_to_string(list_transform(flags, lambda f: '`' || f || '`'), ', ') || ' |' END, '',
 CASE WHEN note <> '' THEN '### Reason given' || chr(10) || chr(10) || note || chr(10) END,
 CASE WHEN known IS NOT NULL THEN '> Known as `' || key || '` (' || known || ' mention(s) so far).' || chr(10) || '> Filing it adds one more, and mentions decide the order.' || chr(10) END,
 nullif(concat_ws(chr(10), CASE WHEN sy.status = 'blocked' THEN '> blocked: metadata could not be read' END,
  CASE WHEN list_contains(flags, 'legal_risk') THEN '> legal_risk: a maintainer will decide' END, CASE WHEN sy.title IS NULL THEN '> no title could be read' END), '')
 ], lambda x: x IS NOT NULL), chr(10)) AS body FROM sy LEFT JOIN fa USING (key) WHERE reason IS NULL"""

# --- search ------------------------------------------------------------------------------


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) < 4 OR regexp_matches({t}, '[^a-z0-9]') THEN {t} WHEN regexp_matches({t}, '[^aeiou]ies$') THEN left({t}, -3) || 'y' "
        f"WHEN regexp_matches({t}, '(sses|shes|ches|xes)$') THEN left({t}, -2) WHEN regexp_matches({t}, '[^s]s$') THEN left({t}, -1) "
        f"WHEN length({t}) > 5 AND {t}[-3:] = 'ing' THEN left({t}, -3) WHEN length({t}) > 5 AND {t}[-2:] = 'ed' THEN left({t}, -2) ELSE {t} END"
    )


def tokenised(src: str, out: str, ids: str, text: str = "text") -> str:
    return f"""{out}_r AS (SELECT {ids}, unnest(regexp_extract_all(lower({text}), {q(rules.TOKEN_RUN)})) AS run FROM {src}),
{out} AS (SELECT {ids}, unnest(CASE WHEN regexp_matches(run, {q(rules.CJK_LETTER)}) THEN
   list_concat(CASE WHEN length(run) = 1 THEN [run] ELSE [] END, list_transform(range(1, length(run)), lambda i: substr(run, i, 2)), CASE WHEN length(run) <= 4 THEN [run] ELSE [] END)
  ELSE list_concat([run], CASE WHEN {stem('run')} <> run THEN [{stem('run')}] ELSE [] END, list_filter(regexp_split_to_array(run, '[.+#_-]'), lambda p: length(p) > 2 AND p <> run)) END) AS term FROM {out}_r)"""


SYN = "syn(word, equiv) AS (VALUES " + ", ".join(
    f"({q(a)}, {q(b)})" for a, b in sorted({(a, b) for g in rules.EQUIVALENT_WORDS for a in g for b in g if a != b})
) + ")"
WEIGHT = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.FIELD_WEIGHTS.items()) + " ELSE 0 END"


def expanded(src: str, out: str) -> str:
    """``query_id, term, weight`` from ``src(query_id, query)``."""
    return f"""{SYN}, {tokenised(src, out + '_t', 'query_id', 'query')},
{out}_typed AS (SELECT DISTINCT query_id, term FROM {out}_t),
{out}_w AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z]+(?: [a-z]+)?|[一-鿿]+')) AS word FROM {src} UNION SELECT query_id, term FROM {out}_typed),
{out}_s AS (SELECT query_id, equiv FROM {out}_w JOIN syn USING (word)), {tokenised(out + '_s', out + '_e', 'query_id', 'equiv')},
{out} AS (SELECT query_id, term, max(w) AS weight FROM (SELECT query_id, term, 1.0 AS w FROM {out}_typed UNION ALL SELECT query_id, term, 0.55 FROM {out}_e) GROUP BY 1, 2)"""


def ranked(fields: str, queries: str, n_docs: str, k: int, prior: str = "") -> str:
    """Top k from CTE ``fields(doc, field, text)`` and CTE ``queries(query_id, query)``."""
    join = f"JOIN {prior} pr ON pr.doc = g.doc" if prior else ""
    mul = "* pr.prior" if prior else ""
    return f"""{tokenised(fields, 'ft', 'doc, field')},
post AS (SELECT doc, term, sum(CAST({WEIGHT} AS DOUBLE)) AS tf, count(*) AS cnt FROM ft GROUP BY 1, 2), dl AS (SELECT doc, sum(cnt) AS len FROM post GROUP BY 1),
tot AS (SELECT ({n_docs}) AS n, (SELECT sum(len) FROM dl) AS total), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
{expanded(queries, 'qt')}, qn AS (SELECT query_id, count(*) FILTER (weight = 1.0) AS typed, count(*) AS terms FROM qt GROUP BY 1),
sc AS (SELECT query_id, doc, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.6 + 0.6 * (len / (total / n))))) AS raw, count(*) FILTER (weight = 1.0) AS th, count(*) AS ah
  FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN dl USING (doc), tot GROUP BY 1, 2),
fin AS (SELECT g.query_id, g.doc, round(raw * (0.55 + 0.45 * CASE WHEN th > 0 THEN th / typed ELSE ah / terms END) {mul}, 6) AS score FROM sc g JOIN qn USING (query_id) {join}),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM fin QUALIFY rank <= {k})"""


ORACLE["tokens"] = with_(tokenised("documents", "t", "doc_id")) + "SELECT doc_id, term AS token, count(*) AS n FROM t GROUP BY 1, 2"
DF = "df0 AS (SELECT doc_id AS doc, 'description' AS field, text FROM documents UNION ALL SELECT doc_id, 'tags', source FROM documents)"
ORACLE["term_df"] = with_(DF, tokenised("df0", "t", "doc")) + "SELECT term, count(DISTINCT doc) AS df FROM t GROUP BY 1"
ORACLE["expanded_queries"] = with_(
    "qs AS (SELECT p_partkey AS query_id, concat_ws(' ', p_name, CASE p_size % 3 WHEN 0 THEN 'open source tool' WHEN 1 THEN 'Design 动画 editing' END) AS query FROM part)", expanded("qs", "qt"),
) + "SELECT query_id, term, CAST(weight AS DOUBLE) AS weight FROM qt"
OUT = "SELECT query_id, doc, CAST(rank AS INT) AS rank, score FROM top"
ORACLE["bm25_topk"] = with_(DF, "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)", ranked("df0", "qs", "SELECT count(*) FROM documents", 10)) + OUT
ORACLE["library_search"] = with_(
    CK, """lfd AS (SELECT DISTINCT key AS doc, 'names' AS field, name AS text FROM placed UNION ALL SELECT DISTINCT key, 'tags', tag FROM placed
      UNION ALL SELECT DISTINCT key, 'sections', section FROM placed WHERE src_type <> 'chrome' UNION ALL SELECT DISTINCT key, 'claims', note FROM placed
      UNION ALL SELECT key, 'key', key FROM ck UNION ALL SELECT key, 'url', url FROM ck UNION ALL SELECT key, 'title', title FROM ck WHERE title <> '')""",
    "qs AS (SELECT DISTINCT concat_ws(' ', note, tag) AS query_id, concat_ws(' ', note, tag) AS query FROM v)",
    """pri AS (SELECT key AS doc, (1 + least(log2(mentions), 3) * 0.18) * CASE status WHEN 'dead' THEN 0.15 WHEN 'unknown' THEN 0.75 WHEN 'blocked' THEN 0.9 WHEN 'alive' THEN 1.1 ELSE 1 END AS prior
      FROM ck WHERE NOT list_contains(flags, 'private') AND NOT list_contains(flags, 'legal_risk'))""",
    ranked("lfd", "qs", "SELECT count(*) FROM ck", 5, "pri"),
) + OUT

# --- link memory -------------------------------------------------------------------------

BOOK = f"""{M}, {PICKS},
sd AS (SELECT key, session, said AS text, min(tm) AS tm, arg_min(regexp_extract(cwd, '([^/]+)/*$', 1), tm) AS project FROM pk GROUP BY 1, 2, 3),
lk0 AS (SELECT key, arg_min(url, {{'a': tm, 'm': msg_id, 'i': idx}}) AS url, min(tm) AS first_seen FROM pk GROUP BY 1),
{canon('pages', 'tc')}, tt0 AS (SELECT {link_key()} AS key, {title_of('html')} AS title FROM tc UNION ALL SELECT 'x.com/status/' || (1000000000 + conv_id // 3), text FROM conversations),
tt AS (SELECT key, min(title) AS title FROM tt0 GROUP BY 1),
lk AS (SELECT lk0.*, tt.title FROM lk0 LEFT JOIN tt USING (key)),
nt AS (SELECT key, 'conclusion ' || session AS text, tm + INTERVAL '1' HOUR AS tm FROM pk WHERE starts_with(key, 'x.com/status/'))"""
ORACLE["link_book"] = with_(BOOK) + f"SELECT lk.key, lk.url, {TS('lk.first_seen')} AS first_seen, count(*) AS remarks, count(DISTINCT session) AS sessions FROM lk JOIN sd USING (key) GROUP BY 1, 2, 3"
ORACLE["link_notes"] = with_(BOOK) + "SELECT key, count(*) AS n, arg_max(text, tm) AS last_note FROM nt GROUP BY 1"


def own_words(text: str) -> str:
    lines = f"string_split(regexp_replace({text}, '(?s)```.*?```', ' ', 'g'), chr(10))"
    return (
        f"regexp_replace(array_to_string(list_filter({lines}, lambda l: NOT regexp_matches(l, '^\\s*>') AND NOT regexp_matches(l, {q(rules.CODE_OR_LOG_LINE)})), ' '), {q(ML)}, ' ', 'g')"
    )


def words(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), {q(rules.MEMORY_RUN)})"
    latin = f"list_filter({runs}, lambda w: NOT regexp_matches(w, '[一-鿿]') AND (length(w) > 2 OR regexp_matches(w, '[a-z]\\d|\\d[a-z]')))"
    return f"list_distinct(list_filter({latin}, lambda t: NOT list_contains({lst(rules.FILLER_WORDS)}, t) AND NOT regexp_matches(t, '^\\d+$')))"


TERMS = f"mt AS (SELECT msg_id, tm, session, unnest({words(own_words('text'))}) AS term FROM m WHERE NOT regexp_matches(text, {q(rules.RELAYED)}))"
VOC = f"{TERMS}, vo AS (SELECT term, count(*) AS n FROM mt GROUP BY 1 HAVING count(*) >= 3), tl AS (SELECT count(*) AS total FROM m WHERE NOT regexp_matches(text, {q(rules.RELAYED)}))"
KW = f"{VOC}, kw AS (SELECT mt.*, coalesce(vo.n, 0) AS n, ln((total + 1) / (coalesce(vo.n, 0) + 1)) AS w FROM mt LEFT JOIN vo USING (term), tl WHERE coalesce(vo.n, 0) <= total / 500)"
ORACLE["own_words"] = with_(M) + f"SELECT msg_id, {own_words('text')} AS own FROM m"
ORACLE["message_terms"] = with_(M, TERMS) + "SELECT msg_id, term FROM mt"
ORACLE["vocabulary"] = with_(M, VOC) + "SELECT term, n, total FROM vo, tl"
ORACLE["message_keywords"] = with_(M, KW) + "SELECT msg_id, term FROM kw"
ORACLE["asks_about_past"] = with_(M) + f"SELECT msg_id, regexp_matches(text, {q(rules.ASKS_ABOUT_PAST)}) AS asks FROM m"
LT = f"""tx AS (SELECT key, 'own' AS part, text, tm FROM sd WHERE length(text) <= 80 UNION ALL SELECT key, 'body', text, tm FROM sd WHERE length(text) > 80
  UNION ALL SELECT key, 'own', text, tm FROM nt UNION ALL SELECT key, 'title', title, TIMESTAMP '1970-01-01' FROM lk WHERE title <> ''),
wd AS (SELECT key, part, tm, unnest({words('text')}) AS term FROM tx), bn AS (SELECT key, min(tm) AS born FROM sd GROUP BY 1),
lt AS (SELECT key, term, CASE WHEN bool_or(part <> 'body') THEN greatest(min(tm) FILTER (part <> 'body'), any_value(born)) END AS own_at, min(tm) FILTER (part = 'body') AS body_at, CASE WHEN bool_or(part = 'title') THEN greatest(min(tm) FILTER (part = 'title'), any_value(born)) END AS title_at,
  bool_or(part <> 'body') AS own, bool_or(part = 'title') AS in_title FROM wd JOIN bn USING (key) GROUP BY 1, 2)"""
RARE = f"""{LT}, dfx AS (SELECT term, count(*) AS df FROM lt GROUP BY 1),
hit AS (SELECT k.msg_id, k.session, k.tm, lt.key, sum(w * CASE WHEN own THEN 1.0 ELSE 0.5 END) AS raw, string_agg(k.term, '|' ORDER BY k.term) AS matched FROM kw k JOIN lt USING (term) JOIN dfx USING (term)
  WHERE df <= 5 GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (own) >= 1 AND count(*) >= 2 AND sum(w * CASE WHEN own THEN 1.0 ELSE 0.5 END) >= 10),
rr AS (SELECT h.*, round(raw, 2) AS score, EXISTS (SELECT 1 FROM nt WHERE nt.key = h.key) AS noted, b.born FROM hit h JOIN bn b USING (key)
  WHERE EXISTS (SELECT 1 FROM sd WHERE sd.key = h.key AND sd.session <> h.session) AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.key = h.key AND pk.msg_id = h.msg_id)),
rt AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY score DESC, noted DESC, born DESC, key) AS rank FROM rr)"""
ORACLE["recall_rare"] = with_(BOOK, KW, RARE) + "SELECT msg_id, CAST(rank AS INT) AS rank, key, score, matched FROM rt WHERE rank <= 3"
RECENT = f"""{LT},
ak AS (SELECT mt.* FROM mt LEFT JOIN vo USING (term), tl WHERE total > 0 AND coalesce(n, 0) <= total / 50),
pr AS (SELECT a.msg_id, a.tm, a.session, a.term, lt.key, coalesce(title_at < a.tm, FALSE) AS in_title FROM ak a JOIN lt USING (term) WHERE own_at < a.tm
  AND EXISTS (SELECT 1 FROM sd WHERE sd.key = lt.key AND sd.tm < a.tm AND sd.tm >= a.tm - INTERVAL '7' DAY AND sd.session <> a.session)
  AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.key = lt.key AND pk.msg_id = a.msg_id)),
px AS (SELECT pr.*, coalesce(lk.title, pr.key) AS thing, (SELECT max(sd.tm) FROM sd WHERE sd.key = pr.key AND sd.tm < pr.tm) AS last_at FROM pr JOIN lk USING (key)),
pw AS (SELECT msg_id, term FROM px GROUP BY 1, 2 HAVING count(DISTINCT thing) >= 2 AND bool_or(in_title)),
ph AS (SELECT msg_id, key, any_value(last_at) AS last_at, string_agg(term, '|' ORDER BY term) AS matched FROM px JOIN pw USING (msg_id, term) GROUP BY 1, 2),
pn AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY last_at DESC, key) AS rank FROM ph)"""
ORACLE["recall_recent"] = with_(BOOK, VOC, RECENT) + "SELECT msg_id, CAST(rank AS INT) AS rank, key, matched FROM pn WHERE rank <= 3"
BF = """bf AS (SELECT key AS doc, 'key' AS field, key AS text FROM lk UNION ALL SELECT key, 'url', url FROM lk UNION ALL SELECT key, 'title', title FROM lk WHERE title <> ''
  UNION ALL SELECT key, 'claims', text FROM sd UNION ALL SELECT key, 'claims', text FROM nt UNION ALL SELECT DISTINCT key, 'tags', project FROM sd)"""
ORACLE["find_links"] = with_(
    BOOK, BF, f"qs AS (SELECT page_id AS query_id, {title_of('html')} AS query FROM pages)", ranked("bf", "qs", "SELECT count(*) FROM lk", 5),
) + OUT
ORACLE["newest_links"] = with_(BOOK) + f"SELECT key, {TS('first_seen')} AS first_seen FROM (SELECT * FROM lk ORDER BY first_seen DESC, key LIMIT 20)"
ORACLE["link_descriptions"] = with_(
    BOOK, "ds AS (SELECT key, arg_max(text, {'l': length(text), 'a': -epoch_us(tm)}) FILTER (text <> '' AND length(text) <= 80) AS short, arg_min(text, tm) FILTER (text <> '') AS any_text, arg_max(project, tm) AS project FROM sd GROUP BY 1)",
    "dn AS (SELECT key, arg_max(text, tm) AS note FROM nt GROUP BY 1)",
) + """SELECT key, strftime(first_seen, '%Y-%m-%d') AS day, regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g') AS what, coalesce(short, any_text, '') AS said,
 coalesce(note, '') AS note, project FROM lk LEFT JOIN ds USING (key) LEFT JOIN dn USING (key)"""
ASK = f"regexp_matches(text, {q(rules.ASKS_ABOUT_PAST)})"
# What a session was shown grows message by message, so the rule is a recursion over its messages.
ONCE_ALL = """cl AS (SELECT session, msg_id, tm, list(key ORDER BY rank) AS ks FROM rt GROUP BY ALL),
nn AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY tm, msg_id) AS i FROM cl),
ons AS (SELECT session, msg_id, i, ks[1:3] AS picked, ks[1:3] AS shown FROM nn WHERE i = 1
 UNION ALL SELECT session, msg_id, i, fresh[1:3], list_concat(shown, fresh[1:3])
 FROM (SELECT n.session, n.msg_id, n.i, o.shown, list_filter(n.ks, lambda x: NOT list_contains(o.shown, x)) AS fresh FROM ons o JOIN nn n ON n.session = o.session AND n.i = o.i + 1))"""
ONCE = ONCE_ALL.replace("FROM rt GROUP", f"FROM rt WHERE msg_id IN (SELECT msg_id FROM m WHERE NOT {ASK}) GROUP", 1)
ORACLE["prompt_routes"] = with_(
    BOOK, KW, BF, f"qs AS (SELECT msg_id AS query_id, string_agg(term, ' ' ORDER BY term) AS query FROM kw JOIN (SELECT msg_id FROM m WHERE {ASK}) USING (msg_id) GROUP BY 1)",
    ranked("bf", "qs", "SELECT count(*) FROM lk", 5), RARE, ONCE, recursive=True,
) + """SELECT query_id AS msg_id, 'search' AS route, CAST(rank AS INT) AS rank, doc AS key FROM top WHERE NOT EXISTS (SELECT 1 FROM pk WHERE pk.msg_id = query_id AND pk.key = doc)
 UNION ALL SELECT msg_id, 'recall', CAST(r AS INT), picked[r] FROM (SELECT msg_id, picked, unnest(range(1, len(picked) + 1)) AS r FROM ons)"""
ORACLE["message_history"] = with_(
    M, "al AS (SELECT msg_id, text, tm, session FROM m UNION ALL SELECT msg_id + 500, text, tm + INTERVAL '1' HOUR, 'fork' || session FROM m)",
) + f"SELECT msg_id, session FROM (SELECT *, first_value(session) OVER (PARTITION BY trim(text, {WS}) ORDER BY tm, msg_id) AS owner FROM al) WHERE session = owner"
ORACLE["book_as_of"] = with_(BOOK) + f"""SELECT s.key, {TS('min(s.tm)')} AS first_seen, count(*) AS remarks, (SELECT count(*) FROM nt WHERE nt.key = s.key AND nt.tm < TIMESTAMP '2024-01-03') AS notes
 FROM sd s WHERE s.tm < TIMESTAMP '2024-01-03' GROUP BY s.key"""
ORACLE["enrich_due"] = with_(BOOK) + """SELECT key, CASE WHEN ends_with(key, '5') THEN 'failed' END AS enrich_error FROM lk
 WHERE NOT contains(key, 'status') OR (ends_with(key, '5') AND first_seen < TIMESTAMP '2024-01-31')"""

# --- analytics ---------------------------------------------------------------------------

PARAM = lambda k: f"coalesce(url_decode(substr(list_filter(string_split(a, '&'), lambda x: split_part(x, '=', 1) = '{k}')[1], {len(k) + 2})), '')"
NUM = lambda k: f"CAST(coalesce(try_cast(nullif({PARAM(k)}, '') AS DOUBLE), 0) AS BIGINT)"


def events(where: str = "c = 'browser'") -> str:
    return f"""sl AS ({SITE_LOG}), ev AS (SELECT event_id, tm, {PARAM('e')} AS kind, {PARAM('e')} NOT IN ('s', 'miss', 'open') AS malformed, {NUM('n')} AS searches, {NUM('m')} AS misses,
 {NUM('o')} AS opens, {NUM('f')} AS facets, {NUM('c')} = 1 AS copied, {PARAM('w')} AS w, {PARAM('l')} AS lang, {PARAM('q')} AS q, {PARAM('k')} AS k, {NUM('r')} AS r FROM sl WHERE {where})"""


SUMMARY = """SELECT count(*) FILTER (kind = 's') AS visits, CAST(coalesce(sum(searches) FILTER (kind = 's'), 0) AS BIGINT) AS searches, CAST(coalesce(sum(misses) FILTER (kind = 's'), 0) AS BIGINT) AS misses,
 CAST(coalesce(sum(facets) FILTER (kind = 's'), 0) AS BIGINT) AS facets, count(*) FILTER (kind = 's' AND copied) AS copies, count(*) FILTER (kind = 's' AND searches > 0) AS searching_visits,
 CAST(coalesce(sum(opens) FILTER (kind = 's'), 0) AS BIGINT) AS open_count, count(*) FILTER (kind = 'miss') AS gaps, count(*) FILTER (kind = 'open') AS opens, count(*) FILTER (malformed) AS malformed"""
ORACLE["site_events"] = with_(events("c = 'browser' AND tm >= TIMESTAMP '2024-01-05'")) + "SELECT event_id, kind, malformed, searches, misses, opens, copied, w, lang, q, k, r FROM ev"
ORACLE["visit_summary"] = with_(events()) + SUMMARY + " FROM ev"
ORACLE["event_log_lines"] = with_(events("event_id % 50 <> 7 AND c = 'browser'"), "br AS (SELECT count(*) AS broken FROM events WHERE event_id % 50 = 7)") + (
    "SELECT * REPLACE (malformed + broken AS malformed) FROM (" + SUMMARY + " FROM ev) s, br"
).replace("SELECT * REPLACE", "SELECT s.* REPLACE")
ORACLE["miss_rate"] = with_(events("c = 'browser' AND tm >= TIMESTAMP '2024-01-16'"), "s AS (" + SUMMARY + " FROM ev)") + (
    "SELECT searches, misses, open_count, round(misses / nullif(searches, 0), 8) AS miss_rate, round(open_count / nullif(searches, 0), 8) AS open_rate FROM s"
)
ORACLE["gap_tally"] = with_(events()) + "SELECT q AS label, count(*) AS n FROM ev WHERE kind = 'miss' AND q <> '' GROUP BY 1"
ORACLE["language_tally"] = with_(events("TRUE")) + "SELECT lang AS label, count(*) AS n FROM ev WHERE kind = 's' AND lang <> '' GROUP BY 1"
ORACLE["most_opened"] = with_(events()) + "SELECT k AS key, count(*) AS n, round(avg(r) FILTER (r > 0), 8) AS avg_rank FROM ev WHERE kind = 'open' AND k <> '' GROUP BY 1 ORDER BY n DESC, key LIMIT 15"
ORACLE["search_chains"] = with_(
    f"ks AS ({KEYSTROKES})", "k1 AS (SELECT *, lag(q) OVER (PARTITION BY visit ORDER BY ts, event_id) AS pq FROM ks)",
    "k2 AS (SELECT *, CASE WHEN q <> '' AND NOT (coalesce(pq, '') <> '' AND (starts_with(q, pq) OR starts_with(pq, q))) THEN 1 ELSE 0 END AS new FROM k1)",
    "k3 AS (SELECT *, sum(new) OVER (PARTITION BY visit ORDER BY ts, event_id) AS chain FROM k2)",
    "k4 AS (SELECT visit, chain, arg_max(results, {'t': ts, 'e': event_id}) AS last FROM k3 WHERE q <> '' GROUP BY 1, 2)",
) + "SELECT v.visit, count(k4.chain) AS searches, count(*) FILTER (k4.last = 0) AS misses FROM (SELECT DISTINCT visit FROM ks) v LEFT JOIN k4 USING (visit) GROUP BY 1"
ORACLE["client_classes"] = """SELECT CASE user_id % 5 WHEN 0 THEN 'none' WHEN 2 THEN 'bot' WHEN 3 THEN 'bot' ELSE 'browser' END AS class, count(*) AS n FROM events GROUP BY 1"""
ORACLE["visit_records"] = """WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%d') AS visit FROM events), f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY visit ORDER BY ts, event_id) = 1)
SELECT visit, nullif(event_id % 7, 0) AS n, nullif(event_id % 3, 0) AS m, nullif(event_id % 2, 0) AS o, CAST(NULL AS BIGINT) AS f, CASE WHEN event_id % 4 = 0 THEN 1 END AS c,
 CASE WHEN event_id % 5 <> 3 THEN 'site' || event_id % 5 || '.com' END AS ref, CASE WHEN event_id % 1500 < 560 THEN 'sm' WHEN event_id % 1500 < 1000 THEN 'md' ELSE 'lg' END AS w, 'en-US-posix' AS l FROM f"""
ORACLE["opted_in"] = "SELECT count(*) AS n, CAST(sum(event_id % 7) AS BIGINT) AS searches FROM events WHERE event_id % 6 <> 0 AND event_id % 9 <> 0 AND event_id % 13 <> 0"

# --- views and sources -------------------------------------------------------------------

ORACLE["section_groups"] = with_(
    LIB, "sg AS (SELECT key, coalesce(sec1, lsec1, tag1, 'Other') AS section FROM head)", "sn AS (SELECT *, count(*) OVER (PARTITION BY section) AS n FROM sg)",
    "so AS (SELECT key, CASE WHEN n < 3 THEN 'Other' ELSE section END AS g FROM sn)", "sz AS (SELECT g, count(*) AS size, row_number() OVER (ORDER BY g = 'Other', count(*) DESC, g) AS o FROM so GROUP BY 1)",
) + 'SELECT key, g AS "group", size AS group_size, CAST(o AS INT) AS group_order FROM so JOIN sz USING (g)'
ESC = lambda x: f"trim(regexp_replace(regexp_replace({x}, '([|\\[\\]])', '\\\\\\1', 'g'), '\\n+', ' ', 'g'))"
ORACLE["list_lines"] = with_(
    CK, "sg AS (SELECT *, coalesce(sec1, lsec1, tag1, 'Other') AS section FROM ck)", "sn AS (SELECT *, count(*) OVER (PARTITION BY section) AS n FROM sg)",
) + f"""SELECT key, CASE WHEN n < 2 THEN 'Other' ELSE section END AS "group", '- **[' || {ESC("coalesce(title, name1)")} || '](' || url || ')**' ||
 CASE status WHEN 'blocked' THEN ' ⚠︎' WHEN 'unknown' THEN ' ?' WHEN 'dead' THEN ' ✗' ELSE '' END || ' — ' || {ESC('claim1')} || CASE WHEN mentions > 1 THEN ' <sub>' || mentions || ' sources</sub>' ELSE '' END AS line FROM sn"""
ORACLE["wall_order"] = """WITH i AS (SELECT CASE WHEN p_size > 30 THEN 's' ELSE 'v' END || p_partkey AS key, CASE WHEN p_size <= 30 THEN 'video' WHEN p_size % 3 = 0 THEN 'repo' ELSE 'site' END AS kind,
 p_partkey AS tm, p_size % 5 AS mentions, p_retailprice > 1900 AS pick FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY kind = 'video' ORDER BY CASE WHEN kind = 'video' THEN 0 - tm ELSE 0 - mentions END, kind = 'repo', key) AS n FROM i WHERE NOT pick)
SELECT key, CAST((SELECT count(*) FROM i WHERE pick) + row_number() OVER (ORDER BY CASE WHEN kind = 'video' THEN n + (n - 1) // 3 ELSE 4 * n END, kind <> 'video') AS BIGINT) AS wall_pos FROM r"""
ORACLE["wall_videos"] = """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS zh, p_size % 5 <> 0 AS complete, CASE WHEN p_size % 2 = 0 THEN 'en ' || p_name END AS line FROM part WHERE p_size % 11 <> 0)
SELECT key, zh AS title, coalesce(line, zh) AS en, NULL AS missing FROM p WHERE complete UNION ALL
SELECT key, NULL, NULL, CASE WHEN NOT complete THEN 'video:' || key ELSE 'en:' || key END FROM p WHERE NOT complete OR line IS NULL"""
ORACLE["category_counts"] = "SELECT p_brand AS cat, count(*) AS n FROM part GROUP BY 1"
ORACLE["bookmark_folders"] = """SELECT 'profile' || page_id // 50 AS profile, 'Bar/f' || page_id % 4 AS folder, 'f' || page_id % 4 AS folder_name, count(*) AS n, min('t' || page_id) AS first_title,
 max(13300000000000000 + page_id - 11644473600000000) AS last_added FROM pages GROUP BY 1, 2, 3"""
ORACLE["best_snapshots"] = """WITH d AS (SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS ua, doc_id % 5 = 0 AS ta, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS ub, doc_id % 4 = 0 AS tb FROM documents),
s AS (SELECT *, n + CASE WHEN ua = 2 THEN length(' https://t.co/a https://t.co/b') ELSE 0 END AS la, n + CASE WHEN ub = 1 THEN length(' https://t.co/a and more words') ELSE 2 END AS lb FROM d),
x AS (SELECT *, CASE WHEN ua = 0 AND NOT ta THEN 'a' WHEN ub = 0 AND NOT tb THEN 'b' WHEN ub < ua OR lb > la THEN 'b' ELSE 'a' END AS pick FROM s)
SELECT CAST(doc_id AS VARCHAR) AS post_id, CASE pick WHEN 'a' THEN 'fxtwitter' ELSE 'syndication' END AS channel, CAST(CASE pick WHEN 'a' THEN ua ELSE ub END AS BIGINT) AS unexpanded,
 CASE pick WHEN 'a' THEN la ELSE lb END AS chars FROM x"""
ORACLE["expanded_links"] = with_(P) + "SELECT post_id, md5(replace(text, 'http://t.co/abc', 'https://full.example.com/' || post_id)) AS digest FROM p"
ORACLE["agent_log_1"] = f"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn AS n, text, FALSE AS queued FROM conversations WHERE role = 'user' AND turn % 10 <> 8
 UNION ALL SELECT CAST(conv_id AS VARCHAR), turn + 100000, 'queued: ' || text, TRUE FROM conversations WHERE role = 'assistant' AND (turn + 100000) % 4 <> 1)
SELECT session, queued, '/p' AS cwd, md5(text) AS digest FROM t QUALIFY row_number() OVER (PARTITION BY session, trim(text, {WS}) ORDER BY n) = 1"""
ORACLE["agent_log_2"] = "SELECT CAST(conv_id AS VARCHAR) AS session, '/q' AS cwd, md5(text) AS digest FROM conversations WHERE role = 'user' AND conv_id % 3 <> 0"
ORACLE["document_round_trip"] = with_(V, placed()) + """SELECT key, kind, count(DISTINCT x) AS n FROM (SELECT key, 'name' AS kind, name AS x FROM placed UNION ALL SELECT key, 'tag', tag FROM placed UNION ALL SELECT key, 'claim', note FROM placed
 UNION ALL SELECT key, CASE src_type WHEN 'chrome' THEN 'local_section' ELSE 'section' END, section FROM placed
 UNION ALL SELECT key, 'source', concat_ws('~', src_type, coalesce(src_post_id, src_folder, ''), coalesce(src_author, '')) FROM placed) GROUP BY 1, 2"""
HOUR = "date_trunc('hour', tm)"
ORACLE["stream_miss_rate"] = with_(events(), "ok AS (SELECT * FROM ev WHERE NOT malformed)") + f"""SELECT {TS(HOUR)} AS window_start, count(*) FILTER (kind = 's') AS visits,
 CAST(coalesce(sum(searches) FILTER (kind = 's'), 0) AS BIGINT) AS searches, CAST(coalesce(sum(misses) FILTER (kind = 's'), 0) AS BIGINT) AS misses, count(*) FILTER (kind = 'miss') AS gaps,
 round(coalesce(sum(misses) FILTER (kind = 's'), 0) / nullif(coalesce(sum(searches) FILTER (kind = 's'), 0), 0), 8) AS miss_rate FROM ok
 GROUP BY {HOUR}"""
ORACLE["stream_distinct_messages"] = "SELECT CAST(conv_id AS VARCHAR) AS session, count(DISTINCT text) AS n FROM conversations WHERE role = 'user' GROUP BY 1"

# --- files -------------------------------------------------------------------------------

ORACLE["library_files"] = with_(LIB) + f"SELECT key, url, mentions, {TS('first_seen')} AS first_seen, {TS('last_seen')} AS last_seen FROM head"
ORACLE["event_log_files"] = with_(f"sl AS ({SITE_LOG})") + """SELECT event_id % 50 = 7 AS bad, CASE WHEN event_id % 50 <> 7 THEN c END AS c, CASE WHEN event_id % 50 <> 7 THEN strftime(tm, '%Y-%m-%d') END AS day,
 count(*) AS n, count(DISTINCT CASE WHEN event_id % 50 <> 7 THEN a END) AS kinds FROM sl GROUP BY 1, 2, 3"""
ORACLE["backfill"] = with_(BOOK, VOC) + """SELECT 'links' AS what, count(*) AS n FROM lk UNION ALL SELECT 'said', count(*) FROM sd UNION ALL SELECT 'terms', count(*) FROM vo
 UNION ALL SELECT 'messages', total FROM tl"""
ORACLE["stream_search_chains"] = ORACLE["search_chains"]
ORACLE["stream_recall"] = with_(BOOK, KW, RARE, ONCE_ALL, recursive=True) + (
    "SELECT msg_id, session, CAST(r AS INT) AS rank, picked[r] AS key FROM (SELECT msg_id, session, picked, unnest(range(1, len(picked) + 1)) AS r FROM ons)"
)
ORACLE["word_table"] = with_(BOOK, LT) + f"""SELECT term, key, {TS('since')} AS since, {TS('common')} AS common_from FROM (
 SELECT term, key, since, row_number() OVER w AS r, max(CASE WHEN nth = 6 THEN since END) OVER (PARTITION BY term) AS common
 FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY since, key) AS nth FROM (SELECT term, key, least(own_at, body_at) AS since FROM lt))
 WINDOW w AS (PARTITION BY term ORDER BY since, key)) WHERE r <= 5"""
ORACLE["stream_growing_log"] = """WITH r AS (SELECT CAST(floor(conv_id / 20) AS INT) AS log, conv_id, turn, '{"turn":' || turn || ',"text":"' || md5(coalesce(text, '')) || '"}' AS line
 FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT log, max(conv_id) AS last FROM r WHERE turn = 1 GROUP BY 1),
o AS (SELECT r.*, CASE WHEN turn = 0 THEN 0 WHEN turn = 1 AND conv_id <> last THEN 1 WHEN turn = 1 THEN 2 ELSE 3 END AS part FROM r LEFT JOIN l USING (log)),
k AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY log ORDER BY part, turn, conv_id) AS upto FROM o WHERE part < 3 OR log % 3 <> 0),
n AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY log ORDER BY conv_id) AS upto FROM r WHERE turn = 0 AND log % 3 = 0 AND conv_id % 20 = 1)
SELECT log, CAST(upto - length(line) - 1 AS BIGINT) AS pos, line AS value FROM k
UNION ALL SELECT log, CAST(upto - length(line) - 1 AS BIGINT), line FROM n WHERE (SELECT max(upto) FROM n m WHERE m.log = n.log) < (SELECT max(upto) FROM k WHERE k.log = n.log)"""
ORACLE["stream_stale"] = with_(FL, canon("fl1", "fc"), keyed("fc", "fk")) + f"""SELECT key, {TS('checked_at')} AS checked_at, {TS("checked_at + INTERVAL '7' DAY")} AS due_at FROM (
 SELECT key, checked_at, lead(checked_at) OVER (PARTITION BY key ORDER BY checked_at) AS later FROM (SELECT DISTINCT key, checked_at FROM fk WHERE key IS NOT NULL))
 WHERE later IS NULL OR later > checked_at + INTERVAL '7' DAY"""
