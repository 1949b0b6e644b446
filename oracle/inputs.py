"""The derived inputs as common table expressions for DuckDB.

``sql(body)`` puts the expressions a query needs in front of it.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz com.br com.mx co.jp co.kr com.cn com.hk "
    "co.in com.sg com.tw co.za com.ar github.io blogspot.com"
).split()
BASE = 1704067200
NOW = BASE + 86520
SCANNED = BASE + 132800
JUNK = r"""[\\).,;:!?''"\]]+$"""


def domain(h: str) -> str:
    two, three = rf"regexp_extract({h}, '([^.]+\.[^.]+)$', 1)", rf"regexp_extract({h}, '([^.]+\.[^.]+\.[^.]+)$', 1)"
    listed = ", ".join(f"'{s}'" for s in SUFFIXES)
    return (
        rf"CASE WHEN regexp_matches({h}, '^[0-9]+(\.[0-9]+){{3}}$') OR NOT contains({h}, '.') THEN {h} "
        f"WHEN {two} IN ({listed}) THEN coalesce(nullif({three}, ''), {two}) ELSE {two} END"
    )


def clean(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '{JUNK}', '')"


def normal(name: str, source: str, column: str, url: str = "normalized_url", host: str = "hostname") -> None:
    """Steps that add the normal form of a URL column of ``source`` as table ``name``."""
    CTES[f"{name}_t"] = rf"SELECT *, regexp_replace({clean(column)}, '\s+$', '') AS t_ FROM {source}"
    CTES[f"{name}_h"] = rf"""
      SELECT *, CASE WHEN regexp_matches(t_, '(?i)^https?://[^/?#]') THEN
        rtrim(lower(regexp_extract(t_, '(?i)^https?://(?:[^/?#]*@)?([^/?#:@]*)', 1)), '.') END AS h_,
        regexp_extract(t_, '(?i)^https?://(?:[^/?#]*@)?[^/?#:@]*:([0-9]+)', 1) AS p_,
        regexp_extract(t_, '(?i)^https?://[^/?#]*([^#]*)', 1) AS r_,
        lower(regexp_extract(t_, '(?i)^(https?)://', 1)) AS s_
      FROM {name}_t"""
    CTES[name] = rf"""
      SELECT * EXCLUDE (t_, h_, p_, r_, s_),
        CASE WHEN h_ <> '' AND NOT contains(h_, ' ') THEN h_ END AS {host},
        CASE WHEN h_ <> '' AND NOT contains(h_, ' ') THEN s_ || '://' || h_ ||
          CASE WHEN p_ = '' OR (s_ = 'http' AND p_ = '80') OR (s_ = 'https' AND p_ = '443') THEN '' ELSE ':' || p_ END ||
          CASE WHEN r_ = '' OR starts_with(r_, '?') THEN '/' ELSE '' END || r_ END AS {url}
      FROM {name}_h"""


# -- URLs --------------------------------------------------------------------
CTES["pg_parts"] = r"""
  SELECT page_id AS n, url, regexp_extract(url, '^(https?)', 1) AS sch, regexp_extract(url, '^https?://([^/]+)', 1) AS h0,
    regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS rest FROM pages"""
CTES["pg_named"] = r"""
  SELECT *, replace(h0, '.example.', CASE WHEN n % 2 = 0 THEN '-example.' ELSE '-p' || n || '.' END) AS h1 FROM pg_parts"""
CTES["pg_host"] = r"""
  SELECT *, CASE WHEN n % 10 = 4 THEN regexp_replace(h1, '\.org$', '.co.uk') ELSE h1 END AS h FROM pg_named"""
CTES["pg"] = r"""
  SELECT n AS page_id, url, CASE
    WHEN n % 50 = 21 THEN 'ftp://' || h || rest
    WHEN n % 50 = 33 THEN sch || '://bad host/' || n
    WHEN n % 50 = 17 THEN sch || '://93.184.' || (n % 250) || '.7' || rest
    WHEN n % 10 = 2 THEN sch || '://' || h || '.' || rest
    WHEN n % 10 = 3 THEN sch || '://user:pw@' || h || rest
    WHEN n % 10 = 5 THEN upper(sch) || '://' || upper(h) || rest
    WHEN n % 10 = 6 THEN sch || '://' || h || rest || ').'
    WHEN n % 10 = 7 THEN sch || '://' || h || CASE WHEN n % 20 = 7 THEN ':443' ELSE ':8443' END || rest
    ELSE sch || '://' || h || rest END AS raw_url FROM pg_host"""
normal("pu0", "pg", "raw_url")
CTES["pu"] = f"SELECT *, {domain('hostname')} AS domain FROM pu0"
CTES["links"] = """
  SELECT *, lead(raw_url, 1) OVER w AS u1, lead(raw_url, 2) OVER w AS u2, lead(raw_url, 3) OVER w AS u3,
    lead(raw_url, 4) OVER w AS u4, lag(raw_url, 3) OVER w AS back3
  FROM pg WINDOW w AS (PARTITION BY page_id // 100 ORDER BY page_id)"""
normal("nl", "links", "raw_url")
CTES["hop_all"] = """
  SELECT normalized_url AS url, page_id AS observed_at, contains(url, '/es/') AS unvisited,
    CASE WHEN page_id % 100 BETWEEN 60 AND 79 OR page_id % 20 IN (7, 11, 15, 19) OR page_id % 4 < 3
      THEN CASE WHEN page_id % 20 = 7 THEN 302 ELSE 301 END ELSE 200 END AS http_status,
    CASE WHEN page_id % 100 BETWEEN 60 AND 79 THEN u1 WHEN page_id % 20 = 7 THEN back3 WHEN page_id % 20 = 11 THEN NULL
      WHEN page_id % 20 = 15 THEN '/moved?x=1' WHEN page_id % 20 = 19 THEN 'ftp://x/' WHEN page_id % 4 < 3 THEN u1 END AS location,
    CASE WHEN page_id % 50 = 3 THEN ['10.0.0.1'] WHEN page_id % 50 = 13 THEN ['93.184.1.1', '::ffff:192.168.1.1']
      WHEN page_id % 50 = 23 THEN ['127.1'] WHEN page_id % 50 = 29 THEN ['999.1.1.1'] WHEN page_id % 50 = 39 THEN [NULL]
      WHEN page_id % 50 = 43 THEN [] WHEN page_id % 50 = 47 THEN NULL
      ELSE ['93.184.0.' || (page_id % 250)] END AS ips,
    CASE WHEN page_id % 50 = 9 THEN 'timeout' END AS error,
    page_id % 7 * 20 AS dns_ms, page_id % 11 * 30 AS connect_ms, page_id % 13 * 40 AS head_ms
  FROM nl WHERE normalized_url IS NOT NULL"""
CTES["hop_log"] = "SELECT * EXCLUDE (unvisited) FROM hop_all WHERE NOT unvisited"
_V4 = [
    ("unspecified", "0.0.0.0", "0.0.0.0"), ("loopback", "127.0.0.0", "127.255.255.255"),
    ("private", "10.0.0.0", "10.255.255.255"), ("private", "192.168.0.0", "192.168.255.255"),
    ("private", "172.16.0.0", "172.31.255.255"), ("private", "100.64.0.0", "100.127.255.255"),
    ("link_local", "169.254.0.0", "169.254.255.255"), ("multicast", "224.0.0.0", "239.255.255.255"),
    ("reserved", "0.0.0.0", "0.255.255.255"), ("reserved", "240.0.0.0", "240.255.255.255"),
]


def _number(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


_CASES = " ".join(f"WHEN v BETWEEN {_number(lo)} AND {_number(hi)} THEN '{kind}'" for kind, lo, hi in _V4)
CTES["ip_rows"] = "SELECT url, observed_at, unnest(ips) AS ip FROM hop_all"
CTES["ip_parts"] = "SELECT *, string_split(replace(ip, '::ffff:', ''), '.') AS q FROM ip_rows"
CTES["ip_numbers"] = r"""
  SELECT *, CASE WHEN regexp_full_match(replace(ip, '::ffff:', ''), '[0-9]+(\.[0-9]+){3}') AND list_max(q::BIGINT[]) < 256
    THEN ((q[1]::BIGINT * 256 + q[2]::BIGINT) * 256 + q[3]::BIGINT) * 256 + q[4]::BIGINT END AS v FROM ip_parts"""
CTES["ip_class"] = f"SELECT url, observed_at, ip, CASE WHEN v IS NULL THEN 'invalid' {_CASES} ELSE 'public' END AS class FROM ip_numbers"
_QUAD = "concat_ws('.', n // 16777216, n // 65536 % 256, n // 256 % 256, n % 256)"
CTES["address_ranges"] = f"""
  SELECT range_id, 64 - bits AS size, cidr, place + n - n % (1::BIGINT << bits) AS low, 1::BIGINT << bits AS width FROM (
    SELECT k AS range_id, n, 0 AS place, 24 - k % 25 AS bits, {_QUAD} || '/' || (8 + k % 25) AS cidr
    FROM (SELECT o_orderkey AS k, o_orderkey * 2654435761 % 4294967296 AS n FROM orders) WHERE k % 3 <> 0
    UNION ALL
    SELECT k, a * 65536 + b, 1::BIGINT << 40, 32 - k % 33, printf('2001:db8:%x:%x::/%d', a, b, 32 + k % 33)
    FROM (SELECT o_orderkey AS k, o_orderkey * 40503 % 65536 AS a, o_orderkey * 30011 % 65536 AS b FROM orders) WHERE k % 3 = 0)"""
CTES["range_addresses"] = f"""
  SELECT k AS orderkey, l AS linenumber,
    CASE WHEN k % 50 = 7 THEN NULL WHEN k % 50 = 8 THEN '999.1.1.1' WHEN l % 3 = 0 THEN upper(printf('2001:db8:%x:%x::', a, b)) || l
      WHEN k % 50 = 9 THEN '::ffff:' || {_QUAD} ELSE {_QUAD} END AS ip,
    CASE WHEN k % 50 IN (7, 8) THEN NULL WHEN l % 3 = 0 THEN (1::BIGINT << 40) + a * 65536 + b ELSE n END AS v
  FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l, (l_orderkey * 2654435761 + l * l * l * 97) % 4294967296 AS n,
    l_orderkey * 40503 % 65536 AS a, (l_orderkey * 30011 + l) % 65536 AS b FROM lineitem)"""
CTES["blocked"] = """
  SELECT DISTINCT url, observed_at FROM ip_class WHERE class <> 'public'
  UNION SELECT url, observed_at FROM hop_all WHERE coalesce(len(ips), 0) = 0"""
CTES["skip_hosts"] = "SELECT DISTINCT hostname AS host FROM pu WHERE starts_with(hostname, 'm.')"
CTES["hop_latest"] = """
  SELECT h.*, b.url IS NOT NULL AS blocked FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY observed_at DESC) AS rn FROM hop_log) h
  LEFT JOIN blocked b ON b.url = h.url AND b.observed_at = h.observed_at WHERE rn = 1"""
CTES["hop_target"] = r"""
  SELECT *, CASE WHEN regexp_matches(location, '(?i)^https?:') THEN location
    WHEN starts_with(location, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || location END AS target,
    regexp_matches(location, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(location, '(?i)^https?:') AS foreign_scheme
  FROM hop_latest"""
normal("hop_next", "hop_target", "target", "next_url", "next_host")
CTES["edges"] = """
  SELECT *, http_status IN (301, 302, 303, 307, 308) AND NOT blocked AND error IS NULL AS follows,
    CASE WHEN blocked THEN 'blocked_address' WHEN error IS NOT NULL THEN error
      WHEN http_status NOT IN (301, 302, 303, 307, 308) THEN 'completed'
      WHEN coalesce(location, '') = '' THEN 'malformed_redirect' WHEN foreign_scheme THEN 'unsupported_scheme'
      WHEN next_url IS NULL THEN 'invalid_url' END AS outcome
  FROM hop_next"""


def chain(prefix: str, urls: str) -> None:
    """Chains of the distinct ``normalized_url, hostname`` rows of ``urls``."""
    CTES[f"{prefix}_walk"] = f"""
      SELECT normalized_url AS start_url, normalized_url AS url, hostname AS host, 0 AS idx, [normalized_url] AS path
      FROM (SELECT DISTINCT normalized_url, hostname FROM {urls} WHERE normalized_url IS NOT NULL)
      UNION ALL
      SELECT c.start_url, e.next_url, e.next_host, c.idx + 1, list_append(c.path, e.next_url)
      FROM {prefix}_walk c JOIN edges e ON e.url = c.url
      WHERE e.follows AND e.outcome IS NULL AND c.idx < 8 AND NOT list_contains(c.path, e.next_url)
        AND c.host NOT IN (SELECT host FROM skip_hosts)"""
    CTES[f"{prefix}_steps"] = f"""
      SELECT w.*, k.host IS NOT NULL AS skip, e.url IS NOT NULL AS observed, e.outcome, e.follows, e.next_url,
        CASE WHEN k.host IS NULL AND NOT e.blocked AND e.error IS NULL THEN e.http_status END AS http_status,
        CASE WHEN k.host IS NULL AND NOT e.blocked THEN e.dns_ms ELSE 0 END AS dns_ms,
        CASE WHEN k.host IS NULL AND NOT e.blocked AND e.error IS NULL THEN e.connect_ms ELSE 0 END AS connect_ms,
        CASE WHEN k.host IS NULL AND NOT e.blocked AND e.error IS NULL THEN e.head_ms ELSE 0 END AS head_ms,
        row_number() OVER (PARTITION BY w.start_url ORDER BY w.idx DESC) AS back
      FROM {prefix}_walk w LEFT JOIN edges e ON e.url = w.url LEFT JOIN skip_hosts k ON k.host = w.host"""
    CTES[f"{prefix}_sums"] = f"""
      SELECT start_url, CAST(sum(dns_ms) AS BIGINT) AS dns_ms, CAST(sum(connect_ms) AS BIGINT) AS connect_ms,
        CAST(sum(head_ms) AS BIGINT) AS head_ms FROM {prefix}_steps GROUP BY 1"""
    CTES[f"{prefix}_last"] = f"""
      SELECT *, CASE WHEN skip THEN 'skipped_host' WHEN NOT observed THEN 'connection_failure'
        WHEN follows AND idx >= 8 THEN 'too_many_redirects' WHEN outcome IS NOT NULL THEN outcome
        ELSE 'redirect_loop' END AS status FROM {prefix}_steps WHERE back = 1"""
    CTES[f"{prefix}s"] = f"""
      SELECT l.start_url AS normalized_url, l.status, CASE WHEN l.status = 'redirect_loop' THEN l.next_url ELSE l.url END AS final_url,
        l.host AS final_hostname, CAST(l.http_status AS BIGINT) AS http_status, CAST(l.idx AS BIGINT) AS redirect_count,
        CASE WHEN l.status NOT IN ('completed', 'skipped_host') THEN l.status END AS error, l.path,
        s.dns_ms, s.connect_ms, s.head_ms
      FROM {prefix}_last l JOIN {prefix}_sums s USING (start_url)"""


chain("page_chain", "pu")

# -- policy --------------------------------------------------------------------
CTES["cats"] = """
  SELECT * FROM (VALUES ('c-adult', 'adult', 'Adult', true, true), ('c-malware', 'malware', 'Malware', true, true),
    ('c-scam', 'scam', 'Scam', true, true), ('c-spam', 'spam', 'Spam', true, false),
    ('c-legacy', 'legacy', 'Legacy', false, true)) AS v(category_id, slug, name, enabled, blocks_serving)"""
CTES["lists"] = """
  SELECT * FROM (VALUES ('L1', 'c-adult', 'adult-primary', true, 'v1'), ('L2', 'c-adult', 'adult-mirror', true, 'v2'),
    ('L3', 'c-malware', 'malware-hosts', true, 'v3'), ('L4', 'c-scam', 'scam-urls', true, 'v4'),
    ('L5', 'c-spam', 'spam-domains', true, 'v5'), ('L6', 'c-adult', 'adult-disabled', false, 'v6'),
    ('L7', 'c-legacy', 'legacy-domains', true, 'v7')) AS v(blocklist_id, category_id, name, enabled, active_version_id)"""
CTES["hosts"] = f"SELECT hostname, min(page_id) AS k, {domain('hostname')} AS domain FROM pu WHERE hostname IS NOT NULL GROUP BY hostname"
CTES["host_rules"] = """
  SELECT *, unnest(CASE k % 7 WHEN 0 THEN ['v1', 'v2'] WHEN 1 THEN ['v3'] WHEN 2 THEN ['v5'] WHEN 3 THEN ['v6']
    WHEN 4 THEN ['v4'] WHEN 5 THEN ['v1old'] ELSE ['v7'] END) AS version FROM hosts"""
CTES["entries"] = """
  SELECT version || ':' || k AS entry_id, version AS blocklist_version_id,
    CASE version WHEN 'v3' THEN 'host' WHEN 'v4' THEN 'url_prefix' ELSE 'domain' END AS rule_type,
    CASE WHEN version = 'v4' THEN 'http://' || hostname || '/' WHEN k % 5 = 0 THEN domain ELSE hostname END AS normalized_value,
    CASE WHEN version <> 'v4' AND k % 5 <> 0 THEN domain END AS registrable_domain, domain AS own_domain
  FROM host_rules"""
CTES["snapshot"] = """
  SELECT e.entry_id, coalesce(e.registrable_domain, e.normalized_value) AS domain, e.blocklist_version_id, l.blocklist_id,
    l.name AS list_name, c.category_id, c.slug AS category_slug, c.blocks_serving
  FROM entries e JOIN lists l ON l.active_version_id = e.blocklist_version_id AND l.enabled
  JOIN cats c ON c.category_id = l.category_id AND c.enabled WHERE e.rule_type IN ('host', 'domain')"""
CTES["hits"] = """
  SELECT * EXCLUDE (rn) FROM (SELECT domain, category_id, category_slug, blocks_serving, blocklist_id, entry_id, blocklist_version_id,
    row_number() OVER (PARTITION BY domain, category_id ORDER BY blocklist_id, entry_id) AS rn FROM snapshot) WHERE rn = 1"""
CTES["domain_answer"] = """
  SELECT domain, bool_or(blocks_serving) AS blacklisted, string_agg(DISTINCT category_slug, ',' ORDER BY category_slug) AS categories
  FROM hits GROUP BY domain"""
CTES["domain_lists"] = """
  SELECT domain, string_agg(list_name, ',' ORDER BY category_slug, list_name) AS list_names,
    string_agg(blocklist_id, ',' ORDER BY category_slug, list_name) AS list_ids,
    string_agg(category_slug || ':' || list_name, ',' ORDER BY category_slug, list_name) AS named
  FROM (SELECT DISTINCT domain, blocklist_id, list_name, category_slug FROM snapshot) GROUP BY domain"""
CTES["registry"] = f"""
  SELECT 'b' || page_id AS blocklist_id, ['c-adult', 'c-malware', 'c-scam', 'c-spam'][page_id % 4 + 1] AS category_id,
    coalesce(hostname, '') AS name,
    CASE WHEN page_id % 9 = 8 THEN 'ftp' WHEN page_id % 3 = 0 THEN 'manual' ELSE 'remote' END AS source_type,
    CASE WHEN page_id % 3 > 0 THEN 'https://' || coalesce(domain, 'none') || '/list' WHEN page_id % 2 = 0 THEN '' END AS source_url,
    CASE WHEN page_id % 11 = 10 THEN 'rpz' WHEN page_id % 2 = 0 THEN 'domains' ELSE 'hosts' END AS format,
    page_id % 5 <> 0 AS enabled,
    CASE WHEN page_id % 6 = 4 THEN 'failed' WHEN page_id % 6 = 5 THEN 'rejected' ELSE 'ok' END AS refresh_status,
    CASE WHEN page_id % 6 = 4 THEN 'timeout' WHEN page_id % 6 = 5 THEN 'too many entries' WHEN page_id % 13 = 1 THEN 'late' END AS last_error,
    CASE WHEN page_id % 4 <> 0 THEN {BASE} + page_id * 60 END AS next_refresh_at,
    CASE WHEN page_id % 17 = 3 THEN 0 ELSE 86400 END AS refresh_interval_s, {BASE} + page_id * 37 % 1000 AS inserted_at
  FROM pu"""
CTES["version_log"] = f"""
  SELECT 'b' || (doc_id // 4) AS blocklist_id, 'v' || doc_id AS version_id,
    ['failed', 'validated', 'active', 'superseded', 'pending'][doc_id % 5 + 1] AS status,
    CASE WHEN doc_id % 5 = 0 THEN ['too many entries', 'download too large (9 MB, limit 8 MB)', 'timeout'][doc_id % 3 + 1] END AS error,
    CASE WHEN doc_id % 5 <> 4 THEN {BASE} + doc_id * 7919 % 100000 END AS activated_at, {BASE} + doc_id AS inserted_at,
    n_chars AS entry_count FROM documents"""
CTES["activated"] = """
  SELECT v.*, a.active_version_id, CASE WHEN v.status IN ('failed', 'pending') THEN v.status
    WHEN v.version_id = a.active_version_id THEN 'active' ELSE 'superseded' END AS new_status
  FROM version_log v LEFT JOIN (SELECT blocklist_id, version_id AS active_version_id FROM (
    SELECT *, row_number() OVER (PARTITION BY blocklist_id ORDER BY activated_at DESC, version_id DESC) AS rn
    FROM version_log WHERE status NOT IN ('failed', 'pending')) WHERE rn = 1) a USING (blocklist_id)"""
CTES["body_lines"] = """
  SELECT page_id // 25 AS block, page_id, ['domains', 'hosts', 'urls'][page_id // 25 % 3 + 1] AS format,
    coalesce(hostname, 'not/a/host:') AS host, raw_url FROM pu"""
CTES["body_text"] = r"""
  SELECT *, CASE WHEN format = 'urls' THEN CASE WHEN page_id % 6 = 3 THEN '! ' || raw_url ELSE raw_url || ' note' END
    ELSE CASE page_id % 6 WHEN 1 THEN '0.0.0.0 ' || host WHEN 2 THEN upper(host) || '.' WHEN 3 THEN '# ' || host
      WHEN 4 THEN '  ' || host || ' # note' WHEN 5 THEN host || chr(13) ELSE host END END AS line FROM body_lines"""
CTES["body_twice"] = r"""
  SELECT block, format, page_id, CASE WHEN page_id % 4 = 0 THEN line || chr(10) || line ELSE line END AS text FROM body_text"""
CTES["bodies"] = r"""
  SELECT 'b' || block AS blocklist_id, block, format, string_agg(
    CASE WHEN block % 8 = 7 THEN '# ' || replace(text, chr(10), chr(10) || '# ') ELSE text END, chr(10) ORDER BY page_id) AS body
  FROM body_twice GROUP BY block, format"""
CTES["rule_lines"] = r"""
  SELECT blocklist_id, format, strlen(body) AS bytes, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line_no,
    unnest(string_split(body, chr(10))) AS line FROM bodies"""
CTES["rule_tokens"] = r"""
  SELECT *, CASE WHEN format = 'hosts' AND regexp_matches(line, '^[0-9.]+\s+\S') THEN regexp_extract(line, '^\S+\s+(\S+)', 1)
    ELSE regexp_extract(line, '^(\S+)', 1) END AS token
  FROM (SELECT * EXCLUDE (line), regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM rule_lines)
  WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '!')"""
normal("rule_urls", "rule_tokens", "token", "url_value", "url_host")
CTES["rules"] = rf"""
  SELECT blocklist_id, line_no, bytes, CASE format WHEN 'urls' THEN 'url_prefix' WHEN 'hosts' THEN 'host' ELSE 'domain' END AS rule_type,
    CASE WHEN format = 'urls' THEN url_value ELSE rtrim(lower(token), '.') END AS normalized_value,
    CASE WHEN format <> 'urls' THEN {domain("rtrim(lower(token), '.')")} END AS registrable_domain
  FROM rule_urls WHERE format <> 'urls' OR url_value IS NOT NULL"""
CTES["small_rules"] = "SELECT * FROM rules WHERE bytes <= 1500"
CTES["previous"] = """
  SELECT DISTINCT 'b' || (page_id // 25) AS blocklist_id, CAST(CASE page_id // 25 % 4 WHEN 1 THEN 10 WHEN 2 THEN 100 ELSE 0 END AS BIGINT) AS previous_count
  FROM pages WHERE page_id // 25 % 4 > 0"""

# -- events --------------------------------------------------------------------
CTES["doc_links"] = f"""
  SELECT d.doc_id, d.doc_id % 50 AS m, d.text, d.lang, sha256(d.source) AS author, {BASE} + 60 * (d.doc_id // 40) AS second,
    'slug-' || (d.doc_id // 60) AS d, coalesce(l.raw_url, '') AS u0, coalesce(l.u1, '') AS u1, coalesce(l.u2, '') AS u2,
    coalesce(l.u3, '') AS u3, coalesce(l.u4, '') AS u4
  FROM documents d LEFT JOIN links l ON l.page_id = d.doc_id // 4"""
CTES["event_parts"] = r"""
  SELECT *, CASE m WHEN 7 THEN upper(author) WHEN 13 THEN 'zz' ELSE author END AS pubkey,
    CASE m WHEN 6 THEN '"' || second || '"' WHEN 12 THEN second || '.0' ELSE second || '' END AS created,
    CASE m WHEN 2 THEN '1' ELSE '30023' END AS kind,
    '["image","' || u1 || '"],["imeta","url ' || u2 || '","m image/png"],["title","' || lang || '"]' AS common,
    CASE WHEN m = 10 THEN '7' ELSE CAST(to_json(text || chr(10) || '![pic](' || u0 || ') [more](' || u1 || ') <' || u2 ||
      '> <img src="' || u3 || '"> see ' || u4 || ' end') AS VARCHAR) END AS content
  FROM doc_links"""
CTES["event_tags"] = r"""
  SELECT *, CASE m WHEN 3 THEN '[["d","' || d || '"],' || common || repeat(',["t","x"]', 200) || ']'
    WHEN 8 THEN '[' || common || ']' WHEN 9 THEN '"none"'
    WHEN 11 THEN '[["d","' || d || '"],' || common || ',["t","' || repeat('é', 1100) || '"]]'
    WHEN 14 THEN '[["d","' || d || '"],' || common || ',["n",5],"x"]'
    WHEN 16 THEN '[["d",5],["d","' || d || '"],' || common || ']' WHEN 18 THEN '[["d",null],["d","' || d || '"],' || common || ']'
    WHEN 22 THEN '[["d",5],' || common || ']'
    ELSE '[["d","' || d || '"],' || common || ']' END AS tags FROM event_parts"""
CTES["event_ids"] = r"""
  SELECT *, CASE WHEN m = 1 THEN sha256(doc_id || '') ELSE
    sha256('[0,"' || pubkey || '",' || created || ',' || kind || ',' || tags || ',' || content || ']') END AS id FROM event_tags"""
CTES["event_rows"] = r"""
  SELECT doc_id, m, second, '{"id":"' || id || '","pubkey":"' || pubkey || '","created_at":' || created || ',"kind":' || kind ||
    ',"tags":' || tags || ',"content":' || content || ',"sig":"' || CASE WHEN m = 5 THEN id ELSE id || id END || '"}' AS ev
  FROM event_ids"""
CTES["feed"] = r"""
  SELECT doc_id, CASE WHEN m <> 15 THEN ev END AS ev, CASE WHEN m <> 15 THEN 'wss://r' || r || '.example' END AS relay,
    CASE WHEN m <> 15 THEN second + 10 * (r + 1) END AS received_at
  FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS r FROM event_rows)"""
CTES["opened"] = r"""
  SELECT *, json_extract_string(ev, '$.id') AS id, json_extract_string(ev, '$.pubkey') AS pubkey,
    json_extract_string(ev, '$.created_at') AS created_at, json_type(ev, '$.created_at') AS created_type,
    json_extract_string(ev, '$.kind') AS kind, json_type(ev, '$.content') AS content_type,
    json_extract_string(ev, '$.content') AS content, json_type(ev, '$.tags') AS tags_type, json_extract(ev, '$.tags') AS tags,
    json_extract_string(ev, '$.sig') AS sig,
    sha256('[0,' || CAST(json_extract(ev, '$.pubkey') AS VARCHAR) || ',' || CAST(json_extract(ev, '$.created_at') AS VARCHAR) || ',' ||
      CAST(json_extract(ev, '$.kind') AS VARCHAR) || ',' || CAST(json_extract(ev, '$.tags') AS VARCHAR) || ',' ||
      CAST(json_extract(ev, '$.content') AS VARCHAR) || ']') AS computed_id FROM feed"""
CTES["checked"] = r"""
  SELECT *, CASE WHEN ev IS NULL THEN 'invalid_event'
    WHEN NOT regexp_full_match(lower(id), '[0-9a-f]{64}') THEN 'invalid_id'
    WHEN NOT regexp_full_match(lower(pubkey), '[0-9a-f]{64}') THEN 'invalid_pubkey'
    WHEN created_type NOT IN ('BIGINT', 'UBIGINT') THEN 'invalid_created_at'
    WHEN kind <> '30023' THEN 'unsupported_kind' WHEN content_type <> 'VARCHAR' THEN 'invalid_content'
    WHEN strlen(content) > 20000 THEN 'content_too_large' WHEN tags_type <> 'ARRAY' THEN 'invalid_tags'
    WHEN json_array_length(tags) > 200 THEN 'too_many_tags'
    WHEN regexp_matches(CAST(tags AS VARCHAR), 'é{1025}') THEN 'tag_too_long'
    WHEN NOT regexp_full_match(lower(sig), '[0-9a-f]{128}') THEN 'invalid_signature'
    WHEN computed_id <> lower(id) THEN 'id_mismatch' END AS reason FROM opened"""
CTES["checked"] = CTES["checked"].replace(
    "regexp_matches(CAST(tags AS VARCHAR), 'é{1025}')", "contains(CAST(tags AS VARCHAR), repeat('é', 1025))")
CTES["checked_all"] = CTES["checked"].replace("> 20000", "> 512000")
CTES["valid"] = r"""
  SELECT lower(id) AS event_id, lower(pubkey) AS pubkey, CAST(created_at AS BIGINT) AS created_at, CAST(kind AS BIGINT) AS kind,
    tags, content, relay, received_at,
    nullif(regexp_extract(CAST(tags AS VARCHAR), '\["d","([^"]*)"', 1), '') AS d_tag FROM checked_all WHERE reason IS NULL"""
CTES["stored"] = r"""
  SELECT event_id, any_value(pubkey) AS pubkey, any_value(created_at) AS created_at, any_value(kind) AS kind, any_value(tags) AS tags,
    any_value(content) AS content, any_value(d_tag) AS d_tag,
    CASE WHEN any_value(d_tag) IS NOT NULL THEN any_value(kind) || ':' || any_value(pubkey) || ':' || any_value(d_tag) END AS article_address,
    min(received_at) AS first_seen_at, max(received_at) AS last_seen_at, string_agg(DISTINCT relay, ',' ORDER BY relay) AS relays
  FROM valid GROUP BY event_id"""
CTES["addresses"] = r"""
  SELECT kind, pubkey, d_tag, article_address, event_id AS current_event_id, created_at AS current_event_created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY article_address ORDER BY created_at DESC, event_id DESC) AS rn
    FROM stored WHERE d_tag IS NOT NULL) WHERE rn = 1"""
CTES["relay_table"] = r"""
  SELECT url, z NOT IN ('3', '4') AS enabled, z <> '1' AS read_enabled, z IN ('0', '1', '5') AS write_enabled FROM (
    SELECT url, right(replace(url, '.example', ''), 1) AS z FROM (
      SELECT DISTINCT relay AS url FROM valid UNION ALL
      SELECT CASE WHEN right(source, 1) = '9' THEN 'http://' ELSE 'wss://' END || source || '.example' FROM (SELECT DISTINCT source FROM documents)))"""

# -- scan ------------------------------------------------------------------------
CTES["tag_rows"] = r"""
  SELECT event_id, generate_subscripts(CAST(tags AS JSON[]), 1) AS i, unnest(CAST(tags AS JSON[])) AS tag FROM stored"""
CTES["text_hits"] = r"""
  SELECT event_id, 2 AS form, 'markdown_image' AS source_type, regexp_extract_all(content, '(?i)!\[[^\]]*\]\((https?://[^)\s]+)', 1) AS hits FROM stored
  UNION ALL SELECT event_id, 3, 'markdown_link', regexp_extract_all(content, '(?i)(?:^|[^!])\[[^\]]*\]\((https?://[^)\s]+)', 1) FROM stored
  UNION ALL SELECT event_id, 4, 'autolink', regexp_extract_all(content, '(?i)<(https?://[^>]+)>', 1) FROM stored
  UNION ALL SELECT event_id, 5, 'html_attr', regexp_extract_all(content, '(?i)(?:src|href)\s*=\s*["''](https?://[^"'']+)["'']', 1) FROM stored
  UNION ALL SELECT event_id, 6, 'bare_url', regexp_extract_all(content, '(?i)(https?://[^\s<>\[\]()"''\\`]+)', 1) FROM stored"""
CTES["raw_finds"] = r"""
  SELECT event_id, 1 AS form, i, CASE WHEN json_extract_string(tag, '$[0]') = 'image' THEN json_extract_string(tag, '$[1]')
      ELSE substr(json_extract_string(tag, '$[1]'), 5) END AS found,
    CASE WHEN json_extract_string(tag, '$[0]') = 'image' THEN 'image_tag' ELSE 'imeta_tag' END AS source_type,
    json_extract_string(tag, '$[0]') AS source_location
  FROM tag_rows WHERE json_extract_string(tag, '$[0]') IN ('image', 'imeta')
  UNION ALL
  SELECT event_id, form, generate_subscripts(hits, 1), unnest(hits), source_type, 'content' FROM text_hits"""
CTES["clean_finds"] = f"SELECT * EXCLUDE (found), {clean('found')} AS original_url FROM raw_finds"
normal("norm_finds", "clean_finds", "original_url")
CTES["finds"] = """
  SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY form, i) - 1 AS position, original_url, normalized_url, hostname,
    source_type, source_location FROM norm_finds WHERE normalized_url IS NOT NULL"""
CTES["occ"] = "SELECT * FROM finds WHERE position < 50"
chain("chain", "occ")
CTES["chain_nodes"] = f"""
  SELECT start_url AS normalized_url, CAST(idx AS BIGINT) AS hop_index, url AS matched_url, host AS matched_hostname,
    {domain('host')} AS domain FROM chain_walk"""
CTES["chain_hits"] = """
  SELECT n.normalized_url, n.hop_index, n.matched_url, n.matched_hostname, h.* EXCLUDE (domain) FROM chain_nodes n JOIN hits h USING (domain)"""
CTES["matches"] = "SELECT o.event_id || ':3' AS scan_id, o.event_id, o.position, c.* FROM occ o JOIN chain_hits c USING (normalized_url)"
CTES["event_urls"] = """
  SELECT event_id, normalized_url, min(position) AS primary_position, count(*) AS occurrences FROM occ GROUP BY 1, 2"""
CTES["url_counts"] = """
  SELECT u.event_id, sum(u.occurrences) AS discovered, count(*) AS resolved, sum(c.redirect_count) AS redirects,
    bool_or(c.status NOT IN ('completed', 'skipped_host')) AS failed FROM event_urls u JOIN chains c USING (normalized_url) GROUP BY 1"""
CTES["match_counts"] = "SELECT event_id, count(*) AS found FROM matches GROUP BY 1"
CTES["scans3"] = """
  SELECT s.event_id || ':3' AS scan_id, s.event_id,
    CASE WHEN u.failed THEN 'partial' WHEN m.found > 0 THEN 'matched' ELSE 'clean' END AS status,
    CAST(coalesce(u.discovered, 0) AS BIGINT) AS urls_discovered, CAST(coalesce(u.resolved, 0) AS BIGINT) AS urls_resolved,
    CAST(coalesce(u.redirects, 0) AS BIGINT) AS redirects_followed, CAST(coalesce(m.found, 0) AS BIGINT) AS matches_found
  FROM stored s LEFT JOIN url_counts u USING (event_id) LEFT JOIN match_counts m USING (event_id)"""
CTES["classified3"] = "SELECT DISTINCT scan_id, event_id, category_id, 'current' AS status FROM matches"
CTES["scan_log"] = f"""
  SELECT scan_id, event_id, 3 AS policy_generation, status, {SCANNED} AS completed_at, {SCANNED} AS inserted_at FROM scans3
  UNION ALL SELECT event_id || ':1', event_id, 1, CASE WHEN left(event_id, 1) < '4' THEN 'failed' ELSE 'clean' END, created_at, created_at FROM stored
  UNION ALL SELECT event_id || ':2', event_id, 2, 'matched', {SCANNED}, {SCANNED} FROM stored WHERE left(event_id, 1) = 'd'
  UNION ALL SELECT event_id || ':4', event_id, 4, 'running', NULL, {SCANNED} + 10 FROM stored WHERE left(event_id, 1) IN ('e', 'f')
  UNION ALL SELECT event_id || ':5', event_id, 5, 'failed', {SCANNED} + 20, {SCANNED} + 20 FROM stored WHERE left(event_id, 1) = 'c'"""
CTES["class_log"] = """
  SELECT * FROM classified3
  UNION ALL SELECT event_id || ':2', event_id, 'c-spam', 'current' FROM stored WHERE left(event_id, 1) IN ('c', 'd')
  UNION ALL SELECT event_id || ':3', event_id, 'c-legacy', 'current' FROM stored WHERE left(event_id, 1) IN ('c', 'd')"""
CTES["classified"] = """
  SELECT l.scan_id, c.category_id, c.slug, c.blocks_serving FROM class_log l JOIN cats c USING (category_id) WHERE c.enabled"""
CTES["scan_verdict"] = """
  SELECT s.*, CASE WHEN s.status = 'running' THEN NULL ELSE coalesce(v.blocking, false) END AS blacklisted,
    CASE WHEN s.status = 'running' THEN 'pending' ELSE s.status END AS api_status, coalesce(v.categories, '') AS categories
  FROM scan_log s LEFT JOIN (SELECT scan_id, bool_or(blocks_serving) AS blocking, string_agg(DISTINCT slug, ',' ORDER BY slug) AS categories
    FROM classified GROUP BY 1) v USING (scan_id)"""
CTES["latest"] = """
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY inserted_at DESC, scan_id DESC) AS rn
    FROM scan_verdict) WHERE rn = 1"""
CTES["states"] = """
  SELECT a.*, l.scan_id, coalesce(l.api_status, 'pending') AS status, l.blacklisted, coalesce(l.categories, '') AS categories,
    l.policy_generation, l.completed_at AS scanned_at FROM addresses a LEFT JOIN latest l ON l.event_id = a.current_event_id"""
CTES["labels"] = """
  SELECT DISTINCT 'l:' || event_id || ':' || category_id AS label_id, event_id, category_id FROM class_log WHERE right(event_id, 1) < '4'"""
CTES["deliveries"] = """
  SELECT label_id, r AS relay_url, CASE WHEN substr(event_id, 2, 1) < '6' OR (substr(event_id, 2, 1) < 'a' AND contains(r, 'r1'))
    THEN 'ok' ELSE 'error' END AS status FROM (SELECT *, unnest(['wss://r0.example', 'wss://r1.example']) AS r FROM labels)"""
CTES["event_relays"] = "SELECT DISTINCT event_id, relay AS relay_url FROM valid"
CTES["label_plan"] = """
  SELECT w.event_id, w.category_id, c.slug, h.source_relay, CASE WHEN l.label_id IS NULL THEN 'draft' ELSE 'reuse' END AS action
  FROM (SELECT DISTINCT event_id, category_id FROM class_log) w JOIN cats c USING (category_id)
  LEFT JOIN (SELECT event_id, min(relay_url) AS source_relay FROM event_relays GROUP BY 1) h USING (event_id)
  LEFT JOIN labels l ON l.event_id = w.event_id AND l.category_id = w.category_id"""
CTES["keys"] = """
  SELECT CASE WHEN doc_id % 5 = 3 THEN 'big' ELSE 'q' || (doc_id // 400) END AS batch, doc_id AS pos,
    CAST(CASE WHEN doc_id % 25 = 0 THEN 1 ELSE 30023 END AS BIGINT) AS kind, sha256(source) AS pubkey,
    CASE WHEN doc_id % 10 = 7 THEN 'missing-' || doc_id ELSE 'slug-' || (doc_id // 60) END AS d_tag FROM documents"""
CTES["requests"] = """
  SELECT CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END AS id, user_id AS key, ts, event_id % 5 + 1 AS cost,
    epoch_us(ts) // 1000000 - event_id % 140 + 10 AS created_at, epoch_us(ts) // 1000000 AS arrived_at FROM events"""
CTES["landings"] = """
  SELECT key, cost, us, us // 86400000000 * 86400 AS window_start, CASE WHEN id % 50 = 7 THEN least(file + 2, 7) ELSE file END AS file
  FROM (SELECT id, key, cost, epoch_us(ts) AS us, (epoch_us(ts) - low) * 8 // (high - low + 1) AS file
    FROM requests, (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM requests))"""

_WORD = re.compile(r"\b[a-z_0-9]+\b")


def _needed(text: str, own: str | None = None) -> list[str]:
    words = set(_WORD.findall(text))
    return [name for name in CTES if name in words and name != own]


def sql(body: str) -> str:
    """The query with the expressions it needs, in the order of definition."""
    wanted: set[str] = set()
    todo = _needed(body)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += _needed(CTES[name], name)
    parts = []
    for name, text in CTES.items():
        if name in wanted:
            kind = "" if name.endswith("_walk") else "MATERIALIZED "
            parts.append(f"{name} AS {kind}({text})")
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
