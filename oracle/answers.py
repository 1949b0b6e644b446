"""One SQL answer per query."""

from __future__ import annotations

from hedgemark.config import DEFAULT_SKIP_HOSTS
from oracle.inputs import BASE, NOW, SCANNED, domain, sql

ANSWERS: dict[str, str] = {}


def answer(name: str, body: str) -> None:
    ANSWERS[name] = sql(body)


N = "CAST(count(*) AS BIGINT)"

# -- sources and sinks
answer("read_events", """
  SELECT relay, received_at, json_extract_string(ev, '$.id') AS event_id, json_extract_string(ev, '$.sig') AS sig FROM feed""")
answer("read_blocklist_bodies", """
  SELECT blocklist_id, CAST(strlen(body) AS BIGINT) AS bytes,
    CASE WHEN strlen(body) <= 1500 THEN sha256(body) END AS checksum FROM bodies""")
answer("write_entries", f"""
  SELECT blocklist_version_id, rule_type, {N} AS n, min(normalized_value) AS first_value FROM entries GROUP BY 1, 2""")
answer("upsert_table", """
  SELECT a.article_address, f.event_id AS first_event_id, a.current_event_id, a.current_event_created_at FROM addresses a
  JOIN (SELECT article_address, event_id, row_number() OVER (PARTITION BY article_address ORDER BY created_at, event_id) AS rn
    FROM stored WHERE d_tag IS NOT NULL) f ON f.article_address = a.article_address AND f.rn = 1""")
answer("upsert_ignore", """
  SELECT DISTINCT hostname AS host, CASE WHEN starts_with(hostname, 'm.') THEN 'known' ELSE 'offered' END AS origin
  FROM pu WHERE hostname IS NOT NULL""")
answer("write_moderation_results", """
  SELECT article_address, blacklisted, status, current_event_id AS event_id, current_event_created_at AS event_created_at,
    categories, scanned_at, policy_generation FROM states""")
answer("write_label_drafts", """
  SELECT CAST(1985 AS BIGINT) AS kind, '' AS content, 'L|content.example;l|' || slug || '|content.example;e|' || event_id || '|' ||
    coalesce(source_relay, '') AS tags FROM label_plan WHERE action = 'draft'""")

# -- projections and filters
answer("validate_events", """
  SELECT id AS event_id, relay, received_at, coalesce(reason, 'accepted') AS outcome FROM checked""")
answer("recompute_event_ids", """
  SELECT event_id, computed_id, coalesce(event_id = computed_id, false) AS id_matches, relay FROM (
    SELECT lower(id) AS event_id, CASE WHEN created_type IN ('BIGINT', 'UBIGINT') THEN computed_id END AS computed_id, relay
    FROM opened WHERE ev IS NOT NULL)""")
answer("derive_addresses", "SELECT event_id, d_tag, article_address FROM stored")
answer("ingest_filter", f"""
  SELECT relay, event_id, created_at, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY relay ORDER BY created_at DESC, event_id) AS rank
    FROM valid WHERE kind = 30023 AND created_at >= {NOW} - 86400) WHERE rank <= 100""")
answer("extract_urls", "SELECT * FROM finds")
answer("normalize_urls", """
  SELECT page_id, normalized_url, hostname, normalized_url IS NOT NULL AS valid FROM pu""")
answer("registrable_domains", f"""
  SELECT domain, {N} AS rows, CAST(count(DISTINCT hostname) AS BIGINT) AS hosts FROM pu WHERE hostname IS NOT NULL GROUP BY domain""")
answer("classify_targets", r"""
  SELECT page_id, CASE WHEN t = '' OR strlen(t) > 4096 THEN 'error' WHEN contains(t, '/') THEN 'url' ELSE 'domain' END AS target_kind,
    CASE WHEN t = '' OR strlen(t) > 4096 THEN NULL WHEN contains(t, '/') AND NOT contains(t, '://') THEN 'https://' || t ELSE t END AS target,
    CASE WHEN t = '' THEN 'empty' WHEN strlen(t) > 4096 THEN 'url_too_long' END AS target_error
  FROM (SELECT page_id, trim(CASE page_id % 6 WHEN 1 THEN regexp_extract(url, '^https?://([^/]+)', 1)
    WHEN 2 THEN regexp_replace(raw_url, '^[a-zA-Z]+://', '') WHEN 3 THEN '   ' WHEN 4 THEN repeat(raw_url, 100) ELSE raw_url END) AS t FROM pg)""")
answer("filter_public_addresses", """
  SELECT h.url, h.observed_at FROM hop_all h WHERE NOT EXISTS (
    SELECT 1 FROM blocked b WHERE b.url = h.url AND b.observed_at = h.observed_at)""")
answer("skip_hosts", """
  SELECT page_id, hostname, starts_with(hostname, 'm.') AS skipped FROM pu WHERE normalized_url IS NOT NULL""")
answer("parse_blocklists", """
  SELECT blocklist_id, CAST(line_no AS BIGINT) AS line_no, rule_type, normalized_value, registrable_domain FROM rules""")
answer("due_blocklists", f"""
  SELECT blocklist_id, forced FROM registry, (VALUES (false), (true)) AS f(forced)
  WHERE enabled AND source_type = 'remote' AND refresh_status = 'ok' AND last_error IS NULL
    AND (forced OR next_refresh_at IS NULL OR next_refresh_at <= {BASE} + 3000)""")
answer("failure_class", f"""
  SELECT CASE WHEN error IS NULL THEN 'ok' WHEN error = 'timeout' THEN 'failed' ELSE 'rejected' END AS refresh_status, error, {N} AS n
  FROM version_log GROUP BY 1, 2""")
answer("check_constraints", """
  SELECT 'blocklists' AS "table", blocklist_id AS key, 'name_required' AS rule FROM registry WHERE name = ''
  UNION ALL SELECT 'blocklists', blocklist_id, 'source_type_known' FROM registry WHERE source_type = 'ftp'
  UNION ALL SELECT 'blocklists', blocklist_id, 'format_known' FROM registry WHERE format = 'rpz'
  UNION ALL SELECT 'blocklists', blocklist_id, 'interval_positive' FROM registry WHERE refresh_interval_s = 0
  UNION ALL SELECT 'blocklists', blocklist_id, 'source_url_required' FROM registry WHERE source_type = 'remote' AND coalesce(source_url, '') = ''
  UNION ALL SELECT 'blocklists', category_id || '|' || name, 'name_unique' FROM registry WHERE name <> '' GROUP BY category_id, name HAVING count(*) > 1
  UNION ALL SELECT 'blocklists', source_url, 'source_url_unique' FROM registry WHERE source_url <> '' GROUP BY source_url HAVING count(*) > 1
  UNION ALL SELECT 'relays', url, 'url_format' FROM relay_table WHERE starts_with(url, 'http:')""")
answer("locked_slugs", """
  SELECT category_id, slug || '-new' AS slug, slug AS old_slug FROM cats WHERE category_id IN (SELECT category_id FROM labels)""")
answer("backfill_domains", """
  SELECT entry_id, rule_type, CASE WHEN rule_type = 'url_prefix' THEN NULL ELSE own_domain END AS registrable_domain FROM entries""")
ASKED = f"""(SELECT page_id, h AS hostname, {domain('h')} AS domain FROM (
    SELECT page_id, CASE WHEN page_id % 40 NOT IN (5, 15, 25)
      THEN replace(regexp_extract(url, '^https?://([^/]+)', 1), '.example.', '-example.') END AS h FROM pages))"""
answer("result_fingerprints", f"""
  SELECT a.page_id, sha256(coalesce(a.domain, '') || '::3::' || coalesce(v.categories, '') || ':' || coalesce(l.list_ids, '')) AS fingerprint
  FROM {ASKED} a LEFT JOIN domain_answer v USING (domain) LEFT JOIN domain_lists l USING (domain)""")
answer("changed_articles", """
  SELECT s.article_address, sha256(s.current_event_id || ':' || coalesce(s.scan_id, '') || ':' || coalesce(s.policy_generation || '', '')) AS fingerprint
  FROM states s WHERE s.policy_generation > 3""")
answer("article_change_feed", """
  SELECT article_address, CASE digit WHEN '0' THEN 'insert' WHEN '1' THEN 'delete' ELSE 'update' END AS kind,
    CASE WHEN digit <> '0' THEN old END AS old, CASE WHEN digit <> '1' THEN new END AS new
  FROM (SELECT article_address, left(current_event_id, 1) AS digit,
      sha256(current_event_id || ':' || coalesce(scan_id, '') || ':' || coalesce(CASE WHEN policy_generation > 3 THEN 3 ELSE policy_generation END || '', '')) AS old,
      sha256(current_event_id || ':' || coalesce(scan_id, '') || ':' || coalesce(policy_generation || '', '')) AS new FROM states) marked
  WHERE digit IN ('0', '1') OR old <> new""")
answer("verdicts", f"""
  SELECT CASE WHEN normalized_url IS NULL THEN 'invalid' WHEN blacklisted THEN 'blocked' WHEN blacklisted IS NOT NULL THEN 'listed'
    ELSE 'clean' END AS verdict, {N} AS n FROM pu LEFT JOIN domain_answer USING (domain) GROUP BY 1""")

# -- joins
answer("policy_snapshot", """
  SELECT entry_id, domain, blocklist_version_id, blocklist_id, list_name, category_slug, blocks_serving FROM snapshot""")
answer("match_targets", """
  SELECT p.page_id, p.domain, h.category_id, h.blocklist_id, h.blocklist_version_id, h.entry_id FROM pu p JOIN hits h USING (domain)""")
answer("explain_lists", """
  SELECT page_id, hostname, domain, coalesce(named, '') AS lists FROM pu LEFT JOIN domain_lists USING (domain) WHERE hostname IS NOT NULL""")
answer("match_hops", """
  SELECT scan_id, position, hop_index, matched_url, matched_hostname, category_id, blocklist_id, blocklist_version_id, entry_id,
    'domain' AS match_type FROM matches""")
answer("classification_categories", "SELECT scan_id, category_id, slug, blocks_serving FROM classified")
answer("article_states", """
  SELECT article_address, current_event_id AS event_id, current_event_created_at AS event_created_at, scan_id, status, blacklisted,
    categories, policy_generation, scanned_at FROM states""")
answer("needs_scan", """
  SELECT event_id FROM stored WHERE event_id NOT IN (
    SELECT current_event_id FROM states WHERE status IN ('clean', 'matched', 'partial', 'failed'))""")
answer("current_policy_rescan", """
  SELECT event_id, 'existing' AS mode FROM stored
  UNION ALL SELECT current_event_id, 'listed' FROM states WHERE status = 'pending'""")
answer("ip_ranges", "SELECT url, ip, class FROM ip_class")
answer("narrowest_ranges", """
  SELECT a.orderkey, a.linenumber, a.ip, b.range_id, b.cidr FROM range_addresses a LEFT JOIN (
    SELECT v, arg_min(range_id, place) AS range_id, arg_min(cidr, place) AS cidr FROM (
      SELECT a.v, r.range_id, r.cidr, -r.size * 1000000000000 + r.range_id AS place
      FROM (SELECT DISTINCT v FROM range_addresses WHERE v IS NOT NULL) a JOIN address_ranges r ON a.v BETWEEN r.low AND r.low + r.width - 1)
    GROUP BY 1) b USING (v)""")
answer("resolve_redirects", """
  SELECT normalized_url, status, final_url, final_hostname, http_status, redirect_count, error, array_to_string(path, ',') AS hops FROM page_chains""")
answer("event_detail", """
  SELECT s.event_id, s.article_address, s.relays, d.scans, d.letters, d.content FROM stored s JOIN (
    SELECT event_id, CAST(count(*) AS BIGINT) AS scans, CAST(length(string_agg(one, chr(10) ORDER BY inserted_at, scan_id)) AS BIGINT) AS letters,
      sha256(string_agg(one, chr(10) ORDER BY inserted_at, scan_id)) AS content
    FROM (SELECT l.event_id, l.inserted_at, l.scan_id, concat_ws('|', l.scan_id, l.status, l.policy_generation,
        coalesce(o.text, ''), coalesce(r.text, ''), coalesce(m.text, ''), coalesce(k.text, '')) AS one
      FROM scan_log l
      LEFT JOIN (SELECT event_id || ':3' AS scan_id, string_agg(concat_ws('=', position, normalized_url, source_type), ';' ORDER BY position) AS text
        FROM occ GROUP BY 1) o USING (scan_id)
      LEFT JOIN (SELECT event_id || ':3' AS scan_id, string_agg(concat_ws('=', primary_position, normalized_url, status, coalesce(final_url, ''),
          redirect_count, array_to_string(path, '>')), ';' ORDER BY primary_position, normalized_url) AS text
        FROM event_urls JOIN chains USING (normalized_url) GROUP BY 1) r USING (scan_id)
      LEFT JOIN (SELECT scan_id, string_agg(concat_ws('=', position, hop_index, category_id, blocklist_id, matched_hostname), ';'
          ORDER BY position, hop_index, category_id, blocklist_id) AS text FROM matches GROUP BY 1) m USING (scan_id)
      LEFT JOIN (SELECT scan_id, string_agg(DISTINCT category_id, ',' ORDER BY category_id) AS text FROM class_log GROUP BY 1) k USING (scan_id))
    GROUP BY 1) d USING (event_id)""")
answer("batch_lookup", """
  SELECT k.batch, k.pos, k.kind, e.error, CASE WHEN e.error IS NULL THEN k.kind || ':' || k.pubkey || ':' || k.d_tag END AS article_address,
    CASE WHEN e.error IS NULL THEN coalesce(s.status, 'unknown') END AS status, CASE WHEN e.error IS NULL THEN s.blacklisted END AS blacklisted,
    CASE WHEN e.error IS NULL THEN s.current_event_id END AS event_id,
    CASE WHEN e.error IS NULL THEN s.current_event_created_at END AS event_created_at,
    CASE WHEN e.error IS NULL THEN coalesce(s.categories, '') END AS categories,
    CASE WHEN e.error IS NULL THEN s.scanned_at END AS scanned_at, CASE WHEN e.error IS NULL THEN s.policy_generation END AS policy_generation
  FROM keys k JOIN (SELECT pos, CASE WHEN count(*) OVER (PARTITION BY batch) > 400 THEN 'batch too large'
      WHEN kind <> 30023 THEN 'unsupported kind' END AS error FROM keys) e USING (pos)
  LEFT JOIN states s ON s.kind = k.kind AND s.pubkey = k.pubkey AND s.d_tag = k.d_tag""")
answer("delete_blocklist", f"""
  SELECT 'blocklists' AS "table", {N} AS n FROM lists WHERE blocklist_id <> 'L1'
  UNION ALL SELECT 'versions', count(DISTINCT blocklist_version_id) FROM entries WHERE blocklist_version_id NOT IN ('v1', 'v1old')
  UNION ALL SELECT 'entries', count(*) FROM entries WHERE blocklist_version_id NOT IN ('v1', 'v1old')
  UNION ALL SELECT 'matches', count(*) FROM matches WHERE blocklist_id <> 'L1'
  UNION ALL SELECT 'held_categories', count(*) FROM cats WHERE category_id IN (SELECT category_id FROM lists WHERE blocklist_id <> 'L1')""")
answer("disable_list", f"""
  SELECT 'one_off' AS "case", {N} AS rules, CAST(count(DISTINCT domain) AS BIGINT) AS domains FROM snapshot WHERE blocklist_id <> 'L1'
  UNION ALL SELECT 'all_off', 0, 0""")
answer("domain_tree_match", """
  SELECT p.page_id, p.hostname, d.v AS listed_domain FROM pu p JOIN (
    SELECT DISTINCT normalized_value AS v FROM entries WHERE rule_type <> 'url_prefix') d
  ON p.hostname = d.v OR ends_with(p.hostname, '.' || d.v)""")
answer("stale_labels", """
  SELECT l.label_id, l.event_id, l.category_id, 'withdrawn' AS status FROM labels l WHERE EXISTS (
    SELECT 1 FROM latest t JOIN addresses a ON a.current_event_id = t.event_id JOIN class_log c ON c.scan_id = t.scan_id
    WHERE c.event_id = l.event_id AND c.category_id = l.category_id)""")
answer("label_plan", "SELECT event_id, category_id, slug, source_relay, action FROM label_plan")
answer("fetch_newest_match", """
  SELECT k.pos, a.current_event_id AS event_id, a.current_event_created_at AS created_at FROM keys k
  JOIN addresses a ON a.kind = k.kind AND a.pubkey = k.pubkey AND a.d_tag = k.d_tag""")

# -- aggregations
answer("dedup_events", "SELECT event_id, first_seen_at, last_seen_at, relays, sha256(content) AS content_hash FROM stored")
answer("current_revisions", "SELECT article_address, current_event_id, current_event_created_at FROM addresses")
DISTINCT = """(SELECT blocklist_id, rule_type, normalized_value, any_value(registrable_domain) AS registrable_domain,
    CAST(min(line_no) AS BIGINT) AS line_no FROM small_rules GROUP BY 1, 2, 3)"""
answer("distinct_rules", f"SELECT * FROM {DISTINCT.replace('small_rules', 'rules')}")
answer("import_decision", f"""
  SELECT *, CASE WHEN error IS NULL THEN 'activate' ELSE 'reject' END AS decision FROM (
    SELECT b.blocklist_id, CAST(strlen(b.body) AS BIGINT) AS bytes, sha256(b.body) AS checksum, coalesce(r.n, 0) AS entry_count, p.previous_count,
      CASE WHEN strlen(b.body) > 1500 THEN 'download too large' WHEN coalesce(r.n, 0) > 22 THEN 'too many entries'
        WHEN coalesce(r.n, 0) = 0 THEN 'no valid entries'
        WHEN p.previous_count > 0 AND r.n * 2 < p.previous_count THEN 'suspicious entry count decrease' END AS error
    FROM bodies b LEFT JOIN (SELECT blocklist_id, {N} AS n FROM {DISTINCT} GROUP BY 1) r USING (blocklist_id)
    LEFT JOIN previous p USING (blocklist_id))""")
answer("distinct_urls", "SELECT event_id, normalized_url, primary_position, occurrences FROM event_urls")
answer("scan_summary", "SELECT * FROM scans3")
answer("classify_events", "SELECT * FROM classified3")
answer("one_hit_per_category", "SELECT * FROM hits")
answer("article_verdict", "SELECT scan_id, api_status AS status, blacklisted, categories FROM scan_verdict")
answer("target_verdict", f"""
  SELECT a.page_id, a.hostname, a.domain, CASE WHEN a.hostname IS NULL THEN 'invalid_domain' END AS target_error,
    CASE WHEN a.hostname IS NULL THEN NULL WHEN v.domain IS NULL THEN 'clean' ELSE 'matched' END AS status,
    CASE WHEN a.hostname IS NOT NULL THEN coalesce(v.blacklisted, false) END AS blacklisted, coalesce(v.categories, '') AS categories, coalesce(l.list_names, '') AS lists,
    CAST(3 AS BIGINT) AS policy_generation
  FROM {ASKED} a LEFT JOIN domain_answer v USING (domain) LEFT JOIN domain_lists l USING (domain)""")
WALK = f"(SELECT start_url, idx, host, {domain('host')} AS domain FROM page_chain_walk)"
answer("url_verdict", f"""
  SELECT c.normalized_url, p.domain, CASE WHEN v.start_url IS NULL THEN 'clean' ELSE 'matched' END AS status,
    coalesce(v.blacklisted, false) AS blacklisted, coalesce(v.categories, '') AS categories, c.final_url, c.redirect_count
  FROM page_chains c JOIN (SELECT DISTINCT normalized_url, domain FROM pu) p USING (normalized_url)
  LEFT JOIN (SELECT start_url, bool_or(blocks_serving) AS blacklisted, string_agg(DISTINCT category_slug, ',' ORDER BY category_slug) AS categories
    FROM {WALK} JOIN hits USING (domain) GROUP BY 1) v ON v.start_url = c.normalized_url""")
CHAIN_LISTS = f"""(SELECT start_url, string_agg(list_name, ',' ORDER BY category_slug, list_name) AS names FROM (
    SELECT DISTINCT start_url, category_slug, list_name FROM {WALK} JOIN snapshot USING (domain)) GROUP BY 1)"""
answer("write_target_results", f"""
  SELECT p.hostname AS domain, p.domain AS registrable_domain, c.normalized_url AS url, c.final_url, c.final_hostname AS final_domain,
    c.redirect_count, c.status AS resolution_status, coalesce(v.blacklisted, false) AS blacklisted,
    CASE WHEN v.start_url IS NULL THEN 'clean' ELSE 'matched' END AS status, coalesce(v.categories, '') AS categories,
    l.names AS lists, CAST(3 AS BIGINT) AS policy_generation
  FROM page_chains c JOIN (SELECT DISTINCT normalized_url, hostname, domain FROM pu) p USING (normalized_url)
  LEFT JOIN (SELECT start_url, bool_or(blocks_serving) AS blacklisted, string_agg(DISTINCT category_slug, ',' ORDER BY category_slug) AS categories
    FROM {WALK} JOIN hits USING (domain) GROUP BY 1) v ON v.start_url = c.normalized_url
  LEFT JOIN {CHAIN_LISTS} l ON l.start_url = c.normalized_url""")
answer("explain_chain", f"""
  SELECT c.normalized_url, h.hosts, coalesce(l.lists, '') AS lists, h.explained FROM page_chains c
  JOIN (SELECT start_url, string_agg(host, ',' ORDER BY first) AS hosts,
      string_agg(concat_ws('=', host, coalesce(domain, ''), coalesce(own, '')), ',' ORDER BY first) AS explained FROM (
    SELECT start_url, host, any_value(domain) AS domain, min(idx) AS first FROM {WALK} GROUP BY 1, 2)
    LEFT JOIN (SELECT domain, string_agg(named, '+' ORDER BY category_slug, list_name) AS own FROM (
      SELECT DISTINCT domain, category_slug, list_name, category_slug || ':' || list_name AS named FROM snapshot) GROUP BY 1) USING (domain)
    GROUP BY 1) h ON h.start_url = c.normalized_url
  LEFT JOIN (SELECT start_url, string_agg(named, ',' ORDER BY category_slug, list_name) AS lists FROM (
    SELECT DISTINCT start_url, category_slug, list_name, category_slug || ':' || list_name AS named FROM {WALK} JOIN snapshot USING (domain))
    GROUP BY 1) l ON l.start_url = c.normalized_url""")
answer("dashboard_stats", f"""
  SELECT (SELECT {N} FROM stored) AS events, (SELECT {N} FROM scan_log) AS scans,
    (SELECT {N} FROM scan_log WHERE status = 'matched') AS matched, (SELECT {N} FROM matches) AS matches""")
answer("ingest_counters", f"""
  SELECT 'received' AS counter, relay AS label, {N} AS n FROM checked WHERE relay IS NOT NULL GROUP BY relay
  UNION ALL SELECT 'rejected', reason, count(*) FROM checked WHERE reason IS NOT NULL GROUP BY reason""")
answer("label_delivery_status", """
  SELECT l.label_id, CASE WHEN bool_or(d.status = 'ok') AND EXISTS (SELECT 1 FROM relay_table WHERE enabled AND write_enabled)
    THEN 'active' ELSE 'pending' END AS status FROM labels l LEFT JOIN deliveries d USING (label_id) GROUP BY 1""")
answer("next_generation", "SELECT CAST(max(policy_generation) + 1 AS BIGINT) AS generation FROM scan_log")
answer("resolution_timing", """
  SELECT normalized_url, final_hostname, dns_ms, connect_ms, head_ms, dns_ms + connect_ms + head_ms AS duration_ms
  FROM chains WHERE dns_ms + connect_ms + head_ms >= 1000""")
ERRORS = f"""(SELECT b.blocklist_id, sha256(b.blocklist_id || ':' || sha256(b.body)) AS version_id, coalesce(r.n, 0) AS n,
    CASE WHEN strlen(b.body) > 1500 THEN 'download too large' WHEN coalesce(r.n, 0) > 22 THEN 'too many entries'
      WHEN coalesce(r.n, 0) = 0 THEN 'no valid entries'
      WHEN p.previous_count > 0 AND r.n * 2 < p.previous_count THEN 'suspicious entry count decrease' END AS error
    FROM bodies b LEFT JOIN (SELECT blocklist_id, {N} AS n FROM {DISTINCT} GROUP BY 1) r USING (blocklist_id)
    LEFT JOIN previous p USING (blocklist_id))"""
answer("refresh_outcome", f"""
  SELECT r.blocklist_id, e.decision, CASE WHEN e.decision IS NULL THEN r.refresh_status WHEN e.error IS NULL THEN 'ok' ELSE 'rejected' END AS refresh_status,
    CASE WHEN e.decision IS NULL THEN r.last_error ELSE e.error END AS last_error,
    CASE WHEN e.decision IS NOT NULL AND e.error IS NULL THEN {NOW} + r.refresh_interval_s ELSE r.next_refresh_at END AS next_refresh_at
  FROM registry r LEFT JOIN (SELECT blocklist_id, CASE WHEN same THEN 'unchanged' WHEN error IS NULL THEN 'activate' ELSE 'reject' END AS decision,
    CASE WHEN NOT same THEN error END AS error FROM (SELECT *, CAST(blocklist_id[2:] AS BIGINT) % 5 = 2 AS same FROM {ERRORS})) e USING (blocklist_id)""")
answer("seed_categories", """
  SELECT DISTINCT 'own-' || slug AS category_id, slug, upper(slug) AS name, false AS enabled, false AS blocks_serving
  FROM (SELECT CASE WHEN lang = 'en' THEN 'adult' ELSE lang END AS slug FROM documents WHERE lang IS NOT NULL)
  UNION ALL SELECT category_id, slug, name, enabled, blocks_serving FROM cats
  WHERE slug <> 'legacy' AND (slug <> 'adult' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'en'))""")
answer("seed_skip_hosts", f"""
  SELECT hostname AS host, {N} AS pages FROM pu WHERE hostname IS NOT NULL GROUP BY 1
  UNION ALL SELECT host, NULL FROM (VALUES {", ".join(f"('{h}')" for h in DEFAULT_SKIP_HOSTS)}) AS v(host)
  WHERE host NOT IN (SELECT hostname FROM pu WHERE hostname IS NOT NULL)""")
answer("import_lists", f"""
  SELECT e.version_id || ':' || r.line_no AS entry_id, e.version_id AS blocklist_version_id, r.rule_type, r.normalized_value, r.registrable_domain
  FROM {DISTINCT} r JOIN {ERRORS} e USING (blocklist_id) WHERE e.error IS NULL""")
answer("imported_versions", f"""
  SELECT version_id, blocklist_id, CASE WHEN error IS NULL THEN 'active' ELSE 'failed' END AS status,
    CASE WHEN error IS NULL THEN n ELSE 0 END AS entry_count, error FROM {ERRORS}""")
answer("bump_generation", f"""
  SELECT DISTINCT CAST(policy_generation AS BIGINT) AS generation, 'invalidate' AS reason, CAST(policy_generation AS BIGINT) AS inserted_at FROM scan_log
  UNION ALL SELECT max(policy_generation) + 1, 'list switched off', {NOW} FROM scan_log""")
answer("skip_host_values", r"""
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN rtrim(lower(regexp_extract(url, '^https?://([^/]+)', 1)), '.')
    WHEN 1 THEN hostname END AS host FROM pu""")
answer("list_checksums", "SELECT blocklist_id, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS checksum FROM bodies")

# -- windows, top-k, sets
answer("latest_scans", "SELECT event_id, scan_id, status, CAST(policy_generation AS BIGINT) AS policy_generation FROM latest")
answer("dedup_blocklists", """
  SELECT blocklist_id, category_id, name, source_url FROM (
    SELECT *, row_number() OVER (PARTITION BY CASE WHEN coalesce(source_url, '') = '' THEN blocklist_id ELSE source_url END
      ORDER BY inserted_at, blocklist_id) AS rn2 FROM (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category_id, name ORDER BY inserted_at, blocklist_id) AS rn FROM registry) WHERE rn = 1))
  WHERE rn2 = 1""")
answer("cap_urls", "SELECT event_id, position, normalized_url FROM finds WHERE position < 6")
answer("primary_occurrence", """
  SELECT e.event_id, e.normalized_url, e.primary_position, c.status, c.redirect_count FROM event_urls e JOIN chains c USING (normalized_url)""")
answer("activate_versions", "SELECT version_id, blocklist_id, new_status AS status, active_version_id FROM activated")
answer("recent_events", """
  SELECT s.event_id, s.kind, s.article_address, s.last_seen_at, s.relays, coalesce(n.n, '') AS scans
  FROM (SELECT * FROM stored ORDER BY last_seen_at DESC, event_id LIMIT 100) s
  LEFT JOIN (SELECT event_id, string_agg(scan_id || ':' || status, ',' ORDER BY inserted_at, scan_id) AS n
    FROM scan_log GROUP BY 1) n USING (event_id)""")
answer("recent_matches", """
  SELECT m.scan_id, m.position, m.hop_index, m.category_id, c.slug, l.name AS list_name, s.status AS scan_status, m.inserted_at
  FROM (SELECT m.*, e.last_seen_at AS inserted_at FROM matches m JOIN stored e USING (event_id)
    ORDER BY e.last_seen_at DESC, m.scan_id, m.position, m.hop_index, m.category_id LIMIT 200) m
  JOIN cats c USING (category_id) JOIN lists l USING (blocklist_id) JOIN scans3 s ON s.scan_id = m.scan_id""")
answer("policy_listing", """
  SELECT * FROM (SELECT blocklist_version_id, row_number() OVER (PARTITION BY blocklist_version_id ORDER BY normalized_value, entry_id) AS rank,
    entry_id, normalized_value FROM entries) WHERE rank <= 20""")
answer("blocklist_listing", """
  SELECT r.blocklist_id, r.name, c.slug AS category_slug, a.version_id AS active_version_id, a.entry_count
  FROM registry r LEFT JOIN cats c USING (category_id)
  LEFT JOIN (SELECT * FROM activated WHERE new_status = 'active') a USING (blocklist_id)""")
answer("version_listing", "SELECT blocklist_id, version_id, status, inserted_at FROM version_log")
answer("relay_union", """
  SELECT url FROM relay_table WHERE enabled AND read_enabled UNION SELECT 'wss://' || lang || '.example' FROM documents""")

# -- streams: the same rows as their batch twins
answer("stream_ingest", """
  SELECT CASE WHEN reason IS NULL THEN lower(id) ELSE id END AS event_id, relay, received_at, coalesce(reason, 'accepted') AS outcome FROM checked""")
answer("stream_dedup", "SELECT event_id, first_seen_at, last_seen_at, relays FROM stored")
answer("stream_first_sight", "SELECT event_id, article_address, created_at FROM stored")
answer("stream_current_revision", "SELECT article_address, current_event_id, current_event_created_at FROM addresses")
answer("stream_scan", "SELECT * FROM scans3")
answer("stream_article_state", """
  SELECT a.article_address, a.current_event_id AS event_id, s.status, coalesce(v.blacklisted, false) AS blacklisted,
    coalesce(v.categories, '') AS categories, CAST(3 AS BIGINT) AS policy_generation
  FROM addresses a JOIN scans3 s ON s.event_id = a.current_event_id
  LEFT JOIN (SELECT k.scan_id, bool_or(c.blocks_serving) AS blacklisted, string_agg(DISTINCT c.slug, ',' ORDER BY c.slug) AS categories
    FROM classified3 k JOIN cats c USING (category_id) WHERE c.enabled GROUP BY 1) v ON v.scan_id = s.scan_id""")
answer("article_verdicts", """
  SELECT a.article_address, a.current_event_id AS event_id, s.status, coalesce(v.blacklisted, false) AS blacklisted,
    coalesce(v.categories, '') AS categories, CAST(3 AS BIGINT) AS policy_generation
  FROM addresses a JOIN scans3 s ON s.event_id = a.current_event_id
  LEFT JOIN (SELECT k.scan_id, bool_or(c.blocks_serving) AS blacklisted, string_agg(DISTINCT c.slug, ',' ORDER BY c.slug) AS categories
    FROM classified3 k JOIN cats c USING (category_id) WHERE c.enabled GROUP BY 1) v ON v.scan_id = s.scan_id""")
answer("category_listing", """
  SELECT category_id, slug, name, enabled, blocks_serving FROM cats WHERE category_id IN (SELECT category_id FROM registry)""")
answer("freshness_classes", f"""
  SELECT CASE WHEN created_at < arrived_at - 65 THEN 'stale' WHEN created_at > arrived_at + 5 THEN 'future' ELSE 'ok' END AS freshness,
    created_at >= arrived_at - 86400 AS in_feed_window, {N} AS n FROM requests GROUP BY 1, 2""")
RATES = """
  SELECT key, CAST(arrived_at // 86400 * 86400 AS BIGINT) AS window_start, CAST(sum(cost) AS BIGINT) AS used, sum(cost) > 20 AS limited
  FROM requests GROUP BY 1, 2"""
answer("rate_window_audit", RATES)
answer("stream_rate_windows", """
  SELECT key, window_start, CAST(sum(cost) FILTER (NOT late) AS BIGINT) AS used, sum(cost) FILTER (NOT late) > 20 AS limited,
    CASE WHEN bool_or(NOT late) THEN (window_start + 86400) * 1000000 <= (SELECT max(us) FROM landings) - 3600000000 END AS closed,
    CAST(sum(cost) FILTER (late) AS BIGINT) AS late_used
  FROM (SELECT l.*, coalesce((window_start + 86400) * 1000000 <= clock, false) AS late FROM landings l JOIN
    (SELECT file, max(max(us)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000000 AS clock
     FROM landings GROUP BY file) c USING (file))
  GROUP BY key, window_start""")
answer("replay_detection", f"""
  SELECT id, {N} AS times, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM requests GROUP BY id HAVING count(*) > 1""")
answer("stream_replays", """
  SELECT id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY id ORDER BY ts) < 120000000
    THEN 'replay' ELSE 'fresh' END AS outcome FROM requests""")
answer("stream_ingest_counters", f"""
  SELECT received_at // 300 * 300 AS window_start, relay, coalesce(reason, 'accepted') AS outcome, {N} AS n
  FROM checked GROUP BY 1, 2, 3""")

# -- extension points
answer("register_extractor", f"""
  SELECT source_type, {N} AS n, CAST(count(DISTINCT event_id) AS BIGINT) AS events FROM finds
  WHERE source_location = 'content' OR left(event_id, 1) >= '8' GROUP BY 1""")
answer("event_source_hook", f"""
  SELECT 'received' AS counter, relay AS label, {N} AS n FROM checked WHERE relay IS NOT NULL GROUP BY relay
  UNION ALL SELECT 'rejected', reason, count(*) FROM checked WHERE reason IS NOT NULL GROUP BY reason""")
answer("page_verdicts", """
  SELECT page_id, normalized_url, domain,
    CASE WHEN normalized_url IS NULL THEN NULL WHEN v.domain IS NULL THEN 'clean' ELSE 'matched' END AS status,
    CASE WHEN normalized_url IS NOT NULL THEN coalesce(v.blacklisted, false) END AS blacklisted,
    coalesce(v.categories, '') AS categories,
    CASE WHEN normalized_url IS NULL THEN 'invalid' WHEN v.blacklisted THEN 'blocked' WHEN v.domain IS NOT NULL THEN 'listed' ELSE 'clean' END AS verdict
  FROM pu LEFT JOIN domain_answer v USING (domain)""")
