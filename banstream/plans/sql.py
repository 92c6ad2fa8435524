"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from banstream.operators.patterns import expand_host, host_group_index
from banstream.plans.lines import CUTS, END, NOW, QUIET, sample
from banstream.sources.catalog import FILTERS

SSHD = FILTERS["sshd"].patterns


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def host(pattern: str, line: str = "line") -> str:
    """The host of a line by a pattern; NULL without one. Addresses of the log are all plain IPv4."""
    return f"nullif(regexp_extract({line}, {text(expand_host(pattern, 're2'))}, {host_group_index(pattern)}), '')"


def samples() -> str:
    """Lines by the catalog's patterns in turn, every other time round without an address."""
    made = [sample(p, "\ue000") for f in FILTERS.values() for p in f.patterns]
    texts = ", ".join(f"({i}, {text(t)})" for i, t in enumerate(made))
    return f"""texts(i, t) AS (VALUES {texts}),
lines AS (SELECT event_id AS seq, replace(t, '\ue000', CASE WHEN event_id // {len(made)} % 2 = 0 THEN '203.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) ELSE 'nowhere' END) AS line
  FROM events JOIN texts ON i = event_id % {len(made)})"""


def lines(prefix: str = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ web1 ')") -> str:
    return f"""lines AS (SELECT 'auth.log' AS source, event_id AS seq, date_trunc('second', ts) AS stamp, {prefix} || CASE event_type
    WHEN 'error' THEN 'sshd[' || event_id || ']: Failed password for user' || user_id || ' from ' || ip || ' port ' || port || ' ssh2'
    WHEN 'click' THEN 'sshd[' || event_id || ']: Invalid user u' || user_id || ' from ' || ip || ' port ' || port
    WHEN 'signup' THEN 'sshd[' || event_id || ']: Connection closed by authenticating user root ' || ip || ' port ' || port || ' [preauth]'
    WHEN 'view' THEN 'sshd[' || event_id || ']: Accepted publickey for user' || user_id || ' from ' || ip || ' port 22 ssh2'
    ELSE 'CRON[' || event_id || ']: pam_unix(cron:session): session opened for user root from ' || ip END AS line
  FROM (SELECT *, '203.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip, 1024 + event_id % 60000 AS port FROM events))"""


FAILURES = f"""{lines()},
found AS (SELECT seq, epoch(strptime(substr(line, 1, 19), '%Y-%m-%dT%H:%M:%S'))::BIGINT AS ts, {host(SSHD[0])} AS h0, {host(SSHD[1])} AS h1, {host(SSHD[2])} AS h2, {host(SSHD[3])} AS h3 FROM lines),
failures AS (SELECT 'sshd' AS jail, coalesce(h0, h1) AS ip, ts, seq, CASE WHEN h0 IS NULL THEN 1 ELSE 0 END::INT AS pattern_idx FROM found WHERE coalesce(h0, h1) IS NOT NULL
  UNION ALL SELECT 'sshd-closed', coalesce(h2, h3), ts, seq, CASE WHEN h2 IS NULL THEN 1 ELSE 0 END::INT FROM found WHERE coalesce(h2, h3) IS NOT NULL)"""


def number(ip: str) -> str:
    """A plain IPv4 address as a number, of all its octets."""
    return "(" + " + ".join(f"split_part({ip}, '.', {i})::BIGINT * {256 ** (4 - i)}" for i in range(1, 5)) + ")"


BANS = f"""{FAILURES},
bans AS (SELECT ip, jail, ts AS banned_at, CASE WHEN seq % 11 <> 0 THEN ts + 3600 * (1 + seq % 100) END AS expires_at FROM failures WHERE seq % 3 = 0)"""
ACTIONS = f"""{BANS},
actions AS (SELECT 'ban' AS action, ip, jail, banned_at AS stamp, expires_at, expires_at - banned_at AS ban_time FROM bans
  UNION ALL SELECT 'unban', ip, jail, expires_at, NULL, NULL FROM bans WHERE expires_at <= {NOW})"""
JAILS = "jails(jail) AS (VALUES ('sshd'), ('sshd-closed'), ('nginx'))"
HITS = f"""{FAILURES},
hits AS (SELECT *, coalesce(ts - lag(ts, 2) OVER (PARTITION BY jail, ip ORDER BY ts, seq) <= 86400, false) AS hit FROM failures),
judged AS (SELECT jail, ip, count(*) AS failures, bool_or(hit) AS would_ban, min(CASE WHEN hit THEN ts END) AS first_hit_ts FROM hits GROUP BY jail, ip)"""
NETWORKS = f"""nets AS (SELECT *, split_part(cidr, '/', 2)::INT AS prefix, {number("split_part(cidr, '/', 1)")} AS base FROM (
  SELECT '203.0.' || (n_nationkey // 8) || '.' || (n_nationkey % 8 * 32) || '/' || (29 - n_nationkey % 3) AS cidr, (64500 + n_nationkey)::INT AS asn, 'Net ' || n_name AS org, n_name AS country FROM nation
  UNION ALL VALUES ('203.0.0.0/16', 64400, NULL, 'WIDE'), ('203.0.4.0/22', 64401, 'Middle', NULL))),
ranges AS (SELECT *, base - base % (1::BIGINT << (32 - prefix)) AS lo, base - base % (1::BIGINT << (32 - prefix)) + (1::BIGINT << (32 - prefix)) - 1 AS hi FROM nets)"""
ADDRESS = number("ip")
CUSTOMER_JAILS = """old AS (SELECT 'jail-' || c_custkey AS jail, CASE WHEN c_custkey % 1000 = 0 THEN 'iptables' ELSE 'nftables' END AS backend FROM customer WHERE c_custkey % 7 <> 1),
new AS (SELECT 'jail-' || c_custkey AS jail, CASE WHEN c_custkey % 5 = 0 THEN 'iptables' ELSE 'nftables' END AS backend, c_custkey % 4 <> 0 AS reban FROM customer WHERE c_custkey % 7 <> 0),
delta AS (SELECT coalesce(o.jail, n.jail) AS jail, unnest(CASE WHEN o.jail IS NULL THEN ['added'] WHEN n.jail IS NULL THEN ['removed'] WHEN o.backend = n.backend THEN ['kept'] ELSE ['removed', 'added'] END) AS change
  FROM old o FULL JOIN new n ON o.jail = n.jail)"""
CUSTOMER_BANS = f"""bans AS (SELECT '203.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip, 'jail-' || (event_id % 2000) AS jail, {NOW}::BIGINT AS banned_at,
  CASE WHEN event_id % 3 <> 0 THEN {NOW} + event_id % 100 - 20 END::BIGINT AS expires_at FROM events)"""
V4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"

# one row a step for each address: rings, bans (until, 0 for none) and the count move on with the address's next failure
STEPS = f"""WITH RECURSIVE {FAILURES},
ev AS (SELECT ip, jail, ts, seq, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS rn FROM failures),
st AS (
  SELECT ip, 0::BIGINT AS rn, []::BIGINT[] AS r1, []::BIGINT[] AS r2, 0::BIGINT AS u1, 0::BIGINT AS u2, 0::INT AS cnt, 0::BIGINT AS lst, NULL::VARCHAR AS jail, NULL::BIGINT AS banned_at, NULL::BIGINT AS expires_at, NULL::INT AS level
  FROM (SELECT DISTINCT ip FROM ev)
  UNION ALL
  SELECT ip, rn, CASE WHEN one THEN CASE WHEN hit THEN []::BIGINT[] ELSE ring END ELSE r1 END, CASE WHEN one THEN r2 ELSE CASE WHEN hit THEN []::BIGINT[] ELSE ring END END,
         CASE WHEN hit AND one THEN ts + secs ELSE u1 END, CASE WHEN hit AND NOT one THEN ts + secs ELSE u2 END, CASE WHEN hit THEN cnt + 1 ELSE cnt END::INT, CASE WHEN hit THEN ts ELSE lst END,
         CASE WHEN hit THEN jail END, CASE WHEN hit THEN ts END, CASE WHEN hit THEN ts + secs END, CASE WHEN hit THEN cnt END::INT
  FROM (SELECT *, NOT banned AND len(ring) = 3 AND ring[3] - ring[1] <= 86400 AS hit, least(43200 * (1::BIGINT << least(cnt, 20)), 604800)::BIGINT AS secs
    FROM (SELECT *, CASE WHEN banned THEN own ELSE list_append(own, ts)[-3:] END AS ring
      FROM (SELECT *, CASE WHEN one THEN u1 > 0 ELSE u2 > 0 END AS banned, CASE WHEN one THEN r1 ELSE r2 END AS own
        FROM (SELECT st.ip, ev.rn, ev.ts, ev.jail, ev.jail = 'sshd' AS one, r1, r2, CASE WHEN u1 > ev.ts THEN u1 ELSE 0 END AS u1, CASE WHEN u2 > ev.ts THEN u2 ELSE 0 END AS u2,
                CASE WHEN lst < ev.ts - 2592000 THEN 0 ELSE cnt END AS cnt, lst
              FROM st JOIN ev ON ev.ip = st.ip AND ev.rn = st.rn + 1))))
)"""
TIMELINE = f"{STEPS} SELECT ip, jail, banned_at, expires_at, level FROM st WHERE banned_at IS NOT NULL"


def all_actions(until: str) -> str:
    """Bans, and the unbans of those that end by a time, with counts forgotten after the short quiet time."""
    steps = STEPS.replace("ev.ts - 2592000", f"ev.ts - {QUIET}")
    return f"""{steps}, b AS (SELECT st.ip, st.jail, banned_at, expires_at, level, ev.seq FROM st JOIN ev ON ev.ip = st.ip AND ev.rn = st.rn WHERE banned_at IS NOT NULL)
SELECT ip, jail, 'ban' AS action, banned_at AS at, expires_at, expires_at - banned_at AS ban_time, 'threshold' AS reason, level, seq FROM b
UNION ALL SELECT ip, jail, 'unban', expires_at, NULL, NULL, 'expired', NULL, NULL FROM b WHERE expires_at <= {until}"""


# as STEPS, with commands; e1 and e2 are the ends of bans that an event finds over
COMMANDS = f"""WITH RECURSIVE {FAILURES},
given AS (SELECT '203.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS ip, epoch(date_trunc('second', ts))::BIGINT AS ts, event_id AS n FROM events WHERE event_type = 'view'),
ev AS (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY ts, seq) AS rn, jail = 'sshd' AS one, jail IN ('sshd', 'sshd-closed') AS known FROM (
  SELECT 'failure' AS kind, ip, jail, NULL::BIGINT AS bt, ts, seq FROM failures
  UNION ALL SELECT CASE WHEN n % 10 = 9 THEN 'ban' WHEN n % 3 = 0 THEN 'unban' WHEN n % 3 = 1 THEN 'ban' ELSE 'apply_failed' END, ip, CASE WHEN n % 10 = 9 THEN 'nowhere' WHEN n % 4 = 0 THEN 'sshd-closed' ELSE 'sshd' END,
    CASE WHEN n % 2 = 0 THEN 7200 END, ts, n FROM given)),
st AS (
  SELECT ip, 0::BIGINT AS rn, []::BIGINT[] AS r1, []::BIGINT[] AS r2, 0::BIGINT AS u1, 0::BIGINT AS u2, 0::INT AS cnt, 0::BIGINT AS lst, NULL::BIGINT AS e1, NULL::BIGINT AS e2,
         NULL::VARCHAR AS jail, NULL::VARCHAR AS action, NULL::BIGINT AS stamp, NULL::BIGINT AS expires_at, NULL::BIGINT AS ban_time, NULL::VARCHAR AS reason, NULL::INT AS level, NULL::BIGINT AS seq
  FROM (SELECT DISTINCT ip FROM ev)
  UNION ALL
  SELECT ip, rn, CASE WHEN NOT one THEN r1 WHEN banning THEN []::BIGINT[] ELSE ring END, CASE WHEN one OR NOT known THEN r2 WHEN banning THEN []::BIGINT[] ELSE ring END,
         CASE WHEN one AND banning THEN ts + secs WHEN one AND lifting THEN 0 ELSE u1 END, CASE WHEN known AND NOT one AND banning THEN ts + secs WHEN known AND NOT one AND lifting THEN 0 ELSE u2 END,
         (cnt + hit::INT)::INT, CASE WHEN hit THEN ts ELSE lst END, e1, e2, jail,
         CASE WHEN banning THEN 'ban' WHEN lifting AND kind = 'unban' THEN 'unban' WHEN lifting THEN 'rollback' WHEN kind IN ('ban', 'unban') THEN 'error' END, ts, CASE WHEN banning THEN ts + secs END, CASE WHEN banning THEN secs END,
         CASE WHEN hit THEN 'threshold' WHEN banning OR (lifting AND kind = 'unban') THEN 'manual' WHEN lifting THEN 'firewall_ban_failed' WHEN NOT known THEN 'unknown_jail' WHEN kind = 'ban' THEN 'already_banned' ELSE 'not_banned' END,
         CASE WHEN hit THEN cnt END::INT, seq
  FROM (SELECT *, hit OR (kind = 'ban' AND known AND NOT banned) AS banning, banned AND kind IN ('unban', 'apply_failed') AS lifting,
               CASE WHEN hit THEN least(43200 * (1::BIGINT << least(cnt, 20)), 604800) ELSE coalesce(bt, 43200) END::BIGINT AS secs
    FROM (SELECT *, kind = 'failure' AND NOT banned AND len(ring) = 3 AND ring[3] - ring[1] <= 86400 AS hit
      FROM (SELECT *, CASE WHEN kind = 'failure' AND NOT banned THEN list_append(own, ts)[-3:] ELSE own END AS ring
        FROM (SELECT *, known AND CASE WHEN one THEN u1 > 0 ELSE u2 > 0 END AS banned, CASE WHEN one THEN r1 ELSE r2 END AS own
          FROM (SELECT st.ip, ev.rn, ev.kind, ev.jail, ev.bt, ev.ts, ev.seq, one, known, r1, r2, CASE WHEN u1 > ev.ts THEN u1 ELSE 0 END AS u1, CASE WHEN u2 > ev.ts THEN u2 ELSE 0 END AS u2,
                  CASE WHEN u1 > 0 AND u1 <= ev.ts THEN u1 END AS e1, CASE WHEN u2 > 0 AND u2 <= ev.ts THEN u2 END AS e2, CASE WHEN lst < ev.ts - {QUIET} THEN 0 ELSE cnt END AS cnt, lst
                FROM st JOIN ev ON ev.ip = st.ip AND ev.rn = st.rn + 1)))))
),
closing AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY ip ORDER BY rn DESC) = 1),
over AS (SELECT ip, 'sshd' AS jail, e1 AS stamp FROM st WHERE e1 IS NOT NULL UNION ALL SELECT ip, 'sshd-closed', e2 FROM st WHERE e2 IS NOT NULL
  UNION ALL SELECT ip, 'sshd', u1 FROM closing WHERE u1 BETWEEN 1 AND {END} UNION ALL SELECT ip, 'sshd-closed', u2 FROM closing WHERE u2 BETWEEN 1 AND {END})
SELECT ip, jail, action, stamp AS at, expires_at, ban_time, reason, level, seq FROM st WHERE action IS NOT NULL
UNION ALL SELECT ip, jail, 'unban', stamp, NULL, NULL, 'expired', NULL, NULL FROM over"""

# what a tracker holds after each of three parts of the log, of which the next begins at a cut
LIVE = f"""{STEPS},
w AS (SELECT batch, max(ts) AS w FROM failures JOIN (VALUES (0, {CUTS[0]}), (1, {CUTS[1]}), (2, {END})) c(batch, cut) ON ts < cut GROUP BY batch),
b AS (SELECT batch, w, ip, jail, banned_at, expires_at FROM w JOIN st ON banned_at <= w),
j AS (SELECT * FROM w, (VALUES ('sshd'), ('sshd-closed'), ('nginx')) j(jail))"""
# failures in three parts that each go over all dates; late ones are ten days behind the newest of the parts before
ARRIVED = f"""{FAILURES},
parts AS (SELECT seq % 3 AS batch, max(ts) AS newest FROM failures GROUP BY 1),
arrived AS (SELECT f.*, coalesce(ts < (SELECT max(newest) FROM parts p WHERE p.batch < f.seq % 3) - 864000, false) AS late FROM failures f)"""

_ANY = "coalesce(" + ", ".join(host(p) for p in SSHD) + ")"
_IDX = "CASE " + " ".join(f"WHEN {host(p)} IS NOT NULL THEN {i}" for i, p in enumerate(SSHD)) + " END::INT"
_HEX = "lpad(lower(concat(" + ", ".join(f"lpad(to_hex(split_part(ip, '.', {i})::INT), 2, '0')" for i in range(1, 5)) + ")), 32, '0')"
_COUNTS = "counts AS (SELECT ip, count(*)::INT AS count, max(banned_at) AS last_ban FROM bans GROUP BY ip)"
_ESCAPED = "'\"' || replace(replace(replace({0}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"'"


def _logfmt(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({c}, '^$|[ \"\\n=]') THEN {_ESCAPED.format(c)} ELSE {c} END, 'null')"


SQL: dict[str, str] = {
    "match_sshd": f"WITH {lines()}, m AS (SELECT seq, {_ANY} AS ip, {_IDX} AS pattern_idx FROM lines) SELECT seq, ip, 4::TINYINT AS ip_family, {_HEX} AS ip_hex, pattern_idx FROM m WHERE ip IS NOT NULL",
    "match_positional": f"WITH {lines()} SELECT seq, {_ANY} AS ip, {_IDX} AS pattern_idx FROM lines WHERE {_ANY} IS NOT NULL",
    "match_all_jails": f"WITH {FAILURES} SELECT jail, seq, ip, pattern_idx FROM failures",
    "match_dynamic": f"WITH {lines()} SELECT seq, {_ANY} AS ip, {_IDX} AS pattern_idx FROM lines WHERE {_ANY} IS NOT NULL",
    "match_rule_table": f"""WITH {lines()}, m AS (SELECT seq, {host(SSHD[2])} AS h2, {host(SSHD[3])} AS h3, regexp_extract(line, ' from ([0-9.]+)', 1) AS ip, regexp_extract(line, ': Failed password for user([0-9]+) from ', 1) AS failed,
        regexp_extract(line, 'user[0-9]*([0-9]) from ', 1) AS digit FROM lines), u AS (SELECT DISTINCT user_id AS u FROM events),
      loose AS (SELECT (u % 10)::VARCHAR AS digit, min(u) + 100 AS idx FROM u WHERE u % 10 = 0 GROUP BY 1)
      SELECT seq, coalesce(h2, h3, ip) AS ip, CASE WHEN h2 IS NOT NULL THEN 0 WHEN h3 IS NOT NULL THEN 1 ELSE least(idx, CASE WHEN failed <> '' AND failed::BIGINT % 10 <> 0 THEN failed::BIGINT + 100 END) END::INT AS pattern_idx
      FROM m LEFT JOIN loose USING (digit) WHERE coalesce(h2, h3) IS NOT NULL OR idx IS NOT NULL OR (failed <> '' AND failed::BIGINT % 10 <> 0)""",
    "log_line_numbers": "SELECT (event_id % 4)::INT AS part, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id * 7919 % 10007, event_id) - 1 AS seq, event_id FROM events",
    "dry_run_offenders": f"""WITH {HITS.replace("PARTITION BY jail, ip ORDER BY ts, seq", "PARTITION BY jail, ip ORDER BY seq % 4, seq * 7919 % 10007, seq")} SELECT jail, ip, failures,
      CASE WHEN would_ban THEN 'WOULD BAN' WHEN failures < 3 THEN (3 - failures) || ' more to ban' ELSE 'spread beyond 86400s window' END AS verdict FROM judged ORDER BY failures DESC, jail, ip""",
    "route_lines": f"WITH {lines()} SELECT jail, count(*) AS lines, min(seq) AS first_seq FROM lines, (VALUES ('sshd'), ('sshd-closed')) j(jail) GROUP BY jail",
    "ignore_lines": f"WITH {lines()} SELECT seq, line FROM lines WHERE NOT regexp_matches(line, 'user\\d*7 ') AND NOT regexp_matches(line, 'Accepted \\w+ for')",
    "bounded_lines": "SELECT doc_id, strlen(text)::INT AS bytes FROM documents WHERE strlen(text) <= 2000",
    "trim_lines": "SELECT conv_id, turn, length(regexp_replace(text || ' ' || chr(9) || ' ', '\\s+$', ''))::INT AS chars FROM conversations WHERE regexp_replace(text, '\\s+$', '') <> ''",
    "prefilter_lines": f"WITH {lines()} SELECT seq FROM lines WHERE contains(line, ': Failed password for ') OR contains(line, ': Invalid user ')",
    "pattern_hits": f"WITH {lines()} " + " UNION ALL ".join(f"SELECT {i} AS pattern_idx, count({host(p)}) AS hits FROM lines" for i, p in enumerate(SSHD)),
    "filter_catalog": f"WITH {lines()} "
    + " UNION ALL ".join(f"SELECT {text(f.name)} AS filter, {len(f.patterns)}::BIGINT AS patterns, ({' + '.join(f'count({host(p)})' for p in f.patterns)})::BIGINT AS hits FROM lines" for f in FILTERS.values()),
    "filter_samples": f"WITH {samples()} "
    + " UNION ALL ".join(f"SELECT {text(f.name)} AS filter, ({' + '.join(f'count(*) FILTER (regexp_matches({host(p)}, {text(V4)}))' for p in f.patterns)})::BIGINT AS hits FROM lines" for f in FILTERS.values()),
    "ts_iso": f"WITH {lines()} SELECT seq, epoch(stamp)::BIGINT AS ts FROM lines",
    "ts_common": f"WITH {lines()} SELECT seq, epoch(stamp)::BIGINT - 7200 AS ts FROM lines",
    "ts_epoch": f"WITH {lines()} SELECT seq, epoch(stamp)::BIGINT AS ts FROM lines",
    "ts_syslog": f"WITH {lines()} SELECT seq, epoch(CASE WHEN epoch(stamp) > 1705363200 + 86400 THEN stamp - INTERVAL 1 YEAR ELSE stamp END)::BIGINT AS ts FROM lines",
    "durations": "SELECT event_id, user_id * [1, 1, 60, 3600, 86400, 604800, NULL, 60][event_id % 8 + 1] AS seconds FROM events",
    "ip_v4_parse": f"""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '10.' || ((event_id // 4) % 300) || '.' || (event_id % 256) || '.1' WHEN 1 THEN '10.0' || (event_id % 10) || '.3.4'
        WHEN 2 THEN '10.1.' || (event_id % 256) || '.' || (event_id % 300) WHEN 3 THEN '10.1.2.' || (event_id % 256) ELSE '192.168.' || (event_id % 256) || '.' || ((event_id // 256) % 256) END AS token FROM events),
      p AS (SELECT event_id, CASE WHEN regexp_matches(token, '{V4}') THEN token WHEN event_id % 5 = 2 THEN '::ffff' END AS without_port FROM t), q AS (SELECT *, CASE WHEN event_id % 5 <> 3 AND without_port <> '::ffff' THEN without_port END AS ip FROM p)
      SELECT event_id, ip, CASE WHEN ip IS NOT NULL THEN {_HEX} END AS ip_hex, without_port FROM q""",
    "ip_in_net": f"WITH {FAILURES} SELECT seq, {ADDRESS} BETWEEN {number("'203.0.0.64'")} AND {number("'203.0.0.127'")} AS inside FROM failures",
    "drop_allowlisted": f"WITH {FAILURES} SELECT jail, ip, ts, seq FROM failures WHERE NOT ({ADDRESS} BETWEEN {number("'203.0.0.0'")} AND {number("'203.0.0.63'")} OR {ADDRESS} BETWEEN {number("'203.0.1.16'")} AND {number("'203.0.1.23'")} OR {ADDRESS} = {number("'203.0.5.7'")})",
    "allowlist_anti_join": f"WITH {FAILURES}, {NETWORKS} SELECT jail, ip, ts, seq FROM failures WHERE NOT EXISTS (SELECT 1 FROM ranges WHERE asn > 64400 AND {ADDRESS} BETWEEN lo AND hi)",
    "geo_enrich": f"WITH {BANS}, {NETWORKS}, a AS (SELECT ip, arg_max(struct_pack(asn := asn, country := country), prefix) AS n FROM (SELECT DISTINCT ip FROM bans), ranges WHERE {ADDRESS} BETWEEN lo AND hi GROUP BY ip) SELECT ip, jail, banned_at, n.asn AS asn, n.country AS country FROM bans LEFT JOIN a USING (ip)",
    "asn_label": f"WITH {BANS}, {NETWORKS}, a AS (SELECT ip, arg_max(struct_pack(asn := asn, org := org), prefix) AS n FROM (SELECT DISTINCT ip FROM bans), ranges WHERE {ADDRESS} BETWEEN lo AND hi GROUP BY ip) SELECT ip, 'AS' || n.asn || coalesce(' (' || n.org || ')', '') AS label FROM (SELECT DISTINCT ip FROM bans) LEFT JOIN a USING (ip)",
    "failure_counts": f"WITH {FAILURES} SELECT jail, ip, count(*) AS failures FROM failures GROUP BY jail, ip",
    "threshold_hits": f"WITH {HITS} SELECT jail, ip, ts, seq, hit FROM hits",
    "would_ban": f"WITH {HITS} SELECT * FROM judged",
    "rolling_failures": f"WITH {FAILURES} SELECT jail, ip, seq, count(*) OVER (PARTITION BY jail, ip ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM failures",
    "dry_run_summary": f"WITH {HITS} SELECT jail, 2 AS patterns, 3 AS max_retry, 86400::BIGINT AS find_time, 43200::BIGINT AS ban_time, sum(failures)::BIGINT AS matches, count(*) AS unique_ips, count(*) FILTER (would_ban) AS would_ban FROM judged GROUP BY jail",
    "top_offenders": f"WITH {HITS} SELECT jail, ip, failures, CASE WHEN would_ban THEN 'WOULD BAN' WHEN failures < 3 THEN (3 - failures) || ' more to ban' ELSE 'spread beyond 86400s window' END AS verdict FROM judged ORDER BY failures DESC, jail, ip",
    "stale_failures": f"WITH {FAILURES} SELECT jail, ip, max(ts) AS newest FROM failures GROUP BY jail, ip HAVING max(ts) >= {NOW} - 86400",
    "suppress_banned": f"WITH {BANS} SELECT jail, ip, ts, seq FROM failures f WHERE NOT EXISTS (SELECT 1 FROM bans b WHERE b.ip = f.ip AND b.jail = f.jail AND banned_at <= ts AND (expires_at IS NULL OR ts < expires_at))",
    "label_banned": f"WITH {BANS}, l AS (SELECT jail, ip, EXISTS (SELECT 1 FROM bans b WHERE b.ip = f.ip AND b.jail = f.jail AND banned_at <= ts AND (expires_at IS NULL OR ts < expires_at)) AS banned FROM failures f) SELECT jail, ip, banned, count(*) AS failures FROM l GROUP BY ALL",
    "failure_params": f"WITH {FAILURES} SELECT jail, CASE WHEN jail = 'sshd' THEN 3 END AS max_retry, count(*) AS failures FROM failures GROUP BY jail",
    "failure_rate_window": f"WITH {FAILURES} SELECT jail, ts - ts % 21600 AS window_start, count(*) AS failures FROM failures GROUP BY ALL",
    "calc_ban_time": """WITH p AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE 60 + event_id % 5000 END AS base, event_id % 30 AS n, CASE WHEN event_id % 3 = 0 THEN [1.0, 5.0, 30.0][least(event_id % 30, 2) + 1] ELSE 2.0 ** least(event_id % 30, 20) END AS times,
        1.0::DOUBLE + (event_id % 5) / 2::DOUBLE AS factor, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 604800 END AS cap FROM events),
      b AS (SELECT event_id, CASE WHEN event_id % 4 = 0 OR base < 0 THEN base WHEN cap > 0 THEN least(trunc(base * times * factor)::BIGINT, cap) ELSE trunc(base * times * factor)::BIGINT END::BIGINT AS ban_time FROM p)
      SELECT event_id, ban_time, CASE WHEN ban_time >= 0 THEN event_id + ban_time END AS expires_at FROM b""",
    "ban_timeline_bans": TIMELINE,
    "track_bans_stream": TIMELINE,
    "ban_timeline_actions": all_actions(str(END)),
    "ban_timeline_commands": COMMANDS,
    "track_actions_stream": all_actions("(SELECT max(ts) FROM failures)"),
    "live_bans_stream": f"{LIVE} SELECT batch, ip, jail, banned_at, expires_at FROM b WHERE expires_at > w",
    "live_rings_stream": f"""{LIVE}, s AS (SELECT batch, w, st.ip, r1[-1] AS n1, r2[-1] AS n2 FROM w JOIN ev ON ev.ts <= w JOIN st ON st.ip = ev.ip AND st.rn = ev.rn QUALIFY row_number() OVER (PARTITION BY batch, st.ip ORDER BY st.rn DESC) = 1)
      SELECT batch, ip, 'sshd' AS jail, n1 AS newest FROM s WHERE n1 >= w - 86400 UNION ALL SELECT batch, ip, 'sshd-closed', n2 FROM s WHERE n2 >= w - 86400""",
    "live_stats_stream": f"""{LIVE} SELECT batch, jail, (SELECT count(*) FROM b WHERE b.batch = j.batch AND b.jail = j.jail AND expires_at > w) AS active_bans, (SELECT count(*) FROM b WHERE b.batch = j.batch AND b.jail = j.jail) AS total_bans,
      (SELECT count(*) FROM b WHERE b.batch = j.batch AND b.jail = j.jail AND expires_at <= w) AS total_unbans, (SELECT count(*) FROM failures f WHERE f.jail = j.jail AND ts <= j.w) AS total_failures FROM j""",
    "late_rows_stream": f"WITH {ARRIVED} SELECT jail, ip, ts, seq FROM arrived WHERE late",
    "late_totals_stream": f"WITH {ARRIVED} SELECT jail, count(*) FILTER (NOT late) AS in_time, count(*) FILTER (late) AS late FROM arrived GROUP BY jail",
    "stream_totals": f"{LIVE} SELECT (SELECT count(*) FROM failures) AS read, count(*) AS bans, count(*) FILTER (expires_at <= w) AS unbans, 0::BIGINT AS late FROM b WHERE batch = 2",
    "escalation_level": f"""WITH {BANS}, g AS (SELECT *, CASE WHEN banned_at - lag(banned_at) OVER (PARTITION BY ip ORDER BY banned_at, jail) > 259200 THEN 1 ELSE 0 END AS new FROM bans),
      i AS (SELECT *, sum(new) OVER (PARTITION BY ip ORDER BY banned_at, jail ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT ip, jail, banned_at, row_number() OVER (PARTITION BY ip, island ORDER BY banned_at, jail) - 1 AS level FROM i""",
    "latest_ban": f"WITH {BANS} SELECT ip, jail, max(banned_at) AS banned_at, arg_max_null(expires_at, banned_at) AS expires_at FROM bans GROUP BY ip, jail",
    "ban_counts": f"WITH {BANS}, {_COUNTS} SELECT * FROM counts",
    "decayed_counts": f"WITH {BANS}, {_COUNTS} SELECT * FROM counts WHERE last_ban < {NOW} + 5 * 86400 - 3 * 86400",
    "active_bans": f"WITH {BANS} SELECT * FROM bans WHERE expires_at IS NULL OR expires_at > {NOW}",
    "expired_bans": f"WITH {BANS} SELECT * FROM bans WHERE expires_at <= {NOW}",
    "list_bans": f"""WITH {BANS}, s AS (SELECT *, expires_at - {NOW} AS secs FROM bans) SELECT jail, ip, banned_at, expires_at, strftime(to_timestamp(banned_at) AT TIME ZONE 'UTC', '%d %b %H:%M') AS banned,
      CASE WHEN secs IS NULL THEN 'permanent' WHEN secs <= 0 THEN 'expired' WHEN secs < 3600 THEN (secs // 60) || 'm remaining' ELSE (secs // 3600) || 'h ' || (secs % 3600 // 60) || 'm remaining' END AS expires FROM s ORDER BY expires_at NULLS LAST, jail, ip""",
    "next_expiry": f"WITH {BANS} SELECT min(expires_at) AS next_expiry FROM bans WHERE expires_at IS NULL OR expires_at > {NOW}",
    "jail_stats": f"""WITH {BANS}, {JAILS} SELECT jail, (SELECT count(*) FROM bans b WHERE b.jail = jails.jail AND (expires_at IS NULL OR expires_at > {NOW})) AS active_bans,
      (SELECT count(*) FROM bans b WHERE b.jail = jails.jail) AS total_bans, (SELECT count(*) FROM failures f WHERE f.jail = jails.jail) AS total_failures FROM jails""",
    "global_stats": f"""WITH {ACTIONS} SELECT 1000::BIGINT AS uptime_secs, (SELECT count(*) FROM bans WHERE expires_at IS NULL OR expires_at > {NOW}) AS active_bans, (SELECT count(*) FROM bans) AS total_bans,
      (SELECT count(*) FROM actions WHERE action = 'unban') AS total_unbans, (SELECT count(*) FROM failures) AS total_failures""",
    "reconcile": f"WITH {BANS}, o AS (SELECT ip, jail FROM bans WHERE ip NOT LIKE '%7') SELECT * FROM bans e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ip = e.ip AND o.jail = e.jail) ORDER BY banned_at, ip, jail, expires_at LIMIT 1000",
    "reconcile_all": f"WITH {BANS}, o AS (SELECT ip, jail FROM bans WHERE ip NOT LIKE '%7') SELECT * FROM bans e WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ip = e.ip AND o.jail = e.jail)",
    "diff_jails": f"WITH {CUSTOMER_JAILS} SELECT * FROM delta",
    "restorable_bans": f"WITH {CUSTOMER_JAILS}, {CUSTOMER_BANS} SELECT * FROM bans WHERE (expires_at IS NULL OR expires_at > {NOW}) AND jail IN (SELECT jail FROM new WHERE reban)",
    "restore_for_added": f"WITH {CUSTOMER_JAILS}, {CUSTOMER_BANS} SELECT * FROM bans WHERE jail IN (SELECT jail FROM delta WHERE change = 'added')",
    "bans_jsonl": f"""WITH {BANS} SELECT '{{"jail":"' || jail || '","ip":"' || ip || '","banned_at":' || banned_at || ',"expires_at":' || coalesce(expires_at::VARCHAR, 'null') || '}}' AS value FROM bans""",
    "notifications": f"""WITH {ACTIONS} SELECT 'https://hooks.example.com/sshd' AS url, '{{"event":"' || action || '","ip":"' || ip || '","jail":"' || jail || '",' || CASE WHEN ban_time IS NULL THEN '' ELSE '"ban_time":' || ban_time || ',' END
      || '"timestamp":"' || strftime(to_timestamp(stamp) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00"}}' AS body FROM actions WHERE jail = 'sshd'""",
    "logfmt_events": f"SELECT 'event seen event_id=' || event_id || ' event_type=' || {_logfmt('event_type')} || ' props=' || {_logfmt('p')} AS line FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN props END AS p FROM events)",
    "severities": "SELECT [3, 4, 5, 6, 7, NULL][event_id % 6 + 1] AS severity, count(*) AS n FROM events GROUP BY 1",
    "render_actions": f"WITH {FAILURES} SELECT seq, jail, CASE WHEN seq % 5 <> 0 THEN 'block ' || ip || ' in ' || jail END AS command FROM failures",
    "set_elements": f"WITH {BANS} SELECT ip, jail, banned_at, '{{ ' || ip || CASE WHEN expires_at IS NULL THEN '' ELSE ' timeout ' || greatest(expires_at - {NOW}, 1) || 's' END || ' }}' AS element FROM bans",
}
