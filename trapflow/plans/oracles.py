"""SQL that must give the same rows as the queries over the trap tables, in another engine."""

from __future__ import annotations

#: source_ip -> source: the canonical address of every notation in the table.
ADDRESSES = r"""
raw_addr AS (SELECT DISTINCT source_ip, regexp_replace(lower(regexp_replace(source_ip, '^\s+|\s+$', '', 'g')), '^\[|\]$|%.*$', '', 'g') AS s FROM trap_event WHERE source_ip IS NOT NULL),
tail_addr AS (SELECT source_ip, s, regexp_extract(s, '([0-9]{1,3}(\.[0-9]{1,3}){3})$', 1) AS t FROM raw_addr),
quad_addr AS (SELECT source_ip, s, t, list_transform(string_split(t, '.'), lambda x: try_cast(x AS INT)) AS q FROM tail_addr),
hex_addr AS (SELECT source_ip, s, t, q, CASE WHEN t = '' THEN s ELSE left(s, length(s) - length(t)) || printf('%x', q[1] * 256 + q[2]) || ':' || printf('%x', q[3] * 256 + q[4]) END AS h FROM quad_addr),
half_addr AS (SELECT *, string_split(h, '::') AS p FROM hex_addr),
side_addr AS (SELECT *, CASE WHEN p[1] = '' THEN []::VARCHAR[] ELSE string_split(p[1], ':') END AS l, CASE WHEN len(p) < 2 OR p[2] = '' THEN []::VARCHAR[] ELSE string_split(p[2], ':') END AS r FROM half_addr),
full_addr AS (SELECT *, CASE WHEN len(p) = 1 THEN l WHEN len(p) = 2 AND len(l) + len(r) < 8 THEN l || list_transform(range(8 - len(l) - len(r)), lambda x: '0') || r END AS g FROM side_addr),
num_addr AS (SELECT *, CASE WHEN len(g) = 8 AND list_bool_and(list_transform(g, lambda x: regexp_full_match(x, '[0-9a-f]{1,4}'))) THEN list_transform(g, lambda x: try_cast('0x' || x AS INT)) END AS n FROM full_addr),
flag_addr AS (SELECT *, list_transform(n, lambda x: printf('%x', x)) AS hx, array_to_string(list_transform(n, lambda x: CASE WHEN x = 0 THEN 'z' ELSE 'n' END), '') AS f FROM num_addr),
run_addr AS (SELECT *, CASE WHEN contains(f, 'zzzzzzzz') THEN 8 WHEN contains(f, 'zzzzzzz') THEN 7 WHEN contains(f, 'zzzzzz') THEN 6 WHEN contains(f, 'zzzzz') THEN 5 WHEN contains(f, 'zzzz') THEN 4 WHEN contains(f, 'zzz') THEN 3 WHEN contains(f, 'zz') THEN 2 ELSE 0 END AS z FROM flag_addr),
addr AS (SELECT source_ip, CASE
  WHEN s = t THEN CASE WHEN list_bool_and(list_transform(q, lambda x: x <= 255)) THEN array_to_string(q, '.') END
  WHEN n IS NULL OR t <> '' AND NOT list_bool_and(list_transform(q, lambda x: x <= 255)) THEN NULL
  WHEN list_sum(n[1:5]) = 0 AND n[6] = 65535 THEN (n[7] // 256) || '.' || (n[7] % 256) || '.' || (n[8] // 256) || '.' || (n[8] % 256)
  WHEN z = 0 THEN array_to_string(hx, ':')
  ELSE array_to_string(hx[1:strpos(f, repeat('z', z)) - 1], ':') || '::' || array_to_string(hx[strpos(f, repeat('z', z)) + z:8], ':') END AS source FROM run_addr)"""

_S = r"regexp_replace(regexp_replace(trap_oid, '^\s+|\s+$', '', 'g'), '^\.+', '')"
_V1 = r"'v1:\.*([0-9]+(?:\.[0-9]+)*):([0-9]{1,9}):([0-9]+)'"
#: The trap type that trap_oid denotes.
TRAP_TYPE = (
    f"CASE WHEN regexp_full_match({_S}, {_V1}) THEN CASE WHEN regexp_extract({_S}, {_V1}, 2) = '6' THEN regexp_extract({_S}, {_V1}, 1) || '.0.' || regexp_extract({_S}, {_V1}, 3) "
    rf"ELSE '1.3.6.1.6.3.1.1.5.' || (regexp_extract({_S}, {_V1}, 2)::INT + 1) END WHEN regexp_full_match({_S}, '[0-9]+(\.[0-9]+)*') THEN {_S} END"
)
_ROWS = f"{ADDRESSES}, rows_ AS (SELECT e.*, addr.source, epoch_us(received_at) AS us, {TRAP_TYPE} AS kind FROM trap_event e JOIN addr USING (source_ip) WHERE addr.source IS NOT NULL AND received_at IS NOT NULL)"

_SESSIONS = f"""WITH {_ROWS}, gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS opens FROM rows_ WINDOW w AS (PARTITION BY source ORDER BY us, seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY us, seq) AS session FROM gaps)"""
P2_FOUND = _SESSIONS + " SELECT source AS source_ip, min(seq) AS seq_min, max(seq) AS seq_max FROM numbered GROUP BY source, session"
P2_SESSIONS = _SESSIONS + " SELECT source AS source_ip, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM numbered GROUP BY source, session"

_MESSAGES = f"""WITH RECURSIVE {_ROWS}, ids AS (SELECT source, request_id, us, seq FROM rows_ WHERE request_id IS NOT NULL AND request_id <> 0),
lead_(source, request_id, us) AS (SELECT source, request_id, min(us) FROM ids GROUP BY ALL UNION
  SELECT l.source, l.request_id, min(i.us) FROM lead_ l JOIN ids i ON i.source = l.source AND i.request_id = l.request_id AND i.us > l.us + 900000000 GROUP BY l.source, l.request_id, l.us),
placed AS (SELECT i.*, l.us AS anchor FROM ids i JOIN lead_ l ON i.source = l.source AND i.request_id = l.request_id AND i.us BETWEEN l.us AND l.us + 900000000),
kept AS (SELECT *, min(seq) OVER (PARTITION BY source, request_id, anchor) AS seq_kept FROM placed)"""
P3_FOUND = _MESSAGES + " SELECT seq_kept, seq AS seq_extra FROM kept WHERE seq <> seq_kept"
_COUNTED = _MESSAGES + ", counted AS (SELECT * FROM rows_ WHERE kind IS NOT NULL AND seq NOT IN (SELECT seq FROM kept WHERE seq <> seq_kept))"
P1_FOUND = _COUNTED + """
SELECT source AS source_ip, strftime(make_timestamp(us), '%Y-%m') AS month_key, kind AS trap_oid, arg_max(seq, (us, seq)) AS latest_seq FROM counted GROUP BY 1, 2, 3 HAVING count(*) >= 3"""

P1_FEATURES = _COUNTED + """, months AS (SELECT source, strftime(make_timestamp(us), '%Y-%m') AS month_key, kind, count(*) AS n, sum(coalesce(len(varbinds), 0)) AS total, datediff('day', max(make_timestamp(us))::DATE, last_day(max(make_timestamp(us))::DATE)) AS days FROM counted GROUP BY ALL)
SELECT source AS source_ip, month_key, '{' || string_agg('"' || kind || '":{"n":' || n || ',"total":' || printf('%.1f', total::DOUBLE) || ',"days_to_end":' || days || '}', ',' ORDER BY kind) || '}' AS features FROM months GROUP BY ALL"""
P1_WINDOWS = _COUNTED + """, dated AS (SELECT *, datediff('day', make_timestamp(us)::DATE, DATE '2018-01-22') AS age FROM counted WHERE make_timestamp(us)::DATE <= DATE '2018-01-22')
SELECT source AS source_ip, kind AS trap_oid, min(age)::INT AS days_since, arg_max(seq, (us, seq)) AS latest_seq, count(*) FILTER (age < 1) AS d1_n, count(*) FILTER (age < 7) AS d7_n, count(*) FILTER (age < 28) AS d28_n,
coalesce(sum(coalesce(len(varbinds), 0)) FILTER (age < 28), 0)::BIGINT AS d28_total FROM dated GROUP BY ALL"""

_RUNS = f"""WITH {_ROWS}, marked AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER w OR us - lag(us) OVER w > 600000000 THEN 1 ELSE 0 END AS opens FROM rows_ WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY us, seq)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY us, seq) AS run FROM marked)"""
P5_FOUND = _RUNS + " SELECT min(seq) AS seq_min, max(seq) AS seq_max FROM numbered GROUP BY source, run HAVING count(*) >= 3"
P5_RUNS = _RUNS + " SELECT source AS source_ip, any_value(kind) AS trap_oid, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM numbered GROUP BY source, run"

#: Cells with a problem: values are read as the kind of the longest listed OID says.
_CELLS = r"""WITH alias_ AS (SELECT ltrim(oid, '.') AS oid, attr_name, kind, unit FROM oid_alias),
entry AS (SELECT seq, unnest(CASE WHEN len(varbinds) > 0 THEN list_transform(varbinds, lambda v, i: {'oid': v.oid, 'value': v.value, 'i': i}) ELSE list_transform(map_entries(raw_varbind_map), lambda e, i: {'oid': e.key, 'value': e.value, 'i': i}) END) AS e FROM trap_event),
placed AS (SELECT seq, e.i AS i, ltrim(regexp_replace(e.oid, '^\s+|\s+$', '', 'g'), '.') AS oid, regexp_replace(e.value, '^\s+|\s+$', '', 'g') AS v FROM entry),
owned AS (SELECT p.seq, arg_max(a, length(a.oid)) AS a, any_value(p.v) AS v, any_value(p.i) AS i FROM (SELECT *, row_number() OVER () AS rid FROM placed) p JOIN alias_ a ON p.oid = a.oid OR starts_with(p.oid, a.oid || '.') GROUP BY p.seq, p.rid),
bare AS (SELECT seq, i, a.attr_name AS attr_name, a.kind AS kind, v, CASE WHEN a.unit IS NOT NULL AND ends_with(lower(v), lower(a.unit)) THEN rtrim(left(v, length(v) - length(a.unit)), chr(32) || chr(9) || chr(10)) ELSE v END AS b,
  CASE WHEN regexp_full_match(v, '[A-Za-z][A-Za-z0-9_ .-]*\(\s*[+-]?[0-9]+\s*\)') THEN regexp_extract(v, '([+-]?[0-9]+)\s*\)$', 1) ELSE v END AS u FROM owned),
num AS (SELECT *, CASE WHEN b = v THEN u ELSE b END AS w FROM bare),
read_ AS (SELECT seq, i, attr_name, CASE kind
  WHEN 'string' THEN nullif(v, '')
  WHEN 'long' THEN CASE WHEN regexp_full_match(w, '[+-]?[0-9]+') AND try_cast(w AS HUGEINT) BETWEEN -9223372036854775808 AND 18446744073709551615 THEN try_cast(w AS HUGEINT)::VARCHAR WHEN regexp_full_match(w, '0[xX]0*[0-9a-fA-F]{1,16}') THEN try_cast('0x' || w[3:] AS UHUGEINT)::VARCHAR END
  WHEN 'double' THEN CASE WHEN regexp_full_match(b, '[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?') AND isfinite(try_cast(replace(b, ',', '.') AS DOUBLE)) THEN (try_cast(replace(b, ',', '.') AS DOUBLE) + 0.0)::VARCHAR END
  WHEN 'boolean' THEN CASE WHEN lower(u) IN ('true', 'yes', 'on', '1') THEN 'true' WHEN lower(u) IN ('false', 'no', 'off', '2') THEN 'false' END
  WHEN 'timestamp' THEN CASE WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)? ?([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)?') THEN epoch_us(try_cast(v AS TIMESTAMPTZ))::VARCHAR
    WHEN regexp_full_match(v, '0[xX][0-9a-fA-F]{16}') THEN epoch_us(try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d.%d+00', ('0x' || v[3:6])::INT, ('0x' || v[7:8])::INT, ('0x' || v[9:10])::INT, ('0x' || v[11:12])::INT, ('0x' || v[13:14])::INT, ('0x' || v[15:16])::INT, ('0x' || v[17:18])::INT) AS TIMESTAMPTZ))::VARCHAR
    WHEN regexp_full_match(v, '[+-]?[0-9]{1,12}') THEN (v::BIGINT * 1000000)::VARCHAR END END AS r FROM num)"""
P4_FOUND = _CELLS + """ SELECT seq, attr_name, CASE WHEN count(r) = 0 THEN 'unreadable' ELSE 'conflict' END AS issue FROM read_ GROUP BY seq, attr_name HAVING count(r) = 0 OR count(DISTINCT r) > 1"""

# The listed attributes, by whether their cells are doubles.
_TEXT_CELLS = "alarm_text batt_pct cert_expiry circuit_ref device_id door_open err_count fan_rpm if_admin if_descr if_index if_oper in_octets last_change on_battery peer_as severity site_code".split()
_DOUBLE_CELLS = "cpu_load latency_ms rx_power temp_c volt_in".split()
P4_VALUES = f"""{_CELLS}, last_ AS (SELECT seq, {", ".join(f"arg_max(r, i) FILTER (attr_name = '{n}' AND r IS NOT NULL) AS {n}" for n in _TEXT_CELLS)},
{", ".join(f"arg_max(r, i) FILTER (attr_name = '{n}' AND r IS NOT NULL)::DOUBLE AS {n}" for n in _DOUBLE_CELLS)} FROM read_ GROUP BY seq)
SELECT t.seq, last_.* EXCLUDE (seq) FROM trap_event t LEFT JOIN last_ ON t.seq = last_.seq"""

ORACLES = {"p4_found": P4_FOUND, "p4_values": P4_VALUES, "p1_found": P1_FOUND, "p1_features": P1_FEATURES, "p1_windows": P1_WINDOWS, "p2_found": P2_FOUND, "p2_sessions": P2_SESSIONS, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_runs": P5_RUNS}
