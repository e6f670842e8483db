"""The same results in SQL, written independently for DuckDB."""

from __future__ import annotations

HOST = r"((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CIDR = HOST + r"/([0-2]?[0-9]|3[0-2])"
BLANK = "' ' || chr(9) || chr(10) || chr(13)"

LOGS = """
logs AS (
  SELECT 'user-' || user_id AS srcname, event_type AS dstname, 'svc-' || (k % 5) AS dstportname,
         ts AS time, k AS rcvd, value AS sent,
         CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS ruleid, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""

DIRTY = LOGS + """,
dirty AS (
  SELECT CASE WHEN event_id % 79 <> 0 THEN srcname END AS srcname, dstname, dstportname,
         CASE WHEN event_id % 97 <> 0 THEN time END AS time,
         CASE WHEN event_id % 89 = 0 OR event_id % 83 = 0 THEN 0 ELSE rcvd END AS rcvd,
         sent, ruleid, event_id
  FROM logs
)"""


def _flows(table: str) -> str:
    return f"""
flows AS (
  SELECT srcname, dstname, dstportname, count(*) AS count, min(time) AS min_time, max(time) AS max_time,
         sum(CAST(rcvd AS DOUBLE)) AS total_rcvd, sum(sent) AS total_sent,
         first(ruleid ORDER BY time, event_id) FILTER (WHERE ruleid IS NOT NULL) AS ruleid_first
  FROM {table}
  WHERE srcname IS NOT NULL AND dstname IS NOT NULL AND dstportname IS NOT NULL AND time IS NOT NULL
  GROUP BY srcname, dstname, dstportname
)"""


FLOW_COLUMNS = """srcname, dstname, dstportname, count, min_time, max_time,
  round(total_rcvd, 2) AS total_rcvd, round(total_sent, 2) AS total_sent, ruleid_first"""

RULES = """
rules AS (
  SELECT key + 1 AS _row, key,
         CASE WHEN key % 7 = 0 THEN '' ELSE 'r-' || (key % 50) END AS rule_name,
         CASE WHEN key % 3 = 0 THEN ''
              WHEN key % 11 = 0 THEN 'Règle très longue, écrite à la main pour la commande numéro ' || key
              ELSE 'Règle "' || o_orderpriority || '" ' || key END AS comment,
         'cust-' || o_custkey AS from_src,
         CASE WHEN key % 2 = 0 THEN o_orderstatus || ',grp' ELSE 'grp,' || o_orderstatus END AS to_dest,
         o_orderpriority AS service,
         CASE WHEN key % 50 = 0 THEN 'bogus' WHEN o_orderstatus = 'P' THEN 'Allow'
              WHEN o_orderstatus = 'F' THEN 'deny' ELSE 'pass' END AS action,
         CASE WHEN key % 4 = 0 THEN 'local_nat_slot_09' ELSE 'local_filter_slot_09' END AS type_slot,
         CASE WHEN key % 101 = 0 THEN 'red' ELSE '' END AS separator_color,
         CASE WHEN key % 4 = 0 THEN 'NAT' ELSE 'FILTER' END AS kind
  FROM (SELECT *, o_orderkey AS key FROM orders)
)"""

IF_RULES = RULES + """,
if_rules AS (
  SELECT *,
         CASE WHEN _row % 3 = 0 THEN 'if-' || (_row % 25)
              WHEN _row % 3 = 1 THEN 'if-' || (_row % 25) || ' , if-' || (_row % 30) ELSE 'Any' END AS from_if,
         CASE WHEN _row % 5 = 0 THEN 'if-' || (_row % 30) ELSE '' END AS to_if
  FROM rules
)"""

KNOWN = """
known AS (
  SELECT 'OBJECT' AS kind, 'cust-' || c_custkey AS name FROM customer WHERE c_custkey % 5 <> 0
  UNION SELECT 'OBJECT', o_orderstatus FROM orders
  UNION SELECT 'OBJECT', o_orderpriority FROM orders WHERE o_orderpriority <> '1-URGENT'
  UNION SELECT 'OBJECT', 'grp'
  UNION SELECT 'OBJECT', 'if-' || n_nationkey FROM nation WHERE n_nationkey % 6 <> 0
  UNION SELECT 'INTERFACE', 'if-' || n_nationkey FROM nation WHERE n_nationkey % 6 <> 0
)"""


def _needs(table: str, interfaces: bool = False) -> str:
    values = [(f"'OBJECT'", c) for c in ("from_src", "to_dest", "service")]
    if interfaces:
        values += [(f"'INTERFACE'", c) for c in ("from_if", "to_if")]
    one = " UNION ALL ".join(f"SELECT _row, {kind} AS kind, {c} AS value FROM {table}" for kind, c in values)
    return f"""
needs AS (
  SELECT DISTINCT _row, kind, trim(part) AS name
  FROM (SELECT _row, kind, unnest(string_split(value, ',')) AS part FROM ({one}) WHERE lower(value) NOT IN ('', 'any'))
  WHERE trim(part) <> ''
),
lacks AS (SELECT * FROM needs ANTI JOIN known USING (kind, name))"""


def _shown(x: str) -> str:
    """A value on a command line."""
    plain = f"trim(strip_accents({x}), {BLANK})"
    return (
        f"CASE WHEN regexp_full_match({plain}, '[a-zA-Z0-9_.-]+|{CIDR}') THEN {plain}"
        f" ELSE '\"' || replace({plain}, '\"', chr(92) || '\"') || '\"' END"
    )


def _capped(x: str) -> str:
    return f"CASE WHEN length({x}) > 64 THEN substr({x}, 1, 61) || '...' ELSE {x} END"


ACTION = """CASE WHEN lower(action) IN ('pass', 'block', 'drop', 'bypass', 'deleg', 'reset', 'log', 'decrypt', 'nat')
  THEN lower(action) WHEN lower(action) IN ('allow', 'accept') THEN 'pass' WHEN lower(action) = 'deny' THEN 'drop' END"""


def _commands(table: str, kind: str, prefix: str = "", slot: int = 9) -> str:
    """``line`` and ``error`` from _row, position, kind and the rule's fields."""
    name = (
        f"'{prefix}' || CASE WHEN rule_name <> '' THEN rule_name WHEN comment <> '' THEN comment"
        f" WHEN {kind} = 'NAT' THEN 'NatRule-' || printf('%04d', position)"
        " ELSE 'FilterRule-' || printf('%04d', position) END"
    )
    return f"""
named AS (SELECT *, strip_accents({name}) AS full_name, {ACTION} AS canonical FROM {table}),
commands AS (
  SELECT *,
    CASE WHEN {kind} <> 'NAT' AND canonical IS NULL THEN NULL ELSE
      'CONFIG FILTER RULE INSERT index={slot} type='
      || CASE WHEN {kind} = 'NAT' THEN 'nat action=nat' ELSE 'filter' END
      || ' position=' || position || ' rulename=' || {_shown('(' + _capped('full_name') + ')')}
      || CASE WHEN rule_name <> '' AND comment <> '' THEN ' comment=' || {_shown('comment')} ELSE '' END
      || CASE WHEN {kind} = 'NAT' THEN '' ELSE ' action=' || canonical || ' service=' || {_shown('service')} END
      || ' srctarget=' || {_shown('from_src')} || ' dsttarget=' || {_shown('to_dest')} END AS line,
    CASE WHEN {kind} <> 'NAT' AND canonical IS NULL
         THEN 'action de filtre inconnue: ''' || action || '''' END AS error
  FROM named
)"""


def _converted(prefix: str = "", start: int = 1) -> str:
    return (
        f"WITH {RULES}, {KNOWN}, {_needs('rules')}, "
        f"""checked AS (
  SELECT r.*, l.missing IS NULL AND (kind = 'NAT' OR {ACTION} IS NOT NULL) AS safe, coalesce(l.missing, '') AS missing
  FROM rules r LEFT JOIN (
    SELECT _row, string_agg(kind || ':' || name, ', ' ORDER BY kind, name) AS missing FROM lacks GROUP BY _row
  ) l USING (_row)
  WHERE separator_color = ''
),
placed AS (
  SELECT *, CASE WHEN safe THEN 'SAFE' ELSE 'PENDING' END AS status,
    CAST({start} + coalesce(sum(CAST(safe AS INTEGER)) OVER (
      ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM checked
), """
        + _commands("placed", "kind", prefix)
    )


ADDRESSES = """
addresses AS (
  SELECT c_custkey * 2 AS _row,
    CASE WHEN c_custkey % 3 = 0 THEN ip ELSE '' END AS from_src,
    CASE WHEN c_custkey % 5 = 0 THEN '10.0.0.' || (c_custkey % 290) ELSE '' END AS source_ip,
    CASE WHEN c_custkey % 4 <> 0 THEN ip ELSE 'web' END AS source,
    CASE WHEN c_custkey % 7 = 0 THEN ip || '/' || (c_custkey % 40) WHEN c_custkey % 7 = 1 THEN ip || '-' || ip
         ELSE 'H_10_0_0_' || (c_custkey % 290) END AS to_dest
  FROM (SELECT *, '10.' || c_nationkey || '.' || (c_custkey // 256 % 300) || '.' || (c_custkey % 256) AS ip FROM customer)
  UNION ALL
  SELECT (doc_id * 1048576 + generate_subscripts(ips, 1) - 1) * 2 + 1, unnest(ips), '', '', 'any'
  FROM (SELECT doc_id, CASE WHEN len(found) > 0 THEN found ELSE [''] END AS ips FROM (
    SELECT doc_id, regexp_extract_all(text, '([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})', 1) AS found FROM documents
  ))
)"""

HOSTS = ADDRESSES + f""",
hosts AS (
  SELECT DISTINCT ip FROM (
    SELECT coalesce(nullif(from_src, ''), nullif(source_ip, ''), nullif(source, '')) AS ip FROM addresses
    UNION ALL SELECT to_dest FROM addresses
  ) WHERE regexp_full_match(ip, '{HOST}')
)"""


def _sorted_list(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({x}, '[,;]'), lambda p: trim(p, {BLANK})), lambda p: p <> '')"
    return f"CASE WHEN len({parts}) > 1 THEN array_to_string(list_sort({parts}), ',') ELSE trim({x}, {BLANK}) END"


SIGNATURES = RULES + f""",
signatures AS (
  SELECT _row, lower(kind) AS kind, from_src AS source, {_sorted_list('to_dest')} AS destination,
         service AS port, 'any' AS protocol, action, CASE WHEN rule_name = '' THEN 'Sans nom' ELSE rule_name END AS name
  FROM rules
),
members AS (
  SELECT *, count(*) OVER g AS n, min(_row) OVER g AS first_line, count(*) OVER (
    PARTITION BY kind, source, destination, port, protocol, action, name) AS same_name
  FROM signatures WINDOW g AS (PARTITION BY kind, source, destination, port, protocol, action)
)"""

# The head of the script of pending rules.
PENDING_HEAD = [
    "######################################################################",
    "# WARNING: PENDING RULES                                           #",
    "# ------------------------------------------------------------------ #",
    "# The commands in this file have MISSING DEPENDENCIES.               #",
    "# They are provided for debugging purposes and are LIKELY TO FAIL if #",
    "# executed directly on a firewall without first creating the       #",
    "# missing objects or interfaces.                                     #",
    "######################################################################",
    "",
    "# Generated on: T",
]

FINAL_IDS = RULES + """,
missing AS (
  SELECT *, row_number() OVER (ORDER BY _row) + 2 AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY from_src, to_dest, service, action ORDER BY _row) AS nth FROM rules s
    WHERE NOT EXISTS (
      SELECT 1 FROM rules f WHERE f.key % 3 <> 0 AND f.from_src = s.from_src AND f.to_dest = s.to_dest
        AND f.service = s.service AND f.action = s.action)
  ) WHERE nth = 1
), """

ORACLES: dict[str, str] = {
    "flow_rollup": f"WITH {LOGS}, {_flows('logs')} SELECT {FLOW_COLUMNS} FROM flows",
    "flow_clean_dirty": f"WITH {DIRTY}, {_flows('dirty')} SELECT {FLOW_COLUMNS} FROM flows",
    "flow_totals": f"WITH {LOGS}, {_flows('logs')} "
    "SELECT CAST(sum(count) AS BIGINT) AS rows_processed, count(*) AS unique_flows FROM flows",
    "flow_top_count": f"WITH {LOGS}, {_flows('logs')} SELECT srcname, dstname, dstportname, count FROM flows "
    "ORDER BY count DESC, srcname, dstname, dstportname LIMIT 10",
    "flow_top_traffic": f"WITH {LOGS}, {_flows('logs')} SELECT srcname, dstname, dstportname, "
    "round(total_rcvd + total_sent, 2) AS total_traffic, round(total_rcvd, 2) AS total_rcvd, "
    "round(total_sent, 2) AS total_sent FROM flows "
    "ORDER BY total_rcvd + total_sent DESC, srcname, dstname, dstportname LIMIT 10",
    "log_csv_scan": f"""WITH {DIRTY}
SELECT srcname, CASE WHEN event_id % 5 = 0 THEN dstname || ', "q"' ELSE dstname END AS dstname, dstportname, time,
  CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE CAST(rcvd AS DOUBLE) END AS rcvd,
  CASE WHEN event_id % 31 = 0 THEN 0.0 ELSE sent END AS sent,
  CASE WHEN event_id % 31 <> 0 THEN ruleid END AS ruleid
FROM dirty WHERE srcname IS NOT NULL AND time IS NOT NULL
  AND (event_id % 31 = 0 OR (event_id % 37 <> 0 AND event_id % 41 <> 0))""",
    "log_folder_scan": f"""WITH {DIRTY}
SELECT CAST(event_id AS VARCHAR) AS event_id, srcname, dstname, CAST(rcvd AS DOUBLE) AS rcvd, sent,
  CASE WHEN event_id % 2 = 1 THEN md5(said) END AS said, CASE WHEN event_id % 2 = 1 THEN CAST(length(said) AS INTEGER) END AS chars
FROM (SELECT *, CASE WHEN event_id % 7 = 0 THEN 'line' || chr(10) || repeat('"x", ', 25000) || dstname ELSE 'plain' END AS said
  FROM dirty) WHERE srcname IS NOT NULL AND time IS NOT NULL""",
    "flow_exact_totals": f"""WITH {LOGS}
SELECT srcname, dstname, dstportname, CAST(sum(big) AS VARCHAR) AS total_rcvd, CAST(sum(big) AS VARCHAR) AS total_sent
FROM (SELECT *, CAST(event_id AS HUGEINT) + 9007199254740993 AS big FROM logs) GROUP BY ALL""",
    "flow_csv_sink": f"WITH {LOGS}, {_flows('logs')} SELECT {FLOW_COLUMNS} FROM flows",
    "rule_classify": f"WITH {RULES} SELECT _row, kind, kind = 'NAT' AND service <> '' AS dropped_service FROM rules",
    "rule_action": f"WITH {RULES} SELECT _row, {ACTION} AS action FROM rules",
    "rule_pick_alias": f"""WITH {RULES}
SELECT _row,
  CASE WHEN _row % 2 = 0 THEN service WHEN _row % 3 = 0 THEN to_dest WHEN _row % 7 = 0 THEN rule_name ELSE '' END AS service,
  CASE WHEN _row % 3 = 0 THEN to_dest ELSE '' END AS to_port, from_src, '' AS to_dest FROM rules""",
    "ip_predicates": f"WITH {ADDRESSES} SELECT _row, "
    + ", ".join(
        f"regexp_full_match({c}, '{HOST}') AS {c}_host, regexp_full_match({c}, '{HOST}|{CIDR}|{HOST}-{HOST}') AS {c}_network"
        for c in ("from_src", "source", "to_dest")
    )
    + " FROM addresses",
    "host_objects_list": f"WITH {HOSTS} SELECT ip, 'H_' || replace(ip, '.', '_') AS name, "
    "'CONFIG OBJECT HOST NEW name=H_' || replace(ip, '.', '_') || ' ip=' || ip || ' comment=\"\"' AS command FROM hosts",
    "host_substitution": f"""WITH {HOSTS},
picked AS (SELECT _row, coalesce(nullif(from_src, ''), source) AS src, to_dest AS dst FROM addresses),
swapped AS (
  SELECT _row, CASE WHEN src IN (SELECT ip FROM hosts) THEN 'H_' || replace(src, '.', '_') ELSE src END AS src,
    CASE WHEN dst IN (SELECT ip FROM hosts) THEN 'H_' || replace(dst, '.', '_') ELSE dst END AS dst FROM picked
)
SELECT _row, 'CONFIG FILTER RULE INSERT index=9 type=filter position=' || _row || ' rulename=FilterRule-' || printf('%04d', _row)
  || CASE WHEN src = '' THEN '' ELSE ' srctarget=' || {_shown('src')} END
  || CASE WHEN dst = '' THEN '' ELSE ' dsttarget=' || {_shown('dst')} END AS command FROM swapped""",
    "rule_csv_scan": f"""WITH {RULES}
SELECT row_number() OVER (ORDER BY _row) AS _row, type_slot, rule_name, from_src,
  CASE WHEN _row % 6 <> 0 THEN to_dest ELSE '' END AS to_dest, CASE WHEN _row % 6 <> 0 THEN 'x' ELSE '' END AS to_dest_1
FROM rules""",
    "rule_files_scan": f"""WITH {RULES},
texts AS (SELECT _row AS k, type_slot, action, CASE WHEN _row % 5 = 0 THEN 'a' || chr(10) || 'b;' || comment ELSE comment END AS comment FROM rules)
SELECT row_number() OVER (ORDER BY k % 3 = 0, k) AS _row, CAST(k AS VARCHAR) AS key,
  CASE WHEN k % 3 = 0 THEN type_slot ELSE '' END AS type_slot, CASE WHEN k % 3 = 0 THEN '' ELSE action END AS action,
  trim(comment, '"' || {BLANK}) AS comment FROM texts""",
    "name_lists": """WITH lines AS (
  SELECT *, c_custkey % 6 AS m, trim(c_mktsegment) AS segment FROM customer
)
SELECT DISTINCT 'object' AS list, CASE m WHEN 0 THEN c_name WHEN 1 THEN segment WHEN 3 THEN 'Name="' || segment || '"'
  WHEN 4 THEN '[' || c_nationkey || ']' ELSE 'ifname=eth' || (c_custkey % 30) || ' up' END AS name FROM lines WHERE m <> 2
UNION
SELECT DISTINCT 'interface', CASE m WHEN 0 THEN 'if ' || (c_custkey % 40) WHEN 1 THEN segment WHEN 3 THEN segment
  ELSE 'eth' || (c_custkey % 30) END FROM lines WHERE m NOT IN (2, 4)""",
    "row_numbers": "SELECT (o_orderkey - 500) * 1000003 AS key, row_number() OVER (ORDER BY o_orderkey) AS n "
    "FROM orders",
    "nat_lines": f"WITH {RULES} SELECT _row, row_number() OVER (ORDER BY _row) AS nat_line FROM rules WHERE kind = 'NAT'",
    "nat_lines_original": f"WITH {RULES} SELECT _row, row_number() OVER (ORDER BY CAST(trunc(1000000 - _row / 10) AS BIGINT), _row) "
    "AS nat_line FROM rules WHERE kind = 'NAT'",
    "missing_list": f"""WITH {IF_RULES}, {KNOWN}, {_needs('if_rules', True)}, names AS (SELECT DISTINCT kind, name FROM lacks)
SELECT 1 AS part, 0 AS ord, kind, name, kind || ': ' || name AS line FROM names
UNION ALL SELECT 0, * FROM (VALUES (0, '', '', '# Missing dependencies found on T'), (1, '', '', ''))""",
    "missing_objects": f"WITH {RULES}, {KNOWN}, {_needs('rules')} SELECT _row, name FROM lacks WHERE kind = 'OBJECT'",
    "missing_interfaces": f"WITH {IF_RULES}, {KNOWN}, {_needs('if_rules', True)} "
    "SELECT _row, name FROM lacks WHERE kind = 'INTERFACE'",
    "missing_all": f"WITH {IF_RULES}, {KNOWN}, {_needs('if_rules', True)} SELECT DISTINCT kind, name FROM lacks",
    "strip_accents": "SELECT 'doc' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS turn, strip_accents(text) AS text FROM documents "
    "UNION ALL SELECT 'conv', conv_id, turn, strip_accents(text) FROM conversations",
    "cli_value": f"SELECT doc_id, {_shown('text')} AS value FROM documents",
    "text_lists": f"""SELECT doc_id, {_sorted_list('text')} AS sorted,
  CAST(len(list_filter(string_split(text, ','), lambda p: trim(p, {BLANK}) <> '')) AS INTEGER) AS n_names,
  split_part(text, ',', 1) AS first, {_capped('text')} AS name, 'H_' || replace(source, '.', '_') AS host FROM documents""",
    "filter_commands": f"WITH {RULES}, placed AS (SELECT *, _row AS position FROM rules), {_commands('placed', chr(39) + 'FILTER' + chr(39))} "
    "SELECT _row, line AS command, error FROM commands",
    "nat_commands": f"WITH {RULES}, placed AS (SELECT *, _row AS position FROM rules), {_commands('placed', chr(39) + 'NAT' + chr(39))} "
    "SELECT _row, line AS command, error FROM commands",
    "rule_positions": f"{_converted()} SELECT _row, status, position FROM placed",
    "convert_rules": f"{_converted('P-', 5)} SELECT _row, kind, status, position, line AS command, error, missing FROM commands",
    "convert_counts": f"{_converted()} SELECT (SELECT count(*) FROM rules) AS rows_read, "
    "(SELECT count(*) FROM placed WHERE safe) AS safe_commands, (SELECT count(*) FROM placed WHERE NOT safe) AS pending, "
    "(SELECT count(*) FROM (SELECT DISTINCT kind, name FROM lacks SEMI JOIN placed USING (_row))) AS missing",
    "safe_script": f"""{_converted()}, safe AS (SELECT position, line FROM commands WHERE safe)
SELECT 4 AS part, position AS ord, 0 AS sub, line FROM safe
UNION ALL SELECT 4, position, 1, '' FROM safe WHERE position % 10 = 0
UNION ALL SELECT 5, * FROM (VALUES (0, 0, ''), (1, 0, 'CONFIG FILTER ACTIVATE'))
UNION ALL SELECT 0, 0, 0, '# Commands generated on T'
UNION ALL SELECT 0, 1, 0, '# Source CSVs: rules.csv'
UNION ALL SELECT 0, 2, 0, '# Number of commands: ' || (SELECT count(*) FROM safe)
UNION ALL SELECT 0, * FROM (VALUES (3, 0, 'SYSTEM SESSION language=fr'), (4, 0, 'MODIFY ON FORCE'),
  (5, 0, 'CONFIG SLOT ACTIVATE type=filter slot=9'), (6, 0, ''))""",
    "pending_script": f"""{_converted()}, pending AS (SELECT * FROM commands WHERE NOT safe)
SELECT 1 AS part, _row AS ord, 0 AS sub, CASE WHEN line IS NULL THEN '# PENDING: Rule from row ' || _row || ' could not be processed.'
  ELSE '# PENDING: Missing dependencies: ' || missing END AS line FROM pending
UNION ALL SELECT 1, _row, 1, line FROM pending WHERE line IS NOT NULL
UNION ALL SELECT 1, _row, 3, '# Original data: ' || CAST(json_object('rule_name', rule_name, 'comment', comment,
  'from_src', from_src, 'to_dest', to_dest, 'service', service, 'action', action, 'type_slot', type_slot,
  'separator_color', separator_color) AS VARCHAR) FROM pending WHERE line IS NULL
UNION ALL SELECT 1, _row, 4, '' FROM pending
UNION ALL SELECT 0, i, 0, t FROM (SELECT unnest(range(10)) AS i, unnest([{', '.join(f"'{t}'" for t in PENDING_HEAD)}]) AS t)
UNION ALL SELECT 1, _row, 2, '# ' || CASE WHEN missing = '' THEN '' ELSE 'Missing: ' || missing END || ' Build error: ' || error
FROM pending WHERE line IS NULL""",
    "suggest_rules": f"""WITH {LOGS}, {_flows('logs')},
known AS (
  SELECT 'user-' || user_id AS name FROM events WHERE user_id % 3 <> 0
  UNION SELECT event_type FROM events WHERE event_type <> 'error'
  UNION SELECT 'svc-' || (event_id % 4) FROM events
),
top AS (
  SELECT row_number() OVER (ORDER BY count DESC, srcname, dstname, dstportname) AS rank, * FROM flows
  ORDER BY rank LIMIT 10
),
lacks AS (
  SELECT DISTINCT rank, name FROM (SELECT rank, unnest([srcname, dstname, dstportname]) AS name FROM top) ANTI JOIN known USING (name)
)
SELECT CAST(rank AS BIGINT) AS rank, srcname, dstname, dstportname, count,
  coalesce((SELECT string_agg('OBJECT:' || name, ', ' ORDER BY name) FROM lacks l WHERE l.rank = t.rank), '') AS missing,
  'CONFIG FILTER RULE INSERT index=9 type=filter position=1 rulename="Rule for ' || srcname || ' to ' || dstname
  || '" action=pass service=' || dstportname || ' srctarget=' || srcname || ' dsttarget=' || dstname AS command
FROM top t""",
    "missing_rules": f"WITH {FINAL_IDS} {_commands('missing', chr(39) + 'FILTER' + chr(39), 'MissingRule-')} "
    "SELECT _row, position, kind, from_src AS id_source, to_dest AS id_destination, service AS id_service, "
    "action AS id_action, line AS command, error FROM commands",
    "dup_signature": f"WITH {SIGNATURES} SELECT _row, kind, source, destination, port, protocol, action, name FROM signatures",
    "dup_groups": f"WITH {SIGNATURES} SELECT DISTINCT kind, source, destination, port, protocol, action, n, first_line "
    "FROM members WHERE n > 1",
    "dup_members": f"""WITH {SIGNATURES},
nat AS (SELECT _row, row_number() OVER (ORDER BY _row) AS nat_line FROM rules WHERE kind = 'NAT')
SELECT kind, _row, nat_line, name, n, _row = first_line AS is_kept, first_line
FROM members LEFT JOIN nat USING (_row) WHERE n > 1""",
    "dup_removals": f"""WITH {SIGNATURES},
gone AS (SELECT *, kind = 'filter' AND (name = 'Sans nom' OR same_name > 1) AS by_line FROM members
  WHERE _row <> first_line AND (kind = 'filter' OR name <> 'Sans nom'))
SELECT kind, _row, CASE WHEN by_line THEN -_row ELSE 0 END AS remove_order,
  'CONFIG FILTER RULE REMOVE index=9 type=' || kind || ' '
  || CASE WHEN by_line THEN 'position=' || _row ELSE 'name="' || name || '"' END AS command FROM gone""",
    "removal_script": f"""WITH {SIGNATURES},
gone AS (SELECT *, kind = 'filter' AND (name = 'Sans nom' OR same_name > 1) AS by_line FROM members
  WHERE _row <> first_line AND (kind = 'filter' OR name <> 'Sans nom'))
SELECT CASE WHEN kind = 'filter' THEN 1 ELSE 3 END AS part, CASE WHEN by_line THEN -_row ELSE 0 END AS remove_order,
  first_line AS first_row, _row, 'CONFIG FILTER RULE REMOVE index=9 type=' || kind || ' '
  || CASE WHEN by_line THEN 'position=' || _row ELSE 'name="' || name || '"' END AS line FROM gone
UNION ALL SELECT * FROM (VALUES (0, 0, 0, 0, '# Commands to delete duplicate filter rules'), (2, 0, 0, 0, ''),
  (2, 0, 1, 0, '# Commands to delete duplicate NAT rules'), (4, 0, 0, 0, ''), (4, 0, 1, 0, '# Activate the new filter policy'),
  (4, 0, 2, 0, 'CONFIG FILTER ACTIVATE'))""",
    "missing_script": f"WITH {FINAL_IDS} {_commands('missing', chr(39) + 'FILTER' + chr(39), 'MissingRule-')}, "
    "built AS (SELECT row_number() OVER (ORDER BY position) AS ord, line FROM commands WHERE line IS NOT NULL) "
    "SELECT 1 AS part, ord, 0 AS sub, line FROM built UNION ALL SELECT 1, ord, 1, '' FROM built WHERE ord % 10 = 0 "
    "UNION ALL SELECT 0, 0, 0, '# Generated on T' UNION ALL SELECT 0, 2, 0, '' "
    "UNION ALL SELECT 0, 1, 0, '# ' || (SELECT count(*) FROM built) || ' commands to add rules that are missing from the final configuration.'",
    "dup_report": f"""WITH {SIGNATURES}, dups AS (SELECT * FROM members WHERE n > 1 AND kind = 'filter'),
heads AS (SELECT * FROM dups WHERE _row = first_line)
SELECT first_line AS first_row, 7 AS sub, _row AS place, '| `N/A` | `' || _row || '` | `' || name || '` |' AS line FROM dups
UNION ALL SELECT _row, 3, _row, '### Duplicate - Signature: (Source: `' || source || '`, Destination: `' || destination
  || '`, Port: `' || port || '`, Protocol: `' || protocol || '`, Action: `' || action || '`)' FROM heads
UNION ALL SELECT _row, 4, _row, '' FROM heads
UNION ALL SELECT _row, 5, _row, '| File | Line | Rule Name |' FROM heads
UNION ALL SELECT _row, 6, _row, '|---|---|---|' FROM heads
UNION ALL SELECT _row, sub, _row, CASE sub WHEN 1 THEN '---' ELSE '' END
FROM heads, (VALUES (0), (1), (2)) v(sub) WHERE _row <> (SELECT min(_row) FROM heads)""",
    "log_packed_scan": f"""WITH {DIRTY}
SELECT CAST(event_id AS VARCHAR) AS event_id, srcname, dstname, CAST(rcvd AS DOUBLE) AS rcvd, sent,
  CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'a' || chr(10) || 'b,c' ELSE 'd' END AS said
FROM dirty WHERE srcname IS NOT NULL AND time IS NOT NULL""",
    "log_bytes": f"""WITH {DIRTY}
SELECT CAST(event_id AS VARCHAR) AS event_id, srcname, said, hex(encode(said)) AS bytes FROM (
  SELECT *, CASE event_id % 3 WHEN 0 THEN 'a' || chr(65533) || 'é' WHEN 1 THEN chr(65533) ELSE 'plain' END AS said FROM dirty)
WHERE srcname IS NOT NULL AND time IS NOT NULL""",
    "log_time_formats": f"""WITH {DIRTY}
SELECT CAST(event_id AS VARCHAR) AS event_id, date_trunc('second', time) AS time FROM dirty WHERE srcname IS NOT NULL AND time IS NOT NULL""",
    "flow_order": f"""WITH {LOGS}, {_flows('logs')}
SELECT row_number() OVER (ORDER BY srcname, dstname, dstportname) AS _row, srcname, dstname, dstportname, count FROM flows""",
    "summary_lines": f"""WITH {LOGS}, {_flows('logs')}, rounded AS (
  SELECT srcname, dstname, dstportname, count, round(total_rcvd, 2) + round(total_sent, 2) AS traffic,
    round(total_rcvd, 2) AS total_rcvd, round(total_sent, 2) AS total_sent FROM flows
), by_count AS (
  SELECT row_number() OVER (ORDER BY count DESC, srcname, dstname, dstportname) AS k,
    [srcname, dstname, dstportname, CAST(count AS VARCHAR)] AS cells FROM rounded QUALIFY k <= 10
), top AS (
  SELECT row_number() OVER (ORDER BY traffic DESC, srcname, dstname, dstportname) AS k, * FROM rounded QUALIFY k <= 10
), shown AS (
  SELECT *, [regexp_replace(printf('%.6f', v), '0+$', '') FOR v IN [traffic, total_rcvd, total_sent]] AS texts FROM top
), places AS (
  SELECT list(p ORDER BY i) AS p, list(whole ORDER BY i) AS whole FROM (
    SELECT i, greatest(1, max(len(split_part(texts[i], '.', 2)))) AS p, bool_and(v[i] = floor(v[i])) AS whole
    FROM (SELECT *, [traffic, total_rcvd, total_sent] AS v FROM shown), range(1, 4) t(i) GROUP BY i)
), by_traffic AS (
  SELECT k, [srcname, dstname, dstportname] || [CASE WHEN whole[i] THEN CAST(CAST(v[i] AS BIGINT) AS VARCHAR)
    ELSE printf('%.' || p[i] || 'f', v[i]) END FOR i IN range(1, 4)] AS cells
  FROM (SELECT *, [traffic, total_rcvd, total_sent] AS v FROM top), places
), heads AS (
  SELECT 7 AS base, 0 AS k, ['srcname', 'dstname', 'dstportname', 'count'] AS cells UNION ALL SELECT 7, * FROM by_count
  UNION ALL SELECT 21, 0, ['srcname', 'dstname', 'dstportname', 'total_traffic', 'total_rcvd', 'total_sent']
  UNION ALL SELECT 21, * FROM by_traffic
), wide AS (
  SELECT h.*, w FROM heads h JOIN (SELECT base, list(w ORDER BY i) AS w FROM (
    SELECT base, i, max(len(cells[i])) AS w FROM heads, range(1, 7) t(i) GROUP BY base, i) GROUP BY base) USING (base)
)
SELECT base + k + 1 AS _row, array_to_string([CASE WHEN i > 3 THEN '  ' WHEN i > 1 THEN ' ' ELSE '' END
  || lpad(cells[i], CAST(w[i] AS INTEGER), ' ') FOR i IN range(1, len(cells) + 1)], '') AS line FROM wide
UNION ALL SELECT i, t FROM (VALUES (1, 'Firewall Log Analysis Summary'), (2, repeat('=', 30)),
  (3, 'Total rows processed: ' || (SELECT sum(count) FROM flows)),
  (4, 'Total unique flows identified: ' || (SELECT count(*) FROM flows)), (5, ''),
  (6, 'Top 10 Flows by Count:'), (7, repeat('-', 25)), (19, ''),
  (20, 'Top 10 Flows by Total Traffic (Received + Sent):'), (21, repeat('-', 50))) v(i, t)""",
    "suggestion_lines": f"""WITH {LOGS}, {_flows('logs')},
top AS (
  SELECT row_number() OVER (ORDER BY count DESC, srcname, dstname, dstportname) AS rank, * FROM flows QUALIFY rank IN (1, 3, 6)
), lines AS (
  SELECT unnest(['# Rule generated from log analysis on T1', '# Rule generated from log analysis on T2', '', '']) AS line FROM top
  UNION ALL SELECT unnest([c, c]) FROM (SELECT 'CONFIG FILTER RULE INSERT index=9 type=filter position=1 rulename='
    || CASE rank WHEN 3 THEN 'third comment="why not"' ELSE '"Rule for ' || srcname || ' to ' || dstname || '"' END
    || ' action=pass service=' || dstportname || ' srctarget=' || srcname || ' dsttarget=' || dstname AS c FROM top)
)
SELECT line, count(*) AS n FROM lines GROUP BY line""",
    "rule_file_names": "SELECT CAST(o_orderkey + 1 AS VARCHAR) AS key, true AS own_name, true AS counted FROM orders",
    "nat_signs": f"""WITH {RULES}
SELECT _row, CASE WHEN _row % 5 = 0 OR _row % 7 = 0 OR _row % 11 = 0 OR _row % 17 = 0 THEN 'NAT' ELSE 'FILTER' END AS kind FROM rules""",
    "rule_slots": f"""WITH {RULES}, slots AS (
  SELECT _row, CASE WHEN _row % 2 = 0 THEN CASE _row % 3 WHEN 0 THEN '7' WHEN 1 THEN 'bad' ELSE '4' END
    WHEN _row % 9 = 1 THEN 'bad' ELSE CAST(_row % 8 AS VARCHAR) END AS slot FROM rules
)
SELECT _row, slot = 'bad' AS failed, CASE WHEN slot <> 'bad' THEN 'CONFIG FILTER RULE INSERT index=' || slot
  || ' type=filter position=' || _row || ' rulename=r action=pass srctarget=a' END AS command FROM slots""",
    "long_commands": f"""WITH {RULES}
SELECT _row, CASE WHEN _row % 3 < 2 THEN 1023 + _row % 3 END AS chars, _row % 3 = 2 AS failed FROM rules""",
    "host_order": f"WITH {HOSTS} SELECT ip, row_number() OVER (ORDER BY ip COLLATE C) AS n FROM hosts",
    "missing_summary": f"WITH {FINAL_IDS[:-2]} SELECT rule_name, from_src, to_dest, service, action, comment FROM missing",
    "blank_rules": f"""WITH {SIGNATURES}, said AS (SELECT * FROM signatures WHERE _row % 3 <> 0)
SELECT kind, source, destination, 'any' AS port, protocol, action, count(*) AS n, min(_row) AS first_line FROM said
GROUP BY ALL HAVING count(*) > 1""",
    "dup_report_nat": f"""WITH {SIGNATURES}, dups AS (SELECT * FROM members WHERE n > 1 AND kind = 'nat'),
heads AS (SELECT * FROM dups WHERE _row = first_line),
nat AS (SELECT _row, row_number() OVER (ORDER BY _row) AS nat_line FROM rules WHERE kind = 'NAT')
SELECT first_line AS first_row, 7 AS sub, nat_line AS place,
  '| `N/A` | `' || _row || '` | `' || nat_line || '` | `' || name || '` |' AS line FROM dups JOIN nat USING (_row)
UNION ALL SELECT _row, sub, nat_line, CASE sub WHEN 3 THEN '### Duplicate - Signature: (Source: `' || source || '`, Destination: `' || destination
  || '`, Port: `' || port || '`, Protocol: `' || protocol || '`, Action: `' || action || '`)'
  WHEN 5 THEN '| File | Line (File) | Line (NAT) | Rule Name |' WHEN 6 THEN '|---|---|---|---|' WHEN 1 THEN '---' ELSE '' END
FROM heads JOIN nat USING (_row), (VALUES (0), (1), (2), (3), (4), (5), (6)) v(sub)
WHERE sub >= 3 OR _row <> (SELECT min(_row) FROM heads)""",
}
