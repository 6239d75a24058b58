"""The same results as SQL on the test tables."""

from __future__ import annotations

from .versions import DOCUMENTS_SQL, EVENTS_SQL, ORDERS_SQL

ORDER_FIELDS = ["cust", "date", "priority", "rush", "status", "total"]


def orders(select: str) -> str:
    return f"WITH {ORDERS_SQL} {select}"


def documents(select: str) -> str:
    return f"WITH {DOCUMENTS_SQL} {select}"


def events(select: str) -> str:
    return f"WITH {EVENTS_SQL} {select}"


_PATHS = """
paths AS (
  SELECT event_type || '/' || user_id || '/' || event_type || '-' || strftime(ts, '%Y-%m-%d')
         || '-' || run_type || '-' || stage || '-records-to-' || action
         || coalesce(part, '') || '.xml' AS path,
         event_type, strftime(ts, '%Y-%m-%d') AS run_date, run_type, stage, action,
         substr(part, 2) AS idx
  FROM (SELECT *, CASE WHEN value >= 60 OR event_type IN ('signup', 'purchase') THEN 'full'
                       ELSE 'daily' END AS run_type,
               CASE WHEN value < 5 THEN 'transformed' ELSE 'extracted' END AS stage,
               CASE WHEN event_type = 'error' THEN 'delete' ELSE 'index' END AS action,
               CASE WHEN value >= 20 THEN '_' || CASE WHEN event_id < 10 THEN '0' ELSE '' END
                    || event_id END AS part
        FROM events))
"""

_CHOSEN = f"""
WITH {_PATHS},
asked(ordinal, source) AS (
  VALUES (0, 'view'), (1, 'purchase'), (2, 'click'), (3, 'signup'), (4, 'unknown')),
files AS (
  SELECT a.ordinal, a.source, p.path, CAST(regexp_extract(p.path, '.+?(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)
         AS DATE) AS extract_date, CASE WHEN contains(p.path, '-full-') THEN 0 ELSE 1 END AS daily
  FROM paths p JOIN asked a ON starts_with(p.path, a.source)
  WHERE contains(p.path, 'extracted')),
newest AS (SELECT ordinal, max(extract_date) AS full_date FROM files WHERE daily = 0 GROUP BY ordinal),
chosen AS (
  SELECT f.* FROM files f JOIN newest n ON f.ordinal = n.ordinal
  WHERE (daily = 0 AND extract_date = full_date) OR (daily = 1 AND extract_date >= full_date))
"""

_FIELD_FLAGS = ", ".join(f"CAST(d_{f} AS INTEGER) AS {f}" for f in ORDER_FIELDS)
_FIELD_LONGS = ", ".join(f"CAST(d_{f} AS BIGINT) AS {f}" for f in ORDER_FIELDS)

_GRID = """
grid AS (
  SELECT s.source, f.field, (SELECT count(*) FROM cells c
         WHERE c.source = s.source AND c.field = f.field) AS n
  FROM (SELECT DISTINCT source FROM records) s, (SELECT DISTINCT field FROM cells) f)
"""

_METRIC_ROWS = """
metric AS (
  SELECT 'summary.total_records' AS path, CAST(count(*) AS DOUBLE) AS value FROM records
  UNION ALL SELECT 'summary.total_records_with_diff',
                   CAST(count(*) FILTER (has_diff = 'true') AS DOUBLE) FROM records
  UNION ALL SELECT 'summary.records_with_diff_percent',
                   round(count(*) FILTER (has_diff = 'true') / count(*) * 100, 2) FROM records
  UNION ALL SELECT 'analysis.by_source.' || source || '.count',
                   CAST(count(*) FILTER (has_diff = 'true') AS DOUBLE) FROM records GROUP BY source
  UNION ALL SELECT 'analysis.by_field.' || field || '.count', CAST(count(*) AS DOUBLE)
            FROM cells GROUP BY field
  UNION ALL SELECT 'analysis.by_source.' || source || '.field_counts.' || field,
                   CAST(n AS DOUBLE) FROM grid WHERE n > 0
  UNION ALL SELECT 'analysis.by_field.' || field || '.source_counts.' || source,
                   CAST(n AS DOUBLE) FROM grid WHERE n > 0)
"""

_CHANGES = """
changes AS (
  SELECT record_id, source, 'cust' AS field, 'root[''cust'']' AS path, 'type_changed' AS kind,
         CAST(cust AS VARCHAR) AS old, '"' || cust || '"' AS new FROM records WHERE d_cust
  UNION ALL SELECT record_id, source, 'date', 'root[''date'']', 'changed',
         '"' || date_a || '"', '"' || date_b || '"' FROM records WHERE d_date
  UNION ALL SELECT record_id, source, 'priority', 'root[''priority'']', 'removed',
         '"' || priority_a || '"', NULL FROM records WHERE d_priority
  UNION ALL SELECT record_id, source, 'rush', 'root[''rush'']', 'added', NULL, 'true'
         FROM records WHERE d_rush
  UNION ALL SELECT record_id, source, 'status', 'root[''status'']', 'changed',
         '"' || status_a || '"', '"' || status_b || '"' FROM records WHERE d_status
  UNION ALL SELECT record_id, source, 'total', 'root[''total'']', 'changed',
         CAST(total_a AS VARCHAR), CAST(total_b AS VARCHAR) FROM records WHERE d_total)
"""

_DOCUMENT = """
CASE WHEN missing THEN NULL ELSE '{' || concat_ws(',',
  '"values_changed":{' || nullif(concat_ws(',',
     CASE WHEN d_date THEN '"root[''date'']":{"new_value":"' || date_b || '","old_value":"'
          || date_a || '"}' END,
     CASE WHEN d_status THEN '"root[''status'']":{"new_value":"' || status_b
          || '","old_value":"' || status_a || '"}' END,
     CASE WHEN d_total THEN '"root[''total'']":{"new_value":' || total_b || ',"old_value":'
          || total_a || '}' END), '') || '}',
  CASE WHEN d_cust THEN '"type_changes":{"root[''cust'']":{"old_type":"int","new_type":"str",'
       || '"old_value":' || cust || ',"new_value":"' || cust || '"}}' END,
  CASE WHEN d_rush THEN '"dictionary_item_added":["root[''rush'']"]' END,
  CASE WHEN d_priority THEN '"dictionary_item_removed":["root[''priority'']"]' END) || '}' END
"""

_ONLY_A = "CASE WHEN NOT in_b THEN 'cust,date,priority,status,total' " \
          "WHEN both_sides AND priority_b IS NULL THEN 'priority' ELSE '' END"
_ONLY_B = "CASE WHEN NOT in_a THEN concat_ws(',', 'cust', 'date', " \
          "CASE WHEN priority_b IS NOT NULL THEN 'priority' END, CASE WHEN rush THEN 'rush' END, " \
          "'status', 'total') WHEN both_sides AND rush THEN 'rush' ELSE '' END"

_RUNS = f"""
WITH {_PATHS}, o AS (
  SELECT count(*) AS total FROM orders WHERE o_totalprice < 490000)
SELECT '2024-11-07_03-56-22' AS run_timestamp, 'run of 2024-11-07' AS run_message,
       (SELECT total FROM o) AS total_records, (SELECT count(*) FROM paths) AS input_files
UNION ALL SELECT '2024-10-17_14-01-18', 'run of 2024-10-17',
       (SELECT count(*) FROM documents), (SELECT count(*) FROM paths)
"""

# all orders in both versions
_ALL_ORDERS_SQL = (
    ORDERS_SQL.replace("o_orderdate < TIMESTAMP '2001-06-01' OR o_totalprice < 5000 AS in_a",
                       "true AS in_a")
    .replace("o_totalprice >= 5000 AS in_b", "true AS in_b"))

_FINAL_COLUMNS = f"""
SELECT record_id, source, has_diff, CAST(missing AS INTEGER) AS a_or_b_missing,
       fields AS modified_fields, {_DOCUMENT} AS ab_diff, record_a, record_b, {_FIELD_LONGS}
FROM records"""
_FINAL = orders(_FINAL_COLUMNS)


def _page(order: str) -> str:
    return orders(f"""
        SELECT record_id, source, has_diff,
               '[' || replace(fields, ',', ', ') || ']' AS modified_fields
        FROM records ORDER BY {order}""")


ORACLES = {
    "collate_full_outer": orders("""
        SELECT record_id, source, CAST(run_date AS VARCHAR) AS run_date, run_type, action,
               record_a, record_b FROM joined"""),
    "latest_state": events("""
        SELECT record_id, source, CAST(run_date AS VARCHAR) AS run_date, run_type, action, event_id
        FROM latest_b WHERE action <> 'delete'"""),
    "latest_collated": events("""
        SELECT record_id, source, CAST(run_date AS VARCHAR) AS run_date, run_type, action,
               CAST(event_a AS VARCHAR) AS event_a, CAST(event_b AS VARCHAR) AS event_b
        FROM collated"""),
    "row_key": orders("""
        SELECT record_id, sha256(concat_ws('|', length(record_id) || ':' || record_id,
               length(source) || ':' || source, '10:' || CAST(run_date AS VARCHAR),
               length(run_type) || ':' || run_type, length(action) || ':' || action)) AS row_key FROM collated"""),
    "checks": f"""
        WITH {ORDERS_SQL}
        SELECT 'orders' AS dataset, count(*) AS total_records,
               count(*) FILTER (NOT in_a) AS record_a_nulls,
               count(*) FILTER (NOT in_b) AS record_b_nulls,
               count(*) - count(DISTINCT record_id) AS duplicate_ids FROM collated
        UNION ALL SELECT 'events', count(*), 0, 0,
               (SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id
                HAVING count(*) > 1)) FROM events""",
    "diff_status": orders("""
        SELECT record_id, source, has_diff, CAST(missing AS INTEGER) AS a_or_b_missing
        FROM records"""),
    "modified_fields": orders(
        "SELECT record_id, has_diff, fields AS modified_fields FROM records"),
    "modified_fields_typed": orders(
        "SELECT record_id, fields AS modified_fields FROM records"),
    "ordered_vs_unordered": documents("""
        SELECT record_id, fields AS fields_unordered,
               CASE WHEN NOT in_b OR n_lines = 1 THEN ''
                    WHEN repeats THEN 'lines,stats' ELSE 'lines' END AS fields_ordered
        FROM records"""),
    "change_table": f"WITH {ORDERS_SQL}, {_CHANGES} SELECT * FROM changes",
    "change_table_nested": events("""
        , both_sides AS (SELECT * FROM collated WHERE event_a IS NOT NULL AND event_b IS NOT NULL)
        SELECT record_id, 'event' AS field, 'root[''event'']' AS path, 'changed' AS kind,
               CAST(event_a AS VARCHAR) AS old, CAST(event_b AS VARCHAR) AS new
        FROM both_sides WHERE event_a <> event_b
        UNION ALL SELECT record_id, 'props', 'root[''props''][''k'']', 'changed',
               CAST(k_a AS VARCHAR), CAST(k_b AS VARCHAR) FROM both_sides WHERE k_a <> k_b
        UNION ALL SELECT record_id, 'type', 'root[''type'']', 'changed',
               '"' || type_a || '"', '"' || type_b || '"' FROM both_sides WHERE type_a <> type_b
        UNION ALL SELECT record_id, 'value', 'root[''value'']', 'changed',
               CAST(value_a AS VARCHAR), CAST(value_b AS VARCHAR)
        FROM both_sides WHERE value_a <> value_b"""),
    "change_table_items": """
        WITH lines AS (
          SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS record_id, l_linenumber AS line,
                 l_partkey AS part, CAST(trunc(l_quantity) AS BIGINT) AS qty, l_suppkey AS supp
          FROM lineitem),
        placed AS (
          SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY line, part, qty, supp) - 1
                   AS i, part % 11 <> 0 AS in_b, (part + line) % 5 = 0 AS edited,
                 count(*) FILTER (part % 11 <> 0) OVER (PARTITION BY record_id) AS left_in_b
          FROM lines)
        SELECT record_id, 'items' AS field,
               'root[''items''][' || i || ']' || CASE WHEN in_b THEN '[''qty'']' ELSE '' END
                 AS path,
               CASE WHEN in_b THEN 'changed' ELSE 'item_removed' END AS kind,
               CASE WHEN in_b THEN CAST(qty AS VARCHAR) ELSE '{"line":' || line || ',"part":'
                 || part || ',"qty":' || qty || ',"supp":' || supp || '}' END AS old,
               CASE WHEN in_b THEN CAST(qty + 100 AS VARCHAR) END AS new
        FROM placed WHERE left_in_b > 0 AND (NOT in_b OR edited)""",
    "change_table_repetition": documents("""
        , line AS (SELECT record_id, unnest(lines) AS line,
                          generate_subscripts(lines, 1) - 1 AS i FROM records WHERE repeats)
        SELECT record_id, 'lines' AS field, 'root[''lines''][' || min(i) || ']' AS path,
               'repetition_changed' AS kind, CAST(count(*) AS INTEGER) AS old_repeat,
               CAST(1 AS INTEGER) AS new_repeat
        FROM line GROUP BY record_id, line HAVING count(*) > 1
        UNION ALL SELECT record_id, 'stats', 'root[''stats''][''lines'']', 'changed', 0, 0
        FROM records WHERE repeats"""),
    "change_document": orders(f"SELECT record_id, {_DOCUMENT} AS ab_diff FROM records"),
    "keys_only_one_side": orders(f"""
        SELECT record_id, {_ONLY_A} AS fields_only_in_a, {_ONLY_B} AS fields_only_in_b
        FROM records"""),
    "record_flags": orders("""
        SELECT record_id, source, CAST(has_diff = 'true' AS INTEGER) AS has_diff,
               CAST(missing AS INTEGER) AS a_or_b_missing FROM records"""),
    "field_long": orders("SELECT record_id, source, field FROM cells"),
    "changed_fields": orders("SELECT DISTINCT field FROM cells"),
    "distinct_sources": orders("SELECT DISTINCT source FROM records"),
    "field_matrix": orders(f"""
        SELECT record_id, source, CAST(has_diff = 'true' AS INTEGER) AS has_diff,
               CAST(missing AS INTEGER) AS a_or_b_missing, {_FIELD_FLAGS} FROM records"""),
    "global_counts": orders("""
        SELECT count(*) AS total_records,
               count(*) FILTER (has_diff = 'true') AS total_records_with_diff,
               round(count(*) FILTER (has_diff = 'true') / count(*) * 100, 2)
                 AS records_with_diff_percent FROM records"""),
    "source_counts": orders("""
        SELECT source, count(*) FILTER (has_diff = 'true') AS n FROM records GROUP BY source"""),
    "source_field_counts": f"WITH {ORDERS_SQL}, {_GRID} SELECT source, field, n FROM grid",
    "field_counts": orders("SELECT field, count(*) AS n FROM cells GROUP BY field"),
    "field_source_counts": f"WITH {DOCUMENTS_SQL}, {_GRID} SELECT field, source, n FROM grid",
    "metrics_rows": f"WITH {ORDERS_SQL}, {_GRID}, {_METRIC_ROWS} SELECT path, value FROM metric",
    "metrics_document": f"""
        WITH {ORDERS_SQL}, named AS (
          SELECT record_id, has_diff, CASE WHEN source = '2-HIGH' THEN ''
                 WHEN source <> '5-LOW' THEN source END AS source FROM records),
        changes AS (SELECT n.source, c.field FROM cells c JOIN named n USING (record_id))
        SELECT 'summary' AS part, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS field,
               '{{"total_records":' || count(*) || ',"total_records_with_diff":'
               || count(*) FILTER (has_diff = 'true') || ',"records_with_diff_percent":'
               || round(count(*) FILTER (has_diff = 'true') / count(*) * 100, 2) || ',"sources":'
               || (SELECT count(*) FROM (SELECT DISTINCT source FROM named))
               || ',"fields_with_diffs":' || (SELECT count(DISTINCT field) FROM changes)
               || '}}' AS metrics FROM named
        UNION ALL SELECT 'source', source, NULL,
               '{{"count":' || count(*) FILTER (has_diff = 'true') || '}}' FROM named GROUP BY source
        UNION ALL SELECT 'field', NULL, field, '{{"count":' || count(*) || '}}'
               FROM changes GROUP BY field
        UNION ALL SELECT 'pair', source, field, '{{"count":' || count(*) || '}}'
               FROM changes GROUP BY source, field""",
    "final_records": _FINAL,
    "final_records_join": _FINAL,
    "matrix_sql": f"""
        WITH {ORDERS_SQL}, record_diff_matrix AS (
          SELECT source, CAST(missing AS INTEGER) AS a_or_b_missing, {_FIELD_LONGS} FROM records)
        SELECT source, count(*) AS n, CAST(sum(status) AS BIGINT) AS status_changes,
               CAST(sum(total) AS BIGINT) AS total_changes
        FROM record_diff_matrix WHERE a_or_b_missing = 0 GROUP BY source""",
    "records_view": orders("""
        SELECT has_diff, source, count(*) AS n, min(record_id) AS first_id,
               count(*) FILTER (d_status) AS status
        FROM records GROUP BY has_diff, source"""),
    "lookup_record": orders("""
        , wanted AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
                     WHERE o_totalprice < 490000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1)
        SELECT record_id,
               replace(replace(record_a, ',"', ', "'), '":', '": ') AS record_a,
               replace(replace(record_b, ',"', ', "'), '":', '": ') AS record_b
        FROM records WHERE record_id = (SELECT id FROM wanted)"""),
    "lookup_stored": orders("""
        SELECT record_id,
               replace(replace(record_a, ',"', ', "'), '":', '": ') AS record_a,
               replace(replace(record_b, ',"', ', "'), '":', '": ') AS record_b,
               CAST(len(string_split(fields, ',')) AS INTEGER) AS fields_changed,
               fields AS modified_fields
        FROM records WHERE record_id = (SELECT min(record_id) FROM records
                                        WHERE has_diff = 'true' AND NOT missing)"""),
    "record_summary": orders(f"""
        SELECT record_id,
               CAST(CASE WHEN fields = '' THEN 0 ELSE len(string_split(fields, ',')) END
                    AS INTEGER) AS fields_changed,
               fields AS modified_fields, {_ONLY_A} AS fields_only_in_a,
               {_ONLY_B} AS fields_only_in_b FROM records"""),
    "browse_page": documents("""
        , d AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE contains(text, 'the'))
        SELECT record_id, source, has_diff, '[' || replace(fields, ',', ', ') || ']' AS modified_fields
        FROM records WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src5', 'src6', 'src7', 'src8') AND contains(fields, 'stats')
          AND record_id IN (SELECT id FROM d)
        ORDER BY source DESC, record_id LIMIT 20 OFFSET 1"""),
    "browse_by_fields": orders("""
        SELECT record_id, source, has_diff, '[' || replace(fields, ',', ', ') || ']' AS modified_fields
        FROM records ORDER BY modified_fields, record_id LIMIT 25 OFFSET 100"""),
    "browse_jump": orders("""
        , rows AS (
            SELECT record_id, source, has_diff,
                   '[' || replace(fields, ',', ', ') || ']' AS modified_fields,
                   d_status OR d_total AS changed
            FROM records),
        whole AS (SELECT * EXCLUDE (changed), 'all' AS page FROM rows
                  ORDER BY source DESC NULLS LAST, record_id LIMIT 40 OFFSET 700),
        part AS (SELECT * EXCLUDE (changed), 'changed' AS page FROM rows WHERE changed
                 ORDER BY source DESC NULLS LAST, record_id LIMIT 30 OFFSET 150)
        SELECT * FROM whole UNION ALL SELECT * FROM part"""),
    "search_stored": documents("""
        , t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents),
        terms AS (SELECT unnest(['é', '100%_x', 'the', 'qu', 'nowhere to be found']) AS term)
        SELECT term, record_id FROM records JOIN t ON id = record_id
        JOIN terms ON contains(text, term)"""),
    "browse_filtered": orders("""
        SELECT record_id, source, has_diff, '[' || replace(fields, ',', ', ') || ']' AS modified_fields
        FROM records WHERE source IN ('1-URGENT', '5-LOW') AND (d_status OR d_total)
          AND (coalesce(contains(record_a, 'PENDING'), false)
               OR coalesce(contains(record_b, 'PENDING'), false))"""),
    "browse_counts": documents("""
        , t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents),
        r AS (SELECT * FROM records JOIN t ON id = record_id)
        SELECT 'wildcards' AS filter, count(*) AS records_total,
               count(*) FILTER (contains(text, '100%_x')) AS records_filtered FROM r
        UNION ALL SELECT 'accent', count(*),
               count(*) FILTER (contains(text, 'é') AND repeats) FROM r
        UNION ALL SELECT 'source', count(*), count(*) FILTER (source IN ('src0', 'src7')) FROM r
        UNION ALL SELECT 'none', count(*), count(*) FROM r"""),
    "manifest_parse": f"""
        WITH {_PATHS} SELECT path, event_type AS source, run_date, run_type, stage, action,
               idx AS "index", 'xml' AS file_type FROM paths""",
    "manifest_since_full": f"""{_CHOSEN}
        SELECT ordinal, source, daily, path, CAST(extract_date AS VARCHAR) AS extract_date
        FROM chosen""",
    "manifest_csv": f"{_CHOSEN} SELECT path FROM chosen",
    "extracted_listing": f"""
        WITH {_PATHS} SELECT event_type AS source, count(*) AS files FROM paths
        WHERE contains(path, 'extracted') GROUP BY event_type""",
    "version_labels": """
        SELECT event_id, CASE WHEN event_type = 'view' THEN 'a' ELSE 'b' END AS version
        FROM events""",
    "versions_applied": f"""
        WITH {_ALL_ORDERS_SQL}
        SELECT 'a' AS version, record_id, record_a AS transformed_record FROM joined
        UNION ALL SELECT 'b', record_id, record_b FROM joined""",
    "versions_lenient": """
        SELECT 'a' AS version, CAST(page_id AS VARCHAR) AS record_id, 'kept' AS outcome FROM pages
        UNION ALL SELECT 'b', CAST(page_id AS VARCHAR),
               CASE WHEN regexp_extract(url, '^https://([^/]+)', 1) <> '' THEN 'kept'
                    ELSE 'rejected' END FROM pages""",
    "write_read_back": orders("""
        SELECT source, has_diff, count(*) AS n, count(record_a) AS with_a,
               count(record_b) AS with_b FROM records GROUP BY source, has_diff"""),
    "version_scan": orders("""
        SELECT record_id, source, CAST(run_date AS VARCHAR) AS run_date, run_type, action,
               record_b AS transformed_record FROM joined WHERE in_b"""),
    "run_diff": _FINAL,
    "run_commits": f"""
        SELECT number, count(*) AS records, count(*) FILTER (has_diff = 'true') AS changed
        FROM ({_FINAL}) CROSS JOIN (SELECT CAST(unnest([0, 1]) AS BIGINT) AS number) GROUP BY number""",
    "compare_transforms": f"WITH {_ALL_ORDERS_SQL} {_FINAL_COLUMNS}",
    "labelled_versions": """
        SELECT version, outcome, count(*) AS n FROM (
          SELECT 'a' AS version, 'kept' AS outcome FROM pages
          UNION ALL SELECT 'b', CASE WHEN regexp_extract(url, '^https://([^/]+)', 1) <> ''
                                THEN 'kept' ELSE 'rejected' END FROM pages)
        GROUP BY version, outcome""",
    "versions_isolated": """
        SELECT 'a' AS version, CAST(page_id AS VARCHAR) AS record_id, NULL AS part,
               NULL AS message FROM pages
        UNION ALL SELECT 'b', CAST(page_id AS VARCHAR),
               CASE WHEN url NOT LIKE 'https://%' THEN CAST(page_id // 100 AS VARCHAR) END,
               CASE WHEN url NOT LIKE 'https://%' THEN 'ValueError: not secure: ' || url END
        FROM pages""",
    "compare_isolated": """
        SELECT CAST(page_id AS VARCHAR) AS record_id,
               CASE WHEN url LIKE 'https://%' THEN 'false' ELSE 'true' END AS has_diff,
               CASE WHEN url LIKE 'https://%' THEN 0 ELSE 1 END AS a_or_b_missing,
               '{"host":"' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '"}' AS record_a,
               CASE WHEN url LIKE 'https://%' THEN
                 '{"host":"' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '"}' END AS record_b
        FROM pages""",
    "run_history": _RUNS,
    "run_documents": f"""
        WITH {ORDERS_SQL},
        od AS (SELECT count(*) FILTER (has_diff = 'true') AS with_diff,
                      count(DISTINCT source) AS sources FROM records),
        toxic AS (SELECT doc_id FROM labels WHERE toxic = 1),
        dd AS (SELECT count(*) FILTER (doc_id IN (SELECT doc_id FROM toxic)
                        OR len(string_split(text, chr(10)))
                           <> len(list_distinct(string_split(text, chr(10))))) AS with_diff,
                      count(DISTINCT source) AS sources FROM documents)
        SELECT '2024-10-17 14:01:18' AS run_time, with_diff, sources FROM dd
        UNION ALL SELECT '2024-11-07 03:56:22', with_diff, sources FROM od""",
    "listed_manifest": _CHOSEN.replace("FROM paths p JOIN", "FROM (SELECT DISTINCT path FROM paths) p JOIN") + """
        SELECT ordinal, source, daily, path AS key, CAST(extract_date AS VARCHAR) AS extract_date
        FROM chosen""",
    "inventory_manifest": _CHOSEN.replace("FROM paths p JOIN", "FROM (SELECT DISTINCT path FROM paths) p JOIN") + """
        SELECT ordinal, source, daily, path AS key, CAST(extract_date AS VARCHAR) AS extract_date
        FROM chosen""",
    "browse_after": _page("modified_fields, record_id LIMIT 25 OFFSET 100"),
    "browse_by_id": _page("record_id DESC LIMIT 30"),
    "browse_by_flag": _page("has_diff DESC, record_id LIMIT 30 OFFSET 10"),
    "record_summary_strict": orders(f"""
        , wanted AS (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
                     ORDER BY o_totalprice, o_orderkey LIMIT 1)
        SELECT record_id,
               CAST(CASE WHEN fields = '' THEN 0 ELSE len(string_split(fields, ',')) END
                    AS INTEGER) AS fields_changed,
               fields AS modified_fields, {_ONLY_A} AS fields_only_in_a,
               {_ONLY_B} AS fields_only_in_b
        FROM records WHERE record_id = (SELECT id FROM wanted)"""),
    "manifest_list": """
        SELECT event_type AS path, row_number() OVER (ORDER BY event_type) - 1 AS line
        FROM (SELECT DISTINCT event_type FROM events)""",
}
