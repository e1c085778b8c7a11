"""The expected result of each query as SQL on the given tables.

The fields of log lines, model elements and dumps are taken straight from the tables (FIXTURES.md),
not from text, so these statements share no parsing with the library.
"""

from __future__ import annotations

# Fixed values, as FIXTURES.md has them: element names of the design model.
LINK_TAGS = ("Link", "OKLink", "KOLink")
DISPLAY_TAGS = (
    "PowerIndexUnit",
    "IndexUnit",
    "HierarchicalIndexUnit",
    "DataUnit",
    "MultiDataUnit",
    "EventCalendarUnit",
    "MultiChoiceIndexUnit",
)
ENTITY_TAGS = ("SelectorUnit", "EntryUnit", "MultiEntryUnit")
UNIT_TAGS = (
    *DISPLAY_TAGS,
    *ENTITY_TAGS,
    "ModuleInstanceUnit",
    "MultiMessageUnit",
    "NoOpContentUnit",
    "TimeUnit",
    "GetUnit",
)


def _list(texts) -> str:
    return ", ".join(f"'{t}'" for t in texts)


CTES = {
    "clicks": """
        SELECT date_trunc('second', ts) AS time, user_id AS u, event_type AS et, k, k % 10 AS m,
               CASE WHEN user_id % 10 = 9 THEN '-' ELSE 's' || user_id || 'd' || day(ts) END AS session,
               CASE WHEN event_type = 'view' AND k % 10 = 3 THEN 'mpage' || (user_id % 28)
                    ELSE 'page' || ((3 * user_id + k % 10 % 4) // 4) END AS page,
               'page' || ((3 * user_id + k % 10 % 3) // 4) AS sp,
               'ln' || (14 * user_id + 2 * (k % 10)) AS link,
               2 * user_id // 3 AS e, 13 * user_id + k AS oid
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
    """,
    "lines": """
        SELECT * FROM clicks UNION ALL SELECT * FROM clicks WHERE m = 5
    """,
    "access": """
        SELECT shape, '10.0.0.' || u AS ip, time, session AS session_id, page AS requested_page_id,
               CASE shape WHEN 1 THEN sp WHEN 4 THEN sp WHEN 2 THEN page END AS source_page_id,
               CASE WHEN shape <= 2 THEN link END AS clicked_link_id,
               CASE WHEN shape <= 2 THEN 'att' || (10 * e + m % 4) END AS clicked_attribute_id,
               CASE WHEN shape > 2 THEN 0 WHEN k <> 97 THEN oid END AS clicked_oid
        FROM (SELECT *, CASE et WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'view' THEN 3
                                WHEN 'signup' THEN 5 ELSE 4 END AS shape
              FROM lines WHERE et <> 'error' OR m <> 7)
    """,
    "runtime": """
        SELECT shape, time, 'INFO' AS log_level, 'h1' AS host, 'com.x.Unit' AS java_class,
               session AS session_id, CASE WHEN shape <> 4 AND k % 3 = 0 THEN 'm1' END AS miu_id,
               page AS page_id, CASE WHEN shape <> 4 THEN 'dau' || e END AS unit_id,
               CASE WHEN shape <= 2 THEN 't-1' END AS trace,
               CASE shape WHEN 1 THEN ' shown {oid=[' || (oid + 1) || ', ' || (oid + 2) || ']}'
                          WHEN 2 THEN ' done {}' WHEN 3 THEN 'started' ELSE 'no unit' END AS message,
               CASE WHEN shape = 1 THEN [oid + 1, oid + 2] END AS oids
        FROM (SELECT *, CASE k % 8 WHEN 0 THEN 2 WHEN 4 THEN 3 WHEN 6 THEN 4 ELSE 1 END AS shape
              FROM lines WHERE et IN ('view', 'click') AND session <> '-')
        UNION ALL
        SELECT 1, time, 'INFO', 'h1', 'com.x.Unit', session, NULL, page, 'dau' || e, 't-1',
               ' shown {oid=[x, ' || (oid + 1) || ']}', [NULL, oid + 1]
        FROM lines WHERE et = 'error' AND m = 6 AND session <> '-'
    """,
    "other_runtime": """
        SELECT CASE WHEN m = 7 OR session = '-' THEN 0 ELSE 1 END AS shape, m = 8 AND session <> '-' AS no_date,
               time, u, k, session, page, e, oid
        FROM lines
        WHERE et = 'error' AND m IN (7, 8) OR session = '-' AND (et IN ('view', 'click') OR et = 'error' AND m = 6)
    """,
    "site_pages": """
        SELECT 'page' || s_suppkey AS page_id, s_name AS page_name, 'Page' AS kind FROM supplier
        UNION ALL SELECT 'page' || s_suppkey, 'A ' || s_name, 'Page' FROM supplier WHERE s_suppkey % 10 = 3
        UNION ALL SELECT 'mpage' || n_nationkey, n_name, 'MasterPage' FROM nation
    """,
    "named_pages": """
        SELECT page_id, min(page_name) AS page_name FROM site_pages GROUP BY page_id
    """,
    "site_links": f"""
        SELECT 'ln' || p_partkey AS link_id, p_name AS link_name, 'dau' || (p_partkey // 20) AS target_unit,
               ([{_list(LINK_TAGS)}])[p_partkey % {len(LINK_TAGS)} + 1] AS kind
        FROM part
    """,
    "site_units": f"""
        SELECT 'dau' || s AS unit_id, 'Box of ' || name AS unit_name,
               CASE WHEN kind IN ({_list(DISPLAY_TAGS + ENTITY_TAGS)}) THEN 'dm#ent' || s END AS entity_id,
               CASE WHEN j IS NOT NULL THEN 'att' || (10 * s + j) END AS displayed_attribute, kind
        FROM (SELECT s_suppkey AS s, s_name AS name,
                     ([{_list(UNIT_TAGS)}])[s_suppkey % {len(UNIT_TAGS)} + 1] AS kind FROM supplier)
        LEFT JOIN (VALUES (0), (1), (2)) AS t(j) ON kind IN ({_list(DISPLAY_TAGS)})
    """,
    "site_attributes": """
        SELECT 'dm#ent' || s_suppkey AS entity_id, table_db, 'Kind ' || s_suppkey AS entity_name,
               'att' || (10 * s_suppkey + j) AS attribute_id, lower(col) AS attribute_name,
               col AS attribute_database_column
        FROM supplier JOIN (VALUES (0, 'PART', 0, 'NAME'), (0, 'PART', 1, 'CATEGORY'), (0, 'PART', 2, 'BRAND'),
                                   (1, 'CUSTOMER', 0, 'NAME'), (1, 'CUSTOMER', 1, 'CATEGORY'),
                                   (2, 'ORDER', 0, 'TITLE'), (2, 'ORDER', 1, 'STATUS')) AS t(i, table_db, j, col)
             ON s_suppkey % 3 = i
        UNION ALL
        SELECT 'dm#ent' || s_suppkey, 'CUSTOMER', 'Kind ' || s_suppkey, 'att' || (10 * s_suppkey), 'name', 'NAME'
        FROM supplier WHERE s_suppkey % 6 = 0
        UNION ALL
        SELECT 'dm#ent' || s_suppkey, 'CUSTOMER', 'Other ' || s_suppkey, 'att' || (10 * s_suppkey + j), lower(col), col
        FROM supplier, (VALUES (0, 'NAME'), (1, 'CATEGORY')) AS t(j, col) WHERE s_suppkey % 6 = 1
    """,
    "stored": """
        SELECT 'PART' AS value_table, 'NAME' AS value_column, p_partkey AS oid,
               CASE WHEN p_partkey % 10 = 1 THEN least(p_name, 'A ' || p_name) ELSE p_name END AS value FROM part
        UNION ALL SELECT 'PART', 'CATEGORY', p_partkey, p_type FROM part
        UNION ALL SELECT 'PART', 'BRAND', p_partkey, p_brand FROM part
        UNION ALL SELECT 'CUSTOMER', 'NAME', c_custkey, c_name FROM customer
        UNION ALL SELECT 'CUSTOMER', 'CATEGORY', c_custkey, c_mktsegment FROM customer
        UNION ALL SELECT 'ORDER', 'TITLE', o_orderkey, o_orderpriority FROM orders
        UNION ALL SELECT 'ORDER', 'STATUS', o_orderkey, o_orderstatus FROM orders
    """,
    "combined": """
        SELECT DISTINCT u.unit_id, u.unit_name, a.*
        FROM site_units u JOIN site_attributes a
             ON u.entity_id = a.entity_id AND u.displayed_attribute = a.attribute_id
    """,
    "shown_columns": """
        SELECT DISTINCT entity_id, table_db, attribute_database_column FROM combined
    """,
    "hits": """
        SELECT DISTINCT * EXCLUDE (shape) FROM access
    """,
    "known_hits": """
        SELECT hits.*, page_name AS requested_page_name FROM hits JOIN named_pages ON requested_page_id = page_id
    """,
    "entity_hits": """
        SELECT h.*, entity_id AS clicked_entity_id, entity_name AS clicked_entity_name
        FROM known_hits h
        LEFT JOIN (SELECT DISTINCT attribute_id, entity_id, entity_name FROM site_attributes)
             ON clicked_attribute_id = attribute_id
    """,
    "source_hits": """
        SELECT h.*, page_name AS source_page_name FROM entity_hits h LEFT JOIN named_pages ON source_page_id = page_id
    """,
    "column_hits": """
        SELECT h.*, table_db AS clicked_table, attribute_database_column AS clicked_column
        FROM source_hits h LEFT JOIN shown_columns ON clicked_entity_id = entity_id AND clicked_oid <> 0
    """,
    "link_hits": """
        SELECT h.*, link_name AS clicked_link_name, target_unit
        FROM column_hits h LEFT JOIN site_links ON clicked_link_id = link_id
    """,
    "valued_hits": """
        SELECT DISTINCT h.* EXCLUDE (clicked_table, clicked_column),
               CASE WHEN clicked_oid <> 0 THEN clicked_column END AS clicked_type_oid, value AS clicked_oid_value
        FROM link_hits h LEFT JOIN stored
             ON clicked_oid <> 0 AND clicked_oid = oid AND clicked_table = value_table AND clicked_column = value_column
    """,
    "shown": """
        SELECT DISTINCT * FROM (
            SELECT * EXCLUDE (shape, oids, page_id), page_id AS displayed_page_id, unnest(oids) AS oid FROM runtime)
        WHERE oid IS NOT NULL
    """,
    "page_shown": """
        SELECT shown.*, page_name AS displayed_page_name FROM shown JOIN named_pages ON displayed_page_id = page_id
    """,
    "unit_shown": """
        SELECT p.*, unit_name AS displayed_unit_name, entity_id AS displayed_entity_id,
               entity_name AS displayed_entity_name, table_db, attribute_id AS displayed_attribute_id,
               attribute_name AS displayed_attribute_name, attribute_database_column
        FROM page_shown p JOIN combined USING (unit_id)
    """,
    "valued_shown": """
        SELECT DISTINCT u.*, table_db AS value_table, u.oid AS displayed_oid,
               attribute_database_column AS displayed_type_oid, value AS displayed_oid_value
        FROM unit_shown u LEFT JOIN stored
             ON u.oid = stored.oid AND table_db = stored.value_table AND attribute_database_column = value_column
    """,
    "enriched": """
        SELECT DISTINCT h.*, s.* EXCLUDE (time, session_id)
        FROM valued_hits h LEFT JOIN valued_shown s
             ON h.time = s.time AND h.session_id = s.session_id AND h.requested_page_id = s.displayed_page_id
    """,
    "exits": """
        SELECT session_id, arg_max(requested_page_id || ': ' || requested_page_name,
                                   (epoch(time)::BIGINT, requested_page_id)) AS unit_id
        FROM enriched GROUP BY session_id
    """,
    "entries": """
        SELECT session_id, arg_min(requested_page_id || ': ' || requested_page_name,
                                   (epoch(time)::BIGINT, requested_page_id)) AS unit_id
        FROM enriched GROUP BY session_id
    """,
    "bounce": """
        SELECT unit_id, count(*) / (SELECT count(*) FROM exits) AS bounce_rate FROM exits GROUP BY unit_id
    """,
    "entrance": """
        SELECT unit_id, count(*) / (SELECT count(*) FROM entries) AS entrance_rate FROM entries GROUP BY unit_id
    """,
    "visits": """
        SELECT requested_page_id || ': ' || requested_page_name AS unit_id,
               count(DISTINCT (time, session_id)) / (SELECT count(*) FROM (SELECT DISTINCT session_id FROM enriched))
                   AS average_visits_per_session
        FROM enriched GROUP BY requested_page_id, requested_page_name
    """,
    "flow": """
        SELECT time, requested_page_id, session_id, source_page_id, min(requested_page_name) AS requested_page_name
        FROM enriched GROUP BY ALL
    """,
    "next_page": """
        SELECT time, requested_page_id, requested_page_name, session_id, nxt.t AS next_time, nxt.p AS next_page_id
        FROM (SELECT a.time, a.requested_page_id, a.requested_page_name, a.session_id,
                     min({'t': b.time, 'p': b.requested_page_id}) AS nxt
              FROM (SELECT DISTINCT * EXCLUDE (source_page_id) FROM flow) a
              JOIN (SELECT DISTINCT time, session_id, requested_page_id FROM flow) b
                   ON a.session_id = b.session_id AND a.requested_page_id <> b.requested_page_id
                  AND b.time > a.time AND epoch(b.time) < epoch(a.time) + 3600
              GROUP BY ALL)
    """,
    "stays": """
        SELECT requested_page_id || ': ' || requested_page_name AS unit_id,
               (epoch(next_time) - epoch(min(time)))::BIGINT AS seconds
        FROM next_page GROUP BY requested_page_id, requested_page_name, next_time, next_page_id, session_id
    """,
    "residence": """
        SELECT unit_id, sum(seconds)::BIGINT / count(*) AS residence_time FROM stays GROUP BY unit_id
    """,
    "steps": """
        SELECT source_page_id, requested_page_id, clicked_link_id, clicked_link_name,
               count(DISTINCT (time, session_id)) AS clicks
        FROM enriched
        WHERE clicked_link_id IS NOT NULL AND source_page_id <> requested_page_id
        GROUP BY ALL
    """,
    "link_out": """
        SELECT source_page_id, requested_page_id, clicked_link_id || ': ' || clicked_link_name AS unit_id,
               clicks / sum(clicks) OVER (PARTITION BY source_page_id) AS link_out
        FROM steps
    """,
    "link_in": """
        SELECT source_page_id, requested_page_id, clicked_link_id || ': ' || clicked_link_name AS unit_id,
               clicks / sum(clicks) OVER (PARTITION BY requested_page_id) AS link_in
        FROM steps
    """,
    "shown_values": """
        SELECT unit_id, displayed_unit_name, displayed_oid_value AS value,
               count(DISTINCT (time, session_id, displayed_attribute_name))::BIGINT AS n
        FROM enriched
        WHERE displayed_oid_value <> 'NULL' AND displayed_attribute_name IN ('name', 'title', 'category')
        GROUP BY ALL
    """,
    "clicked_values": """
        SELECT clicked_link_id, clicked_link_name, clicked_oid_value AS value,
               count(DISTINCT (time, session_id, clicked_type_oid))::BIGINT AS n
        FROM enriched
        WHERE clicked_oid_value <> 'NULL' AND clicked_link_name IS NOT NULL
              AND clicked_type_oid IN ('NAME', 'TITLE', 'CATEGORY')
        GROUP BY ALL
    """,
    "top_shown": """
        SELECT unit_id || ': ' || displayed_unit_name AS unit_id,
               list(value || ': ' || n ORDER BY n DESC, value)[1:10] AS entries
        FROM shown_values GROUP BY shown_values.unit_id, displayed_unit_name
    """,
    "top_clicked": """
        SELECT clicked_link_id || ': ' || clicked_link_name AS unit_id,
               list(value || ': ' || n ORDER BY n DESC, value)[1:10] AS entries
        FROM clicked_values GROUP BY clicked_link_id, clicked_link_name
    """,
    "unused_runtime": """
        SELECT CASE WHEN session = '-' OR m = 7 AND et = 'error' THEN 0 ELSE 1 END AS shape,
               CASE WHEN et = 'error' AND m = 7 THEN 'java.lang.IllegalStateException: ' || k
                    ELSE CASE WHEN et = 'error' AND m = 8 THEN '31 Feb 2024 10:00:00'
                              ELSE strftime(time, '%d %b %Y %H:%M:%S') END
                         || ',123  INFO [h1]  (com.x.Unit) - [' || session || ']'
                         || CASE WHEN et = 'error' AND m = 8 THEN '[' || page || '][dau' || e || '][step][t-1] shown {oid=[1, 2]}'
                                 WHEN et = 'error' THEN '[' || page || '][dau' || e || '][step][t-1] shown {oid=[x, ' || (oid + 1) || ']}'
                                 WHEN k % 8 = 6 THEN '[' || page || ']no unit'
                                 ELSE CASE WHEN k % 3 = 0 THEN '[m1]' ELSE '' END || '[' || page || '][dau' || e || ']'
                                      || CASE k % 8 WHEN 0 THEN '[step][t-1] done {}' WHEN 4 THEN 'started'
                                              ELSE '[step][t-1] shown {oid=[' || (oid + 1) || ', ' || (oid + 2) || ']}' END
                            END
               END AS value
        FROM lines
        WHERE et = 'error' AND m IN (7, 8) OR session = '-' AND (et IN ('view', 'click') OR et = 'error' AND m = 6)
    """,
    "unused_access": """
        SELECT CASE m WHEN 7 THEN 0 ELSE 3 END AS shape,
               CASE m WHEN 7 THEN '10.0.0.' || u || ' - - [' || strftime(time, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /app/login'
                      ELSE '10.0.0.1 - - [31/Feb/2024:10:00:00 +0000] "GET /app/' || page END
               || '.do HTTP/1.1" 200 512 ' || session AS value
        FROM lines WHERE et = 'error' AND m IN (7, 8)
    """,
    "report": """
        SELECT unit_id, residence_time, average_visits_per_session, bounce_rate, entrance_rate,
               round(o.link_out, 9)::DOUBLE AS link_out, round(i.link_in, 9)::DOUBLE AS link_in,
               array_to_string(c.entries, '|') AS top10_clicked_instances,
               array_to_string(d.entries, '|') AS top10_displayed_instances
        FROM residence
        FULL JOIN visits USING (unit_id)
        FULL JOIN bounce USING (unit_id)
        FULL JOIN entrance USING (unit_id)
        FULL JOIN (SELECT unit_id, sum(link_out::DECIMAL(28,12)) AS link_out FROM link_out WHERE unit_id IS NOT NULL GROUP BY 1) o
             USING (unit_id)
        FULL JOIN (SELECT unit_id, sum(link_in::DECIMAL(28,12)) AS link_in FROM link_in WHERE unit_id IS NOT NULL GROUP BY 1) i
             USING (unit_id)
        FULL JOIN top_clicked c USING (unit_id)
        FULL JOIN top_shown d USING (unit_id)
    """,
}

TIME = "strftime(time, '%Y-%m-%d %H:%M:%S') AS time"
TIMED = f"* REPLACE ({TIME})"

SELECTS = {
    "model_pages": "SELECT * FROM site_pages",
    "model_links": "SELECT * FROM site_links",
    "model_units": "SELECT * FROM site_units",
    "data_model_attributes": "SELECT * FROM site_attributes",
    "db_dump_scan": """
        SELECT 'PART' AS table_name, p_partkey::VARCHAR AS oid, p_name AS name, p_type AS category, p_brand AS brand,
               NULL::VARCHAR AS title, NULL::VARCHAR AS status FROM part
        UNION ALL SELECT 'PART', p_partkey::VARCHAR, 'A ' || p_name, p_type, p_brand, NULL, NULL
        FROM part WHERE p_partkey % 10 = 1
        UNION ALL SELECT 'CUSTOMER', c_custkey::VARCHAR, c_name, c_mktsegment, NULL, NULL, NULL FROM customer
        UNION ALL SELECT 'ORDER', o_orderkey::VARCHAR, NULL, NULL, NULL, o_orderpriority, o_orderstatus FROM orders
    """,
    "combined_model": "SELECT * FROM combined",
    "last_segment": """
        SELECT page_id, split_part(rtrim(url, '/'), '/', -1) AS after_slash,
               split_part(rtrim(url, '.'), '.', -1) AS after_dot FROM pages
    """,
    "access_log_parse": f"SELECT {TIMED} FROM access",
    "access_log_shapes": """
        SELECT shape, count(*) AS lines
        FROM (SELECT shape FROM access
              UNION ALL SELECT 3 FROM lines WHERE et = 'error' AND m = 8
              UNION ALL SELECT 0 FROM lines WHERE et = 'error' AND m = 7)
        GROUP BY shape
    """,
    "runtime_log_shapes": """
        SELECT shape, count(*) AS lines
        FROM (SELECT shape FROM runtime UNION ALL SELECT shape FROM other_runtime)
        GROUP BY shape
    """,
    "rejected_lines": """
        SELECT 'access' AS log, shape, count(*) AS lines, count(*) FILTER (kind = 'date') AS bad_dates,
               count(*) FILTER (kind = 'object') AS bad_objects
        FROM (SELECT shape, CASE WHEN clicked_oid IS NULL THEN 'object' END AS kind FROM access
              UNION ALL SELECT 3, 'date' FROM lines WHERE et = 'error' AND m = 8
              UNION ALL SELECT 0, NULL FROM lines WHERE et = 'error' AND m = 7)
        GROUP BY shape
        UNION ALL
        SELECT 'runtime', shape, count(*), count(*) FILTER (kind = 'date'), count(*) FILTER (kind = 'object')
        FROM (SELECT shape, CASE WHEN message LIKE '%[x, %' THEN 'object' END AS kind FROM runtime
              UNION ALL SELECT shape, CASE WHEN no_date THEN 'date' END FROM other_runtime)
        GROUP BY shape
    """,
    "log_files_scan": f"""
        SELECT 'access' AS log, shape, {TIME}, session_id, requested_page_id AS page_id FROM access
        UNION ALL SELECT 'runtime', shape, strftime(time, '%Y-%m-%d %H:%M:%S'), session_id, page_id FROM runtime
    """,
    "runtime_log_parse": f"SELECT * REPLACE ({TIME}, array_to_string(oids, ',') AS oids) FROM runtime",
    "runtime_oids": f"""
        SELECT * FROM (
            SELECT * EXCLUDE (shape, oids, page_id) REPLACE ({TIME}), page_id AS displayed_page_id, unnest(oids) AS oid
            FROM runtime)
        WHERE oid IS NOT NULL
    """,
    "hits_requested_page": f"SELECT {TIMED} FROM known_hits",
    "hits_clicked_entity": f"SELECT {TIMED} FROM entity_hits",
    "hits_source_page": f"SELECT {TIMED} FROM source_hits",
    "hits_models": f"SELECT {TIMED} FROM column_hits",
    "hits_links": f"SELECT {TIMED} FROM link_hits",
    "runtime_pages": f"SELECT {TIMED} FROM page_shown",
    "runtime_enriched": f"SELECT {TIMED} FROM unit_shown",
    "oid_values": """
        SELECT k.oid, k.value_table, k.value_column, value
        FROM (SELECT clicked_oid AS oid, clicked_table AS value_table, clicked_column AS value_column
              FROM link_hits WHERE clicked_oid <> 0
              UNION SELECT oid, table_db, attribute_database_column FROM unit_shown) k
        LEFT JOIN stored s ON k.oid = s.oid AND k.value_table = s.value_table AND k.value_column = s.value_column
    """,
    "oid_values_joined": f"""
        SELECT 'access' AS log, {TIME}, session_id, clicked_oid AS oid, clicked_type_oid AS type_oid,
               clicked_oid_value AS oid_value FROM valued_hits
        UNION ALL
        SELECT 'runtime', strftime(time, '%Y-%m-%d %H:%M:%S'), session_id, displayed_oid, displayed_type_oid,
               displayed_oid_value FROM valued_shown
    """,
    "enriched_log": f"SELECT {TIMED} FROM enriched",
    "enriched_roundtrip": f"SELECT {TIMED} FROM enriched",
    "incremental_cutoff": """
        SELECT batch, count(*) AS rows, strftime(min(time), '%Y-%m-%d %H:%M:%S') AS first_time,
               strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_time, 1::BIGINT AS moments
        FROM (SELECT time, CASE WHEN time < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END::BIGINT AS batch FROM enriched)
        GROUP BY batch
    """,
    "late_arrival": f"SELECT {TIMED} FROM enriched",
    "compacted_log": f"SELECT {TIMED} FROM enriched",
    "reports_by_day": "SELECT * FROM report",
    "session_state": """
        SELECT session_id, strftime(f.time, '%Y-%m-%d %H:%M:%S') AS first_time, f.p AS first_requested_page_id,
               f.n AS first_requested_page_name, strftime(l.time, '%Y-%m-%d %H:%M:%S') AS last_time,
               l.p AS last_requested_page_id, l.n AS last_requested_page_name
        FROM (SELECT session_id, min({'time': time, 'p': requested_page_id, 'n': requested_page_name}) AS f,
                     max({'time': time, 'p': requested_page_id, 'n': requested_page_name}) AS l
              FROM enriched GROUP BY session_id)
    """,
    "residence_by_day": """
        SELECT requested_page_id, requested_page_name, sum(seconds)::BIGINT AS seconds, count(*) AS stays,
               strftime(next_time, '%Y-%m-%d') AS event_date
        FROM (SELECT requested_page_id, requested_page_name, next_time,
                     (epoch(next_time) - epoch(min(time)))::BIGINT AS seconds
              FROM next_page GROUP BY requested_page_id, requested_page_name, next_time, next_page_id, session_id)
        GROUP BY requested_page_id, requested_page_name, strftime(next_time, '%Y-%m-%d')
    """,
    "value_store": """
        SELECT oid, value_table, value_column, value FROM stored
        UNION ALL SELECT DISTINCT oid, value_table, 'OID', oid::VARCHAR FROM stored
    """,
    "quarantined_lines": """
        SELECT 'access' AS log, shape, value, 0::BIGINT AS batch FROM unused_access
        UNION ALL SELECT 'runtime', shape, value, 0 FROM unused_runtime
    """,
    "bounce_rate": "SELECT * FROM bounce",
    "entrance_rate": "SELECT * FROM entrance",
    "average_visits": "SELECT * FROM visits",
    "page_flow": f"SELECT {TIMED} FROM flow",
    "next_navigation": f"""
        SELECT * REPLACE ({TIME}, strftime(next_time, '%Y-%m-%d %H:%M:%S') AS next_time) FROM next_page
    """,
    "residence_time": "SELECT * FROM residence",
    "link_counts": "SELECT * FROM steps",
    "link_counts_merged": """
        SELECT source_page_id, requested_page_id, clicked_link_id, clicked_link_name, count(DISTINCT time) AS clicks
        FROM enriched
        WHERE clicked_link_id IS NOT NULL AND source_page_id <> requested_page_id
        GROUP BY ALL
    """,
    "residence_time_merged": """
        SELECT unit_id, sum(seconds)::BIGINT / count(*) AS residence_time
        FROM (SELECT requested_page_id || ': ' || requested_page_name AS unit_id,
                     (epoch(next_time) - epoch(min(time)))::BIGINT AS seconds
              FROM next_page GROUP BY requested_page_id, requested_page_name, next_time, next_page_id)
        GROUP BY unit_id
    """,
    "displayed_counts_merged": """
        SELECT unit_id, displayed_unit_name, displayed_oid_value AS value,
               count(DISTINCT (time, displayed_attribute_name))::BIGINT AS n
        FROM enriched
        WHERE displayed_oid_value <> 'NULL' AND displayed_attribute_name IN ('name', 'title', 'category')
        GROUP BY ALL
    """,
    "clicked_counts_merged": """
        SELECT clicked_link_id, clicked_link_name, clicked_oid_value AS value,
               count(DISTINCT (time, clicked_type_oid))::BIGINT AS n
        FROM enriched
        WHERE clicked_oid_value <> 'NULL' AND clicked_link_name IS NOT NULL
              AND clicked_type_oid IN ('NAME', 'TITLE', 'CATEGORY')
        GROUP BY ALL
    """,
    "output_link": "SELECT * FROM link_out",
    "input_link": "SELECT * FROM link_in",
    "displayed_counts": "SELECT * FROM shown_values",
    "clicked_counts": "SELECT * FROM clicked_values",
    "top10_displayed": "SELECT unit_id, array_to_string(entries, '|') AS top10_displayed_instances FROM top_shown",
    "top10_clicked": "SELECT unit_id, array_to_string(entries, '|') AS top10_clicked_instances FROM top_clicked",
    "combined_analysis": "SELECT * FROM report",
    "sink_parquet": "SELECT * FROM visits",
    "sink_csv": "SELECT unit_id, to_json(entries)::VARCHAR AS top10_displayed_instances FROM top_shown",
    "sink_json": "SELECT * FROM report",
}


def _with(name: str) -> str:
    ctes = ",\n".join(f"{cte} AS ({sql.strip()})" for cte, sql in CTES.items())
    return f"WITH {ctes}\n{SELECTS[name].strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: _with(name) for name in SELECTS}
