"""Views over the star schema, the event stream and the text tables with the schemas that the operators expect.

The SQL runs unchanged in Spark and in any engine that checks the results.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "chunks": r"""
SELECT CAST(doc_id AS STRING) AS chunk_id, source,
       CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'fastapi' WHEN 2 THEN 'cobol' WHEN 3 THEN 'irs' ELSE 'mumps' END AS artifact_type,
       text AS text_content, lang AS kind,
       TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS created_at
FROM documents
""",
    "vectors": r"""
SELECT CAST(vec_id AS STRING) AS chunk_id, 'm1' AS model, embedding, label,
       CASE CAST(label % 5 AS INT) WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'fastapi' WHEN 2 THEN 'cobol' WHEN 3 THEN 'irs' ELSE 'mumps' END AS artifact_type
FROM embeddings
""",
    "probes": r"""
SELECT 'rule_' || CAST(label AS STRING) AS rule_name, MIN(vec_id) AS vec_id FROM embeddings GROUP BY label
""",
    "gap_history": r"""
SELECT 'gap_' || CAST(user_id AS STRING) AS gap_id, event_id, event_type AS rule_id, 'Rule ' || event_type AS rule_name,
       CASE WHEN event_type = 'purchase' THEN 'CLOSED' ELSE 'OPEN' END AS status,
       CASE CAST(user_id % 4 AS INT) WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
       ts AS status_at, CASE WHEN event_type = 'purchase' THEN ts END AS closed_at
FROM events
""",
    "chunk_metrics": r"""
SELECT CAST(l.doc_id AS STRING) AS chunk_id, d.source, l.quality = 1 AS documented,
       CAST(l.doc_id % 100 AS DOUBLE) / 100 AS confidence_score,
       TIMESTAMP '2024-01-01 00:00:00' + l.doc_id * INTERVAL '30' MINUTE AS processed_at
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""",
    "ingestion_log": r"""
SELECT 'run_' || CAST(event_id AS STRING) AS run_id, event_type AS source_type, ts AS started_at,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       CAST(user_id AS BIGINT) AS files_processed, CAST(event_id % 50 AS BIGINT) AS rows_written,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS errors_count, value AS processing_duration_ms
FROM events
""",
    "requests": r"""
SELECT event_id AS request_id, 'GET:/' || event_type AS endpoint, ts, value AS duration_ms,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
       'agent_' || CAST(user_id % 7 AS STRING) AS user_agent, CAST(user_id AS STRING) AS client
FROM events
""",
    "gap_metrics": r"""
SELECT 'analysis_' || l_returnflag AS analysis_id, 'v1.0.' || CAST(l_linenumber % 2 AS STRING) AS ruleset_version,
       CAST(l_orderkey AS STRING) AS chunk_id,
       CASE CAST(l_suppkey % 5 AS INT) WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'fastapi' WHEN 2 THEN 'cobol' WHEN 3 THEN 'irs' ELSE 'mumps' END AS artifact_type,
       'rule_' || CAST(l_linenumber AS STRING) AS rule_name, l_discount >= 0.05 AS passed,
       ROUND(l_discount * 10, 2) AS metric_value, CAST(1 + l_partkey % 5 AS INT) AS severity, l_shipdate AS created_at
FROM lineitem
""",
    "source_text": r"""
SELECT 'cobol:' || CAST(p_partkey AS STRING) AS chunk_id, 'cobol' AS artifact_type,
       CASE WHEN p_partkey % 3 = 0 THEN '      * Description of the item record' || chr(10) ELSE '' END
       || CASE WHEN p_partkey % 7 = 0 THEN '       COPY ITEMCOPY.' || chr(10) ELSE '' END
       || '       01  ' || UPPER(REPLACE(p_name, ' ', '-')) || '.' || chr(10)
       || '           05  ITEM-ID PIC 9(9)' || CASE WHEN p_partkey % 2 = 0 THEN ' * key' ELSE '.' END || chr(10)
       || '           05  ITEM-SIZE PIC S9(' || CAST(p_size AS STRING) || ') COMP-3.' || chr(10)
       || '           05  ITEM-TYPE PIC X(25) OCCURS 3 TIMES.' || chr(10)
       || '               88  IS-KNOWN VALUE ''' || p_type || '''.'
       || CASE WHEN p_partkey % 5 = 0 THEN chr(10) || '      * PURPOSE: prices ' || p_name || chr(10) || CASE
         WHEN p_partkey % 2 = 0 THEN '      * INPUT: the item' || chr(10) || '      * OUTPUT: the price' || chr(10) ELSE '' END || '       PROCEDURE DIVISION.' || chr(10) || '       MAIN SECTION.' ELSE '' END AS text_content,
       CAST(NULL AS STRING) AS metadata
FROM part
UNION ALL
SELECT 'fastapi:' || CAST(o_orderkey AS STRING), 'fastapi',
       '@app.' || CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'delete' END || '("/orders/' || CAST(o_custkey AS STRING) || '"'
       || CASE WHEN o_orderkey % 4 = 0 THEN ', response_model=Order' ELSE '' END || ')' || chr(10) || 'def handler():' || chr(10)
       || CASE WHEN o_orderkey % 2 = 0 THEN '    ' || repeat('"', 3) || 'Return order ' || o_orderpriority || CASE
         WHEN o_orderkey % 8 = 0 THEN ' with all parameters, responses and usage examples' ELSE '' END || repeat('"', 3) || chr(10) ELSE '' END
       || CASE WHEN o_orderkey % 5 = 0 THEN '    try:' || chr(10) || '        pass' || chr(10) || '    except ValueError:' || chr(10) || '        raise HTTPException(status_code=404)' ELSE '    return 1' END,
       CAST(NULL AS STRING)
FROM orders
UNION ALL
SELECT 'irs:' || CAST(s_suppkey AS STRING), 'irs',
       'IRS Individual Master File Record Layout' || chr(10) || 'Record Type: Individual (Type 01)' || chr(10) || 'Layout Version: 2024.' ||
         CAST(s_nationkey AS STRING) || chr(10)
       || CASE WHEN s_suppkey % 2 = 0 THEN 'Field Name: ID' || chr(10) || 'Description: number' || chr(10) ELSE '' END
       || CASE WHEN s_suppkey % 3 = 0 THEN 'Format: numeric' || chr(10) || 'Position: 001' || chr(10) ELSE '' END
       || 'Field Definitions:' || chr(10)
       || '001-009  Social Security Number  PIC 9(09)  NUMERIC  Required  Section: IDENTITY' || chr(10)
       || '010-0' || CAST(20 + s_nationkey AS STRING) || '  Taxpayer Name  PIC X(20)  ALPHA  Optional  Section: IDENTITY' || chr(10)
       || '060-070  Total Tax  PIC S9(09)V99  PACKED  Required  Section: TAX_INFO',
       CAST(NULL AS STRING)
FROM supplier
UNION ALL
SELECT 'mumps:' || CAST(c_custkey AS STRING), 'mumps',
       CASE WHEN c_custkey % 5 = 0 THEN 'CUST ;' || c_mktsegment || chr(10) || ' ;;1.0;MAIN;FILE' || chr(10) || ' ;; PURPOSE: looks a customer up' || chr(10) ||
         CASE WHEN c_custkey % 2 = 0 THEN ' ;; INPUT: number' || chr(10) || ' ;; OUTPUT: name' || chr(10) ELSE '' END ELSE '' END
       || '^DD(' || CAST(c_nationkey AS STRING) || ',.01,0)="NAME^RF^^0;1^K:$L(X)>30 X"' || chr(10)
       || CASE WHEN c_custkey % 2 = 0 THEN 'TYPE: FREE TEXT' || chr(10) ELSE '' END
       || CASE WHEN c_custkey % 3 = 0 THEN 'HELP-PROMPT: "Answer must be text"' || chr(10) ELSE '' END
       || '^DPT(' || CAST(c_custkey AS STRING) || ',"B")="' || c_mktsegment || '"',
       CAST(NULL AS STRING)
FROM customer
UNION ALL
SELECT 'kubernetes:' || CAST(s_suppkey AS STRING), 'kubernetes',
  'apiVersion: apps/v1' || chr(10) || 'kind: Deployment' || chr(10) || 'metadata:' || chr(10) || '  name: ' || LOWER(REPLACE(s_name, '#', '-')),
       '{"annotations":{' || CASE WHEN s_suppkey % 2 = 0 THEN '"description":"Serves orders for ' || s_name || '"' ELSE '' END || '},"labels":{"app":"' || s_name || '"},'
       || '"spec":{"template":{"spec":{"securityContext":{"runAsNonRoot":' || CASE
         WHEN s_suppkey % 3 = 0 THEN 'true' ELSE 'false' END || '},"containers":[{"resources":{'
       || CASE WHEN s_suppkey % 4 = 0 THEN '"limits":{"cpu":"1"}' ELSE '' END || '},"securityContext":{"allowPrivilegeEscalation":false,"readOnlyRootFilesystem":true}}]}}}}'
FROM supplier
""",
    "files": """
SELECT url AS path, html AS text FROM pages
""",
    "turns": """
SELECT conv_id, turn, role, text FROM conversations
""",
    "snapshots": """
SELECT CAST(ts AS DATE) AS snapshot_date, 'run_' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
       CAST(ROUND(100.0 * SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / COUNT(*), 6) AS DOUBLE) AS coverage_pct,
       CAST(SUM(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS open_gaps,
       CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS closed_gaps,
       CAST(ROUND(AVG(CAST(user_id % 100 AS DOUBLE)) / 100, 6) AS DOUBLE) AS mean_confidence
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-30' GROUP BY CAST(ts AS DATE)
""",
}


class Tables:
    """Tables and views of one data folder as DataFrames: ``Tables(spark, folder).chunks``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name].replace("{", "{{").replace("}", "}}")
        used = [b for b in BASE if re.search(rf"\b(?:FROM|JOIN) {b}\b", sql)]
        for b in used:
            sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
        return self.spark.sql(sql, **{b: getattr(self, b) for b in used})


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the definitions of the views that it reads."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names) + "\n" + sql.strip() if names else sql.strip()
