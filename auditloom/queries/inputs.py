"""Inputs that the queries derive from the given tables; the texts run on both sides of a comparison."""

from __future__ import annotations

#: Documents with a file name, a language and a list of checks.
DOCUMENTS = """
SELECT doc_id, (CASE WHEN lang = 'de' THEN '文档_' ELSE 'doc_' END) || cast(doc_id AS string) || '.' || (CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN 'PDF' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'chm' ELSE 'pptx' END) AS file_name,
  text, (CASE doc_id % 4 WHEN 0 THEN 'scanItem5001, scanItem99999' WHEN 1 THEN 'scanItem99999,scanItem6002,scanItem1001' WHEN 2 THEN NULL ELSE ' scanItem5002 ,scanItem404,scanItem5002' END) AS items
FROM {documents}"""

#: Findings: users are files, kinds of events are checks.
FINDINGS = """
SELECT event_id AS finding_id, user_id % 7 AS task_id, event_id AS seq, 'doc_' || cast(user_id AS string) || '.md' AS file_name,
  CASE event_type WHEN 'view' THEN 'scanItem5001' WHEN 'signup' THEN 'scanItem5002' WHEN 'purchase' THEN 'scanItem6001' WHEN 'error' THEN 'scanItem99999' ELSE 'scanItem6002' END AS scan_item,
  event_type AS problem_type, props AS sentence, CASE WHEN event_id % 11 = 0 THEN props WHEN event_id % 13 = 0 THEN NULL ELSE 'fix ' || cast(user_id % 5 AS string) END AS suggestion,
  CASE WHEN event_id % 2 = 0 THEN 'adaptive_markdown' ELSE 'baseline_fixed' END AS strategy, value
FROM {events}"""

#: Tasks: orders, with states and counts.
TASKS = """
SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'processing' ELSE (CASE WHEN o_orderkey % 3 = 0 THEN 'error' ELSE 'queued' END) END AS status,
  o_orderdate AS create_time, o_custkey % 40 AS problem_count, CASE WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 10 = 1 THEN 99999 ELSE 50 + o_orderkey % 50 END AS total_chunks, o_orderkey % 50 AS complete_chunks,
  CASE WHEN o_orderkey % 2 = 0 THEN 'scanItem5001,scanItem6002' ELSE 'scanItem99999' END AS items
FROM {orders}"""

#: Materials: the lines of an order, each a file once.
MATERIALS = """
SELECT l_orderkey AS task_id, 'file_' || cast(l_linenumber AS string) || '.pdf' AS file_name, max(CASE WHEN l_linestatus = 'F' THEN 'complete' ELSE 'processing' END) AS file_status,
  cast(sum(l_quantity) AS bigint) AS n_5001, cast(count(*) AS bigint) AS n_99999, max(l_partkey) AS words
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


