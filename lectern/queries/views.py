"""SQL text of the model views, for the oracle side."""

from __future__ import annotations

VIEWS = {
    "books": """SELECT c_custkey AS book_id, c_name AS title,
  CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS author,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'en' WHEN 'AUTOMOBILE' THEN 'de' WHEN 'MACHINERY' THEN 'pl'
    WHEN 'HOUSEHOLD' THEN 'zh' ELSE 'fr' END AS language,
  CASE WHEN c_acctbal > 5000 THEN '/covers/' || c_custkey || '.jpg' END AS cover_path,
  'txt' AS source_format,
  make_timestamp((1704067200 + CAST(round(c_acctbal * 100) AS BIGINT)) * 1000000) AS created_at
  FROM customer""",
    "chapters": """SELECT o_orderkey AS chapter_id, o_custkey AS book_id, o_orderdate AS placed_on,
  o_orderpriority || ' #' || o_orderkey AS title, o_orderstatus <> 'F' AS enabled,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS idx
  FROM orders""",
    "segments": """SELECT l_orderkey AS chapter_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  'Part ' || l_partkey || ' of lot ' || l_suppkey AS text,
  CASE WHEN l_tax < 0.08 THEN l_quantity END AS duration_s,
  CASE l_returnflag WHEN 'A' THEN 'done' WHEN 'N' THEN 'queued' ELSE 'failed' END AS status,
  l_linenumber = 7 AS last_of_block,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx
  FROM lineitem""",
    "jobs": """SELECT *,
  CASE WHEN status <> 'queued' THEN created_at + to_microseconds(CAST(round(price * 100) AS BIGINT) * 1000) END AS started_at,
  CASE WHEN status IN ('done','failed') THEN created_at + to_microseconds(CAST(round(price * 100) AS BIGINT) * 3000) END AS finished_at
  FROM (SELECT o_orderkey AS job_id, o_custkey AS book_id, o_totalprice AS price,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed' WHEN o_orderstatus = 'F' THEN 'done'
    WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderpriority = '5-LOW' THEN 'cancelled' ELSE 'queued' END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'af_heart' WHEN '2-HIGH' THEN 'zf_xiaobei' WHEN '3-MEDIUM' THEN 'pl_PL-gosia-medium'
    WHEN '4-NOT SPECIFIED' THEN 'de_DE-thorsten-high' ELSE 'xx_missing' END AS voice,
  1.0::DOUBLE AS speed,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'm4b, mp3' WHEN '2-HIGH' THEN 'srt,,vtt ' WHEN '3-MEDIUM' THEN ''
    WHEN '4-NOT SPECIFIED' THEN 'mp4,ogg' ELSE 'chapters' END AS formats,
  CASE o_orderstatus WHEN 'P' THEN 'static' WHEN 'O' THEN 'waveform' ELSE 'spin' END AS video_style,
  o_orderdate AS created_at FROM orders)""",
    "artifacts": """SELECT job_id, format, '/out/' || l_partkey || '-' || l_suppkey || '.' || format AS path, part_index
  FROM (SELECT l_orderkey AS job_id, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'A' THEN 'mp3' WHEN 'N' THEN 'mp4' ELSE 'srt' END AS format,
  CASE WHEN l_returnflag = 'N' THEN l_linenumber END AS part_index FROM lineitem)""",
    "stage_log": """SELECT event_id, user_id AS job_id, ts,
  CASE event_type WHEN 'signup' THEN 'prepare' WHEN 'view' THEN 'synthesize' WHEN 'click' THEN 'assemble'
    WHEN 'purchase' THEN 'master' ELSE 'export' END AS stage,
  least(round(value) / 100, 1.0::DOUBLE) AS progress FROM events""",
    "voices": """SELECT substr('abefhijpzq', s_nationkey % 10 + 1, 1) ||
  CASE WHEN s_acctbal < 0 THEN 'n' WHEN s_acctbal < 5000 THEN 'f' ELSE 'm' END || '_' || s_name AS voice_id,
  CASE WHEN s_acctbal < 3000 THEN 'piper' ELSE 'kokoro' END AS engine FROM supplier""",
    "lexicon": r"""SELECT doc_id AS book_id, e.entry, e.pattern, e.replacement, e.is_regex, e.enabled FROM (
  SELECT doc_id, unnest([
    {'entry': 1, 'pattern': 'the ', 'replacement': 'thee ', 'is_regex': false, 'enabled': quality = 1},
    {'entry': 2, 'pattern': '([aeiou])nt', 'replacement': '\1mt', 'is_regex': true, 'enabled': toxic = 0},
    {'entry': 3, 'pattern': '.', 'replacement': ' $.', 'is_regex': false, 'enabled': quality = 0}]) AS e FROM labels)""",
}

ISO = """strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN ''
  ELSE '.' || lpad(CAST(epoch_us({c}) % 1000000 AS VARCHAR), 6, '0') END || '+00:00'"""


def iso(column: str) -> str:
    return "(" + ISO.format(c=column) + ")"


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` behind a WITH clause of the named model views and extra CTEs."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in views]
    parts += [f"{name} AS ({text})" for name, text in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
