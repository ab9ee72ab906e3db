"""The adapters of talkweave.sources.adapters as SQL, for the counterparts of queries."""

CONV = """conv AS (
  SELECT turn AS sort_seq, conv_id * 1000 + turn AS server_id, role AS sender,
         'conv_' || conv_id || CASE WHEN conv_id % 3 = 0 THEN '@chatroom' ELSE '' END AS talker,
         conv_id * 3600 + turn * 60 + 1700000000 AS create_time, text
  FROM conversations
)"""
EVT = """evt AS (
  SELECT epoch_us(ts) // 1000 AS sort_seq, event_id AS server_id,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 49 WHEN 'signup' THEN 10000 WHEN 'error' THEN 10002 ELSE 47 END::BIGINT AS msg_type,
         'c' || user_id AS sender,
         'u' || (user_id % 50) || CASE WHEN user_id % 3 = 0 THEN '@chatroom' ELSE '' END AS talker,
         epoch_us(ts) // 1000000 AS create_time, props AS text
  FROM events
)"""
LIN = """lin AS (
  SELECT epoch_us(l_shipdate) // 1000000 * 1000 AS sort_seq, (l_orderkey * 10 + l_linenumber)::BIGINT AS server_id,
         CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 34 WHEN 4 THEN 21474836529 WHEN 5 THEN 244813135921 WHEN 6 THEN 25769803825 WHEN 7 THEN 10000 ELSE 1 END::BIGINT AS local_type,
         'c' || (l_partkey % 1500) AS sender, 's' || l_suppkey AS talker, epoch_us(l_shipdate) // 1000000 AS create_time,
         l_linestatus, l_returnflag, l_quantity, l_partkey
  FROM lineitem
)"""
CON = """con AS (
  SELECT 'c' || c_custkey AS user_name, CASE WHEN c_custkey % 2 = 0 THEN 'al' || c_custkey ELSE '' END AS alias,
         CASE WHEN c_custkey % 5 = 0 THEN 'Remark ' || c_custkey ELSE '' END AS remark,
         CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS nick_name,
         CASE WHEN c_custkey % 11 = 0 THEN 'memo of a friend' END AS memo, n_name AS region,
         CASE WHEN c_custkey % 3 = 0 THEN 'http://a/' || c_custkey END AS avatar_url,
         (c_custkey % 3)::BIGINT AS gender, (c_custkey % 8)::BIGINT AS source_scene, c_mktsegment AS label
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
), names AS (
  SELECT user_name, coalesce(nullif(remark, ''), nullif(nick_name, ''), nullif(alias, ''), user_name) AS name, avatar_url FROM con
)"""
SES = """ses AS (
  SELECT talker AS username, create_time AS sort_timestamp, text AS summary, msg_type AS last_msg_type, sender AS last_msg_sender
  FROM (SELECT *, row_number() OVER (PARTITION BY talker ORDER BY create_time DESC, sort_seq DESC, server_id DESC) AS o FROM evt) WHERE o = 1
)"""


def named(id_col: str, name: str = "n.name") -> str:
    """SQL of a name with the id behind it."""
    return f"CASE WHEN {name} IS NOT NULL AND {name} <> {id_col} THEN {name} || '（' || {id_col} || '）' ELSE {id_col} END"
