"""op8: formats all conversations and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkweave.llm.chat_trees import conversations, linear_tree, read_back

HARD = "</s>[INST] ok [/INST]"


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    # A second reply of a lower score: a branch that is never chosen.
    other = spark.createDataFrame([(-7, 3, 1, "assistant", "no", -1.0)], "tree long, id long, parent long, role string, text string, score double")
    out = conversations(linear_tree(rows.unionByName(more)).unionByName(other))
    return read_back(out).withColumnRenamed("tree", "conv_id")


#: The turns and the masked text are what went in; the template adds 20 characters a turn, the escapes one each.
SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{HARD}'), (-7, 1, 'assistant', '{HARD}')
), t AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(20 + length(role) + length(text) + len(regexp_extract_all(role || text, '[<\\[\\\\]')))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""

QUERIES = {"op8_chat_trees": op8_chat_trees}
ORACLE = {"op8_chat_trees": SQL}
