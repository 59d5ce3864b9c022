"""op11: damaged conversations and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyman.llm.conversations import repair_conversations
from tallyman.workload.registry import Workload

work = Workload()


def _edit(state: str, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
    """A path after one more edit, as a struct; null where it isn't there."""
    body = f"{state}.body" if line is None else f"CASE WHEN {state}.body IS NULL THEN {line} ELSE {state}.body || chr(10) || {line} END"
    return (
        f"CASE WHEN {state} IS NOT NULL AND ({when}) THEN "
        f"{{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'body': {body}}} END"
    )


def _best(*options: str) -> str:
    """The least of structs that aren't null, by cost and then by letters."""
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))[1]"


def _keep(state: str, initial: str) -> str:
    return _edit(state, "late", "K", "role || ':' || text", f"stays AND initial = '{initial}'")


def _same(state: str) -> tuple[str, str]:
    """Edits that leave the state: the row goes, or it has a role without a first letter."""
    return _edit(state, "2", "D"), _keep(state, "")


def _rerole(state: str, role: str) -> str:
    return _edit(state, "1 + late", "R", f"'{role}:' || text", "stays")


def _insert(state: str, role: str) -> str:
    return _edit(state, "5", "I", f"'{role}:'")


_SQL = rf"""
WITH RECURSIVE bits(i, c, k) AS (
  SELECT i, i, 0 FROM range(0, 256) AS t(i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), bytes AS (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), named AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), sums(r, name, p, c) AS (
  SELECT r, name, 0, CAST(4294967295 AS BIGINT) FROM named
  UNION ALL
  SELECT r, name, p + 1, xor(c >> 8, t[(xor(c, CAST(ascii(substr(name, p + 1, 1)) AS BIGINT)) & 255) + 1])
  FROM sums, bytes WHERE p < length(name)
), faults AS (
  SELECT r, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS f FROM sums WHERE p = length(name)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM named JOIN faults USING (r), range(0, 2) AS copies(k) WHERE f <> 0 AND (k = 0 OR f = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text)) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended
  FROM damaged
), known AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM placed
), judged AS (
  SELECT *, NOT blank AND NOT seen AS stays, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND NOT ended AS truncated,
    left(role, 1) AS initial, CASE WHEN NOT blank AND NOT seen AND NOT ended THEN 5 ELSE 0 END AS late,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM known
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(blank) AS BIGINT) AS blank,
    CAST(count_if(duplicate) AS BIGINT) AS duplicate, CAST(count_if(truncated) AS BIGINT) AS truncated,
    CAST(count_if(pair NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id
), paths(conv_id, i, b0, b1, b2, b3) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), {{'cost': CAST(0 AS BIGINT), 'audit': '', 'body': CAST(NULL AS VARCHAR)}},
    CAST(NULL AS STRUCT(cost BIGINT, audit VARCHAR, body VARCHAR)),
    {{'cost': CAST(5 AS BIGINT), 'audit': 'I', 'body': 'user:'}},
    {{'cost': CAST(10 AS BIGINT), 'audit': 'II', 'body': 'user:' || chr(10) || 'assistant:'}} FROM conversations
  UNION ALL
  SELECT conv_id, i, n0, n1, m2, {_best("n3", _insert("m2", "assistant"))} FROM (
    SELECT conv_id, i, n0, n1, n3, {_best("n2", *(_insert(s, "user") for s in ("n0", "n1", "n3")))} AS m2 FROM (
      SELECT p.conv_id, j.i, {_best(*_same("b0"))} AS n0, {_best(*_same("b1"), _keep("b0", "s"))} AS n1,
        {_best(*_same("b2"), *(f(s, v) for s in ("b0", "b1", "b3") for f, v in ((_keep, "u"), (_rerole, "user"))))} AS n2,
        {_best(*_same("b3"), _keep("b2", "a"), _rerole("b2", "assistant"))} AS n3
      FROM paths p JOIN judged j ON j.conv_id IS NOT DISTINCT FROM p.conv_id AND j.i = p.i + 1))
), repaired AS (
  SELECT conv_id, gaps, blank, duplicate, truncated, illegal, {_best("b0", "b3")} AS b FROM paths JOIN (
    SELECT DISTINCT c.conv_id AS c, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
      coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
    FROM conversations c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id) ON c IS NOT DISTINCT FROM conv_id AND n = i
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, b.cost AS cost, b.audit AS audit, sha256(coalesce(b.body, '')) AS repaired_sha256
FROM repaired
"""


@work.query("op11_conversation_repair", _SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
