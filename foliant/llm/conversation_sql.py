"""The repair of conversations stated as DuckDB SQL: all cheapest ways at once, row by row."""


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _edit(state: str, cost: str, letter: str, turn: str | None, when: str = "true") -> str:
    text = f"{state}.t" if turn is None else f"coalesce({state}.t || chr(10), '') || {turn}"
    key = f"printf('%08d', CAST(substr({state}.k, 1, 8) AS BIGINT) + {cost}) || substr({state}.k, 9) || '{letter}'"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'k': {key}, 't': {text}}} END"


def _inserted(source: str) -> str:
    """Ways with inserted turns: from any state to user, then from user to assistant."""
    user = _best("s2", *[_edit(s, "3", "I", "'user:'") for s in ("s0", "s1", "s3")])
    then = _best("s3", _edit("x2", "3", "I", "'assistant:'"))
    return f"SELECT * EXCLUDE (s2, s3), {then} AS x3 FROM (SELECT *, {user} AS x2 FROM {source})"


def _stepped() -> str:
    keep = {a: f"NOT gone AND l = '{a}'" for a in "sua"}
    kept = "role || ':' || text"

    def row(state: str, letter: str, role: str) -> list[str]:
        return [_edit(state, "cut", "K", kept, keep[letter]),
                _edit(state, "3 + cut", "R", f"'{role}:' || text", "NOT gone")]

    def gone(state: str) -> str:
        return _edit(state, "4", "D", None)

    states = (
        gone("s0"),
        _best(gone("s1"), _edit("s0", "cut", "K", kept, keep["s"])),
        _best(gone("x2"), *row("s0", "u", "user"), *row("s1", "u", "user"), *row("x3", "u", "user")),
        _best(gone("x3"), *row("x2", "a", "assistant")),
    )
    return ", ".join(f"{s} AS s{i}" for i, s in enumerate(states))


REPAIR = rf"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)
    ORDER BY n) AS t FROM range(256) r(n)),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' ||
      coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
      lambda c, b: xor(t[CAST(xor(c & 255, b) AS INTEGER) + 1], c >> 8), 4294967295)) % 20 AS kind
  FROM conversations CROSS JOIN tab),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed JOIN range(2) r(copy) ON kind <> 0 AND (copy = 0 OR kind = 3)),
convs AS (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
met AS (
  SELECT c, turn, role, text, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST) > 1 AS seen
  FROM hurt JOIN convs ON hurt.conv_id IS NOT DISTINCT FROM convs.conv_id),
faulty AS (
  SELECT c, turn, role, text, seen, substr(role, 1, 1) AS l,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, seen) AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_matches(text, '[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$') AS ends
  FROM met),
rows AS (
  SELECT c, turn, role, text, l, i, blank, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND ends AS truncated,
    blank OR seen AS gone, CASE WHEN NOT blank AND NOT seen AND ends THEN 3 ELSE 0 END AS cut,
    lag(l) OVER (PARTITION BY c ORDER BY i) || l AS pair
  FROM faulty),
ways AS (
  SELECT c, CAST(0 AS BIGINT) AS i, {{'k': '00000000', 't': CAST(NULL AS VARCHAR)}} AS s0,
    CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s1, CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR)) AS s3 FROM convs
  UNION ALL
  SELECT x.c, r.i, {_stepped()}
  FROM ({_inserted("ways")}) x JOIN rows r ON r.c = x.c AND r.i = x.i + 1),
ended AS (SELECT c, max_by({_best("s0", "x3")}, i) AS way FROM ({_inserted("ways")}) GROUP BY c),
facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
    count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(substr(way.k, 1, 8) AS BIGINT) AS cost,
  substr(way.k, 9) AS audit, sha256(coalesce(way.t, '')) AS repaired_sha256
FROM convs JOIN ended USING (c) LEFT JOIN facts USING (c)
"""
