"""DuckDB SQL of the token rules, built up from common table expressions, for the oracles of the catalogue."""

from __future__ import annotations

#: The delimiters of each level, spelled out once more: an oracle that shared them could not find a wrong one.
CLASSES = (r"[ \r\n\t'\"<>(),|!;{}*]", r"[/@=:\\?&]", r"[.$#`~^+]", r"[-_]")


def cells(table: str, key: str, columns: list[str]) -> str:
    """A query of (row, key, column_name, column_pos, text); rows are numbered in the order of key."""
    base = f"(SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS row FROM {table})"
    one = [f"SELECT row, {key} AS key, '{c}' AS column_name, {k} AS column_pos, CAST({c} AS VARCHAR) AS text FROM {base} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> ''" for k, c in enumerate(columns)]
    return " UNION ALL ".join(one)


def occurrences(source: str) -> str:
    """CTEs that end in occ (row, key, column_name, column_pos, keyword, splits, parent, path) for a query of cells."""
    ctes = [f"s0 AS (SELECT *, 1 AS bits, NULL::VARCHAR AS parent, false AS done, []::INTEGER[] AS path FROM ({source}))"]
    keep = "row, key, column_name, column_pos"
    for k in range(4):
        own, cls = 2 << k, CLASSES[k].replace("'", "''")
        ctes.append(f"p{k} AS (SELECT *, list_filter(regexp_split_to_array(text, '{cls}'), lambda x: x <> '') AS parts FROM s{k})")
        ctes.append(f"w{k} AS (SELECT *, len(parts) = 1 AND parts[1] = text AS whole FROM p{k})")
        ctes.append(f"""s{k + 1} AS (
  SELECT {keep}, text, bits, parent, done, list_append(path, 0) AS path FROM w{k} WHERE done
  UNION ALL SELECT {keep}, text, bits | {own}, parent, false, list_append(path, 0) FROM w{k} WHERE NOT done AND whole
  UNION ALL SELECT {keep}, text, bits, parent, true, list_append(path, 0) FROM w{k} WHERE NOT done AND NOT whole AND bits <> 1
  UNION ALL SELECT {keep}, part, {own}, CASE WHEN bits <> 1 THEN text END, false, list_append(path, CAST(i AS INTEGER))
    FROM (SELECT *, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM w{k} WHERE NOT done AND NOT whole))""")
    ctes.append(f"occ AS (SELECT {keep}, text AS keyword, bits AS splits, parent, path FROM s4)")
    return ",\n".join(ctes)


def runs() -> str:
    """CTEs that end in runs (keyword, column_name, column_pos, start_row, end_row, splits, parent, path) from occ."""
    return """o1 AS (
  SELECT *, CASE WHEN lag(row) OVER w = row AND lag(parent) OVER w IS NOT DISTINCT FROM parent THEN 0 ELSE 1 END AS fresh
  FROM occ WINDOW w AS (PARTITION BY keyword, column_name ORDER BY row, path)),
o2 AS (SELECT *, sum(fresh) OVER (PARTITION BY keyword, column_name ORDER BY row, path) AS entry FROM o1),
o3 AS (
  SELECT keyword, column_name, column_pos, entry, min(row) AS row, bit_or(splits) AS splits, any_value(parent) AS parent, min(path) AS path
  FROM o2 GROUP BY keyword, column_name, column_pos, entry),
o4 AS (
  SELECT *, CASE WHEN lag(row) OVER w + 1 = row AND lag(splits) OVER w = splits AND lag(parent) OVER w IS NOT DISTINCT FROM parent THEN 0 ELSE 1 END AS fresh
  FROM o3 WINDOW w AS (PARTITION BY keyword, column_name ORDER BY entry)),
o5 AS (SELECT *, sum(fresh) OVER (PARTITION BY keyword, column_name ORDER BY entry) AS run FROM o4),
runs AS (
  SELECT keyword, column_name, column_pos, min(row) AS start_row, max(row) AS end_row, any_value(splits) AS splits, any_value(parent) AS parent, min(path) AS path
  FROM o5 GROUP BY keyword, column_name, column_pos, run)"""


def split_level(bits: str) -> str:
    return f"CASE WHEN {bits} & 2 <> 0 THEN 0 WHEN {bits} & 4 <> 0 THEN 1 WHEN {bits} & 8 <> 0 THEN 2 WHEN {bits} & 16 <> 0 THEN 3 ELSE 4 END"


def phrase_status(text: str, wanted: list[str], level: int, column: str | None) -> str:
    """CTEs that end in status (column_name, row, confirmed, needs_verification) from occ, for a phrase of several tokens."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    tokens = ", ".join(quote(w) for w in wanted)
    where = f" AND column_name = {quote(column)}" if column else ""
    walk = []
    for k in range(3):
        walk.append(f"""v{k + 1} AS (
  SELECT v.start, coalesce(f.up, v.at) AS at,
         CASE WHEN v.verdict IS NOT NULL THEN v.verdict WHEN f.keyword IS NULL THEN 'open' WHEN f.up IS NULL THEN 'rejected' WHEN contains(f.up, {quote(text)}) THEN 'confirmed' END AS verdict
  FROM v{k} v LEFT JOIN fit f ON f.keyword = v.at)""")
    return (
        f"""hit AS (SELECT * FROM occ WHERE keyword IN ({tokens}){where}),
bytok AS (SELECT DISTINCT column_name, row, keyword, coalesce(parent, '') AS parent FROM hit),
nrow AS (SELECT column_name, row, count(DISTINCT keyword) AS n, count(DISTINCT parent) AS n_parents FROM bytok GROUP BY column_name, row),
cand AS (SELECT * FROM nrow WHERE n = (SELECT count(DISTINCT keyword) FROM hit)),
common AS (
  SELECT b.column_name, b.row, b.parent FROM bytok b JOIN cand c USING (column_name, row)
  GROUP BY b.column_name, b.row, b.parent, c.n HAVING count(DISTINCT b.keyword) = c.n),
fit AS (
  SELECT keyword, parent AS up FROM (
    SELECT keyword, parent, row_number() OVER (PARTITION BY keyword ORDER BY column_pos, row, path) AS r FROM occ WHERE {split_level("splits")} >= {level}) WHERE r = 1),
v0 AS (SELECT DISTINCT parent AS start, parent AS at, CASE WHEN contains(parent, {quote(text)}) THEN 'confirmed' END AS verdict FROM common WHERE parent <> ''),
"""
        + ",\n".join(walk)
        + """,
status AS (
  SELECT c.column_name, c.row, coalesce(bool_or(v.verdict = 'confirmed'), false) AS confirmed,
         coalesce(bool_or((c.n > 1 AND c.n_parents > 1) OR m.parent = '' OR coalesce(v.verdict, CASE WHEN v.start IS NOT NULL THEN 'open' END) = 'open'), false) AS needs_verification
  FROM cand c LEFT JOIN common m USING (column_name, row) LEFT JOIN v3 v ON v.start = m.parent
  GROUP BY c.column_name, c.row)"""
    )
