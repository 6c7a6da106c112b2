"""CRC-32 in DuckDB SQL, for oracles: the table by its recurrence, then one step per byte."""

from __future__ import annotations

POLYNOMIAL = 0xEDB88320


def crc_table(name: str = "crc_rows") -> str:
    """CTEs (of a WITH RECURSIVE) that end in crc_list: the 256 steps as one list."""
    return f"""{name}(b, k, v) AS (
  SELECT range, 0, range::UBIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, {POLYNOMIAL}::UBIGINT) ELSE v // 2 END FROM {name} WHERE k < 8),
crc_list AS (SELECT list(v ORDER BY b) AS t FROM {name} WHERE k = 8)"""


def crc32(blob: str, steps: str = "crc_list.t") -> str:
    """Unsigned CRC-32 of a BLOB expression, as BIGINT; ``steps``: the column of crc_list, which the query joins."""
    hexed = f"hex({blob})"
    each = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substring({hexed}, i, 2))::UBIGINT)"
    step = f"xor(a // 256, {steps}[(xor(a, x) % 256)::INT + 1])"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {each}), lambda a, x: {step}), 4294967295::UBIGINT)::BIGINT"
