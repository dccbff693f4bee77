"""CRC-32 as DuckDB SQL, which has no such function: for oracles only."""

from __future__ import annotations

#: A list of 256 numbers: what each byte adds, by the polynomial 0xEDB88320 bit by bit.
CRC_TABLE = """(SELECT list(t ORDER BY i) AS t FROM (SELECT i,
  list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS t FROM range(256) r(i)))"""


def crc32_sql(text: str, table: str = "t") -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of ``text``; ``table`` names the column of CRC_TABLE."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: CAST('0x' || p AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, x: xor(c // 256, {table}[xor(c, x) % 256 + 1])), 4294967295)"
