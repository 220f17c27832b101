"""CRC-32 as a DuckDB expression, for the SQL of queries whose contracts name it."""

from __future__ import annotations


def _table() -> str:
    """The checksum of each byte, from the polynomial."""
    table = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    return f"{table}::UBIGINT[]"


#: The relation that crc_sql's expressions need.
CRC = f"crc AS (SELECT {_table()} AS t)"


def crc_sql(text: str) -> str:
    """Unsigned checksum of a text's UTF-8; needs the relation ``crc`` with column ``t``."""
    byte = f"list_transform(range(0, len(hex({text})) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {byte}), lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8)), 4294967295::UBIGINT)"
