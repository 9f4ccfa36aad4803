"""SQL of the CRC-32 checksum for checking queries; Spark has it built in."""

def crc32_sql(key: str) -> str:
    """SQL of the checksum of an ASCII string; ``tab`` holds the 256 remainders."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(string_split({key}, ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295)"""


CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
