"""Parts of the SQL that stands beside the queries."""

#: The polynomial of CRC-32, bits reversed (fixed by the standard).
CRC_POLYNOMIAL = 0xEDB88320


def crc32(number: str) -> str:
    """Unsigned CRC-32 of a number's decimal digits: for each byte one xor and eight shifts, folded over a list."""
    steps = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT)] || list_transform(range(8), lambda z: CAST(-1 AS BIGINT))))"
    step = f"CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, {CRC_POLYNOMIAL} * (c & 1)) END"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {steps}, lambda c, o: {step}), 4294967295)"
