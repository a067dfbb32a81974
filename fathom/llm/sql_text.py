"""DuckDB SQL fragments that several oracles share."""

from __future__ import annotations


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def utf8_bytes(text: str) -> str:
    """A list of the UTF-8 bytes of a text expression."""
    return (
        f"flatten(list_transform(CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE string_split({text}, '') END, lambda ch: "
        "CASE WHEN unicode(ch) < 128 THEN [unicode(ch)] WHEN unicode(ch) < 2048 THEN [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)] "
        "WHEN unicode(ch) < 65536 THEN [224 | (unicode(ch) >> 12), 128 | ((unicode(ch) >> 6) & 63), 128 | (unicode(ch) & 63)] "
        "ELSE [240 | (unicode(ch) >> 18), 128 | ((unicode(ch) >> 12) & 63), 128 | ((unicode(ch) >> 6) & 63), 128 | (unicode(ch) & 63)] END))"
    )


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text expression's UTF-8 bytes."""
    table = ", ".join(map(str, _crc_table()))
    start = "list_prepend(4294967295::BIGINT, " + utf8_bytes(text) + "::BIGINT[])"
    return f"xor(list_reduce({start}, lambda c, b: xor(c >> 8, ([{table}]::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
