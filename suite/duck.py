"""Fragments of DuckDB SQL used by several oracles."""

from __future__ import annotations

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288)"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{0b}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+', ' ', 'g'))"


def strip_html(x: str, strict: bool = False) -> str:
    text = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    if strict:
        text = f"regexp_replace({text}, '&[a-zA-Z0-9#]+;', ' ', 'g')"
    return ws(text)


def letters(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\p{{L}}'))"


def latin(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-z]'))"


NON_LATIN = (
    r"'[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}"
    r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]'"
)
ACCENTED = r"'[\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]'"


def non_english(x: str) -> str:
    return (
        f"(regexp_matches({x}, {NON_LATIN}) OR regexp_matches({x}, {ACCENTED}) OR "
        f"({letters(x)} >= 30 AND {latin(x)} < 0.6 * {letters(x)}))"
    )


def title_case(x: str) -> str:
    return rf"array_to_string([upper(substring(run, 1, 1)) || substring(run, 2) for run in regexp_extract_all(lower({x}), '\p{{L}}+|\P{{L}}+')], '')"
