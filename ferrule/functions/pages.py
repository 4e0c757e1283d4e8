"""Page furniture: lines that belong to the page and not to its text. The patterns suit both Python and Java."""

from __future__ import annotations

import re

_SERIAL = r"[^\W\d_][^\d|:;=]{2,60}"
#: A line with nothing but a page's number, in the forms that page layouts give it. A bare number is a whole one of at most four digits.
PAGE_NUMBER = r"(?:[-–—]\s?\d{1,4}\s?[-–—]|\d{1,4}|\[\d{1,4}\]|S\d{1,4}|\|\s?\d{1,4}|\d{1,4}\s?\||[Pp]p?\.\s?\d{1,4}|[Pp]age\s+\d{1,4}(?:\s+of\s+\d{1,5})?|\d{1,4}\s?/\s?\d{1,4})"
#: Running heads and notes of where a copy comes from.
RUNNING_HEAD = (
    rf"(?:\S[^/=|]{{1,60}}\bet\s+al\.?\s?/\s?{_SERIAL}\s\d{{1,4}}\s?\(\d{{4}}\)\s?\d{{1,5}}\s?[–-]\s?\d{{1,5}}"  # authors / serial volume (year) pages
    rf"|{_SERIAL},\s?Vol\.\s?\d+,\s?No\.\s?\d+,\s?\d{{4}}"  # serial, volume, number, year
    r"|\d{1,4}\s{2,}\S[^:=|]{1,60}\b[Aa]nd\s[^:=|]{1,60}:\s[^\d=|]{3,80}"  # page, authors: short title
    r"|[A-ZÀ-ÖØ-ÞŠŽĆČ][A-ZÀ-ÖØ-ÞŠŽĆČ-]+(?:[\s-][A-ZÀ-ÖØ-ÞŠŽĆČ-]{2,})+(?:\s{2,}\d{1,4})?"  # capitals, with or without the page
    r"|\d{1,4}\s{2,}[A-ZÀ-ÖØ-ÞŠŽĆČ][A-ZÀ-ÖØ-ÞŠŽĆČ-]+(?:[\s-][A-ZÀ-ÖØ-ÞŠŽĆČ-]{2,})+"
    rf"|Downloaded\sfrom\sthe\s{_SERIAL}\son\s\d{{1,2}}/\d{{1,2}}/\d{{4}}"
    rf"|(?:Author\smanuscript\s[-–]|Accepted\sversion,|Scanned\scopy:)\s{_SERIAL})"
)
_NUMBER_LINE, _HEAD_LINE = re.compile(PAGE_NUMBER), re.compile(RUNNING_HEAD)


def furniture(line: str) -> str | None:
    """'pageno' or 'header' for a trimmed line of page furniture, else None."""
    if not line:
        return None
    if _NUMBER_LINE.fullmatch(line):
        return "pageno"
    return "header" if len(line) < 160 and _HEAD_LINE.fullmatch(line) else None


def body_lines(text: str) -> list[str]:
    """The lines of a text without page furniture and blank lines, each trimmed at the right."""
    return [x.rstrip() for x in text.splitlines() if x.strip() and not furniture(x.strip())]
