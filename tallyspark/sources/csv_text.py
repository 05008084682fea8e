"""Text of CSV files: encoding, parting character, header names, records."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

# Encodings in the order tried, and the characters that may part fields.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "iso-8859-1")
DELIMITERS = ",;\t|"
HEAD_CHARS = 2048


def decoded(content: bytes) -> str:
    """A file's text by the first encoding that reads all of it."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode(ENCODINGS[-1], "replace")


def delimiter(content: str) -> str:
    """What parts the fields, seen from the file's head."""
    try:
        return csv.Sniffer().sniff(content[:HEAD_CHARS], DELIMITERS).delimiter
    except csv.Error:
        return ","


def header_names(fields: list[str]) -> list[str]:
    """Trimmed names, told apart where they repeat; empty ones count their place."""
    out: list[str] = []
    for i, field in enumerate(fields):
        name = field.strip() or f"_c{i}"
        out.append(name if name not in out else f"{name}.{sum(n == name or n.startswith(f'{name}.') for n in out)}")
    if "Commissions" in out and "Commission" not in out:
        out[out.index("Commissions")] = "Commission"
    return out


class Lines:
    """The lines of a text, and whether the last has been asked for."""

    def __init__(self, text: str) -> None:
        self.rest, self.over = io.StringIO(text, newline=""), False

    def __iter__(self) -> Lines:
        return self

    def __next__(self) -> str:
        line = self.rest.readline()
        if not line:
            self.over = True
            raise StopIteration
        return line


def records(text: str, parting: str) -> Iterator[tuple[list[str], bool]]:
    """(fields, whole) of each record; the last is not whole if the text ends inside quotes."""
    csv.field_size_limit(1 << 30)
    lines = Lines(text)
    for fields in csv.reader(lines, delimiter=parting):
        yield fields, not lines.over  # inside quotes the reader has asked for more
