"""Tokens of the pipe language."""

from __future__ import annotations

from dataclasses import dataclass

PAIRS = ("=~", "!~", "!=", "<=", ">=")
QUOTES = "\"'`"


class QueryError(ValueError):
    """A query text that has no meaning."""


@dataclass(frozen=True)
class Token:
    text: str
    quoted: bool = False
    gap: bool = False  # white space stands before it
    at: int = 0

    def low(self) -> str:
        """For comparison with keywords, which quoted tokens never match."""
        return "" if self.quoted else self.text.lower()


END = Token("", False, True)


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def unquote(text: str, at: int) -> tuple[str, int]:
    """The value of the quoted string at text[at], and where it ends."""
    q, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == q:
            return "".join(out), i + 1
        if c == "\\" and q != "`" and i + 1 < len(text):
            e = text[i + 1]
            if e in "xuU":
                n = {"x": 2, "u": 4, "U": 8}[e]
                try:
                    out.append(chr(int(text[i + 2 : i + 2 + n], 16)))
                except ValueError:
                    raise QueryError(f"bad escape at {i}") from None
                i += 2 + n
                continue
            out.append({"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "0": "\0"}.get(e, e))
            i += 2
            continue
        out.append(c)
        i += 1
    raise QueryError(f"a quote opened at {at} isn't closed")


def tokens(text: str) -> list[Token]:
    out, i, gap = [], 0, False
    while i < len(text):
        c = text[i]
        if c.isspace():
            i, gap = i + 1, True
        elif c == "#":
            end = text.find("\n", i)
            i, gap = (len(text) if end < 0 else end), True
        else:
            start = i
            if c in QUOTES:
                value, i = unquote(text, i)
                out.append(Token(value, True, gap, start))
            elif is_word(c) or c == ".":
                while i < len(text) and (is_word(text[i]) or text[i] == "."):
                    i += 1
                out.append(Token(text[start:i], False, gap, start))
            else:
                i += 2 if text[i : i + 2] in PAIRS else 1
                out.append(Token(text[start:i], False, gap, start))
            gap = False
    return out


#: Words that have a meaning where a filter is read; as values they are quoted when printed.
RESERVED = {"and", "or", "not", "if", "by", "as", "on", "in", "options", "offset", "limit", "with", "from", "at", "order", "asc", "desc", "rank", "partition"}


def quote(text: str, also: frozenset[str] | set[str] = frozenset()) -> str:
    """A token as canonical text: bare if it is a plain word, quoted otherwise."""
    if text and all(is_word(c) or c == "." for c in text) and text.lower() not in RESERVED and text.lower() not in also:
        return text
    out = text.replace("\\", "\\\\").replace('"', '\\"')
    for raw, esc in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = out.replace(raw, esc)
    return f'"{out}"'
