"""Word, phrase and regular expression matching on text Columns. W is a letter, a digit or an underscore."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

W = r"\p{L}\p{Nd}_"
BEFORE, AFTER = rf"(?<![{W}])", rf"(?![{W}])"


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def quoted(s: str) -> str:
    """s as a literal of a Java regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|#&~-/" else c for c in s)


def phrase_re(p: str, prefix: bool = False) -> str:
    """A boundary is asked for only where the phrase itself has a word character."""
    return (BEFORE if is_word(p[0]) else "") + quoted(p) + (AFTER if not prefix and is_word(p[-1]) else "")


def has_phrase(s: Column, p: str) -> Column:
    """The cheap substring test runs first; '' is found in empty text only."""
    if not p:
        return s == ""
    return s.contains(p) & s.rlike(phrase_re(p)) if is_word(p[0]) or is_word(p[-1]) else s.contains(p)


def has_phrase_of(s: Column, p: Column) -> Column:
    """has_phrase() of a phrase that is a column."""
    at = lambda edge, mark: F.when(p.rlike(edge), mark).otherwise("")
    pattern = F.concat(at(r"^[\p{L}\p{N}_]", BEFORE), F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|#&~\-/])", r"\\$1"), at(r"[\p{L}\p{N}_]\z", AFTER))
    return F.when(p == "", s == "").otherwise(F.contains(s, p) & F.rlike(s, pattern))


def distinct_words(s: Column) -> Column:
    """A text that has a phrase has each of the phrase's words as a whole word."""
    return F.array_remove(F.array_distinct(F.split(s, rf"[^{W}]+")), "")


def has_prefix(s: Column, p: str) -> Column:
    if not p:
        return s != ""
    return s.contains(p) & s.rlike(phrase_re(p, True)) if is_word(p[0]) else s.contains(p)


def has_sequence(s: Column, phrases: list[str]) -> Column:
    phrases = [p for p in phrases if p]
    if not phrases:
        return F.lit(True)
    test = s.rlike(r"[\s\S]*?".join(map(phrase_re, phrases)))
    for p in reversed(phrases):
        test = s.contains(p) & test
    return test


def java_re(pattern: str) -> tuple[str, dict[str, int]]:
    """An RE2 pattern for Java, with the numbers of its named groups, whose names are taken away."""
    out, names, group, i, inside = [], {}, 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n == "Q":
                end = pattern.find("\\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(quoted(pattern[i + 2 : end]))
                i = end + 2
                continue
            out.append({"z": "\\z", "C": "."}.get(n, "\\" + n))
            i += 2
        elif inside:
            inside = c != "]" or pattern[i - 1] == "[" or pattern[i - 2 : i] == "[^"
            out.append("\\[" if c == "[" and not pattern.startswith("[:", i) else c)
            if pattern.startswith("[:", i):
                end = pattern.find(":]", i)
                out[-1] = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "space": "\\s", "upper": "A-Z", "lower": "a-z", "punct": "\\p{Punct}", "xdigit": "0-9a-fA-F", "word": "\\w"}.get(pattern[i + 2 : end], "")
                i = end + 2
                continue
            i += 1
        elif c == "[":
            inside = True
            out.append(c)
            i += 1
        elif c == "(":
            m = re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i)
            if m:
                group += 1
                names[m[1]] = group
                out.append("(")
                i = m.end()
            else:
                group += not pattern.startswith("(?", i)
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out), names


def matches_re(s: Column, pattern: str) -> Column:
    if pattern in ("", ".*", "(?s).*"):
        return F.lit(True)
    if pattern == ".+":
        return s.rlike(".")
    return s.rlike(java_re(pattern)[0])


#: Runs of digits, and of hex digits of even length from four on, that no other word character touches but certain marks.
NUMBERS = rf"(?<![{W}&&[^TXxvshm]])(?:[0-9]++(?![a-fA-F])|(?=[0-9a-fA-F]*[a-fA-F])(?:[0-9a-fA-F]{{2}}){{2,}}+(?![0-9a-fA-F]))(?![{W}&&[^TZsmhμun]])"


def collapsed(s: Column, prettify: bool = False) -> Column:
    out = F.regexp_replace(s, NUMBERS, "<N>")
    if prettify:
        for old, new in (
            ("<N>-<N>-<N>-<N>-<N>", "<UUID>"),
            ("<N>.<N>.<N>.<N>", "<IP4>"),
            ("<N>:<N>:<N>.<N>", "<TIME>"),
            ("<N>:<N>:<N>,<N>", "<TIME>"),
            ("<N>:<N>:<N>", "<TIME>"),
            ("<N>-<N>-<N>", "<DATE>"),
            ("<N>/<N>/<N>", "<DATE>"),
            ("<DATE>T<TIME>Z", "<DATETIME>"),
            ("<DATE>T<TIME>", "<DATETIME>"),
            ("<DATE> <TIME>", "<DATETIME>"),
        ):
            out = F.replace(out, F.lit(old), F.lit(new))
    return out


def decolorized(s: Column) -> Column:
    return F.regexp_replace(s, "\x1b\\[[0-?]*[ -/]*[0-~]?", "")


def word_list(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(rf"([{W}]+)"), 1)
