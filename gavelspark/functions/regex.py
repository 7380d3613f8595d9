"""Translation of rule patterns into Java regular expressions.

Rules come in two dialects. In one, ``\\b`` and ``\\w`` mean ASCII words whatever the text; in the other ``\\m`` and
``\\M`` mark the start and end of a Unicode word and matching ignores case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_WORD = r"[\p{L}\p{N}_]"


def ascii_words(pattern: str) -> str:
    """Java form of a pattern whose ``\\b`` looks at ASCII word characters only."""
    return re.sub(r"\\b", lambda _: _ASCII_EDGE, pattern)


_LITERAL = r"(?:\[([^\\^\]\[&-]+)\]|([^\\\[\](){}.*+?^$|]))(?![?*{])"


def _edges(pattern: str) -> str:
    """As ``ascii_words``, but an edge beside a word character that must be there looks at its other side only."""

    def edge(m: re.Match) -> str:
        if re.match(r"[A-Za-z0-9_](?![?*{])", pattern[m.end() :]):
            return "(?<![A-Za-z0-9_])"
        return "(?![A-Za-z0-9_])" if re.search(r"(?<!\\)[A-Za-z0-9_]$", pattern[: m.start()]) else _ASCII_EDGE

    return re.sub(r"\\b", edge, pattern)


def alternatives(pattern: str) -> list[str]:
    """The parts of a pattern between its outermost bars."""
    out, depth, in_class = [""], 0, False
    for piece in re.findall(r"\\.|.", pattern, re.S):
        if piece == "|" and not depth and not in_class:
            out.append("")
            continue
        out[-1] += piece
        if in_class or piece == "[":
            in_class = piece != "]"
        else:
            depth += (piece == "(") - (piece == ")")
    return out


def found_ascii_words(pattern: str) -> str:
    """A pattern that is found in the texts where ``ascii_words(pattern)`` is, sooner: places whose character begins
    none of the alternatives are passed over. What is found may differ, so it is for tests only."""
    begins = [re.match(_LITERAL, re.sub(r"^\\b", "", a)) for a in alternatives(pattern)]
    if not all(begins):
        return _edges(pattern)
    chars = "".join(sorted({x for m in begins for x in m[1] or m[2]}))
    return f"(?=[{re.sub(r'([&^-])', chr(92) * 2 + '1', chars)}])(?:{_edges(pattern)})"


def unicode_words(pattern: str) -> str:
    """Java form of a case-blind pattern with ``\\m`` / ``\\M`` word edges."""
    return "(?iu)" + pattern.replace(r"\m", f"(?<!{_WORD})").replace(r"\M", f"(?!{_WORD})")


def escape(text: str) -> str:
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m[0], text)


def like_escape(text: str) -> str:
    """The text with LIKE wildcards taken literally."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def word_start(term: str) -> str:
    return unicode_words(r"\m" + escape(term))


def any_term(terms: list[str]) -> str:
    """Java pattern for any of the terms at the start of a word."""
    return unicode_words(r"\m(?:" + "|".join(escape(t) for t in terms) + ")")


def query_words(query: str, least: int = 2) -> list[str]:
    """The words of a search query: lower case, white space squeezed, short ones out."""
    return [w for w in query.lower().split() if len(w) >= least]


def matches(col: Column | str, pattern: str) -> Column:
    return F.coalesce((F.col(col) if isinstance(col, str) else col).rlike(pattern), F.lit(False))
