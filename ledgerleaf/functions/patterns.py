"""Spelling of the rule patterns for the engine that runs them.

Rule patterns mean what Python's ``re`` means for text: ``\\s \\d \\w \\b`` cover Unicode and ``$``
closes the text. The JVM reads the same letters as ASCII, so the classes are written out. A
look-ahead that ends a pattern becomes a plain group: the capture of the first match is the same.
"""

from __future__ import annotations

import re

# Characters Python's str.strip() and \s treat as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "    　"
)

_SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
_WORD = r"\p{L}\p{N}_"
_CLASSES = {"s": _SPACE, "d": r"\p{Nd}", "w": _WORD}
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


def spell(pattern: str, boundary: str = _BOUNDARY) -> str:
    """Write out the Unicode classes, the word boundary and the end anchor."""
    out, in_class = [], False
    for token in re.findall(r"\\.|.", pattern.replace("(?=", "(?:"), re.DOTALL):
        if token[0] == "\\" and token[1] in _CLASSES:
            chars = _CLASSES[token[1]]
            out.append(chars if in_class else f"[{chars}]")
        elif token == r"\b":
            out.append(boundary)
        elif token == "$" and not in_class:
            out.append(r"\z")
        else:
            in_class = token == "[" or (in_class and token != "]")
            out.append(token)
    return "".join(out)


def _alternatives(group: str) -> list[str] | None:
    """The alternatives of the group a pattern starts with; None if it starts with none, or with one that may be absent."""
    if not group.startswith("(?:"):
        return None
    depth, in_class, out = 0, False, [""]
    for at, token in ((m.start(), m.group()) for m in re.finditer(r"\\.|.", group[3:], re.DOTALL)):
        if not in_class and token == ")" and depth == 0:
            return None if group[3 + at + 1:3 + at + 2] in ("?", "*", "{") else out
        if not in_class and token == "|" and depth == 0:
            out.append("")
            continue
        depth += 0 if in_class else (token == "(") - (token == ")")
        in_class = token == "[" or (in_class and token != "]")
        out[-1] += token
    return None


def first_characters(pattern: str) -> set[str] | None:
    """ASCII characters a match may start with, as spelled in a pattern that starts with a group; None if they are not plain."""
    alternatives, found = _alternatives(pattern), set()
    if alternatives is None:
        return None
    for one in alternatives:
        if one.startswith("(?:"):
            inner = first_characters(one)
            if inner is None:
                return None
            found |= inner
        elif one.startswith(r"\d"):
            found |= set("0123456789")
        elif re.match(r"\[(?:\\[^a-zA-Z]|[^]^\\-])+\]", one):
            found |= set(one[1:one.index("]")].replace("\\", ""))
        elif one[:1].isascii() and one[:1].isalnum() and one[1:2] not in ("?", "*", "{"):
            found.add(one[0])
        else:
            return None
    return found


def guard(pattern: str, ignore_case: bool = True) -> str:
    """A look ahead that turns most places of a text down by one character, before all alternatives are tried. Characters
    beyond ASCII pass, as some of them are other cases of ASCII letters."""
    first = first_characters(pattern)
    if first is None:
        return ""
    if ignore_case:
        first = {c.lower() for c in first} | {c.upper() for c in first}
    return "(?![" + "".join(rf"\x{code:02x}" for code in range(128) if chr(code) not in first) + "])"


def jvm(pattern: str, ignore_case: bool = True) -> str:
    return guard(pattern, ignore_case) + ("(?iu)" if ignore_case else "") + spell(pattern)


def jvm_words(pattern: str, ignore_case: bool = True) -> str:
    """For a pattern that begins and ends with a word character between two boundaries: looking
    one character to either side is enough, and much cheaper than the general boundary."""
    bare = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return guard(bare, ignore_case) + ("(?iu)" if ignore_case else "") + rf"(?<![{_WORD}]){spell(bare)}(?![{_WORD}])"


def leading_literal(pattern: str) -> str:
    """The plain text every match starts with; its absence rules a match out."""
    literal = re.match(r"[a-z: -]*", pattern).group()
    return literal[:-1] if pattern[len(literal):len(literal) + 1] in ("?", "*", "{") else literal
