"""The English prose of a post: its text without code, markup and links, line by line."""

from __future__ import annotations

import re

_EDGE = r"(?:[ \t]|<[^<>\n]*>)*"  # blanks and tags around a fence
FENCE = re.compile(rf"^{_EDGE}(```+|~~~+)[^\n]*\n.*?(?:^{_EDGE}\1[`~]*{_EDGE}$|\Z)", re.S | re.M)
HTML_CODE = re.compile(r"<(pre|code|script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
INDENTED = re.compile(r"^(?: {4}|\t).*$", re.M)
INLINE = re.compile(r"`[^`\n]+`")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
LINK = re.compile(r"\b(?:https?://|www\.)\S+", re.I)
ENTITY = re.compile(r"&(?:[a-z]+|#\d+);", re.I)
NON_ASCII_LETTERS = re.compile(r"[^\W\d_a-zA-Z]+")
FOREIGN_WORD = re.compile(r"[a-z]*[^\W\d_a-z][^\W\d_]*")
WORD = re.compile(r"[a-z]+(?:['’][a-z]+)?")
SENTENCE = re.compile(r"[a-z`)\]\"'][.!?]+(?=\s|$)")

# English function words that are rare in other languages.
FUNCTION_WORDS = frozenset(
    "the of that this these those my your his her its our their each with and to but by then for at after because while "
    "until although when before inside through without near is are were be been it you she they not have had does did "
    "from if into about there which who what how could would should will over under here any some than".split()
)
# Words that join clauses; the second set opens a subordinate clause.
COORDINATING = frozenset("and but or so then yet nor".split())
SUBORDINATING = frozenset(
    "because while until although when before after whereas unless if since though whenever wherever which who whose "
    "that's albeit insofar inasmuch notwithstanding provided lest once".split()
)
ADVERBIAL = frozenset("however consequently moreover therefore furthermore nevertheless thus hence first next finally meanwhile usually now".split())

#: Share of function words from which a line of at least LINE_WORDS words counts as English.
ENGLISH_SHARE = 0.15
LINE_WORDS = 8


def strip_code(text: str) -> str:
    """``text`` without fenced, indented, inline and HTML code, tags, links and entities."""
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n", text)
    if "<" in text:
        text = HTML_CODE.sub("\n", text)
    if "\n    " in text or "\t" in text or text.startswith("    "):
        text = INDENTED.sub("", text)
    if "`" in text:
        text = INLINE.sub(" ", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "://" in text or "www." in text:
        text = LINK.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(" ", text)
    return text


def english_lines(text: str) -> tuple[list[str], list[str]]:
    """The English lines of a text in lower case, and all their words.

    Shorter lines count if more words of the text stand in English lines than in other ones.
    """
    lines, short, words, other = [], [], [], 0
    for line in strip_code(text).lower().split("\n"):
        if not line or line.isspace():
            continue
        dropped = 0
        if not line.isascii():
            # a word with a letter beyond ASCII is no English word and must not fall into parts
            foreign = sum(map(len, NON_ASCII_LETTERS.findall(line)))
            if foreign > len(line) // 4:
                other += foreign // 4 + 1
                continue
            line, dropped = FOREIGN_WORD.subn(" ", line)
        found = WORD.findall(line)
        if len(found) < LINE_WORDS:
            short.append((line, found))
        elif sum(map(FUNCTION_WORDS.__contains__, found)) >= ENGLISH_SHARE * (len(found) + dropped):
            lines.append(line)
            words += found
        else:
            other += len(found)
    if len(words) > other:
        for line, found in short:
            lines.append(line)
            words += found
    return lines, words
