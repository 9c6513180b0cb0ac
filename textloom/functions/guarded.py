"""Places of a text that no edit may touch, found by scanners: code, addresses, mail, link targets and file paths.

Wording rules cut texts by one pattern. What rewriters must hand back is found by scanners: each takes a text and a position and gives the next place at or after it, or nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

Span = tuple[int, int]
Scanner = Callable[[str, int], Span | None]

SPACE = re.compile(r"\s")
ADDRESS_HEAD = re.compile(r"https?://|www\.")
#: What ends a run of plain characters of an address or a path.
OUTSIDE = frozenset("<>[]")
EXTENSION = re.compile(r"\.[A-Za-z0-9]{1,8}\Z")
#: The most words after spaces that may lead on to a separator, as in "Program Files (x86)\\".
SPACED_WORDS = 3


def run(text: str, at: int, fits: Callable[[str], bool]) -> int:
    """Where the run of characters that fit, from at on, ends."""
    while at < len(text) and fits(text[at]):
        at += 1
    return at


def name_char(c: str) -> bool:
    return c.isalnum() or c == "_"


def code_run(text: str, at: int) -> Span | None:
    """The same between runs of backticks of any length."""
    while (start := text.find("`", at)) >= 0:
        inner = run(text, start, "`".__eq__)
        end = run(text, inner, lambda c: c not in "`\n")
        if end > inner and text[end : end + 1] == "`":
            return start, run(text, end, "`".__eq__)
        at = max(end, inner)
    return None


def bracketed(text: str, at: int, stop: str) -> int:
    """Behind a pair of parentheses that opens at `at` and holds neither white space nor characters of stop; `at` if there is none."""
    end = run(text, at + 1, lambda c: not c.isspace() and c not in stop)
    return end + 1 if text[end : end + 1] == ")" else at


def address_in_prose(text: str, at: int) -> Span | None:
    """An address may hold parentheses in pairs, and ends before any other bracket."""
    while m := ADDRESS_HEAD.search(text, at):
        end = m.end()
        while True:
            after = run(text, end, lambda c: not c.isspace() and c not in "<>()[]")
            if text[after : after + 1] == "(":
                after = bracketed(text, after, "<>()[]")
            if after == end:
                break
            end = after
        if end > m.end():
            return m.start(), end
        at = m.end()
    return None


def mail_parts(text: str, at: int) -> Iterator[tuple[int, int, int]]:
    """(start of the local part, at sign, end of the host's first label) of what may be a mail address."""
    low = at
    while (sign := text.find("@", at)) >= 0:
        start = sign
        while start > low and (name_char(text[start - 1]) or text[start - 1] in ".+-"):
            start -= 1
        label = run(text, sign + 1, lambda c: name_char(c) or c == "-")
        if start < sign and label > sign + 1 and text[label : label + 1] == ".":
            yield start, sign, label
        at = sign + 1


def mail_in_prose(text: str, at: int) -> Span | None:
    """The host ends with a label."""
    for start, _, end in mail_parts(text, at):
        labels = 0
        while text[end : end + 1] == "." and (after := run(text, end + 1, lambda c: name_char(c) or c == "-")) > end + 1:
            end, labels = after, labels + 1
        if labels:
            return start, end
    return None


def link_target(text: str, at: int) -> Span | None:
    """](...), with parentheses in pairs inside."""
    while (start := text.find("](", at)) >= 0:
        end = start + 2
        while True:
            after = run(text, end, lambda c: not c.isspace() and c not in "()")
            if text[after : after + 1] == "(":
                after = bracketed(text, after, "()")
            if after == end:
                break
            end = after
        if text[end : end + 1] == ")":
            return start, end + 1
        at = start + 2
    return None


def over_spaces(text: str, at: int, separators: str, inner: Callable[[str], bool]) -> int:
    """Behind spaces at `at` and what makes them part of a path: one to three words up to a separator, or one word with a file extension
    before white space or the end. `at` if neither follows."""
    first = run(text, at, " ".__eq__)
    word_end = run(text, first, lambda c: not c.isspace() and c not in OUTSIDE and c not in "/\\:")
    end, words = at, 0
    while words < SPACED_WORDS:
        word = run(text, end, " ".__eq__)
        if word == end or not (name_char(text[word : word + 1]) or text[word : word + 1] == "("):
            break
        end, words = run(text, word, inner), words + 1
        if text[end : end + 1] and text[end] in separators:
            return end
    if EXTENSION.search(text, first, word_end) and (word_end == len(text) or text[word_end].isspace()):
        return word_end
    return at


def windows_tail(text: str, at: int) -> int:
    while True:
        end = run(text, at, lambda c: not c.isspace() and c not in OUTSIDE)
        if text[end : end + 1] == " ":
            end = over_spaces(text, end, "/\\", lambda c: not c.isspace() and c not in OUTSIDE and c not in "/\\:")
        if end == at:
            return at
        at = end


DRIVE, SERVER = re.compile(r"[A-Za-z]:[\\/]"), re.compile(r"\\\\[^\s<>\[\]/\\:]+\\")


def windows_path(text: str, at: int) -> Span | None:
    """By drive or by server."""
    drives = (m for m in DRIVE.finditer(text, at) if not m.start() or not (text[m.start() - 1].isascii() and text[m.start() - 1].isalnum()))
    heads = [m for m in (next(drives, None), SERVER.search(text, at)) if m]
    if not heads:
        return None
    first = min(heads, key=lambda m: m.start())
    return first.start(), windows_tail(text, first.end())


ROOT = re.compile(r"(?:~|\.{1,2})?/")


def unix_segment(text: str, at: int) -> int:
    while True:
        end = run(text, at, lambda c: name_char(c) or c in ".-")
        if text[end : end + 1] == "(":
            end = bracketed(text, end, "<>()[]")
        elif text[end : end + 1] == " ":
            end = over_spaces(text, end, "/", lambda c: name_char(c) or c in ".-()")
        if end == at:
            return at
        at = end


def unix_path(text: str, at: int) -> Span | None:
    """From the root, the home folder or a relative one."""
    for m in ROOT.finditer(text, at):
        before = text[m.start() - 1] if m.start() else " "
        if name_char(before) or before in "/:~.":
            continue
        end = unix_segment(text, m.end())
        if end == m.end():
            continue
        while text[end : end + 1] == "/" and (after := unix_segment(text, end + 1)) > end + 1:
            end = after
        return m.start(), end + (text[end : end + 1] == "/")
    return None


def every(scan: Scanner, text: str) -> list[Span]:
    """All places of one scanner."""
    out: list[Span] = []
    while found := scan(text, out[-1][1] if out else 0):
        out.append(found)
    return out


#: What a rewriter must hand back as it was, beside fences and placeholders.
FROM_REWRITERS = (code_run, address_in_prose, mail_in_prose, link_target, windows_path, unix_path)


def rules_pattern() -> str:
    """What wording rules leave alone: code, addresses, mail and paths. The place that begins first counts, of two that begin together the one listed first. Runs
    are possessive, so that no text is gone over more than a few times."""
    space, word, bare = r"\s\x1c-\x1f\x85\p{Z}", r"\p{L}\p{N}_", "<>\\[\\]"
    end = f"(?=[{space}]|\\z)"
    named = f" ++[^{space}{bare}/\\\\:]*\\.[A-Za-z0-9]{{1,8}}{end}"  # a word with an extension, the last of a path
    onward = lambda inner, separators: f"(?: ++(?=[{word}(])[{inner}]++){{1,{SPACED_WORDS}}}(?=[{separators}])"  # noqa: E731  words up to a separator
    parts = f"(?:[^{space}{bare}]++|{onward(f'^{space}{bare}/{chr(92)}{chr(92)}:', '/' + chr(92) * 2)}|{named})*+"
    segment = f"(?:[{word}.-]++|\\([^{space}{bare}()]*+\\)|{onward(f'{word}.()-', '/')}|{named})"
    return "|".join([
        "```(?s:.*?)```",
        "`[^`\\n]+`",
        f"(?:https?://|www\\.)[^{space}]++",
        f"(?<![{word}.+-])[{word}.+-]++@[{word}-]++\\.[{word}.-]++",
        f"(?:(?<![A-Za-z0-9])[A-Za-z]:[/\\\\]|\\\\\\\\[^{space}{bare}/\\\\:]++\\\\){parts}",
        f"(?<![{word}/:~.])(?:~|\\.{{1,2}})?/{segment}++(?:/{segment}++)*+/?",
    ])


FROM_RULES = rules_pattern()
#: What every text with such a place has.
HINT = r"[`@/\\]|www\."
