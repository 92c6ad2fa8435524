"""What a pattern's text tells before any line is read: plain functions that run once per query."""

from __future__ import annotations

import re
from re import _parser  # the expression as a tree; there is no public way to it

TAG = "<HOST>"
#: What stands for the host: IPv4, mapped IPv4 or the characters of IPv6. Fixed value.
HOST = r"((?:::[fF]{4}:)?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[0-9a-fA-F:]{2,39})"
_META = r"\\.*+?()[]{}|^$"


def expand_host(pattern: str, dialect: str = "java") -> str:
    """The regular expression of a pattern with one ``<HOST>``; for Java, ``.`` stops at line feeds alone."""
    n = pattern.count(TAG)
    if n != 1:
        raise ValueError(f"pattern needs one {TAG}, has {n}: {pattern}")
    return ("(?d)" if dialect == "java" else "") + pattern.replace(TAG, HOST)


def host_group_index(pattern: str) -> int:
    """The number of the host's group: one more than the capturing groups that open before it."""
    before = re.sub(r"\\.", "", pattern[: pattern.index(TAG)])
    before = re.sub(r"\[\^?\]?[^\]]*\]", "", before)
    return 1 + len(re.findall(r"\((?!\?)|\(\?P?<(?![=!])", before))


def _literals(text: str) -> list[str]:
    return re.split(f"[{re.escape(_META)}]", text)


def literal_prefix(pattern: str) -> str | None:
    """The plain text before the host that a matching line should hold: the last run if it has three characters,
    else the longest that has, else a short last run."""
    at = pattern.find(TAG)
    runs = _literals(pattern[: max(at, 0)])
    long = max(runs, key=len)
    return next((r for r in (runs[-1] if len(runs[-1]) >= 3 else "", long if len(long) >= 3 else "", runs[-1]) if r), None)


def host_extractor(pattern: str) -> tuple[str, str | None]:
    """How the positional mode finds the host: at ``start``, ``after`` or ``before`` a literal, or by its ``group``."""
    if TAG not in pattern:
        return "group", None
    before, after = pattern.split(TAG, 1)
    if not before.strip("^"):
        return "start", None
    left, right = _literals(before)[-1], _literals(after)[0]
    if len(left) >= 2 and left not in before[: len(before) - len(left)]:
        return "after", left
    if len(right) >= 2 and right not in before:
        return "before", right
    return "group", None


def guards(pattern: str) -> tuple[str, ...] | None:
    """Literals of which every match of the pattern holds at least one, as specific as they come, or None.

    Read off the parsed expression: runs of plain characters, the items of groups, what is repeated at least once, and
    of alternatives one literal each. Literals of less than three characters guard nothing.
    """
    tree = _parser.parse(expand_host(pattern, "re2"))
    if tree.state.flags & re.IGNORECASE:
        return None
    found = _guards(tree)
    return found if found and min(map(len, found)) >= 3 else None


def _guards(items) -> tuple[str, ...]:
    options: list[tuple[str, ...]] = []
    run = ""
    for kind, value in [*items, (None, None)]:
        if kind is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append((run,))
            run = ""
        if kind is _parser.SUBPATTERN:
            options.append(_guards(value[-1]))
        elif kind is _parser.BRANCH:
            own = [_guards(v) for v in value[1]]
            options.append(tuple(dict.fromkeys(x for o in own for x in o)) if all(own) else ())
        elif kind in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0] >= 1:
            options.append(_guards(value[2]))
    return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=())


_WORD = "A-Za-z0-9_"
#: What divides a line into words.
NO_WORD = f"[^{_WORD}]+"
#: Characters of a gram.
GRAM = 5


def index_choices(regex: str) -> tuple[tuple[tuple[str, str], ...], ...]:
    """For each literal that guards an expanded expression the keys (kind, text) that stand for it; none if unknown.

    ``word``: every whole word inside it that is not a number; or else ``gram``, its first characters. Whichever is
    taken for each literal, every line that the expression matches holds at least one of those taken.
    """
    try:
        tree = _parser.parse(regex.removeprefix("(?d)"))
    except re.error:  # what only Java understands
        return ()
    out = []
    for text in () if tree.state.flags & re.IGNORECASE else _guards(tree):
        words = [w for w in re.findall(f"(?<=[^{_WORD}])[{_WORD}]{{3,}}(?=[^{_WORD}])", text) if not w.isdigit()]
        if not words and len(text) < GRAM:
            return ()
        out.append(tuple(("word", w) for w in dict.fromkeys(words)) or (("gram", text[:GRAM]),))
    return tuple(dict.fromkeys(out))


def index_keys(regex: str) -> tuple[tuple[str, str], ...]:
    """Keys of which every line that an expanded expression matches holds at least one: the longest for each literal; none if unknown."""
    return tuple(dict.fromkeys(max(own, key=lambda k: len(k[1])) for own in index_choices(regex)))


def required_literal(pattern: str) -> str | None:
    """The literal that every match holds for certain, or None where there is none or several stand for each other."""
    found = guards(pattern)
    return found[0] if found and len(found) == 1 else None
