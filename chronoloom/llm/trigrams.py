"""Boolean trigram queries from regular expressions.

A query is ``None`` (every text may match), a trigram, or ``("and" | "or", parts)``.
Any text that the expression matches satisfies its query once both are lower-cased.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

#: A run of exact strings is closed when it branches further than this.
MOST_STRINGS = 48


def _all(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list):
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    # a part that asks for all that another part asks for, and more, adds nothing
    wants = {p: {p} if isinstance(p, str) else set(p[1]) if p[0] == "and" else {p} for p in parts}
    parts = [p for p in parts if not any(wants[q] < wants[p] for q in parts)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """What a text must hold if it holds one of these strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _letters(items) -> set[str] | None:
    """The lower-cased members of a character class, or None if it is large or open."""
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The strings that a sequence matches, if they are few; what any match must hold."""
    run, needs, exact = {""}, [], True

    def close() -> None:
        nonlocal run, exact
        needs.append(_of_strings(run))
        run, exact = {""}, False

    def extend(strings: set[str]) -> None:
        nonlocal run
        if len(run) * len(strings) > MOST_STRINGS:
            close()
        run = {a + b for a in run for b in strings}

    for kind, value in nodes:
        if kind is op.LITERAL:
            extend({chr(value).lower()})
        elif kind is op.IN and (letters := _letters(value)):
            extend(letters)
        elif kind is op.SUBPATTERN:
            strings, need = _walk(value[-1])
            if strings:
                extend(strings)
            else:
                close()
                needs.append(need)
        elif kind is op.BRANCH:
            branches = [_walk(b) for b in value[1]]
            if all(s for s, _ in branches):
                extend(set().union(*(s for s, _ in branches)))
            else:
                close()
                needs.append(_any([_of_strings(s) if s else n for s, n in branches]))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = value
            strings, need = _walk(inner)
            if strings and (least, most) == (0, 1):
                extend(strings | {""})
            elif strings and least == most <= 4:
                for _ in range(least):
                    extend(strings)
            else:
                close()
                if least:
                    needs.append(_of_strings(strings) if strings else need)
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            pass  # matches no characters
        else:
            close()
    needs.append(_of_strings(run))
    return (run if exact else None), _all(needs)


def trigram_query(pattern: str):
    return _walk(parser.parse(pattern))[1]


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))
