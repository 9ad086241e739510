"""Boolean trigram queries that every match of a regular expression satisfies.

A query is True (no trigram is mandatory), ("and", queries) or ("or", queries)
or a trigram of lower-cased ASCII bytes.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser

#: Exact alternatives carried along; beyond this their trigrams are taken and the rest starts afresh.
MOST = 64

Query = bool | str | tuple


def both(kind: str, parts: list[Query]) -> Query:
    """and / or of parts, simplified."""
    flat: list[Query] = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
            continue
        for q in p[1] if isinstance(p, tuple) and p[0] == kind else [p]:
            if q not in flat:
                flat.append(q)
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (kind, flat)


def of_words(words: set[str]) -> Query:
    """What holds if one of the words occurs."""
    return both("or", [both("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)]) if words else True


def _characters(items) -> set[str] | None:
    """The characters of a class, if few and ASCII."""
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 and all(x.isascii() for x in found) else None


def _walk(tree) -> tuple[set[str] | None, Query]:
    """All strings that tree can match, if few; what holds of its matches otherwise."""
    exact: set[str] = {""}
    known: list[Query] = []

    def flush() -> None:
        nonlocal exact
        known.append(of_words(exact))
        exact = {""}

    broken = False
    for op, value in tree:
        words: set[str] | None
        query: Query = True
        if op is C.LITERAL:
            words = {chr(value).lower()} if value < 128 else None
        elif op is C.IN:
            words = _characters(value)
        elif op is C.SUBPATTERN:
            words, query = _walk(value[3])
        elif op is C.BRANCH:
            subs = [_walk(x) for x in value[1]]
            words = set().union(*(w for w, _ in subs)) if all(w is not None for w, _ in subs) else None
            query = both("or", [of_words(w) if w is not None else q for w, q in subs])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, sub = value
            inner, held = _walk(sub)
            words = None
            if inner is not None and least == most == 1:
                words = inner
            elif inner is not None and (least, most) == (0, 1):
                words = inner | {""}
            elif inner is not None and least == most and len(inner) == 1 and least <= 16:
                words = {next(iter(inner)) * least}
            elif least:
                query = of_words(inner) if inner is not None else held
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            words = {""}
        else:
            words = None
        if words is None or len(exact) * len(words) > MOST:
            broken = True
            flush()
            if words is not None:
                exact = set(words)
            else:
                known.append(query)
        else:
            exact = {a + b for a in exact for b in words}
    if not broken:
        return exact, of_words(exact)
    flush()
    return None, both("and", known)


def of_pattern(pattern: str) -> Query:
    """The query of a pattern; True if it has no mandatory trigram."""
    exact, query = _walk(_parser.parse(pattern))
    return of_words(exact) if exact is not None else query


def of_query(query: Query) -> set[str]:
    """The trigrams that a query names."""
    return {query} if isinstance(query, str) else set().union(*map(of_query, query[1])) if isinstance(query, tuple) else set()
