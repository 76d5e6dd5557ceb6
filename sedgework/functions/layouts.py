"""Top-level fields of JSON objects: their types, value sketches, and which of two layouts' fields are one under two names."""

from __future__ import annotations

import json
import math
import re
import sys
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

#: The types a field's value can have; null is none.
STRING, WHOLE, POINT, BOOLEAN, OBJECT, ARRAY = "string", "whole", "point", "boolean", "object", "array"
#: In a chunk's summary: the type is the one that the field had before the chunk, if it was there.
CARRIED = "?"


@dataclass(frozen=True)
class Deep:
    """A value nested deeper than Python's own reader goes: its type and its JSON text."""

    kind: str
    text: str


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse_object(body: str | None) -> dict | None:
    """The object that body is, None if it is null, no JSON or no object. Of a repeated name the last value holds.

    Numbers have any number of digits and values any depth; one too deep for Python's reader comes as Deep.
    """
    if body is None:
        return None
    sys.set_int_max_str_digits(0)
    try:
        found = json.loads(body, parse_constant=_no_constant)
    except RecursionError:
        return _shallow(body)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))')
_SPACES = re.compile(r"[ \t\n\r]*")


def _shallow(body: str) -> dict | None:
    """parse_object without recursion: the whole text is checked, values of the top level that hold others are kept as text."""
    found: dict = {}
    stack: list[str] = []
    # what may come: a value, a value or the end, a name, a name or the end, a colon, a comma or the end
    expect, at, name, begin = "value", 0, None, 0
    while True:
        token = _TOKEN.match(body, at)
        if not token:
            return None
        sign, text, other = token.groups()
        start, at = token.start(token.lastindex), token.end()
        if text is not None and expect in ("name", "name_or_end"):
            if len(stack) == 1:
                name = json.loads(text)
            expect = "colon"
            continue
        if sign == ":" and expect == "colon":
            expect = "value"
            continue
        if sign == "," and expect == "next":
            expect = "name" if stack[-1] == "{" else "value"
            continue
        if sign in ("{", "[") and expect in ("value", "value_or_end"):
            if not stack and sign == "[":
                return None
            if len(stack) == 1:
                begin = start
            stack.append(sign)
            expect = "name_or_end" if sign == "{" else "value_or_end"
            continue
        if sign in ("}", "]") and expect in ("next", "name_or_end" if sign == "}" else "value_or_end") and stack[-1] == ("{" if sign == "}" else "["):
            stack.pop()
            if not stack:
                return found if _SPACES.fullmatch(body, at) else None
            if len(stack) == 1:
                found[name] = Deep(OBJECT if sign == "}" else ARRAY, body[begin:at])
        elif sign is None and stack and expect in ("value", "value_or_end"):
            if len(stack) == 1:
                found[name] = json.loads(text or other)
        else:
            return None
        expect = "next"


def type_of(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, Deep):
        return value.kind
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return WHOLE
    if isinstance(value, float):
        return POINT
    if isinstance(value, str):
        return STRING
    return OBJECT if isinstance(value, dict) else ARRAY


def width_of(value: object) -> int:
    """0 for whole numbers of 64 bits and all that is no whole number, 1 for longer ones of at most 38 digits, 2 beyond."""
    if isinstance(value, bool) or not isinstance(value, int) or -(2**63) <= value < 2**63:
        return 0
    return 1 if abs(value) < 10**38 else 2


def text_of(value: object) -> str:
    """A string as it is, anything else as JSON text."""
    if isinstance(value, str):
        return value
    return value.text if isinstance(value, Deep) else json.dumps(value, ensure_ascii=False)


def sketch(value: object) -> list[float]:
    """A few numbers in [0, 1] that describe a value whatever its type: length, shares of digits, letters and hex digits, variety."""
    text = text_of(value)
    n = len(text)
    if not n:
        return [0.0] * 5
    count = Counter(text)
    share = lambda among: sum(m for c, m in count.items() if among(c)) / n
    return [round(x, 4) for x in (min(1.0, math.log1p(n) / 12), share(str.isdigit), share(str.isalpha), share("0123456789abcdef".__contains__), len(count) / min(n, 64))]


def words(name: str) -> list[str]:
    """The words of a name in any of the usual spellings: schema_version, schemaVersion, SCHEMA-VERSION."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+", name)]


def name_similarity(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of both names' words, 1 for names that differ in spelling only."""
    pairs = lambda name: [w[i : i + 2] for w in words(name) for i in range(max(1, len(w) - 1))]
    x, y = pairs(a), pairs(b)
    if not x or not y:
        return float(a == b)
    rest, both = list(y), 0
    for p in x:
        if p in rest:
            rest.remove(p)
            both += 1
    return 2 * both / (len(x) + len(y))


def sketch_similarity(a: Sequence[float] | None, b: Sequence[float] | None) -> float:
    if not a or not b:
        return 0.0
    return 1 - sum(abs(x - y) for x, y in zip(a, b, strict=True)) / len(a)


def assign(cost: list[list[float]]) -> list[int]:
    """Bipartite matching of least cost: for each row its column. No more rows than columns. Successive shortest ways with potentials."""
    n, m = len(cost), len(cost[0]) if cost else 0
    u, v, of = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], j0 = i, 0
        least, back, used = [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while of[j0]:
            used[j0] = True
            i0, delta, j1 = of[j0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    now = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if now < least[j]:
                        least[j], back[j] = now, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[of[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
        while j0:
            of[j0], j0 = of[back[j0]], back[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


#: What is known of a field: its type (None if only nulls were seen) and the sketch of its last value that wasn't null.
Known = tuple[str | None, list[float] | None]


def renames(gone: Mapping[str, Known], come: Mapping[str, Known]) -> dict[str, str]:
    """New name -> old name: within each type as many pairs as can be, those being most alike in name and values together."""
    found: dict[str, str] = {}
    for kind in sorted({t for t, _ in gone.values() if t} & {t for t, _ in come.values() if t}):
        old, new = sorted(k for k, x in gone.items() if x[0] == kind), sorted(k for k, x in come.items() if x[0] == kind)
        cost = [[2 - name_similarity(a, b) - sketch_similarity(gone[a][1], come[b][1]) for b in new] for a in old]
        if len(old) <= len(new):
            found |= {new[j]: old[i] for i, j in enumerate(assign(cost))}
        else:
            found |= {new[i]: old[j] for i, j in enumerate(assign([list(x) for x in zip(*cost, strict=True)]))}
    return found


State = dict[str, Known]


def step(state: State | None, layout: State) -> tuple[State, list[tuple[str, str, str]]]:
    """The state after a file of that layout, and its changes (field, kind of change, former name or '').

    state: what is known of the fields of the file before, None if there is none. A field's former type
    is that of its latest value that wasn't null since it last appeared.
    """
    changes: list[tuple[str, str, str]] = []
    after: State = {}
    for name, (kind, drawn) in layout.items():
        if state is not None and name in state:
            former = state[name]
            if kind and former[0] and former[0] != kind:
                changes.append((name, "retyped", ""))
            after[name] = (kind, drawn) if kind else former
        else:
            after[name] = (kind, drawn)
    if state is not None:
        gone = {k: x for k, x in state.items() if k not in layout}
        come = {k: x for k, x in layout.items() if k not in state}
        renamed = renames(gone, come)
        changes += [(new, "renamed", old) for new, old in sorted(renamed.items())]
        changes += [(k, "added", "") for k in sorted(come) if k not in renamed]
        changes += [(k, "removed", "") for k in sorted(gone) if k not in renamed.values()]
    return after, changes


def summary(layouts: Sequence[State]) -> State:
    """The state after a chunk of files whatever was before: a field that was in every file and always null carries what it had."""
    state: State = {k: x if x[0] else (CARRIED, None) for k, x in layouts[0].items()}
    for layout in layouts[1:]:
        state = {k: x if x[0] else state.get(k, (None, None)) for k, x in layout.items()}
    return state


def carried(state: State | None, after: State) -> State:
    """The state after a chunk, given the state before it and the chunk's summary."""
    return {k: (state or {}).get(k, (None, None)) if x[0] == CARRIED else x for k, x in after.items()}
