"""JSON inside pages and bodies: fragments, states, nested lists, leaves, overlays.

Small helpers walk one body each; Spark batches them through Arrow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_safe import dumps, loads, within

#: How deep lists are looked for, how many items are entered, and how many are judged (fixed values).
DEPTH, WIDTH, LOOKED_AT = 6, 10, 20
#: Keys that name lists of records, keys of graph pages, and what records hold (fixed values).
RECORD_KEYS = frozenset("data edges entries items jobs listings nodes posts products records results".split())
GRAPH_KEYS = frozenset("edges nodes".split())
MARKS = frozenset("name node title url".split())
#: Points of a list beside one for each object (fixed values), and the least number and share of
#: objects that must hold a field of the surface (fixed values).
POINTS = {"named": 20, "graph": 10, "marked": 5}
LEAST, SHARE = 2, 0.25
#: Scripts whose id names a page's state, and names that scripts assign it to: short lists of our own.
STATE_IDS = ("__NEXT_DATA__", "__NUXT_DATA__")
STATE_NAMES = ("__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__NUXT__", "__STATE__")
WRAPPERS = frozenset(("Reactive", "ShallowReactive", "Ref", "ShallowRef"))
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')
_PUSH = re.compile(r'self\.__next_f\.push\(\[1,\s*"((?:[^"\\]|\\.)*)"\]\)', re.S)
_ROW = re.compile(rb"([0-9a-f]+):(?:T([0-9a-f]+),)?")
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)


def fragment(text: str) -> str:
    """The first balanced object or array in a text; brackets inside strings don't count."""
    depth = start = 0
    for m in _TOKEN.finditer(text, next((m.start() for m in re.finditer(r"[\[{]", text)), len(text))):
        if m[0][0] == '"':
            continue
        if m[0] in "{[":
            start = m.start() if not depth else start
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return ""


def likeness(name: str, items: list) -> int:
    """How much a list under a name looks like records; 0 where it holds no object."""
    objects = sum(1 for x in items[:LOOKED_AT] if x and isinstance(x, dict))
    name = name.strip().lower()
    signs = {"named": name in RECORD_KEYS, "graph": name in GRAPH_KEYS, "marked": any(MARKS & x.keys() for x in items[:WIDTH] if isinstance(x, dict))}
    return objects and objects + sum(POINTS[sign] for sign, shown in signs.items() if shown)


def of_surface(items: list, fields: frozenset[str]) -> bool:
    """Enough of the first objects hold a field of the surface, themselves or one object further in."""
    objects = [x for x in items[:LOOKED_AT] if x and isinstance(x, dict)]
    plain = lambda k: re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", k).lower()).strip("_")
    holds = lambda x: any(plain(k) in fields for k in (*x, *(k for v in x.values() if isinstance(v, dict) for k in v)))
    return not fields or not objects or sum(map(holds, objects)) >= max(LEAST, math.ceil(SHARE * len(objects)))


def best_list(body, fields: frozenset[str] = frozenset()) -> list:
    """The list of a body that looks most like records, the longer and then the earlier of equals.

    Objects and lists are noted in page order, each with its holder and the name it goes by
    there; then, from the last to the first, each hands its best list up, to be judged again by that
    name.  A list that is named like records hides those inside it; one whose objects hold too few of
    the surface's ``fields`` doesn't count, but those inside it may.
    """
    noted = [(0, "", (), 0, body)]  # holder, name there, place there, depth, value
    offers: list[list] = []
    for k, (_, _, _, depth, value) in enumerate(noted):  # grows as it goes
        offers.append([])
        own = [("list", (0,), value)] if isinstance(value, list) else [(n, (i,), v) for i, (n, v) in enumerate(value.items())] if isinstance(value, dict) else []
        for name, place, x in own if depth <= DEPTH else ():
            if isinstance(x, list):
                points = likeness(name, x) if of_surface(x, fields) else 0
                if points:
                    offers[k].append((points, len(x), place, x))
                if not points or isinstance(value, list) or name.strip().lower() not in RECORD_KEYS:
                    noted += [(k, "nested", (*place, i), depth + 1, y) for i, y in enumerate(x[:WIDTH], 1)]
            elif isinstance(x, dict):
                noted.append((k, name, place, depth + 1, x))
    best: list = []
    for k in range(len(noted) - 1, -1, -1):
        holder, name, place, _, _ = noted[k]
        best = min(offers[k], key=lambda o: (-o[0], -o[1], o[2]))[3] if offers[k] else []
        if best and k:
            offers[holder].append((likeness(name, best), len(best), place, best))
    return best


def revive(slots):
    """A list of slots that refer to each other by number, as the tree that it stands for."""
    if not isinstance(slots, list) or not slots:
        return slots
    made: dict[int, object] = {}
    todo = [0]

    def child(ref):
        if isinstance(ref, bool) or not isinstance(ref, int):
            return ref
        met = set()
        while 0 <= ref < len(slots) and ref not in made:  # through wrappers, however many
            value = slots[ref]
            if not (isinstance(value, list) and len(value) == 2 and isinstance(value[0], str) and value[0] in WRAPPERS and isinstance(value[1], int)):
                made[ref] = {} if isinstance(value, dict) else [] if isinstance(value, list) else value
                if isinstance(value, (dict, list)):
                    todo.append(ref)
                break
            if ref in met:  # a wrapper around itself holds nothing
                return None
            met.add(ref)
            ref = value[1]
        return made.get(ref)

    todo.clear()
    root = child(0)
    while todo:
        at = todo.pop()
        value, out = slots[at], made[at]
        if isinstance(value, dict):
            out.update((str(k), child(v)) for k, v in value.items())
        else:
            out.extend(child(v) for v in value)
    return root


def pushed_rows(html: str) -> dict[str, object]:
    """Rows of a state that a page pushes in pieces: id to value, in order.

    Pieces are joined first, so a row may be cut anywhere.  A row is JSON up to the line's end, or
    after T and a length in hexadecimal so many bytes of text.  Others (instructions) are left out.
    """
    pieces = (loads(f'"{m[1]}"') for m in _PUSH.finditer(html))
    data, at, rows = "".join(p for p in pieces if isinstance(p, str)).encode("utf-8", "replace"), 0, {}
    while m := _ROW.match(data, at):
        name, size = m[1].decode(), m[2]
        end = m.end() + int(size, 16) if size is not None else data.find(b"\n", m.end())
        end = len(data) if end < 0 else end
        body = data[m.end() : end].decode("utf-8", "replace")
        value = body if size is not None else loads(body.strip())
        if value is not None:
            rows[name] = value
        at = end + (size is None)
        at += data[at : at + 1] == b"\n" and size is not None
    return rows


def pushed(html: str) -> list:
    """The objects and lists among the pushed rows.  The first reference to a row ("$3", "$L3") is
    replaced by its value, later ones stay, so that nothing is written twice; all stay where the whole gets too deep."""
    rows, met = pushed_rows(html), set()
    todo = [x for x in reversed(rows.values()) if isinstance(x, (dict, list))]
    while todo:  # row by row, each to its leaves
        x = todo.pop()
        inner = []
        for k, v in list(x.items() if isinstance(x, dict) else enumerate(x)):
            m = re.fullmatch(r"\$[L@]?([0-9a-f]+)", v) if isinstance(v, str) else None
            if m and m[1] in rows and m[1] not in met and not _holds(rows[m[1]], x):
                met.add(m[1])
                x[k] = rows[m[1]]
            elif isinstance(v, (dict, list)):
                inner.append(v)
        todo += reversed(inner)
    made = [x for name, x in rows.items() if isinstance(x, (dict, list)) and x and name not in met]
    return made if within(made) else [x for x in pushed_rows(html).values() if isinstance(x, (dict, list)) and x]


def _holds(node, part) -> bool:
    """Is ``part`` inside a tree?  A row that holds the reference can't be put in its place."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x is part:
            return True
        todo += [y for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) if isinstance(y, (dict, list))]
    return False


def states(html: str) -> Iterator[tuple[str, object]]:
    """(name, payload) of the state objects that a page carries."""
    for attrs, body in _SCRIPT.findall(html):
        name = re.search(r"""\bid=["']?([\w-]+)""", attrs)
        if name and name[1] in STATE_IDS and (value := loads(body.strip())) is not None:
            yield name[1], revive(value) if name[1] == "__NUXT_DATA__" else value
            continue
        for known in STATE_NAMES:
            m = re.search(rf"\b{known}\s*=\s*", body)
            if m and (value := loads(fragment(body[m.end() :]))) is not None:
                yield known, value
    if "__next_f" in html and (rows := pushed(html)):
        yield "__NEXT_F__", rows


def embedded(html: str) -> Iterator[object]:
    """Payloads of JSON scripts and of assignments that are no known state."""
    for attrs, body in _SCRIPT.findall(html):
        if re.search(r"""type=["']application/json""", attrs, re.I):
            value = loads(body.strip())
        else:
            m = re.search(r"(?:var|let|const|window\.)\s*[\w.$]+\s*=\s*(?=[\[{])", body)
            value = loads(fragment(body[m.end() :])) if m else None
        if isinstance(value, (dict, list)) and value:
            yield value


def leaves(node, depth: int = 4, only: frozenset[str] | None = None) -> list:
    """Scalars of a tree down to a depth, in order; ``only``: those under these keys."""
    out: list = []

    def walk(x, left, taken):
        if isinstance(x, (dict, list)):
            if left > 0:
                for k, v in x.items() if isinstance(x, dict) else ((None, v) for v in x):
                    walk(v, left - 1, taken or only is None or k is not None and k.casefold() in only)
        elif taken:
            out.append(x)

    walk(node, depth, only is None)
    return [x for x in out if x not in (None, "")]


def overlay(base, extra):
    """Two trees as one: objects merge by key, the base's values stay unless empty."""
    if isinstance(base, dict) and isinstance(extra, dict):
        return {k: overlay(base.get(k), extra.get(k)) for k in {**base, **extra}}
    return extra if base in (None, "", [], {}) else base


def has_path(node, path: str, through: tuple[str, ...] = ("hasVariant",)) -> bool:
    """Does a dotted path hold a value, in any element of arrays, or of the variants?"""
    front = [node]
    for step in path.split("."):
        after = []
        while front:
            x = front.pop()
            if isinstance(x, list):
                front += x
            elif isinstance(x, dict):
                after += [x[step]] if step in x else []
                front += [x[t] for t in through if t in x and t != step]
        front = after
    return any(x not in (None, "", [], {}) for x in front)


def _udf(kind, f):
    return F.pandas_udf(lambda *columns: pd.Series([f(*x) for x in zip(*columns, strict=True)], dtype=object), kind)


def nested_records(bodies: DataFrame, key: str, body: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(key, ord, record): the items of each body's best list, of a surface's ``fields`` if given."""
    wanted = frozenset(fields)
    pick = _udf(T.ArrayType(T.StringType()), lambda b: [dumps(x) for x in best_list(loads(b), wanted)])
    return bodies.select(key, F.posexplode(pick(F.col(body))).alias("ord", "record"))


def page_states(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, name, payload): states and embedded JSON (named ``embedded``) of each page."""
    pick = _udf(T.ArrayType(T.StringType()), lambda h: [dumps([n, v]) for n, v in [*states(h or ""), *(("embedded", v) for v in embedded(h or ""))]])
    rows = pages.select(key, F.explode(pick(F.col(html))).alias("pair"))
    return rows.select(key, F.get_json_object("pair", "$[0]").alias("name"), F.get_json_object("pair", "$[1]").alias("payload"))


def leaf_texts(c: Column, depth: int = 4, only: list[str] | None = None) -> Column:
    keys = None if only is None else frozenset(x.casefold() for x in only)
    return _udf(T.ArrayType(T.StringType()), lambda b: [x if isinstance(x, str) else dumps(x) for x in leaves(loads(b), depth, keys)])(c)


def merged(a: Column, b: Column) -> Column:
    """Two JSON objects overlaid, as canonical JSON."""
    return _udf(T.StringType(), lambda x, y: dumps(overlay(loads(x), loads(y))))(a, b)


def canonical(c: Column) -> Column:
    """JSON with sorted keys and no spaces; null for what is no JSON."""
    return _udf(T.StringType(), lambda x: None if (v := loads(x)) is None else dumps(v))(c)


def cache_key(parts: dict[str, Column]) -> Column:
    """sha256 of the canonical JSON of named texts."""
    return F.sha2(canonical(F.to_json(F.struct(*(c.alias(n) for n, c in parts.items())))), 256)


def path_present(c: Column, path: str) -> Column:
    return _udf(T.BooleanType(), lambda b: has_path(loads(b), path))(c)
