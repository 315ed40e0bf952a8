"""CSS and XPath rules over page trees: every rule of a domain in one pass over a page.

A selector is a chain of steps.  Steps of all rules of a domain share one bit vector; a node's
bits are the steps that some chain has reached at it, and follow from the bits of its parent,
its ancestors and its earlier siblings by a shift.  Rules are a table and meet pages by domain.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import SEAM

#: Matches that a rule takes from a page, and seconds that a pattern may search one (fixed values).
MOST, SECONDS = 12, 1.0
_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\.)+"
_CSS = re.compile(
    rf"\s*([>+~,])\s*|(\s+)|({_NAME}|\*)|#({_NAME})|\.({_NAME})|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+)\s*)?\]"
    r"|:(first-child|last-child|nth-child|nth-of-type|first-of-type|not)(?:\(\s*([^()]*?)\s*\))?"
)
_STEP = re.compile(r"(//|/)(?:@([\w:-]+)|(text\(\))|([\w-]+|\*)((?:\[(?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*\])*))")
_QUOTED = r"(?:\"([^\"]*)\"|'([^']*)')"
_TESTS = [
    (re.compile(rf"contains\(\s*concat\(\s*['\"] ['\"]\s*,\s*(?:normalize-space\(\s*)?@class\s*\)?\s*,\s*['\"] ['\"]\s*\)\s*,\s*{_QUOTED}\s*\)"), lambda m: ("attr", "class", "~=", (m[1] or m[2] or "").strip())),
    (re.compile(rf"contains\(\s*@([\w:-]+)\s*,\s*{_QUOTED}\s*\)"), lambda m: ("attr", m[1], "*=", m[2] or m[3] or "")),
    (re.compile(rf"starts-with\(\s*@([\w:-]+)\s*,\s*{_QUOTED}\s*\)"), lambda m: ("attr", m[1], "^=", m[2] or m[3] or "")),
    (re.compile(rf"@([\w:-]+)\s*=\s*{_QUOTED}"), lambda m: ("attr", m[1], "=", m[2] or m[3] or "")),
    (re.compile(r"@([\w:-]+)"), lambda m: ("attr", m[1], "", "")),
    (re.compile(rf"contains\(\s*(?:\.|text\(\))\s*,\s*{_QUOTED}\s*\)"), lambda m: ("text", "*=", m[1] or m[2] or "")),
    (re.compile(rf"(?:\.|text\(\)|normalize-space\(\))\s*=\s*{_QUOTED}"), lambda m: ("text", "=", m[1] or m[2] or "")),
]


class Step(NamedTuple):
    axis: str  # " " inside, ">" child, "+" next to, "~" after
    tag: str
    tests: tuple


def _formula(text: str) -> tuple[int, int]:
    """a and b of ``an+b``."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.lower(), text.lower()).replace(" ", "")
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text):
        return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)
    return 0, int(text)


def css(selector: str) -> list[tuple[list[Step], str]]:
    """The chains of a selector list, each with what it gives: ``node``.  ValueError if it is none."""
    chains, steps, tag, tests, axis, at = [], [], "", [], " ", 0
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)

    def put():
        nonlocal tag, tests
        if not tag and not tests:
            raise ValueError("empty step")
        steps.append(Step(axis, "" if tag == "*" else tag, tuple(tests)))
        tag, tests = "", []

    selector = selector.strip()
    while at < len(selector):
        m = _CSS.match(selector, at)
        if not m or m.end() == at:
            raise ValueError(selector[at:])
        at = m.end()
        joint, gap, name, ident, cls, attr, op, value, pseudo, inner = m.groups()
        if joint or gap:
            put()
            axis = joint or " "
            if joint == ",":
                chains.append(steps)
                steps, axis = [], " "
        elif name:
            if tag or tests:
                raise ValueError(name)
            tag = plain(name).lower()
        elif ident or cls:
            tests.append(("attr", "id", "=", plain(ident)) if ident else ("attr", "class", "~=", plain(cls)))
        elif attr:
            tests.append(("attr", attr.lower(), op or "", (value[1:-1] if value[:1] in "\"'" else value) if value else ""))
        elif pseudo == "not":
            inside = css(inner or "")
            if len(inside) != 1 or len(inside[0][0]) != 1:
                raise ValueError("not")
            tests.append(("not", inside[0][0][0]))
        elif pseudo == "last-child":
            tests.append(("last", False))
        else:
            tests.append(("nth", pseudo.endswith("type"), *((0, 1) if pseudo.startswith("first") else _formula(inner or ""))))
    put()
    return [(chain, "node") for chain in (*chains, steps)]


def xpath(path: str) -> list[tuple[list[Step], str]]:
    """The chains of a path, each with what it gives: ``node``, ``own`` text or ``@attribute``.

    Steps by name or ``*``, with attribute, text and position tests; anything else is a ValueError.
    """
    chains = []
    for one in re.split(r"\|(?=\s*\.?/)", path):
        one, steps, gives, at = one.strip().removeprefix("."), [], "node", 0
        while at < len(one):
            m = _STEP.match(one, at)
            if not m or gives != "node":
                raise ValueError(one[at:])
            at = m.end()
            if m[2] or m[3]:
                if not steps:
                    raise ValueError(one)
                if m[1] == "//":
                    steps.append(Step(" ", "", ()))
                gives = f"@{m[2].lower()}" if m[2] else "own"
                continue
            tag, tests = "" if m[4] == "*" else m[4].lower(), []
            for test in re.findall(r"\[((?:[^\[\]\"']|\"[^\"]*\"|'[^']*')*)\]", m[5]):
                for part in re.split(r"\s+and\s+(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$)", test.strip()):
                    if p := re.fullmatch(r"(?:position\(\)\s*=\s*)?(\d+)|last\(\)", part):
                        if tests:  # a place among those that passed the tests before it
                            raise ValueError(test)
                        tests.append(("nth", bool(tag), 0, int(p[1])) if p[1] else ("last", bool(tag)))
                    else:
                        made = next((make(x) for shape, make in _TESTS if (x := shape.fullmatch(part))), None)
                        if made is None:
                            raise ValueError(part)
                        tests.append(made)
            steps.append(Step(" " if m[1] == "//" else ">", tag, tuple(tests)))
        if not steps:
            raise ValueError(path)
        chains.append((steps, gives))
    return chains


class Nodes:
    """The arrays of one page."""

    def __init__(self, text, parent, last, nth, of_type, tag, attrs, start, end):
        self.text, self.parent, self.last, self.nth, self.of_type, self.tag = text, parent, last, nth, of_type, tag
        self.attrs, self.start, self.end = [dict(a) for a in attrs], start, end
        self.lasts: dict[tuple[int, str], int] = {}
        for i, p in enumerate(parent):
            self.lasts[p, ""] = self.lasts[p, tag[i]] = i

    def within(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def own(self, i: int) -> list[str]:
        """The texts directly in a node."""
        at, out, k = self.start[i], [], i + 1
        while k <= self.last[i]:
            out.append(self.text[at : self.start[k]])
            at, k = self.end[k], self.last[k] + 1
        return [*out, self.text[at : self.end[i]]]

    def passes(self, i: int, step: Step) -> bool:
        return (not step.tag or step.tag == self.tag[i]) and all(self._test(i, t) for t in step.tests)

    def _test(self, i: int, t: tuple) -> bool:
        if t[0] == "nth":
            a, b = t[2], (self.of_type if t[1] else self.nth)[i] - t[3]
            return b == 0 if a == 0 else b % a == 0 and b // a >= 0
        if t[0] == "last":
            return self.lasts[self.parent[i], self.tag[i] if t[1] else ""] == i
        if t[0] == "not":
            return not self.passes(i, t[1])
        if t[0] == "text":
            return _compare(" ".join(self.within(i).replace(SEAM, "").split()), t[1], t[2])
        value = self.attrs[i].get(t[1])
        return value is not None and _compare(value, t[2], t[3])


def _compare(value: str, op: str, want: str) -> bool:
    if op == "~=":
        return want in value.split()
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if op in ("^=", "$=", "*="):
        return bool(want) and {"^=": value.startswith, "$=": value.endswith, "*=": value.__contains__}[op](want)
    return value == want if op else True


class Automaton:
    """Chains of many rules as one bit vector: bit k is set at a node where step k is reached."""

    def __init__(self, chains: list[list[Step]]):
        self.steps = [s for chain in chains for s in chain]
        self.first, self.finals = 0, []
        for chain in chains:
            self.first |= 1 << (len(self.finals) and self.finals[-1] + 1)
            self.finals.append((self.finals[-1] if self.finals else -1) + len(chain))
        self.axis = {a: sum(1 << k for k, s in enumerate(self.steps) if s.axis == a) for a in " >+~"}
        self.tags: dict[str, int] = {}
        for k, s in enumerate(self.steps):
            self.tags[s.tag] = self.tags.get(s.tag, 0) | 1 << k

    def run(self, nodes: Nodes) -> list[list[int]]:
        """The nodes at which each chain ends, in page order."""
        n, first = len(nodes.tag), self.first
        at, above, before, older = [0] * n, [0] * n, {}, {}
        found: list[list[int]] = [[] for _ in self.finals]
        ends = {f: k for k, f in enumerate(self.finals)}
        free = first & self.axis[" "]  # a first step holds anywhere; after "/" only at the top
        top = free | first & self.axis[">"]
        for i in range(n):
            p = nodes.parent[i]
            upper, parent = (above[p] | at[p], at[p]) if p >= 0 else (0, 0)
            above[i] = upper
            may = (upper << 1) & self.axis[" "] | (parent << 1) & self.axis[">"] | (before.get(p, 0) << 1) & self.axis["+"] | (older.get(p, 0) << 1) & self.axis["~"]
            may = (may & ~first | (free if p >= 0 else top)) & (self.tags.get("", 0) | self.tags.get(nodes.tag[i], 0))
            bits = 0
            while may:
                low = may & -may
                k = low.bit_length() - 1
                may ^= low
                if nodes.passes(i, self.steps[k]):
                    bits |= low
                    if k in ends:
                        found[ends[k]].append(i)
            at[i], before[p] = bits, bits
            older[p] = older.get(p, 0) | bits
        return found


URLS, IMAGES = ("url", "apply_url"), ("image_url", "additional_images")
#: Attributes that stand for a node's text, in order (fixed values).
VALUES = ("content", "value", "datetime", "data-value", "data-price", "data-availability")


def node_value(nodes: Nodes, i: int, field: str) -> str:
    """What a field takes from a node: an address, an attribute that holds its value, or its text."""
    a = nodes.attrs[i]
    if field in IMAGES:
        names = ("content", "src", "data-src", "data-original", "href")
        return a.get("srcset", "").split(",")[0].split(" ")[0] or next((a[k] for k in names if a.get(k)), "")
    if field in URLS:
        return next((a[k] for k in ("href", "content", "data-apply-url") if a.get(k)), "")
    if nodes.tag[i] == "meta":
        return a.get("content", "")
    return next((a[k] for k in VALUES if a.get(k)), nodes.within(i).replace(SEAM, " "))


def _by_pattern(pattern: str, texts: list[str], first: bool) -> list[str]:
    """Of each match (the first of each text, or all) the first group that holds something, or the match."""
    out = []
    for text in texts:
        for m in regex.finditer(pattern, text, regex.DOTALL, timeout=SECONDS):
            out.append(next((g for g in m.groups() if g), m[0]))
            if first or len(out) >= MOST:
                break
    return out[:MOST]


class Rules:
    """A domain's rules, compiled once: XPath, or else CSS, kept by a pattern, or a pattern alone."""

    def __init__(self, rules: list[dict]):
        self.rules, chains, self.parts = rules, [], []
        for r in rules:
            part = {}
            for kind, make in (("xpath", xpath), ("css", css)):
                if r[kind]:
                    try:
                        made = make(r[kind])
                    except ValueError:
                        part[kind] = None
                        continue
                    part[kind] = [(len(chains) + k, gives) for k, (_, gives) in enumerate(made)]
                    chains += [steps for steps, _ in made]
            self.parts.append(part)
        self.automaton = Automaton(chains)

    def values(self, html: str, nodes: Nodes) -> list[tuple]:
        """(rule, field, ord, kind, value, problem) of a page."""
        ends, out = self.automaton.run(nodes), []
        for r, part in zip(self.rules, self.parts, strict=True):
            values, used, bad = [], None, [f"malformed {k}" for k, p in part.items() if p is None]
            for kind in ("xpath", "css"):
                if values or not part.get(kind):
                    continue
                used, hits = kind, sorted({(i, gives) for k, gives in part[kind] for i in ends[k]})
                for i, gives in hits[:MOST]:
                    values += [nodes.attrs[i].get(gives[1:], "")] if gives[0] == "@" else nodes.own(i) if gives == "own" else [nodes.within(i) if kind == "xpath" else node_value(nodes, i, r["field"])]
            try:
                if r["regex"] and values:
                    values = _by_pattern(r["regex"], [" ".join(v.replace(SEAM, "").split()) for v in values], True)
                elif r["regex"] and not r["xpath"] and not r["css"]:
                    used, values = "regex", _by_pattern(r["regex"], [html], False)
            except regex.error:
                bad, values = [*bad, "malformed regex"], []
            except TimeoutError:
                bad, values = [*bad, "slow regex"], []
            values = [x for v in values if (x := " ".join(v.replace(SEAM, "").split()))]
            out += [(r["rule"], r["field"], k, used, v, None) for k, v in enumerate(dict.fromkeys(values[:MOST]))]
            out += [(r["rule"], r["field"], None, None, None, b) for b in bad]
        return out


RULE = ("rule", "field", "xpath", "css", "regex")


def apply_rules(trees: DataFrame, rules: DataFrame, key: str, domain: str = "domain", html: str = "html") -> DataFrame:
    """(key, rule, field, ord, kind, value, problem) of each page's domain's rules.

    ``rules``: domain, rule, field, xpath, css, regex, is_active.  XPath comes first, CSS where it
    finds nothing, then the pattern keeps of each value what it matches; a pattern alone searches
    the page.  Values are distinct, ``MOST`` a rule at most (the rule's contract).  A malformed
    part gives a row with its problem and the rule's other parts still apply.  A page whose domain
    has no active rule, and a null domain, give no row.  The rules of a domain travel as one row; a domain's pages
    are dealt as the join deals them, split where AQE finds skew.
    """
    active = rules.where(F.coalesce("is_active", F.lit(True)) & F.col(domain).isNotNull())
    packed = active.groupBy(domain).agg(F.array_sort(F.collect_list(F.struct(*RULE))).alias("_rules"))
    pages = trees.select(key, domain, F.coalesce(F.col(html), F.lit("")).alias("_html"), "text", "nodes").join(packed, domain)
    each = "rule long, field string, ord int, kind string, value string, problem string"
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    schema = f"{key} {trees.schema[key].dataType.simpleString()}, {each}"
    names = ("parent", "last", "nth", "of_type", "tag", "attrs", "start", "end")

    def run(batches):
        ready: dict[str, Rules] = {}
        for batch in batches:
            owners, rows = [], []
            for k in range(batch.num_rows):
                name = batch.column(domain)[k].as_py()
                if name not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[name] = Rules(batch.column("_rules")[k].as_py())
                tree = batch.column("nodes")[k].values
                fields = [tree.field(n).to_pylist() for n in names] if tree is not None else [[] for _ in names]
                got = ready[name].values(batch.column("_html")[k].as_py(), Nodes(batch.column("text")[k].as_py() or "", *fields))
                rows += got
                owners += [k] * len(got)
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(owners, pa.int32())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [key, "rule", "field", "ord", "kind", "value", "problem"])

    return pages.mapInArrow(run, schema)


def first_values(found: DataFrame, key: str) -> DataFrame:
    """(key, field, values, rules): a field's distinct values in order of rule and place."""
    good = found.where("value is not null").groupBy(key, "field").agg(F.array_sort(F.collect_list(F.struct("rule", "ord", "value"))).alias("v"))
    return good.select(key, "field", F.array_distinct(F.transform("v", lambda x: x["value"])).alias("values"), F.array_distinct(F.transform("v", lambda x: x["rule"])).alias("rules"))
