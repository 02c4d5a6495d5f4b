"""Personal data by patterns and a skip-chain conditional random field.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers by
exact rules.  The field then labels every other token of a text that looks like
an identifier (it holds a digit, @ or _) or shares a key with another node:

* a node's potential comes from its shape;
* a chain potential joins neighbours;
* skip potentials join distant nodes through a hub for each key: the written
  form (``exact``) or what is left of it without separators, the country code
  or the host of an address (``similar``).  Edges grow with the nodes.

Base spans are observed, and so is the hub of a base span's keys: what the
patterns found is personal, however often it is repeated.  So each mention of a
known entity is judged on that hub and its own surroundings, and more mentions
never make one less private.  Loopy belief propagation carries labels on, along
chains and through the hubs of other repeated tokens; a place is added when it
is private with probability of at least ``SURE``.

All potentials are fitted together, as a pseudo-likelihood, on a sample of about
``SAMPLE`` texts by a hash of id and text, and used as fitted.  Patterns label
only what they match, so the fit sees each base span degraded (without what made
the pattern match): private in the text that holds the entity, not private in
one that doesn't; identifiers that nothing personal shares a key with are
negative.  The defaults are the prior's mean.

All searches run in time proportional to the text, also on long runs of digits
or letters.  Defined cases: a null text counts as empty; parts of a graph without
an observed span or a positive potential can't become private and are left
out before messages are passed; of overlapping places the first and longest
stays; repeated rows get equal answers; an empty table fits the default weights;
extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 2_000
SAMPLE_CHARS = 20_000
SURE = 0.9
ROUNDS = 20
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            after = m.end()
        else:
            after = max(after, at)  # what lies before this @ can't be part of a later address
        at = text.find("@", max(at + 1, after))


def base_spans(text: str | None) -> list[Span]:
    """All base spans, by start, then kind."""
    if not text:
        return []
    found: list[Span] = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := g.lstrip("0")) <= 3 and int(p or "0") <= 255 for g in m.groups()):
                found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(DIGIT.findall(m[0])) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# -- the field ------------------------------------------------------------------

WORD = re.compile("[^\x20\x09-\x0d]+")
MARK = re.compile("[0-9@_]")
GROUP = re.compile("[0-9]+")
DASHED = re.compile("(?<![0-9])[0-9]{1,3}(?:[-_][0-9]{1,3}){3}(?![0-9])")
TRIM = ",;:!?()[]{}<>\"'`*#$%&|~=."
BETWEEN = frozenset(" ().-")
LEAST_DIGITS, LEAST_LETTERS = 7, 6
"""Shorter numbers and names identify nobody."""
SHAPES = 9
OBSERVED = 30.0
"""Log odds of what is observed."""


def shape(word: str) -> int:
    """A token's features as bits."""
    digits = sum(c.isdigit() for c in word)
    marks = [
        "@" in word,
        digits >= 7,
        4 <= digits < 7,
        1 <= digits < 4,
        word[:1] == "+",
        word.count(".") >= 2,
        digits > 0 and any(c.isalpha() for c in word),
        len(word) >= 12,
        word.isalpha(),
    ]
    return sum(1 << i for i, m in enumerate(marks) if m)


@dataclass
class Weights:
    """Log odds of private by shape bits and bias; potentials of equal labels along chains and to hubs."""

    bits: tuple[float, ...] = (0.0,) * SHAPES
    bias: float = -3.0
    chain: float = 0.2
    exact: float = 6.0
    similar: float = 6.0

    def unary(self, features: int) -> float:
        return self.bias + sum(w for i, w in enumerate(self.bits) if features >> i & 1)


def lowered(text: str) -> str:
    """The text in lower case, each place kept: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def squeezed(word: str) -> str:
    """Letters and digits alone, in lower case."""
    return "".join(c for c in word.lower() if c.isalnum())


def digits_of(word: str) -> str:
    return "".join(GROUP.findall(word))


def keys_of(kind: str, value: str) -> list[tuple[str, str]]:
    """(key, exact form) of what a repetition of an entity shares with it."""
    if kind == "ip":
        return [(f"i:{value}", value)]
    if kind in ("card", "phone"):
        digits = digits_of(value)
        short = digits[-10:]
        return [(f"n:{digits}", digits)] + ([(f"n:{short}", digits)] if len(digits) > 10 and kind == "phone" else [])
    low = value.lower()
    local = low.split("@")[0]
    own = [(f"w:{squeezed(low)}", low)]
    return own + ([(f"w:{squeezed(local)}", local)] if len(squeezed(local)) >= LEAST_LETTERS and not local.isalpha() else [])


def degraded(kind: str, value: str) -> list[tuple[str, bool]]:
    """Forms of an entity that no pattern matches, and whether each is the key's exact form."""
    digits = digits_of(value)
    if kind == "ip":
        return [(value.replace(".", "-"), False)]
    if kind == "card":
        return [(".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), True)]
    if kind == "phone":
        return [(digits, True)] + ([(f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}", False)] if len(digits) > 10 else [])
    local = value.split("@")[0]
    if len(keys_of(kind, value)) == 1:
        return []
    return [(local, True), (re.sub("[.+%-]", "_", local) if re.search("[.+%-]", local) else f"{local[:3]}_{local[3:]}", False)]


@dataclass
class Node:
    """A place that the field labels: its span, key, exact form there, and the base kind it is observed as, if any."""

    start: int
    end: int
    key: str
    form: str
    kind: str | None = None


def _joins(letter: str) -> bool:
    """Whether a digit group beside this character is part of a word."""
    return letter.isalnum() or letter == "_"


def _numbers(text: str, wanted: frozenset[str]) -> Iterator[Node]:
    """Places, at bounds of digit groups, whose digits are those of a wanted number; the longest from each start."""
    most = max(map(len, wanted))
    groups = [(m.start(), m.end()) for m in GROUP.finditer(text)]
    after = 0
    for i, (start, _) in enumerate(groups):
        if start < after or (start and _joins(text[start - 1])):
            continue
        held, found = "", None
        for j in range(i, len(groups)):
            a, b = groups[j]
            if j > i and (a - groups[j - 1][1] > 2 or not BETWEEN.issuperset(text[groups[j - 1][1] : a])):
                break
            if len(held) + b - a > most:
                break
            held += text[a:b]
            if held in wanted and not _joins(text[b : b + 1]):
                found = Node(start, b, f"n:{held}", held)
        if found:
            after = found.end
            yield found


def _marked(text: str) -> Iterator[re.Match]:
    """The words that hold a mark."""
    after = 0
    while mark := MARK.search(text, after):
        start = max(text.rfind(c, after, mark.start()) for c in "\x20\t\n\x0b\x0c\r") + 1
        word = WORD.match(text, max(start, after))
        yield word
        after = word.end()


def nodes_of(text: str, base: list[Span]) -> list[Node]:
    """The field's nodes by place: base spans, places with a base span's key, and other tokens that look like identifiers."""
    known: dict[str, str] = {}
    taken = [Node(a, b, "", text[a:b], kind) for kind, a, b in base]
    for kind, a, b in base:
        for key, _ in keys_of(kind, text[a:b]):
            known.setdefault(key, kind)
    found: list[Node] = []
    if wanted := frozenset(k[2:] for k in known if k[0] == "n" and len(k) - 2 >= LEAST_DIGITS):
        found += _numbers(text, wanted)
    if any(k[0] == "i" for k in known):
        for m in DASHED.finditer(text):
            key = "i:" + re.sub("[-_]", ".", m[0])
            if key in known:
                found.append(Node(m.start(), m.end(), key, m[0]))
    low = lowered(text)
    letters = any(k[0] == "w" for k in known)
    for m in WORD.finditer(low) if letters else _marked(low):
        word = m[0]
        marked = MARK.search(word)
        bare = word.strip(TRIM)
        key = "w:" + (bare if bare.isalnum() else squeezed(bare))
        if not marked and key not in known or len(key) < 3:
            continue
        if bare.isascii() and not any(c.isalpha() for c in bare) and len(key) - 2 >= LEAST_DIGITS:
            key = "n:" + key[2:]
        start = m.start() + word.index(bare)
        found.append(Node(start, start + len(bare), key, key[2:] if key[0] == "n" else bare))
    # base spans come first, then what shares a key with one, then the rest
    out = _fitting([n for n in found if n.key in known], taken)
    out += _fitting([n for n in found if n.key not in known], taken + out)
    return sorted(out + taken, key=lambda n: (n.start, n.end))


def _fitting(places: list[Node], taken: list[Node]) -> list[Node]:
    """Of ``places`` the first and longest that overlap neither each other nor ``taken``."""
    limits = sorted((n.start, n.end) for n in taken)
    out: list[Node] = []
    i = reach = 0
    for place in sorted(places, key=lambda n: (n.start, -n.end)):
        while i < len(limits) and limits[i][0] < place.end:
            reach = max(reach, limits[i][1])
            i += 1
        if reach <= place.start and (not out or out[-1].end <= place.start):
            out.append(place)
    return out


@dataclass
class Graph:
    """Nodes, their neighbours in the chain, and for each hub its members with whether they are in its exact form."""

    nodes: list[Node]
    chain: list[tuple[int, int]]
    hubs: list[tuple[str | None, list[tuple[int, bool]]]]
    """(kind of the base span that owns the key, members); base spans themselves aren't members."""


def graph_of(text: str, base: list[Span]) -> Graph:
    nodes = nodes_of(text, base)
    chain = [(i, i + 1) for i, (x, y) in enumerate(zip(nodes, nodes[1:])) if 0 <= y.start - x.end <= 3 and not any(c.isalnum() for c in text[x.end : y.start])]
    owner: dict[str, str] = {}
    forms: dict[str, str] = {}
    for kind, a, b in base:
        for key, form in keys_of(kind, text[a:b]):
            owner.setdefault(key, kind)
            forms.setdefault(key, form)
    members: dict[str, list[tuple[int, bool]]] = defaultdict(list)
    for i, n in enumerate(nodes):
        if n.kind is None:
            members[n.key].append((i, forms.setdefault(n.key, n.form) == n.form))
    return Graph(nodes, chain, [(owner.get(key), own) for key, own in members.items() if key in owner or len(own) > 1])


def marginals(unary: list[float], observed: list[bool], edges: list[tuple[int, int, float]], rounds: int = ROUNDS) -> list[float]:
    """Log odds of private at each node, by loopy sum-product with damping.

    With two labels a message is one number: the odds it carries.  An edge of
    strength w multiplies equal labels by exp(w).
    """
    base = np.where(observed, OBSERVED, unary)
    if not edges:
        return base.tolist()
    i, j = np.array([e[:2] for e in edges]).T
    w = np.tile([e[2] for e in edges], 2)
    of, to = np.concatenate([i, j]), np.concatenate([j, i])  # message k goes from of[k] to to[k]; k + n or k - n comes back
    message = np.zeros(len(of))
    for _ in range(rounds):
        total = base + np.bincount(to, message, len(base))
        x = np.where(np.asarray(observed)[of], OBSERVED, np.clip(total[of] - np.roll(message, len(edges)), -OBSERVED, OBSERVED))
        step = 0.5 * (np.logaddexp(x + w, 0) - np.logaddexp(x, w) - message)
        message = message + step
        if np.abs(step).max() < 1e-4:
            break
    return (base + np.bincount(to, message, len(base))).tolist()


def energy(graph: Graph, weights: Weights) -> tuple[list[float], list[bool], list[tuple[int, int, float]]]:
    """Potentials, observations and edges; the hubs follow the nodes and have no potential of their own."""
    unary = [weights.unary(shape(n.form)) for n in graph.nodes] + [0.0] * len(graph.hubs)
    observed = [n.kind is not None for n in graph.nodes] + [kind is not None for kind, _ in graph.hubs]
    edges = [(i, j, weights.chain) for i, j in graph.chain]
    first = len(graph.nodes)
    edges += [(i, first + h, weights.exact if exact else weights.similar) for h, (_, own) in enumerate(graph.hubs) for i, exact in own]
    return unary, observed, edges


def added_spans(text: str, base: list[Span], weights: Weights, sure: float = SURE) -> list[Span]:
    """What the field adds to the base spans of a document."""
    if not base and not MARK.search(text):
        return []
    graph = graph_of(text, base)
    unary, observed, edges = energy(graph, weights)
    # Without an observation or a positive potential in reach nothing can become private.
    around: dict[int, list[int]] = defaultdict(list)
    for i, j, _ in edges:
        around[i].append(j)
        around[j].append(i)
    todo = [i for i in range(len(unary)) if observed[i] or unary[i] > 0]
    reached = set(todo)
    while todo:
        for j in around[todo.pop()]:
            if j not in reached:
                reached.add(j)
                todo.append(j)
    own = sorted(i for i in reached if not observed[i] and i < len(graph.nodes))
    if not own:
        return []
    place = {i: k for k, i in enumerate(sorted(reached))}
    odds = marginals([unary[i] for i in place], [observed[i] for i in place], [(place[i], place[j], w) for i, j, w in edges if i in place])
    kinds = {i: kind for kind, members in graph.hubs for i, _ in members if kind}
    least = math.log(sure / (1 - sure))
    return [(kinds.get(i) or likely_kind(graph.nodes[i].form), graph.nodes[i].start, graph.nodes[i].end) for i in own if odds[place[i]] >= least]


def likely_kind(form: str) -> str:
    """The kind that a token without a known owner looks like."""
    digits = len(digits_of(form))
    if "@" in form or digits < LEAST_DIGITS:
        return "email"
    return "ip" if form.count(".") == 3 else "card" if digits >= 12 else "phone"


# -- fitting ------------------------------------------------------------------------

Example = tuple[int, int, int, int, int]


def evidence(text: str) -> dict[Example, int]:
    """Counts of (shape, sum of the neighbours' labels, exact hub's label, similar hub's label, label); labels of others are 1, -1 or 0 for none."""
    base = base_spans(text)
    out: dict[Example, int] = defaultdict(int)
    if not base and not MARK.search(text):
        return out
    graph = graph_of(text, base)
    near: dict[int, int] = defaultdict(int)
    for i, j in graph.chain:
        near[i] += 1 if graph.nodes[j].kind else -1
        near[j] += 1 if graph.nodes[i].kind else -1
    hub = {i: (owner, exact) for owner, own in graph.hubs for i, exact in own}
    for i, n in enumerate(graph.nodes):
        if n.kind:
            for form, exact in degraded(n.kind, text[n.start : n.end]):
                out[shape(form), near[i], int(exact), int(not exact), 1] += 1
                out[shape(form), near[i], 0, 0, 0] += 1
            continue
        owner, exact = hub.get(i, (None, None))
        if owner is None:  # what shares a key with a base span isn't known to be either
            out[shape(n.form), near[i], -1 if exact else 0, -1 if exact is False else 0, 0] += 1
    return out


def fit_weights(counts: dict[Example, int]) -> Weights:
    """All potentials together by logistic regression with Newton steps, with a normal prior around the defaults."""
    prior = Weights()
    if not any(label for *_, label in counts):
        return prior
    rows = sorted(counts)
    x = np.array([[f >> i & 1 for i in range(SHAPES)] + [1, chain, exact, similar] for f, chain, exact, similar, _ in rows], float)
    y, n = np.array([r[-1] for r in rows], float), np.array([counts[r] for r in rows], float)
    start = np.array([*prior.bits, prior.bias, prior.chain, prior.exact, prior.similar])
    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - (w - start)
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + np.eye(len(w)), slope)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return Weights(tuple(map(float, w[:SHAPES])), *map(float, w[SHAPES:]))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Weights:
    """Weights from a sample of about ``sample`` texts: those whose id and text hash lowest, the same in every run.

    Each partition sends one row for each kind of example, whose number is bounded.
    """
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = docs.count()
    if not total:
        return Weights()
    share = min(1 << 30, (sample << 30) // total + 1)
    drawn = source.where((F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < share) & (F.length("text") <= SAMPLE_CHARS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[Example, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for k, n in evidence(text or "").items():
                    sums[k] += n
        rows = [(*k, n) for k, n in sums.items()]
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], EXAMPLE)

    EXAMPLE = ["shape", "chain", "exact", "similar", "label", "n"]
    rows = drawn.mapInArrow(run, ", ".join(f"{c} bigint" for c in EXAMPLE)).groupBy(*EXAMPLE[:-1]).agg(F.sum("n").alias("n")).collect()
    return fit_weights({tuple(r[c] for c in EXAMPLE[:-1]): r["n"] for r in rows})


# -- over documents -----------------------------------------------------------------


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(text: str | None, weights: Weights) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text."""
    base = base_spans(text)
    more = added_spans(text, base, weights) if text else []
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


REPORT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def report(docs: DataFrame, weights: Weights | None = None) -> DataFrame:
    """``doc_id`` and REPORT for every row; the counts are those of the base spans."""
    weights = weights or fit(docs)
    source = docs.select(F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *(f.split()[0] for f in REPORT.split(", "))]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = []
                for text in part.column(1).to_pylist():
                    base, spans = detect(text, weights)
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {REPORT}")


def masked(text: str | None, weights: Weights) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at, shown = [], 0, -1
    for kind, a, b in detect(text, weights)[1]:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at, shown = b, a
    return "".join(out) + text[at:] if shown >= 0 else text


def mask(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", weights: Weights | None = None) -> DataFrame:
    """The same rows and columns with personal data in the text masked.  No shuffle."""
    weights = weights or fit(docs, id_col=id_col, text_col=text_col)
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, 4 << 20):
                texts = pa.array([masked(t, weights) for t in part.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([texts if i == at else part.column(i) for i in range(part.num_columns)], part.schema.names)

    return docs.mapInArrow(run, schema)
