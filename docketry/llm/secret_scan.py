"""Secret scan with inferred formats.

Fixed patterns find labelled credentials. From a bounded sample of them, per kind, a prefix tree
is built and its statistically compatible states are merged (Hoeffding test on stopping and on
each symbol, folding subtrees), which gives a probabilistic automaton. Symbols are a literal
beginning that half of the kind shares, the class and length of each alphanumeric part (the
smallest class that covers it), and all other characters; so lengths are part of a format, and a
string of any length, which is never cut, has few symbols. A kind with too few credentials has no
automaton.
A background automaton is inferred in the same way from other runs of credential characters.
Every such run of the corpus of at least the fixed patterns' own minimum is then scored, and
where fixed patterns cover some of it, each part left over: it is added as kind `format` if its
likelihood under one kind's automaton is between those of nearly all labelled
credentials, and its odds against the background are high enough.

Runs are not kept between the two passes; the texts are scanned once to learn and once to judge.

Null and empty texts have no spans. Repeated rows are scanned each by itself. Without labelled
credentials nothing is added. Extra columns are not read. Positions are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.frames import col
from docketry.operators.ordering import best_per_key

KINDS = ["assign", "access", "hex", "format"]
SAMPLE = 500  # labelled credentials per kind, and background runs, that automata are fitted on
ALPHA = 0.05  # of the Hoeffding tests
ODDS = 2.0  # natural log of the odds a candidate needs; unlabelled credentials are in the background too
LOWEST = 0.01  # share of labelled credentials that may score below the threshold
FEWEST = 30  # labelled credentials that a kind needs for an automaton
MIN_RUN = 8  # of `assign` too: what is learned from must be looked for
JOINERS = "+/_.=-"  # between a run's alphanumeric parts
CACHE_RUNS = 200_000  # judged runs that a task remembers

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def scan(text: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]:
    """(base spans (kind, start, end, secret), candidates (start, end, run)) of a text. Where one
    candidate lies in another, the longer is first."""
    base = []
    low = text.lower()
    if any(w in low for w in WORDS):
        base += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_RUN]
    runs = [(m.start(), m.end(), m[0]) for m in RUN.finditer(text)]
    for start, _, run in runs:  # keys and hex strings are made of the characters of a run
        if len(run) < 16:
            continue
        base += [("access", start + m.start(), start + m.end(), m[0]) for m in ACCESS.finditer(run) if len(m[0]) >= 16]
        base += [("hex", start + m.start(), start + m.end(), m[0]) for m in HEX.finditer(run)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return base, _left_over(runs, [(s, e) for _, s, e, _ in base]) if base else runs


def _left_over(runs: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The parts of `runs` beside `spans` (in order of their starts), also without the joiners
    that hold them to a span."""
    taken: list[list[int]] = []
    for s, e in spans:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    ends = [e for _, e in taken]
    out = []
    for start, end, run in runs:
        at, i = start, bisect_right(ends, start)
        while at < end:
            s, e = (max(taken[i][0], at), taken[i][1]) if i < len(taken) and taken[i][0] < end else (end, end)
            part = run[at - start : s - start]
            bare = part.lstrip(JOINERS) if at > start else part
            low = at + len(part) - len(bare)
            bare = bare.rstrip(JOINERS) if s < end else bare
            out += [p for p in dict.fromkeys([(at, s, part), (low, low + len(bare), bare)]) if len(p[2]) >= MIN_RUN]
            at, i = e, i + 1
    return out


PARTS = re.compile("[A-Za-z0-9]+|[^A-Za-z0-9]")
# The smallest class that covers a part names it. Fixed order: the first that matches.
CLASSES = [
    ("digits", re.compile("[0-9]+")), ("word", re.compile("[a-z]+")), ("Word", re.compile("[A-Z][a-z]+")), ("WORD", re.compile("[A-Z]+")),
    ("hex", re.compile("[0-9a-f]+")), ("HEX", re.compile("[0-9A-F]+")), ("lower", re.compile("[0-9a-z]+")), ("UPPER", re.compile("[0-9A-Z]+")),
    ("Letters", re.compile("[A-Za-z]+")), ("Mixed", re.compile("[0-9A-Za-z]+")),
]


def symbols(text: str, prefix: str = "") -> list[str]:
    """A string as symbols: its kind's literal prefix, the class and length of every alphanumeric
    part, and all other characters as they are."""
    out = []
    if prefix and text.startswith(prefix):
        out, text = [prefix], text[len(prefix) :]
    for part in PARTS.findall(text):
        out.append(next(f"{name}{len(part)}" for name, form in CLASSES if form.fullmatch(part)) if part.isalnum() else part)
    return out


def common_prefix(strings: list[str]) -> str:
    """The longest beginning, of three characters or more, that half of the strings have."""
    low, group = "", strings
    while True:
        many = Counter(s[: len(low) + 1] for s in group if len(s) > len(low) + 1)
        best = min(many, key=lambda x: (-many[x], x), default=None)
        if best is None or 2 * many[best] < len(strings):
            return low if len(low) >= 3 else ""
        low, group = best, [s for s in group if s.startswith(best)]


class Automaton:
    """A probabilistic automaton inferred from strings, over their symbols."""

    def __init__(self, strings: list[str], alpha: float = ALPHA, prefix: str = ""):
        self.prefix = prefix
        self.next: list[dict[str, int]] = [{}]
        self.many: list[dict[str, int]] = [{}]
        self.stops = [0]
        for s in strings:
            at = 0
            for c in symbols(s, prefix):
                self.many[at][c] = self.many[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.many.append({})
                    self.stops.append(0)
                at = self.next[at][c]
            self.stops[at] += 1
        self.letters = {c for m in self.many for c in m}
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))

    def _total(self, q: int) -> int:
        return self.stops[q] + sum(self.many[q].values())

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """There is evidence enough to tell the states apart, and no symbol's frequency differs by
        more than chance allows, here and below (b is a tree, so this ends in loops of a too)."""
        todo, top = [(a, b)], True
        while todo:
            a, b = todo.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            slack = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if top and slack >= 1:
                return False
            top = False
            if abs(self.stops[a] / n - self.stops[b] / m) > slack:
                return False
            for c in self.many[a].keys() | self.many[b].keys():
                if abs(self.many[a].get(c, 0) / n - self.many[b].get(c, 0) / m) > slack:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the automaton at a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.stops[a] += self.stops[b]
            for c, n in self.many[b].items():
                self.many[a][c] = self.many[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self, bound: float) -> None:
        kept, fringe = [0], sorted((0, c) for c in self.next[0])
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            target = next((q for q in kept if self._alike(q, state, bound)), None)
            if target is None:
                kept.append(state)
            else:
                self.next[parent][c] = target
                self._fold(target, state)
            inside = set(kept)
            fringe = sorted((q, c) for q in kept for c, to in self.next[q].items() if to not in inside)
        self.kept = kept

    def table(self) -> Table:
        return Table(self)

    def score(self, text: str) -> float:
        return self.table().score(text)


class Table:
    """The log probabilities of an automaton's states, with a little mass for what was never seen."""

    def __init__(self, machine: Automaton):
        self.prefix = machine.prefix
        width, number = len(machine.letters) + 2, {q: i for i, q in enumerate(machine.kept)}
        self.steps, self.unseen, self.stops = [], [], []
        for q in machine.kept:
            whole = machine._total(q) + 0.1 * width
            self.steps.append({c: (math.log((n + 0.1) / whole), number[machine.next[q][c]]) for c, n in machine.many[q].items()})
            self.unseen.append(math.log(0.1 / whole))
            self.stops.append(math.log((machine.stops[q] + 0.1) / whole))

    def score(self, text: str) -> float:
        """Log likelihood of `text`."""
        at, total = 0, 0.0
        for c in symbols(text, self.prefix):
            step = self.steps[at].get(c)
            if step is None:
                total += self.unseen[at]
            else:
                total += step[0]
                at = step[1]
        return total + self.stops[at]


class Formats:
    """An automaton per kind with the likelihoods that its credentials have, and the background."""

    def __init__(self, labelled: dict[str, list[str]], other: list[str], alpha: float = ALPHA, lowest: float = LOWEST, odds: float = ODDS, fewest: int = FEWEST):
        self.odds = odds
        self.kinds = []
        for kind in sorted(labelled):
            strings = sorted(labelled[kind])
            if len(strings) < fewest:
                continue
            machine = Automaton(strings, alpha, common_prefix(strings)).table()
            scores = sorted(machine.score(s) for s in strings)
            self.kinds.append((machine, scores[int(lowest * len(scores))], scores[-1]))
        self.background = Automaton(sorted(other), alpha).table() if other else None

    def accepts(self, run: str) -> bool:
        """The likelihood of some kind lies between those of nearly all its credentials, and the
        odds against the background are high enough."""
        scores = [(machine.score(run), least, most) for machine, least, most in self.kinds]
        likely = [score for score, least, most in scores if least <= score <= most]
        if not likely:
            return False
        plain = self.background.score(run) if self.background else math.log(0.1 / SAMPLE)
        return max(likely) - plain >= self.odds


def scan_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, s) of base secrets and, as kind `other`, of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for value in batch.column(0):
                base, other = scan(value.as_py() or "")
                found.update((kind, s) for kind, _, _, s in base)
                found.update(("other", s) for _, _, s in other)
            columns = zip(*found, strict=True) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["kind", "s"])

    return docs.select(col(text).alias("text")).mapInArrow(run, "kind string, s string").distinct()


def learn_formats(strings: DataFrame, sample: int = SAMPLE) -> Formats:
    """Automata from `sample` distinct credentials per kind and as many other runs, chosen by hash."""
    order = [F.xxhash64("s"), F.col("s")]
    # The first of every part of a kind, then of the kind: a kind is many tasks' work.
    parts = best_per_key(strings.withColumn("part", F.pmod(F.xxhash64("s", F.lit(1)), F.lit(64))), ["kind", "part"], order, sample)
    picked: dict[str, list[str]] = defaultdict(list)
    for r in best_per_key(parts.drop("part"), ["kind"], order, sample).select("kind", "s").collect():
        picked[r["kind"]].append(r["s"])
    other = picked.pop("other", [])
    return Formats(dict(picked), other)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row of `docs`: doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans."""
    formats = learn_formats(scan_texts(docs, text), sample)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            out = defaultdict(list)
            for value in batch.column("text"):
                base, runs = scan(value.as_py() or "")
                spans = [(start, KINDS.index(kind), end) for kind, start, end, _ in base]
                added: list[tuple[int, int, int]] = []
                for start, end, run in runs:
                    if run not in known:
                        if len(known) >= CACHE_RUNS:
                            known.clear()
                        known[run] = formats.accepts(run)
                    if known[run] and not (added and start < added[-1][2]):
                        added.append((start, 3, end))
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(s[1] == k for s in spans + added))
                told = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)) for found in (spans, spans + added)]
                out["base_sha256"].append(hashlib.sha256(told[0].encode()).hexdigest())
                out["spans"].append(told[1])
            numbers = [pa.array(out[f"n_{k}"], pa.int64()) for k in KINDS]
            texts = [pa.array(out[c], pa.string()) for c in ("base_sha256", "spans")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, *texts], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"
    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text")).mapInArrow(judge, schema)
