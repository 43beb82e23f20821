"""Secret scans by one combined deterministic automaton.

The rules' expressions, reversed, are compiled to one minimal automaton over bytes that may begin anywhere. One pass over a
text's bytes from its end to its start tells for each place which rules match there. Only where one does, the rule's own automaton runs on from
there to the longest match, so matches of a rule are the leftmost ones that don't overlap, each as long as can be.
Lengths are checked afterwards: a match that is too short is dropped, and what it covers stays covered.

A pass steps many stretches of text at once, as arrays. Stretches end where a document ends or at a byte that no rule has, from which every state leads
back to the first one; a text without such bytes is one long stretch.

Places are code points, ends exclusive. A null or empty text has no spans. Rows of equal id are scanned each on its own; no order
matters, no row is dropped, and an empty table stays empty. Other columns pass through; ``spans`` replaces a column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.automata import Automaton, backward, compiled, parse

SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Texts are cut at the first place that allows it behind so many bytes.
STRETCH = 1024


@dataclass(frozen=True)
class Rule:
    """An expression with the least length of its whole match, and of the part that begins where the match could first end.

    All three expressions of the base read the part's characters last and accept at each of them, so the second length is that of the secret itself.
    """

    kind: str
    pattern: str
    least: int = 1
    least_part: int = 1
    fold: bool = False


#: The kinds of the base, in the order that results list them.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+", least_part=8, fold=True),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Public formats of keys and tokens beyond the base.
FURTHER = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("gitlab", "glpat-[A-Za-z0-9_-]+", least=26),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", "AIza[A-Za-z0-9_-]+", least=39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("login_url", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@\"'<>]+:[^\x00-\x20/:@\"'<>]+@"),
)
RULES = BASE + FURTHER


class Scanner:
    """The rules' automata, made on the driver; a few thousand numbers that go to all tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(rule.pattern, rule.fold) for rule in rules]
        self.starts = compiled([backward(tree) for tree in trees], anywhere=True)
        self.ends = [compiled([tree], anywhere=False) for tree in trees]

    def stretches(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The places at which stretches begin, and the end: those of the texts and, in longer texts, of bytes that no rule has."""
        free = np.flatnonzero(self.starts.breaks[data])
        wanted = np.arange(STRETCH, len(data), STRETCH)
        at = np.searchsorted(free, wanted)
        return np.unique(np.concatenate([bounds, free[at[at < len(free)]]]))

    def places(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places where matches of any rule begin, ascending, and the rules as bits."""
        one, cuts = self.starts, self.stretches(data, bounds)
        order = np.argsort(cuts[:-1] - cuts[1:], kind="stable")  # the longest first
        ends, sizes = cuts[1:][order], (cuts[1:] - cuts[:-1])[order]
        codes, step, width = one.classes[data], one.delta.ravel(), one.delta.shape[1]
        state = np.full(len(ends), one.start, np.int32)
        where: list[np.ndarray] = [np.zeros(0, np.int64)]
        what: list[np.ndarray] = [np.zeros(0, np.int64)]
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for back, n in enumerate(active.tolist(), 1):
            now = step[state[:n] * width + codes[ends[:n] - back]]
            state[:n] = now
            hit = np.flatnonzero(now >= one.first_accept)
            if len(hit):
                where.append(ends[hit] - back)
                what.append(one.accepts[now[hit]])
        at, rules = np.concatenate(where), np.concatenate(what)
        order = np.argsort(at)
        return at[order], rules[order]

    def spans(self, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        """The spans of each text by start, then kind as listed."""
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        places, rules = self.places(data, bounds)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for i in np.unique(np.searchsorted(bounds, places, side="right") - 1).tolist():
            low, high = np.searchsorted(places, bounds[i : i + 2])
            out[i] = self._of_text(texts[i], (places[low:high] - bounds[i]).tolist(), rules[low:high].tolist())
        return out

    def _of_text(self, text: bytes, places: list[int], found: list[int]) -> list[tuple[str, int, int]]:
        spans = []
        for r, rule in enumerate(self.rules):
            free = 0
            for at in (p for p, bits in zip(places, found, strict=True) if bits >> r & 1):
                if at >= free:
                    first, free = longest(self.ends[r], text, at)
                    if free - at >= rule.least and free - first + 1 >= rule.least_part:
                        spans.append((at, r, free))
        count = (lambda i: i) if text.isascii() else _points(text)
        return [(self.rules[r].kind, count(a), count(b)) for a, r, b in sorted(spans)]


def _points(text: bytes):
    """The number of code points before a byte."""
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return lambda i: int(upto[i])


def longest(one: Automaton, text: bytes, at: int) -> tuple[int, int]:
    """The ends of the shortest and of the longest match that begin at a place; the place itself where none does."""
    state, first, last = one.start, at, at
    for i in range(at, len(text)):
        state = one.delta[state, one.classes[text[i]]]
        if state == one.dead:
            break
        if state >= one.first_accept:
            first, last = (first if last > at else i + 1), i + 1
    return first, last


def spans_of(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The spans of a text: an array of kind, start and end."""
    scanner = Scanner(rules)

    @F.arrow_udf(SPANS)
    def found(values: pa.Array) -> pa.Array:
        made = scanner.spans([x or b"" for x in values.cast(pa.binary()).to_pylist()])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in made], pa.list_(kind))

    return found(text)


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans``."""
    return docs.withColumn("spans", spans_of(F.col(text), rules))


def mask(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets, and ``n_masked``. Spans that overlap are one, named by the first; null stays null."""

    def joined(done, span):
        last = F.element_at(done, -1)
        more = F.struct(last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        meets = (F.size(done) > 0) & (span["start"] < F.try_element_at(done, F.lit(-1))["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(done, F.array(span)))

    one = F.aggregate("_spans", F.array().cast(SPANS), joined)
    gaps = F.transform(
        "_one", lambda x, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get("_one", i - 1)["end"] + 1), x["start"] - F.when(i == 0, 0).otherwise(F.get("_one", i - 1)["end"])), F.lit("["), x["kind"], F.lit("]"))
    )
    rest = F.substring(text, F.coalesce(F.try_element_at("_one", F.lit(-1))["end"], F.lit(0)) + 1, F.length(text))
    marked = docs.withColumn("_spans", spans_of(F.col(text), rules)).withColumn("_one", one)
    out = marked.withColumns({text: F.concat(F.array_join(gaps, ""), rest), "n_masked": F.size("_one").cast("long")})
    return out.drop("_spans", "_one")
