"""Operator 10, secret scans by grammar inference.

Labelled credentials make a prefix tree; statistically compatible states are merged (ALERGIA: red and blue states, Hoeffding tests of
stopping and of every transition, recursively) into a probabilistic automaton. Examples of a format that begin alike (up to their first
joining character, as ``password=``, or in their first four characters) are learned together, the others by the kinds of characters they are made of. An automaton's symbols are the
characters of its examples' common beginning as they are and, after it, a class for letters and digits; a state's outgoing class carries a
distribution of characters, smoothed. A string's likelihood is that of its path, its characters and its stop.

A candidate starts where a run of characters of the credential alphabet does or after a joining character (one of ``_-+/=.``) in it, ends with the
run or before a joining character, and has at least 12 characters. All candidates of every text are scored: the starts of a slice step through the
transition tables together, a position at a time, and are scored wherever they may end; only a start that has no path any more, or has come to
its run's end, is done. A candidate is accepted where its log likelihood a character under an automaton is no less than the least of
its held-out examples less ``slack``, and it is no shorter than any example. Of a start the longest accepted candidate of each automaton
counts, with that of the highest margin; of candidates that overlap the first is reported. Nothing is shuffled.

``EXAMPLES`` makes labelled sets for public formats from a fixed seed, of many key words, lengths and alphabets. Another set can be given, as lists
by format or as a table (format, example), of which at most ``most_examples`` of each format, those of least hash, are learned.

Cases: null and empty texts have no candidates; repeated rows are reported each; null doc_ids stay; ties between formats go to the first by name; an
empty table gives no rows; other columns are ignored. A format without examples finds nothing, and a set without formats gives no rows; of fewer than
LEAST_HELD examples all are both learned and held out. A null or empty example is none.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping
from itertools import count
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandix.llm.common import slices, table, utf8

LEAST = 12
ALPHA = 1e-4
SLACK = 0.35
SCHEMA = "doc_id bigint, first_char int, format string, candidate string, log_likelihood double"
_ALNUM = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_CLASS = 256
#: Bytes of candidates, and those of them that may join a credential to something else.
_JOIN = np.zeros(256, bool)
_JOIN[[*b"_-+/=."]] = True
_IN = _JOIN.copy()
_IN[[*_ALNUM]] = True


LEAST_HELD = 20
MOST_EXAMPLES = 20_000


def EXAMPLES(n: int = 600) -> dict[str, list[str]]:  # noqa: N802
    """Labelled credentials by format."""
    rng = Random(10)
    lower, upper, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    word, url = lower + upper + digits, lower + upper + digits + "_-"
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    alphabets = [hexa, lower + digits, upper + digits, word, lower + upper, url]
    keys = [f(k) for k in ("password", "passwd", "pwd", "secret") for f in (str.lower, str.upper, str.title)]
    return {
        "access_key": [head + pick(upper + "234567", 16) for head in ("AKIA", "ASIA") for _ in range(n)],
        "hex_token": [pick(letters, 40) for letters in (hexa, hexa.upper()) for _ in range(n)],
        "password": [f"{k}={pick(alphabets[i % 6], rng.randint(8, 32))}" for k in keys for i in range(n)],
        "personal_token": [f"{head}_{pick(word, 36)}" for head in ("ghp", "gho", "ghs") for _ in range(n)],
        "service_key": [f"{head}_{pick(word, rng.randint(24, 34))}" for head in ("sk_live", "rk_live") for _ in range(n)],
        "signed_token": ["eyJ" + ".".join(pick(url, rng.randint(*r)) for r in ((17, 40), (40, 120), (43, 43))) for _ in range(n)],
    }


class Automaton:
    """A probabilistic automaton inferred from example strings."""

    def __init__(self, examples: list[str], alpha: float = ALPHA) -> None:
        raw = [e.encode() for e in examples]
        self.prefix, self.shortest = 0, min(map(len, raw), default=0)
        while all(len(r) > self.prefix for r in raw) and len({r[self.prefix] for r in raw}) == 1:
            self.prefix += 1
        self.head = raw[0][: self.prefix] if raw else b""
        # Prefix tree: per state its arrivals, stops, children by symbol, and characters by symbol.
        self.stop, self.next, self.count, self.chars = [0], [{}], [0], [defaultdict(Counter)]
        for r in raw:
            q = 0
            self.count[q] += 1
            for i, c in enumerate(r):
                s = self.symbol(c, i)
                if s not in self.next[q]:
                    self.next[q][s] = len(self.stop)
                    for x, v in ((self.stop, 0), (self.next, {}), (self.count, 0), (self.chars, defaultdict(Counter))):
                        x.append(v)
                self.chars[q][s][c] += 1
                q = self.next[q][s]
                self.count[q] += 1
            self.stop[q] += 1
        self._infer(alpha)

    def symbol(self, c: int, i: int) -> int:
        return c if i < self.prefix or c not in _ALNUM else _CLASS

    def _edge(self, q: int, s: int) -> int:
        return sum(self.chars[q][s].values()) if s in self.chars[q] else 0

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            if self._differ(self.stop[a], self.count[a], self.stop[b], self.count[b], alpha):
                return False
            for s in {*self.next[a], *self.next[b]}:
                if self._differ(self._edge(a, s), self.count[a], self._edge(b, s), self.count[b], alpha):
                    return False
                if s in self.next[a] and s in self.next[b]:
                    todo.append((self.next[a][s], self.next[b][s]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for s, to in self.next[b].items():
                self.chars[a][s].update(self.chars[b][s])
                if s in self.next[a]:
                    todo.append((self.next[a][s], to))
                else:
                    self.next[a][s] = to

    def _infer(self, alpha: float) -> None:
        red = [0]
        while True:
            blue = [(q, s) for q in red for s in sorted(self.next[q]) if self.next[q][s] not in red]
            if not blue:
                break
            q, s = max(blue, key=lambda e: (self.count[self.next[e[0]][e[1]]], -e[0], -e[1]))
            b = self.next[q][s]
            for r in red:
                if self._compatible(r, b, alpha):
                    self.next[q][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.states = red
        n = len(red)
        number = {q: i for i, q in enumerate(red)}
        self.to = np.full((n + 1, 257), n, np.int32)  # state n: no path
        self.p_stop = np.full(n + 1, -np.inf)
        self.p_char = np.full((n + 1, 2, 256), -np.inf, np.float32) if n < 200 else None  # by state, whether the symbol is the class, and character
        if self.p_char is None:
            raise ValueError("the examples don't generalise: too many states")
        for q, i in number.items():
            if self.stop[q]:
                self.p_stop[i] = math.log(self.stop[q] / self.count[q])
            for s, to in self.next[q].items():
                self.to[i, s] = number[to]
                n_edge = self._edge(q, s)
                if s < _CLASS:
                    self.p_char[i, 0, s] = math.log(n_edge / self.count[q])
                    continue
                # A character not seen on this edge is as if seen a hundredth of a time.
                for c in _ALNUM:
                    self.p_char[i, 1, c] = math.log(n_edge / self.count[q] * (self.chars[q][s][c] + 0.01) / (n_edge + 0.62))
        self.longest = self._longest()

    def _longest(self) -> int | None:
        """The length of the longest string with a path; None where there is a loop, so any length may have one."""
        n, length = len(self.states), {}
        order, state = [], [0] * n
        todo = [(0, False)]
        while todo:
            q, left = todo.pop()
            if left:
                state[q] = 2
                order.append(q)
            elif not state[q]:
                state[q] = 1
                todo.append((q, True))
                for to in {int(t) for t in self.to[q] if t < n}:
                    if state[to] == 1:
                        return None
                    todo.append((to, False))
        for q in order:
            length[q] = max((length[int(t)] + 1 for t in set(self.to[q].tolist()) if t < n), default=0)
        return length[0]

    def score(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log likelihood a character of each buf[start:end]; -inf where there is no path."""
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        alive, dead = np.arange(len(start)), len(self.to) - 1
        out = np.full(len(start), -np.inf)
        is_class = np.zeros(256, bool)
        is_class[list(_ALNUM)] = True
        for i in count():
            ended = (end - start)[alive] == i
            done = alive[ended]
            out[done] = (total[done] + self.p_stop[state[done]]) / np.maximum(end[done] - start[done], 1)
            alive = alive[~ended]
            if not len(alive):
                break
            c = buf[start[alive] + i].astype(np.int64)
            s = c if i < self.prefix else np.where(is_class[c], _CLASS, c)
            total[alive] += self.p_char[state[alive], np.asarray(s == _CLASS, np.int64), c]
            state[alive] = self.to[state[alive], s]
            alive = alive[state[alive] != dead]
        return out

    def longest_accepted(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """For each start the furthest place, its run's end or a joining character, up to which the log likelihood a character is at least ``least``, and that likelihood; -1 and -inf where there is none."""
        state, total = np.zeros(len(start), np.int64), np.zeros(len(start))
        alive, dead = np.arange(len(start)), len(self.to) - 1
        to, scores = np.full(len(start), -1, np.int64), np.full(len(start), -np.inf)
        is_class = np.zeros(256, bool)
        is_class[list(_ALNUM)] = True
        for i in count():
            at = start[alive] + i
            inside = at < end[alive]
            c = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0).astype(np.int64)
            if i >= max(self.shortest, LEAST):
                score = (total[alive] + self.p_stop[state[alive]]) / i
                good = (~inside | _JOIN[c]) & (score >= least)
                to[alive[good]], scores[alive[good]] = at[good], score[good]
            alive, c = alive[inside], c[inside]
            if not len(alive):
                break
            s = c if i < self.prefix else np.where(is_class[c], _CLASS, c)
            total[alive] += self.p_char[state[alive], np.asarray(s == _CLASS, np.int64), c]
            state[alive] = self.to[state[alive], s]
            alive = alive[state[alive] != dead]
        return to, scores


def _heads(examples: list[str]) -> list[str]:
    """What each example is learned with: its beginning up to the first joining character or its first four characters, whichever enough others share, or else the kinds of its characters."""

    def word(e: str) -> str:
        return next((e[: i + 1] for i, c in enumerate(e) if c in "_-+/=."), "")

    words, firsts = Counter(map(word, examples)), Counter(e[:4] for e in examples)
    enough = max(LEAST_HELD, len(examples) // 20)
    kinds = lambda e: "".join(k for k, f in (("a", str.islower), ("A", str.isupper), ("0", str.isdigit)) if any(map(f, e)))
    return [w if (w := word(e)) and words[w] >= enough else e[:4] if firsts[e[:4]] >= enough else kinds(e) for e in examples]


def learn(examples: Mapping[str, Iterable[str | None]]) -> list[tuple[str, Automaton, float]]:
    """(format, automaton, threshold) by format; every fifth example is held out for the threshold."""
    out = []
    for name, strings in sorted(examples.items()):
        by_head: dict[str, list[str]] = defaultdict(list)
        known = [e for e in strings if e]
        for e, head in zip(known, _heads(known)):
            by_head[head].append(e)
        # Heads of their own need examples enough; the rest of a format is one group.
        few = [h for h, g in by_head.items() if len(g) < LEAST_HELD]
        groups = [g for h, g in sorted(by_head.items()) if h not in few] + [g for g in [[e for h in sorted(few) for e in by_head[h]]] if g]
        for group in groups:
            whole = len(group) < LEAST_HELD
            automaton = Automaton(group if whole else [e for i, e in enumerate(group) if i % 5])
            held = [e.encode() for e in (group if whole else group[::5])]
            ends = np.cumsum([len(h) for h in held])
            scores = automaton.score(np.frombuffer(b"".join(held), np.uint8), ends - [len(h) for h in held], ends)
            if np.isfinite(scores).any():
                out.append((name, automaton, float(scores[np.isfinite(scores)].min())))
    return out


def labelled(examples: DataFrame, most_examples: int = MOST_EXAMPLES) -> dict[str, list[str]]:
    """A table (format, example) as lists by format, of bounded size."""
    rows = examples.select(F.col("format").cast("string").alias("format"), F.col("example").cast("string").alias("example")).where("format IS NOT NULL AND length(example) > 0").distinct()
    rank = F.row_number().over(Window.partitionBy("format").orderBy(F.xxhash64("example"), "example"))
    out: dict[str, list[str]] = defaultdict(list)
    for r in rows.withColumn("r", rank).where(F.col("r") <= most_examples).orderBy("format", "r").collect():
        out[r.format].append(r.example)
    return dict(out)


def scan(docs: DataFrame, examples: Mapping[str, Iterable[str | None]] | DataFrame | None = None, slack: float = SLACK, most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """(doc_id, first_char, format, candidate, log_likelihood) of every credential found."""
    known = EXAMPLES() if examples is None else labelled(examples, most_examples) if isinstance(examples, DataFrame) else examples
    learned = learn(known)
    if not learned:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    models = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = models.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for lo, hi in slices(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                buf = data[offsets[lo] : offsets[hi]]
                inside = _IN[buf]
                edge = np.ones(len(buf) + 1, bool)
                edge[1:] = ~inside
                edge[at] = True
                after = np.ones(len(buf) + 1, bool)
                after[:-1] = ~inside
                after[at] = True
                start = np.flatnonzero(inside & edge[:-1])
                end = np.flatnonzero(inside & after[1:]) + 1
                run = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[False], _JOIN[buf[:-1]]])))
                end = end[np.searchsorted(start, run, "right") - 1]
                start = run[end - run >= LEAST]
                end = end[end - run >= LEAST]
                if not len(start):
                    continue
                ends, scores = (np.stack(x) for x in zip(*[a.longest_accepted(buf, start, end, least - slack) for _, a, least in automata]))
                above = scores - np.array([least for _, _, least in automata])[:, None]
                best = above.argmax(axis=0)
                past = 0
                for i in np.flatnonzero(above.max(axis=0) > -np.inf).tolist():
                    if start[i] < past:
                        continue
                    past = int(ends[best[i], i])
                    d = int(np.searchsorted(at, start[i], "right")) - 1
                    first = int(((buf[at[d] : start[i]] & 0xC0) != 0x80).sum())
                    rows.append((ids[lo + d], first, automata[best[i]][0], buf[start[i] : past].tobytes().decode(), float(scores[best[i], i])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()))], ["doc_id", "first_char", "format", "candidate", "log_likelihood"]
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
