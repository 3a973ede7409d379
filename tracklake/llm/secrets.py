"""Operator 6: secret scans by grammar inference.

Rules with fixed formats find the plain secrets. The values they find are labelled credentials: from a bounded
sample of them a probabilistic automaton is inferred for each kind, by merging the states of their prefix tree that
are statistically compatible. Every other token, and every part of one, is a candidate, whatever its characters: it is a
secret if an automaton makes its format as likely as the labelled ones', and far likelier than ordinary text makes it.
Ordinary text is told by which character follows which in all texts outside the base spans.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.llm.common import cut, field, map_texts, table

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the automata are asked about: runs of the credentials' alphabet as long as the base rule asks of a value, and their
#: parts at these separators, the weakest last.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
LEAST_LENGTH = 6
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_LENGTH},}}")
SEPARATORS = ("=", "/", ".", "+_-")
PUNCTUATION = "+/_.=-"
#: Labelled credentials of a kind that an automaton is fitted on: those with the smallest hashes, over all documents.
SAMPLE = 500
#: A labelled value gives so many characters at most to the fit.
LONGEST = 256
ALPHA = 0.05
#: A candidate must score within so many bits a symbol of the labelled credentials' lowest hundredth, and, as n of them tell
#: that only so well, n**-0.5 bits more.
MARGIN = 0.25
#: And be so many bits likelier as a credential than as ordinary text: about one token in a million is held to be one.
ODDS = 20.0
#: Candidates without a secret that a worker remembers.
REMEMBERED = 1_000_000
SYMBOLS = len(ALPHABET) + 1  # and the end, which any other character is
CODE = np.zeros(256, np.int64)
CODE[list(ALPHABET.encode())] = np.arange(1, SYMBOLS)
MARK = "[secret]"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """The fixed rules' matches as (start, kind, end, value), sorted; kinds are numbered as in KINDS.

    A run of hexadecimal digits matches as a whole, so asking for 24 or more at once finds the same runs.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, words: Iterable[str], alpha: float = ALPHA) -> None:
        self.seen: list[int] = [0]
        self.ends: list[int] = [0]
        self.next: list[dict[str, int]] = [{}]
        self.used: list[dict[str, int]] = [defaultdict(int)]
        self.width = math.sqrt(0.5 * math.log(2 / alpha))
        words = list(words)
        for w in words:
            at = 0
            for c in w:
                self.seen[at] += 1
                self.used[at][c] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.used.append(defaultdict(int))
                at = self.next[at][c]
            self.seen[at] += 1
            self.ends[at] += 1
        self.infer()
        scores = sorted(map(self.score, words))
        self.least = scores[len(scores) // 100] - MARGIN - len(scores) ** -0.5 if scores else math.inf

    def differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.width * (n**-0.5 + m**-0.5)

    def compatible(self, red: int, blue: int) -> bool:
        """Whether the future of two states can be the same, by Hoeffding's bound at each state that both lead to."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            if self.differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in self.used[a].keys() | self.used[b].keys():
                if self.differ(self.used[a].get(c, 0), n, self.used[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def fold(self, red: int, blue: int) -> None:
        """The tree below ``blue`` becomes part of ``red``."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, to in self.next[b].items():
                self.used[a][c] += self.used[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def infer(self) -> None:
        kept = [0]
        fixed = {0}
        fringe = sorted((c, 0) for c in self.next[0])
        while fringe:
            c, parent = fringe.pop(0)
            blue = self.next[parent][c]
            if blue in fixed:
                continue
            into = next((q for q in kept if self.compatible(q, blue)), None)
            if into is None:
                kept.append(blue)
                fixed.add(blue)
                fringe += sorted((x, blue) for x in self.next[blue])
            else:
                self.next[parent][c] = into
                self.fold(into, blue)
                fringe = [(x, q) for q in kept for x in sorted(self.next[q]) if self.next[q][x] not in fixed]
        number = {q: i for i, q in enumerate(kept)}
        self.next = [{c: number[to] for c, to in self.next[q].items()} for q in kept]
        # As many occurrences as a state has symbols are held back for those never seen in it, the end among them.
        kinds = [len(self.used[q]) + (self.ends[q] > 0) for q in kept]
        whole = [max(self.seen[q] + k, 1) for q, k in zip(kept, kinds, strict=True)]
        self.unseen = [math.log2(max(k, 1) / n / max(SYMBOLS - k, 1)) for k, n in zip(kinds, whole, strict=True)]
        self.bits = [{c: math.log2(m / n) for c, m in self.used[q].items()} for q, n in zip(kept, whole, strict=True)]
        self.stop = [math.log2(self.ends[q] / n) if self.ends[q] else u for q, n, u in zip(kept, whole, self.unseen, strict=True)]
        del self.seen, self.ends, self.used

    def score(self, word: str) -> float:
        """Bits of log probability a symbol, its end counted."""
        at, total = 0, 0.0
        for c in word:
            total += self.bits[at].get(c, self.unseen[at])
            at = self.next[at].get(c, 0)
        return (total + self.stop[at]) / (len(word) + 1)


class Ordinary:
    """How likely ordinary text makes a token: by which character follows which, the token's edges among them."""

    def __init__(self, follows: np.ndarray) -> None:
        self.follows, self.times = follows.ravel() + 0.5, (follows + 0.5).sum(axis=1)

    def score(self, word: str) -> float:
        """Bits of log probability of the whole token, itself not counted: a lone secret must not vouch for itself."""
        pairs, times = np.unique(pairs_of(word.encode()), return_counts=True)
        own = np.bincount(pairs // SYMBOLS, weights=times, minlength=SYMBOLS)[pairs // SYMBOLS]
        left = np.maximum(self.follows[pairs] - times, 0.5) / np.maximum(self.times[pairs // SYMBOLS] - own, 0.5 * SYMBOLS)
        return float((times * np.log2(left)).sum())


def pairs_of(data: bytes) -> np.ndarray:
    """Each symbol and the next as one number; what is not of the alphabet is the end of a token."""
    code = np.concatenate([[0], CODE[np.frombuffer(data, np.uint8)], [0]])
    return code[:-1] * SYMBOLS + code[1:]


def follows_in(data: bytes) -> np.ndarray:
    """How often each symbol follows each."""
    times = np.bincount(pairs_of(data), minlength=SYMBOLS * SYMBOLS)
    times[0] = 0  # nothing between two ends is a token
    return times


class Grammars:
    """What tells secrets: an automaton for each kind of labelled credentials, and ordinary text."""

    def __init__(self, automata: list[Automaton], ordinary: Ordinary) -> None:
        self.automata, self.ordinary = automata, ordinary
        self.clean: set[str] = set()  # candidates without a secret

    def gain(self, word: str) -> float:
        """How many bits likelier the word is as a credential than as ordinary text; 0 if no automaton accepts it."""
        found = [x * (len(word) + 1) for a in self.automata if (x := a.score(word)) >= a.least]
        if not found:
            return 0.0
        more = max(found) - self.ordinary.score(word)
        return more if more >= ODDS else 0.0

    def secrets(self, run: str) -> list[tuple[int, int]]:
        """The spans of secrets in a run."""
        if run in self.clean:
            return []
        found = best_spans(run, 0, len(run), self)[1]
        if not found:
            if len(self.clean) >= REMEMBERED:
                self.clean.clear()
            self.clean.add(run)
        return found

    def __reduce__(self) -> tuple:
        return Grammars, (self.automata, self.ordinary)


def labelled_values(text: str) -> set[tuple[int, str]]:
    return {(kind, value[:LONGEST]) for _, kind, _, value in base_spans(text)}


def fit_grammars(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Grammars:
    """An automaton for each kind of which there are labelled credentials among all texts, and the model of ordinary text.

    Every text is scanned; of each kind's distinct values the ``sample`` with the smallest hashes are fitted on, and the pairs
    of characters of all texts are counted. The driver gets those values and at most SYMBOLS**2 counts. Without any
    labelled value, as in an empty table, there is no automaton and only the fixed rules find secrets.
    """

    def label(texts: list[bytes]) -> list:
        whole = [t.decode("utf-8", "replace") for t in texts]
        rows = [base_spans(t) for t in whole]
        follows = follows_in(b"\n".join(texts))
        held = [t[start:end] for t, r in zip(whole, rows, strict=True) for start, _, end, _ in r]
        follows = np.maximum(follows - follows_in("\n".join(held).encode()), 0) if held else follows
        some = np.flatnonzero(follows)
        told = [[f"{k}{v}" for k, v in sorted({(kind, value[:LONGEST]) for _, kind, _, value in r})] for r in rows]
        return [told, [list(map(str, some.tolist()))] + [[]] * (len(texts) - 1), [follows[some].tolist()] + [[]] * (len(texts) - 1)]

    fields = [field("values", T.ArrayType(T.StringType())), field("pairs", T.ArrayType(T.StringType())), field("times", T.ArrayType(T.LongType()))]
    scanned = map_texts(df, text, [], fields, label)
    told = scanned.select(F.explode(F.concat(F.transform("values", lambda v: F.struct(v.alias("value"), F.lit(0).cast("bigint").alias("times"))), F.transform(F.arrays_zip("pairs", "times"), lambda x: F.struct(F.concat(F.lit("p"), x.pairs).alias("value"), x.times.alias("times"))))).alias("x")).select("x.*")
    told = cut(told.groupBy("value").agg(F.sum("times").alias("times")))  # one scan of the texts for all kinds
    kinds = [told.filter(F.col("value").startswith(str(k))).orderBy(F.xxhash64("value"), "value").limit(sample) for k in range(3)]
    found: dict[str, list[str]] = defaultdict(list)
    for r in kinds[0].union(kinds[1]).union(kinds[2]).collect():
        found[r.value[0]].append(r.value[1:])
    follows = np.zeros(SYMBOLS * SYMBOLS)
    for r in told.filter(F.col("value").startswith("p")).collect():
        follows[int(r.value[1:])] = r.times
    return Grammars([Automaton(sorted(v)) for _, v in sorted(found.items())], Ordinary(follows.reshape(SYMBOLS, SYMBOLS)))


def best_spans(text: str, start: int, end: int, grammars: Grammars, level: int = 0) -> tuple[float, list[tuple[int, int]]]:
    """The spans of secrets in a run and their gain: the run itself, or itself without the punctuation around it, or those in
    its parts at the first separator that it has, and so on; whichever gains most."""
    word = text[start:end]
    lo = start + len(word) - len(word.lstrip(PUNCTUATION))
    hi = lo + len(word.strip(PUNCTUATION))
    if hi - lo < LEAST_LENGTH:
        return 0.0, []
    gain, spans = 0.0, []
    for a, z in {(lo, hi), (start, end)}:
        own = grammars.gain(text[a:z])
        if own > gain:
            gain, spans = own, [(a, z)]
    while level < len(SEPARATORS) and not any(c in word for c in SEPARATORS[level]):
        level += 1
    if level < len(SEPARATORS):
        total, parts, at = 0.0, [], start
        for i in [*(i for i, c in enumerate(word, start) if c in SEPARATORS[level]), end]:
            if i - at >= LEAST_LENGTH:
                own, found = best_spans(text, at, i, grammars, level + 1)
                total += own
                parts += found
            at = i + 1
        if total > gain:
            gain, spans = total, parts
    return gain, spans


def all_spans(text: str, grammars: Grammars | None) -> tuple[list, list]:
    """The base spans, and those with the tokens that the automata add, which overlap no base span."""
    base = [(start, kind, end) for start, kind, end, _ in base_spans(text)]
    if not grammars or not grammars.automata or (not base and grammars.clean.issuperset(CANDIDATE.findall(text))):
        return base, base
    added, i, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(base) and base[i][0] < end:
            at = max(at, reach)
            if base[i][0] - at >= LEAST_LENGTH:
                added += [(at + a, at + z) for a, z in grammars.secrets(text[at : base[i][0]])]
            reach = max(reach, base[i][2])
            i += 1
        at = max(at, reach)
        if end - at >= LEAST_LENGTH:
            added += [(at + a, at + z) for a, z in grammars.secrets(text[at:end])]
    return base, sorted(base + [(start, 3, end) for start, end in added])


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(df: DataFrame, grammars: Grammars | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row with counts by kind, the base spans and all spans (kind:start:end in code points, end exclusive).

    A null text counts as empty: no spans, empty strings. Equal texts have equal spans, repeated rows stay, an empty
    table gives an empty result; whole texts are read. A kept column named as a computed one gives way to it.
    """

    def scan(texts: list[bytes]) -> list:
        rows = []
        for t in texts:
            base, every = all_spans(t.decode("utf-8", "replace"), grammars)
            count = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*count, digest(base), digest(every)))
        return [list(c) for c in zip(*rows, strict=True)]

    fields = [field(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [field(n, T.StringType()) for n in ("base_spans", "spans")]
    return map_texts(df, text, df.columns if keep is None else keep, fields, scan)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = MARK) -> str:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, fit_grammars(docs), keep=["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret replaced by a mark; n_chars follows the new text.

    Null and empty texts have no secrets: a null text becomes empty. Equal texts become equal, repeated rows stay, an empty
    table gives an empty result; all columns stay, in their order, of which text and n_chars are computed.
    """
    grammars = fit_grammars(docs)

    def clean(texts: list[bytes]) -> list:
        out = []
        for t in texts:
            whole = t.decode("utf-8", "replace")
            out.append(redact(whole, all_spans(whole, grammars)[1]))
        return [out, [len(x) for x in out]]

    out = map_texts(docs, "text", docs.columns, [field("text", T.StringType()), field("n_chars", T.LongType())], clean)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
