"""Secret scans by grammar inference.

Credentials of known formats, labelled by family, make a prefix tree; its states are merged where the counts
of what follows them don't differ by more than Hoeffding's bound allows. The automaton that is left gives the
likelihood of a candidate, against that under an automaton inferred from ordinary long words, numbers,
addresses and paths in the same way.
"""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchline.llm.common import steps

#: Labelled examples of each family, and of each kind of ordinary string, that the automata learn from.
EXAMPLES = 1000
#: A candidate is a secret if its log likelihood ratio is over this: what fitted() gives, kept here for the workers.
RATIO = 1.0

KINDS = ["assign", "access", "hex", "format"]
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

# The patterns of the base kinds, letters of the first in either case.
_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(rf"""({_either("password")}|{_either("passwd")}|{_either("secret")}|{_either("token")}|{_either("api")}_?{_either("key")})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Classes of characters by the character that stands for each, and how many share it.
CLASSES = str.maketrans({c: "a" for c in "abcdef"} | {c: "z" for c in LOWER[6:]} | {c: "A" for c in UPPER} | {c: "9" for c in DIGITS})
SHARED = {"a": math.log(6), "z": math.log(20), "A": math.log(26), "9": math.log(10)}
#: Code points of a candidate at least; random strings of fewer can't be told from words and numbers (README has figures).
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.\-]{{{LEAST},}}={{0,2}}")


def symbols(text: str, literal: int = 0) -> str:
    """The first ``literal`` characters as they are, then classes: a to f, other small letters, capitals, digits."""
    return text[:literal] + text[literal:].translate(CLASSES)


def credentials(rng: random.Random, n: int) -> dict[str, list[str]]:
    """Labelled credentials: n of each published format, and n of each general shape that formats have.

    The shapes (random characters alone, in parts, or after a mark of a few letters) let the automata know
    credentials of formats that aren't listed.
    """
    some = lambda alphabet, k: "".join(rng.choices(alphabet, k=k))
    base64, hexadecimal = LOWER + UPPER + DIGITS, "0123456789abcdef"
    mark = lambda: some(rng.choice([LOWER, LOWER, UPPER]), rng.randint(2, 6)) + rng.choice("_-.")
    body = lambda a, b: some(rng.choice([base64, base64, base64 + "-_", base64 + "+/", LOWER + UPPER]), rng.randint(a, b))
    made = {
        "access_key_id": lambda: "AKIA" + some(UPPER + "234567", 16),
        "code_host": lambda: "gh" + rng.choice("pousr") + "_" + some(base64, 36),
        "chat": lambda: f"xox{rng.choice('bpar')}-{some(DIGITS, rng.randint(10, 13))}-{some(DIGITS, rng.randint(10, 13))}-{some(base64, 24)}",
        "payments": lambda: f"{rng.choice('sr')}k_{rng.choice(['live', 'test'])}_{some(base64, rng.choice([24, 32]))}",
        "maps": lambda: "AIza" + some(base64 + "-_", 35),
        "digest": lambda: some("0123456789abcdef", rng.choice([32, 40, 64])),
        "secret_key": lambda: some(base64 + "+/", 40),
        "signed": lambda: f"eyJ{some(base64, rng.randint(17, 30))}.eyJ{some(base64, rng.randint(30, 60))}.{some(base64 + '-_', 43)}",
        "opaque": lambda: body(20, 64),
        "marked": lambda: mark() + body(20, 48),
        "marked_digest": lambda: mark()[: rng.choice([-1, None])] + some(hexadecimal, rng.randint(24, 64)),
        "parts": lambda: ".".join([*([mark()[:-1]] * rng.randint(0, 1)), *(body(16, 48) for _ in range(rng.randint(2, 3)))]),
        "small": lambda: some(LOWER + DIGITS, rng.randint(24, 50)),
        "capital": lambda: some(UPPER + DIGITS, rng.randint(20, 40)),
    }
    return {family: [make() for _ in range(n)] for family, make in made.items()}


def ordinary(rng: random.Random, n: int) -> dict[str, list[str]]:
    """Strings of the candidates' alphabet that are no secrets."""
    syllables = ["re", "ti", "on", "an", "the", "er", "in", "es", "ou", "men", "ver", "ge", "la", "ción", "ch", "st", "lo", "bo", "que", "ai"]
    word = lambda a, b: "".join(rng.choice(syllables).replace("ó", "o") for _ in range(rng.randint(a, b)))
    capital = lambda w: w if rng.random() < 0.6 else w.capitalize() if rng.random() < 0.7 else w.upper()
    number = lambda a, b: "".join(rng.choices(DIGITS, k=rng.randint(a, b)))
    made = {
        "word": lambda: capital(word(6, 14)),
        "number": lambda: number(16, 24),
        "host": lambda: f"{word(1, 4)}{number(1, 3)}.{word(2, 5)}.{rng.choice(['com', 'org', 'net'])}",
        "mailbox": lambda: f"{word(1, 3)}.{number(1, 4)}.{word(2, 3)}{number(1, 3)}.{word(2, 4)}.com",
        "path": lambda: "/".join([word(1, 4), *(capital(word(1, 4)) + rng.choice(["", number(1, 4)]) for _ in range(rng.randint(2, 6)))]),
        "compound": lambda: rng.choice("-_").join(capital(word(1, 3)) + rng.choice(["", number(1, 4)]) for _ in range(rng.randint(4, 9))),
        "clauses": lambda: ".".join([rng.choice([word(4, 9), word(4, 9).capitalize()]), rng.choice([number(1, 4), word(1, 6), word(1, 6).capitalize()])]),
        "numbered": lambda: capital(word(6, 10)) + number(1, 5),
        "camel": lambda: rng.choice([word(1, 3), ""]) + "".join(word(1, 4).capitalize() for _ in range(rng.randint(3, 7))) + rng.choice(["", "", "NS", "ID", "URL"]),
        "run": lambda: rng.choice(LOWER + UPPER + DIGITS + "-_./+") * rng.randint(16, 70),
        "uuid": lambda: "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in (8, 4, 4, 4, 12)),
        "date": lambda: f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}T{number(2, 2)}{number(2, 2)}{number(2, 2)}.{number(3, 6)}",
    }
    return {kind: [x for x in (make() for _ in range(2 * n)) if len(x) >= 8][:n] for kind, make in made.items()}


class Automaton:
    """A probabilistic automaton inferred from strings by merging compatible states of their prefix tree."""

    def __init__(self, labelled: list[str], prefix: bool = False, alpha: float = 0.05) -> None:
        """``prefix``: what all strings begin with counts character by character, the rest by classes."""
        self.literal = len(os.path.commonprefix(labelled)) if prefix else 0
        strings = [symbols(s, self.literal) for s in labelled]
        self.seen, self.ends, self.next, self.taken = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.seen[0] += 1
            for c in s:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.taken.append({})
                self.taken[at][c] = self.taken[at].get(c, 0) + 1
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1
        self.limit = math.sqrt(0.5 * math.log(2 / alpha))
        share = Counter(c for s in strings for c in s)
        self.size = len(share) + 1
        self.share = {c: math.log(n / share.total()) for c, n in share.items()}
        self._merge()

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > self.limit * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.taken[p].keys() | self.taken[q].keys():
                if self._differ(self.taken[p].get(c, 0), n, self.taken[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree under q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            for c, count in self.taken[q].items():
                self.taken[p][c] = self.taken[p].get(c, 0) + count
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _merge(self) -> None:
        settled = [0]
        fringe = [(0, c) for c in sorted(self.next[0])]
        while fringe:
            parent, c = fringe.pop(0)
            state = self.next[parent][c]
            if state in settled:
                continue
            target = next((s for s in settled if self._compatible(s, state)), None)
            if target is None:
                settled.append(state)
            else:
                self.next[parent][c] = target
                self._fold(target, state)
            fringe = [(s, c) for s in settled for c in sorted(self.next[s]) if self.next[s][c] not in settled]
        self.states = len(settled)
        self._keep(settled)

    def _keep(self, settled: list[int]) -> None:
        """Leave out the tree's states that were merged into others; workers hold what is left."""
        place = {s: i for i, s in enumerate(settled)}
        self.seen = [self.seen[s] for s in settled]
        self.ends = [self.ends[s] for s in settled]
        self.taken = [self.taken[s] for s in settled]
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in settled]

    def log_likelihood(self, text: str) -> float:
        """Natural log of the string's probability; what no state expects costs by the symbols' shares."""
        at, total = 0, 0.0
        for i, c in enumerate(symbols(text, self.literal)):
            total -= SHARED.get(c, 0.0) if i >= self.literal else 0.0
            if at >= 0:
                total += math.log((self.taken[at].get(c, 0) + 0.05) / (self.seen[at] + 0.05 * self.size))
                at = self.next[at].get(c, -1)
            else:
                total += self.share.get(c, -7.0)
        return total + (math.log((self.ends[at] + 0.05) / (self.seen[at] + 0.05 * self.size)) if at >= 0 else -3.0)


class Scanner:
    """Base patterns, and one automaton for each family of credentials and kind of ordinary string."""

    def __init__(self, secret: dict[str, list[str]], plain: dict[str, list[str]]) -> None:
        self.secret = [Automaton(strings, prefix=True) for strings in secret.values()]
        self.plain = [Automaton(strings) for strings in plain.values()]

    def ratio(self, text: str) -> float:
        """Log likelihood under the likeliest family less that under the likeliest ordinary kind."""
        return max(a.log_likelihood(text) for a in self.secret) - max(a.log_likelihood(text) for a in self.plain)

    def is_secret(self, text: str) -> bool:
        return self.ratio(text) > RATIO

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """Base matches as (start, kind's place in KINDS, end)."""
        low = text.lower()
        out = []
        if any(w in low for w in ("passw", "secret", "token", "api")):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return sorted(out)

    def more(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates, and their parts, that the automata take for secrets, outside all base matches (sorted)."""
        starts = [s for s, _, _ in base]
        ends = list(accumulate((e for _, _, e in base), max))
        out = []
        for m in CANDIDATE.finditer(text):
            at = m.start()
            for s, _, e in base[bisect_right(ends, at) : bisect_left(starts, m.end())]:
                out += self.within(text, at, s)
                at = max(at, e)
                while at < m.end() and text[at] in "/.":
                    at += 1
            out += self.within(text, at, m.end())
        return out

    def within(self, text: str, start: int, end: int, cuts: str = "/.") -> list[tuple[int, int, int]]:
        """The stretch as one secret, or else those of its parts between slashes, and then between dots, that are.

        With more slashes than random characters have it is a path, whose parts alone count.
        """
        while start < end and text[end - 1] in ".-/":
            end -= 1
        if end - start < LEAST:
            return []
        if text.count("/", start, end) <= 1 + (end - start) // 32 and self.is_secret(text[start:end]):
            return [(start, 3, end)]
        for i, cut in enumerate(cuts):
            places = [start - 1, *(m.start() for m in re.compile(re.escape(cut)).finditer(text, start, end)), end]
            if len(places) > 2:
                return [x for a, b in zip(places, places[1:], strict=False) for x in self.within(text, a + 1, b, cuts[i + 1 :])]
        return []


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    rng = random.Random(20240607)
    return Scanner(credentials(rng, EXAMPLES), ordinary(rng, EXAMPLES))


def fitted(own: Scanner, n: int = 1000) -> float:
    """The ratio that parts labelled strings the automata haven't seen best.

    Its cost is the share of the worst family that it misses, and fifty times the share of the worst ordinary kind
    that it takes, as ordinary strings are the many; of equally good ones, the middle, in halves.
    """
    rng = random.Random(20240608)
    held = lambda kinds: [sorted(map(own.ratio, strings)) for strings in kinds.values()]
    secret, plain = held(credentials(rng, n)), held({kind: [s for s in strings if len(s) >= 16] for kind, strings in ordinary(rng, n).items()})
    missed = lambda t: max(bisect_right(r, t) / len(r) for r in secret)
    taken = lambda t: max(1 - bisect_right(r, t) / len(r) for r in plain)
    cost = {t / 2: missed(t / 2) + 50 * taken(t / 2) for t in range(-20, 61)}
    best = [t for t, c in cost.items() if c == min(cost.values())]
    return best[len(best) // 2]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, with_text: bool = False, mask: str = "[SECRET]") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of each row; with_text adds ``masked``.

    Places are code points, ends exclusive. A null text counts as empty; texts without secrets have empty
    spans. ``masked`` is the text with each run of overlapping spans replaced by ``mask``. Rows keep their
    number; other columns are left out.
    """

    own = scanner()  # inferred on the driver, a few hundred states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            rows: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base = own.base(text or "")
                spans = sorted(base + own.more(text or "", base))
                values = [doc_id, *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)]
                if with_text:
                    values.append(masked(text, spans, mask))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ["masked"] * with_text
    types = [pa.int64()] * 4 + [pa.string()] * (2 + with_text)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", masked string" * with_text
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) with the secrets in ``text`` masked, and n_chars to match.

    Null and empty texts stay as they are, and repeated rows as often as they are there; an empty table gives none.
    """

    own = scanner()  # inferred on the driver, a few hundred states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            clean = []
            for text in batch.column("text").to_pylist():
                base = own.base(text or "")
                clean.append(masked(text, sorted(base + own.more(text or "", base)), mask))
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
