"""Secret scans: fixed patterns, and formats learned by grammar inference.

Each format's labelled credentials make a prefix tree over literals and character sets; states whose continuations are
statistically compatible merge (ALERGIA), which leaves one probabilistic automaton a format. Every run of credential
characters long enough for any automaton, and every part of one between separators, is scored: by how many bits its
likelihood under a format exceeds its likelihood as ordinary text or as a random string. A format's threshold is set on
credentials and on a background that were not learned from.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .wordops import slices, utf8

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
CUES = (b"passw", b"secret", b"token", b"api")
SEPARATORS = frozenset("=/.+_-")
EDGES = ".=-"
ALPHA = 0.05
LITERAL = 8
FALSE_SHARE = 0.005  # of the background that a format may accept, in the setting of its threshold
SPLIT_BITS = 8.0  # what a part must be likelier for each side on which it ends inside a longer name or path
MARK = "[SECRET]"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALNUM, HEXES = DIGITS + LOWER + UPPER, DIGITS + "abcdef"
#: Character sets, smaller ones first; a symbol is a literal or the first of these with all of a format's other characters.
SETS = {"digit": DIGITS, "hex": HEXES, "upper": UPPER + DIGITS, "alnum": ALNUM, "url": ALNUM + "_-", "base64": ALNUM + "+/"}
ORDINARY = """
The quick brown fox jumps over the lazy dog while many readers question whether ordinary sentences should have some variety
of words, numbers and names. International organisations responsible for communication between different governments
published recommendations concerning environmental protection and administrative procedures during the last conference.
Zwischen den Jahren wurden verschiedene Einrichtungen geschaffen, die sich mit der Entwicklung und Verbreitung allgemeiner
Kenntnisse beschaeftigen; daraus entstanden gesellschaftliche Veranstaltungen. Les responsables des administrations ont
presente plusieurs propositions concernant la protection de l'environnement et le developpement des communications. Los
trabajadores y las organizaciones internacionales presentaron diferentes propuestas sobre la proteccion de los derechos.
src/main/java/org/example/application/configuration/ApplicationContextInitializer.java tests/unit/test_document_index.py
IMG_20240115_123456789_HDR.jpg Screenshot_2023-11-04-10-22-35.png backup-2022-03-17T08-30-00.tar.gz report_final_v2.docx
getUserAccountInformation setDefaultConnectionTimeout MAX_BUFFER_SIZE_IN_BYTES kDefaultThreadCount handle_incoming_request
https://www.example.org/products/catalogue/index.html?page=12&sort=price user.name@example.com version-1.12.3-beta.4
"""
_CODES = {c: i for i, c in enumerate(ALNUM + "+/_.=-", 1)}
_PLACES = len(_CODES) + 1


def _some(rng: random.Random, chars: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(chars, k=rng.randint(least, most or least)))


#: Credential formats as their issuers document them.
FORMATS = {
    "aws_key": lambda r: "AKIA" + _some(r, UPPER + "234567", 16),
    "aws_secret": lambda r: _some(r, ALNUM + "+/", 40),
    "github": lambda r: r.choice(("ghp_", "gho_", "ghs_")) + _some(r, ALNUM, 36),
    "gitlab": lambda r: "glpat-" + _some(r, ALNUM + "_-", 20),
    "google": lambda r: "AIza" + _some(r, ALNUM + "_-", 35),
    "jwt": lambda r: f"eyJ{_some(r, ALNUM, r.choice((17, 33, 34, 49)))}.eyJ{_some(r, ALNUM, 20, 200)}.{_some(r, ALNUM + '_-', 43)}",
    "npm": lambda r: "npm_" + _some(r, ALNUM, 36),
    "sendgrid": lambda r: f"SG.{_some(r, ALNUM + '_-', 22)}.{_some(r, ALNUM + '_-', 43)}",
    "slack": lambda r: f"xox{r.choice('bp')}-{_some(r, DIGITS, 11, 12)}-{_some(r, DIGITS, 11, 12)}-{_some(r, ALNUM, 24)}",
    "stripe": lambda r: r.choice(("sk_live_", "rk_live_")) + _some(r, ALNUM, 24),
}


def labelled(each: int = 300, seed: int = 11) -> dict[str, list[str]]:
    """Credentials of each format, made up by rule."""
    rng = random.Random(seed)
    return {name: [make(rng) for _ in range(each)] for name, make in FORMATS.items()}


def background(each: int = 2000, seed: int = 12) -> list[str]:
    """Runs of credential characters that are no credentials: words, names, paths and dates put together, and random strings."""
    rng = random.Random(seed)
    parts = re.findall(r"[A-Za-z0-9+/_.=-]{2,}", ORDINARY)
    out = [_some(rng, rng.choice((ALNUM, ALNUM + "+/", ALNUM + "_-", LOWER, LOWER + DIGITS, UPPER + DIGITS, DIGITS)), 16, 200) for _ in range(each)]
    out += [rng.choice(("_", "-", "/", "", ".")).join(rng.choices(parts, k=rng.randint(2, 8))) + rng.choice(("", str(rng.randint(0, 99999)))) for _ in range(each)]
    return out


class Automaton:
    """A deterministic probabilistic automaton over literals and character sets, for one format."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ended = [0]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._tree(samples)
        self._merge()

    def _tree(self, samples: list[str]) -> None:
        """The prefix tree. A character that many strings have at a place is a literal there, as is a dot anywhere; all others of the format share one set."""
        nodes, todo, free = [], [(0, 0, samples)], set()
        while todo:
            q, depth, own = todo.pop()
            by: dict[str, list[str]] = {}
            for s in own:
                if len(s) > depth:
                    by.setdefault(s[depth], []).append(s)
            self.ended[q] = len(own) - sum(map(len, by.values()))
            kept = [c for c in sorted(by) if c == "." or (len(by[c]) >= LITERAL and len(by[c]) * 4 >= len(own))]
            others = [s for c in sorted(by) if c not in kept for s in by[c]]
            free |= {s[depth] for s in others}
            nodes.append((q, [*((c, by[c]) for c in kept), *([("", others)] if others else [])]))
            for _, inside in nodes[-1][1]:
                todo.append((len(self.next), depth + 1, inside))
                self.next.append({})
                self.passed.append({})
                self.ended.append(0)
        shared = next((n for n, chars in SETS.items() if free <= set(chars)), "any")
        t = 1
        for q, groups in nodes:
            for c, inside in groups:
                self.next[q][c or shared], self.passed[q][c or shared] = t, len(inside)
                t += 1

    def _total(self, q: int) -> int:
        return self.ended[q] + sum(self.passed[q].values())

    def _alike(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return not n1 or not n2 or abs(f1 / n1 - f2 / n2) < self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        """Hoeffding's bound holds for ends and symbols here and at all states both reach."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self._total(a), self._total(b)
            if n and m and not (self.ended[a] and self.ended[b]) and not self.passed[a].keys() & self.passed[b].keys():
                return False  # few visits make all shares alike, so states must have a continuation in common
            if not self._alike(self.ended[a], n, self.ended[b], m):
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if not self._alike(self.passed[a].get(c, 0), n, self.passed[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree under b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            for c, n in self.passed[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        red = [0]
        while True:
            blue = sorted({(t, q, c) for q in red for c, t in self.next[q].items() if t not in red}, key=lambda x: (-self._total(x[0]), x))
            if not blue:
                break
            t, q, c = blue[0]
            for r in red:
                if self._compatible(r, t):
                    self.next[q][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
        place = {q: i for i, q in enumerate(red)}
        every = "".join(_CODES)
        #: By place: for each character the next place and the log2 chance of the step, literals before sets; the log2 chance of an end.
        self.steps: list[dict[str, tuple[int, float]]] = []
        for q in red:
            own: dict[str, tuple[int, float]] = {}
            for k in sorted(self.next[q], key=lambda k: len(SETS.get(k, every if k == "any" else k))):
                chars = SETS.get(k, every if k == "any" else k)
                step = (place[self.next[q][k]], math.log2(self.passed[q][k] / self._total(q) / len(chars)))
                own |= {c: step for c in chars if c not in own}
            self.steps.append(own)
        self.ends = [math.log2(self.ended[q] / self._total(q)) if self.ended[q] else -math.inf for q in red]
        self.shortest = self._shortest()

    def _shortest(self) -> int:
        """Length of the shortest string with a chance."""
        reach, seen, n = {0}, {0}, 0
        while reach and not any(self.ends[q] > -math.inf for q in reach):
            reach = {t for q in reach for t, _ in self.steps[q].values()} - seen
            seen |= reach
            n += 1
        return n

    def score(self, text: str) -> float:
        """Log2 likelihood, the end included; minus infinity for what the automaton can't write."""
        at, total = 0, 0.0
        for c in text:
            if c not in self.steps[at]:
                return -math.inf
            at, chance = self.steps[at][c]
            total += chance
        return total + self.ends[at]


class Background:
    """The likelihood of a string as ordinary text, by pairs of characters, or as random characters of one set, whichever is most."""

    RANDOM = (DIGITS, HEXES, LOWER + DIGITS, UPPER + DIGITS, ALNUM + "+/_.=-")
    LENGTH = math.log2(200)

    def __init__(self, texts: list[str]):
        count = [[0.2] * _PLACES for _ in range(_PLACES)]
        for text in texts:
            for word in re.findall(r"[A-Za-z0-9+/_.=-]+", text):
                codes = [0, *(_CODES[c] for c in word)]
                for a, b in zip(codes, codes[1:]):
                    count[a][b] += 1
        self.bits = [[-math.log2(n / sum(row)) for n in row] for row in count]
        self.random = [(set(chars), math.log2(min(len(chars), 64))) for chars in self.RANDOM]

    def score(self, run: str, a: int, e: int) -> float:
        """Log2 likelihood of the characters of run from a to e."""
        codes = [_CODES[c] for c in run[max(a - 1, 0) : e]]
        codes = codes if a else [0, *codes]
        ordinary = sum(self.bits[x][y] for x, y in zip(codes, codes[1:]))
        own = set(run[a:e])
        return -min(ordinary, *((e - a) * bits for chars, bits in self.random if own <= chars)) - self.LENGTH


class Scanner:
    """Finds base matches and learned formats in one text."""

    def __init__(self, samples: dict[str, list[str]] | None = None, alpha: float = ALPHA, false_share: float = FALSE_SHARE):
        samples = labelled() if samples is None else samples
        self.background = Background([ORDINARY])
        self.automata = {n: Automaton([s for i, s in enumerate(own) if i % 3], alpha) for n, own in samples.items()}
        #: Bits over the background that a format asks for: what all but false_share of the background stay under, and at least 1.
        self.least: dict[str, float] = {}
        #: Share of the credentials kept from learning that reach it.
        self.recall: dict[str, float] = {}
        runs = background()
        for name, own in samples.items():
            gains = sorted((self.gain(name, s) for s in runs), reverse=True)
            self.least[name] = max(1.0, gains[int(false_share * len(gains))] + 1e-6) if gains else 1.0
            held = [self.gain(name, s) >= self.least[name] for i, s in enumerate(own) if i % 3 == 0]
            self.recall[name] = sum(held) / len(held) if held else 0.0
        self.shortest = min((a.shortest for a in self.automata.values()), default=0)
        self.run = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % max(self.shortest, 1))

    def gain(self, name: str, run: str) -> float:
        """Bits by which a whole run is likelier in the format than as background."""
        score = self.automata[name].score(run)
        return score - self.background.score(run, 0, len(run)) if score > -math.inf else score

    def best(self, text: str) -> tuple[str, float]:
        """The format of the most bits over its threshold, and these bits; a credential has none or more."""
        if any(c not in _CODES for c in text):
            return "", -math.inf
        return max(((n, self.gain(n, text) - self.least[n]) for n in self.automata), key=lambda x: x[1], default=("", -math.inf))

    def credential(self, text: str) -> bool:
        return self.best(text)[1] >= 0

    def candidates(self, run: str) -> Iterator[tuple[int, int, str, float]]:
        """start, end, format, bits over the threshold of every part of run that is a credential.

        A part starts at run's start or after a separator and ends at run's end or before one, but does not start or end
        with . = or - itself. A side inside a name or path, that is after or before one of / . + _ -, asks for SPLIT_BITS more.
        """
        first, last = len(run) - len(run.lstrip(EDGES)), len(run.rstrip(EDGES))
        starts = [a for a in range(first, last) if a == first or (run[a - 1] in SEPARATORS and run[a] not in EDGES)]
        for a in starts:
            for name, automaton in self.automata.items():
                at, total, steps, ends = 0, 0.0, automaton.steps, automaton.ends
                cost = self.least[name] + (0.0 if a == first or run[a - 1] == "=" else SPLIT_BITS)
                for i in range(a, last):
                    step = steps[at].get(run[i])
                    if step is None:
                        break
                    at, total = step[0], total + step[1]
                    e = i + 1
                    if ends[at] > -math.inf and run[i] not in EDGES and (e == last or run[e] in SEPARATORS):
                        more = total + ends[at] - self.background.score(run, a, e) - cost - (0.0 if e == last or run[e] == "=" else SPLIT_BITS)
                        if more >= 0:
                            yield a, e, name, more

    def parts(self, run: str) -> list[tuple[int, int]]:
        """start, end of credentials in run: the disjoint candidates whose bits add up to most, one bit for each being added."""
        found = sorted(set(self.candidates(run)), key=lambda x: (x[1], x[0]))
        if not found:
            return []
        ends = [x[1] for x in found]
        best: list[tuple] = [(0.0, None)]
        for a, e, _, more in found:
            before = best[bisect.bisect_right(ends, a, 0, len(best) - 1)]
            with_it = (before[0] + more + 1, (a, e, before[1]))
            best.append(with_it if with_it[0] > best[-1][0] else best[-1])
        out, chain = [], best[-1][1]
        while chain:
            out.append(chain[:2])
            chain = chain[2]
        return out[::-1]

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """start, kind, end in bytes, ordered; formats only where no base match lies."""
        base = []
        low = text.lower()
        if any(c in low for c in CUES):
            base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if b"AKIA" in text:
            base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        more, ordered = [], sorted((s, e) for s, _, e in base)
        for m in self.run.finditer(text):
            a, b = m.span()
            for s, e in [x for x in ordered if x[0] < b and x[1] > a] + [(b, b)]:
                if s - a >= self.shortest:
                    more += [(a + x, 3, a + y) for x, y in self.parts(text[a:s].decode())]
                a = max(a, e)
        return sorted(base + more)

    def scored(self, value: bytes) -> str:
        """The best format of a span's credential and its bits over that format's threshold; - where none can write it."""
        found = ASSIGN.match(value)
        name, more = self.best((found[2] if found else value).decode("utf-8", "replace").strip(EDGES))
        return f"{name}:{more:.1f}" if more > -math.inf else "-"


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if text.isascii() or not spans:
        return spans
    place = lambda b: len(text[:b].decode())
    return [(place(a), k, place(b)) for a, k, b in spans]


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string, likelihoods string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 1)):
        data, offsets = utf8(batch.column(1))
        rows = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes()
            found = scanner().spans(text)
            spans = _points(text, found)
            name = lambda own: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in own)
            counts = [sum(x[1] == k for x in spans) for k in range(4)]
            rows.append((*counts, hashlib.sha256(name([x for x in spans if x[1] < 3]).encode()).hexdigest(), name(spans), ",".join(scanner().scored(text[s:e]) for s, _, e in found)))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], [x.split()[0] for x in SCANNED.split(", ")])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans, likelihoods of each row of docs.

    likelihoods has an entry a span: its likeliest format and the bits over that format's threshold, or - where no format
    can write it. Only doc_id and text are read. Null and empty texts hold nothing; repeated rows are each scanned; an empty
    table gives no rows. Kinds may overlap each other; learned formats never overlap base matches.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCANNED)


def redact(text: bytes) -> bytes:
    """text with each secret, or stretch of overlapping ones, replaced by MARK."""
    out, at = [], 0
    for a, _, b in scanner().spans(text):
        if a >= at:
            out += [text[at:a], MARK.encode()]
        at = max(at, b)
    return b"".join(out) + text[at:] if out else text


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, whole.schema.get_field_index("text"))):
        i = batch.schema.get_field_index("text")
        texts = [None if t is None else redact(t.encode()).decode() for t in batch.column(i).to_pylist()]
        yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))


def redacted(docs: DataFrame) -> DataFrame:
    """docs, all columns, with secrets in text replaced; a null text stays null. n_chars, if present, follows the text."""
    ship(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
