"""Secret scan: fixed patterns and guess costs of credential values.

Base spans come from three patterns (assignment, access key, long hex run). The method then
looks at values in a credential context (a key word, a separator, a value) and adds those that
are hard to guess: the guess cost is the least sum of log10 guesses over all ways to cut a value
into known words, dates, years, repeats, sequences, keyboard walks and brute-force characters,
found by dynamic programming. Known words are a short list of common password words, then the whole words in the
vocabulary of a public tokenizer in the order of its ids (frequent words come first), some ten thousand;
the file is a parameter. A repeat is a block of 2 to 20 characters that is said again as often as it goes. Placeholders (password, changeme, qwerty123) are cheap, so a
value of COST or more is taken as a secret.

Defined results: null or empty text has no spans (counts 0, the digest of the empty string);
a null doc_id is kept; repeated rows are each scanned; offsets count code points, end
exclusive; whole texts and quoted values (to the closing quote in the same line) are scanned whatever their length; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerscope.llm.words import lean

#: log10 guesses from which a credential value counts as a secret.
COST = 10.0
#: A piece of a value other than a brute-force character has at most so many characters.
PIECE = 40
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Values of other keys and characters than ASSIGN has, such as pwd: "p@ss w0rd!".
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|credentials?|auth|api[_-]?key|access[_-]?key|private[_-]?key)["']?[\x20\t]*(?:[:=]|=>|\bis\b)[\x20\t]*(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"',;<>]{6,}))""", re.IGNORECASE | re.ASCII)
_HINT = re.compile(r"passw|passphrase|pwd|secret|token|credential|auth|key", re.IGNORECASE | re.ASCII)

# Common words of passwords and placeholders, most common first.
WORDS = (
    "password pass admin root user login test welcome letmein secret token example changeme default master hello "
    "dragon monkey shadow sunshine princess football baseball love angel summer winter spring autumn god money "
    "freedom whatever trust super guest demo sample none null true false your my the key api access private public "
    "value string here foo bar baz temp dummy todo database server system network company office home house secure "
    "security january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday red green blue black white orange purple silver gold star starwars "
    "batman superman michael jordan thomas daniel robert charlie andrew jessica ashley hunter killer soccer hockey "
    "pepper ginger cookie cheese coffee computer internet google apple windows linux abc xyz"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_KEY = {c: (x, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
_LEET = str.maketrans("04@31!$57", "oaaeiisst")
_DAY, _MONTH = "(?:0[1-9]|[12]\\d|3[01])", "(?:0[1-9]|1[0-2])"
#: (pattern, log10 guesses): a year; a day of such a year, or of one of two digits, in the usual orders.
_DATES = tuple(
    (re.compile(p, re.ASCII), cost)
    for p, cost in (
        (r"(?:19|20)\d\d", math.log10(120)),
        (rf"(?:19|20)\d\d([-/._]?){_MONTH}\1{_DAY}", math.log10(120 * 365)),
        (rf"{_DAY}([-/._]?){_MONTH}\1(?:19|20)\d\d", math.log10(120 * 365)),
        (rf"{_MONTH}([-/._]?){_DAY}\1(?:19|20)\d\d", math.log10(120 * 365)),
        (rf"\d\d([-/._]?){_MONTH}\1{_DAY}", math.log10(100 * 365)),
        (rf"{_DAY}([-/._]?){_MONTH}\1\d\d", math.log10(100 * 365)),
        (rf"{_MONTH}([-/._]?){_DAY}\1\d\d", math.log10(100 * 365)),
    )
)


@lru_cache(maxsize=4)
def ranks(vocabulary: str | None) -> dict[str, int]:
    """Rank of each known word; vocabulary: path of a tokenizer's JSON file whose tokens mark a space before them, or none."""
    words = list(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        words += [t[1:].lower() for t in sorted(ids, key=ids.get) if t[0] == "\u0120" and len(t) > 4 and t[1:].isascii() and t[1:].isalpha()]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys(words))}


def dates_at(value: str, i: int) -> list[tuple[int, float]]:
    """(end, log10 guesses) of the dates that begin at i."""
    if not value[i].isdigit():
        return []
    return [(m.end(), cost) for pattern, cost in _DATES if (m := pattern.match(value, i))]


def _brute(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def _adjacent(a: str, b: str) -> bool:
    p, q = _KEY.get(a), _KEY.get(b)
    return p is not None and q is not None and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def guess_cost(value: str, enough: float = math.inf, vocabulary: str | None = None) -> float:
    """Least log10 guesses over all segmentations of a value; with `enough`, a lower bound that reaches it may end the search."""
    n, low, rank = len(value), value.lower(), ranks(vocabulary)
    low = low if len(low) == n else value  # lowering may change the length of a few characters
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n
    same = [0] * 21  # by block size: characters from i on that equal those a block later
    again: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (size, count) of repeated blocks
    for i in reversed(range(n)):
        for size in range(2, min(20, n - 1 - i) + 1):
            same[size] = same[size] + 1 if value[i] == value[i + size] else 0
            if same[size] >= size:
                again[i].append((size, same[size] // size + 1))
    far = math.inf  # least cost of a repeat, which may end anywhere
    for i in range(n):
        if far >= enough and min(best[i : i + PIECE + 1]) >= enough:  # all ways to the end pass here
            return enough
        base = best[i]
        best[i + 1] = min(best[i + 1], base + _brute(value[i]))
        for end, cost in dates_at(value, i):
            best[end] = min(best[end], base + cost)
        stop = min(n, i + PIECE)
        for j in range(i + 3, stop + 1):  # words, with capitals and look-alikes
            for form, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if form in rank:
                    extra += 0.0 if value[i:j].islower() else 0.5
                    best[j] = min(best[j], base + math.log10(rank[form] + 1) + extra)
        step = run = walk = 0
        for j in range(i + 1, stop):  # runs of one step, walks on the keyboard
            d = ord(value[j]) - ord(value[j - 1])
            if j == i + 1:
                step = d
            if run == j - 1 - i and d == step and abs(d) <= 1 and value[j].isalnum():
                run = j - i
                if run >= 2:
                    best[j + 1] = min(best[j + 1], base + _brute(value[i]) + math.log10((run + 1) * 2))
            if walk == j - 1 - i and _adjacent(low[j - 1], low[j]):
                walk = j - i
                if walk >= 3:
                    best[j + 1] = min(best[j + 1], base + math.log10(47 * (walk + 1) * 4))
            if run < j - i and walk < j - i:
                break
        for size, k in again[i]:
            cost = base + sum(map(_brute, value[i : i + size])) + math.log10(k)
            best[i + k * size] = min(best[i + k * size], cost)
            far = min(far, cost)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of kind, kind, end) of the fixed patterns."""
    out = [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    if _HINT.search(text):
        out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(out)


def value_spans(text: str, vocabulary: str | None = None) -> list[tuple[int, int, str, int]]:
    """Credential values that cost COST or more."""
    out = []
    if _HINT.search(text):
        for m in CONTEXT.finditer(text):
            g = m.lastindex
            if guess_cost(m[g], COST, vocabulary) >= COST:
                out.append((m.start(g), 3, "guess", m.end(g)))
    return out


def scan(text: str | None, vocabulary: str | None = None) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int, str, int]]]:
    """Base spans, and all spans, each by start and kind."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + value_spans(text, vocabulary))


def _said(spans: list[tuple[int, int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def _scan(vocabulary: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                found = [scan(t, vocabulary) for t in part.column(1).to_pylist()]
                count = [[sum(s[2] == kind for s in base) for base, _ in found] for kind in KINDS[:3]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([_said(a) for _, a in found], pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return run


def scan_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row; one pass, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(_scan(vocabulary)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, vocabulary: str | None = None, mask: str = "[secret]") -> str | None:
    """The text with each run of overlapping spans replaced."""
    if not text:
        return text
    out, at = [], 0
    _, spans = scan(text, vocabulary)
    for a, _, _, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def _redact(vocabulary: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                yield part.set_column(at, batch.schema.field(at), pa.array([redact(t, vocabulary) for t in part.column(at).to_pylist()], batch.schema.field(at).type))

    return run


def redact_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The same rows and columns with secrets in `text` masked, and n_chars, where there is one, counted anew."""
    out = docs.mapInArrow(lean(_redact(vocabulary)), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
