"""Secret scans: guess cost of values in credential contexts by dynamic programming."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import id_text

KEYS = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"
#: A key word, what may follow it in a name, an assignment, and a value in quotes or up to a blank.
CONTEXT = re.compile(rf"""({KEYS})[a-z0-9_-]{{0,32}}["']?[ \t]*+(?:=>|:=|=|:)[ \t]*+(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;<>]{{4,}}))""", re.IGNORECASE)
#: log10 of the guesses from which on a value counts as a secret.
SECRET = 10.0
#: Cost of joining one more segment.
JOIN = log10(2)
#: Words by rank, most frequent first: common passwords, words of placeholders, and short words of English.
WORDS = """password 123456 qwerty admin secret test user root letmein welcome login token key pass changeme example default
guest abc the and for you this that with your from have not are was all new one our out can will more about when time
there some other than into only over also back after two first last very even most life work world home great little
house people dragon monkey football baseball master sunshine princess shadow superman batman iloveyou trustno freedom
whatever hello hunter summer winter spring autumn monday friday january february march april june july august september
october november december red green blue black white orange yellow silver gold love money power star king queen angel
server database client service access private public system local live dev prod staging sample demo dummy placeholder
value string none null true false todo insert here replace enter some put real fake foo bar baz temp tmp my mypassword
hidden redacted removed xxxx api auth code data file name number open close start stop computer internet network cloud
letter magic cookie coffee pepper ginger tiger lion eagle horse tree water fire earth wind river mountain ocean moon
""".split()
RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys(WORDS))}
#: Characters in the longest word or date.
LONGEST = max(10, *map(len, RANK))
LEET = str.maketrans("013457@$!", "oieastasi")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_PLACE = {c: (r, i) for r, keys in enumerate(KEYBOARD) for i, c in enumerate(keys)}
NEIGHBOURS = {c: {d: (q - r, j - i) for d, (q, j) in _PLACE.items() if (q == r and abs(j - i) == 1) or (q == r + 1 and j - i in (0, -1)) or (q == r - 1 and j - i in (0, 1))} for c, (r, i) in _PLACE.items()}
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:0[1-9]|1[0-2])([-/._]?)(?:0[1-9]|[12]\d|3[01])\3(?:19|20)?\d\d)\Z")
YEAR = re.compile(r"(?:19|20)\d\d\Z")


def word_cost(s: str, rank: dict[str, int] = RANK) -> float | None:
    """A word of the list, in any case, with digits or signs for letters, or backwards."""
    low = s.lower()
    for text, twist in ((low, 1), (low.translate(LEET), 2), (low[::-1], 2)):
        if text in rank:
            case = 1 if s == low else 2 if s in (s.upper(), s.capitalize()) else 2 ** sum(c.isupper() for c in s)
            return log10(rank[text] * twist * case)
    return None


def date_cost(s: str) -> float | None:
    if YEAR.match(s):
        return log10(200)
    if 6 <= len(s) <= 10 and DATE.match(s):
        return log10(365 * 200 * (1 if s.isdigit() else 4))
    return None


def walk_cost(s: str) -> float | None:
    """Three or more neighbouring keys one after another: a start, a length and the turns."""
    if len(s) < 3:
        return None
    low = s.lower().translate(SHIFTED)
    turns, way = 0, None
    for a, b in zip(low, low[1:]):
        step = NEIGHBOURS.get(a, {}).get(b)
        if step is None:
            return None
        turns += step != way
        way = step
    return log10(len(_PLACE) * (len(s) - 1)) + turns * log10(6) + (0 if s in (low, s.lower()) else log10(2))


#: Characters of each kind.
KINDS = (10, 26, 26, 33, 100)


def char_kinds(c: str) -> int:
    """The kinds of a character, a bit each."""
    digit, low, up = c.isdigit(), c.islower(), c.isupper()
    return digit | low << 1 | up << 2 | (not c.isalnum() and ord(c) < 128) << 3 | (ord(c) > 127 and not (digit or low or up)) << 4


def alphabet(kinds: int) -> int:
    return sum(n for k, n in enumerate(KINDS) if kinds >> k & 1)


def brute_cost(s: str) -> float:
    """All strings of the same length over the kinds of characters in it."""
    kinds = 0
    for c in set(s):
        kinds |= char_kinds(c)
    return len(s) * log10(alphabet(kinds))


def repeat_unit(s: str) -> str | None:
    """The shortest string that makes up s by being repeated."""
    at = (s + s).find(s, 1)
    return s[:at] if 0 < at < len(s) else None


def segment_cost(s: str) -> tuple[float, str]:
    """Least cost of s as one segment, and its kind."""
    best = (brute_cost(s), "brute")
    for kind, cost in (("word", word_cost(s)), ("date", date_cost(s)), ("walk", walk_cost(s))):
        if cost is not None and cost < best[0]:
            best = (cost, kind)
    if unit := repeat_unit(s):
        cost = guess_cost(unit)[0] + log10(len(s) // len(unit))
        if cost < best[0]:
            best = (cost, "repeat")
    return best


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(begin, end, p) of the longest spans that repeat a unit of p characters twice or more, the unit no repeat itself."""
    x, out = np.fromiter(map(ord, value), dtype=np.uint32, count=len(value)), []
    for p in range(1, len(x) // 2 + 1):
        # p equal places in a row hold one that is a multiple of p.
        if not (x[:-p:p] == x[p::p]).any():
            continue
        edge = np.concatenate([[-1], np.flatnonzero(x[:-p] != x[p:]), [len(x) - p]])
        for k in np.flatnonzero(np.diff(edge) > p).tolist():
            begin, end = int(edge[k]) + 1, int(edge[k + 1]) + p
            unit = value[begin : begin + p]
            if (unit + unit).find(unit, 1) == p:
                out.append((begin, end, p))
    return out


def _least(totals: np.ndarray) -> tuple[float, int]:
    """The least, and the place of the first that equals it."""
    low = totals.min()
    return float(low), int((totals <= low + 1e-12).argmax())


def guess_cost(value: str, known: dict[str, float] | None = None) -> tuple[float, str]:
    """log10 of the guesses that the cheapest segmentation takes, and its kinds in order.

    The cost of a segmentation is the sum of its segments' costs and JOIN for each
    after the first. No two brute segments are next to each other: characters that
    nothing explains are one segment over all their kinds. Among equals the one
    whose last segment is longest. Segments are of any length. known: costs of the
    units of repeats, filled on the way.
    """
    known = {} if known is None else known
    n = len(value)
    logs = np.log10(np.arange(1, n + 2))  # logs[k]: of k + 1
    # start[i]: cost of what is before a segment that begins at i.
    start, back = np.zeros(n + 1), [(0, "")] * (n + 1)
    # The same where the segment before it isn't brute.
    plain, back_plain = np.append(0.0, np.full(n, np.inf)), [(0, "")] * (n + 1)
    # Brute: for each set of kinds the begin that is cheapest up to here, all characters since being in the set.
    sort = [char_kinds(c) for c in value]
    sets = {0}
    for k in set(sort):
        sets |= {k | s for s in sets}
    rate = {s: log10(alphabet(s)) for s in sets if s}
    brute: dict[int, tuple[float, int] | None] = dict.fromkeys(rate)
    # Walks: the direction of each step between neighbouring keys, turns and capitals up to each place.
    low = [c.lower().translate(SHIFTED) for c in value]
    step = [NEIGHBOURS.get(a, {}).get(b) for a, b in zip(low, low[1:])]
    turns = np.cumsum([0] + [a != b for a, b in zip(step, step[1:])])
    capitals = np.cumsum([0] + [c != c.lower() for c in value])
    walk = 0
    ends: dict[int, list[tuple[int, int]]] = {}
    runs = repeats(value)
    for begin, end, p in runs:
        ends.setdefault(begin + 2 * p, []).append((begin, p))
    last = {(begin, p): end for begin, end, p in runs}
    going: list[tuple[int, int]] = []
    for j in range(1, n + 1):
        found: list[tuple[int, float, str]] = []
        for s, r in rate.items():
            if not sort[j - 1] & s:
                brute[s] = None
                continue
            key = float(plain[j - 1]) - (j - 1) * r
            if key < np.inf and (brute[s] is None or key < brute[s][0] - 1e-12):
                brute[s] = (key, j - 1)
            if brute[s]:
                i = brute[s][1]
                found.append((i, float(plain[i]) + (j - i) * r, "brute"))
        for i in range(max(0, j - LONGEST), j):
            part = value[i:j]
            for kind, cost in (("word", word_cost(part)), ("date", date_cost(part))):
                if cost is not None:
                    found.append((i, float(start[i]) + cost, kind))
        if j > 1 and step[j - 2] is None:
            walk = j - 1
        if j - walk >= 3:
            i = np.arange(walk, j - 2)
            total = start[i] + logs[j - 2 - i] + log10(len(_PLACE)) + (1 + turns[j - 2] - turns[i]) * log10(6) + (capitals[j] > capitals[i]) * log10(2)
            cost, at = _least(total)
            found.append((walk + at, cost, "walk"))
        going = [x for x in going if last[x] >= j] + ends.get(j, [])
        for begin, p in going:
            unit = value[j - p : j]
            if unit not in known:
                known[unit] = guess_cost(unit, known)[0]
            i = np.arange(j - 2 * p, begin - 1, -p)[::-1]
            cost, at = _least(start[i] + known[unit] + logs[(j - i) // p - 1])
            found.append((int(i[at]), cost, "repeat"))
        # Stable: of kinds that cost the same for one span the first above stays.
        found.sort(key=lambda x: x[0])
        least = other = None
        for i, cost, kind in found:
            if least is None or cost < least[1] - 1e-12:
                least = (i, cost, kind)
            if kind != "brute" and (other is None or cost < other[1] - 1e-12):
                other = (i, cost, kind)
        start[j], back[j] = (least[1] + JOIN, (least[0], least[2])) if least else (np.inf, (0, ""))
        if other:
            plain[j], back_plain[j] = other[1] + JOIN, (other[0], other[2])
    kinds, j, before = [], n, ""
    while j:
        j, before = (back_plain if before == "brute" else back)[j]
        kinds.append(before)
    return float(start[n] - JOIN) if n else 0.0, " ".join(reversed(kinds))


OUT = "doc_id long, key string, at int, length int, guesses_log10 double, kinds string, fingerprint string, is_secret boolean"


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[float, str]] = {}
        for batch in batches:
            try:
                some = batch.filter(pc.fill_null(pc.match_substring_regex(batch.column(1), f"({KEYS})", ignore_case=True), False))
            except pa.ArrowInvalid:  # bytes that aren't UTF-8
                some = batch
            rows = []
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                for m in CONTEXT.finditer(text or ""):
                    k = next(k for k in (2, 3, 4) if m.group(k) is not None)
                    value = m.group(k)
                    if value not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[value] = guess_cost(value)
                    cost, kinds = known[value]
                    rows.append((doc, m.group(1).lower(), m.start(k), len(value), round(cost, 6), kinds, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:16], cost >= least))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds_of = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds_of)], names=[f.split()[0] for f in OUT.split(", ")])

    return run


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SECRET) -> DataFrame:
    """One row for every value in a credential context, with its guess cost; is_secret from least on.

    at and length: characters of the value in the text. The value itself isn't
    returned, only a fingerprint that is equal for equal values. Rows with a null
    id, null and empty texts give no rows; repeated rows each give theirs; texts
    of any length are searched to the end.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_scan(least), OUT)
