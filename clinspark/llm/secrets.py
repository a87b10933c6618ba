"""Secret scans: fixed patterns, and a guess-cost estimate of the values that stand in a credential context."""

import base64
import bisect
import itertools
import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "guess")
# Words one of which must occur before the slower patterns run on a text; all of them in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
# A credential word, at most a few characters of syntax, and a value without white space, quotes and closing brackets.
CONTEXT = re.compile(
    r"""(?ai)(?<![a-z0-9])(?:[a-z0-9_.-]{0,40}(?:password|passwd|passphrase|passcode|pwd|secret|token|api_?key|access_?key|private_?key|credentials?|auth_?key)|(?:authorization["']?\x20*[:=]\x20*["']?)?(?:bearer|basic))(?:["']?\x20*(?:[:=]|=>|:=)\x20*|\x20+is\x20+|\x20+)["']?([^\s"'<>(){}\[\],;]{8,})"""
)
CONTEXT_WORDS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "accesskey", "access_key", "privatekey", "private_key", "credential", "authkey", "auth_key", "bearer", "basic")
# Words that guessers try first, most frequent first (fixed values).
COMMON_WORDS = (
    "password", "qwerty", "welcome", "letmein", "admin", "login", "master", "dragon", "monkey", "football", "baseball", "sunshine",
    "princess", "shadow", "secret", "changeme", "default", "example", "test", "guest", "user", "root", "pass", "token", "access", "hello",
    "freedom", "whatever", "trustno", "iloveyou", "superman", "batman", "michael", "jordan", "hunter", "summer", "winter", "spring",
    "autumn", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday",
    "friday", "sunday", "love", "money", "computer", "internet", "server", "private", "public", "key", "api", "demo", "sample", "dummy",
    "placeholder", "your", "my", "here", "value", "string", "none", "null", "true", "false", "empty", "required", "enter", "new", "old",
    "temp", "temporary", "insert", "please", "the", "and", "for", "with", "this", "that", "from", "not",
)
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d)")
# A value that takes fewer than 10 ** THRESHOLD guesses is no secret.
THRESHOLD = 8.0


def _neighbours() -> dict[str, str]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            for dr, dc in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)):
                if 0 <= r + dr < len(KEY_ROWS) and 0 <= c + dc < len(KEY_ROWS[r + dr]):
                    near.setdefault(key, set()).add(KEY_ROWS[r + dr][c + dc])
    for alphabet in ALPHABETS:
        for a, b in zip(alphabet, alphabet[1:]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return {k: "".join(sorted(v)) for k, v in near.items()}


NEIGHBOURS = _neighbours()


def word_ranks(rank_file: bytes | None = None) -> dict[str, int]:
    """Rank of each word that guessers try: COMMON_WORDS, then the lower-case words of a tokenizer's rank file in its order."""
    tokens = (base64.b64decode(line.split()[0]).strip() for line in (rank_file or b"").splitlines() if line.strip())
    more = (t.decode() for t in tokens if re.fullmatch(rb"[a-z]{3,}", t))
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON_WORDS, *more]))}


# A value above LONG characters is first tried with repeats and walks of at most NEAR characters; if that is cheap, it is no secret.
LONG, NEAR = 400, 64


def guess_cost(value: str, words: dict[str, int] | None = None, enough: float = math.inf, near: int | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of `value` takes; 0 for the empty text.

    best[j] is the least cost of value[:j]; a last segment may be a word (its rank, with a factor for capitals and for
    substituted characters), a date, a unit repeated, a walk over neighbouring keys or along the alphabet, or one character
    of brute force at a cost of 10. A short step of log10(2) is charged for each segment but the first, for the guesser must also
    find where segments end.

    With `enough`, only whether the cost reaches it is exact: the search ends where every way on is sure to reach it. A segment that
    goes on past j starts at most a word, a date or the current walk before it, or has its first unit end no earlier than the current repeat
    began. With `near`, units and walks longer than that (but for the whole walk) are not tried, so the cost may be too high.
    """
    if len(value) > LONG and enough < math.inf and near is None:
        least = guess_cost(value, words, enough, NEAR)
        if least < enough:
            return least
    ranks = words if words is not None else word_ranks()
    longest_word = max(map(len, ranks), default=0)
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}
    for m in DATE.finditer(value):
        days = 365 * 100 if m.end() - m.start() > 4 else 119
        ends.setdefault(m.end(), []).append((m.start(), math.log10(days) + (math.log10(4) if not m.group().isdigit() else 0.0)))
    bends = [0, *itertools.accumulate((ord(low[k + 1]) - ord(low[k])) != (ord(low[k + 2]) - ord(low[k + 1])) for k in range(n - 2))]
    walk = 0
    same: list[int] = []  # same[u - 1]: for how many characters up to here each equals the one u before it
    step = math.log10(2)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + 1.0
        for size in range(3, min(longest_word, j) + 1):
            i = j - size
            for form, factor in ((low[i:j], 1), (plain[i:j], 2)):
                rank = ranks.get(form)
                if rank:
                    capitals = sum(c.isupper() for c in value[i:j])
                    factor *= 1 if not capitals else 2 if capitals in (1, size) else 4
                    best[j] = min(best[j], best[i] + math.log10(rank * factor + 1) + step * (i > 0))
        for i, cost in ends.get(j, ()):
            best[j] = min(best[j], best[i] + cost + step * (i > 0))
        walk = walk + 1 if j > 1 and low[j - 1] in NEIGHBOURS.get(low[j - 2], "") else 1
        sizes = range(3, walk + 1) if near is None or walk <= near else [*range(3, near + 1), walk]
        for size in sizes:
            i = j - size
            turns = bends[j - 2] - bends[i]
            best[j] = min(best[j], best[i] + math.log10(47 * size) + 0.5 * math.log10(turns + 1) * min(turns, 6) + step * (i > 0))
        most = j - 1 if near is None else min(j - 1, near)
        same += [0] * (most - len(same))
        c = value[j - 1]
        same = [same[u - 1] + 1 if value[j - 1 - u] == c else 0 for u in range(1, most + 1)]
        for unit, run in enumerate(same, 1):
            times = run // unit + 1
            if times >= 2 and unit * times >= 3:
                i = j - unit * times
                base = min(float(unit), best[j - unit * (times - 1)] - best[i])
                best[j] = min(best[j], best[i] + base + math.log10(times) + step * (i > 0))
        if best[j] >= enough:
            back = max(longest_word, 10, walk, max(same, default=0))
            least = min(best[max(0, j - back) : j + 1])
            if least >= enough:
                return least
    return best[n]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; kinds are numbered as in KINDS. `low` is the text in lower case."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def context_spans(
    text: str, low: str, base: Sequence[tuple[int, int, int]], threshold: float = THRESHOLD, words: dict[str, int] | None = None
) -> list[tuple[int, int, int]]:
    """Spans of values in a credential context whose guess cost reaches the threshold, unless one base span covers the whole value."""
    if not any(w in low for w in CONTEXT_WORDS):
        return []
    starts = [b[0] for b in base]
    reach = list(itertools.accumulate((b[2] for b in base), max))
    found = []
    for m in CONTEXT.finditer(text):
        start, value = m.start(1), m.group(1).rstrip(".:!?")
        end = start + len(value)
        k = bisect.bisect_right(starts, start)
        if len(value) < 8 or (k and reach[k - 1] >= end):
            continue
        if guess_cost(value, words, threshold) >= threshold:
            found.append((start, 3, end))
    return found


def scan(docs: DataFrame, threshold: float = THRESHOLD, text_column: str = "text", rank_file: bytes | None = None) -> DataFrame:
    """Spans of secrets in each document: doc_id, spans array<struct<kind, start, end>> by start, then kind.

    The fixed patterns give kinds assign, access and hex. Values behind credential words ("pwd is ...", "Bearer ...",
    values with characters that `assign` doesn't take) get kind guess if a guesser needs 10 ** threshold tries for the cheapest
    segmentation into words, dates, repeats, key walks and single characters. A value has no upper length. A lower-case word is prose where the guesser has it: `rank_file`, a
    tokenizer's ranks, adds its words to the built-in ones; without it, longer words of prose count as secrets.
    Offsets are code points, ends exclusive. Null texts count as empty and have no spans; texts are scanned whole;
    repeated rows stay; an empty table gives no rows; extra columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ranks(rank_file)
        for batch in stream:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                low = text.lower()
                base = base_spans(text, low)
                spans = sorted(base + context_spans(text, low, base, threshold, words))
                found.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    return source.mapInArrow(batches, "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>")
