"""Personal numbers, addresses and dates replaced by keyed pseudonyms of the same format."""

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "iban", "ip", "ssn", "date")
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})@((?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![A-Za-z0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
# One pass finds every run that may be a number or a date; what it is, validation says.
NUMBER = re.compile(r"(?<![\w.])\+?\(?\d(?:[\d ().:/+-]*\d)?(?!\w)")
# Blank-separated parts that one value has at most, and its characters.
PARTS, LONGEST = 6, 40
IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
SSN = re.compile(r"(\d{3})-(\d{2})-(\d{4})")
ISO_DATE = re.compile(r"((?:19|20)\d\d)([-/.])(\d\d)\2(\d\d)")
DAY_FIRST = re.compile(r"(\d\d?)([-/.])(\d\d?)\2((?:19|20)\d\d)")
# Addresses, social security numbers and dates are looked for first, with digit guards only where more may stand around
# them: a time of day, a port, a mask, the other end of a range.
FIXED = re.compile(
    r"(?<!\d)(?:(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d))|(?P<ssn>(?<![\w.])\d{3}-\d{2}-\d{4}(?!\w))"
    r"|(?P<iso>(?:19|20)\d\d([-/.])\d\d\4\d\d(?!\d))|(?P<day>\d\d?([-/.])\d\d?\6(?:19|20)\d\d(?!\d)))"
)
# What may stand before the end of an international number.
PLUS = re.compile(r"\+[2-9][\d ().-]{0,30}$")
NANP = re.compile(r"(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-]?)[2-9]\d\d[ .-]?\d{4}")
INTERNATIONAL = re.compile(r"\+[2-9]\d{0,2}(?:[ .()-]{0,2}\d){6,12}")
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


class Feistel:
    """Keyed permutations of the numbers below any size: balanced Feistel rounds, walked until the result is in range."""

    def __init__(self, key: bytes):
        self.key = key

    def permute(self, x: int, size: int, label: str, valid: Callable[[int], bool] = lambda y: True) -> int:
        """Image of x. `valid` must hold for x; the walk goes on until it holds, so valid numbers are permuted among themselves."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        wide = (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            for r in range(ROUNDS):
                data = f"{label}|{size}|{r}|".encode() + right.to_bytes(wide, "big")
                word = hashlib.blake2b(data, key=self.key, digest_size=max(8, wide)).digest()
                left, right = right, left ^ (int.from_bytes(word, "big") & mask)
            x = left << half | right
            if x < size and valid(x):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(text: str) -> int:
    """Rest of the account number (country and check digits moved to its end, letters as 10 to 35) modulo 97."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _put_digits(pattern: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Finds validated values in a text and replaces them; the same value and key give the same pseudonym everywhere."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def digits(self, digits: str, label: str, valid=lambda text: True) -> str:
        n = len(digits)
        y = self.feistel.permute(int(digits), 10**n, label, lambda v: valid(str(v).zfill(n)))
        return str(y).zfill(n)

    def email(self, m: re.Match) -> str:
        """Letters and digits of the local part change within their kind, case and places; the domain stays."""
        local = m[1]
        letters = [c for c in local if c.isalpha()]
        number = 0
        for c in letters:
            number = number * 26 + ord(c.lower()) - 97
        domain = m[2].lower()
        new = []
        if letters:
            y = self.feistel.permute(number, 26 ** len(letters), f"email {domain}")
            for _ in letters:
                y, d = divmod(y, 26)
                new.append(chr(97 + d))
        old_digits = "".join(c for c in local if c.isdigit())
        tweak = "".join(letters).lower()
        new_digits = iter(self.digits(old_digits, f"email digits {tweak}@{domain}") if old_digits else "")
        out = [
            (new.pop().upper() if c.isupper() else new.pop()) if c.isalpha() else next(new_digits) if c.isdigit() else c for c in local
        ]  # new is last letter first
        return "".join(out) + "@" + m[2]

    def card(self, text: str) -> str:
        """The digits but the first, permuted; the last one keeps the Luhn sum valid."""
        digits = "".join(c for c in text if c.isdigit())
        body = digits[0] + self.digits(digits[1:-1], f"card {digits[0]}")
        return _put_digits(text, next(body + str(d) for d in range(10) if luhn(body + str(d))))

    def iban(self, text: str) -> str:
        flat = text.replace(" ", "")
        old = "".join(c for c in flat[4:] if c.isdigit())
        left = iter(self.digits(old, f"iban {flat[:2]}"))
        body = "".join(next(left) if c.isdigit() else c for c in flat[4:])
        check = 98 - iban_rest(flat[:2] + "00" + body)
        new = iter(flat[:2] + str(check).zfill(2) + body)
        return "".join(c if c == " " else next(new) for c in text)

    def ip(self, text: str) -> str:
        number = 0
        for part in text.split("."):
            number = number << 8 | int(part)
        y = self.feistel.permute(number, 1 << 32, "ip")
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))

    def ssn(self, text: str) -> str:
        return _put_digits(text, self.digits(text.replace("-", ""), "ssn", valid_ssn))

    def phone(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        if NANP.fullmatch(text):
            return _put_digits(text, digits[:-10] + self.digits(digits[-10:], "nanp", lambda d: d[0] > "1" and d[3] > "1"))
        return _put_digits(text, digits[:2] + self.digits(digits[2:], f"phone {digits[:2]}"))

    def date(self, m: re.Match, year: int, month: int, day: int) -> str | None:
        """Another day between 1900 and 2099 in the same order and with the same separator; null if it isn't a date."""
        if not (1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
            return None
        x = datetime.date(year, month, day).toordinal() - FIRST_DAY
        new = datetime.date.fromordinal(FIRST_DAY + self.feistel.permute(x, DAYS, "date"))
        parts = (f"{new.year}", f"{new.month:02d}", f"{new.day:02d}")
        return m[2].join(parts if len(m[1]) == 4 else reversed(parts))

    def number(self, text: str) -> tuple[str, str] | None:
        """(kind, pseudonym) of a run of digits and separators; null if it validates as nothing."""
        digits = "".join(c for c in text if c.isdigit())
        if IP.fullmatch(text):
            return ("ip", self.ip(text)) if all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split(".")) else None
        if SSN.fullmatch(text):
            return ("ssn", self.ssn(text)) if valid_ssn(digits) else None
        if m := ISO_DATE.fullmatch(text):
            new = self.date(m, int(m[1]), int(m[3]), int(m[4]))
            return ("date", new) if new else None
        if m := DAY_FIRST.fullmatch(text):
            new = self.date(m, int(m[4]), int(m[3]), int(m[1])) or self.date(m, int(m[4]), int(m[1]), int(m[3]))
            return ("date", new) if new else None
        if NANP.fullmatch(text) and (len(digits) > len(text) - 1) is False or INTERNATIONAL.fullmatch(text):
            return "phone", self.phone(text)
        if 13 <= len(digits) <= 19 and digits[0] != "0" and luhn(digits) and re.fullmatch(r"\d+(?:[ -]\d+)*", text):
            return "card", self.card(text)
        return None

    def fixed(self, text: str, m: re.Match, done: int) -> tuple[str, str] | None:
        """(kind, pseudonym) of a match of FIXED; null if it doesn't validate or is a piece of something longer.

        `done` is the end of the value before. The same separator and more digits on a side make a date or social security number a
        piece of a longer number, unless another value stands there.
        """
        start, end = m.span()
        if m["ip"] is None:
            separator = "-" if m["ssn"] else m[4] or m[6]
            before, after = text[max(start - 2, 0) : start], text[end : end + 2]
            if len(before) == 2 and before[1] == separator and before[0].isdigit() and done != start - 1:
                return None
            if len(after) == 2 and after[0] == separator and after[1].isdigit():
                next_one = FIXED.match(text, end + 1)
                if not next_one or not self.number(next_one[0]):
                    return None
            phone = PLUS.search(text[max(start - 32, done) : start])
            if phone and INTERNATIONAL.fullmatch(phone[0] + m[0]):
                return None
            around = text[max(start - 400, 0) : end + 400]
            if "@" in around and any(e.start() <= start < e.end() for e in EMAIL.finditer(text, max(start - 400, 0), end + 400)):
                return None
        return self.number(m[0])

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        def put(kind, new):
            counts[kind] += 1
            return new

        if "@" in text:
            text = EMAIL.sub(lambda m: put("email", self.email(m)) if any(c.isalnum() for c in m[1]) else m[0], text)
        text = IBAN.sub(lambda m: put("iban", self.iban(m[0])) if iban_valid(m[0]) else m[0], text)

        def numbers(m):
            # Several values may stand in one run: from each part on, the longest row of parts that validates is replaced.
            parts = re.split(r"( +)", m[0])
            out, i = [], 0
            while i < len(parts):
                for j in range(min(i + 2 * PARTS - 1, len(parts) - (len(parts) - i + 1) % 2), i, -2):
                    whole = "".join(parts[i:j])
                    core = whole.lstrip("(") if ")" not in whole else whole
                    found = self.number(core) if len(core) <= LONGEST else None
                    if found:
                        out.append(whole[: len(whole) - len(core)] + put(*found))
                        i = j
                        break
                else:
                    out.append(parts[i])
                    i += 1
                if i < len(parts) and i % 2:
                    out.append(parts[i])
                    i += 1
            return "".join(out)

        out, done = [], 0
        for m in FIXED.finditer(text):
            new = self.fixed(text, m, done)
            if new:
                out += [NUMBER.sub(numbers, text[done : m.start()]), put(*new)]
                done = m.end()
        return "".join([*out, NUMBER.sub(numbers, text[done:])]), counts


def valid_ssn(digits: str) -> bool:
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


def iban_valid(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and any(c.isdigit() for c in flat[4:]) and iban_rest(flat) == 1


def pseudonymise(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """Texts with e-mail addresses, phone, card, account and social security numbers, IPv4 addresses and dates replaced.

    Returns doc_id, text and one count per kind (n_email ...). A value is replaced only if it validates (Luhn, modulo 97, calendar,
    ranges), dates also in time stamps and ranges, addresses also with a port or mask; its pseudonym comes from a keyed Feistel permutation of the values of its format, validates in the same way and is the same
    for equal values in all documents, whatever their separators (dates: per order and separator). Null texts stay null
    with counts 0; empty and clean texts stay as they are; texts are read whole; repeated rows stay; extra columns aren't read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id bigint, text string, " + ", ".join(f"n_{k} int" for k in KINDS)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in stream:
            texts, counts = [], {k: [] for k in KINDS}
            for value in batch.column(1):
                new, n = names.replace(value.as_py() or "")
                texts.append(new if value.is_valid else None)
                for k in KINDS:
                    counts[k].append(n[k])
            arrays = [batch.column(0), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int32()) for k in KINDS]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    return source.mapInArrow(batches, schema)
