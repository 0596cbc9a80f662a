"""Format-preserving pseudonyms: a keyed Feistel permutation inside the format of each value.

Values are found by pattern and then validated (card numbers by their check digit, account numbers by remainder, addresses
by range, dates by the calendar). The free characters of a value are a number in mixed radix; a Feistel network over
that range, walked until the result is valid again, permutes it under a key. Length, separators, letter case and check
digits stay right, equal values get equal pseudonyms in every document, and whoever has the key can reverse them.

Numbers: payment cards, phone numbers, account numbers (IBAN), social security numbers, network addresses. Dates:
year-month-day and day or month first with a four-digit year. Names in mail addresses and tokens of secrets are permuted
letter by letter within their class. What doesn't validate stays as it is.

Where a match doesn't validate, or more numbers stand next to it, all readings of the run of numbers count: every kind at
every start, up to every end where its pattern could end. Those that validate and don't overlap are chosen so that first
the digits of certain kinds (all but phone numbers and cards in unusual groups), then those of phone numbers and cards
with one separator, then all digits covered are as many as possible. A phone number isn't read inside an account number or a card in usual groups whose check fails.

Null text stays null; empty text stays empty; texts of any length are taken whole, matches never overlap (mail and secret
first, then the leftmost). Repeated rows get the same text. All other columns pass through, whatever their names.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import textarrays

ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # to the end of 2099
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = frozenset("0123456789abcdef")

#: Kind and pattern; a mark with `keep` groups: what stands in them stays.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("mail", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}\b|(?:password|token|secret|api_key)\s{0,4}[=:]\s{0,4}[\"']?[A-Za-z0-9]{12,64})"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("address", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    ("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"),
)

#: What numbers and account numbers next to each other are made of; where a reading may begin and end; the longest reading.
RUN = re.compile(r"[0-9A-Z ()+./-]+")
STARTS = re.compile(r"(?=(?<![0-9])[0-9]|[+(]|\b[A-Z]{2}[0-9]{2})")
ENDS = re.compile(r"(?<=[0-9A-Z])(?![0-9A-Z])|(?<=[0-9])(?=[A-Z])")
LONGEST = 48
#: Kinds with characters outside of runs; they always validate. No longer than MARGIN.
WORDY, MARGIN = ("mail", "secret"), 800
DIGIT, CLOSE = re.compile("[0-9]"), re.compile("[0-9A-Za-z@_%+-]")
#: Cards in usual groups.
USUAL_CARD = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1){2,3}[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}")


def check_digit(body: str) -> int:
    """Luhn's digit that belongs after a number."""
    total = 0
    for i, d in enumerate(reversed(body)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


class Permuter:
    """Keyed permutations of ranges, by an unbalanced Feistel network and cycle walking."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, value: int, size: int) -> int:
        message = f"{tweak}|{i}|{size}|{value}".encode()
        return int.from_bytes(hmac.new(self.key, message, hashlib.sha256).digest(), "big") % size

    def _network(self, tweak: str, a: int, b: int, value: int, back: bool) -> int:
        left, right = divmod(value, b)  # left below a, right below b
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._round(tweak, i, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, i, right, a)) % a
        return left * b + right

    def permute(self, tweak: str, size: int, value: int, back: bool = False) -> int:
        """A one-to-one image of value in range(size)."""
        if size < 2:
            return value
        a = max(2, int(size**0.5))
        b = -(-size // a)
        value = self._network(tweak, a, b, value, back)
        while value >= size:  # a x b is a little more than size
            value = self._network(tweak, a, b, value, back)
        return value

    def text(self, tweak: str, value: str, valid: Callable[[str], bool] = lambda v: True, back: bool = False) -> str:
        """Permute letters and digits within their class; other characters stay. Walks on until the result is valid."""
        classes = [next((c for c in (LOWER, UPPER, DIGITS) if ch in c), None) for ch in value]
        size = 1
        for c in classes:
            size *= len(c) if c else 1
        shape = tweak + "|" + "".join("a" if c is LOWER else "A" if c is UPPER else "0" if c else ch for c, ch in zip(classes, value, strict=True))
        number = 0
        for c, ch in zip(classes, value, strict=True):
            number = number * len(c) + c.index(ch) if c else number
        while True:
            number = self.permute(shape, size, number, back)
            out, rest = [], number
            for c, ch in zip(reversed(classes), reversed(value), strict=True):
                if c:
                    rest, i = divmod(rest, len(c))
                    out.append(c[i])
                else:
                    out.append(ch)
            result = "".join(reversed(out))
            if valid(result):
                return result


def _spread(shape: str, characters: str) -> str:
    """Characters put back in the places of letters and digits of a shape."""
    rest = iter(characters)
    return "".join(next(rest) if ch.isalnum() else ch for ch in shape)


class Pseudonymiser:
    def __init__(self, key: bytes, patterns: tuple[tuple[str, str], ...] = PATTERNS):
        self.permuter = Permuter(key)
        shifted, groups = [], 0
        for kind, pattern in patterns:  # back references count from the pattern's own groups
            own = re.compile(pattern).groups
            moved = re.sub(r"\\([1-9])", lambda m, g=groups: f"\\{int(m[1]) + g + 1}", pattern)
            shifted.append(f"(?P<{kind}>{moved})")
            groups += own + 1
        self.pattern = re.compile("|".join(shifted))
        self.kinds = [kind for kind, _ in patterns]
        alone = {kind: re.compile(pattern) for kind, pattern in patterns}
        tails = {kind: re.search(r"(?:\(\?![^()]*\)|\\b)?$", pattern)[0] for kind, pattern in patterns}  # a reading cut short must hold them too
        self.readings = [(kind, alone[kind], re.compile(tails[kind])) for kind in self.kinds if kind not in WORDY]
        self.wordy = re.compile("|".join(f"(?P<{kind}>{alone[kind].pattern})" for kind in self.kinds if kind in WORDY) or r"(?!)")
        self.of = functools.lru_cache(100_000)(self.value)

    def value(self, kind: str, value: str, back: bool = False) -> str | None:
        """The pseudonym, or None where the value isn't valid."""
        return getattr(self, f"_{kind}")(value, back)

    def _mail(self, value: str, back: bool) -> str:
        name, _, domain = value.partition("@")
        return self.permuter.text("mail", name, back=back) + "@" + domain

    def _secret(self, value: str, back: bool) -> str | None:
        lead = re.match(r"AKIA|\w+\s*[=:]\s*[\"']?", value)[0]
        body = value[len(lead) :]
        if HEX.issuperset(body):
            changed = f"{self.permuter.permute(f'hex{len(body)}', 16 ** len(body), int(body, 16), back):0{len(body)}x}"
        else:
            changed = self.permuter.text("secret", body, back=back)
        return lead + changed

    def _iban(self, value: str, back: bool) -> str | None:
        plain = value.replace(" ", "")
        as_number = lambda text: int("".join(str(int(c, 36)) for c in text))
        if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        body = self.permuter.text("iban" + plain[:2], plain[4:], back=back)
        check = 98 - as_number(body + plain[:2] + "00") % 97
        return _spread(value, f"{plain[:2]}{check:02d}{body}")

    def _address(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        number = int.from_bytes(bytes(map(int, parts)), "big")
        return ".".join(map(str, self.permuter.permute("address", 1 << 32, number, back).to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        mark = next(c for c in value if not c.isdigit())
        parts = value.split(mark)
        widths = [len(p) for p in parts]
        year_first = widths[0] == 4
        orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]
        for style, (y, m, d) in enumerate(orders):
            try:
                day = datetime.date(int(parts[y]), int(parts[m]), int(parts[d])).toordinal() - FIRST_DAY
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                return None
            padded = widths[m] == 2 and widths[d] == 2
            while True:
                day = self.permuter.permute(f"date{style}{mark}{year_first}{widths}", DAYS, day, back)
                new = datetime.date.fromordinal(day + FIRST_DAY)
                out = [""] * 3
                out[y], out[m], out[d] = f"{new.year}", f"{new.month:02d}" if padded else str(new.month), f"{new.day:02d}" if padded else str(new.day)
                first_reading = style == 0 or new.day > 12  # else it would read as the other order
                if [len(p) for p in out] == widths and first_reading:
                    return mark.join(out)
        return None

    def _card(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if check_digit(digits[:-1]) != int(digits[-1]):
            return None
        body = self.permuter.text("card", digits[:-1], back=back)
        return _spread(value, body + str(check_digit(body)))

    def _social(self, value: str, back: bool) -> str | None:
        valid = lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"
        return self.permuter.text("social", value, valid, back) if valid(value) else None

    def _phone(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not 7 <= len(digits) <= 15:
            return None
        lead = re.match(r"\+[0-9]{1,3}[ .-]?", value)
        start = len(lead[0]) if lead else 0
        return value[:start] + self.permuter.text("phone", value[start:], back=back)

    def candidates(self, text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
        """All valid readings (start, end, kind, pseudonym) that begin in a run, by start, kind and falling length."""
        found, failed = [], []
        ends = [m.start() for m in ENDS.finditer(text, start, end)]
        if not ends or ends[-1] != end:
            ends.append(end)
        for s in (m.start() for m in STARTS.finditer(text, start, end)):
            near = ends[bisect.bisect_right(ends, s) : bisect.bisect_right(ends, s + LONGEST)]
            for kind, pattern, tail in self.readings:
                if not pattern.match(text, s):
                    continue
                formed = [e for e in reversed(near) if tail.match(text, e) and pattern.fullmatch(text, s, e)]
                valid = [(s, e, kind, new) for e in formed if (new := self.of(kind, text[s:e])) is not None]
                found += valid
                if not valid:
                    usual = [e for e in formed if kind == "iban" or (kind == "card" and USUAL_CARD.fullmatch(text, s, e))]
                    failed += [(s, max(usual))] if usual else []
        inside = lambda s, e: any(a <= s and e <= b for a, b in near_failed(s))
        begins = [a for a, _ in failed]
        near_failed = lambda s: failed[bisect.bisect_left(begins, s - LONGEST) : bisect.bisect_right(begins, s)]
        found = [c for c in found if c[2] != "phone" or not inside(c[0], c[1])]
        at = start
        while at < end and (m := self.wordy.search(text, at, min(len(text), end + MARGIN))) and m.start() < end:
            found.append((m.start(), m.end(), m.lastgroup, self.of(m.lastgroup, m[0])))
            at = m.end()
        rank = {kind: i for i, kind in enumerate(self.kinds)}
        return sorted(found, key=lambda c: (c[0], rank[c[2]], -c[1]))

    @staticmethod
    def worth(text: str, start: int, end: int, kind: str) -> tuple[int, int, int, int]:
        """Digits and letters of a reading: of mail or secret, of a certain kind, of anything but a card with blanks and hyphens, of all."""
        n = sum(map(str.isalnum, text[start:end]))
        certain = kind != "phone" and (kind != "card" or USUAL_CARD.fullmatch(text, start, end) is not None)
        mixed = kind == "card" and " " in text[start:end] and "-" in text[start:end]
        return n * (kind in WORDY), n * certain, n * (not mixed), n

    def chosen(self, text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
        """The readings of a run that are worth most together; of equal ones the earlier."""
        found = self.candidates(text, start, end)
        begins = [c[0] for c in found]
        best, take = [(0, 0, 0, 0)] * (len(found) + 1), [None] * len(found)
        for i in range(len(found) - 1, -1, -1):  # best[i]: of the readings from the i-th on
            s, e, kind, _ = found[i]
            after = bisect.bisect_left(begins, e, i + 1)
            total = tuple(map(int.__add__, self.worth(text, s, e, kind), best[after]))
            best[i], take[i] = (total, after) if total >= best[i + 1] else (best[i + 1], None)
        out, i = [], 0
        while i < len(found):
            if take[i] is not None:
                out.append(found[i])
            i = take[i] if take[i] is not None else i + 1
        return out

    def text(self, text: str) -> tuple[str, int]:
        """The text with pseudonyms, and how many."""
        out, count, at, done = [], 0, 0, 0
        while m := self.pattern.search(text, at):
            kind, (start, end) = m.lastgroup, m.span()
            new = self.of(kind, m[0])
            if kind in WORDY:
                spans, at = [(start, end, kind, new)], end
            else:
                run = RUN.match(text, start).end()
                if new is not None and (kind != "card" or USUAL_CARD.fullmatch(m[0])) and not DIGIT.search(text, end, run) and not CLOSE.match(text, end):
                    spans, at = [(start, end, kind, new)], end
                else:
                    spans = self.chosen(text, start, run)
                    at = max(run, spans[-1][1] if spans else 0)
            for s, e, _, value in spans:
                out += [text[done:s], value]
                done = e
            count += len(spans)
        return "".join([*out, text[done:]]), count


@functools.lru_cache(4)
def _pseudonymiser(key: bytes) -> Pseudonymiser:
    return Pseudonymiser(key)


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns, with pseudonyms in the text; count_col: name of a further column with their number, in place of one that is
    already called so."""
    docs = docs.drop(count_col) if count_col and count_col != text_col else docs
    at = docs.columns.index(text_col)

    def work(batch: pa.RecordBatch, _: list[str]) -> pa.RecordBatch:
        worker = _pseudonymiser(key)
        done = [(None, 0) if t is None else worker.text(t) for t in batch.column(at).to_pylist()]
        columns = list(batch.columns)
        columns[at] = pa.array([t for t, _ in done], pa.string())
        columns += [pa.array([n for _, n in done], pa.int64())] if count_col else []
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "a0"][: len(columns)])

    return textarrays.map_rows(docs, work, text_col, {count_col: "long"} if count_col else None)
