"""PII: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates are looked for by pattern, validated (Luhn and IBAN check digits, ranges of
addresses, social security and telephone numbers, calendar dates, shape of e-mail names), and mapped
by a permutation of all valid values of their format. Layout stays: separators, digit counts, check
digits that hold, date notation. The permutation depends on key and format alone, so equal values
get equal pseudonyms in every document, and different ones different pseudonyms; whoever has the key
can invert it.

Defined cases: null text stays null with no finds; empty text stays empty; texts are scanned whole;
each row, repeated or not, gives one row; a value that lies in an earlier find is not looked at; where
the longest reading is not valid, shorter ones of a card or IBAN that end on a group boundary are tried,
then the other kinds, then what begins behind its first character. An IBAN of its country's length with
wrong check digits is passed over as a whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "card", "ssn", "phone", "ipv4", "date")
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

FORMS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{form})" for kind, form in FORMS.items()))
ALONE = {kind: re.compile(form) for kind, form in FORMS.items()}
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    c: int(n)
    for n, own in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for c in own.split(",")
}


class Feistel:
    """Keyed permutation of 0..size-1: a balanced Feistel network on bits, walked until it is in range."""

    def __init__(self, key: bytes, label: str, size: int):
        if size < 1:
            raise ValueError("an empty domain")
        self.size = size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1
        self.hash = hashlib.blake2b(label.encode() + size.to_bytes(32, "little"), key=hashlib.blake2b(key).digest(), digest_size=(self.half + 7) // 8 + 8)

    def _f(self, i: int, half: int) -> int:
        h = self.hash.copy()
        h.update(bytes([i]) + half.to_bytes((self.half + 7) // 8, "little"))
        return int.from_bytes(h.digest(), "little") & self.mask

    def _once(self, x: int, rounds: range, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        for i in rounds:
            if back:
                left, right = right ^ self._f(i, left), left
            else:
                left, right = right, left ^ self._f(i, right)
        return left << self.half | right

    def apply(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """Where x goes; values that are not valid are walked past, so valid ones permute among themselves."""
        while True:
            x = self._once(x, range(ROUNDS), False)
            if x < self.size and valid(x):
                return x

    def invert(self, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        while True:
            x = self._once(x, range(ROUNDS - 1, -1, -1), True)
            if x < self.size and valid(x):
                return x


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[::-1]]
    return sum(odd[0::2] + [2 * d - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def _fill(layout: str, digits: str) -> str:
    """layout with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in layout)


def _ends(kind: str, value: str) -> list[int]:
    """Lengths of value to validate, in order: the whole and, of cards and IBANs, what ends on a group boundary."""
    ends = [len(value)]
    if kind == "card":
        ends += [m.start() for m in re.finditer(r"[ -]", value) if len(re.sub(r"\D", "", value[: m.start()])) > 12][::-1]
    elif kind == "iban":
        shorter = [m.start() for m in re.finditer(" ", value)][::-1]
        length = IBAN_LENGTHS.get(value[:2])
        if length is None:
            return ends + shorter
        # words behind must not change what an IBAN goes to, so its country's length is first
        return [e for e in shorter if len(value[:e].replace(" ", "")) == length] + ends
    return ends


def _readings(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """Kinds and ends of what may stand at the place of a match of PATTERN, the first valid one counts."""
    kinds = list(FORMS)
    for kind in kinds[kinds.index(m.lastgroup) :]:
        own = ALONE[kind].match(text, m.start())
        if own:
            for length in _ends(kind, own[0]):
                yield kind, m.start() + length


class Pseudonyms:
    """replace(kind, value): the pseudonym, or None if the value is not valid. back=True inverts."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back, self.known = key, back, {}

    def _move(self, label: str, size: int, x: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        if (label, size) not in self.known:
            self.known[label, size] = Feistel(self.key, label, size)
        own = self.known[label, size]
        return own.invert(x, valid) if self.back else own.apply(x, valid)

    def replace(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        # the check digit follows from the others
        middle = f"{self._move(f'card{len(digits)}{digits[0]}', 10**n, int(digits[1:-1]), lambda x: len(set(self._checked(digits[0] + f'{x:0{n}d}'))) > 1):0{n}d}"
        return _fill(value, self._checked(digits[0] + middle))

    @staticmethod
    def _checked(body: str) -> str:
        return next(body + c for c in "0123456789" if luhn(body + c))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        bases = [10 if c.isdigit() else 26 for c in plain[4:]]
        x = size = 0
        for c, b in zip(plain[4:], bases, strict=True):
            x = x * b + (int(c) if b == 10 else ord(c) - 65)
        size = 1
        for b in bases:
            size *= b
        x = self._move("iban" + plain[:2] + "".join("9" if b == 10 else "A" for b in bases), size, x)
        out = []
        for b in reversed(bases):
            x, r = divmod(x, b)
            out.append(str(r) if b == 10 else chr(65 + r))
        body = "".join(reversed(out))
        new = iter(plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _ssn(self, value: str) -> str | None:
        def valid(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return area not in (0, 666) and area < 900 and group > 0 and serial > 0

        x = int(value.replace("-", ""))
        return _fill(value, f"{self._move('ssn', 10**9, x, valid):09d}") if valid(x) else None

    def _phone(self, value: str) -> str | None:
        def valid(x: int) -> bool:
            return x // 10**9 > 1 and x // 10**6 % 10 > 1

        digits = re.sub(r"\D", "", value)
        head, x = digits[:-10], int(digits[-10:])
        # numbers outside the numbering plan move among themselves, so that none is left as it was
        plan = valid(x)
        return _fill(value, head + f"{self._move('phone' + head, 10**10, x, lambda y: valid(y) == plan):010d}")

    def _ipv4(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None

        def valid(x: int) -> bool:
            return x >> 24 not in (0, 127)

        x = sum(int(p) << 8 * (3 - i) for i, p in enumerate(parts))
        if not valid(x):
            return None
        x = self._move("ipv4", 1 << 32, x, valid)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, value: str) -> str | None:
        sep = next(c for c in value if not c.isdigit())
        a, b, c = value.split(sep)
        year_first = len(a) == 4
        if year_first:
            y, m, d = a, b, c
        elif sep == "/" and int(a) <= 12:
            y, m, d = c, a, b
        else:
            y, m, d = c, b, a
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        month_first = not year_first and sep == "/" and int(a) <= 12
        wide = len(m) == 2, len(d) == 2

        def same_notation(x: int) -> bool:
            new = datetime.date.fromordinal(FIRST_DAY + x)
            # the result must be read back by the same rule and with the same widths
            fits = (wide[0] or new.month < 10) and (wide[1] or new.day < 10)
            return fits and (month_first or year_first or sep != "/" or new.day > 12)

        label = f"date{sep}{year_first}{month_first}{wide}"
        new = datetime.date.fromordinal(FIRST_DAY + self._move(label, LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY, same_notation))
        month, day_ = f"{new.month:0{1 + wide[0]}d}", f"{new.day:0{1 + wide[1]}d}"
        parts = (f"{new.year:04d}", month, day_) if year_first else (month, day_, f"{new.year:04d}") if month_first else (day_, month, f"{new.year:04d}")
        return sep.join(parts)

    def _email(self, value: str) -> str | None:
        name, at, host = value.rpartition("@")
        if ".." in name or name[-1] == ".":
            return None
        bases = [10 if c.isdigit() else 26 if c.isalpha() else 0 for c in name]
        x, size = 0, 1
        for c, b in zip(name, bases, strict=True):
            if b:
                x, size = x * b + (int(c) if b == 10 else ord(c.lower()) - 97), size * b
        # one permutation for each shape of name at a host, whatever the case of letters
        x = self._move("email" + "".join("9" if b == 10 else "a" if b else c for b, c in zip(bases, name, strict=True)), size, x)
        out = []
        for c, b in reversed(list(zip(name, bases, strict=True))):
            if b:
                x, r = divmod(x, b)
                out.append(str(r) if b == 10 else chr((65 if c.isupper() else 97) + r))
            else:
                out.append(c)
        return "".join(reversed(out)) + at + host

    def text(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and the finds: kind, start, end in the text as it was."""
        out, found, at, look = [], [], 0, 0
        while m := PATTERN.search(text, look):
            look = m.start() + 1
            for kind, end in _readings(text, m):
                new = self.replace(kind, text[m.start() : end])
                if new is not None:
                    out += [text[at : m.start()], new]
                    at = look = end
                    found.append((kind, m.start(), end))
                    break
            else:
                if m.lastgroup == "iban" and len(m[0][: (end := _ends("iban", m[0])[0])].replace(" ", "")) == IBAN_LENGTHS.get(m[0][:2]):
                    # an IBAN with wrong check digits: its groups are not read as a card
                    look = m.start() + end
        return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_email .. n_date (long), spans (kind:start:end in the old text), for each row of docs."""
    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS) + ", spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for batch in batches:
            column = batch.column(1)
            texts, counts, spans = column.to_pylist(), {k: [0] * len(column) for k in KINDS}, [""] * len(column)
            for i in pc.indices_nonzero(pc.is_valid(column)).to_pylist():
                new, found = own.text(texts[i])
                if found:
                    texts[i] = new
                    spans[i] = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
                    for k, _, _ in found:
                        counts[k][i] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(spans)],
                names=["doc_id", "text", *[f"n_{k}" for k in KINDS], "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
