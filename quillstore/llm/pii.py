"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

Each kind of value is a set of equally formed values; a keyed Feistel network with cycle walking permutes that set. So
a value keeps its format and validity, equal values get equal pseudonyms in every document, and the key reverses them.

  card     13 to 19 digits, bare or in groups, that pass the Luhn check: digits permuted, check digit set anew. Of a run
           of groups, cards in the usual groupings first, then the leftmost and longest stretch of whole groups
  phone    North American numbers in the usual groupings or bare, with 1 or without: the ten digits permuted, numbers
           that can be dialled among themselves; + and another country's code: the digits after the code permuted;
           French, German and Spanish national numbers in groups: the digits after the leading 0 or first digit permuted
  iban     account numbers that pass the mod-97 check, bare or in groups: letters and digits permuted within their
           classes, check digits set anew
  ssn      three, two and four digits with hyphens, of a range that is issued: permuted among such numbers
  ipv4     four numbers up to 255: the 32 bits permuted
  ipv6     eight groups, or fewer with ::, of hexadecimal digits: the 128 bits permuted
  date     ISO, d/m/y, d.m.y and written dates (English, French, German, Spanish month names) of the calendar, 1900 to
           2099: the day permuted
  email    local part: its letters and digits permuted within their classes; the domain's likewise, the last label kept
  secret   32 to 128 hexadecimal digits soon after key, token, secret or password: digits permuted

Numbers that fail their check stay as they are. Null text stays null; empty text stays empty; empty input gives no rows; a
value is replaced wherever it is repeated, in repeated rows alike; texts are scanned whole, very long ones too. Of kinds
that match at one place, the first of the pattern's order counts; of places, the leftmost. With counts, columns of the input
that have a count's name are replaced; others are kept.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("card", "phone", "ipv4", "date", "email", "secret", "iban", "ssn", "ipv6")

# Names of the months.
MONTHS = (
    "January February March April May June July August September October November December".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)
_MONTH = "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m)))

_OTHERS = (
    r"(?P<iban>(?<!\w)[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-]))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))"
    r"|(?P<email>(?<![\w.+%-])[A-Za-z0-9][\w.+%-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})"
    r"|(?P<secret>(?i:key|token|secret|password|passwd|pwd)\W{1,12}(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z]))"
    r"|(?P<phone>(?<![\w+])(?:\+?1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    r"|\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
    r"|(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\w|[.-]\d)"
    r"|(?<![.,-])1?[2-9]\d\d[2-9]\d{6}(?!\w|[.,-]\d)"
    r"|(?<![.,-])0[1-9](?:(?: \d\d){4}|(?:\.\d\d){4}|(?:-\d\d){4})(?!\w|[.,-]\d)|(?<![.,-])0(?:[2-9]\d{1,3}|1[5-7]\d{1,2})[/ -]\d{3,4}(?:[ -]?\d{3,4})(?!\w|[./,-]\d)|(?<![.,-])[6-9]\d\d \d{3} \d{3}(?!\w| \d|[.,-]\d)"
    r"|\+[2-9]\d{0,2}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){5,13}(?!\w)))"
    r"|(?P<date>(?<![\w.-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d?/\d\d?/(?:19|20)\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d"
    rf"|\d\d?(?:\.|st|nd|rd|th)?(?: de)? (?:{_MONTH})(?: de|,)? (?:19|20)\d\d|(?:{_MONTH}) \d\d?,? (?:19|20)\d\d)(?![\w/]|-\d|\.\d))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
)
_OTHER = re.compile(_OTHERS, re.ASCII)
#: A card's match is a whole run of groups, of any length.
_CARD = r"|(?P<card>(?<![\w+])\d(?:[ -]?\d){12,}(?!\w))"
_FIND = re.compile(_OTHERS + _CARD, re.ASCII)
#: The same without the kinds that need a check before they count.
_UNCHECKED = re.compile(_OTHERS[_OTHERS.index("|(?P<ipv6>") + 1 :] + _CARD, re.ASCII)
_USUAL = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), *((n,) for n in range(13, 20))}
#: Country codes of one or two digits; the others have three.
_CODES = {"7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n): unbalanced Feistel rounds on a pair (a, b) with a * b >= n, walked until below n."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds

    def _round(self, i: int, tweak: str, n: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, f"{tweak}|{n}|{i}|{x}".encode(), hashlib.sha256), "big")

    def _halves(self, n: int) -> tuple[int, int]:
        a = 1
        while a * a < n:
            a *= 2
        return a, -(-n // a)

    def encrypt(self, x: int, n: int, tweak: str = "") -> int:
        a, b = self._halves(n)
        while True:
            left, right = x % a, x // a
            for i in range(self.rounds):  # even rounds change the left half, odd ones the right
                if i % 2 == 0:
                    left = (left + self._round(i, tweak, n, right)) % a
                else:
                    right = (right + self._round(i, tweak, n, left)) % b
            x = right * a + left
            if x < n:
                return x

    def decrypt(self, x: int, n: int, tweak: str = "") -> int:
        a, b = self._halves(n)
        while True:
            left, right = x % a, x // a
            for i in reversed(range(self.rounds)):
                if i % 2 == 0:
                    left = (left - self._round(i, tweak, n, right)) % a
                else:
                    right = (right - self._round(i, tweak, n, left)) % b
            x = right * a + left
            if x < n:
                return x


def luhn(digits: str) -> int:
    """0 if the check digit is right."""
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _issued(ssn: str) -> bool:
    return ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn[3:5] != "00" and ssn[5:] != "0000"


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


class Pseudonyms:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS):
        self.feistel, self.kinds, self.known = Feistel(key), frozenset(kinds), {}

    def _digits(self, text: str, digits: str, tweak: str, base: int = 10) -> str:
        """text with its digits replaced by the permuted ones."""
        n = self.feistel.encrypt(int(digits, base), base ** len(digits), tweak)
        new, out = [], []
        for _ in digits:
            n, d = divmod(n, base)
            new.append("0123456789abcdef"[d])
        for c in text:
            out.append(new.pop() if c.isalnum() else c)
        return "".join(out)

    def _by_class(self, text: str, tweak: str) -> str:
        """text with the letters and digits permuted together, each within its class."""
        kinds = [next((k for k in _CLASSES if c in k), "") for c in text]
        n, total = 0, 1
        for c, k in zip(text, kinds):
            if k:
                n, total = n * len(k) + k.index(c), total * len(k)
        n, out = self.feistel.encrypt(n, total, tweak + "".join(k[:1] for k in kinds)), []
        for c, k in zip(reversed(text), reversed(kinds)):
            if k:
                n, d = divmod(n, len(k))
                c = k[d]
            out.append(c)
        return "".join(reversed(out))

    def card(self, s: str) -> str:
        digits = re.sub(r"\D", "", s)
        if luhn(digits):
            return s
        body = self._digits(digits[:-1], digits[:-1], "card")
        new = iter(body + str(-luhn(body + "0") % 10))
        return "".join(next(new) if c.isdigit() else c for c in s)

    def phone(self, s: str) -> str:
        digits = re.sub(r"\D", "", s)
        if s[0] != "+" and (s[0] == "0" or len(digits) == 9):  # a national number
            new = iter(digits[0] + self._permuted(digits[1:], "phone0"))
            return "".join(next(new) if c.isdigit() else c for c in s)
        if s[0] != "+" or digits[0] == "1":
            number, n = digits[-10:], 10
            dialled = lambda x: x[0] > "1" and x[3] > "1"
            new = self._permuted(number, "phone")
            while dialled(new) != dialled(number):  # walk on within the class
                new = self._permuted(new, "phone")
        else:
            code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3])
            if not 8 <= len(digits) <= 15:
                return s
            n = len(digits) - len(code)
            new = self._permuted(digits[-n:], "phone" + code)
        new = iter(digits[: len(digits) - n] + new)
        return "".join(next(new) if c.isdigit() else c for c in s)

    def _permuted(self, digits: str, tweak: str) -> str:
        return self._digits(digits, digits, tweak)

    def ipv4(self, s: str) -> str:
        parts = [int(x) for x in s.split(".")]
        if max(parts) > 255:
            return s
        n = self.feistel.encrypt(int.from_bytes(bytes(parts), "big"), 2**32, "ipv4")
        return ".".join(str(b) for b in n.to_bytes(4, "big"))

    def iban(self, s: str) -> str:
        bare = s.replace(" ", "")
        body = self._by_class(bare[4:], "iban" + bare[:2])
        new = iter(f"{bare[:2]}{98 - _mod97(bare[:2] + '00' + body):02}{body}")
        return "".join(" " if c == " " else next(new) for c in s)

    def ssn(self, s: str) -> str:
        new = s.replace("-", "")
        while True:  # walk on among the numbers that are issued
            new = self._permuted(new, "ssn")
            if _issued(new):
                return f"{new[:3]}-{new[3:5]}-{new[5:]}"

    def ipv6(self, s: str) -> str:
        try:
            old = ipaddress.IPv6Address(s)
        except ValueError:
            return s
        new = f"{self.feistel.encrypt(int(old), 2**128, 'ipv6'):032x}"
        groups = [new[i : i + 4].lstrip("0") or "0" for i in range(0, 32, 4)]
        return ":".join(g.upper() if s.upper() == s else g for g in groups)

    def date(self, s: str) -> str:
        numbers = re.findall(r"\d+", s)
        names = next((m for m in MONTHS if any(re.search(rf"(?<!\w){x}(?!\w)", s) for x in m)), None)
        if names and "de" in s.split() and "enero" not in names:  # a name that languages share
            names = MONTHS[3]
        try:
            if names:
                d, m, y = int(numbers[0]), 1 + next(i for i, x in enumerate(names) if re.search(rf"(?<!\w){x}(?!\w)", s)), int(numbers[1])
            else:
                d, m, y = map(int, reversed(numbers) if "-" in s else numbers)
            day = datetime.date(y, m, d)
        except ValueError:
            return s
        new = datetime.date.fromordinal(_FIRST + self.feistel.encrypt(day.toordinal() - _FIRST, _LAST - _FIRST + 1, "date"))
        if names:
            values = iter((str(new.day), str(new.year)))
            return re.sub(r"\d+", lambda _: next(values), s.replace(names[m - 1], names[new.month - 1]))
        if "-" in s:
            return new.isoformat()
        return f"{new.day:02}{s[len(numbers[0])]}{new.month:02}{s[len(numbers[0])]}{new.year}"

    def email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        *labels, last = domain.split(".")
        return f"{self._by_class(local, 'local')}@{'.'.join(self._by_class(x, 'label') for x in labels)}.{last}"

    def secret(self, s: str) -> str:
        digits = re.search(r"[0-9a-fA-F]+$", s.rstrip("\"'"))[0]
        new = self._digits(digits, digits, "secret", 16)
        return s[: len(s) - len(digits)] + (new.upper() if digits.upper() == digits else new)

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)

        def new(kind: str, value: str) -> str:
            if kind not in self.kinds:
                return value
            if (kind, value) not in self.known:
                if len(self.known) > 100_000:
                    self.known.clear()
                self.known[kind, value] = getattr(self, kind)(value)
            out = self.known[kind, value]
            counts[kind] += out != value
            return out

        out, done = [], 0
        for kind, a, b in _found(text):
            out += [text[done:a], new(kind, text[a:b])]
            done = b
        return "".join([*out, text[done:]]), counts


def _found(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the values in a text, in order."""
    at = 0
    while m := _FIND.search(text, at):
        if m.lastgroup == "iban" and _mod97(m[0].replace(" ", "")) != 1 or m.lastgroup == "ssn" and not _issued(m[0].replace("-", "")):
            other = _UNCHECKED.search(text, m.start())  # it may hold a value of another kind
            if not other or other.start() >= m.end():
                at = m.end()
                continue
            m = other
        if m.lastgroup != "card":
            yield m.lastgroup, m.start(), m.end()
            at = m.end()
            continue
        at = m.start()
        for a, b in [*_cards(text, m.start(), m.end()), (m.end(), m.end())]:
            while at < a and (o := _OTHER.search(text, at)) and o.start() < a:
                if o.end() > a and b > a:  # a card goes before what it cuts
                    break
                yield o.lastgroup, o.start(), o.end()
                at = o.end()
            if b > a:
                yield "card", a, b
            at = max(at, b)


def _cards(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Stretches of whole groups in a run that are card numbers, in order, none in another."""
    groups = [g.span() for g in re.compile(r"\d+").finditer(text, start, end)]
    free, out = [True] * len(groups), []

    def take(usual: bool) -> None:
        for i in range(len(groups)):
            size, best = 0, None
            for j in range(i, len(groups)):
                size += groups[j][1] - groups[j][0]
                if not free[j] or size > 19:
                    break
                shape = tuple(b - a for a, b in groups[i : j + 1]) if usual and j < i + 4 else None
                if size >= 13 and (not usual or shape in _USUAL) and not luhn(re.sub(r"\D", "", text[groups[i][0] : groups[j][1]])):
                    best = j
            if best is not None:
                free[i : best + 1] = [False] * (best + 1 - i)
                out.append((groups[i][0], groups[best][1]))

    take(True)
    take(False)
    return sorted(out)


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", kinds: tuple[str, ...] = KINDS, counts: bool = False) -> DataFrame:
    """docs with personal data in `text` replaced; with counts, also pii_<kind> columns."""
    more = [f"pii_{k}" for k in KINDS] if counts else []
    docs = docs.select(*[docs[c] for c in docs.columns if c not in more])
    names = docs.columns
    at = names.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = Pseudonyms(key, kinds)
        for b in batches:
            found = [(None, {}) if (t := x.as_py()) is None else change(t) for x in b.column(at)]
            columns = b.columns
            columns[at] = pa.array([t for t, _ in found], pa.string())
            columns += [pa.array([c.get(k, 0) for _, c in found], pa.int64()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays(columns, [*names, *more])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in more])
    return docs.mapInArrow(each, schema)


def pseudonymise_documents(docs: DataFrame, key: bytes, **options) -> DataFrame:
    """pseudonymise, with n_chars set anew where there is one."""
    out = pseudonymise(docs, key, **options)
    text = options.get("text", "text")
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
