"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by pattern and validated (check digits, ranges, calendar).
Each is put into a domain of the form Z_a x Z_b that holds just the valid
values of its format, permuted there by a keyed Feistel network, and written
back in the same format. A network of this kind is a bijection for any a and
b, so equal values get equal pseudonyms wherever they occur, different values
different ones, and the key's owner can turn them back.

No rows move: each text is cut where a candidate starts, and only these are
judged. A candidate that fails its check hides nothing: those that start
inside it are judged, too.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "phone", "card", "ip", "date", "ssn", "iban")

_L, _R = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Countries by the length of their IBANs (the registry, and the countries that issue them without it).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """One alternative a length; a country that isn't listed has any length."""
    def body(n: int) -> str:
        return rf"\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")

    listed = "|".join(x for names in IBAN_LENGTHS.values() for x in names.split())
    known = "|".join(f"(?:{'|'.join(names.split())}){body(n)}" for n, names in IBAN_LENGTHS.items())
    return rf"{_L}(?:{known}|(?!{listed})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?){_R}"


#: Pattern of each kind as a whole match; the order decides where two could match at one place. A domain name has 127
#: parts at most (more do not fit into its 253 characters); each takes a level of the matcher's stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.){1,127}[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "date": r"(?<![0-9A-Za-z./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![0-9A-Za-z/-])",
    "ssn": r"(?<![0-9A-Za-z-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": rf"(?:{_L}\+\d{{1,3}}[ .-]?)?(?:\(\d{{3}}\) ?|(?<![0-9A-Za-z])\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_R}",
    "iban": _iban_pattern(),
    "card": rf"{_L}(?:\d{{4}}(?<gap>[ -])\d{{4}}\k<gap>\d{{4}}\k<gap>\d{{4}}|\d{{4}}(?<wide>[ -])\d{{6}}\k<wide>\d{{4,5}}|\d{{13,19}}){_R}",
}
_NATIONAL = PATTERNS["phone"]
#: With a country code, any grouping of 8 to 15 digits; a date, SSN or IPv4 address after a space isn't part of it.
_NEXT = rf"(?:(?! (?:{PATTERNS['date']}|{PATTERNS['ssn']}|{PATTERNS['ip']}))[ .-]?\d)"
PATTERNS["phone"] = rf"(?:{_NATIONAL}|(?<![0-9A-Za-z+])\+[1-9](?:\d{{0,2}}[ .-]?\(\d{{1,4}}\){_NEXT}{{4,10}}|{_NEXT}{{7,14}}){_R})"
#: Country codes of one or two digits; all others have three.
_SHORT_CODES = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sub(s: Column, start, size) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(s, as_col(start), as_col(size))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("."), F.lit(0))


def _long(s: Column) -> Column:
    return F.coalesce(s.try_cast("long"), F.lit(0).cast("long"))


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


class Feistel:
    """Keyed round functions; ``back`` undoes what the forward network does."""

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = F.lit(key), back

    def noise(self, kind: str, i: Column, other: Column) -> Column:
        """60 bits of SHA-256 over key, kind, round and the half that stays."""
        h = F.sha2(F.concat_ws("|", self.key, F.lit(kind), i.cast("string"), other.cast("string")), 256)
        return F.conv(_sub(h, 1, 15), 16, 10).cast("long")

    def rounds(self) -> Column:
        return F.array(*[F.lit(i) for i in (reversed(range(ROUNDS)) if self.back else range(ROUNDS))])

    def moved(self, x: Column, noise: Column, size: Column) -> Column:
        return F.pmod(x - F.pmod(noise, size) if self.back else x + F.pmod(noise, size), size)

    def pair(self, kind: str, left: Column, right: Column, a: Column, b: Column) -> Column:
        """Struct (l, r): the pair permuted in Z_a x Z_b."""
        start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        def step(s: Column, i: Column) -> Column:
            even = i % 2 == 0
            return F.struct(F.when(even, self.moved(s["l"], self.noise(kind, i, s["r"]), a)).otherwise(s["l"]).alias("l"),
                            F.when(even, s["r"]).otherwise(self.moved(s["r"], self.noise(kind, i, s["l"]), b)).alias("r"))

        return F.aggregate(self.rounds(), start, step)

    def digits(self, kind: str, d: Column) -> Column:
        """A string of digits (up to 36), permuted among those of its length."""
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        out = self.pair(kind, _long(_sub(d, 1, a)), _long(_sub(d, a + 1, 36)), _ten(a), _ten(n - a))
        return _let(out, lambda s: F.concat(F.when(a > 0, F.lpad(s["l"].cast("string"), a, F.lit("0"))).otherwise(""),
                                            F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))

    def letters(self, kind: str, s: Column) -> Column:
        """Letters and digits moved within their class, in two halves of alternate places; other signs stay. Case plays no part."""

        def step(chars: Column, i: Column) -> Column:
            rest = F.lower(F.array_join(F.filter(chars, lambda c, j: j % 2 != i % 2), ""))
            return _let(rest, lambda other: F.transform(chars, lambda c, j: F.when(j % 2 != i % 2, c).otherwise(
                reduce(lambda x, k: x.when((c >= k[0]) & (c <= k[1]), F.char(
                    F.ascii(F.lit(k[0])) + self.moved(F.ascii(c) - F.ascii(F.lit(k[0])), self.noise(kind, i, F.concat_ws("|", j.cast("string"), other)), F.lit(k[2])))),
                    [("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)], F.when(F.lit(False), c)).otherwise(c))))

        return F.array_join(F.aggregate(self.rounds(), _chars(s), step), "")


def _laid(m: Column, p: Column) -> Column:
    """The digits of ``p`` in the places of the digits of ``m``."""
    place = lambda i: F.length(_digits(_sub(m, 1, i + 1)))
    return F.array_join(F.transform(_chars(m), lambda c, i: F.when(c.between("0", "9"), _sub(p, place(i), 1)).otherwise(c)), "")


def luhn_sum(d: Column) -> Column:
    """Luhn sum of a string of digits, the last one counting once."""
    each = F.transform(F.reverse(_chars(d)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.floor(2 * c.cast("int") / 10).cast("int") + 2 * c.cast("int") % 10))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod97(s: Column) -> Column:
    """The ISO 7064 remainder of letters and digits, letters counting 10 to 35."""
    return F.aggregate(_chars(s), F.lit(0), lambda r, c: F.when(c.between("0", "9"), (r * 10 + c.cast("int")) % 97).otherwise(
        (r * 100 + F.ascii(c) - 55) % 97))


def _card(f: Feistel, m: Column) -> tuple[Column, Column]:
    d = _digits(m)
    valid = (luhn_sum(d) % 10 == 0) & d.rlike("[1-9]")
    body = f.digits("card", _sub(d, 1, F.length(d) - 1))
    return valid, _let(body, lambda p: _laid(m, F.concat(p, ((10 - luhn_sum(F.concat(p, F.lit("0"))) % 10) % 10).cast("string"))))


def _iban(f: Feistel, m: Column) -> tuple[Column, Column]:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    head, rest = _sub(flat, 1, 2), _sub(flat, 5, 40)
    valid = (mod97(F.concat(rest, _sub(flat, 1, 4))) == 1) & rest.rlike("[0-9]")
    check = lambda r: F.lpad((98 - mod97(F.concat(r, head, F.lit("00")))).cast("string"), 2, "0")
    moved = _let(f.digits("iban", _digits(rest)), lambda p: _laid(rest, p))
    return valid, _let(moved, lambda r: _laid(m, F.concat(check(r), _digits(r))))


def _ssn(f: Feistel, m: Column) -> tuple[Column, Column]:
    area, group, serial = _long(_sub(m, 1, 3)), _long(_sub(m, 5, 2)), _long(_sub(m, 8, 4))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = f.pair("ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return valid, _let(out, lambda s: F.concat_ws("-", pad(s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), 3),
                                                  pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4)))


def _ip(f: Feistel, m: Column) -> tuple[Column, Column]:
    part = F.transform(F.split(m, r"\."), _long)
    valid = F.forall(part, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0\d")
    out = _let(part, lambda p: f.pair("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536)))
    return valid, _let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.floor(s[h] / 256), s[h] % 256)]))


#: Days of a whole cycle of the calendar, from 1800-01-01 to 2199-12-31: 189 x 773.
_DAY0, _DAYS = "1800-01-01", (189, 773)


#: Days after the 12th of a month in that cycle: 9 x 9833.
_LATE, _MONTHS = (9, 9833), 4800


def _date(f: Feistel, m: Column) -> tuple[Column, Column]:
    """With slashes the month comes first where it can; a first part over 12 is a day, and stays over 12, so that it is still one."""
    slash = _sub(m, 3, 1) == "/"
    late = slash & (_sub(m, 1, 2) > "12")
    iso = F.when(_sub(m, 5, 1) == "-", m).when(slash & ~late, F.concat_ws("-", _sub(m, 7, 4), _sub(m, 1, 2), _sub(m, 4, 2))).otherwise(
        F.concat_ws("-", _sub(m, 7, 4), _sub(m, 4, 2), _sub(m, 1, 2)))
    date, day0 = F.try_to_date(iso, "yyyy-MM-dd"), F.lit(_DAY0).cast("date")
    day = F.datediff(date, day0)
    valid = F.coalesce((day >= 0) & (day < _DAYS[0] * _DAYS[1]), F.lit(False))
    out = _let(day, lambda x: f.pair("date", F.floor(x / _DAYS[1]), x % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1])))
    new = _let(out, lambda s: F.date_add(day0, (s["l"] * _DAYS[1] + s["r"]).cast("int")))
    # late days are counted on their own: those before a month are its first day less 12 for each month
    month = (F.year(date) - 1800) * 12 + F.month(date) - 1
    moved = _let(day - 12 * (month + 1), lambda x: f.pair("date", F.floor(x / _LATE[1]), x % _LATE[1], F.lit(_LATE[0]), F.lit(_LATE[1])))
    before = lambda k: F.datediff(F.add_months(day0, k), day0) - 12 * k
    near = lambda x: F.transform(F.array(*[F.lit(i) for i in range(-2, 3)]), lambda i: F.floor(x * _MONTHS / (_LATE[0] * _LATE[1])).cast("int") + i)
    of = lambda x: F.array_max(F.filter(near(x), lambda k: (k >= 0) & (k < _MONTHS) & (before(k) <= x)))
    new_late = _let(_let(moved, lambda s: s["l"] * _LATE[1] + s["r"]), lambda x: _let(of(x), lambda k: F.date_add(F.add_months(day0, k), (x - before(k)).cast("int") + 12)))
    return valid, F.when(_sub(m, 5, 1) == "-", F.date_format(new, "yyyy-MM-dd")).when(late, F.date_format(new_late, "dd/MM/yyyy")).when(
        slash, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))


def _phone(f: Feistel, m: Column) -> tuple[Column, Column]:
    d = _digits(m)
    national = m.rlike(f"^(?:{_NATIONAL})$")
    short = F.when(d.rlike("^[17]"), 1).when(d.rlike(_SHORT_CODES), 2).otherwise(3)
    code = F.when(national, F.length(d) - 10).otherwise(short)
    return F.lit(True), _laid(m, F.concat(_sub(d, 1, code), f.digits("phone", _sub(d, code + 1, 36))))


def _email(f: Feistel, m: Column) -> tuple[Column, Column]:
    name = F.substring_index(m, "@", 1)
    return name.rlike("[A-Za-z0-9]"), F.concat(f.letters("email", name), F.lit("@"), F.substring_index(m, "@", -1))


_MAKE = {"email": _email, "phone": _phone, "card": _card, "ip": _ip, "date": _date, "ssn": _ssn, "iban": _iban}


def _kind(f: Feistel, m: Column) -> Column:
    """The kind of a candidate; null where it isn't valid."""
    out = F
    for k, p in PATTERNS.items():
        out = out.when(m.rlike(f"^(?:{p})$"), F.when(_MAKE[k](f, m)[0], F.lit(k)))
    return out


def _new(f: Feistel, kind: Column, m: Column) -> Column:
    out = F
    for k in PATTERNS:
        out = out.when(kind == k, _MAKE[k](f, m)[1])
    return out


def _cuts(c: Column) -> Column:
    """For each candidate, how many characters of its piece a value covers: less than 0 where it is that value itself.

    From left to right, a valid candidate is taken unless one taken before
    reaches into it. One that isn't valid covers nothing. A fold copies the
    list it grows at each step, so the candidates are folded in stretches of
    the square root of their number, and the stretches' lists are joined.
    """
    stretch = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(c)))).cast("int")

    def step(s: Column, x: Column) -> Column:
        taken = (s["over"] == 0) & x["kind"].isNotNull()
        reach = F.when(taken, F.length(x["m"])).otherwise(s["over"])
        cut = F.least(reach, F.length(x["p"]))
        return F.struct((reach - cut).alias("over"), F.concat(s["cuts"], F.array(F.when(taken, -cut).otherwise(cut))).alias("cuts"))

    def some(s: Column, i: Column) -> Column:
        start = F.struct(s["over"].alias("over"), F.array().cast("array<int>").alias("cuts"))
        return _let(F.aggregate(F.slice(c, i, stretch), start, step), lambda t: F.struct(
            t["over"].alias("over"), F.concat(s["parts"], F.array(t["cuts"])).alias("parts")))

    start = F.struct(F.lit(0).alias("over"), F.array().cast("array<array<int>>").alias("parts"))
    return F.flatten(F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c)), stretch), start, some, lambda s: s["parts"]))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def pseudonymise(docs: DataFrame, key: str, back: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text`` with pseudonyms, and ``n_<kind>`` values replaced.

    Kinds: e-mail addresses (the domain stays), telephone numbers (the country
    code stays): 3-3-4 digits, or 8 to 15 digits of any grouping after + and a
    country code; payment cards (Luhn): 13 to 19 digits, 4-4-4-4, 4-6-5 or
    4-6-4; IPv4 addresses; dates from 1800 to 2199: yyyy-mm-dd, dd.mm.yyyy,
    mm/dd/yyyy, and dd/mm/yyyy where the first part is over 12 (these are moved
    among themselves); US social security numbers; IBANs (mod 97). Left out:
    telephone numbers without country code that aren't 3-3-4, or without
    separators, 19-digit cards in groups, dates with one-digit parts, two-digit
    years or month names, small-letter IBANs. What fails its check
    stays as it is. ``back`` with the same key restores the text, unless a failed
    candidate overlaps a value and by chance passes its check with the
    pseudonym (1 in 10 for cards, 1 in 97 for IBANs). Null texts
    stay null, with counts 0; null ids and repeated rows stay, one row each;
    other columns are ignored.
    """
    f = Feistel(key, back)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # every kind holds a digit or an @ sign: other texts are not searched; a split drops an empty first piece, so a line break goes first
    searched = F.concat(F.lit("\n"), F.when(d["text"].rlike("[0-9@]"), d["text"]).otherwise(""))
    d = d.withColumn("p", F.split(searched, f"(?={_ALL})", -1)).withColumn("m", F.regexp_extract_all(searched, F.lit(f"(?=({_ALL}))"), F.lit(1)))
    d = d.withColumn("c", F.transform(F.arrays_zip("m", F.slice("p", F.lit(2), F.size("p")).alias("p")), lambda x: F.struct(
        _kind(f, x["m"]).alias("kind"), x["m"].alias("m"), x["p"].alias("p"))))
    d = d.withColumn("m", F.zip_with("c", _cuts(F.col("c")), lambda x, cut: F.struct(
        F.when(cut < 0, x["kind"]).alias("kind"),
        F.concat(F.when(cut < 0, _new(f, x["kind"], x["m"])).otherwise(""), _sub(x["p"], F.abs(cut) + 1, F.length(x["p"]))).alias("out"))))
    whole = F.concat(_sub(F.col("p")[0], 2, F.length("text")), F.array_join("m.out", ""))
    counts = [F.size(F.filter("m", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", F.when(F.size("m") > 0, whole).otherwise(F.col("text")).alias("text"), *counts)
