"""Format-preserving pseudonyms for personal data, with Spark expressions only.

Addresses, numbers and dates are found by one pattern, validated (Luhn digit, mod-97 digits, octets, calendar, digit counts), and replaced by a keyed
permutation of the values of their format: an alternating Feistel network over the characters of a value, whose round function is SHA-256
of the key, the kind, the round and the other half. Check digits are computed anew, and dates walk the cycle until they are dates, so a
pseudonym is valid where its value was. Equal values get equal pseudonyms in all documents, and different ones different pseudonyms.

Kinds: e-mail local parts (letters by case; the domain stays), IPv4 addresses, phone numbers with a + or in groups of 3, 3 and 4 digits (equal ones are
linked however they are spaced; the country code stays), payment cards, IBANs, social security numbers, dates (year-month-day, and day and month in
either order before the year), and hexadecimal secrets of 32, 40 or 64 characters. Not covered: national phone numbers in other groups, dates
with one-digit days or months, IPv6 addresses, names.

One pass of the pattern marks each match and its kind with control characters; those that a text has itself are escaped meanwhile. The key reaches
the expressions as the value of a one-row subquery, so no plan shows it.

Defined cases: null text stays null with nothing found; what fails its validation stays; repeated rows get equal pseudonyms; an empty table
gives no rows; other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import free_name

DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
MIXED = ALNUM + ALNUM[10:].upper()
ROUNDS = 8

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ISO_DATE, DMY_DATE = r"(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}", r"[0-9]{2}[-/.][0-9]{2}[-/.](?:19|20)[0-9]{2}"
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{13,19}"
SECRET = r"[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}"
FORMS = (EMAIL, IBAN, ISO_DATE, DMY_DATE, IPV4, SSN, PHONE, CARD, SECRET)
#: One kind after the other, the most specific first; none may touch a letter or digit outside it. `GROUPED` has a group a kind.
PATTERN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{p})" for p in FORMS) + r")(?![A-Za-z0-9])"
GROUPED = r"(?<![A-Za-z0-9])(?:" + "|".join(f"({p})" for p in FORMS) + r")(?![A-Za-z0-9])"
#: Country codes by their first digits; all others have three. Fixed values.
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: What begins a match, ends it, stands for one that a text has itself, and parts the kinds.
_BEGIN, _END, _ESCAPE, _KIND = "\x01", "\x02", "\x03", "\x07"

#: Days from 1900-01-01 to 2099-12-31, and 42 symbols, three of which count a little further.
DAYS, SYMBOLS = 73049, "0123456789abcdefghijklmnopqrstuvwxyzABCDEF"


def _column(key: Column | str) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it: lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _at(text: Column, j: Column | int) -> Column:
    return F.substr(text, F.lit(j) if isinstance(j, int) else j, F.lit(1))


def feistel(value: Column, alphabet: str, key: Column | str, kind: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings of ``value``'s length over an alphabet."""
    base, symbols, key = len(alphabet), F.lit(alphabet), _column(key)

    def add(half: Column, stream: Column) -> Column:
        """Each character of a half moved on by a byte of the stream."""

        def moved(j: Column) -> Column:
            step = F.conv(F.substr(stream, F.pmod((j - 1) * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
            return _at(symbols, F.pmod(F.position(_at(half, j), symbols) - 1 + step, F.lit(base)) + 1)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), moved), "")).otherwise("")

    def turn(acc: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", key, F.lit(kind), i.cast("string"), F.length(acc["l"]).cast("string"), acc["r"]).cast("binary"), 256)
        return F.struct(acc["r"].alias("l"), _let(stream, lambda s: add(acc["l"], s)).alias("r"))

    def whole(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substr(v, F.lit(1), half).alias("l"), F.substr(v, half + 1, F.length(v)).alias("r"))
        many = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))
        alone = _let(F.sha2(F.concat_ws("|", key, F.lit(kind), F.lit("one")).cast("binary"), 256), lambda s: add(v, s))  # one character has no halves: it is shifted
        return F.when(F.length(v) > 1, many).otherwise(alone)

    return _let(value, whole)


def refill(form: Column, places: str, filling: Column) -> Column:
    """``form`` with its characters of the class ``places`` replaced in order by those of ``filling``."""

    def filled(form: Column, filling: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            own = _at(form, j).rlike(places)
            c = F.when(own, _at(filling, acc["k"])).otherwise(_at(form, j))
            return F.struct(F.concat(acc["out"], c).alias("out"), (acc["k"] + F.when(own, 1).otherwise(0)).alias("k"))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
        return F.when(F.length(form) > 0, F.aggregate(F.sequence(F.lit(1), F.length(form)), start, step, lambda acc: acc["out"])).otherwise(form)

    return _let(form, lambda f: _let(filling, lambda x: filled(f, x)))


def _only(value: Column, kept: str) -> Column:
    return F.regexp_replace(value, kept.replace("[", "[^"), "")


def luhn_sum(digits: Column, plain: int) -> Column:
    """Sum of digits, every second one doubled; those at positions 2 i + ``plain`` from the right, counted from 0, stay."""

    def total(digits: Column) -> Column:
        def term(j: Column) -> Column:
            d = _at(digits, F.length(digits) - j).cast("int")
            twice = d * 2
            return F.when(F.pmod(j, F.lit(2)) != plain, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), term), F.lit(0), lambda a, x: a + x)

    return _let(digits, total)


def _mod97(value: Column) -> Column:
    def total(value: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            v = F.position(F.lower(_at(value, j)), F.lit(ALNUM)) - 1
            return F.pmod(F.when(v < 10, acc * 10).otherwise(acc * 100) + v, F.lit(97))

        return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), step)

    return _let(value, total)


def _card(value: Column, key: Column | str) -> Column:
    def new(digits: Column) -> Column:
        check = lambda payload: F.pmod(10 - F.pmod(luhn_sum(payload, 1), F.lit(10)), F.lit(10))
        payload = feistel(F.substr(digits, F.lit(1), F.length(digits) - 1), DIGITS, key, "card")
        return F.when(luhn_sum(digits, 0) % 10 == 0, refill(value, "[0-9]", _let(payload, lambda p: F.concat(p, check(p).cast("string")))))

    return _let(_only(value, "[0-9]"), new)


def _iban(value: Column, key: Column | str) -> Column:
    def new(plain: Column) -> Column:
        country, own = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
        account = F.when(own.rlike("^[0-9]+$"), feistel(own, DIGITS, key, "iban")).otherwise(F.upper(feistel(F.lower(own), ALNUM, key, "iban")))
        check = lambda account: F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        valid = _mod97(F.concat(own, F.substr(plain, F.lit(1), F.lit(4)))) == 1
        return F.when(valid, refill(value, "[A-Z0-9]", _let(account, lambda a: F.concat(country, check(a), a))))

    return _let(_only(value, "[A-Z0-9]"), new)


def _date(value: Column, key: Column | str, year: int, day: tuple[int, int], form: str) -> Column:
    """year, day: where the year begins, and where month and day do."""
    at = lambda pos, n: F.substr(value, F.lit(pos), F.lit(n))
    when = F.try_to_date(F.concat_ws("-", at(year, 4), at(day[0], 2), at(day[1], 2)), "yyyy-MM-dd")
    symbols, first_day = F.lit(SYMBOLS), F.to_date(F.lit("1900-01-01"))
    letter = lambda x: _at(symbols, x.cast("int") + 1)
    number = lambda s: sum(((F.position(_at(s, 3 - k), symbols) - 1) * 42**k for k in range(3)), F.lit(0))

    def new(n: Column) -> Column:
        code = F.concat(letter(F.floor(n / 1764)), letter(F.pmod(F.floor(n / 42), F.lit(42))), letter(F.pmod(n, F.lit(42))))
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(12)), code, lambda acc, i: F.when((i == 1) | (number(acc) >= DAYS), feistel(acc, SYMBOLS, key, "date")).otherwise(acc))
        days = _let(walk, lambda w: number(w).cast("int"))
        return F.when(n.isNotNull(), refill(value, "[0-9]", F.date_format(F.date_add(first_day, days), form)))

    return _let(F.datediff(when, first_day), new)


def _ip(value: Column, key: Column | str) -> Column:
    def new(octets: Column) -> Column:
        packed = F.array_join(F.transform(octets, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
        out = lambda new: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(F.substr(new, k * 2 + 1, F.lit(2)), 16, 10)), ".")
        return F.when(F.forall(octets, lambda x: x < 256), _let(feistel(packed, HEX, key, "ip"), out))

    return _let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), new)


def _ssn(value: Column, key: Column | str) -> Column:
    valid = lambda d: ~d.rlike("^(000|666|9)|^...00|0000$")

    def new(digits: Column) -> Column:
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(40)), digits, lambda acc, i: F.when((i == 1) | ~valid(acc), feistel(acc, DIGITS, key, "ssn")).otherwise(acc))
        return F.when(valid(digits), refill(value, "[0-9]", walk))

    return _let(_only(value, "[0-9]"), new)


def _phone(value: Column, key: Column | str) -> Column:
    form = F.replace(value, F.lit("(0)"), F.lit("(_)"))  # a prefix that is dialled without the country code

    def new(digits: Column) -> Column:
        code = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
        own = lambda code: F.concat(code, feistel(F.substr(digits, F.length(code) + 1, F.length(digits)), DIGITS, key, "phone"))
        return F.when(F.length(digits).between(8, 15), F.replace(refill(form, "[0-9]", _let(code, own)), F.lit("(_)"), F.lit("(0)")))

    return _let(_only(form, "[0-9]"), new)


def _email(value: Column, key: Column | str) -> Column:
    def new(local: Column) -> Column:
        return F.concat(refill(local, "[A-Za-z0-9]", feistel(_only(local, "[A-Za-z0-9]"), MIXED, key, "email")), F.substr(value, F.length(local) + 1, F.length(value)))

    return _let(F.substring_index(value, "@", 1), new)


def _kinds(value: Column, key: Column | str) -> list[Column]:
    """The pseudonym of ``value`` as each kind of `FORMS`, null where it isn't valid."""
    dmy = F.coalesce(_date(value, key, 7, (4, 1), "ddMMyyyy"), _date(value, key, 7, (1, 4), "MMddyyyy"))
    return [_email(value, key), _iban(value, key), _date(value, key, 1, (6, 9), "yyyyMMdd"), dmy, _ip(value, key), _ssn(value, key), _phone(value, key), _card(value, key), feistel(value, HEX, key, "secret")]


def pseudonym(value: Column, key: Column | str) -> Column:
    """The pseudonym of a match of `PATTERN`, or the match where it isn't valid."""
    out = F.lit(None).cast("string")
    for form, new in reversed(list(zip(FORMS, _kinds(value, key), strict=True))):
        out = F.when(value.rlike(_full(form)), new).otherwise(out)
    return F.coalesce(out, value)


def _swapped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with pseudonyms in ``text``, and ``n_found``: how many values were replaced."""
    name, old, new, secret = (free_name(docs, n) for n in ("n_found", "pieces", "pseudonyms", "key"))
    text, own = F.col("text"), F.col(secret)
    escapes = [(c, _ESCAPE + chr(ord(c) + 16)) for c in (_ESCAPE, _BEGIN, _END, _KIND)]
    strange = text.contains(_BEGIN) | text.contains(_END) | text.contains(_ESCAPE) | text.contains(_KIND)
    plain = F.when(strange, _swapped(text, escapes)).otherwise(text)
    groups = _KIND.join(f"${k + 1}" for k in range(len(FORMS)))
    marked = F.regexp_replace(plain, GROUPED, f"{_BEGIN}{groups}{_END}")
    pieces = F.when(text.rlike("[0-9@]"), F.split(marked, f"[{_BEGIN}{_END}]", -1))

    def replaced(piece: Column, i: Column) -> Column:
        def new(value: Column) -> Column:
            kind, out = F.length(piece) - F.length(F.ltrim(piece, F.lit(_KIND))), F.lit(None).cast("string")
            for k, as_kind in reversed(list(enumerate(_kinds(value, own)))):
                out = F.when(kind == k, as_kind).otherwise(out)
            return F.coalesce(out, value)

        return F.when(i % 2 == 1, _let(F.trim(piece, F.lit(_KIND)), new)).otherwise(piece)

    keys = docs.sparkSession.createDataFrame([(key,)], "key string")
    found = docs.withColumn(secret, keys.scalar()).withColumn(old, pieces).withColumn(new, F.transform(old, replaced))
    joined = F.array_join(new, "")
    changed = F.when(F.size(old) > 1, F.when(strange, _swapped(joined, [(b, a) for a, b in reversed(escapes)])).otherwise(joined)).otherwise(text)
    count = F.size(F.filter(F.zip_with(old, new, lambda a, b: F.trim(a, F.lit(_KIND)) != b), lambda x: x)).cast("long")
    return found.select(*(changed.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.coalesce(count, F.lit(0)).alias(name))
