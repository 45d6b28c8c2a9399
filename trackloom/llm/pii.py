"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated numbers and dates are permuted with a key within their format: a card number
becomes another card number of the same length, punctuation and first digit whose check
digit is right, a phone number another one in the same punctuation, an address another
with as many digits in each part, a date another real date in the same notation. Equal values become equal
pseudonyms in every document and every run with the same key, and different values of a
format stay different. A date is the same value in all notations, and a number of ten digits
with or without the prefix 1.

A number of n digits is split in halves of a and b digits, which take turns in being added
a keyed hash of the other, modulo 10**a and 10**b: an alternating Feistel network, hence a
permutation. Dates are permuted within their 400-year Gregorian cycle of
146097 = 189 * 773 days by the same network in mixed radix, and the names of e-mail
addresses and hexadecimal secrets by the same network on characters, each turned within
its own alphabet.

Edge cases: null text stays null with no finds; what fails validation (month 13, address
part 300) stays as it is; a number of 13 to 19 digits with a wrong check digit keeps the
distance of that digit from the right one, so that both kinds stay apart; all other
characters of a text are untouched. Repeated rows, and rows that repeat an id or have none,
are rewritten one by one and equal texts alike; of two formats that match at a place the first
in ANY wins; very long texts are rewritten whole; other columns of the table are never read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Days of the Gregorian cycle as a product.
CYCLE = (189, 773)
EMAIL = r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
DATE = r"\d{4}[-/.]\d{2}[-/.]\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4}"
ADDRESS = r"\d{1,3}(?:\.\d{1,3}){3}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
CARD = r"\d(?:[ -]?\d){12,18}"
HEX = r"(?i:[0-9a-f]{32,64})"
#: The first format that matches at a place wins.
ANY = rf"(?<!\w)(?<!\d[.-])(?:{EMAIL}|(?:{HEX}|{DATE}|{SSN}|{CARD}|{PHONE})(?!\w|[.-]\d)|{ADDRESS}(?!\w|\.\d))"
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789")


def _let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def _hash(key: str, *parts: Column) -> Column:
    """A keyed hash as an integer of 52 bits."""
    return F.conv(F.substring(_digest(key, *parts), 1, 13), 16, 10).cast("long")


def feistel(left: Column, right: Column, m_left: Column, m_right: Column, key: str, tag: Column) -> Column:
    """struct(l, r): a permutation of [0, m_left) x [0, m_right)."""

    def turn(s: Column, k: Column) -> Column:
        new = F.pmod(s["l"] + _hash(key, tag, k, s["r"]), m_left)
        return _let(new, lambda x: F.struct(x.alias("l"), F.pmod(s["r"] + _hash(key, tag, k, F.lit("r"), x), m_right).alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def permute_digits(digits: Column, key: str, tag: Column) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        ten = lambda x: F.pow(F.lit(10.0), x).cast("long")
        s = feistel(F.substring(d, F.lit(1), a), F.substring(d, a + 1, n), ten(a), ten(n - a), key, F.concat_ws("|", tag, n.cast("string")))
        return _let(s, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))

    return F.when(F.length(digits).between(2, 18), _let(digits, halves)).otherwise(digits)


def check_digit(head: Column) -> Column:
    """The Luhn check digit that belongs behind a digit string."""
    n = F.length(head)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(head, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i, F.lit(2)) == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add), F.lit(10)), F.lit(10))


def refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those of digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def card(v: Column, key: str) -> Column:
    def swap(x: Column) -> Column:
        n = F.length(x)
        off = lambda h, last: F.pmod(last.cast("int") - check_digit(h), F.lit(10))
        kept = off(F.substring(x, F.lit(1), n - 1), F.substring(x, n, F.lit(1)))
        first = F.substring(x, F.lit(1), F.lit(1))
        head = F.concat(first, permute_digits(F.substring(x, F.lit(2), n - 2), key, F.concat(F.lit("card"), first, kept.cast("string"))))
        return _let(head, lambda h: F.concat(h, F.pmod(check_digit(h) + kept, F.lit(10)).cast("string")))

    return _let(card_end(v), lambda p: F.concat(_let(F.substring(v, F.lit(1), p), lambda c: _let(_digits(c), lambda x: refill(c, swap(x)))), F.substring(v, p + 1, F.length(v))))


def card_end(v: Column) -> Column:
    """Where the card ends in a run of digits: the longest prefix of whole groups that passes the check digit, else the first group if it is long enough, else the run."""
    n = F.length(v)
    passes = lambda x: check_digit(F.substring(x, F.lit(1), F.length(x) - 1)) == F.substring(x, F.length(x), F.lit(1)).cast("int")
    whole = lambda p: (p == n) | F.substring(v, p + 1, F.lit(1)).isin(" ", "-")
    ends = F.filter(F.sequence(F.lit(13), n), lambda p: whole(p) & (F.length(_digits(F.substring(v, F.lit(1), p))) >= 13))
    good = F.filter(ends, lambda p: _let(_digits(F.substring(v, F.lit(1), p)), passes))
    first = F.length(F.regexp_extract(v, r"^\d+", 0))
    return F.coalesce(F.array_max(good), F.when(first >= 13, first), n)


def hexadecimal(v: Column, key: str) -> Column:
    """The same secret in either case gets the same pseudonym, in the case it was found in."""

    def written(p: Column) -> Column:
        mixed = F.array_join(F.zip_with(F.split(v, ""), F.split(p, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")
        return F.when(v == F.lower(v), p).when(v == F.upper(v), F.upper(p)).otherwise(mixed)

    return _let(letters(F.lower(v), key, "hex", ("0123456789abcdef",)), written)


def phone(v: Column, key: str) -> Column:
    """Country code and the digits that may not be 0 or 1 stay; the rest is permuted."""

    def swap(x: Column) -> Column:
        n = F.length(x)
        skip = n - 10  # digits before a number of ten: a country code
        part = lambda a, k: F.substring(x, skip + a, F.lit(k))
        ten = _let(permute_digits(F.concat(part(2, 2), part(5, 6)), key, F.concat(F.lit("phone"), part(1, 1), part(4, 1))), lambda p: F.concat(F.substring(x, F.lit(1), skip + 1), F.substring(p, 1, 2), part(4, 1), F.substring(p, 3, 6)))
        other = F.concat(F.substring(x, 1, 3), permute_digits(F.substring(x, F.lit(4), n - 3), key, F.concat(F.lit("phone"), F.substring(x, 1, 3))))
        return F.when((n == 10) | ((n == 11) & x.startswith("1")), ten).otherwise(other)

    return _let(_digits(v), lambda x: refill(v, swap(x)))


def ssn(v: Column, key: str) -> Column:
    group, serial = F.substring(v, 5, 2).cast("long"), F.substring(v, 8, 4).cast("long")
    s = feistel(group - 1, serial - 1, F.lit(99), F.lit(9999), key, F.concat(F.lit("ssn"), F.substring(v, 1, 3)))
    out = _let(s, lambda s: F.concat(F.substring(v, 1, 4), F.lpad((s["l"] + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["r"] + 1).cast("string"), 4, "0")))
    return F.when((group > 0) & (serial > 0), out).otherwise(v)


def address(v: Column, key: str) -> Column:
    """Each part moves among those of as many digits (0-9, 10-99, 100-255), by a hash of the other three."""

    def swap(p: Column) -> Column:
        parts = F.transform(p, lambda x: x.cast("long"))

        def turn(state: Column, k: Column) -> Column:
            i = F.pmod(k, F.lit(4))
            others = F.array_join(F.transform(state, lambda x, j: F.when(j == i, F.lit("*")).otherwise(x.cast("string"))), ".")

            def move(x: Column) -> Column:
                low = F.when(x < 10, 0).when(x < 100, 10).otherwise(100)
                span = F.when(x < 10, 10).when(x < 100, 90).otherwise(156)
                return (low + F.pmod(x - low + _hash(key, F.lit("address"), k, others), span)).cast("long")

            return F.transform(state, lambda x, j: F.when(j == i, move(x)).otherwise(x))

        out = F.aggregate(F.sequence(F.lit(0), F.lit(4 * ROUNDS // 2 - 1)), parts, turn, lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), "."))
        plain = F.forall(p, lambda x: (x.cast("int") < 256) & (x == x.cast("int").cast("string")))
        return F.when(plain, out).otherwise(v)

    return _let(F.split(v, r"\."), swap)


def date(v: Column, key: str) -> Column:
    sep, iso = F.regexp_extract(v, "[-/.]", 0), v.rlike(r"^\d{4}")
    a, b = F.substring(v, 1, 2), F.substring(v, 4, 2)
    y = F.when(iso, F.substring(v, 1, 4)).otherwise(F.substring(v, 7, 4))
    # day first where that is a date, else month first
    dmy = F.try_to_date(F.concat_ws("-", y, F.when(iso, F.substring(v, 6, 2)).otherwise(b), F.when(iso, F.substring(v, 9, 2)).otherwise(a)), "yyyy-MM-dd")
    mdy = F.when(~iso, F.try_to_date(F.concat_ws("-", y, a, b), "yyyy-MM-dd"))
    size, start = CYCLE[0] * CYCLE[1], F.lit("1800-01-01").cast("date")

    def shift(day: Column) -> Column:
        n = F.datediff(day, start).cast("long")
        block, place = F.floor(n / size), F.pmod(n, F.lit(size))
        s = feistel(F.floor(place / CYCLE[1]), F.pmod(place, F.lit(CYCLE[1])), F.lit(CYCLE[0]), F.lit(CYCLE[1]), key, F.concat(F.lit("date"), block.cast("string")))
        return _let(s, lambda s: F.date_add(start, (block * size + s["l"] * CYCLE[1] + s["r"]).cast("int")))

    def written(d: Column) -> Column:
        y4, m2, d2 = (F.date_format(d, p) for p in ("yyyy", "MM", "dd"))
        return F.when(iso, F.concat(y4, sep, m2, sep, d2)).when(dmy.isNotNull(), F.concat(d2, sep, m2, sep, y4)).otherwise(F.concat(m2, sep, d2, sep, y4))

    day = F.coalesce(dmy, mdy)
    return F.when(day.isNull(), v).otherwise(_let(day, lambda x: _let(shift(x), written)))


def letters(v: Column, key: str, tag: str, alphabets: tuple[str, ...]) -> Column:
    """Characters turned within their alphabets: a Feistel network on the halves of a string."""

    def turned(x: Column, stream: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(stream, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for k in alphabets:
                at = F.instr(F.lit(k), c)
                out = F.when(at > 0, F.substring(F.lit(k), F.pmod(at - 1 + by, F.lit(len(k))) + 1, F.lit(1))).otherwise(out)
            return out

        return F.array_join(F.transform(F.split(x, ""), one), "")

    def halves(s: Column) -> Column:
        n = F.length(s)
        a = F.greatest(F.floor(n / 2), F.lit(1)).cast("int")
        state = F.struct(F.substring(s, F.lit(1), a).alias("l"), F.substring(s, a + 1, n).alias("r"))

        def turn(st: Column, k: Column) -> Column:
            return _let(turned(st["l"], _digest(key, F.lit(tag), n, k, st["r"])), lambda x: F.struct(x.alias("l"), F.when(st["r"] == "", "").otherwise(turned(st["r"], _digest(key, F.lit(tag), n, k, F.lit("r"), x))).alias("r")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), state, turn, lambda st: F.concat(st["l"], st["r"]))

    return _let(v, halves)


def kind_of(v: Column) -> Column:
    whole = lambda p: v.rlike(f"^(?:{p})$")
    return F.when(v.contains("@"), "email").when(whole(HEX), "hex").when(whole(DATE), "date").when(whole(SSN), "ssn").when(whole(ADDRESS), "address").when(whole(PHONE), "phone").otherwise("card")


def pseudonym(v: Column, key: str) -> Column:
    """The replacement of one value that `ANY` has found."""

    def by_kind(k: Column) -> Column:
        name = F.substring_index(v, "@", 1)
        email = F.concat(letters(name, key, "email", ALPHABETS), F.substring(v, F.length(name) + 1, F.length(v)))
        return F.when(k == "email", email).when(k == "hex", hexadecimal(v, key)).when(k == "date", date(v, key)).when(k == "ssn", ssn(v, key)).when(k == "address", address(v, key)).when(k == "phone", phone(v, key)).otherwise(card(v, key))

    return _let(kind_of(v), by_kind)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text (with pseudonyms), n_found, n_changed.

    Each text is cut at the values found, each value is replaced by itself, and the pieces
    are put together again, so a pseudonym can never be taken for another value.
    """
    t = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = F.when(t.rlike("[0-9@]|[A-Fa-f]{32}"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
    cut = rows.select("doc_id", "text", F.coalesce(found, F.array().cast("array<string>")).alias("old"))
    new = cut.select("doc_id", "text", "old", F.transform("old", lambda v: pseudonym(v, key)).alias("new"))
    pieces = F.zip_with(F.split(t, ANY, -1), F.col("new"), lambda p, n: F.concat(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))
    changed = F.size(F.filter(F.zip_with("old", "new", lambda a, b: a != b), lambda x: x))
    return new.select("doc_id", F.when(F.size("old") == 0, t).otherwise(F.array_join(pieces, "")).alias("text"), F.size("old").cast("long").alias("n_found"), changed.cast("long").alias("n_changed"))
