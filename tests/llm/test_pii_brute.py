"""op1_pii against a plain version in Python, over whole tables and made-up cases."""

import datetime
import hashlib
import re

import pytest

from trackloom.llm import pii
from trackloom.llm import queries as Q

KEY = "k"
ASCII = re.ASCII


def digest(*parts):
    return hashlib.sha256("|".join([KEY, *map(str, parts), KEY]).encode()).hexdigest()


def number(*parts):
    return int(digest(*parts)[:13], 16)


def feistel(left, right, m_left, m_right, tag):
    for k in (1, 2, 3):
        left = (left + number(tag, k, right)) % m_left
        right = (right + number(tag, k, "r", left)) % m_right
    return left, right


def permuted(d, tag):
    n = len(d)
    if not 2 <= n <= 18:
        return d
    a = n // 2
    left, right = feistel(int(d[:a]), int(d[a:]), 10**a, 10 ** (n - a), f"{tag}|{n}")
    return f"{left:0{a}d}{right:0{n - a}d}"


def check(head):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(head)))
    return -total % 10


def refill(shape, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def card(v):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ends = [p for p in range(13, len(v) + 1) if (p == len(v) or v[p] in " -") and len(digits(v[:p])) >= 13]
    good = [p for p in ends if check(digits(v[:p])[:-1]) == int(digits(v[:p])[-1])]
    run = len(re.match("[0-9]+", v)[0])
    end = max(good) if good else run if run >= 13 else len(v)
    x = digits(v[:end])
    kept = (int(x[-1]) - check(x[:-1])) % 10
    head = x[0] + permuted(x[1:-1], f"card{x[0]}{kept}")
    return refill(v[:end], head + str((check(head) + kept) % 10)) + v[end:]


def phone(v):
    x = re.sub("[^0-9]", "", v)
    if len(x) == 10 or len(x) == 11 and x[0] == "1":
        own = x[-10:]
        p = permuted(own[1:3] + own[4:], f"phone{own[0]}{own[3]}")
        return refill(v, x[:-10] + own[0] + p[:2] + own[3] + p[2:])
    return refill(v, x[:3] + permuted(x[3:], f"phone{x[:3]}"))


def ssn(v):
    group, serial = int(v[4:6]), int(v[7:11])
    if not group or not serial:
        return v
    a, b = feistel(group - 1, serial - 1, 99, 9999, f"ssn{v[:3]}")
    return f"{v[:4]}{a + 1:02d}-{b + 1:04d}"


def address(v):
    parts = v.split(".")
    if not all(int(p) < 256 and p == str(int(p)) for p in parts):
        return v
    p = [int(x) for x in parts]
    for k in range(12):
        i = k % 4
        low, span = (0, 10) if p[i] < 10 else (10, 90) if p[i] < 100 else (100, 156)
        others = ".".join("*" if j == i else str(x) for j, x in enumerate(p))
        p[i] = low + (p[i] - low + number("address", k, others)) % span
    return ".".join(map(str, p))


def date(v):
    sep, iso = re.search("[-/.]", v)[0], bool(re.match("[0-9]{4}", v))
    y = int(v[:4] if iso else v[6:10])
    orders = [(int(v[5:7]), int(v[8:10]), "i")] if iso else [(int(v[3:5]), int(v[:2]), "d"), (int(v[:2]), int(v[3:5]), "m")]
    for m, d, kind in orders:
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        n = (day - datetime.date(1800, 1, 1)).days
        block, place = divmod(n, 189 * 773)
        a, b = feistel(place // 773, place % 773, 189, 773, f"date{block}")
        new = datetime.date(1800, 1, 1) + datetime.timedelta(days=block * 189 * 773 + a * 773 + b)
        y4, m2, d2 = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return sep.join({"i": (y4, m2, d2), "d": (d2, m2, y4), "m": (m2, d2, y4)}[kind])
    return v


def turned(x, stream, alphabets):
    out = []
    for i, c in enumerate(x):
        by = int(stream[i % 32 * 2 : i % 32 * 2 + 2], 16)
        for a in alphabets:
            if c in a:
                c = a[(a.index(c) + by) % len(a)]
                break
        out.append(c)
    return "".join(out)


def letters(s, tag, alphabets):
    n, a = len(s), max(len(s) // 2, 1)
    left, right = s[:a], s[a:]
    for k in (1, 2, 3):
        left = turned(left, digest(tag, n, k, right), alphabets)
        right = turned(right, digest(tag, n, k, "r", left), alphabets) if right else ""
    return left + right


def pseudonym(v):
    whole = lambda p: re.fullmatch(p, v, ASCII)
    if "@" in v:
        name, rest = v.split("@", 1)
        return letters(name, "email", pii.ALPHABETS) + "@" + rest
    if whole(pii.HEX):
        new = letters(v.lower(), "hex", ("0123456789abcdef",))
        return new if v == v.lower() else new.upper() if v == v.upper() else "".join(b.upper() if a != a.lower() else b for a, b in zip(v, new, strict=True))
    for pattern, f in ((pii.DATE, date), (pii.SSN, ssn), (pii.ADDRESS, address), (pii.PHONE, phone)):
        if whole(pattern):
            return f(v)
    return card(v)


def plain(text):
    if text is None:
        return None, 0, 0
    found = []

    def put(m):
        found.append((m[0], pseudonym(m[0])))
        return found[-1][1]

    out = re.sub(pii.ANY, put, text, flags=ASCII)
    return out, len(found), sum(a != b for a, b in found)


CASES = ["4111 1111 1111 1111 12/25", "378282246310005", "1234567890123", "+49 30 1234567", "(212) 555-0187.", "212.555.0187 and 1-212-555-0187", "000-00-0000 123-45-6789", "2024-02-30 29/02/2024 12/31/1999 31.12.1999 1600-01-01", "10.0.0.7 300.1.1.1 01.2.3.4", "Mix.Ed-99@x.co.uk, a@b.c", "DEADBEEF" * 4 + " " + "deadBEEF" * 8, "x4111111111111111y", "5-4111111111111111", None, "", "no numbers"]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_documents_equal_the_plain_version(spark, sf):
    docs = Q.table(spark, sf, "documents")
    got = {r["doc_id"]: (r["text"], r["n_found"], r["n_changed"]) for r in pii.pseudonymise(docs, KEY).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert {i for i in got if got[i] != plain(texts[i])} == set() and sum(n for _, n, _ in got.values()) > 20


def test_made_up_cases_equal_the_plain_version(spark):
    got = {r["doc_id"]: (r["text"], r["n_found"], r["n_changed"]) for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string"), KEY).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == plain(t), t
