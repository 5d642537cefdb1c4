"""Operator 9 against a Python Feistel written from the docstring, and its properties."""

import hashlib
import random
import re
from datetime import date, timedelta

import pytest

from pricefold.llm import pii

A = [pii.DIGITS, pii.LOWER, pii.UPPER]


def stream(label, other):
    return hashlib.sha256(f"{pii.KEY}|{label}|{other}".encode()).hexdigest()


def marks(value, kind, high=()):
    cells = [(c, i in high) for i, c in enumerate(value)]
    a, b = cells[:len(cells) // 2], cells[len(cells) // 2:]
    for k in range(1, pii.ROUNDS + 1):
        s = stream(f"{kind}{k}/{len(cells)}", "".join(c for c, _ in b))
        out = []
        for i, (c, g) in enumerate(a):
            by = int(s[(i * 3) % 62:(i * 3) % 62 + 3], 16)
            for alphabet in (["23456789", "01"] if g else []) + A:
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
                    break
            out.append((c, g))
        a, b = b, out
    return "".join(c for c, _ in a + b)


def number(u, v, a, b, kind):
    draw = lambda k, other, size: int(stream(f"{kind}{k}", str(other))[:12], 16) % size       # noqa: E731
    for k in range(1, pii.ROUNDS // 2 + 1):
        u = (u + draw(k, v, a)) % a
        v = (v + draw(k + 100, u, b)) % b
    return u, v


def luhn(d):
    return sum((2 * x - 9 if 2 * x > 9 else 2 * x) if k % 2 else x for k, x in enumerate(int(c) for c in reversed(d))) % 10


def mod97(v):
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97


def pour(shape, new, keep):
    it = iter(new)
    return "".join(next(it) if re.match(keep, c) else c for c in shape)


def replaced(v):
    kind = next(k for k in pii.KINDS if re.fullmatch(pii.PATTERNS[k], v, re.A))
    d = re.sub(r"\D", "", v)
    if kind == "email":
        at = v.index("@")
        return kind, marks(v[:at], kind) + v[at:]
    if kind == "card":
        body = d[0] + marks(d[1:-1], kind)
        return (kind, pour(v, body + str(-luhn(body + "0") % 10), r"\d")) if luhn(d) == 0 and len(set(d)) > 1 else ("", v)
    if kind == "iban":
        flat = v.replace(" ", "")
        body = marks(flat[4:], kind)
        return (kind, pour(v, f"{flat[:2]}{98 - mod97(flat[:2] + '00' + body):02d}{body}", "[0-9A-Z]")) \
            if mod97(flat) == 1 and 15 <= len(flat) <= 34 else ("", v)
    if kind == "phone":
        return kind, pour(v, d[:-10] + marks(d[-10:], kind, (0, 3)), r"\d")
    if kind == "ssn":
        a, g, s = map(int, v.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return "", v
        x, y = number((a - 2 if a > 666 else a - 1) * 99 + g - 1, s - 1, 898 * 99, 9999, kind)
        a = x // 99
        return kind, f"{a + 2 if a >= 665 else a + 1:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind == "ip":
        o = list(map(int, v.split(".")))
        if max(o) > 255 or re.search(r"(^|\.)0\d", v):
            return "", v
        x, y = number(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, kind)
        return kind, f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    p = re.split(r"[./-]", v)
    y, m, dd = (p if v[4] == "-" else (p[2], p[0], p[1]) if "/" in v else (p[2], p[1], p[0]))
    try:
        day = (date(int(y), int(m), int(dd)) - date(1800, 1, 1)).days
    except ValueError:
        return "", v
    if not 0 <= day < 146097:
        return "", v
    x, z = number(day // 431, day % 431, 339, 431, "date")
    new = date(1800, 1, 1) + timedelta(x * 431 + z)
    wide = not re.search(r"(^|[./])\d[./]", v)
    n = (lambda q: f"{q:02d}") if wide else str
    return kind, (f"{new:%Y-%m-%d}" if v[4] == "-" else f"{n(new.month)}/{n(new.day)}/{new.year}" if "/" in v
                  else f"{n(new.day)}.{n(new.month)}.{new.year}")


def valid_inside(u, whole):
    d = re.sub(r"\D", "", u)
    if re.match("[0-9]", u):
        return bool(re.search(pii._CARD, u, re.A) or u == whole) and 13 <= len(d) <= 19 and luhn(d) == 0 and len(set(d)) > 1
    flat = u.replace(" ", "")
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]{11,}", u, re.A)) and 15 <= len(flat) <= 34 and mod97(flat) == 1


def parts(v):
    """A card or IBAN candidate around its valid values: every part of 40 words or fewer is tried, leftmost and longest first."""
    if not any(re.fullmatch(pii.PATTERNS[k], v, re.A) for k in ("iban", "card")):
        return [v]
    at = [0, *[m.end() for m in re.finditer("[ -]", v)], len(v) + 1]
    out, done, i = [], 0, 0
    while i < len(at) - 1:
        j = next((j for j in range(min(len(at) - 1, i + 40), i, -1) if valid_inside(v[at[i]:at[j] - 1], v)), None)
        if j:
            out += [v[done:at[i]], v[at[i]:at[j] - 1]]
            done, i = at[j] - 1, j
        else:
            i += 1
    return [*out, v[done:]]


def want(text):
    if text is None:
        return None, []
    found = []

    def one(m):
        out = ""
        for v in parts(m[0]):
            if any(re.fullmatch(pii.PATTERNS[k], v, re.A) for k in pii.KINDS):
                kind, new = replaced(v)
                if kind:
                    found.append((kind, v, new))
                v = new
            out += v
        return out

    return re.sub(pii.ANY, one, text, flags=re.A), found


VALUES = ["4111 1111 1111 1111", "4012888888881881", "378282246310005", "1234567890123456", "0000000000000000", "DE89 3704 0044 0532 0130 00",
          "GB82WEST12345698765432", "GB82WEST12345698765431", "+1 (456) 555-2186", "212-555-0199", "1.415.555.2671", "112-555-0199",
          "123-45-6789", "666-12-1234", "899-99-9999", "000-12-1234", "10.0.255.1", "256.1.1.1", "1.2.3.4.5", "192.168.010.1",
          "2024-02-29", "2023-02-29", "31.12.1999", "1.2.2003", "12/31/1999", "13/31/1999", "1750-01-01", "a.b.42@mail8.example.com",
          "x@y", "O'Neil+tag@site.co.uk", "AB12 cd", "v1.2.3.4", "555-1234", "+1 (091) 555-3384", "(012) 055-7713", "+1-117-155-2028",
          "4111 1111 1111 1111 123", "ID42 4111 1111 1111 1111", "BE68 5390 0754 7034 CARD 4111 1111 1111 1111"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    texts = [f"see {v}, or ({v}) and {rng.choice(VALUES)}." for v in VALUES] + [" ".join(VALUES), "", None, "no value at all", VALUES[0]]
    texts += [f"card {rng.randrange(10 ** 16):016d} ip {'.'.join(str(rng.randrange(300)) for _ in range(4))}" for _ in range(150)]
    texts += ["word " * 30_000 + VALUES[1]]
    return [*enumerate(texts), (0, texts[0]), (None, texts[1])]


def test_texts_and_findings(docs_of, rows):
    docs = docs_of(rows)
    out = pii.pseudonymise(docs, key=pii.KEY)
    assert out.columns == [*docs.columns, "pii_found"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.pii_found]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *want(t)) for i, t in rows), key=repr)
    kinds = {f[0] for _, _, found in got for f in found}
    assert kinds == set(pii.KINDS)


def test_pseudonyms_keep_format_and_never_meet():
    seen = {}
    rng = random.Random(9)
    for _ in range(3000):
        body = f"4{rng.randrange(10 ** 14):014d}"
        v = body + str(-luhn(body + "0") % 10)
        kind, new = replaced(v)
        assert kind == "card" and luhn(new) == 0 and new[0] == "4" and len(new) == 16
        assert seen.setdefault(new, v) == v
    days = {number(i // 431, i % 431, 339, 431, "date") for i in range(0, 146097, 7)}
    assert len(days) == len(range(0, 146097, 7))


def test_phones_with_any_area_code_in_the_explicit_form(docs_of):
    phones = ["+1 (017) 555-7713", "+1 (132) 555-1352", "+1 (171) 555-2028", "(012) 055-7713", "+1-117-155-2028"]
    phones += [f"+1 ({n:03d}) 555-7713" for n in range(1000)]
    bare = ["112-555-0199", "1 017 555 7713"]
    out = pii.pseudonymise(docs_of([(i, f"call {v} now") for i, v in enumerate(phones + bare)]), key=pii.KEY).collect()
    new = {}
    for r in out:
        v = (phones + bare)[r.doc_id]
        if v in bare:
            assert (r.text, r.pii_found) == (f"call {v} now", [])
            continue
        (kind, value, name), = r.pii_found
        assert (kind, value, r.text) == ("phone", v, f"call {name} now") and v != name
        assert re.sub(r"\d", "0", name) == re.sub(r"\d", "0", v)
        assert re.fullmatch(pii.PATTERNS["phone"], name, re.A) and new.setdefault(name, v) == v


INSIDE = [("4111 1111 1111 1111 123", ["4111 1111 1111 1111"]), ("4111 1111 1111 1111 12/27", ["4111 1111 1111 1111"]),
          ("ES9121000418450200051332 EUR", ["ES9121000418450200051332"]), ("BE68539007547034 BIC", ["BE68539007547034"]),
          ("BE68 5390 0754 7034 CARD 4111 1111 1111 1111", ["BE68 5390 0754 7034", "4111 1111 1111 1111"]),
          ("ID42 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("DE42 4111 1111 1111 1111 12", ["4111 1111 1111 1111"]),
          ("12345 4111-1111-1111-1111", ["4111-1111-1111-1111"]), ("12345 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
          ("1234 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("378282246310005 1234", ["378282246310005"]),
          ("3782 822463 10005 1234", ["3782 822463 10005"]), ("411111 1111111111", ["411111 1111111111"]),
          ("DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]), ("1234 5678 9012 3456", []), ("DE88 3704 0044 0532 0130 00", [])]


def test_a_failed_candidate_is_searched_for_valid_ones(docs_of):
    out = pii.pseudonymise(docs_of([(i, f"pay {v}, please") for i, (v, _) in enumerate(INSIDE)]), key=pii.KEY).collect()
    assert len(out) == len(INSIDE)
    for r in out:
        text, values = INSIDE[r.doc_id]
        assert [f.value for f in r.pii_found] == values
        for f in r.pii_found:
            assert f.kind == ("card" if f.value[0].isdigit() else "iban")
            assert (luhn(re.sub(r"\D", "", f.pseudonym)) == 0) if f.kind == "card" else (mod97(f.pseudonym.replace(" ", "")) == 1)
            text = text.replace(f.value, f.pseudonym)
        assert r.text == f"pay {text}, please"


def test_long_runs_of_number_groups(docs_of):
    rng = random.Random(4)
    groups = lambda n, sep: sep.join(f"{rng.randrange(10 ** 4):04d}" for _ in range(n))           # noqa: E731
    texts = [groups(n, sep) for n in (20, 41, 800, 3000) for sep in (" ", "-")] + ["7 " + groups(500, " ") + " 12", "years 1999 " + groups(100, " ") + " end"]
    texts.append(" ".join(["4111 1111 1111 1111"] * 700))
    for r in pii.pseudonymise(docs_of(list(enumerate(texts))), key=pii.KEY).collect():
        assert (r.text, [tuple(f) for f in r.pii_found]) == want(texts[r.doc_id])


def test_a_line_of_a_hundred_thousand_years_ends(docs_of):
    import time
    text = " ".join(str(1000 + i % 1000) for i in range(100_000))
    began = time.time()
    row, = pii.pseudonymise(docs_of([(1, text)]), key=pii.KEY).collect()
    assert time.time() - began < 120 and len(row.text) == len(text) and len(row.pii_found) > 100


def test_callers_must_name_a_key(docs_of):
    with pytest.raises(TypeError):
        pii.pseudonymise(docs_of([(1, "x")]))


def test_empty_table(docs_of):
    assert pii.pseudonymise(docs_of([]).where("doc_id = 1"), key=pii.KEY).count() == 0
