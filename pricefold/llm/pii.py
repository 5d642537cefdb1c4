r"""Operator 9, PII: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Found and validated: card numbers (13 to 19 digits, Luhn), IBANs (remainder 97), North American phone numbers (any area and
exchange after +1 or around brackets, else both from 2), social security numbers (ranges), IPv4 addresses (octets up to 255), dates (real days, written
Y-M-D, D.M.Y or M/D/Y) and the local part of e-mail addresses.  A candidate that fails its check stays as it
is, but a card or IBAN candidate that fails is searched for valid ones made of some of its parts (split at spaces and
hyphens), the leftmost and longest first: a security code, an expiry date or a word may have been taken along.

Each value is permuted inside its own format by a keyed Feistel network, so the pseudonym passes the same check, different
values never meet, and equal values give equal pseudonyms in every document:

* strings of marks: two halves, each round adds a key stream drawn from the other half mark by mark, modulo the size of
  the mark's class (digits, a-z, A-Z; the first digit of a phone's area and exchange stays in 2-9, or in 0-1);
* numbers: a mixed-radix Feistel on Z_a x Z_b, exact on ``a * b`` values (addresses, social security numbers, days of
  the 400-year calendar cycle);
* check digits (Luhn, IBAN) are computed anew; the first digit of a card, an IBAN's country, a phone's country code and
  an address's host stay.

One regular expression finds all kinds; it only reads lines that hold a digit or an @ (no value spans lines).

Defined results: a null text stays null and has no findings; an empty text stays empty; repeated rows get equal results;
all rows and columns of the input are kept; a line that is one very long run of numbers is searched in time that grows
with its length.  Planning the expression takes some seconds, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .registry import query

ROUNDS = 8
KEY = "pseudonym-key-1"          # of the registered queries; callers must pass their own secret

COUNTRIES = {15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
             22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
             25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV",
             29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU"}


def _iban_shape(size: int) -> str:
    """Country's check digits and account marks, solid or in groups of four."""
    groups, rest = divmod(size - 4, 4)
    return rf"\d{{2}}(?:[A-Z0-9]{{{size - 4}}}|(?: [A-Z0-9]{{4}}){{{groups}}}" + (rf" [A-Z0-9]{{{rest}}})" if rest else ")")


_IBAN = "|".join(f"(?:{names}){_iban_shape(size)}" for size, names in COUNTRIES.items())
# groups of four with one separator, any number of them and with a part before them: the card is looked for inside
_CARDS = "|".join(rf"(?:\d{{1,12}}[ \-])?\d{{4}}(?:{c}\d{{4}}){{3,}}(?:{c}\d{{1,3}})?" for c in (" ", r"\-"))
# a card inside a longer candidate: solid, or grouped with one separator
_CARD = r"^(?:\d{13,19}|" + "|".join(
    rf"\d{{4}}{c}(?:\d{{4}}{c}\d{{4}}(?:{c}\d{{4}})?(?:{c}\d{{1,3}})?|\d{{6}}{c}\d{{4,5}})" for c in (" ", r"\-")) + ")$"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "phone": (r"(?<![0-9A-Za-z])(?:(?:\+1[ .\-]?(?:\(\d{3}\) ?|\d{3}[.\- ])|(?:1[ .\-]?)?\(\d{3}\) ?)\d{3}"
              r"|(?:1[ .\-]?)?[2-9]\d{2}[.\- ][2-9]\d{2})[.\- ]\d{4}(?![0-9A-Za-z])"),
    "ssn": r"(?<![0-9A-Za-z\-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z\-])",
    "date": r"(?<![0-9A-Za-z./\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![0-9A-Za-z]|[./\-]\d)",
    "ip": r"(?<![0-9A-Za-z.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![0-9A-Za-z]|\.\d)",
    "card": rf"(?<![0-9A-Za-z.])(?:{_CARDS}|\d(?:[ \-]?\d){{12,18}})(?![0-9A-Za-z]|\.\d)",
}
KINDS = list(PATTERNS)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body (or a lambda in it) reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.split(s, "")


def _stream(key: str, label: Column, other: Column) -> Column:
    """64 hexadecimal marks that depend on the key, the round, and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), label, other), 256)


def _byte(stream: Column, i: Column) -> Column:
    """Three hexadecimal marks of the stream at place ``i`` (places wrap after 62)."""
    return F.conv(F.substring(stream, (i * 3) % 62 + 1, F.lit(3)), 16, 10).cast("int")


def _shift(c: Column, by: Column, high: Column) -> Column:
    """Move a mark inside its class: 2-9 or 0-1 where ``high``, else the digits, a-z or A-Z; other marks stay."""
    def inside(alphabet: str) -> Column:
        place = F.instr(F.lit(alphabet), c)
        return F.substring(F.lit(alphabet), F.pmod(place - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))

    return (F.when(high & c.between("2", "9"), inside("23456789")).when(high & c.between("0", "1"), inside("01")).when(c.between("0", "9"), inside(DIGITS))
            .when(c.between("a", "z"), inside(LOWER)).when(c.between("A", "Z"), inside(UPPER)).otherwise(c))


def permute_marks(value: Column, key: str, kind: str, high: Column | None = None) -> Column:
    """Feistel over the marks of ``value``; ``high`` is an array of places (from 0) where 2-9 and 0-1 stay apart.

    The state carries each mark's own place, so that a place's class never changes while the halves swap."""
    def all_rounds(marks):
        size = F.size(marks)
        half = F.floor(size / 2).cast("int")
        start = F.struct(F.slice(marks, F.lit(1), half).alias("a"), F.slice(marks, half + 1, size - half).alias("b"))

        def one_round(acc, k):
            label = F.concat(F.lit(kind), k.cast("string"), F.lit("/"), size.cast("string"))
            told = _stream(key, label, F.array_join(F.transform(acc["b"], lambda m: m["c"]), ""))
            moved = _let(told, lambda stream: F.transform(acc["a"], lambda m, i: F.struct(
                _shift(m["c"], _byte(stream, i), m["g"]).alias("c"), m["g"].alias("g"))))
            return F.struct(acc["b"].alias("a"), moved.alias("b"))

        done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one_round)
        return _let(done, lambda d: F.array_join(F.transform(F.concat(d["a"], d["b"]), lambda m: m["c"]), ""))

    return _let(F.transform(_chars(value), lambda c, i: F.struct(
        c.alias("c"), (F.array_contains(high, i) if high is not None else F.lit(False)).alias("g"))), all_rounds)


def permute_number(u: Column, v: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel on Z_a x Z_b: rounds add to u what v says and to v what u says; a struct (u, v)."""
    def draw(k, other, size):
        return F.conv(F.substring(_stream(key, F.concat(F.lit(kind), k.cast("string")), other.cast("string")), 1, 12), 16, 10).cast("long") % size

    def one_round(acc, k):
        return _let((acc["u"] + draw(k, acc["v"], a)) % a,
                    lambda nu: F.struct(nu.alias("u"), ((acc["v"] + draw(k + 100, nu, b)) % b).alias("v")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(u.cast("long").alias("u"), v.cast("long").alias("v")), one_round)


# ---------------------------------------------------------------- kinds

def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    n = F.length(d)
    def add(acc, i):
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def _mod97(v: Column) -> Column:
    """Remainder of an IBAN (country and check marks moved to the end, letters as 10 to 35)."""
    moved = F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, F.lit(1), F.lit(4)))
    def add(acc, c):
        x = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (acc * F.when(x > 9, 100).otherwise(10) + x) % 97
    return F.aggregate(_chars(moved), F.lit(0), add)


def _pour(shape: Column, marks: Column, keep: str) -> Column:
    """Put ``marks`` one by one where ``shape`` has marks that match ``keep``; the others stay."""
    parts = F.transform(_chars(shape), lambda c: F.struct(c.alias("c"), c.rlike(keep).cast("int").alias("k")))

    def fill(new):
        def add(acc, p):
            taken = acc["n"] + p["k"]
            return F.struct(F.concat(acc["s"], F.when(p["k"] == 1, F.substring(new, taken, F.lit(1))).otherwise(p["c"])).alias("s"), taken.alias("n"))
        return F.aggregate(parts, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), add)["s"]

    return _let(marks, fill)


def card(v: Column, key: str) -> tuple[Column, Column]:
    d = _digits(v)
    new = _let(F.concat(F.substring(d, 1, 1), permute_marks(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")),
               lambda body: F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")))
    return F.length(d).between(13, 19) & (_let(d, _luhn) == 0) & ~d.rlike(r"^(\d)\1*$"), _pour(v, new, "[0-9]")


def iban(v: Column, key: str) -> tuple[Column, Column]:
    d = F.regexp_replace(v, " ", "")
    country = F.substring(d, 1, 2)
    new = _let(permute_marks(F.substring(d, F.lit(5), F.length(d)), key, "iban"), lambda body: F.concat(
        country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body))
    return F.length(d).between(15, 34) & (_mod97(d) == 1), _pour(v, new, "[0-9A-Z]")


def phone(v: Column, key: str) -> tuple[Column, Column]:
    d = _digits(v)
    new = permute_marks(F.substring(d, -10, 10), key, "phone", F.array(F.lit(0), F.lit(3)))
    return F.lit(True), _pour(v, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new), "[0-9]")


def ssn(v: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.split(v, "-")[i].cast("int") for i in range(3))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)

    def text(z):
        a = F.floor(z["u"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(a >= 665, a + 2).otherwise(a + 1).cast("int"), (z["u"] % 99 + 1).cast("int"),
                               (z["v"] + 1).cast("int"))
    return ok, _let(permute_number(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn"), text)


def ip(v: Column, key: str) -> tuple[Column, Column]:
    o = [F.split(v, r"\.")[i].cast("int") for i in range(4)]
    ok = (o[0] < 256) & (o[1] < 256) & (o[2] < 256) & (o[3] < 256) & ~v.rlike(r"(^|\.)0\d")
    z = permute_number(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
    return ok, _let(z, lambda z: F.concat_ws(".", *[c.cast("string") for h in ("u", "v") for c in (F.floor(z[h] / 256), z[h] % 256)]))


CYCLE_A, CYCLE_B = 339, 431      # 339 * 431 = 146,097 days in 400 years


def date(v: Column, key: str) -> tuple[Column, Column]:
    iso, us = F.substring(v, 5, 1) == "-", F.instr(v, "/") > 0
    p = F.split(v, r"[./\-]")
    y = F.when(iso, p[0]).otherwise(p[2])
    m = F.when(iso, p[1]).when(us, p[0]).otherwise(p[1])
    d = F.when(iso, p[2]).when(us, p[1]).otherwise(p[0])
    day = F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    base = F.to_date(F.lit("1800-01-01"))
    at = F.datediff(day, base)
    z = permute_number(F.floor(at / CYCLE_B), at % CYCLE_B, CYCLE_A, CYCLE_B, key, "date")
    wide = ~v.rlike(r"(^|[./])\d[./]")                     # day and month written with two digits

    def text(new):
        form = lambda two, one: F.when(wide, F.date_format(new, two)).otherwise(F.date_format(new, one))     # noqa: E731
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(us, form("MM/dd/yyyy", "M/d/yyyy")).otherwise(form("dd.MM.yyyy", "d.M.yyyy"))

    return (day.isNotNull() & at.between(0, CYCLE_A * CYCLE_B - 1),
            _let(_let(z, lambda z: F.date_add(base, (z["u"] * CYCLE_B + z["v"]).cast("int"))), text))


def email(v: Column, key: str) -> tuple[Column, Column]:
    at = F.instr(v, "@")
    local = F.substring(v, F.lit(1), at - 1)
    return F.lit(True), F.concat(permute_marks(local, key, "email"), F.substring(v, at, F.length(v)))


MOST_WORDS = 19        # a card has at most 19 digits; an IBAN candidate has at most nine groups
LONG, FEW_WORDS = 40, 6    # only groups of four, but for the first and last, make a longer candidate: a card is five of them, or less
LIST = 256


def _parts(v: Column, key: str) -> Column:
    """``v`` cut into strings: a card or IBAN candidate around its valid values, leftmost and longest first.

    From each word at most ``MOST_WORDS`` words are tried, so the work grows with the length of the candidate."""
    def searched(words):
        """Starts (from 1) and numbers of words of every valid value, leftmost and longest first."""
        size = F.size(words)

        def valid(u):
            return F.when(u.rlike("^[0-9]"), (u.rlike(_CARD) | (u == v)) & card(u, key)[0]) \
                .otherwise(u.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$") & iban(u, key)[0])

        def from_word(i):
            most = F.least(size - i + 1, F.when(size > LONG, FEW_WORDS).otherwise(MOST_WORDS))
            lengths = F.sequence(most, F.lit(1), F.lit(-1))
            return F.transform(F.filter(lengths, lambda n: valid(_value(words, i, n))), lambda n: F.struct(i.alias("i"), n.alias("n")))
        return F.flatten(F.transform(F.sequence(F.lit(1), size), from_word))

    kind = "array<struct<i:int,n:int>>"

    def add(acc, x):
        """Take ``x`` unless it begins inside what was taken; the list grows in pieces of LIST, so that few are copied."""
        full = F.size(acc["part"]) >= LIST
        taken = F.struct(F.when(full, F.concat(acc["full"], F.array(acc["part"]))).otherwise(acc["full"]).alias("full"),
                         F.when(full, F.array(x)).otherwise(F.concat(acc["part"], F.array(x))).alias("part"), (x["i"] + x["n"]).alias("at"))
        return F.when(x["i"] >= acc["at"], taken).otherwise(acc)

    start = F.struct(F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("part"), F.lit(1).alias("at"))

    def woven(words):
        chosen = F.aggregate(searched(words), start, add, lambda acc: F.concat(F.flatten(acc["full"]), acc["part"]))

        def cut(taken):
            end = lambda k: F.coalesce(F.get(taken, k)["i"] + F.get(taken, k)["n"], F.lit(1))       # noqa: E731
            gap = lambda k, to: F.concat(_separator(words, end(k) - 1), F.array_join(F.slice(words, end(k), to - end(k)), ""))
            both = F.transform(taken, lambda x, k: F.array(gap(k - 1, x["i"]), _value(words, x["i"], x["n"])))
            return F.concat(F.flatten(both), F.array(gap(F.size(taken) - 1, F.size(words) + 1)))
        return _let(chosen, cut)

    either = "|".join(f"(?:{PATTERNS[k]})" for k in ("iban", "card"))
    return F.when(v.rlike(f"^(?:{either})$"), _let(F.regexp_extract_all(v, F.lit("[^ -]+[ -]?"), F.lit(0)), woven)).otherwise(F.array(v))


def _value(words: Column, i: Column, n: Column) -> Column:
    """``n`` words from the ``i``-th; each word has the separator behind it, the last one's is left out."""
    return F.regexp_replace(F.array_join(F.slice(words, i, n), ""), "[ -]$", "")


def _separator(words: Column, i: Column) -> Column:
    """The separator behind the ``i``-th word; the empty string for none, and for no word."""
    return F.when(i < 1, F.lit("")).otherwise(F.regexp_extract(F.get(words, i - 1), "[ -]$", 0))


MAKERS = {"email": email, "iban": iban, "phone": phone, "ssn": ssn, "date": date, "ip": ip, "card": card}


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", found_col: str = "pii_found") -> DataFrame:
    """``docs`` with the text's personal values replaced, and ``found_col`` = array of (kind, value, pseudonym)."""
    text = F.col(text_col)

    def replaced(v):
        out = F.struct(F.lit("").alias("kind"), v.alias("value"), v.alias("pseudonym"))
        for kind in reversed(KINDS):
            ok, new = MAKERS[kind](v, key)
            hit = F.struct(F.lit(kind).alias("kind"), v.alias("value"), new.alias("pseudonym"))
            none = F.struct(F.lit("").alias("kind"), v.alias("value"), v.alias("pseudonym"))
            out = F.when(v.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(ok, hit).otherwise(none)).otherwise(out)
        return out

    lines = "__pii_lines"
    while lines in docs.columns:
        lines += "_"
    # no value spans lines, and each needs a digit or an @: only lines with one meet the expression, the others pass
    hot = lambda x: x.rlike("[0-9@]")                                                           # noqa: E731
    kind = "array<struct<kind:string,value:string,pseudonym:string>>"
    none = F.array().cast(kind)

    def read(line):
        values = F.when(hot(line), F.regexp_extract_all(line, F.lit(ANY), F.lit(0)))
        values = F.transform(values, lambda v: F.transform(_parts(v, key), replaced))
        return F.struct(line.alias("line"), F.coalesce(values, F.array().cast(f"array<{kind}>")).alias("values"))

    def written(x):
        # line = rest[0] value[0] rest[1] value[1] ... rest[n]
        woven = F.transform(F.split(x["line"], ANY, -1), lambda r, i: F.concat(r, F.coalesce(F.array_join(F.get(x["values"], i)["pseudonym"], ""), F.lit(""))))
        return F.when(F.size(x["values"]) == 0, x["line"]).otherwise(F.array_join(woven, ""))

    df = docs.withColumn(lines, F.when(hot(text), F.transform(F.split(text, "\n", -1), read)))
    found = F.filter(F.flatten(F.transform(lines, lambda x: F.flatten(x["values"]))), lambda v: v["kind"] != "")
    changed = F.when(F.col(lines).isNull(), text).otherwise(F.array_join(F.transform(lines, written), "\n"))
    return df.withColumn(text_col, changed).withColumn(found_col, F.coalesce(found, none)).drop(lines)


@query("op9_pii")
def op9_pii(spark, sf_dir):
    """doc_id, the whole text with pseudonyms, and how many values of each kind were replaced."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, key=KEY)

    def count(kind):
        return F.size(F.filter("pii_found", lambda x: x["kind"] == kind)).alias(f"n_{kind}")

    return out.select("doc_id", "text", F.size("pii_found").alias("n_found"), *[count(k) for k in KINDS])
