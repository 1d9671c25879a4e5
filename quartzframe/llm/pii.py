"""Format-preserving Feistel pseudonyms for personal data and secrets, in DataFrame expressions only.

Found and replaced, in this order at one place: e-mail addresses, named secrets, access keys and tokens, bank accounts
(IBAN), IP addresses of both versions, ISO and numeric dates, phone numbers, card numbers and social security numbers.
Numbers are validated (octets, calendar, check digits, issuer digit, number plan); what fails is no personal data and
stays. A replacement is a keyed permutation of the value within its format: an alternating Feistel network over
Z_a x Z_b (numbers and dates) or over the two halves of a string with characters moved within their class (addresses
and keys, of any length). So equal values get equal pseudonyms in all documents, different values different ones, and
a pseudonym passes the validation that its value passed. A value counts as it is written: two spellings of one address
are two values.

Each row depends on its own text only: no join, no shuffle. The key has no default: it belongs in a secret store. It is
part of the plan, so plans are as secret as the key.

Rows: a null text stays null with n_pii 0; an empty text stays empty. Texts are searched whole, whatever their length.
Repeated rows are replaced alike and stay. A null doc_id is kept. An empty table gives no rows. Extra columns are
ignored by ``pseudonymize`` and kept by ``replaced``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzframe.llm.common import let

ROUNDS = 8
#: Characters that one digest of a key stream moves.
DIGEST_CHARS = 32
#: What each kind looks like. No alternative starts inside a longer number or word.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
NAMED_SECRET = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:\s{0,3}[=:]\s{0,3}\"[^\"\s]{6,}+\"|[=:][^\s\"',;]{6,}+)"
NAMED_PREFIX = r"^[A-Za-z_-]+\s*[=:]\s*\"?"
ACCESS_KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
BEARER = r"(?<![A-Za-z])[Bb]earer\s{1,3}(?=[A-Za-z._~+/=-]*+[0-9])[A-Za-z0-9._~+/=-]{16,}+"
WEB_TOKEN = r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
PLATFORM_TOKEN = r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_[A-Za-z0-9_]{30,}+|glpat-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|sk-(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+)"
TOKEN_PREFIX = r"^(?:AKIA|[Bb]earer\s+|eyJ|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk-)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:]|\.[0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])"
NUMERIC_DATE = r"(?<![0-9/.])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
LOCAL_PHONE = r"(?<![0-9+(-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}(?![0-9-])"
#: Issuers 2221 to 2720 have 16 digits. The group numbers are those within ANY, whose other patterns capture nothing.
TWO_SERIES = "(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)"
CARD = (
    r"(?<![0-9A-Za-z-])(?:[3-6](?:[0-9]{12,18}|[0-9]{3}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{3}([ -])[0-9]{6}\3[0-9]{5})"
    rf"|{TWO_SERIES}(?:[0-9]{{12}}|([ -])[0-9]{{4}}\4[0-9]{{4}}\4[0-9]{{4}}))(?![0-9A-Za-z]|-[0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
ANY = "(" + "|".join([EMAIL, NAMED_SECRET, ACCESS_KEY, BEARER, WEB_TOKEN, PLATFORM_TOKEN, IBAN, IP6, IP, ISO_DATE, NUMERIC_DATE, PHONE, LOCAL_PHONE, CARD, SSN]) + ")"
#: A text without any of these characters has nothing to replace.
HINT = r"[0-9@=:]|eyJ|xox"
KINDS = ("email", "secret", "iban", "ip", "date", "phone", "card", "ssn")
#: Dates of the years 1500 to 2299 are permuted within their two centuries: 1900-01-01 as a day number, the days of
#: four and of the first two centuries from there, and factors of the days of the first and of the second two.
_FIRST, _FOUR_CENTURIES, _TWO_CENTURIES = -25567, 146097, 73049
_FIRST_HALF, _SECOND_HALF = (17, 4297), (184, 397)


def _div(a: Column, b) -> Column:
    """Whole quotient of two longs, without a detour through doubles."""
    return F.call_function("div", a.cast("long"), b if isinstance(b, Column) else F.lit(b).cast("long"))


def _prf(key: str, tag: str, i: Column, half: Column, modulus: Column) -> Column:
    """A keyed pseudo-random number below modulus."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def _permute(value: Column, a: Column, b: Column, key: str, tag: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    value, a, b = value.cast("long"), a.cast("long"), b.cast("long")
    pair = lambda x, y: F.struct(x.cast("long").alias("l"), y.cast("long").alias("r"))
    step = lambda s, i: F.when(i % 2 == 0, pair((s["l"] + _prf(key, tag, i, s["r"], a)) % a, s["r"])).otherwise(pair(s["l"], (s["r"] + _prf(key, tag, i, s["l"], b)) % b))
    rounds = F.array(*map(F.lit, range(ROUNDS)))
    return F.aggregate(rounds, pair(_div(value, b), value % b), step, lambda s: s["l"] * b + s["r"])


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), (n + 1).cast("int"))


def _permute_digits(digits: Column, key: str, tag: str) -> Column:
    """Up to 18 digits to as many digits."""
    n = F.length(digits)
    half = _div(n, 2)
    moved = _permute(digits.cast("long"), _power(half), _power(n - half), key, tag)
    return F.lpad(moved.cast("string"), n, "0")


def _shift(text: Column, seed: Column, hexadecimal: Column) -> Column:
    """Each character moved within its class by a byte of the key stream: digests of seed and the number of a block."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))  # substrings would walk a long text again and again

    def one(c: Column, i: Column, digests: Column) -> Column:
        digest = F.get(digests, _div(i, DIGEST_CHARS).cast("int"))
        k = F.conv(F.substring(digest, (i % DIGEST_CHARS * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        turn = lambda alphabet: F.substring(F.lit(alphabet), ((F.instr(F.lit(alphabet), c) - 1 + k) % len(alphabet) + 1).cast("int"), F.lit(1))
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), turn("0123456789abcdef"))
            .when(c.rlike("[0-9]"), turn("0123456789"))
            .when(c.rlike("[a-f]"), turn("abcdef"))
            .when(c.rlike("[g-z]"), turn("ghijklmnopqrstuvwxyz"))
            .when(c.rlike("[A-F]"), turn("ABCDEF"))
            .when(c.rlike("[G-Z]"), turn("GHIJKLMNOPQRSTUVWXYZ"))
            .otherwise(c)
        )

    blocks = F.sequence(F.lit(0), _div(F.length(text), DIGEST_CHARS))
    digests = let(seed, lambda x: F.transform(blocks, lambda b: F.sha2(F.concat_ws("|", x, b.cast("string")), 256)))
    return let(digests, lambda d: F.array_join(F.transform(characters, lambda c, i: one(c, i, d)), ""))


def _permute_text(text: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the texts with the same classes of characters at the same places. Letters up to f and
    those after it are two classes, so no other text becomes one of hexadecimal digits only."""
    return let(text, lambda t: let(t.rlike("^[0-9a-f]+$"), lambda x: _feistel_text(t, x, key, tag)))


def _feistel_text(text: Column, hexadecimal: Column, key: str, tag: str) -> Column:
    half = (F.length(text) / 2).cast("int")
    pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))
    seed = lambda i, other: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), F.length(text).cast("string"), i.cast("string"), other), 256)
    step = lambda s, i: F.when(i % 2 == 0, pair(_shift(s["l"], seed(i, s["r"]), hexadecimal), s["r"])).otherwise(pair(s["l"], _shift(s["r"], seed(i, s["l"]), hexadecimal)))
    start = pair(F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text)))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: F.concat(s["l"], s["r"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(text: Column, digits: Column) -> Column:
    """text with its digits replaced by digits, in order."""
    nth = lambda i: F.length(_digits(F.substring(text, F.lit(1), i)))
    one = lambda i: F.when(F.substring(text, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, nth(i), F.lit(1))).otherwise(F.substring(text, i, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits that stand left of a check digit."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn(digits) % 10) % 10).cast("string")


def _email(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(.*)\.[A-Za-z]+$", 1)
    return let(head, lambda h: F.concat(_permute_text(h, key, "email"), F.substring(m, F.length(h) + 1, F.length(m))))


def _secret(m: Column, key: str) -> Column:
    token = F.regexp_extract(m, TOKEN_PREFIX, 0)
    prefix = F.when(m.rlike(f"^(?:{NAMED_SECRET})$") | (token == ""), F.regexp_extract(m, NAMED_PREFIX, 0)).otherwise(token)
    rest = lambda p: F.substring(m, F.length(p) + 1, F.length(m))
    value = lambda p: F.when(rest(p).endswith('"'), F.concat(_permute_text(F.regexp_replace(rest(p), '"$', ""), key, "secret"), F.lit('"'))).otherwise(_permute_text(rest(p), key, "secret"))
    return let(prefix, lambda p: F.concat(p, value(p)))


def _remainder_97(characters: Column) -> Column:
    """Of the number that characters stand for, A as 10 to Z as 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    add = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.regexp_extract_all(characters, F.lit("(?s)."), F.lit(0)), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    """The country stays, the check digits follow. Spaces are put back where they were."""
    bare = F.regexp_replace(m, " ", "")
    country, own = F.substring(m, 1, 2), lambda b: F.substring(b, F.lit(5), F.length(b))
    valid = lambda b: (_remainder_97(F.concat(own(b), F.substring(b, 1, 4))) == 1) & F.length(b).between(15, 34)
    check = lambda o: F.lpad((98 - _remainder_97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0")
    made = lambda b: let(let(own(b), lambda t: _feistel_text(t, F.lit(False), key, "iban")), lambda o: F.concat(country, check(o), o))
    spaced = lambda x: F.when(m.contains(" "), F.regexp_replace(x, "(.{4})(?=.)", "$1 ")).otherwise(x)
    return let(bare, lambda b: F.when(valid(b), let(made(b), spaced)).otherwise(m))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    moved = _permute(number, F.lit(65536), F.lit(65536), key, "ip")
    back = lambda v: F.concat_ws(".", *(F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))
    old = F.when(F.exists(octets, lambda x: x > 255), m).otherwise(let(moved, back))
    return F.when(m.contains(":"), _permute_text(m, key, "ip6")).otherwise(old)


def _date(m: Column, key: str) -> Column:
    """Kept as it is if no calendar has it. With slashes the month comes first if it can; with dots the day."""
    swap = m.contains("/") & (F.substring(m, 1, 2).cast("int") <= 12)
    part = lambda at, n: F.substring(m, at, n)
    iso = F.when(m.contains("-"), m).when(swap, F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))).otherwise(F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)))
    days = F.when(iso.rlike(r"^(?:1[5-9]|2[0-2])"), F.unix_date(F.try_to_date(iso, "yyyy-MM-dd")))
    start = lambda d: d - F.pmod(d - _FIRST, F.lit(_FOUR_CENTURIES))
    later = lambda d: start(d) + _TWO_CENTURIES
    first_half = lambda d: start(d) + _permute(d - start(d), *map(F.lit, _FIRST_HALF), key, "date")
    second_half = lambda d: later(d) + _permute(d - later(d), *map(F.lit, _SECOND_HALF), key, "later date")
    move = lambda d: F.when(d < later(d), first_half(d)).otherwise(second_half(d))
    show = lambda d: F.date_format(F.date_from_unix_date(d.cast("int")), "yyyy-MM-dd")
    of = lambda s, at, n: F.substring(s, at, n)
    numeric = lambda s, one, two: F.concat(of(s, one, 2), part(3, 1), of(s, two, 2), part(6, 1), of(s, 1, 4))
    form = lambda s: F.when(m.contains("-"), s).when(swap, numeric(s, 6, 9)).otherwise(numeric(s, 9, 6))
    return let(days, lambda d: F.when(d.isNull(), m).otherwise(let(show(move(d)), form)))


def _phone(m: Column, key: str) -> Column:
    """The country code stays. Ten digits of the North American plan keep to its rules, with or without +1."""
    code = F.when(m.startswith("+1"), F.lit("+1")).otherwise(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])|^\+[0-9]{2}", 0))
    digits = lambda c: _digits(F.substring(m, F.length(c) + 1, F.length(m)))
    plan = lambda d: (F.length(d) == 10) & d.rlike("^[2-9][0-9]{2}[2-9]")
    number = lambda d: (F.substring(d, 1, 3).cast("long") - 200) * 8_000_000 + (F.substring(d, 4, 3).cast("long") - 200) * 10_000 + F.substring(d, 7, 4).cast("long")
    back = lambda v: F.concat((_div(v, 8_000_000) + 200).cast("string"), (_div(v, 10_000) % 800 + 200).cast("string"), F.lpad((v % 10_000).cast("string"), 4, "0"))
    american = lambda c, d: plan(d) & c.isin("", "+1")
    moved = lambda c, d: F.when(american(c, d), let(_permute(number(d), F.lit(80_000), F.lit(80_000), key, "phone"), back)).otherwise(_permute_digits(d, key, "phone"))
    fill = lambda c, d: F.concat(c, _refill(F.substring(m, F.length(c) + 1, F.length(m)), moved(c, d)))
    return let(code, lambda c: let(digits(c), lambda d: F.when((F.length(d) < 6) | (F.length(d) > 15), m).otherwise(fill(c, d))))


def _card(m: Column, key: str) -> Column:
    """The issuer digit stays, issuers 2221 to 2720 stay in their range, the check digit follows."""
    body = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)
    valid = lambda d: _check_digit(body(d)) == F.substring(d, -1, 1)
    number = lambda d: (F.substring(d, 1, 4).cast("long") - 2221) * 10**11 + F.substring(d, 5, 11).cast("long")
    back = lambda v: F.concat((_div(v, 10**11) + 2221).cast("string"), F.lpad((v % 10**11).cast("string"), 11, "0"))
    two_series = lambda d: let(_permute(number(d), F.lit(5 * 10**6), F.lit(10**7), key, "card 2"), back)
    others = lambda d: F.concat(F.substring(d, 1, 1), _permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
    payload = lambda d: F.when(d.startswith("2"), two_series(d)).otherwise(others(d))
    new = lambda d: let(payload(d), lambda p: F.concat(p, _check_digit(p)))
    return let(_digits(m), lambda d: F.when(valid(d), let(new(d), lambda n: _refill(m, n))).otherwise(m))


def _ssn(m: Column, key: str) -> Column:
    """Area 001-665 and 667-899, group 01-99, serial 0001-9999: 898 * 99 * 9999 numbers."""
    part = lambda a, n: F.substring(m, a, n).cast("long")
    valid = ~part(1, 3).isin(0, 666) & (part(1, 3) < 900) & (part(5, 2) > 0) & (part(8, 4) > 0)
    area = F.when(part(1, 3) > 666, part(1, 3) - 2).otherwise(part(1, 3) - 1)
    number = (area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1
    moved = _permute(number, F.lit(898 * 99), F.lit(9999), key, "ssn")
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    new_area = lambda v: _div(v, 99 * 9999)
    back = lambda v: F.concat_ws("-", pad(F.when(new_area(v) >= 665, new_area(v) + 2).otherwise(new_area(v) + 1), 3), pad(_div(v, 9999) % 99 + 1, 2), pad(v % 9999 + 1, 4))
    return F.when(valid, let(moved, back)).otherwise(m)


def _kind(m: Column) -> Column:
    """The kind of a match; at one place the first pattern of ANY that fits decides."""
    exact = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@") & exact(EMAIL), F.lit("email"))
        .when(exact(IP) | exact(IP6), F.lit("ip"))
        .when(exact(IBAN), F.lit("iban"))
        .when(m.rlike("^[A-Za-z]"), F.lit("secret"))
        .when(exact(ISO_DATE) | exact(NUMERIC_DATE), F.lit("date"))
        .when(exact(PHONE) | exact(LOCAL_PHONE), F.lit("phone"))
        .when(exact(SSN), F.lit("ssn"))
        .otherwise(F.lit("card"))
    )


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    made = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "card": _card, "ssn": _ssn}
    out = F.when(kind == "email", made["email"](m, key))
    for name in KINDS[1:]:
        out = out.when(kind == name, made[name](m, key))
    return out.otherwise(m)


def scan(text: Column, key: str) -> Column:
    """struct(text, kinds): text with its pseudonyms, and the kind of each value that was replaced."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    swap = lambda m: let(_kind(m), lambda k: F.struct(k.alias("kind"), m.alias("old"), _pseudonym(m, k, key).alias("new")))
    pieces = F.split(text, ANY, -1)
    found = F.transform(matches, swap)
    weave = lambda s: F.struct(
        F.array_join(F.zip_with(pieces, F.transform(s, lambda x: x["new"]), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "").alias("text"),
        F.transform(F.filter(s, lambda x: x["old"] != x["new"]), lambda x: x["kind"]).alias("kinds"),
    )
    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike(HINT) & text.rlike(ANY), let(found, weave)).otherwise(nothing)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_pii and, for each kind, n_<kind>: how many values were replaced."""
    rows = docs.select("doc_id", let(scan(F.col("text"), key), lambda s: s).alias("s"))
    count = lambda k: F.size(F.filter(F.col("s.kinds"), lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", F.col("s.text").alias("text"), F.size("s.kinds").cast("long").alias("n_pii"), *map(count, KINDS))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """docs with the pseudonyms in its texts; n_chars, if there, follows the text."""
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("d")).select("d", scan(F.col("d.text"), key)["text"].alias("new_text"))
    chars = lambda c: F.when(F.col("new_text").eqNullSafe(F.col("d.text")), F.col("d.n_chars")).otherwise(F.length("new_text")).cast(docs.schema[c].dataType)
    made = {"text": lambda c: F.col("new_text"), "n_chars": chars}
    return rows.select(*(made.get(c, lambda c: F.col("d")[c])(c).alias(c) for c in names))
