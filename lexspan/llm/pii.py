"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Found values are validated (dates by the calendar, cards by the Luhn sum, addresses by their octets, social security numbers by
their areas), mapped to a pair of numbers (left, right) with left < a and right < b, permuted by rounds of
`left = (left + F(right)) mod a` and `right = (right + F(left)) mod b`, and written back in the format they had. F is a keyed
SHA-256, so the map is a permutation of the format's values: equal values stay equal in all documents, different ones different.

  card   its first digit stays, the middle digits are permuted, the Luhn digit is computed anew; separators stay
  phone  all ten digits are permuted, brackets and separators stay, as does +1; an area code or exchange that can be assigned (first digit
         2 to 9) becomes such a one, another stays another: a number that cannot be dialled is still hidden, and no valid one becomes invalid
  ip     the four octets, none with a leading zero, so that no two ways of writing become one
  ssn    the valid areas, groups and serials
  date   the 146,097 days from 1800-01-01 to 2199-12-31; y-m-d, d.m.y and m/d/y stay as they are
  email  letters and digits permuted within their kind, each letter alike in either case, but for the last part of the domain; parts have the lengths that addresses
         allow (64 before the sign, 63 a label, eight labels), which also bounds the matching: a text of any length takes linear time

Card numbers of each length are permuted for themselves; all other formats have one permutation, however their values are written. The key
is the caller's: whoever has it can undo the pseudonyms.
Dates outside those years and values that fail their check stay as they are. Everything is DataFrame functions.

Cases: a null text is the empty one; a null doc_id is kept; repeated rows are treated alike; an empty table gives no rows; other
columns are ignored; a permuted value may by chance equal the value itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.common import id_text

# The formats, as Java and RE2 read them; tried in this order.
FORMATS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "date": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{2}\.[0-9]{2}\.[0-9]{4}\b|\b[0-9]{2}/[0-9]{2}/[0-9]{4}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|\b[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}\b",
    "card": r"\b(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})\b",
}
PATTERN = "|".join(f"(?:{p})" for p in FORMATS.values())
DATES = (("^[0-9]{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "MM/dd/yyyy"))
ROUNDS = 8
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _long(x: Column) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))


def _luhn(digits: Column, even_doubled: Column) -> Column:
    """The Luhn sum of digits, doubling those at 0-based positions of the parity given."""
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == even_doubled, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), _long(d).cast("int") + 1)).otherwise(_long(d).cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def _date(x: Column) -> Column:
    out = F.lit(None).cast("date")
    for shape, form in reversed(DATES):
        out = F.when(F.rlike(x, F.lit(shape)), F.try_to_timestamp(x, F.lit(form)).cast("date")).otherwise(out)
    return F.when(out.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), out)


def kind_of(x: Column) -> Column:
    """The format of a match that passes its check, else null."""
    octets = F.split(x, r"\.")
    d = _digits(x)
    valid = {
        "email": F.lit(True),
        "date": _date(x).isNotNull(),
        "ip": F.forall(octets, lambda o: (_long(o) <= 255) & ~F.rlike(o, F.lit("^0[0-9]"))),
        "ssn": ~F.rlike(x, F.lit("^(000|666|9..)|^...-00|-0000$")),
        "phone": F.lit(True),
        "card": _luhn(d, F.length(d) % 2) % 10 == 0,
    }
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS.items()):
        out = F.when(F.rlike(x, F.lit(f"^(?:{pattern})$")), F.when(valid[name], F.lit(name))).otherwise(out)
    return out


def _prf(key: str, kind: Column, own: Column, turn: Column, value: Column) -> Column:
    said = F.concat_ws("|", F.lit(key), kind, own.cast("string"), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("bigint")


def feistel(key: str, x: Column) -> Column:
    """x: struct<kind, n, a, b, left, right>; the permuted struct<l, r>. What tells the permutations of a kind apart is hashed with the
    value: the length of a card number, the size of a phone number's halves."""
    own = F.when(x["kind"] == "card", x["n"].cast("bigint")).when(x["kind"] == "phone", 2 * x["a"] + x["b"]).otherwise(F.lit(0).cast("bigint"))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        f = _prf(key, x["kind"], own, i, F.when(even, acc["r"]).otherwise(acc["l"]))
        return F.struct(F.when(even, F.pmod(acc["l"] + f, x["a"])).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(F.pmod(acc["r"] + f, x["b"])).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x["left"].alias("l"), x["right"].alias("r")), turn)


def _half(code: Column) -> Column:
    """How many values half a phone number has: an area code or exchange of the same kind, and two digits of the line."""
    return F.when(code >= 200, F.lit(80000)).otherwise(F.lit(20000))


def _code(code: Column) -> Column:
    return code - F.when(code >= 200, 200).otherwise(0)


def numbered(m: Column, kind: Column) -> Column:
    """struct<m, kind, n, a, b, left, right> of a validated match."""
    d = _digits(m)
    ten = F.right(d, F.lit(10))
    octets = F.split(m, r"\.")
    octet = lambda i: _long(F.get(octets, F.lit(i)))
    days = F.datediff(_date(m), F.lit("1800-01-01").cast("date")).cast("bigint")
    n = F.length(d)
    middle = F.substring(d, F.lit(2), n - 2)
    half = F.floor((n - 2) / 2).cast("int")
    area = _long(F.substring(d, 1, 3))
    area = area - 1 - F.when(area > 666, 1).otherwise(0)
    part = lambda s, a, b: F.substring(s, F.lit(a), F.lit(b))
    by = {
        "card": (_power(half), _power(n - 2 - half), _long(F.substring(middle, F.lit(1), half)), _long(F.substring(middle, half + 1, n))),
        "phone": (_half(_long(part(ten, 1, 3))), _half(_long(part(ten, 4, 3))), _code(_long(part(ten, 1, 3))) * 100 + _long(part(ten, 7, 2)), _code(_long(part(ten, 4, 3))) * 100 + _long(part(ten, 9, 2))),
        "ip": (F.lit(65536), F.lit(65536), octet(0) * 256 + octet(1), octet(2) * 256 + octet(3)),
        "ssn": (F.lit(898 * 99), F.lit(9999), area * 99 + _long(part(d, 4, 2)) - 1, _long(part(d, 6, 4)) - 1),
        "date": (F.lit(189), F.lit(773), F.floor(days / 773), days % 773),
    }
    pick = lambda i: F.coalesce(*(F.when(kind == k, v[i].cast("bigint")) for k, v in by.items()), F.lit(1).cast("bigint"))
    return F.struct(m.alias("m"), kind.alias("kind"), n.alias("n"), pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("left"), pick(3).alias("right"))


def _refill(m: Column, digits: Column) -> Column:
    """m with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.left(m, i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.rlike(F.substring(m, i, F.lit(1)), F.lit("[0-9]")), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(m, i, F.lit(1)))), "")


def _email(key: str, m: Column) -> Column:
    """A Feistel network on the two halves of the address's characters: each turn shifts the letters and digits of one half, within their kind, by a
    keyed hash of the other."""
    body = F.regexp_replace(m, r"\.[A-Za-z]+$", "")
    half = F.floor(F.length(body) / 2).cast("int")

    def shifted(text: Column, other: Column, turn: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.length(body).cast("string"), turn.cast("string"), F.lower(other)), 256)

        def one(i: Column) -> Column:
            c = F.substring(text, i, F.lit(1))
            by = F.conv(F.substring(stream, F.pmod(i * 2, F.lit(64)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
            out = c
            for letters in (_LOWER, _UPPER, _DIGIT):
                place = F.instr(F.lit(letters), c)
                out = F.when((F.length(c) > 0) & (place > 0), F.substring(F.lit(letters), F.pmod(place - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise(F.lit(""))

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i)).alias("r"))

    start = F.struct(F.substring(body, F.lit(1), half).alias("l"), F.substring(body, half + 1, F.length(body)).alias("r"))
    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"])), F.regexp_extract(m, r"\.[A-Za-z]+$", 0))


def _written(key: str, x: Column, f: Column) -> Column:
    """The permuted value (f: struct<l, r>) in the format of x.m."""
    m, n = x["m"], x["n"]
    two = lambda v, w: F.lpad(v.cast("string"), w, "0")
    half = F.floor((n - 2) / 2).cast("int")
    payload = F.concat(F.left(_digits(m), F.lit(1)), F.lpad(f["l"].cast("string"), half, F.lit("0")), F.lpad(f["r"].cast("string"), n - 2 - half, F.lit("0")))
    # in the whole number the digits doubled are every second one before the last
    check = F.pmod(-_luhn(payload, F.pmod(F.length(payload) + 1, F.lit(2))), F.lit(10))
    code = lambda v, size: two((F.floor(v / 100) + F.when(size == 80000, 200).otherwise(0)), 3)
    phone = F.concat(code(f["l"], x["a"]), code(f["r"], x["b"]), two(f["l"] % 100, 2), two(f["r"] % 100, 2))
    area = F.floor(f["l"] / 99) + 1
    area = area + F.when(area >= 666, 1).otherwise(0)
    date = F.date_add(F.lit("1800-01-01").cast("date"), (f["l"] * 773 + f["r"]).cast("int"))
    said = F.lit(None).cast("string")
    for shape, form in reversed(DATES):
        said = F.when(F.rlike(m, F.lit(shape)), F.date_format(date, form)).otherwise(said)
    octets = F.concat_ws(".", *(v.cast("string") for v in (F.floor(f["l"] / 256), f["l"] % 256, F.floor(f["r"] / 256), f["r"] % 256)))
    ssn = F.concat_ws("-", two(area, 3), two(f["l"] % 99 + 1, 2), two(f["r"] + 1, 4))
    return (
        F.when(x["kind"].isNull(), m)
        .when(x["kind"] == "card", _refill(m, F.concat(payload, check.cast("string"))))
        .when(x["kind"] == "phone", _refill(m, F.concat(F.left(_digits(m), F.length(_digits(m)) - 10), phone)))
        .when(x["kind"] == "ip", octets)
        .when(x["kind"] == "ssn", ssn)
        .when(x["kind"] == "date", said)
        .otherwise(_email(key, m))
    )


def _is(kind: str):
    return lambda x: x["kind"] == kind


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with its personal data replaced, and the number of values replaced by kind (n_email ...)."""
    shape = "array<struct<m:string,kind:string,n:int,a:bigint,b:bigint,left:bigint,right:bigint>>"
    hits = F.transform(F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))), lambda x: numbered(x["m"], x["kind"]))
    found = id_text(docs).withColumn("hits", F.when(F.rlike("text", F.lit("[0-9@]")), hits.cast(shape)).otherwise(F.array().cast(shape)))
    new = F.transform(F.transform("hits", lambda x: F.struct(x.alias("x"), feistel(key, x).alias("f"))), lambda y: _written(key, y["x"], y["f"]))
    joined = F.array_join(F.transform(F.arrays_zip(F.split("text", PATTERN, -1).alias("gap"), new.alias("new")), lambda z: F.concat(z["gap"], F.coalesce(z["new"], F.lit("")))), "")
    counts = [F.size(F.filter("hits", _is(k))).cast("long").alias(f"n_{k}") for k in FORMATS]
    return found.select("doc_id", F.when(F.size("hits") > 0, joined).otherwise(F.col("text")).alias("text"), *counts)
