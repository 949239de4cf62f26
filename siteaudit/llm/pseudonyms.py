"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions alone.

Candidates are found by one pattern and validated: card numbers by their check digit, IBANs by
their remainder, IPv4 addresses by their bytes, social security numbers and phone numbers without
country code and bracketed area by the ranges of their parts, dates by the calendar; a phone
number with either of them is one whatever its digits. A valid value is permuted within its format, so it stays
valid, equal values get equal pseudonyms in every document, and the key's holder can undo it.

Two networks are used. Numbers that live in a range A * B keep two halves (a, b) and add a keyed
hash of one to the other, modulo A or B, in turn. Strings keep two halves of characters and add
keyed hashes to the characters of each half in turn, a digit staying a digit and a letter a
letter of its case. Card and IBAN bodies are permuted as strings and their check digits set anew.

Names in mail addresses and the secret parts of credentials are strings of the second kind.

Edges: a null text stays null and an empty one empty, both with no values; candidates that do
not validate stay as they are; repeated rows are treated alike; an empty table gives no rows;
other columns are kept by ``pseudonymised`` (its own are named ``kinds`` and ``pseudonyms`` and
replace columns of those names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteaudit.llm.naming import unused

KEY = "a key for tests; production passes its own"
ROUNDS = 8

# The formats that are looked for, in the order in which they are tried.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "password": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api_key)[=:])[A-Za-z0-9]{6,}",
    "hex": r"(?<=[\"'])[0-9a-f]{32,64}(?=[\"'])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9/-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}


def _one_of(*kinds: str) -> str:
    return "(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in kinds) + ")"


# The kinds in the order above, told apart by their first character before any is tried.
ANY = (
    f"{PATTERNS['hex']}|(?<![A-Za-z0-9])(?:"
    f"(?=[0-9+(]){_one_of('email', 'date', 'ip', 'ssn', 'phone', 'card')}"
    f"|(?=[A-Za-z]){_one_of('secret', 'password', 'email', 'iban')})"
)
# Every match holds or follows one of these characters, or holds the letters of a "secret".
CHEAP, LETTERS = "[0-9@=:\"']", "AKIA"
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 1900 to 2099 has 17 * 4297 days


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, tweak: str, step: Column, other: Column) -> Column:
    """A keyed hash below 2 ** 60."""
    text = F.concat(F.lit(f"{key}|{tweak}|"), step.cast("string"), F.lit("|"), other.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def permuted(a: Column, b: Column, size_a: int, size_b: int, key: str, tweak: str) -> Column:
    """struct(a, b) of the number permuted within size_a * size_b."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s, i):
        return F.when(
            i % 2 == 0,
            F.struct(((s["a"] + _hash(key, tweak, i, s["b"])) % size_a).alias("a"), s["b"].alias("b")),
        ).otherwise(
            F.struct(s["a"].alias("a"), ((s["b"] + _hash(key, tweak, i, s["a"])) % size_b).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shifted(text: Column, stream: Column) -> Column:
    """Each character moved on within its class by two hex digits of ``stream``."""

    def move(c, i, digits):
        by = F.conv(F.substr(digits, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)

        def inside(base, size):
            return F.char(F.lit(base) + (code - base + by) % size)

        return (
            F.when(code.between(48, 57), inside(48, 10))
            .when(code.between(97, 122), inside(97, 26))
            .when(code.between(65, 90), inside(65, 26))
            .otherwise(c)
        )

    return _let(
        stream, lambda digits: F.array_join(F.transform(F.split(text, ""), lambda c, i: move(c, i, digits)), "")
    )


def permuted_text(text: Column, key: str, tweak: str) -> Column:
    """The string permuted, every character within its class."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substr(text, F.lit(1), half).alias("a"), F.substr(text, half + 1, F.length(text) - half).alias("b")
    )

    def stream(step, other):
        return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), step.cast("string"), F.lit("|"), other), 512)

    def turn(s, i):
        return F.when(
            i % 2 == 0, F.struct(_shifted(s["a"], stream(i, s["b"])).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(s["a"].alias("a"), _shifted(s["b"], stream(i, s["a"])).alias("b")))

    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, start, turn, lambda s: F.concat(s["a"], s["b"]))


def _laid(digits: Column, form: Column) -> Column:
    """``digits`` put, in order, where ``form`` has letters and digits."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(
        F.split(form, ""),
        start,
        lambda s, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct(F.concat(s["out"], F.substr(digits, s["at"] + 1, F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def luhn(digits: Column) -> Column:
    """The check sum of a digit string modulo 10; 0 where the number is valid."""
    n = F.length(digits)

    def value(c, i):
        d = c.cast("int")
        return F.when((n - 1 - i) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda s, x: s + x) % 10


def mod97(iban: Column) -> Column:
    moved = F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4)))

    def step(s, c):
        code = F.ascii(c)
        return F.when(code < 65, (s * 10 + code - 48) % 97).otherwise((s * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def made(d):
        body = permuted_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")
        head = F.concat(F.substr(d, F.lit(1), F.lit(1)), body)
        check = lambda h: (10 - luhn(F.concat(h, F.lit("0")))) % 10
        return F.when(luhn(d) == 0, _laid(_let(head, lambda h: F.concat(h, check(h).cast("string"))), m))

    return _let(F.regexp_replace(m, "[ -]", ""), made)


def _iban(m: Column, key: str) -> Column:
    def made(d):
        land = F.substr(d, F.lit(1), F.lit(2))
        check = lambda b: 98 - mod97(F.concat(land, F.lit("00"), b))
        new = _let(
            permuted_text(F.substr(d, F.lit(5), F.length(d)), key, "iban"),
            lambda b: F.concat(land, F.lpad(check(b).cast("string"), 2, "0"), b),
        )
        # 98 - r reaches 2 to 98 only, so a valid number's own check digits must lie there too
        ok = (mod97(d) == 1) & F.substr(d, F.lit(3), F.lit(2)).between("02", "98") & F.length(d).between(15, 34)
        return F.when(ok, _laid(new, m))

    return _let(F.replace(m, F.lit(" "), F.lit("")), made)


def _ip(m: Column, key: str) -> Column:
    def made(p):
        new = permuted(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        shown = lambda x: F.concat_ws(
            ".", *(v.cast("string") for h in ("a", "b") for v in (F.floor(x[h] / 256), x[h] % 256))
        )
        return F.when(F.forall(p, lambda x: x < 256), _let(new, shown))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), made)


def _phone(m: Column, key: str) -> Column:
    def parts(d):
        return F.struct(
            *(F.substr(d, F.lit(s), F.lit(n)).cast("int").alias(x) for x, s, n in (("a", 1, 3), ("o", 4, 3), ("l", 7, 4)))
        )

    def moved(p):
        # Three classes of numbers, each permuted within itself, so the whole stays one to one.
        low, narrow = p["a"] < 200, (p["a"] >= 200) & (p["o"] >= 200)
        a, b = p["a"] - 200, p["o"] * 10000 + p["l"]
        new = (
            F.when(low, permuted(p["a"], b, 200, 10_000_000, key, "phone area"))
            .when(narrow, permuted(a, b - 2_000_000, 800, 8_000_000, key, "phone"))
            .otherwise(permuted(a, b, 800, 2_000_000, key, "phone office"))
        )
        made = _let(
            new,
            lambda x: F.concat(
                F.lpad((x["a"] + F.when(low, 0).otherwise(200)).cast("string"), 3, "0"),
                F.lpad((x["b"] + F.when(narrow, 2_000_000).otherwise(0)).cast("string"), 7, "0"),
            ),
        )
        lead = F.regexp_extract(m, r"^(\+1)?", 0)
        rest = F.substr(m, F.length(lead) + 1, F.length(m))
        # Without country code and brackets, only the ranges tell a phone number from other digits.
        full = m.startswith("+") | m.startswith("(")
        return F.when(narrow | full, F.concat(lead, _let(made, lambda x: _laid(x, rest))))

    digits = F.regexp_replace(F.regexp_replace(m, r"^\+1", ""), "[^0-9]", "")
    return _let(_let(digits, parts), moved)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (x.cast("int") for x in (F.split(m, "-")[k] for k in range(3)))
    at = F.when(area > 666, area - 2).otherwise(area - 1)
    new = permuted(at, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")

    def shown(x):
        back = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
        return F.concat_ws(
            "-",
            F.lpad(back.cast("string"), 3, "0"),
            F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"),
        )

    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(ok, _let(new, shown))


def _date(m: Column, key: str) -> Column:
    """Year first, or day, month and year, or month, day and year where only that is a date."""
    sign = F.when(m.contains("-"), "-").when(m.contains("."), ".").otherwise("/")
    iso = m.contains("-")

    def read(p):
        day_first = F.try_to_date(F.concat_ws("-", p[2], p[1], p[0]))
        month_first = F.try_to_date(F.concat_ws("-", p[2], p[0], p[1]))
        form = F.when(iso, "yyyy-MM-dd").when(day_first.isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")
        day = F.when(iso, F.try_to_date(m)).otherwise(F.coalesce(day_first, month_first))
        return F.struct(F.datediff(day, F.lit(FIRST_DAY).cast("date")).alias("n"), form.alias("form"))

    def made(x):
        n, form = x["n"], x["form"]
        new = permuted(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, "date")

        def shown(v):
            to = F.date_add(F.lit(FIRST_DAY).cast("date"), (v["a"] * DAYS[1] + v["b"]).cast("int"))
            text = (
                F.when(form == "yyyy-MM-dd", F.date_format(to, "yyyy-MM-dd"))
                .when(form == "dd/MM/yyyy", F.date_format(to, "dd/MM/yyyy"))
                .otherwise(F.date_format(to, "MM/dd/yyyy"))
            )
            return F.replace(text, F.lit("/"), sign)

        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), _let(new, shown))

    return _let(_let(F.split(m, "[-./]"), read), made)


def _email(m: Column, key: str) -> Column:
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), permuted_text(F.substr(m, F.lit(5), F.length(m)), key, "secret"))


def _password(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, "^[A-Za-z_]+[=:]", 0)
    return F.concat(name, permuted_text(F.substr(m, F.length(name) + 1, F.length(m)), key, "password"))


def _hex(m: Column, key: str) -> Column:
    return permuted_text(m, key, "hex")


RULES = {
    "secret": _secret,
    "password": _password,
    "hex": _hex,
    "email": _email,
    "iban": _iban,
    "date": _date,
    "ip": _ip,
    "ssn": _ssn,
    "phone": _phone,
    "card": _card,
}
# What tells the kind of a match, which has no surroundings any more.
_SHAPE = {k: "^(?:" + p + ")$" for k, p in PATTERNS.items()} | {"hex": "^[0-9a-f]{32,64}$"}


def replaced(m: Column, key: str) -> Column:
    """struct(kind, value) of a match; value is null where the match does not validate."""
    kind = F.lit(None).cast("string")
    for name in reversed(RULES):
        kind = F.when(m.rlike(_SHAPE[name]), F.lit(name)).otherwise(kind)

    def ruled(k):
        value = F.lit(None).cast("string")
        for name in reversed(RULES):
            value = F.when(k == name, RULES[name](m, key)).otherwise(value)
        return F.struct(k.alias("kind"), value.alias("value"), m.alias("was"))

    return _let(kind, ruled)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with permuted values in ``text``, and ``kinds`` and ``pseudonyms`` in text order
    (columns of these two names are replaced, all others stay)."""
    raw, got = unused([*docs.columns, "kinds", "pseudonyms"], "raw", "got")
    # A text without the cheap signs is passed by; only the others meet the full pattern.
    may = F.col("text").rlike(CHEAP) | F.contains(F.col("text"), F.lit(LETTERS))
    none = F.array().cast("array<string>")
    rows = docs.withColumn(
        raw, F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(none)
    ).withColumn(got, F.transform(raw, lambda m: replaced(m, key)))
    new = F.transform(got, lambda x: F.coalesce(x["value"], x["was"]))
    text = F.array_join(
        F.zip_with(F.split("text", ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""
    )
    valid = F.filter(got, lambda x: x["value"].isNotNull())
    return rows.withColumns(
        {
            "text": F.when(F.size(raw) > 0, text).otherwise(F.col("text")),
            "kinds": F.transform(valid, lambda x: x["kind"]),
            "pseudonyms": F.transform(valid, lambda x: x["value"]),
        }
    ).drop(raw, got)
