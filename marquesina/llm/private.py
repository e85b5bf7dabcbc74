"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by one pattern, validated, and permuted within their format by a keyed
Feistel network. Digit groups in a row are one match, within which valid card numbers are found
first (whole groups, 13 to 19 digits, usual groupings and then the longest first); what is left of it is searched for the other kinds: a card number becomes another valid card number, a date another date, an address in the
same block of addresses. The permutation depends on the key and the kind alone, so equal values get equal
pseudonyms in every document, different values different ones, and whoever has the key can undo it.

Everything here is DataFrame expressions; the round function is SHA-256.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.llm.common import table

ROUNDS = 8
KEY = "replace-this-key"

MONTHS = "January February March April May June July August September October November December".split()
_MONTH, _YEAR, _NO = "(?:" + "|".join([*MONTHS, *(m[:3] for m in MONTHS)]) + ")", r"(?:19|20)\d\d", r"\d{1,2}"
WRITTEN = "|".join([*(f"{_NO}{c}{_NO}{c}{_YEAR}" for c in ("/", r"\.", "-")), *(f"{_YEAR}{c}{_NO}{c}{_NO}" for c in ("/", r"\.")), f"{_NO} {_MONTH} {_YEAR}", f"{_MONTH} {_NO},? {_YEAR}"])
# Lengths of IBANs, which end one written in groups of four where other groups follow.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
GROUPED_IBAN = "|".join(f"(?:{c.replace(' ', '|')})\\d\\d(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
# What is looked for, first match wins where two start together. Numbers are not cut out of longer ones.
KINDS = {
    "email": r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "date": r"(?<![\d.-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\d-])",
    "written": rf"(?<![\w./-])(?=[\dJFMASOND])(?:{WRITTEN})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|(?=[A-Z]{{2}}\d\d )(?:{GROUPED_IBAN}))(?![A-Za-z0-9])",
    "groups": r"(?<![\d.-])\d[\d -]{11,}\d(?![\d-]|/\d|\.\d{1,4}[ .-]\d|[\w.%+-]{0,63}@)",
    "phone": r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?![\d-])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
# What may stand in digit groups beside a card number.
AMONG_GROUPS = "|".join(f"(?:{KINDS[k]})" for k in ("date", "written", "ssn", "phone"))
CARD = r"^\d(?:[ -]?\d){12,18}$"
MOST_DIGITS = 19
# Usual ways to group a card number; they go before other runs, which next to other numbers may be valid by chance.
USUAL_CARD = r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})$"
# No match is without one of these; most texts are passed over by this test alone.
HINT = r"@|\d[\d .()-]{5}|[A-Z]{2}\d\d[A-Z0-9]{11}|\d/\d|[a-z\d],? (?:19|20)\d\d"


def _digest(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """56 bits of the keyed round function."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")


def feistel(value: Column, left: Column, right: Column, key: str, tweak: Column) -> Column:
    """Permutation of 0 .. left * right - 1: alternate halves are moved by a keyed digest of the other."""
    state = F.struct(F.floor((value - value % right) / right).cast("long").alias("a"), (value % right).alias("b"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _digest(key, tweak, i, s["b"]) % left) % left).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _digest(key, tweak, i, s["a"]) % right) % right).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["a"] * right + s["b"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Another digit string of the same length (up to 18 digits)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = feistel(digits.cast("long"), _power(n - half), _power(half), key, F.concat_ws("/", tweak, n.cast("string")))
    return F.lpad(out.cast("string"), n, "0")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit not doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        d2 = F.when((n - i) % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + d2

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def permuted_card(digits: Column, key: str) -> Column:
    """Another card number: the digits before the check digit are permuted, the check digit follows from them."""
    body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
    return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))


def laid_over(original: Column, fresh: Column, pattern: str) -> Column:
    """The original with its characters that match ``pattern`` replaced, in order, by those of ``fresh``."""
    pieces = F.split(original, pattern, -1)
    return F.array_join(F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.concat(F.element_at(pieces, i), F.substring(fresh, i, F.lit(1)))), "")


def _within(value: Column, size: int, halves: tuple[int, int], key: str, tweak: Column) -> Column:
    """Permutation of 0 .. size - 1: walk the permutation of a slightly larger range until back inside."""
    step = lambda x: feistel(x, F.lit(halves[0]), F.lit(halves[1]), key, tweak)
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), step(value), lambda x, i: F.when(x < size, x).otherwise(step(x)))


def permuted_date(text: Column, key: str) -> Column:
    """Another day of 1900 to 2099, in the same notation."""
    days = F.datediff(F.to_date(text), F.lit("1900-01-01").cast("date")).cast("long")
    return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), _within(days, 73_049, (271, 270), key, F.lit("date")).cast("int")), "yyyy-MM-dd")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def written_date(text: Column) -> Column:
    """``(parts, order, day)`` of a date in words or with its year last; day before month unless only the other order is a date."""
    def read(parts: Column) -> Column:
        p = [F.element_at(parts, i) for i in (1, 2, 3)]
        month = lambda w: F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(w, 1, 3)).cast("string")
        day = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        made = lambda order, at: F.struct(parts.alias("parts"), F.lit(order).alias("order"), at.alias("day"))
        return (
            F.when(p[0].rlike("^[A-Z]"), made("mdy", day(p[2], month(p[0]), p[1])))
            .when(p[1].rlike("^[A-Z]"), made("dmy", day(p[2], month(p[1]), p[0])))
            .when(F.length(p[0]) == 4, made("ymd", day(p[0], p[1], p[2])))
            .when(day(p[2], p[1], p[0]).isNotNull(), made("dmy", day(p[2], p[1], p[0])))
            .otherwise(made("mdy", day(p[2], p[0], p[1])))
        )

    return _let(F.regexp_extract_all(text, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0)), read)


def permuted_written_date(text: Column, key: str) -> Column:
    """Another day in the notation of the original; days that can only be read month first go to such days."""
    first = F.lit("1900-01-01").cast("date")
    moved = lambda day: F.date_add(first, _within(F.datediff(day, first).cast("long"), 73_049, (271, 270), key, F.lit("date")).cast("int"))

    def write(w: Column) -> Column:
        digits_first = (w["order"] == "mdy") & F.element_at(w["parts"], 1).rlike("^[0-9]")
        fresh = F.aggregate(F.sequence(F.lit(1), F.lit(64)), moved(w["day"]), lambda d, i: F.when(digits_first & (F.dayofmonth(d) <= 12), moved(d)).otherwise(d))

        def put(day: Column) -> Column:
            def one(part: Column, i: Column) -> Column:
                what = F.substring(w["order"], i + 1, F.lit(1))
                number = F.when(what == "y", F.year(day)).when(what == "m", F.month(day)).otherwise(F.dayofmonth(day)).cast("string")
                name = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(day))
                short = (F.length(part) == 3) & (part != "May")
                return F.when(part.rlike("^[A-Z]"), F.when(short, F.substring(name, 1, 3)).otherwise(name)).otherwise(F.when(F.length(part) == 2, F.lpad(number, 2, "0")).otherwise(number))

            marks = F.split(text, "[0-9A-Za-z]+", -1)
            return F.array_join(F.zip_with(marks, F.transform(w["parts"], one), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

        return _let(fresh, put)

    return _let(written_date(text), write)


def permuted_address(text: Column, key: str) -> Column:
    """Another IPv4 address; the four numbers permute as one 32-bit value."""
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    out = feistel(value, F.lit(65_536), F.lit(65_536), key, F.lit("ip"))
    return F.concat_ws(".", *[(F.floor(F.shiftright(out, s)) % 256).cast("string") for s in (24, 16, 8, 0)])


def permuted_name(name: Column, key: str) -> Column:
    """Local part of an address: runs of up to nine letters or digits permute within their length and kind.

    Letters are a number to the base 26 (case is laid over again), digits one to the base 10, so different
    names stay different.
    """
    runs = F.regexp_extract_all(name, F.lit(r"[A-Za-z]{1,9}|[0-9]{1,9}|[^A-Za-z0-9]+"), F.lit(0))

    def one(run: Column) -> Column:
        n = F.length(run)
        lower = F.lower(run)
        half = F.floor(n / 2).cast("int")
        value = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda acc, i: acc * 26 + F.ascii(F.substring(lower, i, F.lit(1))) - 97)
        left, right = (F.pow(F.lit(26), k).cast("long") for k in (n - half, half))
        out = feistel(value, left, right, key, F.concat_ws("/", F.lit("name"), n.cast("string")))
        letters = F.array_join(
            F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda k: F.char(F.lit(97) + (F.floor(out / F.pow(F.lit(26), k)) % 26).cast("int"))), ""
        )
        cased = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
            F.substring(run, i, F.lit(1)) == F.substring(lower, i, F.lit(1)), F.substring(letters, i, F.lit(1))
        ).otherwise(F.upper(F.substring(letters, i, F.lit(1))))), "")
        return F.when(run.rlike("^[0-9]"), permuted_digits(run, key, F.lit("local"))).when(run.rlike("^[A-Za-z]"), cased).otherwise(run)

    return F.array_join(F.transform(runs, one), "")


def iban_check(country: Column, rest: Column) -> Column:
    """Check digits of an IBAN from its country and account part."""
    moved = F.concat(rest, country, F.lit("00"))

    def take(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), take)).cast("string"), 2, "0")


def permuted_iban(text: Column, key: str) -> Column:
    """Another account of the same country: the digits after the check digits permute, the check digits follow."""
    rest = F.substring(text, F.lit(5), F.length(text))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    head = F.greatest(F.length(digits) - 18, F.lit(0))
    moved = F.when(F.length(digits) < 2, digits).otherwise(
        F.concat(
            F.when(head > 1, permuted_digits(F.substring(digits, F.lit(1), head), key, F.lit("iban-head"))).otherwise(F.substring(digits, F.lit(1), head)),
            permuted_digits(F.substring(digits, head + 1, F.length(digits)), key, F.concat(F.lit("iban"), F.substring(text, 1, 2))),
        )
    )
    account = laid_over(rest, moved, "[0-9]")
    return F.concat(F.substring(text, 1, 2), iban_check(F.substring(text, 1, 2), account), account)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def kind_of(match: Column) -> Column:
    """Kind of a match that is valid, else null: IBAN checksums, address and date ranges."""
    is_a = {k: match.rlike("^(?:" + re.sub(r"^\(\?<![^)]*\)", "", p) + ")$") for k, p in KINDS.items() if k != "groups"}
    account = F.replace(match, F.lit(" "), F.lit(""))
    octets = F.forall(F.split(match, r"\."), lambda x: x.cast("int") < 256)
    return (
        F.when(is_a["email"], F.lit("email"))
        .when(is_a["date"], F.when(F.try_to_date(match, "yyyy-MM-dd").isNotNull(), F.lit("date")))
        .when(is_a["written"], F.when(written_date(match)["day"].isNotNull(), F.lit("date")))
        .when(is_a["ssn"], F.when(~match.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(is_a["ip"], F.when(octets, F.lit("ip")))
        .when(is_a["iban"], F.when(iban_check(F.substring(account, 1, 2), F.substring(account, F.lit(5), F.length(account))) == F.substring(account, 3, 2), F.lit("iban")))
        .when(is_a["phone"], F.lit("phone"))
    )


def _piece(text: Column, kind: Column) -> Column:
    return F.struct(text.alias("t"), kind.alias("k"))


def _card_runs(tokens: Column) -> Column:
    """``(first, last)`` of the runs of tokens that are cards, usual groupings and then longest first and none across another, in text order.

    Tokens at odd places are digit groups, those between are what parts them.
    """
    size = F.size(tokens)

    def from_(first: Column) -> Column:
        ends = F.sequence(first, F.least(first + 2 * (MOST_DIGITS - 1), size), F.lit(2))
        runs = F.transform(ends, lambda last: F.struct(F.array_join(F.slice(tokens, first, last - first + 1), "").alias("t"), last.alias("last")))
        runs = F.filter(runs, lambda r: r["t"].rlike(CARD) & (luhn_sum(_digits(r["t"])) % 10 == 0))
        return F.transform(runs, lambda r: F.struct((~r["t"].rlike(USUAL_CARD)).alias("odd"), (-F.length(_digits(r["t"]))).alias("most"), first.alias("first"), r["last"].alias("last")))

    found = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), size, F.lit(2)), from_)))
    none = F.array().cast("array<struct<first:int,last:int>>")
    taken = F.aggregate(found, none, lambda acc, c: F.when(F.exists(acc, lambda x: (x["first"] <= c["last"]) & (c["first"] <= x["last"])), acc).otherwise(
        F.concat(acc, F.array(F.struct(c["first"].alias("first"), c["last"].alias("last"))))))
    return F.array_sort(taken)


def _among_groups(text: Column) -> Column:
    """Pieces of digit groups without a card: the other kinds that are valid, and what stands between."""
    found = F.regexp_extract_all(text, F.lit(AMONG_GROUPS), F.lit(0))
    both = F.zip_with(F.split(text, AMONG_GROUPS, -1), found, lambda a, m: F.array(_piece(a, F.lit(None).cast("string")), _piece(F.coalesce(m, F.lit("")), kind_of(m))))
    return F.flatten(both)


def pieces_of(match: Column) -> Column:
    """``(t, k)`` of the pieces of a match: one, or for digit groups the cards and what else is found among them."""
    def cut(tokens: Column) -> Column:
        text = lambda first, last: F.array_join(F.slice(tokens, first, last - first + 1), "")

        def laid_out(runs: Column) -> Column:
            n = F.size(runs)
            start = lambda i: F.when(i == 1, F.lit(1)).otherwise(F.get(runs, i - 2)["last"] + 1)
            rest = lambda i: text(start(i), F.when(i > n, F.size(tokens)).otherwise(F.get(runs, i - 1)["first"] - 1))
            card = lambda i: F.when(i <= n, F.array(_piece(text(F.get(runs, i - 1)["first"], F.get(runs, i - 1)["last"]), F.lit("card")))).otherwise(F.array().cast("array<struct<t:string,k:string>>"))
            return F.flatten(F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.concat(_among_groups(rest(i)), card(i))))

        return _let(_card_runs(tokens), laid_out)

    tokens = F.regexp_extract_all(match, F.lit("[0-9]+|[ -]+"), F.lit(0))
    return _let(kind_of(match), lambda k: F.when(k.isNull() & match.rlike(r"^\d[\d -]{11,}\d$"), _let(tokens, cut)).otherwise(F.array(_piece(match, k))))


def pseudonym(match: Column, kind: Column, key: str) -> Column:
    """The value that stands for a valid match; of a phone number the country part stays."""
    digits = _digits(match)
    lead = F.regexp_extract(match, r"^\+\d{1,3}", 0)
    number = F.substring(match, F.length(lead) + 1, F.length(match))
    return (
        F.when(kind == "email", F.concat(permuted_name(F.substring_index(match, "@", 1), key), F.lit("@"), F.substring_index(match, "@", -1)))
        .when(kind == "date", F.when(match.rlike("^[0-9]{4}-"), permuted_date(match, key)).otherwise(permuted_written_date(match, key)))
        .when(kind == "ssn", laid_over(match, permuted_digits(digits, key, F.lit("ssn")), "[0-9]"))
        .when(kind == "ip", permuted_address(match, key))
        .when(kind == "iban", laid_over(match, permuted_iban(F.replace(match, F.lit(" "), F.lit("")), key), "[A-Z0-9]"))
        .when(kind == "card", laid_over(match, permuted_card(digits, key), "[0-9]"))
        .when(kind == "phone", F.concat(lead, laid_over(number, permuted_digits(_digits(number), key, F.lit("phone")), "[0-9]")))
        .otherwise(match)
    )


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``(doc_id, text, n_found, kinds)`` per document: the text with valid personal data replaced.

    Null stays null and counts nothing; invalid numbers stay as they are. Rows are independent, so repeated
    rows, null ids and empty tables need no rule. Texts without a digit run or an at sign are not searched.
    """
    rows = docs.select("doc_id", "text").withColumn("_m", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    rows = rows.withColumn("_p", F.transform("_m", pieces_of))
    fresh = F.transform("_p", lambda pieces: F.array_join(F.transform(pieces, lambda x: pseudonym(x["t"], x["k"], key)), ""))
    joined = F.array_join(F.zip_with(F.split("text", PATTERN, -1), fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.filter(F.transform(F.flatten("_p"), lambda x: x["k"]), lambda k: k.isNotNull())
    return rows.select(
        "doc_id", F.when(F.size("_m") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(kinds), F.lit(0)).alias("n_found"), F.coalesce(F.array_sort(F.array_distinct(kinds)), F.array().cast("array<string>")).alias("kinds"),
    )


def op8_private_data(spark, folder: str) -> DataFrame:
    return pseudonymised(table(spark, folder, "documents"))
