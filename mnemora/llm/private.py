"""Operator 5 [native]: format-preserving Feistel pseudonyms for personal data.

Numbers and dates that pass their own check (Luhn, address ranges, numbering plans, calendar) are permuted
by a keyed Feistel network over exactly the values of their format, so a pseudonym passes the same check,
equal values have equal pseudonyms in every document, and ``restore`` undoes it with the key. E-mail names
are permuted letter for letter, digit for digit. Column functions only; the key reaches them as a scalar
subquery over a table of one row, so it is in no plan, log or explanation.

Cards: 13 to 19 bare digits, or groups with single spaces or hyphens of 4-4-4-n, 4-4-4-4-3, 4-6-5, 4-6-4 and 6-13.
Phones: North American numbers with separators, and international ones with a plus, 7 to 15 digits with single spaces,
dots or hyphens between them; digits that follow such a number after one separator count as part of it. In a North
American number neither area nor exchange starts with 0 or 1 or ends in 11; bare groups of digits that break this
are no phone number and stay. Numbers marked by a plus or brackets are replaced all the same, by such as break it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, unused

ROUNDS = 8

#: What each kind looks like. All parts are bounded or possessive, so matching is linear.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+(?:1[ .-]?[0-9]{10}|[2-9](?:[ .-]?[0-9]){6,14})(?![0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{6}[ -][0-9]{13}|(?:[0-9]{4}[ -]){4}[0-9]{3}(?![ .-]?[0-9])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7})(?![0-9])"
#: Country codes of the international numbering plan with one or two digits; the others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
ANY = "|".join((EMAIL, PHONE, ADDRESS, SOCIAL, DATE, CARD))

#: Days from 1900-01-01 to 2099-12-31: 17 x 4297, so two residues cover the calendar exactly.
DAYS = (17, 4297)
#: Repetitions after which a day beyond the twelfth is found but for one date in 10**25.
WALK = 64


def prf(key: Column, *parts: Column | str) -> Column:
    """A keyed pseudo-random number below 2**60: the head of a SHA-256 of key and parts."""
    text = F.concat_ws("|", key, *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def rounds(undo: bool) -> Column:
    return F.array(*map(F.lit, reversed(range(ROUNDS)) if undo else range(ROUNDS)))


def feistel(left: Column, right: Column, left_size: Column | int, right_size: Column | int, key: Column, tweak: str, undo: bool) -> Column:
    """A keyed permutation of Z_left_size x Z_right_size, as struct(l, r): the halves take turns to add (undone: subtract) a hash of the other."""
    left_size, right_size = (F.lit(n) if isinstance(n, int) else n for n in (left_size, right_size))
    sign = -1 if undo else 1

    def turn(acc: Column, i: Column) -> Column:
        new_left = F.pmod(acc["l"] + sign * (prf(key, tweak, i, acc["r"]) % left_size), left_size)
        new_right = F.pmod(acc["r"] + sign * (prf(key, tweak, i, acc["l"]) % right_size), right_size)
        return F.struct(F.when(i % 2 == 0, new_left).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 1, new_right).otherwise(acc["r"]).alias("r"))

    return F.aggregate(rounds(undo), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: Column, tweak: str, undo: bool) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    net = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten_to(half), ten_to(rest), key, tweak, undo)
    return let(net, lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), rest, "0")))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn."""

    def at(i: Column) -> Column:
        c = F.substring(shape, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.length(digits_of(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), at), "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right; those at odd places from ``doubled`` on count twice, less nine if over nine."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(m: Column, key: Column, undo: bool) -> Column:
    """Network digit kept, the others permuted, check digit made anew; null unless the Luhn check holds.

    Sixteen digits and three more are one number if all pass the check, else a number and its security code, which stays.
    """

    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card", undo))
        return let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")))

    def checked(s: Column) -> Column:
        return let(digits_of(s), lambda d: F.when(F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0), refill(s, new(d))))

    with_code = F.when(m.rlike("^(?:[0-9]{4}[ -]){4}[0-9]{3}$"), F.concat(checked(F.substring(m, 1, 19)), F.substring(m, 20, 4)))
    return F.coalesce(checked(m), with_code)


def valid_code(c: Column) -> Column:
    """Whether three digits can be an area code or an exchange of the North American plan."""
    return (c >= 200) & (c % 100 != 11)


def code_number(c: Column) -> Column:
    """The place of a code among the 792 valid or the 208 other ones."""
    return F.when(valid_code(c), c - 200 - F.floor((c - 112) / 100)).when(c < 200, c).otherwise(198 + F.floor(c / 100))


def numbered_code(i: Column, valid: Column) -> Column:
    """The code at a place, as three digits."""
    c = F.when(valid, 200 + i + F.floor((i + 88) / 99)).when(i < 200, i).otherwise((i - 198) * 100 + 11)
    return F.lpad(c.cast("int").cast("string"), 3, "0")


def phone(m: Column, key: Column, undo: bool) -> Column:
    """Country code kept, the number permuted: a North American one among those whose area and exchange are as valid as its
    own, others among those of their length that start with 0, or that do not. Null for bare digits that are no such number.
    """

    def american(d: Column) -> Column:
        def new(p: Column) -> Column:
            area, exchange = valid_code(p[0]), valid_code(p[1])
            size = lambda v: F.when(v, 792).otherwise(208)
            net = feistel(code_number(p[0]), code_number(p[1]) * 10_000 + p[2], size(area), size(exchange) * 10_000, key, "phone", undo)
            made = let(net, lambda x: F.concat(numbered_code(x["l"], area), numbered_code(F.floor(x["r"] / 10_000), exchange), F.lpad((x["r"] % 10_000).cast("string"), 4, "0")))
            return F.when((area & exchange) | m.startswith("+") | m.contains("("), F.concat(F.substring(d, F.lit(1), F.length(d) - 10), made))

        digits = lambda start, n: F.substring(d, F.length(d) - start, F.lit(n)).cast("int")
        return let(F.array(digits(9, 3), digits(6, 3), digits(3, 4)), new)

    def abroad(d: Column) -> Column:
        code = F.length(F.regexp_extract(d, COUNTRY, 0))
        own = F.substring(d, code + 1, F.length(d))
        half = F.floor(F.length(own) / 2).cast("int")
        rest = F.length(own) - half
        low = F.when(own.startswith("0"), F.lit(0).cast("long")).otherwise(ten_to(half - 1))
        size = F.when(own.startswith("0"), ten_to(half - 1)).otherwise(ten_to(half) - ten_to(half - 1))
        net = feistel(F.substring(own, F.lit(1), half).cast("long") - low, F.substring(own, half + 1, rest), size, ten_to(rest), key, "phone", undo)
        return let(net, lambda x: F.concat(F.substring(d, F.lit(1), code), F.lpad((x["l"] + low).cast("string"), half, "0"), F.lpad(x["r"].cast("string"), rest, "0")))

    foreign = m.startswith("+") & ~m.startswith("+1")
    return let(digits_of(m), lambda d: let(F.when(foreign, abroad(d)).otherwise(american(d)), lambda new: F.when(new.isNotNull(), refill(m, new))))


def address(m: Column, key: Column, undo: bool) -> Column:
    """An IPv4 address among all; null unless each part is at most 255."""

    def new(o: Column) -> Column:
        net = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "address", undo)
        return let(net, lambda x: F.concat_ws(".", *(e.cast("int").cast("string") for e in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256))))

    return let(F.transform(F.split(m, r"\."), lambda o: o.cast("int")), lambda o: F.when(F.array_max(o) <= 255, new(o)))


def social(m: Column, key: Column, undo: bool) -> Column:
    """A US social security number among those that can be issued; null for others."""

    def new(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        net = feistel(area, (p[1] - 1) * 9999 + p[2] - 1, 898, 99 * 9999, key, "social", undo)
        padded = lambda v, n: F.lpad(v.cast("int").cast("string"), n, "0")
        return let(net, lambda x: F.concat_ws("-", padded(x["l"] + F.when(x["l"] >= 665, 2).otherwise(1), 3), padded(F.floor(x["r"] / 9999) + 1, 2), padded(x["r"] % 9999 + 1, 4)))

    valid = lambda p: p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0)
    return let(F.transform(F.split(m, "-"), lambda o: o.cast("int")), lambda p: F.when(valid(p), new(p)))


def date(m: Column, key: Column, undo: bool) -> Column:
    """A day of 1900 to 2099 among those, in the same notation; null for others.

    dd/mm/yyyy is read before mm/dd/yyyy; a date that only the latter reads becomes one that only the latter reads: the
    permutation is repeated until it gives such a day.
    """

    def moved(pattern: str, late: bool = False) -> Column:
        day = F.datediff(F.try_to_timestamp(m, F.lit(pattern)).cast("date"), F.lit("1900-01-01").cast("date"))
        on = lambda n: F.date_add(F.lit("1900-01-01").cast("date"), n.cast("int"))

        def once(n: Column) -> Column:
            return let(feistel(n % DAYS[0], F.floor(n / DAYS[0]), *DAYS, key, "date", undo), lambda x: x["l"] + x["r"] * DAYS[0])

        def again(acc: Column, _: Column) -> Column:
            return F.when(acc["done"], acc).otherwise(let(once(acc["n"]), lambda n: F.struct((F.dayofmonth(on(n)) > 12).alias("done"), n.alias("n"))))

        def new(n: Column) -> Column:
            found = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(F.lit(False).alias("done"), n.cast("long").alias("n")), again)["n"] if late else once(n)
            return F.date_format(on(found), pattern)

        return let(day, lambda n: F.when(n.between(0, DAYS[0] * DAYS[1] - 1), new(n)))

    return F.when(m.contains("-"), moved("yyyy-MM-dd")).otherwise(F.coalesce(moved("dd/MM/yyyy"), moved("MM/dd/yyyy", late=True)))


def email(m: Column, key: Column, undo: bool) -> Column:
    """The name permuted character by character within lower case, upper case and digits; the domain kept."""
    sign = -1 if undo else 1
    alphabet = {"[a-z]": ("a", 26), "[A-Z]": ("A", 26), "[0-9]": ("0", 10)}

    def shifted(s: Column, other: Column, i: Column) -> Column:
        def at(j: Column) -> Column:
            c, out = F.substring(s, j, F.lit(1)), None
            for pattern, (zero, n) in alphabet.items():
                moved = F.char(F.pmod(F.ascii(c) - ord(zero) + sign * (prf(key, "email", i, j, other) % n), F.lit(n)) + ord(zero))
                out = F.when(c.rlike(pattern), moved) if out is None else out.when(c.rlike(pattern), moved)
            return out.otherwise(c)

        return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), at), ""))

    def turn(acc: Column, i: Column) -> Column:
        return F.struct(F.when(i % 2 == 0, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"), F.when(i % 2 == 1, shifted(acc["r"], acc["l"], i)).otherwise(acc["r"]).alias("r"))

    name, half = F.substring_index(m, "@", 1), F.ceil(F.length(F.substring_index(m, "@", 1)) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), half).alias("l"), F.substring(name, half + 1, F.length(name)).alias("r"))
    return let(F.aggregate(rounds(undo), start, turn), lambda x: F.concat(x["l"], x["r"], F.lit("@"), F.substring_index(m, "@", -1)))


def pseudonym(m: Column, key: Column, undo: bool) -> Column:
    """The pseudonym of one match of ANY, or what it stands for; null if it fails its check."""
    return (
        F.when(m.contains("@"), email(m, key, undo))
        .when(m.rlike(rf"^(?:{ADDRESS})$"), address(m, key, undo))
        .when(m.rlike(rf"^(?:{SOCIAL})$"), social(m, key, undo))
        .when(m.rlike(rf"^(?:{DATE})$"), date(m, key, undo))
        .when(m.rlike(rf"^(?:{CARD})$"), card(m, key, undo))
        .otherwise(phone(m, key, undo))
    )


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """A key as a table of one row and one string column; plans name such a table by its columns only."""
    return spark.createDataFrame([(key,)], "key string")


def replaced(df: DataFrame, text_col: str, key: DataFrame, count_col: str, undo: bool) -> DataFrame:
    """``df`` with each match of ANY in ``text_col`` replaced by ``pseudonym``, and their number. Helper columns have names that ``df`` lacks."""
    key_name, made_name = unused(df, "key"), unused(df, "made")
    text = F.col(text_col)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    new = F.transform(found, lambda m: pseudonym(m, F.col(key_name), undo))
    gaps = F.split(text, ANY, -1)

    def whole(made: Column) -> Column:
        filled = F.zip_with(found, made, lambda m, p: F.coalesce(p, m))
        joined = F.zip_with(gaps, filled, lambda gap, p: F.concat(gap, F.coalesce(p, F.lit(""))))
        return F.struct(F.array_join(joined, "").alias("text"), F.size(F.filter(made, lambda p: p.isNotNull())).alias("n"))

    kept = F.struct(text.cast("string").alias("text"), F.lit(0).alias("n"))
    out = df.withColumn(key_name, key.scalar()).withColumn(made_name, F.when(F.coalesce(text.rlike(ANY), F.lit(False)), let(new, whole)).otherwise(kept))
    return out.withColumn(text_col, F.col(f"{made_name}.text")).withColumn(count_col, F.col(f"{made_name}.n")).drop(key_name, made_name)


def pseudonymise(df: DataFrame, text_col: str, key: DataFrame, count_col: str = "n_private") -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced, and how many values were in ``count_col`` (replacing a column of that name).

    ``key`` is a table of one row and one string column (``key_table``, or one read from where keys are kept).
    Null text stays null with a count of 0; all other columns and rows stay as they are. One narrow
    pass: text is searched once, and only texts with a match are taken apart.
    """
    return replaced(df, text_col, key, count_col, undo=False)


def restore(df: DataFrame, text_col: str, key: DataFrame, count_col: str = "n_private") -> DataFrame:
    """What ``pseudonymise`` with this key was given. Pseudonyms are found by the same patterns and checks, which they pass as their originals did."""
    return replaced(df, text_col, key, count_col, undo=True)
