"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Numbers that pass their checks, and dates, are permuted within their format, so that equal values have equal pseudonyms in all
documents and different values different ones. A card keeps a valid Luhn digit, an IBAN valid check digits, a date stays a date of
the years 1 to 9999 in its layout. Where the network leaves the valid values it is applied again until it is back among them.
Built-in functions only; each document is changed where it lies, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Steps after which a pseudonym that isn't valid in its format (chance below 0.12 each) is valid.
_WALK = 60

_EDGE = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9_])"
#: Characters of an IBAN by country; where a country isn't listed, the check digits tell where one ends.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_LISTED = "(?:" + "|".join(" ".join(_IBAN_LENGTHS.values()).split()) + ")"


def _iban_of(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


_IBAN = "(?:" + "|".join(_iban_of(n, c) for n, c in _IBAN_LENGTHS.items()) + f"|(?!{_LISTED})" + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
#: A card may begin after another number and a space only with an issuer's digits in a group of four or more, or ungrouped: else
#: rows of small numbers would be full of cards.
_CARD_START = r"(?:(?<![0-9] )|(?=(?:2[2-7]|[3-6][0-9]|81|97)[0-9]{2}|[0-9]{13}))"
#: By kind, in the order in which they are tried at each place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",  # possessive: Java goes through a repeated group without recursion
    "iban": _EDGE + _IBAN + _END,
    "ssn": r"(?<![A-Za-z0-9_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_-])",
    "date": r"(?<![A-Za-z0-9_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![A-Za-z0-9_/-])",
    "phone": r"(?<![A-Za-z0-9_+(.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9_-])",
    "ip": r"(?<![A-Za-z0-9_.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![A-Za-z0-9_]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9_.-])" + _CARD_START + _CARD + _END,
}
KINDS = tuple(PATTERNS)
#: Every place where a kind may begin, also within a longer match; group 1 is the longest match there.
ANY = f"(?=({'|'.join(PATTERNS.values())}))"
#: Patterns of a match alone, without what stands before it.
_ALONE = PATTERNS | {"iban": _IBAN, "card": _CARD}
#: Places whose choices are made in one array, so that texts with very many of them take time in proportion.
_BLOCK = 256

#: Layouts of dates: pattern, places of year, month and day, and a template. Those of one domain are permuted alike. Slashes leave open
#: whether the day or the month comes first; dates of both readings, of the day first and of the month first are three domains.
_ISO = ((r"[0-9]{4}-[0-9]{2}-[0-9]{2}", (1, 6, 9), "{y}, '-', {m}, '-', {d}"), (r"[0-9]{4}/[0-9]{2}/[0-9]{2}", (1, 6, 9), "{y}, '/', {m}, '/', {d}"), (r"[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}", (7, 4, 1), "{d}, '.', {m}, '.', {y}"))
_SLASHES = r"[0-9]{2}/[0-9]{2}/[0-9]{4}"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """SQL text of the pseudonyms. A number goes through the network as two halves, each moved by a keyed hash of the other."""

    def __init__(self, key: str):
        """key: SQL text of the key, such as the name of a column."""
        self.key = key

    def hash(self, *parts: str) -> str:
        """60 bits of the keyed hash."""
        return f"CAST(conv(substr(sha2(concat_ws(':', {self.key}, {', '.join(parts)}), 256), 1, 15), 16, 10) AS BIGINT)"

    def feistel(self, kind: str, a: str, b: str, mod_a: str, mod_b: str, then: str) -> str:
        """then: of s.a and s.b, the halves after an even number of rounds, below mod_a and mod_b."""
        start = f"named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT), 'ma', CAST({mod_a} AS BIGINT), 'mb', CAST({mod_b} AS BIGINT))"
        moved = f"(s.a + {self.hash(_quoted(kind), 's.ma', 's.mb', 'i', 's.b')} % s.ma) % s.ma"
        return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> named_struct('a', s.b, 'b', {moved}, 'ma', s.mb, 'mb', s.ma), s -> {then})"

    def digits(self, kind: str, d: str) -> str:
        """The digit string d of 2 to 36 digits, permuted among those of its length."""
        power = "CAST(rpad('1', {} + 1, '0') AS BIGINT)".format
        u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
        return self.feistel(kind, f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", power(u), power(v), "concat(lpad(CAST(s.a AS STRING), length(CAST(s.ma AS STRING)) - 1, '0'), lpad(CAST(s.b AS STRING), length(CAST(s.mb AS STRING)) - 1, '0'))")

    @staticmethod
    def only_digits(x: str) -> str:
        return f"regexp_replace({x}, '[^0-9]', '')"

    @staticmethod
    def refilled(x: str, d: str, skip: str) -> str:
        """x with its digits after the first `skip` replaced by those of d, in turn."""
        is_digit = "substr({0}, j, 1) BETWEEN '0' AND '9'".format(x)
        new = f"CASE WHEN {is_digit} AND t.k >= {skip} THEN substr(t.d, t.k - {skip} + 1, 1) ELSE substr({x}, j, 1) END"
        return (
            f"aggregate(sequence(1, length({x})), named_struct('out', '', 'k', 0, 'd', {d}), (t, j) -> named_struct('out', concat(t.out, {new}), "
            f"'k', t.k + IF({is_digit}, 1, 0), 'd', t.d), t -> t.out)"
        )

    @staticmethod
    def luhn(d: str) -> str:
        digit = f"CAST(substr({d}, length({d}) - k, 1) AS INT)"
        return f"aggregate(sequence(0, length({d}) - 1), 0, (r, k) -> r + IF(k % 2 = 0, {digit}, {digit} * 2 - IF({digit} > 4, 9, 0))) % 10"

    @staticmethod
    def mod97(s: str) -> str:
        c = f"substr({s}, k, 1)"
        return f"aggregate(sequence(1, length({s})), 0, (r, k) -> IF({c} BETWEEN '0' AND '9', r * 10 + ascii({c}) - 48, r * 100 + ascii({c}) - 55) % 97)"

    @staticmethod
    def let(name: str, value: str, body: str) -> str:
        """body, with value computed once under a name."""
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    # Each kind: (whether x is valid, its pseudonym).

    def card(self, x: str) -> tuple[str, str]:
        d = self.only_digits(x)
        new = self.let("body", self.digits("card", f"substr({d}, 1, length({d}) - 1)"), f"concat(body, CAST((10 - {self.luhn("concat(body, '0')")}) % 10 AS STRING))")
        return f"length({d}) BETWEEN 13 AND 19 AND {self.luhn(d)} = 0", self.refilled(x, new, "0")

    @staticmethod
    def walked(start: str, bad: Callable[[str], str], again: Callable[[str], str]) -> str:
        """start, a value out of the network, sent through it again as long as it is bad."""
        return f"aggregate(sequence(1, {_WALK}), {start}, (w, z) -> CASE WHEN {bad('w')} THEN {again('w')} ELSE w END)"

    def phone(self, x: str) -> tuple[str, str]:
        """Valid: ten digits that are not all the same. Area codes aren't checked, for numbering plans differ."""
        d = self.only_digits(x)
        same = "{0} = repeat(left({0}, 1), 10)".format
        own = lambda w: self.digits("phone", w)
        return f"NOT ({same(f'right({d}, 10)')})", self.refilled(x, self.walked(own(f"right({d}, 10)"), same, own), f"(length({d}) - 10)")

    def ip(self, x: str) -> tuple[str, str]:
        o = [f"CAST(split({x}, '[.]')[{i}] AS INT)" for i in range(4)]
        out = "concat_ws('.', s.a div 256, s.a % 256, s.b div 256, s.b % 256)"
        return " AND ".join(f"{n} <= 255" for n in o), self.feistel("ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536", out)

    def ssn(self, x: str) -> tuple[str, str]:
        bad = "(substr({0}, 1, 3) IN ('000', '666') OR substr({0}, 1, 1) = '9' OR substr({0}, 4, 2) = '00' OR substr({0}, 6) = '0000')".format
        d = self.only_digits(x)
        own = lambda w: self.digits("ssn", w)
        return f"NOT {bad(d)}", self.refilled(x, self.walked(own(d), bad, own), "0")

    def iban(self, x: str) -> tuple[str, str]:
        s = f"replace({x}, ' ', '')"
        bban = f"substr({s}, 5)"
        fresh = self.let("nb", self.refilled(bban, self.digits("iban", self.only_digits(bban)), "0"), f"concat(lpad(CAST(98 - {self.mod97(f"concat(nb, substr({s}, 1, 2), '00')")} AS STRING), 2, '0'), {self.only_digits('nb')})")
        valid = f"length({s}) BETWEEN 15 AND 34 AND length({self.only_digits(bban)}) BETWEEN 4 AND 30 AND {self.mod97(f'concat({bban}, substr({s}, 1, 4))')} = 1"
        return valid, self.refilled(x, fresh, "0")

    @staticmethod
    def is_day(y: str, m: str, d: str) -> str:
        """Whether numbers are a day of the Gregorian calendar, carried back to year 1."""
        leap = f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
        return f"({y} BETWEEN 1 AND 9999 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN IF({leap}, 29, 28) ELSE 31 END)"

    def days(self, domain: str, y: str, m: str, d: str, low: int, high: int, out: str) -> str:
        """out of the pseudonym of a day from low to high of its month; out has {y}, {m} and {d}."""
        n = 12 * (high - low + 1)
        own = lambda a, b: self.feistel(domain, a, b, "9999", str(n), "named_struct('a', s.a, 'b', s.b)")
        part = lambda w: (f"({w}.a + 1)", f"({w}.b div {high - low + 1} + 1)", f"({w}.b % {high - low + 1} + {low})")
        walked = self.walked(own(f"{y} - 1", f"({m} - 1) * {high - low + 1} + {d} - {low}"), lambda w: f"NOT {self.is_day(*part(w))}", lambda w: own(f"{w}.a", f"{w}.b"))
        new = [f"lpad(CAST({x} AS STRING), {k}, '0')" for x, k in zip(part("v"), (4, 2, 2), strict=True)]
        return self.let("v", walked, f"concat({out.format(y=new[0], m=new[1], d=new[2])})")

    def date(self, x: str) -> tuple[str, str]:
        valid, cases = [], []
        number = lambda at, n=2: f"TRY_CAST(substr({x}, {at}, {n}) AS INT)"
        for pattern, (y, m, d), out in _ISO:
            ymd = number(y, 4), number(m), number(d)
            fits = f"({x} RLIKE '^{pattern}$' AND {self.is_day(*ymd)})"
            valid.append(fits)
            cases.append(f"WHEN {x} RLIKE '^{pattern}$' THEN {self.days('date', *ymd, 1, 31, out)}")
        a, b, y = number(1), number(4), number(7, 4)
        valid.append(f"({x} RLIKE '^{_SLASHES}$' AND ({self.is_day(y, b, a)} OR {self.is_day(y, a, b)}))")
        for domain, when, m, d, low, high, out in (
            ("either", f"greatest({a}, {b}) <= 12", b, a, 1, 12, "{d}, '/', {m}, '/', {y}"),
            ("day", f"{a} > 12", b, a, 13, 31, "{d}, '/', {m}, '/', {y}"),
            ("month", "true", a, b, 13, 31, "{m}, '/', {d}, '/', {y}"),
        ):
            cases.append(f"WHEN {when} THEN {self.days(f'date-{domain}', y, m, d, low, high, out)}")
        return f"({' OR '.join(valid)})", f"CASE {' '.join(cases)} END"

    def email(self, x: str) -> tuple[str, str]:
        """Not a number: letters from 80 bits of the keyed hash of the mailbox and 64 of the domain stand for them."""
        letters = "translate(substr(sha2(concat_ws(':', {0}, '{1}', lower({2})), 256), 1, {3}), '0123456789abcdef', 'bcdfghjklmnpqrst')".format
        return "true", f"concat({letters(self.key, 'mailbox', x, 20)}, '@', {letters(self.key, 'domain', f"substring_index({x}, '@', -1)", 16)}, '.example')"

    def part(self, kind: str, x: str) -> str:
        """The longest beginning of a match that ends where a number may end and holds the kind's check, or null."""
        valid, _ = getattr(self, kind)("p")
        if kind == "card":
            ends = f"sequence(length({x}), 13, -1)"
            stop = f"n = length({x}) OR substr({x}, n + 1, 1) IN (' ', '-')"
        elif kind == "iban":
            ends = f"IF({x} RLIKE '^{_LISTED}', array(length({x})), sequence(length({x}), 15, -1))"
            stop = f"n = length({x}) OR substr({x}, n + 1, 1) = ' '"
        else:
            return f"IF({getattr(self, kind)(x)[0]}, {x}, NULL)"
        return f"get(filter(transform(filter({ends}, n -> {stop}), n -> substr({x}, 1, n)), p -> {valid}), 0)"

    def pseudonym(self, x: str) -> str:
        """(kind, size, text) of a match: how much of it is replaced by what. kind is null if no kind's pattern and check hold."""
        none = "named_struct('kind', CAST(NULL AS STRING), 'size', 0, 'text', '')"
        cases = []
        for kind in KINDS:
            _, new = getattr(self, kind)("v")
            found = f"CASE WHEN v IS NULL THEN {none} ELSE named_struct('kind', '{kind}', 'size', length(v), 'text', {new}) END"
            cases.append(f"WHEN {x} RLIKE {_quoted(f'^(?:{_ALONE[kind]})$')} THEN {self.let('v', self.part(kind, x), found)}")
        return f"CASE {' '.join(cases)} ELSE {none} END"

    @staticmethod
    def chosen(places: str) -> str:
        """(kind, text) of each of the places (kind, size, text, piece), where piece reaches to the next place. From left to right the
        first valid match counts; places within it are part of it, and kind is null there."""
        cut = "CASE WHEN t.skip > 0 THEN t.skip ELSE e.size END"
        own = f"named_struct('kind', IF(t.skip > 0, NULL, e.kind), 'text', concat(IF(t.skip > 0, '', e.text), substr(e.piece, {cut} + 1)))"
        step = f"named_struct('skip', greatest({cut} - length(e.piece), 0), 'out', concat(t.out, array({own})))"
        nothing = "CAST(array() AS ARRAY<STRUCT<kind: STRING, text: STRING>>)"
        block = f"aggregate(slice({places}, b * {_BLOCK} + 1, {_BLOCK}), named_struct('skip', u.skip, 'out', {nothing}), (t, e) -> {step}, t -> named_struct('skip', t.skip, 'out', concat(u.out, array(t.out))))"
        start = "named_struct('skip', 0, 'out', CAST(array() AS ARRAY<ARRAY<STRUCT<kind: STRING, text: STRING>>>))"
        return f"aggregate(sequence(0, (size({places}) - 1) div {_BLOCK}), {start}, (u, b) -> {block}, u -> flatten(u.out))"


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x.eqNullSafe(F.lit(kind))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, text (with pseudonyms), n_<kind> for each kind, changed.

    Whole texts are read; null stays null. Values that fail their check (Luhn, octets over 255, no such day, ...) stay as they
    are; then shorter ones that end at a separator are tried, and what begins within them. An IBAN has its country's length.
    The key is needed to map a value again; it comes from a table of one row by a scalar subquery, so that plans, the web interface and
    event logs don't show it. Repeated rows give repeated rows; extra columns may have any name.
    """
    sql = _Sql("key")
    text = F.col(f"d.{text_col}")
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    rows = docs.select(F.struct(*docs.columns).alias("d"), secret.alias("key")).withColumn("some", text.rlike("[0-9@]"))
    nothing = F.array().cast("array<string>")
    rows = rows.select("d", "key", F.when(F.col("some"), F.regexp_extract_all(text, F.lit(ANY), F.lit(1))).otherwise(nothing).alias("hits"))
    # Pieces begin at the places; what stands before the first is a piece of its own unless it is empty.
    rows = rows.select("d", F.expr(f"transform(hits, x -> {sql.pseudonym('x')})").alias("new"), F.when(F.size("hits") > 0, F.split(text, ANY, -1)).alias("pieces"))
    rows = rows.select("d", F.expr("IF(size(pieces) > size(new), pieces[0], '')").alias("head"), F.expr("transform(new, (n, i) -> named_struct('kind', n.kind, 'size', n.size, 'text', n.text, 'piece', pieces[i + size(pieces) - size(new)]))").alias("places"))
    rows = rows.select("d", "head", F.when(F.size("places") > 0, F.expr(sql.chosen("places"))).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<kind: STRING, text: STRING>>)")).alias("new"))
    kinds = F.transform("new", lambda n: n["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col(f"d.{id_col}").alias(id_col),
        F.when(F.size("new") > 0, F.concat("head", F.array_join(F.transform("new", lambda n: n["text"]), ""))).otherwise(text).alias("text"),
        *counts,
        F.exists("new", lambda n: n["kind"].isNotNull()).alias("changed"),
    )
