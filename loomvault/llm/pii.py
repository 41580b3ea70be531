"""Format-preserving pseudonyms for personal data, in Spark SQL expressions alone.

Numbers and dates that pass their validation are permuted, by a keyed Feistel network, within the set of valid values of
their format: a card number becomes another with the same first digit and a right check digit, a telephone number another
of its kind, an address another address, a social security number another that could be issued, a date another
date of its spelling (y-m-d, d/m/y, or m/d/y where the day is past the 12th). A permutation gives equal values equal pseudonyms everywhere and different values different ones, so what was linked
across documents stays linked. Spelling (separators, brackets) is kept. An e-mail address has no such set; it becomes a keyed
digest of its lower-case form at a reserved domain, which links equal addresses as well.

A network works on pairs (a, b) of numbers below (A, B): in turn a or b gets a keyed function of the other added. Its
round function is SHA-256 over key, kind, round and value. Dates (a set without a fitting product) walk the cycle until they
are in the set again. All of it is one projection: no shuffle, no Python.

Telephone numbers are permuted whatever their codes: those whose area or exchange code cannot be assigned form two sets of their own, as
people write such numbers too. An address with leading zeros (010.0.0.1) fails validation, since it can be read in two ways.

Defined results: a null text stays null and an empty one empty; both count nothing; candidates that fail their validation stay as
they are; where candidates overlap, the leftmost counts, and of those that start together the first in PATTERNS; repeated rows are treated alike; very
long texts are handled whole, and no pattern needs stack by their length; an empty table gives an empty table; extra columns are
ignored by `pseudonymise` when it builds its own result and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

#: Key of the registered query; a deployment passes its own.
KEY = "loomvault"
ROUNDS = 10
KINDS = ("email", "ip", "date", "phone", "ssn", "card")

#: Candidates, by kind; validation follows.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",  # 127 labels, as many as a domain may have; each costs stack
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z/-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[/-][0-9])",
    "phone": r"(?:\+1[ .-]?|(?<![0-9A-Za-z+.-]))(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(PATTERNS.values())
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31
_SIDE = 271  # its square is the least that holds DAYS
_MONTHS, _LATE = 2400, 19  # months of those days; days of a month after the 12th at most


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, kind: str, a: str, b: str, size_a: str, size_b: str, rounds: int = ROUNDS) -> str:
    """SQL for struct(a, b) after all rounds. a is below size_a and b below size_b."""
    f = lambda x: f"cast(conv(substr(sha2(concat_ws('|', {_quote(key)}, '{kind}', r, {x}), 256), 1, 12), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {rounds}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> if(r % 2 = 1, "
        f"named_struct('a', (s.a + {f('s.b')}) % {size_a}, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {f('s.a')}) % {size_b})))"
    )


def _with(value: str, name: str, body: str) -> str:
    """SQL for body with `name` bound to value, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _respell(old: str, digits: str) -> str:
    """The string old with its digits replaced by those of `digits`, in turn."""
    return f"array_join(transform(sequence(1, length({old})), i -> if(substr({old}, i, 1) rlike '[0-9]', substr({digits}, length(regexp_replace(substr({old}, 1, i), '[^0-9]', '')), 1), substr({old}, i, 1))), '')"


def _luhn(digits: str) -> str:
    """The Luhn sum of a digit string that ends with its check digit."""
    d = f"cast(substr({digits}, length({digits}) - p, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0L, (t, p) -> t + if(p % 2 = 1, ({d} * 2) div 10 + ({d} * 2) % 10, {d}))"


def _card(key: str) -> str:
    u, v = "((length(d) - 2) div 2)", "((length(d) - 2) - (length(d) - 2) div 2)"
    size = lambda n: f"cast(rpad('1', 1 + {n}, '0') as bigint)"
    body = f"concat(substr(d, 1, 1), lpad(cast(x.a as string), {u}, '0'), lpad(cast(x.b as string), {v}, '0'))"
    checked = _with(body, "c", f"concat(c, cast((10 - ({_luhn('concat(c, ' + _quote('0') + ')')}) % 10) % 10 as string))")
    net = _feistel(key, "card", f"substr(d, 2, {u})", f"substr(d, 2 + {u}, {v})", size(u), size(v))
    new = _with(net, "x", _with(checked, "w", _respell("v", "w")))
    return _with("regexp_replace(v, '[^0-9]', '')", "d", f"if(({_luhn('d')}) % 10 = 0 and not d rlike '^0+$', {new}, null)")


def _phone(key: str) -> str:
    # three sets, each permuted in itself: both codes from 200 on; the area below; the exchange alone below
    number = "right(d, 10)"
    area, exchange, line = f"cast(substr({number}, 1, 3) as bigint)", f"cast(substr({number}, 4, 3) as bigint)", f"cast(substr({number}, 7, 4) as bigint)"
    three = lambda x: f"lpad(cast({x} as string), 3, '0')"
    end = "lpad(cast(x.b as string), 4, '0')"
    n = f"((({area} - 200) * 800 + {exchange} - 200) * 10000 + {line})"
    good = _with(_feistel(key, "phone", f"({n}) div 80000", f"({n}) % 80000", "80000", "80000"), "x", _with("x.a * 80000 + x.b", "n", "concat(cast(n div 8000000 + 200 as string), cast(n div 10000 % 800 + 200 as string), lpad(cast(n % 10000 as string), 4, '0'))"))
    low_area = _with(_feistel(key, "phone-area", f"{area} * 1000 + {exchange}", line, "200000", "10000"), "x", f"concat({three('x.a div 1000')}, {three('x.a % 1000')}, {end})")
    low_exchange = _with(_feistel(key, "phone-exchange", f"({area} - 200) * 200 + {exchange}", line, "160000", "10000"), "x", f"concat({three('x.a div 200 + 200')}, {three('x.a % 200')}, {end})")
    new = f"case when {area} < 200 then {low_area} when {exchange} < 200 then {low_exchange} else {good} end"
    return _with("regexp_replace(v, '[^0-9]', '')", "d", _with(f"concat(left(d, length(d) - 10), {new})", "w", _respell("v", "w")))


def _ip(key: str) -> str:
    part = lambda k: f"cast(o[{k}] as bigint)"
    net = _feistel(key, "ip", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536")
    new = _with(net, "x", "concat_ws('.', x.a div 256, x.a % 256, x.b div 256, x.b % 256)")
    return _with(r"split(v, '[.]')", "o", f"if(forall(o, q -> cast(q as int) <= 255 and not q rlike '^0[0-9]'), {new}, null)")


def _ssn(key: str) -> str:
    area, group, serial = (f"cast(substr(v, {at}, {n}) as bigint)" for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    index = f"({area} - if({area} > 666, 2, 1))"
    net = _feistel(key, "ssn", f"{index} * 99 + {group} - 1", f"{serial} - 1", "88902", "9999")
    back = "x.a div 99 + if(x.a div 99 >= 665, 2, 1)"
    new = _with(net, "x", f"concat(lpad(cast({back} as string), 3, '0'), '-', lpad(cast(x.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(x.b + 1 as string), 4, '0'))")
    return f"if({valid}, {new}, null)"


def _walk(step: str, inside: str, outside: int) -> str:
    """SQL for the first number after k, on its cycle of a permutation, that is in a set; `outside` numbers are not.

    step is SQL over w.n, inside over n. A walk leaves the set for `outside` steps in a row at most.
    """
    return f"aggregate(sequence(0, {outside}), named_struct('n', cast(k as bigint), 'done', false), (w, t) -> if(w.done, w, {_with(step, 'n', f'''named_struct('n', n, 'done', {inside})''')})).n"


def _date(key: str) -> str:
    # three spellings, each a set of its own: y-m-d; d/m/y, the second number a month; else m/d/y, whose days are past the 12th
    day_first = "cast(substr(v, 4, 2) as int) <= 12"
    iso = f"if(v like '____-__-__', v, if({day_first}, concat(right(v, 4), '-', substr(v, 4, 2), '-', left(v, 2)), concat(right(v, 4), '-', left(v, 2), '-', substr(v, 4, 2))))"
    step = _with(_feistel(key, "date", f"w.n div {_SIDE}", f"w.n % {_SIDE}", str(_SIDE), str(_SIDE)), "x", f"x.a * {_SIDE} + x.b")
    new_day = f"date_add(date'{FIRST_DAY}', cast({_walk(step, f'n < {DAYS}', _SIDE**2 - DAYS)} as int))"
    any_order = _with(f"datediff(c, date'{FIRST_DAY}')", "k", _with(new_day, "e", "if(v like '____-__-__', date_format(e, 'yyyy-MM-dd'), date_format(e, 'dd/MM/yyyy'))"))
    # month since the first day, and day past the 12th; what a month lacks of the 31st is walked over
    first_year = int(FIRST_DAY[:4])
    last = f"day(last_day(make_date({first_year} + cast(n div {_LATE} div 12 as int), cast(n div {_LATE} % 12 as int) + 1, 1)))"
    late = _with(_feistel(key, "date-mdy", f"w.n div {_LATE}", f"w.n % {_LATE}", str(_MONTHS), str(_LATE)), "x", f"x.a * {_LATE} + x.b")
    new_late = _walk(late, f"n % {_LATE} + 13 <= {last}", _MONTHS * 31 - DAYS)
    spelled = f"concat(lpad(cast(n div {_LATE} % 12 + 1 as string), 2, '0'), '/', cast(n % {_LATE} + 13 as string), '/', cast({first_year} + n div {_LATE} div 12 as string))"
    month_first = _with(f"((year(c) - {first_year}) * 12 + month(c) - 1) * {_LATE} + day(c) - 13", "k", _with(new_late, "n", spelled))
    in_range = f"c >= date'{FIRST_DAY}' and c < date_add(date'{FIRST_DAY}', {DAYS})"
    return _with(f"try_cast({iso} as date)", "c", f"if({in_range}, if(v like '____-__-__' or {day_first}, {any_order}, {month_first}), null)")


def _email(key: str) -> str:
    return f"concat('user.', substr(sha2(concat_ws('|', {_quote(key)}, 'email', lower(v)), 256), 1, 16), '@mail.invalid')"


def _value(key: str) -> str:
    """SQL for struct(kind, pseudonym) of the candidate v: the first kind whose form it has and whose validation it passes."""
    forms = {"email": "contains(v, '@')", "ip": r"v rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'", "date": "v rlike '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$'", "ssn": "v rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", "phone": "length(regexp_replace(v, '[^0-9]', '')) in (10, 11)", "card": "length(regexp_replace(v, '[^0-9]', '')) >= 13"}
    made = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    cases = " ".join(f"when {forms[k]} then named_struct('kind', '{k}', 'new', {made[k](key)})" for k in made)
    return f"case {cases} end"


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, the number of values replaced by kind, and the text with its pseudonyms."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pattern = _quote(PATTERN)
    # nothing to look for without a digit or an @
    found = base.withColumn("found", F.expr(f"if(text rlike '[0-9@]', regexp_extract_all(text, {pattern}, 0), cast(array() as array<string>))"))
    named = found.withColumn("made", F.expr(f"transform(found, v -> {_value(key)})"))
    spliced = f"""case when size(found) = 0 or text is null then text else {_with(f"split(text, {pattern}, -1)", "parts",
        "concat(array_join(transform(found, (v, j) -> concat(parts[j], coalesce(made[j].new, v))), ''), parts[size(found)])")} end"""
    counts = [F.expr(f"cast(coalesce(size(filter(made, x -> x.kind = '{k}' and x.new is not null)), 0) as bigint)").alias(f"n_{k}") for k in KINDS]
    return named.select("doc_id", *[F.greatest(c, F.lit(0)).alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)], F.expr(spliced).alias("text"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir))
