"""Format-preserving Feistel pseudonyms, in SQL functions alone.

Numbers and dates found in a text are validated and then permuted within their own format under a key, so
equal values get equal pseudonyms in every document and different values stay different. A balanced Feistel
network over the characters of a value (its halves' keyed SHA-512 digits are added in the base of its alphabet) is a
permutation of all values of that length; ``reverse`` undoes it with the key.

===========  =============================================  ======================================
found        validated                                      permuted
===========  =============================================  ======================================
card         13 to 19 digits, plain or in groups; Luhn      digits but the last, which is the new Luhn digit
phone        NANP forms; area and exchange from 2 on        the last ten digits, to such ones
ssn          3-2-4 digits; area not 000, 666 or 9xx, no 0s  nine digits, to such ones
ipv4         four numbers up to 255                         32 bits
date         a day of the calendar, y-m-d or m/d/y, d/m/y   days within its block of 72,900 (from 1900-01-01)
email        a local part of up to 64 and a dotted domain   letters and digits of the local part and the domain's first label
secret       32 to 64 hexadecimal digits                    its letters and its digits
===========  =============================================  ======================================

In e-mail addresses and secrets letters stay letters and digits digits, each permuted with the others as a tweak, and each place keeps its case:
values that differ in case alone get pseudonyms that differ in case alone, and ``reverse`` gives back the case.
Where not every value of a length is valid, a pseudonym is permuted again until it is (up to ``WALK`` times; one that is not by then has a chance
below 1e-20), so it stays a permutation of the valid ones. A date whose block of days leaves the years 1 to 9999 stays. Separators, and what fails validation, stay as they are and count as no finding. One regular expression finds all; the text is split at its matches and
joined again, so every other byte is kept. Nulls: a null text stays null, with no findings. Rows are
taken one by one, there is no shuffle, and other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, quoted, table

#: A block of days is RADIX squared; what leaves the valid values moves on at most WALK times.
ROUNDS, BLOCK, RADIX, WALK = 8, 72_900, 270, 64
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}+)++",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\d)",
    "card": CARD,
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
}
#: Nine and ten digits that can be a number.
SSN, PHONE = r"^(?!000|666|9)\d{3}(?!00)\d{2}(?!0000)\d{4}$", r"^[2-9]\d{2}[2-9]\d{6}$"
#: Alternatives in order. Groups that repeat without bound are possessive: they never give back, so no text is too long for Java's stack.
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def feistel(value: str, alphabet: str, key: str, kind: str, reverse: bool = False, tweak: str = "") -> str:
    """SQL for the permutation of all strings of value's length over ``alphabet``; a single character is rotated. ``tweak``: SQL of a string that picks another permutation."""
    n = len(alphabet)
    sign = "-" if reverse else "+"
    digit = lambda of, j: f"(locate(substring({of}, {j}, 1), {_q(alphabet)}) - 1)"
    more = f"{tweak}, " if tweak else ""
    prf = lambda half, i: f"sha2(concat_ws('|', {_q(key)}, {_q(kind)}, {more}cast({i} as string), {half}), 512)"
    stream = "cast(conv(substring(h, 2 * j - 1, 2), 16, 10) as int)"
    add = lambda of, by: _let("h", by, f"array_join(transform(sequence(1, length({of})), j -> substring({_q(alphabet)}, pmod({digit(of, 'j')} {sign} {stream}, {n}) + 1, 1)), '')")
    if reverse:
        step = f"named_struct('l', {add('s.r', prf('s.l', 'i'))}, 'r', s.l)"
        rounds = f"reverse(sequence(1, {ROUNDS}))"
    else:
        step = f"named_struct('l', s.r, 'r', {add('s.l', prf('s.r', 'i'))})"
        rounds = f"sequence(1, {ROUNDS})"
    start = "named_struct('l', substring(v, 1, length(v) div 2), 'r', substring(v, length(v) div 2 + 1))"
    many = f"aggregate({rounds}, {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"
    return _let("v", value, f"case when length(v) < 2 then {add('v', prf(_q(''), '0'))} else {many} end")


def _refill(text: str, chars: str, kept: str) -> str:
    """``text`` with its characters outside ``kept`` replaced by ``chars`` in turn."""
    nth = f"length(regexp_replace(substring(t, 1, j), {_q(kept)}, ''))"
    each = f"transform(sequence(1, length(t)), j -> if(regexp_replace(substring(t, j, 1), {_q(kept)}, '') = '', substring(t, j, 1), substring(c, {nth}, 1)))"
    return _let("t", text, _let("c", chars, f"array_join({each}, '')"))


def _luhn(digits: str, upto: str) -> str:
    """Luhn sum of the first ``upto`` digits when one more follows them."""
    d = f"cast(substring({digits}, k, 1) as int)"
    doubled = f"(if(({upto} - k) % 2 = 0, {d} * 2 - if({d} > 4, 9, 0), {d}))"
    return f"aggregate(sequence(1, {upto}), 0, (a, k) -> a + {doubled})"


def _luhn_valid(d: str) -> str:
    return f"({_luhn(d, f'length({d}) - 1')} + cast(substring({d}, length({d}), 1) as int)) % 10 = 0"


def _card(x: str, key: str, reverse: bool) -> str:
    check = f"concat(b, cast(pmod(10 - {_luhn('b', 'length(b)')} % 10, 10) as string))"
    new = _let("b", feistel("substring(d, 1, length(d) - 1)", "0123456789", key, "card", reverse), check)
    return _refill(x, _let("d", f"regexp_replace({x}, '[^0-9]', '')", f"if({_luhn_valid('d')}, {new}, d)"), "[^0-9]")


def _digits(x: str, key: str, kind: str, last: int, valid: str, reverse: bool) -> str:
    """The last digits, permuted until they match ``valid``."""
    turn = lambda d: feistel(d, "0123456789", key, kind, reverse)
    walked = f"aggregate(sequence(1, {WALK}), {turn(f'substring(d, length(d) - {last - 1})')}, (w, k) -> if(rlike(w, {_q(valid)}), w, {turn('w')}))"
    new = _let("d", f"regexp_replace({x}, '[^0-9]', '')", f"concat(substring(d, 1, length(d) - {last}), {walked})")
    return _refill(x, new, "[^0-9]")


def _ipv4(x: str, key: str, reverse: bool) -> str:
    packed = f"array_join(transform(split({x}, '[.]'), o -> lpad(lower(hex(cast(o as bigint))), 2, '0')), '')"
    new = feistel(packed, "0123456789abcdef", key, "ipv4", reverse)
    return _let("p", new, "array_join(transform(sequence(0, 3), o -> conv(substring(p, 2 * o + 1, 2), 16, 10)), '.')")


def _date(x: str, key: str, reverse: bool) -> str:
    """Two halves in base 270; the block of days is kept."""
    step = lambda half, i: f"cast(conv(substring(sha2(concat_ws('|', {_q(key)}, 'date', cast({i} as string), cast({half} as string)), 256), 1, 12), 16, 10) as bigint)"
    if reverse:
        body = f"aggregate(reverse(sequence(1, {ROUNDS})), z, (s, i) -> named_struct('l', pmod(s.r - {step('s.l', 'i')}, {RADIX}), 'r', s.l), s -> s)"
    else:
        body = f"aggregate(sequence(1, {ROUNDS}), z, (s, i) -> named_struct('l', s.r, 'r', pmod(s.l + {step('s.r', 'i')}, {RADIX})), s -> s)"
    start = f"named_struct('l', cast(pmod(n, {BLOCK}) div {RADIX} as bigint), 'r', cast(pmod(pmod(n, {BLOCK}), {RADIX}) as bigint))"
    move = lambda n: _let("n", n, _let("z", start, _let("o", body, f"cast(floor(n / {BLOCK}) * {BLOCK} + o.l * {RADIX} + o.r as int)")))
    day = lambda iso: f"try_cast({iso} as date)"
    date = lambda n: f"date_add(date'1900-01-01', {n})"
    days = lambda iso: f"datediff({day(iso)}, date'1900-01-01')"
    show = lambda n, form: _let("m", date(n), f"if(year(m) between 1 and 9999, date_format(m, '{form}'), {x})")
    # only a day over 12 tells m/d/y from d/m/y, so those dates are moved on until they have one again
    walk = f"if(day({date('w')}) > 12, w, {move('w')})"
    walked = lambda iso: f"aggregate(sequence(1, {WALK}), {move(days(iso))}, (w, k) -> {walk})"
    mdy = f"concat(substring({x}, 7, 4), '-', substring({x}, 1, 2), '-', substring({x}, 4, 2))"
    dmy = f"concat(substring({x}, 7, 4), '-', substring({x}, 4, 2), '-', substring({x}, 1, 2))"
    return (
        f"case when {x} like '____-%' then coalesce(if({day(x)} is null, null, {show(move(days(x)), 'yyyy-MM-dd')}), {x}) "
        f"when {day(dmy)} is not null then {show(move(days(dmy)), 'dd/MM/yyyy')} "
        f"when {day(mdy)} is not null then {show(walked(mdy), 'MM/dd/yyyy')} else {x} end"
    )


def _cased(x: str, letters: str, key: str, kind: str, reverse: bool) -> str:
    """``x`` with its letters permuted under its digits, then its digits under the new letters; places and case stay."""
    turn = lambda v, alphabet, part, tweak: f"if({v} = '', '', {feistel(v, alphabet, key, f'{kind}-{part}', reverse, tweak)})"
    new_a = lambda d: turn("a", letters, "letters", d)
    new_d = lambda a: turn("d", "0123456789", "digits", a)
    if reverse:
        both = _let("nd", new_d("a"), _let("na", new_a("nd"), "struct(na as a, nd as d)"))
    else:
        both = _let("na", new_a("d"), _let("nd", new_d("na"), "struct(na as a, nd as d)"))
    nth = lambda kept: f"length(regexp_replace(substring(t, 1, j), {_q(kept)}, ''))"
    c = "substring(t, j, 1)"
    each = f"case when {c} between '0' and '9' then substring(p.d, {nth('[^0-9]')}, 1) when {c} between 'a' and 'z' then substring(p.a, {nth('[^A-Za-z]')}, 1) when {c} between 'A' and 'Z' then upper(substring(p.a, {nth('[^A-Za-z]')}, 1)) else {c} end"
    parts = _let("a", "lower(regexp_replace(t, '[^A-Za-z]', ''))", _let("d", "regexp_replace(t, '[^0-9]', '')", both))
    return _let("t", x, _let("p", parts, f"array_join(transform(sequence(1, length(t)), j -> {each}), '')"))


def _email(x: str, key: str, reverse: bool) -> str:
    """Letters and digits up to the first dot of the domain."""
    head = f"substring({x}, 1, locate('@', {x}) + locate('.', substring({x}, locate('@', {x}) + 1)) - 1)"
    return _let("e", head, f"concat({_cased('e', 'abcdefghijklmnopqrstuvwxyz', key, 'email', reverse)}, substring({x}, length(e) + 1))")


def pseudonym(x: str, key: str, reverse: bool = False) -> str:
    """SQL for the pseudonym of one match."""
    is_kind = lambda kind: f"rlike({x}, {_q(f'^(?:{KINDS[kind]})$')})"
    secret = _cased(x, "abcdef", key, "secret", reverse)
    return (
        f"case when locate('@', {x}) > 0 then {_email(x, key, reverse)} when {is_kind('ipv4')} then {_ipv4(x, key, reverse)} when {is_kind('date')} then {_date(x, key, reverse)} "
        f"when {is_kind('ssn')} then {_digits(x, key, 'ssn', 9, SSN, reverse)} when {is_kind('phone')} then {_digits(x, key, 'phone', 10, PHONE, reverse)} "
        f"when {is_kind('card')} then {_card(x, key, reverse)} else {secret} end"
    )


def _is_valid(x: str) -> str:
    """SQL for what the patterns alone don't tell: days of the calendar and Luhn digits."""
    day = lambda y, m, d: f"try_cast(concat(substring({x}, {y}, 4), '-', substring({x}, {m}, 2), '-', substring({x}, {d}, 2)) as date) is not null"
    is_ = lambda pattern: f"rlike({x}, {_q(f'^(?:{pattern})$')})"
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return (
        f"case when {is_(r'[0-9]{4}-[0-9]{2}-[0-9]{2}')} then {day(1, 6, 9)} when {is_(r'[0-9]{2}/[0-9]{2}/[0-9]{4}')} then {day(7, 4, 1)} or {day(7, 1, 4)} "
        f"when {is_(CARD)} then {_let('d', digits, _luhn_valid('d'))} else true end"
    )


def pseudonymise(docs: DataFrame, key: str, column: str = "text", found: str = "_found", reverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``column``, and the number of findings as ``found``, which gets a number if it is taken."""
    c, own, found = quoted(column), free_name("_spans", docs.columns), free_name(found, docs.columns)
    spans = f"if({c} is null or not rlike({c}, '[0-9][0-9./ -]|@|[0-9a-fA-F]{{32}}'), cast(array() as array<string>), regexp_extract_all({c}, {_q(PATTERN)}, 0))"
    marked = docs.withColumn(own, F.expr(spans))
    new = f"transform({own}, x -> if({_is_valid('x')}, {pseudonym('x', key, reverse)}, x))"
    joined = f"if(size({own}) = 0, {c}, array_join(zip_with(split({c}, {_q(PATTERN)}, -1), {new}, (a, b) -> concat(a, coalesce(b, ''))), ''))"
    n = F.expr(f"cast(size(filter({own}, x -> {_is_valid('x')})) as long)")
    return marked.select(*[F.expr(joined).alias(x) if x == column else F.col(quoted(x)) for x in docs.columns], n.alias(found))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "tidemark-demo-key", found="n_found").select("doc_id", "n_found", "text")
