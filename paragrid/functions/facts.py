"""Typed facts of a text with normalised values, and the units and clauses that hold them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paragrid.functions.text import PARTICLES, fold_space, terms

# Units of money and what they are worth.
MONEY_UNITS = {"조": 10**12, "억": 10**8, "천만": 10**7, "백만": 10**6, "십만": 10**5, "만": 10**4, "천": 10**3, "백": 10**2}
MONEY = r"(?:[0-9][0-9,]*(?:[.][0-9]+)? ?(?:조|억|천만|백만|십만|만|천|백)? ?)+원"
MONEY_PART = r"[0-9][0-9,]*(?:[.][0-9]+)? ?(?:조|억|천만|백만|십만|만|천|백)?"
DATE = r"[0-9]{4}(?:년 ?[0-9]{1,2}월 ?[0-9]{1,2}일|[.] ?[0-9]{1,2}[.] ?[0-9]{1,2}[.]?|-[0-9]{1,2}-[0-9]{1,2})"
CLOCK = r"(?:오전|오후) ?[0-9]{1,2}시(?: ?[0-9]{1,2}분)?|[0-9]{1,2}:[0-9]{2}"
# What quantities count, the longer first.
QUANTITY = r"[0-9][0-9,]*(?:[.][0-9]+)? ?(?:학점|시간|개월|명|건|회|점|부|주)"
PHONE = r"0[0-9]{1,2}-[0-9]{3,4}-[0-9]{4}|내선 ?[0-9]{4}"
COMPARED = r"([0-9][0-9,.]*) ?(?:%|명|건|회|점|시간|학점|일|원|만 ?원)? ?(이상|이하|초과|미만)"
# Endings that deny, forbid or except.
DENIED = "않|아니|아닙|못|없|불가|금지|제외|제한"
CONNECTIVES = r"(하고|하며|하되|이며|이고|지만|으나),? |[;·]| 및 "


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _numbers(text: Column) -> Column:
    return _all(text, "[0-9]+")


def _two(value: Column) -> Column:
    return F.lpad(value.cast("int").cast("string"), 2, "0")


def money(expression: Column) -> Column:
    """What an amount in words and digits is in won: "3억 2천만 원" is 320,000,000."""

    def worth(part: Column) -> Column:
        number = F.regexp_replace(F.regexp_extract(part, "[0-9,.]+", 0), ",", "").cast("double")
        unit = F.regexp_replace(part, "[0-9,. ]+", "")
        factor = reduce(lambda rest, kv: F.when(unit == kv[0], F.lit(float(kv[1]))).otherwise(rest), MONEY_UNITS.items(), F.lit(1.0))
        return number * factor

    return F.aggregate(_all(expression, MONEY_PART), F.lit(0.0), lambda s, p: s + worth(p)).cast("long")


def typed_facts(text: Column) -> Column:
    """Distinct facts ``kind:value`` of a text in order: years and terms, dates, times in minutes, won, shares, quantities, telephones.

    A date of any notation has one value, as has an amount in digits or in words; null for null.
    """
    flat = fold_space(text)

    def each(kind: str, pattern: str, value) -> Column:
        return F.transform(_all(flat, pattern), lambda m: F.concat(F.lit(kind + ":"), value(m)))

    def date(m: Column) -> Column:
        n = _numbers(m)
        return F.concat(F.get(n, 0), F.lit("-"), _two(F.get(n, 1)), F.lit("-"), _two(F.get(n, 2)))

    def clock(m: Column) -> Column:
        n = _numbers(m)
        hour = F.get(n, 0).cast("int") % F.when(m.rlike("^오"), 12).otherwise(24) + F.when(m.rlike("^오후"), 12).otherwise(0)
        return (hour * 60 + F.coalesce(F.get(n, 1).cast("int"), F.lit(0))).cast("string")

    bare = lambda m: F.regexp_replace(m, "[, ]", "")
    dateless = F.regexp_replace(flat, DATE, "|")
    days = F.transform(_all(dateless, "[0-9]{1,2}월 ?[0-9]{1,2}일"), lambda m: F.concat(F.lit("month_day:"), _two(F.get(_numbers(m), 0)), F.lit("-"), _two(F.get(_numbers(m), 1))))
    found = [
        each("academic_year", "[0-9]{4}학년도", lambda m: F.substring(m, 1, 4)), each("semester", "[1-4]학기", lambda m: F.substring(m, 1, 1)),
        each("date", DATE, date), days, each("time_minutes", CLOCK, clock), each("amount_krw", MONEY, lambda m: money(m).cast("string")),
        each("percent", r"[0-9]+(?:[.][0-9]+)? ?%", lambda m: F.regexp_replace(m, "[ %]", "")), each("quantity", QUANTITY, bare), each("phone", PHONE, lambda m: F.regexp_replace(m, "[^0-9]", "")),
    ]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def scope_facts(facts: Column) -> Column:
    """The facts that fix a scope: academic years and terms."""
    return F.filter(facts, lambda f: f.startswith("academic_year:") | f.startswith("semester:"))


def scopes_conflict(left: Column, right: Column) -> Column:
    """Whether two lists of facts name the same kind of scope with no value in common."""

    def clash(kind: str) -> Column:
        a, b = (F.filter(s, lambda f: f.startswith(kind)) for s in (left, right))
        return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)

    return clash("academic_year:") | clash("semester:")


def comparators(text: Column) -> Column:
    """Bounds ``value:word`` of a text, such as "20:이상"; amounts of money in won."""
    flat = fold_space(text)

    def bound(m: Column) -> Column:
        value = F.when(F.contains(m, F.lit("원")), money(m).cast("string")).otherwise(F.regexp_replace(F.regexp_extract(m, COMPARED, 1), ",", ""))
        return F.concat(value, F.lit(":"), F.regexp_extract(m, COMPARED, 2))

    return F.transform(_all(flat, COMPARED), bound)


def denies(text: Column) -> Column:
    """Whether a text denies, forbids or excepts."""
    return text.rlike(DENIED)


def conflicts(claim: Column, unit: Column) -> Column:
    """Names of what a claim and a unit of evidence contradict each other in: polarity, bound, scope, phone, fact."""
    a, b = typed_facts(claim), typed_facts(unit)
    own = lambda facts, kind: F.filter(facts, lambda f: f.startswith(kind))
    lacking = F.size(F.array_except(a, b)) > 0
    bounds_a, bounds_b = comparators(claim), comparators(unit)
    phone = (F.size(own(a, "phone:")) > 0) & (F.size(own(b, "phone:")) > 0) & ~F.arrays_overlap(own(a, "phone:"), own(b, "phone:"))
    tests = (
        ("polarity", denies(claim) != denies(unit)), ("bound", (F.size(bounds_a) > 0) & (F.size(F.array_except(bounds_a, bounds_b)) > 0)),
        ("scope", scopes_conflict(a, b)), ("phone", phone), ("fact", lacking),
    )
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda n: n.isNotNull())


def evidence_units(text: Column, longest: int = 500) -> Column:
    """The lines of a text, and each line with the next one if both fit ``longest`` characters together."""
    lines = F.filter(F.transform(F.split(text, "\n+", -1), lambda s: F.trim(s)), lambda s: s != "")
    pairs = F.zip_with(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0))), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit("\n"), y))
    return F.concat(lines, F.filter(pairs, lambda p: F.length(p) <= longest))


def clauses(text: Column) -> Column:
    """The clauses of a sentence, cut after connective endings and at semicolons, middle dots and "및"."""
    cut = F.regexp_replace(fold_space(text), CONNECTIVES, "$1\n")
    return F.filter(F.transform(F.split(cut, "\n", -1), lambda s: F.trim(s)), lambda s: s != "")


def draft_claims(text: Column) -> Column:
    """The lines of a draft answer as claims, without bullets and citation marks."""
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"^[ \t]*([-*•·○□]|[0-9]{1,2}[.)])[ \t]+", ""), r"\[[0-9]+\]", ""))
    return F.filter(F.transform(F.split(text, "\n", -1), bare), lambda s: s != "")


def table_matrix(text: Column) -> Column:
    """A table's text as rows of cells: cells by tabs, else by bars, else by two and more spaces."""
    rows = F.filter(F.split(text, "\n", -1), lambda r: F.trim(r) != "")

    def cells(row: Column) -> Column:
        mark = F.when(F.contains(row, F.lit("\t")), F.split(row, "\t", -1)).when(row.rlike(r"[|│]"), F.split(F.regexp_replace(row, r"^\s*[|│]|[|│]\s*$", ""), r"[|│]", -1)).otherwise(F.split(row, " {2,}", -1))
        return F.transform(mark, lambda c: F.trim(c))

    return F.transform(rows, cells)


def term_variants(term: Column) -> Column:
    """A term, and what is left of it without a particle if that has two syllables."""
    return F.array_distinct(F.array(term, F.regexp_replace(term, f"^(..+?)({PARTICLES})$", "$1")))


def terms_supported(claim: Column, source: Column) -> Column:
    """The claim's distinct terms that the source has, as they are, as variants, or one inside the other."""
    held = F.array_distinct(F.flatten(F.transform(terms(source), term_variants)))
    fits = lambda x, y: (x == y) | ((F.length(x) > 1) & (F.length(y) > 1) & (F.contains(x, y) | F.contains(y, x)))
    return F.filter(F.array_distinct(terms(claim)), lambda t: F.exists(held, lambda h: F.exists(term_variants(t), lambda v: fits(v, h))))


def identifiers(text: Column) -> Column:
    """Codes of a text in upper case: letters with digits, joined by hyphens."""
    return F.array_distinct(F.transform(_all(text, "[A-Za-z]{2,}(?:-[A-Za-z0-9]+)+|[0-9]{5,}"), lambda m: F.upper(m)))


def term_in_text(term: Column, text: Column) -> Column:
    """Whether a text has a term: Latin ones as whole tokens, others anywhere, spaces aside."""
    latin = F.array_contains(terms(text), F.lower(term))
    return F.when(term.rlike("^[A-Za-z0-9]+$"), latin).otherwise(F.contains(F.regexp_replace(text, " ", ""), F.regexp_replace(term, " ", "")))


def longest_known_prefix(term: Column, text: Column, least: int = 2) -> Column:
    """The longest beginning of a term, of at least ``least`` characters, that a text holds; empty if none."""
    sizes = F.when(F.length(term) >= least, F.sequence(F.length(term), F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.get(F.filter(F.transform(sizes, lambda n: F.substring(term, F.lit(1), n)), lambda p: F.contains(text, p)), 0), F.lit(""))


def temporal_facets(text: Column) -> Column:
    """What a text says of time: date, time, term, deadline, period."""
    tests = (("date", f"{DATE}|[0-9]{{1,2}}월 ?[0-9]{{1,2}}일"), ("time", CLOCK), ("term", "[0-9]{4}학년도|[1-4]학기"), ("deadline", "까지|마감"), ("period", "부터|기간|동안"))
    return F.when(text.isNotNull(), F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in tests)), lambda n: n.isNotNull()))
