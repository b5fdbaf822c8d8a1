"""Predicates and scalar expressions of trace queries."""

from __future__ import annotations

from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RangeRule(Enum):
    """How a zone is held against a time range; which rule applies depends on the query."""

    CONTAINED = "contained"  # statistics, find zone: start >= from and end <= to
    START_HALF_OPEN = "start_half_open"  # comparison, allocations, samples, zones in frame: from <= start < to
    CLAMPED = "clamped"  # zone flame graph: what overlaps, clipped
    CLOSED = "closed"  # sample flame graph: from <= time <= to


def in_range(rule: RangeRule, start: Column, end: Column, since: int, until: int) -> Column:
    if rule is RangeRule.CONTAINED:
        return (start >= since) & (end <= until)
    if rule is RangeRule.START_HALF_OPEN:
        return (start >= since) & (start < until)
    if rule is RangeRule.CLAMPED:
        return (end > since) & (start < until)
    return (start >= since) & (start <= until)


def clipped(start: Column, end: Column, since: int, until: int) -> Column:
    return F.greatest(F.least(end, F.lit(until)) - F.greatest(start, F.lit(since)), F.lit(0))


def contains(name: Column, part: str, ignore_case: bool = True) -> Column:
    return F.lower(name).contains(part.lower()) if ignore_case else name.contains(part)


def text_filter(name: Column, expression: str) -> Column:
    """Comma: any of the terms; a leading minus excludes; case is ignored. Without including terms all others pass."""
    terms = [t.strip() for t in expression.split(",") if t.strip()]
    wanted = [contains(name, t) for t in terms if t[0] != "-"]
    barred = [~contains(name, t[1:]) for t in terms if t[0] == "-" and len(t) > 1]
    any_of = reduce(lambda a, b: a | b, wanted) if wanted else F.lit(True)
    return reduce(lambda a, b: a & b, barred, any_of)


def matching_locations(locations: DataFrame, zones: DataFrame, part: str, ignore_case: bool = True) -> DataFrame:
    """Source locations whose name or function holds ``part`` and that have zones."""
    hits = locations.where(contains(F.coalesce("name", "function"), part, ignore_case))
    return hits.join(zones.select("srcloc").distinct(), "srcloc", "left_semi")


def message_filter(text: str | None = None, sources: list[str] | None = None, severities: list[str] | None = None, threads: list[int] | None = None) -> Column:
    tests = [text_filter(F.col("text"), text)] if text else []
    tests += [F.col(c).isin(v) for c, v in (("source", sources), ("severity", severities), ("thread", threads)) if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def zone_name(override: Column, name: Column, function: Column) -> Column:
    return F.coalesce(override, name, function)


def is_kernel(address: Column) -> Column:
    """The top bit of an unsigned address, as the sign."""
    return address < 0


#: What images and source paths of code that isn't the program's own begin with, or are.
EXTERNAL_IMAGES = ("/usr/", "/lib/", "/lib64/")
EXTERNAL_PATHS = ("/usr/", "/lib/", "C:\\Program Files", "d:\\a01\\_work\\")
EXTERNAL_NAMES = ("[unknown]", "<kernel>")


def is_external(image: Column, file: Column) -> Column:
    """Frames of system libraries, of the kernel, of unknown places and below hidden directories; a null path or image is
    the program's own. Letters count as they are."""
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    image, path = F.coalesce(image, F.lit("")), F.coalesce(file, F.lit(""))
    hidden = path.rlike(r"(?s)/\.([^.]|\z)")
    return any_of([image.startswith(x) for x in EXTERNAL_IMAGES]) | (image == "<kernel>") | any_of([path.startswith(x) for x in EXTERNAL_PATHS]) | path.isin(*EXTERNAL_NAMES) | hidden


def substituted(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Ordered regular-expression replacements."""
    return reduce(lambda p, r: F.regexp_replace(p, r[0], r[1]), rules, path)


def thread_name(own: Column, external: Column, thread: Column) -> Column:
    """Own name unless it is only the number, else the external one, else ???."""
    named = F.when(own.isNotNull() & (own != thread.cast("string")), own)
    return F.coalesce(named, external, F.lit("???"))


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _thousandths(v: Column, unit: str) -> Column:
    """A number of thousandths with up to two decimals: rounded half up, up to half of one left out, no zeros at the end."""
    whole, rest = _div(v, 1000), v % 1000
    hundredths = _div(rest + 5, 10)
    decimals = F.when(rest <= 5, "").when(hundredths % 10 == 0, F.concat(F.lit("."), _div(hundredths, 10).cast("string"))).otherwise(F.concat(F.lit("."), _two(hundredths)))
    number = F.when(rest >= 995, (whole + 1).cast("string")).otherwise(F.concat(whole.cast("string"), decimals))
    return F.concat(number, F.lit(f" {unit}"))


def format_time(ns: Column) -> Column:
    """Nanoseconds for people: up to a minute in the unit that gives a whole part, then m:ss.f, h:mm:ss and d'd'hh:mm:ss."""
    a, second, minute, hour = F.abs(ns), 1_000_000_000, 60_000_000_000, 3_600_000_000_000
    ms = _div(a % minute, 1_000_000)
    whole, rest = _div(ms, 1000), ms % 1000
    tenths = F.when(rest > 50, F.concat(F.lit("."), _div(rest + 50, 100).cast("string"))).otherwise("")
    seconds = F.when(rest >= 950, _two(whole + 1)).otherwise(F.concat(_two(whole), tenths))
    clock = F.concat(F.lit(":"), _two(_div(a % hour, minute)), F.lit(":"), _two(_div(a % minute, second)))
    shown = (
        F.when(a < 1_000, F.concat(a.cast("string"), F.lit(" ns")))
        .when(a < 1_000_000, _thousandths(a, "μs"))
        .when(a < second, _thousandths(_div(a, 1_000), "ms"))
        .when(a < minute, _thousandths(_div(a, 1_000_000), "s"))
        .when(a < hour, F.concat(_div(a, minute).cast("string"), F.lit(":"), seconds))
        .when(a < 24 * hour, F.concat(_div(a, hour).cast("string"), clock))
        .otherwise(F.concat(_div(a, 24 * hour).cast("string"), F.lit("d"), _two(_div(a % (24 * hour), hour)), clock))
    )
    return F.concat(F.when(ns < 0, "-").otherwise(""), shown)


def format_bytes(n: Column) -> Column:
    """Bytes in the unit that gives less than 10,000, with up to two decimals (of two as near the even one)."""
    a = F.abs(n)

    def scaled(power: int) -> Column:
        unit = 1 << 10 * power
        whole, rest = _div(a, unit), a % unit
        q, r = _div(rest * 100, unit), (rest * 100) % unit
        q = q + F.when((2 * r > unit) | ((2 * r == unit) & (q % 2 == 1)), 1).otherwise(0)
        number = F.concat((whole + _div(q, 100)).cast("string"), F.lit("."), _two(q % 100))
        return F.concat(F.regexp_replace(number, r"\.?0+$", ""), F.lit(f" {' KMGT'[power]}B"))

    shown = F.when(a < 10_000, F.concat(a.cast("string"), F.lit(" bytes")))
    for power in (1, 2, 3):
        shown = shown.when(a < 10_000 << 10 * power, scaled(power))
    return F.concat(F.when(n < 0, "-").otherwise(""), shown.otherwise(scaled(4)))


def format_count(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def format_location(file: Column, line: Column) -> Column:
    return F.when(line.isNull() | (line == 0), file).otherwise(F.concat_ws(":", file, line.cast("string")))


def short_name(name: Column) -> Column:
    """A C++ function name without template arguments, parameters, trailing const, return type and namespaces.

    Brackets nest to any depth: one pass over the characters keeps what lies outside of all of them.
    """
    out = F.regexp_replace(name, r"operator\s*(<=>|<<|>>|<=|>=|<|>|->|\(\))", "operator_")
    for opened, closed in (("<", ">"), ("(", ")")):
        # pieces that begin with a bracket; the number of brackets open after each is a running sum
        pieces = F.regexp_extract_all(out, F.lit(rf"[{opened}{closed}]?[^{opened}{closed}]*"), F.lit(0))
        state = F.aggregate(
            pieces,
            F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept")),
            lambda s, x: F.struct(
                _depth(s["depth"], x, opened, closed).alias("depth"),
                F.when(_depth(s["depth"], x, opened, closed) == 0, F.concat(s["kept"], F.when((s["depth"] > 0) | x.startswith(opened), F.substr(x, F.lit(2))).otherwise(x))).otherwise(s["kept"]).alias("kept"),
            ),
        )
        out = state["kept"]
    out = F.regexp_replace(F.trim(out), r"\s+(const|noexcept|volatile|&&?)$", "")
    return F.regexp_replace(F.regexp_replace(F.trim(out), r"^.*[\s*&]", ""), r"^.*::(?=[^:])", "")


def _depth(before: Column, piece: Column, opened: str, closed: str) -> Column:
    """Brackets open after a piece; a closing one without an opening one counts as text."""
    return F.when(piece.startswith(opened), before + 1).when(piece.startswith(closed) & (before > 0), before - 1).otherwise(before)
