"""Figures in prose: numbers, dates, spelled-out counts, and whether a claim matches its source.

A figure is a struct: ``text`` as written, ``value``, ``decimals`` written, ``is_percent``,
``trailing_zeros`` (magnitude it may be rounded to), ``approx`` (written as a rounded figure) and
``before`` (the text since the previous figure, to tell labels such as "Table 2" from facts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra.functions.text import strip

# --- fixed values: patterns and word lists that decide what counts as a figure -------------------
NUMBER = (
    r"(?U)(?<![\w.\-/])([$€£¥₫])?\s?"
    r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"
    r"\s?(%|k\b|K\b|M\b|m\b(?!m)|bn\b|B\b)?(?!\w)"
)
UNIT = r"(?U)^(k\b|K\b|M\b|m\b(?!m)|bn\b|B\b)"  # a power of ten at the beginning of a text
APPROX_BEFORE = (
    r"(?iU)(about|approx\.?|approximately|around|roughly|nearly|almost|circa|ca\.|~|≈|some|khoảng|gần|xấp xỉ)"
    r"\s*[$€£¥₫]?\s*$"
)
SUFFIXES = {"k": 3, "K": 3, "M": 6, "m": 6, "bn": 9, "B": 9}  # powers of ten; "5 m" counts as 5 million
WORD_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
}
DIGIT = r"(?U)\d"
YEAR = r"(?U)\d{4}"  # every date has one
SQL_NUMBER = r"(?U)(?<![\w.'])(\d+(?:\.\d+)?)(?![\w.'])"


def _any_of(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_WORDS = _any_of(WORD_NUMBERS)
_MONTH = _any_of(MONTHS)
WORD = rf"(?iU)\b({_WORDS})\b(?!-)"
COUNT = (
    rf"(?iU)\b({_WORDS}|\d+)\s+(?:out\s+)?of\s+(?:the\s+|all\s+|its\s+|their\s+|these\s+|those\s+)?"
    rf"({_WORDS}|\d+)\b"
)
ISO_DATE = r"(?<![\w-])(\d{4})-(\d{2})-(\d{2})(?![\w-])"
DAY_FIRST = rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(\d{{4}})\b"
MONTH_FIRST = rf"\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b"
DATE = rf"(?iU){ISO_DATE}|{DAY_FIRST}|{MONTH_FIRST}"
# -------------------------------------------------------------------------------------------------

FIGURE = (
    "struct<text:string,value:double,decimals:int,is_percent:boolean,trailing_zeros:int,approx:boolean,before:string>"
)


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _figure(text, value, decimals, percent, zeros, approx, before) -> Column:
    return F.struct(
        text.alias("text"),
        value.cast("double").alias("value"),
        decimals.cast("int").alias("decimals"),
        percent.alias("is_percent"),
        zeros.cast("int").alias("trailing_zeros"),
        approx.alias("approx"),
        before.alias("before"),
    ).cast(FIGURE)


def find_numbers(c: Column) -> Column:
    """Array of figures, in order.

    The text between figures comes from splitting on the same pattern, so the words before a figure
    are known without match positions.
    """
    whole = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    gaps = F.split(c, NUMBER)
    powers = _lookup(SUFFIXES)

    def parts(z: Column) -> Column:
        raw = F.replace(F.regexp_extract(z["w"], NUMBER, 2), F.lit(","), F.lit(""))
        suffix = F.regexp_extract(z["w"], NUMBER, 3)
        return F.struct(
            strip(z["w"]).alias("text"),
            raw.alias("raw"),
            F.when(raw.contains("."), F.length(F.substring_index(raw, ".", -1))).otherwise(0).alias("decimals"),
            F.try_element_at(powers, suffix).alias("power"),
            (suffix == "%").alias("percent"),
            z["g"].alias("before"),
        )

    def one(p: Column) -> Column:
        value, power = p["raw"].try_cast("double"), p["power"]
        zeros = F.when(p["decimals"] > 0, 0).otherwise(F.length(p["raw"]) - F.length(F.rtrim(p["raw"], F.lit("0"))))
        return _figure(
            p["text"],
            F.when(power.isNull(), value).otherwise(value * F.pow(F.lit(10.0), power)),
            F.when(power.isNull(), p["decimals"]).otherwise(0),
            p["percent"],
            F.when(power.isNull(), zeros).otherwise(F.greatest(F.lit(0), power - p["decimals"])),
            power.isNotNull() | F.right(p["before"], F.lit(24)).rlike(APPROX_BEFORE),
            p["before"],
        )

    # the text after the last figure is the one gap without a figure
    zipped = F.filter(F.arrays_zip(whole.alias("w"), gaps.alias("g")), lambda z: z["w"].isNotNull())
    figures = F.transform(F.transform(zipped, parts), one)
    return F.when(c.rlike(DIGIT), figures).otherwise(F.array().cast(f"array<{FIGURE}>"))


def number_values(c: Column) -> Column:
    """Only the values of ``find_numbers``, for evidence: one pass over the text."""
    powers = _lookup(SUFFIXES)

    def value(w: Column) -> Column:
        raw = F.replace(F.regexp_extract(w, NUMBER, 2), F.lit(","), F.lit("")).try_cast("double")
        power = F.try_element_at(powers, F.regexp_extract(w, NUMBER, 3))
        return F.when(power.isNull(), raw).otherwise(raw * F.pow(F.lit(10.0), power))

    values = F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), value)
    return F.when(c.rlike(DIGIT), values).otherwise(F.array().cast("array<double>"))


def _date_parts(m: Column) -> Column:
    months = _lookup(MONTHS)
    iso = m.rlike(r"^\d{4}-")
    day_first = m.rlike(r"(?U)^\d{1,2}(?!\d)") & ~iso
    pick = lambda rx, g: F.regexp_extract(m, "(?iU)" + rx, g)
    y = F.when(iso, pick(ISO_DATE, 1)).when(day_first, pick(DAY_FIRST, 3)).otherwise(pick(MONTH_FIRST, 3))
    d = F.when(iso, pick(ISO_DATE, 3)).when(day_first, pick(DAY_FIRST, 1)).otherwise(pick(MONTH_FIRST, 2))
    name = F.lower(F.when(day_first, pick(DAY_FIRST, 2)).otherwise(pick(MONTH_FIRST, 1)))
    mon = F.when(iso, pick(ISO_DATE, 2).try_cast("int")).otherwise(F.try_element_at(months, name))
    return F.struct(m.alias("m"), y.try_cast("int").alias("y"), mon.alias("mon"), d.try_cast("int").alias("d"))


def _is_date(p: Column) -> Column:
    day = F.format_string("%04d-%02d-%02d", p["y"], p["mon"], p["d"]).try_cast("date")
    return (p["y"] > 0) & day.isNotNull()


def find_dates(c: Column) -> Column:
    """Full dates as figures whose value is YYYYMMDD; impossible dates are dropped."""
    found = F.regexp_extract_all(c, F.lit(DATE), F.lit(0))
    real = F.filter(F.transform(found, _date_parts), _is_date)
    none = F.lit(False)
    days = F.transform(
        real,
        lambda p: _figure(
            p["m"], p["y"] * 10000 + p["mon"] * 100 + p["d"], F.lit(0), none, F.lit(0), none, F.lit("")
        ),
    )
    return F.when(c.rlike(YEAR), days).otherwise(F.array().cast(f"array<{FIGURE}>"))


def blank_dates(c: Column) -> Column:
    """The text with blanks where :func:`find_dates` finds a date, at exactly those places."""
    found = F.transform(F.regexp_extract_all(c, F.lit(DATE), F.lit(0)), _date_parts)
    shown = F.transform(found, lambda p: F.when(F.coalesce(_is_date(p), F.lit(False)), F.repeat(F.lit(" "), F.length(p["m"]))).otherwise(p["m"]))
    pieces = F.arrays_zip(F.split(c, DATE).alias("gap"), shown.alias("date"))
    joined = F.array_join(F.transform(pieces, lambda z: F.concat(z["gap"], F.coalesce(z["date"], F.lit("")))), "")
    return F.when(c.rlike(YEAR), joined).otherwise(c)


def word_numbers(c: Column) -> Column:
    """Values of spelled-out numbers ("seven"), not the first half of "twenty-five"."""
    values = _lookup(WORD_NUMBERS)
    words = F.regexp_extract_all(c, F.lit(WORD), F.lit(1))
    return F.transform(words, lambda w: F.element_at(values, F.lower(w)).cast("double"))


def count_words(c: Column) -> Column:
    """Spelled-out figures of phrases like "six of the eight"; a leading "one" is idiom, digits are found elsewhere."""
    values = _lookup(WORD_NUMBERS)
    first = F.regexp_extract_all(c, F.lit(COUNT), F.lit(1))
    second = F.regexp_extract_all(c, F.lit(COUNT), F.lit(2))
    firsts = F.transform(first, lambda w: F.when(F.lower(w) != "one", w))
    pairs = F.flatten(F.zip_with(firsts, second, lambda a, b: F.array(a, b)))
    words = F.filter(pairs, lambda w: w.isNotNull() & ~w.rlike(r"(?U)^\d+$"))
    none = F.lit(False)
    counts = F.transform(
        words,
        lambda w: _figure(w, F.element_at(values, F.lower(w)), F.lit(0), none, F.lit(0), none, F.lit("")),
    )
    return F.when(c.rlike(r"(?iU)\sof\s"), counts).otherwise(F.array().cast(f"array<{FIGURE}>"))


def evidence_numbers(c: Column) -> Column:
    """Every value a source states: figures, spelled-out numbers and dates."""
    nums = number_values(c)
    days = F.transform(find_dates(c), lambda n: n["value"])
    return F.concat(nums, word_numbers(c), days)


def sql_numbers(c: Column) -> Column:
    """Number literals of a query text: thresholds the query states count as evidence."""
    return F.transform(F.regexp_extract_all(c, F.lit(SQL_NUMBER), F.lit(1)), lambda x: x.try_cast("double"))


MAX_WRITTEN_DECIMALS = 15  # a double holds no more; figures written longer only match as equal


def round_half_up(x: Column, decimals: Column) -> Column:
    """``x`` at a number of decimals that is a column; null beyond what a double holds."""
    out = F.round(x, 0)
    branch = F.when(decimals == 0, out)
    for d in range(1, MAX_WRITTEN_DECIMALS + 3):
        branch = branch.when(decimals == d, F.round(x, d))
    return branch


def is_close(claimed: Column, found: Column) -> Column:
    """Equal but for the noise of floating point."""
    return F.abs(claimed - found) <= F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(F.abs(claimed), F.abs(found)))


def _same(claimed: Column, found: Column, decimals: Column, zeros: Column) -> Column:
    close = is_close(claimed, found)
    written = F.abs(round_half_up(found, decimals) - claimed) < F.pow(F.lit(10.0), -decimals) / 1000
    step = F.pow(F.lit(10.0), zeros)
    coarse = (zeros > 0) & (F.abs(F.bround(found / step, 0) * step - claimed) < 1e-9)
    return close | F.coalesce(written, F.lit(False)) | coarse


def numbers_match(figure: Column, evidence: Column) -> Column:
    """True if a value of ``evidence`` equals the figure at the precision it is written.

    Rounding to a coarser magnitude counts only for figures written as approximate; a percentage
    also matches the fraction.
    """
    zeros = F.when(figure["approx"], figure["trailing_zeros"]).otherwise(0)

    def hit(e: Column) -> Column:
        plain = _same(figure["value"], e, figure["decimals"], zeros)
        fraction = _same(figure["value"] / 100.0, e, figure["decimals"] + 2, F.lit(0))
        return plain | (figure["is_percent"] & fraction)

    return F.coalesce(F.exists(evidence, hit), F.lit(False))


def plain_number(x: Column) -> Column:
    """Shortest decimal form of a double without exponent: 0.1, 148250."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    text = F.round(x, 10).try_cast("decimal(38,10)").cast("string")
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
    # beyond the decimal's range, or where its ten places lose more than noise: as Spark writes it
    kept = F.coalesce(F.abs(text.cast("double") - x) <= F.abs(x) * 1e-9, F.lit(False))
    return F.when(whole, x.try_cast("decimal(20,0)").cast("string")).when(kept, short).otherwise(x.cast("string"))


def format_value(c: Column, data_type: str, number_format: Column | None = None) -> Column:
    """A typed cell as text: nothing lost, whole numbers plain, percent formats shown as percent."""
    if data_type == "boolean":
        shown = F.when(c, "TRUE").otherwise("FALSE")
    elif data_type == "timestamp":
        midnight = F.date_format(c, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
        shown = F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))
    elif data_type in ("double", "bigint"):
        x = c.cast("double")
        plain = plain_number(x) if data_type == "double" else c.cast("string")
        if number_format is None:
            shown = plain
        else:
            percent = F.concat(plain_number(x * 100), F.lit("%"))
            shown = F.when(F.coalesce(number_format.contains("%"), F.lit(False)), percent).otherwise(plain)
        odd = F.isnan(x) | x.isin(float("inf"), float("-inf"))
        names = F.when(F.isnan(x), "nan").when(x > 0, "inf").otherwise("-inf")
        shown = F.when(odd, names).otherwise(shown) if data_type == "double" else shown
    elif data_type == "date":
        shown = F.date_format(c, "yyyy-MM-dd")
    else:
        shown = strip(c.cast("string"))
    return F.when(c.isNull(), "").otherwise(shown)


def display_number(x: Column) -> Column:
    """Short form for people: whole numbers plain, four decimals from 1 up, else six significant digits."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    four = F.regexp_replace(F.format_string("%.4f", x), r"\.?0+$", "")
    size = F.floor(F.log10(F.abs(x))).cast("int")
    tidy = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    sci = F.format_string("%.5e", x)
    head, tail = F.substring_index(sci, "e", 1), F.substring_index(sci, "e", -1)
    fixed = F.when(size == -1, F.format_string("%.6f", x)).when(size == -2, F.format_string("%.7f", x))
    fixed = fixed.when(size == -3, F.format_string("%.8f", x)).otherwise(F.format_string("%.9f", x))
    small = F.when(size < -4, F.concat(tidy(head), F.lit("e"), tail)).otherwise(tidy(fixed))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    shown = F.when(F.isnan(x) | (F.abs(x) == float("inf")), odd).when(whole, x.cast("decimal(20,0)").cast("string"))
    shown = shown.when(F.abs(x) >= 1, four).otherwise(small)
    return F.when(x.isNull(), "").otherwise(shown)
