"""Quantities in different units and notations, converted to one unit.

A quantity's unit is found from the identities that it takes part in: each
combination of units has a log residual in each identity, and the combination of
least cost is chosen. `unit_solutions` does so for columns of numbers whose unit
depends on the source (mass = density x volume), over all rows of a source at
once. `normalise_amounts` does so for amounts of money written as text: the
combinations are those of notation (which separator is decimal), scale and
currency that the writing leaves open, the identity is total = subtotal + tax,
and the cost of a combination is its log residual and, for each thing stated
that it breaks, `trust`. So a statement is a strong prior: with the default no
residual of a rounding error or a thousandfold outweighs it, but the amount is
flagged as not unique; with a small `trust` the residual chooses. What isn't
stated costs nothing where the identity then holds: a scale that only subtotal
or tax have, and the notation of amounts without any stated currency (of those
with one, a lone point is decimal and a comma before three digits groups).

Solutions are flagged as not unique where another combination of a different
value fits as well, where the best fits badly, or where a number that can be
read in two ways has no identity to tell.

Everything is built of JVM expressions. Defined results: null, blank and
wordy values (no digit) have no amount; a value whose unit is stated nowhere and
found by no identity has none either; repeated rows stay repeated; extra columns
are kept; sources without a row that an identity can judge have null units.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits and marks of other scripts, and what they stand for.
DIGITS_FROM = "０１２３４５６７８９٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९"
DIGITS_TO = "0123456789" * 4
MARKS_FROM = "٫٬．，’‘＇−–—‒－﹣    （）￥＄﹩￡"
MARKS_TO = ".,.,'''------    ()¥$$£"

# Scales and the power of ten of each.
SCALES = {
    3: "k thousand thousands tsd".split(),
    5: "lakh lakhs lac lacs".split(),
    6: "m mn mio mln million millions".split(),
    7: "crore crores cr".split(),
    9: "b bn mrd billion billions".split(),
}
# Sub-units of a hundredth, with the currency that the word alone implies.
SUBUNITS = {
    "us cent": "USD", "us cents": "USD", "¢": "USD", "euro cent": "EUR", "euro cents": "EUR", "eurocent": "EUR", "eurocents": "EUR", "pence": "GBP", "penny": "GBP",
    "pennies": "GBP", "p": "GBP", "fils": "AED", "rappen": "CHF", "cent": None, "cents": None, "paisa": None, "paisas": None, "paise": None, "centime": None,
    "centimes": None, "sen": None,
}
# Codes, signs and first words of names of currencies.
CODES = ["USD", "EUR", "GBP", "PKR", "JPY", "INR", "AED", "CHF"]
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "₨": "PKR", "¥": "JPY", "rs": "PKR"}
NAMES = {
    "USD": ["us dollar", "u.s. dollar"], "EUR": ["euro"], "GBP": ["pound sterling", "pounds sterling", "british pound"], "PKR": ["pakistan rupee", "pakistani rupee"],
    "JPY": ["japanese yen", "yen"], "INR": ["indian rupee"], "AED": ["uae dirham", "emirati dirham"], "CHF": ["swiss franc"],
}


def plain(text: Column) -> Column:
    """The text with ASCII digits and marks."""
    return F.translate(text, DIGITS_FROM + MARKS_FROM, DIGITS_TO + MARKS_TO)


NUMBER = r"(?:\d+(?:[.,']\d+| \d{3}(?!\d))*)"


_CODE = "|".join(c.lower() for c in CODES)
_NAME = "|".join(n.replace(".", r"\.") for names in NAMES.values() for n in names)
_IMPLIED = "|".join(sorted((w for w, c in SUBUNITS.items() if c and w != "¢"), key=len, reverse=True))
CURRENCY = rf"(?<![a-z])(?:{_CODE}|rs|(?:{_NAME})s?|{_IMPLIED})(?![a-z])|[$€£¥₹₨¢]"


def _looked_up(word: Column, table: dict) -> Column:
    """What a table of fixed values has for a word, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), word)


_CURRENCY_WORDS = (
    {c.lower(): c for c in CODES} | SIGNS | {w: c for w, c in SUBUNITS.items() if c} | {f: c for c, names in NAMES.items() for n in names for f in (n, n + "s")}
)
_SCALE_WORDS = {w: power for power, words in SCALES.items() for w in words}


def currency_of(text: Column) -> Column:
    """The currency that a short text states first by code, sign, name or sub-unit, else null."""
    return _looked_up(F.regexp_extract(F.lower(text), CURRENCY, 0), _CURRENCY_WORDS)


def reading(number: Column) -> Column:
    """The decimal a written number denotes, as text.

    A point or comma before exactly two last digits is decimal; a comma before
    three digits groups; a lone point is decimal; several points group.
    """
    bare = F.regexp_replace(number, r"[' ]", "")
    points = F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit("")))
    marked = F.regexp_replace(bare, r"[.,](?=\d{2}$)", "#")
    lone_comma = F.regexp_like(bare, F.lit(r"^\d+,\d+$")) & ~bare.rlike(r",\d{3}$")
    decimal = (
        F.when(marked.contains("#"), F.regexp_replace(marked, r"[.,]", ""))
        .when(lone_comma, F.replace(bare, F.lit(","), F.lit("#")))
        .when(points == 1, F.replace(F.replace(bare, F.lit(","), F.lit("")), F.lit("."), F.lit("#")))
        .otherwise(F.regexp_replace(bare, r"[.,]", ""))
    )
    return F.replace(decimal, F.lit("#"), F.lit("."))


#: The word beside a number: a scale or sub-unit where it is one.
UNIT_WORD = rf"{NUMBER}\s*\)?\s*(us cents?|euro ?cents?|[a-z]+|¢)(?![a-z])"


# Statements on a document's currency: the unit, then or before it a scale.
_UNIT = r"([a-z][a-z. ]*?[a-z]|[€£¥₹₨$])"
STATEMENT = (
    r"(?i)(?:\(figures in (?:" + _UNIT + r")( '?000s?)?\)"
    r"|\b(?:all )?(?:amounts|figures|prices|totals)(?: are)?(?: stated| quoted| given| expressed| shown| payable)? in "
    r"(thousands of |millions of |billions of |lakhs of |crores of )?" + _UNIT + r"( thousand| million| billion| lakh| crore)?s?(?=[.,;)\n]|$)"
    r"|\bcurrency ?: ?([a-z]{3})\b"
    r"|\(([a-z]{3}) (thousands|millions|billions|lakhs|crores)\))"
)


def stated_unit(text: Column) -> Column:
    """struct(currency, power) of the first statement on the document's currency in a longer text."""
    hit = F.regexp_extract(text, STATEMENT, 0)
    power = (
        F.when(hit.rlike(r"(?i)'?000|thousand"), 3)
        .when(hit.rlike(r"(?i)million"), 6)
        .when(hit.rlike(r"(?i)billion"), 9)
        .when(hit.rlike(r"(?i)lakh"), 5)
        .when(hit.rlike(r"(?i)crore"), 7)
    )
    return F.struct(currency_of(hit).alias("currency"), power.alias("power"), hit.alias("said"))


TRUST = 20.0  # cost of a combination for each stated thing that it breaks
FITS = 0.02  # log residual up to which a combination fits
POWERS = [-2, 0, *SCALES]


def parsed(text: Column) -> Column:
    """struct(raw, value, currency, power): the first number of a text by the rules of reading(), and the unit that the text itself states."""
    t = plain(text.cast("string"))
    low = F.lower(t)
    raw = F.regexp_extract(t, NUMBER, 0)
    word = F.regexp_extract(low, UNIT_WORD, 1)
    currency = currency_of(t)
    # "Cr" is a crore of rupees, but a credit in other currencies
    credit = F.coalesce((word == "cr") & currency.isNotNull() & ~currency.isin("INR", "PKR"), F.lit(False))
    sub = word.isin(list(SUBUNITS)) | low.rlike(rf"(?<![a-z])(?:cents?|paisas?|paise|pence|fils|rappen)\s*{NUMBER}")
    power = F.when(~credit, _looked_up(word, _SCALE_WORDS))
    return F.struct(
        raw.alias("raw"),
        F.when(raw != "", reading(raw)).alias("value"),
        currency.alias("currency"),
        F.when(sub, F.coalesce(power, F.lit(0)) - 2).otherwise(power).alias("power"),
        credit.alias("credit"),
    )


def readings(raw: Column) -> Column:
    """Every decimal that a written number may denote, that of reading() first."""
    bare = F.regexp_replace(raw, r"[' ]", "")
    grouped = F.regexp_replace(bare, "[.,]", "")
    last = F.translate(F.regexp_replace(bare, r"[.,](?=\d*[.,])", ""), ",", ".")
    return F.array_distinct(F.array(reading(raw), grouped, last))


def normalise_amounts(
    records: DataFrame, rates: DataFrame, amount: str = "total_amount", context: str = "text_preview", structured: str | None = "extracted_json", trust: float = TRUST
) -> DataFrame:
    """records with the columns amount_value, amount_currency, amount_power, amount_residual, amount_stated, amount_unique, amount_usd_cents.

    rates: (currency unique, micro_usd). amount_stated: the currency is stated beside the amount or in the
    context; elsewhere it is that of subtotal or tax, where these fit. A record without a currency has a null
    amount_usd_cents. amount_residual is null where there is no identity.
    """
    df = records.withColumn("__a", parsed(F.col(amount)))
    text = plain(F.col(amount).cast("string"))
    # the statement counts only for what the amount itself leaves open
    open_unit = (F.col("__a.raw") != "") & (F.col("__a.currency").isNull() | F.col("__a.power").isNull())
    df = df.withColumn("__ctx", F.when(open_unit, stated_unit(F.col(context))))
    negative = (
        text.rlike(r"-[^\d]*\d|\d\s*-\s*(?:$|[^\d])|\([^()]*\d[^()]*\)")
        | text.rlike(r"(?i)(?<![a-z])(?:minus|negative|credit)(?![a-z])")
        | F.col("__a.credit")
    )
    if structured:
        part = {k: parsed(F.get_json_object(F.col(structured), f"$.flat_values.{k}")) for k in ("subtotal", "tax")}
    else:
        part = {k: parsed(F.lit(None).cast("string")) for k in ("subtotal", "tax")}
    df = df.withColumn("__s", part["subtotal"]).withColumn("__x", part["tax"])
    # one row: the rates by currency
    known = rates.dropDuplicates(["currency"]).filter("currency IS NOT NULL AND micro_usd IS NOT NULL")
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("currency", "micro_usd"))).alias("__rates"))
    df = df.crossJoin(F.broadcast(known))

    def number(c: Column) -> Column:
        return c.try_cast("double")

    stated = F.coalesce(F.col("__a.currency"), F.col("__ctx.currency"))
    power = F.coalesce(F.col("__a.power"), F.col("__ctx.power"), F.lit(0))
    base = number(F.col("__s.value"))
    # subtotal and tax without a scale of their own share the amount's; one that has it fixes the scale
    own_scale = F.col("__s.power").isNotNull() & (base > 0)
    least = base * F.pow(F.lit(10.0), F.coalesce("__s.power", F.lit(0))) + F.coalesce(number(F.col("__x.value")), F.lit(0.0)) * F.pow(
        F.lit(10.0), F.coalesce(F.col("__x.power"), F.when(F.col("__x.currency").isNull(), F.col("__s.power")), F.lit(0))
    )
    other = F.coalesce("__s.currency", "__x.currency")
    unscaled = F.col("__a.power").isNull() & F.col("__ctx.power").isNull()
    df = df.withColumns({"__total": F.when(base > 0, least), "__stated": stated, "__power": power, "__unscaled": unscaled, "__own": F.coalesce(own_scale, F.lit(False)), "__other": other})
    currencies = F.when(F.col("__stated").isNotNull(), F.array("__stated")).otherwise(F.array(F.when(F.col("__total").isNotNull(), F.col("__other"))))
    powers = F.when(F.col("__own"), F.array_distinct(F.array(F.col("__power"), *(F.lit(p) for p in POWERS)))).otherwise(F.array("__power"))

    def combination(value: Column, n: Column, p: Column, c: Column) -> Column:
        shown = number(value) * F.when(F.col("__own"), F.pow(F.lit(10.0), p)).otherwise(1.0)
        # amounts in two currencies meet in the common one
        rate = F.when(c != F.col("__other"), F.try_divide(F.try_element_at("__rates", c), F.try_element_at("__rates", F.col("__other")))).otherwise(1.0)
        residual = F.abs(F.ln(F.try_divide(shown * F.coalesce(rate, F.lit(1.0)), F.col("__total"))))
        fit = F.coalesce(residual <= FITS, F.lit(False))
        broken = ((n > 0) & ~(fit & F.col("__stated").isNull())).cast("int") + ((p != F.col("__power")) & ~(fit & F.col("__unscaled"))).cast("int")
        cost = F.coalesce(residual, F.lit(0.0)) + broken * F.lit(trust)
        return F.struct(cost.alias("cost"), broken.alias("broken"), residual.alias("residual"), value.alias("value"), p.alias("power"), c.alias("currency"))

    every = F.flatten(
        F.transform(
            F.when(F.col("__a.raw") != "", readings(F.col("__a.raw"))),
            lambda v, n: F.flatten(F.transform(powers, lambda p: F.transform(currencies, lambda c: combination(v, n, p, c)))),
        )
    )
    df = df.withColumn("__all", F.array_sort(every)).withColumn("__best", F.get("__all", F.lit(0)))
    df = df.withColumn("amount_currency", F.col("__best.currency")).withColumn("amount_power", F.col("__best.power"))
    value = F.expr("try_cast(__best.value AS DECIMAL(24,6))")
    df = df.withColumn("amount_value", F.when(negative, -value).otherwise(value)).withColumn("amount_residual", F.col("__best.residual"))

    def whole(x: Column) -> Column:
        return number(x["value"]) * F.pow(F.lit(10.0), x["power"])

    other_value = lambda x: F.abs(whole(x) - whole(F.col("__best"))) > 1e-9 * whole(F.col("__best"))
    rivals = F.filter("__all", lambda x: other_value(x) & (x["residual"] <= FITS))
    fits = F.coalesce(F.col("__best.residual"), F.lit(0.0)) <= FITS
    # without an identity a group of three after a single separator is open
    either = F.col("__best.residual").isNull() & F.regexp_replace("__a.raw", "[' ]", "").rlike(r"^\d{1,3}[.,]\d{3}$")
    df = df.withColumn("amount_stated", F.col("__best").isNotNull() & F.col("__stated").isNotNull())
    df = df.withColumn("amount_unique", F.coalesce(F.col("amount_currency").isNotNull() & fits & ~either & (F.size(rivals) == 0), F.lit(False)))
    # cents = value * 10^power * micro / 10^4; the hundredth keeps the power of sub-units whole
    micro = F.try_element_at("__rates", F.col("amount_currency")).cast("decimal(12,0)")
    hundredfold = F.expr("CAST(pow(10, amount_power + 2) AS DECIMAL(14,0))")
    cents = F.round(F.col("amount_value") * hundredfold * micro / F.lit(1000000).cast("decimal(7,0)"), 0)
    df = df.withColumn("amount_usd_cents", cents.cast("long"))
    return df.drop("__a", "__ctx", "__s", "__x", "__rates", "__total", "__stated", "__power", "__unscaled", "__own", "__other", "__all", "__best")


@dataclass(frozen=True)
class Quantity:
    """A column of numbers, and the units it may be in: name -> how many of the common unit one is."""

    column: str
    units: dict[str, float]


COMBINATIONS = 4096  # of units, at most


def unit_solutions(df: DataFrame, source: str, quantities: list[Quantity], identities: list[dict[str, float]], fits: float = 0.05) -> DataFrame:
    """(source, unit_<column> of each quantity, residual, runner_up, unique): the units of each source's columns.

    identities: each a product of powers of columns that is 1 in common units, as {"mass": 1, "density": -1,
    "volume": -1}. The cost of a combination is the mean of its absolute log residuals over the source's rows,
    summed over the identities; rows in which a column of an identity is null or not above 0 don't count in it.
    All costs are sums, so a source with a third of all rows is added up before it moves. Not unique: another
    combination within `fits` of the least, or a least cost above it.
    """
    names = [q.column for q in quantities]
    options = list(product(*(q.units.items() for q in quantities)))
    if len(options) > COMBINATIONS:
        raise ValueError(f"{len(options)} combinations of units")
    for one in identities:
        if set(one) - set(names):
            raise ValueError(f"unknown columns in {one}")
    logs = []
    for one in identities:
        good = F.lit(True)
        for c in one:
            good = good & (F.col(c).cast("double") > 0)
        total = F.lit(0.0)
        for c, p in one.items():
            total = total + F.ln(F.col(c).cast("double")) * p
        logs.append(F.when(good, total))
    rows = df.select(F.col(source).alias("__source"), *(x.alias(f"__log{k}") for k, x in enumerate(logs)))
    costs = []
    for n, units in enumerate(options):
        factor = {c: f for c, (_, f) in zip(names, units)}
        cost = F.lit(0.0)
        for k, one in enumerate(identities):
            shift = sum(p * math.log(factor[c]) for c, p in one.items())
            cost = cost + F.avg(F.abs(F.col(f"__log{k}") + shift))
        costs.append(cost.alias(f"__cost{n}"))
    sums = rows.groupBy("__source").agg(*costs)
    listed = F.array(*(F.struct(F.round(F.col(f"__cost{n}"), 9).alias("cost"), *(F.lit(u).alias(f"unit_{c}") for c, (u, _) in zip(names, units))) for n, units in enumerate(options)))
    ranked = sums.select(F.col("__source").alias(source), F.array_sort(F.filter(listed, lambda x: x["cost"].isNotNull())).alias("__all"))
    best, second = F.get("__all", F.lit(0)), F.get("__all", F.lit(1))
    lead = F.coalesce(second["cost"] - best["cost"] > fits, F.lit(True))
    return ranked.select(
        source,
        *(best[f"unit_{c}"].alias(f"unit_{c}") for c in names),
        best["cost"].alias("residual"),
        second["cost"].alias("runner_up"),
        F.coalesce((best["cost"] <= fits) & lead, F.lit(False)).alias("unique"),
    )


def to_common_units(df: DataFrame, source: str, quantities: list[Quantity], identities: list[dict[str, float]], fits: float = 0.05) -> DataFrame:
    """df with <column>_common of each quantity, null where the source's units aren't unique, and units_unique."""
    found = unit_solutions(df, source, quantities, identities, fits)
    solved = found.select(F.col(source).alias("__source"), *(F.col(f"unit_{q.column}").alias(f"__unit_{q.column}") for q in quantities), F.col("unique").alias("units_unique"))
    out = df.join(solved, F.col(source).eqNullSafe(F.col("__source")), "left")
    for q in quantities:
        factor = F.lit(None).cast("double")
        for u, f in q.units.items():
            factor = F.when(F.col(f"__unit_{q.column}") == u, F.lit(float(f))).otherwise(factor)
        out = out.withColumn(f"{q.column}_common", F.when(F.col("units_unique"), F.col(q.column).cast("double") * factor))
    return out.drop("__source", *(f"__unit_{q.column}" for q in quantities))


def reading_of(text: Column) -> Column:
    """The first number of a text as a double, by the rules of reading(), else null."""
    return reading(F.regexp_extract(plain(text), NUMBER, 0)).try_cast("double")
