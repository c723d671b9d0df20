import pytest

from folioforge.operators.units import normalise_amounts

RATES = [("USD", 1_000_000), ("EUR", 1_083_417), ("GBP", 1_267_131), ("PKR", 3_593), ("JPY", 6_713), ("INR", 11_937), ("AED", 272_291), ("CHF", 1_131_229)]
CASES = [
    ("USD 1,234.50", "", 123450), ("USD 1.598,47", "", 159847), ("1 234,50 USD", "", 123450), ("USD 17'261.00", "", 1726100), ("USD 1.234", "", 123),
    ("USD 1,234", "", 123400), ("USD 2,352,800 cents", "", 2352800), ("2000 US cents", "", 2000), ("(USD 10.00)", "", -1000), ("USD -10.00", "", -1000),
    ("USD 10.00-", "", -1000), ("−USD 10", "", -1000), ("US$5.06M", "", 506000000), ("USD 0.5 thousand", "", 50000), ("7,711p (GBP)", "", 9771),
    ("₹1 Cr", "", 11937000), ("PKR 1 lakh", "", 35930), ("USD ۶۲۰", "", 62000), ("USD １２.５０", "", 1250), ("Rs. 100", "", 36), ("¥ 100", "", 67),
    ("5.00", "All amounts in EUR.", 542), ("5", "(figures in USD '000)", 500000), ("USD 5", "(USD millions) x", 500000000), ("5", "Amounts stated in GBP thousand.", 633566),
    ("5", "Prices quoted in US dollars, tax included.", 500), ("5", "Currency: CHF Bill To", 566), ("USD 5k", "(figures in USD '000)", 500000),
    ("5", "The rental amounts to EUR 9.", None), ("USD 10.00 CR", "", -1000), ("Rs 1 CR", "", 3593000), ("minus EUR 1", "", -108), ("Net 30", "", None), ("see attached", "Currency: USD", None), ("", "", None), (None, None, None), ("-", "Currency: USD", None),
]


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.createDataFrame([(i, a, t, None, "x") for i, (a, t, _) in enumerate(CASES)], "id int, total_amount string, text_preview string, extracted_json string, currency string")
    rates = spark.createDataFrame(RATES, "currency string, micro_usd long")
    return {r.id: r for r in normalise_amounts(docs, rates).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_amounts(results, case):
    assert results[case].amount_usd_cents == CASES[case][2], CASES[case]


def test_unstated_units_are_flagged(results):
    assert not results[[c[0] for c in CASES].index("Net 30")].amount_unique


def test_extra_columns_stay_and_empty_tables_pass(spark, results):
    assert results[0].currency == "x"
    docs = spark.createDataFrame([], "id int, total_amount string, text_preview string, extracted_json string")
    assert normalise_amounts(docs, spark.createDataFrame(RATES, "currency string, micro_usd long")).count() == 0


def solved(spark, rows, **options):
    docs = spark.createDataFrame([(i, a, t, None if s is None else '{"flat_values": {"subtotal": "%s", "tax": "%s"}}' % s) for i, (a, t, s) in enumerate(rows)], "id int, total_amount string, text_preview string, extracted_json string")
    return [r for r in normalise_amounts(docs, spark.createDataFrame(RATES, "currency string, micro_usd long"), **options).orderBy("id").collect()]


PROBES = [("USD 1.234", "", ("1,200.00", "34.00")), ("USD 5", "", ("9,000.00", "0")), ("USD 1,234", "", ("1.20", "0.034")), ("USD 1.234", "", None), ("USD 1,234.00", "", ("1,200.00", "34.00"))]


def test_amounts_that_an_identity_contradicts_are_flagged(spark):
    got = solved(spark, PROBES)
    assert [r.amount_usd_cents for r in got] == [123, 500, 123400, 123, 123400]  # as stated
    assert [r.amount_unique for r in got] == [False, False, False, False, True]
    assert got[0].amount_residual > 6 and got[3].amount_residual is None


def test_residuals_choose_where_statements_count_little(spark):
    got = solved(spark, PROBES, trust=0.5)
    assert [r.amount_usd_cents for r in got] == [123400, 500, 123, 123, 123400]
    assert [r.amount_unique for r in got] == [True, False, True, False, True]


def test_currency_and_scale_come_from_the_parts_where_nothing_is_stated(spark):
    rows = [("1,234", "", ("EUR 1,200", "EUR 34")), ("1.2", "", ("GBP 1.2 million", "0")), ("1,234", "", ("1,200", "34")), ("USD 1.2", "", ("USD 1.2 thousand", "0")), ("EUR 100.00", "", ("USD 108.34", "0.00"))]
    got = solved(spark, rows, trust=0.5)
    assert [(r.amount_currency, r.amount_power, r.amount_unique, r.amount_stated) for r in got] == [
        ("EUR", 0, True, False), ("GBP", 6, True, False), (None, 0, False, False), ("USD", 3, True, True), ("EUR", 0, True, True),
    ]
    assert [r.amount_usd_cents for r in got] == [133694, 152055720, None, 120000, 10834]


def test_identities_choose_what_is_not_stated(spark):
    rows = [
        ("USD 1.2", "", ("USD 1.2 thousand", "0")), ("1.2", "", ("GBP 1.2 million", "0")), ("1.234", "", ("EUR 1,200.00", "EUR 34.00")), ("1,234", "", ("EUR 1.20", "EUR 0.034")),  # open
        ("USD 1.2 million", "", ("USD 1.2 thousand", "0")), ("USD 1.2", "(figures in USD '000)", ("USD 1.2 million", "0")), ("USD 1.234", "", ("1,200.00", "34.00")),  # stated
        ("USD 5", "", ("USD 9 thousand", "0")), ("1.234", "", ("EUR 7.00", "0")), ("USD 1,200", "", ("USD 1.2 thousand", "0")),  # nothing fits, or what is written does
    ]
    got = solved(spark, rows)
    assert [r.amount_usd_cents for r in got] == [120000, 152055720, 133694, 134, 120000000, 120000, 123, 500, 134, 120000]
    assert [r.amount_power for r in got] == [3, 6, 0, 0, 6, 3, 0, 0, 0, 0]
    assert [r.amount_unique for r in got] == [True] * 4 + [False] * 5 + [True]


UNITS = {
    "mass": {"kg": 1.0, "g": 0.001, "lb": 0.45359237},
    "density": {"kg/m3": 1.0, "g/cm3": 1000.0},
    "volume": {"m3": 1.0, "l": 0.001, "gal": 0.003785411784},
}
MASS = [{"mass": 1, "density": -1, "volume": -1}]


def test_units_of_each_source_from_mass_density_and_volume(spark):
    import math
    import random

    from folioforge.operators.units import Quantity, to_common_units, unit_solutions

    rng = random.Random(4)
    quantities = [Quantity(c, u) for c, u in UNITS.items()]
    sources = {"a": ("kg", "kg/m3", "m3"), "b": ("lb", "g/cm3", "gal"), "c": ("g", "g/cm3", "l"), "d": ("kg", "kg/m3", "gal")}
    rows, true = [], []
    for n in range(2000):
        s = "a" if n % 3 == 0 else rng.choice("abcd")  # a third of the rows and more from one source
        volume, density = rng.uniform(0.01, 5), rng.uniform(600, 2000)
        mass = volume * density * rng.uniform(0.99, 1.01)
        u = sources[s]
        rows.append((n, s, mass / UNITS["mass"][u[0]], density / UNITS["density"][u[1]], volume / UNITS["volume"][u[2]]))
        true.append((mass, volume))
    rows += [(2000, "e", None, 1.0, 2.0), (2001, "a", 0.0, 1.0, 1.0), (2002, None, 1.0, 2.0, 0.5), (2003, "f", 1.0, 7.0, 31.0)]
    df = spark.createDataFrame(rows, "n int, source string, mass double, density double, volume double")

    def brute(s):
        costs = []
        for m, fm in UNITS["mass"].items():
            for d, fd in UNITS["density"].items():
                for v, fv in UNITS["volume"].items():
                    logs = [abs(math.log(r[2] * fm / (r[3] * fd * r[4] * fv))) for r in rows if r[1] == s and all(x and x > 0 for x in r[2:])]
                    costs.append((sum(logs) / len(logs), (m, d, v)))
        return sorted(costs)

    got = {r.source: r for r in unit_solutions(df, "source", quantities, MASS).collect()}
    for s in "abcdf":
        want = brute(s)
        assert abs(got[s].residual - want[0][0]) < 1e-6 and got[s].unique == (want[0][0] <= 0.05 and want[1][0] - want[0][0] > 0.05)
    assert (got["b"].unit_mass, got["b"].unit_density, got["b"].unit_volume) == sources["b"] and got["b"].unique
    assert not got["a"].unique and not got["c"].unique  # kg, kg/m3, m3 and g, g/cm3, l and others have the same residuals
    assert got["e"].unit_mass is None and not got["e"].unique and not got["f"].unique
    out = {r.n: r for r in to_common_units(df, "source", quantities, MASS).collect()}
    assert len(out) == len(rows) and all(out[n].units_unique == (rows[n][1] in "bd" and got[rows[n][1]].unique) for n in range(2000))
    assert all(abs(out[n].mass_common / true[n][0] - 1) < 1e-9 and abs(out[n].volume_common / true[n][1] - 1) < 1e-9 for n in range(2000) if rows[n][1] == "b")
    assert unit_solutions(df.limit(0), "source", quantities, MASS).count() == 0
