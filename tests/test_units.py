from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from manualake.functions.measures import UNITS, common, measure, number, unit_of
from manualake.operators.units import infer_missing_units, read_measures, stated_measures


@pytest.mark.parametrize(
    ("key", "value", "found"),
    [
        ("Storage", "-4 tot +37 C", ("temperature", -4, 37)),
        ("x", "- 6 til 15°C", ("temperature", -6, 15)),
        ("Inlet in kpa", "809 tot 905", ("pressure", 809, 905)),
        ("x", "29919…45 662 mg", ("mass", 30, 46)),
        ("x", "79.912ms", ("duration", 80, 80)),
        ("x", "1,5 kW", ("power", 1500, 1500)),
        ("x", "39 L/h / 0,7 l/min", ("flow", 650, 650)),
        ("x", "281 K (7,9 °C)", ("temperature", 8, 8)),
        ("x", "282 +/- 14 Watt", ("power", 268, 296)),
        ("Depth [Cm]", "4,1-28,4", ("length", 41, 284)),
        ("x", '1 ¾"', ("length", 44, 44)),
        ("x", "keep at 1.7 KW before first use", ("power", 1700, 1700)),
        ("x", "5 min bis 2 h", ("duration", 300, 7200)),
        ("x", "max. 10 psi", ("pressure", 69, 69)),
    ],
)
def test_values(key, value, found):
    m = measure(key, value)
    assert (m.quantity, round(m.low), round(m.high)) == found


@pytest.mark.parametrize("value", [None, "", "-", "n/a", "IP 44", "RAL 7695", "C22-251", "230 V", "50/60 Hz", "16 A", "52 dB(A)", "6 °dH", "7.3", "zie typeplaat"])
def test_no_quantities(value):
    assert measure("Label", value) is None
    assert measure(None, value) is None


@given(st.integers(0, 10**7), st.sampled_from([u for u in UNITS if unit_of(u)]))
def test_written_values_read_back(n, unit):
    m = measure(None, f"{n} {unit}")
    assert m is not None and m.unit == unit and m.low == m.high == common(Fraction(n), unit)


@given(st.integers(0, 999), st.integers(0, 999))
def test_separators(a, b):
    assert number(f"{a},{b:03d}") == a * 1000 + b
    assert number(f"{a}.{b:02d}") == Fraction(f"{a}.{b:02d}") if b < 100 else True


SPECS = "spec_id long, grp string, model_code string, lang string, items array<struct<k:string,v:string>>, value string"


def test_operator_on_nulls_repeats_and_empty(spark):
    rows = [(1, None, None, None, [("a", "1 m"), None, (None, "2 kg"), ("c", None)], "x")] * 2 + [(2, "g", "m", "en", [], "x"), (3, "g", "m", "en", None, "x")]
    df = spark.createDataFrame(rows, SPECS)
    assert sorted(tuple(r) for r in stated_measures(df).collect()) == [(1, 0, 1000, 1000), (1, 2, 2000, 2000)]
    assert stated_measures(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "g", "m", "en", [("k" * 10_000, "9" * 3_000 + " mm " + "x" * 10_000)], "")], SPECS)
    assert read_measures(long).count() == 1


def test_missing_units_are_routed(spark):
    rows = [(i, "Size", "M", "en", [("Length", f"{100 + i} mm"), ("Width", f"{i % 7 + 1},5 cm"), ("Count", str(i % 5))], "") for i in range(300)]
    rows += [(1000 + i, "Size", "M", "en", [("Length", str(150 + i)), ("Count", "3")], "") for i in range(5)]
    got = infer_missing_units(spark.createDataFrame(rows, SPECS), sample_bound=2_000).filter("spec_id >= 1000").collect()
    assert {r.item_no: (r.predicted, r.route) for r in got}[0][0] == "mm"
    assert {(r.predicted, r.route) for r in got if r.item_no == 1} == {("none", "none")}
