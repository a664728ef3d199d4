"""Reading of measured quantities from text, with exact conversion."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple

#: Unit -> (quantity, factor to the common unit, offset added before the factor). Exact by definition of the units.
_INCH, _POUND = Fraction(254, 10), Fraction(45359237, 100000)
_PSI = _POUND / 1000 * Fraction(980665, 100000) / (Fraction(254, 10000) ** 2) / 1000
UNITS: dict[str, tuple[str, Fraction, Fraction]] = {
    name: (quantity, Fraction(factor), Fraction(offset))
    for quantity, units in {
        "length": {"mm": (1, 0), "cm": (10, 0), "dm": (100, 0), "m": (1000, 0), "km": (10**6, 0), "in": (_INCH, 0), "ft": (_INCH * 12, 0)},
        "mass": {"mg": (Fraction(1, 1000), 0), "g": (1, 0), "kg": (1000, 0), "t": (10**6, 0), "oz": (_POUND / 16, 0), "lb": (_POUND, 0)},
        "pressure": {"Pa": (Fraction(1, 1000), 0), "hPa": (Fraction(1, 10), 0), "kPa": (1, 0), "MPa": (1000, 0), "mbar": (Fraction(1, 10), 0), "bar": (100, 0), "psi": (_PSI, 0), "atm": (Fraction(101325, 1000), 0)},
        "temperature": {"°C": (1, 0), "K": (1, Fraction(-27315, 100)), "°F": (Fraction(5, 9), -32)},
        "volume": {"ml": (1, 0), "cl": (10, 0), "dl": (100, 0), "l": (1000, 0), "m³": (10**6, 0)},
        "power": {"mW": (Fraction(1, 1000), 0), "W": (1, 0), "kW": (1000, 0), "MW": (10**6, 0)},
        "duration": {"ms": (Fraction(1, 1000), 0), "s": (1, 0), "min": (60, 0), "h": (3600, 0), "d": (86400, 0)},
        "flow": {"ml/min": (1, 0), "ml/s": (60, 0), "ml/h": (Fraction(1, 60), 0), "l/min": (1000, 0), "l/s": (60000, 0), "l/h": (Fraction(1000, 60), 0)},
    }.items()
    for name, (factor, offset) in units.items()
}

#: Spellings of a unit, compared without case and inner blanks, a final point being optional.
SPELLINGS: dict[str, str] = {
    "mm": "mm millimeter millimeters millimetre millimetres millimètre millimètres",
    "cm": "cm centimeter centimeters centimetre centimetres centimètre centimètres zentimeter",
    "dm": "dm decimeter dezimeter",
    "m": "m meter meters metre metres mètre mètres mtr",
    "km": "km kilometer",
    "in": "in inch inches duim zoll pouce pouces tomme tommer \" ″ ” ''",
    "ft": "ft foot feet voet fuß pied pieds fod ′ ' ’",
    "mg": "mg milligram milligramm milligramme",
    "g": "g gr gram grams gramm gramme grammes",
    "kg": "kg kilo kilos kilogram kilogramm kilogramme kilogrammes kgs",
    "t": "ton tonne tonnes",
    "oz": "oz ounce ounces ons once onces unze unzen",
    "lb": "lb lbs pound pounds pond pfund livre livres pund",
    "Pa": "pa pascal",
    "hPa": "hpa",
    "kPa": "kpa kilopascal",
    "MPa": "mpa megapascal",
    "mbar": "mbar millibar",
    "bar": "bar bars",
    "psi": "psi",
    "atm": "atm",
    "°C": "°c degc celsius c gradcelsius gradencelsius degreescelsius degréscelsius graderc",
    "K": "k kelvin",
    "°F": "°f degf fahrenheit f",
    "ml": "ml milliliter milliliters millilitre millilitres cc cm³ cm3 ccm",
    "cl": "cl centiliter centilitre",
    "dl": "dl deciliter decilitre",
    "l": "l ltr liter liters litre litres",
    "m³": "m³ m3",
    "W": "w watt watts",
    "kW": "kw kilowatt",
    "MW": "megawatt",
    "ms": "ms msec millisecond milliseconds milliseconde milliseconden millisekunde millisekunden millisekunder",
    "s": "s sec secs sek second seconds seconde seconden secondes sekunde sekunden sekunder",
    "min": "min mins minute minutes minuut minuten minut minutter",
    "h": "h hr hrs hour hours uur u std stunde stunden heure heures time timer",
    "d": "day days dag dagen tag tage jour jours dage",
    "ml/min": "ml/min cc/min mlperminuut",
    "ml/s": "ml/s ml/sec cc/s",
    "ml/h": "ml/h ml/hr",
    "l/min": "l/min lpm ltr/min liter/min",
    "l/s": "l/s l/sec",
    "l/h": "l/h l/hr l/u l/std ltr/h liter/h",
}
_BY_SPELLING = {spelling: unit for unit, spellings in SPELLINGS.items() for spelling in spellings.split()}
#: Letters that are a unit only as written here.
_CASED = {"C": "°C", "F": "°F", "K": "K", "mW": "mW", "MW": "MW"}

_ANY_UNIT = "|".join(
    sorted((r"°\s?[CF]", "mw", *(re.escape(x) for x in _BY_SPELLING if not x.startswith("°"))), key=len, reverse=True)
)
_UNIT = rf"(?:(?:{_ANY_UNIT})\.?(?![\w³²/°]))"
_FRACTION = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4), "⅓": Fraction(1, 3), "⅔": Fraction(2, 3), "⅛": Fraction(1, 8)}
_NUMBER = rf"(?:\d{{1,3}}(?:[ .,'’]\d{{3}})+(?![\d])(?:[.,]\d+)?|\d+(?:[.,]\d+)?(?:\s?[{''.join(_FRACTION)}])?|[{''.join(_FRACTION)}])"
_SIGNED = rf"[+-]?\s?{_NUMBER}"
_TO = r"(?:\s*(?:\.\.\.|[–—…-])\s*|\s+(?:to|tot|t/m|bis|à|a|til|and|en|und|et|og)\s+)"
_TOLERANCE = r"\s*(?:±|\+/-|\+-|\+/−)\s*"
_VALUE = re.compile(
    rf"(?<![\w.,/])(?P<a>{_SIGNED})(?:\s?(?P<ua>{_UNIT}))?"
    rf"(?:(?:{_TOLERANCE}(?P<tol>{_NUMBER})|{_TO}(?P<b>{_SIGNED}))(?!\d)(?:\s?(?P<ub>{_UNIT}))?)?",
    re.IGNORECASE,
)
_KEY_UNIT = re.compile(rf"(?:[\[(]\s*(?P<p>{_UNIT})\s*[\])]|(?:,|\bin|\ben|\bi)\s+(?P<q>{_UNIT}))\s*:?\s*$", re.IGNORECASE)
_BLANKS = str.maketrans({c: " " for c in "      　\t\r\n"} | {"−": "-", "º": "°", "˚": "°", "µ": "μ"})


class Measure(NamedTuple):
    quantity: str
    unit: str
    low: Fraction
    high: Fraction


def unit_of(text: str | None) -> str | None:
    """The unit that a spelling stands for."""
    if not text:
        return None
    t = text.strip().rstrip(".").replace(" ", "")
    if t in _CASED:
        return _CASED[t]
    low = t.lower()
    return None if low in ("c", "f", "k") else _BY_SPELLING.get(low)


def number(text: str) -> Fraction:
    """A separator before exactly three final digits separates thousands, any other one decimals."""
    t = text.replace(" ", "").replace("'", "").replace("’", "")
    sign = -1 if t.startswith("-") else 1
    t = t.lstrip("+-")
    extra = Fraction(0)
    if t and t[-1] in _FRACTION:
        extra, t = _FRACTION[t[-1]], t[:-1]
    if not t:
        return sign * extra
    parts = re.split(r"[.,]", t)
    if len(parts) > 1 and len(parts[-1]) != 3:
        return sign * (Fraction("".join(parts[:-1]) + "." + parts[-1]) + extra)
    return sign * (Fraction("".join(parts)) + extra)


def common(value: Fraction, unit: str) -> Fraction:
    """value in the common unit of its quantity."""
    _, factor, offset = UNITS[unit]
    return (value + offset) * factor


def key_unit(key: str | None) -> str | None:
    """The unit that a label names at its end."""
    m = _KEY_UNIT.search((key or "").translate(_BLANKS))
    return unit_of(m["p"] or m["q"]) if m else None


@lru_cache(maxsize=100_000)
def measure(key: str | None, value: str | None) -> Measure | None:
    """The first quantity that value states, its unit from value or else from key; None if it states none.

    A single value, also one with a limit, has low = high; a range or tolerance gives its ends.
    """
    if not value:
        return None
    text = value.translate(_BLANKS)
    named = None
    for m in _VALUE.finditer(text):
        ua, ub = unit_of(m["ua"]), unit_of(m["ub"])
        first, last = ua or ub, ub or ua
        if first is None:
            if named is None:
                named = key_unit(key)
            first = last = named
        if first is None:
            continue
        quantity = UNITS[first][0]
        a = number(m["a"])
        if m["tol"]:
            t = number(m["tol"])
            low, high = common(a - t, first), common(a + t, first)
        elif m["b"] and UNITS[last][0] == quantity:
            low, high = common(a, first), common(number(m["b"]), last)
        else:
            low = high = common(a, first)
        return Measure(quantity, first, min(low, high), max(low, high))
    return None


@lru_cache(maxsize=100_000)
def bare_ends(value: str | None) -> tuple[Fraction, Fraction] | None:
    """Ends, as written, of a value that is a number or range without a unit or words of its own."""
    if not value:
        return None
    m = _VALUE.search(value.translate(_BLANKS))
    if not m or m["ua"] or m["ub"]:
        return None
    a = number(m["a"])
    if m["tol"]:
        t = number(m["tol"])
        return a - t, a + t
    return a, number(m["b"]) if m["b"] else a


def bare_number(value: str | None) -> tuple[float, float] | None:
    """bare_ends as floating-point numbers."""
    ends = bare_ends(value)
    return (float(ends[0]), float(ends[1])) if ends else None


def bare_measure(value: str | None, unit: str | None) -> Measure | None:
    """What value, which states no unit, measures in unit; None if it is no such value or unit is none."""
    ends = bare_ends(value) if unit in UNITS else None
    if ends is None:
        return None
    a, b = (common(x, unit) for x in ends)
    return Measure(UNITS[unit][0], unit, min(a, b), max(a, b))
