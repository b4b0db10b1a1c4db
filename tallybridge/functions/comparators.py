"""Value comparison rules, chosen per column from the pair of declared types.

Every rule gives two SQL expressions: whether the values match (never NULL)
and, where a numeric difference exists, its absolute size as a double.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from tallybridge.functions.nested import canonical, contains_map
from tallybridge.functions.sqltext import number, text

# Java accepts a type suffix ("1.5d") and hexadecimal floats; both are plain
# text to everybody else and must not be read as numbers.
_JAVA_ONLY_NUMBER = r"(?i)([0-9.][df]\s*$|0x)"

MISSING = "CAST(NULL AS DOUBLE)"


@dataclass(frozen=True)
class Tolerance:
    """``abs(a - b) <= absolute + relative * abs(b)``."""

    absolute: float = 0.0001
    relative: float = 0.0

    def __post_init__(self) -> None:
        for value in (self.absolute, self.relative):
            if not 0 <= value < float("inf"):
                raise ValueError("tolerances must be finite and not negative")

    @property
    def exact_for_integers(self) -> bool:
        return self.absolute < 1 and self.relative == 0


@dataclass(frozen=True)
class Comparison:
    match: str
    difference: str | None = None


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_number(dtype: T.DataType) -> bool:
    return is_integer(dtype) or is_float(dtype) or isinstance(dtype, T.DecimalType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_instant(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def nan_to_null(value: str, dtype: T.DataType) -> str:
    if not is_float(dtype):
        return value
    return f"nanvl({value}, CAST(NULL AS {dtype.simpleString()}))"


def compare(
    a: str, b: str, type_a: T.DataType, type_b: T.DataType, tolerance: Tolerance
) -> Comparison:
    """Pick the rule for one column."""
    numeric_a = is_number(type_a) or isinstance(type_a, T.BooleanType)
    numeric_b = is_number(type_b) or isinstance(type_b, T.BooleanType)
    if numeric_a and numeric_b:
        return _numbers(a, b, type_a, type_b, tolerance)
    if is_number(type_a) and is_text(type_b):
        return _parsed_numbers(_as_double(a, type_a), _text_to_double(b), tolerance)
    if is_text(type_a) and is_number(type_b):
        return _parsed_numbers(_text_to_double(a), _as_double(b, type_b), tolerance)
    if is_text(type_a) and is_text(type_b):
        return Comparison(f"({a} <=> {b})")
    if is_instant(type_a) and is_instant(type_b):
        if type_a == type_b:
            return Comparison(f"({a} <=> {b})")
        return Comparison(f"(CAST({a} AS TIMESTAMP_NTZ) <=> CAST({b} AS TIMESTAMP_NTZ))")
    if is_instant(type_a) and is_text(type_b):
        return _instant_and_text(a, b, type_a)
    if is_text(type_a) and is_instant(type_b):
        return _instant_and_text(b, a, type_b)
    if type_a.simpleString() == type_b.simpleString():
        if contains_map(type_a):
            return Comparison(f"({canonical(a, type_a)} <=> {canonical(b, type_b)})")
        return Comparison(f"({a} <=> {b})")
    return Comparison(f"({a} IS NULL AND {b} IS NULL)")


def _as_double(value: str, dtype: T.DataType) -> tuple[str, str]:
    """The value as a double without NaN, and whether it is missing."""
    double = nan_to_null(f"CAST({value} AS DOUBLE)", T.DoubleType())
    if not is_float(dtype):
        double = f"CAST({value} AS DOUBLE)"
    return double, f"{double} IS NULL"


def _text_to_double(value: str) -> tuple[str, str]:
    """The parsed number, and whether the text stands for a missing value."""
    parsed = f"IF({value} RLIKE {text(_JAVA_ONLY_NUMBER)}, NULL, TRY_CAST({value} AS DOUBLE))"
    missing = f"({value} IS NULL OR coalesce(isnan({parsed}), false))"
    return nan_to_null(parsed, T.DoubleType()), missing


def _close(a: str, b: str, tolerance: Tolerance) -> str:
    """Both doubles; equal infinities match although their difference is NaN."""
    near = f"abs({a} - {b}) <= {number(tolerance.absolute)}"
    if tolerance.relative:
        finite = f"abs({b}) < CAST('Infinity' AS DOUBLE)"
        near = f"({finite} AND {near} + {number(tolerance.relative)} * abs({b}))"
    return f"({a} = {b} OR {near})"


def _numbers(
    a: str, b: str, type_a: T.DataType, type_b: T.DataType, tolerance: Tolerance
) -> Comparison:
    if isinstance(type_a, T.BooleanType):
        a, type_a = f"CAST({a} AS INT)", T.IntegerType()
    if isinstance(type_b, T.BooleanType):
        b, type_b = f"CAST({b} AS INT)", T.IntegerType()

    double_a, double_b = _as_double(a, type_a)[0], _as_double(b, type_b)[0]
    difference = f"abs({double_a} - {double_b})"
    if is_integer(type_a) and is_integer(type_b) and tolerance.exact_for_integers:
        return Comparison(f"({a} <=> {b})", difference)

    if not (is_float(type_a) or is_float(type_b)):
        limit = f"{Decimal(repr(tolerance.absolute)):f}BD"
        exact = _exact_decimal(a, b, type_a, type_b)
        if exact is not None:
            difference, near = f"CAST({exact} AS DOUBLE)", f"{exact} <= {limit}"
        else:
            difference = _wide_difference(a, b, type_a, type_b)
            near = f"{difference} <= CAST({limit} AS DOUBLE)"
        if tolerance.relative:
            allowed = f"{number(tolerance.absolute)} + {number(tolerance.relative)} * abs({double_b})"
            near = f"{difference} <= {allowed}"
        return Comparison(f"(({a} <=> {b}) OR coalesce({near}, false))", difference)

    close = _close(double_a, double_b, tolerance)
    return Comparison(f"(({double_a} <=> {double_b}) OR coalesce({close}, false))", difference)


def _exact_decimal(a: str, b: str, type_a: T.DataType, type_b: T.DataType) -> str | None:
    """``abs(a - b)`` in decimal arithmetic, when the result type holds every digit."""
    if is_float(type_a) or is_float(type_b):
        return None
    (whole_a, scale_a), (whole_b, scale_b) = _digits(type_a), _digits(type_b)
    if max(whole_a, whole_b) + max(scale_a, scale_b) + 1 > 38:
        return None
    left = f"CAST({a} AS DECIMAL({whole_a + scale_a}, {scale_a}))"
    right = f"CAST({b} AS DECIMAL({whole_b + scale_b}, {scale_b}))"
    return f"abs({left} - {right})"


def _wide_difference(a: str, b: str, type_a: T.DataType, type_b: T.DataType) -> str:
    """``abs(a - b)`` as a double where no decimal type holds every digit.

    Whole parts and fractions are subtracted apart, both exactly; only their
    small or large sum is rounded. Parts too far apart for 38 digits differ by
    infinity.
    """
    parts = []
    for value, dtype in ((a, type_a), (b, type_b)):
        whole, scale = _digits(dtype)
        value = f"CAST({value} AS DECIMAL({min(38, whole + scale)}, {scale}))"
        rest = f"({value} % 1BD)" if scale else "0BD"
        floor = f"IF({value} < 0, ceil({value}), floor({value}))" if scale else value
        parts.append((f"CAST({floor} AS DECIMAL(38, 0))", rest))
    (whole_a, rest_a), (whole_b, rest_b) = parts
    whole = f"coalesce(CAST(try_subtract({whole_a}, {whole_b}) AS DOUBLE), CAST('Infinity' AS DOUBLE))"
    rest = f"CAST({rest_a} - {rest_b} AS DOUBLE)"
    return f"IF({a} IS NULL OR {b} IS NULL, NULL, abs({whole} + {rest}))"


def _digits(dtype: T.DataType) -> tuple[int, int]:
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    return 19, 0


def _parsed_numbers(a: tuple[str, str], b: tuple[str, str], tolerance: Tolerance) -> Comparison:
    """Each side is a double and whether the value counts as missing."""
    (number_a, gap_a), (number_b, gap_b) = a, b
    close = _close(number_a, number_b, tolerance)
    match = f"(({gap_a} AND {gap_b}) OR coalesce({close}, false))"
    return Comparison(match, f"abs({number_a} - {number_b})")


def _instant_and_text(instant: str, value: str, dtype: T.DataType) -> Comparison:
    target = "TIMESTAMP" if isinstance(dtype, T.TimestampType) else "TIMESTAMP_NTZ"
    same = f"CAST({instant} AS {target}) = TRY_CAST({value} AS {target})"
    gap = f"({instant} IS NULL AND {value} IS NULL)"
    return Comparison(f"(coalesce({same}, false) OR {gap})")
