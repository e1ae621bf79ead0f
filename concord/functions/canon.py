"""Value alignment and canonical forms: the core comparison semantics.

Two cells match when ``canon(left) <=> canon(right)``, where ``canon`` is
NULL for NULL or NaN and otherwise the value's string form with outer
whitespace removed. That single null-safe equality reproduces the whole
decision ladder (both NULL match, both blank match, NULL differs from blank,
otherwise trimmed strings compare case-sensitively).

Before the two sides meet, each common column is *aligned* to one type so
both sides fit one schema:

* same type on both sides: kept;
* numeric vs numeric: widest decimal (digits as text where 38 don't hold both), or double when either side is
  floating (so ``1`` equals ``1.0`` and ``1.50`` equals ``1.5`` -- a
  deliberate, documented improvement over string-comparing raw numbers);
* boolean vs integral with ``bool_as_int``: integral;
* arrays, maps, structs: JSON text, maps in the order of their keys;
* anything else that differs: string (so a date never equals a timestamp,
  and ``true`` never equals ``1`` unless asked).

Everything here is a built-in Catalyst expression; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outer whitespace is exactly what Python's ``str.strip()`` removes: every
# code point for which ``str.isspace()`` holds (29 of them), derived here by
# that rule rather than listed. ``btrim`` strips them without a regex.
WHITESPACE = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_COMPLEX = (T.ArrayType, T.MapType, T.StructType)


class Digits(T.StringType):
    """Numbers of which no decimal holds both sides: compared by their digits, without zeros at the end of a fraction."""


def _is_numeric(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL + _FLOATING + (T.DecimalType,))


def _as_decimal(t: T.DataType) -> T.DecimalType:
    if isinstance(t, T.DecimalType):
        return t
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}
    return T.DecimalType(digits[type(t)], 0)


def aligned_type(lt: T.DataType, rt: T.DataType, bool_as_int: bool = False) -> T.DataType:
    """The one type both sides of a column are cast to before comparison."""
    if isinstance(lt, _COMPLEX) or isinstance(rt, _COMPLEX):
        return T.StringType()
    if bool_as_int:
        if isinstance(lt, T.BooleanType) and isinstance(rt, _INTEGRAL):
            return rt
        if isinstance(rt, T.BooleanType) and isinstance(lt, _INTEGRAL):
            return lt
    if lt == rt:
        return lt
    if _is_numeric(lt) and _is_numeric(rt):
        if isinstance(lt, _FLOATING) or isinstance(rt, _FLOATING):
            return T.DoubleType()
        if isinstance(lt, _INTEGRAL) and isinstance(rt, _INTEGRAL):
            return T.LongType()
        a, b = _as_decimal(lt), _as_decimal(rt)
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        if whole + scale > 38:
            return Digits()  # no decimal holds both
        return T.DecimalType(whole + scale, scale)
    return T.StringType()


def align(col: Column, src: T.DataType, target: T.DataType) -> Column:
    """Cast one side's column to the aligned type (JSON for nested values)."""
    if isinstance(src, _COMPLEX):
        return F.to_json(_ordered(col, src))
    if isinstance(src, T.BinaryType) and not isinstance(target, T.BinaryType):
        return F.hex(col)
    if src == target:
        return col
    if isinstance(target, Digits) and isinstance(src, T.DecimalType) and src.scale > 0:
        return F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(col.cast("string"), r"\.?0+$", ""))
    if isinstance(src, T.FloatType) and isinstance(target, T.DoubleType):
        return col.cast("string").cast(target)  # 0.1 as a float is 0.1, not the nearest float's many digits
    return col.cast(target)


def _has_map(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _has_map(t.elementType)
    if isinstance(t, T.StructType):
        return any(_has_map(f.dataType) for f in t.fields)
    return isinstance(t, T.MapType)


def _ordered(col: Column, t: T.DataType) -> Column:
    """The nested value with the entries of its maps in the order of their keys."""
    if not _has_map(t):
        return col
    if isinstance(t, T.ArrayType):
        return F.transform(col, lambda x: _ordered(x, t.elementType))
    if isinstance(t, T.StructType):
        fields = [_ordered(col[f.name], f.dataType).alias(f.name) for f in t.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    entries = F.transform(F.array_sort(F.map_keys(col)), lambda k: F.struct(k, _ordered(col[k], t.valueType)))
    return F.map_from_entries(entries)


def canon(col: Column, dtype: T.DataType) -> Column:
    """Canonical comparison value of an aligned value; NULL for NULL/NaN.

    Strings lose their outer whitespace; floating values lose NaN (-> NULL)
    and the sign of zero; everything else is its own canonical value. Both
    sides of a column share the aligned type, so typed equality here is the
    same test as equality of the string forms, without formatting strings.
    """
    if isinstance(dtype, T.StringType):
        return F.btrim(col, F.lit(WHITESPACE))
    if isinstance(dtype, _FLOATING):
        return F.when(~F.isnan(col), col + F.lit(0.0).cast(dtype))
    return col


def canon_sql(name: str, dtype: T.DataType) -> str:
    """:func:`canon` of a column by its name, as SQL text: wide tables build thousands of these, and text is built without the JVM."""
    if isinstance(dtype, T.StringType):
        return f"btrim({name}, '{WHITESPACE}')"
    if isinstance(dtype, _FLOATING):
        return f"(case when not isnan({name}) then {name} + cast(0.0 as {dtype.simpleString()}) end)"
    return name


def same_sql(left: str, right: str, dtype: T.DataType) -> str:
    """The cells of two columns match; their canonical forms are looked at only where the values differ."""
    plain = f"{left} <=> {right}"
    if not isinstance(dtype, (T.StringType, *_FLOATING)):
        return f"({plain})"
    return f"({plain} or {canon_sql(left, dtype)} <=> {canon_sql(right, dtype)})"


def canon_text_sql(name: str, dtype: T.DataType) -> str:
    """:func:`canon_text` of a column by its name, as SQL text."""
    canonical = canon_sql(name, dtype)
    if isinstance(dtype, T.StringType):
        return canonical
    return f"hex({canonical})" if isinstance(dtype, T.BinaryType) else f"cast({canonical} as string)"


def is_null_sql(name: str, dtype: T.DataType) -> str:
    """The canonical value is NULL."""
    return f"({name} is null or isnan({name}))" if isinstance(dtype, _FLOATING) else f"({name} is null)"


def is_null(col: Column, dtype: T.DataType) -> Column:
    """The canonical value is NULL."""
    return col.isNull() | F.isnan(col) if isinstance(dtype, _FLOATING) else col.isNull()


def text(canonical: Column, dtype: T.DataType) -> Column:
    """A canonical value as text, for places mixing columns of many types."""
    if isinstance(dtype, T.StringType):
        return canonical
    return F.hex(canonical) if isinstance(dtype, T.BinaryType) else canonical.cast("string")


def canon_text(col: Column, dtype: T.DataType) -> Column:
    """The canonical form of an aligned value, as text."""
    return text(canon(col, dtype), dtype)


def is_blank(col: Column, dtype: T.DataType) -> Column:
    """Non-NULL string that is empty after stripping outer whitespace."""
    if not isinstance(dtype, T.StringType):
        return F.lit(False)
    return F.coalesce(canon(col, dtype) == F.lit(""), F.lit(False))


def display(col: Column) -> Column:
    """How a value is shown in a difference: its string form, or ``NULL``."""
    return F.coalesce(col.cast("string"), F.lit("NULL"))


def record_id(keys_struct: Column, key_names) -> Column:
    """Printable record id: key values joined by ``|``, ``NULL`` for NULLs; different keys have different ids.

    In keys of several columns, ``\\`` and ``|`` inside a value are preceded by
    ``\\``; a value that is ``NULL`` by its letters (after any ``\\``) is too.
    """
    parts = []
    for k in key_names:
        text = keys_struct[k].cast("string")
        if len(key_names) > 1:
            text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        text = F.when(text.rlike(r"^\\*NULL$"), F.concat(F.lit("\\"), text)).otherwise(text)
        parts.append(F.coalesce(text, F.lit("NULL")))
    return F.concat_ws("|", *parts)
