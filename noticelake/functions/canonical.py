"""JSON of nested columns: the canonical text from which content hashes are made, and the indented one of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import let

#: How JSON writes signs that it cannot hold as they are; the others below a blank are written as \u00xx.
_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_text(text: Column) -> Column:
    """A text in quotes, escaped; letters outside ASCII stay."""

    def escaped(x: Column) -> Column:
        for sign, written in [*_ESCAPES.items(), *((chr(i), f"\\u{i:04x}") for i in range(32) if chr(i) not in _ESCAPES)]:
            x = F.replace(x, F.lit(sign), F.lit(written))
        return x

    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), let(text, escaped)).otherwise(text), F.lit('"'))  # let keeps the replacements, which few texts need, out of the generated code


def json_double(x: Column) -> Column:
    """The fewest of up to 17 digits that read back as the double: plain from 1e-4 to below 1e16, else with an exponent of two digits or more.

    Where two texts of as many digits read back as the double either may be written. Doubles below 2.3e-308, which hold fewer digits, are written with 15.
    """

    def shortest(size: Column) -> Column:
        tries = F.array(*[F.format_string(f"%.{n}e", size) for n in (14, 15, 16)])
        return F.coalesce(F.try_element_at(F.filter(tries, lambda t: t.cast("double") == size), F.lit(1)), size.cast("string"))

    def parts(s: Column) -> Column:
        mantissa, power = F.substring_index(s, "e", 1), F.when(s.contains("e"), F.substring_index(s, "e", -1)).otherwise("0").cast("int")
        whole, fraction = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        digits = F.concat(whole, fraction)
        bare = F.regexp_replace(digits, "^0+(?=.)", "")
        place = F.length(whole) + power - (F.length(digits) - F.length(bare))  # where the point stands in the digits without zeros in front
        return F.struct(F.regexp_replace(bare, "(?<=.)0+$", "").alias("digits"), place.alias("place"))

    def written(p: Column) -> Column:
        digits, place, n = p["digits"], p["place"], F.length(p["digits"])
        plain = (
            F.when(place <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -place), digits))
            .when(place >= n, F.concat(digits, F.repeat(F.lit("0"), place - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), place), F.lit("."), F.substring(digits, place + 1, n)))
        )
        power = place - 1
        shown = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        long_power = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.abs(power).cast("string"))
        return F.when((power >= -4) & (power < 16), plain).when(F.abs(power) >= 100, long_power).otherwise(shown)

    sign = F.when((x < 0) | (F.lower(x.cast("string")).startswith("-0")), "-").otherwise("")
    size = F.concat(sign, let(let(let(F.abs(x), shortest), parts), written))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, F.concat(sign, F.lit("0.0"))).otherwise(size)


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """JSON with keys in order, `, ` and `: ` between, and nothing left to choice: equal values have equal texts, whatever the order of their fields.

    Fields of structs, entries of maps with text keys (by code point) and arrays of any depth; whole numbers, decimals as they are written, doubles by their shortest digits, dates and instants as texts; null is `null`.
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit('"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '": '), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_text(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        by_key = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(by_key, entry), ", "), F.lit("}"))
    elif isinstance(kind, T.BooleanType):
        text = F.when(value, "true").otherwise("false")
    elif isinstance(kind, (T.IntegralType, T.DecimalType)):
        text = value.cast("string")
    elif isinstance(kind, T.FractionalType):
        text = json_double(value.cast("double"))
    else:
        text = json_text(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(text)


def content_hash(value: Column, kind: T.DataType, digits: int = 20) -> Column:
    """The first hexadecimal digits of the SHA-256 of the canonical JSON."""
    return F.left(F.sha2(canonical_json(value, kind), 256), F.lit(digits))


def indented_json(value: Column, kind: T.DataType, depth: int = 0, step: int = 2) -> Column:
    """JSON over lines, `step` blanks a level, fields of structs as they stand and entries of maps by key; empty structs, maps and arrays are `{}` and `[]`, null is `null`."""
    inner, outer = "\n" + " " * step * (depth + 1), "\n" + " " * step * depth

    def block(parts: Column, brackets: str) -> Column:
        body = F.concat(F.lit(brackets[0] + inner), F.array_join(parts, "," + inner), F.lit(outer + brackets[1]))
        return F.when(F.size(parts) == 0, brackets).otherwise(body)

    below = lambda x, of: indented_json(x, of, depth + 1, step)
    if isinstance(kind, T.StructType):
        named = [F.concat(F.lit('"' + f.name.replace("\\", "\\\\").replace('"', '\\"') + '": '), below(value[f.name], f.dataType)) for f in kind.fields]
        text = F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *named), F.lit(outer + "}")) if named else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        text = let(F.transform(value, lambda x: below(x, kind.elementType)), lambda parts: block(parts, "[]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_text(e["key"]), F.lit(": "), below(e["value"], kind.valueType))
        text = let(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), entry), lambda parts: block(parts, "{}"))
    else:
        return canonical_json(value, kind)
    return F.when(value.isNull(), "null").otherwise(text)
