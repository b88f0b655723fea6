"""Columns for people: numbers with errors, sizes, labels, colours, axes and flattened JSON."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.numeric import is_finite


def estimate_with_error(mean: Column, error: Column) -> Column:
    """``(m +- e) x 10^k`` with two significant digits of the error; ``(0 +- 0) x 10^0`` when both are zero."""
    size = F.greatest(F.abs(mean), F.abs(error))
    power = F.floor(F.log10(F.when(size > 0, size))).cast("int")
    scale = F.pow(F.lit(10.0), power.cast("double"))
    scaled = F.abs(error) / scale
    digits = F.when(scaled > 0, F.greatest(F.lit(1) - F.floor(F.log10(F.when(scaled > 0, scaled))).cast("int"), F.lit(0))).otherwise(F.lit(1))
    number = lambda x: _fixed(x, digits)
    text = F.concat(F.lit("("), number(mean / scale), F.lit(" +- "), number(scaled), F.lit(") x 10^"), power.cast("string"))
    return F.when(size > 0, text).otherwise(F.lit("(0 +- 0) x 10^0"))


def _fixed(x: Column, digits: Column) -> Column:
    """Fixed-point text with a number of digits that differs between rows."""
    pattern = F.concat(F.lit("0"), F.when(digits > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), digits))).otherwise(""))
    return F.call_function("format_number", x, pattern)


def human_bytes(n: Column) -> Column:
    n = n.cast("double")
    step = lambda power, unit: F.concat(F.regexp_replace(F.format_number(n / F.lit(1024.0**power), 2), ",", ""), F.lit(f" {unit}"))
    return (
        F.when(n < 1024, F.concat(n.cast("bigint").cast("string"), F.lit(" B")))
        .when(n < 1024.0**2, step(1, "KiB"))
        .when(n < 1024.0**3, step(2, "MiB"))
        .otherwise(step(3, "GiB"))
    )


def title_label(key: Column) -> Column:
    """snake_case to Title Case; letters after the first of a word stay as they are."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.filter(F.split(key, "_"), lambda w: w != ""), word), " ")


def default_name(kind: Column, sequence: Column) -> Column:
    return F.concat_ws("-", kind, sequence.cast("string"))


def clone_name(run: Column, task: Column, snapshot: Column) -> Column:
    return F.concat_ws(":", F.lit("clone_of"), run, task, F.lit("snapshot"), snapshot.cast("string"))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue (0 to 255, rounded) of a hue in degrees."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 60.0, F.lit(6.0))
        return F.round((v - v * s * F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))) * 255).cast("int")

    return [channel(5), channel(3), channel(1)]


def phase_colour(re: Column, im: Column, largest: Column) -> list[Column]:
    """A complex value's colour: its phase is the hue, the root of its share of the largest modulus the brightness."""
    hue = F.degrees(F.atan2(im, re)) + 180.0
    value = F.least(F.lit(1.0), F.sqrt(F.coalesce(F.try_divide(F.hypot(re, im), largest), F.lit(0.0))))
    return hsv_to_rgb(hue, F.lit(1.0), value)


def ramp_colour(t: Column) -> list[Column]:
    """Blue to red for t from 0 to 1."""
    return [F.round(x).cast("int") for x in (255 * t, 200 * (1 - 2 * F.abs(t - 0.5)), 255 * (1 - t))]


def padded(low: Column, high: Column, pad: float = 0.08, flat: float = 0.1) -> list[Column]:
    """Axis limits around finite values: some room; a tenth of the value when all are equal, 1 if that is 0; null for none."""
    room = F.when(high > low, (high - low) * pad).otherwise(flat_room(low, flat))
    return [low - room, high + room]


def cell_centre(index: Column, low: Column, high: Column, count: Column) -> Column:
    """The middle of the ``index``-th of ``count`` even cells; the plain index where the range is not finite."""
    known = is_finite(low) & is_finite(high)
    return F.when(known, low + (high - low) / count * (index + 0.5)).otherwise(index.cast("double"))


def flat_room(value: Column, share: float) -> Column:
    """The room around values that are all equal."""
    room = F.abs(value) * share
    return F.when(room > 0, room).otherwise(F.lit(1.0))


def flatten_json(text: str, prefix: str = "") -> list[tuple[str, str]]:
    """Dotted keys and written values of a configuration object, in its order; lists stand in brackets."""

    def write(x) -> str:
        if isinstance(x, list):
            return "[" + ", ".join(map(write, x)) + "]"
        return x if isinstance(x, str) else json.dumps(x)

    out = []
    for key, x in json.loads(text).items():
        name = f"{prefix}{key}"
        out += flatten_json(json.dumps(x), f"{name}.") if isinstance(x, dict) else [(name, write(x))]
    return out


#: JSON deeper than this is no variant, so the recursion below never ends before the objects do.
_DEEPEST = 1001


def flatten_json_column(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with one row per leaf of the JSON objects in ``column``: its dotted ``key`` and written ``value``.

    A recursive query parses each row once and opens objects however deep they are nested; lists and scalars are
    leaves, an empty object has none. A null, or a text that holds no object, gives no row.
    """
    kept = [c for c in rows.columns if c != column]
    own = "".join(f"{_quoted(c)}, " for c in kept)
    source = rows.withColumn(column, F.try_parse_json(F.col(_quoted(column)).cast("string")))
    is_object = lambda v: f"startswith(schema_of_variant({v}), 'OBJECT')"
    leaf = f"""CASE WHEN startswith(schema_of_variant(_value), 'ARRAY') THEN concat('[', array_join(CAST(_value AS ARRAY<STRING>), ', ', 'none'), ']')
      ELSE coalesce(CAST(_value AS STRING), 'null') END"""
    opened = "".join(f"t.{_quoted(c)}, " for c in kept)
    return rows.sparkSession.sql(
        f"""WITH RECURSIVE t MAX RECURSION LEVEL {_DEEPEST} AS (
          SELECT {own} CAST(NULL AS STRING) AS _key, {_quoted(column)} AS _value, true AS _open FROM {{source}} WHERE {is_object(_quoted(column))}
          UNION ALL
          SELECT {opened} CASE WHEN t._key IS NULL THEN e.key ELSE concat(t._key, '.', e.key) END, e.value, {is_object("e.value")}
          FROM t, LATERAL variant_explode(t._value) AS e WHERE t._open)
        SELECT {own} _key AS key, {leaf} AS value FROM t WHERE NOT _open LIMIT ALL""",
        source=source,
    )


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def presence(text: Column, path: str) -> Column:
    """``missing``, ``null`` or ``present``: what a JSON text has at a path; null where it is no JSON at all."""
    whole = F.try_parse_json(text)
    value = F.try_variant_get(whole, path, "variant")
    said = F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null").otherwise("present")
    return F.when(whole.isNotNull(), said)


def required_downsample_level(points: int, budget: int = 256) -> int:
    """How often the number of points must be halved, rounding up, to fit the budget."""
    level = 0
    while points > budget:
        points, level = math.ceil(points / 2), level + 1
    return level
