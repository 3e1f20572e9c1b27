"""Numbers, geometry and colour on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_number(x: Column) -> Column:
    """A double as ECMAScript prints it: no trailing zeros, an exponent below 1e-6 and from 1e21 on, NaN and Infinity by name."""
    text = x.cast("string")
    plain = F.when(F.abs(x) < 1, text.try_cast("decimal(38,37)").cast("string")).otherwise(text.try_cast("decimal(38,16)").cast("string"))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    # the fewest digits that give the number back: the JVM's own print may have more
    shown = F.coalesce(*[F.when(d.cast("double") == x, d) for d in (F.format_string(f"%.{n}e", x) for n in (14, 15))], F.regexp_replace(F.lower(text), r"e(?=\d)", "e+"))
    exponent = F.regexp_replace(F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+e", "$1e"), r"\.e", "e"), r"e([+-])0", "e$1")
    outside = F.isnan(x) | (F.abs(x) == float("inf"))
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 2.0**53)
    near = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)  # where the JVM prints no exponent
    return F.when(x == 0, "0").when(outside, text).when(whole, x.cast("long").cast("string")).when(near, text).when((F.abs(x) < 1e-6) | (F.abs(x) >= 1e21), exponent).otherwise(plain)


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves upwards."""
    return F.floor(x + 0.5)


def octal(n: Column, width: int) -> Column:
    """Octal digits filled with zeros to width - 1 and a NUL, as archive headers have them."""
    return F.concat(F.lpad(F.conv(n.cast("string"), 10, 8), width - 1, "0"), F.lit("\0"))


def from_octal(text: Column) -> Column:
    return F.conv(F.regexp_extract(text, "[0-7]+", 0), 8, 10).cast("long")


def fit_page(width: Column, height: Column, into_width: float, into_height: float) -> Column:
    """struct x, y, width, height: scaled evenly to fit, and centred."""
    scale = F.least(F.lit(into_width) / width, F.lit(into_height) / height)
    w, h = width * scale, height * scale
    return F.struct(((into_width - w) / 2).alias("x"), ((into_height - h) / 2).alias("y"), w.alias("width"), h.alias("height"))


def rotation(radians: Column) -> Column:
    """Degrees above -180, up to 180."""
    turn = F.pmod(F.degrees(radians), F.lit(360.0))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def twips(points: Column) -> Column:
    return half_up(points * 20)


def emu(points: Column) -> Column:
    return half_up(points * 12700)


def colour_distance(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of channels."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("double"), lambda s, d: s + d.cast("double"))


def channel(x: Column) -> Column:
    """0 to 255; values up to 1 are shares of 255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), half_up(F.when(x <= 1, x * 255).otherwise(x))))


def colour_hex(rgb: Column) -> Column:
    """RRGGBB of an array of three channels, 0 to 255."""
    return F.concat(*[F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), half_up(rgb[i]))).cast("long")), 2, "0") for i in range(3)])


def readable_on(rgb: Column) -> Column:
    """Black on light colours, white on dark ones, by luminance."""
    light = rgb[0] * 0.2126 + rgb[1] * 0.7152 + rgb[2] * 0.0722
    return F.when(light >= 128, "000000").otherwise("FFFFFF")


def scaled_size(width: Column, height: Column, largest: int) -> Column:
    """struct width, height, scaled down so that neither is over largest."""
    scale = F.least(F.lit(1.0), F.lit(float(largest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), half_up(width * scale)).alias("width"), F.greatest(F.lit(1), half_up(height * scale)).alias("height"))


def half_points(size: Column, inherited: float = 22.0) -> Column:
    """A CSS font size (px, pt, em, rem, %) in half points, 2 to 192; null if it has no such form."""
    value = F.regexp_extract(size, r"^\s*([0-9]*\.?[0-9]+)\s*(px|pt|em|rem|%)\s*$", 1).try_cast("double")
    unit = F.regexp_extract(size, r"(px|pt|em|rem|%)\s*$", 1)
    points = F.when(unit == "px", value * 1.5).when(unit == "pt", value * 2).when(unit == "em", value * inherited).when(unit == "rem", value * 24).when(unit == "%", value / 100 * inherited)
    return F.when(points.isNotNull(), F.greatest(F.lit(2), F.least(F.lit(192), half_up(points))))


def _limited(x: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(most)), x))


def gray_rgb(values: Column) -> Column:
    """Three equal channels of the last value; up to 1 it is a share of 255. Null without a value."""
    x = F.element_at(values, -1)
    level = _limited(F.when(x <= 1, x * 255).otherwise(x), 255)
    return F.when(F.size(values) > 0, F.array(level, level, level))


def rgb_channels(values: Column) -> Column:
    """The last three values as channels; if all are from 0 to 1 they are shares of 255. Null with fewer."""
    last = F.slice(values, -3, 3)
    shares = F.forall(last, lambda x: x.between(0, 1))
    return F.when(F.size(values) >= 3, F.transform(last, lambda x: _limited(F.when(shares, x * 255).otherwise(x), 255)))


def cmyk_rgb(values: Column) -> Column:
    """Channels of the last four values, inks from 0 to 1 (above 1: of 255). Null with fewer."""
    inks = F.transform(F.slice(values, -4, 4), lambda x: _limited(F.when(x > 1, x / 255).otherwise(x), 1))
    mixed = F.transform(F.slice(inks, 1, 3), lambda x: 255 * (1 - F.least(F.lit(1.0), x + F.element_at(inks, 4))))
    return F.when(F.size(values) >= 4, mixed)


def text_place(matrix: Column, width: Column, ascent: Column) -> Column:
    """struct angle, height, left, top, width of a piece of text by its matrix of six; ascent is a share of the height (null: all of it)."""
    angle = F.atan2(matrix[1], matrix[0])
    height = F.greatest(F.lit(1.0), F.hypot(matrix[2], matrix[3]))
    up = F.coalesce(ascent, F.lit(1.0)) * height
    wide = F.greatest(F.when(F.coalesce(width, F.lit(0.0)) == 0, height * 0.5).otherwise(width), height * 0.25)
    return F.struct(angle.alias("angle"), height.alias("height"), (matrix[4] + up * F.sin(angle)).alias("left"), (matrix[5] - up * F.cos(angle)).alias("top"), wide.alias("width"))


def _bytes(content: Column, start: Column, n: int) -> Column:
    """Up to n bytes from place start (from 1) as numbers."""
    cut = F.substring(content, start, F.lit(n))
    at = F.sequence(F.lit(1), F.length(cut))
    return F.when(F.length(cut) > 0, F.transform(at, lambda i: F.conv(F.hex(F.substring(cut, i, F.lit(1))), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))


def variable_length(content: Column, at: int | Column = 0) -> Column:
    """struct value, length of the number at a place (from 0): seven bits a byte, up to four, the last one marked."""
    zero = F.struct(F.lit(0).cast("long").alias("value"), F.lit(0).alias("length"), F.lit(True).alias("open"))
    step = lambda s, b: F.when(s["open"], F.struct((s["value"] * 128 + b % 128).alias("value"), (s["length"] + 1).alias("length"), (b < 128).alias("open"))).otherwise(s)
    start = F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int")
    return F.aggregate(_bytes(content, start, 4), zero, step, lambda s: F.struct(s["value"].alias("value"), s["length"].alias("length")))


def variable_length_back(content: Column) -> Column:
    """The number of seven bits a byte at the end of content, four bytes at most; its first byte is marked."""
    last = _bytes(content, F.greatest(F.length(content) - 3, F.lit(1)), 4)
    return F.aggregate(last, F.lit(0).cast("long"), lambda s, b: F.when(b >= 128, b % 128).otherwise(s * 128 + b))
