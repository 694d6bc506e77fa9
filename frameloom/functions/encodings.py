"""Scalar encodings as Column expressions: quantised positions, splat attributes, normals, keys.

Rounding is half-up toward plus infinity, floor(x + 0.5), everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zeroth spherical-harmonic constant and the largest possible second-largest quaternion component.
SH_C0 = 0.28209479177387814
SQRT1_2 = sqrt(0.5)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rounded(x: Column, digits: int = 6) -> Column:
    """x to some decimals, by the same rule in any engine."""
    unit = float(10**digits)
    return half_up(x * unit) / F.lit(unit)


def quantize(v: Column, low: Column, high: Column, bits: int = 14) -> Column:
    """Level of v in [low, high]; an axis without extent divides by 1."""
    size = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    levels = (1 << bits) - 1
    return clamp(half_up((v - low) / size * levels), 0, levels).cast("long")


def quantize_unit(v: Column) -> Column:
    """16-bit level of v in [0, 1]."""
    return clamp(half_up(v * 65535.0), 0, 65535).cast("long")


def dequantize(q: Column, low: Column, high: Column, bits: int = 14) -> Column:
    return low + q * (high - low) / float((1 << bits) - 1)


def scale_byte(s: Column) -> Column:
    """Logarithmic scale in steps of 1/16."""
    return clamp(half_up((F.log(F.greatest(F.lit(1e-12), s)) + 10.0) * 16.0), 0, 255).cast("long")


def scale_of_byte(b: Column) -> Column:
    return F.exp(b / 16.0 - 10.0)


def sh_byte(v: Column) -> Column:
    return clamp(half_up(v * 128.0) + 128, 0, 255).cast("long")


def sh_of_byte(b: Column) -> Column:
    return (b - 128) / 128.0


def sh_coefficients(degree: Column) -> Column:
    """Coefficients above degree zero per colour: 0, 3, 8 or 15."""
    return F.when(degree <= 0, F.lit(0)).otherwise((degree + 1) * (degree + 1) - 1).cast("long")


def sh_stride(degree: Column) -> Column:
    """Bytes of a splat's coefficients, padded to a multiple of four."""
    return F.floor((sh_coefficients(degree) * 3 + 3) / 4).cast("long") * 4


def unit_byte(v: Column) -> Column:
    return half_up(clamp(v, 0.0, 1.0) * 255.0).cast("long")


def attribute_word0(sx: Column, sy: Column, sz: Column, opacity: Column) -> Column:
    return scale_byte(sx) + scale_byte(sy) * (1 << 8) + scale_byte(sz) * (1 << 16) + unit_byte(opacity) * (1 << 24)


def attribute_word2(r: Column, g: Column, b: Column) -> Column:
    return unit_byte(r) + unit_byte(g) * (1 << 8) + unit_byte(b) * (1 << 16)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    c = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(c / (1.0 - c))


def sh0_color(sh0: Column) -> Column:
    return 0.5 + sh0 * SH_C0


def color_sh0(c: Column) -> Column:
    return (c - 0.5) / SH_C0


def pack_quaternion(q: Sequence[Column]) -> Column:
    """Smallest three: two bits name the largest component, ten bits each hold the others' sign and size.

    Signs are taken relative to the largest component, so q and -q pack alike.
    """
    length = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    length = F.when(length == 0, F.lit(1.0)).otherwise(length)
    unit = [c / length for c in q]
    sizes = F.array(*(F.abs(c) for c in unit))
    largest = F.array_position(sizes, F.array_max(sizes)) - 1
    flip = F.element_at(F.array(*unit), (largest + 1).cast("int")) < 0
    word = largest.cast("long")
    for i, c in enumerate(unit):
        size = F.least(F.floor(F.abs(c) / SQRT1_2 * 511.0 + 0.5), F.lit(511)).cast("long")
        sign = F.when((c < 0) != flip, F.lit(512)).otherwise(F.lit(0)).cast("long")
        word = F.when(largest == i, word).otherwise(word * 1024 + sign + size)
    return word


def unpack_quaternion(word: Column) -> list[Column]:
    """x, y, z, w of a packed quaternion; the largest component is positive."""
    largest = F.shiftright(word, 30).cast("int")
    out: list[Column] = []
    stored = []
    for i in range(4):
        # Ten-bit fields in order, without the largest component's.
        place = F.when(largest < i, F.lit(3 - i)).otherwise(F.lit(2 - i))
        field = F.floor(word / F.pow(F.lit(1024.0), place)).cast("long").bitwiseAND(F.lit(1023))
        value = field.bitwiseAND(F.lit(511)) / 511.0 * SQRT1_2 * F.when(field >= 512, F.lit(-1.0)).otherwise(F.lit(1.0))
        stored.append(F.when(largest == i, F.lit(0.0)).otherwise(value))
    rest = F.sqrt(F.greatest(F.lit(0.0), 1.0 - sum((s * s for s in stored[1:]), stored[0] * stored[0])))
    for i in range(4):
        out.append(F.when(largest == i, rest).otherwise(stored[i]))
    return out


def octahedral(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """A direction as two signed 16-bit numbers; the lower half is folded over the upper."""
    s = F.abs(x) + F.abs(y) + F.abs(z)
    s = F.when(s == 0, F.lit(1.0)).otherwise(s)
    a, b = x / s, y / s
    sign = lambda v: F.when(v >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    fold_a, fold_b = (1.0 - F.abs(b)) * sign(a), (1.0 - F.abs(a)) * sign(b)
    level = lambda v: clamp(half_up(v * 32767.0), -32768, 32767).cast("long")
    return level(F.when(z < 0, fold_a).otherwise(a)), level(F.when(z < 0, fold_b).otherwise(b))


def morton(qx: Column, qy: Column, qz: Column, bits: int = 10) -> Column:
    """Bits of three levels interleaved, x lowest."""
    key = F.lit(0).cast("long")
    for axis, q in enumerate((qx, qy, qz)):
        for i in range(bits):
            key = key + F.shiftright(q.cast("long"), i).bitwiseAND(F.lit(1)) * (1 << (3 * i + axis))
    return key


def morton_level(v: Column, low: Column, high: Column) -> Column:
    size = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return clamp(half_up((v - low) * (1023.0 / size)), 0, 1023).cast("long")


def hex_color(text: Column) -> Column:
    """(r, g, b) of "#rrggbb", null if it isn't one; the # may be missing."""
    digits = F.regexp_extract(text, r"^#?([0-9a-fA-F]{6})$", 1)
    byte = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("long")
    return F.when(digits != "", F.struct(byte(1).alias("r"), byte(3).alias("g"), byte(5).alias("b")))


def color_hex(r: Column, g: Column, b: Column) -> Column:
    byte = lambda c: F.lower(F.lpad(F.hex(clamp(half_up(c), 0, 255).cast("long")), 2, "0"))
    # least and greatest skip nulls.
    return F.when(r.isNotNull() & g.isNotNull() & b.isNotNull(), F.concat(F.lit("#"), byte(r), byte(g), byte(b)))


def smoothstep_falloff(d: Column, feather: float) -> Column:
    """1 inside (d <= 0), 0 from the feather on, a cubic between."""
    t = 1.0 - d / feather if feather > 0 else F.lit(0.0)
    return F.when(d <= 0, F.lit(1.0)).when(F.lit(feather <= 0) | (d >= feather), F.lit(0.0)).otherwise(t * t * (3.0 - 2.0 * t))


def frame_to_us(frame: Column, fps: float) -> Column:
    return F.greatest(F.lit(0), half_up(frame)) * 1e6 / fps


def us_to_frame(us: Column, fps: float) -> Column:
    return F.floor(us / (1e6 / fps) + 1e-6).cast("long")


def loop_frame(raw: Column, low: int, high: int, mode: str) -> Column:
    """Frame shown when the clock says ``raw``: past the window's end it loops, goes to and fro, or stops."""
    span = high - low + 1
    if mode == "pingpong" and span > 1:
        period = 2 * (span - 1)
        p = F.pmod(raw - low, F.lit(period))
        past = low + F.when(p < span, p).otherwise(period - p)
    elif mode == "loop":
        past = low + F.pmod(raw - low, F.lit(span))
    else:
        past = F.lit(high)
    return F.when(raw <= high, F.greatest(F.lit(0), raw)).otherwise(past).cast("long")


def degrees(radians: Column) -> Column:
    return radians * 180.0 / pi


def varint_hex(n: Column) -> Column:
    """Unsigned LEB128 of at most five bytes, as hex digits; seven bits a byte, low ones first."""
    n = n.cast("long")
    more = sum(((n >= 1 << 7 * k).cast("int") for k in range(1, 5)), F.lit(0))
    digit = lambda i: F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127)) + F.when(i < more, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), more), lambda i: F.lpad(F.hex(digit(i)), 2, "0")), "")
