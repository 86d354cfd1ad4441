"""Character styles from maps of raw properties, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the format: property numbers and the bits of the flags property.
SIZE, FONT, SCALE_X, SCALE_Y, FONT_LATIN, UNDERLINE, COLOR, BASELINE, FLAGS = 2, 3, 4, 5, 8, 13, 15, 19, 20
ON, UNDERLINED, SHIFTED, BOLD_AT, ITALIC_AT = 0x80000000, 0x10, 0x1000, 26, 28


def _bit_pair(flags: Column, at: int) -> Column:
    return F.when(F.shiftright(flags, at).bitwiseAND(3).isin(1, 2), F.lit(True))


def projected(props: Column) -> Column:
    """A struct of the style; a field that is off, absent or neutral is null, and all are without the ON flag."""
    flags = F.coalesce(F.try_element_at(props, F.lit(FLAGS)), F.lit(0)).cast("long")
    on = flags.bitwiseAND(F.lit(ON)) != 0

    def get(number: int) -> Column:
        return F.when(on, F.try_element_at(props, F.lit(number)).cast("long"))

    def unless(value: Column, *neutral: int) -> Column:
        return F.when(~value.isin(*neutral), value)

    size, color, shift = get(SIZE), unless(get(COLOR), 0, 0xFFFFFFFF), get(BASELINE)
    part = lambda at: F.lower(F.lpad(F.hex(F.shiftright(color, at).bitwiseAND(255)), 2, "0"))
    signed = F.when(shift.bitwiseAND(0x8000) != 0, shift.bitwiseAND(0xFFFF) - 0x10000).otherwise(shift.bitwiseAND(0xFFFF))
    return F.struct(
        F.when(on, _bit_pair(flags, BOLD_AT)).alias("bold"),
        F.when(on, _bit_pair(flags, ITALIC_AT)).alias("italic"),
        F.when(size > 0, F.least(F.lit(999.0), F.greatest(F.lit(1.0), F.round(size / 35.2778 * 2) / 2))).alias("size_pt"),
        unless(get(FONT), 0xFFFF, 0xFFFFFFFF).alias("font"),
        unless(get(FONT_LATIN), 0xFFFF, 0xFFFFFFFF).alias("font_latin"),
        unless(get(SCALE_X), 0, 100).alias("scale_x"),
        unless(get(SCALE_Y), 0, 100).alias("scale_y"),
        F.when(flags.bitwiseAND(UNDERLINED) != 0, unless(get(UNDERLINE), 0, 0xFFFF)).alias("underline"),
        F.when(color.isNotNull(), F.concat(F.lit("#"), part(0), part(8), part(16))).alias("color"),
        F.when(flags.bitwiseAND(SHIFTED) != 0, unless(signed, 0)).alias("baseline"),
    )
