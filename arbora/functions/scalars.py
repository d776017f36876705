"""Column expressions: identifiers, text, hashes, colour numbers, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a browser's trim() removes.
TRIMMED = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Start hue and hue range of the nine spectrum palettes.
PALETTES = {
    "red": (350, 40),
    "orange": (20, 40),
    "yellow": (40, 40),
    "lime": (80, 40),
    "green": (110, 40),
    "teal": (170, 40),
    "blue": (210, 40),
    "purple": (270, 40),
    "pink": (320, 40),
}
# Share of the hue range, saturation and lightness of the five slots.
PALETTE_SLOTS = [(0.0, 75, 45), (0.5, 65, 60), (0.25, 80, 35), (0.75, 55, 55), (1.0, 70, 50)]
# Lightness of the five slots of the grey palette.
GRAY_LIGHTNESS = [30, 45, 55, 40, 65]

_UINT32 = 0xFFFFFFFF


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIMMED))


def has_text(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def label_or_id(label: Column, node_id: Column) -> Column:
    return F.when(has_text(label), label).otherwise(F.coalesce(node_id, F.lit("")))


def id_of(end: Column) -> Column:
    """Id of a link end that is plain text, a number, or a JSON object with an id."""
    text = end.cast("string")
    inner = F.coalesce(F.get_json_object(text, "$.id"), F.lit("undefined"))
    return F.when(text.isNull(), "null").when(text.startswith("{"), inner).otherwise(text)


def collate(text: Column) -> Column:
    """Dictionary order as people expect it, instead of byte order."""
    return F.collate(text, "UNICODE")


def attribute_key(category: Column, attr: Column) -> Column:
    return F.concat(category, F.lit("::"), attr)


def key_category(key: Column) -> Column:
    """First part of a key; a key without parts belongs to "Attribute"."""
    return F.when(F.contains(key, F.lit("::")), F.split_part(key, F.lit("::"), F.lit(1))).otherwise("Attribute")


def key_name(key: Column) -> Column:
    """Second part of a key, without what may follow."""
    return F.when(F.contains(key, F.lit("::")), F.split_part(key, F.lit("::"), F.lit(2))).otherwise(key)


def _hash_step(state: Column, unit: Column) -> Column:
    return (state * 31 + unit).bitwiseAND(F.lit(_UINT32))


def hash32(text: Column) -> Column:
    """h = 31*h + unit over the UTF-16 units, kept to 32 bits, as BIGINT."""

    def step(state: Column, char: Column) -> Column:
        point = F.ascii(char).cast("bigint")
        above = point - 0x10000
        high = F.lit(0xD800) + F.shiftright(above, 10)
        low = F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))
        pair = _hash_step(_hash_step(state, high), low)
        return F.when(point > 0xFFFF, pair).otherwise(_hash_step(state, point))

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("bigint"), step)


def category_hue(category: Column) -> Column:
    """Hue of a category in steps of 40 degrees; halves round up."""
    hue = hash32(category) % 360
    return (F.floor((hue + 20) / 40) * 40 % 360).cast("bigint")


def attribute_hue(attr: Column) -> Column:
    return hash32(attr) % 360


def org_colour(org_id: Column, depth: Column) -> Column:
    return F.struct(
        (hash32(org_id) % 360).alias("hue"),
        (depth * 5 + 60).cast("bigint").alias("saturation"),
        (depth * 3 + 45).cast("bigint").alias("lightness"),
    )


def cluster_hue(org_id: Column) -> Column:
    return hash32(org_id) % 12 * 30


def palette_colour(ordinal: Column, palette: str = "blue", category: Column | None = None) -> Column:
    """Hue, saturation and lightness of the ordinal-th attribute of a category.

    An unknown palette name falls back to shades around the category's own hue.
    """
    slot = ordinal % 5
    if palette == "gray":
        light = F.element_at(F.array(*map(F.lit, GRAY_LIGHTNESS)), (slot + 1).cast("int"))
        parts = F.lit(0.0), F.lit(0), light
    elif palette in PALETTES:
        start, width = PALETTES[palette]
        table = F.array(
            *[
                F.struct(F.lit((start + share * width) % 360).alias("h"), F.lit(s).alias("s"), F.lit(v).alias("l"))
                for share, s, v in PALETTE_SLOTS
            ]
        )
        row = F.element_at(table, (slot + 1).cast("int"))
        parts = row["h"], row["s"], row["l"]
    else:
        if category is None:
            raise ValueError(f"palette {palette!r} is unknown and no category was given")
        hue = (category_hue(category) + ordinal % 6 * 10) % 360
        parts = hue, F.lit(65), F.lit(50) + ordinal % 2 * 5
    return F.struct(
        parts[0].cast("double").alias("hue"),
        parts[1].cast("bigint").alias("saturation"),
        parts[2].cast("bigint").alias("lightness"),
    )


def level_band(level: Column) -> Column:
    return F.when(level == 0, "top").when(level <= 2, "mid").otherwise("low")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.try_divide(edit_distance(a, b), longest))
