"""Scalar functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label names and their values (fixed values).
LABELS = {"REFERRED_OBJECT": 0, "REFERRED": 0, "RELATED_OBJECT": 1, "RELATED": 1, "OTHER_OBJECT": 2, "OTHER": 2}

#: Groups of object names whose members may match each other (fixed values).
TAXONOMY = {
    "REGULAR_VEHICLE": "VEHICLE",
    "LARGE_VEHICLE": "VEHICLE",
    "BOX_TRUCK": "VEHICLE",
    "TRUCK": "VEHICLE",
    "TRUCK_CAB": "VEHICLE",
    "BUS": "VEHICLE",
    "SCHOOL_BUS": "VEHICLE",
    "ARTICULATED_BUS": "VEHICLE",
    "EMERGENCY_VEHICLE": "VEHICLE",
    "VEHICLE": "VEHICLE",
    "BICYCLIST": "BICYCLE",
    "BICYCLE": "BICYCLE",
    "MOTORCYCLIST": "MOTORCYCLE",
    "MOTORCYCLE": "MOTORCYCLE",
    "PEDESTRIAN": "PEDESTRIAN",
    "ANIMAL": "ANIMAL",
    "WHEELED_DEVICE": "WHEELED_DEVICE",
    "WHEELCHAIR": "WHEELED_DEVICE",
    "STROLLER": "WHEELED_DEVICE",
}


#: All white space, for engines whose \\s or trim knows less of it.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+\z", "")


def missing(c: Column, kind: str = "string") -> Column:
    """Null, empty text and NaN are missing."""
    gone = c.isNull()
    return gone | (c == "") if kind == "string" else gone | F.isnan(c) if kind in ("double", "float") else gone


def number(c: Column) -> Column:
    """A finite double, else null."""
    v = c.try_cast("double")
    return F.when(F.abs(v) < float("inf"), v)


def coerce_label(c: Column) -> Column:
    """Names by alias and digit strings to integers; null otherwise."""
    t = F.upper(strip(c))
    out = F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))
    for name, value in LABELS.items():
        out = out.when(t == name, value)
    return out


def label_text(c: Column) -> Column:
    """As coerce_label, as text; what is no label stays as it was."""
    return F.coalesce(coerce_label(c).cast("string"), c)


def any_label(c: Column) -> Column:
    """Any integer, cut off if it has decimals; NaN and other text are unknown (null)."""
    return c.try_cast("int")


def as_list(c: Column, kind: str) -> Column:
    """An array stays, anything else becomes an array of one."""
    return c if kind.startswith("array") else F.array(c)


def tri_state(c: Column) -> Column:
    """0, 1 and 2 stay; all else is unknown (null)."""
    v = c.try_cast("int")
    return F.when(v.isin(0, 1, 2), v)


def score_or_last(c: Column) -> Column:
    """A missing score ranks last."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))


def template_key(c: Column) -> Column:
    """Lower-case, stripped, long ids to <id>, numbers that begin a word to <num>, runs of white space to one blank; null is empty."""
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    t = F.regexp_replace(t, r"[0-9a-f]{8}-[0-9a-f-]{27,}", "<id>")
    t = F.regexp_replace(t, r"\b[0-9]+(?:\.[0-9]+)?", "<num>")
    return F.regexp_replace(t, f"{BLANK}+", " ")


def prompt_key(c: Column) -> Column:
    """Lower-case, numbers to #, other characters than letters, digits and # to blanks, collapsed."""
    t = F.regexp_replace(F.lower(c), r"[0-9]+(\.[0-9]+)?", "#")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9# ]", " "), " +", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays' distinct members."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def taxonomy_group(c: Column) -> Column:
    t = F.upper(strip(c))
    known = F.create_map(*[F.lit(x) for pair in TAXONOMY.items() for x in pair])
    return F.coalesce(F.try_element_at(known, t), t)


def class_compatible(a: Column, b: Column) -> Column:
    """Whether two object names are of one group."""
    return F.coalesce(taxonomy_group(a) == taxonomy_group(b), F.lit(False))


def drop_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def box_area(box: Column) -> Column:
    """Of [x0, y0, x1, y1]; null or malformed is 0."""
    side = lambda i, j: F.greatest(F.lit(0.0), F.get(box, j) - F.get(box, i))
    return F.when(F.size(box) == 4, side(0, 2) * side(1, 3)).otherwise(F.lit(0.0))


def sigmoid(c: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), c))))


def finite_vector(v: Column, n: int) -> Column:
    return F.coalesce((F.size(v) == n) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def volume(size: Column) -> Column:
    return F.aggregate(size, F.lit(1.0), lambda a, x: a * x)


def count_bin(n: Column) -> Column:
    """Audit bins: 0, 1-10, 11-50, 51-100, 101+."""
    return F.when(n < 0, F.raise_error(F.lit("negative count"))).when(n == 0, "0").when(n <= 10, "1-10").when(n <= 50, "11-50").when(n <= 100, "51-100").otherwise("101+")


def size_bin(n: Column) -> Column:
    """Metric bins: 1-64, 65-128, 129-256, 257+."""
    return F.when(n.between(1, 64), "1-64").when(n.between(65, 128), "65-128").when(n.between(129, 256), "129-256").when(n >= 257, "257+")


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def group_seed(seed: int, *key: Column) -> Column:
    """The first four bytes of the SHA-256 of seed|key, read little-endian."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]), 256)
    part = lambda i: F.substring(h, i, 2)
    return F.conv(F.concat(part(7), part(5), part(3), part(1)), 16, 10).cast("long")


def digest_mod10(h: Column) -> Column:
    """A hex digest as a number modulo 10: 16^k is 6 modulo 10 for k of 1 or more."""
    digit = lambda c: F.conv(c, 16, 10).cast("int")
    digits = F.filter(F.split(h, ""), lambda c: c != "")
    total = F.aggregate(digits, F.lit(0), lambda a, c: a + digit(c))
    last = digit(F.substring(h, -1, 1))
    return (6 * (total - last) + last) % 10


def split_bucket(c: Column) -> Column:
    """60/20/20 by the SHA-256 of a text."""
    m = digest_mod10(F.sha2(c, 256))
    return F.when(m < 6, "train").when(m < 8, "validation").otherwise("test")


def box_features(box: Column, width: Column, height: Column, distance: Column, size: Column, translation: Column) -> Column:
    """Twelve numbers: box over the image's size, whether there is one, distance / 50, size / 10, translation / 50; nulls are 0."""
    at = lambda v, i, d=1.0: F.coalesce(F.get(v, i), F.lit(0.0)) / d
    sound = lambda c: F.when(c > 0, c).otherwise(F.raise_error(F.lit("image dimensions must be positive")).cast("double"))
    width, height = sound(width), sound(height)
    return F.array(
        at(box, 0) / width, at(box, 1) / height, at(box, 2) / width, at(box, 3) / height,
        F.when(box.isNull(), 0.0).otherwise(1.0), F.coalesce(distance, F.lit(0.0)) / 50.0,
        *[at(size, i, 10.0) for i in range(3)], *[at(translation, i, 50.0) for i in range(3)],
    )


def metadata_features(score: Column, raw_label: Column, distance: Column) -> Column:
    zero = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.array(zero(score), zero(raw_label) / 10.0, zero(distance) / 50.0)


def diagnosis_features(box: Column, score: Column, distance: Column, match_distance: Column, size: Column, translation: Column) -> Column:
    """The ten named numbers whose distributions are compared; whatever is missing is null, but no box is an area of 0."""
    get = lambda v, i: number(F.get(v, i))
    named = {
        "projected_area_px": box_area(box), "tracker_score": number(score), "distance_m": number(distance), "match_distance_m": number(match_distance),
        "size_length_m": get(size, 0), "size_width_m": get(size, 1), "size_height_m": get(size, 2),
        "translation_x_m": get(translation, 0), "translation_y_m": get(translation, 1), "translation_z_m": get(translation, 2),
    }
    return F.struct(*[v.alias(k) for k, v in named.items()])


FEATURES = ("projected_area_px", "tracker_score", "distance_m", "match_distance_m", "size_length_m", "size_width_m", "size_height_m", "translation_x_m", "translation_y_m", "translation_z_m")
