"""Scalar rules of the sampling and frame steps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def density_count(duration: Column, fps: float = 1.0, low: int = 4, high: int = 60) -> Column:
    """Frames to take at `fps` per second, between low and high; null without a duration."""
    return F.when(duration.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.floor(duration * fps))).cast("int"))


def expected_frames(duration: Column) -> Column:
    return F.coalesce(F.floor(duration).cast("int"), F.lit(-1))


def sample_rate(frames: Column, duration: Column, k: Column, rate: Column) -> Column:
    """Every how many frames one is looked at: so that max(3k, 2 a second) remain, if there are as many."""
    need = F.greatest(3 * k, F.floor(2 * duration)).cast("long")
    known = frames.isNotNull() & duration.isNotNull() & k.isNotNull()
    return F.when(~known, F.lit(None)).when(frames < need * rate, F.greatest(F.lit(1), F.floor(frames / need))).otherwise(rate).cast("long")


def linspace(n: Column, k: Column) -> Column:
    """k whole places evenly from 0 to n - 1, in double arithmetic, the last one exact; repeats where k > n."""
    step = F.when(k > 1, (n - 1).cast("double") / F.greatest(k - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when((i == k - 1) & (k > 1), n - 1).otherwise(F.floor(i * F.coalesce(step, F.lit(0.0)))).cast("int"))


def average_hash(gray: Column) -> Column:
    """A bit for each pixel, 1 above the mean."""
    m = F.try_divide(F.aggregate(gray, F.lit(0.0), lambda s, x: s + x), F.size(gray).cast("double"))
    return F.array_join(F.transform(gray, lambda x: F.when(x > m, "1").otherwise("0")), "")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def id_date(video_id: Column) -> Column:
    """The date after the id's last underscore, null where it isn't one."""
    tail = F.substring_index(video_id, "_", -1)
    return F.when(tail.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(tail, "yyyy-MM-dd"))


def period(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def video_path(base: str, video_id: Column) -> Column:
    """base/year/MM_Month/id.mp4; an unknown month is MM_Unknown, an id without a date part gives null."""
    part = F.split(F.substring_index(video_id, "_", -1), "-")
    month = F.try_element_at(part, F.lit(2))
    # English month names.
    names = "January February March April May June July August September October November December".split()
    known = F.create_map(*[F.lit(x) for i, m in enumerate(names) for x in (f"{i + 1:02d}", m)])
    folder = F.concat(month, F.lit("_"), F.coalesce(F.try_element_at(known, month), F.lit("Unknown")))
    return F.when(F.size(part) >= 3, F.concat_ws("/", F.lit(base), part[0], folder, F.concat(video_id, F.lit(".mp4"))))


def shown_id(video_id: Column, length: int = 30) -> Column:
    """A long id cut to `length` characters, with its date."""
    cut = F.concat(F.substring(video_id, 1, length), F.lit("..."), F.substring_index(video_id, "_", -1))
    return F.when(F.length(video_id) > length, cut).otherwise(video_id)


def config_name(selection: Column, model: Column, method: Column) -> Column:
    """Names of the fixed experiment grid."""
    suffix = F.when(model == "dinov2", F.lit("dinov2_vitb14_lc")).otherwise(model)
    return F.concat_ws("_", F.lit("climate_3k"), selection, F.lit("1fps"), suffix, method)


#: The colours of up to twelve clusters, and of a single one.
PALETTE = "#e41a1c #377eb8 #4daf4a #984ea3 #ff7f00 #ffff33 #a65628 #f781bf #999999 #1f77b4 #17becf #bcbd22".split()
SINGLE = "#1f77b4"
GOLDEN_ANGLE = 137.508  # degrees


def _with(value: Column, body) -> Column:
    """body(value); the value is computed once and its expression isn't repeated."""
    return F.transform(F.array(value), body)[0]


def _rgb(hsv: Column) -> Column:
    """The hex colour of (h, s, v): a hue in sixths of the circle, saturation and value."""

    def parts(x: Column) -> Column:
        f = x["h"] - F.floor(x["h"])
        tones = [x["v"], x["v"] * (1 - x["s"]), x["v"] * (1 - x["s"] * f), x["v"] * (1 - x["s"] * (1 - f))]
        return F.struct((F.floor(x["h"]) % 6 + 1).cast("int").alias("sector"), F.transform(F.array(*tones), lambda c: F.lpad(F.hex(F.floor(c * 255).cast("long")), 2, "0")).alias("tones"))

    # Which of v, p, q and t each of red, green and blue is, by sector.
    order = [F.array(*map(F.lit, which)) for which in ((1, 3, 2, 2, 4, 1), (4, 1, 1, 3, 2, 2), (2, 2, 4, 1, 1, 3))]
    return _with(hsv, lambda x: _with(parts(x), lambda y: F.lower(F.concat(F.lit("#"), *[F.element_at(y["tones"], F.element_at(o, y["sector"])) for o in order]))))


def _hsv(h: Column, s: Column, v: Column) -> Column:
    return F.struct(h.alias("h"), s.alias("s"), v.alias("v"))


def distinct_colour(i: Column, n: Column) -> Column:
    """The i-th (from 0) of n colours: one blue, up to twelve from the palette, else by the golden angle with saturation
    and value alternating."""
    even = i % 2 == 0
    turned = _rgb(_hsv((i * F.lit(GOLDEN_ANGLE)) % 360 / 60, F.when(even, 0.8).otherwise(0.7), F.when(even, 0.8).otherwise(0.9)))
    known = F.element_at(F.array(*map(F.lit, PALETTE)), (F.least(i, F.lit(len(PALETTE) - 1)) + 1).cast("int"))
    return F.when(n == 1, SINGLE).when(n <= len(PALETTE), known).otherwise(turned)


def muted_colour(colour: Column) -> Column:
    """A hex colour with 0.4 of its saturation and 0.7 of its value."""

    def ends(x: Column) -> Column:
        return F.struct(x.alias("c"), F.array_max(x).alias("top"), (F.array_max(x) - F.array_min(x)).alias("d"))

    def muted(x: Column) -> Column:
        r, g, b = (x["c"][k] for k in range(3))
        hue = F.when(x["d"] == 0, 0.0).when(r == x["top"], (g - b) / x["d"]).when(g == x["top"], 2 + (b - r) / x["d"]).otherwise(4 + (r - g) / x["d"])
        return _hsv(F.pmod(hue, F.lit(6.0)), F.when(x["top"] == 0, 0.0).otherwise(x["d"] / x["top"] * 0.4), x["top"] * 0.7)

    rgb = _with(colour, lambda c: F.array(*[F.conv(F.substring(c, at, 2), 16, 10).cast("double") / 255 for at in (2, 4, 6)]))
    return _rgb(_with(_with(rgb, ends), muted))
