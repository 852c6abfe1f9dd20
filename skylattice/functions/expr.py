"""Pure Column functions: identifiers, flags, magnitudes, sky geometry, times, phases, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEG = math.pi / 180
JD_UNIX_EPOCH = 2440587.5


def clean(x: Column) -> Column:
    """NaN is missing: NULL instead."""
    return F.when(~F.isnan(x), x)


def at_most(x: Column, limit: Column | float) -> Column:
    """The lower of the two where x is known; least() alone would take the limit for an unknown x."""
    return F.when(x.isNotNull(), F.least(x, F.lit(limit) if isinstance(limit, (int, float)) else limit))


def at_least(x: Column, limit: Column | float) -> Column:
    """The higher of the two where x is known."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(limit) if isinstance(limit, (int, float)) else limit))


def exact_id(text: Column) -> Column:
    """A catalog id as exact digits: whole numbers as they are, other numbers through decimal(38,0), names unchanged."""
    t = F.trim(text)
    whole = t.try_cast("double").isNotNull() & ~F.isnan(t.try_cast("double"))
    return (
        F.when(t.isNull() | F.lower(t).isin("", "nan", "none", "null"), F.lit(None))
        .when(t.rlike(r"^-?\d+$"), t)
        .when(whole, F.coalesce(t.try_cast("decimal(38,0)").cast("string"), t))
        .otherwise(t)
    )


def preferred_id(name: Column, catalog_id: Column) -> Column:
    """The name where it is an id of 12 to 22 digits, else the exact catalog id."""
    return F.when(F.trim(name).rlike(r"^\d{12,22}$"), F.trim(name)).otherwise(exact_id(catalog_id))


def flag(x: Column) -> Column:
    """Text flags: true, 1, yes, y and t are true; NULL and anything else false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "1.0", "yes", "y", "t"), F.lit(False))


def active(x: Column) -> Column:
    """Soft-delete flags: NULL counts as active; false, 0, no, n and inactive don't."""
    return F.coalesce(~F.lower(F.trim(x.cast("string"))).isin("false", "0", "0.0", "no", "n", "inactive"), F.lit(True))


def magnitude(flux: Column) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux))


def flux_of(mag: Column) -> Column:
    return F.pow(F.lit(10.0), -0.4 * mag)


def colour_bv(bp_rp: Column) -> Column:
    """Johnson B-V from BP-RP, on 0.1 to 2.5."""
    return F.when(bp_rp.between(0.1, 2.5), 0.0850 + 0.9447 * bp_rp - 0.1019 * bp_rp * bp_rp)


def photometric_error(flux: Column, sky: Column, area: Column, gain: Column | float = 1.0) -> Column:
    g = F.lit(gain) if isinstance(gain, float) else gain
    return F.when(flux > 0, F.sqrt(flux / g + at_least(sky, 0.0) * area) / flux)


def signal_to_noise(flux: Column, sky: Column, radius: Column) -> Column:
    return F.when(flux > 0, flux / F.sqrt(flux + at_least(sky, 0.0) * math.pi * radius * radius))


def magnitude_error(flux: Column, flux_error: Column) -> Column:
    return F.when(flux > 0, 2.5 / math.log(10) * flux_error / flux)


def haversine(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Separation in degrees; unknown where a coordinate is."""
    a = F.pow(F.sin((dec2 - dec1) * (DEG / 2)), 2) + F.cos(dec1 * DEG) * F.cos(dec2 * DEG) * F.pow(F.sin((ra2 - ra1) * (DEG / 2)), 2)
    return 2 / DEG * F.asin(F.sqrt(at_most(a, 1.0)))


def ra_delta(a: Column, b: Column) -> Column:
    """a - b on the circle, -180 to 180."""
    return F.pmod(a - b + 540, F.lit(360.0)) - 180


def planar_offset(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    return F.sqrt(F.pow(ra_delta(ra, ra0) * F.cos(dec0 * DEG), 2) + F.pow(dec - dec0, 2))


def unit_vector(ra: Column, dec: Column) -> list[Column]:
    return [F.cos(dec * DEG) * F.cos(ra * DEG), F.cos(dec * DEG) * F.sin(ra * DEG), F.sin(dec * DEG)]


def angle_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def julian_day(ts: Column) -> Column:
    """Julian day of a timestamp without zone, taken as UTC."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return days + seconds / 86400.0 + JD_UNIX_EPOCH


def mid_exposure(start: Column, seconds: Column) -> Column:
    return julian_day(start) + seconds / 2 / 86400.0


def day_of_julian(jd: Column) -> Column:
    """yyyymmdd of a Julian day."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(jd - JD_UNIX_EPOCH).cast("int")), "yyyyMMdd")


def phase(jd: Column, epoch: Column, period: Column) -> Column:
    return F.when(period > 0, F.pmod((jd - epoch) / period, F.lit(1.0)))


def next_minimum(jd: Column, epoch: Column, period: Column) -> Column:
    return F.when(period > 0, epoch + F.ceil((jd - epoch) / period) * period)


def eclipse_model(ph: Column, mag0: Column, depth: Column, width: Column, harmonics: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Column:
    """Brightness over phase: one eclipse of cosh shape at phase 0 and up to three harmonics."""
    x = (ph - F.round(ph)) / width
    dip = depth * F.exp(1 - F.cosh(x))
    out = mag0 + dip
    for k, a in enumerate(harmonics, 1):
        out = out + a * F.cos(2 * math.pi * k * ph)
    return out


def aperture_category(bp_rp: Column) -> Column:
    return F.when(bp_rp.isNull(), "neutral").when(bp_rp < 0.5, "blue").when(bp_rp <= 1.5, "neutral").otherwise("red")


def plate_scale(pixel_um: Column, focal_mm: Column) -> Column:
    """Arc seconds to a pixel."""
    return F.when(focal_mm > 0, 206.265 * pixel_um / focal_mm)


def field_diagonal(width_px: Column, height_px: Column, scale: Column) -> Column:
    return F.sqrt(width_px * width_px + height_px * height_px) * scale / 3600


def observation_hash(day: Column, *parts: Column) -> Column:
    """yyyymmdd_ and the first six signs of an md5 over the parts to eight places."""
    text = F.concat_ws("|", *[F.format_string("%.8f", p) for p in parts])
    return F.concat(day, F.lit("_"), F.substring(F.md5(text.cast("binary")), 1, 6))


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def triangle_shape(a: Column, b: Column, c: Column) -> list[Column]:
    """Two side ratios and the log of the longest side of a triangle."""
    sides = F.array_sort(F.array(a, b, c))
    longest = sides[2]
    return [F.when(longest > 0, sides[0] / longest), F.when(longest > 0, sides[1] / longest), F.when(longest > 0, F.log10(longest))]


def comparison_score(rms: Column, distance_arcsec: Column, d_mag: Column, d_bv: Column, contamination: Column, optimum: float = 1455.0) -> Column:
    """Lower is better. A missing rms counts as 1, a missing distance as the worst, other missing parts as none."""
    return (
        0.50 * F.greatest(F.coalesce(clean(rms), F.lit(1.0)), F.lit(1e-4))
        + 0.20 * F.coalesce(F.abs(clean(distance_arcsec) - optimum) / optimum, F.lit(1.0))
        + 0.15 * F.coalesce(at_most(clean(d_mag) / 2, 1.0), F.lit(0.0))
        + 0.10 * F.coalesce(at_most(clean(d_bv), 1.0), F.lit(0.0))
        + 0.05 * F.coalesce(clean(contamination), F.lit(0.0))
    )


# The limits of magnitude and colour differences of the four tiers.
TIERS = ((0.25, 0.15), (0.50, 0.30), (1.00, 0.50), (2.00, math.inf))


def tier(d_mag: Column, d_bv: Column, tiers: tuple[tuple[float, float], ...] = TIERS) -> Column:
    """The strictest tier that a pair satisfies. An unknown colour difference skips the colour's limit; an unknown
    magnitude difference satisfies none, and what satisfies none is in the last tier."""
    out = F.lit(f"TIER{len(tiers)}")
    for k, (m, b) in reversed(list(enumerate(tiers, 1))):
        ok = F.coalesce(clean(d_mag) <= m, F.lit(False)) & (F.lit(True) if math.isinf(b) else F.coalesce(clean(d_bv) <= b, F.lit(True)))
        out = F.when(ok, f"TIER{k}").otherwise(out)
    return out


# ---------------------------------------------------------------- times


def timestamp_of(jd: Column) -> Column:
    return F.timestamp_seconds((jd - JD_UNIX_EPOCH) * 86400.0)


def hours_minutes(jd: Column) -> Column:
    """HH:MM in UTC of a Julian day, to the nearest second."""
    s = F.pmod(F.round((jd - JD_UNIX_EPOCH) * 86400.0).cast("long"), F.lit(86400))
    return F.format_string("%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60))


def observed_at(date_obs: Column, time_obs: Column | None = None) -> Column:
    """The start of an exposure from header texts: a full date and time, or a date and a time beside it."""
    text = F.trim(date_obs)
    if time_obs is not None:
        text = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & time_obs.isNotNull(), F.concat(text, F.lit("T"), F.trim(time_obs))).otherwise(text)
    return F.regexp_replace(text, "Z$", "").try_cast("timestamp_ntz")


def mid_exposure_of(date_obs: Column, time_obs: Column | None, seconds: Column) -> Column:
    """Julian day of the middle of an exposure; a missing exposure time counts as none."""
    return julian_day(observed_at(date_obs, time_obs)) + F.coalesce(clean(seconds), F.lit(0.0)) / 2 / 86400.0


def age_days(now: Column, then: Column) -> Column:
    """Days between two dates, none below 0; unknown where a date is."""
    return at_least((now.cast("timestamp").cast("double") - then.cast("timestamp").cast("double")) / 86400.0, 0.0)


def validity(age: Column, limit_days: Column | float) -> Column:
    """OK, Warning from 80 % of the limit (at least a day), Expired beyond it; Missing where there is no age."""
    lim = F.greatest(F.lit(1.0), F.lit(limit_days) if isinstance(limit_days, (int, float)) else limit_days)
    return F.when(clean(age).isNull(), "Missing").when(age > lim, "Expired").when(age >= 0.8 * lim, "Warning").otherwise("OK")


# ---------------------------------------------------------------- headers, pointings, optics


def sexagesimal(text: Column, *, hours: bool) -> Column:
    """Degrees from a header's text: a decimal number as it is, parts by colon, space or unit letters as hours or degrees,
    minutes, seconds. Anything else is NULL."""
    t = F.trim(text)
    parts = F.split(F.regexp_replace(F.regexp_replace(t, r"[hHmMsSdD°'\u2032\u2033\":]+", " "), r"^[+-]", ""), r"\s+")
    number = lambda i: F.coalesce(F.get(parts, F.lit(i)).try_cast("double"), F.lit(0.0))
    value = (number(0) + number(1) / 60 + number(2) / 3600) * (15.0 if hours else 1.0)
    signed = F.when(t.startswith("-"), -value).otherwise(value)
    shaped = t.rlike(r"^[+-]?\d+\s*[hHdD°: ]\s*\d+(\s*[mM': ]\s*\d+(\.\d*)?)?\s*[sS\"]?$")
    return F.when(t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")).when(shaped, signed)


def first_pair(*pairs: tuple[Column, Column]) -> Column:
    """(ra_deg, dec_deg) of the first pair that has both: targets before header hints before the observer's own."""
    whole = [F.when(clean(a).isNotNull() & clean(b).isNotNull(), F.struct(a.cast("double").alias("ra_deg"), b.cast("double").alias("dec_deg"))) for a, b in pairs]
    return F.coalesce(*whole)


def gain_of(header: Column, stored: Column, fallback: float = 1.0) -> Column:
    """(gain, source): the stored gain, else the header's EGAIN, else the fallback; only positive values count."""
    egain = header["EGAIN"].try_cast("double")
    return F.when(clean(stored) > 0, F.struct(stored.cast("double").alias("gain"), F.lit("DB").alias("source"))).when(clean(egain) > 0, F.struct(egain.alias("gain"), F.lit("FITS EGAIN").alias("source"))).otherwise(F.struct(F.lit(fallback).alias("gain"), F.lit("fallback").alias("source")))


def positive_of(header: Column, name: str) -> Column:
    """A header number where it is positive, as the noise and width keywords are."""
    x = clean(header[name].try_cast("double"))
    return F.when(x > 0, x)


def focal_length(raw_mm: Column) -> Column:
    """A focal length of 1750 to 2250 mm is a tenth of it mistyped."""
    return F.when(raw_mm.between(1750.0, 2250.0), raw_mm / 10).otherwise(raw_mm)


def cone_radius(diameter_deg: Column) -> Column:
    return F.when(clean(diameter_deg) > 0, 0.5 * diameter_deg * 1.2).otherwise(0.0)


def optics_cone_radius(width_px: Column, height_px: Column, pixel_um: Column, focal_mm: Column, *, margin: float = 1.3, floor_deg: float = 3.5, fallback_deg: float = 1.0) -> Column:
    """Radius that a catalogue query needs to cover a chip, with a floor that shrinks with the focal length."""
    scale = F.coalesce(plate_scale(pixel_um, focal_length(focal_mm)), F.lit(0.0))
    half = 0.5 * F.sqrt(F.pow(F.greatest(width_px, F.lit(1)) * scale / 3600, 2) + F.pow(F.greatest(height_px, F.lit(1)) * scale / 3600, 2)) * margin
    low = F.greatest(F.lit(0.08), F.least(F.lit(floor_deg), 600.0 / focal_mm))
    return F.when((clean(focal_mm) > 0) & (clean(pixel_um) > 0), F.greatest(F.lit(0.08), half, low)).otherwise(F.lit(max(floor_deg, max(0.05, fallback_deg) * 0.65)))


def match_tolerance(scale: Column, *, floor_arcsec: float = 3.0, fallback_arcsec: float = 20.0) -> Column:
    return F.when(clean(scale) > 0, F.greatest(F.lit(floor_arcsec), scale * 2.5)).otherwise(fallback_arcsec)


def scale_bounds(scale: Column) -> Column:
    """(low, high): the band of plate scales that a solver is given around the nominal one."""
    low, high = F.greatest(F.lit(0.03), scale * (8.0 / 9.55)), F.least(F.lit(180.0), scale * (11.0 / 9.55))
    low2, high2 = F.greatest(F.lit(0.03), scale * 0.52), F.least(F.lit(180.0), scale * 1.75)
    fits = high > low
    lo, hi = F.when(fits, low).otherwise(low2), F.when(fits, high).when(high2 > low2, high2).otherwise(F.least(F.lit(180.0), low2 * 1.25))
    known = clean(scale) > 0
    return F.struct(F.when(known, lo).otherwise(0.03).alias("low"), F.when(known, hi).otherwise(180.0).alias("high"))


def matrix_quality(cd11: Column, cd22: Column, expected: Column, *, limit: float = 1.3) -> Column:
    """Scales of a pixel matrix's diagonal in arc seconds, their ratio, distance from the expected scale, and whether that is
    a sane solution."""
    sx, sy = F.abs(cd11) * 3600, F.abs(cd22) * 3600
    ratio = F.when(sx.isNotNull() & sy.isNotNull(), F.greatest(sx, sy) / F.greatest(F.least(sx, sy), F.lit(0.001)))
    mean = (sx + sy) / 2
    error = F.abs(mean - expected) / at_least(expected, 1e-9) * 100
    return F.struct(sx.alias("scale_x"), sy.alias("scale_y"), mean.alias("mean_scale"), ratio.alias("ratio"), error.alias("scale_err_pct"), ((ratio <= limit) & (error < 20.0)).alias("ok"))


# Magnitude below which an aperture's width, height, inner gap, guard and sky size hold; the last and the
# unknown at the end.
APERTURES = ((8.0, (7, 7, 7, 7, 20)), (10.0, (8, 8, 5, 5, 20)), (13.0, (6, 6, 3, 3, 14)), (15.5, (4, 4, 2, 2, 10)))
APERTURE_FAINT, APERTURE_UNKNOWN = (5, 5, 1, 1, 10), (4, 4, 2, 2, 10)


def aperture_parameters(mag: Column) -> Column:
    """Array of the five aperture sizes for a star's magnitude."""
    sizes = lambda x: F.array(*[F.lit(v) for v in x])
    out = F.when(clean(mag).isNull(), sizes(APERTURE_UNKNOWN))
    for limit, x in APERTURES:
        out = out.when(mag < limit, sizes(x))
    return out.otherwise(sizes(APERTURE_FAINT))


def binned_columns(bad: Column, light_binning: Column, native_binning: Column) -> Column:
    """Native bad columns (array) as the distinct columns of a frame binned more coarsely."""
    factor = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), light_binning) / F.greatest(F.lit(1), F.coalesce(native_binning, F.lit(1))))).cast("int")
    return F.array_sort(F.array_distinct(F.transform(bad, lambda x: F.floor(x / factor).cast("int"))))


def polynomial_features(x: Column, y: Column) -> list[Column]:
    """Terms of the displacement model in normalised coordinates."""
    r2 = x * x + y * y
    return [F.lit(1.0), x, y, r2, x * y, x * r2, y * r2, r2 * r2]


def displacement(x: Column, y: Column, norm: tuple[float, float, float, float], coefficients: list[float]) -> Column:
    """A fitted displacement at (x, y); norm: centre and spread of x and y (x0, y0, sx, sy)."""
    x0, y0, sx, sy = norm
    terms = polynomial_features((x - x0) / sx, (y - y0) / sy)
    out = F.lit(0.0)
    for c, term in zip(coefficients, terms, strict=True):
        out = out + F.lit(float(c)) * term
    return out


def distortion_terms(u: Column, v: Column, order: int, least: int = 2) -> Column:
    """Map from "i,j" to u**i v**j for all least <= i + j <= order."""
    pairs = [(i, j) for i in range(order + 1) for j in range(order + 1 - i) if i + j >= least]
    return F.create_map(*[c for i, j in pairs for c in (F.lit(f"{i},{j}"), F.pow(u, F.lit(float(i))) * F.pow(v, F.lit(float(j))))])


# ---------------------------------------------------------------- texts


def general(x: Column, digits: int) -> Column:
    """A number to so many significant digits without trailing zeros, for values from 1e-4 up to 10**digits."""
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x)) + 1e-12)).cast("int")
    scaled = F.bround(x * F.pow(F.lit(10.0), (digits - 1 - size).cast("double")), 0) / F.pow(F.lit(10.0), (digits - 1 - size).cast("double"))
    return F.regexp_replace(F.bround(scaled.cast("decimal(30,12)"), 12).cast("string"), r"\.?0+$", "")


def group_key(filter_name: Column, exposure: Column, binning: Column) -> Column:
    """filter|exposure|binning of an observation group; unknown filters are NoFilter."""
    t = F.trim(filter_name)
    name = F.when(t.isNull() | F.lower(t).isin("", "unknown", "none", "nan"), "NoFilter").otherwise(t)
    return F.concat_ws("|", name, general(F.coalesce(clean(exposure), F.lit(0.0)), 6), F.greatest(F.lit(1), F.coalesce(binning, F.lit(1))).cast("int").cast("string"))


def folder_name(key: Column) -> Column:
    return F.substring(F.regexp_replace(key, r"[^\p{L}\p{N}._-]", "_"), 1, 120)


def token(text: Column) -> Column:
    """A name's part without spaces and slashes; Unknown where nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), " ", ""), r"[/\\]", "-")
    return F.when(t.isNull() | (t == ""), "Unknown").otherwise(t)


def draft_id(text: Column) -> Column:
    """The number of a draft named in a text or path, or the text itself where it is a number."""
    t = F.regexp_replace(F.trim(text), "^[\"']+|[\"']+$", "")
    named = F.regexp_extract(t, r"(?i)draft[_-]?(\d{1,8})(?:\D|$)", 1)
    return F.when(t.rlike(r"^\d+$"), t.try_cast("long")).when(named != "", named.try_cast("long"))


def labels(flags: dict[str, Column]) -> Column:
    """The labels whose flag is set, joined by commas in the given order; a number is set when positive, a text unless it
    says no."""
    set_ = lambda c: F.coalesce(F.when(c.cast("string").try_cast("double").isNotNull(), c.cast("string").try_cast("double") > 0).otherwise(~F.trim(c.cast("string")).isin("", "0", "N", "n", "F", "f", "--", "false")), F.lit(False))
    return F.array_join(F.array_compact(F.array(*[F.when(set_(c), F.lit(name)) for name, c in flags.items()])), ", ")


def match_summary(name: Column, kind: Column, period: Column, amplitude: Column, distance: Column) -> Column:
    """Type, period, amplitude and distance of a catalogue match, those that there are; else its name, else a dash."""
    text = F.concat_ws(" · ", kind, F.concat(F.lit("P="), general(period, 4), F.lit("d")), F.concat(F.lit("amp="), general(amplitude, 3)), F.when(distance.isNotNull(), F.concat(F.lit("dr="), F.format_string("%.2f", F.bround(distance.cast("double"), 2)), F.lit('"'))))
    text = F.when(kind.isNull() & period.isNull() & amplitude.isNull() & distance.isNull(), F.lit(None)).otherwise(text)
    return F.coalesce(text, name, F.lit("—"))


def catalogue_link(ra: Column, dec: Column, base: str) -> Column:
    """A link to a catalogue service: base with the position to six places after it."""
    return F.format_string(base.replace("%", "%%") + "%.6f%%20%.6f&-c.rs=2", ra, dec)


def session_id(prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.regexp_replace(F.uuid(), "-", ""), 1, 12))
