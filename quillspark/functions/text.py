"""Formatting, key and URL functions of the quoting workflow as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import js, urls

#: Status labels and the order they are shown in. Fixed values.
STATUSES = ("new", "in_review", "quoted", "sent", "accepted", "rejected")
#: Parameters that a return path loses. Fixed values.
DROPPED_PARAMS = ("access_token", "clear_access_token", "app_id", "app_base_url", "functions_version", "from_url")
MAX_SIDE, PIXEL_RATIOS = 6000, (1, 2, 3)


def date_code(ts: Column) -> Column:
    return F.date_format(ts, "MMddyyyy")


def initials(name: Column) -> Column:
    """First letters of the first and last word; one word gives one letter, none XX."""
    words = F.filter(F.split(js.trim(F.coalesce(name, F.lit(""))), f"{js.WS}+"), lambda w: w != "")
    first, last = F.upper(F.left(F.get(words, F.lit(0)), F.lit(1))), F.upper(F.left(F.element_at(words, -1), F.lit(1)))
    return F.when(F.size(words) == 0, "XX").when(F.size(words) == 1, first).otherwise(F.concat(first, last))


def customer_key(name: Column) -> Column:
    """Three letters or digits, filled up with CUS."""
    return F.left(F.concat(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9]", ""), F.lit("CUS")), F.lit(3))


def sequence_of(number: Column) -> Column:
    """The three digits that end a quote number; others count as 0."""
    return F.coalesce(js.number(F.regexp_extract(number, r"-([0-9]{3})\z", 1)).cast("int"), F.lit(0))


def quote_number(prefix: Column, sequence: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.format_string("%03d", sequence))


def full_name(first: Column, last: Column) -> Column:
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def status_label(status: Column) -> Column:
    """Shown label; unknown ones are shown as New."""
    known = F.when(status.isin(*STATUSES), status).otherwise("new")
    return F.initcap(F.replace(known, F.lit("_"), F.lit(" ")))


def page_url(name: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(name, F.lit(" "), F.lit("-")))


def spaced(code: Column) -> Column:
    return F.replace(F.coalesce(code, F.lit("")), F.lit("_"), F.lit(" "))


def file_name(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)[^a-z0-9_-]", "_")


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))


def resolved(url_value: Column, default: Column, stored: Column) -> Column:
    """First of URL parameter, default and stored value that is not empty."""
    return F.coalesce(F.nullif(url_value, F.lit("")), F.nullif(default, F.lit("")), F.nullif(stored, F.lit("")))


def deal_note(existing: Column, product: Column, value: Column) -> Column:
    """Text that prefills a note: an existing one wins; without a product a value of 0 gives none."""
    some = (F.coalesce(product, F.lit("")) != "") | (js.or_zero(value) != 0)
    parts = F.concat_ws("\n", F.when(F.coalesce(product, F.lit("")) != "", F.concat(F.lit("Product: "), product)), F.when(value.isNotNull(), F.concat(F.lit("Value: $"), js.fixed2(value))))
    return F.when(F.coalesce(existing, F.lit("")) != "", existing).when(some, parts).otherwise(F.coalesce(existing, F.lit("")))


def percent(confidence: Column) -> Column:
    """Whole percent, halves up; n/a without a value."""
    return F.when(confidence.isNull(), "n/a").otherwise(F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%")))


def return_path(raw: Column, origin: str) -> Column:
    """Path and query of an address that a browser resolves within ``origin``, without the dropped parameters; / for all others.

    A path that would be read as another host (two slashes in front, once its dot segments are gone) is no path either. Queries are form data, so they are
    encoded anew, and a parameter's name counts as decoded.
    """
    def safe(pair: Column) -> Column:
        at, home = pair["at"], pair["home"]
        inside = (at["scheme"] == home["scheme"]) & (at["host"] == home["host"]) & (at["port"] == home["port"])
        return F.when(inside & ~at["path"].startswith("//"), F.concat(at["path"], urls.form_without(at["query"], *DROPPED_PARAMS)))

    pair = F.struct(urls.resolve(raw, origin).alias("at"), urls.resolve(F.lit(origin)).alias("home"))
    return F.coalesce(F.when(F.coalesce(raw, F.lit("")) != "", F.element_at(F.transform(F.array(pair), safe), 1)), F.lit("/"))


def media_url(base: Column, name: Column, width: Column, height: Column, ratio: int) -> Column:
    """Address of a scaled image; sides are rounded and kept between 1 and MAX_SIDE."""
    side = lambda x: F.least(F.greatest(F.floor(x * ratio + 0.5), F.lit(1)), F.lit(MAX_SIDE)).cast("string")
    out = F.when(name.rlike(r"(?i)\.gif\z"), name).otherwise(F.concat(F.regexp_replace(name, r"(?i)\.[a-z0-9]+\z", ""), F.lit(".webp")))
    return F.concat(base, F.lit("/v1/fit/w_"), side(width), F.lit(",h_"), side(F.coalesce(height, width)), F.lit(",q_80,usm_0.66_1.00_0.01,enc_webp,quality_auto/"), out)


def source_set(base: Column, name: Column, width: Column, height: Column) -> Column:
    return F.concat_ws(", ", *[F.concat(media_url(base, name, width, height, r), F.lit(f" {r}x")) for r in PIXEL_RATIOS])


def escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def tolerance_text(e: Column) -> Column:
    t, n = e["tolerance_type"], lambda k: F.coalesce(js.number_text(e[k]), F.lit("0"))
    dash = lambda k: F.coalesce(js.number_text(e[k]), F.lit("—"))
    return (
        F.when(t == "bilateral", F.concat(F.lit("±"), n("plus_tolerance")))
        .when(t == "unilateral", F.concat(F.lit("+"), n("plus_tolerance"), F.lit(" / -"), n("minus_tolerance")))
        .when(t == "limit", F.concat(dash("upper"), F.lit(" / "), dash("lower")))
        .when(t == "none", "—")
        .otherwise(js.or_text(t, F.lit("—")))
    )


def moment(ts: Column) -> Column:
    """Date and time as review notes show them; empty without one."""
    return F.coalesce(F.date_format(ts, "MMM d, yyyy h:mm a"), F.lit(""))


def compacted(*cs: Column) -> Column:
    """The texts that are neither null nor empty, in order."""
    return F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != ""))


def uri_component(c: Column) -> Column:
    """encodeURIComponent: percent signs for all but letters, digits and -_.!~*'()."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def filter_query(field: str, value: Column) -> Column:
    """An equality filter as encoded JSON; of an empty value the filter that everything meets."""
    return uri_component(F.when(F.coalesce(value, F.lit("")) != "", F.to_json(F.struct(value.alias(field)))).otherwise("{}"))


def config_value(config: Column, payload: Column, nested: Column, key: str) -> Column:
    """The entry of ``config`` (a map) named by the payload's or else the nested payload's text under ``key`` (maps), or that of ``key`` itself."""
    label = F.coalesce(F.try_element_at(payload, F.lit(key)), F.try_element_at(nested, F.lit(key)), F.lit(key))
    return F.when(F.map_contains_key(config, label), F.try_element_at(config, label)).otherwise(F.try_element_at(config, F.lit(key)))


def fit_scale(parent_width: Column, own_width: Column, page_width: Column, most: int = 800, default: int = 600) -> Column:
    """Scale at which a page fits the first width that is not 0, at most ``most``; null where that is below 0."""
    width = lambda c: F.nullif(js.or_zero(c), F.lit(0.0))
    target = F.least(F.coalesce(width(parent_width), width(own_width), F.lit(float(default))), F.lit(float(most)))
    return F.when(target > 0, target / page_width)


def media_source(url: Column, hosts: dict[str, str]) -> Column:
    """struct(base, name) of an image address on one of ``hosts`` (host -> path prefix), without its transformation; null for others.

    Only https on the usual port and without a user counts, and no vector images; the address is read as a browser reads it.
    """

    def named(at: Column) -> Column:
        base = F.regexp_replace(at["path"], r"(?i)/v1/(?:fill|fit)/[^/]+/[^/]+\z", "")
        return F.struct(*[at[k].alias(k) for k in ("scheme", "user", "host", "port")], base.alias("base"), F.substring_index(base, "/", -1).alias("name"))

    def source(at: Column) -> Column:
        base, name = at["base"], at["name"]
        prefix = F.lit(None).cast("string")
        for h, p in hosts.items():
            prefix = F.when(at["host"] == h, p).otherwise(prefix)
        ok = (at["scheme"] == "https") & at["user"].isNull() & (at["port"] == "") & base.startswith(prefix) & name.rlike(r"(?i)\.[a-z0-9]+\z") & ~name.rlike(r"(?i)\.svg\z")
        return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.concat(F.lit("https://"), at["host"], base).alias("base"), name.alias("name")))

    return F.element_at(F.transform(F.transform(F.array(urls.resolve(url)), named), source), 1)


def transform_url(source: Column, width: Column, height: Column, crop: Column, focus: Column, quality: Column) -> Column:
    """Address of a scaled image: cropped to fill around ``focus`` (struct x, y of 0 to 1, or null) or fitted; sides between 1 and MAX_SIDE."""
    side = lambda x: F.least(F.greatest(F.floor(x + 0.5), F.lit(1)), F.lit(MAX_SIDE)).cast("string")
    share = lambda x: js.fixed2(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
    place = F.when(~crop, "").when(focus.isNull(), ",al_c").otherwise(F.concat(F.lit(",fp_"), share(focus["x"]), F.lit("_"), share(focus["y"])))
    name = F.when(source["name"].rlike(r"(?i)\.gif\z"), source["name"]).otherwise(F.concat(F.regexp_replace(source["name"], r"(?i)\.[a-z0-9]+\z", ""), F.lit(".webp")))
    tall = F.coalesce(F.nullif(height, F.lit(0)), width)
    return F.concat(source["base"], F.lit("/v1/"), F.when(crop, "fill").otherwise("fit"), F.lit("/w_"), side(width), F.lit(",h_"), side(tall), place, F.lit(",q_"), quality.cast("string"), F.lit(",usm_0.66_1.00_0.01,enc_webp,quality_auto/"), name)


def next_load_mode(mode: Column) -> Column:
    """What an image that failed to load is tried as next."""
    return F.when(mode == "optimized", "original").otherwise("fallback")
