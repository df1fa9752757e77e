"""Addresses as browsers read them: resolution against an origin, and queries as form data. http and https only; other schemes have no result.

Follows the URL Standard for these schemes: control characters and spaces around an address go, tabs and line breaks anywhere; a backslash before the
query is a slash; dot segments (also ``%2e``) are resolved on a stack; scheme and host are lower case, default ports go. Host names outside of ASCII are not
mapped: they have no result, so they never count as one's own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that an address need not name. Fixed values.
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: ASCII marks that stay as they are in a path, besides letters, digits and ``.-*_``. Fixed values; the percent sign comes last.
PATH_MARKS = "!$&'()+,/:;=@[]|~%"
_NAME = r"[^\x00-\x20\x7f-\uffff#/:<>?@\[\\\]^|%\"]+"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def percent_decoded(c: Column, plus: bool = False) -> Column:
    """Text of percent-encoded UTF-8; percent signs that begin no code stay, and so does + unless it stands for a space."""
    out = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(out if plus else F.replace(out, F.lit("+"), F.lit("%2B")))


def _path_encoded(path: Column) -> Column:
    def encoded(p: Column) -> Column:
        out = F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        for mark in PATH_MARKS:
            out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
        return F.when(p.rlike(r"[^A-Za-z0-9/._*%-]"), out).otherwise(p)

    return _bind(path, encoded)


def _walked(path: Column) -> Column:
    """A path that begins with a slash, without dot segments: each segment is pushed on a stack, two dots pop one."""
    single, double = r"(?i)\A(?:\.|%2e)\z", r"(?i)\A(?:\.|%2e){2}\z"

    def step(stack: Column, part: Column) -> Column:
        popped = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when(part.rlike(double), popped).when(part.rlike(single), stack).otherwise(F.concat(stack, F.array(part)))

    def walked(p: Column) -> Column:
        parts = F.split(F.substr(p, F.lit(2)), "/")
        # a path that ends with dots ends with a slash
        whole = F.aggregate(parts, F.array().cast("array<string>"), step)
        ends = F.when(F.element_at(parts, -1).rlike(r"(?i)\A(?:\.|%2e){1,2}\z"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(p.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"), F.concat(F.lit("/"), F.array_join(F.concat(whole, ends), "/"))).otherwise(p)

    return _bind(path, walked)


def _with_authority(scheme: Column, rest: Column) -> Column:
    """Struct of an address whose authority begins ``rest`` (backslashes before the query are slashes already); null if it is none."""

    def split(x: Column) -> Column:
        authority = F.regexp_extract(x["rest"], r"\A([^/?#]*)", 1)
        return F.struct(x["scheme"].alias("scheme"), x["rest"].alias("rest"), authority.alias("authority"), F.regexp_replace(authority, r"\A.*@", "").alias("server"))

    def parts(x: Column) -> Column:
        user = F.regexp_extract(x["authority"], r"\A(.*)@", 1)
        host = F.lower(percent_decoded(F.regexp_extract(x["server"], r"\A([^:]*)", 1)))
        port = F.regexp_replace(F.regexp_extract(x["server"], r":([0-9]*)\z", 1), r"\A0+(?=[0-9])", "")
        return F.struct(x["scheme"].alias("scheme"), x["server"].alias("server"), user.alias("user"), host.alias("host"), port.alias("port"), F.substr(x["rest"], F.length(x["authority"]) + 1).alias("rest"))

    def judged(x: Column) -> Column:
        usual = F.when(x["scheme"] == "http", DEFAULT_PORTS["http"]).otherwise(DEFAULT_PORTS["https"])
        port = x["port"]
        ok = x["server"].rlike(r"\A[^:]+(?::[0-9]*)?\z") & x["host"].rlike(rf"\A{_NAME}\z") & (F.length(port) < 6) & (F.coalesce(F.try_to_number(port, F.lit("99999")), F.lit(0)) < 65536)
        return F.when(F.coalesce(ok, F.lit(False)), _address(x["scheme"], F.nullif(F.regexp_replace(x["user"], r"\A:\z", ""), F.lit("")), x["host"], F.when(port == usual, "").otherwise(port), x["rest"]))

    return _bind(_bind(_bind(F.struct(scheme.alias("scheme"), rest.alias("rest")), split), parts), judged)


def _address(scheme: Column, user: Column, host: Column, port: Column, rest: Column) -> Column:
    whole = _bind(F.regexp_extract(rest, r"\A([^?#]*)", 1), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    query = F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1)
    return F.struct(scheme.alias("scheme"), user.alias("user"), host.alias("host"), port.alias("port"), _path_encoded(_walked(whole)).alias("path"), query.alias("query"))


def resolve(raw: Column, origin: str | None = None) -> Column:
    """struct(scheme, user, host, port, path, query) of an address, relative ones against ``origin``; null for what is no http or https address.

    user is null and port empty where there is none; query is as written, without its question mark; the fragment is dropped.
    """
    own = F.lit(None).cast("string") if origin is None else F.lit(origin.split(":")[0])

    def slashed(after: Column) -> Column:
        # a backslash is a slash before the query
        return _bind(F.regexp_extract(after, r"\A([^?#]*)", 1), lambda head: F.concat(F.replace(head, F.lit("\\"), F.lit("/")), F.substr(after, F.length(head) + 1)))

    def split(clean: Column) -> Column:
        scheme = F.lower(F.regexp_extract(clean, r"\A([A-Za-z][A-Za-z0-9+.-]*):", 1))
        return F.struct(scheme.alias("scheme"), _bind(F.regexp_replace(clean, r"\A[A-Za-z][A-Za-z0-9+.-]*:", ""), slashed).alias("rest"))

    def parsed(x: Column) -> Column:
        scheme, rest = x["scheme"], x["rest"]
        relative = (scheme == "") | (scheme == own) & ~rest.startswith("//")
        full = _with_authority(F.when(scheme == "", own).otherwise(scheme), F.regexp_replace(rest, r"\A/+", ""))
        if origin is None:
            return F.when(scheme.isin(*DEFAULT_PORTS), full)
        base = origin.split("://")[1]
        host, _, port = base.partition(":")
        port = "" if port == DEFAULT_PORTS.get(origin.split(":")[0]) else port
        inside = _address(own, F.lit(None).cast("string"), F.lit(host.lower()), F.lit(port), rest)
        return F.when(relative & ~rest.startswith("//"), inside).when((scheme == "") | scheme.isin(*DEFAULT_PORTS), full)

    clean = F.regexp_replace(F.regexp_replace(raw, r"\A[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]", "")
    return _bind(_bind(clean, split), parsed)


def form_without(query: Column, *names: str) -> Column:
    """A query as form data, without the fields of these names, encoded or not; empty if none is left, with its question mark otherwise."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def field(p: Column) -> Column:
        name = F.regexp_extract(p, r"\A([^=]*)", 1)
        return F.struct(percent_decoded(name, plus=True).alias("k"), percent_decoded(F.substr(p, F.length(name) + 2), plus=True).alias("v"))

    kept = F.filter(F.transform(pairs, field), lambda f: ~f["k"].isin(*names))
    shown = F.array_join(F.transform(kept, lambda f: F.concat(F.url_encode(f["k"]), F.lit("="), F.url_encode(f["v"]))), "&")
    return F.when(shown == "", "").otherwise(F.concat(F.lit("?"), shown))
