"""URL parts, host safety and URL-derived names, by regular expression.

``parse_url`` raises on a blank inside a url and ``try_parse_url`` gives null for the whole url, while crawl
data is full of such urls; the expressions below split any text.
"""

from __future__ import annotations

import ipaddress
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import bind

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DOTTED_QUAD = rf"{OCTET}(?:\.{OCTET}){{3}}"

# Special-purpose address registry, the first network that holds an address decides.
NETWORKS = (
    ("loopback", ("127.0.0.0/8", "::1/128")),
    (
        "public",
        ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
         "2001:20::/28", "2001:30::/28"),
    ),
    (
        "private",
        ("0.0.0.0/8", "10.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
         "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "::/128",
         "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10"),
    ),
)
# An IPv4 address is written as the IPv6 address it is mapped to, so both spellings of it meet the same rules.
MAPPED = "0" * 20 + "ffff"


def clean(url: Column) -> Column:
    """Drop what URL readers ignore: leading control characters and blanks, and tabs or line ends anywhere."""
    return F.regexp_replace(url, r"^[\x00-\x20]+|[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), rf"^({SCHEME}):", 1))


def is_web(url: Column) -> Column:
    return F.coalesce(clean(url).rlike("^(?i:https?):"), F.lit(False))


def authority(url: Column) -> Column:
    return F.regexp_extract(clean(url), rf"^(?:{SCHEME}:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without query and fragment, and without ``;parameters`` of the last segment."""
    whole = F.regexp_extract(clean(url), rf"^(?:{SCHEME}:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(whole, r";[^/]*\z", "")


def _host_of_authority(netloc: Column) -> Column:
    bracketed = F.regexp_extract(netloc, r"\[([^\]]*)[^@]*\z", 1)
    named = F.regexp_extract(netloc, r"([^@:]*)(?::[^@]*)?\z", 1)
    return F.lower(F.when(netloc.rlike(r"\[[^@]*\z"), bracketed).otherwise(named))


def host(url: Column) -> Column:
    return _host_of_authority(authority(url))


def _v4_digits(address: Column) -> Column:
    octets = [F.split_part(address, F.lit("."), F.lit(i)).cast("int") for i in (1, 2, 3, 4)]
    return F.format_string("%02x%02x%02x%02x", *octets)


def _v6_digits(address: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 text form, or null when it is not one."""

    def without_dotted_quad(text: Column) -> Column:
        quad = F.regexp_extract(text, rf":({DOTTED_QUAD})\z", 1)
        groups = F.regexp_replace(_v4_digits(quad), "^(.{4})", "$1:")
        return F.when(quad == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9.]+\z", ""), groups))

    def spell_out(text: Column) -> Column:
        # "::" stands for as many zero groups as are missing, and may occur once.
        halves = F.transform(F.split(text, "::"), lambda half: F.filter(F.split(half, ":"), lambda g: g != ""))
        count = F.size(F.flatten(halves))
        full = F.transform(halves, lambda half: F.array_join(F.transform(half, lambda g: F.lpad(g, 4, "0")), ""))
        well_formed = (
            F.forall(F.flatten(halves), lambda g: g.rlike(r"^[0-9a-f]{1,4}\z"))
            & ~text.rlike(r":::|^:[^:]|[^:]:\z")
            & (((F.size(halves) == 1) & (count == 8)) | ((F.size(halves) == 2) & (count <= 7)))
        )
        zeros = F.repeat(F.lit("0000"), F.greatest(F.lit(8) - count, F.lit(0)))
        return F.when(
            well_formed,
            F.when(F.size(halves) == 1, full[0]).otherwise(F.concat(full[0], zeros, F.try_element_at(full, F.lit(2)))),
        )

    return bind(bind(F.regexp_replace(address, r"%[^%]+\z", ""), without_dotted_quad), spell_out)


@lru_cache(maxsize=1)
def _network_ranges() -> str:
    """SQL literal of the networks: array of (kind, first, last) in hexadecimal digits."""
    rows = []
    for kind, networks in NETWORKS:
        for network in map(ipaddress.ip_network, networks):
            prefix, width = (MAPPED, 8) if network.version == 4 else ("", 32)
            first, last = (f"{prefix}{int(end):0{width}x}" for end in (network[0], network[-1]))
            rows.append(f"struct('{kind}' as kind, '{first}' as first, '{last}' as last)")
    return f"array({', '.join(rows)})"


def _address_kind(digits: Column) -> Column:
    inside = F.filter(F.expr(_network_ranges()), lambda network: digits.between(network["first"], network["last"]))
    return F.coalesce(F.try_element_at(inside, F.lit(1))["kind"], F.lit("public"))


def host_kind(url: Column) -> Column:
    """``malformed``, ``missing``, ``localhost``, ``loopback``, ``private`` or ``public``.

    Only literal addresses are judged; names are never resolved. The IPv6 branch is evaluated for bracketed
    hosts alone.
    """

    def judge(netloc: Column) -> Column:
        name = _host_of_authority(netloc)
        opened, closed = netloc.contains("["), netloc.contains("]")
        v4 = F.concat(F.lit(MAPPED), _v4_digits(name))
        v6 = bind(_v6_digits(name), lambda digits: F.when(digits.isNull(), "malformed").otherwise(_address_kind(digits)))
        return (
            F.when(opened != closed, "malformed")
            .when(opened, F.when(name.rlike(r"^v[0-9a-f]+\..+"), "public").otherwise(v6))
            .when(name == "", "missing")
            .when(name == "localhost", "localhost")
            .when(name.rlike(rf"^{DOTTED_QUAD}\z"), bind(v4, _address_kind))
            .otherwise("public")
        )

    return bind(authority(url), judge)


def is_private_host(url: Column) -> Column:
    """True for localhost, loopback, private and link-local hosts (link-local networks are private ones)."""
    return F.coalesce(host_kind(url).isin("localhost", "loopback", "private"), F.lit(False))


def url_problem(url: Column) -> Column:
    """Why a source url is refused, or null when it is acceptable."""
    kind = host_kind(url)
    # Texts shown to the user.
    return (
        F.when(url.isNull() | ~scheme(url).isin("http", "https"), "URL must start with http:// or https://")
        .when(kind == "malformed", "URL has a malformed host")
        .when(kind == "missing", "URL must include a non-empty host")
        .when(kind == "localhost", "Localhost URLs are not allowed")
        .when(kind == "loopback", "Loopback IP URLs are not allowed")
        .when(kind == "private", "Private IP URLs are not allowed")
    )


def last_segment(url: Column) -> Column:
    return F.regexp_extract(path(url), r"[^/]*\z", 0)


def suffix(name: Column) -> Column:
    """From the last dot on, or the empty string."""
    return F.regexp_extract(name, r"\.[^.]*\z", 0)


def decode(text: Column) -> Column:
    """Percent-decode; ``+`` and stray percent signs stay as they are."""
    guarded = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(text.contains("%"), F.try_url_decode(guarded)).otherwise(text)


def resolve(base: Column, reference: Column) -> Column:
    """Absolute form of ``reference`` as seen from ``base``."""
    ref, base = clean(reference), clean(base)
    origin = F.regexp_extract(base, rf"^{SCHEME}://[^/?#]*", 0)
    base_path = F.regexp_extract(base, rf"^{SCHEME}://[^/?#]*([^?#]*)", 1)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_extract(base_path, r"^.*/", 0))
    return (
        F.when(ref.rlike(rf"^{SCHEME}:"), ref)
        .when(ref == "", base)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(origin, base_path, ref))
        .when(ref.startswith("/"), F.concat(origin, _without_dots(ref)))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, ref))))
    )


def _without_dots(path_and_rest: Column) -> Column:
    """Remove ``.`` and ``..`` segments from the path part."""

    def walk(text: Column) -> Column:
        path_part = F.regexp_extract(text, "^[^?#]*", 0)
        segments = F.split(F.substring(path_part, F.lit(2), F.length(path_part)), "/")
        ends_in_folder = path_part.rlike(r"/\.{1,2}\z")
        kept = F.aggregate(
            segments,
            F.expr("cast(array() as array<string>)"),
            lambda done, part: F.when(part == ".", done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part))),
        )
        rest = F.substring(text, F.length(path_part) + 1, F.length(text))
        return F.concat(
            F.lit("/"),
            F.array_join(kept, "/"),
            F.when(ends_in_folder & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")),
            rest,
        )

    return F.when(path_and_rest.rlike(r"/\.{1,2}(?:/|[?#]|\z)"), bind(path_and_rest, walk)).otherwise(path_and_rest)
