"""Image references in markdown, image acceptance, local names and rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.functions.text import bind, none_if_empty, strip

# ![alt](url): the alt text is the shortest possible and may span lines, the url ends at the first ")".
IMAGE = r"(?s)!\[.*?\]\([^)]+\)"
IMAGE_PARTS = r"(?s)^!\[(.*?)\]\(([^)]+)\)\z"

# Stored extension per content type, and the extensions trusted without one.
EXTENSION_OF_TYPE = {
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/avif": ".avif",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
}
KNOWN_EXTENSIONS = (*EXTENSION_OF_TYPE.values(), ".jpeg")
COLLISION_LETTERS = "abcdefghijklmnopqrstuvwxyz"

REF_TYPE = "struct<pos:int,alt:string,url:string,original_match:string>"


def image_matches(markdown: Column) -> Column:
    """All image matches, of any scheme, in order.

    Every "![" without a closer would make the regex scan on to the end of the text. No match can end after
    the last complete "](...)", so the text is cut there first; the result is the same, in linear time.
    """

    def matches(text: Column) -> Column:
        up_to_last_paren = F.left(text, F.length(text) - F.length(F.substring_index(text, ")", -1)))
        closed = F.regexp_extract(up_to_last_paren, r"(?s)^.*\]\([^)]+\)", 0)
        return F.regexp_extract_all(closed, F.lit(IMAGE), F.lit(0))

    return F.when(markdown.contains("]("), bind(markdown, matches)).otherwise(F.expr("cast(array() as array<string>)"))


def split_match(match: Column) -> tuple[Column, Column]:
    """(alt, url as written)"""
    return F.regexp_extract(match, IMAGE_PARTS, 1), F.regexp_extract(match, IMAGE_PARTS, 2)


def image_refs(markdown: Column) -> Column:
    """``array<struct<pos, alt, url, original_match>>`` of the http(s) references, in order, pos from 0."""

    def parts(match: Column) -> Column:
        alt, written = split_match(match)
        return F.struct(alt.alias("alt"), strip(written).alias("url"), match.alias("original_match"))

    remote = F.filter(F.transform(image_matches(markdown), parts), lambda ref: urls.is_web(ref["url"]))
    numbered = F.transform(
        remote,
        lambda ref, i: F.struct(
            i.alias("pos"), ref["alt"].alias("alt"), ref["url"].alias("url"), ref["original_match"].alias("original_match")
        ),
    )
    return numbered.cast(f"array<{REF_TYPE}>")


def unique_images(refs: Column) -> Column:
    """``array<struct<seq, url>>``: distinct urls numbered from 1 by first sight."""
    distinct = F.array_distinct(F.transform(refs, lambda ref: ref["url"]))
    return F.transform(distinct, lambda url, i: F.struct((i + 1).alias("seq"), url.alias("url")))


def mime_type(content_type: Column) -> Column:
    """Type without parameters, lower-cased; null when the header is missing or empty."""
    return F.lower(strip(F.split_part(none_if_empty(content_type), F.lit(";"), F.lit(1))))


def url_extension(url: Column) -> Column:
    """Lower-cased extension of the url as written (not decoded)."""
    return F.lower(urls.suffix(urls.last_segment(url)))


def rejection(content_type: Column, url: Column) -> Column:
    """Why a successful response is not stored, or null. Looks at headers only, never at a body."""
    mime = mime_type(content_type)
    untrusted = ~url_extension(url).isin(*KNOWN_EXTENSIONS)
    return (
        F.when(mime.isNull(), F.when(untrusted, "no_content_type"))
        .when(mime.startswith("image/"), F.lit(None))
        .when(mime == "application/octet-stream", F.when(untrusted, "unknown_octet_stream"))
        .otherwise("not_an_image")
    )


def name_parts(url: Column) -> Column:
    """``struct<base, ext>`` of the sanitised last path segment; ``ext`` keeps its dot and its case."""

    def parts(name: Column) -> Column:
        ext = urls.suffix(name)
        stem = F.left(name, F.length(name) - F.length(ext))
        base = F.btrim(F.regexp_replace(stem, "-{2,}", "-"), F.lit("-"))
        return F.struct(F.when(base == "", "image").otherwise(base).alias("base"), ext.alias("ext"))

    safe = F.regexp_replace(urls.decode(urls.last_segment(url)), "[^a-zA-Z0-9._-]", "-")
    return bind(safe, parts)


def extension_of_type(mime: Column) -> Column:
    cases = F.lit(None).cast("string")
    for kind, ext in EXTENSION_OF_TYPE.items():
        cases = F.when(mime == kind, ext).otherwise(cases)
    return cases


def extension(content_type: Column, url_ext: Column) -> Column:
    """Extension of the stored file: by content type, else the url's own, else ``.bin`` for an image."""
    mime = mime_type(content_type)
    lower = F.lower(url_ext)
    return F.coalesce(
        extension_of_type(mime),
        F.when(lower.isin(*KNOWN_EXTENSIONS), lower),
        none_if_empty(url_ext),
        F.when(mime.startswith("image/"), ".bin"),
        F.lit(""),
    )


def numbered_name(seq: Column, stem: Column, ext: Column) -> Column:
    return F.concat(F.format_string("%03d-", seq), stem, ext)


def local_names(images: Column) -> Column:
    """File names for ``array<struct<seq, base, ext, ...>>`` sorted by seq, in the same order.

    A repeated base+ext takes the first free of -a ... -z, then its own number. A given name counts as taken
    too, so the choice depends on all earlier ones; the fold runs only where base+ext repeats at all.
    """
    keys = F.transform(images, lambda image: F.concat(image["base"], image["ext"]))
    plain = F.transform(images, lambda image: numbered_name(image["seq"], image["base"], image["ext"]))

    def step(state: Column, image: Column) -> Column:
        base, ext = image["base"], image["ext"]
        options = F.transform(
            F.array(*map(F.lit, COLLISION_LETTERS)), lambda letter: F.concat(base, F.lit("-"), letter, ext)
        )
        free = F.try_element_at(F.array_except(options, state["keys"]), F.lit(1))
        by_number = F.concat(base, F.lit("-"), image["seq"].cast("string"), ext)
        own = F.concat(base, ext)
        key = F.when(F.array_contains(state["keys"], own), F.coalesce(free, by_number)).otherwise(own)
        return bind(
            key,
            lambda key: F.struct(
                F.concat(state["keys"], F.array(key)).alias("keys"),
                F.concat(state["names"], F.array(F.concat(F.format_string("%03d-", image["seq"]), key))).alias("names"),
            ),
        )

    start = F.expr("named_struct('keys', cast(array() as array<string>), 'names', cast(array() as array<string>))")
    folded = F.aggregate(images, start, step, lambda state: state["names"])
    return F.when(F.size(F.array_distinct(keys)) == F.size(images), plain).otherwise(folded)


def rewrite(markdown: Column, refs: Column, files: Column) -> Column:
    """Point every reference whose url is in ``files`` (url -> file name) at ``./images/``.

    Each reference text is replaced wherever it occurs, also inside code fences; one fold per distinct text.
    """
    changes = F.array_distinct(
        F.transform(
            F.filter(refs, lambda ref: F.try_element_at(files, ref["url"]).isNotNull()),
            lambda ref: F.struct(
                ref["original_match"].alias("old"),
                F.concat(
                    F.lit("!["), ref["alt"], F.lit("](./images/"), F.try_element_at(files, ref["url"]), F.lit(")")
                ).alias("new"),
            ),
        )
    )
    return F.aggregate(changes, markdown, lambda text, change: F.replace(text, change["old"], change["new"]))
