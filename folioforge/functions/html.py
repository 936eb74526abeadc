"""HTML page to markdown, in passes over the whole page.

Every pass is about linear in the length of the page. Elements are removed from the part of the page that ends with their
last closing tag, so that each opening tag met there finds a closing one; a tag's pattern ends at the next ``<`` outside
quotes; and what is replaced by something that depends on it is cut out, changed and put back together.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import metadata, urls
from folioforge.functions.text import bind, none_if_empty, strip

# The rest of a tag after its name: quoted values may hold anything, the rest no angle bracket.
REST = r"""[^<>"']*+(?:"[^"]*+"[^<>"']*+|'[^']*+'[^<>"']*+)*+>"""
# A tag whose quotes do not match ends at the next angle bracket.
ANY_REST = rf"(?:{REST}|[^<>]*+>)"

# Elements that hold no text of the page: (opening tag, closing tag).
UNSEEN = (("<!--", "-->"), *((rf"<{tag}\b", rf"</{tag}\s*+>") for tag in ("script", "style", "noscript", "template")))
BOILERPLATE = tuple((rf"<{tag}\b", rf"</{tag}\s*+>") for tag in ("nav", "footer", "aside", "form"))
ADVERTISEMENT = r"""(?i)<div\b[^<>]*?\sclass\s*=\s*["']?(?:[^"'<>]*\s)?(?:ad|ads|advert|advertisement)(?=[\s"'>])[^<>]*+>"""
DIVISION = rf"(?i)<div(?=[\s/>]){ANY_REST}|</div\s*+>"
LIST_TAG = rf"(?i)<(?:ul|ol|li)(?=[\s/>]){ANY_REST}|</(?:ul|ol)\s*+>"
DEEPEST = 16
NO_TEXT = r"(?i)\A(?:\s|</li\s*+>)*+\z"
PREFORMATTED = rf"(?i)<pre(?=[\s>]){ANY_REST}"
# States of a fold are gathered in blocks of about so many bytes, so that adding one copies no more than a block.
BLOCK = 512
# Stand for the line ends and blanks of preformatted text until white space has been dealt with.
LINE, BLANK = "\x02", "\x03"

IMAGE = rf"(?i)<img\b{ANY_REST}"
LINK = rf"(?i)<a\b{ANY_REST}[^<]*+</a\s*+>"
BOLD = ((r"(?i)<(?:b|strong)(?:\s[^<>]*+)?>([^<]++)</(?:b|strong)\s*>", "**$1**"),)
ITALIC = ((r"(?i)<(?:i|em)(?:\s[^<>]*+)?>([^<]++)</(?:i|em)\s*>", "*$1*"),)
CODE = ((r"(?i)<code(?:\s[^<>]*+)?>([^<]++)</code\s*>", "`$1`"),)
SUBHEADINGS = tuple((rf"(?i)<h{level}(?:\s[^<>]*+)?>", f"\n\n{'#' * level} ") for level in range(2, 7))
BLOCKS = (
    (r"(?i)<h1(?:\s[^<>]*+)?>", "\n\n# "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)<(?:dt|dd)(?:\s[^<>]*+)?>", "\n"),
    (r"(?i)</t[dh]\s*>", " "),
    (
        r"(?i)<(?:/?(?:p|div|section|article|main|ul|ol|dl|blockquote|pre|table|tr|figure|header)(?:\s[^<>]*+)?"
        r"|/h[1-6]\s*)>",
        "\n\n",
    ),
    (rf"<[A-Za-z/!?]{ANY_REST}", ""),
)
REFERENCE = "&(?:#[0-9]{1,7}+|#[xX][0-9A-Fa-f]{1,6}+|[A-Za-z][A-Za-z0-9]{1,31}+);"


def replace_each(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """``text`` with every match of ``pattern`` replaced by what ``change`` makes of it."""
    changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    pieces = F.zip_with(F.split(text, pattern, -1), F.concat(changed, F.array(F.lit(""))), lambda kept, new: F.concat(kept, new))
    return F.array_join(pieces, "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted either way or not at all; empty if it is missing."""
    pattern = rf"""(?i)\s(?:{name})\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, group) for group in (1, 2, 3)])


def _named() -> Column:
    """All named character references that end with a semicolon, from the standard library, as a map. The unbreakable
    blank counts as a blank."""
    names = {name[:-1]: character for name, character in html5.items() if name.endswith(";")} | {"nbsp": " "}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _character(reference: Column) -> Column:
    number = F.regexp_extract(reference, "[0-9A-Fa-f]+", 0)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(number, 16, 10)).otherwise(number).cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    name = F.substring(reference, F.lit(2), F.length(reference) - 2)
    named = F.when(reference == "&amp;", "&").otherwise(F.try_element_at(_named(), name))
    return F.coalesce(F.when(reference.startswith("&#"), F.when(valid, char)).otherwise(named), reference)


def unescape(text: Column) -> Column:
    """Character references to their characters; unknown ones stay."""
    # Most texts hold ampersands and nothing else.
    some = F.when(text.rlike("&(?!amp;)[#a-zA-Z]"), replace_each(text, REFERENCE, _character))
    return F.when(text.contains("&"), some.otherwise(F.replace(text, F.lit("&amp;"), F.lit("&")))).otherwise(text)


def _up_to_last(text: Column, closing: str) -> Column:
    """The part of the text that ends with the last match of ``closing``; empty if there is none."""
    return F.regexp_extract(text, rf"(?is)\A.*{closing}", 0)


def without(text: Column, opening: str, closing: str) -> Column:
    """Each stretch from ``opening`` to the next ``closing`` replaced by a blank; what is never closed stays."""

    def removed(parts: Column) -> Column:
        kept = F.regexp_replace(parts["head"], rf"(?is){opening}.*?{closing}", " ")
        return F.concat(kept, F.substring(parts["text"], F.length(parts["head"]) + 1, F.length(parts["text"])))

    parts = F.struct(text.alias("text"), _up_to_last(text, closing).alias("head"))
    return F.when(text.rlike(f"(?i){opening}"), bind(parts, removed)).otherwise(text)


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles, all white space outside ``pre`` as single blanks."""
    for opening, closing in UNSEEN:
        html = _bound_without(html, opening, closing)
    return F.regexp_replace(_preformatted(html), r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")


def _bound_without(text: Column, opening: str, closing: str) -> Column:
    return bind(text, lambda bound: without(bound, opening, closing))


def running(items: str, step: str) -> str:
    """SQL of the states after each item of an array, from 0 on; ``step`` makes the next of ``now`` and ``item``. One fold
    over the array. (Folds are written as SQL: built call by call they take longer to plan than to run.)"""
    grown, fits = "concat(s.last, now, ',')", f"octet_length(s.last) < {BLOCK}"
    added = f"named_struct('now', now, 'full', if({fits}, s.full, concat(s.full, {grown})), 'last', if({fits}, {grown}, ''))"
    return f"""aggregate({items}, named_struct('now', 0, 'full', '', 'last', ''),
      (s, item) -> {_let("now", step.replace("now", "s.now"), added)},
      s -> transform(filter(split(concat(s.full, s.last), ','), x -> x != ''), x -> int(x)))"""


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value``, evaluated once, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_tags(text: str, pattern: str, shown: str) -> str:
    """SQL of a text put together again: its first piece, then ``shown``, an array made of its ``tags`` and of the
    ``pieces`` before, between and after them."""
    tags, pieces = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"split({text}, {_quoted(pattern)}, -1)"
    return _let("tags", tags, _let("pieces", pieces, f"concat(pieces[0], array_join({shown}, ''))"))


def without_nested(text: str, tag: str, unwanted: str) -> Column:
    """The text (a column's name) without the elements whose opening tag matches ``unwanted``, with all that is nested in
    them; a blank takes their place. ``tag`` matches the opening and closing tags of the kind. An element ends where as
    many tags have been closed as opened; one that is never closed stays, and so does a closing tag of nothing."""
    kinds = f"transform(tags, t -> case when startswith(t, '</') then 'closing' when t rlike {_quoted(unwanted)} then 'unwanted' else 'opening' end)"
    # From the end: the closing tags that no opening tag has taken yet.
    left = f"reverse({running('reverse(kinds)', "if(item = 'closing', now + 1, greatest(now - 1, 0))")})"
    closed = "transform(kinds, (k, i) -> if(k = 'closing' or get(open, i + 1) > 0, k, 'unclosed'))"
    deeper = "case when item = 'unwanted' or item = 'opening' and now > 0 then now + 1 when item = 'closing' then greatest(now - 1, 0) else now end"
    kept = "transform(tags, (t, i) -> case when depths[i] > 0 then '' when get(depths, i - 1) > 0 then concat(' ', pieces[i + 1]) else concat(t, pieces[i + 1]) end)"
    shown = _let("kinds", kinds, _let("open", left, _let("closed", closed, _let("depths", running("closed", deeper), kept))))
    return F.expr(f"if({text} rlike {_quoted(unwanted)}, {_by_tags(text, tag, shown)}, {text})")


def _listed(text: str, page_url: str) -> Column:
    """Items of lists as lines, those of nested lists indented by two blanks for each list around theirs, DEEPEST times
    at most, so that a page of unclosed lists does not grow with the square of its length."""
    deeper = "case when startswith(item, '</') then greatest(now - 1, 0) when item rlike '(?i)^<li' then now else now + 1 end"
    line = f"concat('\\n', repeat('{BLANK}', 2 * greatest(least(depths[i] - 1, {DEEPEST}), 0)))"
    shown = f"""case when t rlike '(?i)^<li' then concat({line}, '- ')
      when startswith(t, '</') and depths[i] > 0 then if(pieces[i + 1] rlike {_quoted(NO_TEXT)}, '', {line})
      when not startswith(t, '</') and depths[i] > 1 then '' else t end"""
    return F.expr(_by_tags(text, LIST_TAG, _let("depths", running("tags", deeper), f"transform(tags, (t, i) -> concat({shown}, pieces[i + 1]))")))


def _preformatted(html: Column) -> Column:
    """Line ends and blanks within ``pre`` elements replaced by signs that no later step touches."""

    def marked(text: Column) -> Column:
        def change(element: Column) -> Column:
            return F.translate(F.regexp_replace(element, "\r\n?", "\n"), "\n ", LINE + BLANK)

        def of_element(element: Column) -> Column:
            opening = F.regexp_extract(element, rf"\A{PREFORMATTED}", 0)
            return F.concat(opening, change(F.substring(element, F.length(opening) + 1, F.length(element))))

        def of_parts(parts: Column) -> Column:
            tail = F.substring(parts["text"], F.length(parts["head"]) + 1, F.length(parts["text"]))
            return F.concat(replace_each(parts["head"], rf"(?s){PREFORMATTED}.*?(?=</(?i:pre))", of_element), tail)

        return bind(F.struct(text.alias("text"), _up_to_last(text, r"</pre\s*>").alias("head")), of_parts)

    return bind(html, lambda text: F.when(text.rlike(r"(?i)<pre[\s>]"), marked(text)).otherwise(text))


def main_part(page: Column) -> Column:
    """What the article elements hold, from the first one's opening to the last one's closing tag; else the main
    element, else the body, else everything."""

    def inside(tag: str) -> Column:
        closed = bind(_up_to_last(page, rf"</{tag}\s*>"), lambda text: F.regexp_extract(text, r"(?is)\A(.*)</", 1))
        opened = rf"(?i)<{tag}(?:\s[^<>]*+)?>"
        return bind(F.split(closed, opened, 2), lambda parts: F.when(F.size(parts) == 2, F.get(parts, F.lit(1))))

    def holds(tag: str) -> Column:
        return page.rlike(rf"(?i)</{tag}\s*>")

    parts = [none_if_empty(F.when(holds(tag), inside(tag))) for tag in ("article", "main", "body")]
    return F.coalesce(*parts, page)


def head(page: Column) -> Column:
    """What stands before the body element; the whole page if none is found."""
    return F.get(F.split(page, r"(?i)<body\b", 2), F.lit(0))


def page_title(page: Column) -> Column:
    after = F.get(F.split(page, r"(?i)<title(?:\s[^<>]*+)?>", 2), F.lit(1))
    title = bind(F.split(after, r"(?i)</title\s*+>", 2), lambda parts: F.when(F.size(parts) == 2, F.get(parts, F.lit(0))))
    return none_if_empty(bind(title, lambda text: strip(unescape(text))))


def _target(page_url: Column, reference: Column) -> Column:
    """Absolute address; parentheses, which would end it in markdown, are encoded."""
    absolute = urls.resolve(page_url, unescape(reference))
    return F.replace(F.replace(absolute, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def _image(page_url: Column) -> Callable[[Column], Column]:
    def change(tag: Column) -> Column:
        source = attribute(tag, "src")
        shown = F.concat(F.lit("!["), attribute(tag, "alt"), F.lit("]("), _target(page_url, source), F.lit(")"))
        # An image without a source would be the page itself.
        return F.when(strip(source) == "", "").otherwise(F.coalesce(shown, F.lit("")))

    return change


def _link(page_url: Column) -> Callable[[Column], Column]:
    def change(element: Column) -> Column:
        tag = F.regexp_extract(element, rf"(?i)\A<a\b{ANY_REST}", 0)
        label = F.regexp_extract(F.substring(element, F.length(tag) + 1, F.length(element)), r"(?is)\A[^<]*", 0)
        shown = F.concat(F.lit("["), label, F.lit("]("), _target(page_url, attribute(tag, "href")), F.lit(")"))
        return F.when(tag.rlike(r"(?i)\shref\s*="), F.coalesce(shown, element)).otherwise(element)

    return change


def _replace_all(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _without_boilerplate(name: str, page_url: str) -> Column:
    text = F.col(name)
    for opening, closing in BOILERPLATE:
        text = _bound_without(text, opening, closing)
    return text


# (texts of which one must occur in the lower-cased page, rules or a function of the names of text and url), in order of application. Looking for a literal
# is far cheaper than a pass of a regular expression.
TAG_STEPS = (
    (("<nav", "<footer", "<aside", "<form"), _without_boilerplate),
    (("<div",), lambda text, page_url: without_nested(text, DIVISION, ADVERTISEMENT)),
    (("<img",), lambda text, page_url: replace_each(F.col(text), IMAGE, _image(F.col(page_url)))),
    (("<a ", "<a\t", "<a\n"), lambda text, page_url: replace_each(F.col(text), LINK, _link(F.col(page_url)))),
    (("</b", "</strong"), BOLD),
    (("</i", "</em"), ITALIC),
    (("</code",), CODE),
    (("<h2", "<h3", "<h4", "<h5", "<h6"), SUBHEADINGS),
    (("<li",), _listed),
    (("<",), BLOCKS),
)
# The same, looked for in the text as it is by then.
BLANK_STEPS = (
    ((" \n", "\n "), ((" *\n *", "\n"),)),
    (("  ",), ((" {2,}", " "),)),
    (("\n\n\n",), (("\n{3,}", "\n\n"),)),
)


def with_markdown(pages: DataFrame, part: str, page_url: str, name: str) -> DataFrame:
    """Add ``name``, the markdown of the html in ``part``.

    Each step is a column of its own: a step mentions its input more than once, and a nested expression
    would compute everything below it as many times.
    """
    pages = pages.withColumn("_low", F.lower(part))
    previous, steps = part, []
    for number, (literals, rules) in enumerate((*TAG_STEPS, *BLANK_STEPS)):
        text, searched = F.col(previous), F.col("_low" if number < len(TAG_STEPS) else previous)
        occurs = reduce(or_, [searched.contains(literal) for literal in literals])
        done = rules(previous, page_url) if callable(rules) else _replace_all(text, rules)
        previous = f"_step{number}"
        steps.append(previous)
        pages = pages.withColumn(previous, F.when(occurs, done).otherwise(text))
    pages = pages.withColumn("_plain", unescape(F.col(previous)))
    spaced = F.translate("_plain", LINE + BLANK, "\n ")
    return pages.withColumn(name, strip(spaced)).drop("_low", "_plain", *steps)


def meta_tags(page: Column) -> Column:
    """``array<struct<name, content>>`` of the meta elements that have both."""

    def parts(tag: Column) -> Column:
        name = attribute(tag, "name|property")
        content = bind(attribute(tag, "content"), unescape)
        return F.struct(name.alias("name"), content.alias("content"))

    tags = F.transform(F.regexp_extract_all(page, F.lit(rf"(?i)<meta\s{ANY_REST}"), F.lit(0)), parts)
    return F.filter(tags, lambda tag: tag["name"] != "")


def meta_text(tags: Column, keys: tuple[str, ...]) -> Column:
    def content(key: str) -> Column:
        return F.try_element_at(F.filter(tags, lambda tag: tag["name"] == key), F.lit(1))["content"]

    return metadata.first_text([content(key) for key in keys])
