import re
import sys
import unicodedata

from folioforge.functions import text


def test_strip_knows_the_same_white_space_as_python(apply):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
    values = [f"{b}a{b}b{b}" for b in blanks] + ["", "  ", "plain", "​kept​"]
    assert apply(text.strip, values) == [v.strip() for v in values]
    assert apply(text.has_text, [*values, None]) == [bool(v.strip()) for v in values] + [False]


def test_slugify(apply):
    cases = {
        "My Article! (2026)": "my-article-2026",
        "  Hello_World__again  ": "hello-world-again",
        "a - b -- c": "a-b-c",
        "---": "",
        "日本語": "",
        "Café déjà vu": "caf-dj-vu",
        "tab\tnew\nline nbsp em": "tab-new-line-nbsp-em",
        "x" * 80: "x" * 80,
        "x" * 81: "x" * 80,
        "ab " * 40: "-".join(["ab"] * 26),
        # Character 81 is a hyphen, yet the cut goes back to the one before.
        "a" * 40 + " " + "b" * 39 + " c": "a" * 40,
        # The hyphen is the 80th character.
        "a" * 79 + " bcd": "a" * 79,
        "a " + "b" * 100: "a",
    }
    assert apply(text.slugify, list(cases)) == list(cases.values())


def test_transliterate_matches_unicode_decomposition(apply):
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    lines = ["".join(every[i : i + 64]) for i in range(0, len(every), 64)]
    lines += ["Café déjà vu", "café", "ﬁne ½ … ™ ① Ａ", "𝐁𝐨𝐥𝐝", "plain", "", "🄐x"]
    expected = [unicodedata.normalize("NFKD", line).encode("ascii", "ignore").decode() for line in lines]
    assert apply(text.transliterate, lines) == expected


def test_first_heading(apply):
    values = [
        "# One\n\n# Two",
        "intro\n#   Spaced  \nmore",
        "#\n\nFoo",
        "## Not this\n# This",
        "#NoBlank\n",
        "```\n# in a fence\n```",
        "# a\rb\n",
        "# x y\nz",
        "# nbsp",
        "#  \n",
        "no heading",
        "",
    ]
    expected = []
    for value in values:
        found = re.search(r"^#\s+(.+)$", value, re.MULTILINE)
        expected.append((found.group(1).strip() or None) if found else None)
    assert apply(text.first_heading, values) == expected


def test_redaction_replaces_tokens_and_headers(apply):
    values = {
        "call with Bearer abc.def-1 now": "call with [REDACTED] now",
        "Authorization: Basic xyz": "[REDACTED] xyz",
        "Authorization: Bearer tok end": "[REDACTED] end",
        "Bearer\n tok": "[REDACTED]",
        "bearer tok": "bearer tok",
        "Authorization:key": "[REDACTED]",
        "nothing": "nothing",
    }
    # "Authorization: Bearer tok" loses the token first and then the header with what stands after it.
    assert apply(text.redact_secrets, list(values)) == list(values.values())
