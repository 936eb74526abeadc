from folioforge import Settings
from folioforge.operators import documents
from folioforge.schemas import ARTICLE

SETTINGS = Settings(downloaded_at="2026-03-15T10:00:00Z")


def articles(spark, *rows):
    """rows: (title, author, date, description, source_url, markdown)"""
    data = [(i, url, title, author, date, description, md) for i, (title, author, date, description, url, md) in enumerate(rows)]
    return spark.createDataFrame(data, ARTICLE)


def resolved(spark, *cases):
    rows = [(title, None, None, None, url, md) for title, url, md in cases]
    found = documents.resolve_title_slug(articles(spark, *rows), SETTINGS).orderBy("article_id").collect()
    return [(r.slug, r.title) for r in found]


def test_title_fallbacks(spark):
    assert resolved(
        spark,
        ("My Article! (2026)", "https://example.com/article", "# My Article\n\nContent"),
        (None, "https://example.com/article", "# Heading From Markdown\n\nBody text."),
        (None, "https://example.com/some-article", "No heading."),
        (None, "https://example.com/", "No heading."),
        (None, "https://Example.com:80/a/b_c/", "text"),
        ("日本語", "https://example.com/x", "# Plan B\n"),
        ("日本語", "https://example.com/x", "# 日本\n"),
        ("   ", "https://example.com/日本", "text"),
        ("Café déjà vu", "https://example.com/x", ""),
        ("", "https://example.com/x", "# Ünï\n"),
    ) == [
        ("my-article-2026", "My Article! (2026)"),
        ("heading-from-markdown", "Heading From Markdown"),
        ("some-article", "example.com/some-article"),
        ("article-20260315-100000", "https://example.com/"),
        ("ab-c", "Example.com:80/a/b_c"),
        ("plan-b", "Plan B"),
        ("x", "example.com/x"),
        ("article-20260315-100000", "https://example.com/日本"),
        ("cafe-deja-vu", "Café déjà vu"),
        ("uni", "Ünï"),
    ]


def front(spark, *rows):
    titled = documents.resolve_title_slug(articles(spark, *rows), SETTINGS)
    ready = documents.assemble_documents(documents.add_front_matter(titled, SETTINGS))
    return [r.content for r in ready.orderBy("article_id").collect()]


def test_front_matter_order_omission_and_escapes(spark):
    url = "https://example.com/article"
    full, bare, blank = front(
        spark,
        ('Say "hi"\\', "Jane\tDoe", "2026-01-15T10:00:00Z", "two\nlines\r", url, "Body"),
        ("Test Title", None, "Wed, 11 Mar 2026 19:06:45 GMT", None, url, "Body"),
        ("T", "", "", "\0", url, "Body"),
    )
    assert full == (
        '---\ntitle: "Say \\"hi\\"\\\\"\nauthor: "Jane\\tDoe"\ndate: "2026-01-15"\nsource_url: "https://example.com/article"\n'
        'description: "two\\nlines\\r"\ndownloaded: "2026-03-15T10:00:00Z"\ntool: "folioforge v0.1.0"\n---\n\nBody'
    )
    assert bare == (
        '---\ntitle: "Test Title"\ndate: "2026-03-11"\nsource_url: "https://example.com/article"\n'
        'downloaded: "2026-03-15T10:00:00Z"\ntool: "folioforge v0.1.0"\n---\n\nBody'
    )
    assert 'author: ""' in blank and "date" not in blank and 'description: "\\0"' in blank
