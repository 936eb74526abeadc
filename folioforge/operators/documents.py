"""Title, slug, front matter and document text. Row-local: no shuffle, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import urls
from folioforge.functions.dates import normalize_date
from folioforge.functions.frontmatter import front_matter
from folioforge.functions.images import image_refs, unique_images
from folioforge.functions.text import NON_ASCII, bind, first_heading, none_if_empty, slugify, transliterate
from folioforge.settings import Settings


def best_slug(text: Column, max_length: int) -> Column:
    """Slug of the text or of its transliteration, whichever is longer; null when both are empty."""

    def longer(pair: Column) -> Column:
        return F.when(F.length(pair["ascii"]) > F.length(pair["direct"]), pair["ascii"]).otherwise(pair["direct"])

    direct = slugify(text, max_length)
    pair = F.struct(direct.alias("direct"), slugify(transliterate(text), max_length).alias("ascii"))
    return none_if_empty(F.when(text.rlike(NON_ASCII), bind(pair, longer)).otherwise(direct))


def resolve_title_slug(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``slug`` and replace ``title`` by the title that goes with it.

    Order of choice: title, first heading, url path, run time stamp. Later sources are read only where the
    earlier ones give no slug; the steps are separate columns so that none is computed twice.
    """
    limit = settings.slug_max_length
    no_title = F.col("_title_slug").isNull()
    no_heading = no_title & F.col("_heading_slug").isNull()
    return (
        articles.withColumn("_title_slug", best_slug(F.col("title"), limit))
        .withColumn("_heading", F.when(no_title, first_heading(F.col("markdown"))))
        .withColumn("_heading_slug", best_slug(F.col("_heading"), limit))
        .withColumn("_path", F.when(no_heading, F.btrim(urls.path(F.col("source_url")), F.lit("/"))))
        .withColumn("_path_slug", none_if_empty(slugify(F.col("_path"), limit)))
        .withColumns(
            {
                "slug": F.coalesce(
                    "_title_slug", "_heading_slug", "_path_slug", F.lit(f"article-{settings.run_stamp}")
                ),
                "title": F.when(~no_title, F.col("title"))
                .when(F.col("_heading_slug").isNotNull(), F.col("_heading"))
                .when(
                    F.col("_path_slug").isNotNull(),
                    F.concat(urls.authority(F.col("source_url")), F.lit("/"), F.col("_path")),
                )
                .otherwise(F.col("source_url")),
            }
        )
        .drop("_title_slug", "_heading", "_heading_slug", "_path", "_path_slug")
    )


def add_front_matter(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``front_matter``. Author and description are left out when null, the date also when empty."""
    return articles.withColumn(
        "front_matter",
        front_matter(
            {
                "title": F.coalesce("title", F.lit("")),
                "author": F.col("author"),
                "date": normalize_date(none_if_empty(F.col("date"))),
                "source_url": F.col("source_url"),
                "description": F.col("description"),
                "downloaded": F.lit(settings.downloaded_at),
                "tool": F.lit(settings.tool),
            }
        ),
    )


def assemble(front: Column, markdown: Column) -> Column:
    return F.concat(front, F.lit("\n"), markdown)


def assemble_documents(articles: DataFrame) -> DataFrame:
    return articles.withColumn("content", assemble(F.col("front_matter"), F.col("markdown")))


def prepare_articles(articles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Everything about an article that needs no other row: slug, title, front matter, image references."""
    described = add_front_matter(resolve_title_slug(articles, settings), settings)
    return described.withColumn("refs", image_refs(F.col("markdown"))).select(
        "article_id",
        "source_url",
        "slug",
        "title",
        "front_matter",
        "markdown",
        "refs",
        unique_images(F.col("refs")).alias("images"),
    )
