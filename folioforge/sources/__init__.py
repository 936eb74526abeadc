"""Providers and readers: landed tables in, tables of ``folioforge.schemas`` out."""

from folioforge.sources.html_pages import read_html_pages
from folioforge.sources.image_log import read_image_bodies, read_image_responses
from folioforge.sources.reader_responses import read_reader_responses

__all__ = ["read_html_pages", "read_image_bodies", "read_image_responses", "read_reader_responses"]
