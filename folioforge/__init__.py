"""Article-corpus building on Spark: landed crawl tables in, publishable markdown documents out."""

from folioforge.settings import Settings

__version__ = "0.1.0"

__all__ = ["Settings", "__version__"]
