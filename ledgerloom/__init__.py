"""Statement analytics on Spark: files -> typed transactions -> categories -> footprints."""

__version__ = "0.1.0"
