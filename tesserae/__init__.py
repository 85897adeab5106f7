"""tesserae: a PySpark-native engine for raster-as-relation analytics.

Images, palettes, regions, planar graphs, stamp features and painter-ordered
layers are plain DataFrames; every operator is keyed by image or document so
that many of them are processed at once.
"""

__version__ = "0.1.0"
