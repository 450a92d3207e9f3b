"""Raster-segmentation analytics as Spark jobs over long tables of cells, patches, objects and tiles."""
