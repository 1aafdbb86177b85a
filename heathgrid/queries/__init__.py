"""Registered queries of the terrain and field-log operators, and their SQL."""

from __future__ import annotations

from heathgrid.queries import field, geo, raster, source, stream


def queries():
    return raster.QUERIES | field.QUERIES | geo.QUERIES | source.QUERIES | stream.QUERIES


def oracle_sql():
    return raster.ORACLE | field.ORACLE | geo.ORACLE | source.ORACLE | stream.ORACLE
