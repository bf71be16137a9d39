"""Lines as a GeoPackage, written row by row with sqlite3; Parquet with WKT otherwise."""

from __future__ import annotations

import os
import sqlite3
import struct

from pyspark.sql import DataFrame


def wkb(path) -> bytes:
    """A line string with the GeoPackage header, little-endian."""
    body = struct.pack("<BII", 1, 2, len(path)) + b"".join(struct.pack("<dd", p.x, p.y) for p in path)
    return b"GP\0\x01" + struct.pack("<i", 0) + body


def write_lines(lines: DataFrame, path: str, crs: str | None = None) -> None:
    """Columns beside path and wkt become attributes."""
    if not path.lower().endswith(".gpkg"):
        return lines.write.mode("overwrite").parquet(path)
    names = [c for c in lines.columns if c not in ("path", "wkt")]
    code = int(crs.split(":")[1]) if crs and crs.split(":")[-1].isdigit() else -1
    if os.path.exists(path):
        os.remove(path)
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", {-1: ("undefined cartesian", -1, "NONE", -1), 0: ("undefined geographic", 0, "NONE", 0), code: (crs or "undefined", code, "EPSG" if code > 0 else "NONE", code)}.values())
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT DEFAULT '', last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT)")
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES ('lines', 'features', 'lines', ?)", (code,))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('lines', 'geometry', 'LINESTRING', ?, 0, 0)", (code,))
        db.execute(f"CREATE TABLE lines (fid INTEGER PRIMARY KEY, geometry BLOB{''.join(f', {n} DOUBLE' for n in names)})")
        marks = ", ".join("?" * (len(names) + 1))
        db.executemany(f"INSERT INTO lines (geometry{''.join(f', {n}' for n in names)}) VALUES ({marks})", ((wkb(r.path), *(r[n] for n in names)) for r in lines.toLocalIterator()))
