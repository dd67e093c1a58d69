"""One class with every way of measuring change. Tiled, parallel and streaming variants of other engines are one plan here."""

from __future__ import annotations

from stratamesh.operators import cloud_distance, cylinder, grid, statistics


class ChangeDetector:
    dod = staticmethod(grid.dod)
    dod_files = staticmethod(lambda t1, t2, **k: grid.dod(t1, t2, clamp=False, **k))
    dod_mosaic = staticmethod(grid.mosaic)
    dod_statistics = staticmethod(grid.dod_statistics)
    c2c = staticmethod(cloud_distance.nearest)
    c2c_within = staticmethod(cloud_distance.distances_within)
    c2c_vertical_plane = staticmethod(cloud_distance.vertical_distances)
    c2c_statistics = staticmethod(statistics.distance_statistics)
    autotune = staticmethod(cylinder.autotune)
    autotune_headers = staticmethod(cylinder.autotune_headers)
    m3c2 = staticmethod(cylinder.compare)
    m3c2_upright = staticmethod(cylinder.compare_upright)
    m3c2_normals = staticmethod(cylinder.normals)
    m3c2_statistics = staticmethod(statistics.change_statistics)
    m3c2_planes = staticmethod(cylinder.compare_planes)
