"""Parameters of the listing operators. Thresholds are inputs: the defaults only suit the test tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    min_rent: int = 1000
    max_rent: int = 12000
    min_area: float = 10.0
    max_area: float = 200.0
    min_rent_per_sqm: float = 15.0
    max_rent_per_sqm: float = 300.0
    lon_range: tuple[float, float] = (112.0, 112.8)
    lat_range: tuple[float, float] = (30.3, 31.0)
    #: Text that marks serviced apartments, and areas that are no subdistrict; Java regular expressions.
    apartment: str = "公寓|apartment|studio"
    vague_area: str = "地铁|附近|旁$|路$|街$|^\\?$"
    #: Words in a text that name the area although the coordinates lie outside it.
    place_hint: str = "地铁|号线|街道|镇"
    #: Upper edges of the distance buckets in metres; the last one is inclusive.
    edges: tuple[int, int, int] = (4000, 8000, 12000)
    bucket_names: tuple[str, str, str, str] = ("near", "middle", "far", "beyond")
    min_community: int = 3
    min_nearby: int = 5
    nearby_m: float = 500.0
    eps_m: float = 120.0
    min_samples: int = 5
    #: Clusters of this size are dense; those below twice min_samples are small.
    dense_cluster: int = 20
