"""Pick-up routes: nearest-neighbour tours improved by 2-opt, and their timelines. A route has ``MOST`` stops at most, so
one task holds many routes and a route never outgrows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MOST, DETOUR, SPEED_KMH, ROUNDS, SERVICE_MINUTES = 40, 1.3, 70.0, 200, 15
_EARTH = 6_371_000.0
RESULT = "route_id long, place int, stop_id long, metres double, arrival double, wait double, late boolean, refused boolean"


def distances(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Road metres between all points, as the crow flies times a detour factor."""
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    return DETOUR * 2 * _EARTH * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def tour(d: np.ndarray) -> list[int]:
    """A round trip from point 0: always the nearest point next, then reversals of stretches while they shorten it."""
    left, order = set(range(1, len(d))), [0]
    while left:
        order.append(min(left, key=lambda j: (d[order[-1], j], j)))
        left.remove(order[-1])
    n = len(order)
    for _ in range(ROUNDS):
        better = False
        for i in range(1, n - 1):
            for j in range(i + 1, n):
                a, b, c, e = order[i - 1], order[i], order[j], order[(j + 1) % n]
                if d[a, c] + d[b, e] < d[a, b] + d[c, e] - 1e-6:
                    order[i : j + 1] = order[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return order


def _planned(stops: pd.DataFrame) -> pd.DataFrame:
    stops = stops.sort_values(["depot", "stop_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
    names = ["route_id", "place", "stop_id", "metres", "arrival", "wait", "late", "refused"]
    if not 1 < len(stops) <= MOST + 1:
        return pd.DataFrame([(stops["route_id"].iloc[0], None, None, None, None, None, None, True)], columns=names)
    d = distances(stops["lat"].to_numpy(), stops["lon"].to_numpy())
    order, clock, out = tour(d), float(stops["opens"].iloc[0]), []
    for place, (at, before) in enumerate(zip(order + [0], [0] + order)):
        metres = float(d[before, at])
        clock += metres / 1000 / SPEED_KMH * 60
        last = place == len(order)
        opens, closes = stops["opens"].iloc[at], stops["closes"].iloc[at]
        wait = 0.0 if place == 0 or last else max(0.0, float(opens) - clock)
        out.append((stops["route_id"].iloc[0], place, stops["stop_id"].iloc[at], metres, clock, wait, bool(place > 0 and not last and clock + wait > closes), False))
        clock += wait + (SERVICE_MINUTES if 0 < place < len(order) else 0)
    return pd.DataFrame(out, columns=names)


def plan_routes(stops: DataFrame) -> DataFrame:
    """Timelines of all routes from (route_id, stop_id, lat, lon, opens, closes, depot); times in minutes after midnight.
    The depot opens the route and closes it; a route without a stop or of more than ``MOST``
    stops gives one row that says it is refused, and leaves the others alone."""
    return stops.groupBy("route_id").applyInPandas(_planned, RESULT)
