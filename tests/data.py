"""Small inputs with known answers: readings of river gauges, and a daily series with a weekly shape."""

from datetime import date, timedelta

GAUGES = [
    ("Aire", date(2022, 11, 3), 1.25, 40, False),
    ("Aire", date(2022, 11, 20), 2.75, 95, True),
    ("Aire", date(2023, 1, 8), 3.5, 120, True),
    ("Wye", date(2022, 11, 3), 0.5, 15, False),
    ("Wye", date(2023, 1, 8), 1.0, None, False),
    ("Tees", date(2022, 12, 24), 2.0, 60, False),
    ("Tees", date(2023, 1, 9), 4.0, 210, True),
    ("Tees", date(2023, 1, 31), None, 30, False),
    ("Exe", date(2023, 2, 2), 1.5, 20, None),
]
GAUGES_SCHEMA = "river string, taken date, depth double, silt long, flood boolean"

SHAPE = (3, -2, 0, 5, 8, -6, 1)
START = date(2023, 3, 6)


def series(n: int, slope: float = 0.0, bumps: dict[int, float] | None = None) -> list[tuple[date, float]]:
    return [(START + timedelta(k), 80 + slope * k + SHAPE[k % 7] + (bumps or {}).get(k, 0.0)) for k in range(n)]
