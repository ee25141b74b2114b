"""The profile by exhaustive comparison, row against row, in plain Python."""

import math

DAY, HOUR = 86_400_000_000, 3_600_000_000


def haversine(lat1, lon1, lat2, lon2):
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def profile(rows):
    """rows as for make_ledger -> {id: (rcv, uniq, same, n1h, v1h, days, speed)}."""
    out = {}
    for i, amount, s, r, lat, lon, us in rows:
        others = [o for o in rows if o[0] != i]
        into = [o for o in others if r is not None and o[3] == r and us - 3 * DAY <= o[6] < us]
        mine = [o for o in others if s is not None and o[2] == s and o[6] < us]
        same = [o for o in mine if o[1] == amount and o[6] >= us - 2 * DAY]
        hour = [o for o in mine if o[6] >= us - HOUR]
        days, speed = 9999.0, 0.0
        if mine:
            p = max(mine, key=lambda o: (o[6], o[0]))
            days = (us - p[6]) / DAY
            if None not in (lat, lon, p[4], p[5]):
                km = haversine(float(p[4]), float(p[5]), float(lat), float(lon))
                speed = km / ((us - p[6]) / HOUR)
        out[i] = (
            len(into),
            len({o[2] for o in into if o[2] is not None}),
            len(same),
            len(hour),
            round(float(sum(o[1] for o in hour)), 2),
            round(days, 6),
            round(speed, 3),
        )
    return out
