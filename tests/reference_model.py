"""A small chronological fold over runner rows, written from the semantics, for comparison with the window plans."""

import statistics


def fold(rows, keep, config, fields=("pos",)):
    """rows: dicts with race_id, at (seconds), row_no, horse, jockey, trainer, pos, won, placed. What each row sees of each entity, and ratings."""
    races = {}
    for r in rows:
        races.setdefault((r["at"], r["race_id"]), []).append(r)
    past = {k: {} for k in keep}
    ratings, out = {}, {}
    for (at, race), runners in sorted(races.items()):
        runners.sort(key=lambda r: r["row_no"])
        if len(runners) < 2:
            continue
        full = lambda r: all(r[k] is not None for k in ("horse", "jockey", "trainer"))
        before = [ratings.get(r["horse"], config.default_rating) if full(r) else config.default_rating for r in runners]
        for r, elo in zip(runners, before, strict=True):
            seen = {k: [x for x in past[k].get(r[k], [])[-n:] if x["at"] < at - 300] for k, n in keep.items() if r[k] is not None}
            out[(race, r["row_no"])] = {"seen": seen, "elo": elo if full(r) else None}
        lost = [r["pos"] is None or r["pos"] >= 99 for r in runners]
        for k, r in enumerate(runners):
            others = [x for j, x in enumerate(before) if j != k]
            expected = statistics.fmean(1 / (1 + 10 ** ((o - before[k]) / config.base)) for o in others)
            beaten = sum(1 for j, x in enumerate(runners) if j != k and (99 if lost[j] else x["pos"]) > (r["pos"] or 0)) + sum(lost[j] for j in range(len(runners)) if j != k)
            actual = 0.0 if lost[k] else beaten / (len(runners) - 1)
            new = before[k] + config.k_factor * (actual - expected)
            new += config.regression * (config.default_rating - new)
            if r["horse"] is not None:
                ratings[r["horse"]] = min(config.ceiling, max(config.floor, new))
        for r in runners:
            for k in keep:
                past[k].setdefault(r[k], []).append(r)
    return out, ratings
