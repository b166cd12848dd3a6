"""F7 by part against a plain loop."""
import datetime as dt
import random
from decimal import Decimal

from lotline.operators.stats import fab_in_out

SCHEMA = "PART_ID string, DAY timestamp_ntz, IN_QTY decimal(10,1), OUT_QTY decimal(10,1), SCRAP_QTY decimal(10,1), WIP int"


def test_levels_match_a_loop(spark):
    """One part has most of the rows; tenths add up exactly; a null part, null quantities and days."""
    rnd = random.Random(5)
    tenth = lambda: rnd.choice([None, Decimal(rnd.randrange(30)) / 10])
    rows = [(rnd.choice(["A", "A", "A", "B", None]), rnd.choice([None] + [dt.datetime(2024, 1, 20, 5) + dt.timedelta(days=rnd.randrange(60))] * 9),
             tenth(), tenth(), tenth(), 7) for _ in range(900)]
    got = {(r.PART_ID, r.GID, r.MONTH, r.WEEK, r.DAY): (r.FABIN_QTY, r.FABOUT_QTY, r.WIP_QTY, r.SCRAP_QTY)
           for r in fab_in_out(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want, wip, zero = {}, {}, Decimal(0)
    for part, at, i, o, s, _ in sorted((r for r in rows if r[1]), key=lambda r: r[1]):
        day = dt.datetime(at.year, at.month, at.day)
        month, week = day.replace(day=1), day - dt.timedelta(days=day.weekday())
        wip[part] = wip.get(part, zero) + (i or 0) - (o or 0)
        for key in ((part, 0, month, week, day), (part, 1, month, week, None), (part, 3, month, None, None), (part, 7, None, None, None)):
            a, b, _, c = want.get(key, (zero, zero, zero, zero))
            want[key] = (a + (i or 0), b + (o or 0), wip[part], c + (s or 0))
    assert got == want
    assert fab_in_out(spark.createDataFrame([], SCHEMA)).collect() == []
