import random

from pyspark.sql import functions as F

from loglattice.session import work_path
from loglattice.operators import late

H = late.HOUR_US


def test_verdicts(spark):
    rows = [(0, H - 1), (0, H), (5, 7 * H - 1), (5, 7 * H), (-1, 5), (5, -1), (None, 5), (5, None), (-H, -1 + 0), (-2 * H, -H + 5), (H, 0)]
    df = spark.createDataFrame(rows, "e long, a long")
    got = [r["v"] for r in df.select(late.verdict(F.col("e"), F.col("a")).alias("v")).collect()]
    assert got == ["base", "amend", "amend", "cut", None, None, None, None, None, "amend", "base"]
    hours = spark.createDataFrame([(-1,), (0,), (H - 1,), (H,), (-H - 1,)], "e long").select(late.period_of(F.col("e")).alias("h"))
    assert [r["h"] for r in hours.collect()] == [-1, 0, 0, 1, -2]


def test_merge_is_idempotent_and_free_of_order(spark):
    rng = random.Random(3)
    states, sums = [], {}
    for hour in range(3):
        for source in ("a", "b", ""):
            n = 0
            for version in range(1, 5):
                n += rng.randint(1, 9)
                states.append((hour, source, version, n, 0, n * 10, n))
            sums[hour] = sums.get(hour, 0) + n
    schema = "hour_no long, source string, version long, n long, n_amended long, bytes long, duration_us long"
    for _ in range(3):
        rng.shuffle(states)
        cut = rng.randint(1, len(states) - 1)
        a, b = spark.createDataFrame(states[:cut], schema), spark.createDataFrame(states[cut:], schema)
        merged = late.merge(late.merge(b, a), a, b)
        assert {r["hour_no"]: r["n"] for r in late.totals(merged).collect()} == sums


def test_whole_tables(spark, table):
    rows = late.timed_access(table("access_log"), table("line_events"), table("log_hosts")).cache()
    state = late.counters(rows)
    total = late.totals(late.merge(state, state)).agg(F.sum("n"), F.sum("bytes")).first()
    want = rows.where("verdict in ('base', 'amend')").agg(F.count("*"), F.sum("bytes")).first()
    assert tuple(total) == tuple(want)
    cases = late.late_cases(table("access_log"), table("line_events"), table("log_hosts"))
    assert cases.count() == rows.where("verdict in ('amend', 'cut')").count() > 0
    assert late.counters(rows.limit(0)).count() == 0


def test_states_of_different_rows_add_up(spark, table):
    schema = "event_id long, hour_no long, file string, batch_no long, verdict string, bytes long, duration double"
    rows = [(i, i % 3, "f" if i % 5 else None, i // 4, "amend" if i % 7 == 0 else "base", i, i / 8) for i in range(60)]
    make = lambda keep: late.counters(spark.createDataFrame([r for r in rows if keep(r)], schema))
    by_hour = lambda state: sorted(map(tuple, late.totals(state).collect()))
    want = {h: [sum(1 for r in rows if r[1] == h), sum(r[5] for r in rows if r[1] == h)] for h in range(3)}
    a, b = make(lambda r: r[3] % 2 == 0), make(lambda r: r[3] % 2)
    assert by_hour(late.merge(a, b)) == by_hour(late.merge(b, a, b)) == by_hour(make(lambda r: True))
    assert {r["hour_no"]: [r["n"], r["bytes"]] for r in late.totals(late.merge(a, b)).collect()} == want
    half = make(lambda r: r[3] < 7 or r[0] < 30)  # of batch 7 only a part
    late_one = spark.createDataFrame([r for r in rows if r[3] >= 7], schema)
    assert by_hour(late.with_batch(late.with_batch(half, late_one), late_one)) == by_hour(make(lambda r: True))
    timed = late.timed_access(table("access_log"), table("line_events"), table("log_hosts")).cache()
    parts = [late.counters(timed.where(F.pmod("batch_no", F.lit(3)) == k)) for k in range(3)]
    assert by_hour(late.merge(*parts)) == by_hour(late.counters(timed))


def test_a_store_takes_each_delivery_once(spark):
    import random

    schema = "event_id long, file string, batch_no long, hour_no long, verdict string, bytes long, duration double"
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), i % 3, rng.randint(1, 3), rng.choice(["base", "amend", "cut"]), rng.choice([None, i]), 0.5) for i in range(90)]
    want = {}
    for _, file, _, hour, verdict, size, _ in rows:
        if verdict != "cut":
            w = want.setdefault(hour, [0, 0, 0, 0, set()])
            w[0] += 1
            w[1] += verdict == "amend"
            w[2] += size or 0
            w[3] += 500_000
            w[4].add(file)
    store = late.CounterStore(spark, work_path(spark, "late"), most=3)
    parts = {str(k): spark.createDataFrame([r for r in rows if (r[0] * 7) % 6 == k], schema) for k in range(6)}  # batches are split over deliveries
    order = [*parts, *parts]
    rng.shuffle(order)
    took = [store.add(parts[k], k) for k in order]
    assert sum(took) == 6 and not store.add(parts["0"].limit(0), "0")
    got = {r["hour_no"]: (r["n"], r["n_amended"], r["bytes"], r["duration_us"], r["n_sources"]) for r in store.totals().collect()}
    assert got == {h: (*w[:4], len({f or "" for f in w[4]})) for h, w in want.items()}
    assert len(store.table.manifest()["folders"]) <= 4
    assert late.CounterStore(spark, work_path(spark, "late")).totals().count() == 0
