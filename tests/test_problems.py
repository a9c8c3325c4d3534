import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tributary.operators.idindex import IdIndex, _Prefix, arrival_slices, deliveries, keep_one
from tributary.operators.replay import EventTimeReplay, EventTimeStore, OrderedState, replayed_in_batches

T = datetime(2020, 1, 1, 10)


def test_index_counts_every_copy(spark, make_reviews):
    rng = random.Random(1)
    ids = [f"r{rng.randrange(60)}" for _ in range(300)] + ["hot"] * 150 + [None] * 5
    rng.shuffle(ids)
    df = make_reviews([{"review_id": r, "ingest_time": T + timedelta(minutes=i)} for i, r in enumerate(ids)])
    told = deliveries(df).collect()
    found = {r.id for r in told if r.copies > 1 or r.known}
    assert found == {r for r, n in Counter(ids).items() if n > 1 and r is not None}
    assert Counter([r for r in ids if r]) == sum((Counter({r.id: r.copies}) for r in told), Counter())
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(ids) - {None}) + 5
    firsts = {r.review_id: r.ingest_time for r in kept.collect() if r.review_id}
    assert firsts["hot"] == T + timedelta(minutes=ids.index("hot"))


def test_index_is_idempotent_and_survives_merges(spark, make_reviews, tmp_path):
    index = IdIndex(spark, f"file://{tmp_path}/ids", prefix_rows=8, least_bits=1)
    for k in range(5):
        batch = make_reviews([{"review_id": f"r{i}"} for i in range(k * 10, k * 10 + 15)])
        for _ in range(2 if k in (0, 3) else 1):
            told = {r.id: r.known for r in index.process(batch, k).collect()}
        if k:
            assert {i for i, known in told.items() if known} == {f"r{i}" for i in range(k * 10, k * 10 + 5)}
    assert len(index.runs) < 4 and index.state["bits"] >= 3
    assert sorted(index.runs) == sorted(p.name for p in (tmp_path / "ids").iterdir() if p.name.startswith("run"))


def test_index_knows_after_it_is_reopened(spark, make_reviews, tmp_path):
    path = f"file://{tmp_path}/ids"
    IdIndex(spark, path).process(make_reviews([{"review_id": "x"}, {"review_id": "y"}]), 0)
    again = IdIndex(spark, path)
    assert {r.id: r.known for r in again.process(make_reviews([{"review_id": "x"}, {"review_id": "z"}]), 1).collect()} == {"x": True, "z": False}
    # a batch that failed after its run was written counts for nothing
    lost = IdIndex(spark, path)
    lost.manifest.commit = lambda content: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        lost.process(make_reviews([{"review_id": "w"}]), 2)
    except RuntimeError:
        pass
    third = IdIndex(spark, path)
    assert {r.id: r.known for r in third.process(make_reviews([{"review_id": i} for i in "wxyz"]), 2).collect()} == {"w": False, "x": True, "y": True, "z": True}


def test_equal_hashes_are_told_apart_by_the_identifier():
    import numpy as np
    import pyarrow as pa

    held = _Prefix()
    held.hold(np.array([5, 7, 7], dtype=np.int64).tobytes(), pa.array(["a", "b", "c"]))
    held.hold(np.array([7, 9], dtype=np.int64).tobytes(), pa.array(["d", "e"]))
    assert held.search(np.array([5, 7, 7, 7, 9, 10]), pa.array(["a", "d", "c", "x", "y", "z"])).tolist() == [True, True, True, False, False, False]


def test_index_of_nothing(spark, make_reviews):
    assert deliveries(make_reviews([])).count() == 0
    assert keep_one(make_reviews([])).count() == 0
    assert deliveries(make_reviews([{"review_id": None}, {"ingest_time": None, "review_id": "a"}, {"review_id": "a"}])).where("copies > 1 or known").count() == 1


def test_slices_hold_each_row_once(make_reviews):
    df = make_reviews([{"review_id": str(i), "ingest_time": None if i == 3 else T + timedelta(hours=i % 7)} for i in range(30)])
    parts = [p.count() for p in arrival_slices(df, "ingest_time", 4)]
    assert sum(parts) == 30 and len(parts) == 4
    same = make_reviews([{"review_id": str(i)} for i in range(5)])
    assert sum(p.count() for p in arrival_slices(same, "ingest_time", 4)) == 5


def test_ordered_state_replays_to_the_same_as_sorted():
    rng = random.Random(3)
    events = [(rng.randrange(1440), 1, float(rng.randrange(5)), 1) for _ in range(200)]
    state, last = OrderedState(), {}
    for e in events:
        for out in state.apply([e]):
            last[out[0]] = out[1:]
    running = [0, 0.0, 0]
    for p in sorted({e[0] // 60 for e in events}):
        own = [e for e in events if e[0] // 60 == p]
        running = [running[0] + len(own), running[1] + sum(e[2] for e in own), running[2] + len(own)]
        assert last[p] == (len(own), sum(e[2] for e in own), len(own), *running)


def test_late_rows(make_reviews):
    hour_end = T + timedelta(hours=1)
    rows = [
        {"review_id": "just", "ingest_time": hour_end + timedelta(hours=24)},
        {"review_id": "late", "ingest_time": hour_end + timedelta(hours=24, microseconds=1)},
        {"review_id": "again", "ingest_time": hour_end + timedelta(hours=90)},
        {"review_id": "again", "ingest_time": T},
        {"review_id": None, "ingest_time": hour_end + timedelta(hours=30)},
        {"review_id": None, "ingest_time": T},
        {"review_id": "early", "ingest_time": T - timedelta(hours=2), "stars": None},
        {"review_id": "nowhen", "event_time": None},
        {"review_id": "noarrival", "ingest_time": None},
    ]
    replay = EventTimeReplay(make_reviews(rows))
    assert sorted([r.id for r in replay.rejected().collect()], key=str) == [None, "late"]
    row = replay.current().first()
    assert (row.n_reviews, row.avg_stars, row.day_reviews) == (4, 3.0, 4)
    assert row.versions == 3  # at 8, 10 and 11 o'clock of the next day's arrivals
    by_business = EventTimeReplay(make_reviews(rows), key="business_id").current()
    assert by_business.agg(F.sum("n_reviews")).first()[0] == 4
    assert EventTimeReplay(make_reviews([])).current().count() == 0


def test_stored_state_equals_one_replay(spark, make_reviews, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(160):
        event = T + timedelta(minutes=rng.randrange(3000))
        rows.append({"review_id": rng.choice([None, f"r{rng.randrange(120)}"]), "business_id": rng.choice("ab"), "stars": rng.choice([None, 1.0, 4.0]), "event_time": event, "ingest_time": event + timedelta(minutes=rng.choice([0, 5, 300, 1600, 4000]))})
    rows.sort(key=lambda r: r["ingest_time"])
    whole = EventTimeReplay(make_reviews(rows), key="business_id")
    path = f"file://{tmp_path}/state"
    for k in range(3):
        store = EventTimeStore(spark, path, key="business_id")  # opened anew for each batch
        part = make_reviews(rows[k * 54 : k * 54 + 54])
        for _ in range(2 if k % 2 else 1):  # and processed again
            store.process(part, k)
    columns = ["key", "hour", "n_reviews", "avg_stars", "day_reviews", "day_avg_stars"]
    tidy = lambda df: sorted((r.key, r.hour, r.n_reviews, round(r.avg_stars or 0, 9), r.day_reviews, round(r.day_avg_stars or 0, 9)) for r in df.select(*columns).collect())
    assert tidy(EventTimeStore(spark, path, key="business_id").current()) == tidy(whole.current())
    late = lambda df: sorted((str(r.id), r.event_time) for r in df.collect())
    assert late(store.rejected()) == late(whole.rejected()) != []
    nothing = replayed_in_batches(make_reviews([]), 2)
    assert nothing.current().count() == nothing.rejected().count() == 0
