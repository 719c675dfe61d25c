"""Streams whose batches cost what they bring: state for copies, merged folders, windows judged one by one."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import cleaning, incidents
from weirlog.operators.explore import with_log_id
from weirlog.operators.filters import month_of
from weirlog.schema import LOG_COLUMNS, RAW_SCHEMA
from weirlog.streaming import jobs
from weirlog.streaming.runs import Runs, latest, summed

NOW = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)


def text(at):
    return at.strftime("%Y-%m-%d %H:%M:%S")


def files(make_raw, folder, *batches):
    """One file for each batch of rows, oldest first."""
    for batch in batches:
        make_raw(*batch).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, out, progress, **hours):
    stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_available(jobs.for_each_batch(jobs.clean_stream(stream, **hours), jobs.add_clean_rows_to(out), progress))


def test_copies_near_old_and_early(spark, make_raw, tmp_path, monkeypatch):
    """Near rows are compared with the state only, old and early ones with the stored rows of their months."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    near = [{"timestamp": text(NOW - timedelta(hours=h))} for h in (1, 2, 3)]
    old = [{"timestamp": text(NOW - timedelta(days=d))} for d in (3, 40, 400)]
    early = [{"timestamp": text(NOW + timedelta(days=2))}]
    batches = [near, near[:1] + [near[0]] * 3, old + near[1:], old + early, early + near, [{"timestamp": text(NOW - timedelta(hours=4))}]]
    files(make_raw, source, *batches)
    asked = []
    original = jobs._stored_ids

    def counted(runs, spark, months, before):
        asked.append((before, sorted(map(str, months))))
        return original(runs, spark, months, before)

    monkeypatch.setattr(jobs, "_stored_ids", counted)
    run(spark, source, out, progress)
    expected = cleaning.clean(make_raw(*near, *old, *early, *batches[-1]))
    assert rows_of(jobs.clean_rows(spark, out)) == rows_of(expected)
    assert asked and all(len(months) <= 3 for _, months in asked)
    # Another day's worth of batches of near rows asks for nothing that is stored.
    asked.clear()
    files(make_raw, source, near, near)
    run(spark, source, out, progress)
    assert not asked and rows_of(jobs.clean_rows(spark, out)) == rows_of(expected)


def test_early_rows_are_known_when_their_time_has_come(spark, make_raw, tmp_path):
    out = str(tmp_path / "out")
    add = jobs.add_clean_rows_to(out)
    row = with_log_id(cleaning.clean(make_raw({"timestamp": text(NOW)}))).withColumn("log_month", month_of(F.col("timestamp")))
    other = with_log_id(cleaning.clean(make_raw({"timestamp": text(NOW), "endpoint": "/x"}))).withColumn("log_month", month_of(F.col("timestamp")))
    for number, came in enumerate(("early", "early", "near", "old")):
        add(row.unionByName(other).withColumn("came", F.lit(came)) if number == 2 else row.withColumn("came", F.lit(came)), number)
    assert jobs.clean_rows(spark, out).count() == 2


def test_state_is_in_rocksdb_and_lets_go(spark, make_raw, tmp_path):
    """With hardly any time to remember, state is dropped; what it forgot is found among the stored rows."""
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    rows = [{"timestamp": text(NOW - timedelta(days=9, minutes=i))} for i in range(20)]
    for _ in range(3):
        files(make_raw, source, rows)
        run(spark, source, out, progress, behind_hours=0, ahead_hours=0)
    assert jobs.clean_rows(spark, out).count() == 20
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert list(tmp_path.glob("progress/state/0/*/*.zip"))


def test_fifty_batches_read_little(spark, make_raw, tmp_path, monkeypatch):
    """Near batches read no stored row; old ones those of their month, from a bounded number of folders."""
    out, read = str(tmp_path / "out"), []
    original = jobs._stored_ids

    def counted(runs, spark, months, before):
        found = original(runs, spark, months, before)
        read.append((len(runs.folders(spark, before)), found.count()))
        return found

    monkeypatch.setattr(jobs, "_stored_ids", counted)
    add = jobs.add_clean_rows_to(out, merge_every=4)
    start = datetime(2024, 1, 1)
    for number in range(50):
        own = [{"timestamp": text(start + timedelta(days=31 * number, seconds=i))} for i in range(5)]
        rows = with_log_id(cleaning.clean(make_raw(*own))).withColumn("log_month", month_of(F.col("timestamp")))
        late = number % 10 == 9
        rows = rows.withColumn("came", F.lit("old" if late else "near"))
        add(rows, number)
        if late:
            add(rows, number)  # run again
    assert len(read) == 10 and max(n for _, n in read) <= 5 * 2 and max(f for f, _ in read) <= 12
    assert jobs.clean_rows(spark, out).count() == 250
    # All of them once more, as late copies.
    everything = jobs._row_runs(out).read(spark).withColumn("came", F.lit("old"))
    add(everything, 50)
    assert jobs.clean_rows(spark, out).count() == 250


def test_runs_cover_every_batch_once(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, n bigint").schema
    runs = Runs(str(tmp_path / "runs"), schema, combine=summed("n"), fan_in=3)
    for number in range(30):
        rows = spark.createDataFrame([("all", 1), (f"b{number % 2}", number)], schema)
        runs.add(rows.limit(0) if number == 13 else rows, number)
        if number in (8, 11, 26):  # run again after a merge
            runs.add(rows, number)
        assert len(list((tmp_path / "runs").iterdir())) <= 13
        if number % 5 == 4:
            for before in (None, number):
                found = dict(map(tuple, summed("n")(runs.read(spark, before)).collect()))
                numbers = [n for n in range(number + 1 if before is None else before) if n != 13]
                assert found == {"all": len(numbers), "b0": sum(n for n in numbers if n % 2 == 0), "b1": sum(n for n in numbers if n % 2)}
    assert len(runs.folders(spark)) == 1 + 1


def test_runs_without_a_batch(spark, tmp_path):
    """Batches that were left out make no merge, and nothing is lost."""
    schema = spark.createDataFrame([], "k bigint").schema
    runs = Runs(str(tmp_path / "runs"), schema, fan_in=3)
    for number in (0, 2, 3, 4, 5, 8, 9):
        runs.add(spark.createDataFrame([(number,)], schema), number)
    assert rows_of(runs.read(spark)) == [(n,) for n in (0, 2, 3, 4, 5, 8, 9)]
    assert runs.read(spark, 0).count() == 0


def test_latest_versions(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("b", 1, "z")], "w string, v bigint, s string")
    assert rows_of(latest("w", "v")(rows)) == [("a", 2, None), ("b", 1, "y"), ("b", 1, "z")]


def hourly(hours, failing, services=("auth-service",)):
    rows = []
    for hour in range(hours):
        for i in range(40):
            for service in services:
                bad = i < (6 if (hour, service) in failing else 1)
                at = datetime(2024, 1, 30) + timedelta(hours=hour, seconds=i)
                rows.append({"timestamp": text(at), "service_name": service, "status_code": "500" if bad else "200", "endpoint": f"/{i % 3}"})
    return rows


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_windows_judged_batch_by_batch_equal_all_at_once(spark, make_raw, tmp_path, order):
    services = ("auth-service", "order-service")
    rows = hourly(60, {(h, s) for h in range(60) for s in services if (h * 7 + len(s)) % 5 == 0}, services)
    batches = [rows[i : i + 800] for i in range(0, len(rows), 800)]
    if order == "backward":
        batches = batches[::-1]
    if order == "mixed":
        random.Random(4).shuffle(rows)
        batches = [rows[i::6] for i in range(6)]
    add = jobs.add_window_cells_to(str(tmp_path / "w"), merge_every=3)
    for number, batch in enumerate(batches):
        add(make_raw(*batch), number)
        if number == 2:
            add(make_raw(*batch), number)
    cells = jobs.cells_of_windows(cleaning.clean(make_raw(*rows))).withColumn("is_current", F.lit(True))
    expected = incidents.violations_of_cells(cells, False, by=("window_start",))
    found = jobs.window_violations(spark, str(tmp_path / "w")).select(*expected.columns)
    assert rows_of(found) == rows_of(expected) and expected.count() > 10
    none = spark.createDataFrame([], "id string, status string, changed_at timestamp_ntz")
    assert rows_of(jobs.window_incidents(spark, str(tmp_path / "w"), none)) == rows_of(incidents.incidents_of_windows(expected, none))


def test_late_rows_clear_a_violation(spark, make_raw, tmp_path):
    add = jobs.add_window_cells_to(str(tmp_path / "w"))
    bad = [{"timestamp": f"2024-01-01 05:00:{i:02d}", "status_code": "500"} for i in range(3)]
    good = [{"timestamp": f"2024-01-01 05:01:{i:02d}"} for i in range(60)] + [{"timestamp": f"2024-01-01 05:02:{i:02d}"} for i in range(60)]
    add(make_raw(*bad), 0)
    assert jobs.window_violations(spark, str(tmp_path / "w")).count() == 1
    add(make_raw(*good), 1)
    assert jobs.window_violations(spark, str(tmp_path / "w")).count() == 0


def test_a_batch_reads_the_counts_of_its_months_only(spark, make_raw, tmp_path, monkeypatch):
    """Forty months of history, then a batch of one hour: what is judged again is that hour."""
    add = jobs.add_window_cells_to(str(tmp_path / "w"), merge_every=4)
    months = [{"timestamp": f"{2020 + m // 12}-{m % 12 + 1:02d}-15 0{h}:00:00", "status_code": "500"} for m in range(40) for h in range(3)]
    add(make_raw(*months), 0)
    judged = []
    original = incidents.violations_of_cells

    def caught(cells, *rest, **more):
        judged.append((cells.select("window_start").distinct().count(), cells._jdf.queryExecution().executedPlan().toString()))
        return original(cells, *rest, **more)

    monkeypatch.setattr(incidents, "violations_of_cells", caught)
    add(make_raw({"timestamp": "2023-04-15 01:30:00"}), 1)
    (windows, plan), = judged
    assert windows == 1 and "PartitionFilters" in plan and "log_month" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert jobs.window_violations(spark, str(tmp_path / "w")).count() == 120
    columns = set(jobs.clean_rows(spark, f"{tmp_path}/w/rows").columns)
    assert columns == set(LOG_COLUMNS)
