import random
from datetime import datetime, timedelta

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import cleaning, metrics
from weirlog.schema import CLEAN_SCHEMA, RAW_SCHEMA
from weirlog.sources import csv_logs
from weirlog.streaming import jobs


@pytest.fixture(scope="module")
def csv_parts(raw, tmp_path_factory):
    """The raw logs as several files."""
    folder = tmp_path_factory.mktemp("csv")
    csv_logs.write_raw_csv(raw.repartitionByRange(4, "timestamp"), str(folder / "all"))
    return str(folder / "all")


def paths(tmp_path, *names):
    return [str(tmp_path / n) for n in names]


def test_csv_stream_reads_null_tokens(spark, raw, csv_parts, tmp_path):
    out, progress = paths(tmp_path, "out", "progress")
    jobs.run_available(jobs.append_to(jobs.raw_csv_stream(spark, csv_parts), out, progress))
    assert rows_of(spark.read.parquet(out)) == rows_of(csv_logs.read_raw_csv(spark, csv_parts))


def test_files_far_apart_and_newest_first_lose_nothing(spark, make_raw, tmp_path):
    source, clean, cells = paths(tmp_path, "in", "clean", "cells")
    days = [f"2024-{month:02d}-{day:02d} 00:00:00" for month, day in ((2, 25), (2, 22), (2, 1), (1, 30), (1, 3))]
    everything = make_raw(*({"timestamp": d} for d in days), *({"timestamp": d} for d in days[:3]))
    for i, row in enumerate([*days, *days[:3]]):
        make_raw({"timestamp": row}, {"timestamp": row}).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.run_available(jobs.for_each_batch(stream, jobs.add_clean_rows_to(clean), f"{tmp_path}/p1"))
        counted = jobs.add_cells_to(cells, lambda b: jobs.cells_of_days(cleaning.clean(b)))
        jobs.run_available(jobs.for_each_batch(stream, counted, f"{tmp_path}/p2"))
    assert rows_of(jobs.clean_rows(spark, clean)) == rows_of(cleaning.clean(everything))
    cleaned_each = cleaning.clean(everything).unionByName(cleaning.clean(make_raw(*({"timestamp": d} for d in days[:3]))))
    assert rows_of(jobs.daily_trend_of(jobs.current_cells(spark, cells))) == rows_of(metrics.latency_trend(cleaned_each))


def test_cleaning_in_several_batches_equals_batch(spark, raw, csv_parts, tmp_path):
    out, progress = paths(tmp_path, "out", "progress")
    stream = jobs.raw_csv_stream(spark, csv_parts)
    jobs.run_available(jobs.for_each_batch(stream, jobs.add_clean_rows_to(out), progress))
    assert rows_of(jobs.clean_rows(spark, out)) == rows_of(cleaning.clean(raw))
    again = jobs.add_clean_rows_to(out)
    for number in (0, 1):  # a batch that is run again, and the same rows in a later one
        again(raw, number)
    assert rows_of(jobs.clean_rows(spark, out)) == rows_of(cleaning.clean(raw))


def test_running_cells_equal_batch_tables(spark, logs, tmp_path):
    source, out, progress = paths(tmp_path, "in", "out", "progress")
    logs.repartition(3).write.parquet(source)

    def run():
        stream = spark.readStream.schema(CLEAN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        action = jobs.add_cells_to(out, lambda b: jobs.cells_of_days(b, "service_name"))
        jobs.run_available(jobs.for_each_batch(stream, action, progress))
        return jobs.current_cells(spark, out)

    current = run()
    assert rows_of(jobs.daily_trend_of(current)) == rows_of(metrics.latency_trend(logs))
    expected = metrics.kpis(metrics.daily(logs).withColumnRenamed("date", "day"), "day", "service_name")
    assert rows_of(jobs.daily_kpis_of(current)) == rows_of(expected)
    # More files arrive later: the counts go on.
    logs.coalesce(1).write.mode("append").parquet(source)
    doubled = logs.unionByName(logs)
    assert rows_of(jobs.daily_trend_of(run())) == rows_of(metrics.latency_trend(doubled))


def test_fifty_batches_leave_few_folders(spark, make_logs, tmp_path):
    out = str(tmp_path / "cells")
    add = jobs.add_cells_to(out, jobs.cells_of_days, merge_every=5)
    batch = make_logs({"response_time_ms": 5}, {"response_time_ms": 9, "status_code": 500}).cache()
    for number in range(50):
        add(batch, number)
        if number % 7 == 4:
            add(batch, number)  # run again
    assert len(list((tmp_path / "cells").iterdir())) <= 12
    total = jobs.current_cells(spark, out).agg(F.sum("n"), F.sum("n_5xx")).first()
    assert tuple(total) == (100, 50)


def requests(make_raw, hours, failing):
    """100 requests of one service an hour; in failing hours 10 of them fail, else 4."""
    rows = []
    for hour in range(hours):
        for i in range(100):
            bad = i < (10 if hour in failing else 4)
            at = datetime(2024, 1, 1) + timedelta(hours=hour, seconds=i)
            rows.append({"timestamp": str(at), "status_code": "500" if bad else "200", "endpoint": f"/{i % 3}"})
    return rows


def test_incidents_do_not_depend_on_files_and_follow_the_life_cycle(spark, make_raw, tmp_path):
    rows = requests(make_raw, 6, {1, 2, 4, 5})
    none = spark.createDataFrame([], "id string, status string, changed_at timestamp_ntz")
    orders = {"one": [rows], "forward": [rows[i::20] for i in range(20)]}
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    orders["backward"] = [shuffled[i::6] for i in range(6)][::-1]
    found = {}
    for name, batches in orders.items():
        add = jobs.add_window_cells_to(f"{tmp_path}/{name}")
        for number, batch in enumerate(batches):
            add(make_raw(*batch), number)
        found[name] = rows_of(jobs.window_incidents(spark, f"{tmp_path}/{name}", none))
    assert found["one"] == found["forward"] == found["backward"]
    where = f"{tmp_path}/one"
    first = jobs.window_incidents(spark, where, none).collect()
    assert [(str(r.started_at), r.status) for r in first] == [("2024-01-01 01:00:00", "open")]
    assert first[0].description.startswith("Error rate 10.0%")
    changes = spark.createDataFrame([(first[0].id, "resolved", datetime(2024, 1, 1, 3))], none.schema)
    after = jobs.window_incidents(spark, where, changes).orderBy("started_at").collect()
    assert [(str(r.started_at), r.status) for r in after] == [("2024-01-01 01:00:00", "resolved"), ("2024-01-01 04:00:00", "open")]
