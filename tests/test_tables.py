import duckdb
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weirlog.operators import cleaning, explore, filters, incidents
from weirlog.schema import LOG_COLUMNS
from weirlog.sources import csv_logs, synthetic, tables


@pytest.fixture()
def store(spark, tmp_path):
    made = tables.LogTables(spark, f"db_{tmp_path.name.replace('-', '_')}", str(tmp_path / "db"))
    yield made
    spark.sql(f"DROP DATABASE {made.database} CASCADE")


@pytest.fixture()
def csv(raw, tmp_path):
    path = str(tmp_path / "logs.csv")
    csv_logs.write_raw_csv(raw, path)
    return path


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv_columns_and_null_tokens(spark, tmp_path):
    header = "extra,server_region,timestamp,service_name,endpoint,status_code,response_time_ms,release_version\n"
    path = write(tmp_path, "a.csv", header + '1,NA,2024-01-01,"say ""hi"", you",N/A,200,nan,None\n2,x, t ,s,"",,3,v1\n')
    rows = csv_logs.read_raw_csv(spark, path)
    assert tuple(rows.columns) == LOG_COLUMNS
    assert rows_of(rows) == sorted(
        [("2024-01-01", 'say "hi", you', None, "200", None, None, None), (" t ", "s", None, None, "3", "v1", "x")],
        key=repr,
    )


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(csv_logs.MissingColumnsError, match="endpoint.*server_region"):
        csv_logs.read_raw_csv(spark, write(tmp_path, "a.csv", "timestamp,service_name,status_code,response_time_ms,release_version\n"))


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    names = list(LOG_COLUMNS)
    write(folder, "a.csv", ",".join(names) + "\n" + ",".join("1" * 7) + "\n")
    write(folder, "b.csv", ",".join(names[::-1]) + "\n" + ",".join("2" * 7) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_logs.read_raw_csv(spark, str(folder)).collect()


def test_ingest_list_delete_reset(store, csv, raw):
    first = store.ingest(csv, "one").first()
    expected = cleaning.report(raw).first()
    for name in ("raw_rows", "clean_rows", "dropped_invalid_status", "dropped_invalid_latency", "duplicates_removed"):
        assert first[name] == expected[name]
    assert not first.already_loaded

    known = store.ingest(csv, force=False).first()
    assert (known.dataset_id, known.already_loaded, known.clean_rows) == (first.dataset_id, True, first.clean_rows)
    second = store.ingest(csv, "two").first()
    # Copies in different datasets both stay.
    assert store.scan().count() == 2 * first.clean_rows
    assert [r.name for r in store.list_datasets().collect()] == ["two", "one"]
    assert store.find_dataset("logs.csv").first().dataset_id == second.dataset_id
    assert rows_of(store.scan(first.dataset_id).select(*LOG_COLUMNS)) == rows_of(cleaning.clean(raw))

    store.delete_dataset(first.dataset_id)
    assert store.scan().count() == second.clean_rows and store.scan(first.dataset_id).count() == 0
    with pytest.raises(LookupError):
        store.delete_dataset(first.dataset_id)
    assert tuple(store.reset().first()) == (second.clean_rows, 1)
    assert store.scan().count() == 0 and store.list_datasets().count() == 0


def test_repeated_write_of_a_dataset_replaces_it(store, raw):
    cleaned = cleaning.clean(raw)
    for _ in range(2):
        assert store.persist_clean(cleaned, "d1", "n", "f.csv") == cleaned.count()
    assert store.list_datasets().count() == 1


def test_rows_of_a_failed_load_are_not_seen(store, raw, monkeypatch):
    cleaned = cleaning.clean(raw)
    rows = store.persist_clean(cleaned, "good", "n", "f.csv")
    written = store._replace_dataset

    def fail_to_register(frame, table, dataset_id):
        if table == "datasets":
            raise OSError("lost")
        written(frame, table, dataset_id)

    monkeypatch.setattr(store, "_replace_dataset", fail_to_register)
    with pytest.raises(OSError):
        store.persist_clean(cleaned, "bad", "n", "f.csv")
    assert store.scan("bad").count() == 0
    assert store.scan().count() == rows and store.list_datasets().count() == 1


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_replacing_leaves_no_old_months(spark, store, logs, raw, mode):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        one_year = logs.where("year(timestamp) = 1996")
        store.persist_clean(logs.where("year(timestamp) = 1995"), "other's", "n", "f.csv")
        store.persist_clean(logs, "d1", "n", "f.csv")
        assert store.persist_clean(one_year, "d1", "n", "f.csv") == one_year.count()
        assert store.scan("d1").count() == one_year.count()
        assert store.scan("other's").count() == logs.where("year(timestamp) = 1995").count()
        assert store.persist_clean(logs.limit(0), "d1", "n", "f.csv") == 0 == store.scan("d1").count()
        assert store.land_raw(raw, "r").count() == raw.count()
        assert store.land_raw(raw.limit(0), "r").count() == 0
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_dataset_and_month_filters_prune_partitions(store, logs):
    store.persist_clean(logs, "d1", "n", "f.csv")
    few = filters.filter_logs(store.scan("d1"), service="order-service", date_from="1996-03-05", date_to="1996-04-01")
    plan = few._jdf.queryExecution().executedPlan().toString()
    partition_filters = plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "dataset_id" in partition_filters and "log_month" in partition_filters
    assert "EqualTo(service_name,order-service)" in plan
    expected = filters.filter_logs(logs, service="order-service", date_from="1996-03-05", date_to="1996-04-01")
    assert few.count() == expected.count() > 0


def test_pages_read_the_months_they_lie_in(store, logs):
    store.persist_clean(logs, "d1", "n", "f.csv")
    stored, size = store.scan(), 400
    plain = stored.drop("log_month")
    for page in (1, 2, 9, 15, 16):
        paged = explore.log_page(stored, page, size)
        assert rows_of(paged.drop("log_month")) == rows_of(explore.log_page(plain, page, size)), page
    plan = explore.log_page(stored, 2, size)._jdf.queryExecution().executedPlan().toString()
    read_filters = [scan.split("PushedFilters:")[0] for scan in plan.split("PartitionFilters:")[1:]]
    assert any("log_month" in part for part in read_filters)


def test_a_service_lies_in_few_files_of_a_month(spark, store, make_logs, tmp_path):
    """Of a month with many files, a filter on a service needs the row groups of few; they are told by their statistics."""
    base = make_logs(*({"service_name": f"s{i}", "endpoint": f"/e{j}"} for i in range(8) for j in range(5)))
    many = base.crossJoin(spark.range(2500)).withColumn("response_time_ms", F.xxhash64("id", "endpoint")).drop("id")
    # Groups as they are dealt out, not put together again as small ones are.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        store.persist_clean(many, "d1", "n", "f.csv")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    groups = duckdb.sql(
        f"""SELECT count(*), count(*) FILTER (WHERE stats_min_value <= 's3' AND stats_max_value >= 's3')
            FROM parquet_metadata('{tmp_path}/db/api_logs/**/*.parquet') WHERE path_in_schema = 'service_name'"""
    ).fetchall()[0]
    assert groups[0] >= 5 and groups[1] <= groups[0] / 3, groups
    assert filters.filter_logs(store.scan("d1"), service="s3").count() == 12_500


def test_id_lookup_has_bloom_filters(store, logs, tmp_path):
    store.persist_clean(logs.where("year(timestamp) = 1996"), "d1", "n", "f.csv")
    wanted = store.scan().first()
    assert explore.log_get(store.scan(), wanted.log_id).first() == wanted
    files = f"{tmp_path}/db/api_logs/**/*.parquet"
    columns = duckdb.sql(
        f"SELECT path_in_schema, bool_and(bloom_filter_offset IS NOT NULL) FROM parquet_metadata('{files}') GROUP BY 1"
    )
    assert {name for name, has in columns.fetchall() if has} == {"log_id"}


def test_incident_table(spark, store, logs):
    found = incidents.detect(logs)
    first = store.record(found, F.lit("2024-01-01 00:00:00")).first()
    assert first.incidents_created == found.count() == store.incidents().count()
    assert store.record(found, F.lit("2024-01-02 00:00:00")).first().incidents_created == 0
    wanted = store.incidents().orderBy("id").first()
    changes = spark.createDataFrame([(wanted.id, "acknowledged", "2024-01-03 00:00:00")], "id string, status string, changed_at string")
    store.update_incidents(changes)
    assert store.incidents().count() == found.count()
    both = spark.createDataFrame([(wanted.id, "resolved", "2024-01-03 02:00:00"), (wanted.id, "acknowledged", "2024-01-03 03:00:00")], changes.schema)
    store.update_incidents(both)
    assert store.incidents().count() == found.count()
    with pytest.raises(LookupError):
        store.update_incidents(spark.createDataFrame([("nobody", "resolved", "2024-01-03 02:00:00")], changes.schema))
    assert store.incidents().where("status = 'acknowledged'").first().id == wanted.id
    again = store.record(found, F.lit("2024-01-04 00:00:00")).first()
    assert (again.incidents_created, again.incidents_already_open) == (1, found.count() - 1)
    assert store.incidents().count() == found.count() + 1


def test_synthetic_logs_are_repeatable(spark):
    made = synthetic.generate(spark, 4000)
    assert rows_of(made) == rows_of(synthetic.synthetic_logs(spark.range(4000).repartition(7), "2024-01-01"))
    assert 4100 < made.count() < 4300
    report = cleaning.report(made).first()
    assert 0.70 < 1 - report.dropped_invalid_status / report.raw_rows < 0.85
    span = made.agg(F.min("timestamp"), F.max("timestamp")).first()
    assert span[0] >= "2024-01-01 00:00:00" and span[1] <= "2024-03-01 00:00:00"
    assert rows_of(made) != rows_of(synthetic.generate(spark, 4000, seed=1))


def test_folder_loads_only_what_is_new(spark, store, make_raw, tmp_path):
    """Twenty files, five of them known by content: fifteen are loaded, each as its own dataset."""
    folder = tmp_path / "folder"
    for i in range(20):
        rows = [{"timestamp": f"2024-{i % 3 + 1:02d}-{d + 1:02d} 00:00:00", "endpoint": f"/{i}"} for d in range(5)] * 2
        csv_logs.write_raw_csv(make_raw(*rows, {"status_code": "999"}).coalesce(1), str(folder), mode="append")
        if i < 5:  # the same rows in another order, under another name
            csv_logs.write_raw_csv(make_raw({"status_code": "999"}, *rows[::-1]).coalesce(1), str(tmp_path / f"known{i}"))
            store.ingest(str(tmp_path / f"known{i}"))
    loads = []
    original = store._append
    store._append = lambda rows, table: (loads.append(table), original(rows, table))
    found = store.ingest_folder(str(folder)).collect()
    assert loads == ["raw_logs", "api_logs", "log_counts", "datasets"]
    assert len(found) == 20 and sum(r.already_loaded for r in found) == 5 and {r.clean_rows for r in found} == {5}
    assert store.list_datasets().count() == 20 and store.scan().count() == 100
    new = next(r for r in found if not r.already_loaded)
    assert store.scan(new.dataset_id).count() == 5 == store.counts(new.dataset_id).agg(F.sum("n")).first()[0]
    assert store._table("raw_logs").where(F.col("dataset_id") == new.dataset_id).count() == 11
    before = rows_of(store.scan())
    loads.clear()
    assert all(r.already_loaded for r in store.ingest_folder(str(folder)).collect()) and not loads
    assert rows_of(store.scan()) == before


def test_failed_folder_load_is_repeated(spark, store, make_raw, tmp_path):
    folder = str(tmp_path / "folder")
    for i in range(3):
        csv_logs.write_raw_csv(make_raw({"endpoint": f"/{i % 2}"}).coalesce(1), folder, mode="append")
    original = store._append

    def fail(rows, table):
        if table == "datasets":
            raise OSError("lost")
        original(rows, table)

    store._append = fail
    with pytest.raises(OSError):
        store.ingest_folder(folder)
    assert store.scan().count() == 0
    store._append = original
    found = store.ingest_folder(folder).collect()
    assert sorted(r.already_loaded for r in found) == [False, False, True]  # two files have the same content
    assert store.scan().count() == 2 and store.list_datasets().count() == 2


def test_content_digests(make_raw):
    def digest(*rows):
        return csv_logs.content_digests(make_raw(*rows)).first().digest

    a, b = {"endpoint": "/a"}, {"endpoint": "/b"}
    assert digest(a, b) == digest(b, a) != digest(a, a, b) != digest(a, b, b)
    assert len({digest({"endpoint": None}), digest({"endpoint": ""}), digest({"endpoint": "-"}), digest({"service_name": None})}) == 4
