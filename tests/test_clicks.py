import pytest

from quillspark.plans import eval_queries as Q

QUERY = 1704164021_500_000  # 2024-01-02T02:53:41.5Z
AFTER = {  # a written click time and the microseconds that it lies after the query; None: unusable
    "2024-01-02T02:53:49.250Z": 7_750_000, "2024-01-02T03:53:49+01:00": 7_500_000, "2024-01-02 02:53:49": 7_500_000, "2024-01-02T02:53:49.75": 8_250_000,
    "20240102T025349Z": 7_500_000, "20240102T025349.5Z": 8_000_000, "2024-01-02T03:53:49+0100": 7_500_000, "1704164029": 7_500_000, "1704164029.25": 7_750_000,
    "1704164029250": 7_750_000, "1704164029250001": 7_750_001, "Tue, 02 Jan 2024 02:53:49 +0000": 7_500_000, "2024-01-02": None, "n/a": None, None: None,
}


@pytest.fixture()
def logs(spark, tmp_path):
    n = range(len(AFTER))
    spark.createDataFrame([(f"r{i}", "2024-01-02T02:53:41.500000+00:00", "bm25") for i in n], "request_id string, timestamp string, mode string").write.parquet(f"{tmp_path}/query_log.parquet")
    spark.createDataFrame([(f"r{i}", x, 2) for i, x in zip(n, AFTER)], "request_id string, timestamp string, clicked_rank int").write.parquet(f"{tmp_path}/click_log.parquet")
    return str(tmp_path)


def test_click_times_of_every_form(spark, logs):
    got = {r.timestamp: r.c_micros and r.c_micros - QUERY for r in Q.clicks(spark, logs).collect()}
    assert got == AFTER


def test_success_and_first_ranks(spark, logs):
    assert [tuple(r) for r in Q.search_success_rate(spark, logs).collect()] == [("bm25", 15, 12, 0.8)]
    assert [tuple(r) for r in Q.first_click_rank(spark, logs).collect()] == [(12, 2.0)]
