import json

import pytest
from pyspark.sql import functions as F

from examlens.operators import cohorts
from examlens.session import shared_folder
from examlens.sources import readers, schemas, writers


def _cohort(year, grades, averages, counts=None):
    ids = [g[0] for g in grades]
    return {
        "year": year,
        "grades": [{"id": i, "members": m, "max_points": p} for i, m, p in grades],
        "totals_by_grade": {i: 10 * (n + 1) for n, i in enumerate(ids)},
        "avg_score_by_grade": averages,
        "counts_by_grade": counts or {i: [1, 3] for i in ids},
        "bins": [
            {"range_default": {"min": 0, "max": 10}, "ranges_by_grade": {"4": {"min": 0, "max": 20}}},
            {"range_default": {"min": 10, "max": 20}},
        ],
    }


FULL = [
    ("3", [3], 120),
    ("4", [4], 120),
    ("5-6", [5, 6], 120),
    ("7-9", [7, 8, 9], 150),
    ("10", [10], 150),
    ("11-13", [11, 12, 13], 150),
    ("overall", [], 0),
]


def test_cohort_files(spark, tmp_path):
    averages = {"3": 60.0, "4": None, "5-6": 70.0, "7-9": 80.0, "10": 90.0, "11-13": 100.0}
    (tmp_path / "human_2001.json").write_text(json.dumps(_cohort(2001, FULL, averages), indent=2))
    (tmp_path / "human_2002.json").write_text(json.dumps(_cohort(2002, FULL, averages), indent=2))
    rows = readers.read_cohorts(spark, str(tmp_path / "human_*.json"))
    got = {(r.year, r.exam): r for r in cohorts.human_scores(rows).collect()}
    assert len(got) == 10
    mixed = got[2001, "3-4"]
    # grade 4 has no mean: midpoints 10 and 15 with counts 1 and 3
    assert mixed.human_score == pytest.approx((10 * 60 + 20 * (10 + 45) / 4) / 30)
    assert mixed.human_mean_source == "histogram" and mixed.human_grades_used == "3,4"
    assert got[2001, "5-6"].human_mean_source == "reported"
    # 7-8 is covered by the overlapping record; 9-10 by '10' first, then the overlap
    assert got[2001, "7-8"].human_grades_used == "7-9"
    assert got[2001, "9-10"].human_grades_used == "10,7-9"
    assert got[2001, "11-13"].human_pct == pytest.approx(100 * 100 / 150)
    only = cohorts.human_scores(rows, histogram_means=True)
    assert {r.human_mean_source for r in only.collect()} == {"histogram"}


def test_uncovered_grades_are_an_error(spark, tmp_path):
    averages = {g[0]: 50.0 for g in FULL}
    document = _cohort(2003, [g for g in FULL if g[0] != "11-13"], averages)
    (tmp_path / "h.json").write_text(json.dumps(document))
    rows = readers.read_cohorts(spark, str(tmp_path / "h.json"))
    with pytest.raises(Exception, match="do not cover 2003 11-13"):
        cohorts.human_scores(rows).collect()


def test_missing_cohort_files_are_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.read_cohorts(spark, str(tmp_path / "none_*.json")).collect()


def test_item_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="sol_E_image_bin"):
        readers.validate_item_columns([c for c in schemas.REQUIRED_ITEM_COLUMNS if c != "sol_E_image_bin"])
    rows = spark.range(3).select(F.col("id"))
    writers.conform(rows, schemas.ITEMS).write.parquet(str(tmp_path / "items"))
    items = readers.read_items(spark, str(tmp_path / "items"), ["id", "year"])
    assert items.columns == ["id", "year"] and dict(items.dtypes)["id"] == "string"
    assert "question_image" not in items._jdf.queryExecution().executedPlan().toString()


def test_runs_are_tagged_by_folder(spark, tmp_path):
    schema = "id string, source_id string, predicted string"
    for run in ("r1", "r2", "other"):
        spark.createDataFrame([("1", "1", run)], schema).write.parquet(str(tmp_path / run / "results.parquet"))
    catalogue = readers.run_catalogue(spark, [("r1", "a", "full", "w"), ("r2", "b", "repeat", "w")])
    got = {r.run_id: r for r in readers.read_runs(spark, str(tmp_path), catalogue).collect()}
    assert {k: (r.model, r.predicted) for k, r in got.items()} == {"r1": ("a", "r1"), "r2": ("b", "r2")}
    assert got["r1"].fallback_parse is None


@pytest.mark.parametrize(
    "limit, seconds",
    [
        ("2", 0.5),
        ("0", None),
        ('{"min_interval_seconds": 0, "requests_per_second": 5}', 0.0),
        ('{"min_interval_seconds": -1, "requests_per_second": 5}', 0.2),
        ('{"requests_per_second": 0, "requests_per_minute": 30}', 2.0),
        ('"fast"', None),
        (None, None),
    ],
)
def test_rate_limits(spark, limit, seconds):
    row = spark.createDataFrame([(limit,)], "l string").select(
        readers.seconds_per_request(F.col("l")).alias("s")
    ).first()
    assert row.s == seconds


def test_registry_file(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(
        json.dumps({"models": [{"id": "a", "label": "A", "supports_vision": True, "rate_limit": 4}, {"id": "b"}]}, indent=1)
    )
    got = {r.id: r for r in readers.read_registry(spark, str(path)).collect()}
    assert got["a"].min_request_interval == 0.25 and got["a"].supports_vision
    assert got["b"].min_request_interval is None and not got["b"].supports_vision


def test_empty_results_keep_their_schema(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, predicted string")
    writers.write_results(empty, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.columns == schemas.RUN_RECORD.names and back.count() == 0


def test_run_logs_are_packed_and_complete(spark, tmp_path):
    rows = spark.range(2000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 10 == 0, "HTTP 500").alias("error"),
        F.array(F.lit("no_parse")).alias("warnings"),
    )
    written = writers.conform(rows, schemas.RUN_RECORD)
    writers.write_run_logs(written, rows.select("id"), str(tmp_path))
    logged = spark.read.schema(schemas.RUN_RECORD).json(f"{tmp_path}/results.jsonl")
    assert logged.exceptAll(written).isEmpty() and logged.count() == 2000
    assert spark.read.json(f"{tmp_path}/failures.jsonl").count() == 200
    assert spark.read.json(f"{tmp_path}/raw_responses.jsonl").count() == 2000
    text = spark.read.text(f"{tmp_path}/results.jsonl").agg(F.sum(F.length("value"))).first()[0]
    stored = sum(f.stat().st_size for f in (tmp_path / "results.jsonl").glob("part-*"))
    assert stored < text / 5


class _Session:
    """Just the two attributes that choose the folder."""

    def __init__(self, folder, master):
        class Conf:
            def get(self, name, default=None):
                return folder if name == "spark.checkpoint.dir" else default

        self.conf = Conf()
        self.sparkContext = type("Context", (), {"master": master, "getConf": Conf})()


def test_shared_folder_is_read_from_the_session():
    assert shared_folder(_Session("s3://x/shared/", "yarn"), "p").startswith("s3://x/shared/p-")


def test_a_cluster_without_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Session(None, "yarn"), "p")


def _orders(spark, folder, rows):
    """A small orders table; a query over it reads nothing else."""
    key = F.col("id") + 1
    spark.range(rows).select(
        key.alias("o_orderkey"),
        F.timestamp_seconds(F.lit(800000000) + key * 86400).alias("o_orderdate"),
        F.element_at(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), (key % 2 + 1).cast("int")).alias("o_orderpriority"),
    ).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_item_scan_sends_no_item_table_to_the_driver(spark, tmp_path):
    from examlens.plans import catalog

    scanned = catalog.QUERIES["a1_a9_b12_item_scan"](spark, _orders(spark, tmp_path, 40))
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert scanned.agg(F.sum("items")).first()[0] == 40
