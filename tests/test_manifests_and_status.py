import json

import pytest
from pyspark.sql import functions as F

from voxelweave import checks, schemas
from voxelweave.checks import ContractError
from voxelweave.operators import manifests, upserts
from voxelweave.plans import reports, status
from voxelweave.sources import sinks, tables
from voxelweave.streaming import progress

STATUS_KEYS = "model string, language string, roi_family string, block int, state string"


def test_sample_summary(spark):
    sample = spark.createDataFrame(
        [("EN", "S1", 9, True, ""), ("EN", "S2", 9, False, "motion"), ("FR", "S3", 9, True, "")],
        "language string, subject_id string, n_canonical_runs bigint, included boolean, exclusion_reason string",
    )
    rois = spark.createDataFrame([("EN", "S1", 1, 300), ("EN", "S2", 1, 330), ("FR", "S3", 1, 280)], "language string, subject_id string, canonical_run int, n_scans int")
    got = {r.language: (r.n_subjects, r.n_runs, r.mean_duration, r.any_exclusions) for r in reports.sample_summary(sample, rois).collect()}
    assert got == {"EN": (1, 9, 600.0, "motion"), "FR": (1, 9, 560.0, "none")}


def test_sample_manifest_keeps_one_sided_subjects(spark):
    runs = spark.createDataFrame([("EN", "A", r, True, 10) for r in (1, 2)] + [("EN", "B", 1, True, 10), (None, "X", 1, True, 1)], "language string, subject_id string, canonical_run int, is_valid boolean, n_trs int")
    rois = spark.createDataFrame([("EN", "A", r, 18, 300) for r in (1, 2)] + [("EN", "C", 1, 0, 300)], "language string, subject_id string, canonical_run int, n_rois int, n_scans int")
    got = {r.subject_id: (r.included, r.exclusion_reason) for r in manifests.sample_manifest(runs, rois, 2).collect()}
    assert got == {
        "A": (True, ""), "B": (False, "canonical_runs=1;roi_runs=0;missing_roi_targets"),
        "C": (False, "canonical_runs=0;roi_runs=1;invalid_run_manifest_rows;missing_roi_targets"),
    }


def test_model_inventory(spark):
    models = spark.createDataFrame([("a", 4, "ATTN,FFN"), ("b", 4, "ATTN"), ("c", 4, "ATTN,FFN")], "model string, hidden_size int, default_states string")
    states = spark.createDataFrame([("a", "FFN", 0, [1.0] * 4), ("a", "ATTN", 1, [1.0] * 4), ("b", "FFN", 0, [1.0] * 4)], "model string, state string, block int, vec array<float>")
    qc = spark.createDataFrame([("a", 1e-7), ("b", 2e-4)], "model string, max_abs_diff double")
    got = {r.model: (r.n_blocks, r.states_extracted, r.output_equivalence, r.cache_size_summary) for r in reports.model_inventory(models, states, qc).collect()}
    assert got == {"a": (2, "ATTN,FFN", "PASS", "0.00 MB"), "b": (1, "FFN", "FAIL", "0.00 MB"), "c": (0, "ATTN,FFN", "NOT_RUN", "0.00 MB")}


def test_upsert_matches_null_scopes(spark):
    schema = "model string, shuffle int, v int"
    old = spark.createDataFrame([("a", None, 1), ("a", 0, 2), ("b", None, 3)], schema)
    new = spark.createDataFrame([("a", None, 9)], schema)
    assert sorted((r.model, r.shuffle is None, r.v) for r in upserts.upsert_scope(old, new, ["model", "shuffle"]).collect()) == [("a", False, 2), ("a", True, 9), ("b", True, 3)]


def test_shard_unions(spark):
    a = spark.createDataFrame([("EN", 1), ("EN", 2)], "language string, k int")
    with pytest.raises(ContractError, match="Duplicate"):
        upserts.merge_unique([a, a.limit(1)], ["language", "k"], "state")
    assert upserts.merge_distinct([a, a], ["language", "k"]).count() == 2
    with pytest.raises(ContractError):
        upserts.demand_languages(a, spark.createDataFrame([("EN",), ("FR",)], "language string"))
    upserts.demand_languages(a, spark.createDataFrame([("en",)], "language string"))
    ids = spark.createDataFrame([(1,), (1,)], "triplet_id int")
    out = upserts.consolidate({"triplet_ids": [ids, ids]})
    assert out["triplet_ids"].count() == 1
    assert upserts.table_differences(a, a.orderBy(F.desc("k"))).count() == 0


def test_state_selection_precedence():
    pick = lambda **k: checks.choose_states(**{"everything": False, "argument": None, "configured": None, "observed": ["FFN", "ATTN"], **k})
    assert pick(everything=True, argument=["x"]) == ("ATTN", "FFN")
    assert pick(argument=["ffn", "ffn", "attn"], configured=["OUTPUT"]) == ("FFN", "ATTN")
    assert pick(configured=["output"]) == ("OUTPUT",) and pick() == ("ATTN", "FFN")


def test_scope_filter_and_required_columns(spark):
    df = spark.createDataFrame([("xlmr", "EN"), ("nllb", "FR")], "model string, language string")
    assert checks.in_scope(df, model=["XLMR"], language=[]).count() == 1
    with pytest.raises(ContractError, match="block"):
        checks.require_columns(df, ["model", "block"])


def test_campaign_status(spark, tmp_path):
    settings = spark.createDataFrame([("xlmr", "EN", "SEMANTIC", 3, "FFN"), ("xlmr", "FR", "SEMANTIC", 4, "FFN")], STATUS_KEYS)
    counts = spark.createDataFrame([("EN", 2), ("FR", 1)], "language string, n_subjects bigint")
    doc = {
        "status": "running", "model": "xlmr", "target_language": "EN", "roi_family": "SEMANTIC", "representative_block": 3, "representative_state": "FFN",
        "subject_ids_total": 2, "completed_subject_ids": ["S1"], "rows_written": 2, "resume_count": 1, "current_subject_id": "S2", "updated_utc": "2024-01-01T00:00:09Z",
        "subject_progress": {"S2": {"status": "partial", "completed_ks": [1], "updated_utc": "x"}},
    }
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    documents = tables.read_json_document(spark, str(tmp_path / "doc.json"), schemas.PROGRESS_DOCUMENT)
    assert documents.first().subject_progress["S2"].completed_ks == [1]
    renamed = {"target_language": "language", "representative_block": "block", "representative_state": "state"}
    log = str(tmp_path / "log")
    event = ("xlmr", "EN", "SEMANTIC", 3, "FFN")
    for stamp, name in (("2024-01-01T00:00:01Z", "started"), ("2024-01-01T00:00:05Z", "row_written")):
        sinks.append_events(
            spark.createDataFrame([(stamp, name, *event, "S1")], schemas.PROGRESS_EVENT), log
        )
    events = tables.read_events(spark, log, schemas.PROGRESS_EVENT).withColumnRenamed("target_language", "language")
    rows = status.setting_status(settings, counts, documents.withColumnsRenamed(renamed), events, 2).cache()
    totals = status.campaign_totals(rows).first()
    assert (totals.settings_total, totals.settings_running, totals.settings_not_started) == (2, 1, 1)
    assert (totals.rows_written_total, totals.expected_k_slots_total, totals.completed_subjects_total, totals.subject_ids_total) == (2, 6, 1, 3)
    assert totals.last_event == "row_written" and totals.rows_progress_ratio == pytest.approx(1 / 3)
    assert [(r.language, r.block) for r in status.next_settings(rows).collect()] == [("FR", 4)]
    stream = progress.latest_per_setting(progress.follow_events(spark, log))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("progress").first().last_event == "row_written"


def test_empty_campaign_has_no_division_by_zero(spark):
    empty = status.setting_status(
        spark.createDataFrame([], STATUS_KEYS), spark.createDataFrame([], "language string, n_subjects bigint"),
        spark.createDataFrame([], STATUS_KEYS + ", status string, subject_ids_total int, completed_subject_ids array<string>, rows_written bigint, resume_count int, current_subject_id string, updated_utc string"),
        spark.createDataFrame([], STATUS_KEYS + ", timestamp_utc string, event string"), 2,
    )
    assert status.campaign_totals(empty).first().rows_progress_ratio == 0.0


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_csv_delimiters(spark, tmp_path, sep):
    path = tmp_path / "a.csv"
    path.write_text(f"section{sep}time{sep}f0\n1{sep}0.5{sep}110.0\n")
    assert tuple(tables.read_csv_auto(spark, str(path), "section int, time double, f0 double").first()) == (1, 0.5, 110.0)


def test_shard_discovery(spark, tmp_path):
    base = str(tmp_path / "results.parquet")
    for tag in ("EN", "FR"):
        spark.createDataFrame([(tag, 1)], "language string, v int").write.parquet(tables.tagged(base, tag))
    found = tables.shard_paths(spark, base)
    assert len(found) == 2 and {(r.language, r.shard_tag) for r in tables.read_shards(spark, found).collect()} == {("EN", "EN"), ("FR", "FR")}
    assert tables.shard_paths(spark, base, listed=found[:1]) == found[:1]
    with pytest.raises(FileNotFoundError, match="ZH"):
        tables.shard_paths(spark, base, listed=[*found, tables.tagged(base, "ZH")])
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(FileNotFoundError):
        tables.shard_paths(spark, str(tmp_path / "other.parquet"))


def test_heatmap_is_dense(spark):
    rows = [("EN", "m", 2, 1.0, "FFN", c, roi, "SEMANTIC", z) for c, zs in (("SHARED", (0.4, 0.6)), ("SPECIFIC", (0.1, 0.1))) for roi, z in zip(("L_AG", "R_AG"), zs)]
    df = spark.createDataFrame(rows, "language string, model string, block int, block_depth_norm double, state string, condition string, roi string, roi_family string, mean_z double")
    got = {(r.state, r.block): r.delta_z_mean for r in reports.depth_heatmap(df).collect()}
    assert len(got) == 15 and got["FFN", 2] == pytest.approx(0.4) and got["INPUT", 0] is None


def test_baseline_layouts(spark):
    keys = "model string, language string, roi_family string"
    a = spark.createDataFrame([("m", "EN", "SEMANTIC", "SHARED", 0.5), ("m", "EN", "SEMANTIC", "SPECIFIC", 0.2)], keys + ", condition string, mean_z double")
    b = spark.createDataFrame([("m", "EN", "SEMANTIC", 0.3)], keys + ", delta_z_mean double")
    c = spark.createDataFrame([("m", "EN", "SEMANTIC", 0.3)], keys + ", shared_minus_specific double")
    for frame in (reports.baseline_deltas(a), reports.baseline_deltas(b), reports.baseline_deltas(None, c)):
        assert frame.first().delta_z_mean == pytest.approx(0.3)
    assert reports.baseline_deltas(None) is None
