"""Scoring of prediction files against ground-truth files, and cost."""

import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluation as ops
from tallyspark.operators.cost import token_usage, with_cost
from tallyspark.sources.files import read_predictions, read_truth, write_report

TRUTH = dict(
    treatmentDate="01/01/2024", cptCodes=["90832", "36415"], description="Therapy hour", provider="Alpha", insurers=["B", "A"],
    thirdParties=[], totalCharges=100.0, insPaid=60.0, adjustment=None, payments=2.675, balance=0.125, page="1",
)
NAMES = dict(
    treatmentDate="treatment_date", cptCodes="cpt_codes", thirdParties="third_parties", totalCharges="total_charges", insPaid="ins_paid"
)


def prediction(**changes):
    return {**{NAMES.get(k, k): v for k, v in TRUTH.items()}, **changes}


def score(spark, folder, truth, predictions):
    (folder / "gt").mkdir(), (folder / "pred").mkdir()
    for doc, records in truth.items():
        (folder / "gt" / f"{doc}_gt.json").write_text(json.dumps({"doc_id": doc, "records": records}))
    for name, body in predictions.items():
        (folder / "pred" / f"{name}.json").write_text(json.dumps(body, indent=1))
    left, right = read_truth(spark, str(folder / "gt")), read_predictions(spark, str(folder / "pred"))
    overall = {(r["grain"], r["doc_id"], r["field"]): r for r in ops.accuracy(ops.field_matches(left, right)).collect()}
    documents = {r["doc_id"]: r for r in ops.document_scores(left, right).collect()}
    row = overall.get(("overall", None, None))
    return ((row["matched"], row["total"]) if row else None), overall, documents


@pytest.mark.parametrize(
    "predicted, expected",
    [
        ([prediction()], (12, 12)),
        ([prediction(provider="Beta")], (11, 12)),
        (
            [prediction(provider="  Alpha ", description="Therapy\n hour", insurers=["A", "B"], cpt_codes=["36415", "90832"],
                        total_charges=100.001, payments=2.68, balance=0.13)],
            (12, 12),
        ),
        ([TRUTH], (7, 12)),
        ([], (0, 12)),
        ([prediction(), prediction()], (12, 24)),
        ([prediction(insurers=[None, "A"], balance=float("inf"))], (10, 12)),
        ([{k: v for k, v in prediction().items() if k != "adjustment"}], (12, 12)),
    ],
)
def test_one_document(spark, tmp_path, predicted, expected):
    assert score(spark, tmp_path, {"d": [TRUTH]}, {"d_pred": {"records": predicted}})[0] == expected


def test_missing_extra_and_preferred_files(spark, tmp_path):
    overall, grains, documents = score(
        spark, tmp_path, {"a": [TRUTH, TRUTH], "b": [TRUTH]},
        {"b_pred": {"records": []}, "b": {"job_id": "j", "records": [prediction(page="2", provider="x")]}, "z": {"records": [prediction()]}},
    )
    assert overall == (10, 36)
    assert (documents["a"]["status"], documents["a"]["field_accuracy"]) == ("missing_prediction", 0.0)
    assert (documents["b"]["status"], documents["b"]["records_predicted"], documents["b"]["field_accuracy"]) == ("scored", 1, 0.8333)
    assert (grains[("field", None, "page")]["matched"], grains[("field", None, "page")]["total"]) == (0, 3)


def test_duplicate_truth_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([("a",), ("a",), ("b",)], "doc_id string")
    with pytest.raises(ValueError, match="'a'"):
        ops.require_unique_documents(frame)
    assert ops.require_unique_documents(frame.distinct()).count() == 2
    write_report(ops.duplicate_documents(frame), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["copies"] == 2


def test_cost_and_usage(spark):
    million = 1_000_000
    frame = spark.createDataFrame(
        [
            ("gpt-5.4-mini", million, 0, million), ("gpt-5.4-mini", million, million, 0), ("other", million, 0, 0),
            ("gpt-5.4-mini-2026-01-01", million, None, 0), ("gpt-5.4-x", million, 0, 0), ("gpt-5.4-nano", 0, 0, 0),
            ("gpt-5.4", 10, 20, 0),
        ],
        "model string, input bigint, cached_input bigint, output bigint",
    )
    assert [r["cost_usd"] for r in with_cost(frame).collect()] == [2.25, 0.025, 0.25, 0.25, 1.25, 0.0, 0.000002]
    usage = spark.createDataFrame([(100, 50, 0, 0, 7), (None, None, None, None, None)], "i int, o int, t int, c int, r int")
    maps = [r[0] for r in usage.select(token_usage(*[F.col(c) for c in "iotcr"])).collect()]
    assert maps == [{"input": 100, "output": 50, "total": 150, "reasoning": 7}, {"input": 0, "output": 0, "total": 0}]
