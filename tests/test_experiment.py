"""The whole experiment on a few offers: JSON file, bootstraps, tuning, curve, means, command line."""

import json
import os
import subprocess
import sys

import pytest

from twinfold.operators import blocking as B
from twinfold.operators import matching as M
from twinfold.operators.brand import prepare
from twinfold.plans import experiment as X
from twinfold.sources import offers as O

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    """Ten models of two brands, seven of them in two shops."""
    out = {}
    for i in range(10):
        brand = ("sony", "lg")[i % 2]
        model = f"KD{40 + i}X{i}90{i}"
        offer = {"shop": "a.com", "modelID": model, "title": f"{brand} {model} {30 + i} inch tv", "featuresMap": {"Brand": brand, "Screen Size": f"{30 + i} inches", "Weight": f"{10 + i}.5 lbs"}}
        out[model] = [offer] + [offer | {"shop": "b.com", "title": f"{brand} television {model} {30 + i}\""}] * (i < 7)
    path = tmp_path_factory.mktemp("offers") / "offers.json"
    path.write_text(json.dumps(out))
    return str(path)


def test_one_bootstrap_with_curve_and_means(spark, data):
    offers = O.from_json(spark, data)
    assert offers.count() == 17
    assert O.first_clusters(offers, 3).select("cluster_id").distinct().count() == 3
    got = X.run(offers, 1, 5, num_perm=2, min_pc=0.1, trials=1, min_offers=2)
    one = got["results"][0]
    assert one["bands"]["b"] * one["bands"]["r"] == 2
    assert {"precision", "recall", "f1"} <= set(one["test"])
    assert got["mean"].first().f1 == one["test"]["f1"]
    points = one["curve"].collect()
    assert [(p.k_eff, p.b, p.r) for p in points] == [(k, b, r) for k, b, r in B.band_configs(2, 2, above=False)] + [(None, None, None)]
    assert points[-1].fc == 1.0
    assert all(0 <= p.fc <= 1 and 0 <= p.f1 <= 1 for p in points)
    smooth = got["curve"].collect()
    assert [r.fc for r in smooth] == sorted(r.fc for r in smooth)


def test_short_signatures_give_no_candidates_where_asked(spark, data):
    o = prepare(O.from_json(spark, data))
    sigs = B.signatures(o, 4, 1, 2)
    with pytest.raises(Exception, match="shorter"):
        B.candidates(o, sigs, 8, 1, 2).collect()
    assert B.candidates(o, sigs, 8, 1, 2, strict=False).count() == B.block_pairs(B.split_blocks(o, 2)[1]).count()
    assert B.candidates(o, sigs, 4, 1, 2).count() > 0


def test_forbidden_pairs_dissolve_their_cluster(spark):
    found = spark.createDataFrame([("x", "a", "a"), ("x", "a", "b"), ("x", "c", "c"), ("x", "c", "d")], "brand string, cluster_id string, offer_id string")
    edges = spark.createDataFrame([("x", "a", "b", 1.0), ("x", "c", "d", 0.1), ("x", "a", "c", 1.0)], "brand string, oid1 string, oid2 string, d double")
    assert {tuple(r) for r in M.split_forbidden(found, edges).collect()} == {("x", "a", "a"), ("x", "b", "b"), ("x", "c", "c"), ("x", "c", "d")}


def test_command_line(data, tmp_path):
    args = ["--data", data, "--out", str(tmp_path / "out"), "--bootstraps", "0", "--help"]
    got = subprocess.run([sys.executable, "-m", "twinfold.plans.cli", *args], cwd=REPO, capture_output=True, text=True)
    assert got.returncode == 0 and "--min-pc" in got.stdout
