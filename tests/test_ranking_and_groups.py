import math
import random
from itertools import combinations
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import groups as g
from gradeloom.operators import ranking as r

ROWS = [("a", 1, 3.0, 1.0), ("a", 2, 1.0, 0.0), ("a", 3, 1.0, 1.0), ("a", 4, 2.0, 0.5), ("one", 1, 5.0, 1.0), ("same", 1, 1.0, 0.5), ("same", 2, 2.0, 0.5), ("flat", 1, 4.0, 0.0), ("flat", 2, 4.0, 1.0)]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(ROWS, "prompt string, ord int, score double, label double")


def by_prompt(df, column):
    return {x["prompt"]: x[column] for x in df.collect()}


def test_pairwise_against_plain_python(labelled):
    got = {x["prompt"]: (x["pairwise_acc"], x["resolution"], x["pairs_used"]) for x in r.pairwise_metrics(labelled).collect()}
    for prompt in {x[0] for x in ROWS}:
        pairs = [(a, b) for a, b in combinations([x for x in ROWS if x[0] == prompt], 2) if a[3] != b[3]]
        credit = [0.5 if a[2] == b[2] else float((a[3] > b[3]) == (a[2] > b[2])) for a, b in pairs]
        want = (mean(credit), mean(abs(a[2] - b[2]) for a, b in pairs), len(pairs)) if pairs else (0, 0, 0)
        assert got[prompt] == pytest.approx(want)
    assert r.pairwise_metrics(labelled, keep_empty=False).count() == 2


def test_correlations_are_null_where_undefined(labelled):
    assert by_prompt(r.spearman(labelled), "rho")["flat"] is None
    tau = by_prompt(r.kendall_tau_b(labelled), "tau")
    assert tau["same"] is None and tau["flat"] is None
    assert tau["a"] == pytest.approx((3 - 1) / math.sqrt(5 * 5))


def test_auroc_and_ndcg(labelled):
    assert by_prompt(r.auroc(labelled), "auc") == {"a": pytest.approx((1 + 1 + 0.5 + 0) / 4), "flat": 0.5}
    assert by_prompt(r.auroc_input_order(labelled), "auc")["flat"] == 0.0
    assert set(by_prompt(r.ndcg(labelled, 4, min_rows=4), "ndcg")) == {"a"}


def test_legacy_ties_change_tied_pairs_only(labelled):
    new = r.confident_pairs_pooled(labelled).filter("threshold = 0.1").first()
    old = r.confident_pairs_pooled(labelled, legacy_ties=True).filter("threshold = 0.1").first()
    assert new["n_pairs"] == old["n_pairs"] and new["accuracy"] != old["accuracy"]


def test_empty_tables(labelled):
    none = labelled.limit(0)
    assert r.pairwise_metrics(none).count() == 0 and r.spearman(none).count() == 0 and r.auroc(none).count() == 0


GROUPS = [(1, "g", 1.0, 2), (2, "g", 3.0, 1), (3, "g", 3.0, 5), (4, "one", 7.0, 4), (5, "flat", 2.0, 1), (6, "flat", 2.0, 1)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(GROUPS, "sample_id long, uid string, score double, length int")


def adv(df):
    return {x["sample_id"]: x["advantage"] for x in df.collect()}


def test_one_row_groups_differ_by_estimator(scored):
    assert adv(g.grpo(scored))[4] == pytest.approx(7.0, abs=1e-4)
    assert adv(g.rloo(scored))[4] == 7.0 and adv(g.rloo_vectorized(scored))[4] == 0.0
    assert adv(g.normalise_for_display(scored))[4] == 0.0
    with pytest.raises(Exception, match="two rows"):
        g.pass_at_k(scored).collect()


def test_estimators_against_plain_python(scored):
    s = [1.0, 3.0, 3.0]
    assert adv(g.grpo(scored))[1] == pytest.approx((1 - mean(s)) / (stdev(s) + 1e-6))
    assert adv(g.rloo(scored))[1] == pytest.approx(1 - 3)
    assert adv(g.opo(scored))[1] == pytest.approx(1 - (2 + 3 + 15) / 8)
    assert adv(g.grpo(scored))[5] == 0.0
    assert adv(g.pass_at_k(scored, strict=False))[2] == 0.0  # a tie at the top


def test_registry(scored):
    assert set(adv(g.get_estimator("gpg")(scored))) == {1, 2, 3, 4, 5, 6}
    with pytest.raises(ValueError):
        g.get_estimator("none")


def test_gdpo_is_a_weighted_sum(scored):
    both = adv(g.gdpo(scored.withColumn("b", F.col("score") * 2), {"score": 1.0, "b": 1.0}))
    assert both[1] == pytest.approx(2 * adv(g.grpo(scored))[1], rel=1e-4)


def test_pair_counts_against_all_pairs(spark):
    """Prompts with ties, many labels, negative and huge scores, nulls, and one row."""
    rng = random.Random(5)
    rows = [(p_, k, rng.choice([None, -3.5, 0.0, 1.0, 2.0, 1e9, rng.uniform(-50, 50)]), rng.choice([None, 0.0, 0.25, 0.5, 1.0])) for p_ in "abc" for k in range(60)] + [("d", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "prompt string, ord long, score double, label double")
    got = {r["prompt"]: r for r in r.pairwise_metrics(df).collect()}
    pooled = {r["threshold"]: r for r in r.confident_pairs_pooled(df, (0.25, 0.5), legacy_ties=True).collect()}
    tau = {r["prompt"]: r["tau"] for r in r.kendall_tau_b(df).collect()}
    legacy = {0.25: [], 0.5: []}
    for name in "abcd":
        own = [x for x in rows if x[0] == name and x[2] is not None and x[3] is not None]
        pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
        sign = lambda v: (v > 0) - (v < 0)
        used = [(a, b) for a, b in pairs if a[3] != b[3]]
        credit = [0.5 if a[2] == b[2] else float((a[2] > b[2]) == (a[3] > b[3])) for a, b in used]
        assert got[name]["pairs_used"] == len(used)
        assert got[name]["pairwise_acc"] == pytest.approx(sum(credit) / len(used) if used else 0)
        assert got[name]["resolution"] == pytest.approx(sum(abs(a[2] - b[2]) for a, b in used) / len(used) if used else 0)
        for t in legacy:
            legacy[t] += [1.0 if (a[3] > b[3]) == (a[2] > b[2]) else 0.5 if a[2] == b[2] else 0.0 for a, b in used if abs(a[3] - b[3]) >= t]
        net = sum(sign(a[2] - b[2]) * sign(a[3] - b[3]) for a, b in pairs)
        free = [sum(a[c] != b[c] for a, b in pairs) for c in (2, 3)]
        if free[0] and free[1]:
            assert tau[name] == pytest.approx(net / (free[0] * free[1]) ** 0.5)
    for t, all_credit in legacy.items():
        assert pooled[t]["n_pairs"] == len(all_credit) and pooled[t]["accuracy"] == pytest.approx(sum(all_credit) / len(all_credit))
