"""The language model's scores of texts that it has not learned from."""

import math

import rankdiag.llm.suite as suite


def test_held_out_scores_are_finite_and_near_the_word_model(spark):
    rows = suite.QUERIES["op5_lattice_lm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert rows and all(r["score"] is not None and math.isfinite(r["score"]) for r in rows)
    # The add-one model gives any number of new words a share each, so a model whose shares sum to 1 may be a bit below.
    assert sum(r["score"] for r in rows) >= 1.1 * sum(r["base_score"] for r in rows)
