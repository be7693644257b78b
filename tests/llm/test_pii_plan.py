"""Texts are not shuffled where few documents hold an entity that lost its first surrogate."""

import string

from factorweave.llm import pii


def test_few_moved_entities_do_not_shuffle_the_texts(spark):
    texts = [f"Mr {c} paid 10.0.0.{i}." for i, c in enumerate(string.ascii_uppercase)] + ["Mr Smith slept.", None, ""] + ["nothing here"] * 30
    out = pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan, plan
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    names = [rows[i].split()[1] for i in range(27)]
    assert len(set(names)) == 27 and not set(names) & set(string.ascii_uppercase) and rows[27] is None and rows[28] == "" and rows[40] == "nothing here"
