"""What the enhanced answer plan writes per hit is narrow: whole texts of hits aren't checkpointed."""

from pyspark.sql import functions as F

from vellumine.plans import enhanced as P
from vellumine.workload import load


def test_hits_carry_heads_only(spark, monkeypatch):
    cut, longest = P.cut_lineage, []

    def watched(df):
        out = cut(df)
        if "content" in out.columns:
            longest.append((out.agg(F.max(F.length("content"))).first()[0], out.where("rank > 5 AND content IS NOT NULL").count()))
        return out

    monkeypatch.setattr(P, "cut_lineage", watched)
    assert load()[0]["enhanced_answers"](spark, "/root/testdata/sf0.001").count() > 0
    assert longest and all(n <= 500 and beyond == 0 for n, beyond in longest), longest
