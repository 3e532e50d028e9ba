"""Run the stages end to end on the fixture corpus and print the reports.

    python tools/walkthrough.py [sf_dir]

build (items, sampled per direction, and prompts) -> generate (every owed
reply of both models, with a deterministic stand-in judge) -> review (the
second model reviews the first's baseline replies) -> evaluate (judgements,
scores, agreement) -> the report tables. Everything is written under the
session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from verdict.config import FIXTURE
    from verdict.operators import reports
    from verdict.plans import stages
    from verdict.plans.queries import stub_judge
    from verdict.session import build_session, scratch_dir
    from verdict.sources import fixture as fx

    spark = build_session("local[8]", 8)
    root = scratch_dir(spark, "walkthrough")
    cfg = FIXTURE
    models = [m.id for m in cfg.models]

    built = stages.build(fx.corpus(spark, sf_dir), cfg, f"{root}/build")
    log = f"{root}/replies"
    for model in models:
        stages.generate(spark, built["prompts"], log, cfg, stub_judge, model, buckets=4)
    stages.review(spark, built["items"], built["prompts"], log, cfg, stub_judge,
                  model=models[1], reviewer=models[0], buckets=4)
    out = stages.evaluate(spark, log, built["prompts"], cfg, f"{root}/evaluate")

    scores = spark.read.parquet(out["scores"])
    print(f"written under {root}")
    spark.read.parquet(out["summary"]).orderBy("model", "method").show(truncate=False)
    spark.read.parquet(out["agreement"]).show()
    reports.report_headline(scores, models).orderBy("method", "shots").show()
    reports.report_views(scores).show()
    reports.report_methods(scores, models).orderBy("label").show()


if __name__ == "__main__":
    main()
