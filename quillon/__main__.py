"""python -m quillon validate FILE | evaluate BARS EXPR [HORIZON [MINUTES]] | try BARS EXPR MINUTES START END [KIND [HORIZON]] | task-bank EVALUATIONS OUT.yaml [MAX_SEEDS] | build-prompts BANK OUT [MODE]"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from quillon.operators import scoring, seeds
from quillon.plans.expr import validate
from quillon.sources import bars, tables
from quillon.sources.config import read_config


def main(args: list[str]) -> int:
    if not args or args[0] not in ("validate", "evaluate", "try", "task-bank", "build-prompts"):
        print(__doc__)
        return 2
    if args[0] == "validate":
        data = read_config(args[1])
        bad = 0
        for row in tables.candidate_rows(data.get("seeds", []) if isinstance(data, dict) else data):
            verdict = validate(row[3])
            bad += not verdict.valid
            print(json.dumps({"id": row[1], "valid": verdict.valid, "reasons": verdict.reasons}, ensure_ascii=False))
        return int(bad > 0)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args[0] == "evaluate":
        horizon, minutes = (int(args[i]) if len(args) > i else n for i, n in ((3, 1), (4, 5)))
        out = seeds.evaluate(bars.scan(spark, args[1]), [("given", args[2])], horizon, seeds.smoke_warmup(minutes))
        for row in out.toJSON().toLocalIterator():  # a row a symbol, a partition at a time
            print(row)
    elif args[0] == "try":
        kind, horizon = args[6] if len(args) > 6 else "direction", int(args[7]) if len(args) > 7 else None
        row = scoring.try_out(bars.scan(spark, args[1]), args[2], args[4], args[5], int(args[3]), kind, horizon).first()
        print(json.dumps(row.asDict()))
        return int(not row.valid)
    elif args[0] == "build-prompts":
        seeds.prompts(tables.load_tasks(spark, args[1]), args[3] if len(args) > 3 else "seeded_ocd", "You design factors from the operators of the factor language.").write.mode("overwrite").parquet(args[2])
    else:
        splits = spark.createDataFrame(seeds.SPLITS, "name string, start_date string, end_date string, weight double")
        tables.save_tasks(seeds.task_bank(tables.load_evaluations(spark, args[1]), splits, int(args[3]) if len(args) > 3 else 64), args[2])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
